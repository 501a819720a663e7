"""Present the sales star (orders, lineitem, part, ...) as the ten base tables.

Order-level facts need one aggregation of lineitem by order key. That frame is
one row per order; `star_tables` lets the caller store it (``stage``) so the
three tables cut from it do not repeat the shuffle.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.exprs import money
from ledgerline.schemas import PERCENT, TABLES

# Order status, sales channel and return reason vocabulary.
STATUS = {"F": "Completed", "O": "Returned", "P": "Cancelled"}
CHANNEL = {"1": "Direct", "2": "Direct", "3": "Partner", "4": "Online", "5": "Online"}
REASONS = ["Defective", "Wrong Item", "Unsatisfied"]


def _mapping(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _cents(name: str) -> Column:
    return F.rint(F.col(name) * 100).cast("bigint")


def _whole(number: Column) -> Column:
    """Rounded to a whole number, halves up."""
    return F.floor(number + 0.5).cast("bigint")


def _region_id(key: str) -> Column:
    return F.concat(F.lit("REG"), F.lpad((F.col(key) + 1).cast("string"), 2, "0"))


def order_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has items, with its rep, delay and percent off."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    per_order = (
        read("lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_suppkey").alias("suppkey"),
            F.min(F.to_date("l_shipdate")).alias("first_ship"),
            F.min("l_discount").alias("least_discount"),
            F.sum(_whole(F.col("l_extendedprice") * F.col("l_tax") * 100)).alias("tax_cents"),
        )
    )
    rep_region = (
        read("supplier")
        .join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", _region_id("n_regionkey").alias("region_id"))
    )
    order_date = F.to_date("o_orderdate")
    delay = F.lit(1) + F.pmod(F.date_diff("first_ship", order_date), F.lit(14))
    return (
        read("orders")
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(rep_region, F.col("suppkey") == F.col("s_suppkey"), "left")
        .select(
            "o_orderkey",
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.col("suppkey").cast("string").alias("sales_rep_id"),
            "region_id",
            order_date.alias("order_date"),
            _mapping(STATUS)[F.col("o_orderstatus")].alias("order_status"),
            _mapping(CHANNEL)[F.substring("o_orderpriority", 1, 1)].alias("sales_channel"),
            delay.cast("int").alias("delay_days"),
            (F.lit(5) * F.rint(F.col("least_discount") * 100)).cast("int").alias("percent_off"),
            _whole(F.col("o_totalprice") * 100).alias("price_cents"),
            "tax_cents",
        )
    )


def star_tables(
    spark: SparkSession, sf_dir: str, stage: Callable[[DataFrame], DataFrame] = lambda df: df
) -> dict[str, DataFrame]:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    heads = stage(order_heads(spark, sf_dir))

    regions = (
        read("region")
        .join(read("nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
        .groupBy(_region_id("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))
        .agg(F.min("n_name").alias("country"))
    )
    reps = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("sales_rep_id"),
        F.col("s_name").alias("sales_rep_name"),
        _region_id("n_regionkey").alias("region_id"),
    )
    customers = read("customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("customer_segment"),
        F.date_add(F.lit("1994-01-01").cast("date"), (F.col("c_custkey") % 500).cast("int")).alias("created_date"),
    )
    price = money(_cents("p_retailprice").cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)"))
    products = read("part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        price.alias("base_price"),
        money(price * F.lit("0.6").cast("decimal(2,1)")).alias("cost_price"),
    )
    unit_cents = F.expr(
        "cast(rint(l_extendedprice * 100) as bigint) div nullif(cast(l_quantity as bigint), 0)"
    )
    items = read("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("order_item_id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        money(unit_cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).alias("unit_price"),
    )
    orders = heads.select(
        "order_id", "customer_id", "sales_rep_id", "region_id", "order_date",
        F.date_add("order_date", F.col("delay_days")).alias("shipping_date"),
        "order_status", "sales_channel", "delay_days",
    )
    discounts = heads.filter("percent_off > 0").select(
        F.concat(F.lit("DSC"), "order_id").alias("discount_id"),
        "order_id",
        (F.col("percent_off").cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)"))
        .cast(PERCENT)
        .alias("discount_percentage"),
        F.concat(F.lit("PROMO"), F.col("percent_off").cast("string")).alias("discount_code"),
    )
    back_after = (F.col("delay_days") + 2 + F.col("o_orderkey") % 9).cast("int")
    by_key = F.element_at(F.array(*[F.lit(r) for r in REASONS]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    returns = heads.filter("order_status = 'Returned'").select(
        F.concat(F.lit("RET"), "order_id").alias("return_id"),
        "order_id",
        F.date_add("order_date", back_after).alias("return_date"),
        F.when(F.col("delay_days") > 5, "Late Delivery").otherwise(by_key).alias("return_reason"),
    )

    # What a region spends in a month: the tax on its orders, by their sales channel.
    dollars = lambda cents: money(F.sum(cents).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)"))
    month = F.date_format("order_date", "yyyy-MM")
    placed = heads.filter("region_id IS NOT NULL")
    spend = (
        placed.groupBy("region_id", month.alias("campaign_month"), F.col("sales_channel").alias("marketing_channel"))
        .agg(dollars("tax_cents").alias("spend_amount"))
        .withColumn("spend_id", F.concat_ws("-", F.lit("MKT"), "region_id", "campaign_month", "marketing_channel"))
    )
    # A month's target: what the region's orders came to in the same month of the year before.
    last = heads.agg(F.date_format(F.max("order_date"), "yyyy-MM")).scalar()
    targets = (
        placed.groupBy("region_id", F.date_format(F.add_months("order_date", 12), "yyyy-MM").alias("target_month"))
        .agg(dollars("price_cents").alias("target_revenue"))
        .filter(F.col("target_month") <= last)
        .withColumn("target_id", F.concat_ws("-", F.lit("TGT"), "region_id", "target_month"))
    )
    tables = {
        "customers": customers, "products": products, "regions": regions, "reps": reps,
        "orders": orders, "order_items": items, "discounts": discounts, "returns": returns,
        "marketing_spend": spend, "monthly_targets": targets,
    }
    return {name: tables[name].select(*TABLES[name].fieldNames()) for name in TABLES}
