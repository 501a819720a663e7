"""Headline figures and the tables behind each chart.

Every function takes the fact and an optional filter dictionary. Groups with a
NULL key are left out, and sums over nothing are 0.0.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import mean_of, present, ratio, ratio_if_positive, total
from ledgerline.operators.filters import filter_master, filter_targets
from ledgerline.operators.named import run_named
from ledgerline.schemas import LEAKAGE_CAUSES

# The forecast stand-in spans this many months; a delay needs this many items.
FALLBACK_MONTHS = 6
MIN_ITEMS_PER_DELAY = 3

# Steps of the sales bridge (label, measure, column, sign).
BRIDGE = [
    ("Gross Revenue", "relative", "gross_revenue", 1),
    ("Discounts", "relative", "discount_amount", -1),
    ("Net Revenue", "total", "net_revenue", 1),
    ("Cost of Goods", "relative", "cost_amount", -1),
    ("Net Profit", "total", "gross_profit", 1),
]

# Lines of the financial statement.
STATEMENT = [
    "Gross Invoiced Sales", "Campaign Discounts Issued", "Net Realized Revenue", "Gross Cost Basis", "Net Realized Profit",
]


def filter_values(m: DataFrame) -> DataFrame:
    """Distinct values of the five filter fields as (field, value), sorted."""
    fields = {
        "region": "region_name", "segment": "customer_segment", "category": "category",
        "channel": "sales_channel", "year": "year",
    }
    # The few combinations are found first; only they are turned into rows.
    combos = m.select(*[F.col(c).cast("string").alias(f) for f, c in fields.items()]).distinct()
    return (
        combos.unpivot([], list(fields), "field", "value")
        .filter(F.col("value").isNotNull())
        .distinct()
        .orderBy("field", "value")
    )


def order_ids(orders: DataFrame, limit: int = 100) -> DataFrame:
    return orders.select("order_id").orderBy("order_id").limit(limit)


def _by(m: DataFrame, *keys: str, **sums: str) -> DataFrame:
    return m.filter(present(*keys)).groupBy(*keys).agg(*[total(c).alias(a) for a, c in sums.items()])


def _with_share(m: DataFrame, key: str, value: str) -> DataFrame:
    """Sums of a money column by key, and their shares of the grand total, from the exact sums."""
    exact = m.filter(present(key)).groupBy(key).agg(F.sum(value).alias("exact"))
    whole = exact.agg(F.sum("exact")).scalar()
    return exact.select(key, F.coalesce(F.col("exact").cast("double"), F.lit(0.0)).alias(value), ratio(F.col("exact"), whole).alias("share"))


def forecast_total(m: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """Sum of a saved forecast, or six times the mean net revenue per item without one."""
    if forecast is not None:
        return forecast.agg(F.coalesce(F.sum("forecasted_revenue"), F.lit(0.0)).alias("forecast_6m"))
    return m.agg((mean_of("net_revenue") * FALLBACK_MONTHS).alias("forecast_6m"))


def overview(
    m: DataFrame, targets: DataFrame, filters: dict | None = None, forecast: DataFrame | None = None
) -> DataFrame:
    """Overview figures in one row."""
    rows = filter_master(m, filters)
    goal = filter_targets(targets, rows, filters).agg(total("target_revenue")).scalar()
    return (
        rows.agg(
            total("net_revenue").alias("total_revenue"),
            total("gross_profit").alias("total_profit"),
            F.countDistinct("order_id").alias("total_orders"),
            F.countDistinct("customer_id").alias("total_customers"),
            total("leakage_amount").alias("total_leakage"),
        )
        .withColumn("profit_margin", ratio_if_positive("total_profit", "total_revenue"))
        .withColumn("total_target", goal)
        .withColumn(
            "target_achievement_pct",
            F.when(F.col("total_target") > 0, ratio("total_revenue", "total_target") * 100).otherwise(F.lit(100.0)),
        )
        .withColumn("forecast_6m", forecast_total(m, forecast).scalar())
    )


def monthly_trend(m: DataFrame, filters: dict | None = None) -> DataFrame:
    rows = filter_master(m, filters)
    return _by(rows, "month", net_revenue="net_revenue", gross_profit="gross_profit").orderBy("month")


def monthly_growth(m: DataFrame, filters: dict | None = None) -> DataFrame:
    """Change against the previous month that has sales, as a fraction."""
    by_month = Window.orderBy("month")  # one row per month
    trend = _by(filter_master(m, filters), "month", net_revenue="net_revenue")
    return (
        trend.withColumn("prev_revenue", F.lag("net_revenue").over(by_month))
        .withColumn(
            "growth_rate",
            F.coalesce(ratio(F.col("net_revenue") - F.col("prev_revenue"), F.col("prev_revenue")), F.lit(0.0)),
        )
        .orderBy("month")
    )


def revenue_by_category(m: DataFrame, filters: dict | None = None) -> DataFrame:
    return _with_share(filter_master(m, filters), "category", "net_revenue")


def region_against_target(
    m: DataFrame, targets: DataFrame, regions: DataFrame, filters: dict | None = None
) -> DataFrame:
    """Net revenue beside the whole target of every region that has either."""
    sales = _by(filter_master(m, filters), "region_name", net_revenue="net_revenue")
    goals = (
        _by(targets, "region_id", target_revenue="target_revenue")
        .join(regions.select("region_id", "region_name"), "region_id", "left")
        .select("region_name", "target_revenue")
    )
    return sales.join(goals, "region_name", "full_outer").fillna(0.0, ["net_revenue", "target_revenue"])


def sales_bridge(m: DataFrame, filters: dict | None = None) -> DataFrame:
    """Gross revenue to net profit in five ordered steps."""
    sums = filter_master(m, filters).agg(*[total(c).alias(c) for _, _, c, _ in BRIDGE])
    rows = [
        F.struct(
            F.lit(i).alias("step_index"), F.lit(label).alias("step"), F.lit(kind).alias("measure"),
            (F.col(c) * sign).alias("amount"),
        )
        for i, (label, kind, c, sign) in enumerate(BRIDGE, start=1)
    ]
    return sums.select(F.inline(F.array(*rows))).orderBy("step_index")


def channel_mix(m: DataFrame, filters: dict | None = None) -> DataFrame:
    return _with_share(filter_master(m, filters), "sales_channel", "net_revenue")


def month_by_category(m: DataFrame, filters: dict | None = None) -> DataFrame:
    return _by(filter_master(m, filters), "month", "category", net_revenue="net_revenue").orderBy("month")


def revenue_hierarchy(m: DataFrame, filters: dict | None = None) -> DataFrame:
    """Net revenue of every region, category and product, and the grand total.

    Leaves are summed first, so the rollup multiplies leaf rows and not items.
    """
    path = ["region_name", "category", "product_name"]
    leaves = filter_master(m, filters).filter(present(*path)).groupBy(*path).agg(F.sum("net_revenue").alias("net"))
    depth = {0: 3, 1: 2, 3: 1, 7: 0}
    level = F.create_map(*[F.lit(x) for pair in depth.items() for x in pair])
    return (
        leaves.rollup(*path)
        .agg(F.sum("net").cast("double").alias("net_revenue"), F.grouping_id().cast("int").alias("gid"))
        .select(level[F.col("gid")].alias("level"), *path, "net_revenue")
    )


def customer_kpis(m: DataFrame, filters: dict | None = None) -> DataFrame:
    per_customer = (
        filter_master(m, filters)
        .filter(present("customer_id"))
        .groupBy("customer_id")
        .agg(F.sum("net_revenue").alias("net"), F.max("repeat_customer_indicator").alias("repeat"))
    )
    return per_customer.agg(
        F.count("*").alias("customers"),
        F.coalesce(mean_of("net"), F.lit(0.0)).alias("avg_ltv"),
        F.coalesce(F.sum("repeat"), F.lit(0)).alias("repeat_customers"),
    ).withColumn("repeat_rate_pct", F.coalesce(ratio("repeat_customers", "customers") * 100, F.lit(0.0)))


def value_histogram(customers: DataFrame, value: str = "monetary", bins: int = 20) -> DataFrame:
    """Customers per equal-width bin of their value; the top edge falls in the last bin."""
    v = F.col(value).cast("double")
    edges = customers.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    return (
        customers.select(v.alias("v"), edges.alias("e"))
        .filter(F.col("v").isNotNull())
        .select(
            "e",
            F.when(F.col("e.lo") == F.col("e.hi"), F.lit(1))
            .otherwise(F.least(F.width_bucket("v", "e.lo", "e.hi", F.lit(bins)), F.lit(bins)))
            .cast("int").alias("bin"),
        )
        .groupBy("bin", "e")
        .agg(F.count("*").alias("customers"))
        .select(
            "bin",
            (F.col("e.lo") + (F.col("e.hi") - F.col("e.lo")) * (F.col("bin") - 1) / bins).alias("bin_start"),
            "customers",
        )
        .orderBy("bin")
    )


def top_customers_for(ranked: DataFrame, m: DataFrame, filters: dict | None = None, n: int = 10) -> DataFrame:
    """First n of the ranked customers that occur in the filtered fact, numbered anew.

    Their figures stay global: only membership is filtered.
    """
    members = filter_master(m, filters).select("customer_id").distinct()
    order = [F.col("total_net_revenue").desc(), F.col("customer_id").asc()]
    first = ranked.join(members, "customer_id", "left_semi").orderBy(*order).limit(n)
    return first.withColumn("revenue_rank", F.row_number().over(Window.orderBy(*order)))  # n rows


def product_price_margin(m: DataFrame, filters: dict | None = None) -> DataFrame:
    return (
        filter_master(m, filters)
        .filter(present("product_name", "category"))
        .groupBy("product_name", "category")
        .agg(
            mean_of("unit_price").alias("avg_unit_price"),
            F.avg("profit_margin").alias("avg_profit_margin"),
            F.sum("quantity").alias("total_quantity"),
        )
    )


def worst_ten_products(spark, n: int = 10) -> DataFrame:
    """First n of the weakest products; views must be registered."""
    return (
        run_named(spark, "worst_products")
        .orderBy("profit", F.col("return_rate_pct").desc(), "product_id")
        .limit(n)
        .select(
            "product_name", "category", "profit",
            F.coalesce("profit_margin_pct", F.lit(0.0)).alias("profit_margin_pct"), "return_rate_pct",
        )
    )


def leakage_kpis(m: DataFrame, filters: dict | None = None) -> DataFrame:
    """Total leakage and its rate; with scored rows also the number of anomalies."""
    rows = filter_master(m, filters)
    extra = [F.coalesce(F.sum("is_anomaly"), F.lit(0)).alias("anomalies")] if "is_anomaly" in m.columns else []
    return rows.agg(
        total("leakage_amount").alias("total_leakage"),
        F.coalesce(
            ratio_if_positive(F.sum("leakage_amount"), F.sum("net_revenue") + F.sum("pricing_leakage")), F.lit(0.0)
        ).alias("leakage_rate"),
        *extra,
    )


def leakage_by_cause(m: DataFrame, filters: dict | None = None) -> DataFrame:
    sums = _by(filter_master(m, filters), "category", **{c: c for c in LEAKAGE_CAUSES})
    label = F.concat(F.initcap(F.replace("leakage_type", F.lit("_leakage"), F.lit(""))), F.lit(" Leakage"))
    return sums.unpivot("category", LEAKAGE_CAUSES, "leakage_type", "amount").withColumn("leakage_type", label)


def return_reasons(m: DataFrame, filters: dict | None = None) -> DataFrame:
    returned = filter_master(m, filters).filter(F.col("order_status") == "Returned")
    return returned.groupBy("return_reason").agg(F.count("order_id").alias("items"))


def return_rate_by_delay(m: DataFrame, filters: dict | None = None) -> DataFrame:
    return (
        filter_master(m, filters)
        .filter(present("delay_days"))
        .groupBy("delay_days")
        .agg(mean_of("is_returned").alias("return_rate"), F.count("order_id").alias("items"))
        .filter(F.col("items") >= MIN_ITEMS_PER_DELAY)
        .orderBy("delay_days")
    )


def anomaly_audit(scored: DataFrame, filters: dict | None = None, n: int = 30) -> DataFrame:
    """The n flagged items that leak most."""
    return (
        filter_master(scored, filters)
        .filter(F.col("is_anomaly") == 1)
        .orderBy(F.col("leakage_amount").desc(), "order_id", "order_item_id")
        .limit(n)
        .select(
            "order_id", "customer_name", "sales_rep_name", "order_status", "delay_days",
            F.col("discount_percentage").cast("double").alias("discount_percentage"),
            F.col("leakage_amount").cast("double").alias("leakage_amount"), "profit_margin",
        )
    )


def financial_statement(m: DataFrame, targets: DataFrame, filters: dict | None = None) -> DataFrame:
    """Five ordered lines: amount, its percentage, and for net revenue the target."""
    rows = filter_master(m, filters)
    goal = filter_targets(targets, rows, filters).agg(total("target_revenue")).scalar()
    sums = rows.agg(
        *[total(c).alias(c) for c in ("gross_revenue", "discount_amount", "net_revenue", "cost_amount", "gross_profit")]
    ).withColumn("goal", goal)
    achieved = F.when(F.col("goal") > 0, ratio("net_revenue", "goal") * 100).otherwise(F.lit(100.0))
    none = F.lit(None).cast("double")
    lines = [
        (F.col("gross_revenue"), F.lit(100.0), none, none),
        (-F.col("discount_amount"), ratio("discount_amount", "gross_revenue") * 100, none, none),
        (F.col("net_revenue"), ratio("net_revenue", "gross_revenue") * 100, F.col("goal"), achieved),
        (-F.col("cost_amount"), ratio("cost_amount", "net_revenue") * 100, none, none),
        (F.col("gross_profit"), ratio_if_positive("gross_profit", "net_revenue") * 100, none, none),
    ]
    structs = [
        F.struct(
            F.lit(i).alias("line"), F.lit(label).alias("metric"), amount.alias("amount"), pct.alias("pct"),
            target.alias("target_revenue"), done.alias("target_achievement_pct"),
        )
        for i, (label, (amount, pct, target, done)) in enumerate(zip(STATEMENT, lines), start=1)
    ]
    return sums.select(F.inline(F.array(*structs))).orderBy("line")


def leakage_summary(m: DataFrame, filters: dict | None = None) -> DataFrame:
    """Leakage per cause, in total, and as a share of billed revenue."""
    return filter_master(m, filters).agg(
        *[total(c).alias(c) for c in LEAKAGE_CAUSES],
        total("leakage_amount").alias("total_leakage"),
        F.coalesce(
            ratio_if_positive(F.sum("leakage_amount"), F.sum("net_revenue") + F.sum("pricing_leakage")), F.lit(0.0)
        ).alias("leakage_rate"),
    )
