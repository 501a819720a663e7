"""Build the order-item fact: joins, money, leakage and customer features.

Layout of the build, chosen so that wide item rows are shuffled once, on their
order id:

* everything known per order (customer, region, rep, discount, return, order
  rank, customer features) is joined at order grain first;
* items get their product and then meet that one order frame;
* customer features come from narrow item rows that are summed per customer
  before they are shuffled.

No step gathers the items of a customer. Every large join is a plain left join
with nothing clustered on its key behind it, so AQE may split a hot key.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import money, ratio, ratio_if_positive
from ledgerline.functions.ranking import running_number
from ledgerline.schemas import LEAKAGE_CAUSES, MASTER_COLUMNS, PERCENT

# Thresholds of the leakage and risk rules.
DISCOUNT_ALLOWANCE = "0.20"
LATE_AFTER_DAYS = 5
RISKY_RETURN_RATE = 0.20
RISKY_LEAKAGE_SCORE = 0.25


def _nothing() -> Column:
    return money(F.lit("0"))


# --- joins -----------------------------------------------------------------


def join_products(items: DataFrame, products: DataFrame) -> DataFrame:
    return items.join(products, "product_id", "left")


def join_orders(items: DataFrame, orders: DataFrame) -> DataFrame:
    return items.join(orders, "order_id", "left")


def join_customers_regions(orders: DataFrame, customers: DataFrame, regions: DataFrame) -> DataFrame:
    return orders.join(customers, "customer_id", "left").join(regions, "region_id", "left")


def join_reps(orders: DataFrame, reps: DataFrame) -> DataFrame:
    return orders.join(reps.withColumnRenamed("region_id", "region_id_rep"), "sales_rep_id", "left")


def join_discounts(df: DataFrame, discounts: DataFrame) -> DataFrame:
    return with_discount_defaults(df.join(discounts, "order_id", "left"))


def join_returns(df: DataFrame, returns: DataFrame) -> DataFrame:
    return with_return_defaults(df.join(returns, "order_id", "left"))


def with_discount_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "discount_percentage": F.coalesce("discount_percentage", F.lit("0").cast(PERCENT)),
            "discount_code": F.coalesce("discount_code", F.lit("NONE")),
        }
    )


def with_return_defaults(df: DataFrame) -> DataFrame:
    return df.withColumn("return_reason", F.coalesce("return_reason", F.lit("N/A")))


# --- item rules ------------------------------------------------------------


def with_gross_and_cost(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "gross_revenue": money(F.col("quantity") * F.col("unit_price")),
            "cost_amount": money(F.col("quantity") * F.col("cost_price")),
        }
    )


def with_amounts(df: DataFrame) -> DataFrame:
    gross = money(F.col("quantity") * F.col("unit_price"))
    cost = money(F.col("quantity") * F.col("cost_price"))
    discount = money(gross * F.col("discount_percentage"))
    return df.withColumns(
        {
            "gross_revenue": gross,
            "cost_amount": cost,
            "discount_amount": discount,
            "net_revenue": money(gross - discount),
            "gross_profit": money(gross - discount - cost),
        }
    )


def with_profit_margin(df: DataFrame) -> DataFrame:
    return df.withColumn("profit_margin", ratio_if_positive("gross_profit", "net_revenue"))


def with_discount_leakage(df: DataFrame) -> DataFrame:
    allowance = F.lit(DISCOUNT_ALLOWANCE).cast(PERCENT)
    excess = F.col("discount_percentage") - allowance
    return df.withColumn(
        "discount_leakage",
        F.when(F.col("discount_percentage") > allowance, money(F.col("gross_revenue") * excess)).otherwise(_nothing()),
    )


def with_return_leakage(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "return_leakage", F.when(F.col("order_status") == "Returned", F.col("net_revenue")).otherwise(_nothing())
    )


def with_delay_leakage(df: DataFrame) -> DataFrame:
    lost = (F.col("order_status") == "Cancelled") & (F.col("delay_days") > LATE_AFTER_DAYS)
    return df.withColumn("delay_leakage", F.when(lost, F.col("net_revenue")).otherwise(_nothing()))


def with_pricing_leakage(df: DataFrame) -> DataFrame:
    shortfall = money((F.col("base_price") - F.col("unit_price")) * F.col("quantity"))
    return df.withColumn(
        "pricing_leakage", F.when(F.col("unit_price") < F.col("base_price"), shortfall).otherwise(_nothing())
    )


def with_leakage_total(df: DataFrame) -> DataFrame:
    amount = money(sum((F.col(c) for c in LEAKAGE_CAUSES[1:]), F.col(LEAKAGE_CAUSES[0])))
    billed = F.col("net_revenue") + F.col("pricing_leakage")
    return df.withColumns(
        {
            "leakage_amount": amount,
            "is_leakage": F.when(amount > 0, 1).otherwise(0),
            "leakage_score": F.when(F.col("net_revenue") > 0, ratio(amount, billed)).otherwise(F.lit(0.0)),
        }
    )


def with_leakage(df: DataFrame) -> DataFrame:
    for rule in (with_discount_leakage, with_return_leakage, with_delay_leakage, with_pricing_leakage):
        df = rule(df)
    return with_leakage_total(df)


def with_order_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "order_delay": F.col("delay_days"),
            "is_returned": F.when(F.col("order_status") == "Returned", 1).otherwise(0),
        }
    )


def with_date_parts(df: DataFrame) -> DataFrame:
    day = F.col("order_date")
    return df.withColumns(
        {
            "year": F.year(day),
            "quarter": F.concat(F.year(day), F.lit("Q"), F.quarter(day)),
            "month_num": F.month(day),
            "month": F.date_format(day, "yyyy-MM"),
        }
    )


def with_season(df: DataFrame) -> DataFrame:
    """A missing month falls through to Autumn, the last branch."""
    month = F.col("month_num")
    return df.withColumn(
        "season",
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.between(3, 5), "Spring")
        .when(month.between(6, 8), "Summer")
        .otherwise("Autumn"),
    )


# --- customer features -----------------------------------------------------


def orders_with_items(tables: dict[str, DataFrame]) -> DataFrame:
    """Orders that the fact will hold, with what ranks them."""
    used = tables["order_items"].select("order_id").distinct()
    return tables["orders"].select("order_id", "customer_id", "order_date").join(used, "order_id", "left_semi")


def order_ranks(orders: DataFrame) -> DataFrame:
    """Running number of each order among its customer's orders, by date."""
    return running_number(
        orders, key="customer_id", bucket="order_date", tie="order_id", out="customer_order_rank"
    ).select("order_id", "customer_order_rank")


def customer_features(items: DataFrame) -> DataFrame:
    """Lifetime value and risk flag per customer, weighted by items."""
    return_rate = ratio(F.sum("is_returned"), F.count("*"))
    score = F.try_divide(F.sum("leakage_score"), F.count("*").cast("double"))
    return (
        items.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            money(F.sum("net_revenue")).alias("customer_ltv"),
            F.when((return_rate > RISKY_RETURN_RATE) | (score > RISKY_LEAKAGE_SCORE), 1)
            .otherwise(0)
            .alias("high_risk_customer"),
        )
    )


def with_repeat_indicator(df: DataFrame) -> DataFrame:
    return df.withColumn("repeat_customer_indicator", F.when(F.col("customer_order_rank") > 1, 1).otherwise(0))


def priced_items(tables: dict[str, DataFrame]) -> DataFrame:
    """Items with what the customer features need, and no more columns."""
    orders = tables["orders"].select("order_id", "customer_id", "order_status", "delay_days")
    per_order = join_discounts(orders, tables["discounts"])
    products = tables["products"].select("product_id", "base_price", "cost_price")
    items = join_orders(join_products(tables["order_items"], products), per_order)
    items = with_discount_defaults(items)
    return with_order_flags(with_leakage(with_amounts(items)))


def order_frame(
    tables: dict[str, DataFrame], keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df
) -> DataFrame:
    """Everything the fact holds per order, one row per order; `keep` may store the parts that need shuffles of their own."""
    # Joined at customer grain, so that orders meet customers once.
    features = keep(customer_features(priced_items(tables)), "customer-features")
    people = tables["customers"].join(features, "customer_id", "full_outer")
    ranks = keep(order_ranks(orders_with_items(tables)), "order-ranks")
    orders = join_customers_regions(tables["orders"], people, tables["regions"])
    orders = join_reps(orders, tables["reps"])
    orders = join_discounts(orders, tables["discounts"])
    orders = join_returns(orders, tables["returns"])
    return orders.join(ranks, "order_id", "left")


def fact_inputs(items: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """Items with what the other tables know of them; all other columns of the fact follow from a row of this."""
    fact = join_orders(join_products(items, products), orders)
    # An item without an order has no discount or return row either.
    return with_return_defaults(with_discount_defaults(fact))


def with_rules(fact: DataFrame) -> DataFrame:
    fact = with_leakage(with_profit_margin(with_amounts(fact)))
    fact = with_season(with_date_parts(with_order_flags(fact)))
    return with_repeat_indicator(fact).select(*MASTER_COLUMNS)


def build_master(tables: dict[str, DataFrame]) -> DataFrame:
    """The fact, one row per order item, 54 columns.

    Keys of the joined tables must be unique, which `validate` checks.
    """
    return with_rules(fact_inputs(tables["order_items"], tables["products"], order_frame(tables)))
