"""Named queries and ad-hoc SQL over the base tables, the fact and its views."""

from collections.abc import Callable
from importlib.resources import files

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.exprs import ratio
from ledgerline.functions.ranking import rank_descending


def _ranked_customers(metrics: DataFrame) -> DataFrame:
    return (
        rank_descending(metrics, "net", "revenue_rank")
        .select(
            "customer_id", "customer_name", "customer_segment", "total_orders",
            F.round("net", 2).cast("double").alias("total_net_revenue"),
            F.round("profit", 2).cast("double").alias("total_profit"),
            F.round(F.col("margin") * 100, 2).alias("avg_profit_margin_pct"),
            "revenue_rank",
        )
        .orderBy(F.col("total_net_revenue").desc())
    )


def _ranked_products(metrics: DataFrame) -> DataFrame:
    return (
        rank_descending(metrics, "net_total", "category_rank", by=["category"])
        .select(
            "product_id", "product_name", "category", "total_quantity_sold",
            F.round("gross_total", 2).cast("double").alias("gross_product_revenue"),
            F.round("net_total", 2).cast("double").alias("net_product_revenue"),
            F.round("profit_total", 2).cast("double").alias("product_profit"),
            F.round(ratio("profit_total", "net_total") * 100, 2).alias("profit_margin_pct"),
            "category_rank",
        )
        .orderBy(F.col("net_product_revenue").desc())
    )


# A query is a text in ledgerline/sql; two of them get their rank afterwards,
# because RANK() in the text would bring every row to one task.
NAMED: dict[str, Callable[[DataFrame], DataFrame] | None] = {
    "top_customers": _ranked_customers,
    "top_products": _ranked_products,
    "worst_products": None,
    "revenue_by_region": None,
    "revenue_by_month": None,
    "revenue_leakage_by_category": None,
}


def run_named(
    spark: SparkSession, name: str, args: dict | list | None = None, folder: str | None = None
) -> DataFrame:
    """Run a named query with bind parameters: the library's, or the text ``name``.sql of the caller's folder.

    Unknown names raise FileNotFoundError. A caller's folder may be anywhere Spark can read.
    """
    if folder is None:
        text = files("ledgerline") / "sql" / f"{name}.sql"
        if name not in NAMED or not text.is_file():
            raise FileNotFoundError(f"no named query {name!r}; there are {sorted(NAMED)}")
        finish = NAMED[name]
        result = spark.sql(text.read_text(), args=args)
        return finish(result) if finish else result
    try:
        lines = spark.read.text(f"{folder}/{name}.sql", wholetext=True).collect()  # one text
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        raise FileNotFoundError(f"no text {name}.sql in {folder}") from error
    return spark.sql("\n".join(r[0] for r in lines), args=args)


def run_sql(spark: SparkSession, text: str, args: dict | list | None = None) -> DataFrame:
    """Any SQL over the registered names, with bind parameters."""
    return spark.sql(text, args=args)


def monthly_summary(m: DataFrame) -> DataFrame:
    """Per month, all statuses; total_orders counts order items."""
    return m.groupBy("month").agg(
        F.count("order_id").alias("total_orders"),
        *[
            F.sum(c).cast("double").alias(c)
            for c in ("gross_revenue", "discount_amount", "net_revenue", "cost_amount", "gross_profit")
        ],
        F.avg("profit_margin").alias("avg_profit_margin"),
        F.sum("leakage_amount").cast("double").alias("leakage_amount"),
    )


def register_tables(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def register_views(tables: dict[str, DataFrame], master: DataFrame) -> None:
    register_tables(tables)
    master.createOrReplaceTempView("master_analytical_dataset")
    monthly_summary(master).createOrReplaceTempView("view_monthly_summary")
