"""Store the base tables and the fact, and read them back."""

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.master import fact_inputs, order_frame, with_date_parts, with_rules
from ledgerline.schemas import MASTER, MASTER_COLUMNS, TABLES
from ledgerline.session import materialize, release, scratch, shared_dir
from ledgerline.sources.star import star_tables
from ledgerline.sources.tables import read_tables, standardise_dates, typed_tables
from ledgerline.sources.validation import dedup, validate

#: Items whose rows are shuffled at a time when the fact is stored: a wide row takes some 200 bytes of disk until then.
SLICE_ROWS = 16_000_000


@dataclass(frozen=True)
class Warehouse:
    """The ten base tables by name, and the fact built from them, which may be made when it is first asked for."""

    tables: dict[str, DataFrame]
    fact: DataFrame | Callable[[], DataFrame]
    key: tuple[str, str] | None = None  # application and source folder, of a warehouse that is kept

    @cached_property
    def master(self) -> DataFrame:
        return self.fact() if callable(self.fact) else self.fact

    def register(self, fact: bool = True) -> None:
        """Expose everything to SQL under the names the named queries use; without the fact and its views if they aren't asked."""
        from ledgerline.operators.named import register_tables, register_views

        if fact:
            register_views(self.tables, self.master)
        else:
            register_tables(self.tables)


def write_tables(tables: dict[str, DataFrame], out: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def stored_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{out}/{name}") for name, schema in TABLES.items()}


def write_master(master: DataFrame, out: str) -> None:
    """Parquet in year and month folders, rows by order date within a file."""
    _write_by_month(master, out)


def _write_by_month(
    rows: DataFrame, out: str, finish: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "overwrite"
) -> None:
    """The rebalance hint lets AQE cut a month that holds most of the rows into
    many files and pack small months together. `finish` adds columns behind it.
    """
    (
        finish(rows.hint("rebalance", "year", "month"))
        .sortWithinPartitions("year", "month", "order_date")
        .write.mode(mode)
        .partitionBy("year", "month")
        .parquet(out)
    )


def store_master(spark: SparkSession, tables: dict[str, DataFrame], out: str) -> None:
    """Build and store the fact; what follows from a row's other columns is added after the last shuffle.

    Many items are dealt into slices by order. What is known per order is stored first, step by step; then a slice at a
    time is joined and written, and its shuffle files go before the next. So disk is needed for one step at a time.
    """
    items, products = tables["order_items"], tables["products"]
    slices = -(-items.count() // SLICE_ROWS)

    def write(some: DataFrame, orders: DataFrame, mode: str) -> None:
        _write_by_month(with_date_parts(fact_inputs(some, products, orders)), out, with_rules, mode)

    if slices <= 1:
        write(items, order_frame(tables), "overwrite")
        return

    def keep(df: DataFrame, name: str) -> DataFrame:
        stored = materialize(df, name)
        release(spark)
        return stored

    def slice_of() -> Column:
        return F.pmod(F.xxhash64("order_id"), F.lit(slices)).cast("int")

    orders = order_frame(tables, keep).withColumn("slice", slice_of())
    path = scratch(spark, "order-frame")
    orders.write.partitionBy("slice").parquet(path)
    orders = spark.read.schema(orders.schema).parquet(path)
    for i in range(slices):
        release(spark)
        write(items.where(slice_of() == i), orders.where(F.col("slice") == i).drop("slice"), "append" if i else "overwrite")
    release(spark)


def write_master_csv(master: DataFrame, out: str) -> None:
    master.write.mode("overwrite").option("header", True).csv(out)


def read_master(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MASTER).parquet(out).select(*MASTER_COLUMNS)


def run_etl(spark: SparkSession, raw_dir: str, out: str, fmt: str = "csv") -> Warehouse:
    """Read, validate, clean, store the ten tables, then build and store the fact.

    Raises ValueError with every finding when validation fails.
    """
    raw = read_tables(spark, raw_dir, fmt, typed=False)
    findings = validate(raw, text=fmt == "csv").collect()
    if findings:
        raise ValueError("\n".join(f"{r.table}.{r.column}: {r.error}" for r in findings))
    clean = typed_tables(standardise_dates({name: dedup(df) for name, df in raw.items()}))
    write_tables(clean, f"{out}/tables")
    tables = stored_tables(spark, f"{out}/tables")
    store_master(spark, tables, f"{out}/master")
    write_master_csv(read_master(spark, f"{out}/master"), f"{out}/master_csv")
    return Warehouse(tables, read_master(spark, f"{out}/master"))


_open: dict[tuple[str, str], Warehouse] = {}


def star_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse of a star directory: built once per application, then read.

    Only the per-order frame and, once it is asked for, the fact are stored; the
    other tables are plain projections of their source files.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        slug = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
        out = f"{shared_dir(spark)}/{key[0]}/star-{slug}"
        tables = star_tables(spark, sf_dir, stage=partial(materialize, name="order-heads"))

        def fact() -> DataFrame:
            store_master(spark, tables, f"{out}/master")
            return read_master(spark, f"{out}/master")

        _open[key] = Warehouse(tables, fact, key)
    return _open[key]


def save_forecast(forecast: DataFrame, out: str) -> None:
    forecast.write.mode("overwrite").parquet(f"{out}/forecast_data")


def load_forecast(spark: SparkSession, out: str) -> DataFrame | None:
    """The saved forecast, or None when none was saved."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{out}/forecast_data")
    except AnalysisException:
        return None
