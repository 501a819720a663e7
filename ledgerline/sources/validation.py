"""Checks on the base tables before anything is built from them."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.schemas import CHECKED_TYPES, TABLES, UNIQUE_KEYS

_CLASSES = {
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "string": (T.StringType,),
}
_PROBES = {"float": "double", "int": "bigint"}
_FINDING = "table string, column string, error string"


def schema_findings(tables: dict[str, DataFrame], text: bool = False) -> list[tuple[str, str, str]]:
    """Missing columns and, unless all columns are still text, wrong type classes."""
    found = []
    for name, declared in TABLES.items():
        have = {f.name: f.dataType for f in tables[name].schema}
        found += [(name, c, "missing column") for c in declared.fieldNames() if c not in have]
        for column, expected in CHECKED_TYPES[name].items():
            if not text and column in have and not isinstance(have[column], _CLASSES[expected]):
                found.append((name, column, f"expected {expected}, got {have[column].simpleString()}"))
    return found


def value_findings(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """Values of text columns that do not read as the declared number, one pass per table."""
    frames = []
    for name, checks in CHECKED_TYPES.items():
        df = tables[name]
        text = [
            (c, kind) for c, kind in checks.items()
            if kind in _PROBES and c in df.columns and isinstance(df.schema[c].dataType, T.StringType)
        ]
        if not text:
            continue
        bad = [
            F.struct(
                F.lit(name).alias("table"), F.lit(c).alias("column"),
                F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(_PROBES[kind]).isNull()).alias("bad"),
                F.lit(kind).alias("kind"),
            )
            for c, kind in text
        ]
        frames.append(
            df.agg(F.array(*bad).alias("checks"))
            .select(F.inline("checks"))
            .filter("bad > 0")
            .select("table", "column", F.format_string("%d values are not %s", "bad", "kind").alias("error"))
        )
    return frames


def key_findings(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """Keys that repeat, which would multiply rows of the fact."""
    frames = []
    for name, key in UNIQUE_KEYS.items():
        if key in tables[name].columns:
            frames.append(
                dedup(tables[name]).groupBy(key).count().filter("count > 1")
                .agg(F.count("*").alias("repeated")).filter("repeated > 0")
                .select(
                    F.lit(name).alias("table"), F.lit(key).alias("column"),
                    F.format_string("%d keys repeat", "repeated").alias("error"),
                )
            )
    return frames


def validate(tables: dict[str, DataFrame], keys: bool = True, text: bool = False) -> DataFrame:
    """Every finding as (table, column, error); an empty frame means the tables are fine.

    A text column where a number is declared is a finding, and so is the number
    of its values that do not read as one. With ``text=True`` the tables are raw
    CSV text, and only the values count.
    """
    spark: SparkSession = next(iter(tables.values())).sparkSession
    frames = [spark.createDataFrame(schema_findings(tables, text), _FINDING)]
    frames += value_findings(tables)
    if keys:
        frames += key_findings(tables)
    return reduce(DataFrame.unionByName, frames)


def dedup(df: DataFrame) -> DataFrame:
    """Drop rows that repeat in full."""
    return df.dropDuplicates()


def dedup_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows before and after, per table. Counting copies per row needs one shuffle."""
    reports = []
    for name, df in tables.items():
        copies = df.groupBy(*df.columns).count()
        reports.append(
            copies.agg(
                F.coalesce(F.sum("count"), F.lit(0)).alias("before"), F.count("*").alias("after")
            ).select(
                F.lit(name).alias("table"), "before", "after", (F.col("before") - F.col("after")).alias("removed")
            )
        )
    return reduce(DataFrame.unionByName, reports)
