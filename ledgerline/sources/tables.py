"""Read the ten base tables and bring their dates to the date type."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.schemas import DATE_COLUMNS, FILE_STEMS, TABLES


class MissingTables(FileNotFoundError):
    """Some of the ten tables are not there; none is returned."""


def read_tables(spark: SparkSession, directory: str, fmt: str = "csv", typed: bool = True) -> dict[str, DataFrame]:
    """All ten tables from ``directory``, or MissingTables naming every absent one.

    With ``typed=False`` a CSV column stays text, for the value checks of
    `validate`; by name, so extra columns in the file are allowed.
    """
    tables, missing = {}, []
    for name, schema in TABLES.items():
        path = f"{directory}/{FILE_STEMS.get(name, name)}.{fmt}"
        try:
            tables[name] = _read(spark, path, fmt, schema if typed else None)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            missing.append(path)
    if missing:
        raise MissingTables("missing: " + ", ".join(missing))
    return tables


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    raw = spark.read.option("header", True).csv(path)
    return raw if schema is None else _typed(raw, schema)


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns by name with their types; a missing one stays missing."""
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema if f.name in raw.columns])


def typed_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The declared columns and types of tables that passed `validate`."""
    return {name: _typed(df, TABLES[name]) for name, df in tables.items()}


def standardise_dates(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Date columns as DATE; text that is not a date becomes NULL."""
    out = dict(tables)
    for name, columns in DATE_COLUMNS.items():
        if name in out:
            out[name] = out[name].withColumns({c: _as_date(out[name], c) for c in columns if c in out[name].columns})
    return out


def _as_date(df: DataFrame, name: str):
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.to_date(F.try_to_timestamp(F.col(name)))
    return F.to_date(F.col(name))
