"""The global filter: one value, or "All", for each of five fields."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "year": "year",
    "region": "region_name",
    "segment": "customer_segment",
    "category": "category",
    "channel": "sales_channel",
}


def chosen(filters: dict | None, field: str):
    """The value picked for a field, or None when it is absent or "All"."""
    value = (filters or {}).get(field)
    return None if value == "All" else value


def _predicates(filters: dict | None) -> list[Column]:
    out = []
    for field, column in FIELDS.items():
        value = chosen(filters, field)
        if value is not None:
            out.append(F.col(column) == (int(value) if field == "year" else value))
    return out


def filter_master(m: DataFrame, filters: dict | None = None) -> DataFrame:
    """Rows of the fact that match every chosen value; the fact itself if none is chosen."""
    predicates = _predicates(filters)
    return m.filter(reduce(and_, predicates)) if predicates else m


def filter_targets(targets: DataFrame, filtered: DataFrame, filters: dict | None = None) -> DataFrame:
    """Targets that belong to a filtered fact: its region and its year, when chosen."""
    if chosen(filters, "region") is not None:
        targets = targets.join(filtered.select("region_id").distinct(), "region_id", "left_semi")
    year = chosen(filters, "year")
    if year is not None:
        targets = targets.filter(F.col("target_month").startswith(str(year)))
    return targets


def restrict_customers(customers: DataFrame, filtered: DataFrame) -> DataFrame:
    """Customers that occur in the filtered fact, or all of them if none does."""
    ids = filtered.select("customer_id").distinct().withColumn("occurs", F.lit(True))
    # The join runs once; whether anything was found is a scalar subquery of the plan.
    found = customers.select("customer_id").join(ids, "customer_id", "left_semi").agg(F.count("*")).scalar()
    return customers.join(ids, "customer_id", "left").filter(F.col("occurs") | (found == 0)).drop("occurs")
