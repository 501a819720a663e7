"""Small column helpers shared by the operators."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.schemas import MONEY


def money(column: Column) -> Column:
    return column.cast(MONEY)


def total(name: str) -> Column:
    """Exact sum of a money column as a double, 0.0 when there is nothing to add."""
    return F.coalesce(F.sum(name).cast("double"), F.lit(0.0))


def mean_of(name: str) -> Column:
    """Mean from an exact sum, so it does not depend on partition order."""
    return F.try_divide(F.sum(name).cast("double"), F.count(name).cast("double"))


def ratio(part, whole) -> Column:
    """part / whole as double, NULL when the whole is zero."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.try_divide(part.cast("double"), whole.cast("double"))


def ratio_if_positive(part, whole, otherwise: float = 0.0) -> Column:
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.when(whole > 0, ratio(part, whole)).otherwise(F.lit(otherwise))


def rounded_money(name: str) -> Column:
    return F.round(F.sum(name), 2).cast("double")


def top1(df: DataFrame, metric: str, *keys: str, smallest: bool = False) -> DataFrame:
    """The row with the largest (or smallest) metric, the first key on a tie.

    Planned as a bounded top-k per partition, not as a sort.
    """
    by_metric = F.col(metric).asc_nulls_last() if smallest else F.col(metric).desc_nulls_last()
    return df.orderBy(by_metric, *[F.col(k).asc() for k in keys]).limit(1)


def present(*names: str) -> Column:
    """True where none of the grouping keys is NULL (such rows are left out of groups)."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).isNotNull()
    return condition


def uniform(*columns: str, seed: int = 0) -> Column:
    """A number from 0 up to 1 that depends on the columns' values alone: the first 48 bits of their MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def cuts_below(name: str, cuts: Sequence[float]) -> Column:
    """How many of the sorted cuts lie below the column's value, by halving; 0 for NULL, all for NaN."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(name) > float(cuts[middle]), among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(cuts))
