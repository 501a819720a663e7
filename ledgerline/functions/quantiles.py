"""Exact quantiles with linear interpolation, at any number of rows.

Spark's `percentile` keeps every distinct value of a column in one buffer. Here
the wanted values are found by narrowing brackets: an approximate quantile
proposes a short interval, a count proves that the wanted rows are inside it,
and only the interval is looked at, until it holds few rows or one value.
"""

from dataclasses import dataclass
from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A bracket is short enough to be read when it holds no more rows.
SHORT = 100_000
ACCURACY = 10_000


@dataclass
class _Bracket:
    """An interval of values known to hold the rows of rank first..last (0-based)."""

    column: str
    first: int
    last: int
    weight: float
    below: int
    inside: int
    low: float | None = None  # None: open end
    high: float | None = None
    ends: tuple[float, float] | None = None  # the two values themselves, once they are known

    def under(self) -> Column:
        return F.lit(False) if self.low is None else F.col(self.column) < self.low

    def holds(self) -> Column:
        value = F.col(self.column)
        condition = value.isNotNull()
        if self.low is not None:
            condition = condition & (value >= self.low)
        if self.high is not None:
            condition = condition & (value <= self.high)
        return condition

    def cuts(self, margin: float) -> list[float]:
        """Shares of the interval's rows between which the wanted rows should lie."""
        return [
            max(0.0, (self.first - self.below) / self.inside - margin),
            min(1.0, (self.last - self.below + 1) / self.inside + margin),
        ]

    def settled(self, rows: int) -> bool:
        return self.ends is not None or self.inside <= rows or (self.low is not None and self.low == self.high)


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], short: int | None = None
) -> dict[str, list[float | None]]:
    """{column: [value for each prob]}; NULLs are ignored, an empty column gives None."""
    short = SHORT if short is None else short
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    counts = values.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    wanted = {}
    for c in columns:
        for p in probs:
            position = (counts[c] - 1) * p
            if counts[c]:
                wanted[c, p] = _Bracket(
                    c, floor(position), ceil(position), position - floor(position), 0, counts[c]
                )
    _narrow(values, list(wanted.values()), short)
    found = _read(values, list(wanted.values()))
    return {c: [found[id(wanted[c, p])] if (c, p) in wanted else None for p in probs] for c in columns}


def _narrow(values: DataFrame, brackets: list[_Bracket], rows: int) -> None:
    """Shrink every bracket until few rows are inside, or one value fills it."""
    while open_ := [b for b in brackets if not b.settled(rows)]:
        # Brackets that still share an interval share one sketch of it.
        shared: dict[tuple, list[_Bracket]] = {}
        for b in open_:
            shared.setdefault((b.column, b.low, b.high), []).append(b)
        sketches = [
            F.percentile_approx(
                F.when(group[0].holds(), F.col(group[0].column)),
                [cut for b in group for cut in b.cuts(4 / ACCURACY)],
                ACCURACY,
            ).alias(f"g{i}")
            for i, group in enumerate(shared.values())
        ]
        guesses = values.agg(*sketches).first()
        open_ = [b for group in shared.values() for b in group]
        edges = [edge for guess in guesses for edge in guess]
        tried = [
            _Bracket(b.column, b.first, b.last, b.weight, 0, 0, edges[2 * i], edges[2 * i + 1])
            for i, b in enumerate(open_)
        ]
        counted = values.agg(
            *[F.count_if(t.under()).alias(f"u{i}") for i, t in enumerate(tried)],
            *[F.count_if(t.holds()).alias(f"h{i}") for i, t in enumerate(tried)],
        ).first()
        stuck = []
        for i, (b, t) in enumerate(zip(open_, tried)):
            below, inside = counted[f"u{i}"], counted[f"h{i}"]
            if below <= b.first and b.last < below + inside and (inside < b.inside or t.low == t.high):
                b.low, b.high, b.below, b.inside = t.low, t.high, below, inside
            else:
                stuck.append(b)
        if stuck:
            _halve(values, stuck)


def _halve(values: DataFrame, brackets: list[_Bracket]) -> None:
    """Cut each bracket at a value near its middle: below it, the value itself, above it. One part holds the rows, or
    they are the neighbouring values at a cut. Every cut takes something off, whatever the values are."""
    middles = values.agg(*[
        F.percentile_approx(F.when(b.holds(), F.col(b.column)), 0.5, ACCURACY).alias(f"m{i}") for i, b in enumerate(brackets)
    ]).first()
    parts = []
    for i, (b, m) in enumerate(zip(brackets, middles)):
        value = F.when(b.holds(), F.col(b.column))
        parts += [
            F.count_if(value < m).alias(f"less{i}"), F.count_if(value == m).alias(f"same{i}"),
            F.max(F.when(value < m, value)).alias(f"left{i}"), F.min(F.when(value > m, value)).alias(f"right{i}"),
        ]
    found = values.agg(*parts).first()
    for i, (b, m) in enumerate(zip(brackets, middles)):
        less, same, left, right = (found[f"{k}{i}"] for k in ("less", "same", "left", "right"))
        zones = [(r - b.below >= less) + (r - b.below >= less + same) for r in (b.first, b.last)]
        if zones[0] != zones[1]:
            value = (left, m, right)
            b.ends = (value[zones[0]], value[zones[1]])
        elif zones[0] == 0:
            b.high, b.inside = left, less
        elif zones[0] == 1:
            b.low = b.high = m
            b.below, b.inside = b.below + less, same
        else:
            b.low, b.below, b.inside = right, b.below + less + same, b.inside - less - same


def _read(values: DataFrame, brackets: list[_Bracket]) -> dict[int, float]:
    """The interpolated value of each bracket, from the value counts inside it."""
    known = {id(b): b.ends[0] + (b.ends[1] - b.ends[0]) * b.weight for b in brackets if b.ends}
    brackets = [b for b in brackets if not b.ends]
    if not brackets:
        return known
    # Rows outside all brackets stop here; of the others only the entries that are inside are spread.
    entries = F.filter(
        F.array(*[
            F.struct(F.lit(i).alias("i"), F.when(b.holds(), F.col(b.column)).alias("value"))
            for i, b in enumerate(brackets)
        ]),
        lambda e: e["value"].isNotNull(),
    )
    inside = reduce(or_, [b.holds() for b in brackets])
    counts = (
        values.filter(inside).select(F.inline(entries))
        .groupBy("i", "value")
        .agg(F.count("*").alias("rows"))
    )
    ends = Window.partitionBy("i").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first, last = F.lit(None), F.lit(None)
    for i, b in enumerate(brackets):
        first = F.when(F.col("i") == i, F.lit(b.first - b.below)).otherwise(first)
        last = F.when(F.col("i") == i, F.lit(b.last - b.below)).otherwise(last)
    rows = (
        counts.withColumn("end", F.sum("rows").over(ends))
        .groupBy("i")
        .agg(
            F.min(F.when(F.col("end") > first, F.col("value"))).alias("a"),
            F.min(F.when(F.col("end") > last, F.col("value"))).alias("b"),
        )
        .collect()  # one row per wanted quantile
    )
    return known | {id(brackets[r.i]): r.a + (r.b - r.a) * brackets[r.i].weight for r in rows}
