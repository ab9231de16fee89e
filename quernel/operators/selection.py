"""Exact order statistics of a column, however long, by histogram rounds.

A round counts the values of an interval in buckets, with the smallest and
largest value of each. Buckets are monotone in the value, so the one that
holds a wanted rank is the next interval. A round reads one column, combines
counts where they are read and sends a bounded number of rows; no values are
shuffled. When the interval holds one value, or few enough to sort, the rank
is answered.

Whole numbers and decimals are bucketed by even widths. Doubles are parted by
sign first and then, while an interval spans many magnitudes, by even widths
of the logarithm, so that no distribution needs more than some ten rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096
#: An interval of so many values is sorted.
SORT_ROWS = 100_000


@dataclass
class _Interval:
    """Values from ``low`` to ``high``, which both occur, ``count`` of them, after ``before`` smaller ones."""

    low: Any
    high: Any
    count: int
    before: int
    ranks: list[int] = field(default_factory=list)
    peel: bool = False  # the last round did not narrow it: numbers beyond the precision of a double

    def holds(self, v: Column, kind: T.DataType) -> Column:
        return (v >= F.lit(self.low).cast(kind)) & (v <= F.lit(self.high).cast(kind))


def _bucket(v: Column, kind: T.DataType, low: Any, high: Any) -> Column:
    """A number from 0 to ``BUCKETS`` + 2 that never falls as the value rises; it differs for the interval's ends."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        v, low, high = v.cast("double"), float(low), float(high)
        if math.isnan(high) or math.isinf(high) or math.isinf(low):
            # the infinities and NaN, which is the largest value, apart from the rest
            return F.when(F.isnan(v), 3).when(v == float("inf"), 2).when(v == float("-inf"), 0).otherwise(1)
        if low < 0 < high or (low < 0 <= high) or (low <= 0 < high):
            return F.signum(v).cast("int") + 1
        if low > 0 and high / low > BUCKETS:
            return _even(F.log(v) - math.log(low), math.log(high) - math.log(low))
        if high < 0 and low / high > BUCKETS:
            return _even(math.log(-low) - F.log(-v), math.log(-low) - math.log(-high))
        return _even(v - low, high - low)
    if isinstance(kind, T.DecimalType):
        return _even((v - F.lit(low).cast(kind)).cast("double"), float(high - low))
    if high - low < 2**63:
        return _even((v.cast("long") - F.lit(low).cast("long")).cast("double"), float(high - low))
    return _even(v.cast("double") - float(low), float(high) - float(low))


def _even(over: Column, width: float) -> Column:
    # the largest value is apart, whatever rounding does to the rest
    part = F.floor(over / F.lit(width) * BUCKETS).cast("int")
    return F.greatest(F.lit(0), F.least(part, F.lit(BUCKETS)))


def order_statistics(df: DataFrame, column: str, ranks: list[int], buckets_seen: list[int] | None = None, sort_rows: int = SORT_ROWS) -> dict[int, Any]:
    """The values of a numeric column at ``ranks``, counted from 0 over its values in ascending order; nulls do not count, NaN is largest.

    A rank beyond the values is not in the result. ``buckets_seen`` is given
    the number of buckets that each round sent.
    """
    values = _values(df, column)
    return _select(values, _whole(values), ranks, buckets_seen, sort_rows)


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(f"`{column}`").alias("v")).filter("v IS NOT NULL")


def _whole(values: DataFrame) -> _Interval:
    first = values.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).head()
    return _Interval(first.low, first.high, first.n, 0)


def _select(values: DataFrame, whole: _Interval, ranks: list[int], buckets_seen: list[int] | None, sort_rows: int) -> dict[int, Any]:
    kind = values.schema["v"].dataType
    found: dict[int, Any] = {}
    todo = [_Interval(whole.low, whole.high, whole.count, 0, sorted({r for r in ranks if 0 <= r < whole.count}))]
    while todo := [x for x in todo if x.ranks]:
        still = []
        for x in todo:
            if _same(x.low, x.high):
                found |= dict.fromkeys(x.ranks, x.low)
            else:
                still.append(x)
        todo = still
        for x in [x for x in todo if x.count <= sort_rows]:
            here = values.filter(x.holds(F.col("v"), kind)).groupBy("v").count().orderBy("v").collect()
            at, up_to = 0, x.before
            for r in x.ranks:
                while up_to + here[at]["count"] <= r:
                    up_to += here[at]["count"]
                    at += 1
                found[r] = here[at].v
            todo.remove(x)
        if not todo:
            break
        # one pass over the column for all intervals, which do not meet
        where = F.lit(None).cast("int")
        for i, x in enumerate(todo):
            part = (F.col("v") > F.lit(x.low).cast(kind)).cast("int") if x.peel else _bucket(F.col("v"), kind, x.low, x.high)
            where = F.when(x.holds(F.col("v"), kind), i * (BUCKETS + 4) + part).otherwise(where)
        told = values.select("v", where.alias("b")).filter("b IS NOT NULL").groupBy("b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()
        if buckets_seen is not None:
            buckets_seen.append(len(told))
        following = []
        for i, x in enumerate(todo):
            before = x.before
            for b in (b for b in told if b.b // (BUCKETS + 4) == i):
                ranks = [r for r in x.ranks if before <= r < before + b.n]
                if ranks:
                    following.append(_Interval(b.low, b.high, b.n, before, ranks, b.n == x.count))
                before += b.n
        todo = following
    return found


def _same(a: Any, b: Any) -> bool:
    return a == b or (a != a and b != b)


def quantiles(df: DataFrame, column: str, fractions: list[float], sort_rows: int = SORT_ROWS) -> list[float | None]:
    """Exact quantiles of a numeric column with linear interpolation between neighbours; None for a column without values.

    The same rows as ``percentile`` and, but for rounding in the last digit,
    SQL's ``quantile_cont``, without a task that holds the column.
    """
    values = _values(df, column)
    whole = _whole(values)
    if not whole.count:
        return [None] * len(fractions)
    places = [p * (whole.count - 1) for p in fractions]
    held = _select(values, whole, [r for x in places for r in (math.floor(x), math.ceil(x))], None, sort_rows)
    out: list[float | None] = []
    for x in places:
        low, high = held[math.floor(x)], held[math.ceil(x)]
        share = x - math.floor(x)
        out.append(float(low) if share == 0 or _same(low, high) else (1 - share) * float(low) + share * float(high))
    return out


def group_quantiles(df: DataFrame, group: str, column: str, fractions: list[float], sort_rows: int = SORT_ROWS) -> DataFrame:
    """One row per group: ``group`` and ``q``, the exact quantiles of the column within it, null where it has no values.

    ``percentile`` by group gathers a group's different values in one task.
    Here each group is read alone, in the rounds of ``quantiles``, which run
    when this is called: for columns of few groups.
    """
    kind = df.schema[group].dataType.simpleString()
    key = F.col(f"`{group}`")
    groups = [r[0] for r in df.select(key).distinct().collect()]
    held = [(g, quantiles(df.filter(key.eqNullSafe(F.lit(g).cast(kind))), column, fractions, sort_rows)) for g in groups]
    return df.sparkSession.createDataFrame(held, f"`{group}` {kind}, q array<double>")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): the number of different values that are not null, of each column.

    Each column is read alone. Values are made distinct where they are read,
    then by an exchange on the value; the last step adds up counts.
    """
    out = None
    for c in columns:
        one = df.select(F.col(f"`{c}`").alias("v")).filter("v IS NOT NULL").distinct().agg(F.count("*").alias("n")).select(F.lit(c).alias("column"), "n")
        out = one if out is None else out.unionByName(one)
    return out

