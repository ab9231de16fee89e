"""Prefix scans over long keys, in blocks of time.

A window over a key is one task's work, however long the key. Here a key is
cut into blocks of its order column; windows run within (key, block). Each
block then sends one row, its first and last point and its sum; a window over
these few rows gives every block the neighbours and the sum before it, and an
equi-join on (key, block) brings that back to the points. A key with half of
all rows is so spread over as many tasks as it has blocks, and the plain
window's result comes out, since blocks follow the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = "__block"


def block_of(ts: Column, seconds: int) -> Column:
    """The number of the block that a time lies in; null for no time, which is the first block of its key."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000 * seconds)).cast("long")


def _same_block(keys: tuple[str, ...], other: DataFrame, points: DataFrame) -> Column:
    met = points[BLOCK].eqNullSafe(other["__b"])
    for i, k in enumerate(keys):
        met = met & points[k].eqNullSafe(other[f"__k{i}"])
    return met


def _edges(points: DataFrame, keys: tuple[str, ...], **sums: Column) -> DataFrame:
    return points.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(BLOCK).alias("__b")).agg(*[v.alias(k) for k, v in sums.items()])


def neighbours(points: DataFrame, keys: tuple[str, ...], seconds: int, order: tuple[str, ...] = ("ts", "point_id"), take: tuple[str, ...] = ("ts", "point_id", "x", "y")) -> DataFrame:
    """``points`` with __block, and __prev and __next: structs of the ``take`` columns of the points before and after in the key's order, or null.

    The first of ``order`` is a time and names the block. Rows that are equal
    in all of ``order`` are ordered by ``take``.
    """
    place = F.struct(*[F.col(c) for c in dict.fromkeys((*order, *take))])
    held = points.withColumns({BLOCK: block_of(F.col(order[0]), seconds), "__at": place})
    inside = W.partitionBy(*keys, BLOCK).orderBy("__at")
    local = held.withColumns({"__prev": F.lag("__at").over(inside), "__next": F.lead("__at").over(inside)})
    across = W.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy(F.asc_nulls_first("__b"))
    edges = _edges(held, keys, first=F.min("__at"), last=F.max("__at")).withColumns({"__before": F.lag("last").over(across), "__after": F.lead("first").over(across)}).drop("first", "last")
    joined = local.join(edges, _same_block(keys, edges, local), "left")
    pick = lambda own, other: F.coalesce(own, other)
    return joined.select(*[local[c] for c in points.columns], local[BLOCK], pick(local["__prev"], edges["__before"]).alias("__prev"), pick(local["__next"], edges["__after"]).alias("__next"))


def running_sum(blocked: DataFrame, keys: tuple[str, ...], value: Column, name: str, order: tuple[str, ...] = ("ts", "point_id")) -> DataFrame:
    """``blocked``, which has __block, with the sum of ``value`` up to each row of its key, the row included, as ``name``."""
    held = blocked.withColumn("__value", value)
    inside = W.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = held.withColumn("__sum", F.sum("__value").over(inside))
    across = W.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy(F.asc_nulls_first("__b")).rowsBetween(W.unboundedPreceding, -1)
    carry = _edges(held, keys, __own=F.sum("__value")).withColumn("__carry", F.sum("__own").over(across)).drop("__own")
    joined = local.join(carry, _same_block(keys, carry, local), "left")
    return joined.select(*[local[c] for c in blocked.columns], (F.coalesce(carry["__carry"], F.lit(0)) + local["__sum"]).alias(name))
