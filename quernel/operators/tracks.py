"""Track products: summaries, simplification and map caches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.operators import scan, simplification


def summarise(points: DataFrame, gap_hours: float = 6, keys: tuple[str, ...] = ("track_id",), block: int | None = None) -> DataFrame:
    """One row per track segment.

    A segment starts at a track's first point and wherever the time since the
    previous point exceeds ``gap_hours``. Points are ordered by (ts, point_id),
    so that equal times give one result. Needs track_id, point_id, ts, y.
    One shuffle on the track key serves the two windows and the aggregate, at
    one task a track. ``block``, a number of seconds, cuts tracks into blocks
    of that length that are worked on apart (see ``scan``): the same rows,
    for tables in which a track may hold a large share of all points.
    """
    if block is not None:
        return _summarise_blocks(points, gap_hours, keys, block)
    order = W.partitionBy(*keys).orderBy("ts", "point_id")
    gap = F.make_dt_interval(F.lit(0), F.lit(int(gap_hours)), F.lit(0), F.lit((gap_hours % 1) * 3600))
    previous = F.lag("ts").over(order)
    opens = F.when(previous.isNull() | (F.col("ts") > previous + gap), 1).otherwise(0)
    return (
        points.withColumn("__opens", opens)
        .withColumn("seg", F.sum("__opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "seg")
        .agg(F.count("*").alias("n_points"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    )


def _summarise_blocks(points: DataFrame, gap_hours: float, keys: tuple[str, ...], block: int) -> DataFrame:
    gap = F.make_dt_interval(F.lit(0), F.lit(int(gap_hours)), F.lit(0), F.lit((gap_hours % 1) * 3600))
    near = scan.neighbours(points, keys, block, take=("ts", "point_id"))
    previous = F.col("__prev.ts")
    opens = F.when(previous.isNull() | (F.col("ts") > previous + gap), 1).otherwise(0)
    # segments are summed within a block first, so a long one meets as one row a block
    numbered = scan.running_sum(near, keys, opens, "seg")
    return numbered.groupBy(*keys, "seg").agg(F.count("*").alias("n_points"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def triangle(x0: Column, y0: Column, x: Column, y: Column, x1: Column, y1: Column) -> Column:
    """The area of the triangle of three points; null if a coordinate is."""
    return F.abs((x0 - x) * (y1 - y) - (x1 - x) * (y0 - y)) / 2


def simplify(points: DataFrame, tolerance: float, key: str = "track_id", block: int | None = None) -> DataFrame:
    """One-pass simplification: drop points whose triangle with both neighbours has an area of ``tolerance`` at most.

    First and last points stay, as do points with a null coordinate. One
    window per track, ordered by (ts, point_id), or one per ``block`` seconds
    of a track, as in ``summarise``. Needs ts, point_id, x, y.
    """
    if block is not None:
        near = scan.neighbours(points, (key,), block, take=("ts", "point_id", "x", "y"))
        area = triangle(F.col("__prev.x"), F.col("__prev.y"), F.col("x"), F.col("y"), F.col("__next.x"), F.col("__next.y"))
        return near.filter(F.col("__prev").isNull() | F.col("__next").isNull() | F.coalesce(area > tolerance, F.lit(True))).select(*points.columns)
    order = W.partitionBy(key).orderBy("ts", "point_id")
    cols = {f"__{n}{s}": f(c).over(order) for c, n in (("x", "x"), ("y", "y")) for f, s in ((F.lag, "0"), (F.lead, "1"))}
    # the neighbour's id, not its coordinate, tells whether there is one
    ends = {"__p": F.lag("point_id").over(order), "__n": F.lead("point_id").over(order)}
    area = triangle(F.col("__x0"), F.col("__y0"), F.col("x"), F.col("y"), F.col("__x1"), F.col("__y1"))
    keep = F.col("__p").isNull() | F.col("__n").isNull() | F.coalesce(area > tolerance, F.lit(True))
    return points.withColumns(cols | ends).filter(keep).select(*points.columns)


def simplify_iterative(points: DataFrame, tolerance: float, key: str = "track_id", segment: str | None = None, block: int | None = None, whole: int = 0) -> DataFrame:
    """Visvalingam-Whyatt: remove the point of the smallest triangle, re-evaluate its neighbours, until all exceed ``tolerance``.

    Removal depends on what was removed before, so a track is worked on as
    one unit, in a grouped function. With ``block``, a number of
    seconds, it is worked on by many tasks, with the same result (see
    ``simplification``); tracks of up to ``whole`` points are one unit all
    the same, since cutting many short ones costs more than their points.
    ``segment`` names a column that splits tracks otherwise; each segment
    keeps its ends.
    """
    if block is not None:
        if not whole:
            return simplification.simplify_in_blocks(points, tolerance, key, block)
        long = points.groupBy(F.col(f"`{key}`").alias("__long")).count().filter(F.col("count") > whole).select("__long")
        hot = F.col(f"`{key}`").eqNullSafe(F.col("__long"))
        cut = simplification.simplify_in_blocks(points.join(long, hot, "left_semi"), tolerance, key, block)
        return simplify_iterative(points.join(long, hot, "left_anti"), tolerance, key).unionByName(cut)

    def run(track: pa.Table) -> pa.Table:
        track = track.take(pc.sort_indices(track, [("ts", "ascending"), ("point_id", "ascending")], null_placement="at_start"))
        x, y = (track.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
        stays = np.ones(len(track), bool)
        stays[[i for i, *_ in simplification.removals(x, y, tolerance)]] = False
        return track.filter(pa.array(stays))

    keys = [key] if segment is None else [key, segment]
    return points.groupBy(*keys).applyInArrow(run, points.schema).select(*points.columns)


def map_cache(points: DataFrame, cell_x: float, cell_y: float, zoom: int = 0, key: str = "track_id") -> DataFrame:
    """Points and distinct tracks per grid cell: zoom, cx, cy, n, n_tracks. Points without a place are in no cell."""
    placed = points.filter("x IS NOT NULL AND y IS NOT NULL")
    return placed.groupBy(F.floor(F.col("x") / cell_x).alias("cx"), F.floor(F.col("y") / cell_y).alias("cy")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_tracks")).select(F.lit(zoom).alias("zoom"), "cx", "cy", "n", "n_tracks")
