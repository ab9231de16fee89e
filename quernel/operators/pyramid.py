"""Map caches at many zooms from one scan, refreshed day by day.

A cell of the finest zoom is named by its Morton key, the bits of its two
numbers interleaved, so the cell of four at the next zoom is the key without
its last two bits. The sets of a level, one row per cell and track with its
points, are summed from those of the level below; points are read once. Sets
of days can be merged, so tracks are counted exactly over any choice of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.sources import products
from quernel.sources.shared import shared_place

#: Cell numbers lie between -2**30 and 2**30.
_OFFSET = 1 << 30
_MASKS = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def morton(cx: Column, cy: Column) -> Column:
    """The key of a cell: bits of ``cx`` at even places, of ``cy`` at odd ones."""

    def spread(c: Column) -> Column:
        c = (c + F.lit(_OFFSET)).cast("long")
        for by, mask in _MASKS:
            c = c.bitwiseOR(F.shiftleft(c, by)).bitwiseAND(F.lit(mask))
        return c

    return spread(cx).bitwiseOR(F.shiftleft(spread(cy), 1))


def cell_of(key: Column, zoom: int) -> tuple[Column, Column]:
    """(cx, cy) of a key at a zoom, of which 0 is the finest."""

    def gather(c: Column) -> Column:
        c = c.bitwiseAND(F.lit(_MASKS[-1][1]))
        for (by, _), mask in zip(reversed(_MASKS), [m for _, m in reversed(_MASKS[:-1])] + [0x00000000FFFFFFFF]):
            c = c.bitwiseOR(F.shiftright(c, by)).bitwiseAND(F.lit(mask))
        return c - F.lit(_OFFSET >> zoom)

    return gather(key), gather(F.shiftrightunsigned(key, 1))


def cell_sets(points: DataFrame, cell_x: float, cell_y: float, zooms: int, key: str = "track_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(zoom, cell, track, n and the columns ``by``): the points of each track in each cell, for all zooms.

    Points without a place are in no cell; a null track is a track of its
    own that is not counted as one. The finest sets are written once, and
    each level is a sum over the one below, so it shuffles less.
    """
    spark = points.sparkSession
    place = shared_place(spark, "pyramid")
    placed = points.filter("x IS NOT NULL AND y IS NOT NULL").select(morton(F.floor(F.col("x") / cell_x), F.floor(F.col("y") / cell_y)).alias("cell"), F.col(f"`{key}`").alias("track"), *by)
    level = placed.groupBy("cell", "track", *by).agg(F.count("*").alias("n"))
    out = None
    for zoom in range(zooms):
        level.write.parquet(f"{place}/{zoom}")
        level = spark.read.schema(level.schema).parquet(f"{place}/{zoom}")
        told = level.select(F.lit(zoom).alias("zoom"), "cell", "track", "n", *by)
        out = told if out is None else out.unionByName(told)
        level = level.groupBy(F.shiftright("cell", 2).alias("cell"), "track", *by).agg(F.sum("n").alias("n"))
    return out


def counted(sets: DataFrame, zooms: int) -> DataFrame:
    """zoom, cx, cy, n, n_tracks of sets, which may be of several days: each track counts once in a cell."""
    once = sets.groupBy("zoom", "cell", "track").agg(F.sum("n").alias("n"))
    cells = once.groupBy("zoom", "cell").agg(F.sum("n").alias("n"), F.count("track").alias("n_tracks"))
    cx, cy = F.lit(None).cast("long"), F.lit(None).cast("long")
    for zoom in range(zooms):
        at = cell_of(F.col("cell"), zoom)
        cx, cy = F.when(F.col("zoom") == zoom, at[0]).otherwise(cx), F.when(F.col("zoom") == zoom, at[1]).otherwise(cy)
    return cells.select("zoom", cx.alias("cx"), cy.alias("cy"), "n", "n_tracks")


def map_pyramid(points: DataFrame, cell_x: float, cell_y: float, zooms: int = 6, key: str = "track_id") -> DataFrame:
    """Points and distinct tracks per cell at ``zooms`` zooms, each with cells twice as wide: zoom, cx, cy, n, n_tracks."""
    return counted(cell_sets(points, cell_x, cell_y, zooms, key), zooms)


def day_digests(points: DataFrame, day: Column) -> dict[str, str]:
    """A digest of the rows of each day, whatever their order: one short row a day comes to the driver."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in points.columns])
    rows = points.groupBy(day.cast("string").alias("day")).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s"))
    return {r.day: f"{r.n}-{r.x}-{r.s}" for r in rows.filter("day IS NOT NULL").collect()}


def refresh_pyramid(spark: SparkSession, root: str, points: DataFrame, day: Column, cell_x: float, cell_y: float, zooms: int = 6, key: str = "track_id", code_version: str = "1") -> tuple[DataFrame, list[str]]:
    """(the pyramid of all days, the days whose sets were built now).

    Sets are products of a day; one whose rows have not changed since is not
    built again, and only the points of the others go through the levels.
    Points without a day are left out.
    """
    name = day.cast("string")

    def build(days: list[str]) -> DataFrame:
        new = points.withColumn("part", name).filter(F.col("part").isin(days))
        return cell_sets(new, cell_x, cell_y, zooms, key, by=("part",))

    sets, built = products.load_or_build_parts(spark, root, "map_sets", day_digests(points, day), code_version, {"cell": [cell_x, cell_y], "zooms": zooms, "key": key}, build)
    return counted(sets, zooms), built
