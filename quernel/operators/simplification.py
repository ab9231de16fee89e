"""Visvalingam-Whyatt simplification of one track by many tasks.

The sequential rule removes the point of the smallest triangle, by (area,
place), until all triangles exceed a tolerance. A point that stays for good
parts its track in two: neither side can see past it, and the removals of the
two sides interleave by their running maxima of (area, place), the level.

So tracks are cut at pivots, one in each block of time, the point of its
largest triangle. The units between pivots are simplified apart, as if their
ends stayed, and note at which levels the neighbours of an end change. From
the notes of both sides follows whether a pivot really stays, or at which
level it would have gone. Where one goes, its two units become one and are
done again; up to the lowest such level of a track all removals hold, so those
points are left out. When all pivots stay, the result is that of the
sequential rule: by induction over the levels, every unit has seen what it
would have seen there.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.operators import scan
from quernel.sources.shared import shared_place


def removals(x: np.ndarray, y: np.ndarray, tolerance: float) -> list[tuple[int, float, int, int]]:
    """The points that the sequential rule removes, in its order: (place, area, neighbour before, neighbour after).

    The first and the last point stay, and so does a point whose triangle has
    no area because a coordinate is missing.
    """
    n = len(x)
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    alive = np.ones(n, bool)

    def area(i: int) -> float:
        a, b = before[i], after[i]
        return abs((x[a] - x[i]) * (y[b] - y[i]) - (x[b] - x[i]) * (y[a] - y[i])) / 2

    now = {i: area(i) for i in range(1, n - 1)}
    heap = [(v, i) for i, v in now.items() if v == v]
    heapq.heapify(heap)
    out = []
    while heap:
        v, i = heapq.heappop(heap)
        if not alive[i] or now[i] != v:
            continue
        if v > tolerance:
            break
        alive[i] = False
        a, b = int(before[i]), int(after[i])
        after[a], before[b] = b, a
        out.append((i, float(v), a, b))
        for j in (a, b):
            if 0 < j < n - 1:
                now[j] = area(j)
                if now[j] == now[j]:
                    heapq.heappush(heap, (now[j], j))
    return out


_STATE = "k string, unit long, kind int, pos long, x double, y double, start boolean, end boolean, a double, p long, nx double, ny double"


def _settle(rows: DataFrame, tolerance: float) -> DataFrame:
    """Every unit simplified: its points (kind 0) with the level (a, p) at which they go, and the neighbours of its first (1) and last point (2) from each level on."""

    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]

    def run(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by("pos")
        x, y, pos = (unit.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "pos"))
        x, y = x.astype(float), y.astype(float)
        k, number, n = unit.column("k")[0].as_py(), unit.column("unit")[0].as_py(), len(unit)
        level_a, level_p = np.zeros(n), np.zeros(n, np.int64)
        gone = np.zeros(n, bool)
        # (kind, which end, level from which on, its neighbour)
        notes = [(1, 0, -math.inf, 0, 1), (2, n - 1, -math.inf, 0, n - 2)] if n > 1 else []
        level = (-math.inf, -1)
        for i, v, a, b in removals(x, y, tolerance):
            level = max(level, (v, int(pos[i])))
            gone[i], level_a[i], level_p[i] = True, *level
            if a == 0:
                notes.append((1, 0, *level, b))
            if b == n - 1:
                notes.append((2, n - 1, *level, a))
        kind, at, la, lp, j = (list(c) for c in zip(*notes)) if notes else ([], [], [], [], [])
        at, j, m = np.array(at, int), np.array(j, int), len(notes)
        missing = np.concatenate([~gone, np.zeros(m, bool)])
        columns = [
            [k] * (n + m), [number] * (n + m), [0] * n + kind, np.concatenate([pos, pos[at]]), np.concatenate([x, x[at]]), np.concatenate([y, y[at]]),
            unit.column("start").to_pylist() + [False] * m, unit.column("end").to_pylist() + [False] * m,
            np.ma.array(np.concatenate([level_a, la]), mask=missing), np.ma.array(np.concatenate([level_p, np.array(lp, np.int64)]), mask=missing),
            np.concatenate([np.full(n, np.nan), x[j]]), np.concatenate([np.full(n, np.nan), y[j]]),
        ]
        held = [pa.array(c.data, t, mask=c.mask) if isinstance(c, np.ma.MaskedArray) else pa.array(c, t) for c, t in zip(columns, kinds)]
        return pa.Table.from_arrays(held, [c.split(" ")[0] for c in _STATE.split(", ")])

    return rows.select("k", "unit", "pos", "x", "y", "start", "end").groupBy("k", "unit").applyInArrow(run, _STATE)


def _falls(state: DataFrame, tolerance: float) -> DataFrame:
    """(k, pos, fa, fp): pivots that do not stay, and the level at which they go."""

    shape = pa.schema([("k", pa.string()), ("pos", pa.int64()), ("fa", pa.float64()), ("fp", pa.int64())])

    def fall(notes: list[dict]) -> tuple[float, int] | None:
        x, y, pos = (notes[0][c] for c in ("x", "y", "pos"))
        near: dict[int, tuple[float, float]] = {}
        steps = sorted(enumerate(notes), key=lambda n: (n[1]["a"], n[1]["p"], n[0]))
        # the levels from which the next neighbour is there; the tolerance ends it
        following = [(n["a"], n["p"]) for _, n in steps[1:]] + [(tolerance, math.inf)]
        for (_, n), then in zip(steps, following):
            near[n["kind"]] = n["nx"], n["ny"]
            if len(near) < 2:
                continue
            (bx, by), (cx, cy) = near[2], near[1]
            area = abs((bx - x) * (cy - y) - (cx - x) * (by - y)) / 2
            # within one level the order is by area: a pivot under it may go before the level is done
            if (area, pos) < then:
                return max((n["a"], n["p"]), (area, pos))
        return None

    def run(notes: pa.Table) -> pa.Table:
        rows = notes.to_pylist()
        # the first and the last point of a track have notes of one side
        level = fall(rows) if len({n["kind"] for n in rows}) == 2 else None
        return pa.Table.from_pylist([] if level is None else [{"k": rows[0]["k"], "pos": rows[0]["pos"], "fa": level[0], "fp": level[1]}], shape)

    return state.filter("kind > 0").groupBy("k", "pos").applyInArrow(run, "k string, pos long, fa double, fp long")


def simplify_in_blocks(points: DataFrame, tolerance: float, key: str, block: int) -> DataFrame:
    """What ``tracks.simplify_iterative`` keeps, for tracks of any length.

    ``block`` is the length, in seconds, of the blocks of time that get a
    pivot each; a unit is about a block. Needs ts, point_id, x, y; points are
    ordered by (ts, point_id), other columns are carried along. A track is
    worked on as one unit only where none of its pivots stays: a stretch that
    vanishes whole, as a standstill does, becomes one unit of what is left of it.

    Each round ends in a table in the shared folder; a round repeats only the
    units whose ends did not stay.
    """
    spark = points.sparkSession
    place, tables = shared_place(spark, "simplify"), 0

    def keep(df: DataFrame) -> DataFrame:
        nonlocal tables
        tables += 1
        df.write.parquet(f"{place}/{tables}")
        return spark.read.schema(df.schema).parquet(f"{place}/{tables}")

    near = scan.neighbours(points, (key,), block)
    a, c = F.col("__prev"), F.col("__next")
    area = F.abs((a["x"] - F.col("x")) * (c["y"] - F.col("y")) - (c["x"] - F.col("x")) * (a["y"] - F.col("y"))) / 2
    widest = W.partitionBy(key, scan.BLOCK).orderBy(F.desc(F.coalesce(area, F.lit(math.inf))), "ts", "point_id")
    marked = near.withColumn("__pivot", (F.row_number().over(widest) == 1).cast("int")).drop("__prev", "__next")
    numbered = scan.running_sum(scan.running_sum(marked, (key,), F.lit(1), "__pos"), (key,), F.col("__pivot"), "__unit")
    numbered = keep(numbered.withColumn("__k", F.to_json(F.struct(F.col(f"`{key}`").alias("k")))))

    own = numbered.select(F.col("__k").alias("k"), F.col("__unit").alias("unit"), F.col("__pos").alias("pos"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("__pivot") == 1).alias("start"), F.lit(False).alias("end"))
    # a pivot is the first point of its unit and the last of the one before
    lasts = own.filter("start").select("k", (F.col("unit") - 1).alias("unit"), "pos", "x", "y", F.lit(False).alias("start"), F.lit(True).alias("end"))
    state = keep(_settle(own.unionByName(lasts), tolerance))
    while not (falls := keep(_falls(state, tolerance))).isEmpty():
        first = falls.groupBy("k").agg(F.min(F.struct("fa", "fp")).alias("f"))
        starts = state.filter("kind = 0 AND start").select("k", "unit", "pos").join(falls, ["k", "pos"], "left")
        upto = W.partitionBy("k").orderBy("unit").rowsBetween(W.unboundedPreceding, 0)
        moved = keep(starts.select("k", "unit", F.coalesce(F.max(F.when(F.col("fa").isNull(), F.col("unit"))).over(upto), F.lit(0)).alias("to")))
        targets = moved.filter("unit <> to").select("k", F.col("to").alias("unit")).distinct().withColumn("redo", F.lit(True))
        placed = state.join(moved, ["k", "unit"], "left").withColumn("unit", F.coalesce("to", "unit")).drop("to").join(targets, ["k", "unit"], "left")
        again = placed.filter("redo AND kind = 0").join(first, "k").filter(F.col("a").isNull() | (F.struct(F.col("a").alias("fa"), F.col("p").alias("fp")) >= F.col("f")))
        fallen = falls.select("k", "pos", F.lit(True).alias("fell"))
        again = again.join(fallen, ["k", "pos"], "left").filter("NOT (end AND fell IS NOT NULL)").withColumn("start", F.col("start") & F.col("fell").isNull())
        state = keep(_settle(again, tolerance).unionByName(placed.filter("redo IS NULL").drop("redo").select(*state.columns)))
    stay = state.filter("kind = 0 AND a IS NULL AND NOT end").select(F.col("k").alias("__k"), F.col("pos").alias("__pos"))
    return numbered.join(stay, ["__k", "__pos"], "left_semi").select(*points.columns)
