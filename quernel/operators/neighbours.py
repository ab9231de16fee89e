"""Nearest vectors of many queries by inverted lists, approximate or exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.sources.shared import shared_place

#: At most so many queries are compared with so many vectors at a time.
BLOCK = 2048


def fit_centres(vectors: DataFrame, id: str, vector: str, cells: int = 64, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Directions of at most ``cells`` cells, by k-means over about ``sample`` rows at most, a documented bound.

    Rows are taken by a hash of their id, so the choice does not depend on
    partitions. The centres only say where a vector is looked for: every row
    is placed, whether it was in the sample or not.
    """
    rows = _placed(vectors, id, vector)
    n = rows.count()
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    chosen = rows.filter(spot < (1 << 20) * min(1.0, sample / max(n, 1))).orderBy(F.xxhash64("id"), "id").limit(2 * sample).toPandas()
    if not len(chosen):
        return np.zeros((0, 0))
    x = np.stack(chosen["v"])
    centres = np.unique(x[: 4 * cells], axis=0)[:cells]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def _placed(df: DataFrame, id: str, vector: str) -> DataFrame:
    """id and the vector at unit length; null, empty and zero vectors, and those with places that are null or no finite number, are left out."""
    v = F.col(f"`{vector}`").cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    rows = df.select(F.col(f"`{id}`").alias("id"), v.alias("v"), size.alias("s")).filter("id IS NOT NULL AND s > 0 AND s < 1e150")
    return rows.select("id", F.transform("v", lambda x: x / F.col("s")).alias("v"))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors of the right width, their matrix)."""
    fits = np.asarray(column.value_lengths()) == width
    at = np.flatnonzero(fits)
    return at, column.take(pa.array(at)).flatten().to_numpy().reshape(-1, width)


def nearest(queries: DataFrame, vectors: DataFrame, id: str, vector: str, k: int = 10, centres: np.ndarray | None = None, probes: int = 8, exact: bool = True) -> DataFrame:
    """query, neighbour, rank, similarity: the ``k`` vectors of largest cosine to each query, itself left out.

    Similarities count to 12 decimals, and of equal ones the smaller id is
    first. Each query looks in its ``probes`` nearest cells. With ``exact``
    it then looks in every other cell that could hold a nearer one: none of a
    cell's vectors is nearer than the distance of its centre less the cell's
    radius. Without, recall depends on the probes. A cell of many vectors or
    queries is compared in blocks by many tasks, each of which passes on ``k``
    rows a query. Ids are unique; vectors that ``_placed`` leaves out, or of
    another length than the centres, have no neighbours and are none.
    """
    spark = vectors.sparkSession
    centres = fit_centres(vectors, id, vector) if centres is None else centres
    kind = vectors.schema[id].dataType.simpleString()
    out = f"query {kind}, neighbour {kind}, similarity double"
    if not len(centres):
        return spark.createDataFrame([], f"query {kind}, neighbour {kind}, rank int, similarity double")
    shared, width = spark.sparkContext.broadcast(centres), centres.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _matrix(b.column("v"), width)
            near = x @ shared.value.T
            cell = near.argmax(axis=1) if len(x) else np.zeros(0, int)
            far = np.sqrt(np.maximum(2 - 2 * near[np.arange(len(x)), cell], 0))
            kept = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("v"), pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "v", "cell", "far"])

    root = shared_place(spark, "neighbours")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    members = keep(_placed(vectors, id, vector).mapInArrow(place, f"id {kind}, v array<double>, cell int, far double"), "members")
    # one row a cell
    told = {r.cell: (r.n, r.far) for r in members.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    radius = np.array([told.get(c, (0, -np.inf))[1] for c in range(len(centres))])

    def lists(bounded: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, x = _matrix(b.column("v"), width)
                far = np.sqrt(np.maximum(2 - 2 * (x @ shared.value.T), 0))
                far[:, radius == -np.inf] = np.inf
                order = np.argsort(far, axis=1, kind="stable")
                first = np.zeros(far.shape, bool)
                np.put_along_axis(first, order[:, :probes], True, axis=1)
                wanted = first & np.isfinite(far)
                if bounded:
                    reach = b.column("reach").to_numpy(zero_copy_only=False)[at]
                    wanted = ~first & np.isfinite(far) & (far - radius <= reach[:, None] + 1e-5)
                row, cell = np.nonzero(wanted)
                kept = b.take(pa.array(at[row]))
                yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("v"), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

        return run

    def compare(key, q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(m):
            return pd.DataFrame({"query": q["id"][:0], "neighbour": q["id"][:0], "similarity": np.zeros(0)})
        near = np.round(np.stack(q["v"]) @ np.stack(m["v"]).T, 12)
        ids, rows = m["id"].to_numpy(), []
        by_id = np.argsort(ids, kind="stable")
        near, ids = near[:, by_id], ids[by_id]
        for one, own in zip(q["id"], near):
            able = np.flatnonzero(ids != one)
            best = able[np.argsort(-own[able], kind="stable")[:k]]
            rows.append((np.full(len(best), one, dtype=ids.dtype), ids[best], own[best]))
        a, b, c = (np.concatenate(x) for x in zip(*rows))
        return pd.DataFrame({"query": a, "neighbour": b, "similarity": c})

    def found(asked: DataFrame, name: str) -> DataFrame:
        asked = keep(asked, f"{name}-asked")
        many = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        parts = [(c, -(-told[c][0] // BLOCK), -(-n // BLOCK)) for c, n in many.items()]
        # one row a cell, so it is broadcast
        cut = F.broadcast(spark.createDataFrame(parts, "cell int, mb int, qb int"))
        block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = asked.join(cut, "cell").select("id", "v", "cell", block("qb").alias("q"), spread("mb").alias("m"))
        m = members.join(cut, "cell").select("id", "v", "cell", block("mb").alias("m"), spread("qb").alias("q"))
        pairs = q.groupBy("cell", "q", "m").cogroup(m.groupBy("cell", "q", "m")).applyInPandas(compare, out)
        return keep(pairs, name)

    def ranked(pairs: DataFrame) -> DataFrame:
        order = W.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
        return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    asked = _placed(queries, id, vector)
    ids = f"id {kind}, v array<double>, cell int"
    pairs = found(asked.mapInArrow(lists(False), ids), "first")
    if exact:
        last = ranked(pairs).filter(F.col("rank") == k).select(F.col("query").alias("id"), F.sqrt(F.greatest(2 - 2 * F.col("similarity"), F.lit(0.0))).alias("reach"))
        reach = asked.join(last, "id", "left").select("id", "v", F.coalesce("reach", F.lit(3.0)).alias("reach"))
        pairs = pairs.unionByName(found(reach.mapInArrow(lists(True), ids), "rest"))
    return ranked(pairs).select("query", "neighbour", "rank", "similarity")
