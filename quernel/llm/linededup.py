r"""Line dedup over levelled sorted runs of line hashes.

A run is a bucketed table of (h1, h2, owner), sorted by hash within buckets
and never changed once written. A batch of
documents is merge-anti-joined to every run, and the hashes that none of
them knows become a run of level 0, owned by the smallest doc_id that holds
them. Whenever a level has ``fanout`` runs they are merged into one of the
next level, so a table of n batches has O(fanout * log n) runs and rewrites
each hash O(log n) times. Batches come in ascending order of doc_id where ids
are numbers, so the owner of a hash is its smallest doc_id overall; where
they cannot, a run may hold a smaller owner for a hash of an earlier one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.scratch import Scratch
from quernel.llm.text import ascii_lower, boxed, lines, strip_blanks, unboxed, wide_hash

HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(strip_blanks(line))


class LineRuns:
    """The levelled runs of one deduplication."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = 4, buckets: int | None = None):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    @contextmanager
    def _in_order(self) -> Iterator[None]:
        """Let scans tell the order within buckets, each of which is one file, so that a run is not sorted again."""
        name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        old = self.spark.conf.get(name, None)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, old) if old is not None else self.spark.conf.unset(name)

    def _write(self, df: DataFrame) -> tuple[str, str]:
        self.schema = df.schema
        name, path = f"line_run_{uuid.uuid4().hex}", self.scratch.place()
        with self._in_order():
            (df.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).format("parquet").saveAsTable(name))
        return name, path

    def _runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def absorb(self, batch: DataFrame) -> None:
        """Add a batch's hashes. ``batch``: (h1, h2, doc_id), a row for each line.

        A hash that a run has is not added, unless the batch has a smaller
        doc_id for it, as happens where batches do not come in ascending order.
        """
        new = batch.groupBy(*HASH).agg(F.min("doc_id").alias("owner"))
        for name, _ in self._runs():
            run = self.spark.table(name).select(*[F.col(h).alias(f"r_{h}") for h in HASH], F.col("owner").alias("r_owner")).hint("merge")
            new = new.join(run, (new.h1 == run.r_h1) & (new.h2 == run.r_h2) & (run.r_owner <= new.owner), "left_anti")
        self._put(0, self._write(new))

    def _put(self, level: int, run: tuple[str, str]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0][0])
            for name, _ in old[1:]:
                merged = merged.union(self.spark.table(name))
            self._put(level + 1, self._write(merged.groupBy(*HASH).agg(F.min("owner").alias("owner"))))
            for name, path in old:
                self.spark.sql(f"DROP TABLE {name}")
                self.scratch.remove(path)

    def owners(self) -> DataFrame:
        """(h1, h2, owner) of all runs, read by path; a hash that got a smaller owner later has several rows."""
        return self.spark.read.schema(self.schema).parquet(*[path for _, path in self._runs()])

    def close(self) -> None:
        """Forget the table names; the files stay for results that read them."""
        for name, _ in self._runs():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, batches: int = 6, fanout: int = 3, scratch: Scratch | None = None) -> DataFrame:
    r"""The documents with repeated lines removed, and n_lines and n_dropped.

    Lines are split at ``\n``; null and empty texts are one empty line. A
    line's key is the line without blanks at its ends, A-Z lower-cased. A key
    of ``min_chars`` code points or more loses all its lines except those of
    the smallest doc_id that holds it (there, all stay). ``text`` becomes
    the other lines joined by ``\n``; the rest of a row is unchanged, but
    n_lines and n_dropped replace columns of those names.

    Rows with a null doc_id are returned with all their lines and own
    nothing. Ids may be of any type that has an order. Rows that share a
    doc_id count as one document; they are told apart by their text. A very
    long text is one row, its lines are rows of hashes. An empty table gives an empty result. A key that a
    third of all lines carry is one row of the runs; the join that finds its
    lines is one that Spark can split.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "line-dedup")
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # Ids that are numbers come in ascending batches; others in batches by hash, whose runs may correct an owner.
    ordered = isinstance(own.schema["doc_id"].dataType, T.NumericType)
    if ordered:
        bounds = own.agg(F.percentile_approx("doc_id", [(i + 1) / batches for i in range(batches - 1)], 10000)).head()[0] or []
        batch, batches = F.lit(0), len(set(bounds)) + 1
        for b in sorted(set(bounds)):
            batch = batch + (F.col("doc_id") > b).cast("int")
    else:
        batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    key = line_key(F.col("line"))
    found = (
        own.filter(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("version"), batch.alias("batch"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "version", "batch", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
    )
    h1, h2 = wide_hash(F.col("key"))
    found = scratch.keep(found.select(h1.alias("h1"), h2.alias("h2"), "doc_id", "version", "pos", "batch"), partition_by=("batch",))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, found.count() // 1_000_000))
    runs = LineRuns(spark, scratch, fanout, buckets)
    try:
        for k in range(batches):
            runs.absorb(found.filter(F.col("batch") == k).select(*HASH, "doc_id"))
        owners = runs.owners() if ordered else runs.owners().groupBy(*HASH).agg(F.min("owner").alias("owner"))
    finally:
        runs.close()
    drops = found.select(*HASH, "doc_id", "version", "pos").join(owners, HASH).filter(F.col("doc_id") > F.col("owner")).groupBy("doc_id", "version").agg(F.collect_set("pos").alias("drops"))
    drops = drops.select(F.col("doc_id").alias("d_id"), F.col("version").alias("d_version"), "drops")
    rows = boxed(docs, doc_id=doc_id, text=text).withColumn("version", F.xxhash64("text"))
    joined = rows.join(drops, (F.col("doc_id") == F.col("d_id")) & (F.col("version") == F.col("d_version")), "left")
    cut = joined.withColumn("all_lines", lines(F.col("text")))
    # A sorted list and its counterpart by position: a map would cost more than a search of a few positions.
    kept = F.when(F.col("drops").isNull(), F.col("all_lines")).otherwise(F.transform(F.array_except(F.sequence(F.lit(0), F.size("all_lines") - 1), F.col("drops")), lambda i: F.get("all_lines", i)))
    n_dropped = F.when(F.col("drops").isNull(), F.lit(0).cast("long")).otherwise(F.size("drops").cast("long"))
    return unboxed(
        cut,
        docs.columns,
        **{text: F.array_join(kept, "\n"), "n_lines": F.size("all_lines").cast("long"), "n_dropped": n_dropped},
    )
