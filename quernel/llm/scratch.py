"""Tables that outlive the executor that wrote them."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting to remove shuffle files when the execution that wrote them ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where that is unset, a temporary one serves sessions whose executors run
    in the driver's own process, as in local tests; on a cluster no other
    machine could read it, so there that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quernel-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """A folder of intermediate tables under the shared folder.

    A written table cuts lineage: losing an executor costs the tasks that it
    ran, not the steps before. The tables stay for as long as results are
    read from them; ``drop()`` removes one that nothing reads any more, and
    ``clear()`` all.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._where: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

    def keep(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` as Parquet and return it as read again.

        The partitions are those of the plan: adaptive execution joins small
        ones and splits skewed ones, so nothing here fixes their number. What
        the write has shuffled goes with its end: the table stands for it.
        """
        where, before = self.place(), self.spark.conf.get(_TIDY, "false")
        self.spark.conf.set(_TIDY, "true")
        try:
            df.write.partitionBy(*partition_by).parquet(where) if partition_by else df.write.parquet(where)
        finally:
            self.spark.conf.set(_TIDY, before)
        out = self.spark.read.schema(df.schema).parquet(where)
        self._where[out] = where
        return out

    def place(self) -> str:
        self._n += 1
        return f"{self.path}/{self._n - 1}"

    def drop(self, *kept: DataFrame) -> None:
        """Remove kept tables that no result reads."""
        for df in kept:
            _delete(self.spark, self._where.pop(df))

    def remove(self, where: str) -> None:
        """Remove the files of a place that nothing reads."""
        _delete(self.spark, where)

    def clear(self) -> None:
        _delete(self.spark, self.path)
