"""A log of commits: what exists is what the log names.

A commit is one file, ``commits/<version>.json``, that must not exist before.
Writers prepare everything under names of their own and then try the next
version; whoever finds it taken reads what came in between and tries again,
unless that is the same dataset. Readers take the paths of the commits up to a
version, so they see datasets whole or not at all, and files of runs that
never committed are seen by nobody.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("tables", T.MapType(T.StringType(), T.StringType())),
        T.StructField("committed_at", T.StringType()),
    ]
)


class Taken(ValueError):
    """The dataset id has been committed by another run."""


def hadoop_path(spark: SparkSession, where: str):
    """(path, its file system)"""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def link_new(name: str, text: str) -> bool:
    """Write a file of a mounted file system whole, unless it exists."""
    own = f"{os.path.dirname(name)}/_{uuid.uuid4().hex}"
    with open(own, "x", encoding="utf-8") as f:
        f.write(text)
    try:
        os.link(own, name)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(own)


def put_if_absent(spark: SparkSession, where: str, text: str) -> bool:
    """Write a small file whole unless it exists; of several writers at once one succeeds.

    The text is written under another name first. A local file then gets its
    name by a link, which fails if it is taken; elsewhere a rename that must
    not replace does.
    """
    jvm = spark.sparkContext._jvm
    path, fs = hadoop_path(spark, where)
    path = fs.makeQualified(path)
    fs.mkdirs(path.getParent())
    if path.toUri().getScheme() == "file":
        return link_new(path.toUri().getPath(), text)
    own = jvm.org.apache.hadoop.fs.Path(path.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(own, path, none)
        return True
    except Exception:
        if not fs.exists(path):
            raise
        fs.delete(own, False)
        return False


class CommitLog:
    """The commits under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        path, fs = hadoop_path(self.spark, f"{self.root}/commits")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] not in "_.")

    def entries(self, version: int | None = None) -> DataFrame:
        """The commits up to ``version``, or all: version, dataset_id, run, tables (name to path), committed_at."""
        if not self.versions():
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.schema(ENTRY).json(f"{self.root}/commits", pathGlobFilter="*.json")
        return rows if version is None else rows.filter(F.col("version") <= version)

    def find(self, dataset_id: str) -> dict | None:
        """The commit of a dataset, or None."""
        row = self.entries().filter(F.col("dataset_id") == dataset_id).head()
        return row.asDict() if row else None

    def commit(self, dataset_id: str, run: str, tables: dict[str, str]) -> int:
        """Make a run's tables the dataset; returns the version. ``Taken`` if another run has committed it."""
        # listed before the id is looked up: what is committed in between is met as a taken version
        last = max(self.versions(), default=0)
        if (known := self.find(dataset_id)) is not None:
            raise Taken(f"dataset id {dataset_id} is taken by version {known['version']}")
        while True:
            entry = {"version": last + 1, "dataset_id": dataset_id, "run": run, "tables": tables, "committed_at": datetime.now(timezone.utc).isoformat()}
            if put_if_absent(self.spark, f"{self.root}/commits/{last + 1:020d}.json", json.dumps(entry)):
                return last + 1
            # someone was first: what they committed must not be this dataset
            path, fs = hadoop_path(self.spark, f"{self.root}/commits/{last + 1:020d}.json")
            other = self.spark.read.schema(ENTRY).json(str(path)).head()
            if other.dataset_id == dataset_id:
                raise Taken(f"dataset id {dataset_id} is taken by version {other.version}")
            last += 1

    def table(self, name: str, version: int | None = None, dataset_id: str | None = None) -> DataFrame:
        """A table's rows of all datasets committed up to ``version``, or of one; a table that none has is an error."""
        rows = self.entries(version).filter(F.col("tables")[name].isNotNull())
        if dataset_id is not None:
            rows = rows.filter(F.col("dataset_id") == dataset_id)
        paths = [r.p for r in rows.select(F.col("tables")[name].alias("p"), "version").orderBy("version").collect()]
        if not paths:
            raise FileNotFoundError(f"no committed dataset has a table {name}")
        return self.spark.read.parquet(*paths)
