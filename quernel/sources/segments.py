"""A custom source and sink: tables of segments under a log of commits.

``df.write.format("segments").mode("append").save(path)`` writes a segment a
task and then one commit that names them; ``spark.read`` and
``spark.readStream`` of the same format see the segments of commits alone, so
a task that fails, or a job that does, leaves no rows. A commit keeps the
smallest and largest value of each number and text column of a segment, by
which a filter leaves out whole segments (Spark asks for that where
``spark.sql.python.filterPushdown.enabled`` is on). A stream's offset is a
commit's version.

The folder is one that all machines have mounted: names are given by links,
which fail if they are taken.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from quernel.sources.commits import link_new


@dataclass
class Written(WriterCommitMessage):
    """A segment that a task has written whole."""

    segment: dict


def _place(path: str) -> str:
    return path.removeprefix("file:").replace("//", "/") if path.startswith("file:") else path


def _commits(path: str) -> list[tuple[int, str]]:
    folder = f"{path}/commits"
    names = sorted(n for n in os.listdir(folder) if n[0] not in "_.") if os.path.isdir(folder) else []
    return [(int(n.removesuffix(".json")), f"{folder}/{n}") for n in names]


def _segments(path: str, after: int = 0, up_to: int | None = None, batch: bool = True) -> list[dict]:
    """The segments of commits after one and up to another; in a batch those that a later overwrite replaced are gone."""
    out: list[dict] = []
    for version, name in _commits(path):
        if version > after and (up_to is None or version <= up_to):
            told = json.load(open(name, encoding="utf-8"))
            out = ([] if told["replaces"] and batch else out) + told["segments"]
    return out


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema.json(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(f"{self.path}/data", exist_ok=True)
        name, rows, writer, stats = f"{uuid.uuid4().hex}.parquet", 0, None, {}
        for batch in iterator:
            writer = writer or pq.ParquetWriter(f"{self.path}/data/{name}", batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
            for column, values in zip(batch.schema.names, batch.columns):
                if pa.types.is_integer(values.type) or pa.types.is_floating(values.type) or pa.types.is_string(values.type):
                    ends = pc.min_max(values).as_py()
                    known = stats.setdefault(column, [None, None, False])
                    if ends["min"] is not None:
                        known[0] = ends["min"] if known[0] is None else min(known[0], ends["min"])
                        known[1] = ends["max"] if known[1] is None else max(known[1], ends["max"])
                    # Spark takes NaN for the largest number, min_max does not see it
                    known[2] = known[2] or pa.types.is_floating(values.type) and bool(pc.any(pc.is_nan(values)).as_py())
        if writer is not None:
            writer.close()
        return Written({"file": name, "rows": rows, "stats": stats} if rows else {})

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(f"{self.path}/commits", exist_ok=True)
        link_new(f"{self.path}/schema.json", self.schema)
        told = json.dumps({"replaces": self.overwrite, "segments": [m.segment for m in messages if m is not None and m.segment]})
        while not link_new(f"{self.path}/commits/{(_commits(self.path) or [(0, '')])[-1][0] + 1:012d}.json", told):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.segment:
                os.unlink(f"{self.path}/data/{m.segment['file']}")


def _may_hold(segment: dict, f: Filter) -> bool:
    """Whether a segment can have a row for which the filter is true, by its smallest and largest values."""
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in segment["stats"]:
        return True
    low, high, nan = segment["stats"][f.attribute[0]]
    if low is None:
        return nan  # nulls alone meet no comparison
    at_least, at_most = (lambda v: nan or high >= v), (lambda v: low <= v)
    if isinstance(f, EqualTo):
        return nan or low <= f.value <= high
    if isinstance(f, In):
        return nan or any(low <= v <= high for v in f.value)
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
        return at_least(f.value)
    if isinstance(f, (LessThan, LessThanOrEqual)):
        return at_most(f.value)
    return True


class _Part(InputPartition):
    pass


def _rows(path: str, part: InputPartition | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # Spark asks so where there are no partitions
        return
    yield from pq.ParquetFile(f"{path}/data/{part.value}").iter_batches()


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        own = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        number = lambda v: isinstance(v, (int, float, str)) and not isinstance(v, bool) and v == v
        self.filters = [f for f in filters if isinstance(f, own) and all(map(number, f.value if isinstance(f, In) else [f.value]))]
        return filters  # segments are left out, rows are Spark's

    def partitions(self) -> list[InputPartition]:
        return [_Part(s["file"]) for s in _segments(self.path) if all(_may_hold(s, f) for f in self.filters)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": (_commits(self.path) or [(0, "")])[-1][0]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(s["file"]) for s in _segments(self.path, start["version"], end["version"], batch=False)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition)


class SegmentSource(DataSource):
    """``format("segments")``: batch read and write, and streams of what is appended."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    @property
    def path(self) -> str:
        return _place(self.options["path"])

    def schema(self) -> StructType:
        with open(f"{self.path}/schema.json", encoding="utf-8") as f:
            return StructType.fromJson(json.load(f))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.path)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.path)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.path, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
