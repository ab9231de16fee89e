"""Raw uploads: copied once, identified, never changed.

An upload's files are copied to a folder of the run's own, under the names
that they have below their common folder, and their SHA-256 digests go to a
manifest, so that any later change is found by reading them again. The run
then commits the dataset id (see ``commits``): of two runs of one id one
fails, a run that does not come so far leaves the id free. Files are copied
and hashed by tasks, a file each, in blocks: none has to fit in memory.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.sources.commits import CommitLog, Taken, hadoop_path

BLOCK = 8 << 20
MANIFEST = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("raw_path", T.StringType()),
        T.StructField("raw_sha256", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("code_version", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("imported_at", T.TimestampType()),
    ]
)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest rows of all committed datasets; empty if there are none."""
    done = CommitLog(spark, root).entries().select("dataset_id", "run")
    try:
        rows = spark.read.schema(T.StructType([*MANIFEST.fields, T.StructField("run", T.StringType())])).parquet(f"{root}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    return rows.join(done, ["dataset_id", "run"], "left_semi").select(*MANIFEST.names)


def new_dataset_id() -> str:
    """A random id."""
    return uuid.uuid4().hex


def _open(path: str):
    """(file system, place in it) of a path as Spark writes it, which is not an encoded URI: names may hold blanks, % and #."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host = rest[2:].partition("/")[0] if rest.startswith("//") else ""
    return fs.FileSystem.from_uri(f"{scheme}://{host}{quote(rest[2 + len(host):] if rest.startswith('//') else rest, safe='/')}")


def _hash(path: str, copy_to: str | None = None) -> tuple[str, int]:
    """Digest and size of a file that is read, and copied if asked, block by block.

    A copy is written under a name of this attempt's own and then renamed. A
    copy that is there already, of an earlier attempt of this task, stays and
    is what the digest is of.
    """
    from pyarrow import fs

    source, place = _open(path)
    digest, size, out, own = hashlib.sha256(), 0, None, None
    if copy_to is not None:
        target, where = _open(copy_to)
        if target.get_file_info(where).type != fs.FileType.NotFound:
            return _hash(copy_to)
        folder = where.rsplit("/", 1)[0]
        target.create_dir(folder, recursive=True)
        own = f"{folder}/_{uuid.uuid4().hex}"  # no reader takes names with _ for data
    with source.open_input_stream(place) as f:
        if own is not None:
            out = target.open_output_stream(own)
        while block := f.read(BLOCK):
            digest.update(block)
            size += len(block)
            if out is not None:
                out.write(block)
    if out is not None:
        out.close()
        target.move(own, where)
    return digest.hexdigest(), size


def hash_files(paths: DataFrame) -> DataFrame:
    """(raw_path, raw_sha256, n_bytes) for (raw_path, copy_to); a file that is not there has nulls. Files are copied where ``copy_to`` is not null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, copy_to in zip(batch["raw_path"], batch["copy_to"]):
                try:
                    digest, size = _hash(path, copy_to)
                except FileNotFoundError:
                    digest, size = None, None
                yield pd.DataFrame({"raw_path": [copy_to or path], "raw_sha256": [digest], "n_bytes": pd.array([size], "Int64")})

    return paths.select("raw_path", "copy_to").repartition("raw_path").mapInPandas(run, "raw_path string, raw_sha256 string, n_bytes long")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """The paths of a file, of the files of a folder and of the folders in it, or of a glob's. Their contents are not read.

    Names that begin with _ or . are not data to any reader of Spark, and not listed.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("raw_path")).distinct()


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(raw_path, raw_sha256, n_bytes) of a file or of the files of a folder."""
    return hash_files(files_of(spark, path).withColumn("copy_to", F.lit(None).cast("string")))


def common_folder(files: DataFrame) -> str | None:
    """The folder, with a slash at its end, that all files are below; None if there are no files."""
    ends = files.agg(F.min("raw_path").alias("a"), F.max("raw_path").alias("b")).head()
    # what the first and the last of the sorted paths share, all share
    return None if ends.a is None else os.path.commonprefix([ends.a, ends.b]).rpartition("/")[0] + "/"


def take_in(spark: SparkSession, root: str, path: str, dataset_id: str, run: str, code_version: str, params: dict[str, str] | None = None, copy: bool = True) -> dict[str, str]:
    """Copy an upload for a run and record it; returns the places to commit, ``raw`` (if copied) and ``manifest``.

    Nothing is visible before the commit. A run that has a whole manifest
    keeps it. An upload without files is an error.
    """
    base = root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"
    places = {"manifest": f"{root}/manifest/dataset_id={dataset_id}/run={run}"} | ({"raw": f"{root}/raw/dataset_id={dataset_id}/run={run}"} if copy else {})
    done, fs = hadoop_path(spark, f"{places['manifest']}/_SUCCESS")
    if fs.exists(done):
        return places
    files = files_of(spark, path)
    if (folder := common_folder(files)) is None:
        raise FileNotFoundError(f"{path} has no files")
    below = F.substring(F.col("raw_path"), F.lit(len(folder) + 1), F.length("raw_path"))
    target = F.concat(F.lit(f"{base}/raw/dataset_id={dataset_id}/run={run}/"), below) if copy else F.lit(None).cast("string")
    options = F.create_map(*[F.lit(x) for pair in sorted((params or {}).items()) for x in pair]) if params else F.lit(None)
    rows = hash_files(files.withColumn("copy_to", target)).select(
        "raw_path", "raw_sha256", "n_bytes", F.lit(code_version).alias("code_version"), options.cast("map<string,string>").alias("params"), F.current_timestamp().alias("imported_at")
    )
    # what a broken attempt of this run has left goes; no other run writes here
    rows.write.mode("overwrite").parquet(places["manifest"])
    return places


def register_raw(spark: SparkSession, root: str, path: str, code_version: str, params: dict[str, str] | None = None, dataset_id: str | None = None, copy: bool = True) -> str:
    """Take in an upload and return its dataset id.

    The files are copied to ``raw/dataset_id=<id>/run=<run>`` (with
    ``copy=False`` they stay where they are and are only recorded), each under
    its path below the folder that all have in common, so files of one name
    stay apart. The id is then committed; it is an error if it is taken, and
    free again if anything before fails.
    """
    dataset_id, run = dataset_id or new_dataset_id(), uuid.uuid4().hex
    log = CommitLog(spark, root)
    if log.find(dataset_id) is not None:
        raise Taken(f"dataset id {dataset_id} is taken")
    places = take_in(spark, root, path, dataset_id, run, code_version, params, copy)
    try:
        log.commit(dataset_id, run, places)
    except Taken:
        discard_run(spark, root, dataset_id, run)
        raise
    return dataset_id


def discard_run(spark: SparkSession, root: str, dataset_id: str, run: str) -> None:
    """Remove the copies and the manifest of a run that has not been committed."""
    for kind in ("raw", "manifest"):
        path, fs = hadoop_path(spark, f"{root}/{kind}/dataset_id={dataset_id}/run={run}")
        fs.delete(path, True)


def raw_paths(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """(raw_path, raw_sha256, n_bytes) of an upload, from the manifest."""
    return read_manifest(spark, root).filter(F.col("dataset_id") == dataset_id).select("raw_path", "raw_sha256", "n_bytes")


def verify_raw(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """(raw_path, status) of an upload's files: unchanged, changed or missing, in one job."""
    known = raw_paths(spark, root, dataset_id).select("raw_path", F.col("raw_sha256").alias("old"))
    now = hash_files(known.withColumn("copy_to", F.lit(None).cast("string"))).select("raw_path", F.col("raw_sha256").alias("new"))
    status = F.when(F.col("new").isNull(), "missing").when(F.col("new") == F.col("old"), "unchanged").otherwise("changed")
    return known.join(now, "raw_path", "left").select("raw_path", status.alias("status"))
