"""Derived products that are built once per input, code version and parameters.

A builder writes to a folder of its own and then puts a pointer to it that
must not exist. So a product is read only when it is whole, nothing is
overwritten while it is read, and of two builders at once one gives the
product; the other removes what it built and reads that.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quernel.sources.commits import hadoop_path, put_if_absent


def derivation_key(raw_sha256: str | list[str], code_version: str, params: dict | None = None) -> str:
    """A digest of everything that a derived product depends on."""
    inputs = [raw_sha256] if isinstance(raw_sha256, str) else sorted(raw_sha256)
    told = json.dumps([inputs, code_version, params or {}], sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()


def _pointed(spark: SparkSession, pointer: str) -> str | None:
    path, fs = hadoop_path(spark, pointer)
    return spark.read.text(pointer, wholetext=True).head().value if fs.exists(path) else None


def _build(spark: SparkSession, folder: str, key: str, df: DataFrame) -> str:
    """Write ``df`` under ``folder`` and point the key to it, unless another builder was first; returns what it points to."""
    own = f"{folder}/build={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(own)
    if put_if_absent(spark, f"{folder}/key={key}.pointer", own):
        return own
    path, fs = hadoop_path(spark, own)
    fs.delete(path, True)
    return _pointed(spark, f"{folder}/key={key}.pointer")


def load_or_build(spark: SparkSession, root: str, product: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The product under ``key``: read if it has been built, else built, written and read."""
    folder = f"{root}/generated/{product}"
    place = _pointed(spark, f"{folder}/key={key}.pointer") or _build(spark, folder, key, build())
    return spark.read.parquet(place)


def load_or_build_parts(spark: SparkSession, root: str, product: str, inputs: dict[str, str | list[str]], code_version: str, params: dict | None, build: Callable[[list[str]], DataFrame]) -> tuple[DataFrame, list[str]]:
    """(the product over all partitions, with a column ``part``, and the partitions that were built now).

    ``inputs`` gives each partition the digests of what it is made from. A
    partition whose digests, code version and parameters have a product
    already is not built, nor are its inputs read: ``build`` gets the others
    and returns their rows, with a column ``part``, in one plan. The
    partitions of this state of the inputs are then named by a version
    file of their own, ``versions/<n>.json``, which ``latest`` reads.
    """
    base = f"{root}/generated/{product}"
    pointers = {part: f"{base}/pointers/part={quote(part, safe='')}/key={derivation_key(digests, code_version, params)}" for part, digests in sorted(inputs.items())}
    places = {part: place for part, pointer in pointers.items() if (place := _pointed(spark, pointer)) is not None}
    if missing := [part for part in pointers if part not in places]:
        own = f"{base}/build={uuid.uuid4().hex}"
        build(missing).write.mode("errorifexists").partitionBy("part").parquet(own)
        for part in missing:
            place = f"{own}/part={quote(part, safe='-._~ ')}"
            path, fs = hadoop_path(spark, place)
            if put_if_absent(spark, pointers[part], place if fs.exists(path) else ""):
                places[part] = place if fs.exists(path) else ""
            else:
                fs.delete(path, True)
                places[part] = _pointed(spark, pointers[part])
    places = dict(sorted(places.items()))
    if _versions(spark, root, product)[1] != places:
        while not put_if_absent(spark, f"{base}/versions/{_versions(spark, root, product)[0] + 1:012d}.json", json.dumps(places)):
            pass
    return _read(spark, places), missing


def _versions(spark: SparkSession, root: str, product: str) -> tuple[int, dict[str, str]]:
    path, fs = hadoop_path(spark, f"{root}/generated/{product}/versions")
    names = sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []
    names = [n for n in names if n[0] not in "_."]
    if not names:
        return 0, {}
    return int(names[-1].removesuffix(".json")), json.loads(_pointed(spark, f"{root}/generated/{product}/versions/{names[-1]}"))


def latest(spark: SparkSession, root: str, product: str) -> DataFrame:
    """A partitioned product as of its last version."""
    version, places = _versions(spark, root, product)
    if not version:
        raise FileNotFoundError(f"{root}/generated/{product}")
    return _read(spark, places)


def _read(spark: SparkSession, places: dict[str, str]) -> DataFrame:
    paths = [p for p in places.values() if p]
    if not paths:
        raise FileNotFoundError("no partition has rows")
    rows = spark.read.parquet(paths[0]).schema
    shape = T.StructType([*rows.fields, T.StructField("build", T.StringType()), T.StructField("part", T.StringType())])
    # the folders part=... below the builds name the partitions
    return spark.read.schema(shape).option("basePath", paths[0].rpartition("/build=")[0]).parquet(*paths).drop("build")
