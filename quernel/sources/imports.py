"""An import from upload to published product, in the order in which a user runs it."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.operators.reports import Rule, quality_report, validate
from quernel.operators.tracks import summarise
from quernel.sources import products, raw, tables
from quernel.sources.commits import CommitLog, Taken, hadoop_path, put_if_absent

#: The folders in which a run has files of its own.
PRODUCTS = {"points": "imports/points", "bad": "imports/bad", "validation": "reports/validation", "quality": "reports/quality"}


@dataclass(frozen=True)
class Imported:
    """What an import leaves behind."""

    dataset_id: str
    points: DataFrame
    bad: DataFrame
    validation: DataFrame
    quality: DataFrame
    summary: DataFrame


def import_upload(
    spark: SparkSession, root: str, path: str, fmt: str, code_version: str, rules: list[Rule], unique: tuple[str, ...] = ("track_id", "point_id"), gap_hours: float = 6,
    schema: T.StructType = tables.TRACK_POINTS, dataset_id: str | None = None, resume: bool = False, progress: Callable[[str], None] = lambda step: None, **options: str,
) -> Imported:
    """Register an upload, import its points, publish them, and build reports and the summary.

    The upload is copied under ``raw/`` and parsed from there; points, bad
    records and reports are staged under ``working/`` and moved to
    ``imports/`` and ``reports/``, all under names of this run. One commit
    then makes them the dataset, so it is there whole or not at all. The summary is a
    product under ``generated/``, found again by the digests of the raw
    files, the code version and its parameters. Bad records are counted by
    the check ``parsed``, which warns.

    A run that fails removes its files, and the id can be tried again. With
    ``resume`` it leaves them, and the next call for the id with ``resume``
    and the same upload, format, options and code version goes on behind the
    last table that is whole. Runs that were killed are found by
    ``half_imports`` and removed by ``sweep``. ``progress`` is told each step
    when it is done.
    """
    log = CommitLog(spark, root)
    dataset_id = dataset_id or raw.new_dataset_id()
    if log.find(dataset_id) is not None:
        raise Taken(f"dataset id {dataset_id} is taken")
    told = json.dumps([path, fmt, code_version, sorted(options.items()), schema.simpleString(), [r.check for r in rules], unique])
    run = (_half_run(spark, root, dataset_id, told) if resume else None) or uuid.uuid4().hex
    stage = tables.Staging(spark, root, dataset_id, run)
    put_if_absent(spark, f"{stage.path}/run.json", told)
    try:
        places = raw.take_in(spark, root, path, dataset_id, run, code_version, {"format": fmt, **options})
        progress("raw")
        good, bad = tables.import_points(spark, places["raw"], fmt, dataset_id, schema, recursiveFileLookup="true", **options)
        staged = stage.write(good, "points", PRODUCTS["points"])
        progress("points")
        rejected = stage.write(bad, "bad", PRODUCTS["bad"])
        progress("bad")
        checks = validate(staged, rules, dataset_id, unique)
        lost = rejected.agg(F.count("*").alias("n_failed")).select(F.lit(dataset_id).alias("dataset_id"), F.lit("parsed").alias("check"), F.when(F.col("n_failed") == 0, "pass").otherwise("warn").alias("status"), "n_failed", F.concat(F.col("n_failed").cast("string"), F.lit(" rows")).alias("detail"))
        schemas = {"points": staged.schema, "bad": rejected.schema}
        for name, report in (("validation", checks.unionByName(lost)), ("quality", quality_report(staged, dataset_id, "points", schema.names))):
            schemas[name] = stage.write(report, name, PRODUCTS[name]).schema
            progress(name)
        for name in schemas:
            places[name] = stage.publish(name, PRODUCTS[name])
            progress(f"publish {name}")
        log.commit(dataset_id, run, places)
    except Exception:
        if not resume:
            _discard(spark, root, dataset_id, run)
        raise
    progress("commit")
    stage.discard()
    out = {name: spark.read.schema(kind).parquet(places[name]) for name, kind in schemas.items()}
    files = raw.raw_paths(spark, root, dataset_id)
    # one digest for the files of an upload, whatever their number
    digest = files.groupBy().agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("raw_sha256"))), 256).alias("d"))
    key = products.derivation_key(digest.head().d, code_version, {"gap_hours": gap_hours})
    summary = products.load_or_build(spark, root, "summary", key, lambda: summarise(out["points"], gap_hours))
    return Imported(dataset_id, out["points"], out["bad"], out["validation"], out["quality"], summary)


def _folders(spark: SparkSession, where: str) -> list[str]:
    path, fs = hadoop_path(spark, where)
    return sorted(x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()) if fs.exists(path) else []


def _half_run(spark: SparkSession, root: str, dataset_id: str, told: str) -> str | None:
    """A run of the id that was begun with the same parameters and not committed."""
    for run in _folders(spark, f"{root}/working/{dataset_id}"):
        path, fs = hadoop_path(spark, f"{root}/working/{dataset_id}/{run}/run.json")
        if fs.exists(path) and spark.read.text(str(path), wholetext=True).head().value == told:
            return run
    return None


def half_imports(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(dataset_id, run) of the runs that began and have neither committed nor cleaned up. They may still be at work."""
    begun = [(i, run) for i in _folders(spark, f"{root}/working") for run in _folders(spark, f"{root}/working/{i}")]
    done = {(r.dataset_id, r.run) for r in CommitLog(spark, root).entries().select("dataset_id", "run").collect()} if begun else set()
    return [x for x in begun if x not in done]


def _discard(spark: SparkSession, root: str, dataset_id: str, run: str) -> None:
    raw.discard_run(spark, root, dataset_id, run)
    for product in PRODUCTS.values():
        path, fs = hadoop_path(spark, f"{root}/{product}/dataset_id={dataset_id}/run={run}")
        fs.delete(path, True)
    tables.Staging(spark, root, dataset_id, run).discard()  # last: it tells that there is something to remove


def sweep(spark: SparkSession, root: str, idle_hours: float = 24) -> list[tuple[str, str]]:
    """Remove the files of half imports that began ``idle_hours`` ago or before; returns them.

    Working folders of committed runs that were killed before they could
    clean up go as well. What has been committed is not touched.
    """
    gone = []
    half = set(half_imports(spark, root))
    for i in _folders(spark, f"{root}/working"):
        for run in _folders(spark, f"{root}/working/{i}"):
            path, fs = hadoop_path(spark, f"{root}/working/{i}/{run}")
            if time.time() - fs.getFileStatus(path).getModificationTime() / 1000 < 3600 * idle_hours:
                continue
            if (i, run) in half:
                _discard(spark, root, i, run)
                gone.append((i, run))
            else:
                fs.delete(path, True)
    return gone
