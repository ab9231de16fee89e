"""Readers with fixed schemas and writers that do not destroy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.sources.commits import hadoop_path

CORRUPT = "_corrupt_record"

TRACK_POINTS = T.StructType(
    [
        T.StructField("track_id", T.LongType()),
        T.StructField("point_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)


def read_files(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None = None, **options: str) -> DataFrame:
    """Read a built-in format (parquet, orc, csv, json, text, xml, avro, binaryFile, jdbc) with a given schema.

    Schemas are never inferred from text formats: without one that is an error.
    """
    if fmt in ("csv", "json", "xml") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def import_points(spark: SparkSession, path: str, fmt: str, dataset_id: str, schema: T.StructType = TRACK_POINTS, **options: str) -> tuple[DataFrame, DataFrame]:
    """(good rows with their dataset id, corrupt rows with file and raw record) of an upload.

    Text formats are read permissively, so a bad record is set aside and not
    silently nulled; other formats carry their schema and have none.
    """
    if fmt in ("csv", "json", "xml"):
        raw = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        rows = read_files(spark, path, fmt, raw, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options).select("*", F.col("_metadata.file_path").alias("file"))
        # always true, and not seen to be: a query on the corrupt column alone would prune the columns that decide it
        parsed = F.xxhash64(*schema.names) >= F.lit(-(2**63))
        rows = rows.withColumn("bad", F.col(CORRUPT).isNotNull() & parsed)
        good = rows.filter(~F.col("bad")).select(F.lit(dataset_id).alias("dataset_id"), *schema.names)
        return good, rows.filter("bad").select(F.lit(dataset_id).alias("dataset_id"), "file", F.col(CORRUPT).alias("record"), *schema.names)
    rows = read_files(spark, path, fmt, schema, **options)
    return rows.select(F.lit(dataset_id).alias("dataset_id"), *schema.names), rows.limit(0).select(F.lit(dataset_id).alias("dataset_id"), F.lit("").alias("file"), F.lit("").alias("record"), *schema.names)


def write_once(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write a table that must not exist."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, *partition_by: str) -> None:
    """Replace the partitions that ``df`` has rows for; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


class Staging:
    """The temporary folder of one import run; its tables are moved to names of the run's own and become visible by a commit."""

    def __init__(self, spark: SparkSession, root: str, dataset_id: str, run_id: str):
        self.spark, self.root, self.dataset_id, self.run_id = spark, root, dataset_id, run_id
        self.path = f"{root}/working/{dataset_id}/{run_id}"

    def _fs(self, path: str):
        return hadoop_path(self.spark, path)

    def _target(self, name: str, product: str) -> str:
        return f"{self.root}/{product}/dataset_id={self.dataset_id}/run={self.run_id}"

    def _whole(self, path: str) -> bool:
        done, fs = self._fs(f"{path}/_SUCCESS")
        return fs.exists(done)

    def write(self, df: DataFrame, name: str, product: str | None = None) -> DataFrame:
        """Write a table of this run and read it back; one that the run has whole already, here or published, is kept."""
        place = self._target(name, product) if product and self._whole(self._target(name, product)) else f"{self.path}/{name}"
        if not self._whole(place):
            df.write.mode("overwrite").parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)

    def publish(self, name: str, product: str) -> str:
        """Move a staged table to its final place, which is this run's own."""
        place = self._target(name, product)
        if self._whole(place):
            return place
        source, fs = self._fs(f"{self.path}/{name}")
        target, _ = self._fs(place)
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"{source} could not be moved to {target}")
        return place

    def discard(self) -> None:
        path, fs = self._fs(self.path)
        fs.delete(path, True)
