"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, right_columns: list[str], suffix: str = "_asof", block: float | None = None) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    Both sides go through one window ordered by time, right rows first among
    equals, so the cost is a sort of both sides and not the number of pairs
    per key. Among right rows of one time the largest in ``right_columns``
    wins. Left rows without an earlier right row get nulls, as do null keys
    and null times, which take no part in the sort.

    ``block`` cuts time into blocks of so many seconds (units, for numbers),
    so that a key's history is many tasks: each block gets the last right row
    before it from a table of one row per key and block.
    """
    kind = left.schema[time].dataType.typeName()
    number = F.unix_micros(F.col("__t").cast("timestamp")) / 1_000_000 if kind.startswith("timestamp") else F.col("__t").cast("double")
    cut = F.floor(number / F.lit(float(block))) if block else F.lit(0)
    able = F.col(key).isNotNull() & F.col(time).isNotNull()
    l_kind = left.select(F.struct(*left.columns)).schema[0].dataType
    r = right.filter(able).select(F.col(key).alias("__k"), F.col(time).alias("__t"), F.lit(0).alias("__side"), F.struct(*right_columns).alias("__r"), F.lit(None).cast(l_kind).alias("__l"))
    r_kind = r.schema["__r"].dataType
    rows = left.select(F.col(key).alias("__k"), F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r_kind).alias("__r"), F.struct(*left.columns).alias("__l"), able.alias("__able"))
    both = r.unionByName(rows.filter("__able").drop("__able")).withColumn("__b", cut)
    upto = W.partitionBy("__k", "__b").orderBy("__t", "__side", "__r").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("__last", F.last("__r", ignorenulls=True).over(upto)).filter("__side = 1")
    if block:
        ends = both.groupBy("__k", "__b").agg(F.max(F.when(F.col("__side") == 0, F.struct("__t", "__r"))).alias("__end"))
        earlier = W.partitionBy("__k").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
        carried = ends.select("__k", "__b", F.last("__end", ignorenulls=True).over(earlier).getField("__r").alias("__carried"))
        found = found.join(carried, ["__k", "__b"]).withColumn("__last", F.coalesce("__last", "__carried"))
    found = found.select("__l", "__last").unionByName(rows.filter("NOT __able").select("__l", F.col("__r").alias("__last")))
    return found.select("__l.*", *[F.col(f"__last.{c}").alias(f"{c}{suffix}") for c in right_columns])


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of one key whose right time is within ``seconds`` after the left time.

    Times are cut into buckets of the interval's length. A right row is in
    its own bucket, a left row in its own and the next, so the join has equal
    keys that split a busy key over time, and no key is compared with all of
    its rows. Right columns must have other names than left ones, but for the key.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(seconds * 1_000_000))
    l = left.withColumn("__b", F.explode(F.array(bucket(left_time), bucket(left_time) + 1)))
    r = right.withColumn("__b", bucket(right_time)).withColumnRenamed(key, "__key")
    end = F.col(left_time) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)))
    return l.join(r, (F.col(key) == F.col("__key")) & (l["__b"] == r["__b"]) & F.col(right_time).between(F.col(left_time), end)).drop("__key", "__b")


def salted_join(big: DataFrame, other: DataFrame, key: str, salts: int = 16, hot_share: float = 0.01) -> DataFrame:
    """Inner join on ``key`` with the hot keys of ``big`` dealt to ``salts`` parts.

    Hot are keys that hold more than ``hot_share`` of the rows: 1 / hot_share
    at most, so their list is broadcast. Only their rows are salted, and only
    their rows of the other side are repeated. For plans in which adaptive
    execution cannot split a skewed join itself.
    """
    total = big.count()
    hot = big.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_share * total).select(F.col(key).alias("__hot"))
    hot = F.broadcast(hot)
    salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int")).otherwise(0)
    parts = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = big.join(hot, big[key] == F.col("__hot"), "left").withColumn("__salt", salt).drop("__hot")
    o = other.join(hot, other[key] == F.col("__hot"), "left").withColumn("__salt", F.explode(parts)).drop("__hot")
    return b.join(o, [key, "__salt"]).drop("__salt")
