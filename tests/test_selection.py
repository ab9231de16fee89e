"""Order statistics and distinct counts against sorting, on hard distributions."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quernel.operators import selection
from quernel.operators.reports import quality_report

r = random.Random(11)
COLUMNS = {
    "bigint": [r.randint(-(2**63), 2**63 - 1) for _ in range(300)] + [2**63 - 1, -(2**63)] + [7] * 200 + [None] * 5,
    "long": [2**62 + i for i in range(400)],
    "tinyint": [r.randint(-128, 127) for _ in range(500)],
    "double": [r.uniform(-1, 1) * 10 ** r.randint(-300, 300) for _ in range(400)] + [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308] + [3.25] * 100,
    "float": [float(i) / 8 for i in range(-200, 200)],
    "double ": [float("nan"), float("nan"), float("inf"), float("-inf"), float("inf"), 1.0, 2.0, 2.0, None] * 9,
    "double  ": [math.exp(r.gauss(0, 30)) for _ in range(500)],
    "decimal(38,10)": [Decimal(10**27 + i).scaleb(-10 + 9) for i in range(200)] + [Decimal("-0.0000000001")],
    "decimal(12,2)": [Decimal(r.randint(-(10**6), 10**6)).scaleb(-2) for _ in range(300)],
    "int": [4] * 50,
}


def ordered(values):
    return sorted((v for v in values if v is not None), key=lambda v: (v != v, v))


def same(a, b):
    return a == b or (a != a and b != b)


@pytest.mark.parametrize("kind", COLUMNS)
def test_every_rank_is_found(spark, kind):
    values = COLUMNS[kind]
    df = spark.createDataFrame([(v,) for v in values], f"`a b` {kind.strip()}").repartition(5)
    want = ordered(values)
    ranks = sorted({0, len(want) - 1, len(want) // 2, len(want) // 3, len(want) - 2, 1})
    rounds = []
    got = selection.order_statistics(df, "a b", [*ranks, len(want), -1], rounds, sort_rows=3)
    assert set(got) == set(ranks) and all(same(got[k], want[k]) for k in ranks)
    assert len(rounds) <= 12 and all(n <= (selection.BUCKETS + 1) * len(ranks) for n in rounds)
    if kind.strip() != "double " and not any(v != v or abs(v) > 1e300 for v in want):
        fractions = [0.0, 0.1, 0.5, 0.999, 1.0]
        plain = df.select(F.percentile("a b", F.array(*map(F.lit, fractions)))).head()[0]
        assert selection.quantiles(df, "a b", fractions, sort_rows=3) == pytest.approx(plain, rel=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert selection.quantiles(df, "v", [0.5, 1.0]) == [None, None]
    assert selection.order_statistics(df, "v", [0]) == {}
    assert {(x.metric, x.value) for x in quality_report(df, "d", "t").collect()} == {("rows", 2), ("nulls", 2), ("distinct", 0), ("min", None), ("max", None), ("p50", None)}


def test_the_report_is_the_same_at_any_size(spark):
    """A bound on what is sorted changes how values are found, not the values."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 10_007).alias("a"), F.exp(F.col("id") % 613 - 300).alias("b"), F.lit("x").alias("c"))
    reports = [{tuple(x) for x in quality_report(df, "d", "t", quantiles=(0.25, 0.5, 0.999), sort_rows=n).collect()} for n in (10, 10**6)]
    assert reports[0] == reports[1]
    assert ("d", "t", "a", "distinct", 10_007.0) in reports[0] and {x[3] for x in reports[0]} >= {"p25", "p50", "p99_9"}


def test_no_task_holds_a_column(spark):
    """Rounds send histograms, distinct counts send values by hash; nothing gathers values in one task."""
    df = spark.range(0, 50_000, numPartitions=8).select((F.col("id") * 7 % 50_000).alias("v"))
    plan = selection.distinct_counts(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(v" in plan
    single = plan.split("Exchange SinglePartition")[1].split("\n")[1]
    assert "partial_count(1)" in single  # what meets in one task is one count of each partition


def test_quantiles_by_group(spark):
    """What ``percentile`` gives by group; no plan of it gathers a group's values."""
    df = spark.range(5000).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("g"), F.col("id") % 3)).alias("g h"), F.when(F.col("id") % 11 > 0, F.exp(F.col("id") * 7919 % 5003 / 100)).alias("v"))
    df = df.union(spark.sql("SELECT 'none', CAST(NULL AS DOUBLE)"))
    got = selection.group_quantiles(df, "g h", "v", [0.1, 0.5, 0.99], sort_rows=20)
    want = df.groupBy("g h").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99))).alias("q"))
    rows = lambda d: {r[0]: r[1] or [None] * 3 for r in d.collect()}
    mine, other = rows(got), rows(want)
    assert mine.keys() == other.keys() == {"g0", "g1", "g2", None, "none"}
    assert all(mine[k] == (pytest.approx(other[k], rel=1e-12) if k != "none" else [None] * 3) for k in mine)


def test_percentile_queries_gather_no_values(spark):
    from quernel.plans import catalogue

    for name in ("percentiles", "approx_percentile"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not any(f"{f}(" in plan.replace("percentile_approx", "").replace("approx_percentile", "") for f in ("percentile", "median"))
