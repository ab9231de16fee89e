"""The query catalogue: Spark callables and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quernel.functions import udfs, wkb
from quernel.functions.geo import haversine
from quernel.functions.vectors import cosine
from quernel.operators import joins, neighbours, pyramid, regions, selection, tracks
from quernel.operators.reports import Rule, quality_report, validate
from quernel.sources import database, imports, raw, segments
from quernel.sources.shared import shared_place
from quernel.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL counterpart."""

    def put(f: Query) -> Query:
        _QUERIES[name] = (f, sql)
        return f

    return put


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def _load() -> None:
    from quernel.plans import sqlqueries

    sqlqueries.register(sql)


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql is not None}


_SCHEMAS: dict[tuple[str, int], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Its footer is read once for each state of the file, which a modification time tells."""
    where = f"{sf_dir}/{name}.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    key = where, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(where).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(where)


#: A table of more rows is not broadcast, whatever a hint asks for: hashed, these are some 100 MB on the driver.
BROADCAST_ROWS = 1_000_000


def sql(name: str, spark_sql: str, duck_sql: str | None = None, oracle: bool = True) -> None:
    """Register a SQL query. Tables stand in braces; the same text serves both engines unless ``duck_sql`` is given.

    A hint to broadcast a table holds up to ``BROADCAST_ROWS``; beyond, the
    planner chooses the join.
    """
    names = sorted(set(re.findall(r"\{([a-z]\w*)\}", spark_sql)))
    hint = r"/\*\+ broadcast\((\w+)\) \*/ "
    aliases = re.findall(hint, spark_sql)
    sent = [n for a in aliases for n in names if f"{{{n}}} {a} " in spark_sql]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {n: table(spark, sf_dir, n) for n in names}
        fits = all(tables[n].count() <= BROADCAST_ROWS for n in sent)
        return spark.sql(spark_sql if fits else re.sub(hint, "", spark_sql), **tables)

    _QUERIES[name] = (run, re.sub(r"\{([a-z]\w*)\}", r"\1", duck_sql or spark_sql) if oracle else None)


@query(
    "track_segment",
    """
    WITH a AS (SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) p, event_id FROM events),
    b AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 6 HOUR THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) seg FROM a)
    SELECT user_id, CAST(seg AS BIGINT) AS seg, count(*) AS n_points, min(ts) AS t0, max(ts) AS t1,
           round(min(value), 6) AS min_value, round(max(value), 6) AS max_value
    FROM b GROUP BY user_id, seg""",
)
def track_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("event_id").alias("point_id"), "ts", F.col("value").alias("y"))
    return tracks.summarise(e, gap_hours=6).select(F.col("track_id").alias("user_id"), "seg", "n_points", "t0", "t1", F.round("min_y", 6).alias("min_value"), F.round("max_y", 6).alias("max_value"))


@query(
    "track_simplify",
    """
    WITH p AS (SELECT user_id, event_id, ts, epoch_us(ts) / 3600000000.0 AS x, value AS y FROM events),
    n AS (SELECT *, lag(x) OVER w x0, lag(y) OVER w y0, lead(x) OVER w x1, lead(y) OVER w y1 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id FROM n WHERE x0 IS NULL OR x1 IS NULL OR abs((x0 - x) * (y1 - y) - (x1 - x) * (y0 - y)) / 2 > 50.0""",
)
def track_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.simplify(_points(spark, sf_dir), 50.0).select(F.col("track_id").alias("user_id"), F.col("point_id").alias("event_id"))


#: Every other event belongs to track 0, which so has half of all rows.
_HOT = "(SELECT CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS user_id, event_id, ts, value FROM events)"


def _hot(points: DataFrame) -> DataFrame:
    return points.withColumn("track_id", F.when(F.col("point_id") % 2 == 0, F.lit(0)).otherwise(F.col("track_id")))


@query("hot_track_segment", oracle_sql()["track_segment"].replace("FROM events)", f"FROM {_HOT})", 1))
def hot_track_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments where one track has half of all points: tracks in blocks of a day."""
    e = _hot(_points(spark, sf_dir))
    return tracks.summarise(e, gap_hours=6, block=86400).select(F.col("track_id").alias("user_id"), "seg", "n_points", "t0", "t1", F.round("min_y", 6).alias("min_value"), F.round("max_y", 6).alias("max_value"))


@query("hot_track_simplify", oracle_sql()["track_simplify"].replace("FROM events)", f"FROM {_HOT})", 1))
def hot_track_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-pass simplification where one track has half of all points, in blocks of a day."""
    return tracks.simplify(_hot(_points(spark, sf_dir)), 50.0, block=86400).select(F.col("track_id").alias("user_id"), F.col("point_id").alias("event_id"))


@query("track_simplify_iterative")
def track_simplify_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.simplify_iterative(_points(spark, sf_dir), 50.0).select(F.col("track_id").alias("user_id"), F.col("point_id").alias("event_id"))


@query("hot_track_simplify_iterative")
def hot_track_simplify_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where one track has half of all points: a long track by many tasks, a day a block; of up to 10,000 points each by one."""
    return tracks.simplify_iterative(_hot(_points(spark, sf_dir)), 50.0, block=86400, whole=10_000).select(F.col("track_id").alias("user_id"), F.col("point_id").alias("event_id"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000.0)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("event_id").alias("point_id"), "ts", hours.alias("x"), F.col("value").alias("y"))


@query(
    "map_cache",
    """
    SELECT 0 AS zoom, CAST(floor(epoch_us(ts) / 1000000.0 / 86400) AS BIGINT) AS cx, CAST(floor(value / 16) AS BIGINT) AS cy, count(*) AS n, count(DISTINCT user_id) AS n_tracks
    FROM events GROUP BY 2, 3""",
)
def map_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0))
    return tracks.map_cache(points, 86400, 16)


_PYRAMID = "\n    UNION ALL ".join(
    f"""SELECT {z} AS zoom, CAST(floor(floor(epoch_us(ts) / 1000000.0 / 3600) / {1 << z}) AS BIGINT) AS cx, CAST(floor(floor(value / 4) / {1 << z}) AS BIGINT) AS cy, count(*) AS n, count(DISTINCT user_id) AS n_tracks FROM events GROUP BY 2, 3"""
    for z in range(6)
)


@query("map_pyramid", _PYRAMID)
def map_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six zooms from one scan of events."""
    points = _points(spark, sf_dir).withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0))
    return pyramid.map_pyramid(points, 3600, 4, zooms=6)


@query("map_pyramid_refresh", f"SELECT *, CAST(1 AS INTEGER) AS days_built FROM ({_PYRAMID})")
def map_pyramid_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after all days but the last had been built: one more day is built, the others' sets are reused."""
    root = shared_place(spark, "pyramid")
    points = _points(spark, sf_dir).withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0))
    day = F.to_date("ts")
    last = points.agg(F.max(day).alias("d")).head().d
    pyramid.refresh_pyramid(spark, root, points.filter(day < F.lit(last)), day, 3600, 4)
    cells, built = pyramid.refresh_pyramid(spark, root, points, day, 3600, 4)
    return cells.withColumn("days_built", F.lit(len(built)))


#: Two parts of a region, the first with a hole, in units of its size around its middle.
_PARTS = [[[(-1, -1), (1, -1), (1, 1), (0, 0.25), (-1, 1)], [(-0.5, -0.75), (0.5, -0.75), (0, -0.25)]], [[(1.5, 0), (2, 0), (2, 0.5), (1.5, 0.5)]]]
_REGION_EDGES = " UNION ALL ".join(
    f"SELECT c_custkey, mx + {a[0]} * r AS x1, my + {a[1]} * r AS y1, mx + {b[0]} * r AS x2, my + {b[1]} * r AS y2 FROM g"
    for part in _PARTS
    for ring in part
    for a, b in zip(ring, [*ring[1:], ring[0]])
)


@query(
    "region_points",
    f"""
    WITH g AS (SELECT c_custkey, CAST(473352 + c_custkey * 37 % 720 AS DOUBLE) AS mx, CAST(c_custkey * 17 % 300 AS DOUBLE) AS my, CAST(4 + c_custkey % 29 AS DOUBLE) AS r FROM customer),
    e AS ({_REGION_EDGES}),
    p AS (SELECT event_id, user_id, epoch_us(ts) / 3600000000.0 AS x, CAST(value AS DOUBLE) AS y FROM events),
    h AS (SELECT c_custkey, event_id, user_id FROM e JOIN p ON (y1 > y) <> (y2 > y) WHERE x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
    SELECT c_custkey, count(*) AS n, count(DISTINCT user_id) AS n_tracks, CAST(sum(event_id) AS BIGINT) AS ids FROM h GROUP BY c_custkey""",
)
def region_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in regions of two parts, one with a hole, that each customer draws; regions go through well-known binary."""
    # a small file, but each of its rows draws a shape
    c = table(spark, sf_dir, "customer").select("c_custkey").repartition(2 * spark.sparkContext.defaultParallelism)
    mx, my, r = (473352 + F.col("c_custkey") * 37 % 720).cast("double"), (F.col("c_custkey") * 17 % 300).cast("double"), (4 + F.col("c_custkey") % 29).cast("double")
    place = lambda p: F.struct((mx + p[0] * r).alias("x"), (my + p[1] * r).alias("y"))
    shape = F.array(*[F.array(*[F.array(*[place(p) for p in [*ring, ring[0]]]) for ring in part]) for part in _PARTS])
    drawn = c.select("c_custkey", wkb.multipolygon(shape).alias("shape"))
    return regions.summarise(_points(spark, sf_dir), drawn, "c_custkey", "shape", 2, 2, name="c_custkey")


@query(
    "dq_report",
    """
    SELECT 'events' AS dataset_id, "check", CASE WHEN n_failed = 0 THEN 'pass' ELSE 'fail' END AS status, n_failed, n_failed || ' rows' AS detail FROM (
      SELECT 'value present' AS "check", count(*) FILTER (WHERE value IS NULL) AS n_failed FROM events
      UNION ALL SELECT 'value not negative', count(*) FILTER (WHERE NOT coalesce(value >= 0, false)) FROM events
      UNION ALL SELECT 'value up to 300', count(*) FILTER (WHERE NOT coalesce(value <= 300, false)) FROM events
      UNION ALL SELECT 'unique(event_id)', count(*) - count(DISTINCT event_id) FROM events
      UNION ALL SELECT 'parent(user_id)', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer))""",
)
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule("value present", F.col("value").isNotNull()), Rule("value not negative", F.col("value") >= 0), Rule("value up to 300", F.col("value") <= 300)]
    return validate(table(spark, sf_dir, "events"), rules, "events", unique=("event_id",), parents={"user_id": (table(spark, sf_dir, "customer"), "c_custkey")})


@query(
    "dq_orphans",
    "SELECT count(*) AS orphans FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P')",
)
def dq_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    return table(spark, sf_dir, "lineitem").join(whole, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("orphans"))


_QUANTILES = {"p01": 0.01, "p50": 0.5, "p99": 0.99}


@query(
    "quality_metrics",
    """
    SELECT 'd' AS dataset_id, 'lineitem' AS "table", c AS "column", m AS metric, CAST(v AS DOUBLE) AS value FROM (
      SELECT '*' AS c, 'rows' AS m, count(*) AS v FROM lineitem
      UNION ALL SELECT 'l_shipdate', 'nulls', count(*) - count(l_shipdate) FROM lineitem UNION ALL SELECT 'l_shipdate', 'distinct', count(DISTINCT l_shipdate) FROM lineitem"""
    + "".join(
        f"""
      UNION ALL SELECT '{c}', 'nulls', count(*) - count({c}) FROM lineitem UNION ALL SELECT '{c}', 'distinct', count(DISTINCT {c}) FROM lineitem
      UNION ALL SELECT '{c}', 'min', min({c}) FROM lineitem UNION ALL SELECT '{c}', 'max', max({c}) FROM lineitem"""
        + "".join(f" UNION ALL SELECT '{c}', '{m}', quantile_cont(CAST({c} AS DOUBLE), {p}) FROM lineitem" for m, p in _QUANTILES.items())
        for c in ("l_orderkey", "l_extendedprice", "l_discount")
    )
    + ")",
)
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of four columns; intervals of over 1000 values go through histogram rounds."""
    columns = ["l_shipdate", "l_orderkey", "l_extendedprice", "l_discount"]
    return quality_report(table(spark, sf_dir, "lineitem"), "d", "lineitem", columns, tuple(_QUANTILES.values()), sort_rows=1000)


@query("percentiles", "SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.group_quantiles(table(spark, sf_dir, "events"), "event_type", "value", [0.5, 0.9])
    return found.select("event_type", F.round(F.col("q")[0], 6).alias("med"), F.round(F.col("q")[1], 6).alias("p90"))


@query("approx_percentile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS exact, true AS near FROM lineitem GROUP BY l_returnflag")
def approx_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact median of each flag's prices by histogram rounds, and whether the sketch is within a hundredth of its rank."""
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    exact = selection.group_quantiles(l, "l_returnflag", "l_extendedprice", [0.49, 0.5, 0.51]).withColumnRenamed("l_returnflag", "__flag")
    sketch = l.groupBy("l_returnflag").agg(F.approx_percentile("l_extendedprice", F.lit(0.5)).alias("about"))
    both = sketch.join(exact, F.col("l_returnflag").eqNullSafe(F.col("__flag")))
    return both.select("l_returnflag", F.round(F.col("q")[1], 4).alias("exact"), F.col("about").between(F.col("q")[0], F.col("q")[2]).alias("near"))


@query(
    "asof_join",
    """
    WITH v AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click')
    SELECT v.user_id, v.event_id, v.ts, c.event_id AS event_id_asof FROM v ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.ts >= c.ts""",
)
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return joins.asof_join(e.filter("event_type = 'purchase'").drop("event_type"), e.filter("event_type = 'click'").drop("event_type"), "user_id", "ts", ["event_id"])


@query(
    "interval_join",
    """
    SELECT v.user_id, v.event_id AS view_id, c.event_id AS click_id FROM events v JOIN events c ON v.user_id = c.user_id AND c.ts BETWEEN v.ts AND v.ts + INTERVAL 2 HOUR
    WHERE v.event_type = 'view' AND c.event_type = 'click'""",
)
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    c = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    return joins.interval_join(v, c, "user_id", "view_ts", "click_ts", 7200).select("user_id", "view_id", "click_id")


@query("salted_join", "SELECT l_orderkey, l_linenumber, l_partkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k")
    return joins.salted_join(l, table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "k"), "k").select("l_orderkey", "l_linenumber", "l_partkey", "s_name")


@query("haversine", """
    SELECT c_custkey, round(2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(a - b) / 2), 2), 1.0))), 3) AS metres
    FROM (SELECT c_custkey, CAST(c_custkey % 90 AS DOUBLE) AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer)""")
def haversine_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("c_custkey") % 90).cast("double"), F.col("c_nationkey").cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(haversine(a, b, b, a), 3).alias("metres"))


@query("cosine_topk", """
    WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS sim FROM embeddings, q ORDER BY sim DESC, vec_id LIMIT 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    # one query row: its side of the join is bounded by the filter on the key
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(10)


@query(
    "nearest_vectors",
    """
    WITH p AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 12) AS s
      FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS r FROM p)
    SELECT query, neighbour, CAST(r AS INTEGER) AS rank, round(s, 6) AS similarity FROM r WHERE r <= 10""",
)
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours of every twentieth vector among all, exact."""
    e = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


@query("udf_pandas", "SELECT event_id, least(greatest(value, 10.0), 100.0) AS v FROM events")
def udf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", udfs.clipped("value", F.lit(10.0), F.lit(100.0)).alias("v"))


@query("udf_arrow", "SELECT c_custkey, c_name[1] || length(c_name) AS v FROM customer")
def udf_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", udfs.initials("c_name").alias("v"))


@query("udf_aggregate", "SELECT event_type, round((sum(value) - min(value) - max(value)) / (count(value) - 2), 2) AS v FROM events GROUP BY event_type")
def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(udfs.trimmed_mean("value"), 2).alias("v"))


@query("udf_table", "SELECT p_partkey, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def udf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("numbered_words", udfs.NumberedWords)
    return spark.sql("SELECT p_partkey, pos, word FROM {part}, LATERAL numbered_words(p_name)", part=table(spark, sf_dir, "part"))


@query("udf_row", "SELECT n_nationkey, CAST(n_nationkey // 10 + n_nationkey % 10 AS BIGINT) AS v FROM nation")
def udf_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", udfs.digit_sum(F.col("n_nationkey").cast("long")).alias("v"))


@query("source_tracks", "SELECT user_id AS track_id, count(*) AS n, round(max(value), 6) AS top FROM events WHERE user_id >= 5 AND user_id < 90 GROUP BY user_id")
def source_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through the custom sink, in two commits, and the custom source, which leaves out segments of other tracks."""
    segments.register(spark)
    place = f"{shared_place(spark, 'segments')}/events"
    e = _points(spark, sf_dir).select("track_id", "point_id", F.col("y").alias("value"))
    for half in range(2):
        e.filter(F.col("point_id") % 2 == half).repartitionByRange(8, "track_id").write.format("segments").mode("append").save(place)
    back = spark.read.format("segments").load(place)
    return back.filter("track_id >= 5 AND track_id < 90").groupBy("track_id").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top"))


@query("raw_digests", "SELECT true AS same, true AS whole")
def raw_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the digests and sizes that are read in blocks are those of the files' contents."""
    path = f"{sf_dir}/region.parquet"
    whole = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha"), "length")
    found = raw.digests(spark, path)
    both = found.join(whole, found.raw_path == whole.path, "full")
    return both.agg(F.bool_and(F.coalesce(F.col("raw_sha256") == F.col("sha"), F.lit(False))).alias("same"), F.bool_and(F.coalesce(F.col("n_bytes") == F.col("length"), F.lit(False))).alias("whole"))


@query("file_metadata", "SELECT count(*) AS n, true AS named, true AS sized FROM nation")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("_metadata.file_path", "_metadata.file_size")
    return rows.agg(F.count("*").alias("n"), F.bool_and(F.contains("file_path", F.lit("nation.parquet"))).alias("named"), F.bool_and(F.col("file_size") > 0).alias("sized"))


@query(
    "database_orders",
    """
    SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate,
      CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_totalprice > 100""",
)
def database_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders into a database table and back in ranges of keys; a first run had other prices and half of the rows.

    The database that comes with Spark lives in one process, so this needs a local session.
    """
    url = database.embedded_url(spark, shared_place(spark, "database"))
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    database.execute(spark, url, 'CREATE TABLE orders ("o_orderkey" BIGINT PRIMARY KEY, "o_orderstatus" VARCHAR(8), "o_totalprice" DOUBLE, "o_orderdate" TIMESTAMP, "o_orderpriority" VARCHAR(40))')
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    database.merge_table(o.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0)), url, "orders", ["o_orderkey"], "first")
    for _ in range(2):  # a run that is repeated adds nothing
        database.merge_table(o, url, "orders", ["o_orderkey"], "second")
    return database.read_table(spark, url, "orders", "o_orderkey").filter("o_totalprice > 100")


@query(
    "import_flow",
    """
    WITH p AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, value FROM events),
    s AS (SELECT count(*) AS n FROM p WHERE b IS NULL OR ts > b + INTERVAL 6 HOUR)
    SELECT (SELECT count(*) FROM events) AS points, CAST(2 AS BIGINT) AS bad, s.n AS segments, (SELECT count(*) FROM events WHERE value > 300) AS above, 'warn' AS parsed, 'pass' AS keyed, true AS unchanged,
      (SELECT CAST(max(value) AS DOUBLE) FROM events) AS top FROM s""",
)
def import_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload of events and two broken lines in folders of odd names: registered, parsed, validated, published, summarised and verified."""
    root = shared_place(spark, "import")
    e = _points(spark, sf_dir).withColumn("y", F.col("y").cast("string")).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    broken = spark.range(2).select(F.lit("1").alias("track_id"), F.col("id").cast("string").alias("point_id"), F.lit("never").alias("ts"), F.lit("x").alias("x"), F.lit("y").alias("y"))
    lines = e.select(*[F.col(c).cast("string") for c in broken.columns]).unionByName(broken)
    for half, name in enumerate(("first half", "100% of #2/nested")):
        lines.filter(F.col("point_id").cast("long") % 2 == half).write.csv(f"{root}/upload/{name}")
    done = imports.import_upload(spark, root, f"{root}/upload", "csv", "v1", [Rule("y up to 300", F.col("y") <= 300, fatal=False)], timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    by = F.map_from_entries(F.collect_list(F.struct("check", F.struct("status", "n_failed"))))
    checks = done.validation.agg(by.alias("c")).select(F.col("c")["y up to 300"]["n_failed"].alias("above"), F.col("c")["parsed"]["status"].alias("parsed"), F.col("c")["unique(track_id, point_id)"]["status"].alias("keyed"))
    top = done.quality.filter("column = 'y' AND metric = 'max'").agg(F.max("value").alias("top"))
    whole = raw.verify_raw(spark, root, done.dataset_id).agg(F.bool_and(F.col("status") == "unchanged").alias("unchanged"))
    one = [done.points.agg(F.count("*").alias("points")), done.bad.agg(F.count("*").alias("bad")), done.summary.agg(F.count("*").alias("segments")), checks, top, whole]
    out = one[0]
    for x in one[1:]:  # each is one row
        out = out.crossJoin(x)
    return out


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
_STREAMS = {
    "stream_tumbling": (streams.tumbling, f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS t0, count(*) AS n FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_CLOSED}"),
    "stream_sliding": (streams.sliding, "SELECT t0, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS t0 FROM events) GROUP BY 1"),
    "stream_session": (
        streams.sessions,
        f"""WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        b AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
        SELECT user_id, min(ts) AS t0, max(ts) + INTERVAL 30 MINUTE AS t1, count(*) AS n FROM b GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""",
    ),
    "stream_dedup": (streams.dedup, "SELECT DISTINCT event_id, user_id FROM events"),
    "stream_interval_join": (
        streams.interval_join,
        """SELECT v.user_id, v.event_id AS view_id, c.event_id AS click_id FROM events v JOIN events c ON v.user_id = c.user_id AND c.ts BETWEEN v.ts AND v.ts + INTERVAL 2 HOUR
        WHERE v.event_type = 'view' AND c.event_type = 'click'""",
    ),
    "stream_running_count": (streams.running_count, "SELECT user_id, count(*) AS n FROM events GROUP BY user_id"),
    "stream_running_total": (streams.running_total, "SELECT user_id, count(*) AS n, CAST(sum(CAST(round(100 * value) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY user_id"),
    "stream_top": (
        streams.top_of_hours,
        f"""SELECT t0, CAST(r AS INTEGER) AS rank, event_id, value FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS t0, event_id, value,
        row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, ts) ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3 AND t0 + INTERVAL 1 HOUR <= {_CLOSED}""",
    ),
    "stream_segments": (streams.from_segments, "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type"),
    "stream_rate": (streams.rate, "SELECT c_custkey AS value, c_name FROM customer"),
}
_QUERIES.update(_STREAMS)


_load()
