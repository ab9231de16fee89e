"""Queries in SQL, for both engines. Tables stand in braces."""

from __future__ import annotations

from collections.abc import Callable


def register(sql: Callable[..., None]) -> None:
    # scans, filters and predicates
    sql("scan_project", "SELECT l_orderkey, l_quantity FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_discount > 0.05".replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_discount > 0.05")
    sql("filter_between_in", "SELECT p_partkey, p_brand, p_size FROM {part} WHERE p_size BETWEEN 5 AND 20 AND p_type IN (SELECT p_type FROM {part} WHERE p_size = 1)")
    sql("filter_like_regex", "SELECT c_custkey, c_name FROM {customer} WHERE c_name LIKE '%1%' AND c_name RLIKE '[0-9]{{2}}5$'", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1%' AND regexp_matches(c_name, '[0-9]{2}5$')")
    sql("null_safe_equal", "SELECT count(*) AS n FROM (SELECT NULLIF(p_size, 1) AS a, NULLIF(p_size, 2) AS b FROM {part}) WHERE a <=> b", "SELECT count(*) AS n FROM (SELECT NULLIF(p_size, 1) AS a, NULLIF(p_size, 2) AS b FROM part) WHERE a IS NOT DISTINCT FROM b")
    sql("case_coalesce", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'part' END AS state, COALESCE(NULLIF(o_orderstatus, 'P'), '-') AS st, GREATEST(o_custkey, 100) AS g, LEAST(o_custkey, 100) AS l FROM {orders}")
    sql("correlated_subquery", "SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o_totalprice > (SELECT avg(o2.o_totalprice) * 1.5 FROM {orders} o2 WHERE o2.o_custkey = o.o_custkey)")
    sql("not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
    sql("not_in", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)")
    sql("explode_words", "SELECT p_partkey, w FROM {part} LATERAL VIEW explode(split(p_name, ' ')) t AS w", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
    sql("lateral_subquery", "SELECT c_custkey, t.top FROM {customer} c, LATERAL (SELECT max(o_totalprice) AS top FROM {orders} o WHERE o.o_custkey = c.c_custkey) t")
    sql("pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}) PIVOT (count(l_linenumber) FOR l_linestatus IN ('O' AS open, 'F' AS filled))", "SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS open, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS filled FROM lineitem GROUP BY 1")
    sql("unpivot", "SELECT * FROM (SELECT n_nationkey, n_regionkey AS a, n_nationkey * 2 AS b FROM {nation}) UNPIVOT (v FOR k IN (a, b))", "SELECT n_nationkey, 'a' AS k, n_regionkey AS v FROM nation UNION ALL SELECT n_nationkey, 'b', n_nationkey * 2 FROM nation")
    # a calendar of quarters, grown from the first order to the last
    sql("recursive_cte", """WITH RECURSIVE m(t, z) AS (SELECT CAST(date_trunc('quarter', min(o_orderdate)) AS DATE), CAST(max(o_orderdate) AS DATE) FROM {orders}
      UNION ALL SELECT CAST(t + INTERVAL 3 MONTH AS DATE), z FROM m WHERE CAST(t + INTERVAL 3 MONTH AS DATE) <= z),
    c AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, count(*) AS n FROM {orders} WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT CAST(m.t AS DATE) AS quarter, coalesce(c.n, 0) AS orders FROM m LEFT JOIN c ON c.q = m.t""")
    sql("pipe_syntax", "FROM {orders} |> WHERE o_orderstatus = 'F' |> AGGREGATE count(*) AS n GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
    sql("qualify", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) WHERE rn = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
    # joins
    sql("join_inner", "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
    sql("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 200000")
    sql("join_right", "SELECT s_suppkey, n_name FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey")
    sql("join_full", "SELECT c_custkey, s_suppkey FROM {customer} FULL OUTER JOIN {supplier} ON c_custkey = s_suppkey + 90")
    sql("join_cross", "SELECT n_name, r_name FROM {nation} CROSS JOIN {region}")
    sql("join_semi", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'P'", "SELECT c_custkey FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey")
    sql("join_anti", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'P'", "SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey")
    sql("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
    for kind in ("merge", "shuffle_hash", "broadcast"):
        sql(f"join_{kind}", f"SELECT /*+ {kind}(o) */ o_orderpriority, count(*) AS n FROM {{lineitem}} JOIN {{orders}} o ON l_orderkey = o_orderkey GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
    sql(
        "q5_join",
        """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
        FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY n_name""",
    )
    # aggregates; sums are rounded to the grid of their terms, far above the error of any order of addition
    sql(
        "q1_agg",
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
        round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
        round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    )
    sql("having_filter", "SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 550")
    sql("several_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag")
    sql("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
    sql("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
    sql("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS BIGINT) AS g FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
    sql("statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS cv FROM {lineitem} GROUP BY l_returnflag")
    sql("arg_max", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top, bool_and(o_totalprice > 1000) AS all_big FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS top, bool_and(o_totalprice > 1000) AS all_big FROM orders GROUP BY o_custkey")
    sql("mode", "SELECT o_orderstatus, mode() WITHIN GROUP (ORDER BY o_orderpriority) AS m FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, o_orderpriority AS m FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) = 1")
    sql("list_aggregate", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
    sql("decimal_sum", "SELECT l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS total FROM {lineitem} GROUP BY l_linestatus")
    # sketches: the exact value, and whether the estimate is within its bound
    sql(
        "approx_distinct",
        "SELECT count(DISTINCT l_partkey) AS exact, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.15 * count(DISTINCT l_partkey) AS near, abs(hll_sketch_estimate(hll_sketch_agg(l_partkey)) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS sketched FROM {lineitem}",
        "SELECT count(DISTINCT l_partkey) AS exact, true AS near, true AS sketched FROM lineitem",
    )
    sql(
        "moments",
        "SELECT l_returnflag, round(skewness(l_quantity), 6) AS sk, round(kurtosis(l_quantity), 6) AS ku FROM {lineitem} GROUP BY l_returnflag",
        "SELECT f AS l_returnflag, round(avg(pow(q - m, 3)) / pow(avg(pow(q - m, 2)), 1.5), 6) AS sk, round(avg(pow(q - m, 4)) / pow(avg(pow(q - m, 2)), 2) - 3, 6) AS ku FROM (SELECT l_returnflag AS f, l_quantity AS q, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY f",
    )
    sql("sort_aggregate", "SELECT o_custkey, max(o_orderpriority) AS top, min(o_orderstatus) AS low FROM {orders} GROUP BY o_custkey")
    sql("distinct_rows", "SELECT DISTINCT p_brand, p_size FROM {part}")
    # windows
    sql("ranking", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)".replace("row_number() OVER w", "CAST(row_number() OVER w AS BIGINT)").replace("dense_rank() OVER w", "CAST(dense_rank() OVER w AS BIGINT)").replace(" rank() OVER w", " CAST(rank() OVER w AS BIGINT)").replace("ntile(4) OVER w", "CAST(ntile(4) OVER w AS BIGINT)"))
    sql("offsets", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS later, first_value(o_orderkey) OVER w AS f, nth_value(o_orderkey, 2) OVER w AS second FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
    sql("rows_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS m FROM {events}")
    sql("range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM {events}")
    sql("topn_window", "SELECT o_custkey, o_orderkey, CAST(rn AS BIGINT) AS rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) WHERE rn <= 3")
    # sort, limit and set operations
    sql("top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
    sql("limit_offset", "SELECT c_custkey FROM {customer} ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5")
    sql("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
    sql("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
    sql("intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
    sql("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
    sql("except", "SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey FROM {customer} WHERE c_nationkey < 12")
    sql("except_all", "SELECT o_custkey AS k FROM {orders} EXCEPT ALL SELECT c_custkey FROM {customer}")
    # scalar functions
    sql(
        "string_functions",
        "SELECT p_partkey, upper(p_name) AS u, CAST(length(p_name) AS BIGINT) AS len, substring(p_name, 1, 5) AS sub, replace(p_name, 'a', 'b') AS rep, lpad(p_brand, 12, '*') AS pad, reverse(p_brand) AS rev, regexp_replace(p_name, '[aeiou]', '') AS rx, CAST(locate('a', p_name) AS BIGINT) AS loc, CAST(levenshtein(p_name, p_brand) AS BIGINT) AS lev, split_part(p_name, ' ', 1) AS first FROM {part}",
        "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS len, substring(p_name, 1, 5) AS sub, replace(p_name, 'a', 'b') AS rep, lpad(p_brand, 12, '*') AS pad, reverse(p_brand) AS rev, regexp_replace(p_name, '[aeiou]', '', 'g') AS rx, CAST(instr(p_name, 'a') AS BIGINT) AS loc, levenshtein(p_name, p_brand) AS lev, split_part(p_name, ' ', 1) AS first FROM part",
    )
    sql("trim_functions", "SELECT n_nationkey, trim('  ' || n_name || ' ') AS t, ltrim('  ' || n_name) AS l, rtrim(n_name || '  ') AS r FROM {nation}")
    sql("xxhash64", "SELECT count(DISTINCT xxhash64(c_name)) AS hashes, count(DISTINCT c_name) AS names FROM {customer}", "SELECT count(DISTINCT c_name) AS hashes, count(DISTINCT c_name) AS names FROM customer")
    sql("hash_functions", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s FROM {customer}", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
    sql(
        "date_functions",
        "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS t, last_day(o_orderdate) AS ld, CAST(datediff(DATE '2002-01-01', o_orderdate) AS BIGINT) AS d, CAST(dayofweek(o_orderdate) - 1 AS BIGINT) AS dow, date_format(o_orderdate, 'yyyy-MM') AS ym FROM {orders}",
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t, last_day(o_orderdate) AS ld, date_diff('day', o_orderdate, DATE '2002-01-01') AS d, dayofweek(o_orderdate) AS dow, strftime(o_orderdate, '%Y-%m') AS ym FROM orders",
    )
    sql("math_functions", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS sq, abs(p_size - 20) AS ab, CAST(floor(p_retailprice / 3) AS BIGINT) AS fl, CAST(ceil(p_retailprice / 3) AS BIGINT) AS ce, round(ln(p_retailprice), 6) AS l, round(power(p_size, 2), 3) AS p, CAST(sign(p_size - 20) AS DOUBLE) AS sg FROM {part}")
    sql("safe_division", "SELECT p_partkey, round(try_divide(p_retailprice, p_size - 10), 4) AS r FROM {part}", "SELECT p_partkey, round(p_retailprice / nullif(p_size - 10, 0), 4) AS r FROM part")
    sql(
        "array_functions",
        "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, embedding[0] AS a, round(aggregate(embedding, CAST(0 AS DOUBLE), (s, x) -> s + x), 4) AS total, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS pos FROM {embeddings}",
        "SELECT vec_id, len(embedding) AS n, embedding[1] AS a, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total, len(list_filter(embedding, lambda x: x > 0)) AS pos FROM embeddings",
    )
    sql("map_functions", "SELECT n_regionkey, map_from_entries(array_sort(collect_list(struct(n_name, n_nationkey))))['FRANCE'] AS fr, CAST(count(*) AS BIGINT) AS n FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, max(n_nationkey) FILTER (WHERE n_name = 'FRANCE') AS fr, count(*) AS n FROM nation GROUP BY n_regionkey")
    sql("json_functions", "SELECT event_id, CAST(get_json_object(props, '$.k') AS STRING) AS k FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
    sql("from_json", "SELECT event_id, from_json(props, 'k STRING').k AS k FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
    sql("variant_functions", "SELECT event_id, variant_get(parse_json(props), '$.k', 'string') AS k FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
    sql("collation", "SELECT count(*) AS n FROM {customer} WHERE c_mktsegment COLLATE UTF8_LCASE = 'building'", "SELECT count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'")
    # batch time windows
    sql("window_tumbling", "SELECT CAST(window.start AS TIMESTAMP_NTZ) AS t0, count(*) AS n FROM {events} GROUP BY window(ts, '1 hour')", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS t0, count(*) AS n FROM events GROUP BY 1")
    sql("window_sliding", "SELECT CAST(window.start AS TIMESTAMP_NTZ) AS t0, count(*) AS n FROM {events} GROUP BY window(ts, '1 hour', '30 minutes')", "SELECT t0, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS t0 FROM events) GROUP BY 1")
    sql(
        "window_session",
        "SELECT user_id, CAST(session_window.start AS TIMESTAMP_NTZ) AS t0, CAST(session_window.end AS TIMESTAMP_NTZ) AS t1, count(*) AS n FROM {events} GROUP BY user_id, session_window(ts, '30 minutes')",
        """WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        b AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
        SELECT user_id, min(ts) AS t0, max(ts) + INTERVAL 30 MINUTE AS t1, count(*) AS n FROM b GROUP BY user_id, s""",
    )
