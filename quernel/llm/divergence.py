r"""An audit of how the sources of each language differ in their terms.

Terms are counted where texts are read; the counts are dealt to shards by a
hash of language and term, so a term has all its sources in one shard.
DuckDB runs SQL over each shard: it sums counts, keeps frequent terms, and in
a second pass forms partial sums over pairs of sources and the shard's top
terms. Spark adds the partial sums up and ranks.

Every share p of a source has a floor, that of a term it lacks. The sum of
|p_a - p_b| over all V terms is therefore V times the difference of the
floors, plus what the terms of a change against b's floor, plus the same for
b, plus a correction for the terms that both have: only the last is formed
pair by pair, and no shard meets a term that a source lacks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.llm.scratch import Scratch
from quernel.llm.text import ASCII_LOWER, ASCII_UPPER
from quernel.llm.tokens import text_slices

#: Shares are whole numbers of this many parts.
PARTS = 1_000_000_000
#: Added to every count.
PRIOR = 5

_COUNT = rf"""
SELECT lang, source, term, count(*) AS docs, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT row, lang, source, term, count(*) AS n FROM (
    SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM part)
  GROUP BY ALL)
GROUP BY ALL"""
_KEEP = """
WITH c AS MATERIALIZED (SELECT lang, source, term, sum(docs) AS docs, CAST(sum(n) AS BIGINT) AS n FROM part GROUP BY ALL),
k AS (SELECT lang, term FROM c GROUP BY ALL HAVING sum(docs) >= {min_docs})
SELECT lang, source, term, n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS first FROM c JOIN k USING (lang, term)"""
_PAIRS = f"""
WITH s AS MATERIALIZED (SELECT lang, source, term, 1 + {PARTS}::HUGEINT * (n + {PRIOR}) // (total + {PRIOR} * v) AS p, 1 + {PARTS}::HUGEINT * {PRIOR} // (total + {PRIOR} * v) AS low,
  1 + {PARTS}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + {PRIOR}) // (lang_total + {PRIOR} * v) AS q FROM part)
SELECT lang, source, 'both' AS part, item, CAST(x AS BIGINT) AS value, 1::BIGINT AS times FROM (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p) - abs(a.p - b.low) - abs(a.low - b.p) + abs(a.low - b.low)) AS x
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL)
UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT), 1 FROM s WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {{top}}
UNION ALL SELECT lang, source, 'own', '', CAST(p AS BIGINT), count(*) FROM s GROUP BY ALL"""


@functools.lru_cache(maxsize=1)
def _duck():
    """The worker's own database, in memory: one thread, nothing on a local disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": ""})


def _ask(sql: str, part: pa.Table | pa.RecordBatchReader) -> pa.Table:
    duck = _duck()
    duck.register("part", part)
    try:
        found = duck.sql(sql).arrow()
        return found if isinstance(found, pa.Table) else found.read_all()
    finally:
        duck.unregister("part")


def _shaped(found: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from found.select(schema.names).cast(schema).to_batches(max_chunksize=1 << 16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        # parts of some 16 MB, or one text
        for at, to, _, _ in text_slices(batch.column("text"), 1 << 24):
            part = pa.Table.from_batches([batch.slice(at, to - at)]).append_column("row", pa.array(range(to - at), pa.int64()))
            yield from _shaped(_ask(_COUNT, part), schema)


def _in_shard(sql: str, schema: pa.Schema):
    """A grouped function that runs ``sql`` over the batches of a shard, as they come."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def all_of() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        found = _ask(sql, pa.RecordBatchReader.from_batches(first.schema, all_of()))
        if "shard" in schema.names:
            found = found.append_column("shard", pa.array([key[0].as_py()] * found.num_rows, pa.int64()))
        yield from _shaped(found, schema)

    return run


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 30, top: int = 50, docs_per_shard: int = 2048) -> DataFrame:
    r"""How far the sources of each language are from each other, and the terms that set each apart.

    Rows: lang, source, part, item, value, rank. Terms are matches of
    ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z lower-cased; a language keeps
    those in at least ``min_docs`` of its documents. A source's share of a term is
    p = 1 + floor(10**9 (count + 5) / (N + 5 V)), with V kept terms and N
    occurrences of them. Part ``pair`` ranks the other sources of the language
    by the sum of |p - q| over all kept terms, q the other's share; part
    ``term`` the ``top`` terms of the source by p - q > 0, q the language's.
    Ranks go by value, descending, then item by its bytes. All numbers are exact.

    Nulls in any of the columns count as ''. Each row is a document, also
    where rows repeat. A group without kept terms has pairs all the same; of
    a language without kept terms all are 0. Other columns are ignored. An
    empty table gives no rows.

    Shards are as many as the documents ask for, so that one stays some
    megabytes; counts are summed before they are shuffled. The result of part
    ``pair`` is all pairs of sources of a language, as asked, and a shard
    holds one sum for each at most.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    own = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    shards = max(1, -(-own.count() // docs_per_shard))
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards))

    kept_schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("first", pa.bool_())])
    counted = own.mapInArrow(_count, "lang string, source string, term string, docs long, n long")
    kept = scratch.keep(counted.groupBy(shard.alias("shard")).applyInArrow(_in_shard(_KEEP.format(min_docs=int(min_docs)), kept_schema), "shard long, lang string, source string, term string, n long, first boolean"))

    # every group, its occurrences, its language's, and the share of a term that it lacks
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("v"))
    groups = own.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["total", "v"])
    in_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("v").alias("lang_v"))
    low = F.when(F.col("lang_v") > 0, F.expr(f"1 + {PARTS * PRIOR} div (total + {PRIOR} * lang_v)")).otherwise(F.lit(0).cast("long"))
    groups = scratch.keep(groups.drop("v").join(in_lang, "lang").select("lang", "source", "total", "lang_total", F.col("lang_v").alias("v"), low.alias("low")))

    part_schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("times", pa.int64())])
    told = kept.join(groups.drop("low"), ["lang", "source"]).groupBy("shard").applyInArrow(_in_shard(_PAIRS.format(top=int(top)), part_schema), "lang string, source string, part string, item string, value long, times long")
    parts = scratch.keep(told)

    other = groups.select("lang", F.col("source").alias("item"), F.col("low").alias("other_low"))
    mine = groups.select("lang", "source", "low", "v")
    floors = mine.join(other, "lang").filter("source <> item").select("lang", "source", "item", (F.col("v") * F.abs(F.col("low") - F.col("other_low"))).alias("value"))
    own_terms = parts.filter("part = 'own'").groupBy("lang", "source", F.col("value").alias("p")).agg(F.sum("times").alias("times"))
    change = F.sum(F.col("times") * (F.abs(F.col("p") - F.col("other_low")) - F.abs(F.col("low") - F.col("other_low"))))
    alone = own_terms.join(mine, ["lang", "source"]).join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(change.alias("value"))
    halves = alone.unionByName(parts.filter("part = 'both'").select("lang", "source", "item", "value"))
    mirrored = halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = floors.unionByName(halves).unionByName(mirrored).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(parts.filter("part = 'term'"), "term").filter(F.col("rank") <= top))

