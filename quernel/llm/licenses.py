r"""License scans by diagonal voting.

Every word k-gram of a text is joined by hash to the positions that it has
in the license templates. A hit votes for the diagonal (position in the text
minus position in the template); neighbouring diagonals are merged, so that
a few inserted or missing words do not split a copy. The span is then
verified: its hits must be most of the template's k-grams, stand in a stretch
not much longer than the template, and hold the words that tell it from its
relatives. Where verified spans of several
labels overlap, the one that covers most words stays.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.llm.notices import templates as all_templates
from quernel.llm.scratch import Scratch
from quernel.llm.text import boxed, unboxed

#: Everything that is no word of a license text: ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP_CHARS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

# Phrases and labels of the base scan.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

def license_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def template_grams(templates: list[tuple[str, str, str]], k: int) -> list[tuple[int, str, int, int, int, int, list[str]]]:
    """(template, label, position, words of the template, first and last position of the grams it requires, gram), from the fixed list."""
    split = lambda text: [w for w in re.split(GAP, text.lower()) if w]
    out = []
    for t, (label, body, required) in enumerate(templates):
        ws, need = split(body), split(required)
        if len(need) < k:
            raise ValueError(f"a template needs {k} required words or more: {required!r}")
        at = next(i for i in range(len(ws)) if ws[i : i + len(need)] == need)
        for p in range(len(ws) - k + 1):
            out.append((t, label, p, len(ws), at, at + len(need) - k, ws[p : p + k]))
    return out


def base_scan(ws: Column) -> Column:
    """(label, start) of every place where a phrase's words stand, of an array of lower-case words."""

    def at(i: Column, phrase: tuple[str, ...]) -> Column:
        test = F.lit(True)
        for j, word in enumerate(phrase):
            test = test & (F.coalesce(F.get(ws, i + j), F.lit("")) == word)
        return test

    def label(i: Column) -> Column:
        found = None
        for phrase, name in PHRASES.items():
            found = F.when(at(i, phrase), F.lit(name)) if found is None else found.when(at(i, phrase), F.lit(name))
        return found

    places = F.transform(ws, lambda w, i: F.when(w.isin(*[p[0] for p in PHRASES]), F.struct(label(i).alias("label"), i.cast("long").alias("start"))))
    return F.filter(places, lambda x: x.isNotNull() & x.getField("label").isNotNull())


def scan_licenses(docs: DataFrame, text: str = "text", templates: list[tuple[str, str, str]] | None = None, k: int = 3, slack: int = 4, min_share: float = 0.6, scratch: Scratch | None = None) -> DataFrame:
    """The documents with n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    ``spans`` holds (label, start, end, share) of the verified copies of
    templates: words from 0, ``end`` excluded, ``share`` of the template's
    k-grams that hits found. A span is verified if that is ``min_share`` or
    more, if it is at most half as long again as the template and ``slack``
    words, and if it holds all k-grams of the template's required words. Of
    overlapping spans with different labels the one with most covered words
    stays; among equals the larger share, then the smaller label.

    ``score`` is the largest share, or 1 where a base phrase stands. Null and
    empty texts have no words, no places and score 0. Rows are never merged,
    so repeated rows get equal results; results replace columns of the same
    names. Very long texts are one row each, whose grams stay in it but for
    those that hit. An empty table gives an empty result.

    The templates are the caller's fixed list, so their grams are a local
    table of proven size, which is broadcast; the texts' grams are never
    shuffled, only hits are. A span's votes stay per text and template.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "licenses")
    grams = template_grams(all_templates() if templates is None else templates, k)
    table = spark.createDataFrame(grams, "t int, label string, t_pos int, t_words int, need_lo int, need_hi int, gram array<string>")
    table = table.withColumn("h", F.xxhash64(*[F.xxhash64(F.get("gram", i)) for i in range(k)])).drop("gram")
    base = (
        boxed(docs, text=text)
        .withColumn("uid", F.monotonically_increasing_id())
        .withColumn("ws", license_words(F.coalesce("text", F.lit(""))))
        .withColumn("words_lower", F.transform("ws", lambda w: F.lower(w)))
    )
    # Only words of a phrase can start a place; a text without "license" has none, and is not searched word by word.
    places = F.when(F.contains(F.lower("text"), F.lit("license")), base_scan(F.col("words_lower"))).otherwise(F.array().cast("array<struct<label:string,start:bigint>>"))
    row = F.col("row").dropFields(text) if len(docs.columns) > 1 else F.lit(None).cast("struct<none:int>")
    # A gram whose first word begins no template gram has nothing to join; a hash-set test on the word spares its hash.
    first_words = sorted({g[-1][0] for g in grams})
    starts = F.filter(F.transform("words_lower", lambda w, i: F.when(w.isin(first_words), i)), lambda i: i.isNotNull() & (i + k <= F.size("words_lower")))
    kept = scratch.keep(
        base.select(
            "uid",
            row.alias("row"),
            F.size("ws").cast("long").alias("n_words"),
            F.coalesce(places, F.array().cast("array<struct<label:string,start:bigint>>")).alias("places"),
            F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.xxhash64(F.get("words_lower", i + j)) for j in range(k)]).alias("h"))).alias("grams"),
        )
    )
    hits = kept.select("uid", F.explode("grams").alias("g")).select("uid", F.col("g.pos").alias("pos"), F.col("g.h").alias("h")).join(F.broadcast(table), "h")
    of = ["uid", "t", "label", "t_words", "need_lo", "need_hi"]
    votes = hits.groupBy(*of, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("t_at"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    # Neighbouring diagonals: a new span begins where the step to the next diagonal exceeds the slack.
    along = W.partitionBy("uid", "t").orderBy("diagonal")
    covered = F.size(F.array_distinct(F.flatten(F.transform("found", lambda p: F.sequence(p, p + (k - 1))))))
    merged = (
        votes.withColumn("opens", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > slack).cast("int"), F.lit(1)))
        .withColumn("span", F.sum("opens").over(along.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*of, "span")
        .agg(F.min("lo").alias("lo"), (F.max("hi") + k).alias("end"), F.array_distinct(F.flatten(F.collect_list("t_at"))).alias("found"))
        .withColumn("covered", covered)
        .withColumn("share", F.size("found") / (F.col("t_words") - (k - 1)))
        .filter(F.col("share") >= min_share)
        .filter(2 * (F.col("end") - F.col("lo")) <= 3 * F.col("t_words") + 2 * slack)
        .filter(F.size(F.filter("found", lambda p: p.between(F.col("need_lo"), F.col("need_hi")))) == F.col("need_hi") - F.col("need_lo") + 1)
    )
    found = F.struct(F.col("lo").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label", "share", "covered")

    def beaten(x: Column, y: Column) -> Column:
        """Whether span y, of another label, overlaps x and is better."""
        rank = lambda s: F.struct(-s.getField("covered"), -s.getField("share"), s.getField("label"))
        return (x.getField("label") != y.getField("label")) & (x.getField("start") < y.getField("end")) & (y.getField("start") < x.getField("end")) & (rank(y) < rank(x))

    spans = merged.groupBy("uid").agg(F.array_sort(F.collect_list(found)).alias("all")).withColumn("spans", F.filter("all", lambda x: ~F.exists("all", lambda y: beaten(x, y)))).select("uid", F.transform("spans", lambda s: s.dropFields("covered")).alias("spans"))
    judged = kept.join(spans, "uid", "left")

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base_labels = F.transform("places", lambda p: p.getField("label"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string,share:double>>")
    own = F.coalesce("spans", none)
    start = F.transform("places", lambda p: p.getField("start"))
    return unboxed(
        judged,
        [c for c in docs.columns if c != text],
        n_words=F.col("n_words"),
        n_base=F.size("places").cast("long"),
        first_word=F.array_min(start),
        last_word=F.array_max(start),
        base_labels=joined(base_labels),
        labels=joined(F.concat(base_labels, F.transform(own, lambda s: s.getField("label")))),
        score=F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform(own, lambda s: s.getField("share"))), F.lit(0.0))),
        spans=own,
    )
