"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become sequences of canonical words: numbers,
units and names are replaced by typed placeholders, all else is lower-cased.
Windows of canonical words are hash-joined; matches along one diagonal (place
in the text minus place in the item) are one occurrence. Its placeholders
must be filled consistently: each value of the item stands for the value of
the text that most of its windows give it, and windows that say otherwise do
not count. So verbatim copies match, and so do questions whose numbers, names
and units were exchanged throughout. Which words are names depends on their
case, and a window of placeholders alone would match anything; windows of the
plain lower-cased words are joined too, so that verbatim copies match in any
case and whatever they consist of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.llm.licenses import license_words
from quernel.llm.scratch import Scratch
from quernel.llm.text import bound, boxed, unboxed

# Units that a re-parameterised question may exchange.
UNITS = [
    "mm", "cm", "m", "km", "mile", "miles", "inch", "inches", "foot", "feet", "yard", "yards", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces",
    "ml", "l", "litre", "litres", "liter", "liters", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "kmh", "mph", "degrees", "watt", "watts", "volt", "volts", "joule", "joules", "newton", "newtons",
]
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
#: Benchmark windows are broadcast up to this many bytes; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def canonical(word: Column) -> Column:
    """A word's placeholder or lower-case form; words start with neither blanks nor ASCII punctuation."""
    low = F.lower(word)
    return (
        F.when(word < ":", NUMBER)
        .when((word < "[") | (word > "{"), F.when(word.rlike(r"^\p{Lu}\p{Ll}"), F.when(low.isin(UNITS), UNIT).otherwise(NAME)).otherwise(low))
        .when(low.isin(UNITS), UNIT)
        .otherwise(low)
    )


def window_hashes(words: Column, size: int) -> Column:
    """A hash of each window of ``size`` words: words are hashed once, windows from the hashes of their halves."""

    def join(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda a, b: F.xxhash64(a, b))

    def powers(h: Column, step: int) -> Column:
        if step * 2 <= size:
            return bound(join(h, F.slice(h, step + 1, F.size(h))), lambda x: powers(x, step * 2))
        return h

    def odd(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - size + 1), lambda i: F.xxhash64(F.slice(h, i, size)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    of = bound(hashed, (lambda h: F.slice(powers(h, 1), 1, F.size(words) - size + 1)) if size & (size - 1) == 0 else odd)
    return F.when(F.size(words) >= size, of).otherwise(F.array().cast("array<bigint>"))


def _lowered(plain: str) -> Column:
    return F.transform(plain, lambda w: F.lower(w))


def _slots(canon: str, plain: str, start: Column, size: int) -> Column:
    """The placeholders' values of one window, in order."""
    pairs = F.arrays_zip(F.slice(canon, start, size).alias("c"), F.slice(plain, start, size).alias("p"))
    return F.transform(F.filter(pairs, lambda x: F.substring(x.getField("c"), 1, 1) == "<"), lambda x: F.concat(F.substring(x.getField("c"), 1, 2), F.lower(x.getField("p"))))


def _rare_windows(item_windows: DataFrame, met: DataFrame, min_share: float, min_run: int) -> DataFrame:
    """The windows of each item without the most frequent places, as many as may be hit without the item being reported: item_id, of, size, h."""
    weight = item_windows.groupBy("h").agg(F.count("*").alias("items")).join(met.groupBy("h").agg(F.count("*").alias("docs")), "h", "left")
    heavy = item_windows.join(weight, "h").withColumn("weight", F.col("items") * F.coalesce("docs", F.lit(0)))
    item = ["item_id", "of", "size"]
    places = heavy.groupBy(*item, "at").agg(F.sum("weight").alias("weight"), F.collect_set("h").alias("hs"))
    # a thousandth off, so that rounding never asks for one place more
    needed = F.greatest(F.lit(1), F.least(F.ceil(F.col("of") * min_share - 0.001), F.lit(min_run) - F.col("size") + 1))
    order = W.partitionBy(*item).orderBy(F.desc("weight"), "at")
    rare = places.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") > needed - 1)
    return rare.select(*item, F.explode("hs").alias("h")).distinct()


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 8,
    min_item_words: int = 5,
    min_literals: int = 3,
    min_share: float = 0.5,
    min_run: int = 13,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per document and item that leaks into it: doc_id, item_id, share, run_words, verbatim.

    A window of an item counts if a window of the text has its lower-cased
    words, or its template with values that agree with those of most windows
    of the occurrence. Templates with under ``min_literals`` words that are
    no placeholders are not searched, nor is that of an item of one window,
    which would be found in whatever is phrased like it: for these only the
    words count. ``share`` is the share of the item's windows that count,
    ``run_words`` the words of the longest run of windows, one after another,
    that count, ``verbatim`` whether in the occurrence with most windows all
    have the item's own words. A pair is reported from ``min_share`` or
    ``min_run`` on. Items of ``min_item_words`` to ``window`` - 1 words are
    one window of their own length; shorter ones match nothing.

    Null and empty texts have no windows. Null ids are reported as null.
    Rows that share a doc_id are searched each, and reported as one; so are
    items that share an item_id. Very long texts are one row each; only
    windows that hit leave it. Other columns are ignored. Empty tables give
    an empty result.

    A first pass finds which windows of the benchmark each document has, by
    a join that moves none of the texts while the benchmark's windows are
    few enough to broadcast. A pair that is to be reported needs some number
    of the item's windows; of each item that many but one, the most frequent
    by documents and items, need not be asked for, since one of the others
    must be there too. So a window that many items and many documents share,
    a common opening, brings no pairs about. Only pairs with one of the rarer
    windows are then looked at closely, and only their documents read again.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontaminate")
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), license_words(F.coalesce(F.col(f"`{item_text}`"), F.lit(""))).alias("plain")).withColumn("canon", F.transform("plain", canonical)).filter(F.size("plain") >= min_item_words)
    n = F.size("plain")
    # one array of windows for each length that items have
    lengths = sorted(r.size for r in items.select(F.least(n, F.lit(window)).alias("size")).distinct().collect())

    def of_item(words: str) -> Column:
        out = F.array().cast("array<bigint>")
        for s in lengths:
            out = F.when(F.col("size") == s, window_hashes(F.col(words), s)).otherwise(out)
        return out

    placed = items.withColumn("size", F.least(n, F.lit(window))).withColumn("low", _lowered("plain")).withColumn("of", F.greatest(n - window + 1, F.lit(1)))
    placed = placed.select("item_id", "plain", "canon", "size", "of", F.posexplode(F.arrays_zip(of_item("canon").alias("t"), of_item("low").alias("l"))).alias("pos", "h")).withColumn("at", F.col("pos") + 1)
    literals = F.size(F.filter(F.slice("canon", F.col("at"), F.col("size")), lambda w: F.substring(w, 1, 1) != "<"))
    none = F.lit(None).cast("array<string>")
    template = F.when((literals >= min_literals) & (F.col("of") > 1), F.struct(F.col("h.t").alias("h"), _slots("canon", "plain", F.col("at"), F.col("size")).alias("item_slots")))
    literal = F.struct(F.col("h.l").alias("h"), none.alias("item_slots"))
    item_windows = scratch.keep(placed.select("item_id", "size", "at", "of", F.explode(F.array(literal, template)).alias("w")).filter("w IS NOT NULL").select("item_id", "size", "at", "of", "w.h", "w.item_slots"))
    told = item_windows.agg(F.sum(64 + F.coalesce(F.aggregate("item_slots", F.lit(0), lambda t, x: t + F.length(x) + 16), F.lit(0)))).head()
    sizes, few = lengths, (told[0] or 0) <= BROADCAST_BYTES

    def maybe_broadcast(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))

    def worded(df: DataFrame) -> DataFrame:
        return df.withColumn("plain", license_words(F.col("text"))).withColumn("canon", F.transform("plain", canonical)).withColumn("low", _lowered("plain"))

    every = F.concat(*[window_hashes(words, s) for s in sizes for words in (F.col("canon"), F.col("low"))]) if sizes else F.array().cast("array<bigint>")
    searched = maybe_broadcast(item_windows.select("h").distinct())
    met = scratch.keep(worded(own).select("doc_id", "uid", F.explode(every).alias("h")).join(searched, "h", "left_semi").distinct())
    pairs = scratch.keep(met.join(maybe_broadcast(_rare_windows(item_windows, met, min_share, min_run)), "h").select("doc_id", "uid", "item_id", "of", "size").distinct())
    wanted = pairs.select("doc_id", "uid").distinct()
    near = worded(own.alias("o").join(wanted.alias("t"), (F.col("o.uid") == F.col("t.uid")) & F.col("o.doc_id").eqNullSafe(F.col("t.doc_id")), "left_semi").select("o.uid", "o.doc_id", "o.text"))

    def windows(s: int) -> Column:
        templates = F.transform(window_hashes(F.col("canon"), s), lambda h, i: F.struct(h.alias("h"), (i + 1).alias("at"), _slots("canon", "plain", i + 1, s).alias("slots")))
        literals = F.transform(window_hashes(F.col("low"), s), lambda h, i: F.struct(h.alias("h"), (i + 1).alias("at"), F.lit(None).cast("array<string>").alias("slots")))
        return F.concat(templates, literals)

    places = F.concat(*[windows(s) for s in sizes]) if sizes else F.array().cast("array<struct<h:bigint,at:int,slots:array<string>>>")
    found = near.select("uid", "doc_id", F.explode(places).alias("w")).select("uid", "doc_id", F.col("w.h").alias("h"), F.col("w.at").alias("doc_at"), F.col("w.slots").alias("slots"))
    found = found.join(searched, "h", "left_semi")
    same_item = [F.col("p.item_id").eqNullSafe(F.col("w.item_id")), F.col("p.of") == F.col("w.of"), F.col("p.size") == F.col("w.size")]
    asked = pairs.alias("p").join(maybe_broadcast(item_windows).alias("w"), same_item).select("p.uid", F.col("p.doc_id").alias("own_id"), "w.*")
    found = found.join(asked, ["uid", "h"]).filter(F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("slots").isNull() == F.col("item_slots").isNull()))
    values = F.array_distinct(F.transform(F.arrays_zip("item_slots", "slots"), lambda x: F.struct(x.getField("item_slots").alias("i"), x.getField("slots").alias("d"))))
    key = ["uid", "doc_id", "item_id", "of", "size", "diagonal"]
    hits = scratch.keep(
        found.select("uid", "doc_id", "item_id", "of", "size", (F.col("doc_at") - F.col("at")).alias("diagonal"), "at", F.when(F.col("slots").isNotNull(), values).alias("pairs"))
        .distinct()
    )
    # what each value of the item stands for along a diagonal
    each = hits.select(*key, "at", F.explode("pairs").alias("p")).groupBy(*key, "p").agg(F.count_distinct("at").alias("n"))
    chosen = each.groupBy(*key, F.col("p.i").alias("i")).agg(F.max_by("p.d", F.struct("n", "p.d")).alias("d")).groupBy(*key).agg(F.collect_set(F.struct("i", "d")).alias("agreed"))
    counted = hits.alias("x").join(chosen.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in key], "left").select("x.*", "agreed")
    counted = counted.filter(F.col("pairs").isNull() | (F.size(F.array_except("pairs", F.coalesce("agreed", F.array().cast("array<struct<i:string,d:string>>")))) == 0))
    counted = counted.groupBy(*key, "at").agg(F.bool_or(F.col("pairs").isNull()).alias("same"))
    along = W.partitionBy(*key).orderBy("at")
    runs = counted.withColumn("run", F.col("at") - F.row_number().over(along))
    occurrences = runs.groupBy(*key, "run").agg(F.count("*").alias("n"), F.bool_and("same").alias("same"), F.collect_list("at").alias("at")).groupBy(*key).agg(F.max("n").alias("longest"), F.sum("n").alias("n"), F.bool_and("same").alias("verbatim"), F.flatten(F.collect_list("at")).alias("at"))
    return (
        occurrences.groupBy("uid", "doc_id", "item_id", "of")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"),
            F.max(F.col("longest") + F.col("size") - 1).alias("run_words"),
            F.max(F.struct("n", "verbatim")).getField("verbatim").alias("verbatim"),
        )
        .withColumn("share", F.col("n") / F.col("of"))
        .filter((F.col("share") >= min_share) | (F.col("run_words") >= min_run))
        .groupBy("doc_id", "item_id")
        .agg(F.max("share").alias("share"), F.max("run_words").cast("long").alias("run_words"), F.max("verbatim").alias("verbatim"))
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents without those that hold an item; rows with a null doc_id stay."""
    leaked = find_leaks(docs, benchmark, doc_id, text, **how).select(F.col("doc_id").alias("leaked_id")).distinct()
    rows = boxed(docs, doc_id=doc_id)
    return unboxed(rows.join(leaked, rows.doc_id == leaked.leaked_id, "left_anti"), docs.columns)
