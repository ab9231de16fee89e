r"""Quality rules: features of a document, and lines that are too frequent on its host."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.scratch import Scratch
from quernel.llm.text import ascii_lower, bound, boxed, lines, strip_blanks, unboxed, words

SYMBOLS = "[#*$%&|<>]"


#: Bits of a packed window that hold its place; texts with more words take the plain way.
PLACE_BITS = 24


def _spread(at: Column, n: int) -> Column:
    """Words that windows of ``n`` at these ascending places cover."""
    return F.aggregate(F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(n)), F.lit(n)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def _equal_neighbours(ordered: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The elements that equal the one before or after them."""
    return F.filter(ordered, lambda x, i: F.coalesce(same(x, F.get(ordered, i + 1)), F.lit(False)) | F.coalesce((i > 0) & same(x, F.get(ordered, F.greatest(i - 1, F.lit(0)))), F.lit(False)))


def repeated_words(ws: Column, n: int = 8) -> Column:
    """How many words stand in a window of ``n`` words (a power of 2) that occurs twice or more in the array.

    Windows are compared by 64-bit hashes, put together from hashes of their
    halves. A document without a repeated window, the usual case, costs a
    hash set. Others sort their windows, take those equal to a neighbour, and
    add up the words that these cover; nothing is quadratic. For the sort a
    window is one long, the upper bits of its hash above its place, and whole
    hashes decide which neighbours are equal.
    """

    def pair_up(step: int) -> Callable[[Column], Column]:
        return lambda x: F.zip_with(x, F.slice(x, step + 1, F.size(x)), lambda a, b: F.xxhash64(a, b))

    def hashes(words_: Column) -> Column:
        h, step = F.transform(words_, lambda w: F.xxhash64(w)), 1
        while step < n:
            h = bound(h, pair_up(step))
            step *= 2
        return F.slice(h, 1, F.size(words_) - (n - 1))

    def packed(hs: Column) -> Column:
        def whole(x: Column) -> Column:
            return F.get(hs, x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))

        def count(ordered: Column) -> Column:
            at = F.transform(_equal_neighbours(ordered, lambda a, b: whole(a) == whole(b)), lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
            return bound(F.sort_array(at), lambda p: _spread(p, n))

        def mixed(ordered: Column) -> Column:
            """Whether windows with equal upper bits differ, so that equal ones may be no neighbours."""
            return F.exists(F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.coalesce((F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)) & (whole(a) != whole(b)), F.lit(False))), lambda x: x)

        return bound(F.sort_array(F.transform(hs, lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long")))), lambda o: F.when(mixed(o), plain(hs)).otherwise(count(o)))

    def plain(hs: Column) -> Column:
        def count(ordered: Column) -> Column:
            at = F.transform(_equal_neighbours(ordered, lambda a, b: a.getField("h") == b.getField("h")), lambda x: x.getField("i").cast("long"))
            return bound(F.sort_array(at), lambda p: _spread(p, n))

        return bound(F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), count)

    def judged(hs: Column) -> Column:
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).when(F.size(hs) < 1 << PLACE_BITS, packed(hs)).otherwise(plain(hs))

    return F.when(F.size(ws) <= n, F.lit(0).cast("long")).otherwise(bound(hashes(ws), judged))


def score_quality(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_host_share: float = 0.1,
    min_host_docs: int = 20,
    min_left_words: int = 5,
    min_left_share: float = 0.2,
    scratch: Scratch | None = None,
) -> DataFrame:
    r"""The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left_words, depleted and kept.

    Base rules: fewer than 20 words, or more than 30 % of them in 8-word
    windows that the text repeats. Cross-document rule: a line (blanks
    stripped, A-Z lower-cased, with a word) is above the limit on a host if at
    least ``min_host_docs`` of the host's documents hold it and they are more
    than ``max_host_share`` of them; such lines count as removed, and a
    document is depleted if they leave under ``min_left_words`` words or
    under ``min_left_share`` of them. Both limits are shares or counts of the
    whole table.

    Null text has no words and fails. Null hosts are one host. Repeated rows
    are documents of their own. A very long text is one row, its windows an
    array of hashes. Results replace columns of the same names.
    An empty table gives an empty result.

    A document adds each distinct line once, so documents per line are a
    partially aggregated count, whatever the share of one host or line. The
    lines above the limit are joined back to the lines of their hosts by
    (host, hash).
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "quality")
    w = F.col("ws")
    ruled = (
        boxed(docs, text=text, host=host)
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("uid", F.monotonically_increasing_id())
        .withColumn("all_lines", lines(F.col("text")))
        # no word goes over a line's end, so the lines' words are the text's
        .withColumn("words_of", F.transform("all_lines", words))
        .withColumn("ws", F.flatten("words_of"))
        .withColumn("worded", F.filter(F.zip_with("all_lines", "words_of", lambda x, y: F.struct(x.alias("line"), F.size(y).cast("long").alias("n"))), lambda x: x.getField("n") > 0))
        .select(
            "uid",
            "host",
            "row",
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
            F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("worded") - F.size(F.array_distinct(F.transform("worded", lambda x: x.getField("line"))))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.transform("worded", lambda x: F.struct(F.xxhash64(ascii_lower(strip_blanks(x.getField("line")))).alias("h"), x.getField("n").alias("n"))).alias("line_words"),
        )
        # the text itself is not kept: the features and 16 bytes a line are
        .withColumn("row", F.col("row").dropFields(text) if len(docs.columns) > 1 else F.lit(None).cast("struct<none:int>"))
    )
    kept = scratch.keep(ruled)
    sizes = kept.groupBy("host").agg(F.count("*").alias("host_docs"))
    each = kept.select("uid", "host", F.explode("line_words").alias("x")).select("uid", "host", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    counts = kept.select("host", F.explode(F.array_distinct(F.transform("line_words", lambda x: x.getField("h")))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_host_docs)
    above = counts.join(sizes, counts.host.eqNullSafe(sizes.host)).filter(F.col("docs") > F.lit(max_host_share) * F.col("host_docs")).select(counts.host.alias("a_host"), F.col("h").alias("a_h"))
    removed = each.join(above, each.host.eqNullSafe(F.col("a_host")) & (each.h == F.col("a_h")), "left_semi").groupBy("uid").agg(F.sum("n").alias("removed"))
    judged = kept.join(removed, "uid", "left").withColumn("left", F.col("n_words") - F.coalesce("removed", F.lit(0)))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = (F.col("left") < min_left_words) | (F.col("left") < min_left_share * F.col("n_words"))
    columns = [c for c in docs.columns if c != text]
    return unboxed(
        judged,
        columns,
        n_words=F.col("n_words"),
        word_chars=F.col("word_chars"),
        n_symbols=F.col("n_symbols"),
        n_dup_lines=F.col("n_dup_lines"),
        n_repeat_words=F.col("n_repeat_words"),
        base_failed=base_failed,
        n_left_words=F.col("left"),
        depleted=depleted,
        kept=~base_failed & ~depleted,
    )
