"""Near-duplicate documents by b-bit MinHash.

1. Each document becomes its set of word shingles, hashed, of which 128
   minima are taken. Minima are used twice: whole, to make band keys, and as
   their low b bits, packed into longs, which is all that is kept of them.
2. Documents with equal sets are one class, represented by its smallest
   doc_id. Only representatives go on, so copies are never compared.
3. Representatives that share a band key are candidates. Those whose sizes
   or whose similarity, estimated from equal bits and corrected for chance
   collisions, are far below the threshold are passed over.
4. First pass: each member of a band is compared on full sets with the band's
   smallest representative, its centre, which links most groups at the cost
   of their size.
5. Second pass, for bands that still hold several components. A member x is
   written as its difference from the centre, D(x); two members differ by
   |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles. So either they are so near to
   the centre that they must be linked, which the one nearest to it shows for
   all of them, or they share a known number of elements of their
   differences. A prefix filter joins on these elements, the rarest first:
   no pair is made that shares none of its rare ones, however many members a
   band has. The pairs that come out are estimated from their bits, and
   confirmed on full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm import tokens
from quernel.llm.components import components
from quernel.llm.scratch import Scratch
from quernel.llm.text import boxed, unboxed

MINIMA = 128
BITS = 2
#: Members that are compared with one copy of their centre.
BLOCK = 512
#: Bands are exchanged in so many rounds, so that a part of the keys is on disk at a time.
ROUNDS = 2
_U = np.uint64
_SEEDS = np.random.default_rng(77)
_A = _SEEDS.integers(0, 2**63, MINIMA, dtype=_U) * _U(2) + _U(1)
_B = _SEEDS.integers(0, 2**63, MINIMA, dtype=_U)


def band_rows(threshold: float, miss: float = 1e-6) -> int:
    """The most rows per band at which a pair at the threshold shares no band with probability ``miss`` at most."""
    return max(r for r in range(1, 17) if (1 - threshold**r) ** (MINIMA // r) <= miss or r == 1)


def _signatures(minima: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands) and packed low bits (texts x BITS * MINIMA / 64) of minima (MINIMA x texts)."""
    bands = MINIMA // rows
    keys = np.empty((minima.shape[1], bands), _U)
    for j in range(bands):
        h = np.full(minima.shape[1], j, _U)
        for row in minima[j * rows : (j + 1) * rows]:
            h = tokens.mix(h * _U(0x9FB21C651E98DF25) + row)
        keys[:, j] = h
    low = tokens.mix(minima)
    planes = [np.packbits(((low >> _U(b)) & _U(1)).astype(np.uint8).T, axis=1) for b in range(BITS)]
    return keys.view(np.int64), np.concatenate(planes, axis=1).copy().view(np.int64)


def _sketch(k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tokens.text_slices(batch.column("text")):
                sh, first = tokens.shingles_of(tokens.words_of(data, offsets), k)
                sizes, marks = np.zeros(hi - lo, np.int64), np.zeros((hi - lo, 2), np.int64)
                for i in np.flatnonzero(np.diff(first)):
                    own = np.unique(sh[first[i] : first[i + 1]])
                    sizes[i] = len(own)
                    marks[i] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                some = np.flatnonzero(np.diff(first))
                minima = np.empty((MINIMA, len(some)), _U)
                for m in range(MINIMA if len(some) else 0):
                    minima[m] = np.minimum.reduceat(sh * _A[m] + _B[m], first[some])
                keys, planes = _signatures(minima, rows)
                place = np.zeros(hi - lo, np.int64) - 1
                place[some] = np.arange(len(some))
                null = place < 0

                def lists(x: np.ndarray) -> pa.Array:
                    at = np.concatenate([[0], np.cumsum(~null) * x.shape[1]]).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))

                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("version").slice(lo, hi - lo), pa.array(sizes), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), lists(keys), lists(planes)],
                    ["doc_id", "version", "n", "s1", "s2", "bands", "planes"],
                )

    return run


def _against(k: int, differences: bool):
    """Compare members with their centre.

    Rows come sorted by (a, block, role), so each centre (role 0) is read
    before its members (role 1), which are compared one after another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, _U)
        for batch in batches:
            role = batch.column("role").to_numpy()
            for lo, hi, data, offsets in tokens.text_slices(batch.column("text")):
                sh, first = tokens.shingles_of(tokens.words_of(data, offsets), k)
                at, size, both, diff = [], [], [], []
                for i in range(hi - lo):
                    own = np.unique(sh[first[i] : first[i + 1]])
                    if role[lo + i] == 0:
                        centre = own
                        continue
                    common = len(np.intersect1d(centre, own, assume_unique=True))
                    at.append(lo + i)
                    size.append((len(centre), len(own)))
                    both.append(common)
                    if differences:
                        diff.append(np.setxor1d(centre, own, assume_unique=True).view(np.int64))
                sizes = np.array(size, np.int64).reshape(-1, 2)
                part = batch.take(pa.array(at, pa.int64())).select(["a", "a_tag", "b", "b_tag"])
                cut = np.concatenate([[0], np.cumsum([len(x) for x in diff])]).astype(np.int32) if differences else np.zeros(len(at) + 1, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(diff) if diff else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes[:, 0].copy()), pa.array(sizes[:, 1].copy()), pa.array(np.array(both, np.int64)), lists], ["a", "a_tag", "b", "b_tag", "a_n", "b_n", "both", "diff"])

    return run


def similarity(x: str, y: str) -> Column:
    """The collision-corrected estimate from the packed bits of two rows: of unequal slots a share of 2**-BITS would agree by chance."""
    words = MINIMA // 64

    def slot_differs(w: int) -> Column:
        parts = [F.col(f"{x}.planes")[b * words + w].bitwiseXOR(F.col(f"{y}.planes")[b * words + w]) for b in range(BITS)]
        out = parts[0]
        for p in parts[1:]:
            out = out.bitwiseOR(p)
        return F.bit_count(out)

    differ = slot_differs(0)
    for w in range(1, words):
        differ = differ + slot_differs(w)
    chance = 2.0**-BITS
    return (1.0 - differ / float(MINIMA) - chance) / (1.0 - chance)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, per_cent: int = 80, scratch: Scratch | None = None, further: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= per_cent * |union| of
    their sets of k-word shingles (A-Z lower-cased, words split at blanks;
    fewer than k words make one shingle; no words, an empty set). Components
    of links are groups; ``component_id`` is a group's smallest doc_id and
    ``kept`` marks its row. Null and empty texts are linked with nothing, as
    are rows with a null doc_id, whose component_id is null and which are
    kept. Equal texts are always in one group. Rows that share a doc_id are
    all returned and are one node of the graph, which has the links of all
    their texts. Ids may be of any type that has an order. Very long texts
    are read whole, one at a time. Other columns are ignored. An empty table
    gives an empty result.

    ``further`` holds other texts of the same documents, (doc_id, text): a
    document has the links of all its texts, and a row for each of these as
    well. Rows whose doc_id ``docs`` has not, or has with this text alone,
    are passed over.

    The result is a written table; tables on the way to it go as soon as
    nothing reads them any more.
    """
    spark = docs.sparkSession
    result, scratch = scratch or Scratch(spark, "near-dup"), Scratch(spark, "near-dup")
    threshold = per_cent / 100
    rows = band_rows(threshold)
    # A pair at the threshold falls below this estimate with odds under 1e-9: 6.1 standard deviations.
    agree = threshold + (1 - threshold) * 2.0**-BITS
    least = threshold - 6.1 * math.sqrt(agree * (1 - agree) / MINIMA) / (1 - 2.0**-BITS)
    up, down = 100 + per_cent, 100 - per_cent

    def versions(df: DataFrame, doc_id: Column, text: Column) -> DataFrame:
        return df.select(doc_id.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))

    def sketched(df: DataFrame) -> DataFrame:
        return df.mapInArrow(_sketch(k, rows), f"doc_id {kind}, version long, n long, s1 long, s2 long, bands array<long>, planes array<long>")

    sources = [versions(docs, F.col(f"`{doc_id}`"), F.col(f"`{text}`"))]
    kind = sources[0].schema["doc_id"].dataType.simpleString()
    sketch = sketched(sources[0])
    if further is not None:
        sources.append(versions(further, F.col("doc_id").cast(kind), F.col("text")))
        # Sketches are exchanged, not texts, which are several times as large.
        now, old = sources[0].select(F.col("doc_id").alias("now_id"), F.col("version").alias("now")), sketched(sources[1])
        sketch = sketch.unionByName(old.join(now, (old.doc_id == now.now_id) & (old.version != now.now), "left_semi"))
    sketch = scratch.keep(sketch)
    live = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    first_row = F.min(F.struct("doc_id", "version"))
    # A doc_id may stand for several classes, if its rows have several texts; (rep, tag) is one of these.
    classes = live.groupBy("s1", "s2").agg(first_row.alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("planes").alias("planes"))
    classes = scratch.keep(classes.select("s1", "s2", F.col("r.doc_id").alias("rep"), F.col("r.version").alias("tag"), "n", "bands", "planes"))
    full, sketch = sketch, scratch.keep(sketch.select("doc_id", "n", "s1", "s2"))
    scratch.drop(full)
    live = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    # Bands of two or more; the rows carry ids alone, as most bands have one member and go no further.
    members, step = [], -(-(MINIMA // rows) // ROUNDS)
    for lo in range(1, MINIMA // rows + 1, step):
        each = classes.select(F.explode(F.slice("bands", lo, step)).alias("key"), "rep", "tag")
        band = each.groupBy("key").agg(F.min("rep").alias("c_rep"), F.count("*").alias("size")).filter("size > 1")
        members.append(scratch.keep(each.join(band, "key")))
    member = reduce(DataFrame.unionByName, members)
    full, classes = classes, scratch.keep(classes.drop("bands"))
    scratch.drop(full)
    of_a = classes.select(F.col("rep").alias("a"), F.col("tag").alias("a_tag"), "n", "planes").alias("x")
    of_b = classes.select(F.col("rep").alias("b"), F.col("tag").alias("b_tag"), "n", "planes").alias("y")

    def close(x: str, y: str) -> Column:
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        return (F.least(n, m) * 100 >= F.greatest(n, m) * per_cent) & (similarity(x, y) >= least)

    def candidates(pairs: DataFrame) -> DataFrame:
        """The pairs (a, a_tag, b, b_tag) whose sizes and bits allow a link."""
        return pairs.join(of_a, ["a", "a_tag"]).join(of_b, ["b", "b_tag"]).filter(close("x", "y")).select("a", "a_tag", "b", "b_tag")

    def compared(pairs: DataFrame, differences: bool = False) -> DataFrame:
        """(a, a_tag, b, b_tag, a_n, b_n, both, diff) of pairs with a centre a, on full sets.

        A centre's members are dealt to blocks, each with one copy of the
        centre's text; a block is read as a stream, so neither a large group
        nor a long text gathers in one task.
        """
        blocks = pairs.groupBy("a", "a_tag").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        dealt = pairs.join(blocks, ["a", "a_tag"]).select("a", "a_tag", "b", "b_tag", F.pmod(F.xxhash64("b", "b_tag"), "blocks").alias("block"))
        centres = dealt.select("a", "a_tag", "block").distinct().select("a", "a_tag", F.lit(None).cast(kind).alias("b"), F.lit(None).cast("long").alias("b_tag"), "block", F.lit(0).alias("role"), F.col("a").alias("want"), F.col("a_tag").alias("w_tag"))
        wanted = scratch.keep(dealt.select("*", F.lit(1).alias("role"), F.col("b").alias("want"), F.col("b_tag").alias("w_tag")).unionByName(centres))
        full = wanted.join(texts, (wanted.want == texts.doc_id) & (wanted.w_tag == texts.version)).select("a", "a_tag", "b", "b_tag", "block", "role", "text")
        dense = full.repartition("a", "a_tag", "block").sortWithinPartitions("a", "a_tag", "block", "role")
        out = scratch.keep(dense.mapInArrow(_against(k, differences), f"a {kind}, a_tag long, b {kind}, b_tag long, a_n long, b_n long, both long, diff array<long>"))
        scratch.drop(wanted)
        return out

    def links(found: DataFrame) -> DataFrame:
        return found.filter(100 * F.col("both") >= per_cent * (F.col("a_n") + F.col("b_n") - F.col("both"))).select(F.col("a").alias("u"), F.col("b").alias("v"))

    # First pass: members with the smallest representative of their band.
    centre = member.filter("rep = c_rep").select("key", F.col("rep").alias("a"), F.col("tag").alias("a_tag"))
    stars = member.filter("rep <> c_rep").join(centre, "key").select("a", "a_tag", F.col("rep").alias("b"), F.col("tag").alias("b_tag")).distinct()
    stars = scratch.keep(candidates(stars))
    # The texts of all that either pass may compare are looked up once.
    ids = stars.select(F.col("a").alias("want"), F.col("a_tag").alias("w_tag")).union(stars.select("b", "b_tag")).union(member.filter("size > 2").select("rep", "tag")).distinct()
    looked_up = []
    for source in sources:
        ids = scratch.keep(ids)
        found = scratch.keep(source.join(ids, (source.doc_id == ids.want) & (source.version == ids.w_tag), "left_semi").dropDuplicates(["doc_id", "version"]))
        looked_up.append(found)
        ids = ids.join(found.select("doc_id", "version"), (ids.want == F.col("doc_id")) & (ids.w_tag == F.col("version")), "left_anti")
    texts = reduce(DataFrame.unionByName, looked_up)
    first = compared(stars)
    edges = links(first)
    # Rows that share a doc_id join their classes.
    placed = live.select("doc_id", "s1", "s2").join(classes.select("s1", "s2", "rep"), ["s1", "s2"])
    several = placed.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("u"), F.count_distinct("rep").alias("n")).filter("n > 1").select("doc_id")
    shared = placed.join(several, "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    edges = scratch.keep(edges.union(shared.filter("u <> v")).distinct())
    scratch.drop(first, stars)
    found = components(edges, scratch)
    scratch.drop(edges)

    # Second pass: bands of three or more that hold several components.
    component = found.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    comps = lambda name, out: component.select(F.col("rep").alias(name), F.col("comp").alias(out))
    placed = member.filter("size > 2").join(comps("rep", "r_comp"), "rep", "left").join(comps("c_rep", "c_comp"), "c_rep", "left")
    placed = placed.select("key", "rep", "tag", "c_rep", F.coalesce("r_comp", "rep").alias("comp"), F.coalesce("c_comp", "c_rep").alias("main"))
    mates = placed.filter("rep <> c_rep").join(centre, "key")
    odd_keys = mates.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("comp") != F.col("main")).alias("odd")).filter("odd AND n > 1").select("key")
    mates = scratch.keep(mates.join(odd_keys, "key", "left_semi").select("a", "a_tag", F.col("rep").alias("b"), F.col("tag").alias("b_tag"), "comp", "main").distinct())
    scratch.drop(*members)
    if not mates.isEmpty():
        more = scratch.keep(links(compared(_second_candidates(compared(mates.select("a", "a_tag", "b", "b_tag"), True), mates, candidates, up, down, scratch))))
        if not more.isEmpty():
            # stars of the first pass stand for its links
            found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more), scratch)

    groups = classes.join(found, classes.rep == found.node, "left").select(F.col("s1").alias("g1"), F.col("s2").alias("g2"), F.coalesce("component", "rep").alias("component"))
    out = sketch.join(groups, (F.col("s1") == F.col("g1")) & (F.col("s2") == F.col("g2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    out = result.keep(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")))
    scratch.clear()
    return out


def _second_candidates(against: DataFrame, mates: DataFrame, candidates: Callable[[DataFrame], DataFrame], up: int, down: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, a_tag, b, b_tag) of members of one centre, of different components, that may be linked.

    With S(x) = up * |D(x)| - down * |x|, up and down being 100 plus and
    minus the threshold, x and y are linked exactly if
    S(x) + S(y) <= 2 * up * |D(x) & D(y)|. Where S(x) + S(y) <= 0 they are,
    and so is each with the member of the smallest S. Otherwise they share
    at least (S(x) + S(y)) / (2 * up) elements. Elements that only one
    member has are left out first; a member that then has too few left for
    its easiest partner is out, and of all others those elements count that
    a partner cannot miss all of. ``against`` is removed once it is read.
    """
    group, me = ["a", "a_tag"], ["b", "b_tag"]
    rows = against.join(mates, [*group, *me]).select(*group, *me, "diff", "comp", (F.col("comp") != F.col("main")).alias("odd"), (F.size("diff") * F.lit(up) - F.col("b_n") * down).cast("long").alias("s"))
    rows = scratch.keep(rows)
    scratch.drop(against)
    bounds = rows.groupBy(*group).agg(F.min("s").alias("s_all"), F.min(F.when(F.col("odd"), F.col("s"))).alias("s_odd"), F.min_by(F.struct(*me, "comp", "s"), F.struct("s", *me)).alias("near"))
    bounds = scratch.keep(bounds)
    # near the centre: all with the nearest one
    near = rows.join(bounds.select(*group, "near"), group).filter((F.col("s") + F.col("near.s") <= 0) & (F.col("comp") != F.col("near.comp")))
    near = near.select(F.col("near.b").alias("a"), F.col("near.b_tag").alias("a_tag"), "b", "b_tag")

    each = rows.select(*group, *me, F.explode("diff").alias("e"))
    held = each.groupBy(*group, "e").agg(F.count("*").alias("df")).filter("df > 1")
    listed = each.join(held, [*group, "e"]).groupBy(*group, *me).agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("es"))
    of = rows.drop("diff").join(listed, [*group, *me]).join(bounds.drop("near"), group)

    def share(s: Column, other: Column) -> Column:
        """Elements that a partner of this S shares at least, if the pair is not near the centre."""
        return F.greatest(F.lit(1), F.ceil((s + other) / F.lit(2 * up)))

    size = F.size("es")
    prefix_odd, prefix_all = size - share(F.col("s"), F.col("s_odd")) + 1, size - share(F.col("s"), F.col("s_all")) + 1
    longest = F.when(F.col("odd"), F.greatest(prefix_odd, prefix_all)).otherwise(prefix_odd)
    entries = of.withColumn("prefix_odd", prefix_odd).withColumn("prefix", longest).filter("prefix > 0 AND s_odd IS NOT NULL")
    entries = entries.select(*group, *me, "comp", "odd", "s", size.alias("f"), "prefix_odd", F.posexplode(F.slice("es", F.lit(1), F.col("prefix").cast("int"))).alias("pos", "x"))
    entries = scratch.keep(entries.select(*group, *me, "comp", "odd", "s", "f", "pos", (F.col("pos") < F.col("prefix_odd")).alias("tight"), F.col("x.e").alias("e")))

    def joined(left: DataFrame, right: DataFrame, once: bool) -> DataFrame:
        x, y = left.alias("x"), right.alias("y")
        same = (F.col("x.a") == F.col("y.a")) & (F.col("x.a_tag") == F.col("y.a_tag")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.comp") != F.col("y.comp"))
        if once:
            same = same & (F.col("x.b") < F.col("y.b"))
        # from the first element that they share on, either has so many left at most
        left_over = F.least(F.col("x.f") - F.col("x.pos"), F.col("y.f") - F.col("y.pos"))
        total = F.col("x.s") + F.col("y.s")
        pairs = x.join(y, same & (total > 0) & (left_over * (2 * up) >= total))
        return pairs.select(F.col("x.b").alias("a"), F.col("x.b_tag").alias("a_tag"), F.col("y.b").alias("b"), F.col("y.b_tag").alias("b_tag"))

    odd = entries.filter("odd")
    pairs = joined(odd.filter("tight"), odd.filter("tight"), True).union(joined(odd, entries.filter("NOT odd AND tight"), False)).distinct()
    out = scratch.keep(near.union(candidates(pairs)).distinct())
    scratch.drop(rows, bounds, entries)
    return out


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, per_cent: int = 80, further: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The documents without the near-duplicates of a smaller doc_id; rows with a null doc_id stay.

    ``further`` holds texts of documents, (doc_id, text), as they were before
    an earlier step cut or dropped them: a document has the links of all its
    texts, those that ``docs`` does not have count for nothing.
    """
    dropped = near_duplicates(docs, doc_id, text, k=k, per_cent=per_cent, scratch=scratch, further=further).filter(~F.col("kept")).select(F.col("doc_id").alias("dropped_id")).distinct()
    rows = boxed(docs, doc_id=doc_id)
    return unboxed(rows.join(dropped, rows.doc_id == dropped.dropped_id, "left_anti"), docs.columns)
