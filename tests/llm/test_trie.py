"""The prefix trie against one built node by node."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from quernel.llm import trie


def head():
    return {"head": F.crc32(F.col("c").cast("string").cast("binary")) % 9, "base": F.col("c") - F.col("c") % 5, "longest_head": 8}


def brute(rows, heads):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in own.items()}
    if heads:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in said}
        base = {c: int(c / 5) * 5 for c in said}  # the remainder has the sign of c
        said = {c: said.get(base[c], [])[: h[c]] + v[h[c] :] for c, v in said.items()}
    nodes = {}
    for c, v in said.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        under = [k for k in nodes if k[: len(key)] == key]
        children = [k for k in under if len(k) == len(key) + 1]
        leaves = sum(not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in under) for k in under)
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in under if k)
        ends = ",".join(str(c) for c in sorted(members) if len(said[c]) == len(key))
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed):
    r = random.Random(seed)
    turns = [(r.choice(["user", "assistant", None]), r.choice(["é" * 3, "yes", "", None, "no|", "1:x"])) for _ in range(4)]
    rows = []
    for c in [*range(0, 40), *range(-12, 0), 10**12, 10**12 + 1]:
        if r.random() < 0.85:
            rows += [(c, r.choice([t, t, None, 3]), *r.choice(turns)) for t in range(r.randint(1, 7))]
    return rows + [rows[0], rows[0]] + [(None, 1, "user", "of nobody")]


def test_against_brute_force(spark):
    for seed, heads in ((1, True), (2, True), (3, False)):
        rows = conversations(seed)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(0).alias(c) for c in ("c", "pos", "idx", "k", "n", "id", "parent", "depth", "size")])
        got = trie.prefix_trie(df.repartition(3), **(head() if heads else {})).collect()
        assert sorted((tuple(x) for x in got), key=repr) == brute(rows, heads)


def test_equal_continuations_take_no_rounds(spark, monkeypatch):
    """Long conversations that are equal, or alone, from some turn on are written as chains."""
    monkeypatch.setattr(trie, "ID_BITS", 2)
    kept = []
    keep = trie.Scratch.keep
    monkeypatch.setattr(trie.Scratch, "keep", lambda self, df, *a: kept.append(1) or keep(self, df, *a))
    rows = [(c, t, "user", f"turn {t}" if t else f"first of {c % 2}") for c in range(-6, 25) for t in range(60)] + [(99, t, "user", f"own {t}") for t in range(80)]
    got = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute(rows, False)
    assert len(kept) < 10


def test_no_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), **head()).count() == 0
