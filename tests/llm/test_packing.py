"""Packing against brute force: every id once, in windows without gaps or padding."""

import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import bpe, packing


@pytest.mark.parametrize("seed", range(5))
def test_best_multiset(seed):
    r = random.Random(seed)
    for _ in range(60):
        counts = {x: r.randint(1, 4) for x in r.sample(range(1, 25), 4)}
        slack = r.randint(0, 60)
        best = max(s for t in product(*[range(c + 1) for c in counts.values()]) if (s := sum(x * y for x, y in zip(counts, t))) <= slack)
        total, chosen = packing.best_multiset(counts, slack)
        assert total == best == sum(x * y for x, y in chosen.items())
        assert all(0 < y <= counts[x] for x, y in chosen.items())


@pytest.mark.parametrize("lengths", [[], [1], [7] * 30, [8] * 3 + [5] * 40, [3, 3, 3], list(range(9)) * 9, [5, 8, 1, 1]])
def test_fill_windows(lengths):
    seen, short = defaultdict(list), []
    for window in packing.fill_windows(lengths, 8):
        n = sum(x for *_, x in window)
        if n != 8:
            short.append(n)
        for item, start, x in window:
            seen[item] += range(start, start + x)
    assert {i: sorted(x) for i, x in seen.items()} == {i: list(range(n)) for i, n in enumerate(lengths) if n}
    assert all(n & (n - 1) == 0 for n in short) and sum(short) == sum(lengths) % 8


ODD = [(1, "some words to encode, " * 40), (1, "a repeated id"), (2, None), (3, ""), (None, "no id at all"), (4, "x" * 3000), (5, "été <|endoftext|> 日本語 " * 200), (6, "same"), (6, "same"), (7, "same")]


def test_pieces_hold_every_id_once(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").select("*", F.lit("x").alias("uid"), F.lit(1).alias("start"), F.lit(0).alias("bucket"), F.lit(None).cast("string").alias("ids"))
    rows = packing.pack_documents(df, capacity=64, leaf_chars=200, rests_per_bucket=3).collect()
    core = bpe.load(bpe.default_vocabulary())
    want = sorted((repr(i), tuple(core.encode(t or "") + [1])) for i, t in ODD)
    sequences, documents = defaultdict(list), defaultdict(list)
    for x in rows:
        assert len(x.ids) == x.length and zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32
        sequences[x.sequence_id].append((x.offset, x.length))
        documents[x.doc_id].append(x)
    for pieces in sequences.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        total = sum(n for _, n in pieces)
        assert total <= 64 and total & (total - 1) == 0  # 64 is a power of two as well
    # the ids of a repeated doc_id's documents, whichever piece is whose, are all there
    held = sorted((repr(d), i) for d, pieces in documents.items() for x in pieces for i in x.ids)
    assert held == sorted((d, i) for d, ids in want for i in ids)
    for d, pieces in documents.items():
        if [i for i, _ in ODD].count(d) == 1:
            pieces.sort(key=lambda x: x.start)
            assert tuple(i for x in pieces for i in x.ids) == next(ids for n, ids in want if n == repr(d))
            assert {x.doc_tokens for x in pieces} == {sum(x.length for x in pieces)}
            assert [x.start for x in pieces] == [sum(y.length for y in pieces[:i]) for i in range(len(pieces))]


def test_nothing_to_pack(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
