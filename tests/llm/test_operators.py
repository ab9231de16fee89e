"""Operators on hand-made corner cases and against brute force."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernel.llm import bpe, chat, decontam, licenses, linededup, neardup, ngramlm, notices, quality, tokens, toxicity, wordpiece

UPPER = {i: i + 32 for i in range(65, 91)}
CLASH = "row string, uid long, version long, h long, h1 long, key string, pos int, lines string, n long, rep long, doc string, ws string, drops string, n_lines string, n_words string, kept string, labels string, score string, spans string, size int, at int, component string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(UPPER))


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared lines, hostile and empty ones: (doc_id, text, source)."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [say(9) for _ in range(4)]
    texts = []
    for i in range(n):
        body = [say(r.randint(3, 20)) for _ in range(r.randint(1, 8))]
        for _ in range(r.randint(0, 2)):
            body.insert(r.randint(0, len(body)), r.choice(shared).upper() if r.random() < 0.3 else "  " + r.choice(shared) + "\t")
        texts.append("\n".join(body))
    base = say(200).split()
    for i in range(25):  # near copies around the threshold
        w = list(base)
        for _ in range(i):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], "", None, "   \n\t ", "one", "one two", "ONE  two", "A" * 5000, "x " * 3000, "a\n\nb\n\r\n", "\n", "日本語 テキスト 日本語"]
    return [(i, t, f"host{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame([(*x, *(["z"] if extra else [])) for x in rows], "doc_id long, text string, source string" + (", z string" if extra else ""))
    if extra:
        df = df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (c.strip().split(" ") for c in CLASH.split(","))]).drop("z")
    return df


@pytest.fixture(scope="module")
def rows():
    return corpus() + [(None, "null id one two three four five", "host1"), (3, "another text of a repeated id", "host0")]


@pytest.fixture(scope="module")
def unique_rows():
    return corpus()


def links_brute(rows, k, per_cent):
    """{id: (size of the last text's set, smallest id of its group)}; rows that share an id are one node."""
    sets = []
    for i, t, _ in rows:
        w = words(t or "")
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(sets):
        for j, y in sets[n + 1 :]:
            if i != j and x and y:
                both = len(x & y)
                if 100 * both >= per_cent * (len(x) + len(y) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(x), find(i)) for i, x in sets}


@pytest.mark.parametrize(("k", "per_cent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, unique_rows, k, per_cent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, unique_rows), k=k, per_cent=per_cent).collect()}
    assert got == links_brute(unique_rows, k, per_cent)
    kept = neardup.keep_one(frame(spark, unique_rows), k=k, per_cent=per_cent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c)
    assert kept.columns == frame(spark, unique_rows).columns


def test_near_duplicates_of_a_crowd(spark):
    """Many near copies that miss the threshold against each other: the second pass must lose no link."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(r.choice([1, 3, 5, 6, 7, 9, 12])):
            w[r.randrange(150)] = f"v{r.randrange(40)}"
        rows.append((i, " ".join(w), None))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(frame(spark, rows), k=3, per_cent=85).collect()}
    assert got == links_brute(rows, 3, 85)


def test_near_duplicates_of_a_far_crowd(spark):
    """A crowd in which almost nothing is linked, around a centre that is not there."""
    r = random.Random(3)
    rows = []
    for i in range(300):
        w = [f"w{j}" for j in range(120)]
        for p in r.sample(range(120), r.choice([2, 3, 4])):
            w[p] = f"v{r.randrange(30)}"
        rows.append((i, " ".join(w), None))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(frame(spark, rows), k=3, per_cent=85).collect()}
    assert got == links_brute(rows, 3, 85)


def test_near_duplicates_of_repeated_and_string_ids(spark):
    """Rows that share an id keep the links of all their texts, whatever the order of rows."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a, None), (3, b, None), (7, b + " more", None), (5, a.upper(), None), (9, a + " b", None), (9, "quite another text of this id", None), (11, "quite another text of this id", None), (12, b, None)]
    for order in (rows, rows[::-1]):
        got = {(x.doc_id, x.component_id) for x in neardup.near_duplicates(frame(spark, order), k=3, per_cent=85).collect()}
        assert got == {(i, 3) for i in (3, 5, 7, 9, 11, 12)}
    named = spark.createDataFrame([(f"d{i:02d}", t) for i, t, _ in rows], "doc_id string, text string")
    assert {(x.doc_id, x.component_id) for x in neardup.near_duplicates(named, k=3, per_cent=85).collect()} == {(f"d{i:02d}", "d03") for i in (3, 5, 7, 9, 11, 12)}


def mirrored_words(n=1024):
    """Two words that hashes by sums of powers modulo 2**64 cannot tell apart."""
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return ("".join("ab"[x] for x in out), "".join("ba"[x] for x in out))


def test_words_of_a_known_construction_differ(spark):
    pairs = [mirrored_words(n) for n in (64, 256, 1024)]
    for x, y in pairs:
        data = np.frombuffer(f"{x} {y} {x}".encode(), np.uint8)
        ws = tokens.words_of(data, np.array([0, len(data)]))
        assert ws.hashes[0] == ws.hashes[2] != ws.hashes[1] and len(toxicity.distinct_words(ws)[0]) == 2
        pieces = {b"a", b"b", x.encode()}
        assert wordpiece.LongestMatch(pieces).counts(ws).tolist() == [1, greedy(y.encode(), pieces, pieces), 1]
    df = spark.createDataFrame([(2 * i + j, w) for i, pair in enumerate(pairs) for j, w in enumerate(pair)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df, k=3, per_cent=85).collect()} == {(i, i) for i in range(6)}
    assert {(r.doc_id, r.n_known) for r in ngramlm.score_texts(df, F.col("doc_id") % 2 == 1).collect()} == {(i, 2 if i % 2 == 0 else 1) for i in range(6)}


def test_near_duplicates_odd_rows(spark, rows):
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert neardup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_estimate_is_unbiased():
    r = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        a = r.integers(0, 2**63, 2000, dtype=np.uint64)
        b = np.concatenate([a[: int(2000 * share)], r.integers(0, 2**63, 2000 - int(2000 * share), dtype=np.uint64)])
        minima = np.stack([[(x * neardup._A[m] + neardup._B[m]).min() for x in (a, b)] for m in range(neardup.MINIMA)])
        _, planes = neardup._signatures(minima, 5)
        p = planes.view(np.uint64)
        half = neardup.MINIMA // 64
        differ = sum(int(np.bitwise_count((p[0, w] ^ p[1, w]) | (p[0, w + half] ^ p[1, w + half]))) for w in range(half))
        estimate = (1 - differ / neardup.MINIMA - 0.25) / 0.75
        truth = share / (2 - share)
        assert abs(estimate - truth) < 0.15


def test_line_dedup(spark, unique_rows):
    held = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    for i, t, _ in unique_rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    df = frame(spark, unique_rows)
    for batches, fanout in ((1, 2), (5, 2), (6, 3)):
        out = linededup.dedup_lines(df, batches=batches, fanout=fanout)
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()}
        for i, t, _ in unique_rows:
            lines = (t or "").split("\n")
            kept = [x for x in lines if len(key(x)) < 10 or min(held[key(x)]) == i]
            assert got[i] == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert set(df.columns) <= set(out.columns) and dict(out.dtypes)["n_lines"] == "bigint"


def test_line_dedup_odd_rows(spark, rows):
    out = linededup.dedup_lines(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    assert [r.n_dropped for r in out if r.doc_id is None] == [0]
    assert linededup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_runs_are_levelled(spark):
    from quernel.llm.scratch import Scratch

    runs = linededup.LineRuns(spark, Scratch(spark, "t"), fanout=2, buckets=3)
    for k in range(5):
        runs.absorb(spark.createDataFrame([(h, -h, k * 10 + d) for h in range(k, k + 4) for d in (2, 1)], "h1 long, h2 long, doc_id long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    got = {(r.h1, r.h2): r.owner for r in runs.owners().collect()}
    assert got == {(h, -h): max(0, h - 3) * 10 + 1 for h in range(8)} and runs.owners().count() == 8
    runs.close()


def test_chat_round_trip(spark):
    r = random.Random(4)
    parts = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<", "|", "\\", "<\\|", "<\\\\|", "|>", "\n", "a b", "é", "<|nl|>", ""]
    data = [(c, t, r.choice(["user", "assistant", "assistant", "sys<|\ntem", None]), r.choice([None, "".join(r.choice(parts) for _ in range(r.randint(0, 6)))])) for c in range(40) for t in range(r.randint(1, 9))]
    data += [(None, None, None, None), (7, 1, "user", "again"), (7, 1, "user", "again")]
    df = spark.createDataFrame([(*d, "x") for d in data], "conv_id int, turn int, role string, text string, turns string")
    out = chat.format_conversations(df)
    want = defaultdict(list)
    for c, t, ro, x in data:
        want[c].append((t if t is not None else -1, ro or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for row in out.select("*", chat.read_back(F.col("formatted")).alias("turns")).collect():
        turns = [(b, c) for _, b, c in sorted(want[row.conv_id])]
        assert [(x.role, x.text) for x in row.turns] == turns
        assert "".join(s.text for s in row.segments) == row.formatted
    for row in chat.digest(out).collect():
        turns = [(b, c) for _, b, c in sorted(want[row.conv_id])]
        loss = "".join(c for b, c in turns if b == "assistant")
        assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == (len(turns), sha("".join(f"{b}\n{c}\n" for b, c in turns)), len(loss), sha(loss))
    assert out.filter("conv_id is null").count() == 1
    assert chat.format_conversations(df.limit(0)).count() == 0
    # adjacent turns of one role are one block
    one = chat.format_conversations(spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c")], "conv_id int, turn int, role string, text string")).head()
    assert one.formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def greedy(word, initial, inner):
    i = n = 0
    while i < len(word):
        for j in range(len(word), i, -1):
            if word[i:j] in (initial if i == 0 else inner):
                break
        else:
            return 1
        i, n = j, n + 1
    return n


def test_longest_match_automaton():
    r = random.Random(3)
    for _ in range(150):
        some = lambda: {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))}
        initial, inner = some(), some()
        machine = wordpiece.LongestMatch(initial, inner)
        text = " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(40)) + " " + "abc" * 200
        raw = np.frombuffer(text.encode(), np.uint8)
        got = machine.counts(tokens.words_of(raw, np.array([0, len(raw)])))
        assert got.tolist() == [greedy(w.encode(), initial, inner) for w in text.split()]


def test_token_counts(spark, rows):
    path = bpe.default_vocabulary()
    pieces = set(bpe.load(path).bytes_of.values())
    got = wordpiece.token_counts(frame(spark, rows)).collect()
    want = Counter((i, len(words(t or "")), sum(greedy(b" " + w.encode(), pieces, pieces) for w in words(t or ""))) for i, t, _ in rows)
    assert Counter(map(tuple, got)) == want
    assert wordpiece.token_counts(frame(spark, rows).limit(0)).count() == 0


def brute_lm(texts, held, prior=3.0, growth=0.9):
    """[(n_tokens, n_known, N, base, score)] of texts, each a list of words, from those that are not held out."""
    uni, pairs, triples, heads = Counter(), Counter(), Counter(), 0
    for w, out in zip(texts, held):
        if not out:
            w = [*w, None]
            uni.update(w)
            pairs.update(zip(["^", *w], w))
            triples.update(zip(["^", *w], w, w[1:]))
            heads += 1
    total, types = sum(uni.values()), len(uni)

    def mixed(n, c, lower):
        m = prior * (1 + c**growth)
        return (n + m * lower) / (c + m)

    def p1(w):
        return (uni[w] + 0.1) / (total + 0.1 * (types + 1))

    def p2(v, w):
        return mixed(pairs[v, w], heads if v == "^" else uni[v], p1(w))

    out = []
    for w in texts:
        w = [*w, None]
        before = ["^", *w]
        s = math.log10(p2("^", w[0])) + sum(math.log10(mixed(triples[u, v, x], pairs[u, v], p2(v, x))) for u, v, x in zip(before, w, w[1:]))
        out.append((len(w), sum(uni[x] > 0 for x in w), total, sum(math.log10(p1(x)) for x in w), s))
    return out


@pytest.mark.parametrize(("depth", "chunk"), [(None, 6 << 20), (1, 2000), (2, 700)])
def test_language_model(spark, rows, depth, chunk):
    df = frame(spark, rows).repartition(3)
    got = ngramlm.score_texts(df, F.col("doc_id") % 4 == 0, chunk_bytes=chunk, depth=depth)
    held = [i is None or i % 4 == 0 for i, _, _ in rows]
    want = brute_lm([words(t or "") for _, t, _ in rows], held)
    have = defaultdict(list)
    for r in got.collect():
        have[(r.doc_id, r.n_tokens)].append(r)
    assert sum(map(len, have.values())) == len(rows)
    for (i, _, _), out, (n, known, total, base, score) in zip(rows, held, want):
        assert any(
            (r.held_out, r.n_known, r.train_tokens) == (out, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9) and abs(r.score - score) < 0.01 * n
            for r in have[(i, n)]
        )


def test_language_model_odd_tables(spark, rows):
    df = frame(spark, rows)
    assert ngramlm.score_texts(df.limit(0), F.lit(False)).count() == 0
    assert ngramlm.score_texts(df, F.lit(None).cast("boolean")).agg(F.max("train_tokens")).head()[0] == 0
    named = spark.createDataFrame([("a", "x y x y"), ("b", None), ("b", "x y")], "doc_id string, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in ngramlm.score_texts(named, F.col("doc_id") == "a").collect()) == [("a", 5), ("b", 1), ("b", 3)]


def test_a_chunk_sends_so_many_rows(spark):
    """Rows grow with the chunks, and not with the shards too."""
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    for shift in (58, 52):
        sent = list(ngramlm._rows(0, 1, shift, keys, *[np.ones(len(keys), np.uint16)] * 3))
        assert len(sent) <= ngramlm.FAN and sum(x[2] for x in sent) == len(keys)


def test_elias_fano_trie(tmp_path):
    from quernel.llm.eliasfano import EliasFano, NgramTrie, code_count, code_probability, count_of, probability_of, squeeze, stretch

    r = np.random.default_rng(1)
    for n, u in ((0, 1), (1, 5), (1000, 10), (1000, 2**40), (20000, 2**61), (3000, 3000)):
        v = np.sort(r.integers(0, u, n).astype(np.uint64))
        e = EliasFano.of(v)
        assert (e[np.arange(n)] == v).all() and (stretch(squeeze(v)) == v).all()
        q = np.concatenate([np.unique(v), r.integers(0, u * 2, 500).astype(np.uint64)])
        have = set(v.tolist())
        for a, b in zip(q.tolist(), e.find(q).tolist()):
            assert (b >= 0) == (a in have) and (b < 0 or v[b] == a)
    counts = np.arange(0, 100000)
    assert np.abs((count_of(code_count(counts)) - counts) / np.maximum(counts, 1)).max() < 0.011 and (count_of(code_count(counts[:128])) == counts[:128]).all()
    p = np.exp(-r.uniform(0, 30, 2000))
    assert np.abs(probability_of(code_probability(p)) / p - 1).max() < 0.011 and code_probability(np.ones(1))[0] == 1
    key = np.unique(r.integers(0, 50, 4000).astype(np.uint64) << np.uint64(20) | r.integers(0, 2**20, 4000).astype(np.uint64))
    c, s = key >> np.uint64(20), key & np.uint64(2**20 - 1)
    codes = r.integers(1, 60000, (2, len(key))).astype(np.uint16)
    shuffled = r.permutation(len(key))
    trie = NgramTrie.of(c[shuffled], s[shuffled], codes[0][shuffled], codes[1][shuffled], 20)
    trie.write(str(tmp_path / "t"))
    mapped = NgramTrie.map(str(tmp_path / "t"))
    assert all((x == y).all() for x, y in zip(mapped.find(c, s), codes))
    miss = ~np.isin((c << np.uint64(20)) | (s ^ np.uint64(1)), key)
    assert all((x == 0).all() for x in mapped.find(c[miss], s[miss] ^ np.uint64(1)))


ITEMS = [
    (1, "A train travels 60 km in 2 hours toward Leipzig so how far does the train travel in 5 hours"),
    (2, "Maria bought 12 apples and gave 5 apples to Paul then Maria ate 2 of the apples how many remain"),
    (3, "what colour is grass in spring"),
    (4, "short one"),
    (5, None),
]


def test_decontamination(spark):
    docs = [
        (0, "intro words here. " + ITEMS[0][1] + " and an outro"),
        (1, "Tom bought 7 apples and gave 3 apples to Anna then Tom ate 4 of the apples how many remain"),  # exchanged throughout
        (2, "Tom bought 7 apples and gave 3 apples to Anna then Jim ate 9 of the apples how many remain"),  # Tom became Jim
        (3, "Yesterday I asked WHAT colour is GRASS in spring."),
        (4, "a train of thought travels far in many hours and says nothing at all about any town"),
        (5, None),
        (6, ""),
        (7, "short one"),
        (8, "lorem ipsum " * 3000 + ITEMS[1][1].upper().lower()),
        (None, "x " + ITEMS[0][1]),
    ]
    df = spark.createDataFrame([(*d, "v") for d in docs], "doc_id long, text string, plain string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(df, items).collect()}
    assert {(0, 1), (1, 2), (3, 3), (None, 1)} <= set(got)
    assert got[(0, 1)].verbatim and not got[(1, 2)].verbatim and got[(0, 1)].share == 1.0
    assert not {d for d, _ in got} & {4, 5, 6, 7}
    # Maria is Tom in one window and Jim in eight: the one does not count, the other twelve are consistent
    assert (got[(2, 2)].share, got[(2, 2)].run_words) == (12 / 13, 19) and got[(1, 2)].share == 1
    left = [r.doc_id for r in decontam.drop_leaks(df, items).collect()]
    assert None in left and not set(left) & {0, 1, 3}
    assert decontam.find_leaks(df.limit(0), items).count() == 0 == decontam.find_leaks(df, items.limit(0)).count()
    # the way without a broadcast gives the same rows
    decontam.BROADCAST_BYTES, old = 0, decontam.BROADCAST_BYTES
    try:
        assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, items).collect()} == set(got)
    finally:
        decontam.BROADCAST_BYTES = old


def leaks(spark, items, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.find_leaks(df, spark.createDataFrame(list(enumerate(items)), "item_id int, text string")).collect()}


def test_decontamination_in_any_case(spark):
    item = "The slow boat leaves the old harbour every day. It carries wool and salt for the hill towns"
    got = leaks(spark, [item], [f"so. {item.upper()} end", item.lower(), item.title(), "THE SLOW BOAT LEAVES the old harbour at noon"])
    assert {k: (r.share, r.verbatim) for k, r in got.items()} == {(d, 0): (1.0, True) for d in range(3)}


def test_decontamination_of_copies_with_a_slip(spark):
    item = "The boat left the old harbour with wool and salt for the hill towns. The crew saw 12 gulls near the shore and 5 more at the inn by the long grey road"
    slip = item.replace("The crew", "Our crew")
    other = "Anna carried 12 boxes of pale grey slate over the ridge while 5 mules stood waiting below"
    got = leaks(spark, [item, other], [item, slip, other.replace("12", "7").replace("5", "7")])
    assert set(got) == {(0, 0), (1, 0), (2, 1)}
    assert got[(0, 0)].verbatim and not got[(1, 0)].verbatim and not got[(2, 1)].verbatim
    assert got[(1, 0)].share > 0.5 and got[(2, 1)].share == 1.0


def leaks_brute(text, item, window=8):
    """(share, run_words, verbatim) of an item in a text by plain loops, or None."""
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") if x]

    def canon(x):
        if x < ":":
            return "<number>"
        capital = len(x) > 1 and x[0].isupper() and x[1].islower()
        if x.lower() in decontam.UNITS and (capital or "[" <= x <= "{"):
            return "<unit>"
        return "<name>" if capital else x.lower()

    d, b = split(text), split(item)
    if len(b) < 5:
        return None
    size, of = min(len(b), window), max(len(b) - window + 1, 1)
    dc, bc, dl, bl = [canon(x) for x in d], [canon(x) for x in b], [x.lower() for x in d], [x.lower() for x in b]
    found = defaultdict(dict)  # diagonal -> place -> [same, pairs]
    for i in range(of):
        for j in range(len(d) - size + 1):
            same = bl[i : i + size] == dl[j : j + size]
            template = of > 1 and sum(x[0] != "<" for x in bc[i : i + size]) >= 3 and bc[i : i + size] == dc[j : j + size]
            if same or template:
                pairs = {(bc[i + k][:2] + bl[i + k], dc[j + k][:2] + dl[j + k]) for k in range(size) if bc[i + k][0] == "<"} if template else None
                found[j - i][i] = (same, pairs)
    hits, best, longest = set(), (0, False), 0
    for places in found.values():
        votes = Counter((x, y) for _, pairs in places.values() for x, y in pairs or ())
        agreed = {x: max((n, y) for (x2, y), n in votes.items() if x2 == x)[1] for x, _ in votes}
        good = sorted(i for i, (same, pairs) in places.items() if same or all(agreed[x] == y for x, y in pairs))
        if good:
            runs = [0]
            for i in range(of):
                runs.append(runs[-1] + 1 if i in good else 0)
            longest = max(longest, max(runs))
            best = max(best, (len(good), all(places[i][0] for i in good)))
            hits |= set(good)
    if hits and (len(hits) / of >= 0.5 or longest + size - 1 >= 13):
        return len(hits) / of, longest + size - 1, best[1]
    return None


def test_decontamination_against_brute_force(spark):
    r = random.Random(12)
    vocab = ["the", "of", "Anna", "Berlin", "boat", "takes", "hours", "km", "red", "Paul", "and", "7", "12", "a", "sees"]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [" ".join(say(n)) for n in (5, 7, 8, 9, 12, 20, 30, 30, 40)] + ["12 7 12 Anna km Berlin 7 12 7 Paul Anna 7", "What is the capital of France"]
    docs = ["It is the capital of Spain", "so what is the capital of france now"]
    for _ in range(250):
        w = say(r.randint(0, 10))
        for _ in range(r.randint(1, 3)):
            part = r.choice(items).split()
            lo = r.randint(0, max(len(part) - 6, 0)) if r.random() < 0.5 else 0
            part = part[lo : lo + r.randint(6, 40)]
            if r.random() < 0.6:
                swap = {x: r.choice(["Mara", "Tom", "99", "41", "miles", x]) for x in vocab if x[0].isupper() or x[0].isdigit() or x in ("km", "hours")}
                part = [swap.get(x, x) for x in part]
            if r.random() < 0.4:
                part[r.randrange(len(part))] = r.choice(vocab)
            w += [x.upper() if r.random() < 0.1 else x for x in part] + say(r.randint(0, 5))
        docs.append(" ".join(w))
    want = {(i, j): x for i, d in enumerate(docs) for j, t in enumerate(items) if (x := leaks_brute(d, t))}
    assert {k: (round(x.share, 9), x.run_words, x.verbatim) for k, x in leaks(spark, items, docs).items()} == {k: (round(s, 9), n, v) for k, (s, n, v) in want.items()}
    assert len(want) > 100 and (0, 10) not in want


def test_decontamination_of_a_shared_opening(spark, monkeypatch):
    """An opening that all items and documents have brings no pairs about; what else they share does."""
    r = random.Random(31)
    say = lambda n: " ".join("".join(r.choice("abcdefghijk") for _ in range(7)) for _ in range(n))
    opening = say(12)
    items = [f"{opening} {say(20)}" for _ in range(40)]
    docs = [" ".join(f"{opening} {say(3)}" for _ in range(20)) for _ in range(15)] + [f"{say(5)} {items[3]} {say(2)}", " ".join(items[7].split()[2:15]), items[9].upper(), " ".join(items[11].split()[:12])]
    kept = []
    keep = decontam.Scratch.keep
    monkeypatch.setattr(decontam.Scratch, "keep", lambda self, df, *a: kept.append(keep(self, df, *a)) or kept[-1])
    got = leaks(spark, items, docs)
    assert {k: (round(x.share, 9), x.run_words, x.verbatim) for k, x in got.items()} == {(i, j): (round(y[0], 9), *y[1:]) for i, d in enumerate(docs) for j, t in enumerate(items) if (y := leaks_brute(d, t))}
    assert {(15, 3), (16, 7), (17, 9)} <= set(got)
    pairs = next(x for x in kept if x.columns == ["doc_id", "uid", "item_id", "of", "size"])
    assert pairs.count() < 10  # of 760


def test_bpe_join_is_exact():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    mine, theirs = bpe.load(path), Tokenizer.from_file(path)
    r = random.Random(11)
    pools = ["abcdefgh", "a", "ab", "the and ", "é ü ß", "'s'll're!", "0123456789", "  \n\t x", "日本語", "<|endoftext|>", "!?.,", "aA1 ", "😀é ", "   a"]
    for _ in range(400):
        some = r.sample(pools, r.randint(1, 3))
        text = "".join(r.choice(r.choice(some)) for _ in range(r.randint(1, 300))) + ("<|endoftext|>" if r.random() < 0.1 else "")
        size = r.choice([5, 17, 40, 100])
        got = mine.join_tree([mine.encode(text[i : i + size]) for i in range(0, len(text), size)])
        assert got == theirs.encode(text, add_special_tokens=False).ids
        assert mine.decode(got) == theirs.decode(got, skip_special_tokens=False)


def test_bpe_joins_re_encode_little_in_any_script(monkeypatch):
    """A join looks at a window around it, whatever the script: of long texts little is encoded a second time."""
    mine = bpe.load(bpe.default_vocabulary())
    r = random.Random(5)
    texts = {
        "latin": " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(9000)),
        "cyrillic": " ".join("".join(r.choice("абвгдежз") for _ in range(r.randint(1, 9))) for _ in range(9000)),
        "japanese": "".join(r.choice("日本語テキストかな漢字、。") for _ in range(40000)),
        "digits": "".join(r.choice("0123456789 ") for _ in range(40000)),
        "signs": "".join(r.choice("+-*/=<>!?") for _ in range(40000)),
    }
    done = []
    plain = bpe.ByteBpe.encode
    monkeypatch.setattr(bpe.ByteBpe, "encode", lambda self, text: done.append(len(text)) or plain(self, text))
    for name, text in texts.items():
        parts = [mine.encode(text[i : i + 4096]) for i in range(0, len(text), 4096)]
        done.clear()
        got = mine.join_tree(parts)
        again = sum(done)
        assert got == mine.encode(text), name
        assert again < 0.2 * len(text), (name, again / len(text))


def test_bpe_texts(spark, rows):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(bpe.default_vocabulary())
    want = Counter((i, tuple(theirs.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, _ in rows)
    for leaf in (64, 1 << 15):
        got = bpe.encode_texts(frame(spark, rows), leaf_chars=leaf)
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got.collect()) == want
    digests = Counter(map(tuple, bpe.encode_texts(frame(spark, rows), leaf_chars=64, digest=True).collect()))
    assert digests == Counter((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for (i, ids, t), n in want.items() for _ in range(n))
    assert bpe.encode_texts(frame(spark, rows).limit(0)).count() == 0


def quality_brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    covered = {k for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, rows):
    r = random.Random(2)
    hard = [(1000 + i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60))), "h") for i in range(40)] + [(2000, "# a|b <c>\n# a|b <c>\n\n x", "h")]
    out = quality.score_quality(frame(spark, rows + hard)).collect()
    want = Counter((i, *quality_brute(t)) for i, t, _ in rows + hard)
    assert Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in out) == want
    for x in out:
        assert x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words)
        assert x.kept == (not x.base_failed and not x.depleted)
    assert quality.score_quality(frame(spark, rows).limit(0)).count() == 0


def test_quality_plain_way_for_huge_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "PLACE_BITS", 2)
    r = random.Random(6)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 50))) for _ in range(40)]
    df = spark.createDataFrame(enumerate(texts), "i int, text string")
    from quernel.llm.text import words as split

    got = {x.i: x.n for x in df.select("i", quality.repeated_words(split(F.col("text"))).alias("n")).collect()}
    assert got == {i: quality_brute(t)[-1] for i, t in enumerate(texts)}


def test_frequent_lines_deplete(spark):
    menu = "home about contact terms of use and all the other links that every page has"
    rows = [(i, menu if i < 10 else f"{menu}\n" + " ".join(f"own{i}w{j}" for j in range(30)), "a") for i in range(40)] + [(100 + i, " ".join(f"b{i}w{j}" for j in range(30)), "b") for i in range(60)]
    out = {r.doc_id: r for r in quality.score_quality(frame(spark, rows), min_host_docs=20).collect()}
    assert all(out[i].depleted and out[i].n_left_words == 0 for i in range(10))
    assert all(out[i].kept and out[i].n_left_words == 30 for i in [*range(10, 40), *range(100, 160)])


MIT = next(body for label, body, _ in notices.templates() if label == "mit" and len(body) > 200)


def test_license_labels(spark):
    """Notices that differ in few words get the labels of their own licenses, and only these."""
    cases = [
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
        ("Content under CC BY 3.0, see below", "cc-by"),
        ("CC BY-SA 4.0", "cc-by-sa"),
        ("(CC BY-ND 4.0)", "cc-by-nd"),
        ("CC BY-NC-SA 2.5 applies", "cc-by-nc-sa"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "isc"),
        ("BSD 3-Clause License", "bsd"),
        ("# SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"),
        ("// SPDX-License-Identifier: MIT", "mit"),
        ("Distributed under the Boost Software License", "boost"),
        ("the license of this software is described in creative words", ""),
        ("free of charge to any person obtaining a copy", ""),
    ] + [(body, label) for label, body, _ in notices.NOTICES]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string")
    base = {"gpl", "mit", "apache"}
    for r in licenses.scan_licenses(df).collect():
        text, label = cases[r.doc_id]
        assert set(filter(None, r.labels.split(","))) - (base - {label}) == ({label} if label else set()), (text, r.labels)
    for label, _, _ in notices.templates():
        assert re.fullmatch("[a-z0-9-]+", label)
    assert len({label for label, _, _ in notices.templates()}) >= 40


def test_licenses(spark, rows):
    texts = [
        "Released under the MIT License.", "x mit   LICENSE mit-license", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3", "Licensed under CC BY-NC 4.0.",
        "All rights reserved.", "a mit b license", MIT.upper(), MIT.replace("modify", "alter or modify"), "general public", "İmit license", "",
    ]
    data = rows + [(5000 + i, t, None) for i, t in enumerate(texts)]
    out = licenses.scan_licenses(frame(spark, data)).collect()
    want = Counter()
    for i, t, _ in data:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
        at = [(j, name) for j in range(len(w)) for p, name in licenses.PHRASES.items() if tuple(w[j : j + len(p)]) == p]
        want[(i, len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({n for _, n in at})))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == want
    by = {r.doc_id: r for r in out}
    assert by[5004].labels == "cc-by-nc" and by[5005].labels == "all-rights-reserved" and by[5006].labels == ""
    assert by[5007].labels == "mit" and by[5008].labels == "mit" and by[5008].spans[0].share < 1 and by[5008].score > 0.6
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out)
    assert licenses.scan_licenses(frame(spark, rows).limit(0)).count() == 0


def test_toxicity_held_out(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghi") for _ in range(r.randint(2, 7))) for _ in range(400)]
    bad = ["zorgu" + x for x in ("ma", "lik", "trax", "pp", "net", "ri", "os", "unk")]
    rows = []
    for i in range(900):
        w = [r.choice(vocab) for _ in range(r.randint(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame([(i, t, None) for i, t, _ in rows] + [(None, None, "x"), (9999, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, "q") for i, _, y in rows if i % 3] + [(None, 1, "q"), (1, None, "q")], "doc_id long, toxic int, text string")
    model = toxicity.train(df, labels)
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(df, model).collect()}
    assert len(got) == len(rows) + 2 and all(0 <= s <= 1 for s in got.values())
    wrong = sum((got[i] >= 0.3) != bool(y) for i, _, y in rows if i % 3 == 0)
    assert wrong <= 6 and got[9999] < 0.3
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
    none = toxicity.train(df, labels.limit(0))
    assert {round(x.score, 6) for x in toxicity.score_toxicity(df, none).collect()} == {0.001}


def test_toxicity_sample_is_bounded_in_bytes(spark):
    """An id with very many and long texts: the model's grams stay within the bytes of the sample, all rows are scored."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    rows = [(1, " ".join(word() for _ in range(60))) for _ in range(300)] + [(2, " ".join(word() for _ in range(60))) for _ in range(300)] + [(1, " ".join(word() for _ in range(9000))), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, max_bytes=40_000)
    assert 1000 < len(model.grams) < 60_000
    scores = [x.score for x in toxicity.score_toxicity(df, model).collect()]
    assert len(scores) == len(rows) and all(0 <= x <= 1 for x in scores)


def test_toxicity_keeps_rows_in_place(spark):
    """Only texts go to Python, and the models of the calibration do not stay: the memory and disk of executors follow neither other columns nor the folds."""
    rows = [(i % 40 if i % 7 else None, None if i % 11 == 0 else f"{'vile scum' if i % 5 == 0 else 'fine day'} number {i} " * (1 + i % 3), "x" * i) for i in range(200)] + [(9, "", "y"), (9, "vile scum " * 200_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, `the text` string, other string").repartition(3)
    folder = spark.sparkContext._temp_dir
    before = set(os.listdir(folder))
    model = toxicity.train(df, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)], "doc_id long, toxic int"), text="the text")
    assert set(os.listdir(folder)) == before
    kept = toxicity.keep_clean(df, model, 0.3, text="the text")
    assert kept.columns == df.columns
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [score(the text#" in plan and "MapInArrow" not in plan
    whole = F.xxhash64("doc_id", "the text", "other")  # no row equals another
    scored = toxicity.score_toxicity(df.select(whole.alias("doc_id"), "the text"), model, text="the text")
    want = sorted(x.doc_id for x in scored.filter("score < 0.3").collect())
    assert sorted(x.row for x in kept.select(whole.alias("row")).collect()) == want and 0 < len(want) < len(rows)


def test_toxicity_many_words_of_one_stem(spark):
    """Each toxic word is rare and none is in a training text of the same document: their number and stem give them away."""
    rng = np.random.default_rng(6)
    part = lambda: "".join(rng.choice(["ka", "lo", "mi", "ser", "tun", "vel"], rng.integers(2, 5)))
    rows = []
    for i in range(600):
        words = [part() for _ in range(80)]
        stems = 12 if i % 8 == 0 else 1 if i % 3 == 0 else 0
        for at in rng.integers(0, 80, stems):
            words[at] = "milose" + part()
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(4)
    model = toxicity.train(df, spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id long, toxic int"))
    got = {x.doc_id: x.score >= 0.3 for x in toxicity.score_toxicity(df, model).collect()}
    held = [(got[i], bool(y)) for i, _, y in rows if i % 5 == 0]
    assert sum(g and y for g, y in held) >= 0.9 * sum(y for _, y in held)
    assert sum(g and not y for g, y in held) <= 0.05 * len(held)


def kneser_ney_brute(grams, d=toxicity.DISCOUNT, order=toxicity.ORDER):
    """p(class, context, byte) from {gram: (toxic, plain)}, grams being tuples of bytes, by recursion on dictionaries."""
    counts = {order: Counter(), **{n: Counter() for n in range(1, order)}}
    now = set(grams)
    for n in range(order - 1, 0, -1):
        for g in now:
            if len(g) == n + 1:
                counts[n][g[1:]] += 1
        for g in grams:
            if len(g) == n:
                counts[n][g] += 1
        now = now | set(counts[n])

    def shared(context, byte):
        if len(context) == 0:
            table, lower = counts[1], 1 / 256
        else:
            table, lower = counts[len(context) + 1], shared(context[1:], byte)
        own = {g[-1]: c for g, c in table.items() if g[:-1] == context}
        total = sum(own.values())
        return lower if not total else (max(own.get(byte, 0) - d, 0) + d * len(own) * lower) / total

    def p(which, context, byte):
        own = {g[-1]: c[which] for g, c in grams.items() if g[:-1] == context and c[which]}
        total, lower = sum(own.values()), shared(context[1:], byte) if context else shared((), byte)
        return lower if not total else (max(own.get(byte, 0) - d, 0) + d * len(own) * lower) / total

    return p


def test_class_models_against_brute_force():
    """Ratios of seen and unseen bytes equal those of plain dictionaries, and each class's probabilities of all bytes of a context sum to one."""
    text = np.frombuffer(b"aa ab abc abc b bca cab cab ca abcabcabca cabbage", np.uint8)
    ws = tokens.words_of(text, np.array([0, len(text)]))
    gram, _, _ = toxicity.grams_of(ws, np.arange(len(ws.starts)))
    half = np.arange(len(gram)) % 3 == 0
    model = toxicity.Model.fit(gram, half.astype(float), 1.0 - half)
    plain = lambda g: tuple((int(g) >> (8 * i)) & 255 for i in range((int(g) >> 56) - 1, -1, -1))
    grams = defaultdict(lambda: [0, 0])
    for g, t in zip(gram, half):
        grams[plain(g)][0 if t else 1] += 1
    p = kneser_ney_brute(dict(grams))
    for g, ratio in zip(model.grams, model.ratios):
        *context, byte = plain(g)
        assert math.isclose(ratio, math.log(p(0, tuple(context), byte)) - math.log(p(1, tuple(context), byte)), abs_tol=1e-9)
    for c, rest in zip(model.contexts, model.unseen):
        context = plain(c)
        byte = 0xFE  # no text has it
        assert math.isclose(rest, math.log(p(0, context, byte)) - math.log(p(1, context, byte)), abs_tol=1e-9)
        for which in (0, 1):
            assert math.isclose(sum(p(which, context, b) for b in range(256)), 1, rel_tol=1e-9)


def test_word_places(rows):
    """The vectorised words are those of the definition, whatever the slices."""
    col = pa.array([t for _, t, _ in rows])
    for size in (50, 1 << 20):
        got = []
        for lo, hi, data, offsets in tokens.text_slices(col.slice(2), size):
            ws = tokens.words_of(data, offsets)
            got += [[ws.data[a:b].tobytes().decode() for a, b in zip(ws.starts[x:y], ws.ends[x:y])] for x, y in zip(ws.first, ws.first[1:])]
        assert got == [words(t or "") for _, t, _ in rows[2:]]


def test_very_long_texts(spark):
    """Texts far beyond a batch's or a leaf's size go through every operator whole."""
    from tokenizers import Tokenizer

    r = random.Random(17)
    vocab = ["".join(r.choice("abcdeé日") for _ in range(r.randint(1, 7))) for _ in range(3000)]
    long = "\n".join(" ".join(r.choice(vocab) for _ in range(40)) for _ in range(3000))
    near = long.replace("a", "b", 3)
    rows = [(1, long, "h"), (2, near, "h"), (3, "short text", "h"), (4, "w" * 300_000, "h"), (5, long.split("\n")[0], "h")]
    df = frame(spark, rows)
    w = {i: words(t) for i, t, _ in rows}
    assert {(x.doc_id, x.component_id) for x in neardup.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}
    cut = {x.doc_id: x for x in linededup.dedup_lines(df).collect()}
    assert cut[1].n_dropped == 0 and cut[2].n_dropped > 2990 and cut[5].text == ""
    assert {x.doc_id: x.n_words for x in wordpiece.token_counts(df).collect()} == {i: len(x) for i, x in w.items()}
    scored = {x.doc_id: x for x in ngramlm.score_texts(df, F.col("doc_id") == 2).collect()}
    want = dict(zip(w, brute_lm(list(w.values()), [i == 2 for i in w])))
    assert all(abs(scored[i].score - want[i][4]) < 0.01 * want[i][0] for i in w)
    item = " ".join(w[1][5000:5030])
    assert {x.doc_id for x in decontam.find_leaks(df, spark.createDataFrame([(1, item)], "item_id int, text string")).collect()} == {1, 2}
    theirs = Tokenizer.from_file(bpe.default_vocabulary())
    assert {x.doc_id: x.ids for x in bpe.encode_texts(df).collect()} == {i: theirs.encode(t, add_special_tokens=False).ids for i, t, _ in rows}
    assert {x.doc_id: x.n_words for x in quality.score_quality(df).collect()} == {i: len(x) for i, x in w.items()}
    assert {x.doc_id for x in licenses.scan_licenses(df).collect()} == set(w)
    model = toxicity.train(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(df, model).count() == toxicity.keep_clean(df, model, 2.0).count() == 5
    talk = spark.createDataFrame([(1, 1, "user", long), (1, 2, "assistant", near)], "conv_id int, turn int, role string, text string")
    assert chat.digest(chat.format_conversations(talk)).head().loss_chars == len(near)
