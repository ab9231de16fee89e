"""The corpus pipeline stage by stage against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernel.llm import bpe
from tests.llm.test_operators import UPPER, links_brute

INSULTS = ["zorguma", "zorgulik", "zorgutrax"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(21)
    vocab = ["".join(r.choice("abcdefghi") for _ in range(r.randint(2, 7))) for _ in range(500)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [say(25) for _ in range(5)]
    shared = [say(8) for _ in range(3)]
    docs, labels = [], []
    for i in range(400):
        lines = [say(r.randint(8, 25)) for _ in range(r.randint(2, 6))]
        toxic = i % 6 == 0
        if toxic:
            lines[0] = f"{r.choice(INSULTS)} {lines[0]} {r.choice(INSULTS)}"
        if i % 9 == 1:
            lines.append(r.choice(items))
        if i % 4 == 1:
            lines.insert(0, r.choice(shared))
        docs.append((i, "\n".join(lines), "en", f"s{i % 5}", 0))
        if i % 7:
            labels.append((i, 1, int(toxic)))
    for i in range(400, 440):  # near copies of earlier clean documents
        w = docs[(i - 400) * 6 + 2][1].split(" ")
        w[len(w) // 2] = "changed"
        docs.append((i, " ".join(w), "en", "s0", 0))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (None, say(30), "en", "s1", 0)]
    place = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, items = docs.columns, [x.text for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "near dedup", "decontamination", "bpe"]

    clean = stages["toxicity"](spark, docs, sf_dir)
    assert clean.columns == columns
    have = {x.doc_id: x.text for x in clean.collect()}
    bad = {x.doc_id for x in docs.collect() if any(w in (x.text or "") for w in INSULTS)}
    assert len(bad & set(have)) <= len(bad) * 0.1 and {x.doc_id for x in docs.collect()} - bad <= set(have)

    lines = stages["line dedup"](spark, clean, sf_dir)
    assert lines.columns == columns and lines.schema == docs.schema
    held, key = defaultdict(set), lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    for i, t in have.items():
        if i is not None:
            for x in (t or "").split("\n"):
                held[key(x)].add(i)
    want = {i: "\n".join(x for x in (t or "").split("\n") if i is None or len(key(x)) < 10 or min(held[key(x)]) == i) for i, t in have.items()}
    got = {x.doc_id: x for x in lines.collect()}
    assert {i: x.text for i, x in got.items()} == want and all(x.n_chars == len(x.text) for x in got.values())

    near = stages["near dedup"](spark, lines, sf_dir)
    assert near.columns == columns
    # a near copy has lost the lines that it shares, and is known by its whole text
    whole = [(x.doc_id, x.text, None) for x in docs.collect() if x.doc_id is not None and x.doc_id in want]
    groups = links_brute(whole + [(i, t, None) for i, t in want.items() if i is not None], 5, 80)
    copies = {i for i in range(400, 440) if groups[i][1] != i}
    assert len(copies) > 20 and not copies & {x.doc_id for x in near.collect()}
    assert {x.doc_id for x in near.collect()} == {None} | {i for i, (_, c) in groups.items() if c == i}

    safe = stages["decontamination"](spark, near, sf_dir)
    assert safe.columns == columns
    assert {x.doc_id for x in safe.collect()} == {x.doc_id for x in near.collect() if not any(item in x.text for item in items)}

    out = stages["bpe"](spark, safe, sf_dir).collect()
    machine = bpe.load(bpe.default_vocabulary())
    assert {x.doc_id: x.n_tokens for x in out} == {x.doc_id: len(machine.encode(x.text)) for x in safe.collect()}
    assert {x.doc_id: x.ids for x in out} == {x.doc_id: machine.encode(x.text) for x in safe.collect()}
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, out))


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_odd_rows(spark, sf_dir):
    """Repeated ids, nulls, blank and long texts, and columns with working names go through every stage, each with all its columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = sorted((x.doc_id, x.text) for x in docs.collect() if x.doc_id is not None and x.doc_id < 400 and x.doc_id % 6 and x.doc_id % 9 != 1)
    long = " ".join(t.replace("\n", " ") for _, t in clean) * 2
    assert len(long) > 1 << 15
    more = spark.createDataFrame([(5, "a second text under a known id, of its own words", None, None, 1), (5, "a second text under a known id, of its own words", None, None, 1), (2000, long, "en", "s", 2), (2001, long + " end", "en", "s", 2), (2002, " \n ", "en", "s", 2)], docs.schema)
    docs = docs.unionByName(more)
    for name in ("row", "score", "version", "uid", "h", "now_id", "lines"):
        docs = docs.withColumn(name, F.lit(name))
    ids = sorted((x.doc_id for x in docs.collect()), key=str)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
        have = sorted((x.doc_id for x in kept.collect()), key=str)
        assert not [i for i in set(have) if have.count(i) > ids.count(i)]
        assert None in have and {1000, 1001, 2002} <= set(have), name
        assert all(x.row == "row" and x.lines == "lines" for x in kept.collect())
    assert 2000 in have and 2001 not in have
    assert corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).count() == len(have)
