"""The divergence of sources against plain counting."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quernel.llm import divergence

UPPER = {i: i + 32 for i in range(65, 91)}


def brute(rows, min_docs, top):
    counts, seen, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = set()
    for lang, names in sources.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]

        def share(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in names}
        q = share(sum((counts[lang, s] for s in names), Counter()))
        for s in names:
            pairs = [(b, sum(abs(p[s][t] - p[b][t]) for t in kept)) for b in names if b != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found[:most])}
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    vocab = ["".join(r.choice("abÉßz日Z") for _ in range(r.randint(1, 4))) for _ in range(60)]
    rows = [(r.choice(" -_1\x00").join(r.choice(vocab[: r.randint(3, 60)]) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "é", None, "zz"])) for _ in range(300)]
    rows += [(None, "en", "a"), ("", "xx", "only"), ("rare words", "yy", "one"), ("rare again", "yy", "two"), rows[0], rows[0]]
    rows.append(("long " * 20000 + "tail", "en", "b"))
    df = spark.createDataFrame(rows, "text string, lang string, source string").select("*", *[F.lit(0).alias(c) for c in ("shard", "term", "n", "item", "row", "part")])
    got = divergence.source_divergence(df.repartition(5), min_docs=4, top=6, docs_per_shard=40).collect()
    assert {tuple(x) for x in got} == brute(rows, 4, 6) and len(got) == len(set(got))
    # a language without kept terms has its pairs, at 0
    assert {(x.source, x.item, x.value, x.rank) for x in got if x.lang == "yy"} == {("one", "two", 0, 1), ("two", "one", 0, 1)}
    assert not [x for x in got if x.lang == "xx"]


def test_counts_beyond_64_bits_of_product(spark):
    """Shares are exact where a count times 10**9 has more than 64 bits."""
    import pyarrow as pa

    n = 40_000_000_000
    kept = pa.table({"lang": ["a", "a"], "source": ["x", "y"], "term": ["t", "t"], "n": [n, 1], "total": [n, 1], "lang_total": [n + 1, n + 1], "v": [1, 1]})
    found = divergence._ask(divergence._PAIRS.format(top=5), kept).to_pylist()
    assert sorted({x["value"] for x in found if x["part"] == "own"}) == [1 + 10**9]  # the only term of both


def test_no_documents(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
