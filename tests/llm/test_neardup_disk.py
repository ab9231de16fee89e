"""What near dedup leaves on disk, and other texts of the same documents."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from quernel.llm import neardup
from quernel.llm.scratch import Scratch, root


def _texts(n: int, words: int = 60) -> list[str]:
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(900)]
    return [" ".join(r.choice(vocab) for _ in range(words)) for _ in range(n)]


def test_only_the_result_stays(spark):
    rows = list(enumerate(_texts(60)))
    for i in range(60, 90):  # crowds with an absent centre reach the second pass as well
        w = rows[i % 3][1].split(" ")
        for j in range(3):
            w[(i * 7 + j * 19) % 60] = f"x{i}{j}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared = Path(root(spark).removeprefix("file://"))
    had = set(shared.glob("*"))
    out = neardup.near_duplicates(docs, k=3, per_cent=70)
    left = [x for folder in set(shared.glob("*")) - had for x in folder.iterdir()]
    assert len(left) == 1 and out.count() == 90
    assert {x.doc_id for x in out.filter("NOT kept").collect()} <= set(range(60, 90))


def test_shuffle_files_go_with_the_write(spark):
    folders = [Path(str(x)) for x in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {x for d in folders for x in d.rglob("shuffle_*.data")}
    scratch, had = Scratch(spark, "tidy"), files()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    kept = scratch.keep(spark.range(100_000).repartition(4, F.col("id") % 50))
    for _ in range(50):
        if not files() - had:
            break
        time.sleep(0.1)
    assert not files() - had and spark.conf.get(key) == before and kept.count() == 100_000
    scratch.clear()


def test_texts_of_other_documents_count_for_nothing(spark):
    a, b, c, d = _texts(4)
    near = lambda t: f"{t} more"
    docs = spark.createDataFrame([(3, a), (4, "left of b"), (6, "left of its copy"), (7, c), (8, None), (9, d), (9, d), (9, "of nine"), (None, a)], "doc_id long, text string")
    # 1 and 2 are gone; 4 and 6 were near copies; 7 is as it was; 9 has two texts, of which one is as it was
    further = spark.createDataFrame([(1, a), (2, near(c)), (3, a), (4, b), (6, near(b)), (7, c), (8, None), (9, d), (9, near(d)), (None, b)], "doc_id long, text string")
    kept = [x.doc_id for x in neardup.keep_one(docs, k=5, per_cent=80, further=further).collect()]
    assert sorted(kept, key=str) == [3, 4, 7, 8, 9, 9, 9, None]
