"""Uploads of odd names, commits, imports that are killed after each step, products of two builders."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quernel.operators.reports import Rule
from quernel.sources import imports, products, raw
from quernel.sources.commits import CommitLog, Taken, put_if_absent


class Killed(BaseException):
    """Nothing is cleaned up after it, as after a kill."""


STEPS = ["raw", "points", "bad", "validation", "quality", "publish points", "publish bad", "publish validation", "publish quality"]


def upload(folder):
    for name, i in (("a/points.csv", 1), ("b/points.csv", 2), ("with space/100% #2.csv", 3), ("a/deep/er/x+y&z=1.csv", 4), ("é?.csv", 5)):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(f"{i},1,2024-01-01T00:00:00,0.5,1.5\n{i},2,2024-01-01T09:00:00,0.5,{i}\n")
    return folder


def take(spark, root, path, **how):
    return imports.import_upload(spark, root, str(path), "csv", "v1", [Rule("y", F.col("y") < 300)], **how)


def test_files_of_one_name_and_odd_names_stay_apart(spark, tmp_path):
    up, root = upload(tmp_path / "up"), str(tmp_path / "root")
    made = raw.register_raw(spark, root, str(up), "v1")
    rows = raw.raw_paths(spark, root, made).collect()
    assert len(rows) == 5 and len({r.raw_path for r in rows}) == len({r.raw_sha256 for r in rows}) == 5
    copied = next((tmp_path / "root/raw" / f"dataset_id={made}").iterdir())
    assert sorted(str(p.relative_to(copied)) for p in copied.rglob("*.csv")) == sorted(str(p.relative_to(up)) for p in up.rglob("*.csv"))
    assert {r.status for r in raw.verify_raw(spark, root, made).collect()} == {"unchanged"}
    # a glob over folders keeps both files
    two = raw.register_raw(spark, root, f"{up}/[ab]/*.csv", "v1")
    assert raw.raw_paths(spark, root, two).count() == 2
    done = take(spark, root, up)
    assert done.points.count() == 10 and done.points.select("track_id").distinct().count() == 5


def test_an_upload_without_files_is_refused(spark, tmp_path):
    (tmp_path / "up").mkdir()
    root = str(tmp_path / "root")
    with pytest.raises(FileNotFoundError):
        raw.register_raw(spark, root, str(tmp_path / "up"), "v1", dataset_id="d")
    (tmp_path / "up/x.csv").write_text("1\n")
    assert raw.register_raw(spark, root, str(tmp_path / "up"), "v1", dataset_id="d") == "d"
    assert raw.raw_paths(spark, root, "d").count() == 1


def nothing_is_there(spark, root):
    assert CommitLog(spark, root).entries().count() == 0 and raw.read_manifest(spark, root).count() == 0
    with pytest.raises(FileNotFoundError):
        CommitLog(spark, root).table("points")


@pytest.mark.parametrize("step", STEPS)
def test_a_killed_import_leaves_nothing_or_all(spark, tmp_path, step):
    up, root = tmp_path / "p.csv", str(tmp_path / "root")
    up.write_text("1,1,2024-01-01T00:00:00,0.5,1.5\n1,2,oops,0,0\n")

    def until(done):
        if done == step:
            raise Killed

    with pytest.raises(Killed):
        take(spark, root, up, dataset_id="d", progress=until)
    nothing_is_there(spark, root)
    assert [i for i, _ in imports.half_imports(spark, root)] == ["d"]
    # the same id again, from the start or behind the last whole table
    resume = STEPS.index(step) % 2 == 0
    told = []
    again = take(spark, root, up, dataset_id="d", resume=resume, progress=told.append)
    assert again.points.count() == again.bad.count() == 1 and told[-1] == "commit"
    assert CommitLog(spark, root).table("points").count() == 1
    assert len(list((tmp_path / "root/raw/dataset_id=d").iterdir())) == (1 if resume else 2)
    assert imports.sweep(spark, root, 24) == []
    assert len(imports.sweep(spark, root, 0)) == (0 if resume else 1)
    assert len(list((tmp_path / "root/raw/dataset_id=d").iterdir())) == 1
    assert raw.verify_raw(spark, root, "d").head().status == "unchanged" and CommitLog(spark, root).table("bad").count() == 1
    with pytest.raises(Taken):
        take(spark, root, up, dataset_id="d")


def test_a_failed_import_cleans_up_and_frees_its_id(spark, tmp_path):
    up, root = tmp_path / "p.csv", str(tmp_path / "root")
    up.write_text("1,1,2024-01-01T00:00:00,0.5,1.5\n")
    with pytest.raises(RuntimeError):
        take(spark, root, up, dataset_id="d", progress=lambda s: (_ for _ in ()).throw(RuntimeError(s)) if s == "publish bad" else None)
    nothing_is_there(spark, root)
    assert imports.half_imports(spark, root) == []
    assert not [p for p in (tmp_path / "root").rglob("*") if p.is_file() and "run=" in str(p)]
    assert take(spark, root, up, dataset_id="d").points.count() == 1


def test_of_two_imports_of_an_id_one_commits(spark, tmp_path):
    up, root = tmp_path / "p.csv", str(tmp_path / "root")
    up.write_text("1,1,2024-01-01T00:00:00,0.5,1.5\n")

    def one(i):
        try:
            return take(spark, root, up, dataset_id="same" if i < 3 else f"d{i}").dataset_id
        except Taken:
            return "taken"

    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(one, range(4))) == ["d3", "same", "taken", "taken"]
    assert CommitLog(spark, root).table("points").count() == 2
    assert CommitLog(spark, root).versions() == [1, 2]


def test_readers_see_a_version(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    for i in range(3):
        spark.range(i + 1).write.parquet(f"{tmp_path}/t{i}")
        log.commit(f"d{i}", "r", {"t": f"{tmp_path}/t{i}"})
    assert [log.table("t", v).count() for v in (1, 2, 3, None)] == [1, 3, 6, 6]
    assert log.table("t", dataset_id="d1").count() == 2
    with pytest.raises(Taken):
        log.commit("d1", "other", {})
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda i: put_if_absent(spark, f"{tmp_path}/one", str(i)), range(16))) == 1


def test_two_builders_give_one_product(spark, tmp_path):
    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(lambda i: products.load_or_build(spark, str(tmp_path), "p", "k", lambda: spark.range(5)), range(3)))
    assert len({tuple(x.inputFiles()) for x in found}) == 1 and found[0].count() == 5
    assert len([p for p in (tmp_path / "generated/p").iterdir() if p.name.startswith("build=")]) == 1


def test_only_changed_partitions_are_built(spark, tmp_path):
    root = str(tmp_path)
    read = []

    def build(parts):
        read.extend(parts)
        return spark.createDataFrame([(p, len(p)) for p in parts if p != "empty"], "part string, n int")

    inputs = {"2024-01-01": "a", "2024-01-02": ["b", "c"], "odd/part": "d"}
    first, built = products.load_or_build_parts(spark, root, "days", inputs, "v1", None, build)
    assert built == read == sorted(inputs) and sorted(map(tuple, first.select("part", "n").collect())) == [(p, len(p)) for p in sorted(inputs)]
    again, built = products.load_or_build_parts(spark, root, "days", inputs, "v1", None, build)
    assert built == [] and len(read) == 3 and set(again.inputFiles()) == set(first.inputFiles())
    changed, built = products.load_or_build_parts(spark, root, "days", inputs | {"2024-01-02": ["b", "x"], "2024-01-03": "e", "empty": "f"}, "v1", None, build)
    assert built == ["2024-01-02", "2024-01-03", "empty"] and {f.rsplit("/", 1)[0] for f in set(changed.inputFiles()) & set(first.inputFiles())} == {f.rsplit("/", 1)[0] for f in first.inputFiles() if "2024-01-02" not in f}
    assert first.count() == 3  # what a reader of the version before holds is still there
    assert products.latest(spark, root, "days").count() == 4
    assert products.load_or_build_parts(spark, root, "days", inputs, "v2", None, build)[1] == sorted(inputs)
    assert len(list((tmp_path / "generated/days/versions").iterdir())) == 3
