import pytest

from doctree.streaming import mirror as mi
from doctree.streaming.pull import HELD, PAGE, changes, incremental_pull, mirrored_files

FIRST = [
    ("s", "1", "Home", None, 1, 0, "<p>home</p>", 1), ("s", "2", "Tools", "1", 1, 0, "<p>tools</p>", 2), ("s", "3", "Saw", "2", 1, 0, "<p>saw</p>", 3), ("s", "4", "Wood", "1", 1, 1, "<p>wood</p>", 4),
    ("s", "8", "Leaf", "7", 1, 0, "<p>early</p>", 5), ("s", "9", "Bad", "1", 1, 5, "<p>a < b</p>", 6),
]
SECOND = [("s", "2", "Old Tools", "1", 2, 0, "<p>tools two</p>", 7), ("s", "3", "Saw", "2", 2, 0, "<p>saw two</p>", 8), ("s", "3", "Saw", "2", 2, 0, "<p>saw last</p>", 9)]
THIRD = [("s", "2", "Old Tools", "4", 3, 0, "<p>tools two</p>", 10), ("s", "7", "Branch", "1", 1, 3, "<p>branch</p>", 11), *FIRST, ("t", "1", "Other", None, 1, 0, "<p>x</p>", 12)]


def files(df):
    return sorted(map(tuple, df.collect()))


def run(spark, folder, batches, **options):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").json(f"{folder}/in")
        stream = spark.readStream.schema(PAGE).json(f"{folder}/in")
        incremental_pull(spark, stream, f"{folder}/mirror", f"{folder}/cp", "docs", **options).awaitTermination()
    return files(mirrored_files(spark, f"{folder}/mirror"))


def test_batches_a_move_and_a_replay_equal_one_batch(spark, tmp_path):
    many = run(spark, f"file://{tmp_path}/many", [FIRST, SECOND, THIRD], buckets=4)
    one = run(spark, f"file://{tmp_path}/one", [FIRST + SECOND + THIRD], buckets=4)
    assert many == one
    assert {(s, i): p for s, i, p, *_ in many} == {
        ("s", "1"): "docs/index.md", ("s", "2"): "docs/wood/old-tools/index.md", ("s", "3"): "docs/wood/old-tools/saw.md", ("s", "4"): "docs/wood/index.md",
        ("s", "7"): "docs/branch/index.md", ("s", "8"): "docs/branch/leaf.md", ("t", "1"): "docs/index.md",
    }
    assert [c for s, i, _, _, c in many if i == "3"][0].endswith("saw last\n") and [c for s, i, _, _, c in many if i == "8"][0].endswith("early\n")


def test_a_kill_before_the_manifest_changes_nothing_and_runs_again(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/kill"
    before = run(spark, folder, [FIRST])

    def dies(*args, **kwargs):
        raise OSError("killed")

    monkeypatch.setattr("doctree.streaming.mirror.Store.numbers", dies)  # after the data, before the manifest
    with pytest.raises(Exception, match="killed"):
        mi.commit(spark, f"{folder}/mirror", 1, spark.createDataFrame([("s", "1", "x", None, 0, 9, "p", "c", None)], HELD), HELD)
    monkeypatch.undo()
    assert files(mirrored_files(spark, f"{folder}/mirror")) == before
    (_, fixed) = mi.live_files(spark, f"{folder}/mirror")
    after = run(spark, folder, [SECOND])
    assert [r for r in after if r[1] == "2"][0][2:4] == ("docs/old-tools/index.md", 2) and fixed == mi.BUCKETS
    again = changes(mi.read_mirror(spark, f"{folder}/mirror", HELD), spark.createDataFrame(FIRST + SECOND, PAGE), "docs")
    assert again.where("path is not null").collect() == []  # pages that wait are as they were


def test_a_batch_writes_its_buckets_only_and_old_files_go(spark, tmp_path):
    folder = f"file://{tmp_path}/part"
    row = lambda i, v: ("s", str(i), "t", None, 0, v, f"{i}.md", f"c{v}", None)
    assert mi.commit(spark, folder, 0, spark.createDataFrame([row(i, 1) for i in range(400)], HELD), HELD, 32) == 32
    assert mi.commit(spark, folder, 1, spark.createDataFrame([row(i, 2) for i in (5, 6)], HELD), HELD) <= 2
    assert mi.commit(spark, folder, 1, spark.createDataFrame([row(i, 2) for i in (5, 6)], HELD), HELD) <= 2
    got = mi.read_mirror(spark, folder, HELD)
    assert got.count() == 400 and sorted(r["page_id"] for r in got.where("version = 2").collect()) == ["5", "6"]
    assert mi.read_mirror(spark, folder, HELD, before=1).where("version = 2").count() == 0
    mi.forget(spark, folder, 1)
    assert mi.read_mirror(spark, folder, HELD).count() == 400 and mi.Store(spark, folder).committed() == [1]
    assert len(mi.Store(spark, folder).numbers("data/batch=0", "bucket")) >= 30
    mi.commit(spark, folder, 2, spark.createDataFrame([row(i, 3) for i in range(400)], HELD), HELD)
    mi.forget(spark, folder, 1)
    assert mi.Store(spark, folder).numbers("data", "batch") == [2]


def test_empty_mirror(spark, tmp_path):
    assert mi.read_mirror(spark, f"file://{tmp_path}/none", HELD).collect() == []
    assert changes(spark.createDataFrame([], HELD), spark.createDataFrame([], PAGE), "docs").collect() == []
