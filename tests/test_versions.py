"""The versioned index: merging on read, batches that run twice, conflicts, resets, and nothing lost."""

import pytest
from pyspark.sql import functions as F

from quillstack.operators import versions
from quillstack.streaming import watch

DDL = "citekey string, title string, tags array<string>"


def docs(spark, *pairs):
    return spark.createDataFrame([(k, t, [t]) for k, t in pairs], DDL)


def held(spark, index):
    out = versions.current(spark, index)
    return None if out is None else {r.citekey: r.title for r in out.collect()}


@pytest.fixture
def index(tmp_path):
    return str(tmp_path / "index")


def test_merge_on_read(spark, index):
    assert versions.current(spark, index) is None
    versions.commit(index, docs(spark, ("a", "1"), ("b", "1"), ("c", "1")))
    first = versions.manifest(spark, index)
    versions.commit(index, docs(spark, ("b", "2"), ("d", "2")), docs(spark, ("a", ""), ("d", "")))
    versions.commit(index, docs(spark, ("a", "3")), docs(spark, ("c", ""), ("zz", "")))
    want = {"a": "3", "b": "2", "d": "2"}
    assert held(spark, index) == want
    assert {r.citekey for r in versions.current(spark, index, at=first).collect()} == {"a", "b", "c"}
    assert [r.title for r in versions.get(spark, index, "b").collect()] == ["2"] and versions.get(spark, index, "c").count() == 0
    m = versions.compact(spark, index)
    assert len(m.segments) == 1 and held(spark, index) == want
    assert len(versions.vacuum(spark, index)) == 3 and held(spark, index) == want
    assert versions.compact(spark, index) == m


def test_a_commit_writes_only_its_rows(spark, index, tmp_path):
    versions.commit(index, docs(spark, *((f"k{i}", "1") for i in range(500))))
    m = versions.commit(index, docs(spark, ("k7", "2")))
    assert spark.read.parquet(f"{index}/segments/{m.segments[-1]}").count() == 1
    assert versions.current(spark, index).count() == 500


def test_batches_run_twice(spark, index):
    for _ in range(2):
        versions.commit(index, docs(spark, ("a", "1")), source="s", batch=0)
    versions.commit(index, docs(spark, ("a", "2")), source="s", batch=1)
    versions.commit(index, docs(spark, ("a", "1")), source="s", batch=0)
    assert held(spark, index) == {"a": "2"} and versions.manifest(spark, index).version == 2
    versions.commit(index, docs(spark, ("b", "1")), source="other", batch=0)
    assert held(spark, index) == {"a": "2", "b": "1"}


def test_conflict(spark, index):
    old = versions.manifest(spark, index)
    versions.commit(index, docs(spark, ("a", "1")))
    with pytest.raises(versions.Conflict):
        versions.swap(spark, index, old, versions.Manifest())
    assert held(spark, index) == {"a": "1"}


def test_failed_write_changes_nothing(spark, index):
    versions.commit(index, docs(spark, ("a", "1")))
    bad = docs(spark, ("b", "2")).withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        versions.commit(index, bad)
    assert held(spark, index) == {"a": "1"}


def test_reset_and_stamp(spark, index):
    versions.commit(index, docs(spark, ("a", "1")), source="s", batch=5)
    versions.reset(spark, index)
    assert held(spark, index) is None
    versions.commit(index, docs(spark, ("b", "1")), source="s", batch=0)
    assert held(spark, index) == {"b": "1"}
    wider = docs(spark, ("c", "1")).withColumn("year", F.lit(1))
    assert versions.current(spark, index, versions.stamp_of(wider.schema)) is None
    versions.commit(index, wider, source="s", batch=0)
    assert held(spark, index) == {"c": "1"}


def test_many_commits_are_compacted(spark, index):
    for i in range(4):
        m = versions.commit(index, docs(spark, (f"k{i}", "1")), most=3)
    assert len(m.segments) == 1 and len(held(spark, index)) == 4


BOOK = 'type: book\ntitle: {}\n'


def write(root, key, body):
    (root / key).mkdir(parents=True, exist_ok=True)
    (root / key / "info.yaml").write_text(body)


def test_fresh_checkpoint_on_an_old_index(spark, tmp_path):
    """What was lost before: a second stream with its own checkpoint starts at batch 0 again, on an index that is there."""
    root, index = tmp_path / "lib", str(tmp_path / "index")
    write(root, "one", BOOK.format("one"))
    watch.follow(spark, str(root), index, str(tmp_path / "s1")).awaitTermination(120)
    write(root, "two", BOOK.format("two"))
    watch.follow(spark, str(root), index, str(tmp_path / "s2")).awaitTermination(120)
    assert {r.citekey for r in watch.current(spark, index).collect()} == {"one", "two"}


def test_batch_after_a_lost_commit_log(spark, tmp_path):
    """Spark runs a batch again if its own log of commits is lost after ours was written."""
    root, index, state = tmp_path / "lib", str(tmp_path / "index"), tmp_path / "s"
    write(root, "one", BOOK.format("one"))
    watch.follow(spark, str(root), index, str(state)).awaitTermination(120)
    before = versions.manifest(spark, index)
    for f in (state / "commits").iterdir():
        f.unlink()
    watch.follow(spark, str(root), index, str(state)).awaitTermination(120)
    assert versions.manifest(spark, index) == before
    assert [r.citekey for r in watch.current(spark, index).collect()] == ["one"]
