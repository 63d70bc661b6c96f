"""The store: reuse of chunks, the switch, crashes, clearing, compaction and orphans."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import store
from marlstone.operators.store import Store


@pytest.fixture
def home(spark, tmp_path):
    derived = []

    def derive(fresh):
        derived.append(sorted(r.path for r in fresh.collect()))
        return fresh.withColumn("embedding", F.array(F.length("chunk").cast("double")))

    return Store(spark, str(tmp_path / "store"), derive), derived


def files(spark, **texts):
    return spark.createDataFrame(sorted(texts.items()), "path string, text string").withColumn("hash", F.lit("x"))


def content(s, version=None):
    return sorted((r.path, r.chunk_idx, r.chunk[:1], len(r.chunk), r.embedding) for r in s.read(version).collect())


def test_only_new_chunks_are_derived(spark, home):
    s, derived = home
    a = "a" * 500 + "b" * 450 + "c" * 450
    assert s.upsert(files(spark, a=a, b="x" * 30, c=None)) == 1
    first = content(s)
    assert [(p, i, n) for p, i, _, n, _ in first] == [("a", 0, 500), ("a", 1, 500), ("a", 2, 500), ("a", 3, 50), ("b", 0, 30)] and derived == [["a", "a", "a", "a", "b"]]
    assert s.upsert(files(spark, a=a[:-10] + "d" * 10, b="x" * 30, d="new")) == 2
    assert derived[1] == ["a", "a", "d"] and s.count() == 6 and s.count(1) == 5
    assert content(s, 1) == first
    assert {(r.path, r.version) for r in s.files().collect()} == {("a", 2), ("b", 1), ("d", 1)}
    assert s.upsert(files(spark, a="x", b="x" * 30)) == 3 and s.upsert(files(spark, a=a, b="x" * 30)) == 4
    assert derived[3] == []  # all of its chunks were there before


def test_a_crash_before_the_switch_leaves_the_old_version(spark, home, monkeypatch):
    s, _ = home
    s.upsert(files(spark, a="one", b="two"))
    before = content(s)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_switch", dies)
        with pytest.raises(KeyboardInterrupt):
            s.upsert(files(spark, a="three"))
    assert s.versions() == [1] and content(s) == before and len(s.orphans()) == 3
    gone = s.vacuum()
    assert len(gone) == 3 and s.orphans() == [] and content(s) == before
    assert s.upsert(files(spark, a="three")) == 2 and [c[3] for c in content(s)] == [5]


def test_a_second_writer_is_refused(spark, home, monkeypatch):
    s, _ = home
    s.upsert(files(spark, a="one"))
    with monkeypatch.context() as m:
        m.setattr(Store, "versions", lambda self: [])  # the other writer has not seen version 1
        with pytest.raises(store.Conflict):
            s._switch({part: [] for part in store.PARTS})
    assert s.count() == 1


def test_clear_compact_and_vacuum(spark, home):
    s, _ = home
    s.upsert(files(spark, a="one", b="two"))
    s.upsert(files(spark, a="three"))
    before = content(s)
    assert s.compact() == 3 and content(s) == before and len(s.manifest()["chunks"]) == 1
    s.vacuum()
    assert s.versions() == [3] and content(s) == before
    assert s.clear() == 4 and s.count() == 0 and s.read().count() == 0
    assert s.upsert(files(spark).limit(0)) == 5 and s.count() == 0
    s.vacuum()
    assert s.upsert(files(spark, a="again")) == 6 and s.count() == 1
