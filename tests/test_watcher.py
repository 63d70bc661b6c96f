"""Debounce, reuse of hashes, restart, status and file list of the watcher."""

import os

import pytest

from marlstone.streaming import watcher


@pytest.fixture
def place(spark, tmp_path):
    folder, told, now = tmp_path / "in", [], [1000.0]
    folder.mkdir()
    note = lambda df, n: told.append({r.path.rsplit("/", 1)[1]: r.status for r in df.collect()})
    make = lambda: watcher.Watcher(spark, str(folder), str(tmp_path / "state"), note, quiet=60.0, clock=lambda: now[0])
    return folder, told, now, make


def test_a_burst_is_one_update_and_survives_restarts(place):
    folder, told, now, make = place
    w = make()
    assert w.status() == {"running": False, "checks": 0, "files": 0, "waiting": False}
    (folder / "a [1].txt").write_text("1")
    w.check()
    assert told == [] and w.status() == {"running": False, "checks": 1, "files": 1, "waiting": True}
    now[0] += 30
    (folder / "b.txt").write_text("1")
    w.check()
    now[0] += 40
    (folder / "b.txt").unlink()
    make().check()  # a new process goes on from the same state
    now[0] += 61
    make().check()
    assert told == [{"a [1].txt": "new"}] and not w.status()["waiting"]
    make().check()
    assert len(told) == 1
    now[0] += 1000
    (folder / "a [1].txt").write_text("other")
    make().check()
    now[0] += 60
    make().check()
    assert told[1:] == [{"a [1].txt": "modified"}]


def test_files_of_the_same_size_and_time_are_not_read(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("1")
    before = spark.createDataFrame([tuple(r) for r in watcher.file_state(spark, str(tmp_path)).collect()], watcher.STATE)
    at = os.stat(tmp_path / "a").st_mtime
    (tmp_path / "a").write_text("2")
    os.utime(tmp_path / "a", (at, at))
    (tmp_path / "b").write_text("22")
    kept = {r.path[-1]: r.hash for r in before.collect()}
    now = {r.path[-1]: r.hash for r in watcher.file_state(spark, str(tmp_path), before=before).collect()}
    assert now["a"] == kept["a"] and now["b"] != kept["b"]
    assert {r.path[-1] for r in watcher.file_state(spark, str(tmp_path), before=before.limit(0)).collect()} == {"a", "b"}


def test_life_and_list(place):
    folder, _, _, make = place
    for i, name in enumerate(["old", "new"]):
        (folder / name).write_text(name)
        os.utime(folder / name, (1000 + i, 1000 + i))
    w = make()
    w.start()
    try:
        assert w.status()["running"]
        with pytest.raises(RuntimeError):
            w.check()
    finally:
        w.stop()
    assert not w.status()["running"]
    w.check()
    listed = w.files().collect()
    assert [r.path.rsplit("/", 1)[1] for r in listed] == ["new", "old"] and all(len(r.short_hash) == 8 for r in listed)
