"""Stores whose state is the last of a row of notes: interleaved writers, aborted writes, reuse."""

import threading

import pytest

from guildspark.sources import commits, sinks


def entry(spark, i, at=1):
    return spark.createDataFrame([(i, i, "completed", at)], "id string, analysis_name string, status string, updated_at long")


def test_notes_are_written_once(spark, tmp_path):
    notes = commits.Notes(spark, str(tmp_path / "n"))
    assert notes.names() == [] and notes.get("a") is None
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if notes.put("a", str(k)) else None) for k in range(20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and notes.get("a") == str(won[0]) and notes.names() == ["a"]
    assert notes.put("b", "é") and notes.get("b") == "é" and not notes.put("b", "x")


def test_notes_through_hadoop(spark, tmp_path):
    notes = commits.Notes(spark, str(tmp_path / "h"))
    notes.local = None  # as in a store that only Spark reaches
    assert notes.names() == [] and notes.get("a") is None
    assert notes.put("a", "one") and not notes.put("a", "two")
    assert notes.get("a") == "one" and notes.names() == ["a"]


def test_two_writers_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "archive")
    first, second = sinks.Archive(spark, root), sinks.Archive(spark, root)
    first.upsert(entry(spark, "a"))
    calls = []
    original = first._of

    def overtaken(folder):
        """The other writer commits between this one's reading and its note, once."""
        found = original(folder)
        if not calls:
            calls.append(folder)
            second.upsert(entry(spark, "b", 2))
        return found

    first._of = overtaken
    first.upsert(entry(spark, "c", 3))
    first._of = original
    assert [r["id"] for r in first.entries().collect()] == ["c", "b", "a"]
    assert first.versions.latest()[0] == 3
    first.remove(["b"])
    assert [r["id"] for r in second.entries().collect()] == ["c", "a"]


def test_aborted_write_leaves_the_former_state(spark, tmp_path):
    root = str(tmp_path / "archive")
    h = sinks.Archive(spark, root)
    h.upsert(entry(spark, "a"))
    with pytest.raises(Exception, match="lost"):
        h.versions.change(lambda folder: spark.sql("select raise_error('lost') as id"))
    assert [r["id"] for r in h.entries().collect()] == ["a"]
    h.upsert(entry(spark, "b", 5))
    assert {r["id"] for r in h.entries().collect()} == {"a", "b"}
    always = commits.Versions(spark, root)
    always.notes.put = lambda name, text: False
    with pytest.raises(RuntimeError):
        always.change(lambda folder: spark.range(1), tries=2)


def test_log_of_a_first_release(spark, tmp_path):
    root = str(tmp_path / "old")
    sinks.normalized(entry(spark, "old")).write.parquet(f"{root}/v7-x")
    spark.createDataFrame([(7, "v7-x")], "version long, folder string").coalesce(1).write.json(f"{root}/_log")
    h = sinks.Archive(spark, root)
    h.upsert(entry(spark, "new", 9))
    assert h.versions.latest()[0] == 8 and {r["id"] for r in h.entries().collect()} == {"old", "new"}


def test_reuse(spark, tmp_path):
    root, made = str(tmp_path / "runs"), []

    def make():
        made.append(1)
        return spark.range(3)

    with pytest.raises(Exception, match="lost"):
        commits.get_or_make(spark, root, "k", lambda: spark.sql("select raise_error('lost') as id"))
    assert commits.get_or_make(spark, root, "k", make).count() == 3
    assert commits.get_or_make(spark, root, "k", make).count() == 3 and len(made) == 1
    assert commits.get_or_make(spark, root, "other", lambda: spark.range(0)).count() == 0

    def slow():
        commits.get_or_make(spark, root, "race", lambda: spark.range(5))
        return spark.range(9)

    assert commits.get_or_make(spark, root, "race", slow).count() == 5
