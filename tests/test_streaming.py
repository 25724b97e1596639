"""Streams of samples give what the same rows give as a table; rows that come too late are dropped."""

import datetime as dt

import numpy as np
import pytest

from guildspark.streaming import incremental as ST

SCHEMA = "ts timestamp, condition string, sample_id long, cells array<struct<feature:string,value:double>>"


def samples(seed=1, n=240):
    rng = np.random.default_rng(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        base = rng.normal()
        cells = [(f, float(v)) for f, v in (("a", 5 + base), ("b", 9 - base + rng.normal() / 3), ("c", rng.integers(0, 3)), ("d", 2.0)) if rng.random() < 0.8]
        rows.append((start + dt.timedelta(minutes=30 * i), ["one", "two"][int(rng.integers(2))], i, cells + ([("e", None)] if i % 5 == 0 else [])))
    return rows


def stream(spark, tmp_path, name, parts, make):
    """Runs make(stream) over files that come one after the other, and returns what it wrote."""
    source = tmp_path / name
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"{k:02}"))
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    q = make(read).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def rounded(df):
    return {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()}


@pytest.mark.parametrize("logs", [False, True])
def test_correlations_follow_the_stream(spark, tmp_path, logs):
    rows = samples()
    closing = [(rows[-1][0] + dt.timedelta(days=9), "one", -1, [("z", 1.0)])]
    make = lambda df: ST.windowed_correlations(df, logs=logs)
    parts = [rows[:100], rows[100:180], rows[180:], closing, closing]
    got = rounded(stream(spark, tmp_path, f"corr{int(logs)}", parts, make))
    want = rounded(make(spark.createDataFrame(rows, SCHEMA)))
    assert got == want and len(want) > 10
    one = next(r for r in want if (r[1], r[2], r[3]) == ("one", "a", "b"))
    day = [dict(c) for ts, cond, _, c in rows if cond == "one" and ts.date() == one[0].date()]
    both = np.array([(d["a"], d["b"]) for d in day if "a" in d and "b" in d])
    assert one[5] == len(both) and one[4] == pytest.approx(np.corrcoef(np.log(both.T) if logs else both.T)[0, 1], abs=1e-8)
    assert not any("d" in (r[2], r[3]) or "e" in (r[2], r[3]) for r in want)  # constant, or without a value


def test_overabundance_follows_the_stream_and_late_rows_are_dropped(spark, tmp_path):
    rows = samples(2)
    closing = [(rows[-1][0] + dt.timedelta(days=9), "one", -1, [("z", 1.0)])]
    late = [(rows[0][0], "one", -2, [("a", 1e9)])]
    make = lambda df: ST.windowed_overabundance(df, ["one", "two", "absent"])
    got = rounded(stream(spark, tmp_path, "over", [rows[:120], rows[120:], closing, late, closing], make))
    want = rounded(make(spark.createDataFrame(rows, SCHEMA)))
    assert {r for r in got if r[1] != "z"} == want
    assert {r[3] for r in want if r[2] == "absent"} == {0.0}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ST.windowed_correlations(none).count() == 0 and ST.windowed_overabundance(none, ["one"]).count() == 0
    bare = spark.createDataFrame([(dt.datetime(2024, 1, 1), "one", 1, []), (dt.datetime(2024, 1, 1), None, 1, None)], SCHEMA)
    assert ST.windowed_correlations(bare).count() == 0 and ST.windowed_overabundance(bare, ["one"]).count() == 0
