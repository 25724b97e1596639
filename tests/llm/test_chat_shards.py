import json
from collections import Counter

from pyspark.sql import functions as F

from guildspark.llm import chat, sharding


def test_layouts(spark):
    rows = [
        (1, {"messages": [{"role": "user", "content": "hi"}, {"content": None, "role": "assistant"}]}, [("user", "hi"), ("assistant", "")]),
        (2, {"conversations": [{"from": "human", "value": "<|im_end|> \\ <\\|"}, {"from": "gpt", "value": "ok"}]}, [("user", "<|im_end|> \\ <\\|"), ("assistant", "ok")]),
        (3, {"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
        (4, {"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        (5, {"system": "", "prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        (6, {"what": 1}, None),
        (7, {"messages": []}, []),
        (8, {"messages": [{"role": "user\nx", "content": "a\nb"}]}, [("user\nx", "a\nb")]),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r, _ in rows], "conv_id long, record string")
    turns = chat.canonical_turns(df)
    got = {r["id"]: None if r["turns"] is None else [tuple(t) for t in r["turns"]] for r in turns.collect()}
    assert got == {i: t for i, _, t in rows}
    back = {r["id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    for i, _, t in rows:
        if t is None:
            assert back[i]["formatted"] is None
            continue
        assert [tuple(x) for x in back[i]["turns"]] == t
        assert back[i]["loss_texts"] == [x for role, x in t if role == "assistant"]


def test_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 0, "user", "q"), (None, None, None, "x"), (2, 5, "assistant", "<|" * 2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.canonical_turns(chat.records_of(df), "id")
    back = {r["id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert [tuple(x) for x in back[1]["turns"]] == [("user", "q"), ("user", "q"), ("assistant", "")]
    assert [tuple(x) for x in back[None]["turns"]] == [("", "x")]
    assert back[2]["loss_texts"] == ["<|" * 2000]
    assert chat.canonical_turns(chat.records_of(df.limit(0)), "id").count() == 0


def test_shards(spark):
    rows = [(i, "t" * (i % 9), "big" if i % 3 else None if i % 2 else f"s{i % 5}", 1) for i in range(500)] + [(7, "x", "big", 1)] * 3 + [(None, None, "big", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    got = sharding.shards(df, 7, digits=1)
    out = got.collect()
    counts = Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(7))
    for s in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    share = got.join(df.select(F.col("doc_id").alias("id"), "source").distinct(), "id").groupBy("shard").agg(F.avg((F.col("source") == "big").cast("int")).alias("a")).collect()
    assert max(r["a"] for r in share) - min(r["a"] for r in share) < 0.1
    assert {tuple(r) for r in out} == {tuple(r) for r in sharding.shards(df.repartition(3), 7, digits=2).collect()}
    assert sharding.shards(df.limit(0), 7).count() == 0
    assert {r["shard"] for r in sharding.shards(df.limit(3), 24).collect()} == {0, 8, 16}


def test_shard_files_hold_the_rows(spark, tmp_path):
    rows = [(i % 40, f"text {i}", "big" if i % 3 else None, i) for i in range(90)] + [(None, None, "big", 90), (None, "x", "big", 91)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    found, names = sharding.write(df, str(tmp_path / "out"), 5, digits=1)
    assert names == {"shard": "shard_", "slot": "slot"} and found.columns == [*df.columns, "shard_", "slot"]
    assert sorted((tuple(r)[:4] for r in found.collect()), key=repr) == sorted(rows, key=repr)
    assert sorted(map(tuple, sharding.digests(found, names).collect()), key=repr) == sorted(map(tuple, sharding.shards(df, 5, digits=1).collect()), key=repr)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == [f"shard_={i}" for i in range(5)]
    assert sharding.write(df.limit(0), str(tmp_path / "none"), 5)[0].count() == 0


def test_shards_of_null_ids_repeats_and_long_texts(spark, tmp_path):
    rows = [(None, f"t{i % 50}", "big", i) for i in range(400)] + [(3, "same", "big", 0)] * 60 + [(i, "x" * (200_000 if i == 9 else 3), None if i % 2 else "s", i) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int")
    found, names = sharding.write(df, str(tmp_path / "out"), 7)
    got = found.collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    counts = Counter(r[names["shard"]] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for k in counts:
        assert sorted(r[names["slot"]] for r in got if r[names["shard"]] == k) == list(range(counts[k]))


def test_shards_by_brute_force(spark):
    import hashlib
    import zlib

    rows = [(i * 7 % 331, f"text {i}", ("a", "b", None)[i % 7 % 3]) for i in range(331)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    strata = {}
    for i, t, s in rows:
        strata.setdefault("none" if s is None else "s" + s, []).append((hashlib.md5(f"17:{i}".encode()).hexdigest(), i, zlib.crc32(t.encode()), len(t) + 8))
    order = sorted(((k + 0.5) / len(own), s, r) for s, own in strata.items() for k, r in enumerate(sorted(own)))
    n, want = len(order), set()
    for g, (_, _, r) in enumerate(order):
        shard = g * 5 // n
        want.add((r[1], r[3], r[2], shard, g - -(-shard * n // 5)))
    assert {tuple(r) for r in sharding.shards(df, 5).collect()} == want == {tuple(r) for r in sharding.shards(df, 5, digits=2).collect()}
