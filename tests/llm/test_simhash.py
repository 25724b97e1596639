import random
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from guildspark.llm import simhash
from guildspark.llm.common import join_counted
from guildspark.llm.components import components


def brute_fp(t, size=4):
    w = (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(rows, radius):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_masks_cover():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    rng = random.Random(1)
    for _ in range(2000):
        bits = sum(1 << i for i in rng.sample(range(64), 4))
        assert any(not m & bits for m in masks)
        assert any(not m & bits for m in simhash.block_masks(masks[3], 4) if not masks[3] & bits) or masks[3] & bits


def test_texts(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("ab cd efg hi jkl mno".split()) for _ in range(60)) for _ in range(6)]
    docs = [(i, None if i == 3 else "" if i == 4 else " \t" if i == 5 else rng.choice(base) + rng.choice(["", " x", " Y zz"])) for i in range(60)] + [(7, "dup row"), (7, "dup row"), (99, "One two"), (100, "long " * 30000)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    assert sorted((r["id"], r["fp"] & (1 << 64) - 1) for r in got) == sorted((d, brute_fp(t)) for d, t in docs)
    assert {(r["id"], r["component"]) for r in got if r["id"] != 7} == {(i, c) for i, c in closure([(r["id"], r["fp"] & (1 << 64) - 1) for r in got], 4).items() if i != 7}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_dense_ball(spark):
    rng, rows = random.Random(3), set()
    for c in (0, 0xFFFF0000FFFF0000, 0x123456789ABCDEF0):
        for _ in range(40):
            rows.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    rows = sorted(rows)
    df = spark.createDataFrame([(simhash.signed(x),) for x in rows], "fp long")
    want = closure([(i, x) for i, x in enumerate(rows)], 4)
    for dense in (8,):
        found = components(simhash.links(df, 4, dense), "a", "b").collect()
        groups = defaultdict(set)
        for r in found:
            groups[r["root"]].add(r["node"] & (1 << 64) - 1)
        ref = defaultdict(set)
        for i, c in want.items():
            ref[c].add(rows[i])
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in ref.values() if len(g) > 1)


def test_components_chain(spark):
    n = 40
    df = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(100, 101), (5, 5), (None, 3)], "u long, v long")
    assert {(r["node"], r["root"]) for r in components(df).collect()} == {(i, 0) for i in range(n + 1)} | {(100, 100), (101, 100)}
    assert components(df.limit(0)).count() == 0


def test_ball_with_many_levels(spark):
    """More fingerprints of one key than a task may gather, at several levels, and ids that are null or shared."""
    rng = random.Random(5)
    rows = sorted({sum(1 << b for b in rng.sample(range(20), rng.randint(0, 6))) for _ in range(400)})
    df = spark.createDataFrame([(x,) for x in rows], "fp long")
    want = closure(list(enumerate(rows)), 4)
    root = {r["node"]: r["root"] for r in components(simhash.links(df, 4, 40), "a", "b").collect()}
    assert {x: root.get(x, x) for x in rows} == {rows[i]: rows[c] for i, c in want.items()}
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, None), (4, ""), (9, " ")], "doc_id long, text string")
    got = sorted(((r["id"], r["component"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(4, 4), (4, 4), (9, 4), (None, None), (None, None)]


def test_one_key_over_many_tasks(spark):
    n = 3000
    rows = spark.range(n).selectExpr("id", "if(id % 3 = 0, 7, id) as k", "id as n_of")
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("twice", F.col("k") * 2)
    got = join_counted(rows, keyed, ["k"], n, F.xxhash64("id"))
    assert got.count() == n and got.where("twice = 2 * k").count() == n
    some = keyed.where("k = 7")
    left = join_counted(rows, some, ["k"], n, F.xxhash64("id"), "left")
    assert left.count() == n and left.where("twice is not null").count() == rows.where("k = 7").count()
    star = spark.range(1, n).selectExpr("id as u", "0L as v")
    assert {(r["root"]) for r in components(star).collect()} == {0} and components(star).count() == n
