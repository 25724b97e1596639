"""Operators whose work is dealt out by joins, ranges and counts: p-values, pushes, ranks, sweeps of parameters."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from guildspark.operators import association as S
from guildspark.operators import community as C
from guildspark.operators import walks as WK


def two_sided(rho, n):
    """Student's t with n - 2 degrees of freedom as a finite sum of powers of a cosine."""
    if n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    theta, df = math.asin(abs(rho)), n - 2
    cos2, c, s = math.cos(theta) ** 2, 1.0, 0.0
    for k in range((df - 1) // 2 if df % 2 else df // 2):
        s += c
        c *= cos2 * ((2 * k + 2) / (2 * k + 3) if df % 2 else (2 * k + 1) / (2 * k + 2))
    return 1 - 2 / math.pi * (theta + math.sin(theta) * math.cos(theta) * s) if df % 2 else 1 - math.sin(theta) * s


def test_p_values(spark):
    rhos = [0.0, -0.001, 0.01, 0.05, -0.1, 0.2, 0.33, 0.5, 0.7, -0.9, 0.99, 0.99999, 1.0, -1.0]
    rows = [(r, n) for n in (0, 2, 3, 4, 5, 6, 9, 17, 30, 101, 1000, 20001) for r in rhos] + [(None, 9)]
    found = S.with_p(spark.createDataFrame(rows, "rho double, n long"))
    assert found.columns == ["rho", "n", "p"] and "sequence" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        want = None if r["rho"] is None else two_sided(r["rho"], r["n"])
        assert r["p"] == (want if want is None else pytest.approx(want, abs=1e-10)), r
    # far tails keep their size: asymptotically twice the normal tail
    far = S.with_p(spark.createDataFrame([(0.03, 10**6)], "rho double, n long")).first()["p"]
    z = 0.03 * math.sqrt((10**6 - 2) / (1 - 0.0009))
    assert far == pytest.approx(math.erfc(z / math.sqrt(2)), rel=2e-3)


def graph(seed, n=60, extra=150):
    rng = random.Random(seed)
    pairs = {(i, i - 1 - rng.randrange(min(i, 5))) for i in range(1, n)} | {tuple(sorted(rng.sample(range(n), 2), reverse=True)) for _ in range(extra)}
    return [("c", f"n{a:02}", f"n{b:02}", rng.choice([-1, 1]) * rng.uniform(0.3, 2.0)) for a, b in sorted(pairs)]


EDGE = "condition string, source string, target string, weight double"


def test_push_by_joins(spark):
    """Both vectors meet the invariant and the bar, and differ by no more than the residuals allow."""
    rows = graph(1) + [("hub", "h", f"x{i}", 1.0) for i in range(200)] + [("pair", "a", "b", 0.5)]
    edges = spark.createDataFrame(rows, EDGE)
    runs = spark.createDataFrame([(1, "c", "n00", 0.15, 1e-4), (2, "c", "n30", 0.1, 1e-3), (3, "hub", "x7", 0.15, 1e-4), (4, "pair", "a", 0.2, 1e-3), (5, "c", "nowhere", 0.15, 1e-4)], "run_id long, condition string, node string, alpha double, epsilon double")
    pushed = WK.push_by_joins(edges, runs, weighted=True).cache()
    audit = {r["run_id"]: r for r in WK.push_audit(edges, runs, pushed).collect()}
    assert sorted(audit) == [1, 2, 3, 4]
    assert all(r["gap"] < 1e-12 and r["over"] < 1 and r["converged"] for r in audit.values())
    assert [audit[k]["mass"] for k in (1, 2, 3)] == [pytest.approx(1.0)] * 3 and audit[4]["mass"] < 1  # degrees of 0.5 count as 1
    queued = C.push(edges, runs.withColumn("order_seed", F.lit(None).cast("long"))).cache()
    p = {(r["run_id"], r["node"]): r["p"] for r in pushed.collect()}
    q = {(r["run_id"], r["node"]): r["p"] for r in queued.collect()}
    left = {r["run_id"]: max(r["r"], 0) for r in pushed.groupBy("run_id").agg(F.sum("r").alias("r")).collect()}
    for key in set(p) | set(q):
        assert abs(p.get(key, 0) - q.get(key, 0)) <= left[key[0]] + 0.1
    assert all(r["gap"] < 1e-12 and r["over"] < 1 for r in WK.push_audit(edges, runs, queued).collect())


def test_push_that_does_not_settle(spark):
    edges = spark.createDataFrame(graph(2), EDGE)
    runs = spark.createDataFrame([(1, "c", "n00", 0.05, 1e-6)], "run_id long, condition string, node string, alpha double, epsilon double")
    some = WK.push_by_joins(edges, runs, max_steps=5, steps=2).cache()
    assert not some.first()["converged"] and WK.push_audit(edges, runs, some).first()["gap"] < 1e-12
    assert WK.push_by_joins(edges, runs.limit(0)).count() == 0 and WK.push_by_joins(edges.limit(0), runs).count() == 0


def test_large_graphs_go_through_joins(spark):
    """A condition over the limit is pushed by joins, another in queue order; the report says whether each settled."""
    rows = graph(3) + [("small", a, b, w) for _, a, b, w in graph(4, 12, 10)]
    edges = spark.createDataFrame(rows, EDGE)
    runs = spark.createDataFrame([(1, "c", "n00", 0.15, 1e-3, None), (2, "small", "n00", 0.15, 1e-3, None)], "run_id long, condition string, node string, alpha double, epsilon double, order_seed long")
    both = C.push_any(edges, runs, task_edges=100).cache()
    assert {r["run_id"] for r in both.collect()} == {1, 2} and all(r["gap"] < 1e-12 for r in WK.push_audit(edges, runs, both).collect())
    seeds = spark.createDataFrame([("c", "n00"), ("small", "n00"), ("none", "x")], "condition string, node string")
    report = C.cluster_with_report(edges, seeds.where("condition <> 'none'"), C.Ladder(b=3, min_cut_size=2))[2].collect()
    assert len(report) == 2 and all(r["push_converged"] and r["pushes"] > 0 for r in report)


def test_parameter_table(spark):
    """All settings, networks and weight modes in one plan find what one job per value finds."""
    from dataclasses import replace

    from guildspark.operators import experiments as XP

    rows = [("one", a, b, w) for _, a, b, w in graph(5, 30, 60)] + [("two", a, b, w) for _, a, b, w in graph(6, 24, 30)]
    edges = spark.createDataFrame(rows, EDGE)
    seeds = spark.createDataFrame([("one", "n00"), ("two", "n03")], "condition string, node string")
    base = C.Ladder(phi=0.6, b=3, alpha=0.15, min_cut_size=2)
    values = {"phi": [0.6, 0.3], "alpha": [0.3]}
    said, found = XP.parameter_table(edges, seeds, XP.sweep_settings(spark, base, values))
    got = {(r["network"], r["mode"], r["parameter"], r["value"]): (r["step"], r["size"], round(r["volume"] or 0, 9)) for r in said.collect()}
    assert len(got) == 2 * 2 * 3 and found.groupBy("setting").count().count() == 12
    runs = seeds.withColumn("order_seed", F.lit(None).cast("long")).withColumn("run_id", F.xxhash64("condition", "node"))
    for name, value in ((None, None), ("phi", 0.3), ("alpha", 0.3)):
        chosen = XP.clusters_of(edges, runs, base if name is None else replace(base, **{name: value}), weighted=True)[1]
        network = {r["run_id"]: r["condition"] for r in runs.collect()}
        for r in chosen.collect():
            assert got[(network[r["run_id"]], "weighted", name, value)] == (r["step"], r["size"], round(r["volume"] or 0, 9))


def test_plan_does_not_grow_with_the_settings(spark):
    from guildspark.operators import experiments as XP

    edges = spark.createDataFrame(graph(7, 12, 10), EDGE)
    vector = spark.createDataFrame([("c", f"n{i:02}", 1.0 / (i + 2)) for i in range(12)], "condition string, node string, p double")
    prefixes = C.sweep(edges, vector).cache()
    sizes = []
    for n in (1, 200):
        settings = XP.sweep_settings(spark, C.Ladder(phi=7.0, b=3), {"phi": [0.01 * (i + 1) for i in range(n)]}).selectExpr("xxhash64(parameter, value) as setting", "'c' as condition", "'n00' as node", "*")
        chosen = C.select_each(prefixes, settings)
        sizes.append(len([x for x in chosen._jdf.queryExecution().optimizedPlan().toString().splitlines()]))
        assert chosen.count() == n + 1
    assert sizes[0] == sizes[1]


def test_row_numbers(spark):
    from guildspark.operators import ranks

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 3.0]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(5)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    got = {(r["i"], r["place"]) for r in ranks.row_numbers(df, ["v", "i"]).collect()}
    assert got == {(r[2], k + 1) for k, r in enumerate(sorted(rows, key=key))}
    got = {(r["i"], r["place"]) for r in ranks.row_numbers(df, ["v", "i"], ["g"]).collect()}
    assert got == {(r[2], k + 1) for g in ("a", "b", None) for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=key))}
    down = {(r["i"], r["n"]) for r in ranks.row_numbers(df, [F.desc_nulls_last("v"), F.desc("i")], ["g"], "n").collect()}
    assert {n for i, n in down} == set(range(1, 1 + max(sum(r[0] == g for r in rows) for g in ("a", "b", None))))
    assert ranks.row_numbers(df.limit(0), ["v"]).count() == 0
    plan = ranks.row_numbers(df, ["v", "i"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan or "Exchange" in plan
    assert sorted(r["i"] for r in ranks.evenly_spaced(df, 4, ["i"]).collect()) == [0, 100, 199, 299]
    assert [r["i"] for r in ranks.first_rows(df, 2, ["i"]).collect()] == [0, 1]


def test_kendall_in_runs(spark):
    """Inversions give what all pairs of samples give, in one task and in runs over many."""
    rng = random.Random(9)
    rows = [("c", left, "y", i, float(rng.randint(0, span)), float(rng.randint(0, span) + i // 30)) for left, span, n in (("few", 2, 90), ("many", 500, 150), ("same", 0, 40), ("two", 9, 2), ("one", 9, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "condition string, left string, right string, sample_id long, x double, y double")
    want = {}
    for left in {r[1] for r in rows}:
        own = [(r[4], r[5]) for r in rows if r[1] == left]
        sign = lambda v: (v > 0) - (v < 0)
        s = [sign(a[0] - b[0]) * sign(a[1] - b[1]) for i, a in enumerate(own) for b in own[:i]]
        if s:
            want[left] = (pytest.approx(sum(s) / len(s), abs=1e-12), len(own))
    for run in (10, 60, 10**6):
        got = {r["left"]: (r["tau"], r["n"]) for r in S.kendall(df, run).collect()}
        assert got == want, run
    assert S.kendall(df.limit(0)).count() == 0


def test_inversions():
    import numpy as np

    rng = np.random.default_rng(10)
    for n in (0, 1, 2, 33, 200):
        v, g = rng.integers(0, 12, n), rng.integers(0, 3, n)
        later = lambda same: sum(v[i] > v[j] and (not same or g[i] == g[j]) for i in range(n) for j in range(i + 1, n))  # noqa: E731, B023
        assert S.inversions(v) == later(False) and S.inversions(v, g) == later(True)


def test_similar_sets(spark):
    from guildspark.operators import sets as ST

    rng = random.Random(11)
    pool = [frozenset(rng.sample(range(30), rng.randint(1, 12))) for _ in range(25)]
    runs = {i: rng.choice(pool) for i in range(60)} | {60 + i: frozenset(list(pool[i])[1:]) | {99} for i in range(10)}
    df = spark.createDataFrame([(i, f"n{x}") for i, s in runs.items() for x in s] + [(0, f"n{next(iter(runs[0]))}")], "run_id long, node string")
    for least in (0.3, 0.5, 0.75, 1.0):
        found = ST.similar_classes(ST.classes(df), least).collect()
        names = {s: min(i for i, t in runs.items() if t == s) for s in runs.values()}
        every = sorted(names.items(), key=lambda x: x[1])
        want = {}
        for k, (s, a) in enumerate(every):
            for t, b in every[k + 1 :]:
                j = len(s & t) / len(s | t)
                if j >= least - 1e-9:
                    want[(a, b)] = (len(s & t), pytest.approx(j), sum(x == s for x in runs.values()) * sum(x == t for x in runs.values()))
        assert {(r["class_a"], r["class_b"]): (r["shared"], r["jaccard"], r["pairs"]) for r in found} == want
    bars = {r["low"]: r["pairs"] for r in ST.jaccard_histogram(df, 0.5, 5).collect()}
    pairs = [len(runs[a] & runs[b]) / len(runs[a] | runs[b]) for a in runs for b in runs if a < b]
    assert sum(bars.values()) == len(pairs) and bars[None] == sum(j < 0.5 - 1e-9 for j in pairs)
    assert bars[max(k for k in bars if k is not None)] == sum(j >= 0.9 - 1e-9 for j in pairs)
    assert {r["class_id"] for r in ST.class_members(df).collect()} == set(names.values())
    with pytest.raises(ValueError):
        ST.similar_classes(ST.classes(df), 0)


def test_bitmaps(spark):
    """More nodes than a bucket holds, runs without a bucket, and an empty base."""
    from guildspark.operators import sets as ST

    runs = {"a": range(0, 40000), "b": range(30000, 70000), "c": [5, 35000, 69999]}
    df = spark.createDataFrame([(r, f"{x:06}") for r, xs in runs.items() for x in xs], "run_id string, node string").cache()
    row = ST.union_and_intersection(df).first()
    sets = [set(x) for x in runs.values()]
    assert (row["runs"], row["union_nodes"], row["intersection_nodes"]) == (3, len(set.union(*sets)), len(set.intersection(*sets)))
    base = spark.createDataFrame([(f"{x:06}",) for x in range(29990, 35001)], "node string")
    ground = set(range(29990, 35001))
    got = {r["run_id"]: (r["size"], r["shared"], r["jaccard"], r["escaped"]) for r in ST.against_base(df, base).collect()}
    assert got == {r: (len(s), len(s & ground), pytest.approx(len(s & ground) / len(s | ground)), len(s - ground)) for r, s in zip(runs, sets, strict=True)}
    assert all(r["shared"] == 0 and r["escaped"] == r["size"] for r in ST.against_base(df, base.limit(0)).collect())
    nested = spark.createDataFrame([("a", "a"), ("a", "s"), ("b", "s"), ("c", "x")], "seed string, node string")
    assert tuple(ST.recovery(nested, "s").first()) == (3, 2 / 3, 1 / 3) and tuple(ST.recovery(nested.limit(0), "s").first()) == (0, 0.0, 0.0)


def test_asymmetry_without_pairs_of_seeds(spark):
    from guildspark.operators import stability as T

    rng = random.Random(12)
    found = {(a, b) for a in range(25) for b in rng.sample(range(40), 6)}
    df = spark.createDataFrame(sorted(found), "seed long, node long")
    n = [0, 0, 0, 0]
    for a in range(25):
        for b in range(a + 1, 25):
            n[0 if (a, b) in found and (b, a) in found else 1 if (a, b) in found else 2 if (b, a) in found else 3] += 1
    assert list(T.asymmetry(df).first()) == n


def test_percentiles(spark):
    """As numpy's linear ones, with few and many bins, ties, one value, wide ranges and groups of null."""
    import numpy as np

    from guildspark.operators import selection as SEL
    from guildspark.operators import stability as T

    rng = np.random.default_rng(13)
    groups = {"even": rng.random(500), "ties": rng.integers(0, 3, 400).astype(float), "one": np.array([2.5]), "same": np.full(50, -1.0), "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 200), -(10.0 ** rng.uniform(-300, 308, 100)), [1.7e308, -1.7e308]]), None: rng.normal(size=90)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    shares = [0.0, 0.05, 0.33, 0.5, 0.95, 1.0]
    for how in ({}, {"bins": 4, "passes": 3, "few": 5}, {"bins": 16, "passes": 12, "few": 1}):
        keyed = df.select(F.struct("g").alias("g"), "v")
        got = {(r["g"]["g"], r["share"]): r["v"] for r in SEL.percentiles(keyed, shares, **how).collect()}
        assert len(got) == len(groups) * len(shares)
        for g, vs in groups.items():
            order = np.sort(vs)
            for s in shares:
                at = s * (len(vs) - 1)
                k = int(at)
                want = order[k] * (1 - (at - k)) + order[min(k + 1, len(vs) - 1)] * (at - k)
                assert got[(g, s)] == pytest.approx(want, rel=1e-12, abs=0), (g, s, how)
    odd = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("b", float("inf"))], "g string, v double")
    rows = {r["g"]: r for r in T.describe(odd, "v", ["g"]).collect()}
    assert rows["a"]["count"] == 1 and rows["a"]["median"] == 1.0 and rows["b"]["count"] == 0 and rows["b"]["median"] is None
    assert T.describe(odd, "v").first()["count"] == 1
    assert T.describe(odd.limit(0), "v").first()["count"] == 0 and T.describe(odd.limit(0), "v", ["g"]).count() == 0


def test_rank_correlations_count_equal_points_before_they_are_dealt_by_pair(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(1, 5, (400, 3)).astype(float)
    rows = [("c", i, f"f{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    found = S.spearman(S.pair_cells(spark.createDataFrame(rows, "condition string, sample_id long, feature string, value double")))
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    got = {(r["left"], r["right"]): (r["rho"], r["n"]) for r in found.collect()}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        rho, n = got[f"f{i}", f"f{j}"]
        assert n == 400 and abs(rho - np.corrcoef(rank(x[:, i]), rank(x[:, j]))[0, 1]) < 1e-12
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Window", 1)[1].rsplit("Window", 1)[1]
    assert "count(1) AS c" in below  # windows see counted points, not a row per sample


def test_a_report_of_no_dropped_features_has_no_list(spark):
    from guildspark.operators import abundance as A

    none = spark.createDataFrame([], "feature string")
    (row,) = A.drop_events(none, "filtered").withColumn("items", F.array_join("items", ",")).collect()
    assert (row["dropped"], row["items"], row["truncated"]) == (0, None, False)


def test_star_joins_are_dealt_over_more_partitions_as_the_table_grows(spark, monkeypatch):
    from guildspark.sources import demo

    sf = "/root/testdata/sf0.001"
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    few = demo.bacteria(spark, sf)
    assert few.rdd.getNumPartitions() <= 4
    monkeypatch.setattr(demo, "LANE_ROWS", 500)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    many = demo.bacteria(spark, sf)
    assert n > 8 and many.rdd.getNumPartitions() == n and rows(many) == rows(few)
    assert demo.bacteria_labels(spark, sf).rdd.getNumPartitions() == n


def test_pairs_are_dealt_over_more_partitions_as_cells_grow(spark):
    cells = spark.range(60).selectExpr("'c' as condition", "id div 3 as sample_id", "concat('f', id % 3) as feature", "cast(id * 7 % 11 as double) as value")
    own = {(r["left"], r["right"]): (r["rho"], r["n"]) for r in S.spearman(S.pair_cells(cells)).collect()}
    dealt = S.spearman(S.pair_cells(cells, 9), 9)
    assert {(r["left"], r["right"]): (r["rho"], r["n"]) for r in dealt.collect()} == own and len(own) == 3
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", 9") >= 3


def test_all_correlations_deal_pairs_evenly_as_cells_grow(spark, monkeypatch):
    from guildspark.plans import catalog as K

    sf, by = "/root/testdata/sf0.001", ["condition", "left", "right"]
    rows = lambda name: sorted(tuple(r) for r in K.QUERIES[name](spark, sf).collect())
    names = ("ag6_spearman", "flt12_significant_edges", "jn4_cross_domain_spearman", "so6_both_domain_pairs")
    few = {name: rows(name) for name in names}
    monkeypatch.setattr(K, "PAIR_LANE_ROWS", 100)
    assert {name: rows(name) for name in names} == few and all(few.values())
    for name in names:
        assert "RepartitionByExpression" in K.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # forty pairs of 25 points over forty partitions: none gets more than a few, nearly all get some
    cells = spark.range(250).selectExpr("concat('c', id % 2) as condition", "id div 10 as sample_id", "concat('f', id div 2 % 5) as feature", "cast(id * 7919 % 997 as double) as value")
    shares = []
    points = type(cells).repartitionByRange
    monkeypatch.setattr(type(cells), "repartitionByRange", lambda self, n, *c: shares.append([r["n"] for r in points(self, n, *c).groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct(*by).alias("n")).collect()]) or points(self, n, *c))
    assert S.spearman(S.pair_cells(cells, 20), 20).count() == 20
    assert len(shares) == 1 and max(shares[0]) <= 3 and sum(shares[0]) == 20
