"""File sources and sinks, and what the jobs make of odd files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from guildspark.operators import abundance as A
from guildspark.operators import association as S
from guildspark.operators import community as C
from guildspark.operators import network as N
from guildspark.operators import stability as T
from guildspark.plans import analyze as J
from guildspark.sources import sinks, tables


def test_blank_samples_count(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sample,f1,f2\ns1,1,2\ns2,3,4\ns3,,\n")
    t = tables.load_abundance(spark, [str(tmp_path / "a.csv")])
    ids = tables.sample_ids(spark, [str(tmp_path / "a.csv")])
    assert {r[0] for r in ids.collect()} == {"s1", "s2", "s3"}
    got = {r["feature"]: r for r in A.feature_metrics(t, samples=ids).collect()}
    assert got["f1"]["n_samples"] == 3 and got["f1"]["prevalence"] == pytest.approx(2 / 3)
    assert got["f1"]["mean_relative"] == pytest.approx((1 / 3 + 3 / 7) / 3)


def test_pairs_keep_the_order_of_the_file(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, (20, 3))
    (tmp_path / "a.csv").write_text("sample,zeta,beta,alpha\n" + "".join(f"S{i}," + ",".join(map(str, r)) + "\n" for i, r in enumerate(x)))
    (tmp_path / "m.csv").write_text("sample,Combination_treat2\n" + "".join(f"S{i},{'A' if i % 2 else 'B'}\n" for i in range(20)))
    job = J.Request("bacteria", ("A", "B"), bacteria=(str(tmp_path / "a.csv"),), metadata=(str(tmp_path / "m.csv"),))
    pairs = J.analyze(spark, job)["pairs"]
    got = {(r["left"], r["right"]): r["n"] for r in pairs.where("condition = 'A'").collect()}
    assert got == {("zeta", "beta"): 10, ("zeta", "alpha"): 10, ("beta", "alpha"): 10}


def test_b_of_each_condition(spark):
    rows = [("small", f"a{i}", f"a{j}", 1.0) for i in range(6) for j in range(i)] + [("large", f"n{i}", f"n{j}", 1.0) for i in range(60) for j in range(i) if (i // 20 == j // 20) or (i + j) % 29 == 0]
    e = spark.createDataFrame(rows, "condition string, source string, target string, weight double")
    seeds = spark.createDataFrame([("small", "a1"), ("large", "n1")], "condition string, node string")
    b = {r["condition"]: r["b"] for r in N.graph_stats(e).select("condition", C.default_b(F.col("node_count"), F.col("edge_count")).alias("b")).collect()}
    assert b["small"] < b["large"]
    members, chosen = C.cluster(e, seeds, None)
    both = {r["condition"]: r for r in chosen.collect()}
    for condition, size in b.items():
        alone = C.cluster(e.where(F.col("condition") == condition), seeds.where(F.col("condition") == condition), C.Ladder(b=size))[1].first()
        assert {k: both[condition][k] for k in ("step", "size", "floor_used")} == {k: alone[k] for k in ("step", "size", "floor_used")}
    own = members.where("condition = 'large'").orderBy("rank").collect()
    assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and own[0]["node"] == "n1"


def test_push_by_definition(spark):
    rng = np.random.default_rng(2)
    rows = [("c", f"n{i:02d}", f"n{j:02d}", float(rng.uniform(0.2, 2))) for i in range(20) for j in range(i) if rng.random() < 0.3 or j == i - 1]
    e = spark.createDataFrame(rows, "condition string, source string, target string, weight double")
    runs = spark.createDataFrame([(k, "c", "n03", 0.2, 1e-6, k or None) for k in range(4)], "run_id long, condition string, node string, alpha double, epsilon double, order_seed long")
    names = sorted({x for r in rows for x in r[1:3]})
    w = np.zeros((len(names), len(names)))
    for _, a, b, x in rows:
        w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = x
    d = np.maximum(1, w.sum(axis=1))
    lazy = (np.eye(len(names)) + w / d[:, None]) / 2
    want = 0.2 * np.linalg.inv(np.eye(len(names)) - 0.8 * lazy)[names.index("n03")]
    for k in range(4):
        got = {r["node"]: r for r in C.push(e, runs).where(F.col("run_id") == k).collect()}
        assert all(r["converged"] for r in got.values())
        assert max(abs(want[i] - (got[n]["p"] if n in got else 0)) for i, n in enumerate(names)) < 1e-6 * d.sum()
        assert all(r["r"] < 1e-6 * d[names.index(n)] for n, r in got.items())


def test_edge_files(spark, tmp_path):
    (tmp_path / "e.txt").write_text("row source target weight p\n1 a b 0.5 0.01\n2 a c -0.1 0.2\n\n3 b c 0.9 0.5\n")
    got = tables.read_edge_list(spark, str(tmp_path / "e.txt"), 0.2, 0.3).collect()
    assert [(r["source"], r["target"], r["weight"], r["p"]) for r in got] == [("a", "b", 0.5, 0.01)]
    (tmp_path / "bad.txt").write_text("row source target weight p\n1 a b\n")
    with pytest.raises(Exception, match="malformed"):
        tables.read_edge_list(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "e.csv").write_text("source,target,correlation\na,b,0.5\na,a,0.9\n,b,0.2\na,c,x\n")
    rows, skipped = tables.read_edge_csv(spark, str(tmp_path / "e.csv"))
    assert [tuple(r) for r in rows.collect()] == [("a", "b", 0.5, None)] and tuple(skipped.first()) == (2, 1)
    with pytest.raises(ValueError):
        tables.read_edge_csv(spark, str(tmp_path / "e.txt"))
    (tmp_path / "m.csv").write_text("x,a,b\na,1,0.3\nb,0.3,1\n")
    assert {tuple(r) for r in tables.read_square_matrix(spark, str(tmp_path / "m.csv")).collect()} == {("a", "a", 1.0), ("a", "b", 0.3), ("b", "a", 0.3), ("b", "b", 1.0)}
    (tmp_path / "m1.csv").write_text("sample,Group,Other\ns1,A,1\ns2,B,2\n")
    (tmp_path / "m2.csv").write_text("sample;Group;More\ns3;A;1\n")
    assert tables.common_columns(spark, [str(tmp_path / "m1.csv"), str(tmp_path / "m2.csv")]) == ["sample", "Group"]
    assert tables.count_samples(tables.load_metadata(spark, [str(tmp_path / "m1.csv"), str(tmp_path / "m2.csv")], "Group")) == 3


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("c", "a", "b", 0.5, 0.01, "spieceasi"), ("c", "b", "d", 0.4, None, "spearman")], "condition string, source string, target string, weight double, p double, method string")
    key = sinks.graph_cache_key("job", "c", "spieceasi", 0.05, 0.0, sinks.dataset_fingerprint(["y", "x"]))
    assert sinks.dataset_fingerprint(["x", "y"]) == sinks.dataset_fingerprint(["y", "x"])
    sinks.write_graph(e, str(tmp_path / "g"), key)
    assert {r["source"]: r["p"] for r in sinks.read_graph(spark, str(tmp_path / "g"), key).collect()} == {"a": 0.01, "b": None}
    e.withColumn("cache_version", F.lit(1)).write.parquet(str(tmp_path / "g" / "cache_key=old"))
    assert {r["source"]: r["p"] for r in sinks.read_graph(spark, str(tmp_path / "g"), "old").collect()} == {"a": None, "b": None}
    both = sinks.union_by_keys([e.select("source"), e.select("source", "weight")])
    assert both.columns == ["source", "weight"] and both.count() == 4
    cells = spark.createDataFrame([("s1", "f1", 2.0), ("s2", "f1", 3.0), ("s2", "f2", 4.0)], "sample_id string, feature string, value double")
    assert {r["feature"]: (r["s1"], r["s2"]) for r in sinks.count_matrix(cells, ["f1", "f2"]).collect()} == {"f1": (2.0, 3.0), "f2": (0.0, 4.0)}
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")
    assert [r[0] for r in odd.select(sinks.json_safe(F.col("x"))).collect()] == [1.0, None, None]
    assert sinks.markdown(e.select("source", "weight").orderBy("source")).splitlines() == ["| source | weight |", "| --- | --- |", "| a | 0.5 |", "| b | 0.4 |"]
    sinks.export(e.withColumn("more", F.array(F.lit(1))), str(tmp_path / "x"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).count() == 2
    for bad in (("csv", e.limit(0)), ("xml", e)):
        with pytest.raises(ValueError):
            sinks.export(bad[1], str(tmp_path / "y"), bad[0])


def test_reports(spark):
    assert A.describe_filter(A.TaxaFilter()) == "no taxa filtering" and "20 %" in A.describe_filter(A.PRESETS["balanced"])
    names = spark.createDataFrame([(f"t{i:03d}",) for i in range(60)], "feature string")
    r = A.drop_events(names, "constant").first()
    assert r["dropped"] == 60 and r["truncated"] and r["items"] == [f"t{i:03d}" for i in range(50)]
    assert A.drop_events(names.limit(0), "constant").first()["dropped"] == 0
    assert T.above_chance(0.5, 10, 100) == pytest.approx((0.5 - 10 / 190) / (1 - 10 / 190)) and T.above_chance(1.0, 100, 100) == 0.0
    tried = spark.createDataFrame([(None, 0.0, 1.0, 0.5, 0.5), ("b", 1.0, 0.95, 0.7, 0.7), ("b", 2.0, 0.95, 0.7, 0.7), ("b", 3.0, 0.5, 0.9, 0.9), ("phi", 1.0, 1.0, 0.4, 0.4)], "parameter string, value double, strict_rate double, jaccard_above double, support_above double")
    got = T.best_parameters(T.stability_scores(tried)).collect()
    assert [(r["parameter"], r["value"], round(r["gain"], 9)) for r in got] == [("b", 1.0, 0.2)]
    pairs = spark.createDataFrame([("c", "a", "b", 0.5), ("c", "a", "x", 0.1)], "condition string, left string, right string, rho double")
    order = spark.createDataFrame([("b", 1), ("a", 2)], "feature string, place int")
    assert {(r["left"], r["right"]) for r in S.oriented(pairs, order).collect()} == {("b", "a"), ("a", "x")}
