"""Clustering jobs, stored graphs and snapshots, configurations and what stands between jobs."""

import json

import pytest
from pyspark.sql import functions as F

from guildspark.operators import abundance as A
from guildspark.operators import community as C
from guildspark.operators import experiments as XP
from guildspark.operators import network as N
from guildspark.plans import analyze as J
from guildspark.sources import sinks, tables

E = "condition string, source string, target string, weight double"


@pytest.fixture(scope="module")
def planted(spark):
    """Three dense groups of ten nodes with a few links between them, in one condition; the other has the first group only."""
    rows = [("A", f"n{i:02d}", f"n{j:02d}", 1.0) for i in range(30) for j in range(i) if i // 10 == j // 10 or (i + j) % 23 == 0]
    rows += [("B", f"n{i:02d}", f"n{j:02d}", -0.5) for i in range(10) for j in range(i)]
    return spark.createDataFrame(rows, E).cache()


def test_clustering_job(spark, planted, tmp_path):
    job = J.Clustering.from_json(json.dumps({"seed": "n12", "phi": 0, "alpha": -1, "b": None, "weighted": True, "overrides": {"b": 4, "phi": None}}))
    assert job.ladder == C.Ladder(phi=C.DEFAULT_PHI, b=4, alpha=C.DEFAULT_ALPHA) and job.clamped == {"phi": 0, "alpha": -1}
    out = J.run_clustering(planted, job)
    assert {r[0] for r in out["members"].select("node").collect()} == {f"n{i}" for i in range(10, 20)}
    report = out["report"].collect()
    assert len(report) == 1 and report[0]["condition"] == "A"
    r = report[0]
    assert r["satisfied"] and r["strategy"] == "target_conductance" and r["conditions_met"] == 3 and r["failed_conditions"] == [] and r["evaluated"] > 0
    assert r["conductance"] == pytest.approx(r["score"])
    assert {tuple(x) for x in out["presence"].collect()} == {("A", True), ("B", False)}
    for bad in ({"seed": ""}, {"seed": "x", "profile": "recommended"}):
        with pytest.raises(ValueError):
            J.Clustering(**bad)
    stored = planted.withColumn("p", F.lit(None).cast("double")).withColumn("method", F.lit("spearman"))
    sinks.write_graph(stored, str(tmp_path), "k")
    again = J.recluster(spark, str(tmp_path), "k", job)
    assert again["members"].exceptAll(out["members"]).count() == 0 and again["members"].count() == 10


def test_seed_alone(planted):
    e = planted.where("condition = 'B'")
    r = J.run_clustering(e, J.Clustering("n01", b=2, signed=True))["report"].first()
    assert (r["step"], r["strategy"], r["failed_conditions"]) == (0, "seed_singleton_fallback", ["volume_ok", "prob_ok", "phi_ok"]) and r["conductance"] == float("inf") and r["neg_inside"] == 0.0


def test_configurations(spark, planted, tmp_path):
    seeds = spark.createDataFrame([("A", "n12"), ("A", "n01")], "condition string, node string")
    base, tuned = C.Ladder(b=4), C.Ladder(b=3, phi=0.5)
    want = {tuple(r) for r in XP.configurations(planted, seeds, base, tuned).collect()}
    got = XP.compare_configurations(planted, seeds, base, tuned, str(tmp_path / "runs"), "g")
    assert {tuple(r) for r in got.collect()} == want and {r[0] for r in want} == set(XP.CONFIGURATIONS)
    read = XP.compare_configurations(planted.limit(0), seeds, base, tuned, str(tmp_path / "runs"), "g")
    assert {tuple(r) for r in read.collect()} == want  # nothing ran: the graph given is empty


def test_graph_documents(spark, tmp_path):
    doc = {"nodes": [{"id": "x"}], "edges": [{"source": "a", "target": "b", "correlation": 0.5, "weight": 9}, {"source": "a", "target": "c", "weight": -0.25, "p_value": 0.1}, {"source": "b", "target": "c"}, {"source": "", "target": "c"}, {"target": "c"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    nodes, edges = tables.read_graph_documents(spark, str(tmp_path / "g.json"))
    assert {tuple(r) for r in edges.collect()} == {("a", "b", 0.5, None), ("a", "c", -0.25, 0.1), ("b", "c", 0.0, None)}
    assert {r[0] for r in nodes.collect()} == {"x", "a", "b", "c"}
    path = str(tmp_path / "g.json")
    assert [r["length"] for r in tables.describe_files(spark, [path, path]).collect()] == [(tmp_path / "g.json").stat().st_size]


def test_two_metadata_tables(spark, tmp_path):
    value = lambda i, k: (i * 7 + k * k * 3) % 11
    (tmp_path / "b.csv").write_text("sample,b1,b2\n" + "".join(f"S{i},{value(i, 1)},{value(i, 2)}\n" for i in range(12)))
    (tmp_path / "f.csv").write_text("sample,f1,f2\n" + "".join(f"S{i},{value(i, 3)},{value(i, 4)}\n" for i in range(2, 14)))
    (tmp_path / "mb.csv").write_text("sample,G\n" + "".join(f"S{i},{'XY'[i % 2]}\n" for i in range(12)))
    (tmp_path / "mf.csv").write_text("sample,G\n" + "".join(f"S{i},{'Y' if i == 4 else 'XY'[i % 2]}\n" for i in range(14)))
    p = lambda n: (str(tmp_path / n),)
    job = J.Request("both", ("X", "Y"), bacteria=p("b.csv"), fungi=p("f.csv"), metadata=p("mb.csv"), fungi_metadata=p("mf.csv"), condition_column="G")
    out = J.analyze(spark, job)
    n = {(r["condition"], r["left"], r["right"]): r["n"] for r in out["pairs"].collect()}
    assert n["X", "bac::b1", "bac::b2"] == 6 and n["X", "bac::b1", "fun::f1"] == 4 and n["Y", "fun::f1", "fun::f2"] == 7  # S4 is X in one table only
    assert {r["condition"] for r in out["samples"].collect()} == {"X", "Y"}
    meta = A.merged_metadata(tables.load_metadata(spark, list(job.metadata), "G"), tables.load_metadata(spark, list(job.fungi_metadata), "G"))
    assert {r["condition"]: r["count"] for r in meta.groupBy("condition").count().collect()} == {"X": 7, "Y": 7}  # S4 keeps the bacteria's X
    sinks.write_result(out, job.to_json(), str(tmp_path / "out"))
    doc = json.loads(next((tmp_path / "out" / "document").glob("part-*")).read_text())
    assert doc["success"] and json.loads(doc["request"])["dataset"] == "both" and "pairs" in doc["tables"] and len(doc["samples"]) == 2
    sinks.write_pairs(out["pairs"], str(tmp_path / "pairs"))
    assert set(spark.read.option("header", True).csv(str(tmp_path / "pairs")).columns) == {"condition", *sinks.PAIR_COLUMNS}


def test_pair_table_of_selecting_methods(spark):
    pairs = spark.createDataFrame([("A", "x", "y", 0.9, None, True)], "condition string, left string, right string, rho double, p double, selected boolean")
    r = sinks.pair_table(pairs, "spieceasi").first()
    assert (r["weight_type"], r["evidence_type"], r["selection_method"], r["selected"]) == ("selection_stability", "stars", "StARS", True)
    assert sinks.pair_table(pairs, "sparcc").first()["selected"] is None


def test_snapshots(spark, tmp_path):
    store = sinks.Snapshots(spark, str(tmp_path))
    graphs = spark.createDataFrame([("j1", "k1"), ("j1", "k2"), ("j2", "k1")], "job_id string, cache_key string")
    assert {r["n_members"] for r in store.of(graphs).collect()} == {None}
    rows = lambda n: spark.createDataFrame([("A", f"n{i}", i) for i in range(n)], "condition string, node string, rank int")
    store.save("j1", "k1", rows(3), 1)
    store.save("j1", "k1", rows(5), 2)
    store.save("j2", "k1", rows(2), 3)
    sizes = lambda: {(r[0], r[1]): r[2] for r in store.of(graphs).collect()}
    assert sizes() == {("j1", "k1"): 5, ("j1", "k2"): None, ("j2", "k1"): 2}
    store.delete("j1", 4)
    assert sizes() == {("j1", "k1"): None, ("j1", "k2"): None, ("j2", "k1"): 2}
    store.save("j1", "k2", rows(1), 5)
    assert sizes()["j1", "k2"] == 1


def test_side_by_side(spark):
    raw = [(i, json.dumps({"params": p})) for i, p in (("a", {"method": "spearman", "p": 0.05}), ("b", {"method": "sparcc", "p": 0.05, "more": "x"}), ("c", {"method": "y"}))]
    got = sinks.side_by_side(spark.createDataFrame(raw, "id string, payload string"), "a", "b").collect()
    assert {(r["parameter"], r["a"], r["b"], r["same"]) for r in got} == {("method", "spearman", "sparcc", False), ("p", "0.05", "0.05", True), ("more", None, "x", False)}


def test_lookups_on_ties_and_nothing(spark, planted):
    none = planted.limit(0)
    assert N.top_nodes(spark.createDataFrame([("A", "b", 0.5), ("A", "a", 0.5), ("A", "c", 0.9)], "condition string, node string, p double"), 2).orderBy("rank").collect()[1]["node"] == "a"
    assert N.first_nodes(none, 3).count() == 0 and N.neighbours_of(none, none.select("condition", F.col("source").alias("node"))).count() == 0
    assert N.first_nodes(planted, 0).count() == 0 and [r["id"] for r in N.ordered_nodes(planted).collect()][:2] == ["n00", "n01"]
    meta = spark.createDataFrame([("s1", "X"), ("s2", None)], "sample_id string, condition string")
    more = spark.createDataFrame([("s1", "Y"), ("s2", "Z"), ("s3", "Z")], "sample_id string, condition string")
    assert {tuple(r) for r in A.merged_metadata(meta, more).collect()} == {("s1", "X"), ("s2", "Z"), ("s3", "Z")}
    assert {r[0] for r in A.known_samples(meta, more).collect()} == {"s1", "s2", "s3"}
