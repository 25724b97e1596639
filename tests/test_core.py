import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from guildspark.functions import scalars
from guildspark.operators import abundance as A
from guildspark.operators import association as S
from guildspark.operators import community as C
from guildspark.operators import compare as X
from guildspark.operators import methods as MD
from guildspark.operators import network as N
from guildspark.operators import stability as T
from guildspark.plans import analyze as J
from guildspark.sources import sinks, tables
from guildspark.streaming.incremental import windowed_counts


def edges(spark, rows):
    return spark.createDataFrame([("c", a, b, float(w)) for a, b, w in rows], "condition string, source string, target string, weight double")


def clique(prefix, n):
    return [(f"{prefix}{i}", f"{prefix}{j}", 1.0) for i in range(n) for j in range(i)]


def test_filters(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random((12, 6)) < 0.4, 0, rng.integers(1, 50, (12, 6))).astype(float)
    cells = spark.createDataFrame([(f"s{i}", f"f{j}", float(x[i, j])) for i in range(12) for j in range(6) if x[i, j] > 0], "sample_id string, feature string, value double")
    rel = x / np.where(x.sum(1, keepdims=True) > 0, x.sum(1, keepdims=True), 1)
    n = len([1 for i in range(12) if x[i].sum() > 0])
    got = {r["feature"]: r for r in A.feature_metrics(cells).collect()}
    for j in range(6):
        r = got[f"f{j}"]
        assert r["prevalence"] == pytest.approx((x[:, j] > 0).sum() / n) and r["mean_relative"] == pytest.approx(rel[:, j].sum() / n)
        assert r["variance"] == pytest.approx(np.var(rel[x.sum(1) > 0, j]))
    with pytest.raises(ValueError):
        A.TaxaFilter(prevalence_percent=120)
    exact = spark.createDataFrame([("f", 4, 0.25, 0.5, 0.125)], "feature string, n_samples long, prevalence double, mean_relative double, variance double")
    assert A.removal_reasons(exact, A.TaxaFilter(25.0, 50.0, 0.125)).first()["reasons"] == []
    assert A.removal_reasons(exact, A.TaxaFilter(25.1, 50.0, 0.126)).first()["reasons"] == ["prevalence", "variability"]


def test_varying_by_condition(spark):
    # x varies only in sample 8 (8 % 7 <> 0), y is constant in a, z is absent from one sample of a
    rows = [("a", 7, "x", 1.0), ("a", 14, "x", 1.0), ("a", 8, "x", 2.0), ("a", 7, "y", 3.0), ("a", 14, "y", 3.0), ("a", 8, "y", 3.0), ("a", 7, "z", 1.0), ("a", 8, "z", 1.0), ("b", 1, "y", 3.0), ("b", 2, "y", 4.0), ("b", 1, "z", 1.0), ("b", 2, "z", 1.0)]
    cells = spark.createDataFrame(rows, "condition string, sample_id long, feature string, value double")
    assert sorted(map(tuple, A.varying_by_condition(cells).collect())) == [("a", "x"), ("a", "z"), ("b", "y")]
    from guildspark.plans import catalog

    whole = catalog.QUERIES["flt9_varying_by_condition"](spark, "/root/testdata/sf0.001")
    assert whole.select("condition").distinct().count() == 5


def test_taxa(spark):
    labels = [("k_B;p__Firm_;g__Lacto", "Firm", "Lacto"), ("P_Act|x", "Act", "genus_unknown"), ("g_", "phylum_unknown", "genus_unknown"), ("a, g_ b_", "phylum_unknown", "b")]
    df = spark.createDataFrame([(x,) for x, _, _ in labels], "l string")
    got = df.select("l", A.taxon_of(F.col("l"), "phylum").alias("p"), A.taxon_of(F.col("l"), "genus").alias("g")).collect()
    assert [(r["l"], r["p"], r["g"]) for r in got] == labels
    assert spark.range(1).select(scalars.slug(F.lit("__A b!")), scalars.slug(F.lit("?"))).first()[:] == ("a_b", "condition")


def test_spearman_p(spark):
    rows = [("c", "a", "b", float(r), n) for n in (3, 4, 5, 10, 41) for r in (-1, -0.5, 0, 0.3, 0.9, 1)]
    got = S.with_p(spark.createDataFrame(rows, "condition string, left string, right string, rho double, n long")).collect()

    def tail(t, df, steps=200_000):
        x = np.tan(np.linspace(math.atan(t), math.pi / 2, steps))[:-1]
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        y = c * (1 + x * x / df) ** (-(df + 1) / 2)
        return 2 * float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())

    for r in got:
        df = r["n"] - 2
        want = 0.0 if abs(r["rho"]) == 1 else tail(abs(r["rho"]) * math.sqrt(df / (1 - r["rho"] ** 2)), df)
        assert r["p"] == pytest.approx(want, abs=2e-3 if df < 3 else 1e-4)


def test_spearman_paths_agree_and_drop_constants(spark):
    rng = np.random.default_rng(2)
    rows = [("c", i, f"f{j}", float(rng.integers(0, 6)) if j else 1.0) for i in range(15) for j in range(4)]
    cells = spark.createDataFrame(rows, "condition string, sample_id int, feature string, value double")
    a = {(r["left"], r["right"]): r["rho"] for r in S.spearman(S.pair_cells(cells)).collect()}
    b = {(r["left"], r["right"]): r["rho"] for r in S.spearman_complete(cells.repartition(3)).collect()}
    assert a.keys() == b.keys() == {("f1", "f2"), ("f1", "f3"), ("f2", "f3")} and all(a[k] == pytest.approx(b[k]) for k in a)


def test_two_cliques(spark):
    e = edges(spark, clique("a", 8) + clique("b", 8) + [("a0", "b0", 1.0)])
    side = spark.createDataFrame([("c", f"a{i}") for i in range(8)], "condition string, node string")
    assert C.conductance(e, side).first()["conductance"] == pytest.approx(1 / 57)
    seeds = spark.createDataFrame([("c", "a3")], "condition string, node string")
    found, chosen = C.cluster(e, seeds, C.Ladder(b=4, alpha=0.1))
    assert {r["node"] for r in found.collect()} == {f"a{i}" for i in range(8)} and chosen.first()["step"] == 1
    runs = seeds.selectExpr("1L as run_id", "condition", "node", "0.1D as alpha", "1e-4D as epsilon", "cast(null as long) as order_seed")
    v = C.push(e, runs).collect()
    assert all(r["converged"] and r["p"] >= 0 for r in v) and sum(r["p"] + r["r"] for r in v) == pytest.approx(1, abs=1e-9)
    assert {r["neighbor"] for r in N.top_neighbors(e, 1).where("node = 'a0'").collect()} == {"a1"}


def test_singleton_and_signed(spark):
    e = edges(spark, [("A", "B", 0.8), ("B", "C", -0.7), ("A", "C", 0.6)])
    seeds = spark.createDataFrame([("c", "A")], "condition string, node string")
    found, chosen = C.cluster(e, seeds, C.Ladder(b=2))
    assert [(r["node"], r["rank"]) for r in found.collect()] == [("A", 1)] and chosen.first()["rule"] == "no_admissible_cluster"
    s = C.signed_composition(e, spark.createDataFrame([("c", "B"), ("c", "C")], "condition string, node string")).first()
    assert s["neg_inside"] == pytest.approx(0.7) and s["cut_pos"] == pytest.approx(1.4) and s["vol_pos"] == pytest.approx(1.4)
    for bad in ({"phi": 0}, {"alpha": 0}, {"alpha": 2}):
        with pytest.raises(ValueError):
            C.Ladder(**bad)


def test_compare(spark):
    cols = "source string, target string, weight double, p double, weight_type string"
    a = spark.createDataFrame([("x", "y", 0.5, 0.01, None), ("y", "z", -0.4, None, None), ("x", "w", 0.2, 0.1, "selection_stability")], cols)
    b = spark.createDataFrame([("y", "x", -0.9, 0.02, None), ("z", "y", -0.1, None, None), ("w", "x", 0.3, None, "correlation"), ("q", "r", 1.0, None, None)], cols)
    got = {(r["source"], r["target"]): r for r in X.intersection_edges(a, b, "P", "Q").collect()}
    assert got[("x", "y")]["conflict_type"] == "pos_to_neg" and got[("x", "y")]["weight"] == -0.9
    assert got[("y", "z")]["relation"] == "same sign" and got[("x", "w")]["metric_mismatch"] and got[("x", "w")]["sign_a"] == "not comparable"
    assert [(r["source"], r["target"]) for r in X.exclusive_edges(b, a).collect()] == [("q", "r")]


def test_stability(spark):
    c = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "a"), (3, "b")], "run_id int, node string")
    j = {(r["run_a"], r["run_b"]): r["jaccard"] for r in T.pairwise_jaccard(c).collect()}
    assert j == {(1, 2): pytest.approx(1 / 3), (1, 3): 1.0, (2, 3): pytest.approx(1 / 3)}
    assert T.distinct_clusters(c).first()[:] == (2, 2, 3)
    d = T.describe(spark.createDataFrame([(float(x),) for x in (1, 2, 4, float("nan"), float("inf"))], "v double"), "v").first()
    assert d["count"] == 3 and d["median"] == 2 and d["p95"] == pytest.approx(3.8)


def test_files_and_job(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, (24, 4))
    x[:, 1] = x[:, 0] + rng.integers(0, 3, 24)
    head = "﻿sample-id,o1,o2,o3,o4\n"
    (tmp_path / "a.csv").write_text(head + "".join(f"S{i}," + ",".join("" if (i, j) == (0, 2) else str(v) for j, v in enumerate(r)) + "\n" for i, r in enumerate(x)))
    (tmp_path / "t.tsv").write_text("feature\t" + "\t".join(f"S{i}" for i in range(24)) + "\n" + "".join(f"o{j + 1}\t" + "\t".join("n/a" if (i, j) == (0, 2) else str(x[i, j]) for i in range(24)) + "\n" for j in range(4)))
    (tmp_path / "m.csv").write_text("sample-id;Combination_treat2\n" + "".join(f"S{i};{'A' if i % 2 else 'B'}\n" for i in range(24)))
    meta = tables.load_metadata(spark, [str(tmp_path / "m.csv")], "Combination_treat2")
    assert tables.require_two_conditions(meta) == ["A", "B"]
    one = {(r["sample_id"], r["feature"]): r["value"] for r in tables.load_abundance(spark, [str(tmp_path / "a.csv")], meta).collect()}
    two = {(r["sample_id"], r["feature"]): r["value"] for r in tables.load_abundance(spark, [str(tmp_path / "t.tsv")], meta).collect()}
    assert one == two and len(one) == 95 and ("S0", "o3") not in one
    with pytest.raises(ValueError):
        tables.load_metadata(spark, [str(tmp_path / "m.csv")], "nope")
    job = J.Request("bacteria", ("A", "B"), bacteria=(str(tmp_path / "a.csv"),), metadata=(str(tmp_path / "m.csv"),), filters=A.PRESETS["exploratory"])
    assert J.Request.from_json(job.to_json()) == job
    out = J.analyze(spark, job)
    assert {(r["condition"], r["source"], r["target"]) for r in out["edges"].collect()} >= {("A", "o1", "o2"), ("B", "o1", "o2")}
    assert out["filter_report_bacteria"].first()["before"] == 4
    sinks.write_pairs(out["pairs"], str(tmp_path / "pairs"))
    assert spark.read.option("header", True).csv(str(tmp_path / "pairs")).count() == 12
    for bad in ({"conditions": ("A", "A")}, {"method": "x"}, {"grouping": "x"}, {"max_p": 2}):
        with pytest.raises(ValueError):
            J.Request(**({"dataset": "bacteria", "conditions": ("A", "B"), "bacteria": ("a",), "metadata": ("m",)} | bad))


def test_archive(spark, tmp_path):
    h = sinks.Archive(spark, str(tmp_path / "h"))
    row = lambda i, at: spark.createDataFrame([(i, "n", at)], "id string, analysis_name string, updated_at long")
    assert h.entries().count() == 0
    h.upsert(row("a", 10))
    h.upsert(row("b", 20))
    h.upsert(row("a", 30))
    got = [(r["id"], r["created_at"], r["updated_at"], r["run_count"]) for r in h.entries().collect()]
    assert got == [("a", 10, 30, 2), ("b", 20, 20, 1)]
    h.import_legacy(row("a", 99).unionByName(row("c", 5)))
    h.update("c", status="failed")
    h.remove(["b"])
    assert [(r["id"], r["status"]) for r in h.entries().collect()] == [("a", "completed"), ("c", "failed")]


def test_methods_recover(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6))
    base[:, 1] = base[:, 0] + 0.3 * rng.normal(size=60)
    x = rng.poisson(np.exp(base * 1.2 + 4))
    cells = spark.createDataFrame([("c", i, f"f{j}", float(x[i, j])) for i in range(60) for j in range(6)], "condition string, sample_id int, feature string, value double")
    top = lambda df, c: df.orderBy(F.desc(F.abs(c))).first()
    s = MD.sparcc(cells, iterations=3, permutations=10)
    r = top(s, "rho")
    assert (r["left"], r["right"]) == ("f0", "f1") and r["rho"] > 0.5 and r["p"] < 0.1
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, MD.sparcc(cells.repartition(3), iterations=3, permutations=10).collect()))
    r = top(MD.cclasso(cells, bootstraps=4), "rho")
    assert (r["left"], r["right"]) == ("f0", "f1")
    assert ("f0", "f1") in {(r["left"], r["right"]) for r in MD.spieceasi(cells, penalties=8, subsamples=6, threshold=0.1).collect()}
    with pytest.raises(ValueError):
        MD.sparcc(cells, permutations=3)


def test_method_queries_do_the_whole_job(spark, monkeypatch):
    from guildspark.plans import catalog

    seen = {}

    def note(name):
        def f(cells, *args, **settings):
            seen[name] = (cells.select("condition").distinct().count(), args[1:], settings)
            return cells

        return f

    for name in ("sparcc", "cclasso", "spieceasi", "spring", "selections"):
        monkeypatch.setattr(MD, name, note(name))
    monkeypatch.setattr(MD, "instability", lambda picked, *counts: seen.update(counts=counts))
    monkeypatch.setattr(catalog.XP, "repeatability", note("runs"))
    monkeypatch.setattr(catalog.T, "consensus", lambda runs: runs)
    for name in ("md2_sparcc", "md3_cclasso", "md4_spieceasi", "md5_spring", "stars_instability", "xp1_repeatability"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert {n: seen[n] for n in ("sparcc", "cclasso", "spieceasi", "spring")} == dict.fromkeys(("sparcc", "cclasso", "spieceasi", "spring"), (5, (), {}))
    assert seen["selections"][0] == 5 and seen["selections"][1][:2] == (20, 20) and seen["counts"] == (20, 20)
    assert seen["runs"][0] == 5 and not seen["runs"][2]


def test_lasso_converges():
    import inspect

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 1)) + 0.1 * rng.normal(size=(40, 12))
    r = MD.correlation_of(x)
    lam = MD.penalties_of(r, 20, 1e-3)

    def support(target, penalty):
        # one column at a time, far beyond the tolerance under test, and checked against the conditions of the optimum
        others = [k for k in range(len(r)) if k != target]
        b = np.zeros(len(r))
        for _ in range(200_000):
            before = b.copy()
            for k in others:
                g = r[k, target] - r[k] @ b + r[k, k] * b[k]
                b[k] = np.sign(g) * max(abs(g) - penalty, 0) / r[k, k]
            if np.abs(b - before).max() < 1e-12:
                break
        g = r[others, target] - r[others] @ b
        assert (np.abs(g) <= penalty + 1e-8).all()
        return b != 0

    got = MD.lasso_paths(r, lam)
    for a in (5, 12, 19):
        assert got[a, 0].tolist() == support(0, lam[a]).tolist()
    with pytest.raises(RuntimeError):
        MD.lasso_paths(r, lam, cap=3)
    assert inspect.signature(MD.spieceasi).parameters["ratio"].default == 1e-3
    assert len(MD.latent_table()[1]) == 41 and len(MD.latent_table()[0]) == 4000


def test_kendall_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(6)
    x = rng.integers(0, 5, size=(1500, 8)).astype(float)
    i, j = np.triu_indices(len(x), 1)
    s = np.sign(x[i] - x[j])
    tracemalloc.start()
    got = MD.kendall_matrix(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, s.T @ s / len(i)) and peak < s.nbytes / 2
    assert np.array_equal(got, MD.kendall_matrix(x, pairs=1)) and MD.kendall_matrix(x[:1]).tolist() == np.zeros((8, 8)).tolist()


def test_stream(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("value")).first()[0] == src.count()
