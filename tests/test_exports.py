"""Download forms, previews, widths and what the ladder gave way in."""

import csv
import io
import math

import pytest
from pyspark.sql import functions as F

from guildspark.functions import scalars as V
from guildspark.operators import community as C
from guildspark.operators import compare as X
from guildspark.operators import network as N
from guildspark.sources import cells as FC
from guildspark.sources import sinks


def test_csv_with_cr_and_lf(spark, tmp_path):
    rows = [("plain", 1.5, [1, 2]), ('quo"te', None, None), ("com,ma", -1e-7, []), ("line\nend", 2.0, [3]), ("", 3.0, [4]), (None, 4.0, [5])]
    path = str(tmp_path / "c")
    sinks.write_csv_crlf(spark.createDataFrame(rows, "`na,me` string, v double, list array<int>"), path)
    text = "".join(open(f.path, newline="", encoding="utf-8").read() for f in FC.files_of(path))
    assert text.endswith("\r\n") and text.count("\r\n") == 7
    got = list(csv.reader(io.StringIO(text, newline="")))
    assert got[0] == ["na,me", "v", "list"]
    assert sorted(r[0] for r in got[1:]) == sorted(["plain", 'quo"te', "com,ma", "line\nend", "", ""])
    assert {r[0]: r[2] for r in got[1:]}["plain"] == "[1,2]" and {r[0]: r[1] for r in got[1:]}['quo"te'] == ""
    assert '"plain"' not in text


def test_weights_are_named_by_their_type(spark):
    rows = [("a", "b", 0.12345678, "correlation", 0.5, "x"), ("a", "c", -0.5, None, float("nan"), None), ("b", "c", 0.9, "selection_stability", None, "stars"), ("c", "d", 0.1, "mixed", None, None), ("d", "e", float("inf"), "latent_correlation", None, None), ("e", "f", 0.0, None, None, None)]
    df = spark.createDataFrame(rows, "source string, target string, weight double, weight_type string, p double, evidence_type string")
    got = {(r["source"], r["target"]): r for r in X.export_derived_edges(df, "c").collect()}
    pick = lambda k: (got[k]["correlation"], got[k]["selection_stability"], got[k]["weight"], got[k]["sign"])
    assert pick(("a", "b")) == (0.123457, None, None, "positive") and pick(("a", "c")) == (-0.5, None, None, "negative")
    assert pick(("b", "c")) == (None, 0.9, None, "selected") and pick(("c", "d")) == (None, None, 0.1, "positive")
    assert pick(("d", "e")) == (None, None, None, "positive") and pick(("e", "f"))[3] == "neutral"
    assert got[("a", "c")]["evidence_type"] == "pairwise_p_value" and got[("a", "c")]["p_value"] is None and got[("b", "c")]["evidence_type"] == "stars"
    views = {r["view"] for r in X.views(df, df.limit(2)).collect()}
    assert {"cluster_a", "cluster_b", "intersection"} <= views


def test_borders_and_search(spark):
    df = spark.createDataFrame([(2.0, 4.0), (0.0, 4.0), (-1.0, 0.5), (None, 4.0), (float("inf"), 4.0), (0.01, 4.0), (9.0, 4.0)], "r double, m double")
    assert [round(x[0], 9) for x in df.select(V.node_border(F.col("r"), F.col("m"))).collect()] == [2.3, 1.55, 3.8, 1.55, 1.55, 1.1, 3.8]
    nodes = spark.createDataFrame([("Alpha",), ("beta",), ("alphabet",)], "id string")
    assert [r[0] for r in N.search(nodes, "ALPH").collect()] == ["Alpha", "alphabet"]
    assert N.preview(nodes, [F.desc("id")], 2).count() == 2


def test_stats_of_conditions_without_edges(spark):
    pairs = spark.createDataFrame([("x", "a", "b", 0.9, 0.01), ("x", "a", "c", 0.1, 0.9), ("y", "a", "b", 0.2, 0.8)], "condition string, left string, right string, rho double, p double")
    kept = pairs.where("p <= 0.05")
    got = {r["condition"]: r for r in N.labelled_stats(pairs, kept, N.graph_stats(N.edges_of(kept)), "sparcc", 0.05, 0.3).collect()}
    assert (got["x"]["total_pairs"], got["x"]["significant_pairs"], got["x"]["node_count"]) == (2, 1, 2)
    assert (got["y"]["total_pairs"], got["y"]["significant_pairs"], got["y"]["edge_count"], got["y"]["mean_weight"]) == (1, 0, 0, None)
    assert got["y"]["evidence_type"] == "permutation_p_value" and got["y"]["p_value_threshold_applied"]
    stable = N.labelled_stats(pairs, kept, N.graph_stats(N.edges_of(kept)), "spieceasi", None, 0.3).first()
    assert stable["correlation_threshold_label"] == "minimum_stars_edge_stability" and not stable["p_value_threshold_applied"] and stable["p_value_threshold"] is None and "selected_pairs" in stable.asDict()


def test_relaxations_by_step(spark):
    rows = [(1, 8, 0.5, 4, 0.5, 8.0, 0.4, 20.0, 0.5), (3, 7, 0.5, 4, 0.5, 2.0, 0.4, 3.0, 0.5), (4, 6, 0.5, 4, 0.75, 8.0, 0.7, 20.0, 0.5), (5, 5, 0.5, 4, 0.5, 8.0, 1.5, 2.0, 0.7), (0, 1, 0.5, 4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "step int, size int, phi double, b int, phi_used double, floor_used double, score double, volume double, mass double")
    got = {r["step"]: r for r in C.relaxations(df).collect()}
    assert got[4]["phi_relax_factor"] == 1.5 and got[3]["scale_relaxation"] == 2.0 and got[1]["phi_relax_factor"] is None
    assert (got[5]["penalty_quality"], got[5]["penalty_volume"], got[5]["penalty_mass"]) == (3.0, 0.5 * math.log2(4), pytest.approx(-0.07))
    assert got[0]["sweep_index"] is None and got[1]["sweep_index"] == 7
    vector = spark.createDataFrame([("c", "a", 0.1), ("c", "b", 0.4), ("c", "x", 0.9)], "condition string, node string, p double")
    prefixes = spark.createDataFrame([("c", 1, "a", 0.1), ("c", 2, "b", 0.4), ("c", 3, "x", 0.9)], "condition string, k int, node string, p double")
    chosen = spark.createDataFrame([("c", 1, 2), ("d", 0, 1)], "condition string, step int, size int")
    seeds = spark.createDataFrame([("c", "a"), ("d", "q")], "condition string, node string")
    assert {tuple(r) for r in C.ranked_scores(prefixes, seeds, chosen, vector).collect()} == {("c", "b", 0.4, 1), ("c", "a", 0.1, 2), ("d", "q", 0.0, 1)}


def test_cut_tables_say_so(spark):
    from guildspark.sources import tables

    df = spark.range(5).selectExpr("id", "cast(null as string) as note")
    assert sinks.markdown(df, 5).count("\n") == 6 and "has more" not in sinks.markdown(df, 5)
    assert sinks.markdown(df.orderBy("id"), 2).splitlines()[-1] == "The first 2 rows; the table has more." and "| 2 |" not in sinks.markdown(df.orderBy("id"), 2)
    meta = spark.range(6).selectExpr("id as sample_id", "cast(id % 3 as string) as condition")
    assert tables.require_two_conditions(meta) == ["0", "1", "2"] and tables.require_two_conditions(meta, 3) == ["0", "1", "2"]
    with pytest.raises(ValueError, match="more than 2"):
        tables.require_two_conditions(meta, 2)
    with pytest.raises(ValueError):
        tables.require_two_conditions(meta.where("id = 0"))


def test_rebuild_of_the_history(spark, tmp_path):
    h = sinks.Archive(spark, str(tmp_path / "h"))
    h.upsert(spark.createDataFrame([("a", "A", "completed", 5)], "id string, analysis_name string, status string, updated_at long"))
    h.rebuild(spark.createDataFrame([("a", "sa", 1), ("b", "sb", 7)], "id string, summary string, updated_at long"))
    got = {r["id"]: r for r in h.entries().collect()}
    assert (got["a"]["analysis_name"], got["a"]["summary"], got["a"]["updated_at"]) == ("A", "sa", 5)
    assert (got["b"]["analysis_name"], got["b"]["summary"], got["b"]["created_at"]) == ("Recovered analysis", "sb", 7)
