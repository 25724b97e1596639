"""Matrix methods over two domains whose samples differ, and the numbers SPIEC-EASI takes in wide conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from guildspark.operators import methods as MD
from guildspark.plans import analyze as J


def domain(spark, prefix, samples, features, seed):
    rng = np.random.default_rng(seed)
    rows = [(c, s, f"{prefix}{k}", float(rng.integers(1, 60))) for c in ("one", "two") for s in samples for k in range(features)]
    return spark.createDataFrame([(c, f"{c}{s}", f, v) for c, s, f, v in rows], "condition string, sample_id string, feature string, value double")


def values(df):
    return {(r["condition"], r["left"], r["right"]): (r["rho"], r["p"]) for r in df.collect()}


@pytest.mark.parametrize(("method", "settings"), [("sparcc", {"permutations": 10, "iterations": 3}), ("cclasso", {"bootstraps": 6})])
def test_own_samples_within_a_domain(spark, method, settings):
    a, b = domain(spark, "bac::", range(0, 14), 5, 1), domain(spark, "fun::", range(4, 20), 4, 2)
    found = values(J.pairs_of_two(a, b, method, settings))
    inside = {k: v for k, v in found.items() if k[1][:3] == k[2][:3]}
    across = {k: v for k, v in found.items() if k[1][:3] != k[2][:3]}
    assert len(inside) == 2 * (10 + 6) and len(across) == 2 * 20
    alone = values(J.pairs_of(a, method, settings)) | values(J.pairs_of(b, method, settings))
    assert inside == {k: (pytest.approx(r), pytest.approx(p)) for k, (r, p) in alone.items()}
    common = [f"{c}{s}" for c in ("one", "two") for s in range(4, 14)]
    joint = values(J.pairs_of(a.unionByName(b).where(F.col("sample_id").isin(common)), method, settings))
    assert across == {k: (pytest.approx(r), pytest.approx(p)) for k, (r, p) in joint.items() if k in across}


def test_joint_methods_see_one_matrix(spark):
    a, b = domain(spark, "bac::", range(0, 12), 3, 3), domain(spark, "fun::", range(2, 14), 3, 4)
    few = {"penalties": 4, "subsamples": 3, "threshold": 0.5}
    joint = a.unionByName(b).where(F.regexp_extract("sample_id", "([0-9]+)$", 1).cast("int").between(2, 11))
    assert values(J.pairs_of_two(a, b, "spieceasi", few)) == values(J.pairs_of(joint, "spieceasi", few))


def test_reduced_numbers_in_wide_conditions(spark):
    rng = np.random.default_rng(5)
    wide = [("wide", s, f"f{k:03}", float(rng.integers(0, 9))) for s in range(8) for k in range(205)] + [("wide", s, "constant", 3.0) for s in range(8)]
    tall = [("tall", s, f"f{k:03}", float(rng.integers(1, 9))) for s in range(12) for k in range(201)]
    few = [("few", s, f"f{k:03}", float(rng.integers(1, 9))) for s in range(8) for k in range(4)]
    cells = spark.createDataFrame(wide + tall + few, "condition string, sample_id long, feature string, value double")
    assert [r[0] for r in MD.wide_conditions(cells).collect()] == ["wide"]
    own = spark.createDataFrame(few, cells.schema)
    assert values(MD.spieceasi(own).withColumnRenamed("weight", "rho")) == values(MD.spieceasi(own, 20, subsamples=20).withColumnRenamed("weight", "rho"))


def test_wide_conditions_get_the_usual_numbers(spark, monkeypatch):
    rows = [("wide", s, f"f{k:03}", float((s * 7 + k) % 9)) for s in range(8) for k in range(205)] + [("few", s, f"f{k:03}", float((s * 5 + k) % 7)) for s in range(8) for k in range(4)]
    cells = spark.createDataFrame(rows, "condition string, sample_id long, feature string, value double")
    asked = []

    def noted(own, transform, subsamples, count, *rest):
        asked.append((sorted(r[0] for r in own.select("condition").distinct().collect()), subsamples, count))
        return spark.createDataFrame([], MD.PAIRS)

    monkeypatch.setattr(MD, "selections", noted)
    assert MD.spieceasi(cells).count() == 0
    assert asked == [(["few", "wide"], 20, 20)]
