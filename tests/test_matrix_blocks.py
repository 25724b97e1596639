"""Matrix methods whose conditions are dealt over blocks agree with the whole matrix in one place."""

import numpy as np
import pytest

from guildspark.operators import methods as MD


def table(spark, n=90, p=6, seed=8):
    rng = np.random.default_rng(seed)
    x = rng.poisson(np.exp(rng.normal(size=(n, p)) + 1.0)).astype(float)
    x[:, 1] = x[:, 0] + rng.poisson(1, n)
    x[7] = 0.0
    rows = [("c", i, f"f{j}", float(x[i, j])) for i in range(n) for j in range(p)] + [("c", i, "same", 2.0) for i in range(n)]
    return x, spark.createDataFrame(rows, "condition string, sample_id long, feature string, value double")


def largest_gathered(monkeypatch):
    monkeypatch.setattr(MD, "BLOCK_CELLS", 60)
    monkeypatch.setattr(MD, "repeats", None)  # no whole matrix in a lane


def test_cclasso_over_blocks(spark, monkeypatch):
    largest_gathered(monkeypatch)
    x, cells = table(spark)
    got = {(r["left"], r["right"]): r["rho"] for r in MD.cclasso(cells, bootstraps=3).collect()}
    logs = MD.centred_logs(x)
    s = np.cov(logs, rowvar=False)
    f = np.eye(6) - 1 / 6
    parts = np.array_split(np.random.default_rng([17, 0]).permutation(90), 3)
    grid = np.abs(s - np.diag(np.diag(s))).max() * np.logspace(-3, 0, 10)
    rest = lambda part: np.cov(np.delete(logs, part, 0), rowvar=False)
    loss = [sum(((f @ (MD.cclasso_fit(rest(q), g) - np.cov(logs[q], rowvar=False)) @ f) ** 2).sum() for q in parts) for g in grid]
    want = MD.to_correlation(MD.cclasso_fit(s, grid[int(np.argmin(loss))]))
    assert len(got) == 15 and all(got[f"f{i}", f"f{j}"] == pytest.approx(want[i, j], abs=1e-9) for i in range(6) for j in range(i + 1, 6))


def test_selections_over_blocks(spark, monkeypatch):
    largest_gathered(monkeypatch)
    x, cells = table(spark)
    got = {(r["repeat"], r["left"], r["right"]): r["value"] for r in MD.selections(cells, MD.centred_logs, 3, 8, 1e-2, 0.5, 4, 17).collect()}
    logs = MD.centred_logs(x)
    lam = MD.penalties_of(MD.correlation_of(logs), 8, 1e-2)
    for k in range(4):
        own = logs if k == 0 else logs[np.random.default_rng([17, k]).choice(90, 45, replace=False)]
        code = (MD.neighbourhoods(MD.correlation_of(own), lam).transpose(1, 2, 0) * 2.0 ** np.arange(8)).sum(axis=2)
        assert {k2: v for k2, v in got.items() if k2[0] == k} == {(k, f"f{i}", f"f{j}"): code[i, j] for i in range(6) for j in range(i + 1, 6)}


def test_spring_over_blocks(spark, monkeypatch):
    largest_gathered(monkeypatch)
    x, cells = table(spark)
    cells = cells.where("feature <> 'same'")  # sample 7 is empty and takes no part
    got = {(r["left"], r["right"]): r["weight"] for r in MD.spring(cells, penalties=6, subsamples=3, threshold=0.5).collect()}
    want = MD.latent_correlation(MD.mclr_matrix(x[x.sum(axis=1) > 0]))
    assert ("f0", "f1") in got and all(v == pytest.approx(want[int(a[1]), int(b[1])], abs=1e-9) for (a, b), v in got.items())


def test_taus_of_picks():
    rng = np.random.default_rng(2)
    for n in (2, 5, 64, 301):
        x = rng.integers(0, max(2, n // 3), (n, 2))
        pick = np.zeros(n, bool)
        pick[rng.choice(n, max(2, n // 2), replace=False)] = True
        a, b = (np.unique(c, return_inverse=True)[1].astype(np.int32) for c in x.T)
        assert MD.taus(a, b, [None, pick]) == pytest.approx([MD.kendall_matrix(x)[0, 1], MD.kendall_matrix(x[pick])[0, 1]], abs=1e-12)


def test_slices_of_a_permutation_hold_every_value_once():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 4, 103), rng.integers(0, 60, 103), np.arange(103)]).astype(float)
    columns = [np.unique(c, return_counts=True) for c in x.T]
    for slices, per in (([103], 200), ([103], 10), ([40, 40, 23], 9)):
        rows = [np.concatenate(list(MD.permuted(columns, slices, part, per, [3, 1]))) for part in range(len(slices))]
        assert [len(r) for r in rows] == slices
        got = np.concatenate(rows)
        assert (np.sort(got, axis=0) == np.sort(x, axis=0)).all()
        assert abs(np.corrcoef(got[:, 2], x[:, 2])[0, 1]) < 0.4 and (got[:, 2] != x[:, 2]).any()
        other = np.concatenate([np.concatenate(list(MD.permuted(columns, slices, part, per, [3, 2]))) for part in range(len(slices))])
        assert (other[:, 2] != got[:, 2]).any()


def test_places_of_dealt_values_are_even():
    places = np.zeros((12, 12))
    for k in range(3000):
        own = MD.permuted([(np.arange(12.0), np.ones(12, np.int64))], [5, 5, 2], k % 3, 2, [9, k])
        for at, v in enumerate(np.concatenate(list(own)).ravel(), 5 * (k % 3)):
            places[at, int(v)] += 1
    assert abs(places / 1000 * 12 - 1).max() < 0.5  # a thousand draws of each place


def test_sparcc_over_blocks(spark, monkeypatch):
    """The data's blocks are summed as they are, permutations over slices of blocks of the values of their columns."""
    x, cells = table(spark)
    monkeypatch.setattr(MD, "BLOCK_CELLS", 60)  # 48 samples a block
    monkeypatch.setattr(MD, "SLICE_BLOCKS", 1)
    got = {(r["left"], r["right"]): (r["rho"], r["p"]) for r in MD.sparcc(cells, iterations=4, permutations=40).collect()}
    rho = lambda sums: np.median([MD.basis_correlation(MD.covariance(s, 6), 10) for s in sums], axis=0)
    own = rho(sum(MD.log_sums(x[48 * b : 48 * b + 48], np.random.default_rng([17, 0, b]), 4) for b in range(2)))
    columns, beyond = [np.unique(c, return_counts=True) for c in x.T], np.ones((6, 6))
    for k in range(1, 41):
        parts = [MD.log_sums(y, np.random.default_rng([17, k, 3, part]), 4) for part in range(2) for y in MD.permuted(columns, [48, 42], part, 48, [17, k])]
        beyond += np.abs(rho(sum(parts))) >= np.abs(own)
    assert got == {(f"f{i}", f"f{j}"): (pytest.approx(own[i, j], abs=1e-9), pytest.approx(beyond[i, j] / 41)) for i in range(6) for j in range(i + 1, 6)}
    assert got["f0", "f1"][1] == pytest.approx(1 / 41)


def test_sparcc_sends_no_cells_to_its_permutations(spark):
    """What shuffles write does not grow with the permutations by the cells."""
    x, cells = table(spark, n=1500)

    def records(permutations):
        store, sc = spark._jsc.sc().statusStore(), spark.sparkContext
        none, empty = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList
        written = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(empty(), False, False, none, empty()))}
        before = written()
        assert MD.sparcc(cells, iterations=1, permutations=permutations).count() == 15
        return sum(n for k, n in written().items() if k not in before)

    assert records(100) < records(10) + 18_000  # there are 9,000 cells, and 22 lanes more; 90 permutations more return 1,350 pairs
