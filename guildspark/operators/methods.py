"""Association methods that need a whole matrix: SparCC, CCLasso, SPIEC-EASI (MB) and SPRING.

A matrix is one condition's samples by features, tens to hundreds wide; the work is in its many repeats
(permutations, bootstraps, subsamples), and no task gathers a condition's samples. They are numbered by name and dealt into
blocks; a repeat of CCLasso or SPIEC-EASI is a weight per number, drawn in every block from the same generator, and needs sums
over the blocks only (moments). SPRING needs the columns of a few features at a time, for Kendall's tau. A permutation of SparCC deals the
values of each column, known by their counts, over blocks anew and needs sums over them. What repeats return (pair statistics or
selections) is reduced by group-bys. Every repeat seeds its own generators, so results do not depend on partitioning.

Features constant over a condition's samples are dropped first; too few samples or features give no rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guildspark.sources.staging import cut

from . import abundance as A
from .ranks import row_numbers

#: Cells of a block of samples.
BLOCK_CELLS = 1 << 19
#: Features whose columns go together to the tasks that compare them.
COLUMNS = 4
#: Repeats of a lane; the number of lanes grows with the repeats.
PER_LANE = 4
#: Blocks of permuted samples that one task sums up.
SLICE_BLOCKS = 8
PAIRS = "condition string, repeat long, left string, right string, value double"
SUMS = "condition string, repeat int, part int, p int, sums binary"
SUMS_ARROW = pa.schema([("condition", pa.string()), ("repeat", pa.int32()), ("part", pa.int32()), ("p", pa.int32()), ("sums", pa.binary())])


def features_of(own: DataFrame) -> DataFrame:
    """(condition, feature, c, p): the varying features of each condition, numbered by name, and how many they are."""
    w = Window.partitionBy("condition")
    return A.varying_by_condition(own).select("condition", "feature", (F.row_number().over(w.orderBy("feature")) - 1).alias("c"), F.count("*").over(w).cast("int").alias("p"))


def rows_of_block(p: Column) -> Column:
    """Samples of a full block of a condition with p varying features."""
    return F.greatest(F.floor(F.lit(BLOCK_CELLS) / p), 8 * p)


def blocks(cells: DataFrame, min_samples: int, drop_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """(condition, block, start, rows, n, p, r, c, value) of the cells of varying features, r being a sample's number in its block; a sample
    without such cells has one row with c null. Also (condition, feature, c, p) of the features."""
    v = F.col("value").cast("double")
    sound = F.when((v >= 0) & (v < float("inf")), v).otherwise(F.raise_error(F.lit("abundances must be finite and not negative")).cast("double"))
    own = cut(cells.select("condition", "sample_id", "feature", sound.alias("value")), "cells")
    if drop_empty:
        own = cut(own.join(own.groupBy("condition", "sample_id").agg(F.sum("value").alias("t")).where("t > 0").drop("t"), ["condition", "sample_id"], "left_semi"), "cells")
    names = cut(features_of(own), "features")
    samples = cut(row_numbers(own.select("condition", "sample_id").distinct(), ["sample_id"], ["condition"], "at"), "samples")
    sizes = samples.groupBy("condition").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).join(names.where("p > 1").select("condition", "p").distinct(), "condition")
    sizes = sizes.withColumn("per", rows_of_block(F.col("p")))
    block = F.floor((F.col("at") - 1) / F.col("per")).cast("int")
    dealt = samples.join(sizes, "condition").withColumn("block", block).withColumn("start", F.col("block") * F.col("per"))
    dealt = dealt.select("condition", "sample_id", "block", "start", F.least("per", F.col("n") - F.col("start")).alias("rows"), "n", "p", (F.col("at") - 1 - F.col("start")).cast("int").alias("r"))
    values = own.join(names.select("condition", "feature", "c"), ["condition", "feature"]).select("condition", "sample_id", "c", "value")
    return dealt.join(values, ["condition", "sample_id"], "left").drop("sample_id"), names


def dense(table: pa.Table) -> np.ndarray:
    """The block's samples by the condition's varying features, 0 where a cell is missing."""
    x = np.zeros((table.column("rows")[0].as_py(), table.column("p")[0].as_py()))
    some = table.filter(table.column("c").is_valid())
    x[some.column("r").to_numpy(), some.column("c").to_numpy()] = some.column("value").to_numpy()
    return x


def moments(blocked: DataFrame, transform, draws) -> DataFrame:
    """(condition, repeat, p, sums) of all repeats of draws(n), pairs of a repeat and its weight per sample (None: 1 each).

    transform works on rows of the matrix. sums: the weight, the weighted sums of the columns and of their products."""
    schema = "condition string, repeat int, block int, p int, sums binary"

    def of_block(table: pa.Table) -> pa.Table:
        one = {c: table.column(c)[0].as_py() for c in ("condition", "block", "start", "rows", "n", "p")}
        z = transform(dense(table))
        out = []
        for k, w in draws(one["n"]):
            w = np.ones(len(z)) if w is None else w[one["start"] : one["start"] + one["rows"]].astype(float)
            wz = z * w[:, None]
            out.append((k, np.concatenate(([w.sum()], wz.sum(axis=0), (wz.T @ z).ravel())).tobytes()))
        m = len(out)
        return pa.table([pa.array([one["condition"]] * m, pa.string()), pa.array([k for k, _ in out], pa.int32()), pa.array([one["block"]] * m, pa.int32()), pa.array([one["p"]] * m, pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["condition", "repeat", "block", "p", "sums"])

    def united(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy())  # one order of additions in any run
        total = np.sum([np.frombuffer(table.column("sums")[int(i)].as_py()) for i in order], axis=0)
        return table.slice(0, 1).select(["condition", "repeat", "p"]).append_column("sums", pa.array([total.tobytes()], pa.binary()))

    per = blocked.groupBy("condition", "block").applyInArrow(of_block, schema)
    return per.groupBy("condition", "repeat").applyInArrow(united, "condition string, repeat int, p int, sums binary")


def covariance(sums: np.ndarray, p: int) -> np.ndarray:
    """Covariance with divisor weight - 1; what rounding leaves of a constant column's variance is 0."""
    w, first, second = sums[0], sums[1 : p + 1], sums[p + 1 :].reshape(p, p)
    c = (second - np.outer(first, first) / w) / (w - 1)
    still = np.diag(c) * (w - 1) <= 1e-13 * np.diag(second)
    c[still], c[:, still] = 0.0, 0.0
    return c


def correlation(c: np.ndarray) -> np.ndarray:
    """As correlation_of(), from a covariance."""
    d = np.sqrt(np.diag(c))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.clip(c / d[:, None] / d[None, :], -1, 1)
    return np.where(np.isfinite(r), r, 0.0) * (1 - 1e-8) + 1e-8 * np.eye(len(r))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df by keys over all shuffle partitions: the tasks are few and long, so small ones must not be put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(condition, repeat, left, right, value) of (condition, repeat, i, j, value), i and j being numbers of features_of()."""
    left, right = (names.select("condition", F.col("c").alias(c), F.col("feature").alias(side)) for c, side in (("i", "left"), ("j", "right")))
    return rows.join(left, ["condition", "i"]).join(right, ["condition", "j"]).select("condition", "repeat", "left", "right", "value")


def in_lanes(parts: DataFrame, names: DataFrame, n: int, kernel) -> DataFrame:
    """kernel(table of parts, repeats) -> pairs of a repeat and a symmetric matrix; rows (condition, repeat, left, right, value).

    A lane gets the parts of its PER_LANE repeats, and those of repeats up to 0."""
    lanes = math.ceil(n / PER_LANE)
    lane = F.when(F.col("repeat") <= 0, F.sequence(F.lit(0), F.lit(lanes - 1))).otherwise(F.array(F.col("repeat") % lanes))

    def run(table: pa.Table) -> pa.Table:
        condition, own = table.column("condition")[0].as_py(), table.column("lane")[0].as_py()
        i, j = np.triu_indices(table.column("p")[0].as_py(), 1)
        out = []
        for k, got in kernel(table, range(own, n, lanes)):
            v = got[i, j]
            some = np.isfinite(v)
            m = int(some.sum())
            out.append(pa.table([pa.array([condition] * m, pa.string()), pa.array([k] * m, pa.int64()), pa.array(i[some], pa.int32()), pa.array(j[some], pa.int32()), pa.array(v[some], pa.float64())], names=["condition", "repeat", "i", "j", "value"]))
        return pa.concat_tables(out) if out else pa.table({"condition": pa.array([], pa.string()), "repeat": pa.array([], pa.int64()), "i": pa.array([], pa.int32()), "j": pa.array([], pa.int32()), "value": pa.array([], pa.float64())})

    rows = spread(parts.withColumn("lane", F.explode(lane)), "condition", "lane").groupBy("condition", "lane").applyInArrow(run, "condition string, repeat long, i int, j int, value double")
    return named(rows, names)


def sums_of(table: pa.Table) -> tuple[dict[int, np.ndarray], int]:
    """The sums of moments() by repeat, and the number of features."""
    return {k: np.frombuffer(b) for k, b in zip(table.column("repeat").to_pylist(), table.column("sums").to_pylist(), strict=True)}, table.column("p")[0].as_py()


# --- SparCC (Friedman & Alm 2012) ------------------------------------------------------------------


def basis_correlation(cov: np.ndarray, exclusions: int, cutoff: float = 0.1) -> np.ndarray:
    """Correlations of the unknown basis from the variances of log-ratios, leaving out strongly related pairs; cov is of the logs."""
    p = len(cov)
    d = np.diag(cov)
    t = d[:, None] + d[None, :] - 2 * cov
    used = ~np.eye(p, dtype=bool)
    rho = np.eye(p)
    for _ in range(exclusions + 1):
        n = used.sum(axis=1)
        system = used.astype(float) + np.diag(n)
        w2 = np.maximum(np.linalg.lstsq(system, (t * used).sum(axis=1), rcond=None)[0], 1e-4)
        rho = np.clip((w2[:, None] + w2[None, :] - t) / (2 * np.sqrt(w2[:, None] * w2[None, :])), -1, 1)
        np.fill_diagonal(rho, 1)
        strong = np.where(used, np.abs(rho), 0)
        i, j = np.unravel_index(np.argmax(strong), strong.shape)
        if strong[i, j] < cutoff or n[i] <= 3 or n[j] <= 3:
            break
        used[i, j] = used[j, i] = False
    return rho


def log_sums(x: np.ndarray, rng: np.random.Generator, iterations: int) -> np.ndarray:
    """Per iteration the samples, the sums of the logs of drawn abundances and those of their products. A sample's draws are not divided by
    their sum, which cancels in every log-ratio."""
    out = []
    for _ in range(iterations):
        z = np.log(rng.standard_gamma(x + 1.0))
        out.append(np.concatenate(([len(z)], z.sum(axis=0), (z.T @ z).ravel())))
    return np.array(out)


def dealt(counts: np.ndarray, sizes: list[int], last: int, rng: np.random.Generator) -> list[np.ndarray]:
    """How often each value comes into groups 0 to `last`, if the values, each `counts` times, are dealt into groups of these sizes in random order."""
    left, out = counts.copy(), []
    for at, size in enumerate(sizes[: last + 1]):
        out.append(left.copy() if at == len(sizes) - 1 else rng.multivariate_hypergeometric(left, size, method="marginals"))
        left -= out[-1]
    return out


def groups_of(n: int, size: int) -> list[int]:
    return [min(size, n - at) for at in range(0, n, size)]


def permuted(columns: list[tuple[np.ndarray, np.ndarray]], slices: list[int], part: int, per: int, seed: list[int]):
    """Blocks of up to `per` rows of a slice of the matrix whose columns (values and their counts) are each in random order. Slices and blocks are
    drawn one after the other from generators of the repeat and the column, so the slices of a repeat, made in different tasks, are one permutation."""
    inner = groups_of(slices[part], per)
    own = []
    for c, (_, counts) in enumerate(columns):
        mine = dealt(counts, slices, part, np.random.default_rng([*seed, 0, c]))[part]
        own.append(dealt(mine, inner, len(inner) - 1, np.random.default_rng([*seed, 1, c, part])))
    rng = np.random.default_rng([*seed, 2, part])
    for b in range(len(inner)):
        yield np.column_stack([rng.permutation(np.repeat(values, own[c][b])) for c, (values, _) in enumerate(columns)])


def block_parts(blocked: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(condition, n, p, part, c, sums, counts) of every block, as bytes: with c = -1 log_sums() of the data, else the values of column c and their counts."""
    schema = "condition string, n long, p int, part int, c int, sums binary, counts binary"

    def of_block(table: pa.Table) -> pa.Table:
        condition, block, n, p = (table.column(c)[0].as_py() for c in ("condition", "block", "n", "p"))
        x = dense(table)
        found = [np.unique(column, return_counts=True) for column in x.T]
        sums = [log_sums(x, np.random.default_rng([seed, 0, block]), iterations), *(v for v, _ in found)]
        m = p + 1
        return pa.table([pa.array([condition] * m, pa.string()), pa.array([n] * m, pa.int64()), pa.array([p] * m, pa.int32()), pa.array([block] * m, pa.int32()), pa.array(range(-1, p), pa.int32()), pa.array([v.tobytes() for v in sums], pa.binary()), pa.array([None, *(k.astype(np.int64).tobytes() for _, k in found)], pa.binary())], names=["condition", "n", "p", "part", "c", "sums", "counts"])

    return cut(blocked.groupBy("condition", "block").applyInArrow(of_block, schema), "blocks")


def columns_of(parts: DataFrame) -> DataFrame:
    """(condition, n, p, c, values, counts): the distinct values of every column of a condition and how often they occur."""

    def united(table: pa.Table) -> pa.Table:
        values, at = np.unique(np.concatenate([np.frombuffer(b) for b in table.column("sums").to_pylist()]), return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, at, np.concatenate([np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist()]))
        return table.slice(0, 1).select(["condition", "n", "p", "c"]).append_column("values", pa.array([values.tobytes()], pa.binary())).append_column("counts", pa.array([counts.tobytes()], pa.binary()))

    return cut(parts.where("c >= 0").groupBy("condition", "c").applyInArrow(united, "condition string, n long, p int, c int, values binary, counts binary"), "columns")


def repeats(columns: DataFrame, n: int, iterations: int, seed: int) -> DataFrame:
    """(condition, repeat, part, p, sums) of repeats 1 to n: log_sums() of the slices of the matrix with every column in random order."""
    lanes = math.ceil(n / PER_LANE)
    most = SLICE_BLOCKS
    own = columns.withColumn("per", rows_of_block(F.col("p")))
    parts = F.sequence(F.lit(0), F.ceil(F.col("n") / (F.col("per") * most)).cast("int") - 1)
    sent = own.withColumn("part", F.explode(parts)).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def run(table: pa.Table) -> pa.Table:
        condition, total, p, per, part, own = (table.column(c)[0].as_py() for c in ("condition", "n", "p", "per", "part", "lane"))
        rows = sorted(zip(table.column("c").to_pylist(), table.column("values").to_pylist(), table.column("counts").to_pylist(), strict=True))
        held = [(np.frombuffer(v), np.frombuffer(k, np.int64)) for _, v, k in rows]
        out = []
        for k in range(own + 1, n + 1, lanes):
            rng = np.random.default_rng([seed, k, 3, part])
            sums = sum(log_sums(x, rng, iterations) for x in permuted(held, groups_of(total, per * most), part, per, [seed, k]))
            out.append({"condition": condition, "repeat": k, "part": part, "p": p, "sums": sums.tobytes()})
        return pa.Table.from_pylist(out, SUMS_ARROW)

    return spread(sent, "condition", "lane", "part").groupBy("condition", "lane", "part").applyInArrow(run, SUMS)


def sparcc(cells: DataFrame, iterations: int = 20, exclusions: int = 10, permutations: int = 100, seed: int = 17) -> DataFrame:
    """(condition, left, right, rho, p): repeat 0 is the data, each other shuffles every feature over the samples."""
    if permutations < 10:
        raise ValueError("at least 10 permutations are needed")

    def united(table: pa.Table) -> pa.Table:
        condition, k, p = (table.column(c)[0].as_py() for c in ("condition", "repeat", "p"))
        order = np.argsort(table.column("part").to_numpy())  # one order of additions in any run
        total = np.sum([np.frombuffer(table.column("sums")[int(i)].as_py()) for i in order], axis=0).reshape(iterations, -1)
        rho = np.median([basis_correlation(covariance(s, p), exclusions) for s in total], axis=0)
        i, j = np.triu_indices(p, 1)
        some = np.isfinite(rho[i, j])
        i, j = i[some], j[some]
        return pa.table([pa.array([condition] * len(i), pa.string()), pa.array([k] * len(i), pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(rho[i, j], pa.float64())], names=["condition", "repeat", "i", "j", "value"])

    blocked, names = blocks(cells, 3)
    parts = block_parts(blocked, iterations, seed)
    data = parts.where("c = -1").select("condition", F.lit(0).alias("repeat"), "part", "p", "sums")
    sums = cut(data.unionByName(repeats(columns_of(parts), permutations, iterations, seed)), "sums")
    pairs = spread(sums, "condition", "repeat").groupBy("condition", "repeat").applyInArrow(united, "condition string, repeat long, i int, j int, value double")
    rows = cut(named(pairs, names), "permutations")
    own = rows.where("repeat = 0").select("condition", "left", "right", F.col("value").alias("rho"))
    by = ["condition", "left", "right"]
    beyond = rows.where("repeat > 0").join(own, by).groupBy(*by).agg(F.count_if(F.abs("value") >= F.abs("rho")).alias("k"), F.count("*").alias("n"))
    return own.join(beyond, by).select(*by, "rho", ((F.col("k") + 1) / (F.col("n") + 1)).alias("p"))


# --- CCLasso (Fang et al. 2015) --------------------------------------------------------------------


def cclasso_fit(s: np.ndarray, penalty: float, cap: int = 200, tol: float = 1e-6) -> np.ndarray:
    """Sparse covariance of the basis from the covariance s of centred logs, by ADMM: minimise
    ||F(Z - S)F||^2 / 2 + penalty * ||off-diagonal Z||_1, with F the centring projection."""
    p = len(s)
    f = np.eye(p) - 1.0 / p
    b = f @ s @ f
    step = 1.0
    z, u = b.copy(), np.zeros_like(b)
    for _ in range(cap):
        v = z - u
        # (F.F + step) x = b + step v splits into the centred and the other part of the space
        centred = f @ v @ f
        x = (b + step * centred) / (1 + step) + (v - centred)
        y = x + u
        new = np.sign(y) * np.maximum(np.abs(y) - penalty / step, 0)
        np.fill_diagonal(new, np.maximum(np.diag(y), 1e-8))
        u += x - new
        done = np.abs(new - z).max() < tol
        z = new
        if done:
            break
    return z


def to_correlation(c: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum(np.diag(c), 1e-12))
    return np.clip(c / d[:, None] / d[None, :], -1, 1)


def centred_logs(x: np.ndarray, pseudo: float = 0.5) -> np.ndarray:
    logs = np.log(x + pseudo)
    return logs - logs.mean(axis=1, keepdims=True)


def cclasso_penalty(parts: list[np.ndarray], p: int) -> float:
    """The penalty with the least loss over the folds, whose sums are given."""
    whole = np.sum(parts, axis=0)
    s = covariance(whole, p)
    grid = np.abs(s - np.diag(np.diag(s))).max() * np.logspace(-3, 0, 10)
    f = np.eye(p) - 1.0 / p
    loss = []
    for g in grid:
        total = 0.0
        for part in parts:
            rest = whole - part
            if part[0] < 2 or rest[0] < 2:
                continue
            total += (f @ (cclasso_fit(covariance(rest, p), g) - covariance(part, p)) @ f) ** 2 @ np.ones(p) @ np.ones(p)
        loss.append(total)
    return float(grid[int(np.argmin(loss))])


def cclasso(cells: DataFrame, pseudo: float = 0.5, folds: int = 3, bootstraps: int = 20, seed: int = 17) -> DataFrame:
    """(condition, left, right, rho, p): p from the bootstrap deviation, two-sided normal."""

    def draws(n):
        yield 0, None
        for f, part in enumerate(np.array_split(np.random.default_rng([seed, 0]).permutation(n), folds)):
            yield -1 - f, np.bincount(part, minlength=n)
        for k in range(1, bootstraps + 1):
            yield k, np.bincount(np.random.default_rng([seed, k]).integers(n, size=n), minlength=n)

    def kernel(table, ks):
        sums, p = sums_of(table)
        penalty = cclasso_penalty([sums[-1 - f] for f in range(folds)], p)
        for k in ks:
            yield k, to_correlation(cclasso_fit(covariance(sums[k], p), penalty))

    blocked, names = blocks(cells, 6)
    rows = in_lanes(moments(blocked, lambda x: centred_logs(x, pseudo), draws), names, bootstraps + 1, kernel)
    by = ["condition", "left", "right"]
    own = F.max(F.when(F.col("repeat") == 0, F.col("value")))
    spread = F.stddev_samp(F.when(F.col("repeat") > 0, F.col("value")))
    both = rows.groupBy(*by).agg(own.alias("rho"), spread.alias("sd")).where("rho is not null")
    z = F.abs("rho") / F.when(F.col("sd") > 0, F.col("sd"))
    return both.select(*by, "rho", F.when(F.col("rho") == 0, 1.0).otherwise(F.coalesce(normal_tail(z), F.lit(0.0))).alias("p"))


def normal_tail(z):
    """Two-sided tail of the normal distribution, by the rational form of erfc (absolute error under 1.2e-7)."""
    x = z / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # fixed values: coefficients of the erfc approximation
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


# --- neighbourhood selection and StARS (Meinshausen & Bühlmann 2006, Liu et al. 2010) ---------------


def lasso_exact(r: np.ndarray, target: int, lam: float, beta: np.ndarray) -> np.ndarray | None:
    """The optimum if it has the signs of beta: the solution for these signs, if it meets the optimum's conditions."""
    some = np.flatnonzero(beta)
    sign = np.sign(beta[some])
    try:
        found = np.linalg.solve(r[np.ix_(some, some)], r[some, target] - lam * sign)
    except np.linalg.LinAlgError:
        return None
    rest = np.abs(r[:, target] - r[:, some] @ found)
    rest[some] = rest[target] = 0.0
    if (np.sign(found) != sign).any() or (rest > lam * (1 + 1e-9)).any():
        return None
    out = np.zeros(len(r))
    out[some] = found
    return out


def lasso_paths(r: np.ndarray, penalties: np.ndarray, cap: int = 100_000, tol: float = 1e-10, every: int = 20) -> np.ndarray:
    """Coordinate descent on correlations r for every target column at once, warm-started along falling penalties, until each
    column is at its exact optimum or rests; (penalties, target, p) non-zero flags. Raises where cap rounds do not suffice."""
    p = len(r)
    beta, fit = np.zeros((p, p)), np.zeros((p, p))  # coefficients by target column, r @ beta
    out = np.zeros((len(penalties), p, p), bool)
    for a, lam in enumerate(penalties):
        exact = np.zeros(p, bool)
        for n in range(1, cap + 1):
            change = 0.0
            for k in range(p):
                g = r[k] - fit[k] + r[k, k] * beta[k]
                new = np.sign(g) * np.maximum(np.abs(g) - lam, 0.0) / r[k, k]
                new[k] = 0.0
                step = new - beta[k]
                most = np.abs(step).max()
                if most > 0:
                    fit += np.outer(r[:, k], step)
                    beta[k] = new
                    change = max(change, most)
            if change < tol:
                break
            if n % every == 0:
                for t in np.flatnonzero(~exact):
                    found = lasso_exact(r, t, lam, beta[:, t])
                    if found is not None:
                        beta[:, t], fit[:, t], exact[t] = found, r @ found, True
                if exact.all():
                    break
        else:
            raise RuntimeError(f"the lasso has not converged in {cap} rounds at penalty {lam}")
        out[a] = (beta != 0).T
    return out


def neighbourhoods(r: np.ndarray, penalties: np.ndarray) -> np.ndarray:
    """(penalties, p, p) supports, an edge if either end selects the other."""
    picked = lasso_paths(r, penalties)
    return picked | picked.transpose(0, 2, 1)


def subsample_share(n: int) -> float:
    return 0.8 if n <= 144 else 10 * math.sqrt(n) / n


def penalties_of(r: np.ndarray, count: int, ratio: float) -> np.ndarray:
    top = np.abs(r - np.diag(np.diag(r))).max()
    return np.geomspace(top, ratio * top, count)


def correlation_of(x: np.ndarray) -> np.ndarray:
    r = np.corrcoef(x, rowvar=False)
    return np.where(np.isfinite(r), r, 0.0) * (1 - 1e-8) + 1e-8 * np.eye(len(r))


def subsample(seed: int, k: int, n: int, share: float | None) -> np.ndarray:
    """The numbers of the samples of repeat k, without replacement."""
    size = max(2, int((share or subsample_share(n)) * n))
    return np.random.default_rng([seed, k]).choice(n, size, replace=False)


def coded(correlations, first: np.ndarray, count: int, ratio: float):
    """Pairs of a repeat and the codes of its selections, from pairs of a repeat and its correlations; the penalties are those of `first`."""
    lam = penalties_of(first, count, ratio)
    for k, r in correlations:
        yield k, (neighbourhoods(r, lam).transpose(1, 2, 0) * (2.0 ** np.arange(count))).sum(axis=2)


def selections(cells: DataFrame, transform, subsamples: int, count: int, ratio: float, share, min_samples: int, seed: int) -> DataFrame:
    """(condition, repeat, left, right, value): value codes the penalties (bit a = a-th) that select the pair; repeat 0 is all samples.

    Correlations are those of transform(x), which works on rows of the matrix."""

    def draws(n):
        yield 0, None
        for k in range(1, subsamples + 1):
            yield k, np.bincount(subsample(seed, k, n, share), minlength=n)

    def kernel(table, ks):
        sums, p = sums_of(table)
        of = lambda k: correlation(covariance(sums[k], p))
        return coded(((k, of(k)) for k in ks), of(0), count, ratio)

    blocked, names = blocks(cells, min_samples)
    return in_lanes(moments(blocked, transform, draws), names, subsamples + 1, kernel)


def stars(picked: DataFrame, subsamples: int, count: int, threshold: float) -> DataFrame:
    """StARS over selections(): (condition, penalty, stability, left, right) of the pairs selected at the densest penalty whose
    monotone instability is within the threshold; with none within it, the sparsest."""
    bits = picked.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("on", F.expr("(cast(value as bigint) >> a) & 1"))
    by = ["condition", "a", "left", "right"]
    per = bits.groupBy(*by).agg((F.sum(F.when(F.col("repeat") > 0, F.col("on")).otherwise(0)) / subsamples).alias("f"), F.max(F.when(F.col("repeat") == 0, F.col("on"))).alias("own"))
    curve = per.groupBy("condition", "a").agg(F.avg(2 * F.col("f") * (1 - F.col("f"))).alias("instability"))
    run = Window.partitionBy("condition").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    best = curve.withColumn("d", F.max("instability").over(run)).groupBy("condition").agg(F.coalesce(F.max(F.when(F.col("d") <= threshold, F.col("a"))), F.lit(0)).alias("a"))
    return per.join(best, ["condition", "a"]).where("own = 1").select("condition", F.col("a").alias("penalty"), F.col("f").alias("stability"), "left", "right")


def instability(picked: DataFrame, subsamples: int, count: int) -> DataFrame:
    """(condition, a, instability) of selections()."""
    bits = picked.where("repeat > 0").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("on", F.expr("(cast(value as bigint) >> a) & 1"))
    f = bits.groupBy("condition", "a", "left", "right").agg((F.sum("on") / subsamples).alias("f"))
    return f.groupBy("condition", "a").agg(F.avg(2 * F.col("f") * (1 - F.col("f"))).alias("instability"))


#: What wide_conditions() calls few samples and many features (fixed values).
FEW_SAMPLES, MANY_FEATURES = 10, 200


def wide_conditions(cells: DataFrame) -> DataFrame:
    """(condition): those with FEW_SAMPLES at most and MANY_FEATURES varying features at least, whose selections rest on little. They are told, not treated otherwise."""
    samples = cells.groupBy("condition").agg(F.countDistinct("sample_id").alias("samples")).where(F.col("samples") <= FEW_SAMPLES)
    by = cells.join(samples, "condition").groupBy("condition", "feature").agg(F.max("samples").alias("samples"), F.count_if(F.col("value") != 0).alias("present"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    varying = by.where((F.col("lo") < F.col("hi")) | ((F.col("present") > 0) & (F.col("present") < F.col("samples"))))
    return varying.groupBy("condition").agg(F.count("*").alias("n")).where(F.col("n") >= MANY_FEATURES).select("condition")


def spieceasi(cells: DataFrame, penalties: int = 20, ratio: float = 1e-3, subsamples: int = 20, threshold: float = 0.05, pseudo: float = 0.5, seed: int = 17) -> DataFrame:
    """(condition, left, right, weight, p, selected): MB on centred log-ratios with StARS; weight is the selection share, p is null.

    Every condition gets the same numbers of penalties and subsamples, whatever its size."""
    picked = selections(cells, lambda x: centred_logs(x, pseudo), subsamples, penalties, ratio, None, 4, seed)
    return stars(picked, subsamples, penalties, threshold).select("condition", "left", "right", F.col("stability").alias("weight"), F.lit(None).cast("double").alias("p"), F.lit(True).alias("selected"))


# --- SPRING (Yoon et al. 2019) ----------------------------------------------------------------------


def mclr_matrix(x: np.ndarray) -> np.ndarray:
    logs = np.where(x > 0, np.log(np.where(x > 0, x, 1)), 0)
    n = np.maximum((x > 0).sum(axis=1, keepdims=True), 1)
    c = np.where(x > 0, logs - logs.sum(axis=1, keepdims=True) / n, 0)
    low = c[x > 0].min() if (x > 0).any() else 0
    return np.where(x > 0, c - low + 1, 0)


def kendall_matrix(x: np.ndarray, pairs: int = 1 << 18) -> np.ndarray:
    """Kendall's tau-a of every two columns. Sample pairs are taken in blocks of about `pairs`, so memory does not grow with their number."""
    n, p = x.shape
    if n < 2 or not p:
        return np.zeros((p, p))
    codes = np.column_stack([np.unique(c, return_inverse=True)[1] for c in x.T]).astype(np.int32)
    step, total = max(1, pairs // n), np.zeros((p, p))

    def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = np.sign(a[:, None] - b[None]).reshape(-1, p).astype(np.float32)
        return (s.T @ s).astype(float)  # sums of at most 2^24 signs are exact

    for at in range(0, n, step):
        block, after = codes[at : at + step], codes[at + step :]
        total += products(block, block) / 2
        if len(after):
            total += products(block, after)
    return total / (n * (n - 1) / 2)


def crossings(values: np.ndarray) -> int:
    """Pairs i < j with values[i] > values[j] >= 0. Places in the order are settled from the highest bit down; after each bit the values of one
    prefix are a row of equal length, so a bit costs a few passes over the array."""
    n = len(values)
    bits = max(0, n - 1).bit_length()
    place = np.sort(values.astype(np.int64) << 32 | np.arange(n)) & 0xFFFFFFFF  # equal values by place: they do not cross
    rank = np.arange(1 << bits, dtype=np.int32)  # what fills up to a power of two crosses nothing
    rank[place] = np.arange(n, dtype=np.int32)
    total = 0
    for bit in range(bits - 1, -1, -1):
        half = 1 << bit
        low = (rank & half) == 0
        at = np.flatnonzero(low)  # in a row, what lies between the low values are the high ones before them
        rows = len(rank) // (2 * half)
        total += int(at.sum()) - half * 2 * half * (rows * (rows - 1) // 2) - rows * (half * (half - 1) // 2)
        split = np.empty((rows, 2 * half), np.int32)
        split[:, :half] = rank[at].reshape(rows, half)
        split[:, half:] = rank[~low].reshape(rows, half)
        rank = split.ravel()
    return total


def ties(ordered: np.ndarray) -> int:
    """Pairs of equal values."""
    ends = np.flatnonzero(np.concatenate((ordered[1:] != ordered[:-1], [True])))
    runs = np.diff(ends, prepend=-1)
    return int((runs * (runs - 1) // 2).sum())


def taus(a: np.ndarray, b: np.ndarray, picks: list) -> list[float]:
    """Kendall's tau-a of two columns of codes over each pick (a mask of the samples, None: all)."""
    key = a.astype(np.int64) << 32 | b
    order = np.argsort(key)
    key, out = key[order], []
    for pick in picks:
        own = key if pick is None else key[pick[order]]
        second = own & 0xFFFFFFFF
        every = len(own) * (len(own) - 1) // 2
        tied = ties(own >> 32) + ties(np.sort(second)) - ties(own)
        out.append((every - tied - 2 * crossings(second)) / every if every else 0.0)
    return out


def latent_table(grid: int = 41, points: int = 4000, seed: int = 5):
    """Kendall's tau of two truncated normals by latent correlation and shares of zeros, on fixed quasi-random points."""
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((points, 4))
    rho = np.linspace(-0.99, 0.99, grid)
    return z, rho


def latent_correlation(x: np.ndarray) -> np.ndarray:
    return bridged(kendall_matrix(x), (x <= 0).mean(axis=0))


def bridged(tau: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Inverts the bridge tau(rho, zero shares) of truncated variables: pairs of columns on a grid of latent
    correlations whose tau is the mean sign product of simulated truncated normals with the same zero shares."""
    z, rho = latent_table()
    cut = np.array([_quantile(q) for q in zero])
    p = len(tau)
    out = np.eye(p)
    first = np.stack([np.sign(np.maximum(z[:, 0], c) - np.maximum(z[:, 2], c)) for c in cut], 1)
    w = np.sqrt(1 - rho * rho)[:, None]
    a2, b2 = rho[:, None] * z[:, 0] + w * z[:, 1], rho[:, None] * z[:, 2] + w * z[:, 3]
    for j in range(p - 1):
        best = np.sign(np.maximum(a2, cut[j]) - np.maximum(b2, cut[j])) @ first[:, j + 1 :] / len(z)
        for i in range(j + 1, p):
            out[i, j] = out[j, i] = np.interp(tau[i, j], np.maximum.accumulate(best[:, i - j - 1]), rho)
    values, vectors = np.linalg.eigh(out)
    return to_correlation((vectors * np.maximum(values, 1e-4)) @ vectors.T) * 0.99 + 0.01 * np.eye(p)


def _quantile(q: float) -> float:
    """Normal quantile by bisection of erf; minus infinity at 0."""
    if q <= 0:
        return -math.inf
    lo, hi = -8.0, 8.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < q else (lo, mid)
    return lo


def kendall_parts(blocked: DataFrame, picks) -> DataFrame:
    """(condition, repeat, p, i, j, tau) of the centred logs of the present cells, zeros being least; i = j: the share of zeros.

    picks(n): the numbers of the samples of each repeat, None for all. A task gets the columns of two groups of COLUMNS features."""

    def columns(table: pa.Table) -> pa.Table:
        one = {c: table.column(c)[0].as_py() for c in ("condition", "block", "n", "p")}
        x = dense(table)
        logs = np.where(x > 0, np.log(np.where(x > 0, x, 1)), 0)
        z = np.where(x > 0, logs - logs.sum(axis=1, keepdims=True) / np.maximum((x > 0).sum(axis=1, keepdims=True), 1), -np.inf)
        groups = range(-(-one["p"] // COLUMNS))
        data = [np.ascontiguousarray(z[:, g * COLUMNS : (g + 1) * COLUMNS].T).tobytes() for g in groups]
        return pa.table({**{c: pa.array([v] * len(data)).cast(t) for (c, v), t in zip(one.items(), (pa.string(), pa.int32(), pa.int64(), pa.int32()), strict=True)}, "g": pa.array(groups, pa.int32()), "data": pa.array(data, pa.binary()), "least": pa.array([float(z[x > 0].min()) if (x > 0).any() else None] * len(data), pa.float64())})

    def compared(table: pa.Table) -> pa.Table:
        condition, n, p, low, high = (table.column(c)[0].as_py() for c in ("condition", "n", "p", "low", "high"))
        parts: dict[int, list] = {}
        for g, block, data in sorted(zip(*(table.column(c).to_pylist() for c in ("g", "block", "data")), strict=True)):
            parts.setdefault(g, []).append(np.frombuffer(data).reshape(min(COLUMNS, p - g * COLUMNS), -1))
        columns = {g * COLUMNS + i: np.concatenate([b[i] for b in found]) for g, found in parts.items() for i in range(len(found[0]))}
        zero = {c: np.isneginf(v) for c, v in columns.items()}
        least = table.column("least")[0].as_py()  # shifted as in mclr_matrix, so values that its rounding makes equal are equal here
        codes = {c: np.unique(np.where(zero[c], 0.0, v - least + 1), return_inverse=True)[1].astype(np.int32) for c, v in columns.items()}
        masks = []
        for own in picks(n):
            masks.append(None if own is None else np.zeros(n, bool))
            if own is not None:
                masks[-1][own] = True
        rows = []
        for i in codes:
            if low == high:
                rows += [(k, i, i, float((zero[i] if m is None else zero[i][m]).mean())) for k, m in enumerate(masks)]
            for j in codes:
                if i < j and {i // COLUMNS, j // COLUMNS} == {low, high}:
                    rows += [(k, i, j, t) for k, t in enumerate(taus(codes[i], codes[j], masks))]
        k, i, j, t = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table([pa.array([condition] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array([p] * len(k), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(t, pa.float64())], names=["condition", "repeat", "p", "i", "j", "tau"])

    stored = cut(blocked.groupBy("condition", "block").applyInArrow(columns, "condition string, block int, n long, p int, g int, data binary, least double"), "columns")
    others = F.sequence(F.lit(0), F.floor((F.col("p") - 1) / COLUMNS).cast("int"))
    met = stored.withColumn("h", F.explode(others)).select("*", F.least("g", "h").alias("low"), F.greatest("g", "h").alias("high")).drop("h", "least")
    met = met.join(F.broadcast(stored.groupBy("condition").agg(F.coalesce(F.min("least"), F.lit(0.0)).alias("least"))), "condition")
    return spread(met, "condition", "low", "high").groupBy("condition", "low", "high").applyInArrow(compared, "condition string, repeat int, p int, i int, j int, tau double")


def spring(cells: DataFrame, penalties: int = 20, ratio: float = 1e-2, subsamples: int = 20, threshold: float = 0.1, seed: int = 17) -> DataFrame:
    """(condition, left, right, weight, p, selected): weight is the latent correlation of selected pairs, p is null."""
    picks = lambda n: [None, *(subsample(seed, k, n, 0.8) for k in range(1, subsamples + 1))]

    def kernel(table, ks):
        p = table.column("p")[0].as_py()
        k, i, j, t = (table.column(c).to_numpy() for c in ("repeat", "i", "j", "tau"))
        tau = {a: np.zeros((p, p)) for a in (0, *ks)}
        for a, m in tau.items():
            own = k == a
            m[i[own], j[own]] = m[j[own], i[own]] = t[own]
        latent = lambda a: bridged(tau[a], np.diag(tau[a]))
        first = latent(0)
        if 0 in ks:
            yield -1, first
        yield from coded(((a, latent(a) if a else first) for a in ks), first, penalties, ratio)

    blocked, names = blocks(cells, 6, drop_empty=True)
    rows = cut(in_lanes(cut(kendall_parts(blocked, picks), "taus"), names, subsamples + 1, kernel), "selections")
    chosen = stars(rows.where("repeat >= 0"), subsamples, penalties, threshold)
    latent = rows.where("repeat = -1").select("condition", "left", "right", F.col("value").alias("weight"))
    return chosen.join(latent, ["condition", "left", "right"]).select("condition", "left", "right", "weight", F.lit(None).cast("double").alias("p"), F.lit(True).alias("selected"))


#: Registry of methods: cells (condition, sample_id, feature, value) -> pair rows.
METHODS = {"sparcc": sparcc, "cclasso": cclasso, "spieceasi": spieceasi, "spring": spring}
