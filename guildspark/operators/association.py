"""Pairwise rank correlation over long abundance tables, per condition.

A pair sees the samples in which both features are present; ranks are averaged over ties inside those
samples. If every feature of a group is present in the same samples, ranks per feature are the ranks per
pair, and `spearman_complete` needs one sort per feature instead of one per pair."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guildspark.sources.staging import cut

from .ranks import row_numbers

MIN_OBSERVATIONS = 3


def in_condition(abundance: DataFrame, metadata: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Cells of samples that the metadata knows, with their condition."""
    meta = metadata if wanted is None else metadata.where(F.col("condition").isin(*wanted))
    return abundance.join(meta, "sample_id").select("condition", "sample_id", "feature", "value")


def pair_cells(cells: DataFrame, lanes: int | None = None) -> DataFrame:
    """Cells of each feature pair (left < right) in each sample. One exchange by sample, into `lanes` partitions or the session's number; the order is a residual predicate."""
    left = cells.select("condition", "sample_id", F.col("feature").alias("left"), F.col("value").alias("x"))
    right = cells.select("condition", "sample_id", F.col("feature").alias("right"), F.col("value").alias("y"))
    if lanes is not None:
        left, right = (side.repartition(lanes, "condition", "sample_id") for side in (left, right))
    return left.join(right, ["condition", "sample_id"]).where("left < right")


def cross_cells(first: DataFrame, second: DataFrame, lanes: int | None = None) -> DataFrame:
    """Cells of each pair of a feature of one domain and a feature of the other, in samples that both have in the same condition; lanes as in pair_cells."""
    left = first.select("condition", "sample_id", F.col("feature").alias("left"), F.col("value").alias("x"))
    right = second.select("condition", "sample_id", F.col("feature").alias("right"), F.col("value").alias("y"))
    if lanes is not None:
        left, right = (side.repartition(lanes, "condition", "sample_id") for side in (left, right))
    return left.join(right, ["condition", "sample_id"])


def average_rank(value: str, by: list[str]) -> Column:
    ordered = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(ordered) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def _correlation(groups: DataFrame, by: list[str]) -> DataFrame:
    """Pearson of rx, ry, null where one is constant; ANSI mode would raise in corr()."""
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.when(spread > 0, spread))
    return groups.groupBy(*by).agg(F.count("*").alias("n"), rho.alias("_rho")).where((F.col("n") >= MIN_OBSERVATIONS) & F.col("_rho").isNotNull()).select(*by, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "_rho")).alias("rho"), "n")


def spearman(cells: DataFrame, lanes: int | None = None) -> DataFrame:
    """(condition, left, right, rho, n) from pair cells; pairs under three observations or constant are left out.

    Equal points of a pair are counted before anything is dealt by pair, so what a task sorts grows with the different points. The
    mean of n average ranks is (n + 1) / 2. lanes: partitions of the points, dealt by ranges of pairs, in the place of the session's number."""
    by = ["condition", "left", "right"]
    points = cells.groupBy(*by, "x", "y").agg(F.count("*").alias("c"))
    if lanes is not None:
        points = points.repartitionByRange(lanes, *by)  # by hash, a task would get many pairs and another none
    ranked = points.withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    for r, v in (("rx", "x"), ("ry", "y")):  # twice the rank, less twice the mean rank
        upto, tied = F.sum("c").over(Window.partitionBy(*by).orderBy(v)), F.sum("c").over(Window.partitionBy(*by, v))
        ranked = ranked.withColumn(r, (2 * upto - tied - F.col("n")).cast("double"))
    moment = lambda a, b: F.sum(F.col("c") * F.col(a) * F.col(b))
    sums = ranked.groupBy(*by).agg(F.max("n").alias("n"), moment("rx", "ry").alias("xy"), moment("rx", "rx").alias("xx"), moment("ry", "ry").alias("yy"))
    rho = F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))
    return sums.where((F.col("n") >= MIN_OBSERVATIONS) & (F.col("xx") > 0) & (F.col("yy") > 0)).select(*by, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)).alias("rho"), "n")


def spearman_complete(cells: DataFrame) -> DataFrame:
    """As spearman() of all pairs, where each feature is present in every sample of its condition: ranks are taken once."""
    ranked = cells.withColumn("value", average_rank("value", ["condition", "feature"]))
    pairs = pair_cells(ranked).withColumnRenamed("x", "rx").withColumnRenamed("y", "ry")
    return _correlation(pairs, ["condition", "left", "right"])


def gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a) for a > 0: the series in 1 / z at z = a + 16, carried back by the recurrence."""
    z = a + 16.0
    series = F.lit(0.0)
    for c in (869 / 4194304, -399 / 262144, -21 / 32768, 5 / 1024, 1 / 128, -1 / 8):
        series = (series + c) / z
    out = F.sqrt(z) * (1 + series)
    for k in range(16):
        out = out * ((a + float(k)) / (a + (k + 0.5)))
    return out


def beta_fraction(a: Column, b: Column, x: Column, terms: int = 56) -> Column:
    """The continued fraction of the incomplete beta function, from its last term inwards. For b = 1/2 or a = 1/2 and x on the
    side of its mean that `with_p` chooses, 56 terms leave an error of 3e-11, whatever the other parameter is."""
    v = F.lit(1.0)
    for j in range(terms, 0, -1):
        m = float(j // 2)
        d = m * (b - m) * x / ((a + (2 * m - 1)) * (a + 2 * m)) if j % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + (2 * m + 1)))
        v = 1.0 + d / v
    return 1.0 / v


def with_p(pairs: DataFrame) -> DataFrame:
    """Adds the two-sided p-value of Student's t with n - 2 degrees of freedom: I(df / 2, 1/2) at 1 - rho^2, the regularised
    incomplete beta function, or 1 - I(1/2, df / 2) at rho^2 where that fraction settles sooner.

    The work per pair does not depend on n. Null under three observations, 0 where |rho| is 1."""
    half, r2 = (F.col("n") - 2) / F.lit(2.0), F.col("rho") * F.col("rho")
    sound = (F.col("n") > 2) & (F.abs("rho") < 1)
    small = half * r2 < 1.5 * (1 - r2)
    sides = {"a": F.when(small, 0.5).otherwise(half), "b": F.when(small, half).otherwise(0.5), "x": F.when(small, r2).otherwise(1 - r2)}
    names = {k: f"_{k}_of_p" for k in (*sides, "small", "front")}
    front = F.abs("rho") * F.exp(half * F.log1p(-r2)) * gamma_ratio(half) / F.lit(math.sqrt(math.pi))
    staged = pairs.withColumns({names[k]: F.when(sound, c) for k, c in (sides | {"small": small, "front": front}).items()})
    a, b, x = (F.col(names[k]) for k in "abx")
    tail = F.col(names["front"]) / a * beta_fraction(a, b, x)
    within = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col(names["small"]), 1 - tail).otherwise(tail)))
    p = F.when(sound, within).when((F.col("n") > 2) & (F.abs("rho") >= 1), 0.0)
    return staged.withColumn("p", p).drop(*names.values())


def significant(pairs: DataFrame, max_p: float | None = 0.05, min_abs: float = 0.0) -> DataFrame:
    """Both thresholds are inclusive; a null p fails; max_p None keeps the rows that a method selected."""
    kept = pairs.where(F.col("selected")) if max_p is None else pairs.where(F.col("p") <= max_p)
    return kept.where(F.abs("rho") >= min_abs)


def oriented(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Pairs with the feature on the left that comes first by order (feature, place), names among equals; one without a place comes last."""
    a, b = order.select(F.col("feature").alias("left"), F.col("place").alias("_a")), order.select(F.col("feature").alias("right"), F.col("place").alias("_b"))
    placed = pairs.join(a, "left", "left").join(b, "right", "left")
    turn = F.coalesce(F.col("_b") < F.col("_a"), F.col("_a").isNull() & F.col("_b").isNotNull())
    return placed.withColumns({"left": F.when(turn, F.col("right")).otherwise(F.col("left")), "right": F.when(turn, F.col("left")).otherwise(F.col("right"))}).select(*pairs.columns)


def inversions(values: np.ndarray, groups: np.ndarray | None = None) -> int:
    """Pairs i < j with values[i] > values[j], of one group if groups are given: bits of the ranks are settled from the highest down, in
    arrays kept in order, so the work is n log n."""
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    upper = np.zeros(len(rank), np.int64) if groups is None else np.unique(groups, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(upper, kind="stable")
    rank, upper, total = rank[order], upper[order], 0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1
        ones = np.concatenate(([0], np.cumsum(one)))
        start = np.concatenate(([True], upper[1:] != upper[:-1]))
        first = np.maximum.accumulate(np.where(start, np.arange(len(rank)), 0))
        total += int((ones[:-1] - ones[first])[one == 0].sum())
        order = np.lexsort((one, upper))
        rank, upper = rank[order], 2 * upper[order] + one[order]
        upper = np.cumsum(np.concatenate(([0], upper[1:] != upper[:-1])))
    return total


def _discordant(groups: DataFrame, by: list[str], run: int) -> DataFrame:
    """(*by, discordant) of groups that one task may not hold: rows are numbered by x and by y, over ranges, and dealt into runs of
    `run` numbers by x and by y. Discordant pairs lie in one run, in one run of y, or in different ones of both, where counts tell."""
    x = row_numbers(groups, ["x", "y", "sample_id"], by, "px")
    both = cut(row_numbers(x.select(*by, "y", "px"), ["y", "px"], by, "py").withColumns({"run": F.floor((F.col("px") - 1) / run), "band": F.floor((F.col("py") - 1) / run)}).select(*by, "px", "py", "run", "band"), "places")
    out = T.StructType([*[both.schema[c] for c in by], T.StructField("d", T.LongType())])

    def within(subtract: str | None):
        def count(key, table):
            order = np.argsort(table.column("px").to_numpy())
            py = table.column("py").to_numpy()[order]
            d = inversions(py) - (inversions(py, table.column(subtract).to_numpy()[order]) if subtract else 0)
            return pa.table([pa.array([k.as_py()]) for k in key[: len(by)]] + [pa.array([d], pa.int64())], names=[*by, "d"])

        return count

    def across(key, table):
        runs, bands, n = (table.column(c).to_numpy() for c in ("run", "band", "n"))
        grid = np.zeros((runs.max() + 1, bands.max() + 1), np.int64)
        grid[runs, bands] = n
        higher = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1] - grid  # of the run, in higher bands
        earlier = np.cumsum(higher, axis=0) - higher  # of earlier runs, in higher bands
        d = sum(int(a) * int(b) for a, b in zip(grid[grid > 0], earlier[grid > 0], strict=True))
        return pa.table([pa.array([k.as_py()]) for k in key] + [pa.array([d], pa.int64())], names=[*by, "d"])

    own = both.groupBy(*by, "run").applyInArrow(within(None), out)
    banded = both.groupBy(*by, "band").applyInArrow(within("run"), out)
    counted = both.groupBy(*by, "run", "band").agg(F.count("*").alias("n"))
    far = counted.groupBy(*by).applyInArrow(across, out)
    return own.unionByName(banded).unionByName(far).groupBy(*by).agg(F.sum("d").alias("discordant"))


def kendall(cells: DataFrame, run: int = 1_000_000) -> DataFrame:
    """(condition, left, right, tau, n): Kendall's tau-a of pair cells with two samples at least, by counting discordant pairs.

    Pairs of samples are never built: discordant ones are inversions of y in the order of x, and ties are counts of equal values.
    A pair of features with up to `run` samples is one task's; longer ones are counted in runs."""
    by = ["condition", "left", "right"]
    n = cells.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    long = cut(n.where(F.col("n") > run), "long")
    pairs_in = lambda c: c * (c - 1) / 2
    schema = T.StructType([*[cells.schema[c] for c in by], T.StructField("tau", T.DoubleType()), T.StructField("n", T.LongType())])

    def tau(key, table):
        x, y = (table.column(c).to_numpy() for c in "xy")
        tied = sum(int(pairs_in(np.unique(v, axis=0, return_counts=True)[1].astype(object)).sum()) * sign for v, sign in ((x, 1), (y, 1), (np.stack((x, y), 1), -1)))
        every = len(x) * (len(x) - 1) // 2
        value = (every - tied - 2 * inversions(y[np.lexsort((y, x))])) / every if every else None
        return pa.table([pa.array([k.as_py()]) for k in key] + [pa.array([value], pa.float64()), pa.array([len(x)], pa.int64())], names=[*by, "tau", "n"])

    own = cells.select(*by, "sample_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if long.isEmpty():
        return own.groupBy(*by).applyInArrow(tau, schema).where("n > 1")
    keys = long.select(*by)
    short = own.join(keys, by, "left_anti").groupBy(*by).applyInArrow(tau, schema).where("n > 1")
    rest = cut(own.join(keys, by, "left_semi"), "long")
    ties = [rest.groupBy(*by, *v).agg(F.count("*").alias("c")).groupBy(*by).agg(F.sum(pairs_in(F.col("c").cast("decimal(19,0)"))).alias(f"t{i}")) for i, v in enumerate((["x"], ["y"], ["x", "y"]))]
    joined = long.join(_discordant(rest, by, run), by)
    for t in ties:
        joined = joined.join(t, by)
    every = pairs_in(F.col("n").cast("double"))
    concordant_less = every - F.col("t0") - F.col("t1") + F.col("t2") - 2 * F.col("discordant")
    return short.unionByName(joined.select(*by, (concordant_less / every).cast("double").alias("tau"), "n"))
