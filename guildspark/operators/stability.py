"""Repeatability metrics over tables of clusters (run_id, node)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guildspark.sources.staging import cut

from .selection import percentiles


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, median, min, max, p05, p95 and population deviation of the finite values. Percentiles are exact, and no task holds a group."""
    by = list(by or [])
    v = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value).cast("double"))
    rows = cut(df.select(F.struct(*[F.col(c) for c in by], F.lit(0).alias("_")).alias("g"), v.alias("v")), "values")
    moments = rows.groupBy("g").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop("v").alias("stdev"))
    if not by:  # a table without rows has a row of its own
        moments = moments.unionByName(rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.struct(F.lit(0).alias("_")).alias("g"), F.lit(0).cast("long").alias("count"), *[F.lit(None).cast("double").alias(c) for c in ("mean", "min", "max", "stdev")]))
    shares = {"median": 0.5, "p05": 0.05, "p95": 0.95}
    at = percentiles(rows.where("v is not null"), list(shares.values())).groupBy("g").agg(*[F.max(F.when(F.col("share") == s, F.col("v"))).alias(n) for n, s in shares.items()])
    return moments.join(at, "g", "left").select(*[F.col(f"g.`{c}`") for c in by], "count", "mean", "median", "min", "max", "p05", "p95", "stdev")


def pairwise_jaccard(clusters: DataFrame) -> DataFrame:
    """(run_a, run_b, jaccard) of all pairs of runs; two empty clusters would be 1, and have no rows to say so.

    Shared nodes are counted by a join on the node, sizes come from the runs: no product of clusters is built."""
    c = clusters.select("run_id", "node").distinct()
    size = c.groupBy("run_id").agg(F.count("*").alias("size"))
    a, b = c.select(F.col("run_id").alias("run_a"), "node"), c.select(F.col("run_id").alias("run_b"), "node")
    shared = a.join(b, "node").where("run_a < run_b").groupBy("run_a", "run_b").agg(F.count("*").alias("both"))
    runs_a, runs_b = size.select(F.col("run_id").alias("run_a"), F.col("size").alias("na")), size.select(F.col("run_id").alias("run_b"), F.col("size").alias("nb"))
    pairs = runs_a.join(runs_b, F.col("run_a") < F.col("run_b")).join(shared, ["run_a", "run_b"], "left")
    both = F.coalesce("both", F.lit(0))
    return pairs.select("run_a", "run_b", (both / (F.col("na") + F.col("nb") - both)).alias("jaccard"))


def consensus(clusters: DataFrame) -> DataFrame:
    """(node, runs, frequency, consensus_80, consensus_90, in_all)."""
    n = clusters.agg(F.countDistinct("run_id").alias("_n"))
    by = clusters.select("run_id", "node").distinct().groupBy("node").agg(F.count("*").alias("runs"))
    f = F.col("runs") / F.col("_n")
    return by.crossJoin(F.broadcast(n)).select("node", "runs", f.alias("frequency"), (f >= 0.8).alias("consensus_80"), (f >= 0.9).alias("consensus_90"), (F.col("runs") == F.col("_n")).alias("in_all"))


def frequency_histogram(clusters: DataFrame) -> DataFrame:
    return consensus(clusters).groupBy(F.bround("frequency", 4).alias("frequency")).agg(F.count("*").alias("nodes"))


def cluster_hashes(clusters: DataFrame) -> DataFrame:
    """(run_id, hash): SHA-1 of the sorted names, twelve hex digits."""
    names = F.array_join(F.array_sort(F.collect_set("node")), "\x1f")
    return clusters.groupBy("run_id").agg(F.substring(F.sha1(names.cast("binary")), 1, 12).alias("hash"))


def distinct_clusters(clusters: DataFrame) -> DataFrame:
    by = cluster_hashes(clusters).groupBy("hash").agg(F.count("*").alias("n"))
    return by.agg(F.count("*").alias("distinct_clusters"), F.max("n").alias("largest_group"), F.sum("n").alias("runs"))


def above_chance(jaccard: float, mean_size: float, n_nodes: int) -> float:
    """Jaccard over that of random sets of the mean size, scaled to 1."""
    null = mean_size / (2 * n_nodes - mean_size)
    return (jaccard - null) / (1 - null) if null < 1 else 0.0


def support(clusters: DataFrame, base: DataFrame) -> DataFrame:
    """(node, support): share of the nested runs that hold each node of the base cluster."""
    n = clusters.agg(F.countDistinct("run_id").alias("_n"))
    by = clusters.select("run_id", "node").distinct().groupBy("node").agg(F.count("*").alias("_k"))
    return base.select("node").distinct().join(by, "node", "left").crossJoin(F.broadcast(n)).select("node", (F.coalesce("_k", F.lit(0)) / F.col("_n")).alias("support"))


def escapes(clusters: DataFrame, base: DataFrame) -> DataFrame:
    """(run_id, escaped): members of a run outside the base cluster."""
    b = base.select("node").distinct().withColumn("_in", F.lit(1))
    return clusters.select("run_id", "node").distinct().join(b, "node", "left").groupBy("run_id").agg(F.count_if(F.col("_in").isNull()).alias("escaped"))


def asymmetry(nested: DataFrame) -> DataFrame:
    """Over pairs of seeds of nested runs (seed, node): how many find each other, one way only, or not at all.

    Only seeds that are found by another make rows; the pairs that do not find each other are what is left of all pairs."""
    found = nested.select("seed", "node").distinct()
    seeds = found.select("seed").distinct()
    hits = found.where("seed <> node").join(seeds.select(F.col("seed").alias("node")), "node", "left_semi")
    turned = F.col("seed") < F.col("node")
    pairs = hits.groupBy(F.least("seed", "node").alias("a"), F.greatest("seed", "node").alias("b")).agg(F.bool_or(turned).alias("x"), F.bool_or(~turned).alias("y"))
    counts = pairs.agg(F.count("*").alias("_met"), F.count_if(F.col("x") & F.col("y")).alias("both"), F.count_if(F.col("x") & ~F.col("y")).alias("only_left"), F.count_if(~F.col("x") & F.col("y")).alias("only_right"))
    every = seeds.agg(F.count("*").alias("_n")).select((F.col("_n") * (F.col("_n") - 1) / 2).cast("long").alias("_all"))
    return counts.crossJoin(every).select("both", "only_left", "only_right", (F.col("_all") - F.col("_met")).alias("neither"))  # one row each


def condition_summary(selections: DataFrame) -> DataFrame:
    """(rule, runs, share) of selection rows."""
    n = selections.agg(F.count("*").alias("_n"))
    return selections.groupBy("rule").agg(F.count("*").alias("runs")).crossJoin(F.broadcast(n)).select("rule", "runs", (F.col("runs") / F.col("_n")).alias("share"))


def stability_scores(tried: DataFrame) -> DataFrame:
    """Adds `score` to rows with strict_rate, jaccard_above and support_above: the mean of the last two, null where under
    nine of ten runs were strict."""
    return tried.withColumn("score", F.when(F.col("strict_rate") >= 0.9, (F.col("jaccard_above") + F.col("support_above")) / 2))


def best_parameters(scored: DataFrame) -> DataFrame:
    """(parameter, value, score, gain): per parameter the value of the highest score (the smallest among equals) and what it
    gains over the default, which is the row of `parameter` null; parameters that gain nothing are left out."""
    default = scored.where("parameter is null").agg(F.max("score").alias("_base"))
    best = scored.where("parameter is not null and score is not null").groupBy("parameter").agg(F.max(F.struct("score", (-F.col("value")).alias("less"))).alias("m"))
    gain = F.col("m.score") - F.coalesce("_base", F.lit(float("-inf")))
    return best.crossJoin(F.broadcast(default)).where(gain > 0).select("parameter", (-F.col("m.less")).alias("value"), F.col("m.score").alias("score"), gain.alias("gain"))


def strict_summary(reports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per group of selection reports: how many runs met all strict conditions, fell back or stayed alone, the mean
    number of met conditions, and the pass rate of each condition."""
    strict, n = F.count_if(F.col("strategy") == "target_conductance"), F.count("*")
    rate = lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0))
    passed = [rate(F.count_if(F.col(c))).alias(f"{c.removesuffix('_ok')}_pass_rate") for c in ("volume_ok", "prob_ok", "phi_ok")]
    return reports.groupBy(*(by or [])).agg(n.alias("runs"), strict.alias("strict_success"), rate(strict).alias("strict_success_rate"), (n - strict).alias("fallback_runs"), F.count_if(F.col("strategy") == "seed_singleton_fallback").alias("seed_singleton_runs"), F.avg("conditions_met").alias("conditions_met_mean"), *passed)


def strict_counts(reports: DataFrame) -> DataFrame:
    """(what, name, runs): reports by strategy, by number of met conditions, and by failed condition."""
    pair = lambda what, c: F.struct(F.lit(what).alias("what"), c.cast("string").alias("name"))
    said = F.concat(F.array(pair("strategy", F.col("strategy")), pair("conditions_met", F.col("conditions_met"))), F.transform("failed_conditions", lambda x: pair("failed", x)))
    return reports.select(F.explode(said).alias("s")).groupBy("s.what", "s.name").agg(F.count("*").alias("runs"))


def mean_stability(pairs: DataFrame) -> DataFrame:
    """(condition, selected_edges, mean_edge_stability) of pairs whose rho is a selection share; 0 without a selected edge."""
    own = F.when(F.col("selected"), F.col("rho"))
    return pairs.groupBy("condition").agg(F.count(own).alias("selected_edges"), F.coalesce(F.avg(own), F.lit(0.0)).alias("mean_edge_stability"))
