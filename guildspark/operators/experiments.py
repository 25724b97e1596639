"""Repeatability, nested consistency and parameter sweeps of the clustering: tables of runs instead of process pools."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guildspark.sources.commits import get_or_make
from guildspark.sources.staging import cut

from .community import Ladder, members, push, push_any, select, select_each, sweep
from .network import strongest


def clusters_of(edges: DataFrame, runs: DataFrame, ladder: Ladder, signed: bool = False, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """Clusters (run_id, node) and selections of many runs (run_id, condition, node, order_seed) in one plan.

    A run is a condition of its own for sweep and ladder: edges are repeated per run id of their condition."""
    m = strongest(edges).groupBy("condition").agg(F.count("*").alias("_m"))
    eps = F.lit(1.0) / (2.0**ladder.b * 48 * F.ceil(F.log2(F.greatest("_m", F.lit(2)).cast("double"))))
    jobs = runs.join(m, "condition").select("run_id", "condition", "node", F.lit(ladder.alpha).alias("alpha"), eps.alias("epsilon"), F.col("order_seed").cast("long").alias("order_seed"))
    jobs = cut(jobs, "runs")
    vector = cut(push(edges, jobs, weighted=weighted, walk_positive=signed).where("p > 0").select(F.col("run_id").cast("string").alias("condition"), "node", "p"), "vectors")
    keys = jobs.select("condition", F.col("run_id").cast("string").alias("_run"))
    own = edges.join(keys, "condition").select(F.col("_run").alias("condition"), "source", "target", "weight")
    seeds = jobs.select(F.col("run_id").cast("string").alias("condition"), "node")
    prefixes = cut(sweep(own, vector, weighted, signed), "prefixes")
    chosen = cut(select(prefixes, seeds, ladder), "chosen")
    return members(prefixes, seeds, chosen).select(F.col("condition").cast("long").alias("run_id"), "node"), chosen.withColumn("run_id", F.col("condition").cast("long")).drop("condition")


def repeatability(edges: DataFrame, seeds: DataFrame, ladder: Ladder, n: int = 100, **how) -> DataFrame:
    """Clusters of n runs per seed, each with its own order of pushes."""
    runs = seeds.withColumn("order_seed", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("run_id", F.xxhash64("condition", "node", "order_seed"))
    return clusters_of(edges, runs, ladder, **how)[0]


def nested(edges: DataFrame, seed: DataFrame, ladder: Ladder, **how) -> tuple[DataFrame, DataFrame]:
    """The base cluster of a seed, and the clusters that each of its members finds as a seed; run_id is a hash of the member."""
    first = seed.withColumn("order_seed", F.lit(None).cast("long")).withColumn("run_id", F.xxhash64("condition", "node"))
    base = clusters_of(edges, first, ladder, **how)[0].select("node")
    again = seed.select("condition").crossJoin(F.broadcast(base)).withColumn("order_seed", F.lit(None).cast("long")).withColumn("run_id", F.xxhash64("condition", "node"))
    return base, clusters_of(edges, again, ladder, **how)[0]


def parameter_sweep(edges: DataFrame, seeds: DataFrame, ladder: Ladder, values: dict[str, list]) -> DataFrame:
    """One parameter at a time: (parameter, value, step, rule, size, score, ...) of the seeds' clusters."""
    out = None
    runs = seeds.withColumn("order_seed", F.lit(None).cast("long")).withColumn("run_id", F.xxhash64("condition", "node"))
    for name, options in values.items():
        for v in options:
            chosen = clusters_of(edges, runs, replace(ladder, **{name: v}))[1]
            one = chosen.withColumn("parameter", F.lit(name)).withColumn("value", F.lit(float(v)))
            out = one if out is None else out.unionByName(one)
    return out


#: Whether a mode of a sweep takes the weights or counts edges (fixed values).
WEIGHT_MODES = {"weighted": True, "unweighted": False}


def in_modes(edges: DataFrame, modes: list[str] | None = None) -> DataFrame:
    """The graphs of each weight mode as graphs of their own, named condition/mode; unweighted edges keep their sign."""
    wanted = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(WEIGHT_MODES[m]).alias("own")) for m in (modes or WEIGHT_MODES)])
    each = edges.select("condition", "source", "target", "weight", F.explode(wanted).alias("m"))
    return each.select(F.concat_ws("/", "condition", "m.mode").alias("condition"), "source", "target", F.when(F.col("m.own"), F.col("weight")).otherwise(F.when(F.col("weight") < 0, -1.0).otherwise(1.0)).alias("weight"))


def sweep_settings(spark: SparkSession, base: Ladder, values: dict[str, list]) -> DataFrame:
    """(parameter, value, phi, b, alpha, min_cut_size, max_cut_size): the base, with parameter null, and one parameter at a time."""
    rows = [(None, None, base)] + [(name, float(v), replace(base, **{name: v})) for name, options in values.items() for v in options if v != getattr(base, name)]
    fields = ("phi", "b", "alpha", "min_cut_size", "max_cut_size")
    return spark.createDataFrame([(n, v, *[getattr(x, f) for f in fields]) for n, v, x in rows], "parameter string, value double, phi double, b int, alpha double, min_cut_size int, max_cut_size int")


def parameter_table(edges: DataFrame, seeds: DataFrame, settings: DataFrame, modes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Clusters of every seed under every setting, in every network and weight mode, in one plan.

    settings: as of `sweep_settings`. Returns the selections (parameter, value, network, mode, node, step, rule, size, score, ...)
    and the members (setting, node). Settings that differ in the ladder alone share a push and a sweep."""
    graphs = cut(in_modes(edges, modes), "graphs")
    sizes = strongest(graphs).groupBy("condition").agg(F.count("*").alias("_m"))
    each = F.explode(F.array(*[F.lit(m) for m in (modes or WEIGHT_MODES)]))
    asked = seeds.select(F.col("condition").alias("network"), "node", each.alias("mode")).withColumn("graph", F.concat_ws("/", "network", "mode")).join(sizes.withColumnRenamed("condition", "graph"), "graph").crossJoin(settings)
    eps = F.lit(1.0) / (F.pow(F.lit(2.0), F.col("b").cast("double")) * 48 * F.ceil(F.log2(F.greatest("_m", F.lit(2)).cast("double"))))
    asked = cut(asked.withColumn("epsilon", eps).withColumn("run_id", F.xxhash64("graph", "node", "alpha", "epsilon")).withColumn("setting", F.xxhash64("graph", "node", "parameter", "value")), "settings")
    jobs = asked.select("run_id", F.col("graph").alias("condition"), "node", "alpha", "epsilon").distinct()
    pushed = push_any(graphs, jobs.withColumn("order_seed", F.lit(None).cast("long")))
    name = F.col("run_id").cast("string").alias("condition")
    vectors = cut(pushed.where("p > 0").select(name, "node", "p"), "vectors")
    own = jobs.select("run_id", F.col("condition").alias("graph")).join(graphs.withColumnRenamed("condition", "graph"), "graph").select(name, "source", "target", "weight")
    prefixes = cut(sweep(own, vectors), "prefixes")
    chosen = cut(select_each(prefixes, asked.select("setting", name, "node", "phi", "b", "min_cut_size", "max_cut_size")), "chosen")
    said = asked.select("setting", "parameter", "value", "network", "mode").join(chosen.drop("condition"), "setting")
    big = prefixes.join(chosen.where("step > 0").select("setting", "condition", "size"), "condition").where("k <= size").select("setting", "node")
    return said, big.unionByName(chosen.where("step = 0").select("setting", "node"))


#: The configurations that are compared (fixed values): whether each takes the tuned ladder and whether it is signed.
CONFIGURATIONS = {"baseline": (False, False), "new_parameters": (True, False), "signed_weights": (False, True), "both": (True, True)}


def configurations(edges: DataFrame, seeds: DataFrame, base: Ladder, tuned: Ladder, wanted: dict[str, tuple[bool, bool]] | None = None) -> DataFrame:
    """Clusters (config, run_id, node) of the seeds under each configuration."""
    out = None
    runs = seeds.withColumn("order_seed", F.lit(None).cast("long")).withColumn("run_id", F.xxhash64("condition", "node"))
    for name, (new, signed) in (CONFIGURATIONS if wanted is None else wanted).items():
        one = clusters_of(edges, runs, tuned if new else base, signed)[0].select(F.lit(name).alias("config"), "run_id", "node")
        out = one if out is None else out.unionByName(one)
    return out


def compare_configurations(edges: DataFrame, seeds: DataFrame, base: Ladder, tuned: Ladder, root: str, graph_key: str) -> DataFrame:
    """Like `configurations`, but what a former call stored under root for the same graph, ladder and signs is read, not run.

    graph_key names edges and seeds; the caller changes it with either."""
    spark, out = edges.sparkSession, None
    for name, (new, signed) in CONFIGURATIONS.items():
        ladder = tuned if new else base
        key = hashlib.sha1(json.dumps([graph_key, asdict(ladder), signed], sort_keys=True).encode()).hexdigest()
        stored = get_or_make(spark, root, f"run_{key}", lambda name=name, new=new, signed=signed: configurations(edges, seeds, base, tuned, {name: (new, signed)}).select("run_id", "node"))
        one = stored.select(F.lit(name).alias("config"), "run_id", "node")
        out = one if out is None else out.unionByName(one)
    return out
