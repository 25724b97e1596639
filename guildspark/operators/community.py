"""Communities around seeds: walk vectors, conductance sweeps as cumulative windows, and the selection ladder as one query.

Every table is keyed by `condition` (or any run key under that name), so many runs share a plan."""

from __future__ import annotations

import heapq
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guildspark.sources.staging import cut

from .network import adjacency, graph_stats, strongest, weighted_adjacency
from .walks import push_by_joins

#: Ladder constants (fixed values).
MIN_CUT_SIZE, SCALE_RELAXATIONS, PHI_FACTORS, TIE = 5, 2, (1.25, 1.5, 1.75, 2.0), 0.10
VOLUME_WEIGHT, MASS_WEIGHT = 0.5, 0.10
DEFAULT_PHI, DEFAULT_ALPHA, CLUSTER_SHARE = 0.4, 0.05, 0.10
#: Runs of a condition that one task pushes.
PER_LANE = 8
#: Adjacency rows of a condition that one task may hold; larger graphs are pushed by joins.
TASK_EDGES = 2_000_000
RULES = {1: "strict", 2: "quality_without_mass", 3: "multi_scale", 4: "relaxed_phi", 5: "penalty_best_effort", 0: "no_admissible_cluster"}


@dataclass(frozen=True)
class Ladder:
    phi: float = DEFAULT_PHI
    b: int | None = 10  # None: from the size of each graph
    alpha: float = DEFAULT_ALPHA
    min_cut_size: int = MIN_CUT_SIZE
    max_cut_size: int | None = None

    def __post_init__(self):
        if not self.phi > 0:
            raise ValueError("phi must be positive")
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha must be in (0, 1]")

    @property
    def floor(self) -> float:
        return 2.0 ** (self.b - 1)


def epsilon(b: int, m: int) -> float:
    return 1.0 / (2**b * 48 * math.ceil(math.log2(max(m, 2))))


def default_b(n: Column, m: Column) -> Column:
    """Scale of a cluster of about a tenth of the nodes; halves round to even."""
    n, m = F.greatest(F.lit(1), n), F.greatest(F.lit(1), m)
    size = F.greatest(F.lit(10), F.least(F.greatest(F.floor(n / 3), F.lit(10)), F.bround(CLUSTER_SHARE * n, 0)))
    volume = F.greatest(F.lit(2.0), 2 * m / n * size)
    most = F.greatest(F.lit(1), F.floor(F.log2(F.greatest(2 * m, F.lit(2)).cast("double"))))
    return F.greatest(F.lit(1), F.least(most, F.bround(F.log2(volume), 0))).cast("int")


def mass_threshold(m: Column) -> Column:
    return 1.0 / (48 * F.ceil(F.log2(F.greatest(m, F.lit(2)).cast("double"))))


def conductance(edges: DataFrame, members: DataFrame, weighted: bool = True) -> DataFrame:
    """(condition, volume, boundary, total, conductance) of a node set (condition, node); infinite if a side has no volume."""
    adj = weighted_adjacency(edges, weighted)
    u = members.select("condition", F.col("node").alias("u"), F.lit(1).alias("iu")).distinct()
    v = members.select("condition", F.col("node").alias("v"), F.lit(1).alias("iv")).distinct()
    sums = adj.join(u, ["condition", "u"], "left").join(v, ["condition", "v"], "left").groupBy("condition").agg(F.coalesce(F.sum(F.when(F.col("iu") == 1, F.col("w"))), F.lit(0.0)).alias("volume"), F.coalesce(F.sum(F.when((F.col("iu") == 1) & F.col("iv").isNull(), F.col("w"))), F.lit(0.0)).alias("boundary"), F.sum("w").alias("total"))
    least = F.least("volume", F.col("total") - F.col("volume"))
    return sums.withColumn("conductance", F.when(least > 0, F.try_divide("boundary", least)).otherwise(F.lit(float("inf"))))


def signed_composition(edges: DataFrame, members: DataFrame, sign_lambda: float = 1.0) -> DataFrame:
    """Positive volume, cut and inside weight, negative inside and cut weight, and the signed score of a node set."""
    e = strongest(edges).select("condition", F.col("source").alias("u"), F.col("target").alias("v"), "weight")
    u = members.select("condition", F.col("node").alias("u"), F.lit(1).alias("iu")).distinct()
    v = members.select("condition", F.col("node").alias("v"), F.lit(1).alias("iv")).distinct()
    j = e.join(u, ["condition", "u"], "left").join(v, ["condition", "v"], "left")
    w, ends = F.col("weight"), F.coalesce("iu", F.lit(0)) + F.coalesce("iv", F.lit(0))
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0.0))
    s = j.groupBy("condition").agg(
        total((w > 0) & (ends > 0), w * ends).alias("vol_pos"), total((w > 0) & (ends == 1), w).alias("cut_pos"), total((w > 0) & (ends == 2), w).alias("positive_inside"),
        total((w < 0) & (ends == 2), -w).alias("neg_inside"), total((w < 0) & (ends == 1), -w).alias("neg_cut"), total(w > 0, 2 * w).alias("total_pos_volume"),
    )
    s = s.withColumn("violations", F.col("cut_pos") + sign_lambda * F.col("neg_inside"))
    least = F.least("vol_pos", F.col("total_pos_volume") - F.col("vol_pos"))
    return s.withColumn("score", F.when(least > 0, F.try_divide("violations", least)).otherwise(F.lit(float("inf"))))


def power_walk(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, steps: int = 3, weighted: bool = True) -> DataFrame:
    """(condition, node, p): `steps` lazy-walk steps of personalised PageRank from the seeds (condition, node), as joins."""
    adj = weighted_adjacency(edges, weighted)
    w = Window.partitionBy("condition", "u")
    move = cut(adj.withColumn("m", F.col("w") / F.sum("w").over(w)).select("condition", "u", "v", "m"), "moves")
    start = cut(seeds.select("condition", "node", F.lit(1.0).alias("p")), "seeds")
    now = start
    for _ in range(steps):
        stay = now.select("condition", "node", (F.col("p") * (1 - alpha) / 2).alias("p"))
        go = now.withColumnRenamed("node", "u").join(move, ["condition", "u"]).select("condition", F.col("v").alias("node"), (F.col("p") * F.col("m") * (1 - alpha) / 2).alias("p"))
        back = start.select("condition", "node", F.lit(alpha).alias("p"))
        now = cut(stay.unionByName(go).unionByName(back).groupBy("condition", "node").agg(F.sum("p").alias("p")), "walk")
    return now


def sweep(edges: DataFrame, scores: DataFrame, weighted: bool = True, signed: bool = False, sign_lambda: float = 1.0, cap: float = 0.5, by_count: bool = False) -> DataFrame:
    """(condition, k, node, p, volume, cut, score, mass, total_volume, m): the prefixes up to half of the volume.

    Ordered by score over degree (at least 1), names among equals. The weight inside a prefix grows by the
    edges whose later end is its last node, so cut is one running sum. cap: the share of the total volume where the prefixes end; by_count: the order
    divides by the number of neighbours even in a weighted graph."""
    best = cut(strongest(edges), "graph")
    m = best.groupBy("condition").agg(F.count("*").alias("m"))
    walk = best.where("weight > 0") if signed else best
    adj = adjacency(walk).select("condition", "u", "v", (F.abs("weight") if weighted else F.lit(1.0)).alias("w"))
    deg = adj.groupBy("condition", F.col("u").alias("node")).agg(F.sum("w").alias("d"), F.count("*").alias("c"))
    total = deg.groupBy("condition").agg(F.sum("d").alias("total_volume"))
    own = scores.join(deg, ["condition", "node"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    order = Window.partitionBy("condition").orderBy(F.desc(F.col("p") / F.greatest("c" if by_count else "d", F.lit(1.0))), "node")
    ranked = cut(own.withColumn("k", F.row_number().over(order)), "ranked")  # scored nodes only; read by three joins below
    place = ranked.select("condition", F.col("node").alias("n"), F.col("k").alias("kn"))

    def inside(e: DataFrame, weight: Column, name: str) -> DataFrame:
        a = place.select("condition", F.col("n").alias("source"), F.col("kn").alias("ka"))
        b = place.select("condition", F.col("n").alias("target"), F.col("kn").alias("kb"))
        return e.join(a, ["condition", "source"]).join(b, ["condition", "target"]).groupBy("condition", F.greatest("ka", "kb").alias("k")).agg(F.sum(weight).alias(name))

    size = F.abs("weight") if weighted else F.lit(1.0)
    rows = ranked.join(inside(walk, size, "wi"), ["condition", "k"], "left")
    if signed:
        rows = rows.join(inside(best.where("weight < 0"), size, "ni"), ["condition", "k"], "left")
    else:
        rows = rows.withColumn("ni", F.lit(0.0))
    run = Window.partitionBy("condition").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("condition", "k", "node", "p", F.sum("d").over(run).alias("volume"), F.sum(F.col("d") - 2 * F.coalesce("wi", F.lit(0.0))).over(run).alias("cut"), F.sum(F.coalesce("ni", F.lit(0.0))).over(run).alias("neg_inside"), F.sum("p").over(run).alias("mass"))
    out = out.join(total, "condition").join(m, "condition").where(F.col("volume") <= F.floor(F.col("total_volume") * cap))
    least = F.least("volume", F.col("total_volume") - F.col("volume"))
    lam = sign_lambda if signed else 0.0
    return out.withColumn("score", F.when(least > 0, F.try_divide(F.col("cut") + lam * F.col("neg_inside"), least)).otherwise(F.lit(float("inf"))))


def penalty(score: Column, volume: Column, mass: Column, ladder: Ladder, floor: Column | None = None) -> Column:
    floor = F.lit(ladder.floor) if floor is None else floor
    octaves = F.when(volume <= 0, F.lit(float("inf"))).when(volume < floor, F.log2(floor / F.when(volume > 0, volume))).otherwise(0.0)
    return score / ladder.phi + VOLUME_WEIGHT * octaves - MASS_WEIGHT * F.least(mass, F.lit(1.0))


def select(prefixes: DataFrame, seeds: DataFrame, ladder: Ladder) -> DataFrame:
    """One row per seed (condition, node): step, rule, size, score, volume, mass, phi_used, floor_used.

    Every prefix is tested against the predicates of all steps at once; the first step that any prefix
    meets decides, and in it the smallest prefix within TIE of the best score (in the last step, the
    smallest penalty). Without an admissible prefix the seed stays alone (step 0). A column b of the seeds
    takes the place of the ladder's b in its condition."""
    own_b = "b" in seeds.columns
    at = prefixes.join(seeds.select("condition", "node"), ["condition", "node"]).select("condition", F.col("k").alias("seed_k"))
    p = prefixes.join(at, "condition", "left").where(F.col("k") >= F.greatest(F.lit(ladder.min_cut_size), F.coalesce("seed_k", F.lit(1))))
    if ladder.max_cut_size is not None:
        p = p.where(F.col("k") <= ladder.max_cut_size)
    if own_b:
        p = p.join(seeds.select("condition", "b"), "condition")
    tau, phi = mass_threshold(F.col("m")), ladder.phi
    floor = F.pow(F.lit(2.0), F.col("b") - 1) if own_b else F.lit(ladder.floor)
    rungs = [(1, floor, phi, F.col("mass") > tau), (2, floor, phi, F.lit(True))]
    rungs += [(3, floor / 2**k, phi, F.lit(True)) for k in range(1, SCALE_RELAXATIONS + 1)]
    rungs += [(4, floor, phi * f, F.lit(True)) for f in PHI_FACTORS]
    met = [F.when((F.col("volume") > fl) & (F.col("score") < ph) & more, F.struct(F.lit(i).alias("rung"), F.lit(s).alias("step"), F.lit(fl).alias("floor_used"), F.lit(ph).alias("phi_used"), F.col("score").alias("key"))) for i, (s, fl, ph, more) in enumerate(rungs)]
    cost = penalty(F.col("score"), F.col("volume"), F.col("mass"), ladder, floor)
    met.append(F.when(cost < float("inf"), F.struct(F.lit(len(rungs)).alias("rung"), F.lit(5).alias("step"), F.lit(floor).alias("floor_used"), F.lit(phi).alias("phi_used"), cost.alias("key"))))
    tagged = p.select("condition", "k", "volume", "mass", "score", F.explode(F.array_compact(F.array(*met))).alias("r"))
    first = Window.partitionBy("condition")
    tagged = tagged.withColumn("first", F.min("r.rung").over(first)).where("r.rung = first").withColumn("best", F.min("r.key").over(first))
    close = F.when(F.col("r.step") == 5, F.col("r.key") == F.col("best")).otherwise(F.col("r.key") <= F.col("best") * (1 + TIE))
    won = tagged.where(close).groupBy("condition").agg(F.min(F.struct("k", "volume", "mass", "score", "r")).alias("w"))
    out = seeds.select("condition").join(won, "condition", "left")
    step = F.coalesce("w.r.step", F.lit(0))
    rule = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])[step]
    return out.select("condition", step.alias("step"), rule.alias("rule"), F.coalesce("w.k", F.lit(1)).alias("size"), F.col("w.score").alias("score"), F.col("w.volume").alias("volume"), F.col("w.mass").alias("mass"), F.col("w.r.phi_used").alias("phi_used"), F.col("w.r.floor_used").alias("floor_used"))


def rungs_of(settings: DataFrame) -> DataFrame:
    """The ladder of each setting (setting, condition, node, phi, b, min_cut_size, max_cut_size) as rows with rung, step,
    floor_used, phi_used and whether the mass counts. The last rung takes the smallest penalty of any prefix with a volume."""
    floor, phi = F.pow(F.lit(2.0), F.col("b").cast("double") - 1), F.col("phi")
    steps = [(1, floor, phi, True), (2, floor, phi, False)]
    steps += [(3, floor / 2**k, phi, False) for k in range(1, SCALE_RELAXATIONS + 1)]
    steps += [(4, floor, phi * f, False) for f in PHI_FACTORS] + [(5, floor, phi, False)]
    rows = [F.struct(F.lit(i).alias("rung"), F.lit(s).alias("step"), fl.alias("floor_used"), ph.alias("phi_used"), F.lit(mass).alias("by_mass")) for i, (s, fl, ph, mass) in enumerate(steps)]
    return settings.withColumn("r", F.explode(F.array(*rows))).select(*settings.columns, "r.*")


def select_each(prefixes: DataFrame, settings: DataFrame) -> DataFrame:
    """`select` for a table of settings, all in one plan: (setting, condition, node, step, rule, size, score, volume, mass, phi_used, floor_used).

    A setting names its vector in `condition`; the rungs of its ladder meet the vector's prefixes in a join with ranges for volume,
    conductance and mass, so a setting is a row and neither the plan nor the number of jobs grows with their number."""
    seed_at = prefixes.select("condition", "node", F.col("k").alias("seed_k"))
    rungs = rungs_of(settings.join(seed_at, ["condition", "node"], "left"))
    p, r = prefixes.alias("p"), rungs.alias("r")
    k, volume, score, mass = (F.col(f"p.{c}") for c in ("k", "volume", "score", "mass"))
    sized = (k >= F.greatest("r.min_cut_size", F.coalesce("r.seed_k", F.lit(1)))) & (k <= F.coalesce("r.max_cut_size", F.lit(2**31 - 1)))
    strict = (volume > F.col("r.floor_used")) & (score < F.col("r.phi_used")) & (~F.col("r.by_mass") | (mass > mass_threshold(F.col("p.m"))))
    last = F.col("r.step") == 5
    met = p.join(r, (F.col("p.condition") == F.col("r.condition")) & sized & F.when(last, (volume > 0) & (score < float("inf"))).otherwise(strict))
    floor = F.col("r.floor_used")
    octaves = F.when(volume < floor, F.log2(floor / volume)).otherwise(0.0)
    cost = score / F.col("r.phi_used") + VOLUME_WEIGHT * octaves - MASS_WEIGHT * F.least(mass, F.lit(1.0))
    tagged = met.select("r.setting", "r.rung", "r.step", k.alias("size"), score.alias("score"), volume.alias("volume"), mass.alias("mass"), "r.phi_used", floor.alias("floor_used"), F.when(last, cost).otherwise(score).alias("key"))
    lowest = tagged.groupBy("setting").agg(F.min(F.struct("rung", "key")).alias("lowest"))
    close = F.when(F.col("step") == 5, F.col("key") == F.col("lowest.key")).otherwise(F.col("key") <= F.col("lowest.key") * (1 + TIE))
    of_first = tagged.join(lowest, "setting").where((F.col("rung") == F.col("lowest.rung")) & close)
    won = of_first.groupBy("setting").agg(F.min(F.struct("size", "step", "score", "volume", "mass", "phi_used", "floor_used")).alias("w"))
    out = settings.select("setting", "condition", "node").join(won, "setting", "left")
    step = F.coalesce("w.step", F.lit(0))
    rule = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])[step]
    return out.select("setting", "condition", "node", step.alias("step"), rule.alias("rule"), F.coalesce("w.size", F.lit(1)).alias("size"), *[F.col(f"w.{c}").alias(c) for c in ("score", "volume", "mass", "phi_used", "floor_used")])


def relaxations(chosen: DataFrame) -> DataFrame:
    """Adds to selections with their phi and b what the ladder gave way in: phi_relax_factor (step 4), scale_relaxation in octaves
    (step 3), the parts of the penalty (step 5), and sweep_index, the place of the last member in the sweep."""
    step, floor = F.col("step"), F.pow(F.lit(2.0), F.col("b").cast("double") - 1)
    at = lambda s, c: F.when(step == s, c)
    octaves = F.when(F.col("volume") < floor, F.log2(floor / F.col("volume"))).otherwise(0.0)
    return chosen.withColumns({
        "phi_relax_factor": at(4, F.col("phi_used") / F.col("phi")), "scale_relaxation": at(3, F.log2(floor / F.col("floor_used"))),
        "penalty_quality": at(5, F.col("score") / F.col("phi")), "penalty_volume": at(5, VOLUME_WEIGHT * octaves), "penalty_mass": at(5, -MASS_WEIGHT * F.least("mass", F.lit(1.0))),
        "sweep_index": F.when(step > 0, F.col("size") - 1),
    })


def ranked_scores(prefixes: DataFrame, seeds: DataFrame, chosen: DataFrame, vector: DataFrame) -> DataFrame:
    """(condition, node, score, rank) of the members, the highest score first, names among equals; a seed alone has its own score, or 0."""
    own = members(prefixes, seeds, chosen).join(vector.select("condition", "node", F.col("p").alias("score")), ["condition", "node"], "left")
    return own.select("condition", "node", F.coalesce("score", F.lit(0.0)).alias("score"), "rank")


def strict_flags(df: DataFrame) -> DataFrame:
    """Adds conditions_met, failed_conditions, satisfied and strategy to rows with step and the three strict conditions."""
    names = ("volume_ok", "prob_ok", "phi_ok")
    failed = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in names]))
    met = F.lit(len(names)) - F.size("failed_conditions")
    strategy = F.when(F.col("step") == 0, "seed_singleton_fallback").when(F.col("step") == 1, "target_conductance").otherwise("target_conductance_fallback")
    return df.withColumn("failed_conditions", failed).withColumn("conditions_met", met).withColumn("satisfied", F.col("conditions_met") == len(names)).withColumn("strategy", strategy)


def selection_report(prefixes: DataFrame, seeds: DataFrame, chosen: DataFrame, ladder: Ladder) -> DataFrame:
    """The selection rows with the bounds they were judged by and the strict conditions, whichever step decided.

    evaluated counts the admissible prefixes; a seed alone (step 0) meets no condition."""
    at = prefixes.join(seeds.select("condition", "node"), ["condition", "node"]).select("condition", F.col("k").alias("seed_k"))
    within = F.col("k") >= F.greatest(F.lit(ladder.min_cut_size), F.coalesce("seed_k", F.lit(1)))
    if ladder.max_cut_size is not None:
        within &= F.col("k") <= ladder.max_cut_size
    sizes = prefixes.join(at, "condition", "left").groupBy("condition").agg(F.max("m").alias("m"), F.floor(F.max("total_volume") / 2).alias("volume_max"), F.count_if(within).alias("evaluated"))
    own = chosen.join(sizes, "condition", "left")
    own = own.join(seeds.select("condition", "b"), "condition") if "b" in seeds.columns else own.withColumn("b", F.lit(ladder.b))
    own = own.withColumn("volume_min", F.pow(F.lit(2.0), F.col("b") - 1)).withColumn("mass_threshold", mass_threshold(F.col("m"))).withColumn("phi_target", F.lit(ladder.phi)).withColumn("alpha", F.lit(ladder.alpha))
    sure = lambda c: F.coalesce(c, F.lit(False))
    flags = {"volume_ok": sure((F.col("volume") > F.col("volume_min")) & (F.col("volume") <= F.col("volume_max"))), "prob_ok": sure(F.col("mass") > F.col("mass_threshold")), "phi_ok": sure(F.col("score") < ladder.phi)}
    own = relaxations(own.withColumn("phi", F.lit(float(ladder.phi)))).drop("phi")
    return strict_flags(own.withColumns(flags).withColumn("evaluated", F.coalesce("evaluated", F.lit(0))))


def adaptive(edges: DataFrame, conservative: bool = False) -> DataFrame:
    """(condition, n, m, alpha, b_min, b_max, b, epsilon): what the size of each graph suggests; b_min and b_max only inform."""
    s = graph_stats(strongest(edges))
    n, m = F.greatest("node_count", F.lit(1)), F.greatest("edge_count", F.lit(1))
    least, most = F.floor(F.log2(F.sqrt(n.cast("double")))), F.ceil(F.log2(m.cast("double")))
    b = default_b(F.col("node_count"), F.col("edge_count"))
    return s.select("condition", n.alias("n"), m.alias("m"), F.lit(DEFAULT_ALPHA * (3 if conservative else 1)).alias("alpha"), F.greatest(F.lit(1), least).cast("int").alias("b_min"), F.greatest(F.lit(1), most).cast("int").alias("b_max"), b.alias("b"), (mass_threshold(m) / F.pow(F.lit(2.0), b)).alias("epsilon"))


def thresholds(edges: DataFrame, ladder: Ladder, weighted: bool = True) -> DataFrame:
    """The bounds that a graph and a ladder give, one row per condition."""
    total = weighted_adjacency(edges, weighted).groupBy("condition").agg(F.sum("w").alias("total_volume"))
    own = adaptive(edges).select("condition", "m", (F.col("b") if ladder.b is None else F.lit(ladder.b)).alias("b"))
    bar = mass_threshold(F.col("m"))
    return own.join(total, "condition").select("condition", F.lit(ladder.phi).alias("phi"), "b", F.lit(ladder.alpha).alias("alpha"), (bar / F.pow(F.lit(2.0), F.col("b"))).alias("epsilon"), "total_volume", F.pow(F.lit(2.0), F.col("b") - 1).alias("volume_min"), F.floor(F.col("total_volume") / 2).alias("volume_max"), bar.alias("mass_threshold"), F.lit(ladder.min_cut_size).alias("min_cut_size"))


def legacy_nibble(edges: DataFrame, scores: DataFrame, phi: float = 0.3, b: int = 5, weighted: bool = False) -> DataFrame:
    """(condition, size, score, volume): the best prefix under phi whose volume lies strictly between 2^(b-1) and two
    thirds of the total and whose mass passes the threshold; conditions without one have no row."""
    p = sweep(edges, scores, weighted, cap=2 / 3, by_count=True)
    ok = (F.col("volume") > 2.0 ** (b - 1)) & (F.col("volume") < F.floor(F.col("total_volume") * 2 / 3)) & (F.col("score") < phi) & (F.col("mass") > mass_threshold(F.col("m")))
    return p.where(ok).groupBy("condition").agg(F.min(F.struct("score", F.col("k").alias("size"), "volume")).alias("w")).select("condition", "w.size", "w.score", "w.volume")


def members(prefixes: DataFrame, seeds: DataFrame, chosen: DataFrame) -> DataFrame:
    """(condition, node, rank) of the selected prefixes, ranked by score, names among equals; the seed alone at step 0."""
    by_score = Window.partitionBy("condition").orderBy(F.desc("p"), "node")
    big = prefixes.join(chosen.where("step > 0").select("condition", "size"), "condition").where("k <= size").select("condition", "node", F.row_number().over(by_score).alias("rank"))
    alone = seeds.join(chosen.where("step = 0"), "condition", "left_semi").select("condition", "node", F.lit(1).alias("rank"))
    return big.unionByName(alone)


def push(edges: DataFrame, runs: DataFrame, max_pushes: int = 100_000, weighted: bool = True, walk_positive: bool = False) -> DataFrame:
    """Approximate personalised PageRank by first-in-first-out pushes: rows (run_id, condition, node, p, r, pushes, converged).

    runs: (run_id, condition, node, alpha, epsilon, order_seed); order_seed null keeps edge order. A run is
    sequential, so each (condition, run) is a task's unit of work; a condition's graph meets its runs by
    cogroup, runs of a condition are spread over `lane`s, one per PER_LANE runs. Degrees under 1 count as 1."""
    walk = edges.where("weight > 0") if walk_positive else edges
    adj = weighted_adjacency(walk, weighted)
    lanes = runs.groupBy("condition").agg(F.ceil(F.count("*") / PER_LANE).alias("lanes"))
    spread = runs.join(lanes, "condition").withColumn("lane", F.pmod(F.xxhash64("run_id"), "lanes").cast("int"))
    graphs = adj.join(lanes, "condition").withColumn("lane", F.explode(F.sequence(F.lit(0), (F.col("lanes") - 1).cast("int"))))
    schema = "run_id long, condition string, node string, p double, r double, pushes long, converged boolean"
    out = pa.schema([("run_id", pa.int64()), ("condition", pa.string()), ("node", pa.string()), ("p", pa.float64()), ("r", pa.float64()), ("pushes", pa.int64()), ("converged", pa.bool_())])

    def kernel(graph: pa.Table, jobs: pa.Table) -> pa.Table:
        if not jobs.num_rows:
            return out.empty_table()
        walk = Neighbours.of(graph)
        tables = []
        for job in jobs.to_pylist():
            seed = walk.places.get(job["node"])
            if seed is None:
                continue
            p, r, pushes = walk.push(seed, job["alpha"], job["epsilon"], max_pushes, job["order_seed"])
            some = np.flatnonzero((p > 0) | (r > 0))
            n, done = len(some), bool((r < job["epsilon"] * walk.degree).all())
            columns = ([job["run_id"]] * n, [job["job_condition"]] * n, walk.names[some].tolist(), p[some], r[some], [pushes] * n, [done] * n)
            tables.append(pa.table([pa.array(c, t) for c, t in zip(columns, out.types, strict=True)], schema=out))
        return pa.concat_tables(tables) if tables else out.empty_table()

    jobs = spread.select(F.col("condition").alias("job_condition"), F.col("lane").alias("job_lane"), *[F.col(c).alias(c) for c in ("run_id", "node", "alpha", "epsilon", "order_seed")])
    return graphs.groupBy("condition", "lane").cogroup(jobs.groupBy("job_condition", "job_lane")).applyInArrow(kernel, schema)


@dataclass
class Neighbours:
    """A graph in compressed rows: the neighbours of node i are other[first[i] : first[i + 1]], ordered by name."""

    names: np.ndarray
    first: np.ndarray
    other: np.ndarray
    weight: np.ndarray
    degree: np.ndarray

    @classmethod
    def of(cls, graph: pa.Table) -> Neighbours:
        u, v = (np.array(graph.column(c).to_pylist(), object) for c in ("u", "v"))
        names, place = np.unique(np.concatenate((u, v)), return_inverse=True)
        own, other = place[: len(u)], place[len(u) :]
        order = np.lexsort((other, own))
        weight = graph.column("w").to_numpy()[order].astype(np.float64)
        first = np.searchsorted(own[order], np.arange(len(names) + 1))
        degree = np.bincount(own[order], weight, len(names))
        return cls(names, first, other[order], weight, np.maximum(1.0, degree))

    @property
    def places(self) -> dict[str, int]:
        return {n: i for i, n in enumerate(self.names.tolist())}

    def push(self, seed: int, alpha: float, eps: float, limit: int, order_seed: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Vectors p and r and the number of pushes. p + r keeps the mass 1, and a push moves alpha of a node's residual
        to p, half of the rest to its neighbours by weight, and leaves the other half.

        Nodes over eps times their degree wait in a heap under a ticket: the number of their arrival, so that they
        leave in that order, or with order_seed a random number, so that each waiting node is as likely to be next."""
        p, r, bar = np.zeros(len(self.names)), np.zeros(len(self.names)), eps * self.degree
        draw = itertools.count().__next__ if order_seed is None else np.random.default_rng(order_seed).random
        waits = np.zeros(len(self.names), bool)
        heap, pushes = [], 0

        def enter(nodes) -> None:
            for x in nodes:
                waits[x] = True
                heapq.heappush(heap, (draw(), x))

        r[seed] = 1.0
        enter([seed])
        while heap and pushes < limit:
            _, u = heapq.heappop(heap)
            waits[u] = False
            if r[u] < bar[u]:
                continue
            near = slice(self.first[u], self.first[u + 1])
            p[u] += alpha * r[u]
            r[u] *= (1 - alpha) / 2
            flow = r[u] / self.degree[u]
            enter([u] if r[u] >= bar[u] else [])
            to = self.other[near]
            r[to] += flow * self.weight[near]
            enter(to[(r[to] >= bar[to]) & ~waits[to]].tolist())
            pushes += 1
        return p, r, pushes


def push_any(edges: DataFrame, runs: DataFrame, weighted: bool = True, walk_positive: bool = False, task_edges: int = TASK_EDGES) -> DataFrame:
    """Pushes in queue order where a condition's graph fits a task, by joins (which have no order) where it does not."""
    big = cut(edges.groupBy("condition").count().where(F.col("count") * 2 > task_edges).select("condition"), "large")
    if big.isEmpty():
        return push(edges, runs, weighted=weighted, walk_positive=walk_positive)
    own = lambda df, how: df.join(big, "condition", how)
    small = push(own(edges, "left_anti"), own(runs, "left_anti"), weighted=weighted, walk_positive=walk_positive)
    return small.unionByName(push_by_joins(own(edges, "left_semi"), own(runs, "left_semi"), weighted=weighted, walk_positive=walk_positive))


def cluster(edges: DataFrame, seeds: DataFrame, ladder: Ladder | None, signed: bool = False, sign_lambda: float = 1.0, weighted: bool = True, order_seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    found, chosen, _ = cluster_with_report(edges, seeds, ladder, signed, sign_lambda, weighted, order_seed)
    return found, chosen


def cluster_with_report(edges: DataFrame, seeds: DataFrame, ladder: Ladder | None, signed: bool = False, sign_lambda: float = 1.0, weighted: bool = True, order_seed: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Push, sweep and ladder for the seeds (condition, node): members (condition, node, rank), the selection rows and their report.

    Without a ladder or without its b, each condition's b comes from the size of its graph."""
    m = strongest(edges).groupBy("condition").agg(F.count("*").alias("_m"))
    ladder = Ladder(b=None) if ladder is None else ladder
    if ladder.b is None:
        sizes = graph_stats(edges).select("condition", default_b(F.col("node_count"), F.col("edge_count")).alias("b"))
        seeds = cut(seeds.select("condition", "node").join(sizes, "condition"), "seeds")
    b = F.col("b").cast("double") if "b" in seeds.columns else F.lit(float(ladder.b))
    eps = F.lit(1.0) / (F.pow(F.lit(2.0), b) * 48 * F.ceil(F.log2(F.greatest("_m", F.lit(2)).cast("double"))))
    runs = seeds.join(m, "condition").select(F.xxhash64("condition", "node").alias("run_id"), "condition", "node", F.lit(ladder.alpha).alias("alpha"), eps.alias("epsilon"), F.lit(order_seed).cast("long").alias("order_seed"))
    pushed = cut(push_any(edges, runs, weighted=weighted, walk_positive=signed), "pushed")
    prefixes = cut(sweep(edges, pushed.where("p > 0").select("condition", "node", "p"), weighted, signed, sign_lambda), "prefixes")
    chosen = cut(select(prefixes, seeds, ladder), "chosen")
    settled = pushed.groupBy("condition").agg(F.bool_and("converged").alias("push_converged"), F.max("pushes").alias("pushes"))
    report = selection_report(prefixes, seeds, chosen, ladder).join(settled, "condition", "left")
    report = report.withColumns({"push_converged": F.coalesce("push_converged", F.lit(True)), "pushes": F.coalesce("pushes", F.lit(0))})
    return members(prefixes, seeds, chosen), chosen, report
