"""Pushes for graphs larger than a task: all runs at once, as joins of the waiting residuals with the edges.

Approximate personalised PageRank keeps p and r per run and node. A step pushes every node whose residual reaches its
bar, epsilon times its degree: alpha of it moves to p, half of the rest stays, the other half goes to the neighbours
by weight. Nodes of one step do not see each other's flow; as pushes commute in what they keep invariant, any order
ends with vectors that meet the same bounds. The state holds touched nodes only, a step is one join and one group-by, and
several steps form a block, after which the state is written, so lost executors cost a block at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guildspark.sources.staging import cut

from .network import weighted_adjacency

#: Steps between two writings of the state.
STEPS = 6


def degrees_of(adj: DataFrame) -> DataFrame:
    """(condition, node, d): weights of a node's edges, 1 at least."""
    return adj.groupBy("condition", F.col("u").alias("node")).agg(F.greatest(F.lit(1.0), F.sum("w")).alias("d"))


def moves_of(adj: DataFrame) -> DataFrame:
    """(condition, node, waits, to, to_d, share): where a node's residual goes. A waiting node has a row per neighbour and one of
    its own, whose share is null; any other has only that."""
    d = degrees_of(adj)
    out = adj.join(d.withColumnRenamed("node", "u"), ["condition", "u"]).withColumn("share", F.col("w") / F.col("d")).drop("d")
    out = out.join(d.select("condition", F.col("node").alias("v"), F.col("d").alias("to_d")), ["condition", "v"])
    far = out.select("condition", F.col("u").alias("node"), F.lit(True).alias("waits"), F.col("v").alias("to"), "to_d", "share")
    own = d.select("condition", "node", F.explode(F.array(F.lit(True), F.lit(False))).alias("waits"), F.col("node").alias("to"), F.col("d").alias("to_d"), F.lit(None).cast("double").alias("share"))
    return far.unionByName(own)


def _step(state: DataFrame, moves: DataFrame) -> DataFrame:
    waits = F.col("r") >= F.col("epsilon") * F.col("d")
    own, left = F.col("share").isNull(), F.col("r") * (1 - F.col("alpha")) / 2
    moved = state.withColumn("waits", waits).join(moves, ["condition", "node", "waits"])
    flows = moved.select(
        "run_id", "condition", F.col("to").alias("node"), "alpha", "epsilon", F.col("to_d").alias("d"),
        F.when(own, F.col("p") + F.when(F.col("waits"), F.col("alpha") * F.col("r")).otherwise(0.0)).otherwise(0.0).alias("p"),
        F.when(own, F.when(F.col("waits"), left).otherwise(F.col("r"))).otherwise(left * F.col("share")).alias("r"),
        F.when(own, F.col("pushes") + F.col("waits").cast("long")).otherwise(0).alias("pushes"),
    )
    return flows.groupBy("run_id", "condition", "node").agg(*[F.max(c).alias(c) for c in ("alpha", "epsilon", "d")], *[F.sum(c).alias(c) for c in ("p", "r", "pushes")])


def push_by_joins(edges: DataFrame, runs: DataFrame, max_steps: int = 3000, weighted: bool = True, walk_positive: bool = False, steps: int = STEPS) -> DataFrame:
    """Rows (run_id, condition, node, p, r, pushes, converged) as those of `push`, for graphs of any size.

    runs: (run_id, condition, node, alpha, epsilon); a run whose node has no edges gives no rows. A run that does not settle in
    max_steps is returned as it is, with converged false."""
    walk = edges.where("weight > 0") if walk_positive else edges
    adj = cut(weighted_adjacency(walk, weighted), "adjacency")
    moves = cut(moves_of(adj), "moves")
    start = runs.select("run_id", "condition", "node", F.col("alpha").cast("double").alias("alpha"), F.col("epsilon").cast("double").alias("epsilon"))
    state = cut(start.join(degrees_of(adj), ["condition", "node"]).withColumns({"p": F.lit(0.0), "r": F.lit(1.0), "pushes": F.lit(0).cast("long")}), "push")
    waiting, done = F.col("r") >= F.col("epsilon") * F.col("d"), 0
    while done < max_steps and not state.where(waiting).isEmpty():
        now = min(steps, max_steps - done)
        for _ in range(now):
            state = _step(state, moves)
        state, done = cut(state, "push"), done + now
    judged = state.groupBy("run_id").agg(F.sum("pushes").alias("pushes"), F.bool_and(~waiting).alias("converged"))
    return state.drop("pushes").join(judged, "run_id").select("run_id", "condition", "node", "p", "r", "pushes", "converged")


def push_audit(edges: DataFrame, runs: DataFrame, pushed: DataFrame, weighted: bool = True, walk_positive: bool = False) -> DataFrame:
    """(run_id, condition, seed, nodes, mass, gap, over, converged) per run, from the returned vectors alone.

    mass: the sum of p and r, 1 where all degrees are 1 or more. gap: the largest difference over the nodes between r and what p
    leaves of the seed, r = s - (p - (1 - alpha) p W) / alpha with the lazy walk W. over: the largest r over its bar, under 1 when settled."""
    walk = edges.where("weight > 0") if walk_positive else edges
    adj = cut(weighted_adjacency(walk, weighted), "adjacency")
    d = degrees_of(adj)
    own = pushed.join(runs.select("run_id", F.col("node").alias("seed"), "alpha", "epsilon"), "run_id").join(d, ["condition", "node"])
    half = (1 - F.col("alpha")) / (2 * F.col("alpha"))
    at_home = own.select("run_id", "condition", "seed", "node", (F.col("r") - (F.col("node") == F.col("seed")).cast("double") + F.col("p") / F.col("alpha") - half * F.col("p")).alias("x"), (F.col("p") + F.col("r")).alias("mass"), (F.col("r") / (F.col("epsilon") * F.col("d"))).alias("over"), F.col("converged"))
    away = own.where("p > 0").join(adj.withColumnRenamed("u", "node"), ["condition", "node"]).select("run_id", "condition", "seed", F.col("v").alias("node"), (-half * F.col("p") * F.col("w") / F.col("d")).alias("x"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("over"), F.lit(True).alias("converged"))
    nodes = at_home.unionByName(away).groupBy("run_id", "condition", "seed", "node").agg(F.sum("x").alias("x"), F.sum("mass").alias("mass"), F.max("over").alias("over"), F.bool_and("converged").alias("converged"))
    return nodes.groupBy("run_id", "condition", "seed").agg(F.count("*").alias("nodes"), F.sum("mass").alias("mass"), F.max(F.abs("x")).alias("gap"), F.max("over").alias("over"), F.bool_and("converged").alias("converged"))
