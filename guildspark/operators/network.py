"""Condition graphs as edge tables (source, target, weight, ...): build, degrees and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guildspark.functions.scalars import evidence_type, threshold_label, weight_type

from .ranks import first_rows


def pair_key(a: str = "source", b: str = "target") -> Column:
    return F.concat_ws("::", F.least(a, b), F.greatest(a, b))


def edges_of(pairs: DataFrame, method: str = "spearman", weight_type: str | Column = "correlation", evidence: str | Column = "pairwise_p_value") -> DataFrame:
    return pairs.select("condition", F.col("left").alias("source"), F.col("right").alias("target"), F.col("rho").alias("weight"), "p", F.lit(method).alias("method"), F.lit(weight_type).alias("weight_type"), F.lit(evidence).alias("evidence_type"))


def nodes_of(edges: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """(condition, id, overabundance): only ends of edges are nodes; a node without a ratio has 1."""
    ends = edges.select("condition", F.explode(F.array("source", "target")).alias("id")).distinct()
    if ratios is None:
        return ends.withColumn("overabundance", F.lit(1.0))
    known = ratios.select("condition", F.col("feature").alias("id"), F.col("ratio"))
    return ends.join(known, ["condition", "id"], "left").select("condition", "id", F.coalesce("ratio", F.lit(1.0)).alias("overabundance"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """(condition, node_count, edge_count, mean_weight, negative, positive, np_ratio)."""
    nodes = nodes_of(edges).groupBy("condition").agg(F.count("*").alias("node_count"))
    e = edges.groupBy("condition").agg(F.count("*").alias("edge_count"), F.avg("weight").alias("mean_weight"), F.count_if(F.col("weight") < 0).alias("negative"), F.count_if(F.col("weight") > 0).alias("positive"))
    ratio = F.when(F.col("positive") > 0, F.try_divide("negative", "positive")).when(F.col("negative") > 0, F.lit(float("inf"))).otherwise(0.0)
    return e.join(nodes, "condition").select("condition", "node_count", "edge_count", "mean_weight", "negative", "positive", ratio.alias("np_ratio"))


def labelled_stats(pairs: DataFrame, kept: DataFrame, stats: DataFrame, method: str, max_p: float | None, min_abs: float) -> DataFrame:
    """The statistics of each condition's graph with its counts of pairs, its thresholds, and the labels of what they bound.

    Conditions without an edge have a row too. max_p None: the method selects edges itself, and the count is of selected pairs."""
    count = lambda df, name: df.groupBy("condition").agg(F.count("*").alias(name))
    chosen = "selected_pairs" if max_p is None else "significant_pairs"
    rows = count(pairs, "total_pairs").join(count(kept, chosen), "condition", "left").join(stats, "condition", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in (chosen, "node_count", "edge_count", "negative", "positive")]
    m = F.lit(method)
    return rows.select(
        "condition", "total_pairs", *zero, "mean_weight", "np_ratio", F.lit(max_p).cast("double").alias("p_value_threshold"), F.lit(max_p is not None).alias("p_value_threshold_applied"),
        F.lit(float(min_abs)).alias("correlation_threshold"), threshold_label(m).alias("correlation_threshold_label"), weight_type(m).alias("weight_type"), evidence_type(m).alias("evidence_type"),
    )


def preview(df: DataFrame, order: list, rows: int = 200) -> DataFrame:
    """The first rows of a table in an order, as a table view shows them."""
    return first_rows(df, rows, order)


def sign_stats(edges: DataFrame) -> DataFrame:
    w = F.col("weight")
    share = lambda c: F.coalesce(F.try_divide(c, F.count("*")), F.lit(0.0))
    return edges.groupBy("condition").agg(
        F.count_if(w > 0).alias("positive_edges"),
        F.count_if(w < 0).alias("negative_edges"),
        F.count_if(w == 0).alias("zero_edges"),
        share(F.count_if(w > 0)).alias("positive_fraction"),
        share(F.count_if(w < 0)).alias("negative_fraction"),
        F.coalesce(F.avg(F.when(w > 0, w)), F.lit(0.0)).alias("mean_abs_positive_corr"),
        F.coalesce(F.avg(F.when(w < 0, -w)), F.lit(0.0)).alias("mean_abs_negative_corr"),
    )


def strongest(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair: the one with the largest absolute weight, the smaller names among equals."""
    ends = F.struct(F.abs("weight").alias("a"), F.col("weight").alias("w"))
    return edges.groupBy("condition", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.max(ends).alias("m")).select("condition", "source", "target", F.col("m.w").alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge; a self-loop once."""
    ab = edges.select("condition", F.col("source").alias("u"), F.col("target").alias("v"), "weight")
    return ab.unionByName(ab.where("u <> v").select("condition", F.col("v").alias("u"), F.col("u").alias("v"), "weight"))


def weighted_adjacency(edges: DataFrame, weighted: bool = True) -> DataFrame:
    adj = adjacency(strongest(edges))
    return adj.select("condition", "u", "v", (F.abs("weight") if weighted else F.lit(1.0)).alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    """(condition, node, degree, weighted_degree) after reduction to the strongest edges; weights are absolute."""
    return adjacency(strongest(edges)).groupBy("condition", F.col("u").alias("node")).agg(F.count("*").alias("degree"), F.sum(F.abs("weight")).alias("weighted_degree"))


def top_neighbors(edges: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("condition", "u").orderBy(F.desc(F.abs("weight")), "v")
    return adjacency(strongest(edges)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("condition", F.col("u").alias("node"), "rank", F.col("v").alias("neighbor"), F.abs("weight").alias("weight"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members (condition, node)."""
    a = members.select("condition", F.col("node").alias("source"))
    b = members.select("condition", F.col("node").alias("target"))
    return edges.join(a, ["condition", "source"], "left_semi").join(b, ["condition", "target"], "left_semi")


def positive_walk(edges: DataFrame) -> DataFrame:
    return edges.where("weight > 0")


def grouped_graph(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between groups of nodes (condition, node, group): absolute weights summed, a zero weight counts 1, own edges dropped."""
    a = groups.select("condition", F.col("node").alias("source"), F.col("group").alias("ga"))
    b = groups.select("condition", F.col("node").alias("target"), F.col("group").alias("gb"))
    w = F.abs(F.when(F.col("weight") == 0, 1.0).otherwise(F.coalesce("weight", F.lit(1.0))))
    joined = edges.join(a, ["condition", "source"]).join(b, ["condition", "target"]).where("ga <> gb")
    return joined.groupBy("condition", F.least("ga", "gb").alias("source"), F.greatest("ga", "gb").alias("target")).agg(F.sum(w).alias("weight"), F.count("*").alias("n_edges"))


def search(nodes: DataFrame, term: str) -> DataFrame:
    return nodes.where(F.lower("id").contains(term.lower())).orderBy(F.lower("id"), "id")


def ordered_nodes(edges: DataFrame) -> DataFrame:
    return nodes_of(edges).select("condition", "id").orderBy("condition", "id")


def top_nodes(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k highest scores (condition, node, p) of each condition with their rank, names among equals."""
    w = Window.partitionBy("condition").orderBy(F.desc("p"), "node")
    return scores.select("condition", "node", "p", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def first_nodes(edges: DataFrame, n: int) -> DataFrame:
    """The edges among the first n nodes by name (one at least) of each condition."""
    w = Window.partitionBy("condition").orderBy("id")
    first = nodes_of(edges).select("condition", F.col("id").alias("node"), F.row_number().over(w).alias("rn")).where(F.col("rn") <= max(1, n))
    return induced(edges, first.select("condition", "node"))


def neighbours_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(condition, node): the neighbours of a node set (condition, node), which may lie inside it."""
    own = nodes.select("condition", F.col("node").alias("u")).distinct()
    return adjacency(strongest(edges)).join(own, ["condition", "u"], "left_semi").select("condition", F.col("v").alias("node")).distinct()


def seed_presence(nodes: DataFrame, seed: str) -> DataFrame:
    """(condition, present) of the nodes (condition, id): a run starts only where the seed is in the graph."""
    return nodes.groupBy("condition").agg(F.coalesce(F.bool_or(F.col("id") == seed), F.lit(False)).alias("present"))


def selector_nodes(nodes: DataFrame, order: list[str]) -> DataFrame:
    """One row per id of the nodes (condition, id, overabundance), from the first condition in `order` that has it."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("condition"))
    best = nodes.where("id <> ''").withColumn("place", place).where("place > 0").groupBy("id").agg(F.min(F.struct("place", "condition", "overabundance")).alias("b"))
    return best.select("id", "b.condition", "b.overabundance")


def pair_statistics(wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """rho and p of the wanted pairs (condition, left, right), stored in either orientation; null where there is none."""
    ends = lambda df: df.withColumn("a", F.least("left", "right")).withColumn("b", F.greatest("left", "right"))
    known = ends(pairs).groupBy("condition", "a", "b").agg(F.max(F.struct((F.col("left") == F.col("a")).alias("own"), "rho", "p")).alias("s"))
    return ends(wanted).join(known, ["condition", "a", "b"], "left").select("condition", "left", "right", F.col("s.rho").alias("rho"), F.col("s.p").alias("p"))
