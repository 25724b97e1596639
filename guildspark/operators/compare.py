"""Comparison of two graphs or clusters: set views of nodes and edges, and the tables exported from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guildspark.functions.scalars import rounded, weight_column

from .network import pair_key


def sign(w: Column) -> Column:
    return F.when(w > 0, "positive").when(w < 0, "negative").otherwise("neutral")


def _keyed(edges: DataFrame, side: str) -> DataFrame:
    return edges.select(pair_key().alias("k"), *[F.col(c).alias(f"{c}_{side}") for c in ("source", "target", "weight", "p", "weight_type")])


def node_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def intersection_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("node").intersect(b.select("node"))


def intersection_edges(a: DataFrame, b: DataFrame, label_a: str = "A", label_b: str = "B") -> DataFrame:
    """Pairs in both graphs whatever their sign: both weights and p-values, sign conflict and its direction, and the relation in words."""
    both = _keyed(a, "a").join(_keyed(b, "b"), "k")
    mismatch = F.coalesce("weight_type_a", F.lit("correlation")) != F.coalesce("weight_type_b", F.lit("correlation"))
    stable = ~mismatch & (F.coalesce("weight_type_a", F.lit("correlation")) == "selection_stability")

    def label(side: str) -> Column:
        return F.when(mismatch, "not comparable").when(stable, "selected").otherwise(sign(F.coalesce(f"weight_{side}", F.lit(0.0))))

    out = both.select(
        F.col("source_a").alias("source"), F.col("target_a").alias("target"), F.coalesce("weight_a", F.lit(0.0)).alias("weight_a"), F.coalesce("weight_b", F.lit(0.0)).alias("weight_b"), "p_a", "p_b",
        label("a").alias("sign_a"), label("b").alias("sign_b"), mismatch.alias("metric_mismatch"), F.when(mismatch, "mixed").otherwise(F.coalesce("weight_type_a", F.lit("correlation"))).alias("weight_type"), "weight_type_a", "weight_type_b",
    )
    conflict = ~F.col("metric_mismatch") & (F.col("weight_type") != "selection_stability") & (F.col("sign_a") != F.col("sign_b"))
    larger = F.when(F.abs("weight_a") >= F.abs("weight_b"), F.col("weight_a")).otherwise(F.col("weight_b"))
    out = out.withColumn("sign_conflict", conflict)
    kind = F.when(F.col("sign_conflict"), F.when(F.col("sign_a") == "positive", "pos_to_neg").otherwise("neg_to_pos")).otherwise("")
    relation = (
        F.when(F.col("metric_mismatch"), F.concat(F.lit("different metrics ("), "weight_type_a", F.lit(" vs "), "weight_type_b", F.lit(")")))
        .when(~F.col("sign_conflict"), "same sign")
        .when(F.col("conflict_type") == "neg_to_pos", f"negative in {label_a} → positive in {label_b}")
        .otherwise(f"positive in {label_a} → negative in {label_b}")
    )
    return out.withColumn("conflict_type", kind).withColumn("weight", F.when(F.col("sign_conflict"), larger).otherwise(F.col("weight_a"))).withColumn("relation", relation).drop("weight_type_a", "weight_type_b")


def exclusive_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("node").distinct().join(b.select("node"), "node", "left_anti")


def edges_among(edges: DataFrame, nodes: DataFrame, without: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes whose pair `without` does not have."""
    a, b = nodes.select(F.col("node").alias("source")), nodes.select(F.col("node").alias("target"))
    keys = without.select(pair_key().alias("_k")).distinct()
    return edges.withColumn("_k", pair_key()).join(keys, "_k", "left_anti").drop("_k").join(a, "source", "left_semi").join(b, "target", "left_semi").select(*edges.columns)


def exclusive_edges(a: DataFrame, b: DataFrame, nodes_a: DataFrame | None = None, nodes_b: DataFrame | None = None) -> DataFrame:
    """Edges only in a: both ends exclusive to a, the pair not shared."""
    na, nb = nodes_a or node_ids(a), nodes_b or node_ids(b)
    return edges_among(a, exclusive_nodes(na, nb), b)


def complement_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union minus intersection."""
    return exclusive_nodes(a, b).union(exclusive_nodes(b, a))


def complement_edges(a: DataFrame, b: DataFrame, nodes_a: DataFrame | None = None, nodes_b: DataFrame | None = None) -> DataFrame:
    nodes = complement_nodes(nodes_a or node_ids(a), nodes_b or node_ids(b))
    return edges_among(a, nodes, b).withColumn("side", F.lit("A")).unionByName(edges_among(b, nodes, a).withColumn("side", F.lit("B")))


def node_presence(cluster_a: DataFrame, cluster_b: DataFrame, graph_a: DataFrame, graph_b: DataFrame, label_a: str = "A", label_b: str = "B") -> DataFrame:
    """Nodes in exactly one of two clusters, and in which graphs they are."""
    flag = lambda df, name: df.select("node").distinct().withColumn(name, F.lit(True))
    joined = flag(cluster_a, "in_cluster_a").join(flag(cluster_b, "in_cluster_b"), "node", "full").join(flag(graph_a, "in_graph_a"), "node", "left").join(flag(graph_b, "in_graph_b"), "node", "left")
    filled = joined.select("node", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_cluster_a", "in_cluster_b", "in_graph_a", "in_graph_b")])
    return filled.where("in_cluster_a <> in_cluster_b").withColumn("present_in", F.when(F.col("in_cluster_a"), label_a).otherwise(label_b))


def export_edges(edges: DataFrame, condition: str) -> DataFrame:
    """The download table of a graph, rounded to six decimals."""
    stable = F.col("weight_type") == "selection_stability"
    return edges.select(F.lit(condition).alias("condition"), "source", "target", F.round("weight", 6).alias("weight"), "weight_type", F.when(stable, "selected").otherwise(sign(F.col("weight"))).alias("sign"), F.round("p", 6).alias("p_value"), "evidence_type", "method")


def named_weights(edges: DataFrame) -> DataFrame:
    """Edges with their weight, rounded to six decimals, in the column that its type names: correlation, selection_stability or weight.
    Types of one table may differ; a row has one of the columns, the others are null."""
    kind = F.coalesce("weight_type", F.lit("correlation"))
    own = [F.when(weight_column(kind) == n, rounded(F.col("weight"))).alias(n) for n in ("correlation", "selection_stability", "weight")]
    return edges.select(*[c for c in edges.columns if c != "weight"], *own)


def export_derived_edges(edges: DataFrame, condition: str | Column) -> DataFrame:
    """The download table of the edges of a cluster or of a view (exclusive, complement); missing types and evidence have their defaults."""
    kind = F.coalesce("weight_type", F.lit("correlation"))
    said = F.when(kind == "selection_stability", "selected").otherwise(sign(F.col("weight")))
    rows = edges.select((F.lit(condition) if isinstance(condition, str) else condition).alias("condition"), "source", "target", "weight", kind.alias("weight_type"), said.alias("sign"), rounded(F.col("p")).alias("p_value"), F.coalesce("evidence_type", F.lit("pairwise_p_value")).alias("evidence_type"))
    return named_weights(rows)


def views(cluster_a: DataFrame, cluster_b: DataFrame) -> DataFrame:
    """(view, source, target, weight): the six views of two clusters' edges in one table."""
    pick = lambda df, v: df.select(F.lit(v).alias("view"), "source", "target", "weight")
    parts = [pick(cluster_a, "cluster_a"), pick(cluster_b, "cluster_b"), pick(intersection_edges(cluster_a, cluster_b), "intersection"), pick(exclusive_edges(cluster_a, cluster_b), "exclusive_a"), pick(exclusive_edges(cluster_b, cluster_a), "exclusive_b"), pick(complement_edges(cluster_a, cluster_b), "complement")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
