"""Clusters as sets: runs that resemble each other, and node sets as bitmaps.

Repeated runs mostly find the same few clusters, so equal clusters are one class and only classes are compared. Two classes with
a Jaccard index of `least` share one of their rarest nodes (a prefix of the nodes by frequency), so those are joined, sizes
that cannot match are left out, and what remains is counted exactly. Pairs below `least` are a number, never rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guildspark.sources.staging import cut

from .ranks import row_numbers


def classes(clusters: DataFrame) -> DataFrame:
    """(class_id, runs, size, nodes): the different clusters of rows (run_id, node), named by their smallest run."""
    sets = clusters.groupBy("run_id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    return sets.groupBy("nodes").agg(F.min("run_id").alias("class_id"), F.count("*").alias("runs")).select("class_id", "runs", F.size("nodes").alias("size"), "nodes")


def class_members(clusters: DataFrame) -> DataFrame:
    """(run_id, class_id)."""
    sets = clusters.groupBy("run_id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    return sets.join(classes(clusters).select("class_id", "nodes"), "nodes").select("run_id", "class_id")


def similar_classes(found: DataFrame, least: float) -> DataFrame:
    """(class_a, class_b, shared, jaccard, pairs) of the classes whose index is `least` or more; pairs: the pairs of runs behind them."""
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    nodes = found.select("class_id", "size", F.explode("nodes").alias("node"))
    rarity = nodes.groupBy("node").agg(F.count("*").alias("n"))
    order = Window.partitionBy("class_id").orderBy("n", "node")
    wanted = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1
    rarest = nodes.join(rarity, "node").withColumn("i", F.row_number().over(order)).where(F.col("i") <= wanted).select("class_id", "size", "node")
    a, b = rarest.toDF("class_a", "size_a", "node"), rarest.toDF("class_b", "size_b", "node")
    fits = (F.col("class_a") < F.col("class_b")) & (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * least - 1e-9)
    asked = a.join(b, "node").where(fits).select("class_a", "class_b").distinct()
    left, right = found.toDF("class_a", "runs_a", "size_a", "nodes_a"), found.toDF("class_b", "runs_b", "size_b", "nodes_b")
    both = asked.join(left, "class_a").join(right, "class_b").withColumn("shared", F.size(F.array_intersect("nodes_a", "nodes_b")))
    every = F.col("size_a") + F.col("size_b") - F.col("shared")
    return both.where(F.col("shared") >= every * least - 1e-9).select("class_a", "class_b", "shared", (F.col("shared") / every).alias("jaccard"), (F.col("runs_a") * F.col("runs_b")).alias("pairs"))


def jaccard_histogram(clusters: DataFrame, least: float = 0.5, bins: int = 10) -> DataFrame:
    """(low, pairs): how many pairs of runs have an index from `low` to the next bin; low null counts those under `least`.

    The last bin holds the index 1, of equal clusters too. What is under `least` is what the others leave of all pairs."""
    found = cut(classes(clusters), "classes")
    width = (1 - least) / bins
    at = F.least(F.floor((F.col("jaccard") - least) / width + 1e-9), F.lit(bins - 1)) if width else F.lit(0)
    pairs_in = lambda n: (n * (n - 1) / 2).cast("long")
    over = similar_classes(found, least).select(at.alias("bin"), "pairs")
    equal = found.select(F.lit(bins - 1).cast("long").alias("bin"), pairs_in(F.col("runs")).alias("pairs"))
    counted = cut(over.unionByName(equal).groupBy("bin").agg(F.sum("pairs").alias("pairs")).where("pairs > 0"), "pairs")
    total = found.agg(pairs_in(F.coalesce(F.sum("runs"), F.lit(0))).alias("all"))
    rest = total.crossJoin(counted.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("over"))).select(F.lit(None).cast("double").alias("low"), (F.col("all") - F.col("over")).alias("pairs"))
    return counted.select((least + F.col("bin") * width).alias("low"), "pairs").unionByName(rest)


def bitmaps(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node sets as bitmaps (run_id, bucket, bits), and the nodes' numbers (node, place): 32,768 nodes a bucket, and only buckets in use."""
    places = cut(row_numbers(clusters.select("node").distinct(), ["node"]), "places")
    placed = clusters.join(places, "node").select("run_id", F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit"))
    return placed.groupBy("run_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), places


def union_and_intersection(clusters: DataFrame) -> DataFrame:
    """(runs, union_nodes, intersection_nodes) of all runs; a bucket counts for the intersection if every run has it."""
    bits = cut(bitmaps(clusters)[0], "bitmaps")
    n = bits.agg(F.countDistinct("run_id").alias("runs"))
    by = bits.groupBy("bucket").agg(F.count("*").alias("k"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("any"), F.bitmap_count(F.bitmap_and_agg("bits")).alias("every"))
    both = by.crossJoin(F.broadcast(n))  # n is one row
    return both.groupBy("runs").agg(F.sum("any").alias("union_nodes"), F.sum(F.when(F.col("k") == F.col("runs"), F.col("every")).otherwise(0)).alias("intersection_nodes"))


def against_base(clusters: DataFrame, base: DataFrame) -> DataFrame:
    """(run_id, size, shared, jaccard, escaped) of each run beside the base cluster (node), from counts of bits."""
    own = clusters.select(F.lit(True).alias("is_run"), F.col("run_id").cast("string").alias("run_id"), "node")
    every = own.unionByName(base.select(F.lit(False).alias("is_run"), F.lit("").alias("run_id"), "node"))
    bits, _ = bitmaps(every.select(F.struct("is_run", "run_id").alias("run_id"), "node"))
    bits = cut(bits.select("run_id.is_run", "run_id.run_id", "bucket", "bits"), "bitmaps")
    runs, ground = bits.where("is_run").drop("is_run"), bits.where("not is_run").select("bucket", F.col("bits").alias("ground"))
    sizes = runs.groupBy("run_id").agg(F.sum(F.bitmap_count("bits")).alias("size"))
    met = runs.join(ground, "bucket").select("run_id", "bucket", F.explode(F.array("bits", "ground")).alias("bits"))
    shared = met.groupBy("run_id", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n")).groupBy("run_id").agg(F.sum("n").alias("shared"))
    n = ground.agg(F.coalesce(F.sum(F.bitmap_count("ground")), F.lit(0)).alias("base_size"))
    k = F.coalesce("shared", F.lit(0))
    return sizes.join(shared, "run_id", "left").crossJoin(F.broadcast(n)).select("run_id", "size", k.alias("shared"), (k / (F.col("size") + F.col("base_size") - k)).alias("jaccard"), (F.col("size") - k).alias("escaped"))


def recovery(nested: DataFrame, base_seed) -> DataFrame:
    """(runs, seed_recovery, self_recovery): the shares of nested runs (seed, node) that hold the base's seed, and their own."""
    own = nested.groupBy("seed").agg(F.bool_or(F.col("node") == F.lit(base_seed)).alias("base"), F.bool_or(F.col("node") == F.col("seed")).alias("self"))
    n = F.count("*")
    return own.agg(n.alias("runs"), F.coalesce(F.try_divide(F.count_if("base"), n), F.lit(0.0)).alias("seed_recovery"), F.coalesce(F.try_divide(F.count_if("self"), n), F.lit(0.0)).alias("self_recovery"))
