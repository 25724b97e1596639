"""Streaming extension: event streams as incremental abundance counts, and associations that follow a stream of samples.

Everything here also runs on a table that does not stream, with the same result for rows that are not late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, sample_id, feature, value): events of a user by type and window; later ones than `late` are dropped."""
    w = F.window("ts", window)
    by = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w, F.col("user_id").alias("sample_id"), F.col("event_type").alias("feature"))
    return by.agg(F.count("*").cast("double").alias("value")).select(F.col("window.start").alias("window_start"), "sample_id", "feature", "value")


def sample_records(counts: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts of windows as one row per sample and window (ts, sample_id, cells), for the functions below.

    Follows `windowed_counts` in a query of its own: a window's counts are final when its watermark has passed."""
    return counts.select(F.col("window_start").alias("ts"), "sample_id", F.struct("feature", "value").alias("cell")).withWatermark("ts", late).groupBy("ts", "sample_id").agg(F.array_sort(F.collect_list("cell")).alias("cells"))


def _windowed(samples: DataFrame, window: str, late: str) -> tuple[DataFrame, Column]:
    return samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), F.window("ts", window)


def windowed_overabundance(samples: DataFrame, conditions: list[str], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, feature, condition, ratio): a feature's mean in each condition over its mean in all samples of the window, 1 if that is not positive.

    samples: (ts, condition, cells), cells an array of (feature, value). The conditions are named, as a stream does not tell
    which will come; their sums are columns of one aggregation, so the state is one row per feature and window."""
    own, w = _windowed(samples, window, late)
    cells = own.select("ts", "condition", F.explode("cells").alias("c")).where("c.value is not null")
    value = F.col("c.value")
    means = [F.avg(F.when(F.col("condition") == c, value)).alias(f"_{i}") for i, c in enumerate(conditions)]
    by = cells.groupBy(w, F.col("c.feature").alias("feature")).agg(F.avg(value).alias("_all"), *means)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(f"_{i}").alias("own")) for i, c in enumerate(conditions)])).alias("m")
    ratio = F.when(F.col("_all") > 0, F.coalesce("m.own", F.lit(0.0)) / F.when(F.col("_all") > 0, F.col("_all"))).otherwise(1.0)
    return by.select("window", "feature", "_all", each).select(F.col("window.start").alias("window_start"), "feature", "m.condition", ratio.alias("ratio"))


def windowed_correlations(samples: DataFrame, window: str = "1 day", late: str = "2 days", least: int = 3, logs: bool = False) -> DataFrame:
    """(window_start, condition, left, right, r, n): Pearson's correlation of each pair of features over the samples of a window that hold both.

    The state is one row of co-moments per pair and window, to which every sample adds its own pairs; samples are not kept.
    With logs, values are replaced by their logarithms and those that are not positive are left out. Pairs of fewer than
    `least` samples, or constant ones, have no row."""
    own, w = _windowed(samples, window, late)
    cells = F.filter("cells", lambda c: c["value"].isNotNull() & ((c["value"] > 0) if logs else F.lit(True)))
    if logs:
        cells = F.transform(cells, lambda c: F.struct(c["feature"].alias("feature"), F.log(c["value"]).alias("value")))
    pairs = F.flatten(F.transform("cells", lambda a: F.transform(F.filter("cells", lambda b: b["feature"] > a["feature"]), lambda b: F.struct(a["feature"].alias("left"), b["feature"].alias("right"), a["value"].alias("x"), b["value"].alias("y")))))
    rows = own.withColumn("cells", cells).select("ts", "condition", F.explode(pairs).alias("p"))
    x, y = F.col("p.x").cast("double"), F.col("p.y").cast("double")
    by = rows.groupBy(w, "condition", F.col("p.left").alias("left"), F.col("p.right").alias("right"))
    moments = by.agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("_c"), F.stddev_pop(x).alias("_x"), F.stddev_pop(y).alias("_y"), ((F.min(x) < F.max(x)) & (F.min(y) < F.max(y))).alias("_varies"))
    spread = F.col("_x") * F.col("_y")
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_c") / F.when(spread > 0, spread)))
    return moments.where((F.col("n") >= least) & F.col("_varies")).select(F.col("window.start").alias("window_start"), "condition", "left", "right", r.alias("r"), "n")
