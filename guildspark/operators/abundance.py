"""Filters and roll-ups of abundance tables in long form (sample_id, feature, value); an absent row is a missing value.

Filters see every sample of the table and count a missing value as 0; group sums, condition means and
correlations do not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guildspark.sources.staging import cut

from . import ranks

#: Cap of the items that a removal report lists.
DROP_ITEMS = 50
AGGRESSIVE_SHARE = 0.6


@dataclass(frozen=True)
class TaxaFilter:
    """Thresholds; None switches a filter off. Percentages for prevalence and mean relative abundance."""

    prevalence_percent: float | None = None
    mean_relative_percent: float | None = None
    min_variance: float | None = None

    def __post_init__(self):
        for name in ("prevalence_percent", "mean_relative_percent"):
            v = getattr(self, name)
            if v is not None and not 0 <= v <= 100:
                raise ValueError(f"{name} must be between 0 and 100")
        if self.min_variance is not None and self.min_variance < 0:
            raise ValueError("min_variance must not be negative")

    @property
    def enabled(self) -> bool:
        return any(v is not None for v in (self.prevalence_percent, self.mean_relative_percent, self.min_variance))


#: Presets (fixed values).
PRESETS = {
    "exploratory": TaxaFilter(prevalence_percent=10.0),
    "balanced": TaxaFilter(prevalence_percent=20.0, mean_relative_percent=0.01),
    "stringent": TaxaFilter(prevalence_percent=50.0, mean_relative_percent=0.05),
}


def describe_filter(config: TaxaFilter) -> str:
    """The active filters in words."""
    parts = []
    if config.prevalence_percent is not None:
        parts.append(f"prevalence >= {config.prevalence_percent:g} % of samples")
    if config.mean_relative_percent is not None:
        parts.append(f"mean relative abundance >= {config.mean_relative_percent:g} %")
    if config.min_variance is not None:
        parts.append(f"variance >= {config.min_variance:g}")
    return "; ".join(parts) or "no taxa filtering"


def subset(abundance: DataFrame, n_samples: int, n_features: int, strategy: str = "spread") -> DataFrame:
    """A deterministic smaller table: evenly spaced samples by name, then varying features, evenly spaced by
    (prevalence, abundance, name) or the most prevalent; empty samples and features are left out before."""
    if strategy not in ("spread", "prevalent"):
        raise ValueError(f"unknown strategy: {strategy}")
    full = abundance.where("value > 0")
    names = cut(full.select("sample_id").distinct(), "names")
    cells = full.join(ranks.evenly_spaced(names, n_samples, ["sample_id"]).select("sample_id"), "sample_id", "left_semi")
    by = cut(varying_features(cells, cells).join(cells.groupBy("feature").agg(F.count("*").alias("k"), F.sum("value").alias("v")), "feature"), "features")
    chosen = ranks.evenly_spaced(by, n_features, ["k", "v", "feature"]) if strategy == "spread" else ranks.first_rows(by, n_features, [F.desc("k"), F.desc("v"), F.asc("feature")])
    return keep_features(cells, chosen)


def sample_totals(abundance: DataFrame) -> DataFrame:
    """(sample_id, total)."""
    return abundance.groupBy("sample_id").agg(F.sum("value").alias("total"))


def combined_totals(first: DataFrame, second: DataFrame) -> DataFrame:
    """Totals over two domains, over the union of their samples."""
    return sample_totals(first.select("sample_id", "value").unionByName(second.select("sample_id", "value")))


def relative_abundance(abundance: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Adds `relative`: value / total, 0 if the total is not positive; a sample that `totals` misses uses its own total."""
    own = sample_totals(abundance)
    if totals is not None:
        own = own.join(totals.select("sample_id", F.col("total").alias("given")), "sample_id", "left").select("sample_id", F.coalesce("given", "total").alias("total"))
    return abundance.join(own, "sample_id").withColumn("relative", F.when(F.col("total") > 0, F.try_divide("value", "total")).otherwise(0.0))


def feature_metrics(abundance: DataFrame, totals: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """(feature, n_samples, prevalence, mean_relative, variance) over all samples of the table, or over the given ones
    (sample_id), of which some may have no cells; one pass over the
    present cells, zeros enter through the number of samples: the squares around the mean of the present cells
    are summed with a correction for the zeros, which stays accurate where sum(x^2) - n*mean^2 would cancel."""
    n = (abundance if samples is None else samples).select("sample_id").distinct().agg(F.count("*").alias("n_samples"))
    rel = relative_abundance(abundance, totals)
    by = rel.groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("_present"), F.sum("relative").alias("_sum"), F.count("*").alias("_k"), F.var_pop("relative").alias("_var"))
    k, total = F.col("_k"), F.col("n_samples")
    mean = F.col("_sum") / total
    own = F.col("_sum") / k
    variance = (k * F.col("_var") + k * (own - mean) * (own - mean) + (total - k) * mean * mean) / total
    return by.crossJoin(F.broadcast(n)).select("feature", "n_samples", (F.col("_present") / total).alias("prevalence"), mean.alias("mean_relative"), variance.alias("variance"))


def removal_reasons(metrics: DataFrame, config: TaxaFilter) -> DataFrame:
    """Adds `reasons`: the filters that a feature fails, in a fixed order; a threshold that is met exactly keeps it."""
    checks = (("prevalence", "prevalence", config.prevalence_percent, 100.0), ("meanRelativeAbundance", "mean_relative", config.mean_relative_percent, 100.0), ("variability", "variance", config.min_variance, 1.0))
    failed = [F.when(F.col(column) < limit / scale, name) for name, column, limit, scale in checks if limit is not None]
    return metrics.withColumn("reasons", F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>"))


def keep_features(abundance: DataFrame, features: DataFrame) -> DataFrame:
    return abundance.join(features.select("feature"), "feature", "left_semi")


def filter_taxa(abundance: DataFrame, config: TaxaFilter, totals: DataFrame | None = None, samples: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The restricted table and the per-feature metrics with reasons."""
    judged = removal_reasons(feature_metrics(abundance, totals, samples), config)
    return keep_features(abundance, judged.where(F.size("reasons") == 0)), judged


def filter_report(judged: DataFrame, domain: str, combined: bool = False) -> DataFrame:
    """One row: counts before and after, removals by filter, removed share, whether it is aggressive, and what was excluded."""
    out = F.size("reasons") > 0
    by = [F.count_if(F.array_contains("reasons", r)).alias(f"removed_{c}") for r, c in (("prevalence", "prevalence"), ("meanRelativeAbundance", "mean_relative"), ("variability", "variability"))]
    item = F.struct(F.col("feature").alias("taxon"), "reasons", F.bround(F.col("prevalence") * 100, 4).alias("prevalence_percent"), F.bround(F.col("mean_relative") * 100, 6).alias("mean_relative_abundance_percent"), F.col("variance").alias("relative_abundance_variance"))
    one = judged.agg(F.max("n_samples").alias("total_samples"), F.count("*").alias("before"), F.count_if(~out).alias("after"), *by, F.sort_array(F.collect_list(F.when(out, item))).alias("excluded"))
    share = F.coalesce(F.try_divide(F.col("before") - F.col("after"), F.col("before")), F.lit(0.0))
    return one.select(F.lit(domain).alias("domain"), F.lit("combined_bacteria_fungi" if combined else "domain").alias("denominator"), "*", F.bround(share * 100, 4).alias("removed_share_percent"), (share > AGGRESSIVE_SHARE).alias("aggressive_removal"))


def varying_features(abundance: DataFrame, samples: DataFrame) -> DataFrame:
    """Features with more than one value over the given samples, a missing cell being 0."""
    n = samples.select("sample_id").distinct().agg(F.count("*").alias("_n"))
    present = abundance.join(samples.select("sample_id").distinct(), "sample_id", "left_semi").groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.countDistinct("sample_id").alias("_k"))
    lo = F.when(F.col("_k") < F.col("_n"), F.least("_lo", F.lit(0.0))).otherwise(F.col("_lo"))
    hi = F.when(F.col("_k") < F.col("_n"), F.greatest("_hi", F.lit(0.0))).otherwise(F.col("_hi"))
    return present.crossJoin(F.broadcast(n)).where(lo != hi).select("feature")


def varying_by_condition(cells: DataFrame) -> DataFrame:
    """(condition, feature) of the features with more than one value over all samples of the condition, a missing cell being 0.

    A condition's samples are those with any of its cells (condition, sample_id, feature, value)."""
    n = cells.groupBy("condition").agg(F.countDistinct("sample_id").alias("_n"))
    present = cells.groupBy("condition", "feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.countDistinct("sample_id").alias("_k"))
    absent = F.col("_k") < F.col("_n")
    lo = F.when(absent, F.least("_lo", F.lit(0.0))).otherwise(F.col("_lo"))
    hi = F.when(absent, F.greatest("_hi", F.lit(0.0))).otherwise(F.col("_hi"))
    return present.join(n, "condition").where(lo != hi).select("condition", "feature")


def non_empty_samples(abundance: DataFrame) -> DataFrame:
    return abundance.groupBy("sample_id").agg(F.sum("value").alias("total")).where("total > 0").select("sample_id")


def drop_events(features: DataFrame, reason: str) -> DataFrame:
    """One row for features that a method drops: count, the first names (null if none) and whether the list was cut."""
    first = features.select("feature").orderBy("feature").limit(DROP_ITEMS).agg(F.nullif(F.sort_array(F.collect_list("feature")), F.array().cast("array<string>")).alias("items"))
    n = features.agg(F.count("*").alias("dropped"))
    return n.crossJoin(first).select(F.lit(reason).alias("reason"), "dropped", "items", (F.col("dropped") > DROP_ITEMS).alias("truncated"))


def taxon_of(label: Column, mode: str) -> Column:
    """The taxon of a feature name: its first token that starts with p_ or g_, without prefix and underscores."""
    if mode == "all":
        return label
    if mode not in ("phylum", "genus"):
        raise ValueError(f"unknown grouping: {mode}")
    prefix = "p_" if mode == "phylum" else "g_"
    tokens = F.filter(F.transform(F.split(label, "[;,|]"), lambda t: F.trim(t)), lambda t: F.startswith(F.lower(t), F.lit(prefix)))
    name = F.trim(F.regexp_replace(F.substring(F.get(tokens, F.lit(0)), 3, 1 << 30), r"^[_ ]+|[_ ]+$", ""))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(f"{mode}_unknown"))


def group_taxa(abundance: DataFrame, mode: str) -> DataFrame:
    """Sums values of a sample over the features of a taxon."""
    if mode == "all":
        return abundance.select("sample_id", "feature", "value")
    return abundance.groupBy("sample_id", taxon_of(F.col("feature"), mode).alias("feature")).agg(F.sum("value").alias("value"))


def mean_present(abundance: DataFrame, samples: DataFrame) -> DataFrame:
    """(feature, mean): mean of the present values over the given samples; 0 where none is present."""
    inside = abundance.join(samples.select("sample_id").distinct().withColumn("_in", F.lit(1)), "sample_id", "left")
    return inside.groupBy("feature").agg(F.coalesce(F.avg(F.when(F.col("_in") == 1, F.col("value"))), F.lit(0.0)).alias("mean"))


def overabundance(abundance: DataFrame, metadata: DataFrame) -> DataFrame:
    """(condition, feature, ratio): mean in the condition over the mean in all samples with metadata; 1 if that is not positive."""
    joined = abundance.join(metadata, "sample_id")
    overall = joined.groupBy("feature").agg(F.avg("value").alias("_all"))
    per = joined.groupBy("condition", "feature").agg(F.avg("value").alias("_own"))
    grid = overall.crossJoin(F.broadcast(metadata.select("condition").distinct()))
    return grid.join(per, ["condition", "feature"], "left").select("condition", "feature", F.when(F.col("_all") > 0, F.try_divide(F.coalesce("_own", F.lit(0.0)), F.col("_all"))).otherwise(1.0).alias("ratio"))


def condition_stats(abundance: DataFrame, metadata: DataFrame) -> DataFrame:
    """(condition, metadata_samples, matched, missing)."""
    have = abundance.select("sample_id").distinct().withColumn("_in", F.lit(1))
    return metadata.join(have, "sample_id", "left").groupBy("condition").agg(F.count("*").alias("metadata_samples"), F.count("_in").alias("matched"), (F.count("*") - F.count("_in")).alias("missing"))


def condition_stats_both(first: DataFrame, second: DataFrame, metadata: DataFrame) -> DataFrame:
    """(condition, bacteria, fungi, cross, total): matched samples by domain, in both and in either."""
    a = first.select("sample_id").distinct().withColumn("_a", F.lit(1))
    b = second.select("sample_id").distinct().withColumn("_b", F.lit(1))
    return metadata.join(a, "sample_id", "left").join(b, "sample_id", "left").groupBy("condition").agg(F.count("_a").alias("bacteria"), F.count("_b").alias("fungi"), F.count(F.col("_a") + F.col("_b")).alias("cross"), F.count(F.coalesce("_a", "_b")).alias("total"))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one loaded last."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def clr(abundance: DataFrame, pseudo: float = 0.5) -> DataFrame:
    """Centred log-ratio over the full grid of samples and features: log of closed value plus pseudo-count, minus its sample mean."""
    grid = abundance.select("sample_id").distinct().crossJoin(F.broadcast(abundance.select("feature").distinct()))
    full = grid.join(abundance, ["sample_id", "feature"], "left").select("sample_id", "feature", (F.coalesce("value", F.lit(0.0)) + pseudo).alias("_v"))
    w = Window.partitionBy("sample_id")
    return full.select("sample_id", "feature", (F.log("_v") - F.avg(F.log("_v")).over(w)).alias("clr"))


def mclr(abundance: DataFrame) -> DataFrame:
    """Modified centred log-ratio: positive cells are centred on the sample's positive cells and shifted to be positive; zeros stay 0."""
    w = Window.partitionBy("sample_id")
    centred = abundance.where("value > 0").select("sample_id", "feature", (F.log("value") - F.avg(F.log("value")).over(w)).alias("_c"))
    shift = centred.agg((F.abs(F.min("_c")) + 1).alias("_s"))
    return centred.crossJoin(F.broadcast(shift)).select("sample_id", "feature", (F.col("_c") + F.col("_s")).alias("mclr"))


def merged_metadata(first: DataFrame, second: DataFrame) -> DataFrame:
    """(sample_id, condition) of two tables with one row per sample; the first wins where both have it."""
    both = first.select("sample_id", F.col("condition").alias("_a")).join(second.select("sample_id", F.col("condition").alias("_b")), "sample_id", "full")
    return both.select("sample_id", F.coalesce("_a", "_b").alias("condition"))


def common_samples(meta_a: DataFrame, meta_b: DataFrame, table_a: DataFrame, table_b: DataFrame) -> DataFrame:
    """(condition, sample_id): both metadata give the same condition and both tables have the sample."""
    out = meta_a.select("sample_id", "condition").join(meta_b.select("sample_id", "condition"), ["sample_id", "condition"], "left_semi")
    for table in (table_a, table_b):
        out = out.join(table.select("sample_id"), "sample_id", "left_semi")
    return out.select("condition", "sample_id").distinct()


def known_samples(*metadata: DataFrame) -> DataFrame:
    out = metadata[0].select("sample_id")
    for m in metadata[1:]:
        out = out.unionByName(m.select("sample_id"))
    return out.distinct()
