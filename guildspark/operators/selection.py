"""Exact order statistics of groups of any size, by histograms that close in on the wanted places.

A pass counts the values between the bounds of each wanted place in BINS bins and keeps the bin that holds the place: no value
moves, only counts per bin do. After two or three passes a bin holds a few values, or one value many times. Where a
distribution is so uneven that PASSES passes leave many, the rest is numbered over ranges of its order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guildspark.sources.staging import cut

from .ranks import row_numbers

BINS, PASSES, FEW = 4096, 4, 10_000


def order_statistics(values: DataFrame, wanted: DataFrame, bins: int = BINS, passes: int = PASSES, few: int = FEW) -> DataFrame:
    """(g, place, v): the values at the 0-based places (g, place) of the sorted finite doubles (g, v) of each group.

    values is read once per pass, so it should be a stored table."""
    bounds = values.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("inside"))
    targets = cut(wanted.distinct().join(bounds, "g").where(F.col("place") < F.col("inside")).withColumn("below", F.lit(0).cast("long")), "targets")
    settled = None
    open_ = (F.col("lo") < F.col("hi")) & (F.col("inside") > few)
    for _ in range(passes):
        rest = targets.where(open_)
        if rest.isEmpty():
            break
        # halves keep the width finite for values of both signs near the largest double
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        within = values.join(rest, "g").where("v >= lo and v <= hi").withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
        counted = within.groupBy("g", "place", "below", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        rising = Window.partitionBy("g", "place").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # `bins` rows at most
        upto = counted.withColumn("upto", F.col("below") + F.sum("n").over(rising))
        first = upto.where(F.col("upto") > F.col("place")).groupBy("g", "place").agg(F.min(F.struct("bin", "lo", "hi", "n", "upto")).alias("b"))
        closer = first.select("g", "place", "b.lo", "b.hi", F.col("b.n").alias("inside"), (F.col("b.upto") - F.col("b.n")).alias("below"))
        now = targets.where(~open_).select(*closer.columns)
        settled = now if settled is None else settled.unionByName(now)
        targets = cut(closer, "targets")
    if settled is not None:
        targets = cut(targets.select(*settled.columns).unionByName(settled), "targets")
    single = targets.where("lo = hi").select("g", "place", F.col("lo").alias("v"))
    some = values.join(targets.where("lo < hi"), "g").where("v >= lo and v <= hi").select("g", "place", "below", "inside", "v")
    numbered = Window.partitionBy("g", "place").orderBy("v")  # `few` rows at most
    of_few = some.where(F.col("inside") <= few).withColumn("i", F.row_number().over(numbered)).where(F.col("i") - 1 == F.col("place") - F.col("below")).select("g", "place", "v")
    many = targets.where((F.col("lo") < F.col("hi")) & (F.col("inside") > few))
    found = single.unionByName(of_few)
    if many.isEmpty():
        return found
    rest = row_numbers(some.where(F.col("inside") > few), ["v"], ["g", "place"], "i")
    return found.unionByName(rest.where(F.col("i") - 1 == F.col("place") - F.col("below")).select("g", "place", "v"))


def percentiles(values: DataFrame, shares: list[float], **how) -> DataFrame:
    """(g, share, v): percentiles of finite doubles (g, v) with linear interpolation between neighbours."""
    stored = cut(values, "values")
    at = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    asked = stored.groupBy("g").agg(F.count("*").alias("n")).select("g", "n", at).withColumn("exact", F.col("share") * (F.col("n") - 1)).withColumn("place", F.floor("exact"))
    asked = cut(asked.withColumns({"next": F.least(F.col("place") + 1, F.col("n") - 1), "part": F.col("exact") - F.col("place")}), "asked")
    found = cut(order_statistics(stored, asked.select("g", "place").unionByName(asked.select("g", F.col("next").alias("place"))), **how), "found")
    low, high = found.withColumnRenamed("v", "low"), found.select("g", F.col("place").alias("next"), F.col("v").alias("high"))
    both = asked.join(low, ["g", "place"]).join(high, ["g", "next"])
    return both.select("g", "share", F.when(F.col("part") > 0, F.col("low") * (1 - F.col("part")) + F.col("high") * F.col("part")).otherwise(F.col("low")).alias("v"))
