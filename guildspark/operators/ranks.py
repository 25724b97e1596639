"""Row numbers over tables of any size, in groups or over all rows, without a task that sees a whole group.

Rows are dealt to tasks by ranges of the order and sorted there; each row then knows its range and its number in it. The ranges'
sizes per group, a few rows each, are summed in order, and a row's place is its number plus what comes before its range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guildspark.sources.staging import cut

#: Rows of a range are numbered in the low bits of `monotonically_increasing_id`, ranges in the high ones.
LOW_BITS = 33


def row_numbers(df: DataFrame, order: list, by: list[str] | None = None, name: str = "place") -> DataFrame:
    """df with a column `name`: the number of each row, from 1, in its group `by` in the order of `order` (names or sort columns).

    Rows that the order does not tell apart are numbered in some order; it should be complete where that matters. The ranges are
    drawn from a sample of the rows, so they are even if no value of the order is itself very frequent."""
    by = list(by or [])
    columns = [F.col(c) if isinstance(c, str) else c for c in (*by, *order)]
    at, part, local, first = (f"_{x}_of_{name}" for x in ("at", "part", "local", "first"))
    placed = cut(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(at, F.monotonically_increasing_id()), "ranges")
    split = placed.withColumns({part: F.shiftright(at, LOW_BITS), local: F.col(at).bitwiseAND(F.lit((1 << LOW_BITS) - 1))}).drop(at)
    sizes = split.groupBy(*by, part).agg(F.count("*").alias("n"), F.min(local).alias(first))
    before = Window.partitionBy(*[F.col(c) for c in by]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # without groups the window sees one row per range, not the rows
    starts = sizes.select(*by, part, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col(first)).alias(first))
    keyed = starts.select(*[F.col(c).alias(f"_{i}_by_{name}") for i, c in enumerate(by)], F.col(part).alias(f"_p_by_{name}"), first)
    same = F.col(part) == F.col(f"_p_by_{name}")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_{i}_by_{name}"))
    found = split.join(keyed, same)
    return found.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(local) + F.col(first) + 1).alias(name))


def evenly_spaced(df: DataFrame, size: int, order: list) -> DataFrame:
    """`size` rows of df at even steps through its order, both ends included; halves round to even."""
    if size < 1:
        raise ValueError("size must be positive")
    total = df.count()
    step = (total - 1) / (size - 1.0) if size > 1 else 0.0
    picks = sorted({round(1 + i * step) for i in range(size)})
    return row_numbers(df, order).where(F.col("place").isin(picks))


def first_rows(df: DataFrame, size: int, order: list) -> DataFrame:
    """The first `size` rows in an order: every task keeps that many, and one merges what they kept."""
    return df.orderBy(*order).limit(size)
