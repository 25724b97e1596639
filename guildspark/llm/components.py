"""Connected components of a link table by local contraction and large-star and small-star steps.

A round first contracts the links of each task in pieces of bounded size (any links may be contracted
together), then connects the tasks' results: every star step is a group-by with a minimum and a count
(combined before the shuffle) and a join, in which a node with many links is dealt over several tasks.
The links are written to the shared folder after each step, and a few numbers per round reach the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted


def components(links: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 60) -> DataFrame:
    """Rows (node, root): root is the smallest node reachable. Nodes without links do not occur.

    Self-links and repeated links do no harm; null ends are ignored; no links give no rows."""
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        edges = cut(edges.mapInArrow(_contract, "u long, v long"), "links")
        edges = cut(_large_star(edges), "links")
        edges = cut(_small_star(edges), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _contract(batches, piece: int = 500_000):
    """Links (u, v) of each piece as links of every node to the smallest node that the piece connects it to."""

    def forest(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while x != top:
                root[x], x = top, root[x]
            return top

        for b in rows:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, b_ = find(u), find(v)
                if a != b_:
                    root[max(a, b_)] = min(a, b_)
        ends = [(x, find(x)) for x in list(root)]
        ends = [(x, y) for x, y in ends if x != y]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in range(2)], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= piece:
            yield forest(held)
            held, n = [], 0
    if held:
        yield forest(held)


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = join_counted(both, least, ["u"], 2 * edges.count(), F.xxhash64("v"))
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; every link is written (larger, smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = join_counted(edges, least, ["u"], edges.count(), F.xxhash64("v"))
    own = least.select("u", F.col("m").alias("v"))
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).where("u <> v").distinct()
