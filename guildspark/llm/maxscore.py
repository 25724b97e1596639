"""Exact top-k inner products with MaxScore over sharded postings of quantised vectors.

A vector's components become integers; a component that is not 0 is a term, whose posting in a shard holds the
shard's vectors that have it, and their values. The most that a term can add to a query's score in a shard bounds
it. Terms are taken by that bound: those whose bounds together stay below the query's k-th best score so far are
non-essential, since a vector with no other term cannot reach it. Essential postings are traversed; the others are
probed, strongest first, for the vectors that can still compete. Every shard gives its k best, and these are merged.

Shards and blocks of queries have a fixed size, so a task's memory does not grow with the table: their numbers do.

Defined results: vectors that are null or hold a null or non-finite component take no part; an empty vector scores
0; where lengths differ, the missing components count as 0; rows with a query's id are its own and no candidates;
equal rows are one row asked once and found as often as it stands there, rows that share an id alone are several;
a null id asks nothing and is found last among ties; integers and scores beyond a long become its limit (scores are
compared before that); an empty table gives no rows; columns other than the two named ones are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD_ROWS, BLOCK_QUERIES = 8192, 2048
LONG = 2**63 - 1
FOUND = pa.schema([("query_id", pa.int64()), ("query", pa.string()), ("vec_id", pa.int64()), ("score", pa.int64()), ("tie", pa.string())])


class Postings:
    """The vectors of one shard by term. Vectors are numbered in the order of their ids, nulls last, so a tie goes to the lower number."""

    def __init__(self, ids: list, copies: list[int], vectors: list, exact: bool):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids, self.copies = [ids[i] for i in order], [copies[i] for i in order]
        self.width = max((len(v) for v in vectors), default=0)
        self.terms = np.zeros((self.width, len(ids)), np.int64 if exact else object)
        for n, i in enumerate(order):
            self.terms[: len(vectors[i]), n] = vectors[i]
        self.most, self.least = (self.terms.max(axis=1), self.terms.min(axis=1)) if len(ids) else (np.zeros(self.width, np.int64),) * 2
        self.having = [None if (has := t != 0).all() else np.flatnonzero(has) for t in self.terms]
        self.number = {}
        for n, key in enumerate(self.ids):
            self.number.setdefault(key, []).append(n)

    def start(self, strong: np.ndarray, query: np.ndarray, own: list[int], k: int):
        """The k-th best score among some vectors in which a strong term of the query stands out; None if they are fewer."""
        some = {int(n) for i in strong for n in self._ends(i, query[i] > 0)} - set(own)
        if len(some) < k:
            return None
        at = np.fromiter(some, np.int64, len(some))
        return np.sort(query @ self.terms[: len(query), at])[-k]

    def _ends(self, term: int, high: bool, n: int = 16) -> np.ndarray:
        t = self.terms[term]
        n = min(n, len(t))
        return np.argpartition(t, len(t) - n)[len(t) - n :] if high else np.argpartition(t, n - 1)[:n]

    def best(self, asked, own_id, k: int) -> list[tuple[int, int]]:
        """(score, number) of the k best vectors, best first."""
        query = np.array(asked[: self.width], self.terms.dtype)
        own = self.number.get(own_id, [])
        used = np.flatnonzero(query)
        bound = np.maximum(np.maximum(query[used] * self.most[used], query[used] * self.least[used]), 0)
        rising = np.argsort(bound, kind="stable")
        used, total = used[rising], np.cumsum(bound[rising])
        least = self.start(used[-4:], query, own, k)
        everything = least is None or least <= 0  # vectors without any term of the query score 0
        light = 0 if everything else int(np.searchsorted(total, least, "left"))  # total[light - 1] < least
        score = np.zeros(self.terms.shape[1], self.terms.dtype)
        seen = np.full(len(score), everything)
        for i in used[light:]:
            docs = self.having[i]
            if docs is None:
                score += query[i] * self.terms[i]
                seen[:] = True
            else:
                score[docs] += query[i] * self.terms[i, docs]
                seen[docs] = True
        seen[own] = False
        left = total[light - 1] if light else 0
        docs = np.flatnonzero(seen if least is None else seen & (score + left >= least))
        score = score[docs]
        for j in range(light - 1, -1, -1):
            left = total[j - 1] if j else 0
            score = score + query[used[j]] * self.terms[used[j], docs]
            stays = score + left >= least
            docs, score = docs[stays], score[stays]
        if len(docs) > k:
            floor = np.partition(score, len(score) - k)[len(score) - k]
            docs, score = docs[score >= floor], score[score >= floor]
        out: list[tuple[int, int]] = []
        for n in np.lexsort((docs, -score))[:k] if score.dtype != object else sorted(range(len(docs)), key=lambda n: (-score[n], docs[n]))[:k]:
            out += [(int(score[n]), int(docs[n]))] * min(k, self.copies[docs[n]])
        return out[:k]


def _fits(left: list, right: list) -> bool:
    """Whether every sum of products stays within 62 bits."""
    high = [max((abs(x) for v in side for x in v), default=0) for side in (left, right)]
    return high[0] * high[1] * max(1, max((len(v) for v in left), default=1)) < 2**62


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in FOUND.names}
        if left.num_rows and right.num_rows:
            vectors = left.column("vec").to_pylist()
            asked = [q for block in right.column("asked").to_pylist() for q in block]
            shard = Postings(left.column("id").to_pylist(), left.column("copies").to_pylist(), vectors, _fits(vectors, [q["vec"] for q in asked]))
            for q in asked:
                for score, n in shard.best(q["vec"], q["id"], k):
                    within = max(-LONG - 1, min(LONG, score))
                    values = (q["id"], q["query"], shard.ids[n], within, "" if within == score else f"{score + (1 << 160):041x}")
                    for c, v in zip(FOUND.names, values, strict=True):
                        out[c].append(v)
        return pa.Table.from_pydict(out, schema=FOUND)

    return run


def quantised(vectors: DataFrame, embedding: str = "embedding", id: str = "vec_id", scale: float = 256.0) -> DataFrame:
    """Rows (id, vec, copies): the integer vectors that take part, equal rows once."""
    x = F.col(f"`{embedding}`")
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")))
    return vectors.where(sound).select(F.col(f"`{id}`").cast("long").alias("id"), whole.alias("vec")).groupBy("id", "vec").agg(F.count("*").alias("copies"))


def top_k(rows: DataFrame, asks: Column, k: int = 5, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the rows (id, vec, copies) that ask, against all rows with another id.

    rows is read several times, so it should be a stored table."""
    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(asks, 1)), F.lit(0)).alias("q")).first()
    shards, blocks = -(-sizes["n"] // shard_rows) or 1, -(-sizes["q"] // block_queries) or 1
    place = F.xxhash64("id", "vec")
    dealt = rows.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    name = F.md5(F.concat_ws(",", F.col("vec").cast("array<string>")).cast("binary"))
    packed = (
        rows.where(asks)
        .select(F.pmod(place, F.lit(blocks)).cast("int").alias("block"), F.struct("id", name.alias("query"), "vec").alias("one"))
        .groupBy("block")
        .agg(F.collect_list("one").alias("asked"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    found = dealt.groupBy("block", "shard").cogroup(packed.groupBy("block", "shard")).applyInArrow(_search(k), "query_id long, query string, vec_id long, score long, tie string")
    best = W.partitionBy("query_id", "query").orderBy(F.desc("score"), F.desc("tie"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
