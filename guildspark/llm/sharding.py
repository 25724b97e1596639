"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of a source are put in a seeded random order (by the MD5 of seed and id) and get the fractional
rank (rank - 1/2) / (rows of the source). All rows sorted by fractional rank interleave the sources in
proportion, and cutting that order into equal runs gives shards that each hold the whole mixture, with
row counts at most one apart.

No rank is taken over a whole source or over all rows in one task. The hash orders a source's rows over
16^digits buckets, evenly by construction, so a rank is the count of the buckets before plus the place
inside the bucket. The order by fractional rank is cut into pieces, and each (source, bucket) learns from
which key on its rows lie in which piece. Whole rows then cross one exchange, to their piece, where their
exact ranks follow from the counts of the pieces before.

Defined results: null texts have no bytes; a null source is a source of its own; ties of id are broken
by the text's checksum and size, and rows equal in all of these may swap places (at the border of a
piece such rows stay together, which may move a neighbour by their number); null ids are ordered by
their checksum; an empty table gives no rows; more shards than rows leave some empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, partitions

#: Tables of pieces up to this many rows are broadcast (about 100 bytes each); larger ones are joined as Spark chooses.
SMALL = 200_000
#: Rows that a bucket should have.
BUCKET = 50_000
TIES = ("_h", "_known", "_id", "_crc", "_size")


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 8).cast("long")


def crc_of(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _before(counts: DataFrame, by: list[str], order: str, n: str = "n") -> Column:
    """Rows before each of the counted groups: a running sum over counts."""
    w = (Window.partitionBy(*by) if by else Window).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(w), F.lit(0))


def place(docs: DataFrame, n_shards: int = 24, seed: str = "17", digits: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, dict[str, str]]:
    """docs with two more columns, and their names: shard int, and slot long, which counts the rows of a shard from 0 without gaps.

    digits: hexadecimal digits of the hash that name a bucket; by default as many as the rows need."""
    names = {k: fresh(docs, k) for k in ("shard", "slot")}
    spark = docs.sparkSession
    stratum = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("none"))
    crc = crc_of(text)
    who = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.concat(F.lit("null:"), crc.cast("string")))
    number = F.col(f"`{doc_id}`").cast("long")
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row")
    keyed = docs.select(row, stratum.alias("_s"), F.md5(F.concat(F.lit(f"{seed}:"), who)).alias("_h"), number.isNotNull().cast("int").alias("_known"), F.coalesce(number, F.lit(0)).alias("_id"), crc.alias("_crc"), size_of(text).alias("_size"))
    sources = cut(docs.groupBy(stratum.alias("_s")).agg(F.count("*").alias("n_s")), "shard-sources")
    total = sources.agg(F.sum("n_s")).first()[0] or 0
    if digits is None:
        digits = next(d for d in range(1, 9) if total <= BUCKET * 16**d or d == 8)
    keyed = keyed.withColumn("_b", F.substring("_h", 1, digits))
    pieces = 4 * partitions(spark)

    bucket = Window.partitionBy("_s", "_b").orderBy(*TIES)
    keys = keyed.drop("row")
    counts = keys.groupBy("_s", "_b").agg(F.count("*").alias("n"))
    starts = counts.select("_s", "_b", _before(counts, ["_s"], "_b").alias("_start")).join(sources, "_s")
    ranked = keys.withColumn("_r", F.row_number().over(bucket)).join(starts, ["_s", "_b"])
    piece = F.floor((F.col("_start") + F.col("_r") - 0.5) / F.col("n_s") * pieces)
    ranked = ranked.withColumn("_p", piece).withColumn("_p", F.max("_p").over(Window.partitionBy("_s", "_b", *TIES)))
    edges = cut(ranked.groupBy("_s", "_b", "_p").agg(F.count("*").alias("n"), F.min(F.struct(*TIES)).alias("first")), "shard-pieces")
    per_piece = edges.groupBy("_p").agg(F.sum("n").alias("n"))
    per_piece = per_piece.select("_p", _before(per_piece, [], "_p").alias("_piece_start"))
    inner = edges.groupBy("_s", "_p").agg(F.sum("n").alias("n"))
    inner = inner.select("_s", "_p", _before(inner, ["_s"], "_p").alias("_start")).join(per_piece, "_p").join(sources, "_s")
    borders = edges.groupBy("_s", "_b").agg(F.collect_list(F.struct("first", "_p")).alias("borders"))
    if edges.count() <= SMALL:
        inner, borders = F.broadcast(inner), F.broadcast(borders)

    reached = F.filter("borders", lambda x: x["first"] <= F.struct(*TIES))
    rows = keyed.join(borders, ["_s", "_b"]).withColumn("_p", F.array_max(F.transform(reached, lambda x: x["_p"]))).drop("borders", "_b")
    rows = rows.repartition(partitions(spark), "_p").withColumn("_r", F.row_number().over(Window.partitionBy("_p", "_s").orderBy(*TIES))).join(inner, ["_s", "_p"])
    rows = rows.withColumn("_f", (F.col("_start") + F.col("_r") - 0.5) / F.col("n_s"))
    rows = rows.withColumn("_g", F.col("_piece_start") + F.row_number().over(Window.partitionBy("_p").orderBy("_f", "_s", *TIES)) - 1)
    rows = rows.withColumn("_shard", F.expr(f"(_g * {n_shards}) div {max(1, total)}").cast("int"))
    slot = F.col("_g") - F.expr(f"(_shard * {total}L + {n_shards - 1}) div {n_shards}")
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return rows.select(*own, F.col("_shard").alias(names["shard"]), slot.alias(names["slot"])), names


def write(docs: DataFrame, path: str, n_shards: int = 24, **how) -> tuple[DataFrame, dict[str, str]]:
    """Writes every row of docs into a folder per shard, its files in slot order, and returns the rows as read from there, and the names of place()."""
    placed, names = place(docs, n_shards, **how)
    placed.sortWithinPartitions(*names.values()).write.partitionBy(names["shard"]).option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path).select(*[F.col(f"`{c}`") for c in placed.columns]), names


def digests(rows: DataFrame, names: dict[str, str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, size, crc, shard, slot) of placed rows."""
    return rows.select(F.col(doc_id).cast("long").alias("id"), size_of(text).alias("size"), crc_of(text).alias("crc"), F.col(names["shard"]).alias("shard"), F.col(names["slot"]).alias("slot"))


def shards(docs: DataFrame, n_shards: int = 24, seed: str = "17", digits: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Digests (id, size, crc, shard, slot) of place()."""
    return digests(*place(docs, n_shards, seed, digits, doc_id, text, source), doc_id, text)
