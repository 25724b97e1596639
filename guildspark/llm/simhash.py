"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of a text's shingles. Two texts
link if their fingerprints differ in at most `radius` bits. Equal fingerprints form one class first.
Bit i gets a non-zero vector of F_2^(radius+1); mask a (non-zero) takes the bits whose vector has odd
inner product with a. Any `radius` differing bits leave some mask untouched (radius equations in
radius+1 unknowns), so every linked pair shares the key of some table: recall is 1 by construction.

In a table, rows with one key are compared with each other in a task and only a spanning forest of
their links is emitted. Keys are counted before any task gathers them: one with more than `dense`
fingerprints is dealt out anew: its free bits are cut into radius+1 blocks, one of which any linked pair
agrees on, and so on; a key with f free bits has 2^f fingerprints at most, so this ends. Texts of one
fingerprint and fingerprints of one component, however many, are dealt over several tasks in joins.

Defined results: a null or wordless text has fingerprint 0 and links like any other; fewer words than
`size` give one shingle; repeated rows share a class; null ids take part, and a class of null ids only
has a null component; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut, held, join_counted, map_texts, partitions, record_batch, utf8
from .components import components

SEED = 42


def fingerprint(text, size: int = 4) -> int:
    words = utf8(text).translate(ASCII_LOWER).split()
    n = len(words)
    if n == 0:
        return 0
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n <= size:
        hashes = np.array([h(line, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, n) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[: n - size + 1].tolist()
        hashes = np.fromiter((h(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, n - size + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """Rows (id, fp): fp is the fingerprint as a signed long."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        held("simhash", lambda: None)  # no model, but room
        fp = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64)
        return record_batch(schema, id=batch.column("id"), fp=fp.view(np.int64))

    return map_texts(docs, {"id": F.col(doc_id).cast("long"), "text": F.col(text)}, "id long, fp long", per_batch)


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1)-1 masks; for any `radius` bits some mask has none of them."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vectors[i] & a).bit_count() % 2) for a in range(1, 2 ** (radius + 1))]


def block_masks(mask: int, radius: int, bits: int = 64) -> list[int]:
    """mask with one of radius+1 blocks of its free bits added."""
    free = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: breadth first, each reached once."""
    left, out = fps.view(np.uint64), []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            nearest = np.full(len(left), -1)
            for k in range(len(front)):
                near = (np.bitwise_count(left ^ front[k]) <= radius) & (nearest < 0)
                nearest[near] = k
            hit = nearest >= 0
            if not hit.any():
                break
            reached = left[hit]
            out += zip(front[nearest[hit]].view(np.int64).tolist(), reached.view(np.int64).tolist(), strict=True)
            front, left = reached, left[~hit]
    return out


def _links_in_tables(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) among the rows (mask, key, fp) of each (mask, key), which are few."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settle(mask: int, fp: np.ndarray) -> list[tuple[int, int]]:
        if free_bits(mask) <= radius:  # all that share the key are linked
            return [(int(fp[0]), x) for x in fp[1:].tolist()]
        return forest(fp, radius)

    def run(batches):
        head = None  # rows of the last key seen, which the next batch may go on with
        for batch in batches:
            mask, key, fp = (batch.column(c).to_numpy() for c in ("mask", "key", "fp"))
            if head is not None:
                mask, key, fp = (np.concatenate(x) for x in zip(head, (mask, key, fp), strict=True))
            if not len(fp):
                continue
            start = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
            last = start[-1]
            head = (mask[last:], key[last:], fp[last:])
            many = np.flatnonzero(np.diff(start) > 1)
            pairs = [x for s, e in zip(start[many].tolist(), start[many + 1].tolist(), strict=True) for x in settle(int(mask[s]), fp[s:e])]
            if pairs:
                yield record_batch(schema, a=[x for x, _ in pairs], b=[y for _, y in pairs])
        if head is not None and (pairs := settle(int(head[0][0]), head[2])):
            yield record_batch(schema, a=[x for x, _ in pairs], b=[y for _, y in pairs])

    dealt = rows.repartition(partitions(rows.sparkSession), "mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def free_bits(mask: int) -> int:
    return 64 - (mask & (1 << 64) - 1).bit_count()


def _keyed(fps: DataFrame, masks) -> DataFrame:
    return fps.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def links(distinct: DataFrame, radius: int = 4, dense: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that are within the radius."""
    rows = _keyed(distinct, F.array(*[F.lit(signed(m)) for m in covering_masks(radius)]))
    found = None
    while True:
        over = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > dense)
        over = cut(over.where(64 - F.bit_count("mask") > radius).withColumn("over", F.lit(True)), "simhash-dense")
        masks = [r[0] for r in over.select("mask").distinct().collect()]  # masks, not rows: a fixed number of tables and blocks
        thin = rows
        if masks:
            told = join_counted(rows, over, ["mask", "key"], rows.count(), F.xxhash64("fp"), "left")
            thin = told.where("over is null").drop("over")
        some = cut(_links_in_tables(thin, radius), "simhash-links")
        found = some if found is None else found.unionByName(some)
        if not masks:
            return found
        blocks = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(signed(b)) for b in block_masks(m & (1 << 64) - 1, radius)]))])
        rows = cut(_keyed(told.where("over"), blocks[F.col("mask")]).distinct(), "simhash-finer")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4, dense: int = 4096) -> DataFrame:
    """One row per document: id, fp, component (the smallest id reachable over links, itself included)."""
    fps = cut(fingerprints(docs, doc_id, text, size), "fingerprints")
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "fingerprint-classes")
    found = cut(components(links(classes.select("fp"), radius, dense), "a", "b").select(F.col("node").alias("fp"), "root"), "fingerprint-components")
    reps = found.join(classes, "fp").groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("n"))
    known = join_counted(found, reps, ["root"], found.count(), F.xxhash64("fp")).select("fp", "component")
    by_fp = classes.join(known, "fp", "left").select("fp", "n", F.coalesce("component", "rep").alias("component"))
    # rows of one fingerprint are told apart by their place in the files, which a repeated task finds again
    return join_counted(fps, by_fp, ["fp"], fps.count(), F.monotonically_increasing_id()).select("id", "fp", "component")
