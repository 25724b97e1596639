"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows of test items.

Words are `[0-9a-z\\x80-...]+` after lower-casing A-Z. A pattern is a window of `window` consecutive
words of an item, or the whole item if it has fewer words. Patterns and texts are written with one
space around every word, so a match of a pattern always covers whole words. One scan of a text finds
all patterns; word numbers and character spans in the original text are derived from the offsets of
the normalised one, which has the same byte positions until the words are joined.

Defined results: a null or wordless text has no words, no hits and no items; an item without words
gives no pattern; equal windows of several items report every item; repeated rows each get a row;
null ids are kept; an empty item table hits nothing."""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, held, map_texts, numbered, record_batch, utf8

#: Word bytes keep their place (A-Z in lower case), all others become a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Patterns of one block. The automaton of 8.0 MB of 13-word windows was measured at 338 MB, 42 times its patterns; a worker holds one block's.
BLOCK_BYTES = 4 << 20

OUT = "id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>"
ARROW = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def item_windows(text, window: int) -> list[bytes]:
    words = utf8(text).translate(TO_WORDS).split()
    if not words:
        return []
    last = max(1, len(words) - window + 1)
    return [b" ".join(words[i : i + window]) for i in range(last)]


def automaton(key: str, patterns: dict[bytes, list[int]]):
    """Built once in each Python worker, which keeps the latest one."""

    def build():
        found = ahocorasick.Automaton()
        for p, items in patterns.items():
            found.add_word(f" {p.decode('latin-1')} ", (p.count(b" ") + 1, items))
        found.make_automaton()
        return found

    return held(("patterns", key), build)


def scan(text, found) -> tuple[int, list[tuple[int, int]], set[int], bytes]:
    """Number of words, hit word ranges, items, and the text with its words marked out."""
    marked = utf8(text).translate(TO_WORDS)
    words = marked.split()
    if not words or not len(found):
        return len(words), [], set(), marked
    line = f" {b' '.join(words).decode('latin-1')} "
    matches = list(found.iter(line))
    if not matches:
        return len(words), [], set(), marked
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # offset of the space after each word
    ranges, items = [], set()
    for at, (length, ids) in matches:
        last = int(np.searchsorted(ends, at))
        ranges.append((last - length + 1, last + 1))
        items.update(ids)
    return len(words), ranges, items, marked


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def char_spans(marked: bytes, text, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maps word ranges to [start, end) in characters of the original text."""
    inside = np.concatenate(([0], (np.frombuffer(marked, np.uint8) != 32).view(np.int8), [0]))
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    raw = np.frombuffer(utf8(text), np.uint8)
    char = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(char[starts[a]]), int(char[ends[b - 1]])) for a, b in ranges]


class Blocks:
    """The patterns of an item table, dealt by their hash into blocks of about max_bytes.

    Spark takes the windows, unites the items of equal ones and writes them; the driver holds one block at
    a time, to broadcast it."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str, window: int, max_bytes: int):
        schema = pa.schema([("pattern", pa.binary()), ("item", pa.int64())])

        def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(p, i) for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True) for p in set(item_windows(t, window))]
            return record_batch(schema, pattern=[p for p, _ in found], item=[i for _, i in found])

        found = map_texts(items, {"item": F.col(f"`{id_col}`").cast("long"), "text": F.col(f"`{text_col}`")}, "pattern binary, item long", windows)
        self.table = cut(found.groupBy("pattern").agg(F.collect_set("item").alias("items")), "patterns")
        held = self.table.agg(F.sum(F.length("pattern") + 8 * F.size("items"))).first()[0] or 0
        self.n = max(1, -(-held // max_bytes))

    def __getitem__(self, k: int) -> dict[bytes, list[int]]:
        own = self.table.where(F.pmod(F.xxhash64("pattern"), F.lit(self.n)) == k)
        return {bytes(r["pattern"]): r["items"] for r in own.collect()}


def find(docs: DataFrame, items: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_pattern_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside any occurrence), items, spans (merged, in characters).

    The automaton is sent to the executors, so its patterns are bounded by max_pattern_bytes; a larger
    item set is scanned in blocks of that size, and the blocks' word ranges are united per document."""
    blocks = Blocks(items, item_id, item_text, window, max_pattern_bytes)
    if blocks.n == 1:
        return _scan_block(docs, blocks[0], doc_id, text)
    one = None
    texts = cut(docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row")), "decontaminate")
    for k in range(blocks.n):
        part = cut(_ranges_block(texts, blocks[k]), "decontaminate-block")
        one = part if one is None else one.unionByName(part)
    merged = one.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {k: [] for k in ARROW.names}
        for i, t, ranges, ids in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "ranges", "items")), strict=True):
            marked = utf8(t).translate(TO_WORDS)
            _put(out, i, t, marked, len(marked.split()), [(r["a"], r["b"]) for r in ranges or []], ids or [])
        return record_batch(ARROW, **out)

    joined = texts.join(merged, "row", "left")
    return map_texts(joined, {c: F.col(c) for c in ("id", "text", "ranges", "items")}, OUT, finish)


def _put(out: dict, i, text, marked: bytes, n: int, ranges, items) -> None:
    united = merge(ranges)
    out["id"].append(i)
    out["n_words"].append(n)
    out["n_hit"].append(sum(b - a for a, b in united))
    out["items"].append(sorted(items))
    out["spans"].append([{"start": a, "end": b} for a, b in char_spans(marked, text, united)] if united else [])


def _scan_block(docs: DataFrame, patterns: dict, doc_id: str, text: str) -> DataFrame:
    sent, key = docs.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, out = automaton(key, sent.value), {k: [] for k in ARROW.names}
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            n, ranges, items, marked = scan(t, found)
            _put(out, i, t, marked, n, ranges, items)
        return record_batch(ARROW, **out)

    return map_texts(docs, {"id": F.col(f"`{doc_id}`").cast("long"), "text": F.col(f"`{text}`")}, OUT, per_batch)


def _ranges_block(texts: DataFrame, patterns: dict) -> DataFrame:
    sent, key = texts.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex
    schema = pa.schema([("row", pa.int64()), ("ranges", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.int64()))])

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, out = automaton(key, sent.value), {"row": [], "ranges": [], "items": []}
        for r, t in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            _, ranges, items, _ = scan(t, found)
            if ranges:
                out["row"].append(r)
                out["ranges"].append([{"a": a, "b": b} for a, b in merge(ranges)])
                out["items"].append(sorted(items))
        return record_batch(schema, **out)

    return map_texts(texts, {"row": F.col("row"), "text": F.col("text")}, "row long, ranges array<struct<a:long,b:long>>, items array<long>", per_batch)


def without(docs: DataFrame, items: DataFrame, most_hit: float = 0.05, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, max_pattern_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows of which hit words make up most_hit of all words or more; columns as they are.

    Judged row by row, so null and repeated ids do no harm."""
    blocks = Blocks(items, item_id, item_text, window, max_pattern_bytes)
    if blocks.n > 1:
        row = fresh(docs, "row")
        rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
        judged = find(rows, items, window, row, text, item_id, item_text, max_pattern_bytes)
        hit = judged.where((F.col("n_hit") > 0) & (F.col("n_hit") >= most_hit * F.col("n_words"))).select(F.col("id").alias(row))
        return rows.join(hit, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    sent, key = docs.sparkSession.sparkContext.broadcast(blocks[0]), uuid.uuid4().hex
    plain, column = numbered(docs)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        automate, keep = automaton(key, sent.value), []
        for t in batch.column(column[text]).to_pylist():
            n, ranges, _, _ = scan(t, automate)
            n_hit = sum(b - a for a, b in merge(ranges))
            keep.append(not (n_hit and n_hit >= most_hit * n))
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_texts(plain, {c: F.col(c) for c in plain.columns}, plain.schema, clean).toDF(*docs.columns)
