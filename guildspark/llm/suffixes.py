"""Repeated byte strings by a difference-cover suffix sort, distributed over Spark.

Only prefixes of `size` bytes matter, so the sort is bounded to that depth. The difference cover is
content-defined: in every run of size-GRAM+1 starting points the one whose GRAM bytes hash lowest is
sampled. Equal strings therefore hold a sampled position at an equal shift, the property a difference
cover gives, at one position in sixteen instead of two in three.

1. Slices of documents send the hashes of their sampled grams; a gram that one document has alone
   cannot lie in a repeated string, so its suffixes need no sorting.
2. For each other sampled position a slice sends the bytes a string around it can hold, equal ones once,
   with the smallest document id, to the tile of the gram.
3. A tile sorts triples of bytes, names them, and recurses on triples of names until a name covers the
   depth: this orders the sampled suffixes, and the common prefixes of neighbours are compared.
4. The remaining suffixes are merged by (name of the bytes before the sample, rank of the sampled
   suffix): for each shift, equal pairs are equal strings, and their smallest id is found.
5. The answers, a bit per shift, return to the slices, which remove the covered bytes.

Everything compared is bytes, so no hash decides a removal (a collision of gram hashes only sends
more). A gram's suffixes meet in one tile; equal surroundings are sent once per slice.

Defined results: a null text has no bytes and stays null; texts under `size` bytes lose nothing;
matches never cross documents; repeats inside one document stay; rows with equal ids are one document;
a null id counts as larger than every id; an empty table gives no rows; other columns are carried."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats as R
from .common import fresh, partitions

GRAM = 20
SCREEN_BYTES = 6
#: Samples whose surroundings are laid out at a time, before equal ones are united.
PIECE = 1 << 14


def sliding(a: np.ndarray, size: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over every `size` consecutive values."""
    out, span = a, 1
    while span < size:
        step = min(span, size - span)
        out = best(out[: len(out) - step], out[step:])
        span += step
    return out


class _Samples:
    """Sampled positions of a batch: place in the joined bytes, document, and hash of the gram."""

    def __init__(self, sub: R.Sub, size: int):
        self.data = np.frombuffer(b"".join(sub.texts), np.uint8)
        n, width = len(self.data), size - GRAM + 1
        self.at = np.zeros(0, np.int64)
        if n >= size:
            grams = R.mix(R.window_hashes(self.data.astype(np.uint64) + np.uint64(1), GRAM, R.BASE))
            low = sliding(grams, width, np.minimum)
            for end in sub.ends[:-1].tolist():  # windows over a border do not count
                low[max(0, end - size + 1) : end] = 0
            padded = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
            self.at = np.flatnonzero(sliding(padded, width, np.maximum) == grams)
            self.grams = grams[self.at]
        else:
            self.grams = np.zeros(0, np.uint64)
        self.doc = np.searchsorted(sub.ends, self.at, side="right")

    def screen(self, n_tiles: int):
        tiles = R.tile_of(self.grams * np.uint64(R.BASE2), n_tiles)
        return self.grams >> np.uint64(8 * (8 - SCREEN_BYTES)), tiles


def surroundings(s: _Samples, sub: R.Sub, pick: np.ndarray, size: int) -> np.ndarray:
    """Per picked sample: bytes available before it and from it on, then those bytes, zero where there are none."""
    before = size - GRAM
    at, doc = s.at[pick], s.doc[pick]
    left = np.minimum(before, at - sub.starts[doc])
    right = np.minimum(size, sub.ends[doc] - at)
    out = np.zeros((len(at), 2 + before + size), np.uint8)
    out[:, 0], out[:, 1] = left, right
    column = np.arange(-before, size)
    place = at[:, None] + column
    real = (column >= -left[:, None]) & (column < right[:, None])
    out[:, 2:] = np.where(real, s.data[np.clip(place, 0, max(0, len(s.data) - 1))], 0)
    return out


def as_strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct row, and every row's place among them, in an order that the rows alone decide."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for column in wide.view(np.uint64).T:
        h = R.mix(h * np.uint64(R.BASE) + column)
    order = np.argsort(h)
    new = np.concatenate(([True], h[order[1:]] != h[order[:-1]]))
    same = np.flatnonzero(~new)
    if len(same) and (rows[order[same]] != rows[order[same - 1]]).any():  # two rows with one hash
        _, first, place = np.unique(as_strings(rows), return_index=True, return_inverse=True)
        return first, place
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


class _Slice:
    """What a slice knows of its samples with shared grams: distinct surroundings, and each sample's place in them."""

    def __init__(self, own: pa.Table, got: pa.Table, size: int, n_tiles: int):
        (shared,) = R.told(got, 1)
        self.batches, found, ids, tiles, places, n = [], [], [], [], [], 0
        for batch in R.subs(R.unpack(own)) if own.num_rows else ():
            sub = R.Sub(batch)
            s = _Samples(sub, size)
            keys, to = s.screen(n_tiles)
            pick = np.flatnonzero(R.lookup(R.joint(keys, to), shared) >= 0)
            ids.append(sub.ids[s.doc[pick]])
            for at in range(0, len(pick), PIECE):  # a long text has many samples, and often few different ones
                piece = pick[at : at + PIECE]
                rows = surroundings(s, sub, piece, size)
                first, place = distinct_rows(rows)
                found.append(rows[first])
                tiles.append(to[piece][first])
                places.append(place + n)
                n += len(first)
            self.batches.append((batch, s.at[pick], len(pick)))
            del s, sub
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.rows, first, self.place = np.zeros((0, 2), np.uint8), None, np.zeros(0, np.int64)
        if len(self.ids):
            rows = np.concatenate(found)
            first, place = distinct_rows(rows)
            self.place = place[np.concatenate(places)]
            self.rows, self.tiles = rows[first], np.concatenate(tiles)[first]
            self.low = np.full(len(first), R.NO_ID)
            np.minimum.at(self.low, self.place, self.ids)


def dense_ranks(keys: np.ndarray, bound: int) -> np.ndarray:
    """Each key's rank among the distinct keys; by a table where keys are small, else by sorting."""
    if bound <= 1 << 24:
        seen = np.zeros(bound, bool)
        seen[keys] = True
        return (np.cumsum(seen, dtype=np.int32) - 1)[keys].astype(np.int64)
    order = np.argsort(keys)
    inner = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate(([False], inner[1:] != inner[:-1])))
    return rank


def triple_names(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sorts the triples of three consecutive names and gives each its rank: one step of the recursion.

    columns[k] holds the k-th name of every suffix; missing names count as 0. Ranks order as the triples do."""
    n, zero = len(columns[0]), np.zeros(len(columns[0]), np.int64)
    columns = columns + [zero] * (-len(columns) % 3)
    a, b, c = (np.concatenate(columns[k::3]) for k in range(3))
    names = int(max(x.max(initial=0) for x in (a, b, c))) + 1
    if names**3 < 1 << 62:
        rank = dense_ranks((a * names + b) * names + c, names**3)
    else:
        pair = dense_ranks(a * names + b, names**2)
        rank = dense_ranks(pair * names + c, (len(pair) + 1) * names)
    return [rank[k : k + n] for k in range(0, len(rank), n)]


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows of bytes, and each row's common prefix with the row before it in that order."""
    names = [text[:, k].astype(np.int64) for k in range(text.shape[1])]
    while len(names) > 1:
        names = triple_names(names)
    order = np.argsort(names[0])
    same = text[order[1:]] == text[order[:-1]]
    common = np.where(same.all(axis=1), text.shape[1], same.argmin(axis=1))
    return order, np.concatenate(([0], common))


def longest_common(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Each suffix's longest common prefix with any other, which is with one of its neighbours."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(common, np.append(common[1:], 0))
    return out


def shift_bits(rows: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """Bit o of a row: the string that starts o bytes before its sample also starts in a document with a smaller id."""
    n, before = len(rows), size - GRAM
    left, right, text = rows[:, 0], rows[:, 1], rows[:, 2:]
    order, common = suffix_order(text[:, before:])
    back, back_common = suffix_order(text[:, before - 1 :: -1] if before > 0 else text[:, :0])
    bits = np.zeros(n, np.uint32)
    longest, back_longest = longest_common(order, common), longest_common(back, back_common)
    name, back_name = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(before + 1):  # only suffixes that agree with a neighbour that far, on either side
        some = np.flatnonzero((longest >= size - o) & (back_longest >= o) & (left >= o) & (right >= size - o))
        if len(some) < 2:
            continue
        name[order] = np.cumsum(common < size - o)
        back_name[back] = np.cumsum(back_common < o)
        pair = back_name[some] * (n + 1) + name[some]
        by = np.argsort(pair)
        at = R.runs(pair[by])
        who = ids[some[by]]
        low = np.repeat(np.minimum.reduceat(who, at), np.diff(np.append(at, len(by))))
        bits[some[by][low < who]] |= np.uint32(1 << o)
    return bits


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 50, as_text: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """docs with three more columns, and their names: n_bytes long, removed array<struct<start,end>>
    (maximal runs, in bytes) and kept binary (the bytes that stay). size is between 21 and 51.

    as_text: kept is a string instead, null for a null text; bytes that a removal has left of a character
    go with it."""
    if not GRAM < size <= GRAM + 31:
        raise ValueError(f"size must be between {GRAM + 1} and {GRAM + 31}")
    n_tiles = partitions(docs.sparkSession)
    names = {k: fresh(docs, k) for k in ("n_bytes", "removed", "kept")}
    carry = R.carried(docs, doc_id, text)
    packs = R.spread(docs, doc_id, text, {k: F.col(f"`{c}`") for k, c in carry.items()})
    width = 2 + size - GRAM + size

    def items(sub):
        s = _Samples(sub, size)
        return (*s.screen(n_tiles), sub.ids[s.doc])

    def send(own: pa.Table, got: pa.Table) -> pa.Table:
        s, out = _Slice(own, got, size, n_tiles), []
        if len(s.rows):
            where = own.column("slice")[0].as_py()
            by = np.argsort(s.tiles, kind="stable")
            cuts = R.runs(s.tiles[by])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=True):
                pick = by[a:b]
                rows = np.frombuffer(s.rows[pick].tobytes(), np.uint8).reshape(len(pick), width)
                out.append((where, int(s.tiles[pick[0]]), 2, R.encode(pick.astype(np.uint64), s.low[pick], *(rows[:, k].copy() for k in range(2)), as_strings(rows[:, 2:]).view(f"V{width - 2}"))))
        return R.entry_table(out)

    def decide(table: pa.Table) -> pa.Table:
        tile, where = table.column("tile")[0].as_py(), table.column("slice").to_pylist()
        parts = [R.decode(p.as_py(), np.int64, np.uint8, np.uint8, f"V{width - 2}") for p in table.column("payload")]
        rows = np.concatenate([np.column_stack((p[2], p[3], p[4].view(np.uint8).reshape(-1, width - 2))) for p in parts])
        bits = shift_bits(rows, np.concatenate([p[1] for p in parts]), size)
        out, at = [], 0
        for w, p in zip(where, parts, strict=True):
            own = bits[at : at + len(p[0])]
            at += len(p[0])
            some = np.flatnonzero(own)
            if len(some):
                out.append((w, tile, 3, R.encode(p[0][some], own[some])))
        return R.entry_table(out)

    told = R.shared(R.entries(packs, items, n_tiles), kind=1)
    sent = packs.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(send, R.ENTRY)
    decided = sent.groupBy("tile").applyInArrow(decide, R.ENTRY)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def done(kept: list[bytes], batch) -> pa.Array:
        if not as_text:
            return pa.array(kept, pa.binary())
        return pa.array([k.decode("utf-8", "ignore") if v else None for k, v in zip(kept, batch.column("text").is_valid().to_pylist(), strict=True)], pa.string())

    def finish(own: pa.Table, got: pa.Table) -> pa.Table:
        s, out, first = _Slice(own, got, size, n_tiles), [], 0
        bits = np.zeros(len(s.rows), np.uint32)
        for k, p in zip(got.column("kind").to_pylist(), got.column("payload").to_pylist(), strict=True):
            if k == 3:
                where, some = R.decode(p, np.uint32)
                bits[where.astype(np.int64)] = some
        for batch, at, n in s.batches:
            sub = R.Sub(batch)
            place, ids = s.place[first : first + n], s.ids[first : first + n]
            first += n
            drop = np.zeros(int(sub.ends[-1]) if len(sub.ends) else 0, bool)
            if n:
                rows = s.rows[place]
                own_bits, later = bits[place], ids > s.low[place]
                for o in range(size - GRAM + 1):
                    fits = (rows[:, 0] >= o) & (rows[:, 1] >= size - o)
                    drop[at[fits & (later | (own_bits >> np.uint32(o) & np.uint32(1)).astype(bool))] - o] = True
            n_bytes, removed, kept = [], [], []
            for t, a, b in zip(sub.texts, sub.starts.tolist(), sub.ends.tolist(), strict=True):
                n_bytes.append(b - a)
                flags = drop[a:b]
                if not flags.any():
                    removed.append([])
                    kept.append(t)
                    continue
                mask = R.covered(flags, size, b - a)
                removed.append([{"start": x, "end": y} for x, y in R.spans(mask)])
                kept.append(np.frombuffer(t, np.uint8)[~mask].tobytes())
            out.append(pa.Table.from_batches([batch]).append_column("n_bytes", pa.array(n_bytes, pa.int64())).append_column("removed", pa.array(removed, span)).append_column("kept", done(kept, batch)))
        order = ["id", "text", *carry, "n_bytes", "removed", "kept"]
        return pa.concat_tables(out).select(order) if out else own.slice(0, 0)

    inner = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(k, R.type_of(docs, c)) for k, c in carry.items()], T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(inner)), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    found = packs.groupBy("slice").cogroup(told.unionByName(decided).groupBy("slice")).applyInArrow(finish, schema)
    back = {doc_id: "id", text: "text", **{c: k for k, c in carry.items()}}
    return found.select(*[F.col(back[c]).alias(c) for c in docs.columns], *[F.col(k).alias(v) for k, v in names.items()]), names
