"""Shared exchange for operators that look for content repeated across documents.

Documents are dealt by a hash of their row into slices. A slice sends, for every tile (a hash range of
keys), its distinct keys in packed sorted arrays; a tile finds the keys that are shared and answers every
slice that sent them. A key thus costs one entry per slice, however many documents hold it, and a few
large rows cross the shuffle instead of one per window. Only what shares a key is then looked at closer.
Text crosses it once: all steps of a plan read the same exchange of packs.

A null id counts as larger than every id, so such a document never takes anything from others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, slices, utf8

NO_ID = np.iinfo(np.int64).max
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
ENTRY = "slice int, tile int, kind int, payload binary"
ENTRY_ARROW = pa.schema([("slice", pa.int32()), ("tile", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def spread(docs: DataFrame, doc_id: str, text: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """Rows (slice, pack): Arrow-encoded runs of documents with columns id, text and the carried ones."""
    n = 2 * partitions(docs.sparkSession)
    own = {"id": F.col(f"`{doc_id}`").cast("long"), "text": F.col(f"`{text}`"), **(carry or {})}
    picked = docs.select(F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(n)).cast("int").alias("slice"), *[c.alias(k) for k, c in own.items()])
    out = pa.schema([("slice", pa.int32()), ("pack", pa.binary())])

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for whole in batches:
            for batch in slices(whole, 16 << 20):
                to = batch.column("slice").to_numpy()
                order = np.argsort(to, kind="stable")
                data = batch.select([c for c in batch.schema.names if c != "slice"]).take(pa.array(order))
                starts = np.flatnonzero(np.concatenate(([True], np.diff(to[order]) != 0)))
                packs = []
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(to)], strict=True):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, data.schema, options=options) as w:
                        w.write_batch(data.slice(a, b - a))
                    packs.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(to[order][starts], pa.int32()), pa.array(packs, pa.binary())], schema=out)

    return picked.mapInArrow(run, "slice int, pack binary")


def unpack(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for p in table.column("pack")])


def subs(table: pa.Table, per_bytes: int = 3 << 20):
    """Record batches of about per_bytes."""
    for batch in table.combine_chunks().to_batches():
        yield from slices(batch, per_bytes)


def ids_of(batch) -> np.ndarray:
    return batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)


class Sub:
    """Texts of a batch as one byte array, with their borders."""

    def __init__(self, batch):
        self.ids = ids_of(batch)
        self.texts = [utf8(t) for t in batch.column("text").to_pylist()]
        self.ends = np.cumsum(np.fromiter(map(len, self.texts), np.int64, len(self.texts)))
        self.starts = np.concatenate(([0], self.ends[:-1]))


def planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()


def unplanes(raw: bytes, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * n).reshape(size, n).T).view(dtype).ravel()


def encode(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted keys as differences and further arrays, byte plane by byte plane, compressed."""
    first = np.diff(keys, prepend=np.uint64(0))
    raw = np.uint32(len(keys)).tobytes() + b"".join(planes(a) for a in (first, *more))
    return zstandard.compress(raw, 1)


def decode(payload: bytes, *dtypes) -> list[np.ndarray]:
    raw = zstandard.decompress(payload)
    n, at, out = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
    for d in (np.uint64, *dtypes):
        out.append(unplanes(raw[at : at + np.dtype(d).itemsize * n], d, n))
        at += np.dtype(d).itemsize * n
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(symbols: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp: the polynomial hash, modulo 2^64, of every `size` consecutive symbols, by doubling."""
    if len(symbols) < size:
        return np.zeros(0, np.uint64)
    out, length = symbols, 1
    for bit in bin(size)[3:]:
        m = len(out) - length
        out = out[:m] * np.uint64(pow(base, length, 1 << 64)) + out[length : length + m]
        length *= 2
        if bit == "1":
            m = len(out) - 1
            out = out[:m] * np.uint64(base) + symbols[length : length + m]
            length += 1
    return out


def tile_of(h: np.ndarray, tiles: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(tiles)).astype(np.uint32)


def runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def send(keys: np.ndarray, tiles: np.ndarray, ids: np.ndarray, n_tiles: int) -> list[tuple[int, bytes]]:
    """(tile, payload) for the distinct keys and whether a second id has them."""
    order = np.argsort(keys)
    order = order[np.argsort(tiles[order].astype(np.uint16) if n_tiles < 1 << 16 else tiles[order], kind="stable")]
    keys, tiles, ids = keys[order], tiles[order], ids[order]
    if not len(keys):
        return []
    at = runs(tiles, keys)
    low, high = np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)
    keys, tiles = keys[at], tiles[at]
    cuts = runs(tiles)
    return [(int(tiles[a]), encode(keys[a:b], (low[a:b] != high[a:b]).astype(np.uint8))) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True)]


def entries(packs: DataFrame, items, n_tiles: int) -> DataFrame:
    """items(Sub) -> (keys, tiles, ids): what each slice sends."""

    def run(table: pa.Table) -> pa.Table:
        where, out = table.column("slice")[0].as_py(), []
        for batch in subs(unpack(table)):
            out += send(*items(Sub(batch)), n_tiles)
        return entry_table([(where, t, 0, p) for t, p in out])

    return packs.groupBy("slice").applyInArrow(run, ENTRY)


def entry_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ENTRY_ARROW)], schema=ENTRY_ARROW)


def by_slice(tile: int, kind: int, source: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Entries of a tile to each slice: the columns (keys first, sorted) of its rows, one row of each key and further column."""
    by = np.argsort(source, kind="stable")
    source, columns = source[by], [c[by] for c in columns]
    cuts, out = runs(source), []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(source)], strict=False):
        first = runs(*(c[a:b] for c in columns))  # a slice may have sent a key in several batches
        out.append((int(source[a]), tile, kind, encode(*(c[a:b][first] for c in columns))))
    return out


def shared(sent: DataFrame, kind: int) -> DataFrame:
    """Per tile, to each slice: its keys that two documents or more may have (two rows do, or two ids)."""

    def run(table: pa.Table) -> pa.Table:
        tile, where = table.column("tile")[0].as_py(), table.column("slice").to_numpy()
        parts = [decode(p.as_py(), np.uint8) for p in table.column("payload")]
        keys, multi = (np.concatenate([p[i] for p in parts]) for i in range(2))
        source = np.repeat(where, [len(p[0]) for p in parts])
        del parts
        order = np.argsort(keys)
        keys, multi, source = keys[order], multi[order], source[order]
        at = runs(keys)
        length = np.diff(np.append(at, len(keys)))
        many = (length > 1) | np.maximum.reduceat(multi, at).astype(bool)
        told = np.repeat(many, length)
        return entry_table(by_slice(tile, kind, source[told], keys[told]))

    return sent.groupBy("tile").applyInArrow(run, ENTRY)


def joint(keys: np.ndarray, tiles) -> np.ndarray:
    """One number for key and tile."""
    return mix(keys + np.uint64(BASE2) * np.asarray(tiles, np.uint64))


def told(table: pa.Table, kind: int, *dtypes) -> list[np.ndarray]:
    """The answers of one kind that a slice got: joint keys, sorted, and the arrays that go with them."""
    rows = [(t, decode(p, *dtypes)) for t, k, p in zip(*(table.column(c).to_pylist() for c in ("tile", "kind", "payload")), strict=True) if k == kind]
    if not rows:
        return [np.zeros(0, d) for d in (np.uint64, *dtypes)]
    keys = np.concatenate([joint(p[0], np.full(len(p[0]), t)) for t, p in rows])
    order = np.argsort(keys)
    return [keys[order], *(np.concatenate([p[i + 1] for _, p in rows])[order] for i in range(len(dtypes)))]


def lookup(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted table, -1 if it isn't there."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def covered(flags: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n units lie in a window of `size` units that starts at a flag."""
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(flags)
    step[at] += 1
    np.subtract.at(step, np.minimum(at + size, n), 1)
    return np.cumsum(step[:n]) > 0


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def carried(docs: DataFrame, doc_id: str, text: str) -> dict[str, str]:
    """Names, inside the packs, of the other columns of docs."""
    return {f"c{i}": c for i, c in enumerate(docs.columns) if c not in (doc_id, text)}


def type_of(docs: DataFrame, name: str) -> T.DataType:
    return docs.schema[name].dataType
