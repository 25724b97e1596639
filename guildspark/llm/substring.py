"""Substring deduplication: Rabin-Karp hashes of every window of `size` words, counted in Spark.

Every window of every document is hashed and sent to the tile of its hash, which tells which hashes more
than one document may have. Only for those windows is a second hash taken (XXH3 over the window's bytes,
which shares nothing with the first), and both are sent with the smallest document id: windows are one
where both hashes agree, 56 bits, 64 bits and the tile number of a third. A document drops each word that
lies in a window which also starts in a document with a smaller id; windows overlap, so they merge into
maximal removal intervals. All windows are judged on the input.

Defined results: a null text has no words and stays null; texts under `size` words lose nothing;
repeats inside one document stay; rows with equal ids are one document; a null id counts as larger
than every id; an empty table gives no rows; other columns are carried along under their names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats as R
from .common import fresh, partitions


class _Words(dict):
    """Word -> 64-bit symbol; emptied when it gets large."""

    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_symbols = _Words()


class _Windows:
    """The windows of a batch: key, tile and document of each, and which windows lie in one document."""

    def __init__(self, sub: R.Sub, size: int, n_tiles: int, key_bytes: int):
        self.words = [t.split() for t in sub.texts]
        n = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(n)
        self.starts = self.ends - n
        total = int(n.sum())
        get = _symbols.__getitem__
        s = np.fromiter((get(w) for ws in self.words for w in ws), np.uint64, total)
        doc = np.repeat(np.arange(len(n)), n)
        keys = R.mix(R.window_hashes(s, size, R.BASE))
        whole = doc[: len(keys)] == doc[size - 1 : size - 1 + len(keys)]
        self.at = np.flatnonzero(whole)
        self.doc = doc[self.at]
        self.keys = keys[self.at] >> np.uint64(8 * (8 - key_bytes))
        self.tiles = R.tile_of(R.mix(R.window_hashes(s, size, R.BASE2))[self.at], n_tiles)


    def checks(self, pick: np.ndarray, size: int) -> np.ndarray:
        """XXH3 of the bytes of the picked windows, their words joined by one space."""
        out, h = np.empty(len(pick), np.uint64), xxhash.xxh3_64_intdigest
        docs, at = self.doc[pick], self.at[pick]
        cuts = R.runs(docs)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pick)], strict=False):
            words = self.words[docs[a]]
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            first = at[a:b] - self.starts[docs[a]]
            begin = np.where(first > 0, ends[first - 1], 0)
            out[a:b] = [h(line[x:y]) for x, y in zip(begin.tolist(), (ends[first + size - 1] - 1).tolist(), strict=True)]
        return out


def joined(keys: np.ndarray, tiles: np.ndarray, checks: np.ndarray) -> np.ndarray:
    return R.mix(R.joint(keys, tiles) ^ checks)


def _owners(sent: DataFrame, kind: int) -> DataFrame:
    """Per tile, to each slice: (key, check) with the smallest id of any document, where that matters to the slice."""

    def run(table: pa.Table) -> pa.Table:
        tile, where = table.column("tile")[0].as_py(), table.column("slice").to_numpy()
        parts = [R.decode(p.as_py(), np.uint64, np.int64, np.uint8) for p in table.column("payload")]
        keys, checks, ids, multi = (np.concatenate([p[i] for p in parts]) for i in range(4))
        source = np.repeat(where, [len(p[0]) for p in parts])
        order = np.lexsort((checks, keys))
        keys, checks, ids, multi, source = (x[order] for x in (keys, checks, ids, multi, source))
        at = R.runs(keys, checks)
        low = np.repeat(np.minimum.reduceat(ids, at), np.diff(np.append(at, len(keys))))
        told = (low < ids) | (multi != 0)
        return R.entry_table(R.by_slice(tile, kind, source[told], keys[told], checks[told], low[told]))

    return sent.groupBy("tile").applyInArrow(run, R.ENTRY)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 50, key_bytes: int = 7) -> tuple[DataFrame, dict[str, str]]:
    """docs with three more columns, and their names: n_words long, removed array<struct<start,end>>
    (maximal intervals, in words) and kept string (the words that stay, joined by one space)."""
    n_tiles = partitions(docs.sparkSession)
    names = {k: fresh(docs, k) for k in ("n_words", "removed", "kept")}
    carry = R.carried(docs, doc_id, text)
    packs = R.spread(docs, doc_id, text, {k: F.col(f"`{c}`") for k, c in carry.items()})

    def items(sub):
        w = _Windows(sub, size, n_tiles, key_bytes)
        return w.keys, w.tiles, sub.ids[w.doc]

    told = R.shared(R.entries(packs, items, n_tiles), kind=1)

    def candidates(sub: R.Sub, keys: np.ndarray) -> tuple[_Windows, np.ndarray, np.ndarray]:
        w = _Windows(sub, size, n_tiles, key_bytes)
        pick = np.flatnonzero(R.lookup(R.joint(w.keys, w.tiles), keys) >= 0)
        return w, pick, w.checks(pick, size)

    def send(own: pa.Table, got: pa.Table) -> pa.Table:
        (keys,), out = R.told(got, 1), []
        for batch in R.subs(R.unpack(own)) if own.num_rows and len(keys) else ():
            sub = R.Sub(batch)
            w, pick, check = candidates(sub, keys)
            if not len(pick):
                continue
            key, tile, who = w.keys[pick], w.tiles[pick], sub.ids[w.doc[pick]]
            order = np.lexsort((check, key, tile))
            key, tile, check, who = (x[order] for x in (key, tile, check, who))
            at = R.runs(tile, key, check)
            low, high = np.minimum.reduceat(who, at), np.maximum.reduceat(who, at)
            key, tile, check = key[at], tile[at], check[at]
            cuts = R.runs(tile)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(tile)], strict=True):
                out.append((own.column("slice")[0].as_py(), int(tile[a]), 0, R.encode(key[a:b], check[a:b], low[a:b], (low[a:b] != high[a:b]).astype(np.uint8))))
        return R.entry_table(out)

    owners = _owners(packs.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(send, R.ENTRY), kind=2)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(own: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        known = [(t, R.decode(p, np.uint64, np.int64)) for t, p in zip(*(got.column(c).to_pylist() for c in ("tile", "payload")), strict=True)]
        keys = np.unique(np.concatenate([R.joint(p[0], np.full(len(p[0]), t)) for t, p in known])) if known else np.zeros(0, np.uint64)
        both = np.concatenate([joined(p[0], np.full(len(p[0]), t), p[1]) for t, p in known]) if known else np.zeros(0, np.uint64)
        check_of, low = (np.concatenate([p[i] for _, p in known]) if known else np.zeros(0, d) for i, d in ((1, np.uint64), (2, np.int64)))
        order = np.argsort(both)
        both, check_of, low = both[order], check_of[order], low[order]
        for batch in R.subs(R.unpack(own)) if own.num_rows else ():
            sub = R.Sub(batch)
            w, pick, check = candidates(sub, keys)
            drop = np.zeros(int(w.ends[-1]), bool)
            if len(pick) and len(both):
                at = R.lookup(joined(w.keys[pick], w.tiles[pick], check), both)
                drop[w.at[pick]] = (at >= 0) & (check_of[at] == check) & (low[at] < sub.ids[w.doc[pick]])
            n_words, removed, kept = [], [], []
            for t, words, a, b in zip(sub.texts, w.words, w.starts.tolist(), w.ends.tolist(), strict=True):
                mask = R.covered(drop[a:b], size, b - a)
                n_words.append(b - a)
                removed.append([{"start": x, "end": y} for x, y in R.spans(mask)])
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~mask).tolist()] if mask.any() else words).decode("utf-8", "surrogatepass"))
            valid = batch.column("text").is_valid()
            done = pa.array(kept, pa.string())
            out.append(pa.Table.from_batches([batch]).append_column("n_words", pa.array(n_words, pa.int64())).append_column("removed", pa.array(removed, span)).append_column("kept", pc.if_else(valid, done, pa.scalar(None, pa.string()))))
        order = ["id", "text", *carry, "n_words", "removed", "kept"]
        return pa.concat_tables(out).select(order) if out else own.slice(0, 0)

    inner = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(k, R.type_of(docs, c)) for k, c in carry.items()], T.StructField("n_words", T.LongType()), T.StructField("removed", T.ArrayType(inner)), T.StructField("kept", T.StringType())])
    found = packs.groupBy("slice").cogroup(owners.groupBy("slice")).applyInArrow(finish, schema)
    back = {doc_id: "id", text: "text", **{c: k for k, c in carry.items()}}
    return found.select(*[F.col(back[c]).alias(c) for c in docs.columns], *[F.col(k).alias(v) for k, v in names.items()]), names
