"""Token ids in a binary format: concatenated ids with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by id, encoded with a byte-level BPE of the tokenizers
library, and written as shards: one Parquet row holds the concatenated ids of a run of documents
(2 or 4 bytes each), and the boundaries and document ids as Elias-Fano sequences with select samples. A
shard's first offset is the sum of the ids in the shards before it, taken from the shard counts; a
reader gets a document's place by select.

A byte-level BPE never merges across the pre-tokenizer's borders. A single space between two
characters that aren't white space is such a border, so text is cut there and every distinct piece
goes through the library once per worker. Texts that hold the string of a special token go through the
library whole, as it turns the string into that token.

Defined results: a null or empty text has the end id only; rows with equal ids follow each other in
the order of their texts; null ids come first; an empty table gives no shards and no rows."""

from __future__ import annotations

import itertools
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memory, any_in, gather, no_gc, partitions, record_batch, slices, split_on_spaces, used

#: Single spaces between two characters that are no white space.
BORDER = re.compile(r"(?<=\S) (?=\S)")
SHARD = "part int, seq int, n_docs long, n_tokens long, width int, ids binary, bounds binary, n_null long, first_id long, coded boolean, doc_ids binary"
SHARD_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("bounds", pa.binary()), ("n_null", pa.int64()), ("first_id", pa.int64()), ("coded", pa.bool_()), ("doc_ids", pa.binary())])
SAMPLE = 256

_encoders: dict = {}


class EliasFano:
    """A non-decreasing sequence below a bound in about 2 + log2(bound / n) bits a value.

    low: the lower `bits` bits of the values; high: the upper parts in unary, a one for each value;
    samples: the place of every SAMPLE-th one, from where select() counts on."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, bound: int) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        bits = max(0, int(np.floor(np.log2(max(1, bound) / n)))) if n and bound > n else 0
        low = (values[:, None] >> np.arange(bits)) & 1
        ones = (values >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        a = i * self.bits
        word = int.from_bytes(self.low[a // 8 : (a + self.bits + 7) // 8].tobytes(), "little")
        return word >> a % 8 & (1 << self.bits) - 1

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        bits = int(self.high[byte]) >> at % 8 << at % 8
        while left >= bits.bit_count():
            left -= bits.bit_count()
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        return (byte * 8 + (bits & -bits).bit_length() - 1 - i << self.bits) + self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits).astype(np.int64)
        return ((ones - np.arange(self.n)) << self.bits) + (low << np.arange(self.bits)).sum(axis=1, dtype=np.int64)

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.bits, len(self.low), len(self.high)], "<i8").tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, bits, low, high = np.frombuffer(raw, "<i8", 4).tolist()
        data = np.frombuffer(raw, np.uint8, offset=32)
        return cls(n, bits, data[:low], data[low : low + high], np.frombuffer(data[low + high :].tobytes(), "<u4"))


class Encoder:
    """Byte-level BPE with a bounded memory of words; a value is the ids' bytes.

    special_as_text: strings of special tokens inside a text are ordinary text, as the vocabulary's notes
    have it; else they become their token, as the library does as it is loaded."""

    def __init__(self, path: str, limit: int = 400_000, special_as_text: bool = True):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.specials = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.known = Memory(limit)
        self.find = regex.compile(public_tokenizers.PATTERN).findall

    def _ids(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces are cut by the pre-tokenizer's pattern; distinct parts are encoded once, and remembered like pieces."""
        cut = {p: self.find(p) for p in pieces if not (p[:1] == " " and p[1:].isalpha())}
        whole = [p for p in pieces if p not in cut]
        parts = set(itertools.chain.from_iterable(cut.values()))
        young, old = self.known.young, self.known.old
        ids = {t: v for t in parts if (v := young.get(t) or old.get(t)) is not None}
        new = list(parts.union(whole).difference(ids))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for t, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                ids[t] = array(self.kind, e.ids).tobytes()
        young.update((t, ids[t]) for t in parts)
        get = ids.__getitem__
        return [get(p) if (c := cut.get(p)) is None else b"".join(map(get, c)) for p in pieces]

    def _joined(self, words: list[str], codes: np.ndarray, starts: np.ndarray, end: bytes) -> tuple[bytes, np.ndarray]:
        """The bytes of all texts, each with `end` after it, and where each ends. A text is a run of pieces: the
        first stands as it is, the others have the space before them that they were cut at."""
        inner = np.ones(len(codes), bool)
        inner[starts[:-1]] = False
        first, place = used(codes[~inner], len(words))
        later, where = used(codes[inner], len(words))
        keys = [words[c] for c in first.tolist()] + [" " + words[c] for c in later.tolist()]
        at = np.empty(len(codes), np.int64)
        at[~inner], at[inner] = place, where + len(first)
        at = np.insert(at, starts[1:], len(keys))
        data, ends = gather([*self.known.values(keys, self._of_pieces), end], at)
        return data, ends[starts[1:] + np.arange(len(starts) - 1)]

    def encode_joined(self, texts: pa.Array, end: bytes = b"") -> tuple[bytes, np.ndarray]:
        """The bytes of all texts, each with `end` after it, and where each ends."""
        flat, starts = split_on_spaces(texts)
        words = flat.dictionary.to_pylist()
        codes = flat.indices.to_numpy()
        odd = [i for i, w in enumerate(words) if not w or w.strip() != w]
        borderless = any_in(np.isin(codes, odd), starts) if odd else np.zeros(len(texts), bool)
        borderless &= pc.greater(pc.binary_length(texts.fill_null("")), 0).to_numpy(zero_copy_only=False)
        special = np.zeros(len(texts), bool)
        for s in self.specials:
            special |= pc.match_substring(texts.fill_null(""), s).to_numpy(zero_copy_only=False)
        if not (borderless.any() or special.any()):
            return self._joined(words, codes, starts, end)
        out: list[bytes | None] = [None] * len(texts)
        for i in np.flatnonzero(special).tolist():  # the library cuts these at the special strings itself
            out[i] = self._ids(texts[i].as_py()) + end
        for rows, cut in ((np.flatnonzero(~special & ~borderless), None), (np.flatnonzero(~special & borderless), BORDER.split)):
            if not len(rows):
                continue
            some = texts.take(pa.array(rows))
            if cut is None:
                flat, at = split_on_spaces(some)
                data, ends = self._joined(flat.dictionary.to_pylist(), flat.indices.to_numpy(), at, end)
            else:
                parts = [cut(t) for t in some.to_pylist()]
                flat = pa.array(list(itertools.chain.from_iterable(parts)), pa.string()).dictionary_encode()
                data, ends = self._joined(flat.dictionary.to_pylist(), flat.indices.to_numpy(), np.cumsum([0, *map(len, parts)]), end)
            for i, a, b in zip(rows.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[i] = data[a:b]
        return b"".join(out), np.cumsum(np.fromiter(map(len, out), np.int64, len(out)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        data, ends = self.encode_joined(pa.array(texts, pa.string()))
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def encoder(path: str, special_as_text: bool) -> Encoder:
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, special_as_text=special_as_text)
    return _encoders[key]


def shards(docs: DataFrame, vocabulary: str, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 8 << 20, special_as_text: bool = True) -> DataFrame:
    """Rows of the format, one for each run of documents of about shard_bytes of text, ordered by (part, seq)."""
    n = partitions(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    ordered = own.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text").select(F.spark_partition_id().alias("part"), "id", "text")

    def run(batches):
        seq = 0
        for whole in batches:
            for batch in slices(whole, shard_bytes):
                e = encoder(vocabulary, special_as_text)
                end = b"" if end_id is None else np.array([end_id], e.dtype).tobytes()
                with no_gc():
                    coded, ends = e.encode_joined(batch.column("text"), end)
                ends = ends // e.dtype.itemsize
                who = batch.column("id")
                own = who.drop_null().to_numpy()
                least = int(own[0]) if len(own) else 0
                spread = (own.astype(np.uint64) - np.uint64(least & (1 << 64) - 1)).astype(np.int64)
                coded_ids = len(own) > 0 and bool(spread[-1] >= 0)
                names = EliasFano.of(spread, int(spread[-1]) + 1).to_bytes() if coded_ids else own.astype("<i8").tobytes()
                yield record_batch(SHARD_ARROW, part=[batch.column("part")[0].as_py()], seq=[seq], n_docs=[len(ends)], n_tokens=[int(ends[-1])], width=[e.dtype.itemsize], ids=[coded], bounds=[EliasFano.of(ends, int(ends[-1]) + 1).to_bytes()], n_null=[who.null_count], first_id=[least], coded=[coded_ids], doc_ids=[names])
                seq += 1

    return ordered.mapInArrow(run, SHARD)


def write(docs: DataFrame, path: str, vocabulary: str, **options) -> None:
    """Writes the shards with Spark's writer, so only whole tasks' files appear; an existing path is an error."""
    shards(docs, vocabulary, **options).write.option("compression", "zstd").parquet(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Read back, one row per document: id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only the shards' counts are gathered for the offsets; ids stay where they are read."""
    stored = spark.read.parquet(path)
    out = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bounds = EliasFano.from_bytes(row["bounds"])
                ends = np.fromiter(map(bounds.select, range(bounds.n)), np.int64, bounds.n)
                starts = np.concatenate(([0], ends[:-1]))
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield record_batch(out, part=[row["part"]] * n, seq=[row["seq"]] * n, id=pa.array(names_of(row)), at=starts, n_tokens=ends - starts, ids_crc32=crc)

    rows = stored.select("part", "seq", "width", "ids", "bounds", "n_null", "first_id", "coded", "doc_ids").mapInArrow(run, "part int, seq int, id long, at long, n_tokens long, ids_crc32 long")
    sizes = stored.select("part", "seq", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a task's shards in their order, and the tasks' totals: as many rows as the writing job had tasks
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("base"))
    bases = sizes.withColumn("inner", before(Window.partitionBy("part").orderBy("seq"))).join(parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))
    return rows.join(bases, ["part", "seq"]).select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def names_of(row) -> list[int | None]:
    """The document ids of a shard, nulls first: the others ascend from first_id and are Elias-Fano coded,
    or 64 bits each where they span over half of all numbers."""
    raw = row["doc_ids"]
    known = (EliasFano.from_bytes(raw).all() + row["first_id"]) if row["coded"] else np.frombuffer(raw, "<i8")
    return [None] * row["n_null"] + known.tolist()


def document(row, i: int) -> np.ndarray:
    """The ids of the i-th document of a shard, by two selects."""
    ef = EliasFano.from_bytes(row["bounds"])
    a = ef.select(i - 1) if i else 0
    return np.frombuffer(row["ids"], f"<u{row['width']}")[a : ef.select(i)]
