"""Collocations by best-first branch and bound over phrase prefixes.

A phrase q of frequency a that begins with the words p scores at most 1000 n / f(p), whatever follows: cut after p,
its score is 1000 a n / (f(p) f(rest)), and the rest occurs as often as q at least. So a prefix's count bounds all that grows
from it, best by its first word. Per language, prefixes are grown in the order of that bound, a step of the frontier
at a time: a step holds the first words down to a bound, and grows them to two, three, ... words, each level
counting only phrases whose beginning is frequent. Then the counts of the rests and of phrases with one more word in
front are fetched, candidates get their exact scores, and those that a longer phrase of equal frequency covers
go. A language is settled once no first word is left whose bound reaches its wanted-th best surviving score; ties with that
score are found, as the bound may equal it.

Texts are read twice: to count words, and to write runs of frequent words as 64-bit numbers of word and language,
which all levels read. A run breaks where a piece ends or a word is rare, as no frequent phrase has a rare word. Tasks know
phrases by a bit filter of fixed size; a phrase that passes by chance is counted and then fails the least count.
Two words with one number are told from the word counts of the whole table, and raise.

Defined results: a null or empty text has no words; a null language is `und`; repeated rows all count; an empty table gives
no rows; columns other than the two named ones are not read; words of any length are whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, map_texts, no_gc, record_batch, utf8

BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case; what ends a piece becomes a byte that UTF-8 does not have, a tab becomes a space.
TO_PIECES = bytes(0xFF if b in BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
LONGEST = 5
#: Bits of a filter, a power of two, and the bits of one stored row of it.
FILTER_BITS, ROW_BITS = 1 << 25, 1 << 15
ROW_TOKENS = 1024
WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("key", pa.binary()), ("n", pa.int64())])
RUNS = pa.schema([("run", pa.list_(pa.int64()))])
COUNTS = pa.schema([("key", pa.binary()), ("f", pa.int64())])


def _tokens(langs: list, texts: list):
    """Per language of the rows: its distinct words, the word number at every place (-1: a piece ends), and the numbers of word and language."""
    by: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, texts, strict=True):
        by.setdefault("und" if lang is None else lang, []).append(utf8(text).translate(TO_PIECES))
    for lang, parts in by.items():
        coded = pa.array(b"\xff".join([*parts, b""]).replace(b"\xff", b" \xff ").split(), pa.large_binary()).dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        ids = np.fromiter((xxhash.xxh64_intdigest(w, seed) | 1 for w in words), np.uint64, len(words)).view(np.int64)
        codes = np.where(np.fromiter((w == b"\xff" for w in words), bool, len(words))[codes], -1, codes) if words else codes
        yield lang, words, codes, ids


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (lang, word, key, n) of all words; key: the eight bytes of the number of word and language."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for lang, words, codes, ids in _tokens(*(c.to_pylist() for c in batch.columns)):
            n = np.bincount(codes[codes >= 0], minlength=len(words))
            has = np.flatnonzero(n)
            keys = _keys(ids[has][:, None])
            out.append(record_batch(WORDS, lang=[lang] * len(has), word=[words[i].decode("utf-8", "surrogatepass") for i in has], key=keys, n=n[has]))
        return pa.Table.from_batches(out, WORDS).combine_chunks().to_batches()[0] if any(b.num_rows for b in out) else record_batch(WORDS, lang=[], word=[], key=[], n=[])

    parts = map_texts(docs, {"lang": F.col(f"`{lang}`").cast("string"), "text": F.col(f"`{text}`")}, "lang string, word string, key binary, n long", count)
    return parts.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def _keys(ids: np.ndarray) -> pa.Array:
    """Rows of word numbers as binary keys; the key of a part of a phrase is a part of its key."""
    flat = np.ascontiguousarray(ids)
    width = flat.shape[1] * 8
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _mix(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    h = np.full(len(ids), 0x9E3779B97F4A7C15, np.uint64)
    for col in ids.T:
        h = (h ^ col.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0x94D049BB133111EB)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in the filter."""
    return (h >> np.uint64(8)) & np.uint64(bits - 1), (h >> np.uint64(35)) & np.uint64(bits - 1)


class Filter:
    """A set of phrases as bits in a broadcast of fixed size."""

    def __init__(self, keys: DataFrame, bits: int):
        def places(batches):
            for b in batches:
                key = b.column(0).cast(pa.large_binary())
                for width in set(pc.binary_length(key).to_pylist()):
                    own = key.filter(pc.equal(pc.binary_length(key), width))
                    both = np.concatenate(_places(_mix(np.frombuffer(b"".join(own.to_pylist()), np.int64).reshape(-1, width // 8)), bits))
                    yield pa.RecordBatch.from_arrays([pa.array(both.astype(np.int64))], names=["p"])

        rows = keys.select("key").mapInArrow(places, "p long")
        stored = rows.select(F.floor(F.col("p") / ROW_BITS).alias("row"), (F.col("p") % ROW_BITS).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
        filled = np.zeros(max(1, bits // 8), np.uint8)
        for r in stored.collect():  # bits / ROW_BITS rows at most
            own = np.frombuffer(bytes(r["bits"]), np.uint8)
            at = r["row"] * (ROW_BITS // 8)
            filled[at : at + len(own)] = own[: len(filled) - at]
        self.bits, self.data = bits, keys.sparkSession.sparkContext.broadcast(filled.tobytes())

    def has(self, h: np.ndarray) -> np.ndarray:
        data = np.frombuffer(self.data.value, np.uint8)
        first, second = _places(h, self.bits)
        return ((data[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8)) & (data[second >> np.uint64(3)] >> (second & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def frequent_runs(docs: DataFrame, frequent: Filter, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of one column `run`: word numbers, 0 where a run breaks and at the end. Words with no frequent neighbour are left out."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[np.ndarray] = []
        for _, _, codes, ids in _tokens(*(c.to_pylist() for c in batch.columns)):
            if not len(codes):
                continue
            kept = np.where(frequent.has(_mix(ids[:, None])), ids, 0)
            v = np.concatenate(([0], np.where(codes >= 0, kept[codes], 0), [0]))
            alone = (v[1:-1] != 0) & (v[:-2] == 0) & (v[2:] == 0)
            v[1:-1][alone] = 0
            v = v[1:][(v[1:] != 0) | (v[:-1] != 0)]  # one 0 between runs, none before the first
            ends = np.flatnonzero(v == 0) + 1
            if len(ends):
                at = np.unique(ends[np.searchsorted(ends, np.arange(ROW_TOKENS, len(v) + ROW_TOKENS, ROW_TOKENS)).clip(max=len(ends) - 1)])
                out += np.split(v[: ends[-1]], at[:-1])
        return record_batch(RUNS, run=out)

    return map_texts(docs, {"lang": F.col(f"`{lang}`").cast("string"), "text": F.col(f"`{text}`")}, "run array<long>", encode)


def _phrases(runs: DataFrame, lengths: list[int], wanted) -> DataFrame:
    """Rows (key, f): how often each wanted phrase of these lengths occurs. wanted(hashes, m) judges phrases of m words;
    hashes(k, shift) are those of their k words from the word number `shift` on."""

    def count(v: np.ndarray):
        cache: dict[int, np.ndarray] = {}

        def hashes(m: int, shift: int = 0) -> np.ndarray:
            if m not in cache:
                cache[m] = _mix(np.lib.stride_tricks.sliding_window_view(v, m)) if len(v) >= m else np.empty(0, np.uint64)
            return cache[m][shift:]

        whole = v != 0
        for m in lengths:
            if len(v) < m:
                continue
            inside = np.lib.stride_tricks.sliding_window_view(whole, m).all(axis=1)
            at = np.flatnonzero(inside)
            at = at[wanted(lambda k, shift=0: hashes(k, shift)[at], m)]  # noqa: B023
            if len(at):
                yield from _unique(np.stack([v[at + j] for j in range(m)], axis=1), hashes(m)[at])

    def run(batches):
        for b in batches:
            flat = b.column(0).flatten().to_numpy()
            ends = np.flatnonzero(flat == 0) + 1
            at = 0
            while at < len(flat):  # pieces of about a million words, cut where a run ends
                stop = int(ends[min(np.searchsorted(ends, at + (1 << 20)), len(ends) - 1)])
                with no_gc():
                    yield from count(flat[at:stop])
                at = stop

    return runs.mapInArrow(run, "key binary, f long").groupBy("key").agg(F.sum("f").alias("f"))


def _unique(phrases: np.ndarray, h: np.ndarray):
    """Counts equal rows. Rows are brought together by their hash and compared word by word."""
    _, first, where, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if (phrases != phrases[first[where]]).any():
        _, first, n = np.unique(phrases, axis=0, return_index=True, return_counts=True)
    yield record_batch(COUNTS, key=_keys(phrases[first]), f=n)


def _part(key: str, first: int, words: int) -> F.Column:
    return F.substring(key, 8 * first + 1, 8 * words)


def _length(key: str = "key") -> F.Column:
    return (F.octet_length(key) / 8).cast("int")


class Search:
    """The state of a search: counts so far, and which first words of each language have been grown."""

    def __init__(self, spark: SparkSession, docs: DataFrame, text: str, lang: str, least: int, wanted: int, filter_bits: int):
        self.spark, self.least, self.wanted, self.bits = spark, least, wanted, filter_bits
        words = cut(word_counts(docs, text, lang), "words")
        if not words.groupBy("key").count().where("count > 1").isEmpty():
            raise ValueError("two words have one number: choose another hash")
        self.totals = cut(words.groupBy("lang").agg(F.sum("n").alias("n")), "languages")
        self.words = cut(words.where(F.col("n") >= least), "words")
        self.runs = cut(frequent_runs(docs, self._filter(self.words), text, lang), "runs")
        self.counts = self.words.select("key", F.col("n").alias("f"))  # of words, and of phrases found so far
        self.grown: DataFrame | None = None  # candidates: phrases of grown first words
        self.limits: DataFrame | None = None  # (lang, most): first words of up to so many occurrences are grown

    def _filter(self, keys: DataFrame) -> Filter:
        return Filter(keys, self.bits)

    def _frequent(self, found: DataFrame) -> DataFrame:
        return cut(found.where(F.col("f") >= self.least), "phrases")

    def _upto(self, limits: DataFrame | None) -> DataFrame:
        if limits is None:
            return self.words.limit(0)
        return self.words.join(limits, "lang").where(F.col("n") <= F.col("most")).select(*self.words.columns)

    def grow(self, limits: DataFrame) -> None:
        """Grows the first words that the new limits add, then fetches what their scores and survival need."""
        added = cut(self._upto(limits).join(self._upto(self.limits), "key", "left_anti"), "frontier")
        self.limits, level, found = limits, added, []
        for m in range(2, LONGEST + 1):
            beginning = self._filter(level)
            level = self._frequent(_phrases(self.runs, [m], lambda h, m, known=beginning: known.has(h(m - 1))))
            level = level.join(self._upto(limits).select(F.col("key").alias("first")), _part("key", 0, 1) == F.col("first"), "left_semi")  # none by chance
            found.append(level)
            if level.isEmpty():
                break
        new = found[0]
        for f in found[1:]:
            new = new.unionByName(f)
        new = cut(new, "phrases")
        self.grown = new if self.grown is None else self.grown.unionByName(new).dropDuplicates(["key"])
        known = self.counts.unionByName(new).dropDuplicates(["key"])
        rests = new.select(F.explode(F.transform(F.sequence(F.lit(1), _length() - 1), lambda k: F.expr("key").substr(8 * k + 1, F.octet_length("key") - 8 * k))).alias("key")).distinct()
        missing = rests.join(known, "key", "left_anti")
        open_ = self._open(new, known)
        probes, fronts = self._filter(missing), self._filter(open_)

        def wanted(h, m):
            if m == 2:
                return probes.has(h(2))
            return fronts.has(h(m - 1, 1)) | probes.has(h(m)) if m < LONGEST else fronts.has(h(m - 1, 1))

        fetched = self._frequent(_phrases(self.runs, list(range(2, LONGEST + 1)), wanted))
        self.counts = cut(known.unionByName(fetched).dropDuplicates(["key"]), "counts")

    def _open(self, phrases: DataFrame, counts: DataFrame) -> DataFrame:
        """The phrases that no known phrase of one word more covers as often. A longer one has such a phrase as its part."""
        parts = F.explode(F.array(*[F.expr("key").substr(F.lit(8 * k + 1), F.octet_length("key") - 8) for k in (0, 1)]))
        covers = counts.where(_length() > 2).select(parts.alias("key"), "f")
        return phrases.join(covers, ["key", "f"], "left_anti")

    def scored(self) -> DataFrame:
        """Rows (lang, key, a, l, r, n, score) of the grown candidates that survive."""
        alive = self._open(self.grown, self.counts)
        cuts = alive.withColumn("k", F.explode(F.sequence(F.lit(1), _length() - 1)))
        sides = cuts.withColumns({"left": F.expr("key").substr(F.lit(1), 8 * F.col("k")), "right": F.expr("key").substr(8 * F.col("k") + 1, F.octet_length("key") - 8 * F.col("k"))})
        left = self.counts.select(F.col("key").alias("left"), F.col("f").alias("l"))
        right = self.counts.select(F.col("key").alias("right"), F.col("f").alias("r"))
        first = self.words.select(F.col("key").alias("first"), "lang")
        whole = sides.join(left, "left").join(right, "right").withColumn("first", _part("key", 0, 1)).join(first, "first").join(self.totals, "lang")
        score = F.expr("(cast(1000 as decimal(4,0)) * cast(f as decimal(15,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
        lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
        best = whole.groupBy("key", "lang", "n", F.col("f").alias("a")).agg(lowest)
        return best.select("lang", "key", "a", "cut.l", "cut.r", "n", "cut.score")

    def step(self, share: float) -> DataFrame:
        """Limits under which a language's rarest first words, with at least that share of its frequent words' occurrences, are grown."""
        sums = self.words.groupBy("lang", "n").agg((F.col("n") * F.count("*")).alias("of")).withColumn("upto", F.sum("of").over(W.partitionBy("lang").orderBy("n"))).withColumn("all", F.sum("of").over(W.partitionBy("lang")))
        return sums.where(F.col("upto") >= F.col("all") * share).groupBy("lang").agg(F.min("n").alias("most"))

    def run(self, share: float = 0.125) -> DataFrame:
        """Rows (lang, key, a, l, r, n, score): all survivors that can be among the best of their language."""
        limits = cut(self.step(share), "limits")
        while True:
            self.grow(limits)
            scored = cut(self.scored(), "scores")
            nth = scored.withColumn("i", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score")))).where(F.col("i") == self.wanted).select("lang", F.col("score").alias("reached"))
            left = self.words.join(limits, "lang").where(F.col("n") > F.col("most")).groupBy("lang", "most").agg(F.min("n").alias("next"), F.max("n").alias("last"))
            share = min(1.0, 4 * share)
            bound = F.expr("(cast(1000 as decimal(4,0)) * cast(n as decimal(18,0))) div reached")
            state = left.join(nth, "lang", "left").join(self.totals, "lang").withColumn("reachable", F.when(F.col("reached") > 0, F.least("last", bound)).otherwise(F.col("last")))
            state = cut(state.join(self.step(share).select("lang", F.col("most").alias("stepped")), "lang").where(F.col("next") <= F.col("reachable")), "limits")
            if state.isEmpty():
                return scored
            goal = F.when(F.col("reached").isNull(), F.greatest("next", "stepped")).otherwise(F.col("reachable"))
            raised = state.select("lang", goal.alias("goal"))
            limits = cut(limits.join(raised, "lang", "left").select("lang", F.greatest("most", "goal").alias("most")), "limits")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, wanted: int = 2000, filter_bits: int = FILTER_BITS, share: float = 0.125) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to 5 words of each language.

    share: the part of the frequent words' occurrences that the first step of the frontier grows."""
    search = Search(docs.sparkSession, docs, text, lang, least, wanted, filter_bits)
    found = search.run(share)
    reached = found.withColumn("i", F.rank().over(W.partitionBy("lang").orderBy(F.desc("score")))).where(F.col("i") <= wanted).drop("i")
    single = reached.select("key", "lang", F.posexplode(F.transform(F.sequence(F.lit(0), _length() - 1), lambda k: F.expr("key").substr(8 * k + 1, F.lit(8)))).alias("i", "one"))
    names = search.words.select(F.col("key").alias("one"), "word")
    spelled = single.join(names, "one").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return reached.join(spelled, "key").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= wanted).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

