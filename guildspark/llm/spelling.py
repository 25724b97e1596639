"""Spelling variants: words at an edit distance of exactly one, found with a bit-sliced position index.

Texts are counted into a vocabulary. Two near words agree, wherever their difference lies, before or behind
the middle of the shorter one; so every word is put under a few pieces of itself, and near words share a
piece. A piece that more than DENSE words share is cut again within its open region, before any task gathers
it, down to one open position. Words under one piece form a block. A block is indexed by one bitset of its
words for each position and letter; for all words of the block at once, a recurrence over the positions keeps
the words that agree so far (no error), those with one replaced letter, and those with one letter more, whose
bitsets are read one position further. A deleted letter is an added one seen from the other word.

A pair is told by the one piece that its common prefix leads to, so no pair counts twice and only sums and the
best form of each word leave a task.

Defined results: a null or empty text has no words; a null id counts as an empty one; rows with equal ids or
texts all count; runs of any length are whole; words below the limits are no words; an empty table gives no rows;
columns other than the two named ones are not read."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut, join_counted, map_texts, no_gc, record_batch, utf8

RUN = re.compile("[a-zÀ-ÿ]+")
#: One in so many pairs of document and run loses a letter, as the contract asks.
SPOILED = 97
#: More words under one piece are cut anew; words that one task indexes together.
DENSE = 1024
FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def runs_of(text) -> Counter:
    """The runs of letters of a text with A-Z in lower case, and how often each stands there."""
    return Counter(RUN.findall(utf8(text).translate(ASCII_LOWER).decode("utf-8", "surrogatepass")))


def spoil(run: str, start: int, one_in: int) -> str:
    """The run without the code point that its checksum picks, if the checksum asks for it. start: the checksum of what precedes the run."""
    h = zlib.crc32(run.encode(), start)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, text: str = "text", id: str = "doc_id", least_length: int = 5, least_count: int = 3, spoiled: int = SPOILED) -> DataFrame:
    """Rows (word, n). spoiled = 0 leaves all runs as they are."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter = Counter()
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            start = zlib.crc32(f"{'' if key is None else key}:".encode())
            for run, n in runs_of(value).items():
                if len(run) >= least_length:
                    word = spoil(run, start, spoiled) if spoiled else run
                    if len(word) >= least_length:
                        total[word] += n
        return record_batch(COUNTED, word=list(total), n=list(total.values()))

    parts = map_texts(docs, {"id": F.col(f"`{id}`").cast("string"), "text": F.col(f"`{text}`")}, "word string, n long", count)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds k, the piece: the word without the open region from lo to hi, in places of a word of s letters."""
    open_, back = F.col("lo"), F.col("s") - F.col("hi")
    return rows.withColumn("k", F.xxhash64("s", "lo", "hi", F.substring("word", F.lit(1), open_), F.right("word", back)))


def _start(words: DataFrame, least_length: int) -> DataFrame:
    length = F.length("word")
    sized = words.withColumn("s", F.explode(F.array(length, length - 1))).where(F.col("s") >= least_length)
    return _split(sized.withColumns({"lo": F.lit(0), "hi": F.col("s")}))


def _split(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi")))
    cut_ = rows.select("word", "n", "s", F.explode(halves).alias("h"))
    return _keyed(cut_.select("word", "n", "s", "h.lo", "h.hi"))


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    packed = np.packbits(flags, axis=1, bitorder="little")
    wide = np.zeros((packed.shape[0], -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def near_in_block(letters: np.ndarray, lengths: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of words of a block with one error between them: a has s letters, b as many or one more.

    letters: a row per word, padded with zeros to s + 1 or more."""
    asked = np.flatnonzero(lengths == s)
    alphabet = np.unique(letters)
    code = np.zeros(256, np.int64)
    code[alphabet] = np.arange(len(alphabet))

    def index(place: int) -> np.ndarray:
        """Per letter, the bitset of the words that have it in this place."""
        return _bits(letters[:, place][None, :] == alphabet[:, None])

    same = np.full((len(asked), -(-len(letters) // 64)), np.uint64(2**64 - 1))
    replaced, longer = np.zeros_like(same), np.zeros_like(same)
    ahead = index(0)
    for i in range(s):
        here, ahead = ahead, index(i + 1)
        own = code[letters[asked, i]]
        at, shifted = here[own], ahead[own]
        longer |= same
        longer &= shifted
        replaced &= at
        replaced |= same & ~at
        same &= at
    longer |= same
    sizes = _bits(np.stack([lengths == s, lengths == s + 1]))
    found = (replaced & sizes[0]) | (longer & sizes[1])
    row, word = np.nonzero(found)
    which, bit = np.nonzero(np.unpackbits(found[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return asked[row[which]], word[which] * 64 + bit


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that the rows of a and b share from the start."""
    differs = a != b
    return np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])


def _block(words: list[str], n: np.ndarray, k: np.ndarray, lo: np.ndarray, hi: np.ndarray, s: int) -> dict:
    """n_near and the best near word of the block's words, over the pairs that this block has to tell."""
    raw = [w.encode("latin-1") for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    letters = np.frombuffer(b"".join(w.ljust(s + 1, b"\0") for w in raw), np.uint8).reshape(len(raw), s + 1)
    a, b = near_in_block(letters, lengths, s)
    keep = k[a] == k[b]
    a, b = a[keep], b[keep]
    if len(a):
        reverse = np.frombuffer(b"".join(w[::-1].ljust(s + 1, b"\0") for w in raw), np.uint8).reshape(len(raw), s + 1)
        front, back = _common(letters[a, :s], letters[b, :s]), _common(reverse[a, :s], reverse[b, :s])
        told = (lo[a] == lo[b]) & (hi[a] == hi[b]) & (front >= lo[a]) & (back >= s - hi[a]) & ((hi[a] == s) | (front < hi[a]))
        a, b = a[told], b[told]
    added = lengths[b] > s  # the pairs of one length were found from both sides
    a, b = np.concatenate([a, b[added]]), np.concatenate([b, a[added]])
    rank = np.empty(len(raw), np.int64)
    rank[sorted(range(len(raw)), key=raw.__getitem__)] = np.arange(len(raw))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    own, first, count = np.unique(a, return_index=True, return_counts=True)
    best = b[first]
    return {"word": [words[i] for i in own], "n_near": count, "best_n": n[best], "best": [words[i] for i in best]}


def _blocks(batches):
    """Reads rows sorted by (s, k); yields what is near in blocks of whole pieces of one s."""
    kept: list[pa.RecordBatch] = []

    def run(rows: pa.Table, last: bool):
        """Tells all pieces of the rows, but for the last one unless nothing follows; returns what is left."""
        s, k = rows.column("s").to_numpy(), rows.column("k").to_numpy()
        starts = np.concatenate(([0], np.flatnonzero((np.diff(s) != 0) | (np.diff(k) != 0)) + 1, [len(s)]))
        ends = starts[1:] if last else starts[1:-1]
        at = 0
        for i, end in enumerate(ends):
            following = ends[i + 1] if i + 1 < len(ends) else None
            if following is None or following - at > DENSE or s[following - 1] != s[at]:
                if end - at > 1:
                    part = rows.slice(at, end - at)
                    col = {c: part.column(c).to_numpy() for c in ("n", "k", "lo", "hi")}
                    with no_gc():
                        found = _block(part.column("word").to_pylist(), **col, s=int(s[at]))
                    if len(found["word"]):
                        yield record_batch(FOUND, **found)
                at = int(end)
        kept[:] = rows.slice(at).to_batches()

    for batch in batches:
        kept.append(batch)
        yield from run(pa.Table.from_batches(kept), False)
    if kept:
        yield from run(pa.Table.from_batches(kept), True)


def _near(rows: DataFrame) -> DataFrame:
    dealt = rows.select("word", "n", "s", "k", "lo", "hi").repartition("k").sortWithinPartitions("s", "k")
    return dealt.mapInArrow(_blocks, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame, least_length: int = 5, dense: int = DENSE) -> DataFrame:
    """Rows (word, n_near, best_n, best) of the words (word, n) that have near ones: how many, and the near word of
    largest n, of equal ones the smallest. words is read several times, so it should be a stored table."""
    rows, parts = _start(words, least_length), []
    while True:
        shared = rows.groupBy("k").agg(F.count("*").alias("words"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        crowded = cut(shared.where((F.col("words") > dense) & (F.col("open") > 1)).select("k"), "pieces")
        if crowded.isEmpty():
            parts.append(_near(rows))
            break
        parts.append(_near(rows.join(crowded, "k", "left_anti")))
        rows = cut(_split(rows.join(crowded, "k", "left_semi")), "pieces")
    told = parts[0]
    for p in parts[1:]:
        told = told.unionByName(p)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) from rows (word, form): the end of each word's forms. A form's form is looked up twice as far in each round."""
    links = cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        used = links.groupBy("root").agg(F.count("*").alias("n"))
        keyed = links.select(F.col("word").alias("root"), F.col("root").alias("up")).join(used, "root")
        total = links.count()
        further = cut(join_counted(links, keyed, ["root"], total, F.xxhash64("word"), "left"), "forms")
        if further.where("up is not null").isEmpty():
            return links
        links = further.select("word", F.coalesce("up", "root").alias("root"))


def variants(docs: DataFrame, text: str = "text", id: str = "doc_id", least_length: int = 5, least_count: int = 3, ratio: int = 2, spoiled: int = SPOILED) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n): every word of the vocabulary with the more frequent spelling that it varies, if any."""
    words = cut(vocabulary(docs, text, id, least_length, least_count, spoiled), "words")
    near = near_words(words, least_length)
    is_form = F.col("best_n") >= ratio * F.col("n")
    told = cut(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
        ),
        "variants",
    )
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
