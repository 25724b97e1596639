"""Toxicity by a support vector machine with a gap-weighted subsequence kernel and Nyström landmarks.

Kernel: two words are compared by their subsequences of three characters, weighed by DECAY per
character of span (up to SPAN), so gaps and inserted characters weaken a match and do not break it;
words carry a start and an end mark, and kernels are normalised. The landmarks are words of the
training sample; a word's Nyström features are its kernels with them times the inverse root of their
own kernel matrix. Labels are given to documents, so training is of the multiple-instance kind: words
that labelled documents of one class share start as that class's examples, a linear SVM is fitted, and
candidates it puts on the clean side change sides before it is fitted again. As the features are linear
in the landmarks' subsequences, the fitted machine is folded into one weight per subsequence, which
gives the same decision values. A document is scored by the three highest of its distinct words with a
logistic fit on the sample's documents.

Words are counted by the distinct words before them: a copied document then counts once, and a word that
stands in many places of toxic documents counts many times.

The sample has at most `per_class` labelled documents of each class (those with the lowest MD5 of their
id), the bound on everything that is gathered from the labels; word counts are summed in Spark. Every word of
the sample that passes GAIN and stands mostly in toxic documents is a candidate; of the clean words `max_words`
(the most frequent and a sample by MD5) are the examples to tell them from. Scoring covers all words of all texts.

Defined results: null, empty and wordless texts get the score of a document without insults; words over
WORD characters are scored in overlapping parts; repeated rows each get a row; labels of unknown ids and
null labels are ignored; without a label of either class the score is the smoothed share of toxic ones."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, held, map_texts, numbered, record_batch

DECAY, SPAN, WORD, ALPHABET = 0.6, 7, 48, 128
EDGE = " \t\r\n.,;:!?\"'()[]{}<>|/\\*_-~`=+&^%$#@"
#: Character classes: the edges of a word, OTHERS shared ones by code point, and one of its own for each further character.
START, STOP, OTHER, OTHERS = 1, 2, 3, 31
TOP = 3
#: Bytes of text whose words a worker holds at once.
SLICE = 2 << 20
#: A word is a candidate of the toxic class from this gain on (chi-square of one degree of freedom), if its rate lies
#: past the middle between the sample's share and 1: very frequent words gain by the slightest difference.
GAIN = 12.0


def words_of(text) -> set[str]:
    """Distinct words of a text in lower case, without punctuation at either end."""
    if not text:
        return set()
    return {w.strip(EDGE) for w in set(text.lower().split())} - {""}


def parts_of(word: str) -> list[str]:
    if len(word) <= WORD:
        return [word]
    return [word[i : i + WORD] for i in range(0, len(word) - WORD // 2, WORD // 2)]


_triples: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of three in n characters within SPAN, and their weights."""
    if n not in _triples:
        at = np.array([(i, j, k) for i in range(n) for j, k in itertools.combinations(range(i + 1, min(n, i + SPAN)), 2)], np.int64).reshape(-1, 3)
        _triples[n] = at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)
    return _triples[n]


class Kernel:
    """Character classes: the most frequent characters of the sample have their own, all others are spread over OTHERS shared ones."""

    def __init__(self, characters: str):
        self.code = {c: i + OTHER + OTHERS for i, c in enumerate(characters[: ALPHABET - OTHER - OTHERS])}

    def subsequences(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length: the number of each subsequence (words x places) and each place's weight."""
        get = self.code.get
        codes = np.array([[START, *[get(c) or OTHER + ord(c) % OTHERS for c in w], STOP] for w in words], np.int32)
        at, weight = triples(codes.shape[1])
        return (codes[:, at[:, 0]] * ALPHABET + codes[:, at[:, 1]]) * ALPHABET + codes[:, at[:, 2]], weight

    def values(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """weights . phi(word) / |phi(word)| for each word, whose parts' best counts."""
        out = np.full(len(words), -np.inf, np.float32)
        by_length: dict[int, list[tuple[int, str]]] = {}
        for i, w in enumerate(words):
            for p in parts_of(w):
                by_length.setdefault(len(p), []).append((i, p))
        for length, own in by_length.items():
            step = max(1, 500_000 // max(1, len(triples(length + 2)[0])))
            for a in range(0, len(own), step):
                some = own[a : a + step]
                numbers, weight = self.subsequences([p for _, p in some])
                dot = (weights[numbers] * weight).sum(axis=1)
                order = np.argsort(numbers, axis=1)
                inner = np.take_along_axis(numbers, order, axis=1)
                value = weight[order]
                new = np.ones(inner.shape, bool)
                new[:, 1:] = inner[:, 1:] != inner[:, :-1]
                sums = np.add.reduceat(value.ravel(), np.flatnonzero(new.ravel()))
                rows = np.repeat(np.arange(len(some)), new.sum(axis=1))
                norm = np.sqrt(np.bincount(rows, sums.astype(np.float64) ** 2, len(some)))
                np.maximum.at(out, [i for i, _ in some], (dot / np.maximum(norm, 1e-9)).astype(np.float32))
        return out

    def vectors(self, words: list[str], known: dict[int, int] | None = None) -> tuple[np.ndarray, dict[int, int]]:
        """Normalised phi of each word over the subsequences that occur; for the words of the sample only."""
        cells = []
        known = {} if known is None else known
        for i, w in enumerate(words):
            numbers, weight = self.subsequences([w[:WORD]])
            for u, x in zip(numbers[0].tolist(), weight.tolist(), strict=True):
                cells.append((i, known.setdefault(u, len(known)), x))
        out = np.zeros((len(words), len(known)), np.float32)
        i, u, x = (np.array(c) for c in zip(*cells, strict=True)) if cells else (np.zeros(0, int),) * 3
        np.add.at(out, (i, u), x)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), known


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Squared hinge loss by Newton steps over the rows inside the margin; the last column is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        xi, wi = x[inside], (weight * c)[inside]
        new = np.linalg.solve(np.eye(len(w)) + 2 * (xi.T * wi) @ xi, 2 * (xi.T * wi) @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, rounds: int = 50) -> np.ndarray:
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


class Model:
    def __init__(self, characters: str, weights: np.ndarray, bias: float, top: np.ndarray, prior: float):
        self.kernel, self.weights, self.bias, self.top, self.prior = Kernel(characters), weights.astype(np.float32), bias, top, prior
        self.known: dict[str, float] = {}

    def tops(self, texts: list, limit: int = 400_000) -> np.ndarray:
        """Per text the TOP highest decision values of its distinct words, between -2 and 2; -2 where there are fewer."""
        bags = [words_of(t) for t in texts]
        new = list(set().union(*bags).difference(self.known))
        self.known.update(zip(new, np.clip(self.kernel.values(new, self.weights) + self.bias, -2, 2).tolist(), strict=True))
        get = self.known.__getitem__
        out = np.full((len(texts), TOP), -2.0)
        for i, bag in enumerate(bags):
            values = np.fromiter(map(get, bag), np.float64, len(bag))
            best = np.sort(values)[::-1][:TOP] if len(values) < 64 else np.sort(np.partition(values, -TOP)[-TOP:])[::-1]
            out[i, : len(best)] = best
        if len(self.known) > limit:
            for w in new:
                del self.known[w]
        return out

    def scores(self, texts: list) -> np.ndarray:
        if self.top is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.tops(texts) @ self.top[:-1] + self.top[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", usable: Column | None = None, per_class: int = 4000, max_words: int = 6000, landmarks: int = 192) -> Model:
    """usable: the rows of labels that may be learned from. per_class, max_words: labelled documents of each class and clean example words."""
    own = labels if usable is None else labels.where(usable)
    own = own.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    shares = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    mixed = F.md5(F.col("id").cast("string"))
    picked = own.where("y = 1").orderBy(mixed).limit(per_class).unionByName(own.where("y = 0").orderBy(mixed).limit(per_class)).collect()  # 2 * per_class ids
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r["id"], r["y"]) for r in picked], "id long, y int")
    sample = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id").where("text is not null")
    empty = Model("", np.zeros(ALPHABET**3), 0.0, None, prior)
    if not (shares.get(0) and shares.get(1)):
        return empty
    schema = pa.schema([("word", pa.string()), ("before", pa.string()), ("t", pa.int32()), ("n", pa.int32())])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple[str, str], int] = {}
        for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
            last = ""
            for w in t.lower().split():
                w = w.strip(EDGE)
                if w and len(w) <= WORD:
                    found[w, last] = found.get((w, last), 0) | (1 if y else 2)
                last = w
        return record_batch(schema, word=[k[0] for k in found], before=[k[1] for k in found], t=[v & 1 for v in found.values()], n=[v >> 1 for v in found.values()])

    # a word counts once for each word before it, so copies of a document add nothing
    seen_in = map_texts(sample, {"y": F.col("y"), "text": F.col("text")}, "word string, before string, t int, n int", count).groupBy("word", "before").agg(F.max("t").alias("t"), F.max("n").alias("n"))
    counted = cut(seen_in.groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n")), "toxicity-words")
    n1, n0 = (x or 0 for x in counted.agg(F.sum("t"), F.sum("n")).first())
    if not n1 or not n0:
        return empty
    share = n1 / (n1 + n0)
    # twice the log-likelihood gain of a rate of the word's own over the sample's share of toxic occurrences
    both, rate = F.col("t") + F.col("n"), F.col("t") / (F.col("t") + F.col("n"))
    part = lambda k, p, q: F.when(F.col(k) > 0, F.col(k) * F.log(p / q)).otherwise(0.0)
    gain = 2 * (part("t", rate, F.lit(share)) + part("n", 1 - rate, F.lit(1 - share)))
    scored = counted.withColumn("gain", F.when(rate > share, gain).otherwise(-gain)).withColumn("clean", (F.col("gain") <= 2) | (rate <= (1 + share) / 2)).where(both >= 1)
    bad = scored.where((F.col("gain") > GAIN) & ~F.col("clean")).orderBy(F.desc("gain"), "word").collect()  # words of the sample only
    common = scored.where("clean").orderBy(F.desc("n"), "word").limit(max_words // 3).collect()
    spread = scored.where("clean and n > 0").orderBy(F.md5("word"), "word").limit(max_words - max_words // 3).collect()
    if not bad or not (common or spread):
        return empty
    good = list(dict.fromkeys([r["word"] for r in common] + [r["word"] for r in spread]))
    seen: dict[str, int] = {}
    for w in [r["word"] for r in bad] + good:
        for c in w:
            seen[c] = seen.get(c, 0) + 1
    characters = "".join(sorted(seen, key=lambda c: (-seen[c], c)))
    kernel = Kernel(characters)
    words = [r["word"] for r in bad] + good
    y = np.array([1.0] * len(bad) + [-1.0] * len(good))
    weight = np.array([min(10.0, r["t"]) for r in bad] + [1.0] * len(good))
    marks = [r["word"] for r in bad[: landmarks // 2]] + good[: landmarks // 2]
    phi, known = kernel.vectors(marks)
    near = np.concatenate([kernel.vectors(words[a : a + 250], dict(known))[0][:, : len(known)] @ phi.T for a in range(0, len(words), 250)])  # words x landmarks
    values, roots = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    inverse_root = roots[:, kept] / np.sqrt(values[kept])
    x = np.column_stack((near @ inverse_root, np.ones(len(words))))
    for _ in range(4):
        w = linear_svm(x, y, weight)
        turned = (y > 0) & (np.arange(len(y)) < len(bad)) & (x @ w < 0)
        if not turned.any() or turned.sum() == (y > 0).sum():
            break
        y[turned], weight[turned] = -1.0, 1.0
    folded = np.zeros(ALPHABET**3)
    folded[list(known)] = phi.T @ (inverse_root @ w[:-1])
    model = Model(characters, folded, float(w[-1]), None, prior)
    sent = spark.sparkContext.broadcast((characters, model.weights, model.bias))
    tops = pa.schema([("y", pa.int32()), *[(f"m{k}", pa.float64()) for k in range(TOP)]])

    def value(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _on_worker(sent, lambda v: Model(*v, None, prior)).tops(batch.column("text").to_pylist())
        return record_batch(tops, y=batch.column("y"), **{f"m{k}": m[:, k] for k in range(TOP)})

    rows = map_texts(sample, {"y": F.col("y"), "text": F.col("text")}, "y int, " + ", ".join(f"m{k} double" for k in range(TOP)), value, SLICE).collect()  # 2 * per_class rows of four numbers
    yy = np.array([r["y"] for r in rows], np.float64)
    # each class counts as it does among the labels, whatever its share of the sample
    balance = np.where(yy > 0, prior / max(1, yy.sum()), (1 - prior) / max(1, (1 - yy).sum())) * len(yy)
    model.top = logistic(np.array([[r[f"m{k}"] for k in range(TOP)] for r in rows]), yy, balance)
    return model


def _on_worker(sent, build):
    return held(("toxicity", sent), lambda: build(sent.value))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, score)."""
    return _scored(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), model, "text", "score").select("id", "score")


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score in one more column, which must not exist yet."""
    return _scored(docs, model, text, name)


def _scored(docs: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(("".join(model.kernel.code), model.weights, model.bias, model.top, model.prior))
    plain, column = numbered(docs)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = _on_worker(sent, lambda v: Model(*v)).scores(batch.column(column[text]).to_pylist())
        return batch.append_column("score", pa.array(got, pa.float64()))

    found = map_texts(plain, {c: F.col(c) for c in plain.columns}, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]), per_batch, SLICE)
    return found.select(*[F.col(column[c]).alias(c) for c in docs.columns], F.col("score").alias(name))
