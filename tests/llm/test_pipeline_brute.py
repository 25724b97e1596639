"""The pipeline's stages beside plain Python over whole tables."""

import re

import corpus_pipeline as P
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from guildspark.llm import sentencepiece_trie, toxicity
from guildspark.llm.common import cut, read

SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def first_of_groups(docs):
    fp = {d: fingerprint(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


def without_repeats(docs, size=50):
    seen = {}
    for d in sorted(docs):
        x = (docs[d] or "").encode()
        for i in range(len(x) - size + 1):
            seen.setdefault(x[i : i + size], d)
    out = {}
    for d, t in docs.items():
        x = (t or "").encode()
        gone = bytearray(len(x))
        for i in range(len(x) - size + 1):
            if seen[x[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        out[d] = None if t is None else bytes(b for b, g in zip(x, gone) if not g).decode("utf-8", "ignore")
    return out


def uncontaminated(docs, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {}
    for t in items:
        w = words(t)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(len(w[i : i + n]), set()).add(tuple(w[i : i + n]))
    kept = set()
    for d, t in docs.items():
        w, hit = words(t), set()
        for k, own in windows.items():
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in own:
                    hit.update(range(i, i + k))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.add(d)
    return kept


def test_stages_by_brute_force(spark):
    docs = read(spark, SF, "documents")
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    before = texts(docs)
    model = toxicity.train(docs, read(spark, SF, "labels"))
    score = {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    docs = cut(P.STAGES[0][1](spark, docs, SF), "t0")
    want = {d: before[d] for d in before if score[d] < 0.3}
    assert texts(docs) == want
    docs = cut(P.STAGES[1][1](spark, docs, SF), "t1")
    want = {d: want[d] for d in first_of_groups(want)}
    assert texts(docs) == want
    docs = cut(P.STAGES[2][1](spark, docs, SF), "t2")
    want = without_repeats(want)
    assert texts(docs) == want
    docs = cut(P.STAGES[3][1](spark, docs, SF), "t3")
    items = [r["text"] for r in read(spark, SF, "benchmark").collect()]
    want = {d: want[d] for d in uncontaminated(want, items)}
    assert texts(docs) == want
    coded = cut(P.STAGES[4][1](spark, docs, SF), "t4")
    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {d: None if t is None else m.encode(t) for d, t in want.items()}
    assert {r["id"]: r["text"] for r in sentencepiece_trie.decode(coded, path, "doc_id").collect()} == want


def test_odd_tables(spark):
    docs = read(spark, SF, "documents")
    extra = docs.limit(60).withColumns({"a.b": F.lit(1), "score": F.lit("x"), "kept": F.lit(2.0), "component": F.lit(3), "row": F.lit(4)})
    long = extra.limit(1).withColumn("doc_id", F.lit(10**6).cast("long")).withColumn("text", F.repeat(F.lit("lorem ipsum dolor sit amet "), 60_000))
    for rows in (extra.limit(0), extra.unionByName(long)):
        now = rows
        for name, stage in P.STAGES[:-1]:
            now = cut(stage(spark, now, SF), "odd")
            assert now.columns == rows.columns, name
        assert P.encode(spark, now, SF).count() == now.count()
