import hashlib
import random

import pytest

from guildspark.llm import substring, suffixes

RNG = random.Random(7)
WORDS = "a bb ccc dé ee".split()


def make_docs():
    part = [" ".join(RNG.choice(WORDS) for _ in range(14)) for _ in range(4)]
    docs = []
    for i in range(40):
        docs.append((i, " ".join(RNG.choice(part) if RNG.random() < 0.5 else "".join(RNG.choice("xyzé ") for _ in range(30)) for _ in range(3))))
    docs += [(40, None), (41, ""), (42, "short"), (5, docs[5][1]), (None, docs[3][1]), (43, "ab " * 4000), (44, "ab " * 500), (45, part[0] + "\t\n" + part[1])]
    return docs


DOCS = make_docs()


def brute(docs, units, size):
    seen = {}
    big = 1 << 62
    for d, t in docs:
        u = units(t)
        for k in range(len(u) - size + 1):
            w = tuple(u[k : k + size])
            seen[w] = min(seen.get(w, big + 1), big if d is None else d)
    out = []
    for d, t in docs:
        u = units(t)
        mask = [False] * len(u)
        for k in range(len(u) - size + 1):
            if seen[tuple(u[k : k + size])] < (big if d is None else d):
                mask[k : k + size] = [True] * size
        out.append((d, len(u), sum(mask), [x for x, m in zip(u, mask) if not m]))
    return out


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, kept string, slice int")


def test_words(spark):
    got, c = substring.deduplicate(frame(spark, DOCS), size=10)
    rows = got.collect()
    assert got.columns[:4] == ["doc_id", "text", "kept", "slice"] and all(r["kept"] == "x" and r["slice"] == 1 for r in rows)
    key = lambda d, n, x, k: (str(d), n, x, k)
    mine = sorted(key(r["doc_id"], r[c["n_words"]], sum(s["end"] - s["start"] for s in r[c["removed"]]), r[c["kept"]] or "") for r in rows)
    want = sorted(key(d, n, x, b" ".join(k).decode()) for d, n, x, k in brute(DOCS, lambda t: (t or "").encode().split(), 10))
    assert mine == want


@pytest.mark.parametrize("size", [26, 50])
def test_bytes(spark, size):
    got, c = suffixes.deduplicate(frame(spark, DOCS), size=size)
    sha = lambda b: hashlib.sha256(bytes(b)).hexdigest()
    mine = sorted((str(r["doc_id"]), r[c["n_bytes"]], sum(s["end"] - s["start"] for s in r[c["removed"]]), sha(r[c["kept"]])) for r in got.collect())
    want = sorted((str(d), n, x, sha(k)) for d, n, x, k in brute(DOCS, lambda t: (t or "").encode(), size))
    assert mine == want


def test_text_and_empty(spark):
    got, c = suffixes.deduplicate(spark.createDataFrame([(1, "é" * 60), (2, "z" + "é" * 30), (3, None)], "doc_id long, text string"), as_text=True)
    assert {r["doc_id"]: r[c["kept"]] for r in got.collect()} == {1: "é" * 60, 2: "z", 3: None}
    none = frame(spark, [])
    assert suffixes.deduplicate(none)[0].count() == 0 and substring.deduplicate(none)[0].count() == 0


def test_suffix_order():
    import numpy as np

    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, (300, 50)).astype(np.uint8)
    text[100:200] = text[:100]
    text[150:200, 30:] = 98
    order, common = suffixes.suffix_order(text)
    rows = [text[i].tobytes() for i in order]
    assert rows == sorted(rows)
    for k in range(1, len(rows)):
        n = 0
        while n < 50 and rows[k][n] == rows[k - 1][n]:
            n += 1
        assert common[k] == n


def test_windows_of_one_polynomial_hash_stay_apart(spark):
    """A 0/1 Thue-Morse pattern and its complement agree in many low bits of every polynomial hash modulo 2^64."""
    morse = ["ab"[i.bit_count() & 1] for i in range(64)]
    other = ["ba"[i.bit_count() & 1] for i in range(64)]
    docs = [(1, " ".join(morse)), (2, " ".join(other)), (3, " ".join(morse)), (4, " ".join(["c", *other]))]
    found, c = substring.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), size=32, key_bytes=1)
    got = {r["doc_id"]: sum(x["end"] - x["start"] for x in r[c["removed"]]) for r in found.collect()}
    want = {d: n for d, _, n, _ in brute(docs, str.split, 32)}
    assert got == want


@pytest.mark.parametrize("key_bytes", [1, 2])
def test_equal_screens_remove_nothing(spark, key_bytes):
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(300))) for i in range(20)] + [(30, " ".join(f"w3x{k}" for k in range(100, 220)))]
    found, c = substring.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), key_bytes=key_bytes)
    got = {r["doc_id"]: sum(x["end"] - x["start"] for x in r[c["removed"]]) for r in found.collect()}
    assert got == {i: 0 for i in range(20)} | {30: 120}


def test_long_text_of_one_character(spark):
    """Every position of such a text is sampled; equal surroundings are united piece by piece (174 MB in the place of 3.3 GB for 2 MB of text)."""
    from guildspark.llm import suffixes

    docs = spark.createDataFrame([(1, "a" * (3 << 20)), (2, "b" + "a" * 100 + "c"), (3, "a" * 49), (4, None)], "doc_id long, text string")
    found, c = suffixes.deduplicate(docs)
    got = {r["doc_id"]: (r[c["n_bytes"]], [(x["start"], x["end"]) for x in r[c["removed"]]]) for r in found.collect()}
    assert got == {1: (3 << 20, []), 2: (102, [(1, 101)]), 3: (49, []), 4: (0, [])}


def test_pieces_unite_as_one():
    """Distinct rows of pieces, united, are the distinct rows of the whole, in the same order."""
    import numpy as np

    from guildspark.llm import suffixes

    rows = np.random.default_rng(5).integers(0, 2, (500, 5)).astype(np.uint8)
    first, place = suffixes.distinct_rows(rows)
    kept, places, n = [], [], 0
    for at in range(0, 500, 37):
        f, p = suffixes.distinct_rows(rows[at : at + 37])
        kept.append(rows[at : at + 37][f])
        places.append(p + n)
        n += len(f)
    again, where = suffixes.distinct_rows(np.concatenate(kept))
    assert (np.concatenate(kept)[again] == rows[first]).all() and (where[np.concatenate(places)] == place).all()
