import random
import re
import zlib
from collections import Counter

from guildspark.llm import spelling


def brute_words(rows, length=5, count=3):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += len(w) >= length
    return {w: n for w, n in total.items() if n >= count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    out = {}
    for w, n in words.items():
        near = sorted((x for x in words if is_near(w, x)), key=lambda x: (-words[x], x))
        out[w] = (near[0] if near and words[near[0]] >= 2 * n else None, len(near))
    rows = set()
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, words[w], n_near, words[form] if form else None))
    return rows


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def documents(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aéB") for _ in range(rng.randint(4, 7))) for _ in range(120)] + ["ÿÿÿÿÿ", "ÿÿÿÿÿÿ", "aaaaaa", "aaaaa", "x" * 3000, "x" * 3001, "×÷×÷×"]
    text = lambda: rng.choice([" ", ", ", "1"]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=80))
    return [(i, text()) for i in range(60)] + [(None, text()), (3, None), (4, ""), (5, " ".join(words * 3)), (5, " ".join(words * 3)), (6, "ABBAA abbaa " * 20000)]


def test_against_brute_force(spark):
    rows = documents(1)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    found = spelling.variants(df)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(brute_words(rows))
    assert len(want) > 60 and sum(r[1] is not None for r in want) > 10
    assert rows_of(found) == want and found.count() == len(want)
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.variants(df.where("text is null")).count() == 0


def test_crowded_pieces_are_cut(spark):
    """More words under a piece than a task may index: the pieces are cut down to one open place."""
    rng = random.Random(2)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))): rng.randint(3, 50) for _ in range(600)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3).cache()
    want = {(w, sum(is_near(w, x) for x in words)) for w in words}
    for dense in (2, 20):
        got = spelling.near_words(df, dense=dense).collect()
        assert {(r["word"], r["n_near"]) for r in got} == {x for x in want if x[1]} and len(got) == sum(x[1] > 0 for x in want)


def test_block_recurrence():
    import numpy as np

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([5, 6]))) for _ in range(150)})
    letters = np.array([list(w.encode().ljust(6, b"\0")) for w in words], np.uint8)
    a, b = spelling.near_in_block(letters, np.array([len(w) for w in words]), 5)
    got = [(words[i], words[j]) for i, j in zip(a, b, strict=True)]
    assert len(set(got)) == len(got)
    assert set(got) == {(x, y) for x in words for y in words if len(x) == 5 and is_near(x, y)}


def test_roots_of_a_long_chain(spark):
    n = 37
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(n)] + [("side", "w30")]
    got = {(r["word"], r["root"]) for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {(w, f"w{n}") for w, _ in chain}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0
