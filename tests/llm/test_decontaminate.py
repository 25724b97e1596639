import re

from guildspark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size):
    pats = {}
    for i, t in items:
        w = words(t)
        if w:
            for k in range(max(1, len(w) - size + 1)):
                pats.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for p, i in pats.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    ids |= i
        out.append((d, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=repr)


DOCS = [(0, "Alpha beta, GAMMA delta! epsilon"), (1, None), (2, ""), (3, "né à the b a b a b a"), (3, "né à the b a b a b a"), (None, "alpha beta gamma"), (5, "xalpha beta gammax"), (6, "... --- ..."), (7, "beta alpha " * 4000 + "alpha beta gamma")]
ITEMS = [(1, "alpha beta gamma"), (2, "b a b a"), (3, None), (4, "??"), (5, "Né"), (6, "ALPHA-beta.gamma"), (None, "delta epsilon")]


def check(spark, **more):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in DOCS], "doc_id long, text string, n_words int, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.find(docs, items, window=3, **more).collect()
    want = brute(DOCS, [(-1 if i is None else i, t) for i, t in ITEMS], 3)  # words of an item without id count as hit, the item isn't named
    assert sorted(((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got), key=repr) == sorted(((d, n, h, tuple(x for x in i if x >= 0)) for d, n, h, i in want), key=repr)
    first = next(r for r in got if r["id"] == 0)
    assert [DOCS[0][1][s["start"] : s["end"]] for s in first["spans"]] == ["Alpha beta, GAMMA delta! epsilon"]


def test_brute(spark):
    check(spark)


def test_blocks(spark):
    check(spark, max_pattern_bytes=10)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in decontaminate.find(one, items).collect()] == [(1, 2, 0)]


def test_without_in_blocks(spark):
    """Rows are kept and dropped alike however many blocks the patterns make, null and repeated ids included."""
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in DOCS], "doc_id long, text string, n_words int, `row` string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = [sorted(map(tuple, decontaminate.without(docs, items, most_hit=0.3, window=3, max_pattern_bytes=b).collect()), key=repr) for b in (1 << 20, 10)]
    want = [(d, t) for (d, t), r in zip(DOCS, [next(x for x in brute([row], [(-1 if i is None else i, t) for i, t in ITEMS], 3)) for row in DOCS], strict=True) if not (r[2] and r[2] >= 0.3 * r[1])]
    assert kept[0] == kept[1] == sorted(((d, t, 1, "x") for d, t in want), key=repr) and 0 < len(want) < len(DOCS)
