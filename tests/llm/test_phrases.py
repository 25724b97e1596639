import random
import re
from collections import Counter, defaultdict

import pytest

from guildspark.llm import phrases


def brute(rows, least, wanted):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lower):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, counts in f.items():
        frequent = {p: c for p, c in counts.items() if c >= least}
        covered = set()
        for p, c in frequent.items():
            for m in range(2, len(p)):
                covered |= {s for i in range(len(p) - m + 1) if 100 * c >= 100 * frequent[s := p[i : i + m]]}
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and p not in covered:
                cuts = [(1000 * a * n[lang] // (frequent[p[:k]] * frequent[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p), frequent[p[:k]], frequent[p[k:]]))
        found.sort(key=lambda r: (r[0], r[1], r[2].encode()))
        out |= {(lang, i + 1, p, -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(found[:wanted])}  # noqa: E741
    return out


def documents(seed, size=260):
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdefghé')}{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    fixed = [" ".join(rng.choices(words, k=rng.randint(2, 7))) for _ in range(12)]
    rows = []
    for _ in range(size):
        parts = []
        for _ in range(12):
            parts += [rng.choice(fixed)] if rng.random() < 0.4 else rng.choices(words, weights, k=3)
            parts += [rng.choice([".", "!\n", " ", "\t", ",,"])] if rng.random() < 0.4 else []
        rows.append((rng.choice(["en", "en", "en", "de", None]), " ".join(parts).replace("a", "A")))
    return rows + [("en", None), (None, ""), ("fr", "one two"), ("fr", " ; \t"), ("en", rows[0][1])] + [("en", rows[1][1])] * 30 + [("la", "ora et labora ora et labora " * 2000), ("la", "w" * 50000)]


@pytest.mark.parametrize(("least", "wanted", "share"), [(8, 15, 0.02), (20, 2000, 0.3)])
def test_against_brute_force(spark, least, wanted, share):
    rows = documents(least)
    df = spark.createDataFrame([(la, t, "x", 3) for la, t in rows], "lang string, text string, key string, n int")
    found = phrases.collocations(df, least=least, wanted=wanted, share=share)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in found.collect()]
    assert set(got) == brute(rows, least, wanted) and len(got) == len(set(got))


def test_full_filter_and_empty_tables(spark):
    """A filter whose bits are all set lets everything pass, and only the counts decide."""
    rows = documents(5, 60)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in phrases.collocations(df, least=10, wanted=30, filter_bits=64).collect()} == brute(rows, 10, 30)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df.where("text is null")).count() == 0


def test_frontier_stops_at_the_bound(spark):
    """With rare pairs that score high, the frequent first words of the language are never grown."""
    rows = [("en", " ".join(["the"] * 50 + [f"x{i}", f"y{i}"] * 6) + " .") for i in range(30) for _ in range(2)]
    df = spark.createDataFrame(rows, "lang string, text string")
    search = phrases.Search(spark, df, "text", "lang", 10, 10, 1 << 16)
    found = search.run(0.05).collect()
    assert search.limits.first()["most"] < 100
    want = sorted((r[7] for r in brute(rows, 10, 10)), reverse=True)
    assert sorted((r["score"] for r in found), reverse=True)[:10] == want
