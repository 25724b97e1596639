import random

import numpy as np
from pyspark.sql import functions as F

from guildspark.llm import chroma, toxicity

RNG = random.Random(5)
CLEAN = ["".join(RNG.choice(["th", "er", "ing", "on", "es", "ha", "nd", "re"]) for _ in range(RNG.randint(1, 4))) for _ in range(400)]
BAD = ["idiot", "moron", "stupid"]


def text(toxic, n=60):
    w = [RNG.choice(CLEAN) for _ in range(n)]
    for _ in range(3 if toxic else 0):
        w[RNG.randrange(n)] = RNG.choice(BAD)
    return " ".join(w)


def test_held_out(spark):
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9999, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, usable=F.col("doc_id") % 5 != 0)
    got = {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    wrong = [i for i, _, y in rows if i % 5 == 0 and (got[i] >= 0.3) != bool(y)]
    assert len(wrong) <= 2
    odd = [None, "", "...", text(False) + " id-iot mor.on", text(False) + " idiiot stupiid", text(False, 20_000)]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(odd)], "doc_id long, text string, score double")
    s = [r["s"] for r in toxicity.with_score(frame, model, name="s").orderBy("doc_id").collect()]
    assert all(0 <= x <= 1 for x in s) and max(s[:3]) < 0.3 and min(s[3:5]) >= 0.3 and s[5] < 0.3
    assert toxicity.score(frame.limit(0), model).count() == 0
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(frame, none).agg(F.max("score")).first()[0] < 0.3


def test_kernel_matches_definition():
    k = toxicity.Kernel("abc")

    def phi(w):
        s = [toxicity.START, *[k.code.get(c, toxicity.OTHER) for c in w], toxicity.STOP]
        out = {}
        for a in range(len(s)):
            for b in range(a + 1, len(s)):
                for c in range(b + 1, len(s)):
                    if c - a < toxicity.SPAN:
                        u = (s[a], s[b], s[c])
                        out[u] = out.get(u, 0) + toxicity.DECAY ** (c - a + 1)
        return out

    words = ["abc", "aabbcc", "xyz", "a", "cabacabac"]
    mark = phi("abca")
    weights = np.zeros(toxicity.ALPHABET**3, np.float32)
    for (a, b, c), x in mark.items():
        weights[(a * toxicity.ALPHABET + b) * toxicity.ALPHABET + c] = x
    for w, v in zip(words, k.values(words, weights)):
        p = phi(w)
        assert abs(v - sum(x * mark.get(u, 0) for u, x in p.items()) / np.sqrt(sum(x * x for x in p.values()))) < 1e-4


def test_rectangles():
    image = np.random.default_rng(1).random((30, 12))
    got = chroma.integers(image)
    assert len(got) == 15
    kind, y, h, w = chroma.filters()[1]
    for t in (0, 7, 14):
        top, low = image[t : t + w, y + h // 2 : y + h].sum(), image[t : t + w, y : y + h // 2].sum()
        level = int(np.searchsorted([-0.25, 0, 0.25], np.log1p(top) - np.log1p(low)))
        assert (int(got[t]) >> 28) & 3 == [0, 1, 3, 2][level]


def test_align(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 64))
    a = chroma.read_wav(chroma.melody(v[0]))[1]
    late = chroma.write_wav(np.concatenate((np.zeros(5 * chroma.HOP), a)), 4096)
    rows = [(i, chroma.melody(x)) for i, x in enumerate(v)] + [(100, late), (101, chroma.melody(v[0])), (102, chroma.melody(v[3] + rng.normal(size=64) * 0.03)), (103, None), (104, b""), (105, chroma.melody(v[4][:2])), (7, chroma.melody(v[7])), (None, chroma.melody(v[8]))]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "rec_id long, audio binary, ints int")
    prints = chroma.fingerprints(df, "audio", "rec_id")
    got = {}
    for r in chroma.align(prints, F.col("id").isin(0, 102, 103, 9)).collect():
        got[r["id"]] = r
    assert len(got) == len({i for i, _ in rows})
    assert got[0]["best_id"] == 100 and got[0]["best_offset"] == 5 and got[101]["class_id"] == 0
    assert got[102]["best_id"] == 3 and got[102]["best_errors"] < 0.2
    assert got[9]["n_matches"] == 0 and got[103]["n_ints"] == 0 and got[5]["n_matches"] is None
    assert chroma.align(chroma.fingerprints(df.limit(0), "audio", "rec_id"), F.lit(True)).count() == 0


def test_align_judges_tied_offsets(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**31), 2**31, 30)
    late = np.concatenate((rng.integers(-(2**31), 2**31, 10), base ^ 1))
    late[10:12] = base[0:2]  # one equal pair at the true offset 10 ...
    late[5:7] = base[5:7]  # ... and one by chance at offset 0
    short, noisy = base[:4].copy(), base[:4].copy()
    noisy[3] ^= 1
    rows = [(i, [int(v) for v in x]) for i, x in enumerate((base, late, short, noisy))]
    prints = spark.createDataFrame(rows, "id long, ints array<int>")
    got = {r["id"]: r for r in chroma.align(prints.where("id < 2"), F.lit(True)).collect()}
    assert (got[0]["best_id"], got[0]["best_offset"], got[0]["n_matches"]) == (1, 10, 1)
    got = {r["id"]: r for r in chroma.align(prints.where("id >= 2"), F.lit(True)).collect()}
    assert got[2]["best_id"] == 3 and abs(got[2]["best_errors"] - 1 / 128) < 1e-6


def _links(prints, most=0.2, least=8):
    """All pairs at all offsets: (a, b) -> least share of differing bits."""
    out = {}
    for a, x in prints.items():
        for b, y in prints.items():
            if a >= b or not len(x) or not len(y):
                continue
            enough = min(least, len(x), len(y))
            for k in range(enough - len(x), len(y) - enough + 1):
                n = min(len(x) - max(0, -k), len(y) - max(0, k))
                e = np.bitwise_count(x[max(0, -k) :][:n] ^ y[max(0, k) :][:n]).sum() / (32 * n)
                if e <= most and e < out.get((a, b), 1):
                    out[a, b] = e
    return out


def test_align_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    vectors = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").limit(40).collect()]
    rows = [(i, chroma.melody(v)) for i, v in vectors]
    near = []
    for k in range(30):  # near copies: one with a few other notes, and one that starts later
        v = np.array(vectors[k][1], float)
        v[rng.integers(0, 64, 1 + k % 4)] *= -1
        near.append((1000 + k, chroma.melody(v)))
        sound = chroma.read_wav(rows[k][1])[1]
        near.append((2000 + k, chroma.write_wav(sound[chroma.HOP * (3 + k % 5) :], 4096)))
    prints = chroma.fingerprints(spark.createDataFrame(rows + near, "rec_id long, audio binary"), "audio", "rec_id")
    ints = {r["id"]: np.array(r["ints"], np.int32).view(np.uint32) for r in prints.collect()}
    true = _links(ints)
    got = {r["id"]: r for r in chroma.align(prints, F.lit(True)).collect()}
    grouped = {}
    for i, r in got.items():
        grouped.setdefault(r["group_id"], []).append(i)
    partners = {}
    for a, b in true:
        partners.setdefault(a, set()).add(b)
        partners.setdefault(b, set()).add(a)
    for own in grouped.values():  # a group is connected by links
        reached = {own[0]}
        while more := {j for i in reached for j in partners.get(i, ()) if j in own} - reached:
            reached |= more
        assert reached == set(own)
    copies = [i for i in partners if any(abs(len(ints[i]) - len(ints[j])) < 12 for j in partners[i])]
    found = [i for i in copies if got[i]["best_id"] in partners[i]]
    assert len(copies) >= 60 and len(found) >= 0.9 * len(copies)
    assert not [i for i in got if got[i]["n_near"] + got[i]["n_matches"] and i not in partners]
    # the best is the best of the recordings compared, with its own share of differing bits
    for i in found:
        x, y, k = ints[i], ints[got[i]["best_id"]], got[i]["best_offset"]
        n = min(len(x) - max(0, -k), len(y) - max(0, k))
        assert abs(got[i]["best_errors"] - np.bitwise_count(x[max(0, -k) :][:n] ^ y[max(0, k) :][:n]).sum() / (32 * n)) < 1e-6
        assert min(true[min(i, j), max(i, j)] for j in partners[i]) - 1e-6 <= got[i]["best_errors"] <= 0.2


def test_align_finds_links_without_an_equal_integer_and_at_every_offset(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**32, 40, dtype=np.uint32)
    noisy = base ^ np.uint32(5)  # an error in every integer
    late = np.concatenate((rng.integers(0, 2**32, 13, dtype=np.uint32), base[:27] ^ np.uint32(9)))
    tail = np.concatenate((base[32:] ^ np.uint32(1), rng.integers(0, 2**32, 60, dtype=np.uint32)))  # an overlap of eight
    prints = {0: base, 1: noisy, 2: late, 3: tail} | {10 + i: rng.integers(0, 2**32, 20 + 7 * (i % 6), dtype=np.uint32) for i in range(30)}
    true = _links(prints)
    assert {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)} <= set(true)
    table = spark.createDataFrame([(i, x.view(np.int32).tolist()) for i, x in prints.items()], "id long, ints array<int>")
    got = {r["id"]: r for r in chroma.align(table, F.lit(True)).collect()}
    assert (got[0]["group_id"], got[1]["group_id"], got[0]["n_near"], got[2]["n_near"]) == (0, 0, 1, 0)
    for i in prints:
        partners = {(set(p) - {i}).pop(): e for p, e in true.items() if i in p}
        assert got[i]["n_matches"] == len({got[j]["group_id"] for j in partners} - {got[i]["group_id"]})
        assert got[i]["best_errors"] == (round(min(partners.values()), 6) if partners else None)


def test_align_of_a_large_group_stays_linear(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-(2**31), 2**31, 100)
    rows = []
    for i in range(400):
        x = base.copy()
        x[rng.integers(0, 100, 15)] = rng.integers(-(2**31), 2**31, 15)  # some 7 % of the bits, 14 % between two copies
        rows.append((i, [int(v) for v in x.astype(np.int64)]))
    rows += [(1000 + i, [int(v) for v in rng.integers(-(2**31), 2**31, 100)]) for i in range(40)] + [(5000, []), (5001, [])]
    prints = spark.createDataFrame(rows, "id long, ints array<int>")
    got = {r["id"]: r for r in chroma.align(prints, F.col("id") % 20 == 0).collect()}
    assert len(got) == len(rows)
    assert {got[i]["group_id"] for i in range(400)} == {0} and {got[i]["n_near"] for i in range(400)} == {399}
    assert all(got[1000 + i]["group_id"] == 1000 + i and not got[1000 + i]["n_matches"] for i in range(40))
    assert got[5000]["n_near"] == 0 and got[5000]["n_matches"] == 0 and got[5000]["class_id"] == 5000


def test_characters_without_a_class_of_their_own():
    """Words of a script that the sample lacks stay distinct, and similar ones stay similar."""
    kernel = toxicity.Kernel("abcdefgh")
    phi, _ = kernel.vectors(["привет", "приввет", "дракон", "abc"])
    near = phi @ phi.T
    assert near[0, 1] > 0.6 and near[0, 2] < 0.3 and near[0, 3] < 0.3
    assert max(kernel.subsequences(["привет", "дракон"])[0].ravel()) < toxicity.ALPHABET**3


def test_held_out_rows_of_a_larger_table(spark):
    """Frequent words that stand a little more often in toxic documents must not hide the insults."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.train(docs, labels, usable=~held_out)
    judged = labels.where(held_out).where("toxic in (0, 1)").select("doc_id", "toxic").join(docs, "doc_id")
    scored = toxicity.with_score(judged, model, name="score").select("toxic", (F.col("score") >= 0.3).alias("told")).groupBy("toxic", "told").count().collect()
    n = {(r["toxic"], r["told"]): r["count"] for r in scored}
    assert n[1, True] >= 0.85 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.05 * (n[0, False] + n.get((0, True), 0))


def test_near_pairs_are_ruled_out_by_sums_and_none_is_lost(spark, monkeypatch):
    rng = np.random.default_rng(21)
    for n in (1, 3, 4, 30, 110):
        base = rng.integers(0, 2**32, (40, n), dtype=np.uint32)
        rows = [base]
        for errors in range(0, 32 * n // 4, max(1, n // 3)):  # up to a quarter of the bits, some at the threshold
            x = np.unpackbits(base[errors % 40].view(np.uint8))
            x[rng.permutation(32 * n)[:errors]] ^= 1
            rows.append(np.packbits(x).view(np.uint32)[None])
        exact = base[:1].copy()
        for bit in range(32 * n // 5):
            exact[0, bit // 32] ^= np.uint32(1 << (bit % 32))
        every = np.concatenate((*rows, exact, base[:3]))
        wrong = np.bitwise_count(every[:, None] ^ every[None]).sum(axis=2)
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(wrong <= 0.2 * 32 * n), strict=True)}
        for step in (7, 512):
            monkeypatch.setattr(chroma, "HELD", step * 32 * n)
            for same in (False, True):
                got = {(int(a), int(b)) for part in chroma._near(every.view(np.int32), every.view(np.int32), 0.2, same) for a, b in zip(*part, strict=True)}
                assert got | {(b, a) for a, b in got} == want and (same or got == want)
        monkeypatch.undo()
    judged = []
    count = np.bitwise_count
    # recordings whose bits change slowly, as chroma's do: few pairs are compared bit by bit
    slow = np.repeat(rng.integers(0, 2**32, (400, 28), dtype=np.uint32), 4, axis=1).view(np.int32)
    monkeypatch.setattr(chroma.np, "bitwise_count", lambda x: judged.append(len(x)) or count(x))
    assert {(int(a), int(b)) for part in chroma._near(slow, slow, 0.2) for a, b in zip(*part, strict=True)} == {(i, i) for i in range(400)}
    assert 400 <= sum(judged) < 1600


def test_bits_of_near_pairs_are_counted_without_a_sign():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.integers(0, 2**32, (400, 7), dtype=np.uint32), 4, axis=1)  # slow, so that few pairs are compared bit by bit
    x[1] = x[0] ^ np.uint32(2**31 + 1)  # two bits of each integer differ, the highest among them
    x[3] = x[2] ^ np.uint32(2**32 - 1)  # all bits differ
    found = {(int(a), int(b)) for part in chroma._near(x.view(np.int32), x.view(np.int32), 0.2) for a, b in zip(*part, strict=True)}
    assert found == {(i, i) for i in range(400)} | {(0, 1), (1, 0)}


def test_two_offsets_at_once_lose_no_alignment(monkeypatch):
    """Slow signals of mixed lengths: what is judged by the bound equals what every offset says."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    slow = lambda n: np.repeat(rng.integers(0, 2**32, n // 5 + 1, dtype=np.uint32), 5)[:n]
    prints = [slow(int(n)) for n in np.repeat([16, 17, 24, 40, 41], 16)]
    for k in range(60):  # parts of others with errors near the threshold, at either end
        x = prints[k]
        s = int(rng.integers(0, max(1, len(x) - 8)))
        c = x[s:] ^ np.packbits(rng.random((len(x) - s, 32)) < (0, 0.1, 0.19, 0.21)[k % 4], axis=1).view(np.uint32)[:, 0]
        prints.append(np.concatenate((c, slow(s)) if k % 2 else (slow(s), c)))
    true = _links(dict(enumerate(prints)))
    compared = []
    exact = chroma._Offsets.exact
    monkeypatch.setattr(chroma._Offsets, "exact", lambda self, x, y, rows, cols, f: compared.append(len(f)) or exact(self, x, y, rows, cols, f))
    found, share = [], {"key": pa.int64(), "center": pa.int64(), "id": pa.int64(), "ints": pa.list_(pa.int32())}
    table = lambda chosen: pa.table({name: pa.array([prints[i].view(np.int32).tolist() if name == "ints" else i for i in chosen], t) for name, t in share.items()})
    for n in (16, 17, 24, 40, 41):
        found += chroma._aligned(8, 0.2)(table([i for i, x in enumerate(prints) if len(x) == n]), table(range(len(prints)))).to_pylist()
    pairs = lambda r: (min(r["query"], r["o"]), max(r["query"], r["o"]))
    assert {pairs(r) for r in found} == set(true) and len(true) > 20 and sum(compared) > 0
    assert all(abs(r["errors"] - true[pairs(r)]) < 1e-9 for r in found)


def test_a_tile_transforms_its_classes_once(monkeypatch):
    """Several blocks of queries share the transforms, unless they are too many to keep; errors are those of all offsets, one by one."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    prints = [np.repeat(rng.integers(0, 2**32, n // 4 + 1, dtype=np.uint32), 4)[:n] for n in [41] * 300 + [38] * 20]
    for k in range(20):
        prints[300 + k][: 9 + k] = prints[k][32 - k :]
    ids = pa.array(range(320), pa.int64())
    table = pa.table({"key": ids, "center": ids, "id": ids, "ints": pa.array([x.view(np.int32).tolist() for x in prints], pa.list_(pa.int32()))})
    asked, seen = chroma._Offsets.asked, []
    monkeypatch.setattr(chroma._Offsets, "asked", lambda self, y: seen.append(len(y)) or asked(self, y))
    rows = chroma._aligned(8, 0.2)(table.slice(0, 300), table.slice(300)).to_pylist()
    assert sum(seen) == 20
    monkeypatch.setattr(chroma, "ASKED", 0)
    assert chroma._aligned(8, 0.2)(table.slice(0, 300), table.slice(300)).to_pylist() == rows and sum(seen) == 60
    assert {(k, 300 + k, 0.0, k - 32) for k in range(20)} <= {(r["query"], r["o"], r["errors"], r["offset"]) for r in rows}
    for d in range(-33, 31):
        n, i, j = int(min(41 - max(0, -d), 38 - max(0, d))), max(0, -d), max(0, d)
        two = chroma._Offsets(41, 38, 8, 1.0)
        row, col, at, size, wrong = two.exact(np.stack(prints[:3]), np.stack(prints[300:303]), np.array([0, 1, 2]), np.array([2, 0, 1]), np.full(3, d // 2))
        own = {(int(a), int(b), int(s)): int(w) for a, b, k, s, w in zip(row, col, at, size, wrong, strict=True) if k == d}
        assert own == {(a, b, n): int(np.bitwise_count(prints[a][i : i + n] ^ prints[300 + b][j : j + n]).sum()) for a, b in ((0, 2), (1, 0), (2, 1))}
