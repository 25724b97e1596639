import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from guildspark.llm import sentencepiece_trie as S
from guildspark.llm import token_store as K

RNG = random.Random(3)
ODD = ["", " ", "  a", "a  b", "a ", "a\n b", "x\ty", "日本語 テスト", "   ", "é" * 50, "the<|endoftext|>the", "a" * 3000, " " * 60 + "x" + " " * 37, "I'm don't we'll", "x\r\n\r\n y", " a   b", None]
ODD += ["".join(RNG.choice("abtheinr. \né中'1 ") for _ in range(RNG.randint(0, 60))) for _ in range(500)]


def test_elias_fano():
    for n in (0, 1, 5, 1000):
        for gap in (1, 3, 100_000):
            v = np.cumsum(np.random.default_rng(n).integers(0, gap, n))
            ef = K.EliasFano.from_bytes(K.EliasFano.of(v, int(v[-1]) + 1 if n else 1).to_bytes())
            assert (ef.all() == v).all() and [ef.select(i) for i in range(n)] == v.tolist()


def test_byte_pairs():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    e = K.Encoder(path, limit=50)
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(ODD)] == [t.encode(x or "", add_special_tokens=False).ids for x in ODD]


def test_special_strings_as_the_library_is_loaded(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [*ODD[:80], "a b <|endoftext|> c", "<|endoftext|>", " <|endoftext|><|endoftext|>x  y", "no <|endoftext |> here"]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert want[80] == [64, 275, 220, 50256, 269]
    e = K.Encoder(path, limit=50, special_as_text=False)
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(texts)] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    K.write(df, str(tmp_path / "s"), path, shard_bytes=300, special_as_text=False)
    got = {r["id"]: (r["n_tokens"], r["ids_crc32"]) for r in K.documents(spark, str(tmp_path / "s")).collect()}
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(want)}


def test_wide_and_repeated_ids(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(-(2**63) + 1, "a"), (2**63 - 1, "b"), (5, "c"), (5, "c"), (None, None), (None, "x " * 200_000)]
    K.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "s"), path)
    got = K.documents(spark, str(tmp_path / "s")).collect()
    assert sorted(((r["id"]) for r in got), key=repr) == sorted((i for i, _ in rows), key=repr)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_memory_keeps_what_is_used():
    from guildspark.llm.common import Memory

    m, asked = Memory(3), []

    def make(keys):
        asked.extend(keys)
        return [k.upper() for k in keys]

    for keys in (["a", "b"], ["a", "c"], ["d"], ["a"], ["e", "a"], ["a", "f"]):
        assert m.values(keys, make) == [k.upper() for k in keys]
    assert asked.count("a") == 1 and len(m.young) + len(m.old) <= 8


def test_store(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    docs = [(7 * k % 101, x) for k, x in enumerate(ODD[:90])] + [(3, "twice"), (3, "twice"), (None, "no id")]
    df = spark.createDataFrame([(d, x, 1) for d, x in docs], "doc_id long, text string, part int")
    K.write(df, str(tmp_path / "s"), path, shard_bytes=500)
    got = [tuple(r) for r in K.documents(spark, str(tmp_path / "s")).orderBy("start").collect()]
    want, at = [], 0
    for d, x in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    row = spark.read.parquet(str(tmp_path / "s")).first()
    assert K.document(row, 0)[-1] == 2
    K.write(df.limit(0), str(tmp_path / "e"), path)
    assert K.documents(spark, str(tmp_path / "e")).count() == 0


def test_pieces(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    coded = S.encode(df, path)
    got = {r["id"]: r["ids"] for r in coded.collect()}
    assert got == {i: None if t is None else m.encode(t) for i, t in enumerate(ODD)}
    assert {r["id"]: r["text"] for r in S.decode(coded, path).collect()} == dict(enumerate(ODD))
    assert all(r["same"] for r in S.round_trip(df, path).collect())
    assert S.encode(df.limit(0), path).count() == 0


def test_unigram_is_best():
    pieces = [("▁", -3.0), ("▁a", -2.0), ("ab", -2.5), ("b", -2.2), ("abc", -3.4), ("c", -2.1), ("bc", -2.9), ("▁ab", -3.9), ("a", -2.3)]
    v = S.Vocabulary(pieces, False, {}, 99)

    def brute(w):
        if not w:
            return 0.0
        return max((v.scores.get(w[:k], v.least if k == 1 else float("-inf")) + brute(w[k:]) for k in range(1, len(w) + 1)), default=0.0)

    words = ["▁" + "".join(RNG.choice("abcx") for _ in range(RNG.randint(0, 9))) for _ in range(200)]
    for w, ps in v.encode_words(set(words)).items():
        assert "".join(ps) == w and abs(sum(v.scores.get(p, v.least) for p in ps) - brute(w)) < 1e-9
