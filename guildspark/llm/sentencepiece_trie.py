"""SentencePiece encoding and decoding with a forward pass shared by common prefixes.

A text is marked (a space becomes the mark, one is put in front) and cut into marked words: no piece of
the vocabulary holds a mark after another character, so words are encoded alone. The distinct words of
a batch are sorted, which is a depth-first walk of their trie: the forward state of the prefix that a
word shares with the one before stays, and only the rest is computed.

Forward state of a prefix: its best score and last piece (Viterbi), over the pieces that end there, found
in a trie of the pieces read backwards. In a unigram vocabulary every piece is an arc. In a BPE vocabulary
the best sum of scores over all arcs would not be the merges' result: there a piece is an arc only if it
and the last piece before it stay two pieces when merged together. One arc is left for each prefix, as its
encoding is unique, and the forward scores along them are those of the merges' own pieces.

Defined results: a null text has null ids (empty: none); the mark itself in a text decodes to a space;
characters outside the vocabulary become bytes if it has byte pieces, else the unknown id."""

from __future__ import annotations

import heapq
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, gather, held, map_texts, record_batch, split_on_spaces

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
INNER_MARK = re.compile(f"[^{MARK}]{MARK}")


class Vocabulary:
    """Pieces with scores; bpe tells how scores are used."""

    def __init__(self, pieces: list[tuple[str, float]], bpe: bool, byte_ids: dict[int, int], unknown: int, ids: list[int] | None = None, dummy_prefix: bool = True):
        ids = list(range(len(pieces))) if ids is None else ids
        self.ids = {p: i for (p, _), i in zip(pieces, ids, strict=True)}
        self.scores = dict(pieces)
        self.bpe, self.byte_ids, self.unknown, self.dummy_prefix = bpe, byte_ids, unknown, dummy_prefix
        self.longest = max(map(len, self.ids), default=1)
        self.least = min(self.scores.values(), default=0.0) - 10
        self.words_alone = not any(INNER_MARK.search(p) for p in self.ids)
        self.endings = self._endings()
        self.meet: dict[str, dict[str, bool]] = {}
        self.met = 0
        self.own: dict[str, bool] = {}
        self.raw = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in byte_ids.items()} | {unknown: b"\xef\xbf\xbd"}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only vocabularies without text normalisation are supported")
        plain = [(i, p) for i, p in enumerate(m.pieces) if p.type in (1, 4)]
        unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        return cls([(p.piece, p.score) for _, p in plain], m.trainer_spec.model_type == 2, {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}, unknown, [i for i, _ in plain], m.normalizer_spec.add_dummy_prefix)

    def merged(self, text: str) -> list[str]:
        """BPE by its merges: the adjacent pair with the best score first, the left one among equals."""
        parts, scores = list(text), self.scores
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(-scores[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in scores]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if parts[i] else len(parts)
            if j >= len(parts) or len(parts[i]) + len(parts[j]) != len(p):
                continue
            parts[i], parts[j] = p, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                if (q := p + parts[after[i]]) in scores:
                    heapq.heappush(heap, (-scores[q], i, q))
            if before[i] >= 0 and (q := parts[before[i]] + p) in scores:
                heapq.heappush(heap, (-scores[q], before[i], q))
        return [p for p in parts if p]

    def follows(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart when their text is merged."""
        after = self.meet.get(left)
        if after is None:
            after = self.meet[left] = {}
        if (known := after.get(right)) is None:
            if self.met > 2_000_000:
                self.meet.clear()
                after, self.met = self.meet.setdefault(left, {}), 0
            self.met += 1
            known = after[right] = left + right not in self.scores and (len(left) + len(right) == 2 or self.merged(left + right) == [left, right])
        return known

    def stands(self, piece: str) -> bool:
        """Whether merging its characters gives the piece."""
        if (known := self.own.get(piece)) is None:
            known = self.own[piece] = self.merged(piece) == [piece]
        return known

    def ids_of(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        if self.byte_ids:
            return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def encode_words(self, words) -> dict[str, list[str]]:
        """The pieces of distinct words, walked in sorted order so that shared prefixes are computed once."""
        out, last, start, best = {}, "", [0], [0.0]
        step = self._step
        for w in sorted(words):
            if self.bpe and w[:2] == MARK * 2:  # runs of marks have equal scores, where order decides
                out[w] = self.merged(w)
                continue
            keep, most = 0, min(len(w), len(last))
            while keep < most and w[keep] == last[keep]:
                keep += 1
            del start[keep + 1 :], best[keep + 1 :]
            for end in range(keep + 1, len(w) + 1):
                step(w, end, start, best)
            last, pieces, at = w, [], len(w)
            while at:
                pieces.append(w[start[at] : at])
                at = start[at]
            out[w] = pieces[::-1]
        return out

    def _endings(self) -> dict:
        """The pieces as a trie read from their last character; a node's piece is under the empty key."""
        root: dict = {}
        for p in self.ids:
            node = root
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        return root

    def _step(self, w: str, end: int, start: list, best: list) -> None:
        """The forward score of w[:end]: the best of the arcs that end there, each the score of the prefix before a
        piece plus the piece's own. In a BPE vocabulary an arc counts only if its piece stays apart from the last
        piece before it; one arc does, and the search ends with it."""
        choice, at, s = None, 0, end
        node, scores, bpe = self.endings, self.scores, self.bpe
        while s:
            s -= 1
            node = node.get(w[s])
            if node is None:
                if s < end - 1:
                    break
                p, node = w[s], {}  # a character that is no piece
            elif (p := node.get("")) is None:
                if s < end - 1:
                    continue
                p = w[s]
            if bpe:
                if (s < end - 1 and not self.stands(p)) or (s and not self.follows(w[start[s] : s], p)):
                    continue
                best.append(best[s] + scores.get(p, self.least))
                start.append(s)
                return
            score = best[s] + scores.get(p, self.least)
            if choice is None or score > choice:
                choice, at = score, s
        if choice is None:
            raise AssertionError(w)
        best.append(choice)
        start.append(at)


#: Texts that a worker encodes at a time; one longer text is encoded alone.
SLICE_BYTES = 1 << 20


class Codec:
    """Encodes and decodes texts with a bounded memory of words' ids. Over 67 MB of Parquet a worker's peak was 282 MB with 60,000
    words a generation and slices of 1 MB of text, and 456 MB with 200,000 and 8 MB."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 150_000):
        self.v, self.known, self.coded = vocabulary, Memory(limit), {}
        raw = vocabulary.raw
        self.spelled = pa.array([raw.get(i, b"") for i in range(max(raw, default=-1) + 1)] + [b""], pa.large_binary())

    def words(self, text: str) -> list[str]:
        """Marked words; one that has a single mark in front comes without it."""
        marked = ((" " if self.v.dummy_prefix else "") + text).replace(" ", MARK)
        if not self.v.words_alone:
            return [MARK + marked]
        return [w[1:] if w[0] == MARK and w[1:2] not in ("", MARK) else MARK + w for w in WORD.findall(marked)]

    def _of_words(self, words: list[str]) -> list[bytes]:
        # a leading mark beside others is doubled by words(): it stands for a word that keeps its own marks
        full = [w[1:] if w[:1] == MARK else MARK + w for w in words]
        found = self.v.encode_words(set(full))
        coded = self.coded
        for p in set(itertools.chain.from_iterable(found.values())).difference(coded):
            coded[p] = np.array(self.v.ids_of(p), "<i4").tobytes()
        out = [b"".join(map(coded.__getitem__, found[w])) for w in full]
        if len(coded) > 1_000_000:  # characters that are no pieces
            coded.clear()
        return out

    def _joined(self, flat: pa.DictionaryArray, starts: np.ndarray) -> tuple[bytes, np.ndarray]:
        words = flat.dictionary.to_pylist()
        some = [w for w in words if w]
        made = dict(zip(some, self.known.values(some, self._of_words), strict=True))
        data, ends = gather([made[w] if w else b"" for w in words], flat.indices.to_numpy())
        return data, np.concatenate(([0], ends))[starts[1:]]

    def encode_joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's end."""
        texts = texts.fill_null("")
        odd = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False)
        if self.v.words_alone and self.v.dummy_prefix:  # single spaces part words; all else is marked and cut by pattern
            for p in ("  ", MARK):
                odd = odd | pc.match_substring(texts, p).to_numpy(zero_copy_only=False)
            odd = odd | pc.starts_with(texts, " ").to_numpy(zero_copy_only=False) | pc.ends_with(texts, " ").to_numpy(zero_copy_only=False)
        else:
            odd[:] = True
        if not odd.any():
            data, ends = self._joined(*split_on_spaces(texts))
            return np.frombuffer(data, "<i4"), ends // 4
        out: list = [b""] * len(texts)
        for rows in (np.flatnonzero(~odd), np.flatnonzero(odd)):
            some = texts.take(pa.array(rows))
            if odd[rows].any():
                cut = [self.words(t) if t else [] for t in some.to_pylist()]
                data, ends = self._joined(pa.array([w for x in cut for w in x], pa.string()).dictionary_encode(), np.cumsum([0, *map(len, cut)]))
            else:
                data, ends = self._joined(*split_on_spaces(some))
            for i, a, b in zip(rows.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[i] = data[a:b]
        return np.frombuffer(b"".join(out), "<i4"), np.cumsum(np.fromiter(map(len, out), np.int64, len(out))) // 4

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        ids, ends = self.encode_joined(pa.array(texts, pa.string()))
        return [None if t is None else ids[a:b] for t, a, b in zip(texts, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def decode_joined(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids that lie in one array; an id without a spelling (a control one) adds nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.spelled) - 1), ids, len(self.spelled) - 1)
        data, byte_ends = gather(self.spelled, ids)
        at = np.concatenate(([0], byte_ends))[np.concatenate(([0], ends))].tolist()
        cut = 1 if self.v.dummy_prefix else 0
        return [data[a + (cut if data[a : a + 1] == b" " and b > a else 0) : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids) -> str | None:
        return None if ids is None else self.decode_joined(np.asarray(ids, np.int64), np.array([len(ids)]))[0]


def codec(path: str) -> Codec:
    return held(("sentencepiece", path), lambda: Codec(Vocabulary.load(path)))


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, ids array<int>)."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        ids, ends = codec(vocabulary).encode_joined(texts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()), mask=texts.is_null())
        return pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "ids"])

    return map_texts(docs, {"id": F.col(doc_id).cast("long"), "text": F.col(text)}, "id long, ids array<int>", per_batch, SLICE_BYTES)


def decode(encoded: DataFrame, vocabulary: str, doc_id: str = "id", ids: str = "ids") -> DataFrame:
    """Rows (id, text)."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary)
        return record_batch(schema, id=batch.column("id"), text=[c.decode(x) for x in batch.column("ids").to_pylist()])

    return map_texts(encoded, {"id": F.col(doc_id).cast("long"), "ids": F.col(ids)}, "id long, text string", per_batch, SLICE_BYTES)


def round_trip(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: id, n_ids, ids_crc32 (little-endian 32-bit ids), decoded, same."""
    schema = pa.schema([("id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded", pa.string()), ("same", pa.bool_())])

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, texts = codec(vocabulary), batch.column("text")
        ids, ends = c.encode_joined(texts)
        valid = texts.is_valid().to_pylist()
        decoded = [t if v else None for t, v in zip(c.decode_joined(ids, ends), valid, strict=True)]
        bounds = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        return record_batch(schema, id=batch.column("id"), n_ids=[b - a for a, b in bounds], ids_crc32=[zlib.crc32(ids[a:b].tobytes()) for a, b in bounds], decoded=decoded, same=[a == b for a, b in zip(texts.to_pylist(), decoded, strict=True)])

    return map_texts(docs, {"id": F.col(doc_id).cast("long"), "text": F.col(text)}, "id long, n_ids long, ids_crc32 long, decoded string, same boolean", per_batch, SLICE_BYTES)
