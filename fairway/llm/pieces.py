"""SentencePiece encoding and decoding over a trie of distinct marked words.

A text becomes marked text (one mark in front, every space a mark) and is cut in front of each run
of marks that follows another character. No piece of the vocabulary crosses such a place, so each
marked word is encoded alone. The distinct words of a batch are sorted, which is a depth-first walk
of their trie: a word takes over the forward values of the prefix it shares with the word before it.

Forward values: for a unigram model the best score of every prefix of the word (Viterbi). The library
adds up the whole text in single precision, so of ways that score the same, such as the same pieces
in another order, it may take another one. For a BPE model the value of a prefix is the last piece of its merge encoding; it is the one piece that fits behind the
value of the shorter prefix, where a pair fits if merging its joined text gives the pair back.
Maximising raw BPE scores would not give the library's ids. Words with two or more leading marks
(runs of spaces share one score in such models) are merged directly.

The kind of model and its normaliser are read from the file. Models that would need more than this
(a character map, removal of extra spaces, pieces given by the user, marks behind or inside words,
other kinds) are refused rather than encoded wrongly.

Null gives null ids; an empty text gives none. Repeated rows are encoded each, very long texts whole,
an empty table gives an empty one; other columns pass through only where ``keep`` names them.
Decoding is exact for every text without the mark character U+2581, which becomes a space as in the library.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fairway.session import bounded_batches

MARK = "▁"
KNOWN_WORDS = 700_000
WORDS_AT_ONCE = 400_000
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_WORDS_AND_BREAKS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_loaded: dict[str, PieceModel] = {}


class PieceModel:
    """Vocabulary with scores, and the forward pass over sorted words."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], unknown: int, kind: str = "bpe", banned: frozenset[int] = frozenset(), prefix: bool = True):
        self.kind, self.unknown, self.byte_ids, self.prefix = kind, unknown, byte_ids, MARK if prefix else ""
        skip = set(byte_ids.values()) | banned | {unknown}
        self.text = [p for p, _ in pieces]
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if i not in skip}
        self.score = [s for _, s in pieces]
        self.longest = max(map(len, self.ids), default=1)
        # a line break that no piece holds parts words as well
        self.words = (_WORDS if any("\n" in p for p in self.ids) else _WORDS_AND_BREAKS).findall
        self.pairs: dict[int, bool] = {}
        self.place: dict[str, int] = {}
        self.flat, self.ends, self.used = array("i"), array("q"), np.zeros(0, np.int64)
        self.byte_of = {i: b for b, i in byte_ids.items()}
        self.plain = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else p for i, p in enumerate(self.text)]
        self.high = {i for i, b in self.byte_of.items() if b > 127}
        import ahocorasick

        self.finder = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if i:  # id 0 stands for "no piece" in the walk
                self.finder.add_word(p, (i, len(p)))
        self.finder.make_automaton()

    @classmethod
    def from_file(cls, path: str) -> PieceModel:
        import sentencepiece

        kind, prefix = _model_kind(path)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        every = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
        byte_ids = {int(every[i][0][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        banned = frozenset(i for i in range(n) if sp.is_control(i) or sp.is_unused(i))
        if any(MARK in p.lstrip(MARK) for i, (p, _) in enumerate(every) if i not in banned):
            raise ValueError(f"{path}: pieces reach over words")
        return cls(every, byte_ids, sp.unk_id(), kind, banned, prefix)

    # merges -----------------------------------------------------------------

    def merged(self, word: str) -> list[str]:
        """Merge encoding: always the adjacent pair of the best score, the leftmost of equals."""
        part = list(word)
        n = len(part)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (k := self.ids.get(both := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, j, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not (alive[i] and alive[j] and after[i] == j and part[i] + part[j] == both):
                continue
            part[i], alive[j] = both, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p, a in zip(part, alive, strict=True) if a]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging keeps these two pieces apart; left 0: nothing that merges stands there."""
        want = [self.text[right]] if not left else [self.text[left], self.text[right]]
        return self.merged("".join(want)) == want

    # forward pass -----------------------------------------------------------

    def walk(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Ids of each of the sorted distinct words, with forward values shared by prefix."""
        return self._walk_merges(words) if self.kind == "bpe" else self._walk_scores(words)

    def _walk_merges(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        last, size = [0], [0]  # of each prefix: id of its last piece (0: an unknown character), length of that piece
        pairs, longest, find = self.pairs, self.longest, self.finder.iter
        previous = ""
        for word in words:
            at = _shared(previous, word)
            del last[at + 1 :], size[at + 1 :]
            base = max(0, at - longest + 1)
            for e, (k, n) in find(word[base:] if base else word):
                end = base + e + 1
                if end <= at:
                    continue
                while at + 1 < end:
                    last.append(0)
                    size.append(1)
                    at += 1
                key = last[end - n] << 20 | k
                fit = pairs.get(key)
                if fit is None:
                    if len(pairs) > 2_000_000:
                        pairs.clear()
                    fit = pairs[key] = self.fits(key >> 20, k)
                if fit:
                    last.append(k)
                    size.append(n)
                    at = end
            while at < len(word):
                last.append(0)
                size.append(1)
                at += 1
            previous = word
            yield word, self._back(word, last, size)

    def _walk_scores(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        last, size, best = [0], [0], [np.float32(0)]
        longest, find = self.longest, self.finder.iter
        lowest = np.float32(min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0)
        score = np.array(self.score, dtype=np.float32)
        previous = ""
        for word in words:
            same = _shared(previous, word)
            del last[same + 1 :], size[same + 1 :], best[same + 1 :]
            base = max(0, same - longest + 1)
            ends: dict[int, list[tuple[int, int]]] = {}
            for e, found in find(word[base:] if base else word):
                ends.setdefault(base + e + 1, []).append(found)
            for end in range(same + 1, len(word) + 1):
                ways = sorted(((n, k) for k, n in ends.get(end, ())), reverse=True)
                if not ways or ways[-1][0] != 1:  # only a character that is no piece is unknown
                    ways.append((1, 0))
                top = None
                for n, k in ways:
                    value = best[end - n] + (score[k] if k else lowest)
                    if top is None or value > top[0]:
                        top = value, k, n
                best.append(top[0])
                last.append(top[1])
                size.append(top[2])
            previous = word
            yield word, self._back(word, last, size)

    def _back(self, word: str, last: list[int], size: list[int]) -> tuple[int, ...]:
        out: list[int] = []
        at = len(word)
        while at:
            k = last[at]
            if k:
                out.append(k)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(word[at - 1].encode())]
            else:
                out.append(self.unknown)
            at -= size[at]
        out.reverse()
        return tuple(out)

    def numbers(self, parts: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for p in parts:
            k = self.ids.get(p)
            if k is not None:
                out.append(k)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return tuple(out)

    def learn(self, words: set[str]) -> None:
        """Give the ids of new words places in the table of known words."""
        several = {w for w in words if self.kind == "bpe" and w.startswith(MARK * 2)}
        for found in (((w, self.numbers(self.merged(w))) for w in several), self.walk(sorted(words - several))):
            for w, ids in found:
                self.place[w] = len(self.ends)
                self.flat.extend(ids)
                self.ends.append(len(self.flat))

    def forget(self) -> None:
        """Halve a full table: the words used most stay."""
        used = self.used[: len(self.ends)]
        stay = used > np.partition(used, len(used) // 2)[len(used) // 2]
        flat, ends = np.array(self.flat, dtype=np.int32), np.array(self.ends, dtype=np.int64)
        words = [w for w, i in self.place.items() if stay[i]]
        at = np.array([self.place[w] for w in words], dtype=np.int64)
        values, size = _gather(flat, ends, at)
        self.place = {w: i for i, w in enumerate(words)}
        self.flat, self.ends = array("i", values.tobytes()), array("q", np.cumsum(size).tobytes())
        self.used = np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        at = 0
        while at < len(texts):  # so many texts at once as WORDS_AT_ONCE words make up
            words: list[str] = []
            ends = [0]
            start = at
            while at < len(texts) and (at == start or len(words) < WORDS_AT_ONCE):
                if t := texts[at]:
                    words += self.words(self.prefix + t.replace(" ", MARK))
                ends.append(len(words))
                at += 1
            if len(self.place) > KNOWN_WORDS:
                self.forget()
            places = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            new = np.flatnonzero(places < 0)
            if len(new):
                fresh = [words[i] for i in new]
                self.learn(set(fresh))
                places[new] = np.fromiter(map(self.place.__getitem__, fresh), dtype=np.int64, count=len(fresh))
            self.used = np.concatenate([self.used, np.zeros(len(self.ends) - len(self.used), np.int64)])
            self.used += np.bincount(places, minlength=len(self.ends))
            values, size = _gather(np.frombuffer(self.flat, dtype=np.int32) if self.flat else np.zeros(0, np.int32), np.frombuffer(self.ends, dtype=np.int64) if self.ends else np.zeros(0, np.int64), places)
            cut = np.concatenate([[0], np.cumsum(size)])[ends]
            for i in range(at - start):
                ids = values[cut[i] : cut[i + 1]]
                if not self.byte_ids and len(ids):  # unknown characters in a row are one piece
                    ids = ids[(ids != self.unknown) | np.concatenate([[True], ids[:-1] != self.unknown])]
                out.append(None if texts[start + i] is None else ids)
        return out

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, bytes put together as UTF-8, marks to spaces, the first one dropped."""
        if not self.high or not self.high.intersection(ids):  # no byte of a character of several bytes
            joined = "".join(map(self.plain.__getitem__, ids)).replace(MARK, " ")
            return joined[1:] if self.prefix and joined[:1] == " " else joined
        out: list[str] = []
        held = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        joined = "".join(out).replace(MARK, " ")
        return joined[1:] if self.prefix and joined[:1] == " " else joined


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + n]
            at += n


def _model_kind(path: str) -> tuple[str, bool]:
    """Kind of a model file and whether a mark goes in front; refuses what the encoder does not do.

    Fields of the public format: 1 pieces (3 type), 2 trainer (3 kind, 24 mark behind the word), 3 normaliser (2 character map,
    3 mark in front, 4 extra spaces removed, 5 spaces escaped).
    """
    with open(path, "rb") as f:
        parts = list(_fields(f.read()))
    trainer, rule = ({k: v for n, part in parts if n == which for k, v in _fields(part)} for which in (2, 3))
    kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1))
    if kind is None or trainer.get(24, 0) or rule.get(2) or rule.get(4, 1) or not rule.get(5, 1):
        raise ValueError(f"{path}: this kind of model or normaliser is not handled")
    if any(dict(_fields(part)).get(3, 1) == 4 for n, part in parts if n == 1):
        raise ValueError(f"{path}: pieces given by the user are not handled")
    return kind, bool(rule.get(3, 1))


def _gather(flat: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the rows ``places`` of a ragged table, one after the other, and how many each has."""
    if not len(places):
        return flat[:0].copy(), np.zeros(0, np.int64)
    size = np.diff(ends, prepend=0)[places]
    shift = (ends[places] - size) - (np.cumsum(size) - size)
    return flat[np.repeat(shift, size) + np.arange(int(size.sum()))], size


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def model(path: str | None = None) -> PieceModel:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _loaded:
        _loaded[path] = PieceModel.from_file(path)
    return _loaded[path]


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, token_ids, n_tokens (null for a null text) and decodes: the ids give the text back."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(vocabulary)
        for b in batches:
            texts = b.column("__text").to_pylist()
            for at, end in _groups(texts):
                ids = m.encode(texts[at:end])
                same = [None if t is None else m.decode(x.tolist()) == t for x, t in zip(ids, texts[at:end], strict=True)]
                size = np.fromiter((0 if x is None else len(x) for x in ids), dtype=np.int64, count=len(ids))
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                nulls = np.fromiter((x is None for x in ids), dtype=bool, count=len(ids))
                values = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=pa.array(nulls))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, end - at) for c in keep), lists, pa.array(size, pa.int64(), mask=nulls), pa.array(same, pa.bool_())], names=[*keep, "token_ids", "n_tokens", "decodes"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decodes", T.BooleanType())])
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str | None = None, ids: str = "token_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and text; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(vocabulary)
        for b in batches:
            texts = [None if x is None else m.decode(x) for x in b.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("text", T.StringType())])
    return rows.select(*keep, rows[ids].alias("__ids")).mapInArrow(run, schema)


def _groups(texts: list[str | None], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and held + len(t or "") > limit:
            yield at, i
            at, held = i, 0
        held += len(t or "")
    if at < len(texts):
        yield at, len(texts)
