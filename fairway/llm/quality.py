"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), which is the
sum over all pairs of features of <v_i, v_j> x_i x_j in time linear in the features. Features are the
hashed words (log counts, to unit length), statistics of structure and the text's sizes. Labels,
language, source and doc_id are never features.

The model is fitted on the driver from at most ``MAX_LABELLED`` labelled rows (those of least hash
of their doc_id, then text); everything else runs over all rows. Null and empty texts have the
features of an empty text, very long ones are whole. Repeated rows get equal scores and are learned
from once; rows that share a labelled doc_id all bear its label. Of several labels of one doc_id the
largest counts; labels without a doc_id or a quality do not; with no label at all the score is 0.5.
A row without doc_id is scored and is not held out. An empty table gives an empty one. Other columns
pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairway.session import bounded_batches
from .text import Words, buffers, slices

MAX_LABELLED = 6000
WORD_BITS = 15
FACTORS = 8
STATISTICS = 18
SLICE = 1 << 19
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT, _SIGN, _BREAK, _HIGH = (np.zeros(256, dtype=bool) for _ in range(6))
_UPPER[0x41:0x5B] = True
_LOWER[0x61:0x7B] = True
_DIGIT[0x30:0x3A] = True
_HIGH[0x80:] = True
_BREAK[0x0A] = True
_SIGN[0x21:0x7F] = True
_SIGN &= ~(_UPPER | _LOWER | _DIGIT)


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each document's features, then their numbers and values."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    h = words.hashes()
    counts = words.counts()
    doc = np.repeat(np.arange(n), counts)
    key, times = np.unique(doc.astype(np.int64) << WORD_BITS | (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    word_doc, number = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(word_doc, value * value, minlength=n))
    value = value / np.maximum(norm[word_doc], 1e-9)

    size = np.diff(offsets).astype(np.float64)
    chars = np.maximum(size, 1)
    n_words = np.maximum(counts, 1).astype(np.float64)
    distinct = np.bincount(word_doc, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, word_doc, times)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    last = data[words.end - 1] if len(h) else np.zeros(0, np.uint8)
    length = words.end - words.start
    doubled = np.zeros(len(h), dtype=bool)
    long = np.flatnonzero(length > 1)
    doubled[long] = _SIGN[last[long]] & (data[words.end[long] - 2] == last[long])
    lone = (length == 1) & _SIGN[last] if len(h) else same
    capital = _UPPER[data[words.start]] if len(h) else same
    lines = _per_doc(_BREAK[data], offsets)
    share = lambda mask: np.bincount(doc, mask, minlength=n) / n_words
    letters = np.maximum(_per_doc(_UPPER[data] | _LOWER[data], offsets), 1)
    stats = np.stack([
        np.log1p(size) / 12, np.log1p(counts) / 10, size / n_words / 12, distinct / n_words, most / n_words, 3 * share(same), 2 * share(doubled), 2 * share(lone), share(capital),
        _per_doc(_UPPER[data], offsets) / letters, 5 * _per_doc(_DIGIT[data], offsets) / chars, 5 * _per_doc(_SIGN[data], offsets) / chars, _per_doc(_HIGH[data], offsets) / chars,
        20 * lines / chars, np.minimum(n_words / (lines + 1), 200) / 50, (counts == 0).astype(float), share(length > 25), 2 * np.maximum(share(same) - 0.1, 0) + np.maximum(share(lone) - 0.1, 0),
    ], axis=1)
    per = np.bincount(word_doc, minlength=n) + STATISTICS
    start = np.concatenate([[0], np.cumsum(per)])
    numbers = np.empty(int(start[-1]), dtype=np.int32)
    values = np.empty(int(start[-1]), dtype=np.float64)
    at = start[:-1, None] + np.arange(STATISTICS)
    numbers[at] = (1 << WORD_BITS) + np.arange(STATISTICS)
    values[at] = stats
    place = np.arange(len(key)) + STATISTICS * (word_doc + 1)
    numbers[place] = number
    values[place] = value
    return start, numbers, values


class Machine:
    """Weights of the factorisation machine."""

    def __init__(self, seed: int = 7):
        size = (1 << WORD_BITS) + STATISTICS
        self.bias = 0.0
        self.w = np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, FACTORS))
        self.fitted = False

    def margins(self, start: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins, and what their slopes need: the factors times values, and their sums."""
        vx = self.v[numbers] * values[:, None]
        first = start[:-1]
        sums = np.add.reduceat(vx, first, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), first)
        linear = np.add.reduceat(self.w[numbers] * values, first)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), vx, sums

    def scores(self, start: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(start) - 1, 0.5)
        return 1 / (1 + np.exp(-np.clip(self.margins(start, numbers, values)[0], -30, 30)))

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 800, rate: float = 0.02, decay: float = 1e-5, seed: int = 11) -> Machine:
        """Adam over small groups of rows (label, numbers, values)."""
        if not rows:
            return self
        y = np.array([r[0] for r in rows], dtype=np.float64)
        mean = np.clip(y.mean(), 0.01, 0.99)
        self.bias, self.fitted = float(np.log(mean / (1 - mean))), True
        rng = np.random.default_rng(seed)
        m_w, s_w = np.zeros_like(self.w), np.zeros_like(self.w)
        m_v, s_v = np.zeros_like(self.v), np.zeros_like(self.v)
        m_b = s_b = 0.0
        step = 0
        for _ in range(-(-steps // -(-len(rows) // 64))):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), 64):
                some = order[at : at + 64]
                size = np.array([len(rows[i][1]) for i in some])
                start = np.concatenate([[0], np.cumsum(size)])
                numbers = np.concatenate([rows[i][1] for i in some])
                values = np.concatenate([rows[i][2] for i in some])
                margin, vx, sums = self.margins(start, numbers, values)
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[some]) / len(some)
                e = np.repeat(error, size)
                ex = e * values
                step += 1
                lift = np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * rate
                used, where = np.unique(numbers, return_inverse=True)
                g = np.bincount(where, ex) + decay * self.w[used]
                m_w[used] = 0.9 * m_w[used] + 0.1 * g
                s_w[used] = 0.999 * s_w[used] + 0.001 * g * g
                self.w[used] -= lift * m_w[used] / (np.sqrt(s_w[used]) + 1e-8)
                inner = np.repeat(sums, size, axis=0) - vx
                g = np.stack([np.bincount(where, ex * inner[:, f]) for f in range(FACTORS)], axis=1) + decay * self.v[used]
                m_v[used] = 0.9 * m_v[used] + 0.1 * g
                s_v[used] = 0.999 * s_v[used] + 0.001 * g * g
                self.v[used] -= lift * m_v[used] / (np.sqrt(s_v[used]) + 1e-8)
                m_b, s_b = 0.9 * m_b + 0.1 * error.sum(), 0.999 * s_b + 0.001 * error.sum() ** 2
                self.bias -= lift * m_b / (np.sqrt(s_b) + 1e-8)
        return self


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = buffers(b.column("text"))
        labels = b.column("label").to_pylist()
        for lo, hi in slices(offsets, SLICE):
            start, numbers, values = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            cut = [(start[i], start[i + 1]) for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([pa.array(labels[lo:hi], pa.int32()), pa.array([numbers[a:z].tobytes() for a, z in cut], pa.binary()), pa.array([values[a:z].astype(np.float32).tobytes() for a, z in cut], pa.binary())], names=["label", "numbers", "values"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Machine:
    """Fit on the labelled documents that are not held out."""
    bounded_batches(docs.sparkSession)
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_key"))
    keys = texts.select("doc_id", "text_key").join(F.broadcast(known), "doc_id").distinct()  # at most max_labelled ids
    keys = keys.orderBy(F.xxhash64("doc_id"), "doc_id", "text_key").limit(max_labelled)
    chosen = texts.join(F.broadcast(keys), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    packed = chosen.select("label", "text").mapInArrow(_packed, "label int, numbers binary, values binary").collect()  # max_labelled rows at most
    rows = [(r[0], np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32).astype(np.float64)) for r in packed]
    rows.sort(key=lambda r: (len(r[1]), r[0], r[2].tobytes()))
    return Machine().fit(rows)


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """All columns of the documents, with score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32), machine.fitted))
    names = docs.columns
    alias = [f"c{i}" for i in range(len(names))]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine()
        m.bias, m.w, m.v, m.fitted = shared.value
        for b in batches:
            data, offsets = buffers(b.column(at))
            out = np.zeros(b.num_rows)
            for lo, hi in slices(offsets, SLICE):
                out[lo:hi] = m.scores(*features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(out, 9))], names=[*alias, "score"])

    schema = T.StructType([*(T.StructField(a, f.dataType) for a, f in zip(alias, docs.schema, strict=True)), T.StructField("score", T.DoubleType())])
    scored = docs.toDF(*alias).mapInArrow(run, schema)
    return scored.toDF(*names, "score")
