"""Document fingerprints from closed syncmers.

A closed syncmer is a run of ``K`` code points whose smallest inner run of ``S`` code points (by
hash) stands at the run's first or last place. Whether a run is one depends on the run alone, so the
same passage gives the same anchors in any text around it. A fingerprint holds the ``ANCHORS``
anchors of least hash, once each, in the order of their first places in the text; it has at most
8 * ANCHORS hexadecimal digits for any length of text.

Likeness of two fingerprints: among the ANCHORS least anchors of both together, the share that both
hold and in the same order (longest increasing run of places). Equal texts have equal fingerprints
and likeness 1. A text without a syncmer (short, say) has its checksum as only anchor; null and
empty texts have the empty fingerprint, and two of these are alike to 1, one and another to 0.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairway.session import bounded_batches
from .text import grams, mix, sliding

K, S, ANCHORS = 14, 6, 96
BLOCK = 1 << 15


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 32-bit hashes of the closed syncmers of code points."""
    base = mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    inner = grams(base, S)
    width = K - S + 1
    low = sliding(inner, width)
    size = len(low)
    at = np.flatnonzero((inner[:size] == low) | (inner[width - 1 : width - 1 + size] == low))
    return at, (grams(base, K, 1)[at] >> np.uint64(32)).astype(np.int64)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Anchors of each text: 32-bit hashes in the order of their places."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= BLOCK):
            held += len(texts[end])
            end += 1
        part = texts[at:end]
        if held > 4 * BLOCK:
            out += [_long(t) for t in part]
        else:
            codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            out += _block(codes, sizes, part)
        at = end
    return out


def _block(codes: np.ndarray, sizes: np.ndarray, part: list[str]) -> list[np.ndarray]:
    ends = np.cumsum(sizes)
    at, h = _anchors(codes)
    doc = np.searchsorted(ends, at, side="right")
    inside = at + K <= ends[np.minimum(doc, len(ends) - 1)] if len(at) else np.zeros(0, bool)
    at, h, doc = at[inside], h[inside], doc[inside]
    at, h, doc = _least(at, h, doc)
    cut = np.searchsorted(doc, np.arange(len(part) + 1))
    return [h[cut[i] : cut[i + 1]] if cut[i + 1] > cut[i] else _whole(t) for i, t in enumerate(part)]


def _least(at: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ANCHORS least distinct hashes of each document, at their first places, in order of place."""
    key = doc << 32 | h
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    order = order[first]
    d = doc[order]
    rank = np.arange(len(d)) - np.searchsorted(d, d)
    order = np.sort(order[rank < ANCHORS])
    return at[order], h[order], doc[order]


def _long(text: str) -> np.ndarray:
    """A very long text block by block; what is kept between blocks is bounded."""
    at, h = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(text), BLOCK):
        piece = text[start : start + BLOCK + K - 1]
        a, x = _anchors(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        at, h = np.concatenate([at, a + start]), np.concatenate([h, x])
        at, h, _ = _least(at, h, np.zeros(len(at), np.int64))
    return h if len(h) else _whole(text)


def _whole(text: str) -> np.ndarray:
    return np.array([zlib.crc32(text.encode("utf-8", "surrogatepass"))] if text else [], dtype=np.int64)


def digits(anchors: np.ndarray) -> str:
    return anchors.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a == b).all():
        return 1.0
    least = np.union1d(a, b)[:ANCHORS]
    common = np.intersect1d(a, b, assume_unique=True)
    if not len(common):
        return 0.0
    common = common[common <= least[-1]]
    place = {x: i for i, x in enumerate(b.tolist())}
    held = set(common.tolist())
    tails: list[int] = []
    for x in a.tolist():
        if x in held:
            p = place[x]
            i = bisect_left(tails, p)
            if i == len(tails):
                tails.append(p)
            else:
                tails[i] = p
    return len(tails) / len(least)


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and fingerprint, one row for each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(map(digits, fingerprints(texts)), pa.string())], names=[*keep, "fingerprint"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fingerprint", T.StringType())])
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


def edited(text: str, other: str) -> str:
    """The last third of the code points replaced by the first as many of the other text."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def edit_probe(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text and the next document, in descending order of doc_id.

    Rows are dealt to ranges of doc_id whose upper ends are ids that occur, and sorted inside. A
    range needs one row of the range after it: the row that has that range's upper end, which is
    known beforehand and is sent to both. Rows of one doc_id follow each other by text; a null
    doc_id comes last. Nothing is gathered but the ends, as many as there are ranges.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = [i / n for i in range(1, n)]
    least, most, cuts = rows.agg(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", at, 20 * n)).first()
    ends = sorted({most, *(cuts or ())}, reverse=True) if most is not None else []
    parts = max(1, len(ends))
    # range p holds the ids up to ends[p] and above ends[p + 1]; null ids go to the last
    if ends:
        up = [int(x) for x in reversed(ends)]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = np.array(up, dtype=np.int64)
            for b in batches:
                ids = b.column("doc_id")
                null = np.asarray(ids.is_null())
                value = np.asarray(ids.fill_null(least))
                part = parts - 1 - np.searchsorted(bounds, value)
                part = np.where(null, parts - 1, part)
                head = np.flatnonzero(~null & (bounds[np.minimum(parts - 1 - part, parts - 1)] == value))
                for rows_at, p, extra in ((None, part, False), (head, (part[head] - 1) % parts, True)):
                    some = b if rows_at is None else b.take(pa.array(rows_at))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", "text")), pa.array(p, pa.int32()), pa.array(np.full(some.num_rows, extra))], names=["doc_id", "text", "part", "extra"])

        dealt = rows.mapInArrow(deal, "doc_id long, text string, part int, extra boolean")
    else:
        dealt = rows.withColumns({"part": F.lit(0), "extra": F.lit(False)})
    if hasattr(dealt, "repartitionById"):
        spread = dealt.repartitionById(parts, F.col("part"))
    else:
        spread = dealt.repartition(parts, "part")
    ordered = spread.sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_probe, schema)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the last row so far: part, doc_id, text, anchors
    head: tuple | None = None  # the first row of its part, for a part without an extra row
    done = False  # the extra row of the part has been met
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def results(pairs: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
        changed = [edited(a[2], b[2]) for a, b in pairs]
        prints = fingerprints(changed)
        rows = [(a[1], len(a[2]), hashlib.sha256(e.encode()).hexdigest(), digits(a[3]), digits(p), likeness(a[3], p), likeness(a[3], b[3])) for (a, b), e, p in zip(pairs, changed, prints, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        texts = b.column("text").to_pylist()
        prints = fingerprints(texts)
        pairs: list[tuple[tuple, tuple]] = []
        size = 0
        for part, doc_id, text, anchors, extra in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), texts, prints, b.column("extra").to_pylist(), strict=True):
            row = (part, doc_id, text, anchors)
            if held is not None and held[0] != part:
                if not done:
                    pairs.append((held, head))
                held, head, done = None, None, False
            if done:
                continue
            if held is not None:
                pairs.append((held, row))
                size += len(held[2])
            if extra:
                done = True
            if held is None and not extra:
                head = row
            held = row
            if size > BLOCK:
                yield results(pairs)
                pairs, size = [], 0
        if pairs:
            yield results(pairs)
    if held is not None and not done and head is not None:
        yield results([(held, head)])
