"""Removal of repeated passages: every word in a window of ``WINDOW`` words that starts earlier elsewhere.

A log-structured index of window hashes. Of every window the index takes the hash of its least run of
``GRAM`` words (its anchor): equal windows have equal anchors, and neighbouring windows mostly share
one, so a place of an anchor stands for about eight windows. A batch of documents becomes one
immutable run with one row for each anchor: how many places hold it, and the least and greatest hash
of (text, place) among them, which differ if and only if two different places do. Runs are bucketed
and sorted by anchor. ``add`` merge-joins the new run with each older one, without moving or sorting
the older ones again, and gives the anchors that have now been seen at two places. ``MERGE_RUNS`` runs
are compacted into one. Copies of a text hold the same places, so they make nothing recur.

Anchors found this way name the windows that may repeat. These are verified by 128-bit BLAKE2
digests of their words, once a document: for each the first place (smallest doc_id, then start) is kept by a
partial and a final minimum, so a passage shared by a third of all documents never meets in one
task, and places of very common anchors are spread over tasks. Every candidate window that is not
such a first place repeats, and its words go.

Documents with equal texts are verified once: only the smallest doc_id of equal texts is looked at,
and in the others every word goes that a window covers.

Null and empty texts have no words. Texts under WINDOW words lose nothing; very long ones are whole.
An empty table gives an empty one. A null doc_id comes first. Rows that share a doc_id
are told apart by their texts (in order of a hash of the text); rows equal in both are one document
with equal results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairway.operators.skew import spread_join
from fairway.session import bounded_batches, new_table, scratch, write, written
from .text import Words, buffers, grams, slices, sliding, starts_inside

WINDOW, GRAM = 20, 8
SLICE = 1 << 18
BATCH_BYTES = 4 << 20  # of Arrow; slices are far smaller
MERGE_RUNS = 4
BATCHES = 5
NO_ID = -(1 << 63)  # stands for a null doc_id, and comes first


def _anchored(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the anchor hash of each window, and the hashes of all runs of GRAM words."""
    g = grams(words.hashes(), GRAM)
    starts = starts_inside(words.first, WINDOW)
    low = sliding(g, WINDOW - GRAM + 1)
    return starts, low[starts] if len(starts) else low[:0], g


def _places(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Every place that is the anchor of some window, and its hash."""
    starts, low, g = _anchored(words)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = WINDOW - GRAM + 1
    full = np.zeros(len(g) + width - 1, dtype=np.uint64)  # 0 where no window starts
    full[starts + width - 1] = low
    high = sliding(full, width, np.maximum)  # of the windows over each place, the largest least hash
    at = np.flatnonzero(high == g)
    return at, g[at]


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = buffers(b.column("text"))
        kept = ["doc_id", "text_key", "batch", "text_hash"]
        columns = [b.column(c).to_numpy(zero_copy_only=False) for c in kept]
        for lo, hi in slices(offsets, SLICE):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            at, h = _places(words)
            doc = np.searchsorted(words.first, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((at - words.first[doc]).astype(np.int32)), *(pa.array(c[lo + doc]) for c in columns)], names=["h", "at", *kept])


def _candidates(words: Words, row: int, places: np.ndarray) -> np.ndarray:
    """Starts of the windows of one document whose anchor stands at one of the places."""
    first, last = int(words.first[row]), int(words.first[row + 1])
    n = last - first - WINDOW + 1
    if n <= 0 or not len(places):
        return np.zeros(0, np.int64)
    g = words.gram_hashes[first : last - GRAM + 1]
    low = sliding(g, WINDOW - GRAM + 1)
    width = WINDOW - GRAM + 1
    at = places[places < len(g)].astype(np.int64)
    starts = (at[:, None] - np.arange(width)).ravel()
    owner = np.repeat(at, width)
    good = (starts >= 0) & (starts < n)
    starts, owner = starts[good], owner[good]
    return np.unique(starts[low[starts] == g[owner]])


def _first_of_each(row: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Where each digest of a row stands first."""
    order = np.lexsort((digest[:, 1], digest[:, 0], row))  # stable
    if not len(order):
        return order
    r, d = row[order], digest[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (d[1:] != d[:-1]).any(axis=1)
    return np.sort(order[new])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = buffers(b.column("text"))
        ids, keys = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("text_key").to_numpy(zero_copy_only=False)
        places = b.column("places")
        for lo, hi in slices(offsets, SLICE):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            words.gram_hashes = grams(words.hashes(), GRAM)
            found = [_candidates(words, i, np.asarray(places[lo + i].values)) for i in range(hi - lo)]
            size = np.fromiter(map(len, found), dtype=np.int64, count=hi - lo)
            row = np.repeat(np.arange(hi - lo), size)
            start = np.concatenate(found) if found else np.zeros(0, np.int64)
            at = words.first[row] + start
            joined = _joined(words.data, words.start, words.end)
            begin = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])  # of each word among the joined ones
            spans = zip(begin[at].tolist(), (begin[at + WINDOW] - 1).tolist(), strict=True)
            digest = np.frombuffer(b"".join(hashlib.blake2b(joined[x:y], digest_size=16).digest() for x, y in spans), dtype=np.int64).reshape(-1, 2)
            first = _first_of_each(row, digest)
            digest, row, start = digest[first], row[first], start[first]
            yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(ids[lo + row]), pa.array(keys[lo + row]), pa.array(start.astype(np.int32))], names=["d1", "d2", "doc_id", "text_key", "start"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = buffers(b.column("text"))
        places, firsts, copy = b.column("places"), b.column("firsts"), b.column("is_copy").to_pylist()
        for lo, hi in slices(offsets, SLICE):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            words.gram_hashes = grams(words.hashes(), GRAM) if any(places[i].is_valid and not copy[i] for i in range(lo, hi)) else None
            n_words, n_removed, digest, kept = [], [], [], []
            for i in range(hi - lo):
                first, last = int(words.first[i]), int(words.first[i + 1])
                n = last - first
                starts, ends = words.start[first:last], words.end[first:last]
                gone = None
                if copy[lo + i]:
                    gone = np.ones(n, dtype=bool) if n >= WINDOW else None
                elif places[lo + i].is_valid:
                    seen = np.asarray(firsts[lo + i].values) if firsts[lo + i].is_valid else np.zeros(0, np.int64)
                    repeats = np.setdiff1d(_candidates(words, i, np.asarray(places[lo + i].values)), seen, assume_unique=True)
                    if len(repeats):
                        edge = np.zeros(n + 1, dtype=np.int32)
                        np.add.at(edge, repeats, 1)
                        np.add.at(edge, repeats + WINDOW, -1)
                        gone = np.cumsum(edge[:n]) > 0
                if gone is not None:
                    starts, ends = starts[~gone], ends[~gone]
                text = _joined(words.data, starts, ends)
                n_words.append(n)
                n_removed.append(0 if gone is None else int(gone.sum()))
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words joined by one space."""
    if not len(starts):
        return b""
    size = ends - starts + 1  # each with the byte behind it, which becomes a space
    at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out = data[np.minimum(at, len(data) - 1)]
    out[np.cumsum(size) - 1] = 0x20
    return out[:-1].tobytes()


class WindowIndex:
    """Runs of anchors, each a bucketed and sorted table. Runs are immutable; adding and compacting write new ones."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.name = f"fairway_run_{uuid.uuid4().hex}"
        self.folder = new_table(spark, "windows")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.made = 0
        self.runs: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        """A run of rows that are grouped by anchor, so that each bucket is one file."""
        self.made += 1
        name = f"{self.name}_{self.made}"
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.folder}/{self.made}").format("parquet").saveAsTable(name)
        return name

    def add(self, places: DataFrame) -> DataFrame:
        """Index a batch of places (h, text_hash, at). Gives (h, n): its anchors seen at two places of texts by now, in n places at least."""
        place = F.xxhash64("text_hash", "at")
        name = self._write(places.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count(F.lit(1)).alias("n")))
        key = "spark.sql.legacy.bucketedTableScan.outputOrdering"  # files of a bucket are read in their order
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "true")
        try:
            new = self.spark.table(name)
            for i, run in enumerate(self.runs):
                old = self.spark.table(run).select("h", F.col("lo").alias(f"lo{i}"), F.col("hi").alias(f"hi{i}"), F.col("n").alias(f"n{i}"))
                new = new.join(old.hint("merge"), "h", "left")
            count = range(len(self.runs))
            lo = F.least("lo", *(f"lo{i}" for i in count)) if self.runs else F.col("lo")
            hi = F.greatest("hi", *(f"hi{i}" for i in count)) if self.runs else F.col("hi")
            total = sum((F.coalesce(f"n{i}", F.lit(0)) for i in count), F.col("n"))
            found = written(new.where(lo != hi).select("h", total.alias("n")).hint("rebalance", "h"), "found")  # else a file for each bucket
        finally:
            self.spark.conf.set(key, before)
        self.runs.append(name)
        if len(self.runs) >= MERGE_RUNS:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge all runs into one."""
        rows = self.rows().groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
        merged = self._write(rows)
        self.drop()
        self.runs = [merged]

    def rows(self) -> DataFrame:
        """Rows of all runs, read as plain files: a union of bucketed tables would pass for grouped by anchor."""
        return self.spark.read.schema("h long, lo long, hi long, n long").parquet(*(f"{self.folder}/{run.rsplit('_', 1)[1]}" for run in self.runs))

    def drop(self) -> None:
        """Forget the runs; their files go with the folder."""
        for run in self.runs:
            self.spark.sql(f"drop table {run}")
        self.runs = []


def _recurring_places(rows: DataFrame, batches: int, copies_at: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, places): places of recurring anchors in documents that stand for themselves; and the copies, written to a path."""
    spark = rows.sparkSession
    key = ["doc_id", "text_key"]
    cut = rows.withColumns({"batch": F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"), "text_hash": F.xxhash64("text")})
    anchors = written(cut.mapInArrow(_run_rows, "h long, at int, doc_id long, text_key int, batch int, text_hash long"), "anchors")
    index = WindowIndex(spark)
    found = None
    for i in range(batches):
        part = index.add(anchors.where(F.col("batch") == i))
        found = part if found is None else found.unionByName(part)
    index.drop()
    recurring = written(found.groupBy("h").agg(F.max("n").alias("n")), "recurring")
    # equal texts: the first in order of doc_id stands for them
    ids = rows.select(*key, F.md5(F.col("text").cast("binary")).alias("digest"))
    heads = ids.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = written(heads, "heads")
    write(spread_join(ids, heads, "digest", "n", key).where(F.col("doc_id") != F.col("head")).select(*key).distinct().withColumn("is_copy", F.lit(True)), copies_at)
    copies = spark.read.parquet(copies_at)
    # a place listed once for each document, and only of documents that stand for themselves
    places = spread_join(anchors.select("h", "at", *key), recurring, "h", "n", [*key, "at"]).groupBy(*key).agg(F.collect_set("at").alias("places")).join(copies, key, "left_anti")
    return places, copies


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (words joined by one space) of every document.

    The documents enter the index in ``batches`` parts by hash of doc_id, one after the other, as they
    would arrive; each part is joined with the runs of those before it.
    """
    spark = docs.sparkSession
    bounded_batches(spark, BATCH_BYTES)
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    several = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = rows.withColumn("text_key", F.hash("text") if several else F.lit(0))
    key = ["doc_id", "text_key"]
    places_at, copies_at = new_table(spark, "places"), new_table(spark, "copies")
    with scratch(spark):  # the index and what leads to it go before texts move
        places, copies = _recurring_places(rows, batches, copies_at)
        write(places, places_at)
    places, copies = spark.read.parquet(places_at), spark.read.parquet(copies_at)
    windows = rows.join(places, key).mapInArrow(_window_rows, "d1 long, d2 long, doc_id long, text_key int, start int")
    same = windows.groupBy("d1", "d2")
    if several:
        heads = same.agg(F.min(F.struct(*key, "start")).alias("head")).select("head.*")
    else:  # two minima need no sort, and a document has a window once
        heads = same.agg(F.min("doc_id").alias("doc_id"), F.min_by("start", "doc_id").alias("start")).withColumn("text_key", F.lit(0))
    firsts = heads.groupBy(*key).agg(F.collect_list("start").alias("firsts"))
    small = written(places.join(firsts, key, "left").unionByName(copies.select(*key), allowMissingColumns=True).join(copies, key, "left"), "marks")
    every = rows.join(small, key, "left").select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text", F.coalesce("is_copy", F.lit(False)).alias("is_copy"), "places", "firsts")
    return every.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
