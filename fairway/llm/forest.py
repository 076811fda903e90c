"""Near-duplicate classes by an LSH forest of MinHash signatures, confirmed on full shingle sets.

Every document gets ``HASHES`` MinHash values. A tree sorts documents by these values in an order of its
own; documents whose longest common prefix in it reaches the depth of the level form a region. Trees
of the first level have depth 3: a pair with similarity 0.8 shares a region of one of them with
probability 1 - (1 - 0.8 ** 3) ** 20, all but 1 in 10**6. Depth adapts to the region: one of up to
``REGION`` rows is compared each with each on the signatures (one byte a value). In a larger one every
row is compared with the region's hub; rows that agree with it in ``CORE`` of the values stay there,
as whatever is alike to them is near the hub itself, and all others descend to the deeper trees of
the next level, of which there are as many more as the greater depth needs. A region of the last
level that is still larger becomes one candidate cluster, so nothing is cut off. Only a spanning
forest of what may be alike is emitted, never all pairs.

Candidates joined this way form clusters. Full shingle sets travel to their cluster, where all
pairs are compared exactly by products of incidence matrices. A cluster beyond the bounds of a block
is first compared within blocks that share some representatives; then only rows outside the largest
component found so far are compared with all blocks, as pairs inside a component change nothing.
Again a spanning forest of the confirmed links leaves the task.

Documents with equal sets are one class, of which only the least doc_id enters the search. An empty
set, of null or empty texts, is linked with nothing. A null doc_id orders first; rows that share a
doc_id are one node, each with its own n_shingles; equal rows get equal results. Very long texts are
whole. An empty table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.operators.graph import components
from fairway.operators.skew import spread_join
from fairway.session import bounded_batches, written
from .text import Words, buffers, grams, mix, slices

TREES, DEPTH = 20, 3
HASHES = TREES * DEPTH
#: Depth and number of trees of each level; every level misses a pair of similarity 0.8 about once in 10**6.
LEVELS = ((DEPTH, TREES), (6, 48), (12, 200))
REGION = 2048
LIKELY, CORE = 0.55, 0.9
REPRESENTATIVES = 32
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_500_000
SLICE = 1 << 18
NO_ID = -(1 << 63)

_FACTORS = np.random.default_rng(99).integers(1, 2**63, size=HASHES, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, sorted within each, and where each document's start."""
    words = Words(data, offsets)
    h = words.hashes(lower=True)
    counts = words.counts()
    docs = len(offsets) - 1
    g = grams(h, n)
    full = counts >= n
    per = np.where(full, counts - n + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(docs), per)
    at = words.first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    values = np.zeros(len(row), dtype=np.uint64)
    whole = full[row]
    values[whole] = g[at[whole]]
    for i in np.flatnonzero(~full & (counts > 0)):  # fewer words than a shingle: the sequence itself
        values[np.searchsorted(row, i)] = grams(h[words.first[i] : words.first[i + 1]], int(counts[i]), 1)[0] + np.uint64(counts[i])
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    row, values = row[first], values[first]
    return values, np.searchsorted(row, np.arange(docs + 1))


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for lo, hi in slices(offsets, SLICE):
                values, start = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                size = np.diff(start)
                rows = hi - lo
                s1, s2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                keys = np.zeros((rows, TREES), np.uint64)
                bytes_ = np.zeros((rows, HASHES), np.uint8)
                some = np.flatnonzero(size)
                if len(some):
                    at = start[:-1][some]
                    s1[some] = np.add.reduceat(mix(values), at)
                    s2[some] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    for k in range(HASHES):
                        low = mix(np.minimum.reduceat(values * _FACTORS[k], at))
                        bytes_[some, k] = (low & np.uint64(255)).astype(np.uint8)
                        tree = k // DEPTH
                        keys[some, tree] = keys[some, tree] * np.uint64(0x9E3779B97F4A7C15) + low
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * TREES), pa.array(mix(keys.ravel()).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, rows), pa.array(size, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists, pa.array([x.tobytes() for x in bytes_], pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "keys", "sketch"])

    return run


def _stars(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges from every node to the least node of its group, for links (a, b) between rows."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(ids[a].tolist(), ids[b].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in parent if root(x) != x]


def _alike(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sparing set of pairs of rows (each row with some earlier row) that connects all rows whose signatures agree enough."""
    n = len(sketches)
    need = int(np.ceil(LIKELY * HASHES))
    a, b = [], []
    group = np.arange(n)
    for i in range(1, n):
        agree = np.flatnonzero((sketches[:i] == sketches[i]).sum(axis=1) >= need)
        if len(agree):
            heads, where = np.unique(group[agree], return_index=True)
            a += [i] * len(heads)
            b += agree[where].tolist()
            least = heads[0]
            group[i] = least
            for h in heads[1:]:
                group[group == h] = least
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["a", "b"])


def _sketches(b: pa.RecordBatch, column: str = "sketch") -> np.ndarray:
    return np.frombuffer(b"".join(b.column(column).to_pylist()), dtype=np.uint8).reshape(-1, HASHES)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate edges from rows sorted by region and signature order; regions have up to REGION rows."""
    key = None
    ids: list[np.ndarray] = []
    sketches: list[np.ndarray] = []

    def compare() -> list[tuple[int, int]]:
        i = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        if len(i) < 2:
            return []
        return _stars(*_alike(np.concatenate(sketches)), i)

    for b in batches:
        if not b.num_rows:
            continue
        region = b.column("region").to_numpy(zero_copy_only=False)
        doc = b.column("doc_id").to_numpy(zero_copy_only=False)
        sk = _sketches(b)
        cut = np.concatenate([[0], np.flatnonzero(region[1:] != region[:-1]) + 1, [len(region)]])
        out: list[tuple[int, int]] = []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if region[lo] != key:
                out += compare()
                key, ids, sketches = region[lo], [], []
            ids.append(doc[lo:hi])
            sketches.append(sk[lo:hi])
        if out:
            yield _edges(out)
    yield _edges(compare())


def _about_hubs(last: bool):
    """Edges of rows of large regions to their hubs, and rows that go deeper (b is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc, hub = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "hub_id"))
            agree = (_sketches(b) == _sketches(b, "hub")).sum(axis=1)
            linked = np.flatnonzero((doc != hub) & ((agree >= LIKELY * HASHES) | last))
            deeper = np.flatnonzero(agree < CORE * HASHES) if not last else linked[:0]
            ends = pa.concat_arrays([pa.array(hub[linked], pa.int64()), pa.nulls(len(deeper), pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([doc[linked], doc[deeper]]), pa.int64()), ends], names=["a", "b"])

    return run


def _deeper(level: int):
    """Region keys of the trees of a level below the first, from the signatures' bytes."""
    depth, trees = LEVELS[level]
    rng = np.random.default_rng(1000 + level)
    orders = np.stack([rng.permutation(HASHES)[:depth] for _ in range(trees)])
    factors = rng.integers(1, 2**63, size=depth, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sk = _sketches(b)
            keys = np.zeros((len(sk), trees), np.uint64)
            for t, order in enumerate(orders):
                keys[:, t] = ((sk[:, order].astype(np.uint64) + np.uint64(1)) * factors).sum(axis=1) + np.uint64(t * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sk) + 1, dtype=np.int32) * trees), pa.array(mix(keys.ravel()).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, b.column("sketch")], names=["doc_id", "keys", "sketch"])

    return run


def candidate_edges(entering: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of what may be alike; ``entering`` has doc_id, keys of the first level, sketch."""
    parts = int(entering.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = None
    now = entering
    for level in range(len(LEVELS)):
        last = level == len(LEVELS) - 1
        keyed = now.select("doc_id", F.posexplode("keys").alias("tree", "key")).select("doc_id", "tree", F.xxhash64("tree", "key").alias("region"))
        shared = written(keyed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "regions")
        sized = shared.withColumn("size", F.col("n"))
        members = spread_join(keyed, sized, "region", "n", ["doc_id"]).join(now.select("doc_id", "sketch"), "doc_id")
        at = F.col("tree") * DEPTH % HASHES
        turned = F.concat(F.substring("sketch", at + 1, F.lit(HASHES)), F.substring("sketch", F.lit(1), at))
        members = written(members.select("doc_id", "region", "size", "sketch", turned.alias("turned")), "members")
        few = members.where(F.col("size") <= REGION).repartition(parts, "region").sortWithinPartitions("region", "turned", "doc_id")
        found = few.select("region", "doc_id", "sketch").mapInArrow(_regions, "a long, b long")
        large = members.where(F.col("size") > REGION)
        if large.isEmpty():
            return found if edges is None else edges.unionByName(found)
        hubs = written(large.groupBy("region").agg(F.min_by(F.struct("doc_id", "sketch"), F.xxhash64("doc_id")).alias("h"), F.count(F.lit(1)).alias("n")).select("region", F.col("h.doc_id").alias("hub_id"), F.col("h.sketch").alias("hub"), "n"), "hubs")
        about = spread_join(large.select("doc_id", "region", "sketch"), hubs, "region", "n", ["doc_id"]).mapInArrow(_about_hubs(last), "a long, b long")
        about = written(about, "about")
        found = found.unionByName(about.where("b is not null"))
        edges = written(found if edges is None else edges.unionByName(found), "candidates")
        if last:
            return edges
        down = about.where("b is null").select(F.col("a").alias("doc_id")).distinct()
        now = written(entering.select("doc_id", "sketch").join(down.hint("merge"), "doc_id").mapInArrow(_deeper(level + 1), "doc_id long, keys array<long>, sketch binary"), "deeper")
    return edges


def _confirmed(n: int, percent: int):
    """Links among the full sets of each group of rows, sorted by group."""

    def links(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        count = len(ids)
        if count < 2:
            return []
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(count), size)
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        common = times[column] > 1
        row, column = row[common], column[common]
        both = np.zeros((count, count), dtype=np.float32)
        if len(row):
            _, column = np.unique(column, return_inverse=True)
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            width = max(1, (8 << 20) // count)
            for at in range(0, int(column[-1]) + 1, width):
                lo, hi = np.searchsorted(column, [at, at + width])
                m = np.zeros((count, min(width, int(column[-1]) + 1 - at)), dtype=np.float32)
                m[row[lo:hi], column[lo:hi] - at] = 1
                both += m @ m.T
        union = size[:, None] + size[None, :] - both
        linked = np.triu(100 * both.astype(np.float64) >= percent * union, 1)
        a, b = np.nonzero(linked)
        return _stars(a, b, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def rows() -> pa.RecordBatch:
            edges = links(np.array(ids, dtype=np.int64), sets)
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

        for b in batches:
            data, offsets = buffers(b.column("text"))
            group = list(zip(b.column("cluster").to_pylist(), b.column("part").to_pylist(), strict=True))
            doc = b.column("doc_id").to_pylist()
            for lo, hi in slices(offsets, SLICE):
                values, start = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                for i in range(hi - lo):
                    if group[lo + i] != key:
                        if len(ids) > 1:
                            yield rows()
                        key, ids, sets = group[lo + i], [], []
                    ids.append(doc[lo + i])
                    sets.append(values[start[i] : start[i + 1]].copy())
        if len(ids) > 1:
            yield rows()

    return run


def _confirmed_links(rows: DataFrame, placed: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): confirmed links that join all that is alike within the clusters of ``placed`` (node, component, n_shingles)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compared(wanted: DataFrame) -> DataFrame:  # the list of wanted documents grows with the table, so it is never broadcast
        sent = rows.join(wanted.select(F.col("node").alias("doc_id"), "cluster", "part").distinct().hint("merge"), "doc_id")
        return sent.repartition(parts, "cluster", "part").sortWithinPartitions("cluster", "part").mapInArrow(_confirmed(shingle, percent), "a long, b long")

    def blocks_of(members: DataFrame) -> DataFrame:
        sized = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
        return sized.select("component", "n", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))

    sized = written(blocks_of(placed).withColumn("rows", F.col("n")), "sizes")
    dealt = written(spread_join(placed, sized, "component", "n", ["node"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "dealt")
    chosen = F.pmod(F.xxhash64("node", F.lit(7)), F.col("rows")) < REPRESENTATIVES  # about that many rows of a cluster
    to = F.when((F.col("blocks") > 1) & chosen, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    links = written(compared(dealt.select("node", F.col("component").alias("cluster"), F.explode(to.cast("array<long>")).alias("part"))), "links")
    big = dealt.where("blocks > 1")
    if big.isEmpty():
        return links
    joined = big.select("node", "component", "n_shingles", "block", "blocks").join(components(links).withColumnRenamed("component", "now"), "node", "left").withColumn("now", F.coalesce("now", "node"))
    joined = written(joined, "joined")
    largest = joined.groupBy("component", "now").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("now", F.struct("n", -F.col("now"))).alias("main"), F.sum("n").alias("n"))
    rest = written(spread_join(joined, written(largest, "largest"), "component", "n", ["node"]).where("now <> main").drop("main", "now"), "rest")
    if rest.isEmpty():
        return links
    others = written(blocks_of(rest).select("component", F.col("blocks").alias("r")).join(sized.select("component", "n"), "component"), "others")
    every = spread_join(joined.drop("now"), others, "component", "n", ["node"])
    place = F.col("rest_block") * F.lit(1 << 31).cast("long") + F.col("block")
    one = spread_join(rest, others, "component", "n", ["node"]).withColumn("rest_block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("r")).cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    two = every.withColumn("rest_block", F.explode(F.sequence(F.lit(0), F.col("r") - 1).cast("array<long>")))
    wanted = one.select("node", F.col("component").alias("cluster"), place.alias("part")).unionByName(two.select("node", F.col("component").alias("cluster"), place.alias("part")))
    return links.unionByName(compared(wanted))


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable over links) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    signed = written(rows.mapInArrow(_signatures(shingle), "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>, sketch binary"), "signatures")
    some = signed.where("n_shingles > 0")
    heads = some.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies"))
    classes = written(heads, "classes")
    # one row for each class; doc_id is among the keys, so a class of very many copies does not meet
    entering = some.join(classes.select(F.col("head").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"]).dropDuplicates(["doc_id", "s1", "s2"])
    entering = written(entering.select("doc_id", "n_shingles", "keys", "sketch"), "entering")
    clusters = components(candidate_edges(entering.select("doc_id", "keys", "sketch")))
    placed = written(clusters.join(entering.select(F.col("doc_id").alias("node"), "n_shingles"), "node"), "clusters")
    found = components(_confirmed_links(rows, placed, shingle, percent))
    # class heads to their component, and every row to that of its class
    same = F.struct("s1", "s2", "n_shingles").alias("class")
    named = classes.join(found.withColumnRenamed("node", "head"), "head", "left").select(same, F.coalesce("component", "head").alias("component_id"), "copies")
    out = spread_join(signed.where("n_shingles > 0").select("doc_id", "n_shingles", same), written(named, "named"), "class", "copies", ["doc_id"]).drop("class")
    out = out.unionByName(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(back("doc_id"), "n_shingles", back("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))
