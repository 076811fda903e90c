"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on the ring of 64-bit hashes, and a key belongs to the arc before
the next point clockwise. A shard takes the keys of its arcs up to its bound; those beyond it go on
clockwise to the next point whose shard has room. With bounds that add up to the number of rows
(floor or ceiling of the mean), all shards end within one row of each other, and only the overflow
leaves the shard that the ring names.

What overflows where depends only on how many keys each arc holds. These counts, shards * vnodes at
most whatever the number of rows, are gathered; the walk over them gives for each arc a few runs
(from rank, shard, slot), which are broadcast. A row's rank in its arc then gives its shard and its
slot. No group of rows is gathered: the ring mixes doc_id and text hash, so neither a hot key nor a
group of copies meets in one arc.

Null text counts as empty; a null doc_id is a key like any other; repeated rows get a slot each.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

POSITION_BITS = 62
BUCKET_BITS = 12


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Points of the ring in order: (position, shard)."""
    points = {}
    for s in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") >> (64 - POSITION_BITS)
            points[at] = s
    return sorted(points.items())


def position(*keys: Column) -> Column:
    """Place of a key on the ring."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - POSITION_BITS)


def runs(counts: dict[int, int], points: list[tuple[int, int]], shards: int, bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, from rank, to rank, shard, slot of the first) for the number of keys in each arc.

    First every arc gives its shard what fits, in order of the ring; then what is left moves on
    clockwise, point by point, in the same order.
    """
    n = len(points)
    free = list(bounds)
    taken: dict[int, list[tuple[int, int]]] = {}
    left: list[tuple[int, int]] = []
    for arc in range(n):
        if want := counts.get(arc, 0):
            s = points[arc][1]
            got = min(want, free[s])
            free[s] -= got
            if got:
                taken[arc] = [(s, got)]
            if want > got:
                left.append((arc, want - got))
    for arc, want in left:
        step = arc
        while want:
            step = (step + 1) % n
            s = points[step][1]
            if free[s]:
                got = min(want, free[s])
                free[s] -= got
                want -= got
                taken.setdefault(arc, []).append((s, got))
    slots = [0] * shards
    out = []
    for arc in sorted(taken):
        at = 0
        for s, got in taken[arc]:
            out.append((arc, at, at + got, s, slots[s]))
            slots[s] += got
            at += got
    return out


def bounds_by_rows(total: int, shards: int) -> list[int]:
    """Counts at most one apart."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def assign(rows: DataFrame, key: list[Column], shards: int, vnodes: int = 64) -> DataFrame:
    """The rows with shard and slot (gapless from 0 in each shard)."""
    spark = rows.sparkSession
    points = ring(shards, vnodes)
    ends = [p for p, _ in points]
    n = len(points)
    width = 1 << (POSITION_BITS - BUCKET_BITS)
    # arc i holds the positions above ends[i - 1] up to ends[i]; those above the last point belong to arc 0
    pieces = []
    for b in range(1 << BUCKET_BITS):
        lo, hi = b * width, (b + 1) * width - 1
        at = lo
        while at <= hi:
            i = bisect.bisect_left(ends, at)
            to = min(hi, ends[i]) if i < n else hi
            pieces.append((b, at, to, i % n))
            at = to + 1
    arcs = spark.createDataFrame(pieces, "__bucket int, __lo long, __hi long, __arc int")
    placed = rows.withColumn("__at", position(*key)).withColumn("__bucket", F.shiftrightunsigned("__at", POSITION_BITS - BUCKET_BITS).cast("int"))
    placed = placed.join(F.broadcast(arcs), (placed["__bucket"] == arcs["__bucket"]) & placed["__at"].between(arcs["__lo"], arcs["__hi"])).drop(placed["__bucket"]).drop(arcs["__bucket"]).drop("__lo", "__hi")
    counts = {r[0]: r[1] for r in placed.groupBy("__arc").count().collect()}  # one row for each point of the ring at most
    total = sum(counts.values())
    table = spark.createDataFrame(runs(counts, points, shards, bounds_by_rows(total, shards)), T.StructType.fromDDL("__arc int, __from long, __to long, shard int, __slot long"))
    order = Window.partitionBy("__arc").orderBy("__at", *(F.col(c) for c in rows.columns if dict(rows.dtypes)[c] in ("bigint", "int", "string")))
    ranked = placed.withColumn("__rank", F.row_number().over(order).cast("long") - 1)
    found = ranked.join(F.broadcast(table), (ranked["__arc"] == table["__arc"]) & (ranked["__rank"] >= table["__from"]) & (ranked["__rank"] < table["__to"]))
    return found.select(*(ranked[c] for c in rows.columns), table["shard"], (table["__slot"] + ranked["__rank"] - table["__from"]).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, vnodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    return assign(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards, vnodes)
