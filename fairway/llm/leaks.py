"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by size: class c holds items of 2**c to 2**(c + 1) - 1 distinct shingles, and
its MinHash signature is the least floor(0.2 * (2**(c + 1) - 1)) + ``SPARE`` hashes of an item (all, if it
has fewer). A document that holds 80 % of an item's n shingles lacks at most floor(0.2 * n) of them,
so of a signature of s hashes it holds at least s - floor(0.2 * n): documents below that estimate of
containment go, and none that holds the item is among them, whatever its length. A signature of the
document would drown the item, so documents are looked up with all their shingles. What is left is
verified by the exact share of the item's shingles.

A shingle is ``shingle`` consecutive words; words are runs of letters and digits in lower case. Items
under that many words have no shingle and match nothing, as do null and empty texts; an empty table
of either kind finds nothing. Rows that share a doc_id, or have none, are told apart by their texts
(by a 64-bit hash of it), so a leak in one takes no other row with it; equal rows are one. Equal items
are each found. Very long texts are whole. Other columns pass through, whatever their names.
Only JVM expressions are used. Item shingles are broadcast only up to BROADCAST_BYTES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
SPARE = 4
BROADCAST_BYTES = 16 << 20
NO_ID = -(1 << 63)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _hashes(words: Column, n: int) -> Column:
    """Hash of every run of n words."""
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    return F.transform(F.slice(words, 1, count), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, n))))


def item_shingles(items: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, n, h, rank): distinct shingles of each item, in order of hash from 1."""
    words = items.where("text is not null").select("item_id", _words(F.col("text")).alias("w"))
    sets = words.select("item_id", F.array_sort(F.array_distinct(_hashes(F.col("w"), shingle))).alias("hs")).where(F.size("hs") > 0).distinct()
    return sets.select("item_id", F.size("hs").alias("n"), F.posexplode("hs").alias("p", "h")).select("item_id", "n", "h", (F.col("p") + 1).alias("rank"))


def found_leaks(rows: DataFrame, items: DataFrame, shingle: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, text_key, item_id, n, n_shared) of every row (doc_id, text_key, text) that holds an item."""
    percent = round(100 * contained)
    parts = item_shingles(items, shingle)
    top = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1  # largest size of the class
    lacks = lambda n: F.floor(n * (100 - percent) / 100)
    length = F.least(F.col("n"), lacks(top) + SPARE)
    signature = parts.where(F.col("rank") <= length).select("item_id", "h", (length - lacks(F.col("n"))).cast("int").alias("need"))
    size = parts.agg(F.sum(F.lit(32) + F.length(F.col("item_id").cast("string")))).first()[0] or 0

    def small(df: DataFrame) -> DataFrame:  # beyond the bound the join shuffles
        return F.broadcast(df) if size <= BROADCAST_BYTES else df

    shingled = rows.select("doc_id", "text_key", _words(F.col("text")).alias("w")).select("doc_id", "text_key", F.explode(_hashes(F.col("w"), shingle)).alias("h"))
    hits = shingled.join(small(signature), "h").select("doc_id", "text_key", "item_id", "need", "h").distinct()
    candidates = hits.groupBy("doc_id", "text_key", "item_id").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n >= need")
    wanted = candidates.groupBy("doc_id", "text_key").agg(F.collect_set("item_id").alias("items"))
    # words are a column of their own: inside the hashing lambda they would be split anew for every word
    again = rows.join(wanted.hint("merge"), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", "items", _words(F.col("text")).alias("w"))
    again = again.select("doc_id", "text_key", "items", F.explode(F.array_distinct(_hashes(F.col("w"), shingle))).alias("h"))
    held = again.join(small(parts), "h").where(F.array_contains("items", F.col("item_id")))
    return held.groupBy("doc_id", "text_key", "item_id", "n").agg(F.count(F.lit(1)).alias("n_shared")).where(100 * F.col("n_shared") >= percent * F.col("n"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_key"), docs["text"].alias("text"))


def leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every document that holds an item."""
    once = found_leaks(_rows(docs), items, shingle, contained).groupBy("doc_id", "item_id", "n").agg(F.max("n_shared").alias("n_shared"))
    return once.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "item_id", F.col("n").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"), F.round(F.col("n_shared") / F.col("n"), 6).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose own text holds no item; all columns stay."""
    names = docs.columns
    alias = [f"c{i}" for i in range(len(names))]
    at = {c: alias[names.index(c)] for c in ("doc_id", "text")}
    keyed = docs.toDF(*alias).withColumns({"doc_id": F.coalesce(F.col(at["doc_id"]).cast("long"), F.lit(NO_ID)), "text_key": F.xxhash64(at["text"])})
    found = found_leaks(_rows(docs), items).select("doc_id", "text_key").distinct()
    return keyed.join(found.hint("merge"), ["doc_id", "text_key"], "left_anti").select(*alias).toDF(*names)


def sql(source: str, shingle: int = SHINGLE, contained: float = CONTAINED) -> str:
    """DuckDB common table expressions ending in ``leaked``."""
    def shingles(name: str, table: str, key: str) -> str:
        return f"""
{name}_w as (select {key}, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') as w from {table} where text is not null),
{name} as (select distinct {key}, unnest(list_transform(range(1, len(w) - {shingle - 2}), lambda i: array_to_string(w[i:i + {shingle - 1}], ' '))) as s from {name}_w where len(w) >= {shingle})"""
    return f"""{shingles("lk_doc", source, "doc_id")},{shingles("lk_item", "benchmark", "item_id")},
lk_size as (select item_id, count(*) as n from lk_item group by item_id),
leaked as (
  select d.doc_id, i.item_id, n as n_item, count(*) as n_shared, round(count(*) / n, 6) as containment
  from lk_doc d join lk_item i on d.s = i.s join lk_size z on z.item_id = i.item_id
  group by d.doc_id, i.item_id, n having 100 * count(*) >= {round(100 * contained)} * n)"""
