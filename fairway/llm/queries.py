"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest, leaks, lines, pieces, quality, ring, substrings, syncmers, tokens, urls
from fairway.session import table

TOKEN_LIMIT = 1024


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    return pieces.encode(table(spark, sf_dir, "documents"))


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_probe(table(spark, sf_dir, "documents"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, machine)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: counts of shards are at most one apart."""
    placed = ring.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _op10_sql() -> str:
    weights, bias = urls.production_model()
    table = "[" + ", ".join(str(round(x * 1e6)) for x in weights) + "]"
    rules = ", ".join(f"('{says}', '{text[: text.index('/')]}', '{text[text.index('/') :]}', '{text}')" for says, text in urls.RULES)
    return f"""
with rest as (
  select page_id, coalesce(case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') end, '') as r from pages),
parts as (
  select page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         substr(r, length(regexp_extract(r, '^[^/]*')) + 1) as path from rest),
coded as (
  select *, list_transform(range(1, length(host) + length(path) + 3), lambda i: unicode(substr('^' || host || path || '$', i, 1))) as codes from parts),
scored as (
  select page_id, host, path, len(codes) - 2 as n,
         list_sum(list_transform(range(1, len(codes) - 1), lambda i: ({table})[((codes[i] * 31 + codes[i + 1]) * 31 + codes[i + 2]) % {urls.BUCKETS} + 1])) as total
  from coded),
rules(says, h, p, rule) as (values {rules}),
fits as (
  select page_id, max_by(rule, length(rule)) as rule, max_by(says, length(rule)) as says
  from parts, rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select s.page_id, host, path, rule,
       coalesce(says, case when {bias} + coalesce(total, 0)::double / 1e6 / sqrt(greatest(n, 1)::double) > {urls.CUT} then 'block' else 'allow' end) as verdict
from scored s left join fits f on s.page_id = f.page_id"""


_WORD = r"[^\x20\x09-\x0D]+"

_OP4_SQL = f"""
with cut as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
windows as (
  select doc_id, s, array_to_string(ws[s:s + {substrings.WINDOW - 1}], ' ') as t from (select doc_id, ws, unnest(range(1, len(ws) - {substrings.WINDOW - 2})) as s from cut)),
ranked as (select doc_id, s, row_number() over (partition by t order by doc_id, s) as k from windows),
gone as (select distinct doc_id, unnest(range(s, s + {substrings.WINDOW})) as pos from ranked where k > 1),
spread as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as pos from cut),
kept as (select doc_id, string_agg(w, ' ' order by pos) as t from spread anti join gone using (doc_id, pos) group by doc_id),
counted as (select doc_id, count(*) as n from gone group by doc_id)
select c.doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from cut c left join kept k on k.doc_id = c.doc_id left join counted g on g.doc_id = c.doc_id"""

_OP6_SQL = f"""
with recursive cut as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as ws from documents),
sets as (
  select distinct doc_id, array_to_string(ws[s:s + 3], ' ') as h from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as s from cut where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from sets a join sets b on a.h = b.h join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id where a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach(doc_id, goal) as (select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join links l on l.a = r.goal),
least_of as (select doc_id, min(goal) as component_id from reach group by doc_id)
select l.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, l.doc_id = component_id as kept from least_of l left join sizes s on s.doc_id = l.doc_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_syncmers": op2_syncmers,
    "op3_line_templates": op3_line_templates,
    "op4_substrings": op4_substrings,
    "op5_leaks": op5_leaks,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_token_counts": op9_token_counts,
    "op10_url_filter": op10_url_filter,
}
ORACLES: dict[str, str] = {
    "op3_line_templates": f"with {lines.sql('documents')} select doc_id, n_lines, n_dropped, md5(text) as kept_md5 from line_dedup",
    "op5_leaks": f"with {leaks.sql('documents')} select * from leaked",
    "op4_substrings": _OP4_SQL,
    "op6_near_duplicates": _OP6_SQL,
    "op10_url_filter": _op10_sql(),
}
