"""Line dedup by a log-template tree.

Lines are the parts between line breaks; tokens are runs outside ``\\x20 \\x09-\\x0D``, and a token
with a digit is a variable field (``<*>``). The tree has fixed depth: number of tokens, then the
first ``LEAD`` tokens, then a leaf. The lines of a leaf share one template: at each place the token
that at least half of the leaf's lines hold, and at least two of them, else a variable field. A line
belongs to the template if it agrees with ``SIMILARITY`` of its places; other lines of the leaf stand
for themselves (with their variable fields). A template or line found in enough different texts recurs
across documents: its first line (least doc_id, then place) stays, all others are dropped.

Enough depends on the length: ``SHORT_DOCS`` texts for lines under ``MIN_TOKENS`` tokens, ``min_docs`` for
the others, and for long lines also the fewer texts of ``LONG``, where a line must agree with ``CLOSE``
of the places of the template. A short line of variable fields alone is compared as it is written.
Lines without a token never go.

Exact copies of a text count once, so copied documents do not make their own lines recur. Null text
stays null (0 lines), an empty text has one empty line. Rows that share a doc_id are told apart by
their texts; rows equal in both get equal results, and a null doc_id comes first. Of equal places of
one template the least (doc_id, hash of the text, place) is first. An empty table gives an empty one.
Very long texts and lines are whole. Only JVM expressions are used. Leaves short of texts are set
aside before any tokens move; leaves and units that hold much of the lines are spread over partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairway.operators.skew import spread_join
from fairway.session import written

MIN_DOCS = 10
LEAD = 3
SIMILARITY = 0.6
MIN_TOKENS = 4
SHORT_DOCS = 20
#: Least number of tokens of a long line, and in how many texts it recurs.
LONG = ((50, 2), (20, 5))
CLOSE = 0.8
NO_ID = -(1 << 63)
_RARE_GAPS = "\t\x0b\x0c\r"  # besides the space; a line break parts lines


def _tokens(line: Column) -> Column:
    """Parts at single spaces, which needs no pattern; the rare other gaps become spaces first."""
    odd = F.lit(False)
    for c in _RARE_GAPS:
        odd |= F.contains(line, F.lit(c))
    spaced = F.when(odd, F.translate(line, _RARE_GAPS, " " * len(_RARE_GAPS))).otherwise(line)
    return F.array_remove(F.split(spaced, " "), "")


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, drops): the places of the lines to drop; ``docs`` has doc_id, text_key, text."""
    size = F.size("tokens")
    wide = F.when(size < MIN_TOKENS, SHORT_DOCS).otherwise(min_docs)
    close = F.lit(None).cast("int")
    for least, texts in reversed(LONG):
        close = F.when(size >= least, texts).otherwise(close)
    lines = docs.where("text is not null").select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    # tokens are a column while the leaf is found; lines are written with their leaf, as both the counts and the tokens need them
    lines = lines.select("*", _tokens(F.col("line")).alias("tokens")).where(size >= 1)
    bare = (size < MIN_TOKENS) & F.forall("tokens", lambda t: t.rlike("[0-9]"))
    lead = F.slice("tokens", 1, LEAD)
    leaf = F.xxhash64(size, F.when(bare, lead).otherwise(_masked(lead)))
    lines = written(lines.select("doc_id", "text_key", "place", "line", leaf.alias("leaf"), F.least(wide, close).alias("need")), "split")
    by_text = lines.groupBy("leaf", "text_key").agg(F.min("need").alias("need"), F.count(F.lit(1)).alias("n"))
    shared = by_text.groupBy("leaf").agg(F.count(F.lit(1)).alias("texts"), F.min("need").alias("need"), F.sum("n").alias("n")).where(F.col("texts") >= F.col("need"))
    shared = written(shared.select("leaf", "n"), "leaves")
    full = spread_join(lines.drop("need"), shared, "leaf", "n", ["doc_id", "place"])
    full = full.select("doc_id", "text_key", "place", "leaf", F.col("line").rlike("[0-9]").alias("fields"), _tokens(F.col("line")).alias("tokens"))
    full = written(full.select("doc_id", "text_key", "place", "leaf", F.when(F.col("fields"), _masked(F.col("tokens"))).otherwise(F.col("tokens")).alias("tokens")), "lines")
    held = full.select("leaf", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("n"))
    modal = held.groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("all"))
    fixed = (2 * F.col("top.n") >= F.col("all")) & (F.col("top.n") >= 2)
    modal = modal.select("leaf", "at", "all", F.when(fixed, F.col("top.token")).otherwise("<*>").alias("token"))
    template = modal.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("t"), F.max("all").alias("n")).select("leaf", F.col("t.token").alias("template"), "n")
    placed = spread_join(full, written(template, "templates"), "leaf", "n", ["doc_id", "place"])
    agree = F.aggregate(F.zip_with("tokens", "template", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    placed = placed.select("doc_id", "text_key", "place", "leaf", "tokens", agree.alias("agree"))
    # the two counts of a line go in one shuffle: the flag in the hash keeps their units apart
    unit = lambda part, flag: F.when(F.col("agree") >= part * size, F.xxhash64("leaf", F.lit(flag))).otherwise(F.xxhash64("leaf", F.lit(flag), "tokens"))
    one, two = F.struct(unit(SIMILARITY, 0).alias("unit"), wide.alias("need")), F.struct(unit(CLOSE, 1).alias("unit"), close.alias("need"))
    placed = placed.select("doc_id", "text_key", "place", F.explode(F.when(close.isNotNull(), F.array(one, two)).otherwise(F.array(one))).alias("x"))
    placed = written(placed.select("doc_id", "text_key", "place", "x.unit", "x.need"), "placed")
    by_text = placed.groupBy("unit", "text_key").agg(F.min(F.struct("doc_id", "text_key", "place")).alias("first"), F.min("need").alias("need"), F.count(F.lit(1)).alias("n"))
    recurring = by_text.groupBy("unit").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.min("need").alias("need"), F.sum("n").alias("n")).where(F.col("texts") >= F.col("need"))
    gone = spread_join(placed.drop("need"), written(recurring.select("unit", "first", "n"), "units"), "unit", "n", ["doc_id", "place"])
    return gone.where(F.struct("doc_id", "text_key", "place") != F.col("first")).groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("drops"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text") -> DataFrame:
    """All columns of the documents, ``text`` without its dropped lines, and then n_lines and n_dropped (by place, so any names may clash)."""
    names = docs.columns
    at = names.index(text)
    alias = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*alias).withColumns({"doc_id": F.coalesce(F.col(alias[names.index("doc_id")]).cast("long"), F.lit(NO_ID)), "text_key": F.xxhash64(F.coalesce(F.col(alias[at]), F.lit("")))})
    drops = dropped_lines(rows.select("doc_id", "text_key", F.col(alias[at]).alias("text")), min_docs)
    joined = rows.join(drops.hint("merge"), ["doc_id", "text_key"], "left")  # drops grow with the documents, so they are never broadcast
    lines = F.split(F.col(alias[at]), "\n")
    kept = F.when(F.col("drops").isNull(), F.col(alias[at])).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drops", i)), "\n"))
    out = joined.select(*(kept.alias(a) if i == at else F.col(a) for i, a in enumerate(alias)), F.coalesce(F.size(lines), F.lit(0)).alias("l"), F.coalesce(F.size("drops"), F.lit(0)).alias("d"))
    sizes = out.select(*alias, F.greatest("l", F.lit(0)).cast("long").alias("l"), F.greatest("d", F.lit(0)).cast("long").alias("d"))
    return sizes.toDF(*names, "n_lines", "n_dropped")


def sql(source: str, min_docs: int = MIN_DOCS) -> str:
    """DuckDB common table expressions ending in ``line_dedup`` (columns of the source, then n_lines, n_dropped)."""
    gap = r"[\x20\x09-\x0D]+"
    wide = f"case when len(tokens) < {MIN_TOKENS} then {SHORT_DOCS} else {min_docs} end"
    close = "case " + " ".join(f"when len(tokens) >= {least} then {texts}" for least, texts in LONG) + " end"
    unit = lambda part, flag: f"'{flag} ' || f.leaf || case when agree >= {part} * len(tokens) then '' else chr(10) || array_to_string(tokens, ' ') end"
    return f"""
ld_lines as (
  select doc_id, text as whole, i - 1 as place, list_filter(string_split_regex(line, '{gap}'), lambda t: t <> '') as raw
  from (select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from {source} where text is not null)),
ld_masked as (
  select *, list_transform(raw, lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as tokens from ld_lines where len(raw) >= 1),
ld_leafed as (
  select *, {wide} as wide, {close} as close, len(tokens)::varchar || ' ' || array_to_string(
    case when len(tokens) < {MIN_TOKENS} and len(list_filter(tokens, lambda t: t <> '<*>')) = 0 then raw else tokens[1:{LEAD}] end, ' ') as leaf from ld_masked),
ld_shared as (select leaf from ld_leafed group by leaf having count(distinct whole) >= min(least(wide, coalesce(close, wide)))),
ld_full as (select * from ld_leafed where leaf in (select leaf from ld_shared)),
ld_held as (
  select leaf, pos, token, count(*) as n
  from (select leaf, unnest(tokens) as token, unnest(range(1, len(tokens) + 1)) as pos from ld_full) group by leaf, pos, token),
ld_modal as (
  select leaf, pos, case when 2 * max(n) >= sum(n) and max(n) >= 2 then max(struct_pack(n := n, token := token)).token else '<*>' end as token from ld_held group by leaf, pos),
ld_template as (select leaf, list(token order by pos) as template from ld_modal group by leaf),
ld_agreed as (
  select f.*, list_sum(list_transform(range(1, len(tokens) + 1), lambda i: (tokens[i] = template[i])::int)) as agree from ld_full f join ld_template t on f.leaf = t.leaf),
ld_placed as (
  select doc_id, whole, place, wide as need, {unit(SIMILARITY, 0)} as unit from ld_agreed f
  union all select doc_id, whole, place, close, {unit(CLOSE, 1)} from ld_agreed f where close is not null),
ld_recurring as (
  select unit, min(struct_pack(d := doc_id, p := place)) as first from ld_placed group by unit having count(distinct whole) >= min(need)),
ld_gone as (
  select doc_id, list(distinct place) as drops from ld_placed p join ld_recurring r on p.unit = r.unit where not (doc_id = first.d and place = first.p) group by doc_id),
line_dedup as (
  select s.* replace (case when g.drops is null then s.text
       else array_to_string(list_filter(list_transform(range(1, len(string_split(s.text, chr(10))) + 1),
              lambda i: case when list_contains(g.drops, i - 1) then null else string_split(s.text, chr(10))[i] end), lambda x: x is not null), chr(10)) end as text),
       coalesce(len(string_split(s.text, chr(10))), 0)::bigint as n_lines, coalesce(len(g.drops), 0)::bigint as n_dropped
  from {source} s left join ld_gone g on s.doc_id = g.doc_id)"""
