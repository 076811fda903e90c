"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, SentencePiece ids.

Every stage takes the documents its predecessor kept, as read back from Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairway.llm import forest, leaks, lines, pieces, quality
from fairway.session import delete, fresh, new_table, scratch, table, write, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SHINGLE = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts are scored as empty ones; equal rows stay or go together."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs.columns, "score")
    return quality.score(docs, machine).toDF(*docs.columns, score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go but for the first. A document left without any text goes too; null texts and empty ones that lost nothing stay.

    ``n_chars``, where there is one, is that of the text left.
    """
    names = docs.columns
    n_lines = fresh(names, "n_lines")
    dropped = fresh([*names, n_lines], "n_dropped")
    cut = lines.dedup_lines(docs).toDF(*names, n_lines, dropped)
    cut = cut.where((F.col(dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*names)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class.

    Where a doc_id is missing or repeated, rows are compared one by one (no doc_id first, then by
    doc_id and text), and of rows equal in doc_id and text one stays. Texts without words, null ones
    among them, are alike to nothing and all stay.
    """
    names = docs.columns
    row = fresh(names, "row")
    rows = docs.withColumn(row, F.col("doc_id").cast("long"))
    if not rows.groupBy(row).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(row).isNull()).isEmpty():
        order = ["doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), "text"]
        rows = docs.dropDuplicates(["doc_id", "text"]).repartitionByRange(*order).sortWithinPartitions(*order)
        rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "numbered")  # numbers follow doc_id, as parts are ranges of it
    found = forest.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), shingle=SHINGLE, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(gone.hint("merge"), row, "left_anti").select(*names)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no benchmark item; null and empty texts hold none. Rows of one doc_id are judged each by its own text."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, and whether the ids decode to the text; all null for a null text."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: The classifier and the piece encoder are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written to the shared folder and read back for the next. A stage's own tables go when it is written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        path = new_table(spark, "stage")
        with scratch(spark):
            write(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
