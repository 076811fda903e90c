"""Joins of rows with a table of their keys when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, table: DataFrame, key: str, count: str, salt: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and says in ``count`` how many rows hold it.

    Keys with more than an even share of the rows are dealt over all partitions by a hash of ``salt``,
    with their row of the table copied to each. There are fewer such keys than partitions, so their
    list is small whatever the data. ``table`` is read more than once and should be a written one.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = table.where(F.col(count) > total / parts).select(key).limit(parts)
    found = hot.collect()  # fewer than parts keys
    if not found or parts < 2:
        return rows.join(table.drop(count).hint("merge"), key, how)
    listed = F.broadcast(spark.createDataFrame(found, hot.schema).withColumn("__hot", F.lit(True)))
    dealt = rows.join(listed, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*salt), F.lit(parts)).cast("int")).otherwise(0)).drop("__hot")
    copied = table.drop(count).join(listed, key, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return dealt.join(copied.hint("merge"), [key, "__salt"], how).drop("__salt")
