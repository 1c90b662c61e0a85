"""Exact de-duplication by a tree merge of sorted digest runs, in DataFrame operations only.

Each input partition is a run: its distinct digests, each with the smallest document id and a count. Runs merge in rounds,
``fan_in`` at a time (binomial numbering: run r merges into r >> bits). In a round Spark sorts what meets by run, digest and id,
and one pass over that order keeps the first row of each digest, which has its smallest id; so at every level a digest occurs at
most ``fan_in`` times under one key, however many copies a text has. The way down hands each run the smallest id and the size of
the whole group.
A digest counts as verified by a second hash and the length of the text, which travel with it as part of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlake.llm.common import cut, fresh

KEY = ["_digest", "_check", "_length"]


def normalised(text: Column) -> Column:
    """Text with each run of ASCII white space as one space; null is empty.

    The pattern skips runs that are one space already, which is nearly all of them.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _merged(runs: DataFrame) -> DataFrame:
    """Runs merged in sorted order: each digest of a run once, with its smallest id (null only if all are) and its whole size."""
    order = Window.partitionBy("_run", *KEY).orderBy(F.col("_keep").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size, place = F.sum("_size").over(whole).alias("_size"), F.row_number().over(order).alias("_place")
    return runs.select("_run", *KEY, "_keep", size, place).where("_place = 1").drop("_place")


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in_bits: int = 4) -> DataFrame:
    """One row per input row: id, keep_id (smallest id with an equal text), group_size, kept, text_sha256.

    Defined cases: null and empty texts are equal to each other; a repeated row with the same id counts in group_size and all
    rows of the id that stays are marked kept; a null id never wins against an id and wins only among nulls (keep_id null,
    kept false unless it is the whole group); an empty table gives an empty table. Other columns are not read.
    """
    body = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    rows = cut(
        body.select(
            "_id",
            F.unhex(F.sha2("_text", 256)).alias("_digest"),
            F.xxhash64("_text").alias("_check"),
            F.length("_text").alias("_length"),
            F.spark_partition_id().alias("_run"),
        )
    )
    runs = (rows.agg(F.max("_run")).first()[0] or 0) + 1
    level = rows.groupBy("_run", *KEY).agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    levels = [level]
    while runs > 1:
        runs = -(-runs // (1 << fan_in_bits))
        level = _merged(level.withColumn("_run", F.shiftright("_run", fan_in_bits)))
        levels.append(level)
    found = levels.pop()
    while levels:
        below = levels.pop().select("_run", *KEY)
        up = found.withColumnRenamed("_run", "_up")
        found = (
            below.withColumn("_up", F.shiftright("_run", fan_in_bits)).join(up, ["_up", *KEY]).select("_run", *KEY, "_keep", "_size")
        )
    return rows.join(found, ["_run", *KEY]).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.coalesce(F.col("_id") == F.col("_keep"), F.col("_keep").isNull()).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, of those with its smallest id; the columns stay as they are.

    Rows are told apart by id and text together: two texts under one id are two groups. Of repeated rows with one id and text one
    stays. A row with a null id stays only where its whole group has null ids, and then one of them does.
    """
    own, digest, times = fresh(docs, "kept_id"), fresh(docs, "kept_digest"), fresh(docs, "kept_times")
    found = group_copies(docs, id_col, text_col).filter("kept")
    kept = cut(found.groupBy(F.col(id_col).alias(own), F.unhex("text_sha256").alias(digest)).agg(F.count(F.lit(1)).alias(times)))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256)) == F.col(digest))
    once = docs.join(kept.where(F.col(times) == 1), same, "left_semi")
    again = kept.where(F.col(times) > 1)
    if not again.take(1):
        return once
    repeated = docs.join(again, same).dropDuplicates([own, digest]).select([f"`{c}`" for c in docs.columns])
    return once.unionByName(repeated)
