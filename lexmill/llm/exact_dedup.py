"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import id_and_text, join_counted, settle

#: Into how many groups the local winners of one text are dealt.
SALTS = 16


def combine_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: ``sha, fp, n_bytes, text, keep_id, group_size``.

    Three stages compare whole texts, since the text is part of every grouping
    key. Each task first combines its own rows (the map side of the aggregation:
    a task sends one row per text, however many copies it read). The winners of
    the tasks are merged in ``salts`` groups per text, and the salt winners are
    combined globally, so the last group of a text has ``salts`` rows at most.
    """
    rows = id_and_text(df, id_col, text_col).select(
        "doc_id",
        "text",
        F.unhex(F.sha2("text", 256)).alias("sha"),
        F.xxhash64("text").alias("fp"),
        (F.spark_partition_id() % F.lit(salts)).alias("salt"),
    )
    merged = rows.groupBy("sha", "fp", "text", "salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    whole = merged.groupBy("sha", "fp", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return whole.withColumn("n_bytes", F.octet_length("text").cast("long"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; a null text counts as empty, and all empty
    texts are copies of each other. Of equal texts exactly one row stays: the one
    with the largest id. A null id loses against any other; a text that only rows
    without an id hold has a null ``keep_id``, and one of these rows is ``kept``.
    Rows that repeat an id are rows of their own: each counts in ``group_size``,
    and of rows that repeat an id and a text at most one is kept. Further columns
    of ``df`` are ignored, and an empty table gives an empty result.

    The winners go back to the documents by a join on SHA-256, a second hash and
    the length; were two different texts ever to agree in all three, the query
    fails instead of mixing them up. Only ids and hashes move in that join. Rows
    of one id and text are counted before it and told apart behind it, and the
    texts with the most copies are dealt into parts.
    """
    keys = ["sha", "fp", "n_bytes"]
    winners = (
        combine_copies(df, id_col, text_col, salts)
        .groupBy(*keys)
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("n"))
        .select(*keys, "keep_id", F.when(F.col("n") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts agree in SHA-256, hash and length"))).alias("group_size"))
    )
    docs = id_and_text(df, id_col, text_col).select(
        "doc_id",
        F.unhex(F.sha2("text", 256)).alias("sha"),
        F.xxhash64("text").alias("fp"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )
    docs = docs.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("copies"))
    joined = join_counted(docs, settle(winners, "winners"), keys, "group_size", ["doc_id"])
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


#: The same in SQL.
EXACT_DEDUP_SQL = """
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256
FROM (
  SELECT doc_id,
         row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) AS place,
         max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
         sha256(coalesce(text, '')) AS text_sha256
  FROM documents
)
"""
