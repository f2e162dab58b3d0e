"""What the training-data operators share: tables, shared storage, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.plans.shared import discard, settle, settled_path, shared_dir

__all__ = ["blocks", "discard", "id_and_text", "in_batches", "join_counted", "settle", "settled_path", "shared_dir", "table", "tidy"]

#: Rows that a Python function holds as Python objects at once.
BLOCK_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key of more than one in so many rows is hot, so there are fewer hot keys than this; and into how many parts it is dealt.
HOT_SHARE, SALTS = 1024, 64


def join_counted(rows: DataFrame, stats: DataFrame, keys: list[str], count: str, spread: list[str]) -> DataFrame:
    """``rows`` joined with ``stats``, a settled table of one row per key that counts the key's ``rows``.

    A hot key's rows are dealt into SALTS parts, by the ``spread`` columns, and its
    row of ``stats`` goes to each part. Which keys are hot is broadcast: as the
    counts add up to the rows, fewer than HOT_SHARE keys can be.
    """
    total = stats.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    hot = F.broadcast(stats.where(is_hot).select(*keys, F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(hot, keys, "left").withColumn("_part", part).drop("_hot")
    return dealt.join(stats.withColumn("_part", F.explode(parts)), [*keys, "_part"]).drop("_part")


#: Rows and bytes of an Arrow batch: both the JVM and the Python worker hold some at once.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def in_batches(df: DataFrame, run, ddl: str) -> DataFrame:
    """``df.mapInArrow(run, ddl)`` with batches that a long text doesn't swell to hundreds of MB.

    Spark sizes batches by session settings only, so these are set here, unless the
    session has its own; they bound memory and change no result.
    """
    conf = df.sparkSession.conf
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if f"spark.sql.execution.arrow.{key}" not in conf.getAll:
            conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    return df.mapInArrow(run, ddl)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns the operators work on; null text is the empty text."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``max_bytes`` (one long row stays whole)."""
    try:
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                n = min(rows, batch.num_rows - start)
                while n > 1 and sum(c.nbytes for c in batch.slice(start, n).columns) > max_bytes:
                    n = (n + 1) // 2
                yield batch.slice(start, n)
                start += n
    finally:
        tidy()


def tidy() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
