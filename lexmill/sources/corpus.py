"""Tables of texts as an indexed corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.fold import fold

#: States of a document.
INDEXED, TOO_LARGE, ERROR, SECURITY = 0, 2, 3, 4
MAX_FILE_SIZE = 16 << 20
CORPUS_COLUMNS = ("doc_id", "file_path", "entry_path", "ext", "size", "mtime_ns", "status", "reason", "content", "content_fold")


def indexed(df: DataFrame, doc_id: Column, file_path: Column, entry_path: Column, ext: str, content: Column, mtime_ns: Column, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """``df`` in the shape of a snapshot: texts over ``max_size`` bytes are too large and have no content to search."""
    size = F.octet_length(content).cast("long")
    status = F.when(size > max_size, TOO_LARGE).otherwise(INDEXED)
    return df.select(
        doc_id.cast("long").alias("doc_id"), file_path.alias("file_path"), entry_path.cast("string").alias("entry_path"), F.lit(ext).alias("ext"),
        size.alias("size"), mtime_ns.cast("long").alias("mtime_ns"), status.alias("status"), F.lit(None).cast("string").alias("reason"),
        content.alias("content"), F.when(status == INDEXED, fold(content)).alias("content_fold"),
    )


def _mtime(doc_id: Column) -> Column:
    """A made-up time for each id; every tenth has none."""
    return F.when(doc_id % 10 != 9, F.lit(1_700_000_000_000_000_000) + doc_id * F.lit(61_000_000_007))


def documents(spark: SparkSession, sf_dir: str, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return indexed(df, F.col("doc_id"), path, F.lit(None), "txt", F.col("text"), _mtime(F.col("doc_id")), max_size)


def pages(spark: SparkSession, sf_dir: str, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return indexed(df, F.col("page_id"), path, F.lit(None), "html", F.col("html"), _mtime(F.col("page_id")), max_size)


def conversations(spark: SparkSession, sf_dir: str, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """One archive for each conversation, one entry for each turn."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".zip"))
    entry = F.concat("role", F.lit("/"), F.col("turn").cast("string"), F.lit(".txt"))
    doc_id = F.col("conv_id") * 1000 + F.col("turn")
    return indexed(df, doc_id, path, entry, "txt", F.col("text"), _mtime(F.col("conv_id")), max_size)


def benchmark(spark: SparkSession, sf_dir: str, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    path = F.concat(F.lit("bench/"), F.col("item_id").cast("string"), F.lit(".md"))
    return indexed(df, F.col("item_id"), path, F.lit(None), "md", F.col("text"), _mtime(F.col("item_id")), max_size)
