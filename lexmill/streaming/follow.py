"""Extensions for streams: search as documents arrive, and updates by trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.functions.fold import fold
from lexmill.operators.search import SearchOptions, occurrences
from lexmill.plans.build import BuildReport, update_index
from lexmill.plans.options import BuildOptions


def search_stream(documents: DataFrame, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Matches in a stream of documents (doc_id, file_path, entry_path, size, mtime_ns, content); no state is kept."""
    matcher = options.matcher(query)
    rows = documents.withColumn("content_fold", fold(F.col("content"))).withColumn("status", F.lit(0))
    rows = rows.where(matcher.candidate(F.col("content_fold")) & options.masks.accepts_document(F.col("file_path"), F.col("entry_path")))
    return occurrences(rows.withColumn("starts", matcher.starts(F.col("content"), F.col("content_fold"))), options)


def update_on(changes: DataFrame, spark: SparkSession, path: str, options: BuildOptions, checkpoint: str, seen: Callable[[BuildReport], None] = lambda r: None) -> StreamingQuery:
    """Bring the index up to date whenever the stream of changes has rows; an update twice is harmless."""

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            seen(update_index(spark, path, options))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
