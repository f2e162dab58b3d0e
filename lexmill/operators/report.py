"""Reports of a build from what became of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many extensions a profile shows, and how many errors a report details.
TOP_EXTENSIONS, DETAILED_ERRORS = 5, 1000


def top_extensions(documents: DataFrame, most: int = TOP_EXTENSIONS) -> DataFrame:
    """The commonest extensions of indexed documents; ties by name."""
    rows = documents.where("status = 0 AND ext IS NOT NULL").groupBy("ext").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "ext").limit(most)


def pruned_directories(staged: DataFrame) -> DataFrame:
    return staged.where("fate = 'pruned_dir'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def build_counters(staged: DataFrame) -> DataFrame:
    """One row of counters over staged rows (fate, entry_path, status, size, read, kind, fallback, content)."""
    entry, fate = F.col("entry_path").isNotNull(), F.col("fate")
    is_ = lambda *x: fate.isin(*x)
    files = ~entry & ~is_("pruned_dir", "scan_error", "archive_limit", "archive_opened")
    return staged.agg(
        F.count_distinct(F.when(files | is_("archive_limit", "archive_opened"), F.col("file_path"))).alias("files_seen"),
        F.count_if(is_("ignored_name", "ignored_sniff", "ignored_disabled")).alias("files_ignored"),
        F.count_if(is_("ignored_name") & ~entry).alias("files_ignored_by_name"),
        F.count_if(is_("ignored_sniff") & ~entry).alias("files_ignored_by_sniff"),
        F.count_if(is_("pruned_dir")).alias("directories_excluded"),
        F.count_if(is_("indexed")).alias("files_indexed"),
        F.count_if(is_("too_large")).alias("files_too_large"),
        F.count_if(is_("security", "archive_limit")).alias("files_security_limited"),
        F.count_if(is_("error", "scan_error")).alias("errors"),
        F.count_if(F.coalesce("fallback", F.lit(False))).alias("fallback_decodes"),
        F.count_if(is_("archive_opened")).alias("archives"),
        F.count_if(is_("indexed") & entry).alias("archive_entries_indexed"),
        F.count_if(is_("ignored_name") & entry).alias("archive_entries_skipped_by_name"),
        F.count_if(is_("ignored_sniff") & entry).alias("archive_entries_ignored_by_sniff"),
        F.count_if(is_("error") & entry).alias("archive_entries_errored"),
        F.count_if(is_("security") & entry).alias("archive_entries_security_limited"),
        F.coalesce(F.sum(F.when(entry, F.col("read"))), F.lit(0)).cast("long").alias("archive_bytes_decompressed"),
        F.coalesce(F.sum("read"), F.lit(0)).cast("long").alias("bytes_read"),
        F.coalesce(F.sum(F.when(is_("indexed"), F.octet_length("content"))), F.lit(0)).cast("long").alias("bytes_indexed"),
    )


def errors(staged: DataFrame, most: int = DETAILED_ERRORS) -> tuple[DataFrame, int]:
    """The first errors in order of path, and how many there are in all."""
    rows = staged.where(F.col("fate").isin("error", "scan_error"))
    return rows.select("file_path", "entry_path", "reason").orderBy("file_path", F.col("entry_path").asc_nulls_first()).limit(most), rows.count()
