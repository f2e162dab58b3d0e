"""Incremental update as a difference of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def previous_paths(documents: DataFrame) -> DataFrame:
    """One row per path of the previous snapshot: its own row's size and time, or its entries' times."""
    own = F.col("entry_path").isNull()
    return documents.groupBy("file_path").agg(
        F.max(F.when(own, F.struct("size", "mtime_ns"))).alias("own"),
        F.count_if(~own).alias("entries"),
        F.count_if(~own & F.col("mtime_ns").isNull()).alias("untimed"),
        F.min(F.when(~own, F.col("mtime_ns"))).alias("least"),
        F.max(F.when(~own, F.col("mtime_ns"))).alias("most"),
    )


def diff(listing: DataFrame, documents: DataFrame, archives_enabled: bool = True) -> DataFrame:
    """``file_path, fate``: added, modified, unchanged or deleted, by a full outer join on the path.

    ``listing``: file_path, size, mtime_ns, kind. A path is unchanged if its own
    row has the same size and time, or, of an archive, all entries have its time. An
    archive is never unchanged while archives are off.
    """
    seen = listing.select("file_path", F.col("size").alias("now_size"), F.col("mtime_ns").alias("now_mtime"), "kind", F.lit(True).alias("seen"))
    both = seen.join(previous_paths(documents), "file_path", "full_outer")
    own = (F.col("own.size") == F.col("now_size")) & F.col("own.mtime_ns").eqNullSafe(F.col("now_mtime"))
    timed = (F.col("untimed") == 0) & (F.col("least") == F.col("now_mtime")) & (F.col("most") == F.col("now_mtime"))
    untimed = F.col("now_mtime").isNull() & (F.col("untimed") == F.col("entries"))
    same = F.when(F.col("own").isNotNull(), own).otherwise(F.coalesce(timed | untimed, F.lit(False)))
    if not archives_enabled:
        same = same & (F.col("kind") != "archive")
    fate = F.when(F.col("seen").isNull(), "deleted").when(F.col("entries").isNull(), "added").when(same, "unchanged").otherwise("modified")
    return both.select("file_path", fate.alias("fate"))


def delta(fates: DataFrame) -> DataFrame:
    return fates.agg(F.count_if(F.col("fate") == "added").alias("added"), F.count_if(F.col("fate") == "deleted").alias("removed"), F.count_if(F.col("fate") == "modified").alias("updated"), F.count_if(F.col("fate") == "unchanged").alias("unchanged"))


def kept_rows(documents: DataFrame, fates: DataFrame) -> DataFrame:
    """Rows of the previous snapshot whose path is neither changed nor gone."""
    gone = fates.where(F.col("fate").isin("modified", "deleted")).select("file_path")
    return documents.join(gone, "file_path", "left_anti")
