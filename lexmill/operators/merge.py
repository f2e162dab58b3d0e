"""Results of several indexes as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.paths import path_key


def tagged(results: list[tuple[str, DataFrame]]) -> DataFrame:
    """Results of (project, rows) in order of selection; a project named twice counts once."""
    rows = [df.withColumns({"project_id": F.lit(p), "target": F.lit(i)}) for i, (p, df) in enumerate(dict(reversed(list(reversed(results)))).items())]
    return reduce(DataFrame.unionByName, rows)


def first_wins(rows: DataFrame) -> DataFrame:
    """Of each physical file the whole result of the first project that reports it; matches are never merged."""
    one = Window.partitionBy(path_key(F.col("file_path")), "entry_path").orderBy("target", "file_path", "doc_id")
    return rows.withColumn("rank", F.row_number().over(one)).where("rank = 1").drop("rank")


def merged_counters(rows: DataFrame) -> DataFrame:
    """Plain sums: candidates of each index, never unique files."""
    names = [c for c in rows.columns if c not in ("project_id", "target")]
    return rows.agg(*[F.sum(c).alias(c) for c in names])


def selected(projects: DataFrame, wanted: list[str]) -> tuple[list[str], int]:
    """The wanted ids that exist, in order and once each, and how many are missing."""
    ids = list(dict.fromkeys(wanted))
    there = {r[0] for r in projects.where(F.col("id").isin(*ids)).select("id").collect()} if ids else set()
    return [i for i in ids if i in there], len([i for i in ids if i not in there])
