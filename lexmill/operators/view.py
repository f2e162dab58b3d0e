"""The result list as it is shown: filter, order, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.masks import NameMasks, parse_masks
from lexmill.functions.paths import components, extension, result_leaf, result_path
from lexmill.plans.shared import settle

SORT_KEYS = ("path", "name", "modified", "occurrences", "size", "extension")


@dataclass(frozen=True)
class ViewSpec:
    filter: str = ""
    sort: str = "path"
    descending: bool = False


class InvalidFilter(ValueError):
    """A filter mask contains a path separator."""


def view_masks(text: str) -> NameMasks:
    masks = parse_masks(text)
    if any("/" in m or "\\" in m for m in masks):
        raise InvalidFilter("masks of the filter are matched against names, not paths")
    return NameMasks(tuple(masks))


def view_order(sort: str, descending: bool) -> list[Column]:
    """The key, then the path; both turn round, but files without a time stay last."""
    name = result_leaf(F.col("file_path"), F.col("entry_path"))
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    entry = F.col("entry_path").desc_nulls_last() if descending else F.col("entry_path").asc_nulls_first()
    keys = {
        "path": [],
        "name": [turn(F.lower(name))],
        "modified": [F.col("mtime").isNull().asc(), turn(F.col("mtime"))],
        "occurrences": [turn(F.col("occurrences"))],
        "size": [turn(F.col("size"))],
        "extension": [turn(extension(name)), turn(F.lower(name))],
    }[sort]
    return [*keys, turn(components(F.col("file_path"))), entry]


def view(results: DataFrame, spec: ViewSpec) -> DataFrame:
    name = result_leaf(F.col("file_path"), F.col("entry_path"))
    return results.where(view_masks(spec.filter).included(name)).orderBy(*view_order(spec.sort, spec.descending))


def ranked(results: DataFrame, spec: ViewSpec) -> DataFrame:
    """The view with its order as a column, ``place``.

    The sort deals rows out by range; a row's place is its number in its range
    behind all rows of the ranges before. The results are written before the sort,
    which reads them twice, and the sorted rows after it, as they are counted and
    numbered from one and the same division into ranges; the table of counts has a
    row per range.
    """
    rows = view(settle(results, "results"), spec).withColumns({"_part": F.spark_partition_id(), "_n": F.monotonically_increasing_id()})
    rows = settle(rows, "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(counts), "_part").withColumn("place", (F.col("_before") + inside + 1).cast("long")).drop("_part", "_n", "_before")


def hide(results: DataFrame, hidden: DataFrame) -> DataFrame:
    """``results`` with ``visible``: false in rows whose project and document ``hidden`` names. No row goes, so counts stay."""
    keys = [c for c in ("project_id", "doc_id") if c in results.columns and c in hidden.columns]
    marks = hidden.select(*keys).distinct().withColumn("_hidden", F.lit(True))
    return results.join(marks, keys, "left").withColumn("visible", F.col("_hidden").isNull()).drop("_hidden")


def view_counts(results: DataFrame) -> DataFrame:
    """``files, occurrences, visible``: of all results, hidden ones too; and how many are shown."""
    return results.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), F.count_if("visible").alias("visible"))


def export_lines(occurrences: DataFrame) -> DataFrame:
    """``path:line:column: text``, without white space at the end."""
    path = result_path(F.col("file_path"), F.col("entry_path"))
    line = F.concat(path, F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"), F.lit(": "), F.regexp_replace("line_text", r"(?U)\s+\z", ""))
    return occurrences.select("doc_id", line.alias("export_line"))
