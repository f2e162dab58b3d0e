"""Trigram postings: an inverted index as a table, to narrow down candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.fold import fold_text


def trigrams(folded: Column) -> Column:
    """Distinct runs of three characters, by code point."""
    chars = F.split(folded, "")
    n = F.greatest(F.length(folded) - 2, F.lit(0))
    # Three shifted copies side by side: the lambdas hold no column, which they would evaluate each time.
    pairs = F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.zip_with(pairs, F.slice(chars, 3, n), lambda a, b: F.concat(a, b)))


def postings(index: DataFrame, only: list[str] | None = None) -> DataFrame:
    """``gram, doc_id`` of the indexed documents. Each document alone, no shuffle.

    With ``only``, the postings of these trigrams: the others aren't made.
    """
    folded = F.col("content_fold")
    grams = trigrams(folded) if only is None else F.filter(F.array(*map(F.lit, only)), lambda g: F.contains(folded, g))
    return index.where("status = 0").select(F.explode(grams).alias("gram"), "doc_id")


def query_grams(query: str) -> list[str]:
    folded = fold_text(query)
    return sorted({folded[i : i + 3] for i in range(len(folded) - 2)})


def posting_candidates(table: DataFrame, query: str) -> DataFrame:
    """Documents that hold every trigram of the query: a superset of those that contain it."""
    grams = query_grams(query)
    return table.where(F.col("gram").isin(*grams)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("doc_id")


def narrowed(index: DataFrame, table: DataFrame, query: str) -> DataFrame:
    """The index without documents that the postings rule out; too large ones stay."""
    kept = index.join(posting_candidates(table, query), "doc_id", "left_semi")
    return kept.unionByName(index.where("status <> 0"))
