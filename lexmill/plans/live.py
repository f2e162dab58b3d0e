"""Search of an index against the files as they are now."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.fold import fold, fold_text
from lexmill.operators import search as S
from lexmill.plans.snapshot import Index
from lexmill.sources.corpus import INDEXED, TOO_LARGE
from lexmill.sources.reader import read_live


@dataclass(frozen=True)
class LiveSearch:
    """``outcomes``: a row per candidate; ``results``: a row per match; ``counters``: one row."""

    outcomes: DataFrame
    results: DataFrame
    counters: DataFrame


def search_live(index: Index, query: str, options: S.SearchOptions = S.SearchOptions()) -> LiveSearch:
    """Candidates from the index, then every hit from the real content.

    Too large files are read only if ``analyze_oversized`` is set, and then up to
    the size limit of the build.
    """
    matcher = options.matcher(query)
    rows = index.rows(fold_text(query))
    cap = index.options.max_file_size
    found = S.candidates(rows, query, options)
    read = found if options.analyze_oversized else found.where(F.col("status") == INDEXED)
    outcomes = read_live(read, index.options, cap)
    checked = outcomes.where("outcome = 'verified'").withColumn("content_fold", fold(F.col("content")))
    checked = checked.withColumn("starts", matcher.starts(F.col("content"), F.col("content_fold")))
    scope = rows.where(options.masks.accepts_document(F.col("file_path"), F.col("entry_path")))
    fixed = scope.agg(F.count_if(F.col("status") == INDEXED).alias("from_index"), F.count_if(F.col("status") == TOO_LARGE).alias("too_large"), F.count_if(F.col("status") == 3).alias("index_errors"), F.count_if(F.col("status") == 4).alias("security_limits"))
    entry = F.col("entry_path").isNotNull()
    seen = outcomes.agg(
        F.count_if(F.col("outcome") == "stale").alias("stale"),
        F.count_if(F.col("outcome") == "failed").alias("verification_errors"),
        F.count_if((F.col("outcome") == "verified") & F.col("truncated")).alias("truncated"),
        # An archive all of whose entries were stale by its time wasn't opened.
        F.count_distinct(F.when(entry & (F.col("outcome") != "stale"), F.col("file_path"))).alias("archives_opened"),
    )
    names = [*fixed.columns, *seen.columns]
    both = fixed.unionByName(seen, allowMissingColumns=True)
    return LiveSearch(outcomes, S.occurrences(checked, options), both.agg(*[F.sum(n).alias(n) for n in names]))
