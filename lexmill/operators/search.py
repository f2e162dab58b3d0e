"""Search: candidates by folded content, exact verification, occurrences and counters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.display import seconds_of
from lexmill.functions.masks import NameMasks
from lexmill.functions.matching import LiteralMatcher, Matcher, locate, validate_query
from lexmill.functions.paths import components
from lexmill.plans.shared import settle
from lexmill.sources.corpus import ERROR, INDEXED, MAX_FILE_SIZE, SECURITY, TOO_LARGE

#: Too large documents that one job reads.
EVENTS = 64


@dataclass(frozen=True)
class SearchOptions:
    case_sensitive: bool = False
    whole_word: bool = False
    context_lines: int = 2
    masks: NameMasks = field(default_factory=NameMasks)
    analyze_oversized: bool = False

    def matcher(self, query: str) -> LiteralMatcher:
        return LiteralMatcher(validate_query(query), self.case_sensitive, self.whole_word)


def canonical_order() -> list[Column]:
    return [components(F.col("file_path")).asc(), F.col("entry_path").asc_nulls_first()]


def list_documents(index: DataFrame, statuses: tuple[int, ...] = ()) -> DataFrame:
    """Documents of the given states (none given: all), in order of their path's bytes."""
    rows = index.where(F.col("status").isin(*statuses)) if statuses else index
    return rows.select("doc_id", "file_path", "entry_path", "size", "mtime_ns", "status").orderBy("file_path", F.col("entry_path").asc_nulls_first())


def candidates(index: DataFrame, query: str, options: SearchOptions = SearchOptions(), matcher: Matcher | None = None) -> DataFrame:
    """Indexed documents that contain the folded query, and all that were too large to index; in scope of the masks.

    The condition on ``content_fold`` is a plain substring test on a stored
    column, so it reaches the Parquet scan; masks come before any verification.
    """
    matcher = matcher or options.matcher(query)
    hit = (F.col("status") == INDEXED) & matcher.candidate(F.col("content_fold"))
    return index.where((hit | (F.col("status") == TOO_LARGE)) & options.masks.accepts_document(F.col("file_path"), F.col("entry_path")))


def _capped(content: Column, cap: int) -> Column:
    """The longest prefix of whole characters within ``cap`` bytes."""
    cut = F.substring(F.encode(content, "UTF-8"), 1, cap)
    # A prefix of valid text is valid without the at most three bytes of a broken character.
    tries = [F.try_validate_utf8(F.substr(cut, F.lit(1), F.greatest(F.octet_length(cut) - n, F.lit(0))).cast("string")) for n in range(4)]
    return F.when(F.octet_length(content) <= cap, content).otherwise(F.coalesce(*tries))


def verified(found: DataFrame, query: str, options: SearchOptions = SearchOptions(), cap: int = MAX_FILE_SIZE, matcher: Matcher | None = None) -> DataFrame:
    """Candidates with ``starts`` of their exact matches; of too large ones only the first ``cap`` bytes are read.

    Too large documents are left out unless ``analyze_oversized`` is set.
    """
    from lexmill.functions.fold import fold

    matcher = matcher or options.matcher(query)
    small = found.where(F.col("status") == INDEXED)
    if options.analyze_oversized:
        large = found.where(F.col("status") == TOO_LARGE).withColumn("content", _capped(F.col("content"), cap))
        small = small.unionByName(large.withColumn("content_fold", fold(F.col("content"))))
    return small.withColumn("starts", matcher.starts(F.col("content"), F.col("content_fold")))


def occurrences(checked: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """A row for each match: the document's columns, line, column, the line and its context."""
    return locate(checked.where(F.size("starts") > 0), ["doc_id", "file_path", "entry_path", "size", "mtime_ns", "status"], options.context_lines)


def search(index: DataFrame, query: str, options: SearchOptions = SearchOptions(), cap: int = MAX_FILE_SIZE) -> DataFrame:
    return occurrences(verified(candidates(index, query, options), query, options, cap), options)


def file_results(checked: DataFrame) -> DataFrame:
    """One row per document with matches, times in whole seconds."""
    return checked.where(F.size("starts") > 0).select("doc_id", "file_path", "entry_path", F.size("starts").cast("long").alias("occurrences"), "size", seconds_of(F.col("mtime_ns")).alias("mtime"))


def counters(index: DataFrame, query: str, options: SearchOptions = SearchOptions(), cap: int = MAX_FILE_SIZE) -> DataFrame:
    """One row of counters, all in scope of the masks; one pass over the index."""
    matcher = options.matcher(query)
    scope = options.masks.accepts_document(F.col("file_path"), F.col("entry_path"))
    hit = (F.col("status") == INDEXED) & matcher.candidate(F.coalesce("content_fold", F.lit("")))
    opened = F.when(hit & F.col("entry_path").isNotNull(), F.col("file_path"))
    large = F.col("status") == TOO_LARGE
    return index.where(scope).agg(
        F.count_if(hit).alias("from_index"),
        F.count_if(large).alias("too_large"),
        F.count_if(F.col("status") == ERROR).alias("index_errors"),
        F.count_if(F.col("status") == SECURITY).alias("security_limits"),
        (F.count_if(large & (F.col("size") > cap)) if options.analyze_oversized else F.lit(0).cast("long")).alias("truncated"),
        F.count_distinct(opened).alias("archives_opened"),
    )


@dataclass(frozen=True)
class IndexedDone:
    """The results from the index are complete."""

    results: DataFrame
    counters: DataFrame


@dataclass(frozen=True)
class OversizedProgress:
    """``done`` of ``total`` too large documents are read."""

    done: int
    total: int
    found: DataFrame


class Cancelled(RuntimeError):
    """The search was cancelled; there is no partial report."""


def search_events(index: DataFrame, query: str, options: SearchOptions = SearchOptions(), cancelled=lambda: False, cap: int = MAX_FILE_SIZE) -> Iterator[IndexedDone | OversizedProgress]:
    """First what the index gives; then, if asked for, too large documents one after another.

    The second phase reads EVENTS too large documents in a job, and then tells of
    them one by one; a cancel stops it between jobs and between documents.
    """
    options.matcher(query)

    def check() -> None:
        if cancelled():
            raise Cancelled("search cancelled")

    check()
    found = candidates(index, query, options)
    yield IndexedDone(occurrences(verified(found.where(F.col("status") == INDEXED), query, options), options), counters(index, query, options, cap))
    check()
    if options.analyze_oversized:
        large = found.where(F.col("status") == TOO_LARGE)
        names = (row["doc_id"] for row in large.orderBy(*canonical_order()).select("doc_id").toLocalIterator())
        total, done = large.count(), 0
        while some := list(islice(names, EVENTS)):
            check()
            rows = settle(occurrences(verified(large.where(F.col("doc_id").isin(some)), query, options, cap), options), "oversized")
            for name in some:
                check()
                done += 1
                yield OversizedProgress(done, total, rows.where(F.col("doc_id") == name))
        check()
