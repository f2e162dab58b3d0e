"""Literal matches as columns: where they start, their lines, columns and context."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from typing import Protocol

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.fold import fold_text

#: A character of a word.
WORD = regex.compile(r"[\p{Alphabetic}\p{N}_]")
MIN_QUERY = 3
#: Matches, and bytes of their lines and context, that become one batch.
BATCH_HITS, BATCH_BYTES = 1000, 4 << 20


class QueryTooShort(ValueError):
    """A query has fewer than three characters."""


def validate_query(query: str) -> str:
    if len(query) < MIN_QUERY:
        raise QueryTooShort(f"a query needs {MIN_QUERY} characters at least, not {len(query)}")
    return query


def _places(text: str, needle: str) -> list[int]:
    found, at = [], text.find(needle) if needle else -1
    while at >= 0:
        found.append(at)
        at = text.find(needle, at + len(needle))
    return found


def find(text: Column, needle: str) -> Column:
    """0-based starts of the needle, from left to right and not overlapping; an empty needle is nowhere."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _places(t, needle) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return run(text)


class Matcher(Protocol):
    """Where a document matches; other kinds of search can take the literal's place."""

    def starts(self, content: Column, folded: Column) -> Column:
        """0-based starts in characters, ascending."""

    def candidate(self, folded: Column) -> Column:
        """A cheap condition that holds wherever there is a match."""


@dataclass(frozen=True)
class LiteralMatcher:
    needle: str
    case_sensitive: bool = False
    whole_word: bool = False

    @property
    def width(self) -> int:
        return len(self.needle)

    def candidate(self, folded: Column) -> Column:
        return F.contains(folded, F.lit(fold_text(self.needle)))

    def _whole(self, text: str, at: int) -> bool:
        """Whether the neighbours on both sides are no characters of a word."""
        end = at + self.width
        return not (at and WORD.match(text[at - 1])) and not (end < len(text) and WORD.match(text[end]))

    def starts(self, content: Column, folded: Column) -> Column:
        """One pass over each text; time is linear in it and in its matches."""
        needle = self.needle if self.case_sensitive else fold_text(self.needle)
        if not self.whole_word:
            return find(content if self.case_sensitive else folded, needle)

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array, hays: pa.Array) -> pa.Array:
            rows = zip(texts.to_pylist(), hays.to_pylist(), strict=True)
            return pa.array([None if t is None else [a for a in _places(h, needle) if self._whole(t, a)] for t, h in rows], pa.list_(pa.int32()))

        return run(content, content if self.case_sensitive else folded)


OCCURRENCE_DDL = "hit long, line long, column long, line_text string, context_before array<string>, context_after array<string>"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]


def _located(text: str, starts: list[int], context: int) -> Iterator[tuple]:
    """Of each match: its number, line and column (from 1, of its start), the line and the lines around it.

    Lines end at ``\\n`` only; a last ``\\n`` opens an empty line.
    """
    lines = text.split("\n")
    begins = list(accumulate((len(x) + 1 for x in lines), initial=0))
    shown = lambda a, b: [x.rstrip("\r\n") for x in lines[max(a, 0) : b]]
    for hit, at in enumerate(starts):
        n = bisect_right(begins, at)
        yield hit, n, at - begins[n - 1] + 1, lines[n - 1].rstrip("\r\n"), shown(n - 1 - context, n - 1), shown(n, n + context)


def locate(rows: DataFrame, kept: list[str], context: int) -> DataFrame:
    """A row for each match in ``rows`` (kept columns, content, starts): the kept columns and OCCURRENCE_DDL.

    Each text is cut into lines once; rows leave in batches of bounded size, so
    that no text is copied to each of its matches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(kept)
            for i in range(batch.num_rows):
                held, size = [], 0
                same = [c.slice(i, 1) for c in batch.columns[:n]]

                def flush(held=held, same=same) -> pa.RecordBatch:
                    again = pa.array([0] * len(held), pa.int32())
                    columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=True)]
                    return pa.RecordBatch.from_arrays([*[c.take(again) for c in same], *columns], [*kept, *[f.split()[0] for f in OCCURRENCE_DDL.split(", ")]])

                for row in _located(batch.column(n)[i].as_py(), batch.column(n + 1)[i].as_py(), context):
                    held.append(row)
                    size += len(row[3]) + sum(map(len, row[4])) + sum(map(len, row[5]))
                    if len(held) == BATCH_HITS or size > BATCH_BYTES:
                        yield flush()
                        held.clear()
                        size = 0
                if held:
                    yield flush()

    base = rows.select(*kept, "content", "starts")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[: len(kept)])
    return base.mapInArrow(run, f"{fields}, {OCCURRENCE_DDL}")


def segments(line: Column, starts: Column, width: int) -> Column:
    """The line as pieces (text, hit) in order, tabs as four spaces; empty pieces are left out."""
    ends = F.concat(F.array(F.lit(0)), F.transform(starts, lambda s: s + F.lit(width)))
    begins = F.concat(starts, F.array(F.length(line)))
    piece = lambda a, b, hit: F.struct(F.regexp_replace(F.substr(line, a + 1, b - a), "\t", "    ").alias("text"), F.lit(hit).alias("hit"))
    plain = F.zip_with(ends, begins, lambda a, b: piece(a, F.greatest(a, b), False))
    hits = F.transform(starts, lambda s: piece(s, s + F.lit(width), True))
    mixed = F.flatten(F.zip_with(plain, hits, lambda p, h: F.when(h.isNull(), F.array(p)).otherwise(F.array(p, h))))
    return F.filter(mixed, lambda x: x["text"] != "")
