"""File-name masks: ``*`` for any run, ``?`` for one character, all else literal."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_masks(text: str) -> list[str]:
    """Masks between semicolons and line ends, trimmed; a comma is an ordinary character."""
    return [m for m in (part.strip() for part in re.split(r"[;\n]", text)) if m]


def quote(literal: str) -> str:
    """The literal as a regular expression of Java."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def mask_regex(mask: str) -> str:
    parts = [{"*": ".*", "?": "."}.get(p) or quote(p) for p in re.split(r"([*?])", mask.lower()) if p]
    return "(?s)\\A" + "".join(parts) + "\\z"


def wildcard_match(mask: str, name: Column) -> Column:
    """Whether the whole name matches, both sides in full lower case."""
    return F.lower(name).rlike(mask_regex(mask))


def wildcard_text(mask: str, name: str) -> bool:
    pattern = "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in mask.lower())
    return re.fullmatch(pattern, name.lower(), re.S) is not None


def leaf(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def leaf_text(path: str) -> str:
    return re.split(r"[/\\]", path)[-1]


@dataclass(frozen=True)
class NameMasks:
    """An empty include list accepts every name; exclusion wins."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    @staticmethod
    def of(include: str = "", exclude: str = "") -> NameMasks:
        return NameMasks(tuple(parse_masks(include)), tuple(parse_masks(exclude)))

    def included(self, name: Column) -> Column:
        return reduce(Column.__or__, [wildcard_match(m, name) for m in self.include]) if self.include else F.lit(True)

    def excluded(self, name: Column) -> Column:
        return reduce(Column.__or__, [wildcard_match(m, name) for m in self.exclude]) if self.exclude else F.lit(False)

    def accepts(self, name: Column) -> Column:
        return self.included(name) & ~self.excluded(name)

    def accepts_document(self, file_path: Column, entry_path: Column) -> Column:
        """A file answers for its own name; an entry for its leaf, and its container can exclude it."""
        own, inner = leaf(file_path), leaf(F.coalesce(entry_path, F.lit("")))
        return F.when(entry_path.isNull(), self.accepts(own)).otherwise(self.accepts(inner) & ~self.excluded(own))

    def excluded_text(self, name: str) -> bool:
        return any(wildcard_text(m, name) for m in self.exclude)

    def accepts_text(self, name: str) -> bool:
        return (not self.include or any(wildcard_text(m, name) for m in self.include)) and not self.excluded_text(name)
