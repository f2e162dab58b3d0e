"""Simple case folding: one character for one character, so that offsets stay."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Characters that fold to another one, and what they fold to.

    The full folding counts where it is one character, else the lower case where
    that is one, else the character stays.
    """
    source, target = [], []
    for point in range(sys.maxunicode + 1):
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        folded = c.casefold()
        if len(folded) != 1:
            folded = c.lower()
        if len(folded) == 1 and folded != c:
            source.append(c)
            target.append(folded)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    return F.translate(text, *fold_table())


@lru_cache(maxsize=1)
def _by_point() -> dict[int, str]:
    return str.maketrans(*fold_table())


def fold_text(text: str) -> str:
    return text.translate(_by_point())
