"""Paths, extensions and what results display of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.masks import leaf


def components(path: Column) -> Column:
    """Orders as paths do: component by component, not byte by byte."""
    return F.split(path, "/")


def result_leaf(file_path: Column, entry_path: Column) -> Column:
    return leaf(F.coalesce(entry_path, file_path))


def result_path(file_path: Column, entry_path: Column) -> Column:
    return F.when(entry_path.isNull(), file_path).otherwise(F.concat(file_path, F.lit("!"), entry_path))


def parent_display(file_path: Column, entry_path: Column) -> Column:
    folder = F.regexp_extract(file_path, r"(?s)\A(.*/)[^/]*\z", 1)
    inner = F.regexp_extract(F.coalesce(entry_path, F.lit("")), r"(?s)\A(.*[/\\])[^/\\]*\z", 1)
    return F.when(entry_path.isNull(), folder).when(inner == "", file_path).otherwise(F.concat(file_path, F.lit("!"), inner))


def extension(name: Column) -> Column:
    """In lower case, without the dot; none for a leading dot, and then the empty text."""
    return F.lower(F.regexp_extract(name, r"(?s)\A.+\.([^.]*)\z", 1))


def path_key(path: Column) -> Column:
    """Equal for paths that name one place: separators, verbatim prefixes and case don't count."""
    s = F.replace(path, F.lit("/"), F.lit("\\"))
    s = (
        F.when(s.startswith("\\\\?\\UNC\\"), F.concat(F.lit("\\\\"), F.substr(s, F.lit(9))))
        .when(s.startswith("\\\\?\\"), F.substr(s, F.lit(5)))
        .otherwise(s)
    )
    head, tail = F.substr(s, F.lit(1), F.lit(3)), F.substr(s, F.lit(4))
    return F.lower(F.concat(head, F.regexp_replace(tail, r"\\+\z", "")))


def file_extension(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    at = name.rfind(".")
    return name[at + 1 :].lower() if at > 0 else None


def entry_extension(name: str) -> str | None:
    at, slash = name.rfind("."), max(name.rfind("/"), 0)
    return name[at + 1 :].lower() if at > slash else None


def parse_list(text: str) -> list[str]:
    return [p for p in (x.strip() for x in re.split(r"[,;\n]", text)) if p]


def join_list(items: list[str]) -> str:
    return ", ".join(items)
