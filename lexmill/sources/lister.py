"""Listing of file trees, in parallel by subtree."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lexmill.plans.shared import settle
from lexmill.functions.masks import leaf_text
from lexmill.functions.paths import file_extension
from lexmill.plans.options import ARCHIVE_EXTENSIONS, BINARY_EXTENSIONS, BuildOptions

DDL = "kind string, file_path string, name string, ext string, size long, mtime_ns long, reason string"
COLUMNS = [f.split()[0] for f in DDL.split(", ")]
_ROWS = 2000


def _rule(pattern: str) -> tuple[re.Pattern[str], bool, bool] | None:
    """A line of an ignore file: what it matches, whether it takes back, and whether only directories."""
    pattern = pattern.rstrip("\n\r")
    if not pattern.strip() or pattern.startswith("#"):
        return None
    back = pattern.startswith("!")
    pattern = pattern[back:].strip()
    only_dirs, anchored = pattern.endswith("/"), "/" in pattern.rstrip("/")
    parts = []
    for piece in re.split(r"(\*\*/|/\*\*$|\*|\?|\[[^]]*\])", pattern.strip("/")):
        parts.append({"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(piece) or (fnmatch.translate(piece)[4:-3] if piece.startswith("[") else re.escape(piece)))
    return re.compile(("" if anchored else "(?:.*/)?") + "".join(parts) + r"\Z"), back, only_dirs


class IgnoreRules:
    """The ignore files from a root down to a directory; the last rule that matches decides."""

    def __init__(self, levels: tuple[tuple[str, tuple], ...] = ()) -> None:
        self.levels = levels

    def below(self, folder: str) -> IgnoreRules:
        try:
            with open(f"{folder}/.gitignore", encoding="utf-8", errors="replace") as f:
                rules = tuple(r for r in map(_rule, f) if r)
        except OSError:
            return self
        return IgnoreRules((*self.levels, (folder, rules)))

    def ignored(self, path: str, is_dir: bool) -> bool:
        for folder, rules in reversed(self.levels):
            for pattern, back, only_dirs in reversed(rules):
                if (is_dir or not only_dirs) and pattern.match(os.path.relpath(path, folder)):
                    return not back
        return False


def classify(path: str, options: BuildOptions) -> str:
    """Excluded names first; then what the extension says."""
    if options.masks.excluded_text(leaf_text(path)):
        return "ignored_mask"
    ext = file_extension(path)
    return "ignored_ext" if ext in BINARY_EXTENSIONS else "archive" if ext in ARCHIVE_EXTENSIONS else "file"


def scan(folder: str, rules: IgnoreRules, options: BuildOptions, depth: int | None) -> Iterator[tuple]:
    """Rows of a directory and, but for ``depth`` 0, of those in it; ``kind`` dir: left for another task."""
    pruned = {d.lower() for d in options.excluded_dirs}
    rules = rules.below(folder) if options.respect_gitignore else rules
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError as e:
        yield ("scan_error", folder, os.path.basename(folder), None, None, None, f"[scan] {e.strerror}")
        return
    for e in entries:
        try:
            if e.is_symlink():
                continue
            is_dir = e.is_dir(follow_symlinks=False)
            if options.respect_gitignore and rules.ignored(e.path, is_dir):
                continue
            if is_dir:
                if depth == 0:
                    continue
                if e.name.lower() in pruned:
                    yield ("pruned_dir", e.path, e.name.lower(), None, None, None, None)
                elif depth is None:
                    yield from scan(e.path, rules, options, None)
                else:
                    yield ("dir", e.path, e.name, None, None, None, None)
            elif e.is_file(follow_symlinks=False):
                try:
                    e.path.encode("utf-8")
                except UnicodeEncodeError:
                    shown = e.path.encode("utf-8", "replace").decode()
                    yield ("scan_error", shown, leaf_text(shown), None, None, None, "[invalid_unicode_path] path is not valid Unicode")
                    continue
                stat = e.stat(follow_symlinks=False)
                yield (classify(e.path, options), e.path, e.name, file_extension(e.path), stat.st_size, stat.st_mtime_ns, None)
        except OSError as x:
            yield ("scan_error", e.path, e.name, None, None, None, f"[scan] {x.strerror}")


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pd.DataFrame(held, columns=COLUMNS, dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=COLUMNS, dtype=object)


def _rules_down_to(root: str, folder: str, options: BuildOptions) -> IgnoreRules:
    rules = IgnoreRules()
    if options.respect_gitignore:
        at = root
        for part in ["", *os.path.relpath(os.path.dirname(folder), root).split("/")]:
            at = at if part in ("", ".") else f"{at}/{part}"
            rules = rules.below(at)
    return rules


def list_files(spark: SparkSession, options: BuildOptions) -> DataFrame:
    """``kind, file_path, name, ext, size, mtime_ns, reason`` of all that the roots hold.

    Hidden files count, links aren't followed. A first job lists the roots
    themselves; each directory in them then is a task's work. The trees have to be
    where executors see them under the same path.
    """
    roots, _ = options.normalized_roots()
    rows = [(os.path.abspath(r.path), r.recursive) for r in roots]

    def tops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for root, recursive in zip(frame["root"], frame["recursive"], strict=True):
                for out in _frames(scan(root, IgnoreRules(), options, 1 if recursive else 0)):
                    yield out.assign(root=root)

    def subtrees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for root, folder in zip(frame["root"], frame["file_path"], strict=True):
                yield from _frames(scan(folder, _rules_down_to(root, folder, options), options, None))

    first = spark.createDataFrame(rows, "root string, recursive boolean").repartition(len(rows), "root").mapInPandas(tops, f"{DDL}, root string")
    first = settle(first, "tops")
    width = spark.sparkContext.defaultParallelism * 4
    rest = first.where("kind = 'dir'").repartition(width).mapInPandas(subtrees, DDL)
    return first.where("kind <> 'dir'").drop("root").unionByName(rest)
