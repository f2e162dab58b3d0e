"""What a build is asked to do."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field
from typing import Any

from lexmill.functions.masks import NameMasks

# Names of directories that are left out, extensions of files that aren't text.
EXCLUDED_DIRS = (
    ".git", ".svn", ".hg", "node_modules", "bin", "obj", "target", "build", "dist", "out", ".gradle",
    ".mvn", ".m2", ".idea", ".vs", ".vscode", ".settings", ".metadata", "__pycache__", ".pytest_cache", ".cache",
)
BINARY_EXTENSIONS = ("exe", "dll", "so", "dylib", "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "class")
ARCHIVE_EXTENSIONS = ("zip", "jar", "war", "ear", "aar", "apk")
MIB = 1 << 20


class InvalidOptions(ValueError):
    """A build can't run with these options."""


@dataclass(frozen=True)
class RootSpec:
    path: str
    recursive: bool = True


@dataclass(frozen=True)
class ArchiveOptions:
    enabled: bool = True
    max_entry_size: int = 32 * MIB
    max_nested_size: int = 64 * MIB
    max_entries: int = 200_000
    max_uncompressed: int = 2048 * MIB
    max_depth: int = 1


@dataclass(frozen=True)
class BuildOptions:
    roots: tuple[RootSpec, ...]
    excluded_dirs: tuple[str, ...] = EXCLUDED_DIRS
    masks: NameMasks = field(default_factory=NameMasks)
    respect_gitignore: bool = False
    max_file_size: int = 16 * MIB
    archives: ArchiveOptions = field(default_factory=ArchiveOptions)
    fallback_encoding: str | None = None
    #: Paths are one if they differ in case only.
    case_insensitive_paths: bool = True

    def validate(self) -> None:
        if not self.roots:
            raise InvalidOptions("name a folder to read: there are no roots")
        limits = {"max_file_size": self.max_file_size, **{k: v for k, v in dataclasses.asdict(self.archives).items() if k not in ("enabled", "max_depth")}}
        for name, value in limits.items():
            if value < 1:
                raise InvalidOptions(f"{name} is {value}, but has to be positive")
        if self.fallback_encoding not in (None, "windows-1252"):
            raise InvalidOptions(f"unknown fallback encoding {self.fallback_encoding}")
        policies: dict[tuple[str, ...], RootSpec] = {}
        for root in self.roots:
            other = policies.setdefault(self.root_key(root.path), root)
            if other.recursive != root.recursive:
                raise InvalidOptions(f"{root.path} and {other.path} are one folder, but only one of them is to be read with its subfolders")

    def root_key(self, path: str) -> tuple[str, ...]:
        """The components of the absolute path, so that ``bin`` doesn't contain ``bin2``."""
        whole = os.path.abspath(path)
        return tuple((whole.lower() if self.case_insensitive_paths else whole).strip("/").split("/"))

    def normalized_roots(self) -> tuple[tuple[RootSpec, ...], list[tuple[str, str]]]:
        """Roots without duplicates and without those that a recursive root covers; and why others were skipped."""
        kept: dict[tuple[tuple[str, ...], bool], RootSpec] = {}
        skipped: list[tuple[str, str]] = []
        inside = lambda inner, outer: len(inner) > len(outer) and inner[: len(outer)] == outer
        for root in self.roots:
            key = self.root_key(root.path)
            if (key, root.recursive) in kept:
                skipped.append((root.path, f"the same as {kept[key, root.recursive].path}"))
                continue
            cover = next((r for (k, recursive), r in kept.items() if recursive and inside(key, k)), None)
            if cover:
                skipped.append((root.path, f"read with {cover.path}"))
                continue
            if root.recursive:
                for k in [k for k in kept if inside(k[0], key)]:
                    skipped.append((kept.pop(k).path, f"read with {root.path}"))
            kept[key, root.recursive] = root
        return tuple(kept.values()), skipped

    def to_json(self) -> dict[str, Any]:
        return dataclasses.asdict(self)

    @staticmethod
    def from_json(d: dict[str, Any]) -> BuildOptions:
        known = {f.name for f in dataclasses.fields(BuildOptions)}
        d = {k: v for k, v in d.items() if k in known}
        d["roots"] = tuple(RootSpec(**r) for r in d.get("roots", ()))
        if "masks" in d:
            d["masks"] = NameMasks(tuple(d["masks"]["include"]), tuple(d["masks"]["exclude"]))
        if "archives" in d:
            d["archives"] = ArchiveOptions(**d["archives"])
        if "excluded_dirs" in d:
            d["excluded_dirs"] = tuple(d["excluded_dirs"])
        return BuildOptions(**d)
