"""Snapshots of an index: immutable tables, a manifest, and a pointer to the current one."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.plans.options import BuildOptions
from lexmill.plans.storage import Storage

SCHEMA_VERSION = 2
#: What reads and decodes files; contents of another engine are read anew.
ENGINE = "2"
POINTER = "CURRENT"
DOCUMENTS_DDL = "doc_id long, file_path string, entry_path string, ext string, size long, mtime_ns long, status int, reason string"
CONTENTS_DDL = "doc_id long, content string, content_fold string"


class IndexNotFound(FileNotFoundError):
    """There is no index at that path."""


class NotAnIndex(ValueError):
    """The path holds something else, or a table is missing."""


class IncompleteIndex(ValueError):
    """The snapshot was never finished."""


class UnsupportedSchema(ValueError):
    """The snapshot's schema has another version."""


@dataclass(frozen=True)
class Manifest:
    """``complete`` is written last; ``segments`` are the folders that hold contents.

    ``previous`` is the snapshot that was current before and stays for its readers.
    """

    snapshot: str
    segments: tuple[str, ...]
    options: dict[str, Any]
    built_at: str
    indexed_files: int
    report: dict[str, Any] = field(default_factory=dict)
    schema_version: int = SCHEMA_VERSION
    complete: bool = False
    previous: str | None = None
    engine: str = ""

    def to_json(self) -> str:
        return json.dumps(self.__dict__ | {"segments": list(self.segments)}, default=str)

    @staticmethod
    def from_json(text: str) -> Manifest:
        try:
            d = json.loads(text)
            return Manifest(**d | {"segments": tuple(d["segments"])})
        except (ValueError, TypeError, KeyError) as e:
            raise NotAnIndex(f"unreadable manifest: {e}") from e


@dataclass(frozen=True)
class IndexInfo:
    schema_version: int
    built_at: str
    roots: tuple[str, ...]
    indexed_files: int
    size_bytes: int


class Index:
    """A validated snapshot, read-only."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.storage = spark, Storage(spark, path)
        if not self.storage.exists():
            raise IndexNotFound(path)
        if not self.storage.exists(POINTER):
            raise NotAnIndex(f"{path} has no current snapshot")
        name = self.storage.read_text(POINTER).strip()
        self.manifest = self.check(self.storage, name)

    @staticmethod
    def check(storage: Storage, name: str) -> Manifest:
        if not storage.exists(f"{name}/manifest.json"):
            raise IncompleteIndex(name)
        manifest = Manifest.from_json(storage.read_text(f"{name}/manifest.json"))
        if manifest.schema_version != SCHEMA_VERSION:
            raise UnsupportedSchema(str(manifest.schema_version))
        if not manifest.complete:
            raise IncompleteIndex(name)
        for part in (f"{name}/documents", *manifest.segments):
            if not storage.exists(part):
                raise NotAnIndex(f"{part} is missing")
        return manifest

    @property
    def options(self) -> BuildOptions:
        return BuildOptions.from_json(self.manifest.options)

    def documents(self) -> DataFrame:
        return self.spark.read.schema(DOCUMENTS_DDL).parquet(self.storage.full(f"{self.manifest.snapshot}/documents"))

    def contents(self) -> DataFrame:
        return self.spark.read.schema(CONTENTS_DDL).parquet(*[self.storage.full(s) for s in self.manifest.segments])

    def rows(self, folded_needle: str | None = None) -> DataFrame:
        """Documents with their contents, joined by id.

        With a needle, contents without it are left out by a filter on the stored
        column that the scan takes over, before the join. Segments may still hold
        contents of documents that are gone; the join drops those.
        """
        contents = self.contents()
        if folded_needle is None:
            return self.documents().join(contents, "doc_id", "left")
        hit = contents.where(F.contains("content_fold", F.lit(folded_needle)))
        documents = self.documents()
        none = F.lit(None).cast("string")
        return documents.where("status = 0").join(hit, "doc_id").unionByName(documents.where("status <> 0").withColumns({"content": none, "content_fold": none}))

    def info(self) -> IndexInfo:
        return IndexInfo(self.manifest.schema_version, self.manifest.built_at, tuple(r["path"] for r in self.manifest.options["roots"]), self.manifest.indexed_files, self.storage.size())


def verify_index(spark: SparkSession, path: str) -> IndexInfo:
    """What an index says of itself, after a query on it has run."""
    index = Index(spark, path)
    try:
        index.rows("\u0000probe").limit(1).collect()
    except Exception as e:  # whatever Spark raises, the index can't be read
        raise NotAnIndex(f"the index can't be queried: {e}") from e
    return index.info()
