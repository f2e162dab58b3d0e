"""Building an index, and bringing one up to date."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.fold import fold
from lexmill.operators import report as R
from lexmill.operators import update as U
from lexmill.plans.options import BuildOptions
from lexmill.plans.snapshot import CONTENTS_DDL, ENGINE, POINTER, Index, Manifest
from lexmill.plans.storage import Storage
from lexmill.sources.lister import list_files
from lexmill.sources.reader import read_files

#: What becomes a row of ``documents``.
ROW_FATES = ("indexed", "too_large", "error", "security", "archive_limit")
#: Share of the first segment that dead contents, or the contents behind it, may reach before all are merged.
MERGE_SHARE = 0.25
_BUSY: set[str] = set()
_LOCK = threading.Lock()


class BuildInProgress(RuntimeError):
    """This process is building that index already."""


class BuildCancelled(RuntimeError):
    """The build was cancelled; the previous snapshot is as it was."""


@dataclass(frozen=True)
class BuildReport:
    kind: str
    counters: dict[str, int]
    top_extensions: list[tuple[str, int]]
    errors: list[tuple[str, str | None, str]]
    errors_omitted: int
    skipped_roots: list[tuple[str, str]]
    seconds: dict[str, float]
    delta: dict[str, int] | None = None

    @property
    def warning(self) -> bool:
        """A full build that indexed nothing."""
        return self.kind == "full" and not self.counters["files_indexed"]


@dataclass
class _Build:
    spark: SparkSession
    path: str
    options: BuildOptions
    cancelled: Any
    progress: Any = None
    seconds: dict[str, float] = field(default_factory=dict)

    def step(self, name: str) -> None:
        if self.cancelled():
            raise BuildCancelled("build cancelled")
        self.seconds[name] = time.monotonic()
        if self.progress:
            self.progress(name)

    def run(self, base: Index | None) -> BuildReport:
        storage = Storage(self.spark, self.path)
        name = uuid.uuid4().hex
        snapshot, segment, staging = f"snap-{name}", f"seg-{name}", f"stage-{name}"
        self._clean(storage)
        try:
            self.step("scan")
            listing = self._stage(storage, f"{staging}/listing", list_files(self.spark, self.options))
            todo, kept, fates = listing, None, None
            if base:
                # Names that a mask excludes aren't part of the tree; so their old rows are left over.
                there = listing.where(F.col("kind").isin("file", "archive", "ignored_ext"))
                fates = self._stage(storage, f"{staging}/fates", U.diff(there, base.documents(), self.options.archives.enabled))
                same = fates.where("fate = 'unchanged'").select("file_path")
                todo = listing.join(same, "file_path", "left_anti")
                kept = U.kept_rows(base.documents(), fates)
            self.step("process")
            staged = self._stage(storage, f"{staging}/rows", self._numbered(read_files(todo, self.options), base))
            self.step("write")
            fresh = staged.where(F.col("fate").isin(*ROW_FATES)).select("doc_id", "file_path", "entry_path", "ext", "size", "mtime_ns", "status", "reason")
            documents = fresh.unionByName(kept.select(*fresh.columns)) if kept is not None else fresh
            documents.write.parquet(storage.full(f"{snapshot}/documents"))
            contents = staged.where("fate = 'indexed'").select("doc_id", "content", fold(F.col("content")).alias("content_fold"))
            segments = self._segments(storage, segment, contents, base, kept)
            self.step("report")
            done = self._report(staged, listing, fates, base)
            self.step("activate")
            n = self.spark.read.parquet(storage.full(f"{snapshot}/documents")).where("status = 0").count()
            before = storage.read_text(POINTER).strip() if storage.exists(POINTER) else None
            manifest = Manifest(snapshot, segments, self.options.to_json(), datetime.now(UTC).isoformat(), n, asdict(done), complete=True, previous=before, engine=ENGINE)
            storage.write_text(f"{snapshot}/manifest.json", manifest.to_json())
            Index.check(storage, snapshot)
            if self.cancelled():
                raise BuildCancelled("build cancelled")
            storage.write_text(POINTER, snapshot)
            self._clean(storage)
            return done
        except BaseException:
            for part in (snapshot, segment):
                if storage.exists(part) and not (storage.exists(POINTER) and storage.read_text(POINTER).strip() == snapshot):
                    storage.delete(part)
            raise
        finally:
            storage.delete(staging)

    def _stage(self, storage: Storage, name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(storage.full(name))
        return self.spark.read.schema(rows.schema).parquet(storage.full(name))

    def _segments(self, storage: Storage, name: str, fresh: DataFrame, base: Index | None, kept: DataFrame | None) -> tuple[str, ...]:
        """The folders of the snapshot's contents: one large segment and at most a smaller one behind it.

        The smaller one is written anew with what is fresh; the large one stays as
        it is until a quarter of it is dead, or what lies behind it has grown to a
        quarter of it: then both are merged. If nothing has changed, nothing is written.
        """
        if base is None or kept is None:
            fresh.write.parquet(storage.full(name))
            return (name,)
        live = kept.where(F.col("status") == 0).select("doc_id")
        parts = base.manifest.segments
        read = lambda *s: self.spark.read.schema(CONTENTS_DDL).parquet(*[storage.full(x) for x in s])
        n_fresh, n_live = fresh.count(), live.count()
        if not n_fresh and n_live == base.documents().where("status = 0").count():
            return parts
        n_first, first_live = read(parts[0]).count(), read(parts[0]).select("doc_id").join(live, "doc_id", "left_semi").count()
        behind = n_live - first_live + n_fresh
        merge = behind > MERGE_SHARE * n_first or first_live < (1 - MERGE_SHARE) * n_first
        old = parts if merge else parts[1:]
        rows = read(*old).join(live, "doc_id", "left_semi").unionByName(fresh) if old else fresh
        rows.write.parquet(storage.full(name))
        return (name,) if merge else (parts[0], name)

    def _numbered(self, rows: DataFrame, base: Index | None) -> DataFrame:
        """Ids above all that the base has; so a new row never takes the id of one that is gone."""
        first = 0
        if base:
            highest = [rows.agg(F.max("doc_id")).first()[0] for rows in (base.documents(), base.contents())]
            first = 1 + max([h for h in highest if h is not None], default=-1)
        return rows.withColumn("doc_id", F.lit(first) + F.monotonically_increasing_id())

    def _report(self, staged: DataFrame, listing: DataFrame, fates: DataFrame | None, base: Index | None) -> BuildReport:
        counters = R.build_counters(staged).first().asDict()
        counters["files_seen"] = listing.where("kind NOT IN ('pruned_dir', 'scan_error')").count()
        delta = None
        if fates is not None:
            seen = {r["fate"]: r["n"] for r in fates.groupBy("fate").agg(F.count(F.lit(1)).alias("n")).collect()}
            counters |= {"files_unchanged": seen.get("unchanged", 0), "files_modified": seen.get("modified", 0), "files_deleted": seen.get("deleted", 0)}
            ignored = counters["files_ignored"] - counters["archive_entries_skipped_by_name"] - counters["archive_entries_ignored_by_sniff"]
            added = max(0, counters["files_seen"] - counters["files_unchanged"] - counters["files_modified"] - ignored)
            delta = {"added": added, "removed": counters["files_deleted"], "updated": counters["files_modified"]}
        failed, total = R.errors(staged)
        details = [tuple(r) for r in failed.collect()]
        extensions = [(r["ext"], r["n"]) for r in R.top_extensions(staged.where(F.col("fate").isin(*ROW_FATES))).collect()]
        names, times = list(self.seconds), [*self.seconds.values(), time.monotonic()]
        spent = {n: round(b - a, 3) for n, a, b in zip(names, times, times[1:], strict=False)}
        return BuildReport("update" if base else "full", counters, extensions, details, total - len(details), self.options.normalized_roots()[1], spent, delta)

    def _clean(self, storage: Storage) -> None:
        """Delete what neither the current snapshot nor the one before it refers to, and what a broken build left.

        The one before stays for readers that opened it before the swap.
        """
        keep, name = {POINTER}, storage.read_text(POINTER).strip() if storage.exists(POINTER) else None
        for _ in range(2):
            if not name:
                break
            keep.add(name)
            try:
                manifest = Manifest.from_json(storage.read_text(f"{name}/manifest.json"))
            except Exception:  # a snapshot without a manifest refers to nothing
                break
            keep |= set(manifest.segments)
            name = manifest.previous
        for found in storage.names():
            if found.startswith(("snap-", "seg-", "stage-")) and found not in keep:
                storage.delete(found)


def _guarded(spark: SparkSession, path: str, options: BuildOptions, base: Index | None, cancelled, progress) -> BuildReport:
    options.validate()
    key = path.rstrip("/")
    with _LOCK:
        if key in _BUSY:
            raise BuildInProgress(path)
        _BUSY.add(key)
    try:
        return _Build(spark, path, options, cancelled, progress).run(base)
    finally:
        with _LOCK:
            _BUSY.discard(key)


def rebuild_index(spark: SparkSession, path: str, options: BuildOptions, cancelled=lambda: False, progress=None) -> BuildReport:
    """Read all roots into a new snapshot, and make it the current one at the end.

    ``progress`` is called with the name of each phase as it begins: scan, process,
    write, report, activate.
    """
    return _guarded(spark, path, options, None, cancelled, progress)


def update_index(spark: SparkSession, path: str, options: BuildOptions, cancelled=lambda: False, progress=None) -> BuildReport:
    """As a rebuild, but unchanged paths keep their rows and aren't read.

    Contents of kept documents stay in the segments that hold them, until these are
    merged. Without a valid index, or with one built with other options or by
    another engine, this is a full build.
    """
    try:
        base = Index(spark, path)
    except (FileNotFoundError, ValueError):
        base = None
    if base and (base.options != options or base.manifest.engine != ENGINE):
        base = None
    return _guarded(spark, path, options, base, cancelled, progress)
