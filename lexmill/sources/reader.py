"""Reading listed files: sniff, decode, and open archives in memory."""

from __future__ import annotations

import io
import os
import pickle
import tempfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.functions.encoding import SNIFF_PREFIX, DecodeError, decode, reason, sniff, without_broken_tail
from lexmill.functions.masks import leaf_text
from lexmill.functions.paths import entry_extension, file_extension
from lexmill.plans.options import ARCHIVE_EXTENSIONS, BINARY_EXTENSIONS, BuildOptions
from lexmill.sources.corpus import ERROR, INDEXED, SECURITY, TOO_LARGE

DDL = "fate string, file_path string, entry_path string, name string, ext string, size long, mtime_ns long, status int, reason string, content string, read long, fallback boolean"
COLUMNS = [f.split()[0] for f in DDL.split(", ")]
_BYTES = 8 << 20
#: Bytes of an archive's rows that are held in memory, and of a nested archive that is opened again.
SPOOL, NESTED = 32 << 20, 256 << 20


def _row(fate: str, path: str, entry: str | None = None, ext: str | None = None, size: int | None = None, mtime: int | None = None, status: int | None = None, why: str | None = None, content: str | None = None, read: int = 0, fallback: bool = False) -> tuple:
    return (fate, path, entry, leaf_text(entry or path), ext, size, mtime, status, why, content, read, fallback)


def error_code(e: OSError) -> str:
    return "deleted" if isinstance(e, FileNotFoundError) else "permission_denied" if isinstance(e, PermissionError) else "read"


class _Quota(Exception):
    """A limit of the whole archive is used up."""


class _Spool:
    """Rows in order; those of over SPOOL bytes lie in a file of the task's own until they are read back, once."""

    def __init__(self) -> None:
        self._file = tempfile.SpooledTemporaryFile(max_size=SPOOL)
        self._rows = 0

    def append(self, row: tuple) -> None:
        pickle.dump(row, self._file, pickle.HIGHEST_PROTOCOL)
        self._rows += 1

    def __iter__(self) -> Iterator[tuple]:
        with self._file as f:
            f.seek(0)
            for _ in range(self._rows):
                yield pickle.load(f)


class ArchiveReader:
    """The entries of one archive file and of archives in it, one after another, within limits."""

    def __init__(self, path: str, mtime: int | None, options: BuildOptions) -> None:
        self.path, self.mtime, self.options, self.limits = path, mtime, options, options.archives
        self.entries = self.total = 0
        self.rows = _Spool()

    def _fail(self, entry: str, code: str, message: str) -> None:
        # The row of a failed entry bears the container's extension and no size.
        self.rows.append(_row("error", self.path, entry, file_extension(self.path), 0, self.mtime, ERROR, reason(code, message)))

    def _limit(self, entry: str, ext: str | None, size: int, why: str) -> None:
        self.rows.append(_row("security", self.path, entry, ext, size, self.mtime, SECURITY, why, read=size))

    def walk(self, archive: zipfile.ZipFile, depth: int, prefix: str) -> None:
        limits = self.limits
        for info in archive.infolist():
            if self.entries >= limits.max_entries:
                raise _Quota(f"more than {limits.max_entries} entries; the rest is not read")
            if self.total >= limits.max_uncompressed:
                raise _Quota(f"more than {limits.max_uncompressed} bytes unpacked; the rest is not read")
            name = info.filename
            if name.endswith(("/", "\\")):
                continue
            entry, ext = prefix + name, entry_extension(name)
            self.entries += 1
            if ext in BINARY_EXTENSIONS or not self.options.masks.accepts_text(leaf_text(name)):
                self.rows.append(_row("ignored_name", self.path, entry, ext))
                continue
            nested = ext in ARCHIVE_EXTENSIONS
            limit = limits.max_nested_size if nested else limits.max_entry_size
            try:
                with archive.open(info) as f:
                    data = f.read(limit + 1)
            except (NotImplementedError, RuntimeError) as e:
                self._fail(entry, "unsupported_archive_feature", str(e))
                continue
            except (zipfile.BadZipFile, zlib.error, EOFError, OSError) as e:
                self._fail(entry, "corrupt_archive_entry", str(e))
                continue
            self.total += len(data)
            if len(data) > limit:
                self._limit(entry, ext, len(data), f"an entry of over {limit} bytes")
                continue
            kind = sniff(data[:SNIFF_PREFIX])
            if nested or kind == "archive":
                if depth + 1 > limits.max_depth:
                    self._limit(entry, ext, len(data), f"an archive nested deeper than {limits.max_depth}")
                    continue
                try:
                    inner = zipfile.ZipFile(io.BytesIO(data))
                except (zipfile.BadZipFile, NotImplementedError, ValueError, EOFError) as e:
                    self._fail(entry, "corrupt_archive", str(e))
                    continue
                with inner:
                    self.walk(inner, depth + 1, entry + "!/")
            elif kind == "binary":
                self.rows.append(_row("ignored_sniff", self.path, entry, ext, read=len(data)))
            else:
                try:
                    text, used = decode(data, self.options.fallback_encoding)
                except DecodeError as e:
                    self._fail(entry, e.code, str(e))
                    continue
                self.rows.append(_row("indexed", self.path, entry, ext, len(data), self.mtime, INDEXED, None, text, len(data), used))


def read_archive(path: str, ext: str | None, size: int, mtime: int | None, options: BuildOptions) -> Iterable[tuple]:
    """The rows of an archive, if it is the same before and after reading; those of a large one wait in a file."""
    if not options.archives.enabled:
        return [_row("ignored_disabled", path, ext=ext)]
    opened = _row("archive_opened", path, ext=ext)
    failed = lambda code, message: [opened, _row("error", path, None, ext, size, mtime, ERROR, reason(code, message))]
    try:
        archive = zipfile.ZipFile(path)
    except OSError as e:
        return failed(error_code(e), str(e))
    except (zipfile.BadZipFile, NotImplementedError, ValueError, EOFError) as e:
        return failed("corrupt_archive", str(e))
    reader = ArchiveReader(path, mtime, options)
    with archive:
        try:
            reader.walk(archive, 0, "")
        except _Quota as e:
            reader.rows.append(_row("archive_limit", path, None, ext, size, mtime, SECURITY, str(e)))
    try:
        stat = os.stat(path, follow_symlinks=False)
    except OSError:
        return failed("deleted", "the archive went away while it was read")
    if (stat.st_size, stat.st_mtime_ns) != (size, mtime):
        return failed("modified", "the archive changed while it was read, so nothing of it counts")
    return chain([opened], reader.rows)


def read_file(path: str, ext: str | None, size: int, mtime: int | None, options: BuildOptions) -> Iterable[tuple]:
    """A file that changes while it is read is read once more, and then given up."""
    fail = lambda code, message: [_row("error", path, None, ext, size, mtime, ERROR, reason(code, message))]
    try:
        for attempt in (0, 1):
            with open(path, "rb") as f:
                before = os.fstat(f.fileno())
                data = f.read(SNIFF_PREFIX)
                kind = sniff(data)
                if kind == "archive":
                    return read_archive(path, ext, before.st_size, before.st_mtime_ns, options)
                if kind == "binary":
                    return [_row("ignored_sniff", path, ext=ext, read=len(data))]
                if not options.masks.accepts_text(leaf_text(path)):
                    return [_row("ignored_name", path, ext=ext, read=len(data))]
                if before.st_size > options.max_file_size:
                    why = f"file exceeds the maximum indexed size ({before.st_size} > {options.max_file_size} bytes)"
                    return [_row("too_large", path, None, ext, before.st_size, before.st_mtime_ns, TOO_LARGE, why, read=len(data))]
                data += f.read()
            after = os.stat(path)
            if (len(data), after.st_size, after.st_mtime_ns) == (before.st_size, before.st_size, before.st_mtime_ns):
                break
            if attempt:
                return fail("modified", "file changed while it was read")
    except OSError as e:
        return fail(error_code(e), str(e))
    try:
        text, used = decode(data, options.fallback_encoding)
    except DecodeError as e:
        return fail(e.code, str(e))
    return [_row("indexed", path, None, ext, len(data), before.st_mtime_ns, INDEXED, None, text, len(data), used)]


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], ddl: str = DDL) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def read_files(listing: DataFrame, options: BuildOptions) -> DataFrame:
    """What became of each listed row, one row for each document, ignored thing or error.

    Files go to tasks by a hash of their path; a task holds one file, or the
    entries of one archive, at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        load = 0
        for batch in batches:
            for kind, path, name, ext, size, mtime, why in zip(*(batch.column(c).to_pylist() for c in ("kind", "file_path", "name", "ext", "size", "mtime_ns", "reason")), strict=True):
                if kind in ("pruned_dir", "scan_error"):
                    rows = [(kind, path, None, name, None, None, None, None, why, None, 0, False)]
                elif kind in ("ignored_mask", "ignored_ext"):
                    rows = [_row("ignored_name", path, ext=ext)]
                elif kind == "archive":
                    rows = read_archive(path, ext, size, mtime, options)
                else:
                    rows = read_file(path, ext, size, mtime, options)
                for row in rows:
                    held.append(row)
                    load += len(row[9] or "") + 1
                    if load > _BYTES or len(held) > 5000:
                        yield _batch(held)
                        held, load = [], 0
        yield _batch(held)

    return listing.repartition("file_path").mapInArrow(run, DDL)


def read_entry(archive: zipfile.ZipFile, entry: str, most: int) -> bytes:
    """An entry by its path through nested archives; KeyError if there is none, OSError if one on the way is over NESTED."""
    head, nested, rest = entry.partition("!/")
    with archive.open(head) as f:
        data = f.read(most + 1 if not nested else NESTED + 1)
    if nested:
        if len(data) > NESTED:
            raise OSError(f"{head} is an archive of over {NESTED} bytes")
        with zipfile.ZipFile(io.BytesIO(data)) as inner:
            return read_entry(inner, rest, most)
    return data


def read_live(found: DataFrame, options: BuildOptions, cap: int) -> DataFrame:
    """Candidates with ``outcome`` (verified, stale, failed) and ``content``, read from where they are now.

    A file is stale if its size or time has changed, an entry if its archive's time
    has. Of a too large file the first ``cap`` bytes count, without a broken
    character at the end. Entries of an archive come together; it is opened once.
    """
    columns = ["doc_id", "file_path", "entry_path", "size", "mtime_ns", "status"]

    def one(path: str, entry: str | None, size: int, mtime: int | None, status: int, opened: dict) -> tuple[str, str | None, bool]:
        try:
            stat = os.stat(path)
            if (mtime is not None and stat.st_mtime_ns != mtime) or (entry is None and stat.st_size != size):
                return "stale", None, False
            truncated = status == TOO_LARGE and size > cap
            if entry is None:
                with open(path, "rb") as f:
                    data = f.read(cap if truncated else size + 1)
                if truncated:
                    data = without_broken_tail(data)
            else:
                if path not in opened:
                    opened.clear()
                    opened[path] = None
                    opened[path] = zipfile.ZipFile(path)
                if opened[path] is None:
                    return "failed", None, False
                data = read_entry(opened[path], entry, size)
                if len(data) > size:
                    return "stale", None, False
            return "verified", decode(data, options.fallback_encoding)[0], truncated
        except (FileNotFoundError, KeyError):
            return "stale", None, False
        except (OSError, DecodeError, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
            return "failed", None, False

    ddl = "doc_id long, file_path string, entry_path string, size long, mtime_ns long, status int, outcome string, content string, truncated boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                part = batch.slice(start, 16)
                rows = list(zip(*(part.column(c).to_pylist() for c in columns), strict=True))
                yield _batch([(*r, *one(*r[1:], opened)) for r in rows], ddl)

    rows = found.select(*columns).repartition("file_path").sortWithinPartitions("file_path", "entry_path")
    return rows.mapInArrow(run, ddl)
