"""Packing documents into training sequences, online and in bounded space."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import blocks, id_and_text, in_batches, settle
from lexmill.llm.word_bpe import RunCache, default_tokenizer_path, run_cache

#: Tokens of a sequence, open windows of a partition, the id after each document.
SEQUENCE = 4096
WINDOWS = 8
END_ID = 2
#: Partitions whose leftovers one task merges: at most so many times SEQUENCE ids.
MERGED = 256

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("task", pa.int64()), ("place", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, task long, place long"


class Piece:
    """A run of a document's ids: 4 bytes each."""

    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id: int | None, start: int, ids: memoryview, doc_tokens: int) -> None:
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.doc_tokens)


class Packer:
    """Best-fit packing with at most ``windows`` open windows."""

    def __init__(self, first_id: int, sequence: int = SEQUENCE, windows: int = WINDOWS, ids: bool = False) -> None:
        self.next_id, self.sequence, self.windows, self.keep = first_id, sequence, windows, ids
        self.open: list[list[Piece]] = []
        self.free: list[int] = []
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, self.next_id, offset, None, None, None))
            offset += len(p)
        self.next_id += 1

    def _close(self, at: int) -> None:
        self._emit(self.open[at])
        del self.open[at], self.free[at]

    def add(self, piece: Piece) -> None:
        while len(piece) >= self.sequence:
            head, piece = piece.cut(self.sequence)
            self._emit([head])
        if not len(piece):
            return
        fits = [(free, i) for i, free in enumerate(self.free) if free >= len(piece)]
        if fits:
            free, at = min(fits)
            self.open[at].append(piece)
            self.free[at] = free - len(piece)
            if not self.free[at]:
                self._close(at)
            return
        if len(self.open) == self.windows:
            # None fits: the fullest goes out, filled to the brim with the head of the piece.
            at = min(range(self.windows), key=lambda i: (self.free[i], i))
            head, piece = piece.cut(self.free[at])
            self.open[at].append(head)
            self._close(at)
        self.open.append([piece])
        self.free.append(self.sequence - len(piece))

    def merge(self) -> list[Piece]:
        """Fill windows from one another, fullest first; what is left is under one sequence."""
        order = sorted(range(len(self.open)), key=lambda i: (self.free[i], i))
        pieces = [p for i in order for p in self.open[i]]
        self.open, self.free = [], []
        return self._run(pieces)

    def _run(self, pieces: list[Piece]) -> list[Piece]:
        """Cut a run of pieces into full sequences; returns the rest."""
        held: list[Piece] = []
        room = self.sequence
        for p in pieces:
            while len(p) >= room:
                head, p = p.cut(room)
                self._emit([*held, head])
                held, room = [], self.sequence
            if len(p):
                held.append(p)
                room -= len(p)
        return held

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(SCHEMA), SCHEMA.types, strict=True)], schema=SCHEMA)


def _packed(path: str, sequence: int, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        cache, packer = run_cache(RunCache, path), Packer(task << 32, sequence, windows)
        end = END_ID.to_bytes(4, "little")
        for block in blocks(batches, rows=10_000, max_bytes=8 << 20):
            for doc_id, ids in zip(block.column(0).to_pylist(), cache.encode(block.column(1)), strict=True):
                whole = memoryview(ids + end)
                packer.add(Piece(doc_id, 0, whole, len(whole) // 4))
            # An open window holds its own ids, not those of the whole document.
            packer.open = [[Piece(p.doc_id, p.start, memoryview(bytes(p.ids)), p.doc_tokens) if len(p.ids) < p.ids.obj.__len__() else p for p in w] for w in packer.open]
            yield packer.take()
        packer.rows += [(p.doc_id, p.start, len(p), 0, p.doc_tokens, None, None, bytes(p.ids), task, i) for i, p in enumerate(packer.merge())]
        yield packer.take()

    return run


def _merged(sequence: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending"), ("place", "ascending")])
        packer = Packer((1 << 62) | (key[0].as_py() << 32), sequence)
        rest = packer._run([Piece(r["doc_id"], r["start"], memoryview(r["ids"]), r["doc_tokens"]) for r in table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist()])
        if rest:
            packer._emit(rest)
        return pa.Table.from_batches([packer.take()])

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, sequence: int = SEQUENCE, windows: int = WINDOWS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its token ids and an end id, so an empty or null text is one
    id. Each partition streams through its documents with ``windows`` open
    windows: whole sequences of long documents go out at once, the rest is placed
    in the window it fits best; if none fits, the fullest is filled with its head
    and goes out. At the end the open windows are merged, and the rest of each
    partition (under one sequence) is merged with those of MERGED - 1 others. So
    only the last sequence of MERGED partitions is short and needs padding.

    Rows that repeat an id are documents of their own; a null id stays null in its
    pieces. An empty table gives an
    empty result; other columns of ``df`` are ignored. Which documents share a
    sequence depends on how the input is split; every id is in one piece always.
    """
    path = tokenizer_path or default_tokenizer_path()
    pieces = settle(id_and_text(df, id_col, text_col).transform(in_batches, _packed(path, sequence, windows), DDL), "pieces")
    rest = pieces.where(F.col("ids").isNotNull()).withColumn("part", F.floor(F.col("task") / MERGED).cast("long"))
    merged = rest.groupBy("part").applyInArrow(_merged(sequence), DDL)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pieces.where(F.col("ids").isNull()).select(*columns).unionByName(merged.select(*columns))
