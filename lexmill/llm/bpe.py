"""Byte-pair encoding and decoding, written out: a queue of merges over a linked list."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.common import blocks, id_and_text, in_batches
from lexmill.llm.word_bpe import RunCache, default_tokenizer_path, lower, run_cache


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def compile_words(spec: dict):
    import regex

    return regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])


class WordBpe:
    """Encoder and decoder of one vocabulary file of words with ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.ranks.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        letters = byte_letters()
        self._inner = [self.ids.get(c, -1) for c in letters]
        self._final = [self.ids.get(c + self.end, -1) for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.by_id = [self.strings.get(i, "") for i in range(1 + max(self.strings))]
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._tokens = compile_words(spec)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge by rank, lowest first and leftmost among equals, until no rank is left.

        Symbols are a doubly linked list in arrays. The queue holds (rank, place,
        left, right) as they were when queued; an entry whose symbols have changed
        since is stale and skipped.
        """
        n, ranks = len(symbols), self.ranks
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if found := ranks.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i] = ranks[a, b][1]
            symbols[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := ranks.get((symbols[i], symbols[k])):
                    heapq.heappush(queue, (found[0], i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (found := ranks.get((symbols[h], symbols[i]))):
                heapq.heappush(queue, (found[0], h, symbols[h], symbols[i]))
        return [s for s in symbols if s >= 0]

    def encode_word(self, word: str) -> list[int]:
        """A word of normalised text."""
        data = word.encode()
        symbols = [self._inner[b] for b in data[:-1]]
        symbols.append(self._final[data[-1]])
        return self.merge([s for s in symbols if s >= 0])

    def _encode_plain(self, text: str) -> list[int]:
        return [i for word in self._tokens.findall(lower(unicodedata.normalize("NFC", text))) for i in self.encode_word(word)]

    def encode(self, text: str) -> list[int]:
        if not self._special:
            return self._encode_plain(text)
        out: list[int] = []
        at = 0
        for m in self._special.finditer(text):
            out += self._encode_plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._encode_plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, one space between; the vocabulary file has no decoder of its own."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


class OwnRunCache(RunCache):
    """As RunCache, by the encoder above."""

    def __init__(self, path: str) -> None:
        self.bpe = WordBpe(path)
        self.pattern, self.special = self.bpe._tokens, self.bpe.special
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_run(self, run: str) -> bytes:
        return np.array(self.bpe.encode(run), dtype="<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        one = self.bpe.encode_word
        ids = [one(w) for w in words]
        data = np.fromiter((i for x in ids for i in x), dtype="<u4").tobytes()
        bounds = [0, *(4 * np.cumsum([len(x) for x in ids])).tolist()]
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _decoded(cache: OwnRunCache, ids: list[bytes]) -> list[str | None]:
    """What each part decodes to; None if it has no ids."""
    strings = cache.bpe.by_id
    numbers = np.frombuffer(b"".join(ids), dtype="<u4").tolist()
    out, at = [], 0
    for x in ids:
        n = len(x) // 4
        out.append(" ".join([strings[i] for i in numbers[at : at + n]]) if n else None)
        at += n
    return out


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, ids`` (little-endian unsigned 32-bit, binary), ``decoded``.

    Null and empty texts have no ids and decode to the empty text. Rows that
    repeat an id stay; other columns are ignored; an empty table gives an empty
    result. Very long texts are encoded whole. No shuffle; each row alone.
    """
    path = tokenizer_path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = run_cache(OwnRunCache, path)
        for block in blocks(batches, rows=10_000, max_bytes=8 << 20):
            found = cache.numbered(block.column(1))
            yield pa.RecordBatch.from_arrays([block.column(0), found.ids(), found.spelt(_decoded(cache, found.part_ids))], ["doc_id", "ids", "decoded"])

    return id_and_text(df, id_col, text_col).transform(in_batches, run, "doc_id long, ids binary, decoded string")


def digest(ids_and_text: DataFrame) -> DataFrame:
    """What ``encode_decode`` returns, as counts and digests."""
    from pyspark.sql import functions as F

    return ids_and_text.select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

