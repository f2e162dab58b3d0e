"""Token ids of whole texts for a vocabulary of words with ends, looked up by word.

The vocabulary drops white space and no token spans it, so the ids of a text are
those of its runs between white space, one after another. Arrow splits the texts
of a batch, numbers the distinct runs, and parts those from the punctuation at
their ends; only distinct parts are looked at in Python, and each worker keeps the
ids of those that it has met, up to a bound.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of each of the two generations of a worker's cache, and the longest word that it keeps.
CACHED_WORDS = 300_000
CACHED_LENGTH = 48
#: Words that the library encodes at once.
ENCODED_AT_ONCE = 16384
#: Punctuation at the end of a run, behind a letter or digit, is a word of its own.
_TAIL = r"(\pL|\pN)([!-&(-/:;=-@\[-`{-~]+)$"
#: For lower-case ASCII the same as the vocabulary's own pattern.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\s\x1c-\x1fa-z0-9]+|[\x1c-\x1f]+")


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def lower(text: str) -> str:
    """Lower case of each character by itself: a capital sigma has no final form."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class RunCache:
    """ids of texts by the ``tokenizers`` library, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix = spec["model"]["end_of_word_suffix"]
        self._last = np.zeros(1 + max([*spec["model"]["vocab"].values(), *self.special.values()]), dtype=bool)
        self._last[[i for s, i in spec["model"]["vocab"].items() if s.endswith(suffix)]] = True
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_run(self, run: str) -> bytes:
        """A run as it stands, special tokens in it included."""
        return np.array(self._tokenizer.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Words that the pattern makes of normalised text."""
        ids = np.array(self._tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self._last[ids]) + 1
        if len(ends) != len(words) or len(ids) != ends[-1]:
            return [self.encode_run(w) for w in words]
        data, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def split(self, run: str) -> list[str] | None:
        """The words of a run; None if it has to be encoded as it stands."""
        if run.isascii():
            if "<|" in run:
                return None
            run = run.lower()
            return [run] if run.isalpha() else _ASCII_WORDS.findall(run)
        run = lower(unicodedata.normalize("NFC", run))
        if "<|" in run or not unicodedata.is_normalized("NFC", run):
            return None
        return [run] if run.isalpha() else self.pattern.findall(run)

    def resolve(self, parts: list[str]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        get, older, known = self.known.get, self.older, self.known
        out = [get(p) for p in parts]
        missing = [i for i, x in enumerate(out) if x is None]
        if older:
            for i in missing:
                if (ids := older.get(parts[i])) is not None:
                    out[i] = known[parts[i]] = ids
            missing = [i for i in missing if out[i] is None]
        open_ = [(i, self.split(parts[i])) for i in missing]
        fresh = list({w for _, words in open_ if words for w in words if w not in self.known})
        found: dict[str, bytes] = {}
        for a in range(0, len(fresh), ENCODED_AT_ONCE):
            part = fresh[a : a + ENCODED_AT_ONCE]
            found.update(zip(part, self.encode_words(part), strict=True))
        for i, words in open_:
            if words is None:
                ids = self.encode_run(parts[i])
            else:
                ids = b"".join([found[w] if w in found else self.known[w] for w in words])
            out[i] = ids
            if len(parts[i]) <= CACHED_LENGTH:
                self.known[parts[i]] = ids
        return out

    def numbered(self, texts: pa.Array) -> Numbered:
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        runs = lists.flatten().dictionary_encode()
        # Special tokens are looked for in raw text, so a run that may hold one keeps its case.
        raw = pc.match_substring(runs.dictionary, "<|")
        plain = pc.if_else(pc.and_not(pc.string_is_ascii(runs.dictionary), raw), pc.ascii_lower(runs.dictionary), runs.dictionary)
        parted = pc.if_else(raw, plain, pc.replace_substring_regex(plain, _TAIL, r"\1 \2"))
        parts = pc.ascii_split_whitespace(parted)
        distinct = parts.flatten().dictionary_encode()
        return Numbered(lists.offsets, runs.indices, parts.offsets, distinct.indices, self.resolve(distinct.dictionary.to_pylist()))

    def encode(self, texts: pa.Array) -> list[bytes]:
        return self.numbered(texts).ids().to_pylist()


@dataclass(frozen=True)
class Numbered:
    """Texts as runs by number, runs as parts by number, and the ids of the parts."""

    text_offsets: pa.Array
    runs: pa.Array
    run_offsets: pa.Array
    parts: pa.Array
    part_ids: list[bytes]

    def ids(self) -> pa.Array:
        of_runs = joined(self.run_offsets, self.parts, pa.array(self.part_ids, pa.binary()), b"")
        return joined(self.text_offsets, self.runs, of_runs, b"")

    def spelt(self, of_parts: list[str | None]) -> pa.Array:
        """The texts when each part is spelt so, with a space between; None for a part without ids."""
        of_runs = joined(self.run_offsets, self.parts, pa.array(of_parts, pa.string()), " ")
        if None in of_parts:
            of_runs = pc.if_else(pc.equal(of_runs, ""), None, of_runs)
        return joined(self.text_offsets, self.runs, of_runs, " ")


def joined(offsets: pa.Array, numbers: pa.Array, values: pa.Array, separator: bytes | str) -> pa.Array:
    """The numbered values of each list behind one another; those that are null are left out."""
    lists = pa.ListArray.from_arrays(offsets, values.take(numbers))
    if not lists.values.null_count:
        return pc.binary_join(lists, pa.scalar(separator, values.type))
    return pa.array([separator.join([x for x in row if x is not None]) for row in lists.to_pylist()], values.type)


_CACHES: dict[tuple[type, str], RunCache] = {}


def run_cache(kind: type[RunCache], path: str) -> RunCache:
    """The one of this worker process."""
    if (kind, path) not in _CACHES:
        _CACHES[kind, path] = kind(path)
    return _CACHES[kind, path]
