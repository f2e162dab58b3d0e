"""Word shingles of texts: as sets of 64-bit hashes, and as the words themselves."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C55)
_INVERSE = U(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
#: Keys of the two lanes of a word's hash.
_LANES = (U(0x9E3779B97F4A7C55), U(0xD1342543DE82EF95))
#: Bytes of a word that are hashed side by side with others; longer words are hashed one by one.
_LONG = 256
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the argument moves every bit of the result."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=U)
    p[:1] = 1
    return np.cumprod(p, dtype=U)


_CACHED: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i under ``n``."""
    if n > 1 << 20:
        return _powers(_BASE, n), _powers(_INVERSE, n)
    if not _CACHED:
        _CACHED.update(up=_powers(_BASE, 1 << 20), down=_powers(_INVERSE, 1 << 20))
    return _CACHED["up"][:n], _CACHED["down"][:n]


def words_of(text: str) -> list[bytes]:
    """Runs without ASCII white space, lower-cased in A-Z."""
    return text.encode().lower().split()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash, in two lanes of 64 bits, and text number of every word, in order; words are lower-cased in A-Z.

    Each eight bytes go through a mixing of their own, so no pattern of a text
    carries over to its hash.
    """
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" " * 9, dtype=np.uint8)]
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    lanes = np.empty((len(starts), 2), dtype=U)
    for i, key in enumerate(_LANES):
        lanes[:, i] = mix(size.astype(U) + key)
    live = np.flatnonzero(size <= _LONG)
    for at in range(0, _LONG, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        value = eight[starts[live] + at].astype(U)
        left = size[live] - at
        short = left < 8
        value[short] &= (U(1) << (left[short].astype(U) << U(3))) - U(1)
        for i, key in enumerate(_LANES):
            lanes[live, i] = mix(lanes[live, i] * key + value)
    for w in np.flatnonzero(size > _LONG).tolist():
        lanes[w] = np.frombuffer(hashlib.blake2b(data[starts[w] : ends[w]].tobytes(), digest_size=16).digest(), dtype="<u8")
    return lanes, np.searchsorted(ends_of_texts, starts, side="right")


def _rolled(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k words that follow each other."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, U(k), dtype=U)
    for j in range(k):
        h = mix(h * U(0xD6E8FEB86659FD93) + words[j : j + n])
    return h


def shingle_sets(texts: list[str], k: int) -> tuple[list[np.ndarray], list[bytes | None]]:
    """For each text the sorted distinct hashes of its k-word shingles, and a 128-bit digest of the set.

    The digest sees 128 bits of every shingle. A text of fewer words, but one at
    least, has its whole sequence as its only shingle; one without words has none,
    and no digest.
    """
    words, owner = word_hashes([t.encode() for t in texts])
    n = np.bincount(owner, minlength=len(texts)) if len(words) else np.zeros(len(texts), dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(n)]).tolist()
    rolled = [_rolled(words[:, i], k) for i in (0, 1)]
    sets, keys = [], []
    for a, b in zip(begin, begin[1:], strict=False):
        if a == b:
            sets.append(np.zeros(0, dtype=U))
            keys.append(None)
            continue
        first, second = (r[a : b - k + 1] for r in rolled) if b - a >= k else (_rolled(words[a:b, i], b - a) for i in (0, 1))
        first, at = np.unique(first, return_index=True)
        sets.append(first)
        keys.append(hashlib.blake2b(first.tobytes() + second[at].tobytes(), digest_size=16).digest())
    return sets, keys


def really_linked(a: str, b: str, k: int, percent: int) -> bool:
    """As ``linked``, of the shingles themselves: words, and then shingles, are numbered, not hashed."""
    words = (words_of(a), words_of(b))
    if min(map(len, words)) < k:
        return bool(words[0]) and words[0] == words[1]
    number: dict[bytes, int] = {}
    one, two = (np.fromiter((number.setdefault(w, len(number)) for w in own), dtype=np.int64, count=len(own)) for own in words)
    base, n = len(number), len(one) - k + 1
    codes = np.concatenate([one[:n], two[: len(two) - k + 1]])
    for j in range(1, k):
        following = np.concatenate([one[j : n + j], two[j : len(two) - k + 1 + j]])
        codes = np.unique(codes * base + following, return_inverse=True)[1]
    x, y = np.unique(codes[:n]), np.unique(codes[n:])
    shared = common(x, y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    both = np.concatenate([a, b])
    both.sort(kind="mergesort")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sets that aren't empty."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    inter = common(a, b)
    return 100 * inter >= percent * (len(a) + len(b) - inter)
