"""Text quality by positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import blocks, in_batches

#: Positive and unlabelled documents that a model is fitted to, about.
POSITIVES, UNLABELLED = 2000, 4000

# Classes of bytes: what a text is made of, whatever its language.
_CLASSES = 24
_CLASS = np.full(256, 0, dtype=np.int64)
_CLASS[0x80:] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
for _i, _group in enumerate((" ", "\n", ".", ",", "!", "?", "*", "$", "%", "&", "#", "|", "'\"", "-_", ":;", "()[]{}<>", "/\\", "@", "=+~^`")):
    for _c in _group:
        _CLASS[ord(_c)] = 5 + _i
N_DENSE = 9
N_FEATURES = _CLASSES * _CLASSES + N_DENSE


def features(texts: list[bytes]) -> np.ndarray:
    """A row for each text: square roots of byte-class bigram shares, and measures of form.

    Measures: log length, words, mean word and line length, distinct words and
    lines, the longest run of one word, capitals and symbols among the characters.
    """
    n = len(texts)
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    data = _CLASS[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    owner = np.repeat(np.arange(n), [len(t) + 1 for t in texts])
    code = data[:-1] * _CLASSES + data[1:]
    same = owner[:-1] == owner[1:]
    counts = np.bincount(owner[:-1][same] * _CLASSES**2 + code[same], minlength=n * _CLASSES**2).reshape(n, -1)
    out[:, : _CLASSES**2] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    for i, t in enumerate(texts):
        words, lines = t.split(), t.split(b"\n")
        size = max(len(t), 1)
        best = min(len(words), 1)
        if any(map(eq, words, words[1:])):
            best = max(len(list(g)) for _, g in groupby(words))
        caps = int(counts[i].reshape(_CLASSES, -1)[3].sum())
        odd = int(counts[i].reshape(_CLASSES, -1)[9:].sum())
        m = max(len(words), 1)
        out[i, _CLASSES**2 :] = (np.log1p(len(t)) / 10, np.log1p(len(words)) / 8, min(len(t) / m, 40) / 20, min(len(t) / len(lines), 2000) / 1000, len(set(words)) / m, len(set(lines)) / len(lines), best / m, caps / size, odd / size)
    return out


@dataclass(frozen=True)
class Scorer:
    """A linear model on scaled features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(grad, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = (np.zeros(size, dtype=np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, estimated from scores that tell the two apart.

    Over any threshold, unlabelled rows are at least prior * (positives over it);
    so the least ratio of the two shares bounds the prior from above. Thresholds
    that too few rows reach are left out, and each ratio gets the slack of a
    binomial share.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    best = 1.0
    for t in np.quantile(p, np.linspace(0, 0.9, 91)):
        over_p = (len(p) - np.searchsorted(p, t)) / len(p)
        over_u = (len(u) - np.searchsorted(u, t)) / len(u)
        slack = np.sqrt(over_u * (1 - over_u) / len(u)) + np.sqrt(over_p * (1 - over_p) / len(p))
        best = min(best, (over_u + slack) / max(over_p, 1e-9))
    return float(np.clip(best, 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-3) -> Scorer:
    """Minimise the non-negative unbiased risk with the logistic loss.

    risk = prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)).
    When the bracket is negative, the step goes against it, as the unlabelled are
    being overfitted then.
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 0.02)
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    p1, u1 = (np.c_[x, np.ones(len(x))].astype(np.float32) for x in (p, u))

    first = _adam(lambda w: apart_gradient(w, p1, u1, decay), p1.shape[1], steps // 2, rate)
    prior = class_prior(p1 @ first, u1 @ first)
    w = _adam(lambda w: risk_gradient(w, p1, u1, prior, decay), p1.shape[1], steps, rate)
    return Scorer(mean, scale, w[:-1], float(w[-1]), prior)


def apart_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, decay: float) -> np.ndarray:
    """Of the logistic loss that tells positives (rows of ``p``) from unlabelled rows (of ``u``)."""
    return p.T @ (_sigmoid(p @ w) - 1) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + decay * w


def risk_parts(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """prior * R+(positive), and R-(unlabelled) - prior * R-(positive), with the logistic loss."""
    fp, fu = p @ w, u @ w
    return float(prior * np.logaddexp(0, -fp).mean()), float(np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean())


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, decay: float) -> np.ndarray:
    """Of the non-negative risk; where its second part is negative, against that part."""
    sp = _sigmoid(p @ w)
    plus = p.T @ (sp - 1) / len(p)
    minus = u.T @ _sigmoid(u @ w) / len(u) - prior * p.T @ sp / len(p)
    return (prior * plus + minus if risk_parts(w, p, u, prior)[1] >= 0 else -minus) + decay * w


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, max_bytes=1 << 20):
        x = features([t.encode() for t in block.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([block.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["hash", "x"])


def _rate(n: int, wanted: int) -> int:
    """Of a hash of 30 bits, below which ``wanted`` of ``n`` rows are, about."""
    return min(1 << 30, int((1 << 30) * wanted / max(n, 1)) + 1)


def _matrix(rows: DataFrame, wanted: int) -> np.ndarray:
    """Features of about ``wanted`` rows (doc_id, text), and of twice as many at most.

    Drawn by a hash of id and text, so equal rows are drawn as one; features are
    made where the rows are, and those of the least hashes reach the driver.
    """
    hashed = rows.select(F.xxhash64("doc_id", "text", F.lit("quality sample")).alias("hash"), "text")
    drawn = hashed.where(F.pmod("hash", F.lit(1 << 30)) < _rate(rows.count(), wanted))
    found = drawn.transform(in_batches, _featured, "hash long, x binary").groupBy("hash").agg(F.min("x").alias("x"))
    first = found.orderBy(F.pmod("hash", F.lit(1 << 30)), "hash").limit(2 * wanted).collect()
    return np.frombuffer(b"".join(bytes(r["x"]) for r in first), dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Scorer | None:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, quality): positives are ids with a row of quality 1.

    Both samples are bounded, from rows that ``learn`` admits; rows without an id
    are never positives. None without positives. About POSITIVES ids are broadcast,
    twice as many at most.
    """
    ids = labels.where(learn & (F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(1 << 30))
    trusted = ids.where(draw < _rate(ids.count(), POSITIVES)).orderBy(draw, "doc_id").limit(2 * POSITIVES)
    positive = _matrix(docs.join(F.broadcast(trusted), "doc_id", "left_semi"), POSITIVES)
    unlabelled = _matrix(docs.where(learn), UNLABELLED)
    return fit(positive, unlabelled) if len(positive) and len(unlabelled) else None


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    The score is the estimated probability of label 1, from the text alone. A null
    text is scored as the empty one. Without any positive label all scores are
    0.5. Rows that repeat an id stay; other columns are ignored; an empty table
    gives an empty result. Scoring reads each row alone, without a shuffle.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = train(docs, labels, ~held_out("doc_id"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, max_bytes=1 << 20):
            texts = [t.encode() for t in block.column(1).to_pylist()]
            s = shared.value.score(features(texts)) if shared.value else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs.transform(in_batches, run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
