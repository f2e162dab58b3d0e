"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import blocks, in_batches
from lexmill.llm.shingles import U, mix

#: Documents of each language that a model is fitted to, about; of all languages; and words of a document, about.
SAMPLE, SAMPLE_ALL, SAMPLE_WORDS = 400, 40_000, 200
#: Characters of a sampled document that reach the driver, from a place that its id's hash gives.
SAMPLE_CHARS = 4000
#: Distinct words whose features are held at once.
WORDS_AT_ONCE = 16384
#: Places of the hashed weights of a label at most, and weights of all labels: with many labels there are fewer places.
PLACES, WEIGHTS = 1 << 17, 1 << 24
#: Words of a chain that a model is fitted to, and of a stretch of a text's chain that is computed side by side with others.
CHAIN = 64
UNDETERMINED = "und"
#: The highest number of bytes of an affix and of an n-gram, with the marks at a word's ends.
AFFIX, GRAMS = 5, (2, 3, 4)


@dataclass(frozen=True)
class Crf:
    """Weights of features by label, and of transitions and starts."""

    labels: tuple[str, ...]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def seen(self) -> np.ndarray:
        """Whether the fitting has seen a feature at a place of the weights."""
        return self.emit.any(axis=1)


def places_of(labels: int) -> int:
    """Places for so many labels: a power of 2."""
    places = PLACES
    while places > 1024 and places * labels > WEIGHTS:
        places //= 2
    return places


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number, word number) of every word with a letter, in order; and the distinct words.

    A word is the letters of a run between white space, in lower case.
    """
    lists = pc.utf8_split_whitespace(texts)
    runs = lists.flatten().dictionary_encode()
    letters = pc.utf8_lower(pc.replace_substring_regex(runs.dictionary, r"[^\pL]+", "")).dictionary_encode()
    number = letters.indices.to_numpy()[runs.indices.to_numpy()]
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    filled = pc.not_equal(letters.dictionary, "").to_numpy(zero_copy_only=False)
    keep = filled[number] if len(number) else np.zeros(0, dtype=bool)
    return owner[keep], number[keep], letters.dictionary


def word_features(words: pa.Array, n_places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """(word number, place of a weight) of every feature of every word.

    Prefixes and suffixes, n-grams in any place, and the word itself (the lexicon),
    over the bytes of the word between two marks.
    """
    marked = pc.binary_join_element_wise("\x02", words, "\x03", "")
    data = np.frombuffer(b"".join(pc.cast(marked, pa.binary()).to_pylist()), dtype=np.uint8).astype(U)
    size = pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    first = end - size
    at, places = [], []

    def add(word: np.ndarray, h: np.ndarray, kind: int) -> None:
        at.append(word)
        places.append((mix(h + U(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % U(n_places)).astype(np.int64))

    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(data)) - first[owner] if len(data) else np.zeros(0, dtype=np.int64)
    room = end[owner] - np.arange(len(data)) if len(data) else place
    rolled = np.zeros(len(data), dtype=U)
    for n in range(1, AFFIX + 1):
        # rolled: the n bytes from here on, where the word has so many.
        rolled[: len(data) - n + 1] = rolled[: len(data) - n + 1] * U(257) + data[n - 1 :] + U(1)
        ok = room >= n
        if n >= 2:
            head, tail = ok & (place == 0), ok & (room == n)
            add(owner[head], rolled[head], 10 + n)
            add(owner[tail], rolled[tail], 20 + n)
        if n in GRAMS:
            add(owner[ok], rolled[ok], n)
    weight = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x100000001B3, dtype=U))
    whole = np.add.reduceat(mix(data) * weight[place], first) if len(data) else np.zeros(0, dtype=U)
    add(np.arange(len(words)), whole, 1)
    return np.concatenate(at), np.concatenate(places)


def emissions(words: pa.Array, emit: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The summed weights of each word's features, by label; and the share of them that the fitting has seen."""
    out, known = np.zeros((len(words), emit.shape[1]), dtype=np.float32), np.zeros(len(words))
    for a in range(0, len(words), WORDS_AT_ONCE):
        part = words[a : a + WORDS_AT_ONCE]
        word, place = word_features(part, len(emit))
        for k in range(emit.shape[1]):
            out[a : a + len(part), k] = np.bincount(word, weights=emit[place, k], minlength=len(part))
        known[a : a + len(part)] = np.bincount(word, weights=seen[place], minlength=len(part)) / np.maximum(np.bincount(word, minlength=len(part)), 1)
    return out, known


def _sweep(e: np.ndarray, length: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages along stretches (n, t, k): what arrives at each word, scaled; and what leaves each stretch's last."""
    n, t, _ = e.shape
    arrive, last = np.zeros_like(e), np.zeros_like(first)
    a = first
    for i in range(t):
        live = i < length
        arrive[:, i] = a
        out = a * e[:, i]
        out /= out.sum(axis=1, keepdims=True)
        last[live] = out[live]
        a = out @ move
    return arrive, last


def _settled(e: np.ndarray, length: np.ndarray, move: np.ndarray, end: np.ndarray, is_end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What arrives at each word of whole chains, each in several stretches.

    ``before``: the stretch from which a message comes; at ends (``is_end``) it is
    ``end``. All stretches are swept side by side, first with a guess; those
    whose message turns out to be another are swept again, until none is: so the
    result is that of one sweep through the whole chain.
    """
    first = np.where(is_end[:, None], end, e.dtype.type(1 / e.shape[2])).astype(e.dtype)
    arrive, last = np.zeros_like(e), np.zeros_like(first)
    todo = np.arange(len(e))
    while len(todo):
        arrive[todo], last[todo] = _sweep(e[todo], length[todo], move, first[todo])
        now = last[before] @ move
        now /= now.sum(axis=1, keepdims=True)
        todo = np.flatnonzero(~is_end & (np.abs(now - first / first.sum(axis=1, keepdims=True)).max(axis=1) > 1e-6))
        first[todo] = now[todo]
    return arrive


def chain_marginals(scores: np.ndarray, size: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of labels (words, k) by forward-backward over whole chains.

    ``scores``: those of all words, chain after chain; ``size``: words of each chain,
    none of which is empty.
    """
    k, t = scores.shape[1], int(min(CHAIN, size.max()))
    pieces = -(-size // t)
    row_of_first = np.cumsum(pieces) - pieces
    n = int(pieces.sum())
    place = np.arange(len(scores)) - np.repeat(np.cumsum(size) - size, size)
    row, column = np.repeat(row_of_first, size) + place // t, place % t
    length = np.bincount(row, minlength=n)
    e = np.ones((n, t, k), dtype=np.float32)
    e[row, column] = np.maximum(np.exp(scores - scores.max(axis=1, keepdims=True)), 1e-30)
    m = np.exp(move - move.max()).astype(np.float32)
    is_first, is_last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    is_first[row_of_first], is_last[row_of_first + pieces - 1] = True, True
    number = np.arange(n)
    forward = _settled(e, length, m, np.exp(start - start.max())[None, :], is_first, np.where(is_first, number, number - 1))
    # Backwards, the words of each stretch stand in reverse.
    turned = np.where(np.arange(t) < length[:, None], length[:, None] - 1 - np.arange(t), np.arange(t))[:, :, None]
    backward = _settled(np.take_along_axis(e, turned, axis=1), length, m.T, np.ones((1, k)), is_last, np.where(is_last, number, number + 1))
    marginal = (forward * e * np.take_along_axis(backward, turned, axis=1))[row, column]
    return marginal / marginal.sum(axis=1, keepdims=True)


def forward_backward(scores: np.ndarray, length: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of labels (n, t, k), summed pair marginals (k, k) and log partition of chains.

    ``scores``: (n, t, k), of which chain i has the first ``length[i]`` rows. In
    probability space with a scale for each step, so that nothing overflows.
    """
    n, t, k = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e = np.exp(scores - top)
    m, log_z = np.exp(move), top[:, :, 0] * (np.arange(t) < length[:, None])
    log_z = log_z.sum(axis=1)
    forward, scale = np.zeros_like(e), np.ones((n, t), dtype=e.dtype)
    a = e[:, 0] * np.exp(start)
    for i in range(t):
        live = i < length
        if i:
            a = (forward[:, i - 1] @ m) * e[:, i]
        a[~live] = 0
        s = a.sum(axis=1)
        s[~live] = 1
        scale[:, i] = s
        forward[:, i] = a / s[:, None]
    log_z = log_z + np.log(scale).sum(axis=1)
    marginal, pairs = np.zeros_like(e), np.zeros((k, k))
    b = np.ones((n, k), dtype=e.dtype)
    for i in range(t - 1, -1, -1):
        over = i >= length - 1
        if i < t - 1:
            nxt = e[:, i + 1] * b / scale[:, i + 1, None]
            live = (i + 1 < length).astype(e.dtype)[:, None]
            nxt *= live
            pairs += forward[:, i].T @ nxt * m
            b = nxt @ m.T
        b = np.where(over[:, None], e.dtype.type(1), b)
        marginal[:, i] = forward[:, i] * b
    marginal *= (np.arange(t) < length[:, None])[:, :, None]
    return marginal, pairs, log_z


def fit(texts: list[str], labels: list[str], seed: int = 7, rounds: int = 6, rate: float = 0.25) -> Crf:
    """Maximum likelihood on chains in which languages change, as in code-switched text.

    Documents bear one label, so chains are made of stretches of 4 to 24 words of
    documents drawn at random: features learn from all of them, and transitions
    from where the stretches meet.
    """
    names = tuple(sorted(set(labels)))
    k = len(names)
    n_places = places_of(max(k, 1))
    emit, move, start = np.zeros((n_places, k), dtype=np.float32), np.zeros((k, k), dtype=np.float32), np.zeros(k, dtype=np.float32)
    owner, number, words = words_of(pa.array(texts, pa.string()))
    if k < 2 or not len(owner):
        return Crf(names, emit, move, start)
    gold_of = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    stretches = []
    for own in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
        at = 0
        while at < len(own):
            n = int(rng.integers(4, 25))
            # Of a long text some stretches, from all over it.
            if rng.random() * len(own) < SAMPLE_WORDS:
                stretches.append(own[at : at + n])
            at += n
    if not stretches:
        return Crf(names, emit, move, start)
    taken = np.sort(np.concatenate(stretches))
    used, renumbered = np.unique(number[taken], return_inverse=True)
    number = np.zeros(len(owner), dtype=np.int64)
    number[taken] = renumbered
    words = words.take(pa.array(used))
    order, feature = word_features(words, n_places)
    sort = np.argsort(order, kind="stable")
    order, feature = order[sort], feature[sort]
    first = np.searchsorted(order, np.arange(len(words) + 1))
    squares = [np.full_like(x, 1e-6) for x in (emit, move, start)]
    for _ in range(rounds):
        line = np.concatenate([stretches[i] for i in rng.permutation(len(stretches))])
        for begin in range(0, len(line), 128 * CHAIN):
            part = line[begin : begin + 128 * CHAIN]
            used, word = np.unique(number[part], return_inverse=True)
            count = first[used + 1] - first[used]
            rows = np.repeat(np.arange(len(used)), count)
            places = feature[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[used][rows]]
            score = np.stack([np.bincount(rows, weights=emit[places, j], minlength=len(used)) for j in range(k)], axis=1)
            n = -(-len(part) // CHAIN)
            r, c = np.divmod(np.arange(len(part)), CHAIN)
            length = np.bincount(r, minlength=n)
            table = np.zeros((n, CHAIN, k))
            table[r, c] = score[word]
            marginal, pairs, _ = forward_backward(table, length, move.astype(float), start.astype(float))
            gold = gold_of[owner[part]]
            hot = np.zeros((len(part), k))
            hot[np.arange(len(part)), gold] = 1
            step = hot - marginal[r, c]
            by_word = np.stack([np.bincount(word, weights=step[:, j], minlength=len(used)) for j in range(k)], axis=1)
            g_emit = np.stack([np.bincount(places, weights=by_word[rows, j], minlength=n_places) for j in range(k)], axis=1)
            g_move = -pairs
            inner = r[1:] == r[:-1]
            np.add.at(g_move, (gold[:-1][inner], gold[1:][inner]), 1)
            g_start = (hot - marginal[r, c])[c == 0].sum(axis=0)
            for w, g, s in zip((emit, move, start), (g_emit, g_move, g_start), squares, strict=True):
                s += g * g
                w += rate * g / np.sqrt(s)
    return Crf(names, emit, move, start)


def predict(model: Crf, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Label and score of each text: the label with the highest mean marginal, and that mean.

    A word's marginals count as far as the fitting has seen its features: what is
    like nothing that was learned speaks for no label. So the score is low for a
    text of no learned language, and for one of several.
    """
    owner, number, words = words_of(texts)
    k = len(model.labels)
    total = np.zeros((len(texts), max(k, 1)))
    n = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), dtype=np.int64)
    if len(owner) and k:
        score, known = emissions(words, model.emit, model.seen())
        begin = np.cumsum(n) - n
        # Texts of about equal length go together, some thousand stretches at a time.
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        batch = np.cumsum(-(-n[order] // CHAIN)) // 2048
        for part in np.split(order, np.flatnonzero(np.diff(batch)) + 1):
            size = n[part]
            text = np.repeat(part, size)
            at = np.repeat(begin[part], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            marginal = chain_marginals(score[number[at]], size, model.move, model.start) * known[number[at], None]
            for label in range(k):
                total[:, label] += np.bincount(text, weights=marginal[:, label], minlength=len(texts))
    mean = total / np.maximum(n, 1)[:, None]
    best = mean.argmax(axis=1)
    labels = [model.labels[b] if c and k else UNDETERMINED for b, c in zip(best.tolist(), n.tolist(), strict=True)]
    return labels, np.where((n > 0) & (k > 0), np.clip(mean.max(axis=1), 0, 1), 0.0)


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, sample: int = SAMPLE) -> Crf:
    """Fit to about ``sample`` documents of each label, and SAMPLE_ALL of all together.

    All labels are learned. Which rows are drawn depends on a hash of their id and
    text, at a rate for each label that follows from its count; equal rows are
    drawn as one. Only drawn rows, and of a long text SAMPLE_CHARS characters from
    a place that the hash gives, reach the driver. The labels and their rates are
    broadcast: they are fewer than the model's weights, which the driver holds.
    """
    learn = F.lit(True) if learn is None else learn
    rows = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return fit([], [])
    wanted, span = max(1, min(sample, SAMPLE_ALL // len(counts))), 1 << 30
    rates = df.sparkSession.createDataFrame([(lang, min(span, int(span * wanted / n) + 1)) for lang, n in counts], "lang string, rate long")
    named = rows.join(F.broadcast(rates), "lang").withColumn("hash", F.xxhash64("id", "text", F.lit("language sample")))
    start = F.lit(1) + F.pmod(F.col("hash"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int")
    drawn = named.where(F.pmod("hash", F.lit(span)) < F.col("rate")).select("hash", F.substr("text", start, F.lit(SAMPLE_CHARS)).alias("text"), "lang")
    found = sorted(tuple(r) for r in drawn.groupBy("hash", "lang").agg(F.min("text").alias("text")).select("lang", "hash", "text").collect())
    return fit([t for _, _, t in found], [lang for lang, _, _ in found])


def identify(df: DataFrame, model: Crf, text_col: str = "text", passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``passed`` columns of ``df``, with ``lang_pred`` and ``score`` behind them.

    Whole texts are read. A null text, or one without a letter, is ``und`` with
    score 0. Rows that repeat an id stay. Each row alone, no shuffle.
    """
    # A model has about WEIGHTS weights at most, however large the input is.
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = [*passed, *([] if text_col in passed else [text_col])]
    at, n = columns.index(text_col), len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, rows=10_000, max_bytes=4 << 20):
            labels, scores = predict(shared.value, pc.fill_null(block.column(at), ""))
            yield pa.RecordBatch.from_arrays([*block.columns[:n], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*block.schema.names[:n], "lang_pred", "score"])

    base = df.select(*columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:n])
    return base.transform(in_batches, run, f"{fields}, lang_pred string, score double")


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    The model learns from rows that are not held out; an empty table, or one
    without labels, gives ``und`` everywhere.
    """
    model = train(df, id_col, text_col, lang_col, learn=~held_out(id_col))
    rows = identify(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
