"""Removal of repeated substrings: depth-limited radix sort of anchored suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest

from lexmill.llm.common import blocks, discard, in_batches, join_counted, settle
from lexmill.llm.shingles import U, mix, powers

#: Bytes of a string that counts as repeated, and of the grams at which suffixes are anchored.
WINDOW = 200
GRAM = 100
#: Bytes of context on either side of a gram that a window over it can reach.
SIDE = WINDOW - GRAM
#: Contexts of one core that a task sorts; larger groups are split by further passes first.
AT_ONCE = 16384
#: Bytes of a digit of the radix sort.
DIGIT = 8
#: Bytes of a text whose anchors are sought at once: a longer text is cut into pieces that overlap by a window.
#: About so many are sought at once of short texts too, as their arrays then fit a core's cache.
PIECE = 1 << 17


def _sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op, of a minimum or a maximum, over each w consecutive values: over twice as many from step to step."""
    width = 1
    while 2 * width <= w:
        x = op(x[:-width], x[width:])
        width *= 2
    left = w - width
    return op(x[: len(x) - left], x[left:]) if left else x


class Texts:
    """Some texts behind one another, with hashes of any of their substrings."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.ends - [len(t) for t in texts]
        up, self._down = powers(len(self.data) + 1)
        self._total = np.zeros(len(self.data) + 1, dtype=U)
        np.cumsum((self.data.astype(U) + U(1)) * up[:-1], out=self._total[1:])

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self._total[b] - self._total[a]) * self._down[a])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(text number, place in it) of the grams whose hash is least in some window.

        Equal windows have equal least grams at equal places, so two equal windows
        always share an anchor, wherever they stand.
        """
        n = len(self.data)
        long = np.flatnonzero(self.ends - self.starts >= WINDOW)
        none = np.zeros(0, dtype=np.int64)
        if not len(long):
            return none, none
        # The upper halves of the hashes choose; grams that tie are anchors both.
        grams = (mix((self._total[GRAM:] - self._total[: n - GRAM + 1]) * self._down[: n - GRAM + 1]) >> U(32)).astype(np.uint32)
        valid = np.zeros(n + 1, dtype=np.int8)
        valid[self.starts[long]] += 1
        valid[self.ends[long] - WINDOW + 1] -= 1
        window_ok = np.cumsum(valid[:-1], dtype=np.int8)[: n - WINDOW + 1].astype(bool)
        least = np.where(window_ok, _sliding(grams, SIDE + 1, np.minimum), np.uint32(0))
        edge = np.zeros(SIDE, dtype=np.uint32)
        reach = _sliding(np.concatenate([edge, least, edge]), SIDE + 1, np.maximum)
        at = np.flatnonzero(reach == grams)
        owner = np.searchsorted(self.ends, at, side="right")
        ok = (at + GRAM <= self.ends[owner]) & (self.ends[owner] - self.starts[owner] >= WINDOW)
        at, owner = at[ok], owner[ok]
        return owner, at - self.starts[owner]


def _passes(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose bytes are those of another row of their group, and their new groups.

    ``group`` is ascending, and so are the new groups. Most-significant-digit
    passes: each splits the groups by the next digit of DIGIT bytes, by a sort
    unless all groups agree in it, and what stands alone leaves.
    """
    rows = np.arange(len(values))
    for at in range(-DIGIT, values.shape[1], DIGIT):
        if at >= 0:
            part = np.zeros((len(rows), DIGIT), dtype=np.uint8)
            digit = values[rows, at : at + DIGIT]
            part[:, : digit.shape[1]] = digit
            value = part.view(">u8").astype(U).reshape(-1)
            new = np.ones(len(rows), dtype=bool)
            new[1:] = group[1:] != group[:-1]
            if (value == value[np.flatnonzero(new)[np.cumsum(new) - 1]]).all():
                continue
            order = np.lexsort((value, group))
            rows, group, value = rows[order], group[order], value[order]
            new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
            group = np.cumsum(new) - 1
        if not len(rows):
            break
        if at < 0:
            group = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
        many = np.bincount(group)[group] > 1
        if not many.all():
            rows, group = rows[many], group[many]
        if not len(rows):
            break
    return rows, group


def repeated_windows(contexts: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context, from where to where repeated windows cover it (-1, -1: nowhere).

    ``contexts``: rows of SIDE + GRAM + SIDE bytes around grams, of which ``left``
    and ``right`` bytes beside the gram are there; ``group``: equal for equal
    grams, which are told apart by the first passes. A window that begins o bytes before the gram needs equal o bytes to the
    left and SIDE - o to the right. So what all windows of a range of o need is the
    range's core; from range to half range cores grow by the next bytes, passes
    over these split the groups, and what stands alone leaves. The core of a single
    o is a window: its groups are exactly the repeated windows.
    """
    m = len(contexts)
    lo, hi = np.full(m, WINDOW + SIDE, dtype=np.int64), np.full(m, -1, dtype=np.int64)
    todo = [(0, SIDE, *_passes(contexts[:, SIDE : SIDE + GRAM], group))]
    while todo:
        first, last, rows, own = todo.pop()
        if first == last:
            lo[rows] = np.minimum(lo[rows], SIDE - first)
            hi[rows] = np.maximum(hi[rows], SIDE - first + WINDOW)
            continue
        middle, end = (first + last) // 2, SIDE + GRAM + SIDE
        for c, d, x, y in ((first, middle, end - last, end - middle), (middle + 1, last, SIDE - middle - 1, SIDE - first)):
            there = (left[rows] >= c) & (right[rows] >= SIDE - d)
            near, of = rows[there], own[there]
            found, split = _passes(contexts[near, x:y], of)
            if len(found):
                todo.append((c, d, near[found], split))
    lo[hi < 0] = -1
    return lo, hi


def _columns(block: pa.RecordBatch, at: int) -> list[bytes]:
    return [t.encode() for t in block.column(at).to_pylist()]


def _pieces(texts: list[bytes], most: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text number, where it begins, bytes) of each text or of its overlapping pieces, about ``most`` bytes at once."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - WINDOW + 1), most - WINDOW + 1):
            piece = text[at : at + most]
            if held and size + len(piece) > most:
                yield held
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield held


def _anchored(places: bool, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, rows=1024, max_bytes=1 << 20):
            for pieces in _pieces(_columns(block, 2), most):
                texts = Texts([p for _, _, p in pieces])
                owner, place = texts.anchors()
                at = place + texts.starts[owner] if len(owner) else place
                gram = pa.array(texts.hashes(at, at + GRAM).view(np.int64))
                if places:
                    row, begin = (np.array([p[i] for p in pieces], dtype=np.int64)[owner] for i in (0, 1))
                    ids, fps = (block.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([gram, pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(place + begin)], ["gram", "doc", "fp", "place"])
                else:
                    yield pa.RecordBatch.from_arrays([gram], ["gram"])

    return run


MEMBERS_DDL = "gram long, c1 long, c2 long, doc long, fp long, copies long, place long, left long, right long"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, fp, text, places, copies) -> a row for each place: digests of the gram and of the bytes around it."""
    for block in blocks(batches, rows=1024, max_bytes=1 << 20):
        grams, digests, places, sizes = [], [], [], []
        for text, own in zip(_columns(block, 2), block.column(3).to_pylist(), strict=True):
            grams += [xxh3_64_digest(text[p : p + GRAM]) for p in own]
            inner = len(text) - GRAM - SIDE
            digests += [_digest(text, p) if SIDE <= p <= inner else _digest_at_edge(text, p) for p in own]
            places += own
            sizes.append((len(own), len(text)))
        count, size = np.array(sizes, dtype=np.int64).reshape(-1, 2).T
        row, place = np.repeat(np.arange(len(count)), count), np.array(places, dtype=np.int64)
        gram, context = np.frombuffer(b"".join(grams), dtype="<i8"), np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        ids, fps, copies = (block.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1, 4))
        columns = [gram, context[:, 0], context[:, 1], ids, fps, copies, place, np.minimum(SIDE, place), np.minimum(SIDE, size[row] - place - GRAM)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], [f.split()[0] for f in MEMBERS_DDL.split(", ")])


def _digest(text: bytes, p: int) -> bytes:
    """Of the bytes around the gram at ``p``."""
    return blake2b(text[p - SIDE : p + GRAM + SIDE], digest_size=16).digest()


def _digest_at_edge(text: bytes, p: int) -> bytes:
    """As _digest, where the text begins or ends sooner."""
    left, right = min(SIDE, p), min(SIDE, len(text) - p - GRAM)
    return blake2b(text[p - left : p + GRAM + right], digest_size=16, person=bytes([left, right])).digest()


CONTEXTS_DDL = "gram long, c1 long, c2 long, n long, m long, left long, right long, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted: array of gram, c1, c2, n, m, place) -> the bytes around each place."""
    for block in blocks(batches, rows=1024, max_bytes=1 << 20):
        rows = []
        for text, wanted in zip(_columns(block, 0), block.column(1).to_pylist(), strict=True):
            for w in wanted:
                p = w["place"]
                a, b = max(0, p - SIDE), min(len(text), p + GRAM + SIDE)
                rows.append((w["gram"], w["c1"], w["c2"], w["n"], w["m"], p - a, b - p - GRAM, bytes(SIDE - p + a) + text[a:b] + bytes(p + GRAM + SIDE - b)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 7 + [pa.binary()], strict=True)], [f.split()[0] for f in CONTEXTS_DDL.split(", ")])


def _matrix(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), dtype=np.uint8).reshape(-1, GRAM + 2 * SIDE)


COVERED_DDL = "gram long, c1 long, c2 long, n long, lo long, hi long"


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, gram, c1, c2, n, left, right, bytes), sorted by key and c1 -> what repeated windows cover of each."""
    held: list[pa.RecordBatch] = []

    def flush(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        key, gram, c1, c2, n, left, right = (table[c].to_numpy() for c in ("key", "gram", "c1", "c2", "n", "left", "right"))
        contexts = _matrix(table["bytes"])
        # The second of two that agree in all bytes is told by the first; both are covered as far as they reach.
        same = np.zeros(len(key), dtype=bool)
        same[1:] = (key[1:] == key[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1]) & (contexts[1:] == contexts[:-1]).all(axis=1)
        alone = ~same
        own = np.flatnonzero(alone)
        lo, hi = repeated_windows(contexts[own], left[own], right[own], np.unique(key[own], return_inverse=True)[1])
        twice = np.flatnonzero(same[1:])
        whole = twice[alone[twice]]
        at = np.searchsorted(own, whole)
        lo[at], hi[at] = SIDE - left[whole], SIDE + GRAM + right[whole]
        ok = hi >= 0
        columns = [gram[own][ok], c1[own][ok], c2[own][ok], n[own][ok], lo[ok], hi[ok]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], [f.split()[0] for f in COVERED_DDL.split(", ")])

    for block in blocks(batches, rows=4000):
        held.append(block)
        table = pa.Table.from_batches(held)
        key = table["key"].to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if cut:
            yield flush(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield flush(pa.Table.from_batches(held))


def _covered(contexts: DataFrame) -> DataFrame:
    """``gram, c1, c2, n, lo, hi``: what repeated windows cover of each context.

    Groups of equal grams that fit a task are sorted in one. Those that don't are
    split by passes over all of them first: from a range of window starts to its
    halves, by the cores of these (see ``repeated_windows``), until they fit or the
    core is a whole window. Equal cores are counted, combined on the map side;
    they never gather in one task. The result is settled, what leads to it is discarded.
    """
    columns = ["gram", "c1", "c2", "n", "left", "right", "bytes"]
    small = [contexts.where(F.col("m") <= AT_ONCE).select(F.col("gram").alias("key"), *columns)]
    whole, splits = [], []
    large = contexts.where(F.col("m") > AT_ONCE).select(*columns, F.lit(0).alias("first"), F.lit(SIDE).alias("last"))
    while not large.isEmpty():
        middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("first").alias("first"), middle.alias("last")), F.struct((middle + 1).alias("first"), F.col("last").alias("last"))))
        split = large.withColumn("half", halves).select(*columns, "half.*")
        split = split.where((F.col("left") >= F.col("first")) & (F.col("right") >= F.lit(SIDE) - F.col("last")))
        core = F.substr("bytes", F.lit(SIDE + 1) - F.col("first"), F.lit(GRAM + SIDE) + F.col("first") - F.col("last"))
        cored = settle(split.withColumn("core", core), "cored")
        groups = settle(cored.groupBy("first", "core").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "cores")
        split = settle(join_counted(cored, groups, ["first", "core"], "m", ["c1", "c2"]), "split")
        discard(cored, groups)
        splits.append(split)
        windows = split.where("first = last")
        whole.append(windows.select("gram", "c1", "c2", "n", (F.lit(SIDE) - F.col("first")).cast("long").alias("lo"), (F.lit(SIDE + WINDOW) - F.col("first")).cast("long").alias("hi")))
        # A part of the windows is left to sort: so the context reaches only as far as these.
        reach = {"left": F.least("left", F.col("last").cast("long")), "right": F.least("right", (F.lit(SIDE) - F.col("first")).cast("long"))}
        fits = (F.col("m") <= AT_ONCE) & (F.col("first") < F.col("last"))
        small.append(split.where(fits).withColumns(reach).select(F.xxhash64("first", "core").alias("key"), *columns))
        large = split.where((F.col("m") > AT_ONCE) & (F.col("first") < F.col("last"))).drop("core", "m")
    rows = reduce(DataFrame.unionByName, small)
    found = rows.repartition("key").sortWithinPartitions("key", "left", "right", "c1", "c2").transform(in_batches, _sorted_groups, COVERED_DDL)
    covered = reduce(DataFrame.unionByName, whole, found).groupBy("gram", "c1", "c2").agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    covered = settle(covered, "covered")
    discard(contexts, *splits)
    return covered


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: spans that overlap or touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that they cover only in part."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, fp, text, spans) -> what is left of the text."""
    for block in blocks(batches):
        rows = []
        for doc, fp, text, spans in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), _columns(block, 2), block.column(3).to_pylist(), strict=True):
            runs = merged_spans([(s["a"], s["b"]) for s in spans])
            rows.append((doc, fp, sum(b - a for a, b in runs), len(runs), hashlib.sha256(cut_bytes(text, runs)).hexdigest(), cut_bytes(text, whole_characters(text, runs)).decode()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc", "fp", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def _name(id_col: str, text_col: str) -> dict[str, Column]:
    """``doc`` and ``fp``, which name a text and its id, a null id too."""
    own = F.col(id_col).cast("long")
    return {"doc": F.coalesce(own, F.lit(0)).cast("long"), "fp": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), own.isNull())}


def cut_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, fp, n_removed, n_spans, kept_sha256, kept_text`` of the texts that lose bytes.

    ``doc`` and ``fp`` (a hash of the text) name a text, so that rows that repeat
    an id stay apart unless they are equal.

    1. The least gram of each window is an anchor, about every 50 bytes: equal
       windows have the same anchor at the same place, so only suffixes there are
       ordered. Anchors whose gram's hash is seen once are forgotten.
    2. The others go to their texts, which then are read once more. Anchors with
       the same bytes around them, as far as a window can reach, are counted
       together by a 128-bit digest; two of them stand for all.
    3. The bytes around these are sorted in depth-limited radix passes, on the
       bytes themselves (see ``_covered`` and ``repeated_windows``).
    4. The spans of each text are merged and cut out.
    """
    names = _name(id_col, text_col)
    docs = df.select(*[c.alias(n) for n, c in names.items()], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = docs.where(F.octet_length("text") >= WINDOW)
    grams = long.transform(in_batches, _anchored(False, PIECE), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    grams = settle(grams, "grams")
    anchors = join_counted(long.transform(in_batches, _anchored(True, PIECE), "gram long, doc long, fp long, place long"), grams, ["gram"], "seen", ["doc", "fp", "place"])
    places = anchors.groupBy("doc", "fp").agg(F.collect_set("place").alias("places"))
    touched = long.join(places, ["doc", "fp"]).groupBy("doc", "fp").agg(F.first("text").alias("text"), F.first("places").alias("places"), F.count(F.lit(1)).alias("copies"))
    touched = settle(touched, "touched")
    discard(grams)
    members = settle(touched.transform(in_batches, _members, MEMBERS_DDL), "members")

    here = F.struct("doc", "fp", "place")
    classes = members.groupBy("gram", "c1", "c2").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("places"), F.min(here).alias("first"), F.max(here).alias("last"))
    classes = settle(classes.withColumn("two", F.when(F.col("places") > 1, F.array("first", "last")).otherwise(F.array("first"))), "contexts")
    kinds = settle(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.size("two")).alias("m")).where("m > 1"), "kinds")
    sought = join_counted(classes, kinds, ["gram"], "kinds", ["c1", "c2"]).select("gram", "c1", "c2", "n", "m", F.explode("two").alias("at"))
    wanted = sought.groupBy("at.doc", "at.fp").agg(F.collect_list(F.struct("gram", "c1", "c2", "n", "m", F.col("at.place").alias("place"))).alias("wanted"))
    contexts = settle(touched.select("doc", "fp", "text").join(wanted, ["doc", "fp"]).select("text", "wanted").transform(in_batches, _contexts, CONTEXTS_DDL), "bytes")
    discard(classes, kinds)

    covered = _covered(contexts)
    a, b = F.col("place") - SIDE + F.col("lo"), F.col("place") - SIDE + F.col("hi")
    spans = join_counted(members, covered, ["gram", "c1", "c2"], "n", ["doc", "fp", "place"]).select("doc", "fp", F.struct(a.alias("a"), b.alias("b")).alias("span"))
    # A text that stands in several rows of one id repeats as a whole.
    repeated = touched.where("copies > 1").select("doc", "fp", F.struct(F.lit(0).cast("long").alias("a"), F.octet_length("text").cast("long").alias("b")).alias("span"))
    spans = spans.union(repeated).groupBy("doc", "fp").agg(F.collect_set("span").alias("spans"))
    return touched.select("doc", "fp", "text").join(spans, ["doc", "fp"]).select("doc", "fp", "text", "spans").transform(in_batches, _removed, "doc long, fp long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte is removed if a string of WINDOW bytes covers it that starts anywhere
    else too, in the same document or in another; strings are judged on the input
    and never cross documents. A null text is empty; texts under WINDOW bytes lose
    nothing; an empty table gives an empty result; other columns are ignored.
    Rows that repeat an id and a text are documents of their own, copies of each
    other; rows that repeat an id with other texts are different documents; so are
    rows without an id. Long texts are anchored in overlapping pieces.
    """
    names = _name(id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(n) for n, c in names.items()], F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    cut = cut_texts(df, id_col, text_col).drop("kept_text")
    return docs.join(cut, ["doc", "fp"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with repeated substrings cut out of the text; other columns stay as they are.

    As ``substring_dedup``, but a character of which a repeated string covers only
    some bytes stays, so that the text stays valid. Null texts stay null.
    """
    cut = settle(cut_texts(df, id_col, text_col).select(F.col("doc").alias("_sd_doc"), F.col("fp").alias("_sd_fp"), F.col("kept_text").alias("_sd_text")), "cut")
    names = _name(id_col, text_col)
    joined = df.withColumns({"_sd_own": names["doc"], "_sd_own_fp": names["fp"]}).join(cut, (F.col("_sd_own") == F.col("_sd_doc")) & (F.col("_sd_own_fp") == F.col("_sd_fp")), "left")
    return joined.withColumn(text_col, F.coalesce("_sd_text", F.col(text_col))).select(*df.columns)
