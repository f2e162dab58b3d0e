"""Near-duplicate groups: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import blocks, in_batches, join_counted, settle
from lexmill.llm.components import connected_components
from lexmill.llm.shingles import U, linked, mix, really_linked, shingle_sets

#: Bands, and coordinates in each: a pair at 0.8 shares a band with probability 1 - 3e-6.
BANDS = 32
ROWS = 5
#: Members that one leader meets in one group of a task.
GROUP = 64
#: Members of one leader, and open ones, that meet in one cell at most.
CELL = 16384


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of ``t`` coordinates for each set that isn't empty (of an empty one: all bits set).

    Round i of the first t hashes every element to a bin and a value, and a bin
    keeps the least (round, value); round t + j hashes every element to bin j. A
    set leaves when all its bins are filled, so large ones after a round or two
    and the smallest after t + t rounds at most, with no bin left empty. Two sets
    agree in a coordinate with the probability of their Jaccard similarity, and
    the agreements are concentrated as if the coordinates were independent.
    """
    n, none = len(sets), U(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, none, dtype=U)
    sizes = [len(s) for s in sets]
    values = np.concatenate([*sets, np.zeros(0, dtype=U)])
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    for i in range(2 * t):
        if not len(values):
            break
        x = mix(values ^ mix(np.array([i + 1], dtype=U) * U(0xA0761D6478BD642F)))
        at = (x % U(t)).astype(np.int64) if i < t else np.full(len(x), i - t, dtype=np.int64)
        x = mix(x)
        np.minimum.at(out, owner * t + at, (U(i) << U(54)) | (x >> U(10)))
        full = (out.reshape(n, t) != none).all(axis=1)
        stay = ~full[owner]
        if not stay.all():
            values, owner = values[stay], owner[stay]
    return out.reshape(n, t)


def band_hashes(rows: np.ndarray, bands: int) -> np.ndarray:
    parts = rows.reshape(len(rows), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0xE7037ED1A0B428DB), parts.shape[:2])
    for j in range(parts.shape[2]):
        h = mix(h * U(0x8EBC6AF09C88C6E3) + parts[:, :, j])
    return h


def _signed(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, max_bytes=1 << 20):
            sets, keys = shingle_sets(block.column(2).to_pylist(), k)
            hashed = band_hashes(sketches(sets, bands * rows), bands).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * (len(sets) + 1), bands, dtype=np.int32)), pa.array(hashed.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), lists],
                ["doc_id", "fp", "n_shingles", "set_key", "bands"],
            )

    return run


def _met(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, str, str, np.ndarray, np.ndarray]]]:
    """Rows sorted by leader, salt, and then leader before members -> leader, member, their texts and their sets."""
    leader, text, theirs = None, "", np.zeros(0, dtype=U)
    for block in blocks(batches, max_bytes=1 << 20):
        ids, salts, members, texts = (block.column(i).to_pylist() for i in range(4))
        out = []
        for a, salt, b, own_text, own in zip(ids, salts, members, texts, shingle_sets(texts, k)[0], strict=True):
            if b is None:
                leader, text, theirs = (a, salt), own_text, own
            elif leader == (a, salt):
                out.append((a, b, text, own_text, theirs, own))
        yield out


def _links(rows: list, k: int, percent: int) -> list[bool]:
    """Whether leader and member are linked: their hashes say so, and then their shingles themselves."""
    return [linked(theirs, own, percent) and really_linked(text, own_text, k, percent) for _, _, text, own_text, theirs, own in rows]


def _compared(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _met(k, batches):
            found = [r[:2] for r, near in zip(rows, _links(rows, k, percent), strict=True) if near]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return run


def _differences(k: int, percent: int):
    """As _compared, but a row for every member: its size, and what tells its set from the leader's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _met(k, batches):
            deltas = [np.setxor1d(r[4], r[5], assume_unique=True).view(np.int64) for r in rows]
            offsets = np.cumsum([0, *(len(d) for d in deltas)], dtype=np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*deltas, np.zeros(0, dtype=np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[5]) for r in rows], pa.int64()), pa.array(_links(rows, k, percent), pa.bool_()), values],
                ["a", "b", "size", "near", "delta"],
            )

    return run


def meet(pairs: DataFrame, texts: DataFrame, run, ddl: str) -> DataFrame:
    """Hold each a against its partners b, on full texts, in groups of about GROUP.

    The text of a goes to each of its groups; so no task holds more than a group,
    however many partners a has.
    """
    counts = settle(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("groups", F.ceil(F.col("n") / F.lit(GROUP)).cast("int")), "leaders")
    numbered = join_counted(pairs, counts, ["a"], "n", ["b"]).select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"))
    members = numbered.join(texts, numbered["b"] == texts["node"]).select("a", "salt", "b", "text")
    leaders = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))
    leaders = leaders.join(texts, leaders["a"] == texts["node"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    dealt = members.union(leaders).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.transform(in_batches, run, ddl)


def _linked_apart(percent: int):
    """Rows (a, cell, open, b, component, size, delta), sorted by the first three -> links to other components.

    Sets x and y whose differences from the same leader are X and Y differ in
    |X| + |Y| - 2 |X and Y| shingles, and are linked if that is at most (100 -
    percent) / (100 + percent) of the sum of their sizes. So only differences are
    looked at, by an index of those of the cell's members; of its links to one
    component an open member reports one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, index = None, [], None

        def build() -> tuple:
            ids, parts, sizes = (np.array([h[i] for h in held], dtype=np.int64) for i in range(3))
            deltas = [np.array(h[3], dtype=np.int64) for h in held]
            tokens = np.concatenate([*deltas, np.zeros(0, dtype=np.int64)])
            owner = np.repeat(np.arange(len(held)), [len(d) for d in deltas])
            order = np.argsort(tokens, kind="stable")
            return ids, parts, sizes, np.array([len(d) for d in deltas]), tokens[order], owner[order]

        for block in blocks(batches):
            found: list[tuple[int, int]] = []
            for a, cell, open_, b, part, size, delta in zip(*(block.column(i).to_pylist() for i in range(7)), strict=True):
                if group != (a, cell):
                    group, held, index = (a, cell), [], None
                if not open_:
                    held.append((b, part, size, delta))
                    continue
                if not held:
                    continue
                if index is None:
                    index = build()
                ids, parts, sizes, counts, tokens, owner = index
                mine = np.array(delta, dtype=np.int64)
                lo, hi = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
                n = hi - lo
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                shared = np.bincount(owner[at], minlength=len(ids))
                apart = counts + len(mine) - 2 * shared
                # x and y are linked if 100 * common >= percent * union, with union - common = apart.
                union = (sizes + size + apart) // 2
                ok = (100 * (union - apart) >= percent * union) & (parts != part)
                if ok.any():
                    first = np.unique(parts[ok], return_index=True)[1]
                    found += [(b, int(y)) for y in ids[ok][first]]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _across(group: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one leader that are in different components.

    ``group``: a, b, component, size, delta. The members outside a leader's
    largest component are its open ones; they are held against all members in a
    grid of cells, each of a block of members and a block of open ones. The blocks
    grow with the leader's members up to CELL, so that no task holds more.
    """
    tally = group.groupBy("a", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("a")
    tally = tally.agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    block = F.least(F.lit(CELL), F.greatest(F.lit(512), F.ceil(F.sqrt(F.col("n") * (F.col("n") - F.col("most")) / 256)).cast("int")))
    tally = tally.withColumns({"rows": F.ceil(F.col("n") / block).cast("int"), "columns": F.ceil((F.col("n") - F.col("most")) / block).cast("int")})
    group = join_counted(group, settle(tally, "tally"), ["a"], "n", ["b"])
    columns = ["b", "component", "size", "delta"]
    row, column = F.pmod(F.xxhash64("b"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("b", F.lit(1)), F.col("columns")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = group.withColumn("x", row).select("a", "x", every("columns").alias("y"), F.lit(False).alias("open"), *columns)
    unsure = group.where(F.col("component") != F.col("largest")).withColumn("y", column).select("a", every("rows").alias("x"), "y", F.lit(True).alias("open"), *columns)
    dealt = held.union(unsure).select("a", (F.col("x") * F.lit(1 << 31) + F.col("y")).alias("cell"), "open", *columns)
    dealt = dealt.repartition("a", "cell").sortWithinPartitions("a", "cell", "open")
    return dealt.transform(in_batches, _linked_apart(percent), "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_shingles, component_id, kept``.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; a set is
    the distinct k-word shingles of the whole text (fewer words: the sequence as
    one shingle; no words or null: empty). Documents are linked if 100 * |A and B|
    >= percent * |A or B|. ``component_id`` is the smallest id that links reach,
    and rows of that id in the component are ``kept``. Documents with an empty set
    are linked with nothing. Rows that repeat an id are documents of their own,
    linked by their own texts; if both are in one component they have the same
    ``component_id``. A row with a null id takes no part: its component is null
    and it is kept. Other columns are ignored; an empty table gives an empty result.

    1. Equal sets are grouped by a 128-bit digest; one row stands for them.
    2. The sketch of each representative is cut into bands. Texts that share a
       band are candidates. No bucket is capped.
    3. In each bucket all members are compared with its first. Buckets whose
       members are in one component then are done.
    4. In the others all members meet the one that has most links so far, and what
       tells their sets from its set is kept. From these differences the similarity
       of any two members follows exactly; the members outside the largest
       component are held against all others (see ``_across``). Pairs are not
       emitted, only links between components.
    So each pair that shares a bucket is compared or already connected. All links
    are confirmed on the shingles themselves, not on their hashes. The work of the
    last step grows with (members outside the largest component) x (members) of a
    leader: texts of one template that are almost, but not, near-duplicates.
    """
    return near_rows(df, id_col, text_col, k, percent, bands, rows).drop("fp")


def near_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """As ``near_components``, with ``fp``, a hash that tells the texts of one id apart."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("fp"), "text")
    signed = settle(docs.transform(in_batches, _signed(k, bands, rows), "doc_id long, fp long, n_shingles long, set_key binary, bands array<long>"), "sketches")
    takes_part = F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()
    known = signed.where(takes_part)
    reps = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "fp")).alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
    # Numbers that are written are fixed; ids can't be nodes, as rows may repeat them.
    reps = settle(reps.withColumn("node", F.monotonically_increasing_id()), "representatives")
    buckets = reps.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a")).where(F.col("n") > 1)
    members = settle(join_counted(buckets, settle(shared, "shared"), ["bucket"], "n", ["node"]).select("bucket", "node", "a"), "buckets")
    wanted = members.select("node").distinct().join(reps, "node").select("node", "rep.doc_id", "rep.fp")
    texts = settle(docs.join(wanted, ["doc_id", "fp"]).groupBy("doc_id", "fp").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"), "candidates")

    pairs = settle(members.where("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    links = settle(meet(pairs, texts, _compared(k, percent), "a long, b long"), "links")

    def placed(rows: DataFrame, of: str, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        component = settle(connected_components(links), "components")
        return rows.join(component, rows[of] == component["id"], "left").withColumn("component", F.coalesce("component", of)).drop("id"), component

    at, component = placed(members.select("bucket", "node"), "node", links)
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    at = settle(at.join(degree, F.col("node") == F.col("id"), "left").select("bucket", "node", "component", F.coalesce("degree", F.lit(0)).alias("degree")), "placed")
    undone = at.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max_by("node", F.struct("degree", -F.col("node"))).alias("a"), F.count(F.lit(1)).alias("n"))
    undone = settle(undone.where("lo < hi").select("bucket", "a", "n"), "undone")
    pairs = join_counted(at.select("bucket", "node"), undone, ["bucket"], "n", ["node"])
    pairs = settle(pairs.where("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    met = settle(meet(pairs, texts, _differences(k, percent), "a long, b long, size long, near boolean, delta array<long>"), "met")
    links = links.union(met.where("near").select("a", "b"))

    group, component = placed(met, "b", links)
    pairs = settle(_across(group, percent), "pairs")
    links = links.union(settle(meet(pairs, texts, _compared(k, percent), "a long, b long"), "links"))
    component = settle(connected_components(links), "components")
    least = component.join(reps.select(F.col("node").alias("id"), F.col("rep.doc_id").alias("rep")), "id")
    least = settle(least.groupBy("component").agg(F.min("rep").alias("class"), F.count(F.lit(1)).alias("n")), "least")
    named = join_counted(component, least, ["component"], "n", ["id"]).select("id", "class")
    classes = reps.join(named, reps["node"] == named["id"], "left").select("set_key", "n", F.coalesce("class", "rep.doc_id").alias("component_id"))
    columns = ["doc_id", "fp", "n_shingles", "component_id"]
    out = join_counted(known.drop("bands"), settle(classes, "classes"), ["set_key"], "n", ["doc_id"]).select(*columns)
    out = out.unionByName(signed.where(~takes_part).select("doc_id", "fp", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate group, as it is: a row of the group's smallest id.

    Rows without an id, or without words, are in no group and stay. Of rows that
    repeat the smallest id one stays, whether their texts are equal or not.
    """
    key, fp = F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    grouped = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]") & F.col(id_col).isNotNull(), F.lit(False))
    found = near_rows(df.where(grouped), id_col, text_col, k, percent).where("kept")
    kept = found.groupBy(F.col("doc_id").alias("_nd_id")).agg(F.min(F.struct("fp")).alias("_nd_least"), F.count(F.lit(1)).alias("_nd_rows"))
    kept = settle(kept.select("_nd_id", F.col("_nd_least.fp").alias("_nd_fp"), "_nd_rows"), "kept")
    tagged = df.where(grouped).withColumns({"_nd_own": key, "_nd_own_fp": fp})
    on = lambda k: (F.col("_nd_own") == k["_nd_id"]) & (F.col("_nd_own_fp") == k["_nd_fp"])
    one, many = kept.where("_nd_rows = 1"), kept.where("_nd_rows > 1")
    single = tagged.join(one, on(one), "left_semi").select(*df.columns)
    # Rows of one id that are all in the group: the aggregate keeps one of each task's, then one of all.
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    repeated = tagged.join(many, on(many), "left_semi").groupBy("_nd_own").agg(F.first(whole).alias("_nd_row")).select("_nd_row.*")
    return single.union(repeated).union(df.where(~grouped))
