"""Media columns: payloads in content-defined chunks, stored once and read back verified."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import blocks, id_and_text, in_batches, settle, settled_path
from lexmill.llm.shingles import mix

#: A payload is a multiple of so many bytes, and not empty.
UNIT = 64
#: Bytes of a chunk: least, most, and the bits of the gear hash that are 0 at a cut.
LEAST, MOST, CUT_BITS = 2048, 32768, 13
#: Sample rate that the stored form states.
RATE = 8000
#: A chunk of more references than this is joined in SALTS copies.
HOT, SALTS = 2000, 64

#: Texts, characters of each, and bytes of the dictionary that short chunks are pressed with.
SAMPLE, SAMPLE_CHARS, DICTIONARY = 2000, 2048, 1 << 16

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def wave_header(n: int) -> bytes:
    """Of a file of n mono samples of 8 bits."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def samples_of(media: bytes) -> bytes:
    """The samples of a stored file; fails if the file isn't of that form."""
    n = len(media) - 44
    if n <= 0 or media[:44] != wave_header(n):
        raise ValueError("not an 8-bit mono wave file of the stated length")
    return media[44:]


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2 h + G[byte] modulo 2 ** 32 after each byte: it sees 32 bytes back."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h = np.concatenate([h[:k], h[k:] + (h[:-k] << np.uint32(k))])
    return h


def cuts(data: bytes) -> list[int]:
    """Where chunks end: at the first hash with zeros in its highest bits after LEAST bytes, or at MOST."""
    n = len(data)
    if n <= LEAST:
        return [n]
    places = np.flatnonzero(gear(np.frombuffer(data, dtype=np.uint8)) >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, at = [], 0
    while n - at > LEAST:
        i = np.searchsorted(places, at + LEAST)
        at = min(int(places[i]) if i < len(places) else n, at + MOST, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks_of(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def features(samples: bytes) -> str:
    """Length, sum, sum of squares, sign changes about the middle, and counts by 8 levels."""
    x = np.frombuffer(samples, dtype=np.uint8)
    v = x.astype(np.int64) - 128
    levels = np.bincount(x >> 5, minlength=8)
    return f"n={len(x)};sum={int(v.sum())};energy={int((v * v).sum())};crossings={int(np.count_nonzero((v[1:] < 0) != (v[:-1] < 0)))};levels={','.join(map(str, levels))}"


def dictionary_of(keyed: DataFrame) -> bytes:
    """What the chunks of a store are pressed with: trained on a bounded sample of the texts (key, text).

    About SAMPLE distinct texts, drawn by their key's hash, and SAMPLE_CHARS
    characters from a place that the hash gives, reach the driver. It changes the
    size of the store and no value. Empty if there is too little to train on.
    """
    import zstandard

    start = F.lit(1) + F.pmod(F.xxhash64("key"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int")
    rate = min(1 << 30, int((1 << 30) * SAMPLE / max(keyed.count(), 1)) + 1)
    drawn = keyed.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < rate).select("key", F.substr("text", start, F.lit(SAMPLE_CHARS)).alias("text"))
    least = drawn.groupBy("key").agg(F.first("text").alias("text")).orderBy("key").limit(2 * SAMPLE).collect()
    samples = [r["text"].encode() for r in least if r["text"]]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _shape(dictionary: bytes) -> dict:
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _stored(dictionary: bytes):
    """Rows (key, text) -> a row (digest, data) for each chunk, data compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=9, write_content_size=True, write_checksum=False, **_shape(dictionary))
        for block in blocks(batches):
            chunks = [c for t in block.column(1).to_pylist() for c in chunks_of(payload_of(t.encode()))]
            yield pa.RecordBatch.from_arrays([pa.array([digest(c) for c in chunks], pa.binary()), pa.array([press.compress(c) for c in chunks], pa.binary())], ["digest", "data"])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) -> a row (key, n_bytes, header, chunks, place, digest) for each chunk."""
    for block in blocks(batches):
        rows = []
        for key, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
            data = text.encode()
            payload = payload_of(data)
            parts = chunks_of(payload)
            rows += [(key, len(data), wave_header(len(payload)), len(parts), i, digest(c)) for i, c in enumerate(parts)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "n_bytes", "header", "chunks", "place", "digest"])


def _read(dictionary: bytes):
    """Rows (key, n_bytes, header, chunks, place, digest, data), each key's in order -> a row for each key.

    Every chunk is held against its digest and its place in the list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor(**_shape(dictionary))
        parts: list[bytes] = []
        for block in blocks(batches):
            rows = []
            for key, n_bytes, header, chunks, place, name, data in zip(*(block.column(i).to_pylist() for i in range(7)), strict=True):
                chunk = press.decompress(data)
                if digest(chunk) != name or place != len(parts):
                    raise ValueError("a chunk of the store is damaged or missing")
                parts.append(chunk)
                if len(parts) == chunks:
                    media, parts = b"".join([header, *parts]), []
                    samples = samples_of(media)
                    rows.append((key, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], READ_NAMES)

    return run


READ_NAMES = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
READ_DDL = "key binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def chunk_store(keyed: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """``digest, data, refs``: each distinct chunk of the texts (key, text) once, as written to the shared folder.

    The table is bucketed by digest, so that reading it by digest moves no chunk.
    """
    spark = keyed.sparkSession
    chunks = keyed.transform(in_batches, _stored(dictionary), "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data"), F.count(F.lit(1)).alias("refs"))
    path = settled_path(spark, "chunks")
    name = "lexmill_" + path.rpartition("-")[2]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks.write.bucketBy(buckets, "digest").option("path", path).option("compression", "none").saveAsTable(name)
    return spark.table(name)


def chunk_lists(keyed: DataFrame) -> DataFrame:
    """``key, n_bytes, header, chunks, place, digest``: the ordered chunks of each distinct text."""
    return keyed.transform(in_batches, _listed, "key binary, n_bytes long, header binary, chunks long, place long, digest binary").dropDuplicates(["key", "place"])


def read_media(lists: DataFrame, store: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """Put the media of the lists together from the store, verify them and compute features.

    Media of one chunk are read where the chunk is; only those of more are dealt
    out again, by key. A chunk of very many references meets its lists in SALTS
    places.
    """
    columns = ["key", "n_bytes", "header", "chunks", "place", "digest", "data"]
    cold = lists.join(store.where(F.col("refs") <= HOT), "digest").select(*columns)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    hot = lists.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(store.where(F.col("refs") > HOT).withColumn("salt", salts), ["digest", "salt"]).select(*columns)
    found = cold.union(hot)
    single = found.where("chunks = 1").transform(in_batches, _read(dictionary), READ_DDL)
    several = found.where("chunks > 1").repartition("key").sortWithinPartitions("key", "place").transform(in_batches, _read(dictionary), READ_DDL)
    return single.union(several)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.

    A payload is the text in UTF-8 (null: empty) with bytes 0 up to a positive
    multiple of 64; its stored form is a wave file of 8-bit mono samples. Payloads
    are cut into chunks where a rolling gear hash says so, so that equal passages
    of over about MOST bytes give equal chunks wherever they stand. Chunks of one
    digest are stored once; each payload is an ordered list of digests. Store and
    lists are written to the shared folder and read back from there; all values are
    computed from the bytes read back, once per distinct text; so equal texts
    have equal values. Rows that repeat an id stay; other columns are ignored; an
    empty table gives an empty result.
    """
    docs = id_and_text(df, id_col, text_col).withColumn("key", F.unhex(F.sha2("text", 256)))
    keyed = docs.select("key", "text")
    dictionary = dictionary_of(keyed)
    values = read_media(settle(chunk_lists(keyed), "lists"), chunk_store(keyed, dictionary), dictionary)
    return docs.select("doc_id", "key").join(values, "key").drop("key")
