"""Helpers that the text operators share: written stages, byte views of Arrow text, word hashes."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of text that one numpy pass holds (a single longer text is its own pass).
CHUNK_BYTES = 1 << 20
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits of a map of hashed values (4 MB), and bytes of one of Spark's bitmap buckets.
MAP_BITS, BUCKET_BYTES = 1 << 25, 4096
#: Words of up to so many bytes are hashed eight bytes at a time in numpy, longer ones by blake2b.
WORD_BYTES = 64


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or _own_dir()


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and the n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    if len(offsets) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def map_chunks(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str, text: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow in which fn gets batches of about limit bytes of text."""

    def run(batches):
        for batch in batches:
            _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            for i, j in row_slices(offsets, limit):
                out = fn(batch.slice(i, j - i))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    lut = np.zeros(256, bool)
    for a, b in ranges:
        lut[a : b + 1] = True
    return lut


#: Words of the near-duplicate contract: everything but ASCII white space.
SPACE_WORDS = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Words of the decontamination contract: ASCII letters and digits and all bytes of non-ASCII characters.
LETTER_WORDS = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte and end byte of each word (A-Z lower-cased), and per text the offsets into them."""
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    inside = is_word[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    before[edge[:n]] = False
    after = np.concatenate((inside[1:], [False]))
    after[edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return _spans_hashed(low, starts, ends), starts, ends, np.searchsorted(starts, offsets)


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _spans_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes: blocks of eight bytes through a mix that is not linear, the length with them."""
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    length = ends - starts
    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = np.arange(len(starts))
    for at in range(0, WORD_BYTES, 8):
        if at:
            rows = rows[length[rows] > at]
        if not len(rows):
            break
        block = eights[starts[rows] + at].view(np.uint64)[:, 0] & _KEEP[np.minimum(length[rows] - at, 8)]
        h[rows] = mix((h[rows] ^ block) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(at + 1))
    for i in np.flatnonzero(length > WORD_BYTES):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[j : j + n]
    return mix(h)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, is_word: np.ndarray = SPACE_WORDS) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, one without words none."""
    words, _, _, at = word_hashes(data, offsets, is_word)
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], int(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def list_array(values: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from a matrix with width columns."""
    rows = len(values) // width if values.ndim == 1 else len(values)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))


def digests(parts: Iterable[np.ndarray]) -> list[bytes]:
    """128 bits that tell arrays apart."""
    return [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in parts]


def map_place(value: Column) -> Column:
    """The place of a value in a map of MAP_BITS bits; positions count from 1."""
    return F.pmod(F.xxhash64(value), F.lit(MAP_BITS)) + 1


def hashed_map(places: DataFrame) -> Broadcast:
    """A bit for each place in the one column of places, on all executors: MAP_BITS bits whatever their number.

    It only leaves out rows early; who uses it joins the values themselves afterwards.
    """
    parts = places.toDF("p").groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for part in parts:  # at most MAP_BITS / 8 bytes in all
        at = (part["bucket"] - 1) * BUCKET_BYTES
        bits[at : at + BUCKET_BYTES] = np.frombuffer(part["bits"], np.uint8)
    return places.sparkSession.sparkContext.broadcast(bits)


def in_map(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    p = place - 1
    return (bits[p // 8] >> (p % 8).astype(np.uint8) & 1).astype(bool)
