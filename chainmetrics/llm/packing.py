"""Packing along a space-filling curve.

Each document's hashed vector is projected to DIMENSIONS numbers, whose Hilbert index is a sort key: neighbours
along the curve have like vocabularies. Documents are range-sorted by it and laid end to end; sequences are cut
from that line, so only the last one is padded.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_chunks, materialize, mix
from .tokens import Merges

DIMENSIONS, BITS, BUCKETS = 3, 10, 256
#: The bucket that each 16-bit id is hashed to.
BUCKET = (mix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(56)).astype(np.uint8)
PROJECTION = np.random.default_rng(11).normal(size=(BUCKETS, DIMENSIONS))
#: Chunks of ASCII and accented Latin letters: composed already, and lower-cased one by one.
PLAIN = re.compile("[\x00-\x7f\xc0-\u012f\u0131-\u017f]*")
#: Pieces of such text in lower case, as the file's pre-tokenizer splits it.
LATIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xd6\xd8-\xf6\xf8-\u017f]+|[0-9]|[^\x20\x09-\x0d0-9a-z\xc0-\xd6\xd8-\xf6\xf8-\u017f]+")
#: Chunks whose ids a worker keeps; beyond, it starts anew.
KEPT = 600_000
#: Text that is looked up at once: the more, the fewer lookups of the chunks that its documents share.
BATCH_BYTES = 1 << 22


class Ids:
    """Token ids, unsigned 16-bit, of texts cut at spaces and line ends.

    The vocabulary's pre-tokenizer drops white space, so ids of chunks between spaces stand alone and are kept, end to
    end in one array. A batch's distinct chunks are looked up once and its texts gathered from that array. Pieces of
    Latin chunks are merged by the file's ranks, many at once; the library, which is slow on words it has not seen,
    takes the rest. Both give the same ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.merges = Merges(path)
        self.pieces: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        """Start the kept chunks anew: their numbers, and where each one's ids lie."""
        self.numbers: dict[str, int] = {}
        self.flat, self.ends = np.empty(0, "<u2"), np.zeros(1, np.int64)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), end to end, and the n + 1 offsets."""
        if len(self.numbers) > KEPT:
            self.forget()
        if len(self.pieces) > KEPT:
            self.pieces = {}
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn([c for c in chunks if c not in self.numbers])
        number = np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks))[coded.indices.to_numpy()]
        first = self.ends[number]
        size = self.ends[number + 1] - first
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        ids = self.flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
        at = np.asarray(lists.offsets)
        return ids, ends[at - at[0]]

    def learn(self, new: list[str]) -> None:
        """Number new chunks and keep their ids."""
        pieces, found = self.pieces, {}
        plain = [c for c in new if (c.isascii() or PLAIN.fullmatch(c)) and "<|" not in c]
        other = list(set(new).difference(plain))
        split = list(map(LATIN_PIECES.findall, " ".join(plain).lower().split(" "))) if plain else []
        unseen = list({p for own in split for p in own if p not in pieces})
        for i in range(0, len(unseen), 20_000):
            some = unseen[i : i + 20_000]
            size, ids = self.merges.merged([p.encode() for p in some])
            raw, ends = ids.astype("<u2").tobytes(), (2 * np.cumsum(size)).tolist()
            pieces.update((p, raw[a:b]) for p, a, b in zip(some, [0, *ends], ends))
        for c, own in zip(plain, split):
            found[c] = pieces[own[0]] if len(own) == 1 else b"".join([pieces[p] for p in own])
        for i in range(0, len(other), 5_000):
            some = other[i : i + 5_000]
            found.update((c, np.array(e.ids, "<u2").tobytes()) for c, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)))
        self.numbers.update(zip(found, range(len(self.numbers), len(self.numbers) + len(found))))
        size = np.fromiter(map(len, found.values()), np.int64, len(found)) // 2
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(size)))
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(found.values()), "<u2")))


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of points (rows of coordinates below 2 ** bits)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of the curve, from its largest cells down
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hilbert index of each document's hashed token counts, projected and scaled to 2 ** BITS steps a dimension.

    ids: those of all documents, end to end; at: the n + 1 offsets.
    """
    n = len(at) - 1
    place = np.repeat(np.arange(n) * BUCKETS, np.diff(at)) + BUCKET[ids]
    vectors = np.bincount(place, minlength=n * BUCKETS).reshape(n, BUCKETS)
    vectors = np.sqrt(vectors)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    flat = vectors @ PROJECTION / 3.0 + 0.5
    return hilbert(np.clip(flat * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, key, n, ids (16-bit) of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = ids_of(path).of(batch.column(1))
        ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(2 * at), pa.py_buffer(ids)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve_keys(ids, at)), pa.array(np.diff(at)), packed.cast(pa.binary())], ["doc_id", "key", "n", "ids"])

    return map_chunks(docs.select("doc_id", "text"), run, f"doc_id {kind}, key long, n long, ids binary", limit=BATCH_BYTES)


def pack(docs: DataFrame, path: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids.

    docs: doc_id, text; more columns are ignored. Every document is its ids and end_id after them; a null text is
    empty, so it is end_id alone. Documents follow each other along the curve (ties by doc_id's hash) and are cut
    where a sequence of length is full. Every row of docs, repeated or with a null doc_id, is packed once; an
    empty table gives no pieces. Sequences are full but the last.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = materialize(tokenized(docs, path, end_id).withColumn("tie", F.xxhash64("doc_id")))
    line = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "doc_id").select("doc_id", "n", "ids")

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            before = at + np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part)), pa.array(before, pa.int64())], ["doc_id", "n", "ids", "part", "before"])

    line = materialize(line.mapInArrow(number, f"doc_id {kind}, n long, ids binary, part long, before long"))
    totals = line.groupBy("part").agg(F.sum("n").alias("total"))
    # one row a partition of the sort, so a single task and a broadcast hold it
    base = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = line.join(F.broadcast(base), "part").select("doc_id", "n", "ids", (F.col("base") + F.col("before")).alias("at"))

    def cut(batches):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                out, row = [], []
                for i, (n, ids, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                    ids, start = np.frombuffer(ids, "<u2").astype("<u4"), 0
                    while start < n:
                        size = min(n - start, length - (at + start) % length)
                        piece = ids[start : start + size].tobytes()
                        out.append((start, size, zlib.crc32(piece), n, (at + start) // length, (at + start) % length, piece))
                        row.append(i)
                        start += size
                columns = list(zip(*out)) or [()] * 7
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names)

    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
