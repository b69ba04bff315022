"""Benchmark decontamination by winnowing.

Of every SPAN consecutive K-word grams the one of the smallest hash is a fingerprint, so a document and an item
that share WINDOW = K + SPAN - 1 words share a fingerprint inside them. Shared fingerprints are joined and the match
is extended word by word to both sides; runs of WINDOW words or more are hits. An item of fewer words is one window
of its own length, found by the hash of all its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER_WORDS, gram_hashes, map_chunks, materialize, text_bytes, word_hashes

K, SPAN = 5, 6
WINDOW = K + SPAN - 1
#: Most bytes of benchmark text that are sent to every executor; beyond, fingerprints are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def fingerprints(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions (in words, ascending) of the fingerprints of texts whose words lie end to end at `at`."""
    grams = gram_hashes(words, K)
    n = len(grams) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    best, where = grams[:n].copy(), np.arange(n)
    for j in range(1, SPAN):
        other = grams[j : j + n]
        less = other <= best
        best[less] = other[less]
        where[less] = np.flatnonzero(less) + j
    inside = np.zeros(n, bool)
    last = at[1:] - WINDOW  # the last window of each text
    mark = np.zeros(n + 1, np.int64)
    full = last >= at[:-1]
    np.add.at(mark, at[:-1][full], 1)
    np.add.at(mark, last[full] + 1, -1)
    inside = np.cumsum(mark[:n]) > 0
    where = np.unique(where[inside])
    return grams[where], where


class Items:
    """Words and fingerprints of benchmark items, for lookup."""

    def __init__(self, ids: list[str], texts: list[str]):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        self.ids = ids
        self.words, _, _, self.at = word_hashes(data, offsets, LETTER_WORDS)
        count = np.diff(self.at)
        fp, pos = fingerprints(self.words, self.at)
        order = np.argsort(fp, kind="stable")
        self.fp, self.pos = fp[order], pos[order]
        self.item = np.searchsorted(self.at, self.pos, "right") - 1
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, WINDOW):
            own = np.flatnonzero(count == size)
            if len(own):
                h = np.array([gram_hashes(self.words[self.at[i] : self.at[i + 1]], size)[0] for i in own])
                order = np.argsort(h, kind="stable")
                self.short[size] = h[order], own[order]

    def hits(self, words: np.ndarray, at: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """By text: the runs of its words (start, end) that match, and the items."""
        found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        seen: dict[tuple[int, int, int], int] = {}
        fp, pos = fingerprints(words, at)
        low, high = np.searchsorted(self.fp, fp, "left"), np.searchsorted(self.fp, fp, "right")
        for i in np.flatnonzero(high > low):
            p = int(pos[i])
            d = int(np.searchsorted(at, p, "right")) - 1
            for k in range(low[i], high[i]):
                item, q = int(self.item[k]), int(self.pos[k])
                if seen.get((d, item, p - q), -1) >= p + K:
                    continue
                back = min(p - at[d], q - self.at[item])
                same = words[p - back : p][::-1] == self.words[q - back : q][::-1]
                left = back if same.all() else int(np.argmin(same))
                ahead = min(at[d + 1] - p, self.at[item + 1] - q)
                same = words[p : p + ahead] == self.words[q : q + ahead]
                right = ahead if same.all() else int(np.argmin(same))
                seen[d, item, p - q] = p + max(int(right), K)
                if left + right >= WINDOW:
                    runs, items = found.setdefault(d, ([], set()))
                    runs.append((int(p - left - at[d]), int(p + right - at[d])))
                    items.add(item)
        for size, (h, own) in self.short.items():
            grams = gram_hashes(words, size)
            low, high = np.searchsorted(h, grams, "left"), np.searchsorted(h, grams, "right")
            for p in np.flatnonzero(high > low):
                d = int(np.searchsorted(at, p, "right")) - 1
                if p + size <= at[d + 1]:
                    runs, items = found.setdefault(d, ([], set()))
                    runs.append((int(p - at[d]), int(p + size - at[d])))
                    items.update(int(x) for x in own[low[p] : high[p]])
        return found


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs without overlaps, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _as_spans(runs) -> list[dict]:
    return [{"start": a, "end": b} for a, b in joined(runs)]


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, hits (runs of word numbers), items (sorted ids as strings): one row for each row of docs.

    docs: doc_id, text; benchmark: item_id, text; more columns are ignored. Null or empty texts have no words, and
    benchmark rows without an id or words match nothing. Repeated docs give a row each; items with the same id count
    once. The benchmark goes to the executors if its texts are at most broadcast_bytes; else by shuffled joins.
    """
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("item_text")).where("item_id IS NOT NULL AND item_text IS NOT NULL")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    if total > broadcast_bytes:
        return _by_shuffle(docs, bench)
    rows = bench.collect()
    index = docs.sparkSession.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows]))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        words, _, _, at = word_hashes(data, offsets, LETTER_WORDS)
        found = index.value.hits(words, at)
        none = ((), ())
        hits = [_as_spans(found.get(i, none)[0]) for i in range(batch.num_rows)]
        items = [sorted({index.value.ids[x] for x in found.get(i, none)[1]}) for i in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(hits, _SPANS), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "hits", "items"])

    return map_chunks(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, hits {SPANS}, items array<string>")


def _fingerprint_rows(df: DataFrame, key: str, kind: str, sizes: list[int]) -> DataFrame:
    """key, fp: a row for each distinct fingerprint of df's texts, and for each gram of a size of a short item."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        words, _, _, at = word_hashes(data, offsets, LETTER_WORDS)
        all_fp, pos = fingerprints(words, at)
        rows, out = [np.searchsorted(at, pos, "right") - 1], [all_fp]
        for size in sizes:
            grams = gram_hashes(words, size)
            d = np.searchsorted(at, np.arange(len(grams)), "right") - 1
            inside = np.arange(len(grams)) + size <= at[d + 1]
            rows.append(d[inside])
            out.append(grams[inside])
        both = np.unique(np.rec.fromarrays([np.concatenate(rows).astype(np.int64), np.concatenate(out)], names="r,f"))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(both.r)), pa.array(both.f.view(np.int64))], [key, "fp"])

    return map_chunks(df, run, f"{key} {kind}, fp long")


def _by_shuffle(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """contamination() for a benchmark of any size: distinct texts and items that share a fingerprint meet as pairs."""
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("tkey"), F.coalesce("text", F.lit("")).alias("text"))
    texts = materialize(keyed.select("tkey", "text").dropDuplicates(["tkey"]))
    bench = bench.dropDuplicates().withColumn("ikey", F.sha2(F.concat_ws("\x00", "item_id", "item_text"), 256))
    counts = map_chunks(bench.select("ikey", F.col("item_text").alias("text")), _word_counts, "ikey string, n long")
    sizes = sorted(r[0] for r in counts.where(f"n > 0 AND n < {WINDOW}").select("n").distinct().collect())
    left = _fingerprint_rows(texts.select("tkey", "text"), "tkey", "string", sizes)
    right = _fingerprint_rows(bench.select("ikey", F.col("item_text").alias("text")), "ikey", "string", sizes)
    pairs = left.join(right, "fp").select("tkey", "ikey").distinct()
    rows = pairs.join(bench, "ikey").join(texts, "tkey").select("tkey", "item_id", "item_text", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(3))
        out = []
        for i, (tkey, item, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            words, _, _, at = word_hashes(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), LETTER_WORDS)
            if found := Items([item], [text]).hits(words, at):
                out.append((tkey, item, _as_spans(found[0][0])))
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], _SPANS)], ["tkey", "item_id", "hits"])

    found = map_chunks(rows, run, f"tkey string, item_id string, hits {SPANS}")
    per_text = found.groupBy("tkey").agg(F.sort_array(F.flatten(F.collect_set("hits"))).alias("hits"), F.sort_array(F.collect_set("item_id")).alias("items"))
    joined_up = texts.join(per_text, "tkey", "left")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        at = word_hashes(data, offsets, LETTER_WORDS)[3]
        hits = [_as_spans((x["start"], x["end"]) for x in h or ()) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(hits, _SPANS), pa.array([x or [] for x in batch.column(3).to_pylist()], pa.list_(pa.string()))], ["tkey", "n_words", "hits", "items"])

    counted = map_chunks(joined_up.select("tkey", "text", "hits", "items"), count, f"tkey string, n_words long, hits {SPANS}, items array<string>")
    return keyed.select("doc_id", "tkey").join(counted, "tkey").select(F.col("doc_id").cast(kind), "n_words", "hits", "items")


def _word_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column(1))
    at = word_hashes(data, offsets, LETTER_WORDS)[3]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64())], ["ikey", "n"])
