"""Exact repeated substrings by column-wise construction of a multi-string Burrows-Wheeler transform.

Two equal strings of LENGTH bytes have the same minimiser (smallest hash of their GRAM-byte grams, the leftmost
on ties) at the same place, so the work is split by minimiser: each maximal run of starts with one minimiser is cut
out as one short string, and only strings of minimisers that occur at least twice are kept. All strings of a minimiser
meet in one task, aligned at it. There, the transform is built column by column from the right: each round puts
one more symbol in front of every string, sorts the strings stably by it, and brings the common prefixes of
neighbours along (one more than the smallest between them in the round before; zero where the symbols differ).
A string whose prefix in common with a neighbour reaches LENGTH starts a repeated substring in that column.

In general such a transform merges the suffixes of all columns; aligned at the minimiser, equal substrings lie in
the same column, so each column's order is kept by itself and the merge of columns is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, map_chunks, materialize, mix, text_bytes

GRAM = 40
#: Strings of one minimiser that meet in a task; a minimiser with more is settled by counts of whole substrings.
HOT = 20_000
#: Bytes that one search for minimisers holds at most; longer texts are searched in parts that overlap.
PART, PLACES = 4 << 20, 1 << 24
#: Strings for which one transform is built.
BLOCK = 4_000
STRINGS = "mini long, rid long, start long, pivot int, text binary"


BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i up to n."""
    size = max(CHUNK_BYTES, n) + 1
    if size not in _powers:
        up, down = np.full(size, BASE, np.uint64), np.full(size, BASE_INV, np.uint64)
        up[0] = down[0] = 1
        got = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size > CHUNK_BYTES + 1:
            return got
        _powers[size] = got
    return _powers[size]


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the width bytes from each position on, for all positions that have as many."""
    h = data.astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    size, factor = 1, 0x9E3779B97F4A7C15
    while True:
        if width & size:
            if out is None:
                out = h
            else:
                n = len(data) - done - size + 1
                out = out[:n] * np.uint64(factor) + h[done : done + n]
            done += size
        if done == width:
            return mix(out)
        n = len(h) - size
        if n <= 0:
            return np.empty(0, np.uint64)
        h = h[:n] * np.uint64(factor) + h[size : size + n]
        size *= 2
        factor = factor * factor % (1 << 64)


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of starts of length-byte strings with one minimiser: hash, text, first start, number, minimiser's place."""
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    span = length - GRAM + 1
    grams = window_hashes(data, GRAM)
    n = len(grams) - span + 1
    if n <= 0:
        return none
    # hash in the high bits, place in the low: the smallest is the leftmost of the smallest hashes
    best = grams & ~np.uint64(PLACES - 1) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: n], best[span - width : span - width + n])
    place = (best[:n] & np.uint64(PLACES - 1)).astype(np.int64)
    last = offsets[1:] - length
    full = last >= offsets[:-1]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, offsets[:-1][full], 1)
    np.add.at(mark, last[full] + 1, -1)
    inside = np.cumsum(mark[:n]) > 0
    place[~inside] = -1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    edge = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    number = np.diff(np.concatenate((edge, [n])))
    own = place[edge] >= 0
    edge, number = edge[own], number[own]
    at = place[edge]
    row = text[edge]
    return grams[at].view(np.int64), row, edge - offsets[row], number, at - offsets[row]


def range_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of bytes."""
    up, down = powers(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def repeated_starts(group: np.ndarray, strings: list[np.ndarray], pivots: np.ndarray, length: int) -> list[np.ndarray]:
    """Per string the columns (places from its start) at which a length-byte string starts that another place has too."""
    m = len(strings)
    size = np.array([len(s) for s in strings])
    left, right = int(pivots.max()), int((size - pivots).max())
    # symbols plus one, strings aligned at their pivots; zero where a string has none
    table = np.zeros((left + right, m), np.uint16)
    for i, s in enumerate(strings):
        table[left - pivots[i] : left - pivots[i] + size[i], i] = s
    wide = table
    order = np.argsort(group, kind="stable")
    common = np.zeros(m, np.int32)  # of each string with the one before it in the order
    found: list[list[int]] = [[] for _ in range(m)]
    for column in range(left + right - 1, -1, -1):
        symbols = wide[column][order]
        by = np.argsort(symbols, kind="stable")
        symbols = symbols[by]
        same = np.concatenate(([False], (symbols[1:] == symbols[:-1]) & (symbols[1:] > 0)))
        fresh = np.zeros(m, np.int32)
        at = np.flatnonzero(same)
        if len(at):
            # smallest common prefix between two strings of a symbol in the order before
            cuts = np.empty(2 * len(at), np.int64)
            cuts[0::2], cuts[1::2] = by[at - 1] + 1, by[at] + 1
            fresh[at] = np.minimum.reduceat(np.append(common, 0), cuts)[0::2] + 1
        order, common = order[by], fresh
        hit = common >= length
        if hit.any():
            hit[:-1] |= hit[1:]
            for i in order[hit]:
                found[i].append(column)
    return [np.array(f[::-1], np.int64) - left + pivots[i] if f else np.empty(0, np.int64) for i, f in enumerate(found)]


def _consecutive(values: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, number) of ascending whole numbers."""
    if not len(values):
        return []
    edge = np.flatnonzero(np.concatenate(([True], np.diff(values) != 1)))
    return list(zip(values[edge].tolist(), np.diff(np.concatenate((edge, [len(values)]))).tolist()))


def _found_batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rid", "start", "number"])


def _transform(length: int):
    def run(batches):
        held, group = [], []

        def settle(rows):
            strings = [np.frombuffer(r[4], np.uint8).astype(np.uint16) + np.uint16(1) for r in rows]
            starts = repeated_starts(np.array([r[0] for r in rows]), strings, np.array([r[3] for r in rows]), length)
            return _found_batch([(r[1], r[2] + first, number) for r, s in zip(rows, starts) for first, number in _consecutive(s)])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[-1][0] != row[0]:
                    if len(group) > 1:
                        held += group
                    group = []
                    if len(held) >= BLOCK:
                        yield settle(held)
                        held = []
                group.append(row)
        if len(group) > 1:
            held += group
        if held:
            yield settle(held)

    return run


def _by_counts(strings: DataFrame, length: int) -> DataFrame:
    """rid, start, number of repeated starts, from counts of all length-byte substrings of strings (by 128 bits of hash)."""

    def every(batches):
        for batch in batches:
            for rid, start, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4))):
                data = np.frombuffer(text, np.uint8)
                a = window_hashes(data, length)
                b = window_hashes(255 - data, length)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), rid)), pa.array(start + np.arange(len(a)))], ["a", "b", "rid", "start"])

    places = materialize(strings.mapInArrow(every, "a long, b long, rid long, start long"))
    again = places.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    return places.join(again, ["a", "b"], "left_semi").select("rid", "start", F.lit(1).cast("long").alias("number"))


def repeated_substrings(docs: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (of bytes): one row for each row of docs.

    docs: doc_id, text; more columns are ignored. A byte is covered if a length-byte string over it also starts at
    another place of any text; spans are the maximal covered runs, kept_sha256 is of the other bytes. A null text is
    empty. Copies of a text, repeated rows included, are covered whole if they have length bytes. A null doc_id stays
    null. Texts are told apart by 60 bits of their SHA-256. hot: strings of a minimiser beyond which they are settled
    by counts of substrings in place of the transform, so that no task must hold them all.
    """
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("sha", F.sha2("text", 256))
    keyed = keyed.withColumn("rid", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")).withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    every = materialize(keyed.select("doc_id", "id", "rid", "sha", F.octet_length("text").cast("long").alias("n_bytes")))
    classes = every.groupBy("rid").agg(F.min("id").alias("id"), F.count("*").alias("copies"))

    def minimisers(batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column(1))
        rid = batch.column(0).to_numpy()
        # within a batch, a copy's runs add nothing
        fresh = np.zeros(len(rid), bool)
        fresh[np.unique(rid, return_index=True)[1]] = True
        for s in range(0, max(len(data), 1), PART):
            part, own = (data, offsets) if len(rid) > 1 else (data[s : s + PART + length - 1], np.array([0, min(len(data) - s, PART + length - 1)]))
            mini, row, first, number, pivot = runs(part, own, length)
            keep = fresh[row]
            mini, row, first, number, pivot = (x[keep] for x in (mini, row, first, number, pivot))
            begin = own[row] + first
            content = range_hashes(part, begin, begin + number - 1 + length)
            _, one, back, count = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
            # strings that are the same in a batch repeat each other: they are settled here, and one of each goes on
            again, lead = count[back] > 1, np.zeros(len(content), bool)
            lead[one] = True
            edge = np.flatnonzero(again & ~(np.concatenate(([False], again[:-1])) & np.concatenate(([False], begin[1:] == (begin + number)[:-1])) & np.concatenate(([False], row[1:] == row[:-1]))))
            settled = np.add.reduceat(np.where(again, number, 0), edge) if len(edge) else edge
            yield _cut_batch(mini[lead], rid[row[lead]], first[lead] + s, number[lead], (pivot - first)[lead], False)
            yield _cut_batch(mini[edge], rid[row[edge]], first[edge] + s, settled, np.zeros(len(edge), np.int64), True)

    cut = materialize(map_chunks(keyed.where(F.octet_length("text") >= length).select("rid", "text"), minimisers, "mini long, rid long, start int, number int, delta int, settled boolean"))
    place = F.xxhash64("rid", "start")
    counts = cut.where("NOT settled").groupBy("mini").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n")).where("low <> high").select("mini", (F.col("n") > hot).alias("hot"))
    again = cut.where("NOT settled").join(counts, "mini").select("rid", F.struct("mini", "start", "number", "delta", "hot").alias("run"))
    nothing = F.lit(None).cast(again.schema["run"].dataType)
    again = again.union(cut.where("settled").select("rid", nothing.alias("run")).distinct())  # a text may have settled spans alone
    per_text = again.groupBy("rid").agg(F.collect_set("run").alias("runs")).join(classes.select("rid", "id"), "rid")
    texts = materialize(keyed.select("id", "rid", "text").join(per_text, ["id", "rid"]).dropDuplicates(["id", "rid"]))

    def strings(batch: pa.RecordBatch):
        out = []
        for rid, body, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
            body = body.encode()
            for r in own:
                out.append((r["mini"], rid, r["start"], r["delta"], body[r["start"] : r["start"] + r["number"] - 1 + length], r["hot"]))
            if len(out) > 20_000:
                yield _strings_batch(out)
                out = []
        yield _strings_batch(out)

    pieces = map_chunks(texts.select("rid", "text", "runs"), strings, f"{STRINGS}, hot boolean")
    names = [c.split()[0] for c in STRINGS.split(", ")]
    cold = pieces.where("NOT hot").select(names)
    found = cold.repartition("mini").sortWithinPartitions("mini").mapInArrow(_transform(length), "rid long, start long, number long")
    if not counts.where("hot").isEmpty():
        found = found.union(_by_counts(pieces.where("hot").select(names), length))
    settled = cut.where("settled").select("rid", F.col("start").cast("long").alias("start"), F.col("number").cast("long").alias("number"))
    found = found.union(settled.distinct())
    spans = materialize(found.groupBy("rid").agg(F.collect_list(F.struct("start", "number")).alias("found")))

    def cover(batch: pa.RecordBatch) -> pa.RecordBatch:
        import hashlib

        out = []
        for body, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            merged: list[list[int]] = []
            for a, b in sorted((r["start"], r["start"] + r["number"] - 1 + length) for r in own):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            body, at, kept = body.encode(), 0, hashlib.sha256()
            for a, b in merged:
                kept.update(body[at:a])
                at = b
            kept.update(body[at:])
            out.append((sum(b - a for a, b in merged), kept.hexdigest(), [{"start": a, "end": b} for a, b in merged]))
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["rid", "removed", "kept", "spans"])

    span_type = "array<struct<start:bigint,end:bigint>>"
    partial = map_chunks(texts.select("rid", "text").join(spans, "rid"), cover, f"rid long, removed long, kept string, spans {span_type}")
    out = every.join(classes.select("rid", "copies"), "rid").join(partial, "rid", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        F.col("doc_id").cast(kind),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.greatest(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.array().cast(span_type))).alias("spans"),
    )


def _cut_batch(mini, rid, start, number, delta, settled: bool) -> pa.RecordBatch:
    small = [pa.array(x.astype(np.int32)) for x in (start, number, delta)]
    return pa.RecordBatch.from_arrays([pa.array(mini), pa.array(rid), *small, pa.array(np.full(len(mini), settled))], ["mini", "rid", "start", "number", "delta", "settled"])


def _strings_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["mini", "rid", "start", "pivot", "text", "hot"])
