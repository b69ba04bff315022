"""Jaccard join of documents on sets of word n-grams by PartEnum signatures: exact, no pair is missed by chance.

Sets that are alike differ in few shingles: with a threshold of P percent and a smaller set of s shingles, in
(100 - P) * s / P at most. Sizes are cut into bands such that a set's partners lie in its own band or the next one;
each band b has a bound k of the differences of its pairs (both in b, or one in b and one in b + 1). The domain of
shingles is dealt by a hash to n1 * n2 parts, n1 groups of n2. In some group two such sets differ in at most k2
shingles, k2 = k / n1 rounded down, and so agree on some n2 - k2 parts of it. A signature is a hash of what a set has
in one subset of n2 - k2 parts of a group; all subsets are enumerated, so linked sets share a signature.

A signature of an empty projection says nothing and would be shared by many. There are `slack` groups more than
needed; a set with no more than `slack` empty projections leaves them out, and still shares another one with each
partner. The few sets with more of them go through a second, third and fourth dealing of the domain, in which only such sets
meet, and the last of which keeps the empty ones.

Signatures outnumber documents by far, so they are sorted where they are made: one that many sets of a chunk have
is known to be shared; of the others an entry of 12 bytes goes to the part of its key, where those without
company are dropped. A signature that very many sets have is a few entries a chunk there, and never a group in memory.
What is shared becomes components like this: stars (each component's likeliest member against one leader of a
signature), confirmed on full sets, then the pairs across components that sizes and parity bits allow.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, digests, list_array, map_chunks, materialize, mix, shingle_sets, text_bytes
from .components import connected_components
from .minhash import confirm, texts_of

#: Dealings of the domain for sets with many empty projections.
LEVELS = 4
#: Bytes of text whose signatures are sorted at once, and signatures that one part of the keys has on average.
CHUNK, PART = 8 << 20, 2_000_000
#: Bits of a key and of a node that travel: chance agreements of either make a candidate more, never a link.
LOW = np.uint64((1 << 48) - 1)
#: Longs of parity bits that a set carries: two sets' bits differ in no more places than the sets differ in shingles.
ODD_LONGS = 16
#: Sets of a chunk that are named one by one where a key belongs.
LOCAL = 16
#: Nodes of a signature that are compared with each other, or with as many others, in one group.
BLOCK = 1000
MARK = (1 << 48) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=8)
def band_starts(percent: int, most: int = 1 << 32) -> np.ndarray:
    """Smallest sizes of the bands: all partners of a set lie in its band or a neighbouring one."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(100 * starts[-1] // percent + 1)
    return np.array(starts, np.int64)


def scheme(k: int) -> tuple[int, int, int, int]:
    """n1, n2, k2 and slack for sets that differ in at most k shingles: four to seven shingles a projection."""
    if k <= 3:
        return 1, 6, k, 0
    if k < 16:
        return k // 3 + 1, 5, 2, 0
    slack = k // 12
    return k // 2 + 1 + slack, 3, 1, slack


def signatures(flat: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and which set each is of. flat: distinct shingles of the sets, at: offsets of the sets in it."""
    size = np.diff(at)
    starts = band_starts(percent)
    band = np.searchsorted(starts, size, "right") - 1
    keys, sets = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    weight = mix(flat + np.uint64(1))
    low, high = (weight & np.uint64(0xFFFFFFFF)).astype(float), (weight >> np.uint64(32)).astype(float)
    for b in np.unique(np.concatenate((band, band - 1))):
        k = (100 - percent) * int(starts[b + 1] - 1) // percent if b >= 0 else 0
        if k == 0:  # equal sets alone
            continue
        n1, n2, k2, slack = scheme(k)
        rows = np.flatnonzero((band == b) | (band == b + 1))
        for level in range(LEVELS):
            if not len(rows):
                break
            n = size[rows]
            own = np.repeat(np.arange(len(rows)), n)
            take = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[rows], n)
            salt = mix(np.array([int(b) * LEVELS + level], np.uint64) + np.uint64(77))[0]
            place = own * (n1 * n2) + ((mix(flat[take] ^ salt) >> np.uint64(11)) % np.uint64(n1 * n2)).astype(np.int64)
            total = len(rows) * n1 * n2
            part = np.bincount(place, low[take], total).astype(np.uint64) + np.bincount(place, high[take], total).astype(np.uint64) * _ODD
            part, full = part.reshape(-1, n1, n2), np.bincount(place, minlength=total).reshape(-1, n1, n2) > 0
            empty = np.zeros(len(rows), np.int64)
            for nth, kept in enumerate(combinations(range(n2), n2 - k2)):
                label = mix(salt + np.arange(n1, dtype=np.uint64) * _ODD + np.uint64(nth))
                some = full[:, :, kept].any(axis=2)
                empty += n1 - some.sum(axis=1)
                row, _ = there = np.nonzero(some if level < LEVELS - 1 else np.ones_like(some))
                keys.append(mix(part[:, :, kept].sum(axis=2, dtype=np.uint64) + label)[there])
                sets.append(rows[row])
            rows = rows[empty > slack]
    return np.concatenate(keys), np.concatenate(sets)


def _home(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key; it rises with the key."""
    return ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _final(low: np.ndarray, home: np.ndarray) -> np.ndarray:
    return mix(low + home.astype(np.uint64) * _ODD).view(np.int64)


def _blobs(values: np.ndarray, width: int, cuts: np.ndarray) -> pa.Array:
    """The low bytes of values as binary, from cut to cut."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(raw)])


def _read(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8")[:, 0]


def _nodes48(nodes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(nodes), ">u8")[::2].astype(np.uint64) >> np.uint64(16)


def shared_signatures(docs: DataFrame, shingle: int, percent: int, parts: int) -> DataFrame:
    """key, low: signatures that several sets have, with the low bits of each such set's node (a row may come twice)."""

    def make(batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column(0))
        sets = [s for s in shingle_sets(data, offsets, shingle, SPACE_WORDS) if len(s)]
        if not sets:
            return
        nodes, first = np.unique(_nodes48(digests(sets)), return_index=True)
        sets = [sets[i] for i in first]
        keys, owner = signatures(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))), percent)
        order = np.argsort(keys)
        keys, nodes = keys[order], nodes[owner[order]]
        again = np.zeros(len(keys), bool)
        again[1:] = keys[1:] == keys[:-1]
        group = np.cumsum(~again) - 1
        several = (np.bincount(group) > LOCAL)[group] if len(keys) else again
        home = _home(keys, parts)
        # a signature that many sets of this chunk have leaves a mark where its key belongs
        sent = ~(again & several)
        what = np.where(several, np.uint64(MARK), nodes)[sent]
        cuts = np.searchsorted(home[sent], np.arange(parts + 1))
        filled = np.flatnonzero(np.diff(cuts))
        cuts = np.append(cuts[filled], cuts[-1])
        names = ["part", "known", "keys", "nodes"]
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(np.zeros(len(filled), bool)), _blobs(keys[sent], 6, cuts), _blobs(what, 6, cuts)], names)
        if several.any():
            cuts = np.array([0, several.sum()])
            yield pa.RecordBatch.from_arrays([pa.array([int(nodes[0]) % parts], pa.int64()), pa.array([True]), _blobs(_final(keys[several] & LOW, home[several]).view(np.uint64), 8, cuts), _blobs(nodes[several], 6, cuts)], names)

    def found(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes.astype(np.int64))], ["key", "low"])

    def settle(part: int, keys: list[bytes], nodes: list[bytes]):
        key, node = _read(b"".join(keys), 6), _read(b"".join(nodes), 6)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, node[1:] != node[:-1])
        key, node, starts = key[new], node[new], np.flatnonzero(new_key[new])
        many = np.diff(np.append(starts, len(key)))
        marked = np.zeros(len(key), np.int64)
        marked[node == MARK] = 1
        marked = np.add.reduceat(marked, starts) > 0
        # sets that share one signature mostly share many: what the same sets share counts once, under a name of these sets
        name = np.where(marked, _final(key[starts], np.full(len(starts), part)), mix(np.add.reduceat(mix(node), starts) + many.astype(np.uint64)).view(np.int64))
        kept = many > 1
        once = np.zeros(len(starts), bool)
        once[np.flatnonzero(kept)[np.unique(name[kept], return_index=True)[1]]] = True
        rows = np.repeat(once, many) & (node != MARK)
        name, node = np.repeat(name, many)[rows], node[rows]
        for i in range(0, len(node), 100_000):
            yield found(name[i : i + 100_000], node[i : i + 100_000])

    def pick(batches):
        now, keys, nodes = None, [], []
        for batch in batches:
            for part, known, key, node in zip(*(batch.column(i) for i in range(4))):
                if known.as_py():
                    yield found(_read(key.as_py(), 8).view(np.int64), _read(node.as_py(), 6))
                    continue
                if part.as_py() != now:
                    if keys:
                        yield from settle(now, keys, nodes)
                    now, keys, nodes = part.as_py(), [], []
                keys.append(key.as_py())
                nodes.append(node.as_py())
        if keys:
            yield from settle(now, keys, nodes)

    made = map_chunks(docs.select("text"), make, "part long, known boolean, keys binary, nodes binary", limit=CHUNK)
    return made.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(pick, "key long, low long")


def parities(shingles: np.ndarray) -> np.ndarray:
    places = (mix(shingles + np.uint64(1)) & np.uint64(ODD_LONGS * 64 - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=ODD_LONGS * 64) & 1).astype(bool)).view(np.int64)


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, node (a digest of the set; null if it is empty), low (bits of the node), odd (parity bits)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch):
        sets = shingle_sets(*text_bytes(batch.column(1)), shingle, SPACE_WORDS)
        nodes = digests(sets)
        some = np.array([len(s) > 0 for s in sets], bool)
        low = _nodes48(nodes).astype(np.int64)
        odd = list_array(np.array([parities(s) for s in sets], np.int64).reshape(-1, ODD_LONGS), ODD_LONGS, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x if s else None for x, s in zip(nodes, some)], pa.binary()), pa.array(low, mask=~some), odd], ["doc_id", "n_shingles", "node", "low", "odd"])

    return map_chunks(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_shingles long, node binary, low long, odd array<long>")


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, stars: int = 3, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs.

    docs: doc_id, text; more columns are ignored. Words are runs of anything but ASCII white space, A-Z lower-cased; a
    text's set holds its distinct shingles of `shingle` words, a shorter text being one shingle. Texts are linked if
    100 * intersection >= percent * union; component_id is the smallest doc_id that links reach. A null, empty or
    wordless text has no shingles and is its own component. Repeated doc_ids give a row each; a null doc_id keeps null
    unless it is linked with others. No rows: no rows. percent is from 1 to 100.
    """
    all_rows = materialize(sets_of(docs, shingle))
    classes = materialize(all_rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("low").alias("low"), F.first("odd").alias("odd")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // part + 1)
    found = materialize(shared_signatures(docs, shingle, percent, parts))
    buckets = materialize(found.join(classes.select("low", "node"), "low").select("key", "node").distinct())
    labels = _components(buckets, classes, docs, shingle, percent, stars)
    named = classes.join(labels, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_node = named.join(least, "comp").select("node", "component_id")
    out = all_rows.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _components(buckets: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int, stars: int) -> DataFrame:
    """node, comp of every node that shares a signature (buckets: key, node)."""
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size"))
    score = buckets.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("score"))
    open_nodes = materialize(score.join(classes.select("node", "rep", "n", "odd"), "node"))
    labels = open_nodes.select("node", F.col("node").alias("comp"))
    like = _alike(percent)

    def side(k: str) -> DataFrame:
        return open_nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("odd").alias(f"o{k}"))

    left = materialize(buckets.join(open_nodes.select("node", "score"), "node"))
    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that are linked by their full sets; texts are read anew, those of the pairs alone."""
        needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        reps = materialize(needed.join(open_nodes.select("node", "rep"), "node"))
        found = texts_of(docs, reps.select("rep"), shingle).select("node", "text")
        return materialize(confirm(pairs, found.join(reps.select("node"), "node", "left_semi").dropDuplicates(["node"]), shingle, percent))

    for turn in range(stars):
        # the first leader of a signature is the node with most neighbours, which is near the middle of its group
        order = F.col("score") if turn == 0 else F.xxhash64("node", F.lit(turn))
        inside = left.join(labels, "node")
        lead = inside.groupBy("key").agg(F.max(F.struct(order.alias("order"), "node", "comp")).alias("l"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key", F.col("l.node").alias("b"), F.col("l.comp").alias("cb"))
        # signatures whose nodes have become one component are done with
        mixed = materialize(inside.join(lead, "key"))
        star = mixed.where("comp <> cb").groupBy(F.col("node").alias("a"), "b", F.col("comp").alias("ca")).agg(F.count("*").alias("shared"))
        pairs = star.groupBy("ca").agg(F.max(F.struct("shared", F.xxhash64("a", "b"), "a", "b")).alias("p")).select("p.a", "p.b")
        best = materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(like).select("a", "b"))
        left = mixed.select("key", "node", "score")
        if not best.isEmpty():
            labels = connected_components(labels, confirmed(best))
    rest = materialize(_across(left, labels, open_nodes, percent))
    return labels if rest.isEmpty() else connected_components(labels, confirmed(rest))


def _across(buckets: DataFrame, labels: DataFrame, open_nodes: DataFrame, percent: int) -> DataFrame:
    """a, b of all pairs of a signature whose components differ and which may be linked by their sizes and parity bits.

    The nodes of a signature are dealt to blocks, and each pair of blocks is a group of its own, so that one with very
    many nodes is many groups of bounded size; a group's pairs are compared as matrices.
    """
    inside = buckets.join(labels, "node")
    mixed = inside.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("low <> high").select("key", "blocks")
    inside = inside.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    inside = inside.select("key", "node", "comp", "own", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    groups = inside.join(open_nodes.select("node", "n", "odd"), "node").select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "n", "odd")
    groups = groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own")

    def pairs(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        i, j, own, n = (t.column(c).to_numpy() for c in (1, 2, 3, 6))
        node, comp = t.column(4).to_pylist(), np.unique(np.array(t.column(5).to_pylist(), object), return_inverse=True)[1]
        odd = t.column(7).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, ODD_LONGS)
        # of two blocks the first against the second, of one block each node against those after it
        left, first = (np.flatnonzero(own == i), np.flatnonzero(own == j)[0]) if i[0] != j[0] else (np.arange(len(n)), 0)
        found = []
        for at in (left[k : k + 32] for k in range(0, len(left), 32)):
            total = n[at, None] + n[None, first:]
            likely = (comp[at, None] != comp[None, first:]) & (100 * np.minimum(n[at, None], n[None, first:]) >= percent * np.maximum(n[at, None], n[None, first:]))
            if i[0] == j[0]:
                likely &= at[:, None] < np.arange(len(n))[None, :]
            if likely.any():
                differing = np.bitwise_count(odd[at, None, :] ^ odd[None, first:, :]).sum(axis=2, dtype=np.int64)
                x, y = np.nonzero(likely & ((100 + percent) * differing <= (100 - percent) * total))
                found += [tuple(sorted((node[at[u]], node[first + v]))) for u, v in zip(x, y)]
        return pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.binary()), pa.array([f[0] for f in found], pa.binary())], ["a", "b"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            starts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for a, b in zip(starts[:-1], starts[1:]):
                if a < b:
                    if held and names[a] != now:
                        yield pairs(held)
                        held = []
                    now = names[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield pairs(held)

    return groups.mapInArrow(run, "a binary, b binary").distinct()


def _alike(percent: int) -> Column:
    """What linked sets have: sizes close to each other, and parity bits that differ in no more places than they may in shingles."""
    differing = " + ".join(f"bit_count(oa[{i}] ^ ob[{i}])" for i in range(ODD_LONGS))
    return F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND {100 + percent} * ({differing}) <= {100 - percent} * (na + nb)")
