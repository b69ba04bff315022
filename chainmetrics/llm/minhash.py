"""Near-duplicate documents by b-bit MinHash.

Every distinct shingle set gets PERMUTATIONS minima. Bands of ROWS minima make candidate buckets; BITS bits of
the mixed minima, packed in longs, give a collision-corrected similarity from bit counts, which
drops hopeless candidates; what is left is confirmed on the full sets. A pair at similarity 0.8 shares no
bucket with a chance below 1e-7, and is dropped by the estimate with a chance below 1e-5; both fall fast above.

Equal sets are one class from the start, so copies never meet. Within a bucket, pairs are not expanded:
rounds of stars (each component's likeliest member against one leader) merge what they confirm. Members that
are then still in different components are compared with each other if the shingles that they share with other
components at all are enough for a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, digests, hashed_map, in_map, list_array, map_chunks, map_place, materialize, mix, row_slices, shingle_sets, text_bytes
from .components import connected_components

#: Minima of which low bits are kept; the first of them also make the bands. One bit each says most for its size.
PERMUTATIONS, BITS, BANDS, ROWS = 512, 1, 32, 4
LONGS = PERMUTATIONS * BITS // 64
#: Four and a half standard errors at the threshold of 0.8: sqrt(0.9 * 0.1 / 512) / 0.5 = 0.0265.
ESTIMATE_SLACK = 0.12
_rng = np.random.default_rng(7)
MULTIPLIERS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
ADDENDS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
#: Longs of parity bits, which rule out pairs exactly.
ODD_LONGS = 32
#: Members that one leader's copy serves in a confirming task.
FAN = 500
#: Nodes of a bucket that meet each other without a bound of what they can share.
CROWD = 500
#: Nodes of a component whose shingles one task gathers.
CLASS = 1000


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of PERMUTATIONS minima for each of the sets, none of which is empty."""
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), PERMUTATIONS), np.uint64)
    for p in range(PERMUTATIONS):
        out[:, p] = np.minimum.reduceat(flat * MULTIPLIERS[p] + ADDENDS[p], at)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    bands = low[:, : BANDS * ROWS].reshape(len(low), BANDS, ROWS)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    return key.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum, 64 // BITS to a long.

    The minima are mixed first: as x * M + A with M odd their lowest bit is that of x + A, the same for all functions.
    """
    lanes = (mix(low) & np.uint64((1 << BITS) - 1)).reshape(len(low), LONGS, 64 // BITS)
    return (lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Bits of which each shingle turns one: two sets' bits differ in no more places than the sets differ in shingles."""
    places = (mix(shingles + np.uint64(1)) & np.uint64(ODD_LONGS * 64 - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=ODD_LONGS * 64) & 1).astype(bool)).view(np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, node (of the class of equal sets; null if empty), bands, sig."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column(1))
        sets = shingle_sets(data, offsets, shingle, SPACE_WORDS)
        full = np.flatnonzero([len(s) > 0 for s in sets])
        for rows in (full[i : i + 4096] for i in range(0, len(full), 4096)):
            own = [sets[i] for i in rows]
            node = pa.array(digests(own), pa.binary())
            low = minima(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([len(s) for s in own], pa.int64()), node, list_array(band_keys(low), BANDS, pa.int64()), list_array(packed(low), LONGS, pa.int64())], ["doc_id", "n_shingles", "node", "bands", "sig"])
        bare = np.flatnonzero([len(s) == 0 for s in sets])
        if len(bare):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(bare)), pa.array(np.zeros(len(bare), np.int64)), pa.nulls(len(bare), pa.binary()), pa.nulls(len(bare), pa.list_(pa.int64())), pa.nulls(len(bare), pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "bands", "sig"])

    return map_chunks(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_shingles long, node binary, bands array<long>, sig array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures: bits that differ are counted, chance matches taken out."""
    differing = F.lit(0)
    for i in range(LONGS):
        differing = differing + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    chance = 2.0**-BITS
    return ((1 - differing / PERMUTATIONS) - chance) / (1 - chance)


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes those with 100 * intersection >= percent * union, on full sets. texts: node, text.

    A leader's text is sent once for each FAN of its members, so that a leader with many members is many groups.
    """
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(1 << 20)).alias("h"))
    size = pairs.groupBy("b").agg(F.ceil(F.count("*") / FAN).alias("parts"))
    members = pairs.join(size, "b").select("a", "b", (F.col("h") % F.col("parts")).alias("part"))
    leaders = size.select(F.col("b").alias("a"), "b", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    rows = members.union(leaders).join(texts.select(F.col("node").alias("a"), "text"), "a").select("b", "part", (F.col("a") == F.col("b")).alias("lead"), "a", "text")
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", F.desc("lead"))

    def run(batches):
        leader, own = None, None
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                data, offsets = text_bytes(batch.column(4))
                kept = []
                for b, lead, a, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), shingle_sets(data, offsets, shingle, SPACE_WORDS)):
                    if lead:
                        leader, own = b, s
                    elif b == leader:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(s) - both):
                            kept.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.binary()), pa.array([x[1] for x in kept], pa.binary())], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, stars: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    docs: doc_id, text; more columns are ignored. Texts are linked if their sets of shingle-word shingles have a
    Jaccard similarity of percent / 100 or more; component_id is the smallest doc_id that links reach, kept is
    doc_id = component_id. A null, empty or wordless text has no shingles and is its own component. Repeated
    doc_ids give a row each; a null doc_id keeps null unless it is linked with others, and is never kept.
    stars: rounds of leaders before the likely pairs across components of a bucket are compared.
    """
    all_rows = materialize(signatures(docs, shingle))
    some = all_rows.where("node IS NOT NULL")
    classes = materialize(some.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    spread = classes.select("node", F.explode("bands").alias("key"))
    full = spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = materialize(spread.join(full, "key"))
    labels = connected_components_of(buckets, classes, docs, shingle, percent, stars)
    named = classes.join(labels, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_node = named.join(least, "comp").select("node", "component_id")
    out = all_rows.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def connected_components_of(buckets: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int, stars: int) -> DataFrame:
    """node, comp for every node in a bucket with others. buckets: key, node, size (of the bucket)."""
    score = buckets.groupBy("node").agg(F.sum("size").alias("score"))
    open_nodes = materialize(score.join(classes, "node"))
    texts = materialize(texts_of(docs, open_nodes.select("rep"), shingle).join(open_nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    near = open_nodes.select("node", "n", "sig").join(texts.select("node", "odd"), "node")
    labels = open_nodes.select("node", F.col("node").alias("comp"))
    like = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)") & (estimate("sa", "sb") >= percent / 100 - ESTIMATE_SLACK)
    # sets that are alike differ in (1 - s) / (1 + s) of their sizes at most, and the bits of parity in no more places
    like &= F.expr(f"{100 + percent} * ({' + '.join(f'bit_count(oa[{i}] ^ ob[{i}])' for i in range(ODD_LONGS))}) <= {100 - percent} * (na + nb)")

    def side(k: str) -> DataFrame:
        return near.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"), F.col("odd").alias(f"o{k}"))

    for turn in range(stars):
        # the first leader of a bucket is the node with most neighbours, which is near the middle of its group
        order = F.col("score") if turn == 0 else F.xxhash64("node", F.lit(turn))
        inside = buckets.join(labels, "node").join(open_nodes.select("node", "score"), "node").withColumn("order", order)
        lead = inside.groupBy("key").agg(F.max(F.struct("order", "node", "comp")).alias("l"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key", F.col("l.node").alias("b"), F.col("l.comp").alias("cb"))
        star = inside.join(lead, "key").where("comp <> cb").groupBy(F.col("node").alias("a"), "b", F.col("comp").alias("ca")).agg(F.count("*").alias("shared"))
        # one pair for each component: of its members the one that shares most buckets with a leader
        pairs = star.groupBy("ca").agg(F.max(F.struct("shared", F.xxhash64("a", "b"), "a", "b")).alias("p")).select("p.a", "p.b")
        best = materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(like).select("a", "b"))
        if best.isEmpty():
            continue
        labels = connected_components(labels, materialize(confirm(best, texts, shingle, percent)))
    rest = materialize(_across(buckets, labels, open_nodes, texts, like, shingle, percent))
    return labels if rest.isEmpty() else connected_components(labels, confirm(rest, texts, shingle, percent))


def _across(buckets: DataFrame, labels: DataFrame, open_nodes: DataFrame, texts: DataFrame, like: Column, shingle: int, percent: int) -> DataFrame:
    """a, b of all likely pairs of a bucket whose components differ.

    In a bucket of more than CROWD nodes only those meet that can be linked at all: a node alone in its component can be
    linked only by shingles that some other component has too, and so many of them bound its similarity to any text.
    Variants of a common text that their own words set apart fall out there without meeting each other.
    """
    inside = buckets.join(labels, "node")
    mixed = inside.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", (F.col("n") > CROWD).alias("crowded"))
    inside = materialize(inside.join(mixed, "key").select("key", "crowded", "node", "comp"))
    sizes = labels.groupBy("comp").agg(F.count("*").alias("size"))
    members = inside.where("crowded").select("node", "comp").distinct().join(sizes, "comp").select("node", "comp", (F.col("size") == 1).alias("alone"), F.floor(F.pmod(F.xxhash64("node"), F.col("size")) / CLASS).alias("part"))

    def run(batches):
        seen: dict[bytes, np.ndarray] = {}  # of components in this task: CLASS nodes, so that their shingles are sent once
        for batch in batches:
            _, all_offsets = text_bytes(batch.column(2))
            for i, j in row_slices(all_offsets):
                own, out = batch.slice(i, j - i), []
                for comp, alone, shingles in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), shingle_sets(*text_bytes(own.column(2)), shingle, SPACE_WORDS)):
                    if not alone:
                        before = seen.get(comp, shingles[:0])
                        shingles = np.setdiff1d(shingles, before, assume_unique=True)
                        seen[comp] = np.union1d(before, shingles)
                    out.append((comp, alone, shingles))
                many = [len(x[2]) for x in out]
                take = pa.array(np.repeat(np.arange(len(out)), many))
                flat = np.concatenate([np.empty(0, np.uint64), *(x[2] for x in out)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()).take(take), pa.array([x[1] for x in out], pa.bool_()).take(take), pa.array(flat)], ["comp", "alone", "shingle"])

    dealt = members.join(texts, "node").select("comp", "alone", "text", "part").repartition("comp", "part").drop("part")
    shingles = materialize(dealt.mapInArrow(run, "comp binary, alone boolean, shingle long"))
    shared = shingles.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("shingle")
    known = shingles.where("alone").join(shared, "shingle").groupBy(F.col("comp").alias("node")).agg(F.count("*").alias("most"))
    bound = members.join(known, "node", "left").select("node", F.when(F.col("alone"), F.coalesce("most", F.lit(0))).alias("most"))
    sized = open_nodes.select("node", "n", "sig", "bands").join(texts.select("node", "odd"), "node").join(bound, "node", "left")
    full = inside.join(sized, "node").withColumn("most", F.when(F.col("crowded"), F.coalesce("most", "n")).otherwise(F.col("n"))).where(f"100 * most >= {percent} * n")
    left, right = (full.select("key", F.col("node").alias(k), F.col("comp").alias(f"c{k}"), F.col("most").alias(f"most{k}"), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"), F.col("odd").alias(f"o{k}"), F.col("bands").alias(f"bands_{k}")) for k in "ab")
    enough = F.expr(f"100 * least(mosta, mostb) >= {percent} * (na + nb - least(mosta, mostb))")
    return left.join(right, (left["key"] == right["key"]) & F.expr("a > b AND ca <> cb") & enough & like & _first_shared(left["key"])).select("a", "b")


def _first_shared(key: Column) -> Column:
    """Whether key is the first band that both sides have; a pair meets in each bucket that it shares."""
    same = F.zip_with("bands_a", "bands_b", lambda x, y: x == y)
    return F.array_position(same, F.lit(True)) == F.array_position("bands_a", key)


def texts_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, text, odd (bits of parity) of the texts with shingles whose doc_id is in wanted (rep), and of a few others.

    Texts are left out where they are read, by a map of the wanted ids. Callers join the nodes that they want.
    """
    shared = hashed_map(wanted.select(map_place(F.col(wanted.columns[0]))))

    def run(batch: pa.RecordBatch):
        rows = np.flatnonzero(in_map(shared.value, batch.column(0).to_numpy()))
        own = batch.column(1).take(pa.array(rows))
        data, offsets = text_bytes(own)
        sets = shingle_sets(data, offsets, shingle, SPACE_WORDS)
        full = np.flatnonzero([len(s) > 0 for s in sets])
        odd = np.array([parities(sets[i]) for i in full], np.int64).reshape(-1, ODD_LONGS)
        return pa.RecordBatch.from_arrays([pa.array(digests(sets[i] for i in full), pa.binary()), own.take(pa.array(full, pa.int64())), list_array(odd, ODD_LONGS, pa.int64())], ["node", "text", "odd"])

    return map_chunks(docs.select(map_place(F.col("doc_id")).alias("p"), "text"), run, "node binary, text string, odd array<long>")
