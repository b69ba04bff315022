"""A trie of conversation prefixes as node tables with minimal perfect hashes.

Every conversation is rebuilt from its donor's first turns and its own later ones; each distinct sequence of turns
that rebuilt conversations begin with is a node, named by a 128-bit digest that is chained turn by turn. Members are
counted by an aggregation over digests, which combines before the shuffle, so a first turn that very many share is
cheap. A node with one member heads a chain, of which nothing needs to be summed. The others are dealt out by
subtrees of bounded size. A task enumerates a shard's digests, gives each a slot by a minimal perfect hash that is
verified against the digests, scatters counts into flat arrays, and adds them to the parents' slots in order of depth.
The nodes above all subtrees, few by construction, are one more table, or if they are many, are summed depth by depth.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix

#: Nodes that a subtree may have to be summed in one table, and that a table gathers of smaller ones.
SUBTREE = 50_000
#: Positions a key on each level of the hash.
GAMMA = 2
ROOT = hashlib.blake2b(b"", digest_size=16).digest()
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Slots:
    """A minimal perfect hash: n distinct 128-bit digests get the slots 0 to n - 1.

    On each level the digests that are alone at their position get the next slots, the others go to the next level.
    find() gives -1 for a digest that is not one of the n: what a slot holds is compared with what is looked up.
    """

    def __init__(self, digests: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = np.empty_like(digests)
        rest, base = np.arange(len(digests)), 0
        while len(rest):
            if len(self.levels) > 64:
                raise ValueError("digests are not distinct")
            at = self._place(digests[rest], len(self.levels), GAMMA * len(rest) + 1)
            alone = np.bincount(at, minlength=GAMMA * len(rest) + 1) == 1
            slot = np.cumsum(alone) - 1 + base
            self.levels.append((alone, slot))
            settled = alone[at]
            self.held[slot[at[settled]]] = digests[rest[settled]]
            rest, base = rest[~settled], base + int(alone.sum())

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(digests[:, 0] + mix(digests[:, 1] ^ np.uint64(level * 0x9E3779B9 + 1))) % np.uint64(size)).astype(np.int64)

    def find(self, digests: np.ndarray) -> np.ndarray:
        out = np.full(len(digests), -1)
        rest = np.arange(len(digests))
        for level, (alone, slot) in enumerate(self.levels):
            at = self._place(digests[rest], level, len(alone))
            found = alone[at]
            out[rest[found]] = slot[at[found]]
            rest = rest[~found]
        known = out >= 0
        out[known] = np.where((self.held[out[known]] == digests[known]).all(axis=1), out[known], -1)
        return out


def summed(node: np.ndarray, parent: np.ndarray, depth: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """counts (a row a node) with those of all nodes below added; parents that are not among the nodes get nothing."""
    slots = Slots(node)
    own, above = slots.find(node), slots.find(parent)
    flat = np.zeros_like(counts)
    flat[own] = counts
    order = np.argsort(-depth, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(depth[order]) != 0)), len(order)) if len(order) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:]):
        rows = order[a:b]
        rows = rows[above[rows] >= 0]
        np.add.at(flat, above[rows], flat[own[rows]])
    return flat[own]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, total, role, text: the rebuilt conversations turn by turn, with a row of depth 0 for each; total: its turns."""
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = materialize(turns.withColumn("seq", F.row_number().over(by_turn).cast("long")).drop("turn"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9, "donor": F.expr("conv_id - conv_id % 5")})
    lent = convs.select(F.col("conv_id").alias("donor"), F.col("own").alias("lent"))
    convs = convs.join(lent, "donor", "left").withColumn("first", F.least("h", F.coalesce("lent", F.lit(0)))).withColumn("total", F.col("first") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "donor", "h", "first", "total"))
    # h is 8 at most and a donor serves five conversations, so this join gives a donor 40 rows
    given = convs.join(turns.where("seq <= 8").withColumnRenamed("conv_id", "donor"), "donor").where("seq <= h").select("conv_id", F.col("seq").alias("depth"), "total", "role", "text")
    kept = turns.join(convs, "conv_id").where("seq > h").select("conv_id", (F.col("first") + F.col("seq") - F.col("h")).alias("depth"), "total", "role", "text")
    empty = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "total", F.lit("").alias("role"), F.lit("").alias("text"))
    return given.unionByName(kept).unionByName(empty)


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, total, node, parent (of the root: null), size (bytes of the last text): the nodes of each rebuilt conversation."""
    # one digest a turn in place of its text before the rows are shuffled
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    light = turns.select("conv_id", "depth", "total", said.alias("said"), F.octet_length("text").cast("long").alias("size"))

    def run(batches):
        node = ROOT
        for batch in batches:
            nodes, parents = [], []
            for depth, own in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                parent, node = (None, ROOT) if depth == 0 else (node, hashlib.blake2b(node + own, digest_size=16).digest())
                nodes.append(node)
                parents.append(parent)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), batch.column(4)], ["conv_id", "depth", "total", "node", "parent", "size"])

    return light.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(run, "conv_id long, depth long, total long, node binary, parent binary, size long")


def _ends(of: DataFrame) -> DataFrame:
    """node, ends_sha256 of nodes at which conversations end. The ids run through the hash in order and are not gathered."""

    def run(batches):
        now, digest = None, None
        for batch in batches:
            out = []
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node != now:
                    if digest:
                        out.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["node", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    last = of.where("depth = total").select("node", "conv_id")
    return last.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(run, "node binary, ends_sha256 string")


def _tables(shards: DataFrame, subtree: int) -> DataFrame:
    """node, parent, cut, leaves, saved: sums over subtrees. shards: cut (a shard's name, at most `subtree` nodes each), node, parent, depth, leaves, saved."""

    def table(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        cut, node, parent = (t.column(i).combine_chunks() for i in range(3))
        words = lambda column: np.frombuffer(b"".join(x or bytes(16) for x in column.to_pylist()), np.uint64).reshape(-1, 2)
        sums = summed(words(node), words(parent), t.column(3).to_numpy(), np.stack([t.column(i).to_numpy() for i in (4, 5)], axis=1))
        return pa.RecordBatch.from_arrays([node, parent, cut, pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["node", "parent", "cut", "leaves", "saved"])

    def run(batches):
        held, n, last = [], 0, None
        for batch in batches:
            cuts = batch.column(0).to_pylist()
            start = 0
            for i, cut in enumerate(cuts):
                if cut != last:
                    if n + i - start >= subtree:  # a table ends where a shard does
                        yield table([*held, batch.slice(start, i - start)])
                        held, n, start = [], 0, i
                    last = cut
            held.append(batch.slice(start))
            n += len(cuts) - start
        if n:
            yield table(held)

    picked = shards.select("cut", "node", "parent", "depth", "leaves", "saved")
    return picked.repartition("cut").sortWithinPartitions("cut").mapInArrow(run, "node binary, parent binary, cut binary, leaves long, saved long")


def prefix_trie(conversations: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, a row each.

    conversations: conv_id, turn, role, text; more columns are ignored. Turns are ordered by turn (null first), equal
    ones by role and text; a null role or text is empty; rows without a conv_id belong to no conversation and are left out. With
    h = crc32 of the decimal conv_id modulo 9, a conversation c is rebuilt from the first h turns of c - c % 5 (all if there are fewer,
    none if there is no such conversation) and its own turns after its first h. No rows: no nodes.

    conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves, saved_tokens (over the
    subtree, members less one times bytes of the last text), ends_sha256 (of the ids of conversations that end here).
    """
    of = materialize(paths(rebuilt(conversations)))
    weight = F.sum(F.col("total") - F.col("depth") + 1)
    nodes = of.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("size").alias("size"), F.count("*").alias("n_convs"), weight.alias("weight"))
    nodes = materialize(nodes)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    nodes = materialize(nodes.join(children, "node", "left").fillna(0, ["n_children", "single"]))
    # one leaf below each child with one member, and this node itself if it has no child
    shared = nodes.where("n_convs > 1").withColumns({"leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("single")).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")})
    sums = _subtree_sums(of, shared, subtree)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "node", "left").join(_ends(of), "node", "left").join(parents, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def _subtree_sums(of: DataFrame, shared: DataFrame, subtree: int) -> DataFrame:
    """node, leaves, saved of the nodes with several members, over their subtrees."""
    low, high = shared.where(F.col("weight") <= subtree), shared.where(F.col("weight") > subtree)
    # a node lies in the subtree of the first small node on the path of its smallest member
    cuts = of.join(low.select("node"), "node").groupBy("conv_id").agg(F.min_by("node", "depth").alias("cut"))
    done = materialize(_tables(low.join(cuts, "conv_id"), subtree))
    below = done.where("node = cut AND parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    plus = lambda rows, more: rows.join(more, "node", "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}).select("node", "parent", "depth", "leaves", "saved")
    top = materialize(plus(high, below))
    found = top.agg(F.count("*").alias("n"), F.max("depth").alias("depth")).first()
    if 0 < found["n"] <= subtree:
        top = _tables(top.withColumn("cut", F.lit(ROOT)), subtree)
    else:
        for depth in range(found["depth"] or 0, 0, -1):
            up = top.where(F.col("depth") == depth).groupBy(F.col("parent").alias("node")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
            top = materialize(plus(top, up))
    return done.select("node", "leaves", "saved").unionByName(top.select("node", "leaves", "saved"))
