"""Near-duplicate passages by compact windows.

A text is its sequence of five-word shingles, and the hash at a place is that of the 13 shingles around it. The passages
whose smallest hash is at place c are those inside c's range in the Cartesian tree of the hashes, so (left, c, right)
stands for all of them. A window's key is the hash at c; texts are joined on keys, the windows that they share are laid
over each other with a passage's length to either side, and inside them the passages are verified shingle by shingle.

Passages of 46 shingles that are alike by 0.8 share at least 41. Where their shared shingles break off, either side loses
four or more (an edited word is in five), so that there is one break at most, and a run of RUN shingles is in both; the
runs of longer passages are no shorter. A run of RUN holds nine places with all their 13 shingles. Windows as narrow as
nine places are kept, a ninth to a fifth of a text's places, and both passages have the one whose centre is the smallest of these
nine: nothing is left to chance, and one hash function is enough. Only passages that repeat their own four-word sequences
may break at a lesser cost. Lines of 16 words or fewer give no key, however common.

Where one shingle fills a place's whole context (a word repeated on and on), a key says nothing of what follows. Such a
stretch has a key of its own if it holds a whole passage; every passage that leaves it holds the shingles past one of its
ends, and its keys are those (ends_of). Texts that merely repeat the same word a few dozen times do not meet.

Groups that share a key are not expanded to pairs: every text meets the member with the most shared keys around, which
closes the windows whose passages it verifies. Only windows that stay open, or whose texts are not linked yet, meet each
other, in blocks of a key, if LONG shingles to one side of c are equal and parities of the shingles that a passage around c
must hold allow one. They try the nearest first, until a passage is verified: results grow with windows, not with pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAP_BITS, SPACE_WORDS, digests, gram_hashes, hashed_map, in_map, list_array, map_chunks, materialize, mix, row_slices, text_bytes, word_hashes
from .components import connected_components

SHINGLE, CONTEXT, RUN = 5, 6, 21
#: Places of a run with all their context, and shingles of the run to one side of any of them, context included.
PLACES = RUN - 2 * CONTEXT
LONG = 2 * CONTEXT + 1 + (PLACES - 1) // 2
#: Shingles past the end of a stretch of one shingle that tell what follows.
EDGE = 4
#: Partners that one copy of a text serves in a verifying task.
FAN = 300
#: Texts of a component whose shingles one task gathers.
CLASS = 1000
#: Rows of a key that a block of the last step holds; two blocks meet in one task.
BLOCK = 4000


def centres(values: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Places that are the smallest (leftmost) of some `width` consecutive values inside one of the texts at `at`."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, where, size = values, np.arange(len(values)), 1

    def narrow(shift: int, count: int) -> None:
        nonlocal best, where
        a, b = best[:count], best[shift : shift + count]
        right = b < a
        best, where = np.where(right, b, a), np.where(right, where[shift : shift + count], where[:count])

    while size * 2 <= width:
        narrow(size, len(best) - size)
        size *= 2
    if size < width:
        narrow(width - size, n)
    last = at[1:] - width
    full = last >= at[:-1]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, at[:-1][full], 1)
    np.add.at(mark, last[full] + 1, -1)
    where = where[:n][np.cumsum(mark[:n]) > 0]  # in order, since a window's smallest place is never before that of the one before
    return where[np.diff(where, prepend=-1) > 0]


def reach(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range (first, last) of each place in the Cartesian tree: how far no value is smaller (to the left: or equal)."""
    levels = [values]
    while (1 << len(levels)) <= len(values):
        a, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(a[:-step], a[step:]))
    low, high, own = places.copy(), places.copy(), values[places]
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        table = levels[k]
        fits = low >= size
        fits[fits] = table[low[fits] - size] > own[fits]
        low[fits] -= size
        fits = high + size < len(values)
        fits[fits] = table[high[fits] + 1] >= own[fits]
        high[fits] += size
    return low, high


def ends_of(grams: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Stretches of one shingle as long as a context: of each its first and last place; for their keys (stretch, place, key): the stretch itself, and its ends.

    first, last: bounds of the texts. A passage of `width` shingles lies inside a stretch of that length, or holds
    an end and some shingles past it: up to EDGE of them tell, fewer where the stretch is nearly a passage by itself.
    """
    edge = np.flatnonzero(grams[1:] != grams[:-1]) + 1
    bounds = np.unique(np.concatenate(([0], edge, first, last + 1, [len(grams)])))
    flat = np.flatnonzero(np.diff(bounds) > 2 * CONTEXT)
    u, v = bounds[flat], bounds[flat + 1] - 1
    text = np.searchsorted(first, u, "right") - 1
    own = (text >= 0) & (v <= last[text])
    u, v, text = u[own], v[own], text[own]
    i, size = np.arange(len(u)), v - u + 1
    whole = i[size >= width]
    index, place, keys = [whole], [u[whole]], [mix(grams[u[whole]] + np.uint64(7))]
    for k in range(1, EDGE + 1):
        some = i if k == EDGE else i[size >= width - 2 * EDGE]
        for salt, end, step in ((11, v, 1), (31, u, -1)):
            own = some[(end[some] + step * k <= last[text[some]]) & (end[some] + step * k >= first[text[some]])]
            index.append(own)
            place.append(end[own])
            keys.append(mix(mix(grams[end[own]] + np.uint64(salt + k)) ^ grams[end[own] + step * k]))
    return u, v, np.concatenate(index), np.concatenate(place), np.concatenate(keys)


def xor_before(grams: np.ndarray) -> np.ndarray:
    """For each place the parities, in 64 bits, of the hashed shingles before it."""
    bits = np.uint64(1) << (mix(grams + np.uint64(5)) & np.uint64(63))
    return np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bits))) if len(bits) else np.zeros(1, np.uint64)


def previous(grams: np.ndarray) -> np.ndarray:
    """For each place where its shingle was last; far below 0 if nowhere."""
    order = np.argsort(grams, kind="stable")
    out = np.full(len(grams), -len(grams) - (1 << 30), np.int64)
    same = grams[order[1:]] == grams[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def enough(width: int, percent: int) -> int:
    """Shingles that two sets of `width` share if they are alike by percent / 100."""
    return -(-2 * percent * width // (100 + percent))


def verified(a: np.ndarray, b: np.ndarray, region: tuple[int, int], width: int, percent: int, index: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int]]:
    """Passages (start, end in a's region, start, end in b) of `width` shingles or more that are alike. index: b's sorted shingles and their places.

    First the whole stretch of common shingles is held against b's; if it is not alike, every window of `width` along
    each line on which a run of shingles lies in both.
    """
    need, run = enough(width, percent), width * percent // 200
    a = a[region[0] : region[1]]
    order = index[1] if index else np.argsort(b, kind="stable")
    ordered = index[0] if index else b[order]
    at = np.minimum(np.searchsorted(ordered, a), len(ordered) - 1) if len(ordered) else np.empty(0, np.int64)
    common = np.flatnonzero(ordered[at] == a) if len(ordered) else at
    if len(common) < need:
        return []
    place = order[at[common]]
    shift = place - common
    repeats = len(ordered) > 1 and bool((ordered[1:] == ordered[:-1]).any()) or len(np.unique(a)) < len(a)
    out = []
    # stretches of common shingles; in texts that repeat themselves b's places are their first ones, so b's side is drawn out to `width`
    gaps = np.flatnonzero(np.diff(common) > SHINGLE + 1) + 1 if repeats else []
    for some in [slice(None), *(slice(i, j) for i, j in zip([0, *gaps], [*gaps, len(common)]))][: None if repeats else 1]:
        x, y, p, q = int(common[some][0]), int(common[some][-1]) + 1, int(place[some].min()), int(place[some].max()) + 1
        if repeats and q - p < width:
            q = min(p + width, len(b))
            p = max(0, q - width)
        if min(y - x, q - p) >= width and q - p <= 2 * (y - x) + width and _alike(a[x:y], b[p:q], percent):
            out.append((x, y, p, q))
            if some == slice(None):
                return out
    lines, many = np.unique(shift, return_counts=True)
    for d in lines[many >= run].tolist():
        first, last = max(0, -d), min(len(a) - width, len(b) - width - d)
        if last < first:
            continue
        off = shift - d
        low = np.maximum(np.maximum(common, common + off) - width + 1, first)
        high = np.minimum(np.minimum(common, common + off), last)
        fits = low <= high
        count = np.zeros(last + 2, np.int64)
        np.add.at(count, low[fits], 1)
        np.add.at(count, high[fits] + 1, -1)
        good = np.cumsum(count)[: last + 1] >= need
        for s in np.flatnonzero(good) if repeats else ():
            good[s] = _alike(a[s : s + width], b[s + d : s + d + width], percent)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], good, [False]))))
        out += [(s, e - 1 + width, s + d, e - 1 + width + d) for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist())]
    return out


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    left, right = np.unique(a), np.unique(b)
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= percent * (len(left) + len(right) - both)


def passages(docs: DataFrame, words: int = 50, percent: int = 80, all_links: bool = True) -> DataFrame:
    """doc_id, n_words, component_id, n_links, passages (word numbers, end exclusive), n_repeated: a row for each row of docs.

    docs: doc_id, text; more columns are ignored. A passage of `words` words or more is repeated if some other text
    has one whose shingle set is alike by percent / 100. Copies of a text (same words) are linked and, if they have
    the words, repeated whole. component_id is the smallest doc_id that links reach. n_links counts the texts linked
    directly, copies included; all pairs of texts that share a key must meet for it, which grows with the square of a
    group. all_links=False leaves the column out, and groups meet by stars; texts, components and passages stay whole.
    Null, empty and short texts have no passages and are their own component (with their copies); a null doc_id keeps
    null unless linked. Very long texts are a pass each; of equal hashes the leftmost is a window's centre.
    """
    width = words - SHINGLE + 1
    if width < RUN:
        raise ValueError("passages must be longer than a key")
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text")

    def each(column: pa.Array):
        data, offsets = text_bytes(column)
        hashes, _, _, at = word_hashes(data, offsets, SPACE_WORDS)
        return hashes, at, digests(hashes[a:b] for a, b in zip(at[:-1], at[1:]))

    def identify(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, at, node = each(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.binary()), pa.array(np.diff(at), pa.int64())], ["doc_id", "node", "n_words"])

    def keyed(column: pa.Array):
        """Hashed shingles and contexts, texts' bounds, contexts that are centres with their texts, stretches' keys. Of copies in a batch one speaks."""
        hashes, at, node = each(column)
        grams = gram_hashes(hashes, SHINGLE)
        start, end = at[:-1], np.maximum(at[1:] - SHINGLE + 1, at[:-1])
        speaks = np.zeros(len(node), bool)
        speaks[list({x: i for i, x in enumerate(node)}.values())] = True
        speaks &= end - start >= width
        v = gram_hashes(grams, 2 * CONTEXT + 1)  # from a context's first shingle on
        equal = np.concatenate((np.zeros(1, np.int64), np.cumsum(grams[1:] == grams[:-1])))
        alone = np.flatnonzero(equal[2 * CONTEXT :] - equal[: len(v)] == 2 * CONTEXT) if len(v) else np.empty(0, np.int64)
        v[alone] = ~np.uint64(0)  # contexts of one shingle are never a centre
        bounds = np.minimum(np.stack((start, np.maximum(end - 2 * CONTEXT, start)), axis=1).reshape(-1), len(v))  # texts and the gaps between them, by turns
        p = centres(v, bounds, PLACES)
        text = np.searchsorted(at, p, "right") - 1
        own = (p < bounds[1::2][text]) & speaks[text] & (v[p] != ~np.uint64(0))  # shingles across texts are outside every text's range
        p, text = p[own], text[own]
        some = np.flatnonzero(speaks)
        none = p[:0]
        stretches = ends_of(grams, start[some], end[some] - 1, width) if len(some) and len(alone) else (none, none, none, none, v[:0])
        return grams, v, node, at, end - 1, p, text, stretches

    def keys_only(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, v, node, at, _, p, text, (*_, place, of_end) = keyed(batch.column(0))
        short = np.array([int.from_bytes(x[:8], "little", signed=True) for x in node], np.int64)
        key, text = np.concatenate((v[p], of_end)), np.concatenate((text, np.searchsorted(at, place, "right") - 1))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(short[text])], ["key", "short"])

    every = materialize(map_chunks(rows, identify, f"doc_id {kind}, node binary, n_words long"))
    some = rows.where("text IS NOT NULL")
    of_key = map_chunks(some.select("text"), keys_only, "key long, short long").groupBy("key").agg(F.min("short").alias("low"), F.max("short").alias("high"), F.count("*").alias("size"))
    shared = materialize(of_key.where("low <> high").select("key", "size"))
    wanted = hashed_map(shared.select(F.pmod("key", F.lit(MAP_BITS)) + 1))
    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, v, node, at, end, p, text, (u, w, index, place, of_end) = keyed(batch.column(0))
        known = lambda key: np.flatnonzero(in_map(wanted.value, (key.view(np.int64) & (MAP_BITS - 1)) + 1))
        some, ends = known(v[p]), known(of_end)
        p, text, index, place, of_end = p[some], text[some], index[ends], place[ends], of_end[ends]
        low, high = reach(v, p) if len(p) else (p, p)
        text, c, key = np.concatenate((text, np.searchsorted(at, place, "right") - 1)), np.concatenate((p + CONTEXT, place)), np.concatenate((v[p], of_end)).view(np.int64)
        left, right = np.concatenate((low, u[index])), np.concatenate((high + 2 * CONTEXT, w[index]))
        of_end = np.concatenate((np.zeros(len(p), np.uint64), of_end))  # 0 for plain keys
        start = at[:-1]
        order = np.lexsort((c, key, text))
        text, left, c, right, key, of_end = (x[order] for x in (text, left, c, right, key, of_end))
        start, end = start[text], end[text]
        # passages that hold the window's smallest hash may go beyond it
        left, right = np.maximum(left - width, start) - start, np.minimum(right + width, end) - start
        # a row for each text and key, with all its places: texts that repeat themselves have many
        first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(key, prepend=0) != 0) | (np.arange(len(c)) == 0))
        stops = pa.array(np.append(first, len(c)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(stops, pa.array(x.astype(np.int32))) for x in (left, c - start, right)]
        columns = [pa.array(key[first]), pa.array(node, pa.binary()).take(pa.array(text[first])), *lists, pa.array(of_end[first] > 0)]
        return pa.RecordBatch.from_arrays(columns, ["key", "node", "left", "c", "right", "ends"])

    found = map_chunks(some.select("text"), windows, "key long, node binary, left array<int>, c array<int>, right array<int>, ends boolean")
    # equal texts in several batches are one
    found = materialize(found.join(shared, "key").dropDuplicates(["key", "node"]))
    classes = every.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    nodes = materialize(found.select("node").distinct())
    ids = nodes.join(classes, "node").select(F.col("rep").alias("rep_id")).distinct()

    def with_node(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(each(batch.column(0))[2], pa.binary()), batch.column(0)], ["node", "text"])

    source = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("rep_id")), "left_semi").select("text")
    texts = materialize(map_chunks(source, with_node, "node binary, text string").join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    results, labels = _linked(found, texts, nodes, width, percent, all_links)
    links = results.select("a", "b").distinct()
    spans = _spans(results).groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    labels = connected_components(labels, links)
    named = classes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_node = named.join(least, "comp").join(spans, "node", "left")
    if all_links:
        both_ways = links.select(F.col("a").alias("own"), F.col("b").alias("node")).union(links.select(F.col("b").alias("own"), F.col("a").alias("node")))
        degree = both_ways.join(classes.select("node", "copies"), "node").groupBy(F.col("own").alias("node")).agg(F.sum("copies").alias("links"))
        of_node = of_node.join(degree, "node", "left")
    else:
        of_node = of_node.withColumn("links", F.lit(0))
    out = every.join(of_node.select("node", "component_id", "copies", "links", "spans"), "node")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= words)
    span = "array<struct<start:bigint,end:bigint>>"
    merged = F.aggregate(F.array_sort("spans"), F.array().cast(span), _merge)
    out = out.withColumn("passages", F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(F.coalesce(merged, F.array().cast(span))))
    repeated = F.aggregate("passages", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    bare = F.col("n_words") == 0
    n_links = [F.when(bare, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")] if all_links else []
    return out.select("doc_id", "n_words", F.when(bare, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *n_links, "passages", repeated.alias("n_repeated"))


def _linked(found: DataFrame, texts: DataFrame, nodes: DataFrame, width: int, percent: int, all_links: bool) -> tuple[DataFrame, DataFrame]:
    """a, b, in_a, in_b of verified pairs; node, comp as far as it is known. found: key, size, node, left, c, right, ends."""
    if all_links:
        side = lambda k: found.select("key", F.col("node").alias(k), F.arrays_zip("left", "right").alias("w"))
        pairs = side("a").join(side("b").drop("w"), "key").where("a > b").groupBy("a", "b").agg(F.flatten(F.collect_set("w")).alias("windows"))
        return materialize(_verify(pairs, texts, width, percent)), nodes.select("node", F.col("node").alias("comp"))
    around = Window.partitionBy("node").orderBy(F.col("c")[0]).rangeBetween(-width, width)
    scored = materialize(found.withColumn("score", F.sum("size").over(around)).drop("size"))
    # the row with most shared keys around leads its key
    lead = scored.groupBy("key").agg(F.max(F.struct("score", "node")).alias("l")).select("key", F.col("l.node").alias("b"))
    star = materialize(scored.select("key", "node", "left", "c", "right").join(lead, "key").where("node <> b"))
    pairs = star.groupBy(F.col("node").alias("a"), "b").agg(F.flatten(F.collect_list(F.arrays_zip("left", "right"))).alias("windows"))
    results = materialize(_verify(materialize(pairs), texts, width, percent))
    # windows stay open whose centres are not all in verified passages
    spans = _spans(results).groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    covered = lambda c: F.exists("spans", lambda s: (s["start"] <= c) & (s["end"] >= c + SHINGLE))
    still = star.select("key", "node", "c").join(spans, "node", "left").where(F.col("spans").isNull() | ~F.forall("c", covered))
    labels = connected_components(nodes.select("node", F.col("node").alias("comp")), results.select("a", "b").distinct())
    marked = scored.join(still.select("key", "node", F.lit(True).alias("open")), ["key", "node"], "left").withColumn("open", F.coalesce("open", F.lit(False))).join(labels, "node")
    marked = materialize(marked.select("key", "node", "c", "comp", "open", "ends"))
    possible = _possible(marked, texts, width, percent)
    # open windows that no passage can hold meet nobody
    marked = marked.join(possible, ["key", "node"], "left").where("NOT open OR possible")
    # keys whose texts are one component without open windows are done
    mixed = marked.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("open").alias("open"), F.count("*").alias("n")).where("n > 1 AND (low <> high OR open)").select("key")
    left = materialize(marked.join(mixed, "key").select("key", "node", F.col("c")[0].alias("c"), "comp", "open", "ends"))
    return materialize(results.unionByName(_rest(left, texts, width, percent))), labels


def _rest(left: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b, in_a, in_b: a link for each open window that has one, and for components that any two windows with one key link.

    left: key, node, c, comp, open, ends. The windows' rows carry the shingles that a passage of `width` around c can
    hold. Those of a key meet in blocks of at most BLOCK rows by BLOCK; open windows try the others, the nearest first, until a
    passage around c is verified, others try those of components that the block has not joined yet.
    """
    lists = left.groupBy("node").agg(F.collect_list(F.struct("key", "c", "comp", "open", "ends")).alias("windows"))
    # a passage with x shingles left of c holds all of those from c - lefts[i] on, inner in number, with lefts[i] the largest up to x
    step = width // 5
    inner = width - step + 1
    lefts = [*range(0, inner, step), inner - 1]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        hashes, _, _, at = word_hashes(data, offsets, SPACE_WORDS)
        rows = batch.column(2).flatten()
        of_text = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
        c = rows.field("c").to_numpy(zero_copy_only=False).astype(np.int64)
        grams = gram_hashes(hashes, SHINGLE)
        first = np.maximum(c - width + 1, 0)
        size = np.minimum(c + width, (np.diff(at) - SHINGLE + 1)[of_text]) - first
        stops = np.concatenate(([0], np.cumsum(size)))
        flat = grams[np.repeat(at[:-1][of_text] + first - stops[:-1], size) + np.arange(stops[-1])] if len(c) else grams[:0]
        around = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(flat.view(np.int64)))
        plain, before, long = ~rows.field("ends").to_numpy(zero_copy_only=False), xor_before(grams), gram_hashes(grams, LONG)
        start, end = at[:-1][of_text], (at[1:] - SHINGLE)[of_text]
        c = c + start
        # parities of what passages around c hold, by how many shingles are left of it; 0 where a text has no such passage, and for stretches' ends
        sides = np.zeros((len(c), len(lefts)), np.uint64)
        for k, x in enumerate(lefts):
            own = np.flatnonzero((c - x >= start) & (c - x + inner <= end + 1) & plain)
            sides[own, k] = before[c[own] - x] ^ before[c[own] - x + inner] | np.uint64(1)
        edge = np.maximum(end - LONG + 1, start)
        l, r = (np.where(plain, long[np.minimum(np.clip(c + x, start, edge), len(long) - 1)], np.uint64(0)) if len(c) else long[:0] for x in (CONTEXT + 1 - LONG, -CONTEXT))
        columns = [batch.column(0).take(pa.array(of_text)), *(rows.field(x) for x in ("key", "c", "comp", "open")), list_array(sides.view(np.int64), len(lefts), pa.int64()), pa.array(l.view(np.int64)), pa.array(r.view(np.int64)), around]
        return pa.RecordBatch.from_arrays(columns, ["node", "key", "c", "comp", "open", "sides", "l", "r", "around"])

    cuts = map_chunks(texts.join(lists, "node").select("node", "text", "windows"), cut, "node binary, key long, c int, comp binary, open boolean, sides array<long>, l long, r long, around array<long>")
    parts = left.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = cuts.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "c", "comp", "open", "sides", "l", "r", "around")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        held: list[pa.RecordBatch] = []
        before = None
        for whole in batches:
            names = np.stack([whole.column(k).to_numpy() for k in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), len(names)]
            for i, j in zip(edges[:-1], edges[1:]):
                if i == j:
                    continue
                if held and tuple(names[i]) != before:
                    yield answer(held)
                    held = []
                before = tuple(names[i])
                held.append(whole.slice(i, j - i))
        if held:
            yield answer(held)

    def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        out = list(_meet(pa.Table.from_batches(held).combine_chunks().to_batches()[0], width, percent))
        columns = list(zip(*out)) or [()] * 4
        words = [[[{"start": x, "end": y + SHINGLE - 1} for x, y in some] for some in columns[k]] for k in (2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(words[0], spans), pa.array(words[1], spans)], ["a", "b", "in_a", "in_b"])

    return dealt.mapInArrow(run, "a binary, b binary, in_a array<struct<start:long,end:long>>, in_b array<struct<start:long,end:long>>")


def _meet(rows: pa.RecordBatch, width: int, percent: int):
    """a, b and the verified passages (in shingles) in both, of the windows of one key. rows: key, x, y, own, node, c, comp, open, sides, l, r, around."""
    n = rows.num_rows
    one_block = rows.column(1)[0].as_py() == rows.column(2)[0].as_py()
    own, c, is_open, l, r = (rows.column(k).to_numpy(zero_copy_only=False) for k in (3, 5, 7, 9, 10))
    node, is_open = rows.column(4).to_pylist(), is_open.copy()
    comp = np.unique(np.array(rows.column(6).to_pylist(), object), return_inverse=True)[1]
    sides = rows.column(8).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1)
    at, flat = rows.column(11).offsets.to_numpy(), rows.column(11).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    at = at - at[0]
    first = np.maximum(c - width + 1, 0)
    ends = ~sides.any(1)
    need, several = enough(width, percent), len(np.unique(comp)) > 1
    apart = 2 * (width - need)
    order = np.argsort(~is_open, kind="stable")  # open windows first, each against all that follow
    for at_order, i in enumerate(order.tolist()):
        if not several and not is_open[i]:
            continue
        j = order[at_order + 1 :]
        if not one_block:
            j = j[own[j] != own[i]]
        j = j[((l[j] == l[i]) | (r[j] == r[i])) & (is_open[i] | is_open[j] | (comp[j] != comp[i]))]
        if not len(j):
            continue
        bits = np.where((sides[i] != 0) & (sides[j] != 0), np.bitwise_count(sides[j] ^ sides[i]), 64).min(1)
        bits[ends[j] & ends[i]] = 0
        j = j[np.argsort(bits, kind="stable")[: np.count_nonzero(bits <= apart)]]
        a = flat[at[i] : at[i + 1]]
        ordered = np.sort(a)
        plain = not (ordered[1:] == ordered[:-1]).any()
        for k in j.tolist():
            if not (is_open[i] or is_open[k] or comp[i] != comp[k]):
                continue
            b = flat[at[k] : at[k + 1]]
            # a passage around c holds at least enough() shingles of the other text, all within its reach
            if plain and np.count_nonzero(ordered[np.minimum(np.searchsorted(ordered, b), len(a) - 1)] == b) < need:
                continue
            found = verified(a, b, (0, len(a)), width, percent)
            if not found:
                continue
            in_a, in_b = (sorted({(int(first[m]) + w[z], int(first[m]) + w[z + 1]) for w in found}) for m, z in ((i, 0), (k, 2)))
            yield node[i], node[k], in_a, in_b
            for m, some in ((i, in_a), (k, in_b)):
                if any(s <= c[m] < e for s, e in some):
                    is_open[m] = False
            if comp[i] != comp[k]:
                comp[comp == comp[k]] = comp[i]
                several = bool((comp != comp[i]).any())


def _possible(marked: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """key, node, possible: the open windows around whose centre enough shingles are in other texts for any passage.

    Two passages of `width` shingles or more that are alike share enough() of `width` in a row; around a centre where the
    text repeats its own shingles, which count once in a set, percent / 100 of the distinct ones. Open texts count by themselves, the others by
    their components (whose names are no text's here), whose shingles a task sends once for each CLASS texts.
    """
    least = enough(width, percent)
    keys = marked.where("open").select("key").distinct()
    of_node = marked.join(keys, "key").groupBy("node").agg(F.max("open").alias("open"), F.first("comp").alias("comp"))
    sizes = of_node.groupBy("comp").agg(F.count("*").alias("size"))
    members = of_node.join(sizes, "comp").select("node", "open", F.when(F.col("open"), F.col("node")).otherwise(F.concat("comp", F.lit(b"+"))).alias("own"), F.when(F.col("open"), F.lit(0)).otherwise(F.floor(F.pmod(F.xxhash64("node"), F.col("size")) / CLASS)).alias("part"))

    def grams_of(column: pa.Array) -> list[np.ndarray]:
        data, offsets = text_bytes(column)
        hashes, _, _, at = word_hashes(data, offsets, SPACE_WORDS)
        return [gram_hashes(hashes[x:y], SHINGLE) for x, y in zip(at[:-1], at[1:])]

    def gather(batches):
        seen: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for i, j in row_slices(text_bytes(batch.column(2))[1]):
                part, out = batch.slice(i, j - i), []
                for own, alone, grams in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), grams_of(part.column(2))):
                    grams = np.unique(grams)
                    if not alone:
                        before = seen.get(own, grams[:0])
                        grams = np.setdiff1d(grams, before, assume_unique=True)
                        seen[own] = np.union1d(before, grams)
                    out.append((own, alone, grams))
                take = pa.array(np.repeat(np.arange(len(out)), [len(x[2]) for x in out]))
                flat = np.concatenate([np.empty(0, np.uint64), *(x[2] for x in out)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()).take(take), pa.array([x[1] for x in out], pa.bool_()).take(take), pa.array(flat)], ["own", "open", "gram"])

    dealt = members.join(texts, "node").select("own", "open", "text", "part").repartition("own", "part").drop("part")
    grams = materialize(dealt.mapInArrow(gather, "own binary, open boolean, gram long"))
    shared = grams.groupBy("gram").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("gram")
    known = grams.where("open").join(shared, "gram").groupBy(F.col("own").alias("node")).agg(F.collect_list("gram").alias("grams"))
    wanted = marked.where("open").groupBy("node").agg(F.collect_list(F.struct("key", "c")).alias("windows"))

    def test(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, key = [], []
        for name, some, windows, grams in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), grams_of(batch.column(0))):
            held = np.isin(grams, np.array(some, np.int64).view(np.uint64))
            count = np.concatenate(([0], np.cumsum(held)))
            before = previous(grams)
            new = np.lib.stride_tricks.sliding_window_view(before, width) < np.arange(len(grams) - width + 1)[:, None]
            distinct = new.sum(1)
            seen = (new & np.lib.stride_tricks.sliding_window_view(held, width)).sum(1)
            dense = np.flatnonzero((count[width:] - count[:-width] >= least) | (distinct < width) & (100 * seen >= percent * distinct))  # starts of passages
            for w in windows:
                c = np.array(w["c"])
                if (np.searchsorted(dense, c, "right") > np.searchsorted(dense, c - width, "right")).any():
                    node.append(name)
                    key.append(w["key"])
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node, pa.binary()), pa.array([True] * len(key), pa.bool_())], ["key", "node", "possible"])

    rows = texts.join(wanted, "node").join(known, "node").select("text", "node", "grams", "windows")
    return materialize(map_chunks(rows, test, "key long, node binary, possible boolean"))


def _spans(results: DataFrame) -> DataFrame:
    """node, start, end of all verified passages, once each."""
    both = results.select(F.col("a").alias("node"), F.explode("in_a").alias("s")).union(results.select(F.col("b").alias("node"), F.explode("in_b").alias("s")))
    return both.select("node", "s.start", "s.end").distinct()


def _merge(acc, s):
    last = F.try_element_at(acc, F.lit(-1))
    touching = F.coalesce(s["start"] <= last["end"], F.lit(False))
    grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
    return F.when(touching, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b, in_a, in_b of the pairs with verified passages (in words). pairs: a, b, windows (of a that b shares).

    a sends the shingles of its windows alone; b's go once to each FAN of its partners.
    """
    pairs = pairs.withColumn("h", F.pmod(F.xxhash64("a"), F.lit(1 << 20)))
    size = pairs.groupBy("b").agg(F.ceil(F.count("*") / FAN).alias("parts"))
    members = pairs.join(size, "b").select("a", "b", (F.col("h") % F.col("parts")).alias("part"), "windows")
    heads = size.select(F.col("b").alias("a"), "b", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(None).cast("array<struct<left:int,right:int>>").alias("windows"))
    with_text = members.unionByName(heads).join(texts.select(F.col("node").alias("a"), "text"), "a").select("b", "part", "a", "windows", "text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(4))
        hashes, _, _, at = word_hashes(data, offsets, SPACE_WORDS)
        out, start = [], []
        for i, windows in enumerate(batch.column(3).to_pylist()):
            grams = gram_hashes(hashes[at[i] : at[i + 1]], SHINGLE)
            if windows is None:
                out.append([grams])
                start.append([0])
                continue
            runs: list[list[int]] = []
            for w in sorted({(w["left"], w["right"] + 1) for w in windows}):
                if runs and w[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], w[1])
                else:
                    runs.append(list(w))
            out.append([grams[x:y] for x, y in runs])
            start.append([x for x, _ in runs])
        flat = np.concatenate([np.empty(0, np.uint64), *(g for own in out for g in own)])
        ends = np.concatenate(([0], np.cumsum([sum(map(len, own)) for own in out]))).astype(np.int32)
        grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
        starts, sizes = (pa.array(x, pa.list_(pa.int32())) for x in (start, [[len(g) for g in own] for own in out]))
        head = pa.array([w is None for w in batch.column(3).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), head, batch.column(2), starts, sizes, grams], ["b", "part", "head", "a", "starts", "sizes", "grams"])

    sent = map_chunks(with_text, cut, "b binary, part long, head boolean, a binary, starts array<int>, sizes array<int>, grams array<long>")
    sent = sent.repartition("b", "part").sortWithinPartitions("b", "part", F.desc("head"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    as_words = lambda some: [{"start": x, "end": y + SHINGLE - 1} for x, y in some]

    def run(batches):
        head = other = ordered = order = None
        for whole in batches:
            for batch in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                lists = batch.column(6)
                at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
                out = []
                for i, (b, first, a, starts, sizes) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)))):
                    grams = flat[at[i] : at[i + 1]]
                    if first:
                        order = np.argsort(grams, kind="stable")
                        head, other, ordered = b, grams.copy(), grams[order]
                        continue
                    if b != head:
                        continue
                    in_a, in_b, x = set(), set(), 0
                    for start, size in zip(starts, sizes):
                        for s, e, p, q in verified(grams, other, (x, x + size), width, percent, (ordered, order)):
                            in_a.add((start + s, start + e))
                            in_b.add((p, q))
                        x += size
                    if in_a:
                        out.append((a, b, as_words(sorted(in_a)), as_words(sorted(in_b))))
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], spans), pa.array(columns[3], spans)], ["a", "b", "in_a", "in_b"])

    return sent.mapInArrow(run, "a binary, b binary, in_a array<struct<start:long,end:long>>, in_b array<struct<start:long,end:long>>")
