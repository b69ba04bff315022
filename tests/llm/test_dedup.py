import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainmetrics.llm import columns, compact, minhash
from chainmetrics.llm.components import connected_components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def word_list(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]


def shingle_set(text, k):
    w = word_list(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_copies(seed, base_words, copies, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9000)}" for _ in range(base_words)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def brute_components(rows, k):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def test_near_duplicates_equal_brute_force(spark):
    rows = list(enumerate(near_copies(1, 120, 60, 9) + near_copies(2, 60, 20, 4) + [f"alone {i} of no group at all {i * 7}" for i in range(30)] + ["A b C", "a B c", "a b", "", " \t\n", "x " * 3000]))
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, node string, bands int").repartition(4)
    got = minhash.near_duplicates(df, shingle=4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_crowded_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD", 2)
    rows = list(enumerate(near_copies(9, 120, 50, 9) + near_copies(10, 80, 30, 6)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(df, shingle=4, stars=1).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 4)


def test_long_words_that_differ_in_order_alone_are_told_apart():
    from chainmetrics.llm.common import SPACE_WORDS, word_hashes

    even = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    words = [even, even.translate(str.maketrans("ab", "ba")), even[:40], even[40:80], "ab", "ba", "é" * 5]
    raw = " ".join(words).encode()
    hashes, starts, ends, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SPACE_WORDS)
    assert len(set(hashes.tolist())) == len(words) and [raw[a:b].decode() for a, b in zip(starts, ends)] == words


def test_near_duplicates_of_odd_rows(spark):
    long = "one two three four five six seven"
    df = spark.createDataFrame([(1, None), (2, long), (2, long), (None, long), (None, "x"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (2, 2, True), (None, 2, False), (None, None, False), (None, None, False)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    sets = [a, np.unique(np.concatenate((a[:889], rng.integers(0, 1 << 63, 111, dtype=np.uint64))))]
    low = minhash.minima(sets)
    x, y = (minhash.packed(low)[i].view(np.uint64) for i in (0, 1))
    differing = sum(int(v).bit_count() for v in x ^ y)
    assert abs((1 - differing / minhash.PERMUTATIONS - 0.5) / 0.5 - 0.8) < 0.1


def test_short_texts_at_the_threshold_are_linked(spark):
    rng = random.Random(6)
    rows = []
    for i in range(240):
        less, more = ((7, 8), (11, 13), (15, 18))[i % 3]  # 4 of 5, 8 of 10 and 12 of 15 shingles of four words
        text = [f"s{i}x{rng.randrange(10**6)}" for _ in range(more)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:less]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, shingle=4).collect())
    assert got == brute_components(rows, 4) and all(d - d % 2 == c for d, _, c in got)


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(2).shuffle(order)
    nodes = spark.createDataFrame([(i, i) for i in range(70)], "node long, comp long")
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(65, 65), (None, 3)], "a long, b long")
    got = dict(tuple(r) for r in connected_components(nodes, edges).collect())
    assert all(got[i] == (0 if i < 60 else i) for i in range(70))


def brute_repeats(rows, n):
    seen = Counter(b[i : i + n] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - n + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                mask[i : i + n] = True
        spans = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        out.append((d, len(b), int(mask.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeated_substrings_equal_brute_force(spark, hot):
    rng = random.Random(1)
    shared = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(150, 420))) for _ in range(8)]
    rows = []
    for i in range(80):
        text = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 150)))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 60)
            text += rng.choice(shared)[a : a + rng.randint(150, 400)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 50)))
        rows.append((i, text))
    rows += [(200, rows[5][1]), (200, rows[5][1]), (None, rows[7][1]), (None, None), (201, ""), (202, "a" * 700), (203, "ab" * 300 + "c"), (205, "é" * 150)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, rid int").repartition(4)
    got = sorted(((r[0], r[1], r[2], r[3], r[4]) for r in columns.repeated_substrings(df, 200, hot).collect()), key=str)
    assert got == brute_repeats(rows, 200)


def test_long_texts_are_searched_in_parts(spark, monkeypatch):
    monkeypatch.setattr(columns, "PART", 1000)
    rng = random.Random(4)
    text = "".join(rng.choice("abcdef") for _ in range(5000))
    rows = [(1, text), (2, "zz" + text[900:1300] + "yy" + text[3000:3199])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:5] for r in columns.repeated_substrings(df, 200).collect()) == brute_repeats(rows, 200)
    assert columns.repeated_substrings(df.limit(0)).count() == 0


def test_cartesian_ranges():
    v = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    left, right = compact.reach(v, np.arange(300))
    for c in range(300):
        a = b = c
        while a > 0 and v[a - 1] > v[c]:
            a -= 1
        while b < 299 and v[b + 1] >= v[c]:
            b += 1
        assert (a, b) == (left[c], right[c])
    at = np.array([0, 120, 300])
    want = sorted({i + int(np.argmin(v[i : i + 20])) for x, y in ((0, 120), (120, 300)) for i in range(x, y - 19)})
    assert list(compact.centres(v, at, 20)) == want


def test_passages_are_found_and_others_left_alone(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    shared, rows, planted = [words(70) for _ in range(4)], [], set()
    for i in range(48):
        text = words(rng.randint(0, 200))
        if i % 3 == 0:
            own = list(shared[(i // 3) % 4])
            if i % 2:
                own[35] = "edit"
            text += own + words(rng.randint(0, 100))
            planted.add(i)
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, ""), (102, rows[1][1]), (None, "x y"), (103, "short text"), (104, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in compact.passages(df).collect()}
    repeated = {d for d, r in got.items() if r["n_repeated"]}
    whole = {1, 102} if len(word_list(rows[1][1])) >= 50 else set()
    assert repeated == planted | whole and got[104]["component_id"] == 103 and got[101]["n_links"] == 0
    groups = defaultdict(set)
    for i in planted:
        groups[(i // 3) % 4].add(got[i]["component_id"])
    assert all(len(g) == 1 for g in groups.values())
    assert compact.passages(df.limit(0)).count() == 0


def brute_links(texts, words, k=5):
    """For each text the number of others that have a passage of `words` words like one of its own."""
    width = words - k + 1
    windows = []
    for t in texts:
        w = word_list(t)
        grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        windows.append([frozenset(grams[i : i + width]) for i in range(len(grams) - width + 1)])
    degree = [0] * len(texts)
    for i, own in enumerate(windows):
        for j in range(i):
            # like windows have a common shingle of all: at most a fifth is alone
            if any(5 * len(x & y) >= 4 * len(x | y) for x in own for y in windows[j] if not x.isdisjoint(y)):
                degree[i] += 1
                degree[j] += 1
    return degree


def test_passages_with_boilerplate_equal_brute_force(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    licence, common = words(25), words(60)
    texts = [words(rng.randint(20, 40)) + licence + words(rng.randint(20, 40)) for _ in range(40)]
    for _ in range(20):  # half of what two texts share is what all have
        own = words(25)
        texts += [words(20) + own + licence + words(20) for _ in range(2)]
    texts += [words(10) + common + words(10) for _ in range(40)]
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)) + [(500, texts[-1])], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in compact.passages(df).collect()}
    want = brute_links(texts, 50)
    assert want == [0] * 40 + [1] * 40 + [39] * 40
    assert [got[i]["n_links"] for i in range(120)] == want[:80] + [40] * 40  # the copy counts
    assert all((got[i]["n_repeated"] >= 50) == (i >= 40) for i in range(120))


def test_passages_with_two_equally_common_shifts():
    a, u = (np.arange(n, n + 30, dtype=np.uint64) for n in (0, 100))
    left = np.concatenate((a, u))
    right = np.concatenate((a, np.arange(1000, 1300, dtype=np.uint64), u))
    assert compact.verified(left, right, (0, len(left)), 46, 80) == []


def test_passages_by_stars_equal_those_by_all_pairs_and_brute_force(spark):
    """The way that the registered query takes: near copies around the threshold, a common licence, copies, ties, odd rows, a very long text and columns of clashing names."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    licence, base, long = words(25), words(90), words(30_000)
    texts = [words(25) + licence + words(25) for _ in range(10)]
    for edits in (0, 2, 5, 8) * 6:
        own = list(base)
        for place in rng.sample(range(90), edits):
            own[place] = "edit"
        texts.append(words(5) + own + words(5))
    texts += [long + base[:60], words(5) + long[1000:1070]]
    texts = [" ".join(t) for t in texts]
    odd = [(900, None), (901, ""), (902, texts[12]), (902, texts[12]), (None, texts[3]), (903, "a b"), (904, "a b")]
    rows = [(d, t, "k", 1, 2) for d, t in [*enumerate(texts), *odd]]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, node int, c int").repartition(3)
    # where passages end may differ by the partner that they were held against, what is repeated and with whom may not
    whole = lambda found: sorted(map(str, (tuple(r) for r in found.select("doc_id", "n_words", "component_id", F.col("n_repeated") >= 50).collect())))
    pairs = compact.passages(df)
    assert whole(compact.passages(df, all_links=False)) == whole(pairs)
    linked = {r["doc_id"]: r["n_links"] > 0 for r in pairs.collect()}
    short = [t if len(t) < 10**5 else " ".join(t.split()[-60:] + t.split()[1000:1070]) for t in texts]  # what of the long text others have
    assert [linked[i] for i in range(len(texts))] == [n > 0 or i == 3 or i == 12 for i, n in enumerate(brute_links(short, 50))]
    assert compact.passages(df.limit(0), all_links=False).count() == 0


def test_texts_that_repeat_single_words_meet_only_where_passages_can(spark, monkeypatch):
    def stretches(*some):
        return " ".join(w for w, n in some for w in [w] * n)

    # 80 texts of one word in common, 30 times, between words of their own
    texts = [stretches(*((f"a{i}x{j}", 24) for j in range(3)), ("to", 30), *((f"b{i}x{j}", 24) for j in range(3))) for i in range(80)]
    texts += [stretches((f"c{i}", 30), ("da", 50 + i), (f"d{i}", 30)) for i in range(3)]  # a passage of one word
    texts += [stretches((f"e{i}", 9), ("to", 28 + i), ("so", 30 - i), (f"f{i}", 9)) for i in range(3)]  # one that holds two stretches
    texts += [stretches((f"g{i}", 1), ("to", 20), *((f"h{j}", 1) for j in range(40)), (f"k{i}", 30)) for i in range(2)]  # a stretch and what follows
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, own = [], compact._verify
    monkeypatch.setattr(compact, "_verify", lambda pairs, *a: (met.append(pairs.select("a", "b").distinct().count()), own(pairs, *a))[1])
    got = {r["doc_id"]: r for r in compact.passages(df, all_links=False).collect()}
    assert [got[i]["component_id"] for i in range(88)] == [*range(80), 80, 80, 80, 83, 83, 83, 86, 86]
    assert all((got[i]["n_repeated"] >= 50) == (i >= 80) and (got[i]["n_repeated"] == 0) == (i < 80) for i in got)
    assert sum(met) < 100  # before, thousands


def test_every_passage_with_one_edit_is_found(spark):
    """Nothing is left to chance: 400 pairs of 50 words that share 41 shingles of 46, at any place of the edit."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        own = [f"w{rng.randrange(10**6)}" for _ in range(50)]
        edited = [*own[: i % 50], "edit", *own[i % 50 + 1 :]]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(edited))]
    got = compact.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), all_links=False).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: d - d % 2 for d, _ in rows}


def test_near_copies_are_not_met_pair_by_pair(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    texts = []
    for _ in range(100):
        own = list(base)
        for place in rng.sample(range(90), 7):
            own[place] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    met, own = [], compact._verify
    monkeypatch.setattr(compact, "_verify", lambda pairs, *a: (met.append(pairs.select("a", "b").distinct().count()), own(pairs, *a))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in compact.passages(df, all_links=False).collect()}
    linked = [i for i, n in enumerate(brute_links(texts, 50)) if n]
    assert all(got[i]["n_repeated"] >= 50 for i in linked)
    windows = [[frozenset(tuple(t[s : s + 5]) for s in range(k, k + 46)) for k in range(len(t) - 49)] for t in (x.split() for x in texts)]
    names = list(range(100))
    for i in range(100):
        for j in range(i):
            if names[i] != names[j] and any(5 * len(x & y) >= 4 * len(x | y) for x in windows[i] for y in windows[j] if not x.isdisjoint(y)):
                names = [names[j] if n == names[i] else n for n in names]
    for i in range(100):  # longer passages may link more
        assert len({got[j]["component_id"] for j in range(100) if names[j] == names[i]}) == 1
    assert sum(met) < 500  # before, thousands
