"""Conversation repair and the prefix trie against brute force; signatures that linked sets must share."""

import random

import duckdb
import numpy as np
import pytest

from chainmetrics.llm import oracles, partenum, repair, trie

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def layered(initials, faults):
    """Least (cost, audit) row by row over the four states."""
    far = (10**9, "")

    def closed(b):
        put = lambda x: (x[0] + 5, x[1] + "I")
        user = min(b[2], put(b[0]), put(b[1]), put(b[3]))
        return [b[0], b[1], user, min(b[3], put(user))]

    b = closed([(0, ""), far, far, far])
    for initial, fault in zip(initials, faults):
        read = [(c + 2, a + "D") for c, a in b]
        if fault not in (1, 2):
            more = 5 * (fault == 3)
            for q, to, wanted in ((0, 1, "s"), (0, 2, "u"), (1, 2, "u"), (3, 2, "u"), (2, 3, "a")):
                c, a = b[q]
                if initial == wanted:
                    read[to] = min(read[to], (c + more, a + "K"))
                if to > 1:
                    read[to] = min(read[to], (c + 1 + more, a + "R"))
        b = closed(read)
    return min(b[0], b[3])


def test_cheapest_edits_equal_brute_force():
    rng = random.Random(1)
    for _ in range(4000):
        n = rng.randrange(12)
        initials, faults = [rng.choice("suaaux") if rng.random() > 0.05 else "" for _ in range(n)], [rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n)]
        assert repair.cheapest(initials, faults) == layered(initials, faults)


def test_long_conversation_is_repaired_in_one_pass():
    rng = random.Random(2)
    initials, faults = [rng.choice("uas") for _ in range(5000)], [rng.choice([0, 0, 0, 1, 3]) for _ in range(5000)]
    assert repair.cheapest(initials, faults) == layered(initials, faults)


def test_repaired_rows_are_the_conversation(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Bye."), (2, 0, "assistant", "No question."), (2, 1, "user", "x" * 300_000), (2, 2, "assistant", " \n")]
    found = repair.repaired(spark.createDataFrame(rows, CONVERSATIONS)).orderBy("conv_id", "place").collect()
    assert ["".join(r["edit"] for r in found if r["conv_id"] == c) for c in (1, 2)] == ["KDKD", "DDD"]
    assert [(r["role"], r["text"]) for r in found if r["edit"] != "D"] == [("user", "Hi."), ("assistant", "Hello.")]
    assert [r["fault"] for r in found] == ["", "duplicate", "", "", "", "truncated", "blank"]
    assert repair.repair_digests(spark.createDataFrame([], CONVERSATIONS)).collect() == []


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(3)
    digests = rng.integers(0, 1 << 63, (20_000, 2), dtype=np.uint64)
    digests[100:200, 0] = digests[0, 0]
    slots = trie.Slots(digests)
    assert sorted(slots.find(digests).tolist()) == list(range(20_000))
    assert (slots.find(digests ^ np.uint64(1 << 40)) == -1).all()
    with pytest.raises(ValueError):
        trie.Slots(np.zeros((2, 2), np.uint64))


def test_sums_in_order_of_depth():
    node = np.array([[1, 0], [2, 0], [3, 0], [4, 0], [5, 0]], np.uint64)
    parent = np.array([[9, 9], [1, 0], [2, 0], [1, 0], [8, 8]], np.uint64)
    found = trie.summed(node, parent, np.array([0, 1, 2, 1, 1]), np.array([[1, 10], [1, 20], [1, 30], [1, 40], [1, 50]]))
    assert found.tolist() == [[4, 100], [2, 50], [1, 30], [1, 40], [1, 50]]


@pytest.mark.parametrize("subtree", [1, 3, 20, 50_000])
def test_trie_is_the_same_however_it_is_cut(spark, tmp_path, subtree):
    rng = random.Random(4)
    rows = [(c, t, ("user", "assistant")[t % 2], rng.choice(["a.", "b.", "é"]) if t else "Hello.") for c in range(0, 120) for t in range(rng.randrange(0, 7))]
    rows += [(c, t, "user", f"same {t}") for c in (500, 1000, 1005) for t in range(40)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    con = duckdb.connect()
    pandas = df.toPandas()  # noqa: F841
    con.execute("CREATE VIEW conversations AS SELECT * FROM pandas")
    want = con.execute(oracles.PREFIX_TRIE)
    names = [c[0] for c in want.description]
    got = trie.prefix_trie(df, subtree=subtree).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_trie_of_nothing_is_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], CONVERSATIONS)).collect() == []


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_sets_at_the_threshold_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    tried = 0
    for size in [*range(1, 120), 150, 300, 700, 2500]:
        for _ in range(4):
            gone, new = rng.integers(0, size // 2 + 1, 2)
            while 100 * (size - gone) < percent * (size + new):
                gone, new = max(gone - 1, 0), max(new - 1, 0)
            if gone + new == 0:
                continue
            u = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            v = np.concatenate((u[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)))
            keys, of = partenum.signatures(np.concatenate((u, v)), np.array([0, len(u), len(u) + len(v)]), percent)
            assert len(np.intersect1d(keys[of == 0], keys[of == 1])), (size, gone, new)
            tried += 1
    assert tried > 250


def test_signatures_of_sets_with_empty_projections(monkeypatch):
    """Where the shingles of a set fall into few parts, later dealings serve, and in the last the empty ones count."""
    monkeypatch.setattr(partenum, "LEVELS", 1)
    rng = np.random.default_rng(1)
    for _ in range(300):
        u = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
        keys, of = partenum.signatures(np.concatenate((u, u[1:])), np.array([0, 5, 9]), 80)
        assert len(np.intersect1d(keys[of == 0], keys[of == 1]))


def linked(docs, shingle, percent):
    sets = {}
    for doc, text in docs:
        words = [w for w in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
        sets[doc] = {" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))} if words else set()
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_jaccard_components_equal_brute_force(spark):
    """Groups of near copies around the threshold, a line that many texts share, copies, nulls, ties and a very long text; keys in several parts."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(400)}"
    line = " ".join(word() for _ in range(12))
    docs, doc = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "two words")], 10
    for _ in range(40):
        base = [word() for _ in range(rng.choice([6, 9, 14, 30, 80, 200]))]
        for _ in range(rng.randrange(1, 7)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                own[rng.randrange(len(own))] = word()
            docs.append((doc, " ".join(own) + (f" {line}" if rng.random() < 0.5 else "")))
            doc += 1
    docs += [(900, docs[20][1]), (901, docs[20][1].upper()), (902, " ".join(word() for _ in range(60_000)))]
    docs.append((903, docs[-1][1] + " more"))
    df = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, key string")
    for part in (partenum.PART, 200):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.jaccard_components(df.repartition(5), part=part).collect()}
        assert got == linked(docs, 5, 80)
    assert partenum.jaccard_components(df.limit(0)).collect() == []
    twice = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in partenum.jaccard_components(twice).collect() if r["n_shingles"]) == [("7", 7), ("7", 7), ("None", 7)]
