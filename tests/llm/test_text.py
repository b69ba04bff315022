import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from chainmetrics.llm import packing, pii, quality, secrets, tiff, tokens, winnow  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def odd_texts(n=1500, seed=3):
    rng = random.Random(seed)
    pool = "aab  \n\t'sétllre<|endoftext|>12\x1c\x85 　日本́ſK🙂%%"
    latin = [chr(c) for c in range(0x20, 0x180)] + ["́"] * 5
    out = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    out += ["".join(rng.choice(latin) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return out + ["a" * 3000, "<|endoftext|><|endoftext|>x", " " * 500, "ΑΣ ΣΑΣ Σ", "<|startoftext|> A<|ENDOFTEXT|>", "it's''s It'S", ""]


def test_token_counts_equal_the_library(spark):
    texts = odd_texts()
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert tokens.merges(BYTE).count(texts) == want
    df = spark.createDataFrame([(1, None, 9), (None, "a", 9), (1, texts[0], 9)], "doc_id long, text string, n_tokens int")
    assert sorted(tuple(r) for r in tokens.token_counts(df, BYTE).where("doc_id = 1").collect()) == sorted([(1, 0, 0, False), (1, len(texts[0].encode()), want[0], want[0] > 512)])
    assert tokens.token_counts(df.limit(0), BYTE).count() == 0


def test_ids_equal_the_library():
    texts = odd_texts()
    want = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    ids, at = packing.Ids(WORD).of(pa.array(["left out", *texts, None])[1:])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [*want, []]


def test_ids_outlive_what_is_kept(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 2)
    kept = packing.Ids(WORD)
    for text in ("one two three four", "four five", "one", "", "two four"):
        assert kept.of(pa.array([text]))[0].tolist() == kept.tokenizer.encode(text, add_special_tokens=False).ids
    assert [len(x) for x in kept.of(pa.array([], pa.string()))] == [0, 1]


def test_packing_is_gapless(spark):
    rows = [(i, f"word{i} " * (i * 37 % 2500)) for i in range(40)] + [(7, "again"), (None, None), (50, "")]
    got = packing.pack(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(5), WORD).collect()
    at = {}
    for r in got:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for s, pieces in at.items():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 4096 or s == max(at)
    assert sum(r["length"] for r in got) == len(packing.Ids(WORD).of(pa.array([t for _, t in rows]))[0]) + len(rows)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


def test_hilbert_neighbours_touch():
    n = 8
    points = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    keys = packing.hilbert(points, 3)
    assert sorted(keys) == list(range(n**3))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute_hits(docs, items):
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER)) if w]
    index = {}
    for i, t in items:
        w = words(t)
        for j in range(len(w) - min(10, len(w)) + 1 if w and i is not None else 0):
            index.setdefault(tuple(w[j : j + min(10, len(w))]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in index}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in index:
                    hit.update(range(j, j + k))
                    found |= index[tuple(w[j : j + k])]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 24, 10])
def test_contamination_equals_brute_force(spark, limit):
    rng = random.Random(5)
    some = lambda n: [rng.choice("abcdefgh") + rng.choice("xyzé") for _ in range(n)]
    items = [(i, " ".join(some(rng.randint(1, 40)))) for i in range(12)] + [(50, "ax"), (51, None), (None, "ay az"), (3, "ax ay az"), (52, "--")]
    docs = [(i, ", ".join(some(rng.randint(0, 60)) + items[i % 12][1].split()[: rng.randint(0, 40)] + some(5))) for i in range(60)] + [(7, items[3][1]), (None, items[2][1]), (100, None), (101, "")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    got = winnow.contamination(df, spark.createDataFrame(items, "item_id long, text string"), limit).collect()
    assert sorted(((r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["hits"]), r["items"]) for r in got), key=str) == brute_hits(docs, items)


def test_contamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert winnow.contamination(docs, bench).first()["n_words"] == 2 and winnow.contamination(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("compression", [1, 5, 8, 32946, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, h + 1, (h, 70)).astype(np.uint8) for h in (1, 50)]
    got = list(tiff.pages_of(tiff.encode(pages, compression, predictor, 7, tile)))
    assert [(p.width, p.height, p.samples) for p in got] == [(70, len(x), x.tobytes()) for x in pages]


def test_lzw_past_a_full_table():
    data = np.random.default_rng(2).integers(0, 256, 30_000).astype(np.uint8).tobytes()
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_every_way_serves_every_size():
    for words in (1, 30, 3000):
        payloads = [(f"{i} word " * words).encode() for i in range(150)]
        payloads = [p + bytes(-len(p) % 64) for p in payloads]
        used = set()
        for p in payloads:
            pages = list(tiff.pages_of(tiff.stored(p)))
            assert b"".join(x.samples for x in pages) == p and tiff.stored(p) == tiff.stored(bytes(p))
            used.add((pages[0].compression, pages[0].predictor))
        assert used == {(c, p) for c, p, _ in tiff.WAYS}


@pytest.mark.parametrize("tag", [tiff.WIDTH, tiff.HEIGHT, tiff.TILE_WIDTH, tiff.ROWS_PER_STRIP])
@pytest.mark.parametrize("claim", [0, 1 << 30])
def test_sizes_that_the_file_cannot_hold(tag, claim):
    page = np.arange(64 * 64, dtype=np.uint32).astype(np.uint8).reshape(64, 64)
    raw = bytearray(tiff.encode([page], 8, tile=(64, 64) if tag == tiff.TILE_WIDTH else None))
    struct.pack_into("<I", raw, raw.index(struct.pack("<HHI", tag, 4, 1)) + 8, claim)
    if tag == tiff.ROWS_PER_STRIP and claim:  # more rows a strip than there are is allowed
        assert next(tiff.pages_of(bytes(raw))).samples == page.tobytes()
    elif tag in (tiff.WIDTH, tiff.HEIGHT) and not claim:
        assert all(p.samples == b"" for p in _pages_or_none(bytes(raw)))
    else:
        with pytest.raises(ValueError):
            list(tiff.pages_of(bytes(raw)))


def _pages_or_none(raw):
    try:
        return list(tiff.pages_of(raw))
    except ValueError:
        return []


def test_media_rows(spark):
    texts = [None, "", "a", "x" * 300, "é" * 5000, "long " * 70_000]
    df = spark.createDataFrame([(i % 5, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = sorted((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) for r in tiff.media_digests(df).collect())
    want = []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want.append((i % 5, len(raw), len(full), hashlib.sha256(full).hexdigest()))
    assert got == sorted(want)
    bad = spark.createDataFrame([(1, None), (2, b"II*"), (3, tiff.stored(b"a" * 64)[:-30])], "doc_id long, media binary")
    assert all(r["error"] and r["last"] for r in tiff.tiff_pages(bad, ["doc_id"]).collect())


def test_tiff_pages_keep_columns_of_any_name(spark):
    rows = [("k", 1, 2, tiff.stored(b"a" * 64)), ("k", 1, 3, None)]
    media = spark.createDataFrame(rows, "`a b` string, `c.d` int, `e``f` int, media binary")
    got = sorted(tuple(r)[:4] for r in tiff.tiff_pages(media, ["a b", "c.d", "e`f"]).collect())
    assert got == [("k", 1, 2, 0), ("k", 1, 3, -1)]


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.PACK_BITS, tiff.ADOBE_DEFLATE])
def test_tiff_sizes_within_what_a_compression_reaches(compression):
    page = np.zeros((4096, 1024), np.uint8)
    raw = tiff.encode([page], compression)
    assert next(tiff.pages_of(raw)).samples == page.tobytes() and page.size <= tiff.MOST_OUT[compression] * len(raw)
    with pytest.raises(ValueError, match="cannot hold"):
        tiff._page(b"\0" * 1000, {tiff.WIDTH: (1000,), tiff.HEIGHT: (tiff.MOST_OUT[compression] + 1,), tiff.BITS: (8,), tiff.COMPRESSION: (compression,), tiff.STRIP_OFFSETS: (0,), tiff.STRIP_COUNTS: (1000,)})


def test_quality_on_held_out_rows(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "of", "river", "walks", "under", "stone", "light"]) + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(20, 200)))
    bad = lambda: rng.choice([good().upper(), "buy " * 100, good().replace(" ", "%% ")])
    rows = [(i, good() if i % 3 else bad()) for i in range(600)]
    docs = spark.createDataFrame([*rows, (None, None), (601, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert len(got) == 602 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    assert quality.quality_scores(docs, labels.limit(0)).count() == 602 and quality.quality_scores(docs.limit(0), labels).count() == 0


BASE = {"assign": re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def brute_secrets(text):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if (len(m.group(1)) if name == "assign" else m.end() - m.start()) >= (8, 16, 32)[k]:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_secret_patterns_and_network(spark):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"some words é around {rng.choice(['token = ', 'PassWord:', 'api_key=', 'x '])}{hexes(40)} and {i} more words-of-{i}-text" for i in range(200)] + [f"plain text number {i} without anything 2024-01-{i:02d}" for i in range(60)] + [None, "", "token=short", "AKIA" + "B" * 12, "secret: 'abcdefgh'"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, found int")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(df)).collect()}
    assert all(got[i]["base_sha256"] == hashlib.sha256(brute_secrets(t).encode()).hexdigest() for i, t in enumerate(texts))
    assert secrets.scan(df.limit(0)).count() == 0
    net = secrets.fit_network(df)
    inside = lambda t, own: secrets.window(t, t.index(own), t.index(own) + len(own))
    own = hexes(36)
    scores = net.probability(np.array([inside(f"and then {own} as said", own), inside("and then words-of-text here", "words-of-text")]))
    assert scores[0] > 0.8 > 0.2 > scores[1]


def test_secrets_that_nothing_introduces_are_added_as_brute_force_says(spark):
    rng = random.Random(3)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 12)))
    prose = lambda n: " ".join(word() for _ in range(n))
    address = lambda i: f"{word()}.{i}@mail{i % 9}.example.com"
    labelled = [f"{prose(30)} {rng.choice(['token = ', 'api_key: ', ''])}{hexes(40)} {prose(20)} {address(i)} {prose(9)}" for i in range(300)]
    planted = [f"{prose(12)} {hexes(rng.randint(24, 31))} {prose(6)}" for _ in range(40)] + [f"blob {'words9and' * 60}{hexes(28)} end"]
    clean = [f"{prose(12)} chapter-{i} of {address(i)} {prose(5)}" for i in range(100)]
    texts = labelled + planted + clean + [None, "", "a1" * 20_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    net = secrets.fit_network(df)
    got = {r["doc_id"]: {(s["start"], s["end"]) for s in r["found"] if s["kind"] == "cnn"} for r in secrets.scan(df).collect()}
    token = re.compile("[A-Za-z0-9+/_.=-]{8,}")
    for i, text in enumerate(texts):
        taken = {p for s in brute_secrets(text).split(",") if s for p in range(*map(int, s.split(":")[1:]))}
        want = set()
        for m in token.finditer(text or ""):
            own = m.group().rstrip(".")
            span = range(m.start(), m.start() + len(own))
            if len(own) >= 8 and re.search("[0-9]", own) and re.search("[A-Za-z]", own) and not taken & set(span):
                pieces = [max(span.start, min(a, span.stop - 48)) for a in span[::48]]
                rows = np.array([secrets.window(text, a, min(a + 48, span.stop)) for a in pieces])
                if net.probability(rows).max() >= net.threshold:
                    want.add((span.start, span.stop))
        assert got[i] == want, text
    first = len(labelled)
    assert sum(bool(got[i]) for i in range(first, first + len(planted))) >= 0.9 * len(planted)
    assert not any(got[i] for i in range(first + len(planted), first + len(planted) + len(clean)))


PII = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def brute_pii(text):
    def holds(kind, value):
        digits = re.sub("[^0-9]", "", value)
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 13 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in p.finditer(text or "") if holds(k, m.group()))


def test_personal_data_equals_brute_force(spark):
    rng = random.Random(5)
    pool = ["a@b.c", "_x", "@", "1.2.3.4", ".5", "+1 (234) 555-7890", "4111 1111 1111 1111", "4111-1111-1111-1111", "  ", "-", " ", "a", "é🙂", "", "255.255.255.256", "0", "9", "12", "+", "(", ").", "$1", "\\", "x.y@é.com", "\n", "00256.1.1.1", "007.1.2.3"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(800)] + [None, "", "1" * 20_000, "a" * 20_000 + "@", "+1" + "(" * 5000, "1 " * 8000]
    found = pii.find(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int"))
    got = {r["doc_id"]: r["base_sha256"] for r in pii.digest(found).collect()}
    assert len(got) == len(texts) and all(got[i] == hashlib.sha256(brute_pii(t).encode()).hexdigest() for i, t in enumerate(texts))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_spans_that_overlap_are_generalised_as_one(spark):
    texts = ["at 10.0.0.18 4111 1111 1111 1111 end", "10.0.0.1 +1 234 567 8901", "+49 4111 1111 1111 1111!", "a@1.2.3.4 b"]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), disclosure=9.0)
    got = {r["doc_id"]: (r["t"], r["spans"]) for r in found.select("doc_id", "spans", pii.sanitised(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got[0][0] == "at <IP> end" and {s["kind"] for s in got[0][1]} == {"ip", "card"}
    for i, text in enumerate(texts):
        inside = {p for s in got[i][1] for p in range(s["start"], s["end"])}
        assert re.sub("<[A-Z]+>", "", got[i][0]) == "".join(c for p, c in enumerate(text) if p not in inside)


def test_terms_of_rare_entities_disclose(spark):
    one = "note of Kim for kim@example.org about rain\n金 4111 1111 1111 1111 common"
    rows = [(1, one)] * 5 + [(2, "Ann wrote from 10.1.2.3 today"), (3, "more by Ann, 10.1.2.3 and rain")]
    rows += [(10 + i, f"note {i} of what was wrote for all about and from rain, today more by common") for i in range(60)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.sanitised(F.col("text"), F.col("spans")).alias("t"))
    got = {r["doc_id"]: r["t"] for r in found.collect()}
    assert got[1] == "note of <TERM> for <EMAIL> about rain\n<TERM> <CARD> common"
    assert got[2] == "<TERM> wrote from <IP> today" and got[3] == "more by <TERM>, <IP> and rain"
    assert all(got[d] == t for d, t in rows if d >= 10)


def test_terms_that_disclose_are_generalised(spark):
    rows = [(i, f"report {i} of common matters\nwrite to jane.roe@example.org about zanzibar today") for i in range(4)]
    rows += [(100 + i, f"note {i}: today all is common, write about other matters") for i in range(40)] + [(200, "zanzibar"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(docs, disclosure=0.8).select("doc_id", pii.sanitised(F.col("text"), F.col("spans")).alias("t"))
    got = {r["doc_id"]: r["t"] for r in found.collect()}
    assert got[0] == "report 0 of common matters\nwrite to <EMAIL> about <TERM> today"
    assert got[200] == "zanzibar" and got[105] == rows[9][1] and got[4] == ""


def brute_terms(texts, disclosure, z):
    """For each text its terms that disclose one of its entities, by the definition over pairs of sets of texts."""
    word = re.compile("[a-z0-9_'-]{3,}")
    taken_out = "|".join(p.pattern for k, p in PII.items() if k != "card") + r"|[0-9]([\x20-]?[0-9]){12,}"
    values = [{m.group() for k, p in PII.items() for m in p.finditer(t) if brute_pii(m.group()) == f"{k}:0:{len(m.group())}"} for t in texts]
    terms = [set(word.findall(t.lower())) for t in texts]
    distinct = sorted(set(texts))
    first = [texts.index(t) for t in distinct]
    n_term, n_entity, n_both = Counter(), Counter(), Counter()
    for i in first:
        n_term.update(terms[i])
        n_entity.update(values[i])
        near = set()
        for raw, line in zip(texts[i].split("\n"), re.sub(taken_out, " ", texts[i]).lower().split("\n")):
            near |= {(e, t) for e in values[i] if e in raw for t in word.findall(line)}
        n_both.update(near)

    def discloses(e, t):
        k, n, content = n_both[e, t], n_term[t], math.log(len(first) / n_entity[e])
        if z is None:
            share = k / n
        elif k < 2:
            share = 0
        else:
            k, n = k - 1, n - 1
            p = k / n
            share = (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)
        return content > 0 and share > 0 and math.log(share * len(first) / n_entity[e]) >= disclosure * content

    telling = [(e, t) for e, t in n_both if discloses(e, t)]
    return [{t for e, t in telling if e in values[i] and t in terms[i]} for i in range(len(texts))]


def named_corpus():
    """Six people of whom some texts tell the address, four of them by a name that nobody else has; a rare word on every line."""
    rng = random.Random(9)
    pool = [f"word{i}" for i in range(60)]
    texts = []
    for i in range(600):
        line = rng.sample(pool, 8) + [f"rare{i}"]
        if i < 48:
            who = i % 6
            line += [f"name{who}" if who < 4 else "chris", f"user{who}@example.org"]
        elif i < 96:
            line += ["chris"]
        rng.shuffle(line)
        texts.append(" ".join(rng.sample(pool, 5)) + "\n" + " ".join(line))
    return [*texts, texts[0], texts[0], "", "10.0.0.1"]


@pytest.mark.parametrize("evidence", [{}, pii.EVIDENCE])
def test_terms_that_disclose_equal_brute_force(spark, evidence):
    texts = named_corpus()
    found = pii.find(spark.createDataFrame([(i, t, "e", 0) for i, t in enumerate(texts)], "doc_id long, text string, entity string, at int").repartition(3), **evidence)
    got = {r["doc_id"]: {s["value"].lower() for s in r["spans"] if s["kind"] == "term"} for r in found.collect()}
    want = brute_terms(texts, evidence.get("disclosure", 0.95), evidence.get("z"))
    assert [got[i] for i in range(len(texts))] == want
    if evidence:  # by other texts: the names, and no word of one text alone
        assert set().union(*want) == {f"name{i}" for i in range(4)} and sum(map(bool, want)) == 34
    else:
        assert sum(t.startswith("rare") for some in want for t in some) == 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_terms_by_other_texts_on_odd_rows(spark):
    rows = [(1, None), (None, "a b@c.de zed"), (2, ""), (3, "solo x@y.zz " * 3000), (3, "solo x@y.zz " * 3000), (4, "\n" * 5000 + "word x@y.zz")]
    df = spark.createDataFrame([(d, t, 0, "k") for d, t in rows], "doc_id long, text string, total int, term string")
    found = pii.find(df, **pii.EVIDENCE).collect()
    assert len(found) == len(rows) and not any(s["kind"] == "term" for r in found for s in r["spans"])
    assert pii.find(df.limit(0), **pii.EVIDENCE).count() == 0


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 300)), max_size=12))
@settings(max_examples=200, deadline=None)
def test_codecs_give_back_runs(runs):
    data = b"".join(bytes((b,)) * n for b, n in runs)
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data and tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_codecs_on_literal_bytes():
    # by hand: three 9-bit codes 97, 98, 258 ("ab") and the end
    assert tiff.lzw(b"abab") == int("001100001" "001100010" "100000010" "100000001" "0000", 2).to_bytes(5, "big")
    assert tiff.pack_bits(b"aaab" + b"c" * 130) == bytes((254, 97, 0, 98, 129, 99, 255, 99))
