import random

import corpus_pipeline


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(3)
    names = [f"{a}{b}" for a in ("ri", "sto", "li", "wa", "mo", "ne", "ta") for b in ("ver", "ne", "ght", "lk", "on", "st", "le")]
    good = lambda n: " ".join(rng.choice(names) for _ in range(n))
    rows = [(i, good(80)) for i in range(40)] + [(100 + i, "BUY!! " * 60) for i in range(10)]
    item = good(20)
    rows += [(60, rows[0][1]), (61, rows[1][1] + " tail"), (62, good(40) + " " + item + " " + good(10)), (63, good(50) + " mail a.b@example.com now"), (None, good(70))]
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 100), 0) for d, _ in rows if d is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept["quality"]) == {d for d, _ in rows if d is None or d < 100}
    assert set(kept["quality"]) - set(kept["near_dedup"]) == {60, 61}
    assert set(kept["near_dedup"]) - set(kept["decontaminate"]) == {62}
    assert "<EMAIL>" in kept["sanitise"][63] and set(kept["sanitise"]) == set(kept["decontaminate"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == set(kept["sanitise"])


def test_stages_decide_by_row_and_keep_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item = words(20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak, clean = words(10) + " " + item, words(30)
    rows = [(None, leak), (None, clean), (7, leak), (7, clean), (8, clean + " mail a.b@example.com"), (9, None)]
    extra = ("score", "rows", "id", "key", "safe", "hits", "doc", "rep")
    docs = spark.createDataFrame([(d, t, *range(len(extra))) for d, t in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in extra))
    kept = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES[1:4]}
    assert all(df.columns == docs.columns for df in kept.values())
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert pairs(kept["decontaminate"]) == sorted([r for r in rows if r[1] != leak], key=str)
    safe = next(t for d, t in pairs(kept["sanitise"]) if d == 8)
    assert safe.startswith(clean) and safe.endswith("<EMAIL>") and "a.b@" not in safe and len(pairs(kept["sanitise"])) == len(rows)
    assert {d for d, _ in pairs(kept["near_dedup"])} == {None, 7, 9}


def test_stages_on_empty_tables_and_a_long_text(spark, tmp_path):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    labels = "doc_id long, quality int, toxic int"
    for name, rows, marks in (("none", [], []), ("long", [(i, f"{long} tail{i}", "en", "s", 1) for i in range(2)] + [(2, "", "en", "s", 0)], [(i, 1, 0) for i in range(3)])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, docs).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(marks, labels).write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        pieces = corpus_pipeline.run(spark, sf).collect()
        ids = {r["doc_id"] for r in pieces}
        # the near copy goes; the pieces of the long text are whole
        assert ids == ({0, 2} if rows else set())
        for d in ids:
            own = sorted((r["start"], r["length"]) for r in pieces if r["doc_id"] == d)
            assert [x for x, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
            assert sum(n for _, n in own) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == d)
