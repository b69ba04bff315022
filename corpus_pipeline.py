"""From raw documents to packed training sequences.

The stages apply the operators of chainmetrics.llm with the corpus's own words: near-duplicates and other word
shingles of five words, a similarity of 0.8. Every stage but the last returns the columns of documents, those of the
rows that it keeps; a null or empty text is a document like any other. A doc_id that is null, or that rows repeat,
is kept by all stages but the second, which keeps one row of it a text (see there).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainmetrics.llm import pii
from chainmetrics.llm.minhash import near_duplicates
from chainmetrics.llm.packing import pack
from chainmetrics.llm.quality import fit_quality, scored
from chainmetrics.llm.winnow import contamination
from chainmetrics.session import ship

QUALITY = 0.3
TOKENIZER = "word_bpe_49k.json"


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no name of theirs can clash with a stage's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores QUALITY or more; the model is fitted on the labels of sf_dir."""
    ship(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = scored(docs.select(whole(docs).alias("doc"), "text"), model).where(F.col("score") >= QUALITY)
    return kept.select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates; documents without an id are not told apart and stay.

    Rows that repeat a kept doc_id stay as one row for each text.
    """
    ship(spark)
    found = near_duplicates(docs, shingle=5, percent=80)
    kept = found.where("kept").groupBy("doc_id").agg(F.count("*").alias("rows"))
    out = docs.select(whole(docs).alias("doc"), "doc_id", "text").join(kept, "doc_id")
    once, more = out.where("rows = 1").select("doc.*"), out.where("rows > 1").dropDuplicates(["doc_id", "text"]).select("doc.*")
    return once.unionByName(more).unionByName(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no window of a benchmark item, whatever their doc_id: each row goes through as its own id."""
    ship(spark)
    found = contamination(docs.select(whole(docs).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hits") == 0).select("doc_id.*")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, generalised to their kind; n_chars is counted anew."""
    found = pii.find(docs, **pii.EVIDENCE)
    changed = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), pii.sanitised(F.col("text"), F.col("spans")).alias("safe")).dropDuplicates(["id", "key"])
    keyed = docs.select(whole(docs).alias("doc"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"))
    joined = keyed.join(changed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tkey") == F.col("key")), "left")
    own = {"text": F.coalesce("safe", F.col("doc.text"))}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("safe").isNull(), F.col("doc.n_chars")).otherwise(F.length("safe")).cast(docs.schema["n_chars"].dataType)
    return joined.select([own.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their token ids."""
    ship(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("sanitise", sanitise), ("packing", packing)]
#: The model, the tokenizer and the curve have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages make of the documents of sf_dir. What a stage keeps is written before the next reads it."""
    from chainmetrics.llm.common import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
