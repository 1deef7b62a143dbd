"""From documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the rows that the next one works on: documents
that pass for good, one document of each group of near duplicates, texts without repeated passages,
texts without personal data, packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import ngram_join, packing, quality, sketch, suffix_dedup, surrogates
from lodestone.llm.common import drop, shared_dir, small_batches, stored, sweep, table

#: A deployment passes a secret of its own.
KEY = b"lodestone surrogate key"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    sweep(spark)
    path = f"{shared_dir(spark)}/statistics"
    model = quality.fit(stored(quality.measured(docs), path), table(spark, sf_dir, "labels"))
    drop(spark, path)
    return quality.keep(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that n-gram Jaccard links join: that of the smallest id, null being the last.

    Where rows of a group share that id, the smallest set's digest, then the smallest row counts. Rows
    of one id in different groups are judged each by its own; rows without words are in no group and stay.
    """
    sweep(spark)
    path = shared_dir(spark)
    joined = stored(ngram_join.join(docs, nodes=True), f"{path}/joined")
    # an id of one row tells what becomes of it; null and repeated ids don't
    several = stored(joined.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), f"{path}/several")
    unclear = not several.isEmpty() or not joined.where("doc_id is null").isEmpty()
    others = joined.where("component_id <> doc_id").select("doc_id").union(several).distinct()
    others = stored(others, f"{path}/others")
    may, rest = sketch.parted(docs, "doc_id", others)
    out = may.join(others, "doc_id", "left_anti").select(docs.columns).union(rest.where("doc_id is not null") if unclear else rest)
    return out.union(_judged(docs, joined, several)) if unclear else out


def _judged(docs: DataFrame, joined: DataFrame, several: DataFrame) -> DataFrame:
    """What stays of the rows whose id is null or repeated."""
    may, _ = sketch.parted(docs, "doc_id", several)
    rows = ngram_join.digested(may.join(several, "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null")))
    first = joined.where("digest is not null and doc_id <=> component_id").groupBy("root", "doc_id").agg(F.min("digest").alias("__digest"))
    first = first.select(F.col("doc_id").alias("__id"), "__digest")
    kept = rows.join(first, rows["doc_id"].eqNullSafe(first["__id"]) & (rows["__digest"] == first["__digest"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", "__digest").orderBy(*docs.columns))
    return kept.withColumn("__nth", nth).where("__nth = 1").select(docs.columns).union(rows.where("__digest is null").select(docs.columns))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller id has."""
    sweep(spark)
    return suffix_dedup.shortened(docs, size_col="n_chars")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets."""
    sweep(spark)
    small_batches(spark)
    return surrogates.replaced(docs, KEY).withColumn("n_chars", F.char_length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    sweep(spark)
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096, keep_ids=False).drop("ids")


STAGES = [("quality", good), ("ngram_join", distinct), ("suffix_dedup", unrepeated), ("pii", private), ("packing", packed)]
#: The stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
