"""The subpackage's registered queries; each applies its operator to its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, collocations, media, ngram_join, packing, preferences, quality, suffix_dedup, surrogates, templates, toxicity, whitening, winnowing
from lodestone.llm.common import shared_dir, stored, table

#: A deployment passes a secret of its own.
KEY = b"lodestone surrogate key"
VOCABULARY = "word_bpe_49k.json"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = stored(quality.measured(table(spark, sf_dir, "documents")), f"{shared_dir(spark)}/statistics")
    return quality.scored(statistics, quality.fit(statistics, table(spark, sf_dir, "labels")))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY, count_col="n_entities")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = stored(media.stored_media(table(spark, sf_dir, "documents")), f"{shared_dir(spark)}/media")
    shown = media.resolved(media.sequences(kept, "doc_id", "html"), media.read_back(kept)).where("kind = 'media'")
    return shown.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("digest").alias("media_sha256"), "feature", "position", "caption")


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.formatted(preferences.against_neighbours(table(spark, sf_dir, "conversations")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=2, capacity=4096, keep_ids=False).drop("ids")


def op7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_slots")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.fingerprints_beside_next(table(spark, sf_dir, "documents"))
    own, edited, following = (winnowing.hashes(F.col(c)) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    name = lambda c: F.sha2(F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).cast("binary"), 256)
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        name("fingerprint").alias("fingerprint"),
        name("edited_fingerprint").alias("edited_fingerprint"),
        winnowing.likeness(own, edited).alias("near_edited"),
        winnowing.likeness(own, following).alias("near_next"),
        F.col("fingerprint").alias("marks"),  # hashes with their positions
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best(collocations.collocations(table(spark, sf_dir, "documents")), 2000)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_quality": op2_quality,
        "op3_surrogates": op3_surrogates,
        "op4_media": op4_media,
        "op5_preferences": op5_preferences,
        "op6_packing": op6_packing,
        "op7_templates": op7_templates,
        "op8_winnowing": op8_winnowing,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_bpe": op10_bpe,
        "op11_collocations": op11_collocations,
        "op12_whitening": op12_whitening,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_preferences": preferences.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL}
