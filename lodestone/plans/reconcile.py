"""Incremental indexing: the store follows the corpus by content hash, in one set-based pass."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.embedding import Embedder, embedded
from lodestone.functions.markdown import Config
from lodestone.functions.text import search_text
from lodestone.operators import markdown, relational
from lodestone.sources.store import SCHEMA, Store

DOCUMENT = ["package", "document_stem"]


def reconcile(spark: SparkSession, store: Store, documents: DataFrame, embedder: Embedder, config: Config = Config()) -> dict:
    """Bring the store to documents(package, document_stem, document_hash, path, content); counts and failures.

    Stale documents go; unchanged ones are skipped; the others are chunked, embeddings of unchanged
    chunks are taken over. A document that fails to extract, chunk or embed keeps its old rows, one without
    text loses them. Of several files of one document the last by path counts, the others are failures.
    """
    if (embedder.model, embedder.dimension) != (store.model, store.dimension):
        raise ValueError("the embedder isn't the store's")
    store.ensure()
    last = Window.partitionBy(*DOCUMENT).orderBy(F.split("path", "/").desc())
    ranked = documents.withColumn("__n", F.row_number().over(last)).persist()
    found = ranked.where("__n = 1").drop("__n")
    doubles = ranked.where("__n > 1").select(*DOCUMENT, F.lit("duplicate_document").alias("error_kind"), F.col("path").alias("error"))
    old = store.rows()
    stale = relational.stale(old.select(*DOCUMENT).distinct(), found, DOCUMENT).persist()
    work = relational.changed(found, old.select(*DOCUMENT, "document_hash").distinct(), DOCUMENT, "document_hash")
    chunked = markdown.chunks(work, config).persist()
    failed = chunked.where("status = 'failed'").select(*DOCUMENT, "error_kind", "error")
    fresh = chunked.where("status = 'chunked'")
    known = old.select(*DOCUMENT, "chunk_hash", "embedding")
    with_old = relational.reuse(fresh, known, [*DOCUMENT, "chunk_hash"]).persist()
    hits, misses = with_old.where("embedding is not null"), with_old.where("embedding is null").drop("embedding")
    # the embedder runs once: its rows are read by the count of failures and by the write
    made = embedded(misses, embedder).persist(StorageLevel.DISK_ONLY)
    unembedded = made.where("embedding is null").groupBy(*DOCUMENT).agg(F.min("embedding_error").alias("error"))
    unembedded = unembedded.select(*DOCUMENT, F.lit("embedding").alias("error_kind"), "error").persist()
    whole = lambda df: df.join(unembedded, relational.null_safe(df, unembedded, DOCUMENT), "left_anti")
    fresh = whole(fresh)
    failed = failed.unionByName(unembedded)
    rows = whole(hits.unionByName(made.drop("embedding_error")))
    rows = rows.withColumns({
        "search_text": search_text(F.col("document_stem"), F.col("heading_path"), F.col("text")),
        "embedding_model": F.lit(store.model), "embedding_dimension": F.lit(store.dimension),
    }).select(*SCHEMA.names)
    emptied = failed.where("error_kind = 'no_chunks'").select(*DOCUMENT)
    gone = stale.unionByName(emptied).unionByName(fresh.select(*DOCUMENT)).distinct()
    n_stale, n_fresh, n_found = stale.count(), fresh.select(*DOCUMENT).distinct().count(), found.count()
    failures = [r.asDict() for r in failed.unionByName(doubles).orderBy(F.asc_nulls_first("package"), "document_stem").collect()]
    n_work = n_fresh + sum(f["error_kind"] != "duplicate_document" for f in failures)
    if n_stale or n_fresh or any(f["error_kind"] == "no_chunks" for f in failures):
        store.merge(gone, rows)
    out = {"skipped": n_found - n_work, "reindexed": n_fresh, "deleted": n_stale, "embedded": misses.count(), "failures": failures}
    for df in (ranked, stale, chunked, with_old, made, unembedded):
        df.unpersist()
    return out
