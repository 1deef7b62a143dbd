"""Indexing as a stream: new and changed files by micro-batch, with an append-only progress table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.embedding import Embedder
from lodestone.functions.markdown import Config
from lodestone.plans.reconcile import reconcile
from lodestone.sources.discovery import with_names
from lodestone.functions.text import is_stem
from lodestone.sources.store import Store

PROGRESS = "batch long, at timestamp, step string, package string, document_stem string, message string"


def progress_rows(spark: SparkSession, batch_id: int, result: dict) -> DataFrame:
    rows = [(batch_id, step, None, None, str(result[key])) for step, key in (("indexed", "reindexed"), ("unchanged", "skipped"), ("deleted", "deleted"))]
    rows += [(batch_id, "failed", f["package"], f["document_stem"], f"{f['error_kind']}: {f['error']}") for f in result["failures"]]
    df = spark.createDataFrame(rows, "batch long, step string, package string, document_stem string, message string")
    return df.select("batch", F.current_timestamp().alias("at"), "step", "package", "document_stem", "message")


def index_stream(spark: SparkSession, root: str, store: Store, embedder: Embedder, checkpoint: str, progress: str, config: Config = Config(), files_per_batch: int = 1000, corpus: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Index files below ``root`` as they come, then stop; run again to go on from the checkpoint.

    A stream of files never tells of deletions, so every batch's documents are joined with those the
    store has; ``corpus``, if given, is asked instead for all documents as they are now.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)

    def handle(rows: DataFrame, batch_id: int) -> None:
        s = rows.sparkSession
        named = with_names(rows).where(F.col("extension").isin("md", "markdown") & is_stem(F.col("document_stem")))
        fresh = named.select("package", "document_stem", "path", F.sha2("content", 256).alias("document_hash"), "content")
        if corpus is not None:
            documents = corpus()
        else:
            store.ensure()
            known = store.rows().select("package", "document_stem", "document_hash").distinct()
            others = known.join(fresh.select("package", "document_stem"), known["package"].eqNullSafe(fresh["package"]) & (known["document_stem"] == fresh["document_stem"]), "left_anti")
            # documents that aren't in this batch count as they are in the store
            documents = fresh.unionByName(others.select("package", "document_stem", F.lit("").alias("path"), "document_hash", F.lit(None).cast("binary").alias("content")))
        result = reconcile(s, store, documents, embedder, config)
        progress_rows(s, batch_id, result).write.mode("append").parquet(progress)

    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
