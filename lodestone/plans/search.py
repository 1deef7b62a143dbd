"""Hybrid search over a store: both branches, fusion, sections, neighbours, context."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.embedding import Embedder
from lodestone.operators import retrieval as S
from lodestone.sources.store import Store

SECTION = ["package", "document_stem", "heading_path"]


def required(text: str, what: str = "query") -> str:
    if not text.strip():
        raise ValueError(f"the {what} is blank")
    return text.strip()


def search(store: Store, embedder: Embedder, query: str, package: str | None = None, document: str | None = None, limit: int = S.RESULT_LIMIT) -> DataFrame:
    """Ranked chunks with their position, ranks, score, neighbours and expansion."""
    query = required(query)
    if limit <= 0:
        raise ValueError("the limit must be positive")
    rows = store.rows()
    where = F.lit(True)
    if package is not None:
        where = where & (F.col("package") == required(package, "package"))
    if document is not None:
        where = where & (F.col("document_stem") == required(document, "document"))
    mine = rows.where(where)
    if mine.isEmpty():
        semantic = mine.select("chunk_id", F.lit(1).alias("semantic_rank"))
    else:
        semantic = store.semantic(embedder.embed([query])[0], where=where)
    terms = re.findall(r"[^\W_]+", query.lower())
    fts = store.lexical(terms, S.LEXICAL_LIMIT, where)
    branches = [S.exact_stem_hits(mine, query), S.exact_filename_hit(mine, query), fts.select("chunk_id", F.col("lexical_rank").alias("position"))]
    lexical = S.merge_ranked(branches, "chunk_id", S.LEXICAL_LIMIT).withColumnRenamed("position", "lexical_rank")
    fused = S.fuse(semantic, lexical, "chunk_id")
    from pyspark.sql import Window

    placed = rows.join(F.broadcast(fused), "chunk_id").select("chunk_id", *SECTION, "semantic_rank", "lexical_rank", "rrf_score")  # at most 40 rows
    best = S.best_of_sections(placed, SECTION, "chunk_id").orderBy(*S.result_order("chunk_id")).limit(limit)
    primaries = best.select("chunk_id", F.row_number().over(Window.orderBy(*S.result_order("chunk_id"))).alias("result_position"), "rrf_score", "semantic_rank", "lexical_rank")
    expanded = S.expand(primaries, rows.select("chunk_id", *SECTION, "chunk_ordinal"), limit)
    # neighbours are of one document: only the results' documents are looked at, limit rows at most
    documents = F.broadcast(rows.join(F.broadcast(expanded.select("chunk_id")), "chunk_id", "left_semi").select("package", "document_stem").distinct())
    near = rows.join(documents, rows["package"].eqNullSafe(documents["package"]) & (rows["document_stem"] == documents["document_stem"]), "left_semi")
    sections = S.with_neighbors(near.select("chunk_id", *SECTION, "chunk_ordinal"), SECTION, ["chunk_ordinal", "chunk_id"], "chunk_id", ("section_previous", "section_next"))
    few = F.broadcast(expanded)
    return rows.select("chunk_id", *SECTION, "document_hash", "chunk_ordinal", "frontmatter", "text", "token_count").join(few, "chunk_id").join(sections.select("chunk_id", "section_previous", "section_next"), "chunk_id")


def context(store: Store, embedder: Embedder, query: str, package: str | None = None, document: str | None = None, limit: int = S.RESULT_LIMIT) -> DataFrame:
    return S.assemble_context(search(store, embedder, query, package, document, limit), query, limit)
