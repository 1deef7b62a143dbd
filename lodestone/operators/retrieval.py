"""Retrieval: nearest neighbours, BM25, exact matches, rank fusion, section handling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import term_count, word_count

SEMANTIC_LIMIT = LEXICAL_LIMIT = 20
RESULT_LIMIT = 8
RRF_K = 60
BM25_K1, BM25_B = 1.2, 0.75


def squared_distance(embedding: Column, query: Sequence[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(embedding, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def semantic_topk(df: DataFrame, query: Sequence[float], key: str, embedding: str = "embedding", k: int = SEMANTIC_LIMIT, where: Column | None = None) -> DataFrame:
    """The k rows nearest to the query: key, semantic_rank. The filter holds before the ranking; ties go to the smaller key.

    Only (key, distance) reaches the top-k, which is partial in each task; the rank is over k rows.
    """
    df = df.where(where) if where is not None else df
    near = df.select(key, squared_distance(F.col(embedding), query).alias("distance")).orderBy("distance", key).limit(k)
    return near.select(key, F.row_number().over(Window.orderBy("distance", key)).alias("semantic_rank"))


def bm25_scores(df: DataFrame, terms: Sequence[str], key: str, text: str, where: Column | None = None) -> DataFrame:
    """key, score of the rows that hold a term. Counts are over the whole table, the filter is on candidates only.

    Terms are counted in place, without exploding texts; the statistics are one row.
    """
    terms = sorted(set(terms))
    counted = df.select("*", word_count(F.lower(F.col(text))).alias("__dl"), *(term_count(F.col(text), t).alias(f"__tf{i}") for i, t in enumerate(terms)))
    stats = counted.agg(F.count("*").alias("n"), F.avg("__dl").alias("avg"), *(F.count_if(F.col(f"__tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    n, avg = stats["n"], stats["avg"] or 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        tf = F.col(f"__tf{i}").cast("double")
        score = score + F.lit(idf) * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("__dl") / F.lit(avg)))
    hits = counted.where(where) if where is not None else counted
    return hits.select(key, score.alias("score")).where("score > 0")


def lexical_topk(df: DataFrame, terms: Sequence[str], key: str, text: str, k: int = LEXICAL_LIMIT, where: Column | None = None) -> DataFrame:
    """key, lexical_rank, score of the k best rows."""
    best = bm25_scores(df, terms, key, text, where).orderBy(F.desc("score"), key).limit(k)
    return best.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("lexical_rank"), "score")


def postings(df: DataFrame, key: str, text: str, *others: str) -> DataFrame:
    """An index: term, key, others, tf, length (words of the row's text)."""
    words = df.select(key, *others, F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"))
    listed = words.select(key, *others, F.size("words").alias("length"), F.explode("words").alias("term"))
    return listed.groupBy("term", key, *others, "length").agg(F.count("*").cast("int").alias("tf"))


def text_size(df: DataFrame, text: str) -> tuple[int, float]:
    """Number of rows and their mean words."""
    r = df.agg(F.count("*").alias("n"), F.avg(word_count(F.lower(F.col(text)))).alias("mean")).first()
    return r["n"], r["mean"] or 0.0


def indexed_topk(listed: DataFrame, n: int, mean: float, terms: Sequence[str], key: str, k: int = LEXICAL_LIMIT, where: Column | None = None) -> DataFrame:
    """lexical_topk over a stored index of n rows: only the query's terms are read. The filter is on what postings hold.

    A row's parts are added up in the order of the terms, so that equal rows tie.
    """
    hits = listed.where(F.col("term").isin(sorted(set(terms))))
    df = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}  # one row a term of the query
    if not df:
        return hits.select(key, F.lit(0).alias("lexical_rank"), F.lit(0.0).alias("score")).limit(0)
    hits = hits.where(where) if where is not None else hits
    idf = F.create_map(*(F.lit(x) for t, m in df.items() for x in (t, math.log(1 + (n - m + 0.5) / (m + 0.5)))))
    part = idf[F.col("term")] * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.lit(mean or 1.0)))
    parts = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", part.alias("part")))).alias("parts"))
    best = parts.select(key, F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return best.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("lexical_rank"), "score")


def exact_stem_hits(chunks: DataFrame, query: str) -> DataFrame:
    """The first chunk of each stem that the query names, with or without a Markdown suffix: chunk_id, position."""
    names = sorted({query, query.removesuffix(".md"), query.removesuffix(".markdown")})
    first = Window.partitionBy("document_stem").orderBy("chunk_ordinal", "chunk_id")
    hits = chunks.where(F.col("document_stem").isin(names)).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return hits.select("chunk_id", F.row_number().over(Window.orderBy("document_stem")).alias("position"))


def exact_filename_hit(chunks: DataFrame, query: str) -> DataFrame:
    """The first chunk whose search text holds a file name: chunk_id, position."""
    if not query.endswith((".md", ".markdown")):
        return chunks.select("chunk_id", F.lit(1).alias("position")).limit(0)
    return chunks.where(F.col("search_text").contains(query)).orderBy("chunk_ordinal", "chunk_id").limit(1).select("chunk_id", F.lit(1).alias("position"))


def merge_ranked(branches: Sequence[DataFrame], key: str, k: int) -> DataFrame:
    """Branches(key, position) one after another, each key once, where it first comes: key, position."""
    every = [b.select(key, "position", F.lit(i).alias("branch")) for i, b in enumerate(branches)]
    rows = every[0]
    for b in every[1:]:
        rows = rows.unionByName(b)
    first = rows.groupBy(key).agg(F.min(F.struct("branch", "position")).alias("at")).orderBy("at", key).limit(k)
    return first.select(key, F.row_number().over(Window.orderBy("at", key)).alias("position"))


def rank_term(rank: Column) -> Column:
    """1 / (60 + rank) as a single-precision number, 0 without a rank; the denominator stays below 2**16."""
    return F.when(rank.isNull(), F.lit(0.0)).otherwise(F.lit(1.0) / F.least(rank + RRF_K, F.lit(65535))).cast("float")


def fuse(semantic: DataFrame, lexical: DataFrame, key: str) -> DataFrame:
    """Full outer join of the branches: key, semantic_rank, lexical_rank, rrf_score (single precision)."""
    both = semantic.select(key, "semantic_rank").join(lexical.select(key, "lexical_rank"), key, "full_outer")
    return both.withColumn("rrf_score", (rank_term(F.col("semantic_rank")) + rank_term(F.col("lexical_rank"))).cast("float"))


def result_order(key: str) -> list[Column]:
    return [F.desc("rrf_score"), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("lexical_rank"), F.asc(key)]


def best_of_sections(fused: DataFrame, section: Sequence[str], key: str) -> DataFrame:
    """The first row of each section in result order."""
    w = Window.partitionBy(*section).orderBy(*result_order(key))
    return fused.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_neighbors(chunks: DataFrame, group: Sequence[str], order: Sequence[str], key: str, names: tuple[str, str] = ("previous_chunk_id", "next_chunk_id")) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return chunks.withColumns({names[0]: F.lag(key).over(w), names[1]: F.lead(key).over(w)})


def expand(primaries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Primaries, then their neighbours of the same section until ``limit`` rows.

    primaries(chunk_id, result_position, rrf_score, semantic_rank, lexical_rank), at most ``limit`` rows,
    so they are the broadcast side; chunks(chunk_id, package, document_stem, heading_path, chunk_ordinal).
    """
    order = Window.partitionBy("package", "document_stem").orderBy("chunk_ordinal", "chunk_id")
    keys = F.broadcast(primaries.select("chunk_id"))
    documents = chunks.join(keys, "chunk_id", "left_semi").select("package", "document_stem").distinct()  # at most limit rows
    same = chunks["package"].eqNullSafe(documents["package"]) & (chunks["document_stem"] == documents["document_stem"])
    placed = chunks.join(F.broadcast(documents), same, "left_semi").withColumn("__at", F.row_number().over(order))
    base = primaries.join(placed.select("chunk_id", "package", "document_stem", "heading_path", "__at"), "chunk_id")
    near = placed.select(F.col("chunk_id").alias("n_id"), F.col("package").alias("n_p"), F.col("document_stem").alias("n_s"), F.col("heading_path").alias("n_h"), F.col("__at").alias("n_at"))
    beside = base.join(
        near,
        F.col("package").eqNullSafe(F.col("n_p")) & (F.col("document_stem") == F.col("n_s")) & (F.col("heading_path") == F.col("n_h")) & (F.abs(F.col("n_at") - F.col("__at")) == 1),
    )
    found = beside.select(F.col("n_id").alias("chunk_id"), "result_position", (F.col("n_at") - F.col("__at")).alias("side"), "rrf_score", F.col("chunk_id").alias("expanded_from_chunk_id"))
    found = found.join(F.broadcast(primaries.select("chunk_id")), "chunk_id", "left_anti")
    once = Window.partitionBy("chunk_id").orderBy("result_position", "side")
    found = found.withColumn("__n", F.row_number().over(once)).where("__n = 1")
    rows = primaries.select("chunk_id", F.lit(0).alias("part"), "result_position", F.lit(0).alias("side"), "rrf_score", "semantic_rank", "lexical_rank", F.lit(False).alias("was_expanded"), F.lit(None).cast("string").alias("expanded_from_chunk_id")).unionByName(
        found.select("chunk_id", F.lit(1).alias("part"), "result_position", "side", "rrf_score", F.lit(None).cast("int").alias("semantic_rank"), F.lit(None).cast("int").alias("lexical_rank"), F.lit(True).alias("was_expanded"), F.col("expanded_from_chunk_id").cast("string"))
    )
    rows = rows.orderBy("part", "result_position", "side").limit(limit)
    return rows.select("chunk_id", F.row_number().over(Window.orderBy("part", "result_position", "side")).alias("position"), "rrf_score", "semantic_rank", "lexical_rank", "was_expanded", "expanded_from_chunk_id")


def assemble_context(results: DataFrame, query: str, limit: int) -> DataFrame:
    """One row: query, status, limit, returned, sources, chunks, diagnostics.

    results(position, chunk_id, package, document_stem, heading_path, text, token_count, rrf_score, ...)
    """
    if limit <= 0:
        raise ValueError("the limit must be positive")
    kept = results.orderBy("position").limit(limit)
    source = ["package", "document_stem", "heading_path"]
    seen = kept.groupBy(*source).agg(F.min("position").alias("first"))
    numbered = seen.withColumn("source_id", F.concat(F.lit("src-"), F.row_number().over(Window.orderBy("first")).cast("string")))
    label = F.concat(F.coalesce(F.concat("package", F.lit("/")), F.lit("")), F.col("document_stem"), F.array_join(F.transform("heading_path", lambda h: F.concat(F.lit(" > "), h)), ""))
    numbered = numbered.withColumn("citation", label)
    on = kept["package"].eqNullSafe(numbered["package"]) & (kept["document_stem"] == numbered["document_stem"]) & (kept["heading_path"] == numbered["heading_path"])
    chunks = kept.join(F.broadcast(numbered.select(*source, "source_id", "citation")), on).select(
        "position", "chunk_id", "source_id", "citation", "text", "token_count"
    ).withColumn("context_id", F.concat(F.lit("ctx-"), F.row_number().over(Window.orderBy("position")).cast("string")))
    one_chunks = chunks.agg(
        F.array_sort(F.collect_list(F.struct("position", "context_id", "chunk_id", "source_id", "citation", "text", "token_count"))).alias("chunks"),
        F.count("*").alias("returned"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"),
    )
    one_sources = numbered.agg(F.array_sort(F.collect_list(F.struct("first", "source_id", *source, "citation"))).alias("sources"))
    total = results.agg(F.count("*").alias("total"))
    joined = one_chunks.crossJoin(one_sources).crossJoin(total)  # three one-row tables
    return joined.select(
        F.lit(query).alias("query"),
        F.when(F.col("returned") > 0, "ok").otherwise("no_results").alias("status"),
        F.lit(limit).alias("limit"),
        "returned",
        "sources",
        "chunks",
        F.struct((F.col("total") - F.col("returned")).alias("dropped_after_limit"), F.col("tokens").alias("total_token_count")).alias("diagnostics"),
    )


def render_json(context: DataFrame) -> DataFrame:
    return context.select(F.to_json(F.struct(*context.columns)).alias("json"))
