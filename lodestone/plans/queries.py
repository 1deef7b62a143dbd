"""Registered queries over the driver's tables, each with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import markdown as M
from lodestone.operators import relational as R
from lodestone.operators import retrieval as S
from lodestone.operators import validate as V
from lodestone.session import work_dir
from lodestone.sources.text_index import TextIndex
from lodestone.sources.vector_index import VectorIndex

TERMS = ("thatly", "ndther", "reing")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _query_embedding(emb: DataFrame, vec_id: int) -> list[float]:
    return list(emb.where(F.col("vec_id") == vec_id).select("embedding").first()[0])


# --- retrieval


def semantic_topk(spark, d):
    emb = _t(spark, d, "embeddings")
    return S.semantic_topk(emb, _query_embedding(emb, 0), "vec_id", "embedding")


def semantic_topk_filtered(spark, d):
    emb = _t(spark, d, "embeddings")
    return S.semantic_topk(emb, _query_embedding(emb, 0), "vec_id", "embedding", where=F.col("label") == 3)


def vector_index_nearest(spark, d):
    """The nearest rows of one vector by the index with exact bounds."""
    emb = _t(spark, d, "embeddings")
    index = VectorIndex.build(emb, f"{work_dir(spark)}/vectors", "vec_id")
    return index.nearest(spark, _query_embedding(emb, 0), exact=True).select("vec_id", F.col("rank").alias("semantic_rank"))


def vector_index_topk(spark, d):
    """The ten nearest rows of every hundredth vector among all, by the nearest cells of the index; recall is 0.9 or more."""
    emb = _t(spark, d, "embeddings")
    index = VectorIndex.build(emb, f"{work_dir(spark)}/vectors", "vec_id")
    return index.nearest_of(emb.where("vec_id % 100 = 0"), "vec_id", k=10).select(F.col("query").cast("long").alias("query_id"), "vec_id", "rank", "distance")


def lexical_bm25_topk(spark, d):
    return S.lexical_topk(_t(spark, d, "documents"), TERMS, "doc_id", "text").withColumn("score", F.round("score", 6))


def lexical_indexed_topk(spark, d):
    docs = _t(spark, d, "documents")
    return S.indexed_topk(S.postings(docs, "doc_id", "text"), *S.text_size(docs, "text"), TERMS, "doc_id").withColumn("score", F.round("score", 6))


def text_index_topk(spark, d):
    """The best documents by an index of term folders and bounded blocks, built over all of them."""
    index = TextIndex(spark, f"{work_dir(spark)}/terms")
    docs = _t(spark, d, "documents").select(F.format_string("%019d", "doc_id").alias("name"), "text")  # in the order of the numbers
    segments = index.added([], docs, "name", "text")
    best = index.topk(segments, TERMS)
    return best.select(F.col("key").cast("long").alias("doc_id"), "lexical_rank", F.round("score", 6).alias("score"))


def _fused(spark, d):
    emb = _t(spark, d, "embeddings")
    sem = S.semantic_topk(emb, _query_embedding(emb, 0), "vec_id", "embedding").withColumnRenamed("vec_id", "doc_id")
    return S.fuse(sem, S.lexical_topk(_t(spark, d, "documents"), TERMS, "doc_id", "text"), "doc_id")


def rrf_fusion(spark, d):
    w = Window.orderBy(*S.result_order("doc_id"))
    return _fused(spark, d).select("doc_id", "semantic_rank", "lexical_rank", F.round(F.col("rrf_score").cast("double"), 6).alias("score"), F.row_number().over(w).alias("position"))


def section_dedup(spark, d):
    fused = _fused(spark, d)
    rows = _t(spark, d, "documents").select("doc_id", "lang", "source").join(F.broadcast(fused), "doc_id")  # at most 40 rows
    return S.best_of_sections(rows, ["lang", "source"], "doc_id").select("doc_id", "lang", "source")


def hybrid_search(spark, d):
    """The flagship: both branches, fusion, one row a section, the best eight."""
    fused = _fused(spark, d)
    rows = _t(spark, d, "documents").select("doc_id", "lang", "source").join(F.broadcast(fused), "doc_id")
    best = S.best_of_sections(rows, ["lang", "source"], "doc_id").orderBy(*S.result_order("doc_id")).limit(S.RESULT_LIMIT)
    return best.select("doc_id", "lang", "source", F.row_number().over(Window.orderBy(*S.result_order("doc_id"))).alias("position"))


def exact_first_rows(spark, d):
    """The first document of each named source, as exact stem hits take a stem's first chunk."""
    chunks = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_stem"), F.col("n_chars").alias("chunk_ordinal"))
    return S.exact_stem_hits(chunks, "src3.md")


def merge_ranked(spark, d):
    docs = _t(spark, d, "documents")
    exact = docs.where("source = 'src3'").orderBy("n_chars", "doc_id").limit(5).select("doc_id", F.row_number().over(Window.orderBy("n_chars", "doc_id")).alias("position"))
    lexical = S.lexical_topk(docs, TERMS, "doc_id", "text").select("doc_id", F.col("lexical_rank").alias("position"))
    return S.merge_ranked([exact, lexical], "doc_id", S.LEXICAL_LIMIT)


def neighbor_ids(spark, d):
    conv = _t(spark, d, "conversations").withColumn("id", F.concat_ws("/", "conv_id", "turn"))
    doc = S.with_neighbors(conv, ["conv_id"], ["turn"], "id")
    both = S.with_neighbors(doc, ["conv_id", "role"], ["turn"], "id", ("section_previous", "section_next"))
    return both.select("id", "previous_chunk_id", "next_chunk_id", "section_previous", "section_next")


def _conversation_chunks(spark, d):
    return _t(spark, d, "conversations").select(
        F.format_string("%s/%04d", "conv_id", "turn").alias("chunk_id"), F.lit(None).cast("string").alias("package"), F.col("conv_id").cast("string").alias("document_stem"),
        F.array(F.lit("all")).alias("heading_path"), F.col("turn").alias("chunk_ordinal"), "text",
    )


def _expanded(spark, d):
    chunks = _conversation_chunks(spark, d)
    hits = S.lexical_topk(chunks, TERMS, "chunk_id", "text", k=5)
    primaries = hits.select("chunk_id", F.col("lexical_rank").alias("result_position"), S.rank_term(F.col("lexical_rank")).alias("rrf_score"), F.lit(None).cast("int").alias("semantic_rank"), "lexical_rank")
    return chunks, S.expand(primaries, chunks.drop("text"), 12)


def adjacent_expansion(spark, d):
    return _expanded(spark, d)[1].select("chunk_id", "position", "lexical_rank", "was_expanded", "expanded_from_chunk_id")


def context_sources(spark, d):
    chunks, rows = _expanded(spark, d)
    results = rows.join(chunks.withColumn("token_count", T.token_count(F.col("text"))), "chunk_id")
    context = S.assemble_context(results, " ".join(TERMS), 10)
    return context.select(F.explode("chunks").alias("c"), F.col("diagnostics.*")).select("c.context_id", "c.source_id", "c.chunk_id", "c.token_count", "dropped_after_limit", "total_token_count")


# --- incremental store


def _stored(docs):
    return docs.select(F.col("source").alias("package"), "doc_id", F.sha2("text", 256).alias("hash"))


def _found(docs):
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    return docs.where("doc_id % 7 <> 0").select(F.col("source").alias("package"), "doc_id", F.sha2(text, 256).alias("hash"))


def stale_documents(spark, d):
    docs = _t(spark, d, "documents")
    return R.stale(_stored(docs), _found(docs), ["package", "doc_id"]).select("package", "doc_id")


def unchanged_documents(spark, d):
    docs = _t(spark, d, "documents")
    return R.unchanged(_found(docs), _stored(docs), ["package", "doc_id"], "hash")


def changed_documents(spark, d):
    docs = _t(spark, d, "documents")
    return R.changed(_found(docs), _stored(docs), ["package", "doc_id"], "hash")


def embedding_reuse(spark, d):
    emb = _t(spark, d, "embeddings")
    new = emb.select("vec_id", "label")
    known = emb.where("vec_id % 3 <> 0").select("vec_id", "label", F.col("embedding").alias("embedding"))
    return R.reuse(new, known, ["vec_id", "label"]).groupBy("label").agg(F.count_if(F.col("embedding").isNotNull()).alias("hits"), F.count_if(F.col("embedding").isNull()).alias("misses"))


def index_summary(spark, d):
    docs = _t(spark, d, "documents")
    stored, found = _stored(docs), _found(docs)
    action = lambda df, a: df.select(F.lit(a).alias("action"))
    rows = action(R.unchanged(found, stored, ["package", "doc_id"], "hash"), "skipped").union(action(R.changed(found, stored, ["package", "doc_id"], "hash"), "reindexed"))
    return R.summary(rows.union(action(R.stale(stored, found, ["package", "doc_id"]), "deleted")))


def _merge_sides(docs):
    old = docs.where("doc_id % 4 <> 1").select("doc_id", (F.col("doc_id") % 50).alias("document"), F.col("n_chars").alias("size"))
    new = docs.where("doc_id % 50 < 10 and doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 50).alias("document"), (F.col("n_chars") + 1).alias("size"))
    return old, new


def merge_upsert(spark, d):
    return R.merged(*_merge_sides(_t(spark, d, "documents")), "doc_id", ["document"])


def merge_counts(spark, d):
    return R.merge_counts(*_merge_sides(_t(spark, d, "documents")), "doc_id", ["document"])


def _whole_merge_sides(docs):
    """All documents, and all of the changed snapshot: values altered, keys shifted, one document under a new name."""
    n = F.col("doc_id") % 50
    old = docs.select("doc_id", n.alias("document"), F.col("n_chars").alias("size"))
    key = F.when((F.col("doc_id") % 4 == 1) | (n == 49), -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    size = F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    new = docs.select(key.alias("doc_id"), F.when(n == 49, 50).otherwise(n).alias("document"), size.alias("size"))
    return old, new


def merge_upsert_whole(spark, d):
    return R.merged(*_whole_merge_sides(_t(spark, d, "documents")), "doc_id", ["document"])


def merge_counts_whole(spark, d):
    return R.merge_counts(*_whole_merge_sides(_t(spark, d, "documents")), "doc_id", ["document"])


# --- catalogue and text


def distinct_documents(spark, d):
    return _t(spark, d, "documents").select("lang", "source").distinct()


def next_code(spark, d):
    return _t(spark, d, "documents").groupBy("lang").agg((F.coalesce(F.max("doc_id"), F.lit(0)) + 1).alias("next_code"))


def tag_listing(spark, d):
    return _t(spark, d, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("tags"))


def catalogue_tree(spark, d):
    orders = _t(spark, d, "orders").where("o_orderkey <= 2000")
    return orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("keys"), F.count("*").alias("n"))


def catalogue_tree_whole(spark, d):
    """The tree over all orders; blocks of 10,000 keys bound a group's list."""
    orders = _t(spark, d, "orders").withColumn("block", F.floor(F.col("o_orderkey") / 10000))
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",")
    return orders.groupBy("o_orderstatus", "o_orderpriority", "block").agg(keys.alias("keys"), F.count("*").alias("n"))


def dashboard_status(spark, d):
    orders = _t(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")


def token_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("tokens"), T.word_count(F.col("text")).cast("long").alias("words"))


def line_spans(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content")).withColumn("size", F.octet_length("content"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), start.alias("start"), (start + F.col("size")).alias("stop"))


def search_text(spark, d):
    docs = _t(spark, d, "documents")
    stem = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("-"), "source")
    return docs.select("doc_id", F.md5(T.search_text(stem, F.array("lang", "source"), F.col("text"))).alias("search_md5"))


def autolinks(spark, d):
    pages = _t(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)).alias("links"))
    return pages.select("page_id", F.posexplode("links").alias("nth", "target")).select("page_id", F.col("nth").cast("long").alias("nth"), "target")


def anchor_slugs(spark, d):
    heads = _t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"))
    return heads.select("page_id", T.anchor(F.col("heading")).alias("anchor"))


def heading_ids(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("doc"), T.anchor(F.col("p_type")).alias("slug"))
    n = F.row_number().over(Window.partitionBy("doc", "slug").orderBy("p_partkey"))
    return rows.select("p_partkey", F.when(n == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), n.cast("string"))).alias("heading_id"))


def duplicate_anchors(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("doc"), T.anchor(F.col("p_type")).alias("slug"))
    n = F.row_number().over(Window.partitionBy("doc", "slug").orderBy("p_partkey"))
    return rows.withColumn("n", n).where("n > 1").select("p_partkey", "doc", "slug")


def stem_grammar(spark, d):
    stem = F.concat_ws("-", F.lower(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 3 == 0, F.lit("x")).otherwise(F.lpad(F.col("c_custkey").cast("string"), 5, "0")), F.when(F.col("c_custkey") % 5 == 0, F.lit("Bad")).otherwise(F.lit("slug")))
    rows = _t(spark, d, "customer").select("c_custkey", stem.alias("stem"))
    parts = T.stem_parts(F.col("stem"))
    return rows.select("c_custkey", T.is_stem(F.col("stem")).alias("valid"), parts["type"].alias("type"), parts["code"].cast("long").alias("code"), parts["slug"].alias("slug"))


def slug_check(spark, d):
    slug = F.lower(F.regexp_replace("p_name", "[ #]", "-"))
    return _t(spark, d, "part").select("p_partkey", T.is_slug(slug).alias("valid"), F.coalesce(T.slug_reason(slug), F.lit("")).alias("reason"))


def validation_errors(spark, d):
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    rule = lambda bad, message: F.when(bad, F.lit(message))
    rules = F.array_compact(F.array(
        rule(F.col("quality").isNull(), "Missing required field: quality"), rule(F.col("toxic") == 1, "Invalid status 'toxic'"),
        rule(F.col("quality") == 0, "Invalid category 'low'"), rule(F.col("n_chars") < 20, "Document is too short"),
    ))
    return docs.select("doc_id", F.explode(rules).alias("error"))


def union_corpora(spark, d):
    docs = _t(spark, d, "documents")
    every = docs.where("lang = 'en'").select(F.lit(None).cast("string").alias("package"), "doc_id").unionByName(docs.where("lang <> 'en'").select(F.col("lang").alias("package"), "doc_id"))
    return every.groupBy("package").agg(F.count("*").alias("documents"))


def package_plan(spark, d):
    rows = _t(spark, d, "nation").select("n_name", F.when(F.col("n_regionkey") % 2 == 0, "git").otherwise("file").alias("type"), (F.col("n_nationkey") % 3 == 0).alias("present"))
    action = F.when(F.col("type") == "git", F.when(F.col("present"), "fetch").otherwise("clone")).otherwise("copy")
    return rows.select("n_name", "type", action.alias("action"))


def event_windows(spark, d):
    """An extra, not of the engine's own operators: tumbling windows over events."""
    e = _t(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


# --- sequential: no SQL says them, tests hold them against brute force


def chunk_paragraphs(spark, d):
    """The chunks of every document; one without text is one row of status 'failed'."""
    text = F.coalesce("text", F.lit(""))
    docs = _t(spark, d, "documents").select(F.col("source").alias("package"), F.col("doc_id").cast("string").alias("document_stem"), F.sha2(text.cast("binary"), 256).alias("document_hash"), text.cast("binary").alias("content"))
    rows = M.chunks(docs)
    return rows.select("package", F.col("document_stem").cast("long").alias("doc_id"), "status", "error_kind", "chunk_ordinal", "chunk_id", "chunk_hash", "token_count", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def stem_dictionary_match(spark, d):
    """How often every document has each bare stem; the words of the benchmark stand for stems."""
    words = _t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9-]+"), F.lit(0))).alias("document_stem"))
    mentions = V.stem_mentions(_t(spark, d, "documents").select("doc_id", "text"), "doc_id", words.select(F.col("document_stem").alias("stem")))
    return mentions.groupBy("doc_id", "stem").agg(F.count("*").alias("n"))


SEQUENTIAL: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (chunk_paragraphs, stem_dictionary_match, vector_index_topk)}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        hybrid_search, semantic_topk, semantic_topk_filtered, vector_index_nearest, lexical_bm25_topk, lexical_indexed_topk, text_index_topk, rrf_fusion, section_dedup, exact_first_rows, merge_ranked, neighbor_ids, adjacent_expansion, context_sources,
        stale_documents, unchanged_documents, changed_documents, embedding_reuse, index_summary, merge_upsert, merge_counts, merge_upsert_whole, merge_counts_whole, distinct_documents, next_code, tag_listing, catalogue_tree, catalogue_tree_whole, dashboard_status,
        token_counts, line_spans, search_text, autolinks, anchor_slugs, heading_ids, duplicate_anchors, stem_grammar, slug_check, validation_errors, union_corpora, package_plan, event_windows,
    )
}


def _ctes() -> str:
    tf = lambda t: f"len(list_filter(w, lambda x: x = '{t}'))"
    idf = lambda i: f"ln(1 + ((SELECT count(*) FROM counted) - (SELECT count(*) FROM counted WHERE tf{i} > 0) + 0.5) / ((SELECT count(*) FROM counted WHERE tf{i} > 0) + 0.5))"
    part = lambda i: f"{idf(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM counted)))"
    terms = sorted(set(TERMS))
    return f"""
words AS (SELECT {{key}} AS id, regexp_extract_all(lower(text), '[\\p{{{{L}}}}\\p{{{{N}}}}]+') AS w FROM {{table}}),
counted AS (SELECT id, len(w) AS dl, {', '.join(f'{tf(t)} AS tf{i}' for i, t in enumerate(terms))} FROM words),
scored AS (SELECT id, {' + '.join(part(i) for i in range(len(terms)))} AS score FROM counted),
lexical AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS lexical_rank FROM scored WHERE score > 0 QUALIFY lexical_rank <= {{k}})"""


_LEX = lambda key, table, k: _ctes().format(key=key, table=table, k=k)
_SEM = """
near AS (SELECT vec_id, list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS dist FROM embeddings {where}),
semantic AS (SELECT vec_id, row_number() OVER (ORDER BY dist, vec_id) AS semantic_rank FROM near QUALIFY semantic_rank <= 20)"""
_FUSED = f"""WITH {_LEX('doc_id', 'documents', 20)}, {_SEM.format(where='')},
fused AS (SELECT coalesce(vec_id, id) AS doc_id, semantic_rank, lexical_rank,
  (coalesce((1.0::DOUBLE / (60 + semantic_rank))::FLOAT, 0::FLOAT) + coalesce((1.0::DOUBLE / (60 + lexical_rank))::FLOAT, 0::FLOAT))::FLOAT AS score
  FROM semantic FULL OUTER JOIN lexical ON vec_id = id)"""
_ORDER = "score DESC, semantic_rank NULLS LAST, lexical_rank NULLS LAST, doc_id"
_CHUNKS = "(SELECT conv_id || '/' || lpad(turn::VARCHAR, 4, '0') AS chunk_id, conv_id, turn, text FROM conversations)"
_EXPANDED = f"""WITH chunks AS {_CHUNKS}, {_LEX('chunk_id', 'chunks', 5)},
placed AS (SELECT chunk_id, conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, chunk_id) AS at FROM chunks),
beside AS (SELECT n.chunk_id, l.lexical_rank AS rp, n.at - p.at AS side, l.id AS src FROM lexical l JOIN placed p ON p.chunk_id = l.id
  JOIN placed n ON n.conv_id = p.conv_id AND abs(n.at - p.at) = 1 WHERE n.chunk_id NOT IN (SELECT id FROM lexical)),
once AS (SELECT * FROM beside QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY rp, side) = 1),
every AS (SELECT id AS chunk_id, 0 AS part, lexical_rank AS rp, 0 AS side, lexical_rank, false AS was_expanded, NULL AS expanded_from_chunk_id FROM lexical
  UNION ALL SELECT chunk_id, 1, rp, side, NULL, true, src FROM once),
expanded AS (SELECT *, row_number() OVER (ORDER BY part, rp, side) AS position FROM every QUALIFY position <= 12)"""
_STORED = "stored AS (SELECT source AS package, doc_id, sha256(text) AS hash FROM documents)"
_FOUND = "found AS (SELECT source AS package, doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0)"
_SIDES = """old AS (SELECT doc_id, doc_id % 50 AS document, n_chars AS size FROM documents WHERE doc_id % 4 <> 1),
new AS (SELECT doc_id, doc_id % 50 AS document, n_chars + 1 AS size FROM documents WHERE doc_id % 50 < 10 AND doc_id % 3 = 0)"""
_WHOLE_SIDES = """old AS (SELECT doc_id, doc_id % 50 AS document, n_chars AS size FROM documents),
new AS (SELECT CASE WHEN doc_id % 4 = 1 OR doc_id % 50 = 49 THEN -doc_id - 1 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 50 = 49 THEN 50 ELSE doc_id % 50 END AS document,
  n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS size FROM documents)"""
_BLANK = r"[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ANCHOR = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '(?:[\t-\r \x{{85}}\x{{A0}}\x{{3000}}]|-)+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"

ORACLE: dict[str, str] = {
    "semantic_topk": f"WITH {_SEM.format(where='')} SELECT * FROM semantic",
    "semantic_topk_filtered": f"WITH {_SEM.format(where='WHERE label = 3')} SELECT * FROM semantic",
    "vector_index_nearest": f"WITH {_SEM.format(where='')} SELECT * FROM semantic",
    "lexical_bm25_topk": f"WITH {_LEX('doc_id', 'documents', 20)} SELECT id AS doc_id, lexical_rank, round(score, 6) AS score FROM lexical",
    "lexical_indexed_topk": f"WITH {_LEX('doc_id', 'documents', 20)} SELECT id AS doc_id, lexical_rank, round(score, 6) AS score FROM lexical",
    "text_index_topk": f"WITH {_LEX('doc_id', 'documents', 20)} SELECT id AS doc_id, lexical_rank, round(score, 6) AS score FROM lexical",
    "rrf_fusion": f"{_FUSED} SELECT doc_id, semantic_rank, lexical_rank, round(score::DOUBLE, 6) AS score, row_number() OVER (ORDER BY {_ORDER}) AS position FROM fused",
    "section_dedup": f"{_FUSED} SELECT doc_id, lang, source FROM fused JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_ORDER}) = 1",
    "hybrid_search": f"{_FUSED}, best AS (SELECT fused.*, lang, source FROM fused JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_ORDER}) = 1) SELECT doc_id, lang, source, row_number() OVER (ORDER BY {_ORDER}) AS position FROM best QUALIFY position <= 8",
    "exact_first_rows": "SELECT doc_id AS chunk_id, 1 AS position FROM documents WHERE source = 'src3' ORDER BY n_chars, doc_id LIMIT 1",
    "merge_ranked": f"""WITH {_LEX('doc_id', 'documents', 20)}, exact AS (SELECT doc_id AS id, 0 AS b, row_number() OVER (ORDER BY n_chars, doc_id) AS p FROM documents WHERE source = 'src3' QUALIFY p <= 5),
every AS (SELECT * FROM exact UNION ALL SELECT id, 1, lexical_rank FROM lexical), one AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY b, p) = 1)
SELECT id AS doc_id, row_number() OVER (ORDER BY b, p, id) AS position FROM one QUALIFY position <= 20""",
    "neighbor_ids": """SELECT conv_id || '/' || turn AS id, lag(conv_id || '/' || turn) OVER d AS previous_chunk_id, lead(conv_id || '/' || turn) OVER d AS next_chunk_id,
lag(conv_id || '/' || turn) OVER s AS section_previous, lead(conv_id || '/' || turn) OVER s AS section_next FROM conversations
WINDOW d AS (PARTITION BY conv_id ORDER BY turn), s AS (PARTITION BY conv_id, role ORDER BY turn)""",
    "adjacent_expansion": f"{_EXPANDED} SELECT chunk_id, position, lexical_rank, was_expanded, expanded_from_chunk_id FROM expanded",
    "context_sources": rf"""{_EXPANDED}, kept AS (SELECT expanded.chunk_id, position, conv_id, len(regexp_extract_all(text, '{_BLANK}')) AS token_count FROM expanded JOIN placed USING (chunk_id) WHERE position <= 10),
sources AS (SELECT conv_id, row_number() OVER (ORDER BY min(position)) AS n FROM kept GROUP BY conv_id)
SELECT 'ctx-' || row_number() OVER (ORDER BY position) AS context_id, 'src-' || n AS source_id, chunk_id, token_count, (SELECT count(*) FROM expanded) - (SELECT count(*) FROM kept) AS dropped_after_limit, (SELECT sum(token_count) FROM kept) AS total_token_count FROM kept JOIN sources USING (conv_id)""",
    "stale_documents": f"WITH {_STORED}, {_FOUND} SELECT package, doc_id FROM stored ANTI JOIN found USING (package, doc_id)",
    "unchanged_documents": f"WITH {_STORED}, {_FOUND} SELECT * FROM found SEMI JOIN stored USING (package, doc_id, hash)",
    "changed_documents": f"WITH {_STORED}, {_FOUND} SELECT * FROM found ANTI JOIN stored USING (package, doc_id, hash)",
    "embedding_reuse": "SELECT label, count(*) FILTER (vec_id % 3 <> 0) AS hits, count(*) FILTER (vec_id % 3 = 0) AS misses FROM embeddings GROUP BY label",
    "index_summary": f"""WITH {_STORED}, {_FOUND} SELECT (SELECT count(*) FROM found SEMI JOIN stored USING (package, doc_id, hash)) AS skipped,
(SELECT count(*) FROM found ANTI JOIN stored USING (package, doc_id, hash)) AS reindexed, (SELECT count(*) FROM stored ANTI JOIN found USING (package, doc_id)) AS deleted, 0 AS failed""",
    "merge_upsert": f"WITH {_SIDES} SELECT * FROM old WHERE document NOT IN (SELECT document FROM new) AND doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new",
    "merge_counts": f"""WITH {_SIDES}, mine AS (SELECT * FROM old WHERE document IN (SELECT document FROM new))
SELECT (SELECT count(*) FROM new ANTI JOIN mine USING (doc_id)) AS inserted, (SELECT count(*) FROM new SEMI JOIN mine USING (doc_id)) AS updated, (SELECT count(*) FROM mine ANTI JOIN new USING (doc_id)) AS deleted""",
    "merge_upsert_whole": f"WITH {_WHOLE_SIDES} SELECT * FROM old WHERE document NOT IN (SELECT document FROM new) AND doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new",
    "merge_counts_whole": f"""WITH {_WHOLE_SIDES}, mine AS (SELECT * FROM old WHERE document IN (SELECT document FROM new))
SELECT (SELECT count(*) FROM new ANTI JOIN mine USING (doc_id)) AS inserted, (SELECT count(*) FROM new SEMI JOIN mine USING (doc_id)) AS updated, (SELECT count(*) FROM mine ANTI JOIN new USING (doc_id)) AS deleted""",
    "distinct_documents": "SELECT DISTINCT lang, source FROM documents",
    "next_code": "SELECT lang, coalesce(max(doc_id), 0) + 1 AS next_code FROM documents GROUP BY lang",
    "tag_listing": "SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS tags FROM documents GROUP BY lang",
    "catalogue_tree": "SELECT o_orderstatus, o_orderpriority, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys, count(*) AS n FROM orders WHERE o_orderkey <= 2000 GROUP BY ALL",
    "catalogue_tree_whole": "SELECT o_orderstatus, o_orderpriority, o_orderkey // 10000 AS block, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys, count(*) AS n FROM orders GROUP BY ALL",
    "dashboard_status": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "token_counts": rf"SELECT doc_id, len(regexp_extract_all(text, '{_BLANK}')) AS tokens, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS words FROM documents",
    "line_spans": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS line FROM s)
SELECT doc_id, line, coalesce(sum(strlen(c) + 1) OVER w, 0) AS start, coalesce(sum(strlen(c) + 1) OVER w, 0) + strlen(c) AS stop FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "search_text": """WITH s AS (SELECT *, 'doc-' || doc_id || '-' || source AS stem FROM documents)
SELECT doc_id, md5(concat_ws(chr(10), stem, stem || '.md', regexp_replace(stem, '[^A-Za-z0-9]', ' ', 'g'), regexp_replace(stem || '.md', '[^A-Za-z0-9]', ' ', 'g'), lang || ' / ' || source, text)) AS search_md5 FROM s""",
    "autolinks": """WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS t FROM pages) SELECT page_id, generate_subscripts(t, 1) - 1 AS nth, unnest(t) AS target FROM l""",
    "anchor_slugs": f"SELECT page_id, {_ANCHOR(chr(39).join(['regexp_extract(html, ', '<h1>([^<]*)</h1>', ', 1)']))} AS anchor FROM pages",
    "heading_ids": f"WITH r AS (SELECT p_partkey, p_brand AS doc, {_ANCHOR('p_type')} AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY doc, slug ORDER BY p_partkey) AS n FROM r) SELECT p_partkey, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS heading_id FROM n",
    "duplicate_anchors": f"WITH r AS (SELECT p_partkey, p_brand AS doc, {_ANCHOR('p_type')} AS slug FROM part) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc, slug ORDER BY p_partkey) > 1",
    "stem_grammar": """WITH s AS (SELECT c_custkey, lower(c_mktsegment) || '-' || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE left(lpad(c_custkey::VARCHAR, 5, '0'), 5) END || '-' || CASE WHEN c_custkey % 5 = 0 THEN 'Bad' ELSE 'slug' END AS stem FROM customer),
v AS (SELECT *, string_split(stem, '-') AS p, len(p) >= 3 AND len(list_filter(p, lambda x: NOT regexp_full_match(x, '[a-z0-9]+'))) = 0 AS clean, list_position(list_transform(p, lambda x: regexp_full_match(x, '[0-9]+')), true) AS k FROM s),
w AS (SELECT *, coalesce(clean AND k > 1 AND k < len(p), false) AS valid FROM v)
SELECT c_custkey, valid, CASE WHEN valid THEN array_to_string(p[1:k-1], '-') END AS type, CASE WHEN valid THEN p[k]::BIGINT END AS code, CASE WHEN valid THEN array_to_string(p[k+1:], '-') END AS slug FROM w""",
    "slug_check": """WITH s AS (SELECT p_partkey, lower(regexp_replace(p_name, '[ #]', '-', 'g')) AS s FROM part)
SELECT p_partkey, regexp_full_match(s, '[a-z0-9]+(-[a-z0-9]+)*') AS valid, CASE WHEN s = '' THEN 'empty' WHEN s LIKE '-%' OR s LIKE '%-' THEN 'edge hyphen' WHEN contains(s, '--') THEN 'double hyphen' WHEN NOT regexp_full_match(s, '[a-z0-9-]+') THEN 'invalid character' ELSE '' END AS reason FROM s""",
    "validation_errors": """WITH j AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, 'Missing required field: quality' AS error FROM j WHERE quality IS NULL UNION ALL SELECT doc_id, 'Invalid status ''toxic''' FROM j WHERE toxic = 1
UNION ALL SELECT doc_id, 'Invalid category ''low''' FROM j WHERE quality = 0 UNION ALL SELECT doc_id, 'Document is too short' FROM j WHERE n_chars < 20""",
    "union_corpora": "SELECT CASE WHEN lang = 'en' THEN NULL ELSE lang END AS package, count(*) AS documents FROM documents GROUP BY 1",
    "package_plan": "SELECT n_name, CASE WHEN n_regionkey % 2 = 0 THEN 'git' ELSE 'file' END AS type, CASE WHEN n_regionkey % 2 = 0 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'fetch' ELSE 'clone' END ELSE 'copy' END AS action FROM nation",
    "event_windows": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
