"""Registered queries that put a whole governed corpus through the library's own operators, each with its SQL.

The corpus has a Markdown document for every row of ``part``, by one SQL text that Spark and any other
engine read alike: three document types with a layout each, and every fault that the rules know, by the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import catalog, moves, validate
from lodestone.operators import markdown as M
from lodestone.session import work_dir
from lodestone.sources.config import DocumentType

CORPUS = """
a AS (SELECT p_partkey AS k, p_size AS size, CASE p_partkey % 3 WHEN 0 THEN 'rfc' WHEN 1 THEN 'spec' ELSE 'project' END AS doc_type,
  lpad(CAST(p_partkey AS STRING), 8, '0') AS code, CASE WHEN p_partkey % 7 = 0 THEN 'item--x' ELSE 'item-x' END AS slug,
  CASE WHEN p_partkey % 2 = 0 THEN 'draft' ELSE 'done' END AS half, chr(10) AS nl FROM $part),
b AS (SELECT *, CASE doc_type WHEN 'rfc' THEN half WHEN 'spec' THEN 'cat-' || half ELSE CASE WHEN k % 5 = 0 THEN 'sub' ELSE 'project' END END AS folder,
  CASE WHEN k % 19 = 0 THEN 'odd' WHEN k % 11 = 0 THEN CASE WHEN half = 'draft' THEN 'done' ELSE 'draft' END ELSE half END AS status,
  CASE WHEN k % 13 = 0 THEN 'cat-other' ELSE 'cat-' || half END AS category FROM a),
c AS (SELECT *, CASE WHEN k % 43 = 0 THEN chr(13) || chr(10) ELSE nl END AS eol,
  CASE doc_type WHEN 'rfc' THEN 'status: ' || status || nl WHEN 'spec' THEN 'category: ' || category || nl ELSE '' END AS placed,
  doc_type || '-' || code || '-' || CASE WHEN k % 17 = 0 THEN 'other' ELSE slug END || '.md' AS name FROM b),
d AS (SELECT *, 'w/doc/' || doc_type || '/' || folder || '/' || name AS path,
  '---' || nl || 'id: ' || doc_type || '-' || code || nl || 'type: ' || doc_type || nl || 'code: ' || code || nl || 'slug: ' || slug || nl
  || CASE WHEN k % 23 = 0 THEN '' ELSE 'title: Part ' || CAST(k AS STRING) || nl END || 'description: D' || nl || 'created: 2024-01-01' || nl
  || 'tags:' || nl || '  - size-' || CAST(size AS STRING) || nl || '  - part' || nl || placed || '---' || nl AS front,
  '# Part ' || CAST(k AS STRING) || nl || nl || 'All about the part.' || nl || nl || '## Use It' || nl || nl || 'See [[rfc-00000003-item-x' || CASE WHEN k % 29 = 0 THEN '.md' ELSE '' END
  || ']] and [here](#use-it) or <https://example.com/' || CAST(k AS STRING) || '>.' || nl
  || CASE WHEN k % 31 = 0 THEN nl || '## Use It' || nl || nl || 'Again.' || nl ELSE '' END || CASE WHEN k % 37 = 0 THEN nl || '[Missing][none]' || nl ELSE '' END
  || CASE WHEN k % 41 = 0 THEN nl || chr(35) || chr(123) || 'Bad_Name' || chr(125) || nl ELSE '' END AS body FROM c),
corpus AS (SELECT *, replace(front || body, nl, eol) AS content FROM d)
"""
TYPES = (
    DocumentType("rfc", layout="status", statuses=["draft", "done"], tags=["b", "a"]),
    DocumentType("spec", layout="category", tags=["c", "a"]),
    DocumentType("project", layout="directory"),
)


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The documents of all parts. A part is a few bytes and its document hundreds, so a file or two would
    leave the work of a whole cluster to a task or two: the keys are dealt before the texts are made."""
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size").repartition(tasks, "p_partkey")
    part.createOrReplaceTempView("lodestone_part")
    rows = spark.sql(f"WITH {CORPUS.replace('$part', 'lodestone_part')} SELECT * FROM corpus")
    return rows.withColumn("content", F.col("content").cast("binary"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d)
    return rows.select(F.lit(None).cast("string").alias("package"), F.regexp_replace("name", r"\.md$", "").alias("document_stem"), F.lit("h").alias("document_hash"), "content")


def governed_errors(spark, d):
    """Every rule over every document."""
    return validate.validate(corpus(spark, d).select("path", "doc_type", "content"), TYPES)


def governed_stems(spark, d):
    """Every rule, with all stems of the corpus, over the corpus with more that names its stems bare, linked and in code; some rows have no content or type."""
    own, other = F.expr("left(name, length(name) - 3)"), F.lit("pkg/spec-1-known")
    more = F.concat(F.lit("\nAs "), own, F.lit(" says (`"), own, F.lit("`, [["), own, F.lit("]], x-"), own, F.lit(", "), own, F.lit(".md): "), other, F.lit(".\n```\n"), own, F.lit("\n```\n"))
    content = F.when(F.col("k") % 53 != 0, F.concat(F.col("content").cast("string"), F.when(F.col("k") % 4 == 0, more).otherwise(F.lit(""))).cast("binary"))
    rows = corpus(spark, d)
    stems = rows.select(own.alias("stem")).unionByName(rows.select(F.concat_ws("/", F.lit("pkg"), F.lit("spec-1-known")).alias("stem")))
    kind = F.when(F.col("k") % 59 == 0, "memo").otherwise(F.col("doc_type"))
    return validate.validate(rows.select("path", kind.alias("doc_type"), content.alias("content")), TYPES, stems)


MOVES = """
m AS (SELECT p_partkey AS k, 'f/' || CAST(p_partkey AS STRING) AS path, CAST(floor(p_partkey / 10) AS BIGINT) AS g FROM $part),
planned AS (SELECT k, path, CASE k % 10
  WHEN 0 THEN 'f/' || CAST(k + 1 AS STRING) WHEN 1 THEN 'f/' || CAST(k + 1 AS STRING)
  WHEN 3 THEN 'f/' || CAST(k + 1 AS STRING) WHEN 4 THEN 'f/' || CAST(CASE WHEN g % 2 = 0 THEN k - 1 ELSE k + 1 END AS STRING) WHEN 5 THEN CASE WHEN g % 2 = 0 THEN 'one/' || CAST(g AS STRING) ELSE 'f/' || CAST(k - 2 AS STRING) END
  WHEN 6 THEN 'one/' || CAST(g AS STRING) WHEN 7 THEN 'f/' || CAST(k + 1 AS STRING) WHEN 8 THEN 'new/' || CAST(g AS STRING) WHEN 9 THEN 'f/' || CAST(k + 7 AS STRING) END AS target FROM m)
"""


def governed_moves(spark, d):
    """Moves for every part that are chains, swaps, longer cycles, two to one place and places that are taken."""
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("lodestone_part")
    planned = spark.sql(f"WITH {MOVES.replace('$part', 'lodestone_part')} SELECT path, target FROM planned")
    return moves.ordered_moves(planned, planned.select("path"), work_dir(spark))


def governed_report(spark, d):
    rows = validate.report(governed_errors(spark, d))
    return rows.select("valid", F.size("errors").cast("long").alias("errors"))


def governed_repairs(spark, d):
    plan = validate.repair_plan(corpus(spark, d).select("path", "doc_type", "content"), TYPES)
    return plan.select("path", "target", F.array_join("fixes", ",").alias("fixes"), F.md5("content").alias("content_md5"))


def extracted_metadata(spark, d):
    rows = M.extract(_documents(spark, d))
    field = lambda k: F.get_json_object("frontmatter", f"$.{k}").alias(k)
    more = (F.array_join("tags", ",").alias("tags"), F.col("body_start").cast("long").alias("body_start"))
    return rows.select("document_stem", "status", "format", field("title"), field("code"), field("slug"), *more)


def extracted_outline(spark, d):
    rows = M.heading_outline(M.extract(_documents(spark, d)))
    span = (F.col("start").cast("long").alias("from_byte"), F.col("end").cast("long").alias("to_byte"))
    return rows.select("document_stem", F.col("level").cast("long").alias("level"), "text", "heading_id", F.array_join("path", "/").alias("outline"), *span)


def extracted_links(spark, d):
    rows = M.link_edges(M.extract(_documents(spark, d)))
    return rows.select("document_stem", "kind", "raw", "target", "label", "heading", (F.col("end") - F.col("start")).cast("long").alias("n_bytes"))


def extracted_diagnostics(spark, d):
    rows = M.extract(_documents(spark, d)).select("document_stem", F.explode("diagnostics").alias("x"))
    return rows.select("document_stem", "x.kind", "x.message")


def extracted_chunks(spark, d):
    rows = M.chunks(_documents(spark, d)).withColumn("parts", F.split("chunk_id", "/"))
    part = lambda k: F.element_at("parts", k)
    named = (part(1) == "workspace") & (part(2) == F.col("document_stem")) & (part(4) == F.col("chunk_hash"))
    outline = F.array_join("heading_path", "/").alias("outline")
    counts = (F.col("chunk_ordinal").cast("long").alias("chunk_ordinal"), F.col("token_count").cast("long").alias("tokens"))
    return rows.select("document_stem", "status", part(3).alias("place"), named.alias("named"), outline, "text", *counts)


def _records(spark, d):
    rows = corpus(spark, d)
    title = F.when(F.col("k") % 23 != 0, F.concat(F.lit("Part "), F.col("k").cast("string")))
    return catalog.catalogue(rows.select("path", F.regexp_replace("name", r"\.md$", "").alias("document_stem"), title.alias("title")))


def governed_catalogue(spark, d):
    return _records(spark, d).select("path", "type", F.col("code").cast("long").alias("code"), "slug", "folder", "title")


def governed_tree(spark, d):
    stems = F.transform("documents", lambda x: x["document_stem"])
    rows = catalog.tree(_records(spark, d))
    return rows.select("type", "folder", F.size("documents").cast("long").alias("n"), F.md5(F.array_join(stems, ",").cast("binary")).alias("stems_md5"))


def governed_next_code(spark, d):
    rows = _records(spark, d)
    out = [catalog.next_code(rows, t.name).select(F.lit(t.name).alias("type"), "next_code") for t in TYPES]
    return out[0].union(out[1]).union(out[2])


def governed_dashboard(spark, d):
    sections = [
        {"title": "Open", "doc_type": "rfc", "statuses": ["draft"], "categories": [], "error": None},
        {"title": "Shelves", "doc_type": "spec", "statuses": [], "categories": ["cat-draft", "cat-done"], "error": None},
        {"title": "Broken", "doc_type": "rfc", "statuses": [], "categories": [], "error": "no such type"},
    ]
    rows = catalog.dashboard(_records(spark, d), sections)
    return rows.select(F.col("section").cast("long").alias("section"), "section_title", "status", F.col("code").cast("long").alias("code"), "slug", "document_stem")


def governed_names(spark, d):
    return catalog.file_names(_records(spark, d), 8).select("path", "expected_name")


def governed_tags(spark, d):
    """The tags of all brands, each of which uses the words of its parts' types."""
    part = spark.read.parquet(f"{d}/part.parquet")
    return catalog.tags(part.select("p_brand", F.explode(F.split(F.lower("p_type"), " ")).alias("tag")).groupBy("p_brand").agg(F.collect_set("tag").alias("tags")))


def governed_types(spark, d):
    """A listing of all brands as types; the least size decides their layout."""
    part = spark.read.parquet(f"{d}/part.parquet").groupBy(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "-")).alias("name")).agg(F.min("p_size").alias("least"))
    return catalog.type_listing(part.select("name", F.expr("CASE least % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'category' ELSE 'directory' END").alias("layout")))


def governed_packages(spark, d):
    nations = spark.read.parquet(f"{d}/nation.parquet")
    kind = F.when(F.col("n_regionkey") % 2 == 0, "git").otherwise("file")
    manifest = nations.select(F.col("n_name").alias("name"), kind.alias("type"), F.lower("n_name").alias("url"), F.lit(None).cast("string").alias("tag"))
    present = nations.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"))
    return catalog.package_plan(manifest, present).select("name", "type", "url", "action")


def prompt_texts(spark, d):
    """Placeholders, those without a value, and mentions of a text for every part."""
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    text = F.concat(F.lit("#{name} of #{brand} costs #{price}, says @"), brand, F.lit("/x and @desk; not a@b #{name}"))
    part = spark.read.parquet(f"{d}/part.parquet").withColumn("t", text)
    values = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    lists = (F.array_join(catalog.unresolved(F.col("t"), values), ",").alias("unresolved"), F.array_join(catalog.mentions(F.col("t")), ",").alias("mentions"))
    return part.select("p_partkey", catalog.substitute(F.col("t"), values).alias("text"), *lists)


def failure_kinds(spark, d):
    """A class for an error text of every event."""
    events = spark.read.parquet(f"{d}/events.parquet")
    text = F.expr("CASE event_id % 5 WHEN 0 THEN 'Store not found' WHEN 1 THEN 'wrong Dimension' WHEN 2 THEN 'query is blank' WHEN 3 THEN 'missing store' ELSE event_type END")
    return events.select("event_id", catalog.failure_kind(text).alias("kind"))


QUERIES = {
    f.__name__: f
    for f in (
        governed_errors, governed_stems, governed_moves, governed_report, governed_repairs, extracted_metadata, extracted_outline, extracted_links, extracted_diagnostics, extracted_chunks, governed_catalogue,
        governed_tree, governed_next_code, governed_dashboard, governed_names, governed_tags, governed_types, governed_packages, prompt_texts, failure_kinds,
    )
}

_SQL = f"WITH {CORPUS.replace('$part', 'part')}"
_STEM = "left(name, length(name) - 3)"
_PLAIN = "k % 43 <> 0"
_ERRORS = f"""errors AS (
  SELECT path, 'file has CRLF line endings' AS error FROM corpus WHERE k % 43 = 0
  UNION ALL SELECT path, 'Missing required frontmatter field: title' FROM corpus WHERE k % 23 = 0 AND {_PLAIN}
  UNION ALL SELECT path, 'Invalid slug: Slug must not contain consecutive hyphens' FROM corpus WHERE k % 7 = 0 AND {_PLAIN}
  UNION ALL SELECT path, 'Invalid status ''odd''. Allowed: ["draft", "done"]' FROM corpus WHERE doc_type = 'rfc' AND status = 'odd' AND {_PLAIN}
  UNION ALL SELECT path, 'File is in folder ''' || folder || ''' but frontmatter status is ''' || status || '''' FROM corpus
    WHERE doc_type = 'rfc' AND folder <> status AND {_PLAIN}
  UNION ALL SELECT path, 'File is in folder ''' || folder || ''' but frontmatter category is ''' || category || '''' FROM corpus
    WHERE doc_type = 'spec' AND folder <> category AND {_PLAIN}
  UNION ALL SELECT path, 'File for directory-based layout must be directly under ''doc/project'' (found in ''sub'')' FROM corpus
    WHERE doc_type = 'project' AND folder = 'sub' AND {_PLAIN}
  UNION ALL SELECT path, 'Filename ''' || name || ''' does not match pattern ''{{doc_type}}-{{code}}-{{slug}}.md'' (expected: ''' || doc_type || '-' || code || '-' || slug || '.md'')'
    FROM corpus WHERE k % 17 = 0 AND {_PLAIN}
  UNION ALL SELECT path, 'Wikilink ''rfc-00000003-item-x.md'' should not include .md extension' FROM corpus WHERE k % 29 = 0 AND {_PLAIN}
  UNION ALL SELECT path, 'Invalid substitution variable ''#{{Bad_Name}}''; variable names must be kebab-case' FROM corpus WHERE k % 41 = 0 AND {_PLAIN})"""
_AT = "strlen(replace(front, nl, eol))"
#: Each heading with what stands before it, in bytes.
_HEADS = f"""heads AS (
  SELECT *, 1 AS level, 'Part ' || k AS text, 'part-' || k AS heading_id, 'Part ' || k AS outline, {_AT} AS spot FROM corpus
  UNION ALL SELECT *, 2, 'Use It', 'use-it', 'Part ' || k || '/Use It', {_AT} + strlen('# Part ' || k || 'All about the part.') + 4 * strlen(eol) FROM corpus
  UNION ALL SELECT *, 2, 'Use It', 'use-it-2', 'Part ' || k || '/Use It', strlen(content) - strlen('## Use ItAgain.') - 3 * strlen(eol)
    - CASE WHEN k % 37 = 0 THEN strlen('[Missing][none]') + 2 * strlen(eol) ELSE 0 END
    - CASE WHEN k % 41 = 0 THEN strlen('#{{Bad_Name}}') + 2 * strlen(eol) ELSE 0 END FROM corpus WHERE k % 31 = 0)"""
_CATALOGUE = f"""records AS (SELECT *, {_STEM} AS document_stem, CASE WHEN k % 17 = 0 THEN 'other' ELSE slug END AS own FROM corpus),
cat AS (SELECT path, doc_type AS type, k AS code, own AS slug, folder, CASE WHEN k % 23 = 0 THEN own ELSE 'Part ' || k END AS title, document_stem
  FROM records WHERE own <> 'item--x')"""
ORACLE = {
    "governed_errors": f"{_SQL}, {_ERRORS} SELECT * FROM errors",
    "governed_stems": f"""{_SQL}, {_ERRORS}, told AS (SELECT path, error FROM errors JOIN corpus USING (path) WHERE k % 53 <> 0 AND k % 59 <> 0
  UNION ALL SELECT path, 'file has no content' FROM corpus WHERE k % 53 = 0 AND k % 59 <> 0
  UNION ALL SELECT path, 'Unknown document type ' || chr(39) || 'memo' || chr(39) FROM corpus WHERE k % 59 = 0
  UNION ALL SELECT path, 'Bare governed document stem ' || chr(39) || s || chr(39) || ' should be a wikilink; expected ' || chr(39) || '[[' || s || ']]' || chr(39) FROM (
    SELECT path, k, unnest([{_STEM}, 'pkg/spec-1-known']) AS s FROM corpus WHERE k % 4 = 0 AND k % 53 <> 0 AND k % 59 <> 0 AND {_PLAIN})) SELECT * FROM told""",
    "governed_moves": f"""WITH RECURSIVE {MOVES.replace('$part', 'part')},
v AS (SELECT path, target, row_number() OVER (PARTITION BY target ORDER BY path) AS nth FROM planned WHERE target IS NOT NULL AND target <> path),
won AS (SELECT path, target FROM v WHERE nth = 1),
walk AS (SELECT path, path AS node, target AS ahead, 0 AS turn, path AS least, false AS loop FROM won
  UNION ALL SELECT w.path, n.path, n.target, w.turn + 1, least(w.least, n.path), n.target = w.path FROM walk w JOIN won n ON n.path = w.ahead WHERE NOT w.loop AND n.path <> w.path),
ends AS (SELECT w.*, EXISTS (SELECT 1 FROM m WHERE m.path = w.ahead) AS shut FROM walk w WHERE NOT loop AND w.ahead NOT IN (SELECT path FROM won)),
loops AS (SELECT path, least FROM walk WHERE loop),
steps AS (SELECT w.path, w.turn, l.least FROM walk w JOIN loops l USING (path) WHERE w.ahead = l.least)
SELECT e.path, v.target, NOT shut AS made, CASE WHEN shut THEN CASE WHEN e.turn = 0 THEN 'taken' ELSE 'blocked' END END AS reason, CASE WHEN NOT shut THEN e.turn END AS turn, NULL AS aside FROM ends e JOIN v USING (path)
UNION ALL SELECT s.path, v.target, true, NULL, s.turn, CASE WHEN s.path = s.least THEN s.path || '.moving' END FROM steps s JOIN v USING (path)
UNION ALL SELECT path, target, false, 'claimed', NULL, NULL FROM v WHERE nth > 1""",
    "governed_report": f"{_SQL}, {_ERRORS} SELECT count(*) = 0 AS valid, count(*) AS errors FROM errors",
    "governed_repairs": f"""{_SQL}, new AS (SELECT *, replace(replace(content, eol, nl), 'item-x.md]]', 'item-x]]') AS after,
CASE WHEN doc_type = 'rfc' AND folder <> status AND status <> 'odd' THEN 'w/doc/rfc/' || status || '/' || name
  WHEN doc_type = 'spec' AND folder <> category THEN 'w/doc/spec/' || category || '/' || name
  WHEN doc_type = 'project' AND folder = 'sub' THEN 'w/doc/project/' || name END AS target FROM corpus)
SELECT path, target, concat_ws(',', CASE WHEN k % 43 = 0 THEN 'normalize_line_endings' END, CASE WHEN k % 29 = 0 THEN 'normalize_wikilinks' END) AS fixes,
CASE WHEN after <> content THEN md5(after) END AS content_md5 FROM new WHERE target IS NOT NULL OR after <> content""",
    "extracted_metadata": f"""{_SQL} SELECT {_STEM} AS document_stem, 'extracted' AS status, 'yaml' AS format, CASE WHEN k % 23 <> 0 THEN 'Part ' || k END AS title,
code, slug, 'size-' || size || ',part' AS tags, {_AT} AS body_start FROM corpus""",
    "extracted_outline": f"{_SQL}, {_HEADS} SELECT {_STEM} AS document_stem, level, text, heading_id, outline, spot AS from_byte, spot + level + 1 + strlen(text) AS to_byte FROM heads",
    "extracted_links": f"""{_SQL}, w AS (SELECT *, 'rfc-00000003-item-x' || CASE WHEN k % 29 = 0 THEN '.md' ELSE '' END AS t FROM corpus), l AS (
SELECT {_STEM} AS document_stem, 'Wikilink' AS kind, '[[' || t || ']]' AS raw, t AS target, NULL AS label, NULL AS heading FROM w
UNION ALL SELECT {_STEM}, 'Inline', '[here](#use-it)', '', 'here', 'use-it' FROM w
UNION ALL SELECT {_STEM}, 'Autolink', '<https://example.com/' || k || '>', 'https://example.com/' || k, NULL, NULL FROM w)
SELECT *, strlen(raw) AS n_bytes FROM l""",
    "extracted_diagnostics": f"""{_SQL} SELECT {_STEM} AS document_stem, 'duplicate_anchor' AS kind, 'duplicate heading anchor `use-it`' AS message FROM corpus WHERE k % 31 = 0
UNION ALL SELECT {_STEM}, 'unresolved_reference_link', 'reference-style link `none` could not be resolved' FROM corpus WHERE k % 37 = 0""",
    "extracted_chunks": f"""{_SQL}, t AS (SELECT *, rtrim(body, nl) AS whole, strpos(body, '## Use It') AS p,
  CASE WHEN k % 31 = 0 THEN strpos(body, nl || '## Use It' || nl || nl || 'Again.') END AS q FROM corpus),
pieces AS (SELECT *, 0 AS o, 'Part ' || k AS outline, whole AS text FROM t
UNION ALL SELECT *, 1, 'Part ' || k || '/Use It', rtrim(CASE WHEN q IS NULL THEN whole[p:] ELSE body[p:q] END, nl) FROM t
UNION ALL SELECT *, 2, 'Part ' || k || '/Use It', whole[q + 1:] FROM t WHERE q IS NOT NULL)
SELECT {_STEM} AS document_stem, 'chunked' AS status, o AS chunk_ordinal, lpad(o::VARCHAR, 4, '0') AS place, true AS named, outline, replace(text, nl, eol) AS text,
len(regexp_extract_all(text, '\\S+')) AS tokens FROM pieces""",
    "governed_catalogue": f"{_SQL}, {_CATALOGUE} SELECT path, type, code, slug, folder, title FROM cat",
    "governed_tree": f"{_SQL}, {_CATALOGUE} SELECT type, folder, count(*) AS n, md5(string_agg(document_stem, ',' ORDER BY code)) AS stems_md5 FROM cat GROUP BY ALL",
    "governed_next_code": f"{_SQL}, {_CATALOGUE} SELECT type, max(code) + 1 AS next_code FROM cat GROUP BY ALL",
    "governed_dashboard": f"""{_SQL}, {_CATALOGUE} SELECT 0 AS section, 'Open' AS section_title, folder AS status, code, slug, document_stem FROM cat WHERE type = 'rfc' AND folder = 'draft'
UNION ALL SELECT 1, 'Shelves', folder, code, slug, document_stem FROM cat WHERE type = 'spec' AND folder IN ('cat-draft', 'cat-done')""",
    "governed_names": f"{_SQL}, {_CATALOGUE} SELECT path, type || '-' || lpad(code::VARCHAR, 8, '0') || '-' || slug || '.md' AS expected_name FROM cat",
    "governed_tags": "SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS tag FROM part)",
    "governed_types": """WITH t AS (SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g')) AS name, min(p_size) AS least FROM part GROUP BY 1)
SELECT string_agg('## ' || name || chr(10) || 'layout: ' || CASE least % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'category' ELSE 'directory' END, chr(10) || chr(10) ORDER BY name) AS listing FROM t""",
    "governed_packages": """SELECT n_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'git' ELSE 'file' END AS type, lower(n_name) AS url,
CASE WHEN n_regionkey % 2 = 1 THEN 'copy' WHEN n_nationkey % 3 = 0 THEN 'fetch' ELSE 'clone' END AS action FROM nation""",
    "prompt_texts": """SELECT p_partkey, p_name || ' of ' || p_brand || ' costs #{price}, says @' || lower(replace(p_brand, '#', '')) || '/x and @desk; not a@b ' || p_name AS text,
'price' AS unresolved, lower(replace(p_brand, '#', '')) || '/x,desk' AS mentions FROM part""",
    "failure_kinds": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'store_missing' WHEN 1 THEN 'store_incompatible' WHEN 2 THEN 'invalid_request'
WHEN 3 THEN 'store_missing' ELSE 'internal' END AS kind FROM events""",
}
