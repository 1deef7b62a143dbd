"""Catalogue, dashboard, package and prompt operators over small tables of governed documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import padded_code, stem_parts


def catalogue(records: DataFrame) -> DataFrame:
    """records(path, document_stem, title) with type, code, slug, folder and title (else the slug)."""
    parts = stem_parts(F.col("document_stem"))
    rows = records.withColumn("p", parts).where("p.type is not null")
    return rows.select("path", "document_stem", "p.type", "p.code", "p.slug", F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("folder"), F.coalesce("title", "p.slug").alias("title"))


def sorted_catalogue(rows: DataFrame) -> DataFrame:
    return rows.orderBy("code", F.collate("slug", "UNICODE"))


def tree(rows: DataFrame) -> DataFrame:
    """type, folder, documents in order."""
    return rows.groupBy("type", "folder").agg(F.array_sort(F.collect_list(F.struct("code", "slug", "document_stem", "title"))).alias("documents"))


def group_filter(rows: DataFrame, kind: str = "all", value: str | None = None) -> DataFrame:
    return rows if kind == "all" else rows.where(F.col("folder") == value)


def dashboard(rows: DataFrame, sections: Sequence[dict]) -> DataFrame:
    """title, status, code, slug, document_stem of each section without an error."""
    out = None
    for k, s in enumerate(x for x in sections if not x["error"]):
        chosen = rows.where(F.col("type") == s["doc_type"])
        if folders := [*s["statuses"], *s["categories"]]:
            chosen = chosen.where(F.col("folder").isin(folders))
        part = chosen.select(F.lit(k).alias("section"), F.lit(s["title"]).alias("section_title"), F.col("folder").alias("status"), "code", "slug", "document_stem")
        out = part if out is None else out.unionByName(part)
    return out


def next_code(rows: DataFrame, doc_type: str) -> DataFrame:
    return rows.where(F.col("type") == doc_type).agg((F.coalesce(F.max("code"), F.lit(0)) + 1).cast("long").alias("next_code"))


def find(rows: DataFrame, doc_type: str, code: int) -> DataFrame:
    """The document of a type and code, the first by path."""
    return rows.where((F.col("type") == doc_type) & (F.col("code") == code)).orderBy(F.split("path", "/")).limit(1)


def by_stem(rows: DataFrame, stem: str) -> DataFrame:
    return rows.where(F.col("document_stem") == stem).orderBy(F.split("path", "/")).limit(1)


def only(rows: DataFrame, where: Column) -> DataFrame:
    """One row: the match and why there is none (no match, or several)."""
    return rows.where(where).agg(F.count("*").alias("matches"), F.min("path").alias("first")).select(F.when(F.col("matches") == 1, F.col("first")).alias("path"), F.when(F.col("matches") == 0, "not found").when(F.col("matches") > 1, "ambiguous").alias("reason"))


def target_path(doc_type: str, layout: str, code: int, slug: str, width: int, folder: str | None = None) -> str:
    """Where a new document goes."""
    name = f"{doc_type}-{code:0{width}d}-{slug}.md"
    return "/".join(x for x in ("doc", doc_type, folder if layout != "directory" else None, name) if x)


def file_names(rows: DataFrame, width: int) -> DataFrame:
    return rows.select("*", F.concat(F.concat_ws("-", "type", padded_code(F.col("code"), width), "slug"), F.lit(".md")).alias("expected_name"))


def tags(types: DataFrame) -> DataFrame:
    """The distinct tags of types(tags) in order, as one text."""
    return types.select(F.explode("tags").alias("t")).agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("tags"))


def type_listing(types: DataFrame) -> DataFrame:
    """types(name, layout) as one text block a type, in order of their names."""
    block = F.concat(F.lit("## "), F.col("name"), F.lit("\nlayout: "), F.col("layout"))
    return types.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("listing"))


def package_plan(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """manifest(name, type, url, tag) with what synchronising does: clone or fetch, or copy."""
    rows = manifest.join(F.broadcast(present.select("name", F.lit(True).alias("there"))), "name", "left")
    return rows.select("name", "type", "url", "tag", F.when(F.col("type") == "file", "copy").when(F.col("there"), "fetch").otherwise("clone").alias("action"))


def prompt_bodies(rules: DataFrame, files: DataFrame, languages: Sequence[str], kind: str) -> DataFrame:
    """One row: the bodies of the languages' prompt files in the order asked for; files must be unambiguous.

    rules(language, kind, stem), files(stem, body).
    """
    from lodestone.functions import frontmatter as fm

    strip = F.udf(fm.without, "string", useArrow=True)
    asked = rules.sparkSession.createDataFrame(list(enumerate(languages)), "position int, language string")
    named = asked.join(rules.where((F.col("kind") == kind) & (F.col("stem") != "none")), "language")
    found = named.join(files, "stem", "left").groupBy("position", "stem").agg(F.count("body").alias("n"), F.min("body").alias("body"))
    checked = F.when(F.col("n") == 1, strip("body")).otherwise(F.raise_error(F.concat(F.col("stem"), F.lit(" matches "), F.col("n").cast("string"), F.lit(" files"))).cast("string"))
    one = found.select("position", checked.alias("body"))
    return one.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "body"))), lambda x: x["body"]), "\n\n").alias("prompt"))


def substitute(text: Column, values: Column) -> Column:
    """#{name} replaced by a map's values; unknown names stay."""
    return F.aggregate(F.map_entries(values), text, lambda t, e: F.replace(t, F.concat(F.lit("#{"), e["key"], F.lit("}")), e["value"]))


def unresolved(text: Column, values: Column) -> Column:
    """The distinct names without a value, in order of appearance."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(r"#\{([^}]+)\}"), F.lit(1))), F.map_keys(values))


def form_fields(text: Column) -> Column:
    """key and kind of each line ``key = input(...)`` or ``key = chat-input(...)``."""
    pattern = r"^\s*([A-Za-z][\w-]*)\s*=\s*(input|chat-input)\((.*)\)\s*$"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("key"), F.regexp_extract(x, pattern, 2).alias("kind"), F.regexp_extract(x, pattern, 3).alias("arguments")))


def mentions(text: Column) -> Column:
    """Distinct @-mentions in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|(?<=\s))@([\w./-]+)"), F.lit(1)))


def failure_kind(error: Column) -> Column:
    """An error text's class; the first that fits."""
    low = F.lower(error)
    return (
        F.when(low.contains("not found") | low.contains("missing store"), "store_missing")
        .when(low.contains("dimension") | low.contains("incompatible"), "store_incompatible")
        .when(low.contains("blank") | low.contains("limit"), "invalid_request")
        .otherwise("internal")
    )
