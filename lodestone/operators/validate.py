"""Rules over governed documents, and plans to repair what they find.

documents(path, doc_type, content): one row a file below doc/<type>. Rules are columns, so a
document is looked at once. For stems that are mentioned outside links, each text gives its candidate words
with their places, and a join keeps those that are in the table of stems: stems stay a table, whatever their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from lodestone.functions import frontmatter as fm
from lodestone.functions.text import KEBAB
from lodestone.sources.config import DocumentType

REQUIRED = ("id", "type", "code", "slug", "title", "description", "created", "tags")
BOM = b"\xef\xbb\xbf"
#: Over how many keys the mentions of one stem are dealt: a stem that a third of all documents name is no one task's.
SALTS = 8
#: Places of candidates that a task packs by word before it sends them; texts that Python unpacks at once.
HELD, TEXTS = 1 << 18, 64
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9_/-])[a-z0-9-]+(?:/[a-z0-9-]+)?(?![A-Za-z0-9_/-])(?!\.[A-Za-z0-9])")
_PROTECTED = re.compile(r"\[\[.*?\]\]|`[^`]*(?:`|\Z)|[A-Za-z0-9+.-]*://[^\s)\]]*")


def candidates(content: str) -> list[tuple[str, int, int]]:
    """(word, from, to) of the words of a body's text, outside links, code and addresses, that may be stems.

    A candidate is a whole run of a stem's characters, so no two overlap and the longest stem at a place is the only one.
    """
    pieces = content.split("---", 2)
    at = len(content) - len(pieces[2]) if len(pieces) == 3 else 0
    out, fenced = [], False
    for line in content[at:].splitlines(keepends=True):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced:
            shielded = [m.span() for m in _PROTECTED.finditer(line)] if any(x in line for x in ("`", "[[", "://")) else []
            k = 0  # both are in order
            for m in _CANDIDATE.finditer(line):
                a, b = m.span()
                while k < len(shielded) and shielded[k][1] <= a:
                    k += 1
                if k == len(shielded) or b <= shielded[k][0]:
                    out.append((m[0], at + a, at + b))
        at += len(line)
    return out


def bare_stems(content: str, stems: frozenset[str]) -> list[tuple[str, int, int]]:
    """Those of a text's candidates that are among these stems."""
    return [x for x in candidates(content) if x[0] in stems]


def stem_mentions(texts: DataFrame, key: str, stems: DataFrame) -> DataFrame:
    """key, stem, start, end: the known stems(stem) that texts(key, text) name bare, by a join; null texts and stems have none.

    A task packs its candidates by word before it sends them, so that the exchange has a row for a word and HELD
    places, not one for a place, and Python never holds more than these.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}  # of a word: keys, starts
        n = 0

        def sent(kind: pa.DataType) -> pa.RecordBatch:
            keys, starts = ([x[i] for x in held.values()] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(keys, pa.list_(kind)), pa.array(starts, pa.list_(pa.int32()))], names=["stem", "keys", "starts"])

        for b in batches:
            kind = b.column(0).type
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                for k, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    for word, start, _ in candidates(t) if t else ():
                        if (lists := held.get(word)) is None:
                            lists = held[word] = ([], [])
                        lists[0].append(k)
                        lists[1].append(start)
                        n += 1
                    if n >= HELD:
                        yield sent(kind)
                        held.clear()
                        n = 0
        if held:
            yield sent(kind)

    of = texts.schema[key].dataType.simpleString()
    words = texts.select(key, "text").mapInArrow(packed, f"stem string, keys array<{of}>, starts array<int>")
    salted = words.withColumn("salt", F.pmod(F.xxhash64(F.get("keys", F.lit(0)), F.get("starts", F.lit(0))), F.lit(SALTS)).cast("int"))
    known = stems.select("stem").where("stem is not null").distinct().select("stem", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # by exchange: what Spark guesses of an exploded table's size is too little, and stems may be many
    found = salted.join(known.hint("merge"), ["stem", "salt"], "left_semi")
    rows = found.select("stem", F.explode(F.arrays_zip("keys", "starts")).alias("x"))
    start = F.col("x.starts")
    return rows.select(F.col("x.keys").alias(key), "stem", start.alias("start"), (start + F.length("stem")).alias("end"))


def stem_table(spark, stems: DataFrame | Sequence[str]) -> DataFrame:
    return stems if isinstance(stems, DataFrame) else spark.createDataFrame([(s,) for s in sorted(set(stems))], "stem string")


def stem_dictionary(workspace: DataFrame, packages: DataFrame) -> DataFrame:
    """Distinct stems of workspace(document_stem) and package/stem of packages(package, document_stem), longest first."""
    every = workspace.select(F.col("document_stem").alias("stem")).union(packages.select(F.concat_ws("/", "package", "document_stem")))
    return every.distinct().orderBy(F.desc(F.length("stem")), "stem")


def _fields(content: Column) -> Column:
    """A document's flat frontmatter as a map."""
    return F.udf(lambda c: None if c is None else fm.governed_fields(c), MapType(StringType(), StringType()), useArrow=True)(content)


def _rule(bad: Column, message: Column) -> Column:
    return F.when(bad, message)


def _say(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _listed(values: Column) -> Column:
    return _say("[", F.array_join(F.transform(values, lambda v: _say('"', v, '"')), ", "), "]")


def validate(documents: DataFrame, types: Sequence[DocumentType], stems: DataFrame | Sequence[str] = (), top_folders: Sequence[str] = ()) -> DataFrame:
    """path, error: one row for each rule that a document breaks; stems(stem) are those that should be links.

    A document without content, or of a type that isn't configured, is one row that says so.
    """
    spark = documents.sparkSession
    config = spark.createDataFrame([(t.name, t.layout, t.statuses) for t in types], "doc_type string, layout string, statuses array<string>")
    status_folders = sorted({s for t in types for s in t.statuses})
    parts = F.split("path", "/")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    crlf = F.instr(text, "\r\n") > 0
    encoding = (
        F.when(F.col("content").isNull(), "file has no content")
        .when(F.substring("content", 1, 3) == F.lit(BOM), "file starts with a UTF-8 byte order mark")
        .when(text.isNull(), "file is not valid UTF-8")
        .when(crlf, "file has CRLF line endings")
    )
    unknown = documents.join(F.broadcast(config), "doc_type", "left_anti").select("path", _say("Unknown document type '", F.coalesce("doc_type", F.lit("")), "'").alias("error"))
    rows = documents.join(F.broadcast(config), "doc_type").select(
        "path", "doc_type", "layout", "statuses", F.element_at(parts, -1).alias("name"), F.try_element_at(parts, F.lit(-2)).alias("folder"), encoding.alias("encoding"), text.alias("text")
    )
    rows = rows.withColumn("fields", _fields(F.when(F.col("encoding").isNull(), F.col("text"))))
    f = lambda k: F.try_element_at("fields", F.lit(k))
    has = lambda k: F.coalesce(F.map_contains_key("fields", F.lit(k)), F.lit(False))
    status, category, slug, folder = f("status"), f("category"), f("slug"), F.col("folder")
    layout = lambda x: F.col("layout") == x
    kind = (
        F.when(slug == "", "Slug cannot be empty")
        .when(slug.startswith("-") | slug.endswith("-"), "Slug must not start or end with a hyphen")
        .when(slug.contains("--"), "Slug must not contain consecutive hyphens")
        .when(~slug.rlike(r"^[a-z0-9-]+\z"), "Slug must contain only lowercase ASCII letters, ASCII digits, and hyphens")
    )
    expected = _say(F.col("doc_type"), "-", F.coalesce(f("code"), F.lit("")), "-", F.coalesce(slug, F.lit("")), ".md")
    of_fields = F.array(
        *(_rule(~has(k), F.lit(f"Missing required frontmatter field: {k}")) for k in REQUIRED),
        _rule(kind.isNotNull(), _say("Invalid slug: ", kind)),
        _rule(layout("status") & ~has("status"), F.lit("Missing required frontmatter field: status")),
        _rule(layout("status") & status.isNotNull() & ~F.array_contains("statuses", status), _say("Invalid status '", status, "'. Allowed: ", _listed(F.col("statuses")))),
        _rule(layout("status") & folder.isin(status_folders) & (folder != status), _say("File is in folder '", folder, "' but frontmatter status is '", status, "'")),
        _rule(layout("category") & ~has("category"), F.lit("Missing required frontmatter field: category")),
        _rule(layout("category") & ~folder.isin(list(top_folders)) & (folder != category), _say("File is in folder '", folder, "' but frontmatter category is '", category, "'")),
        _rule(layout("directory") & (folder != F.col("doc_type")), _say("File for directory-based layout must be directly under 'doc/", F.col("doc_type"), "' (found in '", folder, "')")),
        _rule(F.col("name") != expected, _say("Filename '", F.col("name"), "' does not match pattern '{doc_type}-{code}-{slug}.md' (expected: '", expected, "')")),
    )
    first_link = lambda line: F.regexp_extract(line, r"^(?:(?!\[\[|\]\]).)*\[\[((?:(?!\]\]).)+)\]\]", 1)
    links = F.filter(F.transform(F.split("text", "\n"), first_link), lambda x: F.lower(x).rlike(r"[^/]\.md\z"))
    wiki = F.transform(links, lambda x: _say("Wikilink '", x, "' should not include .md extension"))
    names = F.filter(F.regexp_extract_all("text", F.lit(r"#\{([^}]+)\}"), F.lit(1)), lambda x: ~x.rlike(KEBAB))
    placeholders = F.transform(names, lambda x: _say("Invalid substitution variable '#{", x, "}'; variable names must be kebab-case"))
    none = F.array().cast("array<string>")
    errors = (
        F.when(F.col("encoding").isNotNull(), F.array("encoding"))
        .when(F.col("fields").isNull(), F.array(F.lit("Missing or malformed frontmatter")))
        .otherwise(F.concat(F.when(F.col("doc_type") == "template", none).otherwise(F.array_compact(of_fields)), wiki, placeholders))
    )
    out = rows.select("path", F.explode(errors).alias("error")).unionByName(unknown)
    if not isinstance(stems, DataFrame) and not stems:
        return out
    # a column, not a filter: Spark would push a filter below what makes the text and write that out for each use, too long to be compiled
    read = rows.select("path", F.when(F.col("encoding").isNull() & F.col("fields").isNotNull(), F.col("text")).alias("text"))
    named = stem_mentions(read, "path", stem_table(spark, stems))
    return out.unionByName(named.select("path", _say("Bare governed document stem '", F.col("stem"), "' should be a wikilink; expected '[[", F.col("stem"), "]]'").alias("error")))


def report(errors: DataFrame) -> DataFrame:
    """valid, errors: one row."""
    return errors.agg((F.count("*") == 0).alias("valid"), F.array_sort(F.collect_list(F.struct("path", "error"))).alias("errors"))


# --- repairs: rewritten contents and moves, as rows; a driver step applies them


#: The repairs that need neither stems nor a move, in their order.
_EARLY = (("normalize_line_endings", lambda t: t.replace("\r\n", "\n")), ("normalize_wikilinks", lambda t: re.sub(r"\[\[([^\]]+)\.md\]\]", r"[[\1]]", t)))


def repaired(content: bytes, stems: frozenset[str]) -> tuple[bytes, list[str]]:
    """A file's content after the repairs that need no move, and which were made."""
    made = []
    if content.startswith(BOM):
        try:
            content[3:].decode()
            content, made = content[3:], ["remove_bom"]
        except UnicodeDecodeError:
            return content, made
    try:
        text = content.decode()
    except UnicodeDecodeError:
        return content, made
    for name, new in (*_EARLY, ("link_bare_stems", lambda t: linked(t, stems)), ("normalize_heading", headed)):
        if (after := new(text)) != text:
            text = after
            made.append(name)
    return text.encode(), made


def linked(text: str, stems: frozenset[str]) -> str:
    for s, a, b in reversed(bare_stems(text, stems)):
        text = f"{text[:a]}[[{s}]]{text[b:]}"
    return text


def headed(text: str) -> str:
    """The first line of the body as a heading, unless it is one or empty."""
    body = fm.without(text)
    start = len(text) - len(body)
    first = body.split("\n", 1)[0]
    if body.startswith("\n# ") or not first or first.startswith("#"):
        return text
    return f"{text[:start]}# {first.strip()}{text[start + len(first):]}"


def repair_plan(documents: DataFrame, types: Sequence[DocumentType], stems: DataFrame | Sequence[str] = ()) -> DataFrame:
    """path, target (a new place or null), content (rewritten or null), fixes: of the files to be changed. A file without content stays."""
    config = documents.sparkSession.createDataFrame([(t.name, t.layout, t.statuses) for t in types], "doc_type string, layout string, statuses array<string>")

    @F.pandas_udf("content binary, fixes array<string>")
    def fixed(contents: pd.Series, named: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, []) if c is None else repaired(bytes(c), frozenset(() if n is None else n)) for c, n in zip(contents, named)], columns=["content", "fixes"], dtype=object)

    rows = documents.join(F.broadcast(config), "doc_type")
    if isinstance(stems, DataFrame) or stems:
        # which stems a file names is known by a join; the file itself is then written with those only
        plain = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
        early = F.regexp_replace(F.replace(plain, F.lit("\r\n"), F.lit("\n")), r"\[\[([^\]]+)\.md\]\]", "[[$1]]")
        mentions = stem_mentions(rows.select("path", early.alias("text")), "path", stem_table(rows.sparkSession, stems))
        rows = rows.join(mentions.groupBy("path").agg(F.collect_set("stem").alias("named")), "path", "left")
    else:
        rows = rows.withColumn("named", F.array().cast("array<string>"))
    rows = rows.withColumn("new", fixed("content", "named")).withColumn("fields", _fields(F.col("new.content").cast("string")))
    parts = F.split("path", "/")
    name, folder = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    status, category = F.try_element_at("fields", F.lit("status")), F.try_element_at("fields", F.lit("category"))
    above = lambda n: F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - n, F.lit(0))), "/")
    base = F.regexp_extract("path", r"^(.*?(?:^|/)doc/[^/]+)/", 1)
    target = (
        F.when((F.col("layout") == "status") & F.array_contains("statuses", status) & F.array_contains("statuses", folder) & (folder != status), F.concat_ws("/", above(2), status, name))
        .when((F.col("layout") == "category") & (category != "") & (folder != category), F.concat_ws("/", base, category, name))
        .when((F.col("layout") == "directory") & (folder != F.col("doc_type")), F.concat_ws("/", base, name))
    )
    rows = rows.select("path", F.when(target != F.col("path"), target).alias("target"), F.when(F.size("new.fixes") > 0, F.col("new.content")).alias("content"), F.col("new.fixes").alias("fixes"))
    return rows.where("target is not null or content is not null")
