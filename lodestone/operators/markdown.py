"""Markdown operators over tables of documents(package, document_stem, document_hash, content)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import frontmatter as fm
from lodestone.functions import markdown as md

_EXTRACTED = (
    "status string, error_kind string, error string, format string, frontmatter string, tags array<string>, body_start int, "
    "headings array<struct<level:int,text:string,anchor:string,ordinal:int,path:array<string>,start:int,end:int>>, "
    "links array<struct<kind:string,raw:string,target:string,label:string,heading:string,start:int,end:int>>, "
    "diagnostics array<struct<kind:string,message:string,start:int,end:int>>"
)


def _extracted(content) -> dict:
    """What extraction finds; a content that is missing, isn't UTF-8 or is nested too deep is a failure like others."""
    failed = lambda kind, error: {"status": "failed", "error_kind": kind, "error": error}
    if content is None:
        return failed("no_content", "the document has no content")
    try:
        e = md.extract(bytes(content).decode())
        fm.to_json(e.get("metadata"))  # which recurses as well
        return e
    except UnicodeDecodeError:
        return failed("encoding", "not UTF-8")
    except RecursionError:
        return failed("malformed_frontmatter", "nested too deep")


def extract(documents: DataFrame) -> DataFrame:
    """The documents' columns but for the content, and what extraction finds; a failure is a row with an error."""
    keys = [f for f in documents.schema if f.name != "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content in pdf.pop("content"):
                e = _extracted(content)
                e["frontmatter"] = fm.to_json(e.get("metadata"))
                e["tags"] = fm.filterable(e.get("metadata")).get("tags")
                rows.append([e.get(k) for k in ("status", "error_kind", "error", "format", "frontmatter", "tags", "body_start", "headings", "links", "diagnostics")])
            out = pd.DataFrame(rows, columns=["status", "error_kind", "error", "format", "frontmatter", "tags", "body_start", "headings", "links", "diagnostics"], dtype=object)
            yield pd.concat([pdf.reset_index(drop=True), out], axis=1)

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    return documents.select(*(f.name for f in keys), "content").mapInPandas(run, f"{ddl}, {_EXTRACTED}")


_CHUNK = "package string, document_stem string, document_hash string, status string, error_kind string, error string, chunk_id string, chunk_hash string, chunk_ordinal int, heading_path array<string>, frontmatter string, text string, token_count int"


def chunks(documents: DataFrame, config: md.Config = md.Config()) -> DataFrame:
    """One row a chunk; a document that fails (or has no text) is one row with status 'failed'."""

    def of(package, stem, digest, content) -> list[tuple]:
        e = _extracted(content)
        if e["status"] == "failed":
            return [(package, stem, digest, "failed", e["error_kind"], e["error"])]
        try:
            meta = fm.to_json(e["metadata"])
            found = md.chunk(package, stem, e, config)
        except md.OversizedBlock as x:
            return [(package, stem, digest, "failed", "oversized_block", str(x))]
        if not found:
            return [(package, stem, digest, "failed", "no_chunks", "the document has no text")]
        return [(package, stem, digest, "chunked", None, None, c["chunk_id"], c["chunk_hash"], c["chunk_ordinal"], c["heading_path"], meta, c["text"], c["token_count"]) for c in found]

    names = [x.split()[0] for x in _CHUNK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r + (None,) * (len(names) - len(r)) for d in pdf.itertuples(index=False) for r in of(*(None if isinstance(x, float) else x for x in d))]
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out.astype({"chunk_ordinal": "Int32", "token_count": "Int32"})

    return documents.select("package", "document_stem", "document_hash", "content").mapInPandas(run, _CHUNK)


def link_edges(extracted: DataFrame) -> DataFrame:
    """The links of all documents as edges."""
    return extracted.where("status = 'extracted'").select("package", "document_stem", F.explode("links").alias("l")).select("package", "document_stem", "l.*")


def heading_outline(extracted: DataFrame) -> DataFrame:
    """Headings with identifiers of their own: the anchor, then anchor-2, anchor-3 ..."""
    from pyspark.sql import Window

    rows = extracted.select("package", "document_stem", F.explode("headings").alias("h")).select("package", "document_stem", "h.*")
    n = F.row_number().over(Window.partitionBy("package", "document_stem", "anchor").orderBy("ordinal"))
    return rows.withColumn("heading_id", F.when(n == 1, F.col("anchor")).otherwise(F.concat("anchor", F.lit("-"), n.cast("string"))))
