"""python -m lodestone.cli init | update-database | search QUERY | validate, in a workspace."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from lodestone.functions.embedding import HashingEmbedder
from lodestone.operators import retrieval, validate
from lodestone.plans import reconcile, search
from lodestone.session import session
from lodestone.sources import config, discovery
from lodestone.sources.store import Store

STORE = ".lodestone/store"
TYPES = ".lodestone/document-types.yaml"


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--workspace", default=".")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--dimension", type=int, default=384)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    u = sub.add_parser("update-database")
    u.add_argument("--package", action="append", default=[])
    u.add_argument("--json", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--package")
    s.add_argument("--document")
    s.add_argument("--limit", type=int, default=retrieval.RESULT_LIMIT)
    s.add_argument("--json", action="store_true")
    sub.add_parser("validate")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = _arguments(argv)
    spark = session(master=a.master)
    embedder = HashingEmbedder(a.dimension)
    store = Store(spark, f"{a.workspace}/{STORE}", embedder.model, embedder.dimension)
    if a.command == "init":
        store.ensure()
        return 0
    if a.command == "update-database":
        records, issues = discovery.discover(spark, a.workspace, a.package)
        out = reconcile.reconcile(spark, store, records, embedder)
        out["failures"] += [{"package": r.package, "document_stem": r.stem, "error_kind": r.kind, "error": r.path} for r in discovery.ordered_issues(issues).collect()]
        print(json.dumps(out, indent=None if a.json else 2))
        return int(bool(out["failures"]))
    if a.command == "search":
        one = search.context(store, embedder, a.query, a.package, a.document, a.limit)
        if a.json:
            print(retrieval.render_json(one).first().json)
        else:
            for c in one.first().chunks:
                print(f"{c.context_id}  {c.citation}  ({c.token_count} tokens)\n{c.text}\n")
        return 0
    types = config.document_types(spark.read.text(f"{a.workspace}/{TYPES}", wholetext=True).first()[0])
    files = discovery.with_names(discovery.files(spark, [f"{a.workspace}/{discovery.CORPUS_ROOT}"]))
    documents = files.withColumn("doc_type", F.regexp_extract("path", r"/doc/([^/]+)/", 1)).where((F.col("extension") == "md") | ~F.col("file_name").contains("."))
    stems = documents.select(F.col("document_stem").alias("stem"))
    n = 0
    for n, e in enumerate(validate.validate(documents.select("path", "doc_type", "content"), types, stems).orderBy("path", "error").toLocalIterator(), 1):
        print(f"{e.path}: {e.error}")
    return int(n > 0)


if __name__ == "__main__":
    sys.exit(main())
