import importlib

import pytest

from lodestone.plans import governed, queries
from tests.oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", [*queries.QUERIES, *governed.QUERIES])
def test_query_equals_its_sql(spark, sf_dir, name):
    columns, rows = spark_rows({**queries.QUERIES, **governed.QUERIES}[name](spark, sf_dir))
    assert (columns, rows) == sql_rows({**queries.ORACLE, **governed.ORACLE}[name], sf_dir) and columns


def test_catalogue_tree_holds_all_orders(spark, tmp_path):
    spark.range(0, 25000).selectExpr("id o_orderkey", "if(id % 2 = 0, 'O', 'F') o_orderstatus", "'1-URGENT' o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    rows = queries.catalogue_tree_whole(spark, str(tmp_path)).collect()
    assert sorted(int(k) for r in rows for k in r["keys"].split(",")) == list(range(25000))
    assert len(rows) == 6 and all(len(r["keys"].split(",")) == r.n <= 10000 for r in rows)


def test_whole_merge_takes_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    assert [side.count() for side in queries._whole_merge_sides(docs)] == [n, n]
    stay = docs.where("doc_id % 50 = 49").count()
    away = docs.where("doc_id % 4 = 1 and doc_id % 50 <> 49").count()
    assert queries.merge_upsert_whole(spark, sf_dir).count() == n + stay
    assert queries.merge_counts_whole(spark, sf_dir).first().asDict() == {"inserted": away + stay, "updated": n - away - stay, "deleted": away}


def _documents(spark, tmp_path, *texts):
    rows = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")


def test_chunk_paragraphs_by_brute_force(spark, tmp_path):
    import hashlib

    def block(n, c):
        return " ".join(f"{c}{i}" for i in range(n))

    texts = [block(3, "a"), "", None, block(1200, "b"), "\n\n".join([block(200, "c"), block(140, "d"), block(400, "e"), block(90, "f")]), " \n"]
    _documents(spark, tmp_path, *texts)

    def packed(text):  # up to 350 words, or up to 500 while there are fewer than 350
        blocks = []
        for b in text.split("\n\n"):
            w = b.split()
            blocks += [w[i : i + 500] for i in range(0, len(w), 500)]
        if len(text.split()) <= 500:
            return [text]
        out, now = [], []
        for b in blocks:
            n, more = sum(map(len, now)), sum(map(len, now)) + len(b)
            if now and not (more <= 350 or more <= 500 and n < 350):
                out.append(now)
                now = [now[-1]] if len(now[-1]) <= OVERLAP and len(now[-1]) + len(b) <= 500 else []
            now.append(b)
        return ["\n\n".join(map(" ".join, x)) for x in [*out, now]]

    from lodestone.functions.markdown import Config

    OVERLAP = Config().overlap or 0
    want = {(k, i, len(p.split()), hashlib.sha256(p.encode()).hexdigest()) for k, t in enumerate(texts) if t and t.strip() for i, p in enumerate(packed(t))}
    rows = importlib.import_module("__spark_entry__").queries()["chunk_paragraphs"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.chunk_ordinal, r.token_count, r.text_sha256) for r in rows if r.status == "chunked"} == want
    assert sorted(r.doc_id for r in rows if r.status == "failed") == [1, 2, 5]


def test_stem_dictionary_match_by_brute_force(spark, tmp_path):
    import re

    texts = ["one two-3 One one. one/two `one` [[one]] x-one one.md two", None, "", "four\n```\none\n```\none (two-3)", "nothing"]
    _documents(spark, tmp_path, *texts)
    spark.createDataFrame([(0, "One two-3"), (1, "TWO, one"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    for k, t in enumerate(texts):
        free = re.sub(r"```.*?```|`[^`]*`|\[\[.*?\]\]", " ~ ", t or "", flags=re.S)
        for w in re.split(r"[^A-Za-z0-9_/.-]+", free):
            if (w := w.rstrip(".")) in ("one", "two-3", "two"):
                want[k, w] = want.get((k, w), 0) + 1
    rows = importlib.import_module("__spark_entry__").queries()["stem_dictionary_match"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.stem): r.n for r in rows} == want and len(rows) == len(want) and want[0, "one"] == 2


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_optional_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(x.startswith('op') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    import re

    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    from pyspark.sql import functions as F

    from lodestone.operators import retrieval

    p = plan(retrieval.semantic_topk(emb, [0.0] * 64, "vec_id", "embedding", where=F.col("label") == 3))
    assert "TakeOrderedAndProject" in p and "EqualTo(label,3)" in p and "Exchange hashpartitioning" not in p
    assert "LeftAnti" in plan(queries.stale_documents(spark, sf_dir))
    assert "WindowGroupLimit" in plan(queries.section_dedup(spark, sf_dir))
    assert re.search(r"ReadSchema: struct<(doc_id|text):\w+,(doc_id|text):\w+>", plan(queries.lexical_bm25_topk(spark, sf_dir)))


@pytest.mark.parametrize("name", ["rrf_fusion", "merge_upsert", "adjacent_expansion"])
def test_results_dont_depend_on_partitions(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(spark_rows(queries.QUERIES[name](spark, sf_dir)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
