import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions.embedding import HashingEmbedder
from lodestone.operators import retrieval
from lodestone.plans.reconcile import reconcile
from lodestone.plans.search import context, search
from lodestone.sources.store import SCHEMA, IncompatibleStore, MissingStore, Store
from lodestone.streaming.indexing import index_stream


class Markers:
    """Embeddings by what a text holds, far away without a mark."""

    model, dimension = "markers", 3

    def __init__(self, marks):
        self.marks = marks

    def embed(self, texts):
        return [next((v for k, v in self.marks.items() if k in t), [1000.0] * 3) for t in texts]


def table(spark, rows):
    return spark.createDataFrame([(p, s, f"/w/doc/{s}.md", hashlib.sha256(t.encode()).hexdigest(), bytearray(t.encode())) for p, s, t in rows], "package string, document_stem string, path string, document_hash string, content binary")


def doc(title, body):
    return f"---\ntitle: {title}\n---\n\n# {title}\n\n{body}\n"


def test_reconcile(spark, tmp_path):
    e = HashingEmbedder(8)
    store = Store(spark, str(tmp_path / "s"), e.model, e.dimension)
    two = doc("A", "intro") + "\n## One\n\nfirst\n\n## Two\n\nsecond\n"
    rows = [(None, "spec-1-a", two), ("pkg", "spec-1-a", doc("B", "other")), (None, "spec-2-b", doc("C", "third")), (None, "spec-3-bad", "---\na: [b\n---\n"), (None, "spec-4-empty", "# only\n")]
    r = reconcile(spark, store, table(spark, rows), e)
    assert (r["reindexed"], r["skipped"], r["deleted"]) == (3, 0, 0)
    assert [(f["document_stem"], f["error_kind"]) for f in r["failures"]] == [("spec-3-bad", "malformed_frontmatter"), ("spec-4-empty", "no_chunks")]
    again = reconcile(spark, store, table(spark, rows), e)
    assert (again["reindexed"], again["skipped"], again["embedded"]) == (0, 3, 0)
    rows[0] = (None, "spec-1-a", two.replace("second", "changed"))
    r = reconcile(spark, store, table(spark, [x for x in rows if x[1] != "spec-2-b"]), e)
    assert (r["reindexed"], r["skipped"], r["deleted"], r["embedded"]) == (1, 1, 1, 2)  # the section and the one around it
    assert {(d.package, d.document_stem) for d in store.documents().collect()} == {(None, "spec-1-a"), ("pkg", "spec-1-a")}
    rows[0] = (None, "spec-1-a", "---\na: [b\n---\n")  # fails: old rows stay
    reconcile(spark, store, table(spark, rows[:2]), e)
    assert store.documents().count() == 2
    assert store.delete_document(None, "spec-1-a") == 3 and store.delete_document(None, "spec-1-a") == 0
    assert store.is_indexed("pkg", "spec-1-a", hashlib.sha256(rows[1][2].encode()).hexdigest()) and not store.is_indexed(None, "spec-1-a", "x")


def test_store_contract(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "m", 3)
    with pytest.raises(MissingStore):
        store.rows()
    store.ensure()
    assert store.rows().count() == 0
    with pytest.raises(IncompatibleStore):
        Store(spark, str(tmp_path / "s"), "m", 4).ensure()
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path), " ", 3)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    e = Markers({"find": [0.0, 0, 0], "MIXED_ALPHA": [1.0, 0, 0], "MIXED_BETA": [2.0, 0, 0], "MIXED_GAMMA": [3.0, 0, 0]})
    store = Store(spark, str(tmp_path_factory.mktemp("store") / "s"), e.model, e.dimension)
    rows = [
        (None, "spec-1-alpha", doc("Alpha", "MIXED_ALPHA filler needle")), (None, "spec-2-beta", doc("Beta", "MIXED_BETA needle needle")), (None, "spec-3-gamma", doc("Gamma", "MIXED_GAMMA needle")),
        *((None, f"spec-{i}-decoy", doc(f"Decoy {i}", f"text {i}")) for i in range(10, 34)), ("pkg", "spec-1-alpha", doc("Alpha", "packaged needle")),
        (None, "spec-9-long", "# Long\n\n## Section\n\n" + "\n\n".join(f"paragraph {i} " + "word " * 290 for i in range(3))),
    ]
    reconcile(spark, store, table(spark, rows), e)
    return store, e


def test_fusion(indexed):
    rows = {r.document_stem: r for r in search(*indexed, "find needle").where("package is null").collect()}
    beta, alpha = rows["spec-2-beta"], rows["spec-1-alpha"]
    assert (alpha.semantic_rank, beta.semantic_rank) == (1, 2) and beta.lexical_rank == 1
    assert beta.rrf_score == pytest.approx(1 / 62 + 1 / 61, abs=1e-6) and beta.position < alpha.position


def test_exact_names_and_filters(indexed):
    store, e = indexed
    for q in ("spec-20-decoy", "spec-20-decoy.md"):
        assert search(store, e, q).where("document_stem = 'spec-20-decoy'").first().lexical_rank == 1
    assert {r.package for r in search(store, e, "find needle", package="pkg").collect()} == {"pkg"}
    assert {r.document_stem for r in search(store, e, "find", document="spec-3-gamma").collect()} == {"spec-3-gamma"}
    assert search(store, e, "find", document="spec-99-none").isEmpty()
    for bad in ({"query": " "}, {"query": "x", "limit": 0}, {"query": "x", "package": ""}):
        with pytest.raises(ValueError):
            search(store, e, **bad)


def test_sections_expand(indexed):
    store, e = indexed
    rows = search(store, e, "paragraph", document="spec-9-long", limit=3).orderBy("position").collect()
    assert len(rows) >= 2 and not rows[0].was_expanded and all(r.was_expanded and r.semantic_rank is None for r in rows[1:])
    assert {tuple(r.heading_path) for r in rows} == {("Long", "Section")}
    one = context(store, e, "find needle", limit=2).first()
    assert one.returned == 2 and one.diagnostics.total_token_count == sum(c.token_count for c in one.chunks) and one.chunks[0].context_id == "ctx-1" and one.sources[0].source_id == "src-1"


def test_stream(spark, tmp_path):
    e = HashingEmbedder(4)
    (tmp_path / "doc").mkdir()
    store = Store(spark, str(tmp_path / "s"), e.model, e.dimension)
    go = lambda: index_stream(spark, str(tmp_path / "doc"), store, e, str(tmp_path / "c"), str(tmp_path / "p")).awaitTermination()
    (tmp_path / "doc/spec-1-a.md").write_text(doc("A", "one"))
    (tmp_path / "doc/Not governed.md").write_text("x")
    go()
    (tmp_path / "doc/spec-2-b.md").write_text(doc("B", "two"))
    go()
    assert {d.document_stem for d in store.documents().collect()} == {"spec-1-a", "spec-2-b"}
    assert spark.read.parquet(str(tmp_path / "p")).where("step = 'indexed'").selectExpr("sum(int(message)) n").first().n == 2


class Failing:
    model, dimension = "fake", 2

    def embed(self, texts):
        if any("BROKEN" in t for t in texts):
            raise RuntimeError("no embedding for this")
        return [[float(len(t)), 0.0] for t in texts]


def test_a_failing_embedding_is_its_documents_failure(spark, tmp_path):
    from lodestone.plans.reconcile import reconcile
    from lodestone.sources.store import Store

    store = Store(spark, f"{tmp_path}/store", "fake", 2)
    rows = [(None, "spec-1-good", "h1", "p/a.md", bytearray(b"# A\n\nFine.\n")), (None, "spec-2-bad", "h2", "p/b.md", bytearray(b"# B\n\nBROKEN here.\n"))]
    docs = spark.createDataFrame(rows, "package string, document_stem string, document_hash string, path string, content binary")
    out = reconcile(spark, store, docs, Failing())
    assert out["reindexed"] == 1 and [(f["document_stem"], f["error_kind"]) for f in out["failures"]] == [("spec-2-bad", "embedding")]
    assert "no embedding" in out["failures"][0]["error"]
    assert [r.document_stem for r in store.documents().collect()] == ["spec-1-good"]


def test_pointers_are_never_changed_and_old_versions_go(spark, tmp_path):
    from lodestone.sources.store import SCHEMA, Store

    store = Store(spark, f"{tmp_path}/store", "fake", 2)
    store.ensure()
    before = store.rows()
    for _ in range(3):
        store.replace(spark.createDataFrame([], SCHEMA))
    assert before.count() == 0 and len(store._pointers()) == 4
    assert store.vacuum() == 2 and len(store._pointers()) == 2 and store.rows().count() == 0
    assert store.vacuum() == 0


def chunk_rows(spark, docs):
    rows = [(f"{stem}-{i}", package, stem, "h", "c", i, [], None, t, t, 1, "fake", 2, [float(i), 0.0]) for package, stem, texts in docs for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_merge_writes_only_touched_buckets(spark, tmp_path):
    """As a dictionary of documents does; buckets that no changed document lies in keep their version."""
    store = Store(spark, f"{tmp_path}/store", "fake", 2, buckets=4)
    store.ensure()
    docs = {(None, f"s-{i}-x"): ["one two", f"word{i} two two"] for i in range(12)} | {("pkg", "s-1-x"): ["other"]}
    store.replace(chunk_rows(spark, [(*k, v) for k, v in docs.items()]))
    before = store._parts()
    assert len(before) > 2
    changes = [(None, "s-1-x", ["new two"])]
    store.merge(spark.createDataFrame([(None, "s-1-x"), ("none", "s-0-x")], "package string, document_stem string"), chunk_rows(spark, changes))
    docs[(None, "s-1-x")] = ["new two"]
    after = store._parts()
    changed = {b for b in after if after[b]["version"] != before.get(b, {}).get("version")}
    assert 1 <= len(changed) <= 2 < len(after)
    got = {}
    for r in store.rows().orderBy("chunk_ordinal").collect():
        got.setdefault((r.package, r.document_stem), []).append(r.text)
    assert got == docs
    listed, n, mean = store.text_index()
    texts = [t.split() for v in docs.values() for t in v]
    assert n == len(texts) and mean == pytest.approx(sum(map(len, texts)) / n)
    want = sorted((w, t.count(w), len(t)) for t in texts for w in set(t))
    assert sorted((r.term, r.tf, r.length) for r in listed.collect()) == want
    for stem in [k[1] for k in docs if k[0] is None]:
        assert store.delete_document(None, stem) == len(docs[(None, stem)])
    assert [r.text for r in store.rows().collect()] == ["other"] and len(store._parts()) == 1
    assert store.vacuum() > 0 and store.rows().count() == 1
    assert Store(spark, store.path, "fake", 2, buckets=99)._buckets() == 4  # its own number counts


def test_stored_postings_rank_as_texts_do(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", "fake", 2)
    store.replace(chunk_rows(spark, [(None if i % 2 else "p", f"s-{i}-x", [" ".join(["Needle"] * (i % 4) + ["hay"] * (i % 7)), "straw hay"]) for i in range(30)]))
    listed, n, mean = store.text_index()
    for where in (None, F.col("package") == "p", F.col("document_stem") == "s-3-x"):
        for terms in (["needle"], ["hay", "needle", "straw"], ["none"]):
            want = retrieval.lexical_topk(store.rows(), terms, "chunk_id", "search_text", where=where).collect()
            got = retrieval.indexed_topk(listed, n, mean, terms, "chunk_id", where=where).collect()
            assert [(r.chunk_id, r.lexical_rank, round(r.score, 9)) for r in got] == [(r.chunk_id, r.lexical_rank, round(r.score, 9)) for r in want]
    plan = listed.where(F.col("term").isin(["needle"])).select("chunk_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(term,needle)" in plan.replace("In(term, [needle])", "EqualTo(term,needle)")


def test_a_vector_index_beside_changed_buckets(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", "fake", 2, buckets=6)
    docs = [(None if i % 2 else "p", f"s-{i}-x", ["a", "b", "c"]) for i in range(30)]
    rows = chunk_rows(spark, docs).withColumn("embedding", F.array(F.substring("document_stem", 3, 9).substr(F.lit(1), F.length("document_stem") - 4).cast("float"), F.col("chunk_ordinal") / 10).cast("array<float>"))
    store.replace(rows)

    def agree():
        for query in ([3.0, 0.0], [17.2, 0.1]):
            for where in (None, F.col("package") == "p"):
                want = retrieval.semantic_topk(store.rows(), query, "chunk_id", k=5, where=where).collect()
                got = store.semantic(query, 5, where).collect()
                assert [(r.chunk_id, r.semantic_rank) for r in got] == [(r.chunk_id, r.semantic_rank) for r in want]

    agree()
    index = store.index_vectors()
    assert sum(index.sizes) == 90
    index.probes = len(index.sizes)
    agree()
    store.merge(spark.createDataFrame([(None, "s-17-x")], "package string, document_stem string"), rows.where("document_stem = 's-3-x'").withColumn("document_stem", F.lit("s-99-x")).withColumn("chunk_id", F.concat(F.lit("new-"), "chunk_ordinal")))
    assert store._meta()["vectors"] is not None and {r.chunk_id for r in store.semantic([3.0, 0.0], 6).collect()} == {"new-0", "new-1", "new-2", "s-3-x-0", "s-3-x-1", "s-3-x-2"}
    assert "s-17-x-0" not in {r.chunk_id for r in store.semantic([17.0, 0.0], 6).collect()}
    assert store.vacuum(1) > 0 and len(store.semantic([3.0, 0.0], 6).collect()) == 6
