"""The vector index against exact search: recall, exact bounds, what a probe reads, growth."""

import importlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.sources import vector_index
from lodestone.sources.vector_index import VectorIndex

rng = np.random.default_rng(4)
CENTRES = rng.normal(size=(12, 8)) * 3
X = np.float32(np.vstack([CENTRES[i % 12] + rng.normal(size=8) * 0.4 for i in range(600)] + [CENTRES[3]] * 300)).astype(float)
ODD = [(9001, None, "a"), (9002, [1.0, None] * 4, "a"), (9003, [float("nan")] * 8, "a"), (9004, [float("inf")] * 8, "a"), (9005, [1.0], "a"), (9006, [], "a"), (None, [0.0] * 8, "a")]
SCHEMA = "id long, embedding array<float>, tag string"


def brute(query, k, keep=lambda i: True):
    near = sorted((float(((X[i] - query) ** 2).sum()), i) for i in range(len(X)) if keep(i))[:k]
    return [i for _, i in near]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(X)] + ODD, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return VectorIndex.build(rows, str(tmp_path_factory.mktemp("v") / "ix"), "id", others=["tag"])


def test_every_fitting_row_has_a_cell(spark, index):
    assert sum(index.sizes) == len(X) == index.rows(spark).count() and len(index.sizes) > 8
    for r in index.rows(spark).collect():
        off = np.sqrt(((index.centroids - np.array(r.embedding)) ** 2).sum(1))
        assert off[r.cell] <= off.min() + 1e-6 and r.away <= index.radii[r.cell] + 1e-12


@pytest.mark.parametrize("q", [0, 77, 450, 700])
def test_one_query(spark, index, q):
    exact = index.nearest(spark, X[q].tolist(), k=15, exact=True).orderBy("rank").collect()
    assert [r.id for r in exact] == brute(X[q], 15)
    tagged = index.nearest(spark, X[q].tolist(), k=5, exact=True, where=F.col("tag") == "b").orderBy("rank").collect()
    assert [r.id for r in tagged] == brute(X[q], 5, lambda i: i % 2)
    assert len(set(r.id for r in index.nearest(spark, X[q].tolist(), k=15).collect()) & set(brute(X[q], 15))) >= 13


def test_a_probe_reads_its_cells_only(spark, index):
    assert index.probes < len(index.sizes) / 2
    plan = index.nearest(spark, X[5].tolist())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    files = index.nearest(spark, X[5].tolist(), probes=2).select("id").join(index.rows(spark).select("id", "cell"), "id").select("cell").distinct().count()
    assert files <= 2


def test_many_queries(spark, rows, index, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 37)  # cells and their queries in many groups
    asked = rows.where("id % 7 = 0 or id is null or id > 9000")
    exact = index.nearest_of(asked, "id", k=6, probes=1, exact=True, work=str(tmp_path)).collect()
    want = {str(i): brute(X[i], 6) for i in range(0, len(X), 7)}
    got = {}
    for r in sorted(exact, key=lambda r: r["rank"]):
        got.setdefault(r.query, []).append(r.id)
    got.pop(None, None)
    assert got == want
    found = [(r.query, r.id) for r in index.nearest_of(asked, "id", k=6).collect() if r.query]
    assert sum(i in want[q] for q, i in found) >= 0.9 * 6 * len(want) and len(found) == len(set(found))


def test_an_index_grows_and_is_read_again(spark, rows, tmp_path):
    path = str(tmp_path / "ix")
    first = VectorIndex.build(rows.where("id < 500"), path, "id", others=["tag"])
    before = {f.getPath().toString(): f.getModificationTime() for f in _files(spark, path)}
    first.add(rows.where("id >= 500"))
    after = {f.getPath().toString(): f.getModificationTime() for f in _files(spark, path)}
    assert before.items() <= after.items()
    again = VectorIndex.open(spark, path)
    assert again.sizes == first.sizes and sum(again.sizes) == len(X) and np.array_equal(again.centroids, first.centroids)
    assert [r.id for r in again.nearest(spark, X[801].tolist(), k=9, exact=True).orderBy("rank").collect()] == brute(X[801], 9)


def _files(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    it = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while it.hasNext():
        out.append(it.next())
    return out


def test_empty_and_tiny_tables(spark, rows, tmp_path):
    none = VectorIndex.build(rows.where("false"), str(tmp_path / "none"), "id")
    assert none.nearest_of(rows, "id").collect() == [] and none.rows(spark).count() == 0
    one = VectorIndex.build(rows.where("id = 3"), str(tmp_path / "one"), "id")
    assert [r.id for r in one.nearest(spark, X[9].tolist(), exact=True).collect()] == [3]
    with pytest.raises(ValueError):
        one.nearest(spark, [1.0])


def test_recall_over_the_embeddings(spark, sf_dir):
    got = {}
    for r in importlib.import_module("__spark_entry__").queries()["vector_index_topk"](spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in emb]), np.array([r.embedding for r in emb], float)
    hits = 0
    for q in got:
        near = ((x - x[ids == q][0]) ** 2).sum(1)
        hits += len(set(ids[np.lexsort((ids, near))[:10]]) & set(got[q]))
    assert sorted(got) == sorted(i for i in ids if i % 100 == 0) and hits >= 0.9 * 10 * len(got)
