"""Compression-distance toxicity: held-out accuracy on planted words, the attribution by brute force, odd cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import toxicity

rng = random.Random(11)
PARTS = ["ba", "len", "tor", "mi", "sha", "rou", "keti", "on", "ver", "dal", "esu", "gra"]
BAD = ["zwickelfrotz", "qualmhund", "vexbrack", "hoxiplunk"]


def plain(n):
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def text(toxic):
    w = plain(rng.randint(40, 120))
    for _ in range(3 * toxic):
        w[rng.randrange(len(w))] = rng.choice(BAD)
    return " ".join(w).capitalize() + "."


MARKED = [(i, int(i % 4 == 0)) for i in range(400)]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(y)) for i, y in MARKED]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, " ".join([*plain(50_000), BAD[0], BAD[3]])), (None, "Such a vexbrack qualmhund"), (1004, "퟿ x" * 30), (1004, "a " + BAD[1]), (1005, BAD[2] * 300)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([*MARKED, (0, None), (9999, 1), (3, 0), (None, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(docs, labels):
    return toxicity.fit(docs, labels)


def test_held_out_documents_are_told_apart(docs, labels, model):
    rows = {r.doc_id: r for r in toxicity.scored(docs, model).where("doc_id < 400").collect()}
    held = [(i, y) for i, y in MARKED if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [rows[i].held_out for i, _ in MARKED] == [zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in MARKED] and len(held) > 40
    assert np.mean([rows[i].predicted == y for i, y in held]) >= 0.95
    ones, zeros = ([rows[i].score for i, y in held if y == k] for k in (1, 0))
    assert np.mean([a > b for a in ones for b in zeros]) > 0.98


def test_a_passage_is_found_where_it_is(docs, model):
    found = toxicity.passages(docs.where("doc_id = 1003"), model).collect()
    there = [r for r in found if r.first_word <= 50_000 < r.first_word + toxicity.WINDOW]
    assert there and all(BAD[0] in r.passage for r in there) and len(found) < 50


def test_attribution_by_brute_force(spark, docs, labels):
    sample = toxicity.sampled(docs, labels)
    got = {r["word"]: (r.a, r.b) for r in toxicity.attributed(sample).collect()}
    beside = {0: {}, 1: {}}
    for r in sample.collect():
        w = ["", *toxicity.words(r.text), ""]
        first = {}
        for x, y, z in zip(w, w[1:], w[2:]):
            first.setdefault(y, (x, z))
        for y, at in first.items():
            beside[r.label].setdefault(y, set()).add(at)
    want = {w: (len(beside[1].get(w, ())), len(beside[0].get(w, ()))) for w in {*beside[0], *beside[1]}}
    assert got == want and all(got[w][1] == 0 < got[w][0] for w in BAD)


def test_held_out_labels_are_never_learned_from(docs, labels, model):
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, turned)
    assert (again.toxic, again.ordinary, again.threshold) == (model.toxic, model.ordinary, model.threshold) and np.array_equal(again.weights, model.weights)


def test_copies_of_one_text_count_once(spark):
    rows = [(i, text(0)) for i in range(100)] + [(i, "some odd sentence of one loud source") for i in range(100, 160)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in range(160)], "doc_id long, toxic int")
    counts = toxicity.attributed(toxicity.sampled(spark.createDataFrame(rows, SCHEMA), labels))
    assert counts.where("word = 'loud'").first().a == 1


def test_odd_cases(spark, docs, labels, model):
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1000].score == by[1001].score == by[1002].score < 0.5 and by[None].held_out is False
    clash = docs.withColumns({c: F.lit("clash") for c in ("score", "label", "word", "gain", "toxic")})
    assert sorted(map(str, toxicity.scored(clash, model).collect())) == sorted(map(str, rows))
    assert np.array_equal(toxicity.fit(clash, labels.withColumn("text", F.lit("x"))).weights, model.weights)
    none = spark.createDataFrame([], SCHEMA)
    assert toxicity.scored(none, toxicity.fit(none, labels)).columns == ["doc_id", "held_out", "score", "predicted"]
    assert {r.score for r in toxicity.scored(docs, toxicity.fit(docs, labels.where("false"))).collect()} == {0.5}
    assert toxicity.fit(docs, labels.where("toxic = 1")).share == 1.0
    assert not toxicity.fit(docs.withColumn("text", F.lit(None).cast("string")), labels).toxic


def test_windows_cover_every_phrase():
    for n in range(60):
        w = [f"w{i}" for i in range(n)]
        got = toxicity.windows(w)
        for k in range(n - 2):
            assert any(" ".join(w[k : k + 3]) in x for x in got)
        assert not n or w[-1] in got[-1].split()
        assert len(got) == len(set(got)) and bool(got) == bool(n)
