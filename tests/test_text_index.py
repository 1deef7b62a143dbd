"""The text index against exact BM25, whatever its segments; what a query reads; what an increment writes."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.sources import text_index
from lodestone.sources.text_index import Plan, TextIndex

rng = random.Random(8)
WORDS = [f"w{i}" for i in range(40)]
SCHEMA = "id string, text string, tag string"


def text(i):
    n = rng.randrange(1, 60)
    return " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(40)], k=n)) + (" Ünïque" if i % 50 == 0 else "")


ROWS = {f"d{i:04d}": (text(i), "ab"[i % 2]) for i in range(900)}
ROWS |= {"e1": ("", "a"), "e2": (None, "a"), "e3": ("W0, w0; W0!", "b"), "é": ("w7 " * 300, "b")}


def brute(rows, terms, k, keep=lambda key, tag: True):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, (t, _) in rows.items()}
    n, mean = len(rows), sum(map(len, words.values())) / max(len(rows), 1)
    score = {}
    for t in sorted(set(terms)):
        m = sum(t in w for w in words.values())
        idf = math.log(1 + (n - m + 0.5) / (m + 0.5))
        for i, w in words.items():
            if (tf := w.count(t)) and keep(i, rows[i][1]):
                score[i] = score.get(i, 0.0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return [(i, round(s, 9)) for i, s in sorted(score.items(), key=lambda x: (-x[1], x[0].encode()))[:k]]


def table(spark, rows):
    return spark.createDataFrame([(i, t, g) for i, (t, g) in rows.items()] + [(None, "w0 w1", "a")], SCHEMA).repartition(3)


def found(index, segments, terms, k=20, where=None):
    return [(r.key, round(r.score, 9)) for r in index.topk(segments, terms, k, where).orderBy("lexical_rank").collect()]


QUERIES = [["w0"], ["w39"], ["w0", "w1", "w30"], ["ünïque", "w3"], ["none"], [], ["w7", "none", "w7"]]


@pytest.fixture(scope="module", autouse=True)
def small_blocks():
    before = text_index.BLOCK
    text_index.BLOCK = 16
    yield
    text_index.BLOCK = before


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    index = TextIndex(spark, str(tmp_path_factory.mktemp("t") / "ix"), others=["tag"], parts=8)
    return index, index.added([], table(spark, ROWS), "id", "text")


@pytest.mark.parametrize("terms", QUERIES)
def test_one_segment(whole, terms):
    index, segments = whole
    assert found(index, segments, terms) == brute(ROWS, terms, 20)
    tagged = found(index, segments, terms, 5, (F.col("tag") == "b") & (F.col("key") != "é"))
    assert tagged == brute(ROWS, terms, 5, lambda i, g: g == "b" and i != "é")


def test_blocks_hold_their_bounds(whole):
    index, segments = whole
    for b in index._read(segments, "postings", index._blocks).collect():
        assert list(b["keys"]) == sorted(b["keys"], key=str.encode) and (b["first"], b["last"], b["n"]) == (b["keys"][0], b["keys"][-1], len(b["keys"]))
        assert (b["tf"], b["length"]) == (max(b["tfs"]), min(b["lengths"])) and b["n"] <= 16
        score = lambda tf, length, mean: tf / (tf + 0.3 + 0.9 * length / mean)
        for mean in (1, 30, 500):
            assert max(score(x, y, mean) for x, y in zip(b["tops"][::2], b["tops"][1::2])) == max(score(x, y, mean) for x, y in zip(b["tfs"], b["lengths"]))


def test_a_query_opens_its_terms_folders_and_few_blocks(whole):
    index, segments = whole
    df = index.topk(segments, ["w0", "w30"], 3)
    chosen, listed = index.last_read
    assert 0 < chosen < listed / 2  # early termination
    parts = set(index._parts_of(["w0", "w30"]))
    assert {int(re.search(r"part=(\d+)", f)[1]) for f in index.postings(segments, sorted(parts)).inputFiles()} == parts
    assert len(segments[0]["folders"]["postings"]) == 8 and df.count() == 3


def test_terms_of_too_many_blocks_have_one_bound(whole, monkeypatch):
    monkeypatch.setattr(text_index, "HEADS", 5)
    index, segments = whole
    for terms in QUERIES:
        assert found(index, segments, terms) == brute(ROWS, terms, 20)


def test_many_chosen_blocks(whole, monkeypatch):
    index, segments = whole
    assert found(index, segments, WORDS, 600) == brute(ROWS, WORDS, 600)


def _files(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    it = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    out = {}
    while it.hasNext():
        f = it.next()
        out[f.getPath().toString()] = f.getModificationTime()
    return out


def test_increments_replace_delete_and_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "TIER", 2)
    index = TextIndex(spark, str(tmp_path / "ix"), others=["tag"], parts=4)
    rows = {k: v for k, v in ROWS.items() if k < "d0300"}
    segments = index.added([], table(spark, rows), "id", "text")
    big = segments[0]["name"]
    before = _files(spark, f"{tmp_path}/ix/{big}")
    for step in range(4):
        new = {k: (f"w{step} fresh {v[0]}", v[1]) for k, v in list(ROWS.items())[step * 20 : step * 20 + 12]} | {f"n{step}": ("w0 fresh", "a")}
        gone = [f"d{step * 20 + 15:04d}", "not there", f"n{step - 1}"]
        segments = index.added(segments, table(spark, new), "id", "text", spark.createDataFrame([(g,) for g in gone], "k string"))
        rows = {k: v for k, v in rows.items() if k not in gone} | new
        assert index.size(segments)[0] == len(rows)
        for terms in (["w0", "fresh"], ["w3"], ["w30", "w2"]):
            assert found(index, segments, terms) == brute(rows, terms, 20)
    assert segments[0]["name"] == big and len(segments) <= 4 and _files(spark, f"{tmp_path}/ix/{big}") == before
    index.save(segments)
    assert index.opened() == segments
    segments = index.added(segments, table(spark, {}).where("id is not null"), "id", "text", spark.createDataFrame([(k,) for k in rows], "k string"))
    assert index.size(segments)[0] == 0 and found(index, segments, ["w0"]) == []


def test_an_empty_index(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "ix"))
    assert index.opened() == [] and found(index, [], ["a"]) == []
    segments = index.added([], spark.createDataFrame([], SCHEMA), "id", "text")
    assert found(index, segments, ["a"]) == [] and index.size(segments) == (0, 0.0)


def test_bounds_of_shared_keys():
    b = lambda t, at, first, last, bound: {"term": t, "at": at, "first": first, "last": last, "bound": bound}
    blocks = [b("x", 0, "a", "c", 2.0), b("x", 0, "d", "f", 1.0), b("y", 0, "b", "b", 3.0), b("y", 1, "e", "z", 0.5)]
    plan = Plan({"x": 9, "y": 9}, {}, blocks, {})
    plan.reaching(0.0)
    chains = text_index._chains([b("x", 0, f, l, 1.0) for f, l in (("a", "d"), ("b", "c"), ("d", "e"), ("e", "g"), ("f", "f"))])
    assert len(chains) == 2 and all(x["last"] < y["first"] for c in chains for x, y in zip(c, c[1:]))
    assert plan.spare(2.5) == ({"x"}, 2.0) and plan.spare(1.0) == (set(), 0.0) and [x["first"] for x in plan.holding({"x"}, ["c", "cc"])] == ["a"]
    assert plan.reaching(0.0)[0] and len(plan.reaching(0.0)[0]) == 4
    assert [x["first"] for x in plan.reaching(4.0)[0]] == ["a", "b"]
    assert [x["first"] for x in plan.reaching(1.5)[0]] == ["a", "d", "b", "e"]
    assert plan.reaching(5.1)[0] == []
    for _ in range(50):
        blocks = [b("x", 0, chr(97 + i), chr(97 + i), rng.random()) for i in range(rng.randrange(1, 20))]
        run = text_index._Run(blocks)
        i, j = sorted(rng.choices(range(20), k=2))
        want = max((x["bound"] for x in blocks if chr(97 + i) <= x["first"] <= chr(97 + j)), default=0.0)
        assert run.within(chr(97 + i), chr(97 + j)) == want


def test_packing_counts_words_as_arrays():
    import collections
    import random
    import time
    import types

    import pyarrow as pa

    from lodestone.sources.text_index import TextIndex, tops

    rng = random.Random(4)
    docs = [(f"{i:04d}é", [f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(900))], f"o{i % 3}") for i in range(2500)]
    rng.shuffle(docs)
    docs += [("none", [], None)]
    kinds = {"key": pa.string(), "o": pa.string(), "words": pa.list_(pa.string())}
    batch = pa.RecordBatch.from_arrays([pa.array([d[i] for d in docs], k) for i, k in zip((0, 2, 1), kinds.values())], names=list(kinds))
    run = TextIndex._packed.fget(types.SimpleNamespace(others=["o"]))
    began = time.process_time()
    out = list(run(iter([batch.slice(0, 700), batch.slice(700)])))
    took = time.process_time() - began
    assert len(out) > 1
    got = collections.Counter()
    for row in (r for b in out for r in b.to_pylist()):
        assert row["keys"] == sorted(row["keys"]) and row["first"] == row["keys"][0]
        got.update((row["term"], *x) for x in zip(row["keys"], row["tfs"], row["lengths"], row["o_of"]))
    want = collections.Counter((t, k, tf, len(w), o) for k, w, o in docs for t, tf in collections.Counter(w).items())
    assert got == want and took < 3
    assert all(isinstance(b.column("keys"), pa.ListArray) for b in out) and tops([1, 3, 3, 2], [5, 9, 8, 8]) == [3, 8, 1, 5]
