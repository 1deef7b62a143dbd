"""The corpus pipeline: each stage on what the one before kept."""

import corpus_pipeline
from lodestone.llm import ngram_join, sketch
from lodestone.llm.common import shared_dir, stored
from lodestone.llm.surrogates import found


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    path, kept = shared_dir(spark), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r for r in docs.collect()}
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sum(labels.get(d) == 0 for d in kept["quality"]) <= 2 and sum(q == 1 for d, q in labels.items() if d not in kept["quality"]) <= 1

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = sorted((d, shingles(before[d])) for d in kept["quality"])
    twins = {d for i, (d, a) in enumerate(sets) for _, b in sets[:i] if 5 * len(a & b) >= 4 * len(a | b)}
    assert not set(kept["ngram_join"]) & twins or len(set(kept["ngram_join"]) & twins) < len(twins)
    assert set(kept["suffix_dedup"]) == set(kept["ngram_join"]) == set(kept["pii"])
    seen = set()
    for d in sorted(kept["ngram_join"]):
        b = before[d].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if b[i : i + 50] in seen:
                gone[i : i + 50] = b"\1" * 50
        seen |= {b[i : i + 50] for i in range(len(b) - 49)}
        assert kept["suffix_dedup"][d].text == bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    for d, r in kept["pii"].items():
        old = kept["suffix_dedup"][d].text
        assert [k for k, *_ in found(r.text)] == [k for k, *_ in found(old)] and r.n_chars == len(r.text)
        assert not {old[a:b] for _, a, b in found(old)} & {r.text[a:b] for _, a, b in found(r.text)}
    pieces = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert {p.doc_id for p in pieces} == set(kept["pii"])


def test_one_row_of_each_group_stays(spark, sf_dir):
    text = lambda x: " ".join(f"{x}{i}" for i in range(30))
    a, b, c, d, e, f = map(text, "abcdef")
    rows = [
        (1, a), (5, a), (5, b), (7, b),  # 5 repeats with another text, which stands for its group
        (2, c), (2, c), (2, c + " end"), (2, c.upper()),  # copies and near copies of one id
        (3, d), (3, e), (None, e), (None, a),
        (None, f), (None, f), (None, f + " end"), (None, text("g")), (None, text("g")),
        (8, ""), (8, ""), (None, None), (9, text("h")),
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.distinct(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    got = [(r.doc_id, (r.text or "").lower()[:1]) for r in kept.collect()]
    want = [(1, "a"), (5, "b"), (2, "c"), (3, "d"), (3, "e"), (None, "f"), (None, "g"), (8, ""), (8, ""), (None, ""), (9, "h")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_few_sets_move_in_the_second_stage(spark, sf_dir, monkeypatch):
    """Of texts that differ none is sent on, however crowded the slots are and however often each is copied."""
    monkeypatch.setattr(sketch, "SLOT_BITS", 14)
    text = lambda x: " ".join(f"{x}-{i}" for i in range(60))
    rows = [(1000 * k + i, text(f"{i} {k // 2}")) for i in range(200) for k in range(4)] + [(9000, text("z")), (9001, text("z") + " end")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    tables = {}
    monkeypatch.setattr(ngram_join, "stored", lambda df, path, *a, **b: tables.setdefault(path.rsplit("/", 1)[1], stored(df, path, *a, **b)))
    monkeypatch.setattr(ngram_join, "drop", lambda *a: None)
    kept = {r.doc_id for r in corpus_pipeline.distinct(spark, docs, sf_dir).collect()}
    assert kept == {1000 * k + i for i in range(200) for k in (0, 2)} | {9000}
    assert 2 <= tables["sets"].count() < 40  # a slot of the ids may be shared by chance


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    lengths = {}
    for p in rows:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
    assert rows and all(lengths[p.doc_id] == p.doc_tokens for p in rows)
