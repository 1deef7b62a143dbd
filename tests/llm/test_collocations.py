"""Collocations: mining and scores by brute force, whatever the pivots' groups and the tasks' sizes."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import collocations as C

rng = random.Random(5)
WORDS = ["the", "of", "to", "state", "law", "court", "é", "x-1", "über", "rare", "\x1codd\x00"]
TEXTS = [" ".join(rng.choices(WORDS, [30, 20, 20, 5, 5, 5, 3, 3, 2, 1, 1], k=rng.randrange(40))) for _ in range(60)]
TEXTS += ["the supreme court of the state. The  Supreme\tcourt, of the state", "A b c d e f g A b c d e f g\x0ba b c d e f g"] * 4
TEXTS += ["law law law law law law", "the\nof;to!the?of:to", "of the of the of the of the of the", None, "", " .,; \t", "one", "w" * 50_000 + " the", "É Ü é ü", "日本 語 日本 語 日本 語 日本 語"]
ROWS = [(i if i % 9 else None, t, (None, "de", "en", "", "en")[i % 5]) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "en")] * 3
SCHEMA = "doc_id long, text string, lang string"


def expected(rows, least, longest):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    c = f.setdefault(lang, Counter())
                    c[w[i : i + k]] += 1
    out = set()
    for lang, c in f.items():
        often = {p for p in c if len(p) > 1 and c[p] >= least}
        for p in often:
            if any(c[q] >= c[p] and any(q[i : i + len(p)] == p for i in range(len(q))) for q in often if len(q) > len(p)):
                continue
            score, k = min((1000 * c[p] * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            out.add((lang, " ".join(p), c[p], c[p[:k]], c[p[k:]], n[lang], score))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def found(df, **kw):
    rows = C.collocations(df, **kw).collect()
    assert len({(r.lang, r.phrase) for r in rows}) == len(rows)
    return {(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows}


@pytest.mark.parametrize("least,longest", [(2, 5), (4, 5), (3, 3), (5, 2)])
def test_phrases_by_brute_force(docs, least, longest):
    want = expected(ROWS, least, longest)
    assert found(docs, least=least, longest=longest) == want and any(" " in p for _, p, *_ in want)
    assert longest < 5 or any(p.count(" ") == 4 for _, p, *_ in want)


def test_pivots_of_many_stretches_are_dealt_and_tasks_flush(docs, monkeypatch):
    monkeypatch.setattr(C, "SPLIT", 2)
    monkeypatch.setattr(C, "FLUSH", 50)
    monkeypatch.setattr(C, "HELD", 3)
    monkeypatch.setattr(C, "REMEMBERED", 200)
    assert found(docs, least=2) == expected(ROWS, 2, 5)


def test_words_that_share_a_slot(docs, monkeypatch):
    monkeypatch.setattr(C, "MOST_SLOT_BITS", 2)
    assert found(docs, least=2) == expected(ROWS, 2, 5)


def test_each_ngram_has_one_owner():
    import numpy as np

    for _ in range(200):
        n, longest = rng.randrange(1, 30), rng.randrange(2, 6)
        ranks = np.array([rng.choice([0, 1, 2, 2, 3, 9]) for _ in range(n)], np.int64)
        words = [b"%d" % i for i in range(n)]
        got = Counter()
        for pivot, payload in C.stretches(words, ranks, longest):
            C.owned(Counter(payload.split(b"\n")), longest, got)
        want = Counter(b" ".join(words[a:z]) for a in range(n) for z in range(a + 2, min(n, a + longest) + 1) if ranks[a:z].all())
        assert got == want


def test_products_over_64_bits(spark, tmp_path):
    big = 10**14
    words = spark.createDataFrame([("en", None, big), ("en", "a", big // 2), ("en", "b", big // 3)], "lang string, word string, n long")
    phrases = spark.createDataFrame([("en", "a b", big // 4)], "lang string, phrase string, f long")
    assert C.scored(phrases, words).first().score == 1000 * (big // 4) * big // ((big // 2) * (big // 3))


def test_ranks_ties_and_odd_tables(spark, docs):
    rows = C.best(C.collocations(docs, least=2), 7).collect()
    for lang in {r.lang for r in rows}:
        want = sorted((x for x in expected(ROWS, 2, 5) if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:7]
        assert [r.phrase for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r["rank"])] == [x[1] for x in want]
    clash = docs.withColumns({c: F.lit("clash") for c in ("word", "pivot", "phrase", "n", "first", "k", "rank")})
    assert found(clash, least=2) == expected(ROWS, 2, 5)
    assert C.best(C.collocations(spark.createDataFrame([], SCHEMA)), 5).collect() == []
    assert C.collocations(docs.where("text is null")).collect() == []
