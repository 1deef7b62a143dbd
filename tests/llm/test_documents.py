"""Operators over documents, held against brute force on small tables with every odd case."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import bpe, ngram_join, packing, quality, sketch, suffix_dedup, surrogates, winnowing

PATH = public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


BASE = prose(120)
PASSAGE = prose(40)


def edited(text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


TEXTS = [
    None, "", "   ", "one", "One", "two words", "a b c d e", "a b c d e f", BASE, BASE, BASE.upper(), edited(BASE, 1), edited(BASE, 2), edited(BASE, 5), *(edited(BASE, 3) for _ in range(12)),
    PASSAGE + " " + prose(30), prose(30) + " " + PASSAGE, PASSAGE, "der " * 200, "der " * 90, "é" * 60, "x" + "é" * 60, "ab" * 5000, prose(3000), "日本語" * 40, "İstanbul ΣΑΣ it's 12 <|endoftext|> ok", "\x1cx\x1dy",
]
ROWS = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)] + [(None, BASE, None, None, None), (8, BASE, "en", None, None), (11, "another text of an id that is there", None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("digest", "component_id", "bucket", "ids", "k1", "following", "score")})


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_ngram_join(docs):
    sets = [(d, shingles(t)) for d, t, *_ in ROWS]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(sets):
        groups.setdefault(root(i), []).append(d)
    want = sorted(((d, len(s), min((x for x in groups[root(i)] if x is not None), default=None)) for i, (d, s) in enumerate(sets)), key=repr)
    got = sorted((tuple(r) for r in ngram_join.join(clashing(docs)).collect()), key=repr)
    assert got == want


def test_ngram_join_many_groups(spark, monkeypatch):
    """Groups of two sets and tokens of few: every link between groups is found."""
    monkeypatch.setattr(ngram_join, "GROUP", 2)
    rows = [(i, edited(BASE, i % 7)) for i in range(80)]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in rows]
    label = list(range(80))
    for i in range(80):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert got == dict(enumerate(label))


def test_tile_links_is_a_forest_of_all_links():
    from fractions import Fraction

    sets = [np.unique(np.array([rng.randrange(60) for _ in range(50)], np.uint64)) for _ in range(30)]
    group = (b"".join(bytes([i]) * 16 for i in range(30)), np.array([len(s) for s in sets]).tobytes(), np.array([len(s) for s in sets]).tobytes(), b"".join(s.tobytes() for s in sets))
    links = ngram_join.tile_links(group, group, Fraction(1, 2))
    forest, brute = ngram_join.Forest(), ngram_join.Forest()
    for a, b in links:
        assert forest.join(a[0], b[0])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 2 * both >= len(a) + len(b) - both:
                brute.join(i, j)
    assert [forest.root(i) for i in range(30)] == [brute.root(i) for i in range(30)]


def test_suffix_dedup(docs):
    earlier = {}
    for d, t, *_ in ROWS:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                earlier[b[i : i + 50]] = min(d, earlier.get(b[i : i + 50], d))
    want = []
    for d, t, *_ in ROWS:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and earlier[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        rest = bytes(x for x, g in zip(b, gone) if not g)
        want.append((d, len(b), sum(gone), len([1 for x in bytes(gone).split(b"\0") if x]), rest, hashlib.sha256(rest).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) for r in suffix_dedup.deduplicated(clashing(docs)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_suffix_dedup_shortens_texts_and_keeps_columns(docs):
    out = suffix_dedup.shortened(docs, size_col="n_chars")
    assert out.schema == docs.schema
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert all(r.text is None if r.doc_id == 0 else r.n_chars == len(r.text) for r in rows)
    assert sum(r.text == BASE for r in rows) == 3  # both rows of id 8 and the row without an id


@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(60))])
def test_suffix_order(alphabet):
    for _ in range(20):
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 15))]
        owner, size, common = suffix_dedup.suffix_order(np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings))))
        suffixes = [strings[o][len(strings[o]) - s :] for o, s in zip(owner, size)]
        assert suffixes == sorted(x[i:] for x in strings for i in range(len(x)))
        for a, b, c in zip(suffixes, suffixes[1:], common[1:]):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert n == c


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    want = sorted(((d, np.array(ids := library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)) for d, t, *_ in ROWS), key=repr)
    got = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.round_trip(clashing(docs), PATH).collect()), key=repr)
    assert got == want
    ids = bpe.encode(docs, PATH)
    assert sorted(((r.doc_id, r.decoded) for r in bpe.decode(ids, PATH).collect()), key=repr) == sorted(((d, t) for d, _, t in want), key=repr)


def test_bpe_on_odd_characters():
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(PATH), bpe.Encoder(bpe.Vocabulary(PATH))
    pool = "abcXYZ's't 've'll12٣Ⅷ½ÄäßİıΣσςéé가힣日本 \t\n\x0b\x85\xa0  　\x1c\x1f.,!?'\"<|endoftext|>😀\U0001d400​"
    for _ in range(400):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = packing.pack(clashing(docs), PATH, end_id=2, capacity=256).collect()
    left = sorted((d, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, *_ in ROWS if d is not None)
    ends = sorted((r.doc_id, r.doc_tokens) for r in rows if r.doc_id is not None and r.start + r.length == r.doc_tokens)
    assert ends == left
    windows = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256


def test_best_fit_decreasing_takes_the_tightest_window():
    for _ in range(50):
        lengths = [rng.randint(1, 150) for _ in range(rng.randint(0, 60))]
        placed = packing.pack_lengths(lengths, 64)
        assert sorted((k, s) for k, s, *_ in placed) == sorted((k, s) for k, n in enumerate(lengths) for s in range(0, n, 64))
        left = []
        for n in sorted((n % 64 for n in lengths if n % 64), reverse=True):  # the same by a plain search
            fits = [i for i, c in enumerate(left) if c >= n]
            if fits:
                left[min(fits, key=lambda i: left[i])] -= n
            else:
                left.append(64 - n)
        assert len(left) + sum(n // 64 for n in lengths) == len({w for *_, w, _ in placed})


def test_winnowing(docs):
    from pyspark.sql import functions as F

    rows = winnowing.fingerprints_beside_next(clashing(docs)).select("*", winnowing.likeness(winnowing.hashes(F.col("fingerprint")), winnowing.hashes(F.col("edited_fingerprint"))).alias("near")).collect()
    assert len(rows) == len(ROWS)
    order = sorted({d for d, *_ in ROWS if d is not None})
    first = {d: min(t or "" for x, t, *_ in ROWS if x == d) for d in order}
    following = {}
    for d in order:
        texts = sorted((t or "") for x, t, *_ in ROWS if x == d)
        after = [*texts[1:], first[order[(order.index(d) + 1) % len(order)]]]
        following.update({(d, t): f for t, f in reversed(list(zip(texts, after)))})
    prints = {}
    for r in rows:
        n = len(r.text)
        if r.doc_id not in (8, None):
            nxt = following[r.doc_id, r.text]
            assert r.edited == r.text[: n - n // 2] + nxt[: n // 2], r.doc_id
        assert prints.setdefault(r.text, r.fingerprint) == r.fingerprint
        symbols = [w[i : i + 16] for w in r.text.split() for i in range(0, len(w), 16)] if "\x1c" not in r.text else None
        if symbols is not None:
            grams = max(0, len(symbols) - 4)
            at = [(1 << 25) - 1 - (x & ((1 << 25) - 1)) for x in r.fingerprint]
            assert at == sorted(set(at)) and all(any(s <= a < s + 4 for a in at) for s in range(max(0, grams - 3)))  # one in each window
        assert 0 <= r.near <= 1


def test_winnowing_takes_the_rightmost_of_equal_hashes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a " * 20,)], "t string").select(winnowing.fingerprint(F.col("t")).alias("f"))
    at = [(1 << 25) - 1 - (x & ((1 << 25) - 1)) for x in df.first().f]
    assert at == list(range(3, 16))


def test_winnowing_uses_no_python(docs):
    plan = winnowing.fingerprints_beside_next(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_quality(spark):
    good = [(i, prose(rng.randint(5, 200)).replace("w", "wo") + ".", 1) for i in range(300)]
    bad = [(300 + i, "SPAM!! " * rng.randint(20, 200), 0) for i in range(120)]
    rows = good + bad + [(1000, "", None), (1001, None, 1), (None, "x", 1), (5, "SPAM!! " * 30, None)]
    docs = clashing(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(77777, 1, 0)], "doc_id long, quality int, toxic int")
    measured = quality.measured(docs)
    model = quality.fit(measured, labels)
    out = {r.doc_id: r for r in quality.scored(measured, model).collect()}
    assert len(out) == len({r[0] for r in rows})
    tested = [(d, y) for d, _, y in good + bad if zlib.crc32(str(d).encode()) % 5 == 0 and d != 5]
    assert tested and all(out[d].held_out and out[d].predicted == y for d, y in tested)
    kept = {r.doc_id for r in quality.keep(docs, model).collect()}
    assert {d for d, *_ in good} - kept <= {5} and not kept & {d for d, *_ in bad}
    empty = labels.where("false")
    assert {r.score for r in quality.scored(measured, quality.fit(measured, empty)).collect()} == {0.5}


def test_quality_never_learns_from_held_out_rows(spark):
    docs = spark.createDataFrame([(i, prose(20)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    flipped = spark.createDataFrame([(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 5 == 0 else i % 2) for i in range(200)], "doc_id long, quality int")
    measured = quality.measured(docs)
    a, b = quality.fit(measured, labels), quality.fit(measured, flipped)
    assert np.allclose(a.means, b.means) and np.allclose(a.factors, b.factors)


PRIVATE = [
    "mail john.doe@example.com or JOHN.DOE@example.com, call +1 (017) 555-7713",
    "Frau Anna Schmidt, Mr. Иван Петров; card 4111 1111 1111 1111 and 4111111111111112",
    'ip 97.51.17.173 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" DE89 3704 0044 0532 0130 00',
    "ssn 123-45-6789, nothing else", "plain text 12 34", "", None,
]


def test_surrogates(spark):
    docs = clashing(spark.createDataFrame([(i, t) for i, t in enumerate(PRIVATE * 2)], "doc_id long, text string"))
    out = {r.doc_id: r for r in surrogates.replaced(docs, b"key", count_col="n").collect()}
    n = len(PRIVATE)
    assert all(out[i].text == out[i + n].text for i in range(n))  # coreference
    assert [out[i].n for i in range(n)] == [3, 4, 3, 1, 0, 0, 0]
    for i, t in enumerate(PRIVATE):
        new = out[i].text
        if t is None:
            assert new is None
            continue
        if i == 2:  # numbers of an address differ in length
            spans = surrogates.found(new)
            assert [k for k, *_ in spans] == [k for k, *_ in surrogates.found(t)] and not set(new.split()) & {x for x in t.split() if any(c.isdigit() for c in x)}
            continue
        assert len(new) == len(t)
        for kind, a, b in surrogates.found(t):
            assert new[a:b] != t[a:b]  # but the same script, case and punctuation
            assert [(c.isdigit(), c.isalpha(), c.isupper()) for c in new[a:b]] == [(c.isdigit(), c.isalpha(), c.isupper()) for c in t[a:b]]
    one = out[0].text.split()
    assert one[1].lower() == one[3].strip(",").lower()  # one address in two cases
    assert "+1 (" in out[0].text and out[1].text.startswith("Frau ")
    card = out[1].text.split("card ")[1]
    assert surrogates.luhn(card[:19].replace(" ", "")) and not surrogates.luhn(card[-16:])
    assert surrogates.clashes(surrogates.entities(docs, b"key")).isEmpty()


def test_surrogates_of_texts_without_digits_and_of_compressed_addresses():
    s = surrogates.Surrogates(b"key")
    for entity in ("ghp_" + "abcdEFGHij" * 3, "AKIA" + "ABCDEFGH" * 2, "abcdef" * 6, "ABCDEF" * 6):
        new, kinds = surrogates.rewritten(f"see {entity} there", s)
        assert kinds == ["secret"] and entity not in new and surrogates.rewritten(f"see {entity} there 1", s)[0] == f"{new} 1"
    for entity in ("2001:db8::1", "fe80::1", "::1", "2001:DB8:0:1::", "fe80::aaaa:bbbb:1"):
        new, kinds = surrogates.rewritten(f"at {entity}, [{entity}]/64.", s)
        assert kinds == ["hardware"] * 2 and f"at {entity}," not in new and len(new) == 2 * len(entity) + 11
        assert [k for k, *_ in surrogates.found(new)] == kinds
    for text in ("std::cout", "dead::beef", "at 1:2:3", "ab: :c1", "x::1"):
        assert not surrogates.found(text)
    with_digit = [f"a::{k:x}" for k in range(4096, 65536) if set(f"{k:x}") & set("0123456789")]
    assert len({s.of("hardware", x) for x in with_digit}) == len(with_digit)


def test_surrogates_are_a_bijection():
    s = surrogates.Surrogates(b"key")
    for kind, pool in (("ssn", [f"{i:03d}-12-{i * 7 % 10000:04d}" for i in range(1000)]), ("email", [f"u{i}@a.io" for i in range(1000)]), ("phone", [f"+1 {i:03d}" for i in range(1000)])):
        assert len({s.of(kind, x) for x in pool}) == len(pool)
    small = {s.permuted("t", a + b) for a in "aeiou" for b in "0123456789"}
    assert len(small) == 50


@pytest.mark.parametrize("run", [
    lambda d: ngram_join.join(d), lambda d: suffix_dedup.deduplicated(d), lambda d: suffix_dedup.shortened(d), lambda d: bpe.round_trip(d, PATH), lambda d: packing.pack(d, PATH, 2),
    lambda d: winnowing.fingerprints_beside_next(d), lambda d: quality.measured(d), lambda d: surrogates.replaced(d, b"k"),
])
def test_empty_tables(empty, run):
    assert run(empty).collect() == []


@pytest.mark.parametrize("partitions", [1, 8, 100])
def test_packing_pads_little_in_any_partitions(spark, sf_dir, partitions):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs.repartition(partitions), PATH, 2, keep_ids=False).collect()
    used, size = {}, {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        size.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    for pieces in size.values():
        at = 0
        for start, length, _ in sorted(pieces):
            assert start == at
            at += length
        assert at == pieces[0][2]
    assert len(size) == docs.count()
    total = sum(r.length for r in rows)
    assert len(used) <= -(-total // 4096) + max(1, 0.01 * total / 4096)


def test_words_of_like_patterns_differ(spark):
    """Two words that polynomials modulo a power of two can't tell apart."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} of the long kind here"), (2, f"{other} of the long kind here")]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2}


@pytest.mark.parametrize("frequent", [1000, 3, 1])
def test_beside_is_a_join(spark, monkeypatch, frequent):
    """Whatever keys count as frequent; null keys and keys without a value go, rows that repeat stay."""
    from lodestone.llm import common

    monkeypatch.setattr(common, "FREQUENT", frequent)
    keys = ["a"] * 9 + ["b"] * 2 + ["c", None, "z"]
    rows = spark.createDataFrame([(k, i // 2) for i, k in enumerate(keys)], "k string, i int").repartition(3)
    values = spark.createDataFrame([("a", 9, 1, None), ("b", 2, None, "y"), ("c", 1, 3, "x"), ("q", 0, 4, "w")], "k string, n int, v int, w string")
    want = rows.join(values.drop("n"), "k").select("k", "i", "v", "w").collect()
    got = common.beside(rows, values, "k", len(keys))
    assert got.columns == ["k", "i", "v", "w"] and sorted(map(repr, got.collect())) == sorted(map(repr, want))


@pytest.mark.parametrize("group", [1, 2, 5])
def test_ngram_join_in_two_rounds(spark, monkeypatch, group):
    """With neighbours first and labels from components the result is that of all pairs."""
    monkeypatch.setattr(ngram_join, "GROUP", group)
    rows = [(i, edited(BASE, i % 9)) for i in range(60)] + [(100 + i, edited(PASSAGE, i % 4)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = sorted(map(tuple, ngram_join.join(docs).collect()))
    monkeypatch.setattr(ngram_join, "AT_ONCE", -1)
    assert sorted(map(tuple, ngram_join.join(docs).collect())) == whole


def test_ngram_join_with_crowded_slots(spark, monkeypatch, tmp_path):
    """Whatever share of the slots is taken, only sets that others share move, and of equal texts none for that alone."""
    monkeypatch.setattr(sketch, "SLOT_BITS", 14)
    rows = [(i, " ".join(f"{w}-{i}" for w in prose(100).split())) for i in range(300)]
    rows += [(1000 + i, t) for i, t in rows] + [(2000, BASE), (2001, edited(BASE, 1))]
    written = {}
    monkeypatch.setattr(ngram_join, "stored", lambda df, path, *a, f=ngram_join.stored, **b: written.setdefault(path.rsplit("/", 1)[1], f(df, f"file://{tmp_path}/{len(written)}", *a, **b)))
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: i if i == 2000 else 2000 if i == 2001 else i % 1000 for i, _ in rows}
    assert 2 <= written["sets"].count() < 20  # a slot of the ids may be shared by chance


@pytest.mark.parametrize("texts", [[], [5], [0, 40, 1, 0, 700, 3], [2] * 40 + [30000] + [1] * 200])
def test_tokens_come_back_to_their_places(texts):
    """Of every segment the tokens' bits and places, also with steps that don't fit a word."""
    made = np.random.default_rng(3)
    tokens = [np.unique(made.integers(0, 1 << 63, n, np.uint64) << np.uint64(1)) for n in texts]
    want = sorted((int(x) >> 24, k) for k, t in enumerate(tokens) for x in t)
    got = [(s << 28 | int(v), int(p)) for s, payload in (sketch.placed(tokens) if sum(texts) else ()) for v, p in zip(*sketch._unplaced(payload))]
    assert sorted(got) == want


def test_survey_counts_what_others_share(spark, monkeypatch):
    """However tokens are cut into chunks; equal texts whose ids don't count share nothing."""
    words = lambda text: np.unique(np.array([zlib.crc32(w) << 32 for w in text.split()], np.uint64))
    texts = [None, "", "a b c", "c d e f", "a b c", "x y", "f q"]
    docs = spark.createDataFrame([(None if i == 6 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    for most in (1, 2, 1 << 16):
        monkeypatch.setattr(sketch, "PLACES", most)
        monkeypatch.setattr(sketch, "FLUSH", most)
        rows = sketch.surveyed(docs, lambda: words, lambda t: t.tobytes()).where("segment < 0").collect()
        assert {(r.doc_id, r.n, r.shared) for r in rows} == {(0, 0, 0), (1, 0, 0), (2, 3, 3), (3, 4, 2), (4, 3, 3), (5, 2, 0), (None, 2, 1)}
    counts = sketch.of_ids(spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 5)], "id long"))
    rows = sketch.surveyed(docs, lambda: words, lambda t: t.tobytes(), counts).where("segment < 0").collect()
    assert {(r.doc_id, r.n, r.shared) for r in rows} == {(0, 0, 0), (1, 0, 0), (2, 3, 1), (3, 4, 2), (4, 3, 0), (5, 2, 0), (None, 2, 1)}


def test_marks_lose_no_link():
    """Marks never rule out a pair of groups that has a link, and rule out nearly all others."""
    from fractions import Fraction

    made, t = np.random.default_rng(5), Fraction(4, 5)
    ruled_out = 0
    for k in range(200):
        sets = [np.unique(made.integers(0, 1 << 63, made.integers(1, 400), np.uint64)) for _ in range(8)]
        near = [x[made.random(len(x)) > made.choice([0, 0.1, 0.3])] for x in sets[:4]] if k % 2 else []
        halves = [[x for x in part if len(x)] for part in (sets[:4], near + sets[4:])]
        packed = []
        for part in halves:
            n = np.array([len(x) for x in part])
            packed.append((b"".join(zlib.crc32(x.tobytes()).to_bytes(16, "big") for x in part), n.tobytes(), n.tobytes(), b"".join(x.tobytes() for x in part), b"".join(map(ngram_join.marks, part))))
        may = ngram_join.may_link(*((g[1], g[2], g[4]) for g in packed), t)
        linked = any(5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for a in halves[0] for b in halves[1])
        assert may or not linked
        ruled_out += not may
    assert ruled_out >= 90


def test_ngram_join_with_pairs_in_rounds(spark, monkeypatch):
    """Whatever moves at once, the result is the same."""
    monkeypatch.setattr(ngram_join, "GROUP", 2)
    docs = spark.createDataFrame([(i, edited(BASE, i % 9)) for i in range(60)], "doc_id long, text string").repartition(3)
    whole = sorted(map(tuple, ngram_join.join(docs).collect()))
    monkeypatch.setattr(ngram_join, "MOVED", 0.2)
    assert sorted(map(tuple, ngram_join.join(docs).collect())) == whole


def test_components_with_frequent_nodes(spark, tmp_path, monkeypatch):
    """A star, chains and repeated links, with every node frequent, some and none, against a union-find."""
    from lodestone.llm import common
    from lodestone.llm.components import Forest, components

    key = lambda i: b"%04d" % i
    pairs = [(500, i) for i in range(0, 900, 3)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2001), (2001, 2000), (2002, 2002), (899, 1060)]
    forest = Forest()
    for a, b in pairs:
        if a != b:
            forest.join(key(a), key(b))
    want = {x: forest.root(x) for x in list(forest.parent)}
    links = spark.createDataFrame([(bytearray(key(a)), bytearray(key(b))) for a, b in pairs], "a binary, b binary").repartition(7)
    for frequent in (1000, 4, 1):
        monkeypatch.setattr(common, "FREQUENT", frequent)
        rows = components(links, f"{tmp_path}/{frequent}").collect()
        assert len(rows) == len(want) and {bytes(r.node): bytes(r.root) for r in rows} == want


def test_components_that_do_not_settle_are_an_error(spark, monkeypatch, tmp_path):
    from lodestone.llm import components

    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)], "a binary, b binary").repartition(4)
    got = {bytes(r.node): bytes(r.root) for r in components.components(links, f"{tmp_path}/a").collect()}
    assert got == {bytes([i]): bytes([0]) for i in range(61)}
    monkeypatch.setattr(components, "ROUNDS", 2)
    with pytest.raises(RuntimeError):
        components.components(links, f"{tmp_path}/b")


def test_surrogates_of_names():
    s = surrogates.Surrogates(b"key")
    new = {t: surrogates.rewritten(t, s)[0] for t in (
        "Mr. John Smith", "Mr Smith", "Dr Smith", "Mrs. Anna Kowalska", "Ms Anna Kowalska", "Frau Żółć Łęcka", "Dr. Šč", "we met John Smith there",
        "John Smith left. Smith came back.", "call 030 1234567 now", "at 12 Baker Street", "Lindenstraße 7", "Mme Ελένη Παππά", "Herr Иван Петров",
    )}
    assert new["Mr. John Smith"].split()[2] == new["Mr Smith"].split()[1] == new["Dr Smith"].split()[1] != "Smith"
    assert new["Mrs. Anna Kowalska"].split()[1:] == new["Ms Anna Kowalska"].split()[1:]
    given = new["Mr. John Smith"].split()[1].lower()
    assert given in surrogates.MALE and given != "john" and new["Ms Anna Kowalska"].split()[1].lower() in surrogates.FEMALE
    assert new["we met John Smith there"].split()[2:4] == new["Mr. John Smith"].split()[1:]
    assert new["John Smith left. Smith came back."].split()[1] == new["John Smith left. Smith came back."].split()[3] != "Smith"
    for text in ("Frau Żółć Łęcka", "Dr. Šč", "Mme Ελένη Παππά", "Herr Иван Петров"):
        for old, now in zip(text.split()[1:], new[text].split()[1:], strict=True):
            stays = [o for o, c in zip(old, now) if o == c]
            assert len(old) == len(now) and len(stays) <= 2 and [c.isupper() for c in old] == [c.isupper() for c in now]
    assert new["call 030 1234567 now"] != "call 030 1234567 now" and new["Lindenstraße 7"].split()[0].endswith("straße") and "Linden" not in new["Lindenstraße 7"]
    assert new["at 12 Baker Street"].endswith(" Street") and "Baker" not in new["at 12 Baker Street"] and "12" not in new["at 12 Baker Street"]
    for text in ("the street of John", "Und Peter", "12 streets", "0 12"):
        assert surrogates.found(text) == []


def test_surrogates_of_name_parts_are_distinct():
    s = surrogates.Surrogates(b"key")
    parts = {a + v + b for a in (*surrogates.ONSETS, *"bdfgklmnprstvw") for v in "aeiou" for b in (*surrogates.INNER, "a", "o", "l", "z")} | {*surrogates.FEMALE, *surrogates.MALE}
    new = {s._part(x) for x in parts}
    assert len(new) == len(parts)
    assert all(len(s._part(x)) == len(x) for x in list(parts)[:200])
    assert {s._part(x) for x in surrogates.FEMALE} - {*surrogates.FEMALE} == {s._part(x) for x in surrogates.FEMALE if x not in s.given}


def test_successors_of_scattered_ids(spark):
    """Hashed ids are followed by the next larger one, and no range has more than its share."""
    ids = sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(3000)})
    got = winnowing.cyclic_successors(spark.createDataFrame([(x,) for x in [*ids, *ids[:50]]], "k long"), "k").collect()
    assert {r.k: r.following for r in got} == dict(zip(ids, ids[1:] + ids[:1])) and len(got) == len(ids)


def test_winnowing_against_brute_force(spark):
    """Hash values, choice of windows and both likenesses, from the definition."""
    from pyspark.sql import functions as F

    texts = [prose(60), prose(60), PASSAGE + " " + prose(20), prose(25) + " " + PASSAGE, "a " * 20, "one two", ""]
    words = sorted({w[i : i + 16] for t in texts for w in t.split() for i in range(0, len(w), 16)})
    symbol = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    mask = (1 << 64) - 1
    turn = lambda x, n: (x << n | x >> (64 - n)) & mask if n else x

    def chosen(text):
        h = [symbol[w] & mask for w in text.split()]
        if not h:
            return []
        if len(h) < 5:
            whole = 0
            for x in h:
                whole = turn(whole, 1) ^ x
            return [(whole >> 26, 0)]
        grams = []
        for i in range(len(h) - 4):
            value = 0
            for j in range(5):
                value ^= turn(h[i + j], 4 - j)
            grams.append((value >> 26, i))
        picked = []
        for s in range(max(1, len(grams) - 3)):
            least = min(x for x, _ in grams[s : s + 4])
            best = max(g for g in grams[s : s + 4] if g[0] == least)
            if best not in picked:
                picked.append(best)
        return picked

    def near(a, b):
        a, b = {x for x, _ in a}, {x for x, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    rows = winnowing.fingerprints_beside_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    own, edited, following = (winnowing.hashes(F.col(c)) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    rows = rows.select("doc_id", "fingerprint", winnowing.likeness(own, edited).alias("e"), winnowing.likeness(own, following).alias("n")).collect()
    for r in rows:
        mine, after = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        assert [((x >> 25) & ((1 << 38) - 1), (1 << 25) - 1 - (x & ((1 << 25) - 1))) for x in r.fingerprint] == chosen(mine)
        assert r.n == pytest.approx(near(chosen(mine), chosen(after)))
        half = len(mine) // 2
        altered = mine[: len(mine) - half] + after[:half]
        if all(w in symbol for w in altered.split()):
            assert r.e == pytest.approx(near(chosen(mine), chosen(altered)))


def test_quality_by_plain_densities():
    """Scores of the model are those of the two normal densities, computed without factors."""
    gen = np.random.default_rng(3)
    d = len(quality.STATISTICS)
    rows = {c: gen.normal(c, 1 + c, (40, d)) @ gen.normal(0, 1, (d, d)) for c in (0, 1)}
    for r in rows.values():
        r[:, 0] = np.abs(r[:, 0])
    model = quality.fitted({c: (len(r), r.sum(0), r.T @ r) for c, r in rows.items()})
    x = np.concatenate([rows[0][:5], rows[1][:5]])
    density = []
    for c in (0, 1):
        cov = np.cov(rows[c].T)
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov))
        cov = 0.98 * cov + 0.02 * np.trace(cov) / d * np.eye(d)
        diff = x - rows[c].mean(0)
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) + np.linalg.slogdet(cov)[1]))
    words = np.expm1(x[:, 0])
    odds = 0.25 * words / (words + 20) * (density[1] - density[0])  # the classes are of one size
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(-np.clip(odds, -700, 700))), abs=1e-9)


def test_quality_keeps_nothing_of_nothing(spark, empty):
    model = quality.Model(0.9)
    assert quality.keep(empty, model).collect() == [] and quality.keep(empty, model).columns == empty.columns
    long = spark.createDataFrame([("word " * 300_000,), (None,), ("",)], "text string")
    assert quality.keep(long, model).count() == 3
