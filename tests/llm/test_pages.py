"""Media sequences, HTML extraction and preference formatting."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import media, preferences, queries, templates
from tests.oracle import spark_rows, sql_rows

rng = random.Random(5)


def test_media_hold_any_bytes():
    for n in (0, 1, 15, 191, 192, 193, 5000):
        text = bytes(rng.randrange(256) for _ in range(n))
        payload, size = media.from_png(media.as_png(text))
        assert size == n and payload == text + b" " * (max(192, -(-n // 192) * 192) - n)
        assert media.feature(payload) == media.feature(payload)
    damaged = bytearray(media.as_png(b"x"))
    damaged[60] ^= 1
    with pytest.raises(Exception):
        media.from_png(bytes(damaged))


D1, D2 = "1" * 64, "2" * 64
HTML = f'<p>Fish &amp; chips</p><script>no()</script><figure><img src="sha256:{D1}"><img src="x.png"><figcaption>Two <b>views</b></figcaption></figure>after<img src="/m/sha256-{D2}.jpg" alt="alone"><p>end'


def test_items_stay_in_order_with_their_captions():
    got = [(i["kind"], i["text"], i["digest"], i["caption"]) for i in media.items(HTML)]
    assert got == [("text", "Fish & chips", None, None), ("media", None, D1, "Two views"), ("media", None, None, "Two views"), ("text", "after", None, None), ("media", None, D2, "alone"), ("text", "end", None, None)]
    assert media.items("") == [] and media.items("<figure><img src='a'><figcaption>open")[0]["caption"] == "open"


def test_digests_resolve(spark):
    pages = spark.createDataFrame([(1, HTML, "x"), (2, None, "x"), (3, "", "x"), (1, HTML, "x")], "doc_id long, html string, digest string")
    store = spark.createDataFrame([(D1, b"a"), (D1, b"a"), ("9" * 64, b"z"), (None, b"n")], "digest string, payload binary")
    rows = media.resolved(media.sequences(pages, "doc_id", "html"), store)
    got = sorted((r.doc_id, r.position, r.kind, bytes(r.payload) if r.payload else None) for r in rows.collect())
    one = [(1, 0, "text", None), (1, 1, "media", b"a"), (1, 2, "media", None), (1, 3, "text", None), (1, 4, "media", None), (1, 5, "text", None)]
    assert got == sorted(one * 2, key=lambda x: x[:3])
    whole = media.interleaved(media.resolved(media.sequences(pages.limit(1), "doc_id", "html"), store)).first()
    assert [i.position for i in whole["items"]] == list(range(6))
    assert media.resolved(media.sequences(pages.where("false"), "doc_id", "html"), store).isEmpty()


def test_media_query(spark, sf_dir):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op4_media(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = texts[r.doc_id]
        payload = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        assert (r.n_bytes, r.payload_sha256, r.media_sha256) == (len(b), hashlib.sha256(payload).hexdigest(), hashlib.sha256(media.as_png(b)).hexdigest())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>"</script></head><body class="page"><!-- c -->
<header><a href="/">Home</a></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div><article><h1>Title {n}</h1>
<p>First <b>bold</b>ly &eacute;&amp;&#33;   text {n}.<br>Second<p>Open paragraph {n}<ul><li>one<li>two</ul><aside>Side</aside><form><input>Search</form></article>
<div id="comments"><p>Reader says {n}</p></div><footer>Foot {n}</footer></body></html>"""


def test_extraction(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(n=i)) for i in range(6)]
    rows += [(10, None, None), (11, "http://x/", ""), (12, "no address", "plain &lt;text&gt;"), (13, "http://h0.example/cut", PAGE.format(n=13).split("</ul><aside>")[0]), (0, "http://h0.example/0", PAGE.format(n=0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "template": F.lit(1), "text": F.lit("clash")})
    got = sorted((r.page_id, r.text) for r in templates.extracted(pages).collect())
    text = lambda n: f"Title {n} First boldly é&! text {n}. Second Open paragraph {n} one two"
    assert got == sorted([*((i, text(i)) for i in range(6)), (10, ""), (11, ""), (12, "plain <text>"), (13, text(13)), (0, text(0))])
    assert templates.extracted(pages.where("false")).isEmpty()


def test_template_texts_go_where_no_article_is_marked(spark):
    page = "<html><body><div><a href=/>one</a> <a href=/>two</a></div><div class=x>The same on all pages</div><div class=y><p>Own text {n} of this page</p></div></body></html>"
    pages = spark.createDataFrame([(i, "http://a/" + str(i), page.format(n=i)) for i in range(5)], "page_id long, url string, html string")
    assert {r.text for r in templates.extracted(pages).collect()} == {f"Own text {i} of this page" for i in range(5)}
    learned = templates.deduced(pages.withColumn("host", templates.host(F.col("url")))).collect()
    assert len(learned) == 1 and templates._text_token("/html/body/div.x", "The same on all pages") in learned[0].template


def test_the_template_decides_inside_articles_too(spark):
    page = """<html><body><article><h1>Title {n}</h1><p>Own <b>bold</b> text {n}, see <a href="/x">{n}</a></p><p>Written by our staff</p>
<div class="kick">Tell your <a href="/f">friends</a></div><ul class="more"><li><a href="/{n}">Page {n}</a></ul></article></body></html>"""
    rows = [(k, f"http://a/{k}", page.format(n=k)) for k in range(6)]
    rows += [(k, f"http://b/{k}", page.format(n=k)) for k in (10, 11, 12)]
    rows += [(20, "http://c/20", page.format(n=20))]
    copy = "<html><body><i>{n}</i><article><p>One text at many addresses</p></article></body></html>"
    rows += [(k, f"http://d/{k}", copy.format(n=k)) for k in range(30, 36)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in templates.extracted(pages).collect()}
    own = lambda k: f"Title {k} Own bold text {k}, see {k}"
    assert all(got[k] == own(k) for k in range(6))
    assert all(got[k] == f"{own(k)} Written by our staff" for k in (10, 11, 12))
    assert got[20] == f"{own(20)} Written by our staff Tell your friends Page 20"
    assert all(got[k] == "One text at many addresses" for k in range(30, 36))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body class='has-sidebar'><div class='no-sidebar'><article><p>A</article></div></body>", "A"),
        ("<body class='sidebar'><form><nav>N</nav><article><p>A</article></form></body>", "A"),
        ("<body class='sidebar'><form id=search><p>A</form><p>B</body>", "B"),
        ("<div class='page widget'><div class='ad'>N</div><main><p>A</main></div>", "A"),
        ("<div class='related'><article>N</article></div><article>A<div class='comments'><article>N</article></div></article>", "A"),
        ("<aside><article>N</article></aside><p>A", "A"),
        ("<article><div class='entry-header'><h1>H</h1></div><section id='related-work'>A</section><h2 id='search'>B</h2><p class='ad-hoc'>C<p class='notice'>D</article>", "H A B C D"),
        ("<article><div class='header'><h1>H</h1></div><section id='related'>A</section><div data-id='ad'>B</div></article>", "H A B"),
        ("<article>A<div class='share'>N</div><div class='cookie-notice x'>N</div><div id=ad_banner>N</div><div role='navigation'>N</div></article>", "A"),
        ("<div class='main-lead'>A</div><div>B</div>", "A B"),
        ("<div class='x main'>A</div><div>N</div>", "A"),
        ("<div class='widget main'><article>A</article></div><div>N</div>", "A"),
    ],
)
def test_what_stands_apart(page, text):
    assert " ".join(t for _, texts in templates.slots(page, frozenset()) for t in texts) == text


def test_copies_of_a_page_are_no_template(spark):
    page = "<html><body><div class=x><h1>Title {n}</h1><p>Text {n} of it</p><p>More {n}</p></div></body></html>"
    rows = [(0, "http://a/0", page.format(n=0)), (1, "http://a/1", page.format(n=0))]  # one page under two addresses
    rows += [(2, "http://b/2", page.format(n=2))] * 3  # repeated rows
    rows += [(3, None, page.format(n=3)), (4, None, page.format(n=3))]  # no address
    rows += [(k, f"http://c/{k}", page.format(n=max(k, 6))) for k in range(5, 9)]  # copies are half of a host
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    n = lambda k: {1: 0, 4: 3, 5: 6}.get(k, k)
    assert sorted((r.page_id, r.text) for r in templates.extracted(pages).collect()) == sorted((k, f"Title {n(k)} Text {n(k)} of it More {n(k)}") for k, _, _ in rows)


def test_equivalence_classes_by_brute_force(spark):
    pages = [(i, "http://a/", f"<div><p>x</p>{'<i>t</i>' * (i % 3)}<b>{i}</b></div>") for i in range(9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("a"))
    template = set(templates.deduced(df).first().template)
    counts = {}
    for k, _, source in pages:
        p = templates.Page(source)
        for t in map(templates._tag_token, p.tags):
            counts.setdefault(t, [0] * 9)[k] += 1
        for x in p.texts:
            if x and not x[1].isspace():
                counts.setdefault(templates._text_token(x[0], x[1]), [0] * 9)[k] += 1
    classes = {}
    for t, v in counts.items():
        classes.setdefault(tuple(v), set()).add(t)
    valid = [c for v, c in classes.items() if sum(map(bool, v)) >= 5 and len(c) >= 2]
    assert template == set().union(*valid)


def test_preferences_equal_their_sql(spark, sf_dir):
    assert spark_rows(queries.op5_preferences(spark, sf_dir)) == sql_rows(preferences.ORACLE_SQL, sf_dir)


def test_preferences(spark):
    turns = [(0, 0, "system", "S"), (0, 1, "user", "Q"), (0, 2, "assistant", "good"), (1, 0, "system", "S"), (1, 1, "user", "Q"), (1, 2, "assistant", "bad"), (1, 3, "user", None), (2, 0, None, "x"), (None, 0, "user", "lost"), (4, 0, "user", "same"), (5, 0, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"pair_id": F.lit("clash"), "t": F.lit(0)})
    out = {r.pair_id: r for r in preferences.formatted(preferences.paired(df)).collect()}
    r = out[0]
    assert (r.common_turns, r.prompt) == (2, "<|system|>\nS<|end|>\n<|user|>\nQ<|end|>\n")
    assert (r.chosen, r.chosen_mask) == ("<|assistant|>\ngood<|end|>\n", "14:0 12:1")
    assert (r.rejected, r.rejected_mask) == ("<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n", "14:0 11:1 9:0 8:0")
    assert (out[1].common_turns, out[1].chosen, out[1].rejected) == (0, "<||>\nx<|end|>\n", "")
    assert (out[2].common_turns, out[2].chosen, out[2].rejected) == (1, "", "") and len(out) == 3
    assert preferences.formatted(preferences.paired(df.where("false"))).isEmpty()


def test_most_prompts_hold_turns(spark, sf_dir):
    rows = queries.op5_preferences(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    assert sum(r.prompt != "" and r.chosen != "" and r.rejected != "" for r in rows) > len(rows) / 2
    assert all(r.chosen != r.rejected or not r.chosen for r in rows)


def test_a_neighbours_answer_is_rejected(spark):
    said = lambda *turns: [(r, t) for r, t in turns]
    talks = {
        0: said(("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")), 1: said(("user", "f"), ("assistant", "g")), 2: said(("user", "h"), ("assistant", "i")), 3: said(("user", "j")),
        4: said(("user", "k"), ("assistant", "l")), 6: said(("user", "m"), ("assistant", "same")), 7: said(("assistant", "same")), -1: said(("assistant", "n")), -2: said(("system", "o"), ("assistant", None)),
    }
    df = spark.createDataFrame([(c, k, *t) for c, turns in talks.items() for k, t in enumerate(turns)] + [(None, 0, "user", "lost")], "conv_id long, turn long, role string, text string")
    clash = df.withColumns({c: F.lit("clash") for c in ("pair_id", "chosen", "mine", "at", "from", "side", "s")})
    pairs = {r.pair_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in preferences.against_neighbours(clash).collect()}
    a = lambda t: ("assistant", t)
    talk = lambda c, n: [(r, t or "") for r, t in talks[c][:n]]
    assert pairs == {
        0: (talk(0, 4), [*talk(0, 3), a("g")]), 1: (talk(1, 2), [*talk(1, 1), a("d")]), 2: (talk(2, 2), talk(2, 1)), 3: (talk(3, 1), talk(3, 1)), 4: (talk(4, 2), talk(4, 1)),
        6: (talk(6, 2), talk(6, 2)), 7: (talk(7, 1), talk(7, 1)), -1: (talk(-1, 1), [a("")]), -2: (talk(-2, 2), [*talk(-2, 1), a("n")]),
    }
    out = {r.pair_id: r for r in preferences.formatted(preferences.against_neighbours(df)).collect()}
    assert (out[0].common_turns, out[0].chosen, out[0].rejected) == (3, "<|assistant|>\nd<|end|>\n", "<|assistant|>\ng<|end|>\n") and out[6].rejected == "" == out[3].chosen
    assert preferences.against_neighbours(df.where("false")).isEmpty()


def test_media_columns_by_hand(spark):
    """Every column of the query from the definition; the stored form is read by a reader of its own."""
    import hashlib
    import struct
    import zlib

    from lodestone.llm import media

    texts = [None, "", "a", "é" * 100, "x" * 192, "y" * 193, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = media.stored_media(docs).cache()
    rows = {r.doc_id: r for r in media.resolved(media.sequences(kept, "doc_id", "html"), media.read_back(kept)).where("kind = 'media'").collect()}
    stored = {r.doc_id: bytes(r.media) for r in kept.collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r, png = rows[k], stored[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.digest) == (len(png), hashlib.sha256(png).hexdigest())
        at, data = 8, b""
        while at < len(png):
            n, kind = struct.unpack(">I4s", png[at : at + 8])
            data += png[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
            at += n + 12
        lines = zlib.decompress(data)
        assert b"".join(lines[i + 1 : i + 193] for i in range(0, len(lines), 193)) == payload
        mean = sum(payload) / len(payload)
        spread = max(0.0, sum(b * b for b in payload) / len(payload) - mean * mean) ** 0.5
        first, second, bits = r.feature.split(":")
        assert (first, second, len(bits)) == (f"{mean:.3f}", f"{spread:.3f}", 16)
    assert rows[2].feature == rows[6].feature and rows[2].digest == rows[6].digest and rows[0].digest == rows[1].digest
    none = media.stored_media(docs.limit(0))
    assert media.resolved(media.sequences(none, "doc_id", "html"), media.read_back(none)).count() == 0


def test_sequences_of_pages_with_several_media(spark):
    from lodestone.llm import media

    png = {k: media.as_png(k.encode()) for k in ("one", "two")}
    import hashlib

    d = {k: hashlib.sha256(v).hexdigest() for k, v in png.items()}
    page = f'<p>Before</p><figure><img src="sha256:{d["one"]}"><img src="sha256:{d["two"]}"><figcaption>Both</figcaption></figure><p>Between</p><img src="sha256:{"0" * 64}" alt="Gone"><p>After</p><img src="x.png">'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    stored = spark.createDataFrame([(bytearray(x),) for x in (*png.values(), png["one"])], "media binary")
    rows = media.resolved(media.sequences(pages, "page_id", "html"), media.read_back(stored)).orderBy("position").collect()
    assert [(r.position, r.kind, r.text, r.digest, r.caption, r.n_bytes) for r in rows] == [
        (0, "text", "Before", None, None, None), (1, "media", None, d["one"], "Both", 3), (2, "media", None, d["two"], "Both", 3),
        (3, "text", "Between", None, None, None), (4, "media", None, "0" * 64, "Gone", None), (5, "text", "After", None, None, None),
        (6, "media", None, None, None, None),
    ]
