import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import catalog, patch, validate
from lodestone.operators import markdown as ops
from lodestone.sources import config, discovery

TYPES = config.document_types("""
document-types:
  rfc: {layout: status, statuses: [draft, done], tags: [b, a]}
  spec: {layout: category}
  project: {layout: directory}
  template: {}
""")
GOOD = "---\nid: rfc-00001-x\ntype: rfc\ncode: 00001\nslug: x\ntitle: T\ndescription: D\ncreated: 2024-01-01\ntags:\n  - a\nstatus: draft\n---\n# T\n"


def errors(spark, path, kind, content, **more):
    df = spark.createDataFrame([(path, kind, bytearray(content if isinstance(content, bytes) else content.encode()))], "path string, doc_type string, content binary")
    return [r.error for r in validate.validate(df, TYPES, **more).collect()]


def test_rules(spark):
    at = "w/doc/rfc/draft/rfc-00001-x.md"
    assert errors(spark, at, "rfc", GOOD) == []
    assert errors(spark, at, "rfc", "no frontmatter") == ["Missing or malformed frontmatter"]
    assert errors(spark, at, "rfc", GOOD.replace("title: T\n", "")) == ["Missing required frontmatter field: title"]
    assert errors(spark, at, "rfc", GOOD.replace("status: draft", "status: odd")) == ["Invalid status 'odd'. Allowed: [\"draft\", \"done\"]", "File is in folder 'draft' but frontmatter status is 'odd'"]
    assert errors(spark, at, "rfc", GOOD.replace("slug: x", "slug: x--y"))[0] == "Invalid slug: Slug must not contain consecutive hyphens"
    assert errors(spark, at, "rfc", GOOD + "See [[rfc-1-a.md]] and [[b.md]].\n") == ["Wikilink 'rfc-1-a.md' should not include .md extension"]
    assert errors(spark, at, "rfc", GOOD + "#{Bad_Name} #{good-name}\n") == ["Invalid substitution variable '#{Bad_Name}'; variable names must be kebab-case"]
    assert len(errors(spark, at, "rfc", GOOD.replace("\n", "\r\n"))) == len(errors(spark, at, "rfc", b"\xef\xbb\xbf" + GOOD.encode())) == len(errors(spark, at, "rfc", b"\xff")) == 1
    spec = GOOD.replace("rfc", "spec").replace("status: draft\n", "")
    assert errors(spark, "w/doc/spec/cat/spec-00001-x.md", "spec", spec) == ["Missing required frontmatter field: category"]
    assert errors(spark, "w/doc/spec/cat/spec-00001-x.md", "spec", spec.replace("tags:", "category: dog\ntags:")) == ["File is in folder 'cat' but frontmatter category is 'dog'"]
    assert errors(spark, "w/doc/spec/cat/spec-00001-x.md", "spec", spec.replace("tags:", "category: dog\ntags:"), top_folders=["cat"]) == []
    assert "directly under 'doc/project'" in errors(spark, "w/doc/project/sub/project-00001-x.md", "project", GOOD.replace("rfc", "project"))[0]
    assert errors(spark, "w/doc/template/t.md", "template", "---\nid: #{id}\n---\n") == []


def test_bare_stems(spark):
    stems = frozenset(["rfc-1-a", "rfc-1-a-b", "pkg/rfc-1-a"])
    hits = lambda s: [x for x, *_ in validate.bare_stems(s, stems)]
    assert hits("see rfc-1-a-b, pkg/rfc-1-a and (rfc-1-a).") == ["rfc-1-a-b", "pkg/rfc-1-a", "rfc-1-a"]
    assert hits("[[rfc-1-a]] `rfc-1-a` rfc-1-a.md http://x/rfc-1-a x_rfc-1-a rfc-1-a/y\n```\nrfc-1-a\n```\n") == []
    assert hits("---\nid: rfc-1-a\n---\nrfc-1-a") == ["rfc-1-a"]
    assert errors(spark, "w/doc/rfc/draft/rfc-00001-x.md", "rfc", GOOD + "rfc-1-a\n", stems=stems) == ["Bare governed document stem 'rfc-1-a' should be a wikilink; expected '[[rfc-1-a]]'"]


def test_repairs(spark):
    raw = b"\xef\xbb\xbf" + GOOD.replace("# T\n", "Title line\nrfc-1-a [[x.md]]\n").replace("\n", "\r\n").encode()
    df = spark.createDataFrame([("w/doc/rfc/done/rfc-00001-x.md", "rfc", bytearray(raw)), ("w/doc/rfc/draft/rfc-00001-x.md", "rfc", bytearray(GOOD.encode()))], "path string, doc_type string, content binary")
    (r,) = validate.repair_plan(df, TYPES, ["rfc-1-a"]).collect()
    assert r.target == "w/doc/rfc/draft/rfc-00001-x.md" and r.fixes == ["remove_bom", "normalize_line_endings", "normalize_wikilinks", "link_bare_stems", "normalize_heading"]
    assert bytes(r.content).decode().endswith("---\n# Title line\n[[rfc-1-a]] [[x]]\n")


TEXT = "one\ntwo\nthree\nfour\n"
DIFF = "--- a/x.md\n+++ b/x.md\n@@ -1,3 +1,3 @@\n one\n-two\n+TWO\n three\n"


def test_unified_patches():
    assert patch.unified(TEXT, DIFF, "x.md") == "one\nTWO\nthree\nfour\n"
    assert patch.unified(TEXT.replace("\n", "\r\n"), f"text\n```diff\n{DIFF}```".split("text\n")[1], "x.md") == "one\r\nTWO\r\nthree\r\nfour\r\n"
    for bad in (DIFF.replace("b/x.md", "/dev/null"), DIFF.replace("a/x.md", "/dev/null"), DIFF.replace("b/x", "b/y"), DIFF.replace("-1,3", "-1,4"), DIFF.replace(" three", " threes")):
        with pytest.raises(patch.PatchError):
            patch.unified(TEXT, bad, "x.md")
    with pytest.raises(patch.PatchError):
        patch.unified(TEXT, DIFF, "other.md")
    with pytest.raises(patch.PatchError):
        patch.unified("a\r\nb\n", DIFF, "x.md")


def test_envelope_patches(spark):
    p = "*** Begin Patch\n*** Update File: doc/x.md\n@@\n two\n-three\n+THREE\n*** End Patch"
    assert patch.envelope(TEXT, p, "x.md") == "one\ntwo\nTHREE\nfour\n"
    for bad in (p.replace("*** End Patch", ""), p.replace("Update File", "Delete File"), p.replace(" two", " none"), p.replace("x.md", "y.md")):
        with pytest.raises(patch.PatchError):
            patch.envelope(TEXT, bad, "x.md")
    with pytest.raises(patch.PatchError, match="2 times"):
        patch.envelope("a\na\n", "*** Begin Patch\n*** Update File: x.md\n@@\n-a\n+b\n*** End Patch", "x.md")
    df = spark.createDataFrame([(TEXT, p, "x.md"), (TEXT, DIFF, "y.md")], "c string, p string, n string")
    a, b = (r.r for r in df.select(patch.patched(F.col("c"), F.col("p"), F.col("n")).alias("r")).collect())
    assert a.error is None and b.content is None and "x.md" in b.error


def test_discovery(spark, tmp_path):
    for name in ("doc/rfc/rfc-1-a.md", "doc/rfc/rfc-2-b.MARKDOWN", "doc/rfc/note.txt", "doc/rfc/Bad.md", "doc/old/rfc-3-c.md", ".lodestone/packages/pkg/doc/rfc-1-a.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# x\n\ny")
    (tmp_path / "doc/rfc/rfc-4-d.md").write_bytes(b"\xff\xfe")
    records, issues = discovery.discover(spark, str(tmp_path), ["pkg", "gone"], ["doc/old"])
    assert [(r.package, r.document_stem) for r in discovery.ordered_records(records).collect()] == [(None, "rfc-1-a"), (None, "rfc-2-b"), ("pkg", "rfc-1-a")]
    assert [(r.kind, r.package) for r in discovery.ordered_issues(issues).collect()] == [("encoding", None), ("invalid_stem", None), ("missing_package", "gone")]
    extracted = ops.extract(records)
    assert extracted.where("status = 'extracted'").count() == 3 and ops.heading_outline(extracted).count() == 3
    assert discovery.file_suggestions(discovery.files(spark, [str(tmp_path / "doc")]), "rfc").count() == 4


def test_config():
    assert [t.name for t in TYPES] == ["project", "rfc", "spec", "template"]
    for bad in ("document-types: {a: {odd: 1}}", "document-types: {a: {layout: odd}}"):
        with pytest.raises(config.ConfigError):
            config.document_types(bad)
    assert config.bad_keys({"good-key": {"Bad": 1}, "free": {"Any_Key": 1}}, frozenset(["free"])) == ["Bad"]
    packages = config.add_package([], "pkg", "git", "http://x", "v1")
    assert config.manifest(config.dump_manifest(packages)) == packages and config.manifest(None) == []
    for bad in (("P", "git", "u", "t"), ("p", "svn", "u", "t"), ("p", "git", "", "t"), ("p", "git", "u", None), ("p", "git", "u", "branch:"), ("pkg", "file", "u", None)):
        with pytest.raises(config.ConfigError):
            config.add_package(packages, *bad)
    sections = config.dashboard_sections("sections: [{title: A, doc-type: rfc, statuses: [draft]}, {title: B, doc-type: spec, statuses: [x]}, {title: C, doc-type: no}]", TYPES)
    assert [bool(s["error"]) for s in sections] == [False, True, True]


def test_catalogue(spark):
    rows = catalog.catalogue(spark.createDataFrame([("doc/rfc/draft/rfc-2-b.md", "rfc-2-b", None), ("doc/rfc/draft/rfc-10-a.md", "rfc-10-a", "Ten"), ("doc/rfc/done/rfc-2-b.md", "rfc-2-b", "x"), ("doc/x.md", "x", None)], "path string, document_stem string, title string"))
    assert [r.slug for r in catalog.sorted_catalogue(rows.where("folder = 'draft'")).collect()] == ["b", "a"]
    assert catalog.next_code(rows, "rfc").first().next_code == 11 and catalog.next_code(rows, "none").first().next_code == 1
    assert catalog.find(rows, "rfc", 2).first().folder == "done" and catalog.only(rows, F.col("document_stem") == "rfc-2-b").first().reason == "ambiguous"
    assert catalog.tree(rows).count() == 2 and catalog.group_filter(rows, "status", "done").count() == 1
    board = catalog.dashboard(rows, config.dashboard_sections("sections: [{title: A, doc-type: rfc, statuses: [draft]}]", TYPES))
    assert {r.document_stem for r in board.collect()} == {"rfc-2-b", "rfc-10-a"}
    assert catalog.target_path("rfc", "status", 7, "x", 5, "draft") == "doc/rfc/draft/rfc-00007-x.md"
    types = spark.createDataFrame([(t.name, t.layout, t.tags) for t in TYPES], "name string, layout string, tags array<string>")
    assert catalog.tags(types).first().tags == "a,b" and catalog.type_listing(types).first().listing.startswith("## project\n")
    rules = spark.createDataFrame([("rust", "gate", "p1"), ("python", "gate", "p2"), ("go", "gate", "none")], "language string, kind string, stem string")
    files = spark.createDataFrame([("p1", "---\nx: 1\n---\nRust"), ("p2", "Python")], "stem string, body string")
    assert catalog.prompt_bodies(rules, files, ["python", "go", "rust"], "gate").first().prompt == "Python\n\nRust"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    values = F.create_map(F.lit("a-b"), F.lit("1"))
    assert one(catalog.substitute(F.lit("#{a-b} #{c} #{a-b}"), values)) == "1 #{c} 1" and one(catalog.unresolved(F.lit("#{a-b} #{c} #{d} #{c}"), values)) == ["c", "d"]
    assert [(f.key, f.kind) for f in one(catalog.form_fields(F.lit("name = input(x)\nno\nask = chat-input()")))] == [("name", "input"), ("ask", "chat-input")]
    assert one(catalog.mentions(F.lit("@a b@c @d/e @a"))) == ["a", "d/e"]
    stems = {"rfc-1-a": True, "a-b-1-c-2-d": True, "1-a-b": False, "a-1": False, "A-1-b": False, "a--1-b": False, "a-1-b\n": False, "rfc-x-1": False, "a-1-2": True}
    assert {s: one(T.is_stem(F.lit(s))) for s in stems} == stems
    assert one(T.stem_parts(F.lit("ai-rule-007-x-1"))["type"]) == "ai-rule" and one(T.padded_code(F.lit(123456), 5)) == "123456"
    assert one(T.token_count(F.lit("a\xa0b　c  d\n"))) == 4 and one(T.anchor(F.lit("A  B--c! é-"))) == "a-b-c"
    assert one(T.unix_lines(F.lit("a\r\nb\rc"))) == "a\nb\nc"


def test_stems_by_join_equal_a_dictionary(spark, monkeypatch):
    import random

    rng = random.Random(2)
    stems = [f"rfc-{i}-{s}" for i in range(12) for s in ("a", "a-b")] + ["pkg/rfc-1-a", "pkg/rfc-2-zz"]
    parts = [*stems, "rfc-1", "rfc-1-a/x", "x/rfc-1-a", "`rfc-1-a`", "[[rfc-2-a]]", "http://x/rfc-3-a", "rfc-4-a.md", "rfc-4-a.", "(rfc-5-a)", "\n", "\n```\n", "_rfc-1-a", "Rfc-1-a", "é"]
    texts = [(i, " ".join(rng.choices(parts, k=rng.randrange(30)))) for i in range(80)] + [(90, None), (91, ""), (92, "rfc-1-a " * 3000)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    table = spark.createDataFrame([(s,) for s in [*stems, stems[0], None]], "stem string")
    want = sorted((i, *x) for i, t in texts for x in validate.bare_stems(t or "", frozenset(stems)))
    got = validate.stem_mentions(df, "id", table)
    assert sorted(map(tuple, got.collect())) == want and any(a == "pkg/rfc-2-zz" for _, a, *_ in want)
    assert got.where("id = 92").count() == 3000 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_stem_mentions_move_packed_by_word(spark):
    texts = spark.range(0, 2000, 1, 1).select("id", F.expr("concat('rfc-1-a and rfc-2-b, ', repeat('word ', 50))").alias("text"))
    table = spark.createDataFrame([("rfc-1-a",), ("rfc-2-b",)], "stem string")
    got = validate.stem_mentions(texts, "id", table)
    assert got.count() == 4000 and got.agg(F.countDistinct("id")).first()[0] == 2000
    assert [tuple(r) for r in got.where("id = 7").orderBy("start").collect()] == [(7, "rfc-1-a", 0, 7), (7, "rfc-2-b", 12, 19)]
    # 106,000 places of four words: what crosses from Python is a row for a word, not for a place
    plan = got._jdf.queryExecution().analyzed()
    python = plan
    while "MapInArrow" not in python.nodeName():
        python = python.children().head()
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, python)
    assert rows.count() < 100


def test_candidates_of_a_long_line_take_time_in_proportion():
    import time

    began = time.process_time()
    assert len(validate.candidates("rfc-1-a `x` " * 20000)) == 20000
    assert time.process_time() - began < 5


def test_a_corpus_of_one_file_is_dealt_over_the_cluster(spark, sf_dir, tmp_path):
    from lodestone.plans import governed

    spark.read.parquet(f"{sf_dir}/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = governed.extracted_metadata(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    per = [r["count"] for r in rows.groupBy("task").count().collect()]
    assert len(per) >= 2 * spark.sparkContext.defaultParallelism and max(per) < sum(per) / 4


def test_rules_and_stems_write_no_text_out_for_each_use(spark, sf_dir):
    from lodestone.plans import governed

    plan = governed.governed_stems(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("lpad") < 20  # 202 where a filter on the text was pushed below what makes it


def test_bad_rows_are_rows(spark):
    schema = "package string, document_stem string, document_hash string, content binary"
    deep = b"---\na: " + b"[" * 5000 + b"]" * 5000 + b"\n---\n# T\n\nx\n"
    rows = [(None, "spec-1-none", "h", None), (None, "spec-2-bytes", "h", bytearray(b"\xff")), (None, "spec-3-deep", "h", bytearray(deep)), (None, "spec-4-good", "h", bytearray(b"# T\n\nFine.\n"))]
    df = spark.createDataFrame(rows, schema)
    want = {"spec-1-none": "no_content", "spec-2-bytes": "encoding", "spec-3-deep": "malformed_frontmatter", "spec-4-good": None}
    for op in (ops.extract, ops.chunks):
        assert {r.document_stem: r.error_kind for r in op(df).collect()} == want
    governed = spark.createDataFrame([("w/doc/rfc/draft/a.md", "rfc", None), ("w/doc/memo/b.md", "memo", bytearray(b"x")), ("w/doc/c.md", None, None)], "path string, doc_type string, content binary")
    assert {r.path: r.error for r in validate.validate(governed, TYPES).collect()} == {
        "w/doc/rfc/draft/a.md": "file has no content", "w/doc/memo/b.md": "Unknown document type 'memo'", "w/doc/c.md": "Unknown document type ''",
    }
    assert validate.repair_plan(governed, TYPES, ["rfc-1-a"]).collect() == []
