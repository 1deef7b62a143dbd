import pytest

from lodestone.functions import frontmatter as fm
from lodestone.functions import markdown as md
from lodestone.functions.hashing import chunk_hash, fnv1a

SPEC = "spec-00011-rag-plan-implementation"


def chunks(source, stem=SPEC, package=None, config=md.Config()):
    return md.chunk(package, stem, md.extract(source), config)


def test_fnv():
    assert fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_short_section():
    e = md.extract("---\ntitle: Short\n---\n# Title\n\n## Short Section\n\nA concise section.\n")
    assert e["body_start"] == 21 and [h["text"] for h in e["headings"]] == ["Title", "Short Section"]
    (c,) = md.chunk(None, SPEC, e)
    assert (c["heading_path"], c["text"], c["token_count"], c["chunk_hash"]) == (["Title", "Short Section"], "## Short Section\n\nA concise section.", 6, "bf6a178204fa7888")
    assert c["chunk_id"] == f"workspace/{SPEC}/0000/bf6a178204fa7888"


def test_nested_sections_overlap():
    a, b = chunks("# RFC 00034\n\n## Proposal\n\nProposal introduction.\n\n### Details\n\nNested content.\n", "rfc-00034-markdown-chunking")
    assert (a["chunk_hash"], b["chunk_hash"]) == ("3090d2c1122f5502", "2b4d39cceb910146") and "Nested content." in a["text"]


def test_packages_and_line_ends():
    (c,) = chunks("# Package Spec\n\nPackage synchronized content.\n", package="shared-docs")
    assert c["chunk_hash"] == "1003eebf0b9e259b" and c["chunk_id"].startswith(f"shared-docs/{SPEC}/0000/")
    assert {chunks(s)[0]["chunk_hash"] for s in ("# Title\n\nBody.", "# Title\r\n\r\nBody.")} == {"07aa48c75a67155c"}


def test_heading_only_sections_and_preface():
    assert [c["heading_path"][-1] for c in chunks("# Title\n\n## Empty\n\n## Full\n\nBody.\n")] == ["Full"]
    assert [c["heading_path"] for c in chunks("Opening paragraph before headings.\n\n# Title\n\nBody.\n")] == [[], ["Title"]]
    assert len(chunks("# Task\n\n## Phase\n\nFirst.\n\n## Phase\n\nSecond.\n")) == 2 and chunks("\n\n") == []


def test_hashes_of_other_sections_stay():
    one, two = (chunks(f"# T\n\n## Stable\n\nsame\n\n## Changed\n\n{x}\n") for x in ("a", "b"))
    assert one[0] == two[0] and one[1]["chunk_hash"] != two[1]["chunk_hash"]


def test_oversized_sections():
    assert all(c["token_count"] <= 500 for c in chunks("# Title\n\n## Long Section\n\n" + "word " * 520))
    paragraphs = "\n\n".join(" ".join(f"{w}-{i}" for i in range(8)) for w in ("alpha", "beta", "gamma"))
    out = chunks(f"# T\n\n## Long Section\n\n{paragraphs}\n", config=md.Config(10, 12, 0))
    assert len(out) == 3 and all(c["token_count"] <= 12 and c["text"].startswith("## Long Section\n\n") for c in out)


def test_overlap_carries_the_tail():
    items = "\n".join(f"- {n} item words" for n in ("first", "second", "third", "fourth"))
    out = chunks(f"# T\n\n## Before\n\nleading\n\n## List\n\n{items}\n\n## After\n\ntrailing\n", config=md.Config(8, 14, 8))
    parts = [c["text"] for c in out if c["heading_path"][-1] == "List"]
    assert len(parts) > 1 and all("leading" not in p and "trailing" not in p for p in parts)
    assert any(set(a.split("\n\n")[1:]) & set(b.split("\n\n")[1:]) for a, b in zip(parts, parts[1:]))


def test_fences_and_tables_stay_whole():
    out = chunks("## Code\n\none two three four five\n\n```rust\nfn main() {}\n```\n\nsix seven eight nine\n", config=md.Config(7, 12, 0))
    assert sum("fn main() {}" in c["text"] and c["text"].count("```") == 2 for c in out) == 1
    table = chunks("## T\n\n| a | b |\n| - | - |\n| 1 | x y |\n| 2 | z w |\n| 3 | u v |\n", config=md.Config(16, 18, 0))
    assert all("| a | b |\n| - | - |" in c["text"] for c in table)
    with pytest.raises(md.OversizedBlock):
        chunks("## C\n\n```\n" + "w " * 20 + "\n```\n", config=md.Config(5, 8, 0))


FULL = """---
title: Full
tags: [a, b]
---
# One

See [[rfc-1-x#part|label]] and [inline](path.md#proposal) ![img](no.png) <https://example.org> [ref][key].

```
# not a heading [[no]]
```

## One

[Missing][missing-ref]
[key]: target.md#frag
"""


def test_extraction():
    e = md.extract(FULL)
    assert [link["kind"] for link in e["links"]] == ["Wikilink", "Inline", "Autolink", "Reference"]
    wiki, inline, auto, ref = e["links"]
    assert (wiki["target"], wiki["heading"], wiki["label"]) == ("rfc-1-x", "part", "label") and inline["heading"] == "proposal"
    assert (ref["target"], ref["heading"]) == ("target.md", "frag") and FULL.encode()[wiki["start"] : wiki["end"]].decode() == wiki["raw"]
    assert [d["kind"] for d in e["diagnostics"]] == ["duplicate_anchor", "unresolved_reference_link"]


def test_offsets_are_bytes():
    source = "# Größe é\n\n[[ß]]\n"
    e = md.extract(source)
    assert source.encode()[e["headings"][0]["start"] : e["headings"][0]["end"]].decode() == "# Größe é"
    assert source.encode()[e["links"][0]["start"] : e["links"][0]["end"]].decode() == "[[ß]]"


def test_frontmatter_formats():
    assert fm.parse("+++\na = 1\nb = [\"x\", \"y\"]\nc = true\n+++\nx").metadata == {"a": "1", "b": ["x", "y"], "c": True}
    assert fm.parse('---json\n{"a": 1.5}\n---\nx').metadata == {"a": "1.5"}
    assert fm.parse("---\ntitle: [broken\n---\n").error and fm.parse("---\nnever closed\n").error == "unclosed"
    assert fm.parse("no frontmatter").format is None and fm.parse("---").format is None
    assert fm.parse("---\na: yes\nb: 2024-01-01\nc: true\n---\n").metadata == {"a": "yes", "b": "2024-01-01", "c": True}
    assert fm.filterable({"tags": ["a", "b"], "one": "x", "flag": True, "nested": {"k": 1}, "bad": ["a", None], "null": None}) == {"tags": ["a", "b"], "one": ["x"], "flag": ["true"]}


def test_governed_fields():
    assert fm.governed_fields('text ---\nid: "x"\ntags:\n  - a\n  - "b"\nempty:\nlast:\n--- body') == {"id": "x", "tags": "a, b", "last": ""}
    assert fm.governed_fields("--- once") is None


def test_scalars():
    text = "---\nstatus: draft\n---\nstatus: body\n"
    assert fm.scalar(text, "status") == "draft" and fm.with_scalar(text, "status", "done") == "---\nstatus: done\n---\nstatus: body\n"


def test_hash_depends_on_every_part():
    base = (None, "a-1-b", 0, ["x"], "t")
    assert len({chunk_hash(*base), *(chunk_hash(*base[:i], v, *base[i + 1 :]) for i, v in enumerate(("p", "a-1-c", 1, ["y"], "u")))}) == 6


def test_quick_yaml_equals_the_other_loader():
    import random

    import yaml

    from lodestone.functions import frontmatter as fm

    assert issubclass(fm._Quick, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    rng = random.Random(3)
    parts = ["a", "key", "- ", ": ", ":", "\n", "\n  ", "\n- ", " ", "'", '"', " #", "x: y", "\nk: ", "\r\n", "true", "yes", "00031", "31", "1.5", "~", "2024-01-01", "...", "<<: ", "0x1f", "http://x/y", "é", "\t", "[", "]", "{a: b}", "!x ", "&a ", "*a", "|", "> "]

    def read(loader, block):
        try:
            return repr(loader(block))
        except yaml.YAMLError as e:
            return str(e).splitlines()[0]

    made = ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(3000)]
    for b in [*made, "a:\tb", "code: 00031\ntags:\n  - x\n  - yes\n", " " * 70 + "a: b"]:
        assert read(fm._yaml, b) == read(lambda x: yaml.load(x, fm._Loader), b), b
    assert sum(not fm._ODD.search(b) for b in made) > 500
