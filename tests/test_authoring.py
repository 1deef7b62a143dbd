import datetime

import pytest

from lodestone.functions.embedding import HashingEmbedder, LazyEmbedder
from lodestone.operators.patch import PatchError
from lodestone.plans import authoring
from lodestone.sources import config

RFC = config.DocumentType("rfc", "status", initial_status="draft", statuses=["draft", "done"])
DAY = datetime.date(2024, 1, 2)


def test_documents_are_created_found_and_moved(tmp_path):
    a = authoring.create(str(tmp_path), RFC, "first-idea", "First", today=DAY)
    b = authoring.create(str(tmp_path), RFC, "second", "Second", today=DAY)
    assert [p.name for p in (a, b)] == ["rfc-00001-first-idea.md", "rfc-00002-second.md"] and a.parent.name == "draft"
    assert authoring.find(str(tmp_path), "rfc", 2) == b
    moved = authoring.change_status(a, RFC, "done")
    assert moved.parent.name == "done" and "status: done" in moved.read_text() and not a.exists()
    with pytest.raises(authoring.AuthoringError):
        authoring.change_status(b, RFC, "odd")
    (tmp_path / "doc/rfc/draft/rfc-bad.md").write_text("x")
    with pytest.raises(authoring.AuthoringError):
        authoring.next_code(str(tmp_path), "rfc")


def test_templates_are_copied(tmp_path):
    (tmp_path / "t.md").write_text("id: #{id}")
    kind = config.DocumentType("note", template="t.md")
    assert authoring.create(str(tmp_path), kind, "x", "X").read_text() == "id: #{id}"


def test_replace_and_patch(tmp_path):
    p = authoring.create(str(tmp_path), RFC, "x", "X", today=DAY)
    text = p.read_text()
    authoring.replace(p, text + "more\n")
    for bad in (text.replace("slug: x", "slug: y"), "﻿" + text, "none"):
        with pytest.raises(authoring.AuthoringError):
            authoring.replace(p, bad)
    assert authoring.apply_patch(p, f"*** Begin Patch\n*** Update File: {p.name}\n@@\n-more\n+less\n*** End Patch").endswith("less\n")
    with pytest.raises(PatchError):
        authoring.apply_patch(p, f"*** Begin Patch\n*** Update File: {p.name}\n@@\n less\n*** End Patch")


def test_blocks_and_profiles():
    assert config.block("agent: a\ninputs: {n: 1, b: true, z: }", ("agent",))["inputs"] == {"n": "1", "b": "true", "z": ""}
    assert config.block("a: [")["error"] and config.block("- x")["error"] and config.block("a: 1", ("agent",))["error"] == "agent is missing"
    agents = {"one": {"command": "x"}, "two": {}}
    assert [(a["name"], a["available"]) for a in config.resolved_profile("p", {"p": ["two", "gone", "one"]}, agents)] == [("two", False), ("one", True)]


def test_lazy_embedder_is_made_at_its_first_text():
    made = []
    e = LazyEmbedder("m", 4, lambda: made.append(1) or HashingEmbedder(4))
    assert e.embed([]) == [] and not made
    assert e.embed(["a"]) == e.embed(["a"]) and len(made) == 1
