import json

import pytest

from lodestone import cli
from lodestone.plans.registry import Registry, registry


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda master: spark)
    w = ["--workspace", str(tmp_path), "--dimension", "16"]
    (tmp_path / "doc/spec").mkdir(parents=True)
    (tmp_path / ".lodestone").mkdir()
    (tmp_path / ".lodestone/document-types.yaml").write_text("document-types: {spec: {layout: directory}}")
    (tmp_path / "doc/spec/spec-00001-one.md").write_text("---\nid: x\n---\n# One\n\nNeedles in hay.\n")
    assert cli.main([*w, "init"]) == 0
    assert cli.main([*w, "update-database", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["reindexed"] == 1
    assert cli.main([*w, "search", "needles", "--json"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["returned"] == 1 and found["chunks"][0]["citation"] == "spec-00001-one > One"
    assert cli.main([*w, "validate"]) == 1 and "Missing required frontmatter field: title" in capsys.readouterr().out


def test_registry(spark):
    r, events = Registry(), []
    r.listeners += [lambda e: 1 / 0, events.append]
    r.register("double")(lambda x: 2 * x)
    assert r.run(spark, "double", 4) == 8 and [e.kind for e in events] == ["started", "completed"]
    with pytest.raises(TypeError):
        r.run(spark, "double", None)
    with pytest.raises(ValueError):
        r.register("double", int)
    assert events[-1].kind == "failed" and {"search", "validate", "reconcile"} <= set(registry.operations)
