"""Small configuration tables from YAML: document types, package manifests, language rules, dashboards."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import yaml

KEBAB = re.compile(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*\Z")


class ConfigError(ValueError):
    pass


@dataclass
class DocumentType:
    name: str
    layout: str = "directory"  # status, category or directory
    code_width: int = 5
    template: str = ""
    prompt: str = ""
    create_document_form: str = ""
    initial_status: str = ""
    statuses: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)


_FIELDS = {"layout", "code-width", "template", "prompt", "create-document-form", "initial-status", "statuses", "tags"}


def document_types(text: str) -> list[DocumentType]:
    data = yaml.safe_load(text) or {}
    out = []
    for name, spec in sorted((data.get("document-types") or {}).items()):
        spec = spec or {}
        if unknown := set(spec) - _FIELDS:
            raise ConfigError(f"{name}: unknown fields {sorted(unknown)}")
        if spec.get("layout", "directory") not in ("status", "category", "directory"):
            raise ConfigError(f"{name}: unknown layout {spec['layout']!r}")
        out.append(DocumentType(name, **{k.replace("-", "_"): v for k, v in spec.items()}))
    return out


def bad_keys(tree, dynamic_below: frozenset[str] = frozenset(), _dynamic: bool = False) -> list[str]:
    """Keys of a YAML tree that aren't kebab-case, wherever they stand; children of ``dynamic_below`` are free."""
    out = []
    if isinstance(tree, dict):
        for k, v in tree.items():
            if not _dynamic and not (isinstance(k, str) and KEBAB.match(k)):
                out.append(str(k))
            out += bad_keys(v, dynamic_below, k in dynamic_below)
    elif isinstance(tree, list):
        for v in tree:
            out += bad_keys(v, dynamic_below)
    return out


def manifest(text: str | None) -> list[dict]:
    """Packages of a manifest, by name; a missing file is an empty one."""
    data = yaml.safe_load(text) if text else None
    out = []
    for name, spec in sorted(((data or {}).get("packages") or {}).items()):
        kind, url, tag = (spec or {}).get("type"), (spec or {}).get("url"), (spec or {}).get("tag")
        if kind not in ("git", "file"):
            raise ConfigError(f"{name}: type must be git or file")
        if not isinstance(url, str) or not url.strip():
            raise ConfigError(f"{name}: url is missing")
        if kind == "git" and not isinstance(tag, str):
            raise ConfigError(f"{name}: git packages need a tag")
        if isinstance(tag, str) and tag.startswith("branch:") and not tag[7:].strip():
            raise ConfigError(f"{name}: the branch has no name")
        out.append({"name": name, "type": kind, "url": url, "tag": tag})
    return out


def dump_manifest(packages: list[dict]) -> str:
    return yaml.safe_dump({"packages": {p["name"]: {k: p[k] for k in ("type", "url", "tag") if p.get(k)} for p in packages}}, sort_keys=True)


def add_package(packages: list[dict], name: str, kind: str, url: str, tag: str | None = None) -> list[dict]:
    if not KEBAB.match(name):
        raise ConfigError(f"{name!r} isn't kebab-case")
    if any(p["name"] == name for p in packages):
        raise ConfigError(f"{name} is there already")
    return manifest(dump_manifest([*packages, {"name": name, "type": kind, "url": url, "tag": tag}]))


def language_rules(text: str) -> dict[str, dict[str, str]]:
    return {str(k).lower(): v or {} for k, v in ((yaml.safe_load(text) or {}).get("languages") or {}).items()}


def normalized_languages(names: list[str]) -> list[str]:
    out = [n.strip().lower() for n in names]
    if "" in out or len(set(out)) < len(out):
        raise ConfigError("languages must be named once each")
    return out


def dashboard_sections(text: str, types: list[DocumentType]) -> list[dict]:
    """Sections of a dashboard, each with an error of its own where it is wrong."""
    layouts = {t.name: t.layout for t in types}
    out = []
    for s in (yaml.safe_load(text) or {}).get("sections") or []:
        kind = s.get("doc-type")
        error = None
        if kind not in layouts:
            error = f"unknown document type {kind!r}"
        elif s.get("statuses") and layouts[kind] != "status":
            error = f"{kind} has no statuses"
        elif s.get("categories") and layouts[kind] != "category":
            error = f"{kind} has no categories"
        out.append({"title": s.get("title"), "doc_type": kind, "statuses": s.get("statuses") or [], "categories": s.get("categories") or [], "error": error})
    return out


def block(text: str, required: tuple[str, ...] = ()) -> dict:
    """A YAML block of a document: its fields, inputs as texts, or an error."""
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        return {"error": str(e).splitlines()[0]}
    if not isinstance(data, dict):
        return {"error": "the block isn't a mapping"}
    if missing := [k for k in required if not data.get(k)]:
        return {"error": f"{missing[0]} is missing"}
    inputs = data.get("inputs") or {}
    return {**data, "inputs": {str(k): "" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for k, v in inputs.items()} if isinstance(inputs, dict) else {}, "error": None}


def resolved_profile(name: str, profiles: dict[str, list[str]], agents: dict[str, dict]) -> list[dict]:
    """A profile's agents with their definitions, unknown ones left out."""
    return [{"name": a, **agents[a], "available": bool(agents[a].get("command"))} for a in profiles.get(name, []) if a in agents]
