"""Frontmatter: the grammars that extraction, validation and prompt reading each have."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import yaml


class _Loader(yaml.SafeLoader):
    """YAML with JSON's scalars: yes, no, on, off and dates stay strings."""


class _Quick(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """The same by libyaml, where it is installed."""


for _kind in (_Loader, _Quick):
    _kind.yaml_implicit_resolvers = {
        k: [(tag, rx) for tag, rx in v if tag not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool", "tag:yaml.org,2002:int")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    _kind.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    # a code such as 00031 is a text, not an octal number
    _kind.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^(?:[-+]?(?:0|[1-9][0-9]*)|0x[0-9a-fA-F]+)$"), list("-+0123456789"))
    _kind.add_multi_constructor("!", lambda loader, suffix, node: loader.construct_mapping(node, True) if isinstance(node, yaml.MappingNode) else loader.construct_sequence(node, True) if isinstance(node, yaml.SequenceNode) else node.value)
#: What libyaml may read otherwise than the other loader, and what may be nested so deep that only the other one notices.
_ODD = re.compile(r"[^\n\r -~]|[\[{?&*%!|>]|^ {64}|^(?:- ){8}", re.M)


def _yaml(block: str):
    """A block's value; libyaml reads plain ones, and what it refuses the other loader judges, whose errors are reported."""
    if not _ODD.search(block):
        try:
            return yaml.load(block, _Quick)  # noqa: S506 - a safe loader
        except yaml.YAMLError:
            pass
    return yaml.load(block, _Loader)  # noqa: S506 - a safe loader


#: Opening line to closing line and format.
FENCES = {"---": ("---", "yaml"), "---yaml": ("---", "yaml"), "---yml": ("---", "yaml"), "---json": ("---", "json"), "---toml": ("---", "toml"), "+++": ("+++", "toml")}


@dataclass
class Frontmatter:
    format: str | None = None
    body_start: int = 0  # in UTF-8 bytes
    metadata: object = None
    error: str | None = None
    keys: list[str] = field(default_factory=list)


def _tree(x):
    """Numbers as strings, only string keys, anything else as it is."""
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, (list, tuple, set)):
        return [_tree(v) for v in x]
    if isinstance(x, dict):
        return {k: _tree(v) for k, v in x.items() if isinstance(k, str)}
    return str(x)


def _toml_value(raw: str):
    raw = raw.strip()
    if raw in ("true", "false"):
        return raw == "true"
    if len(raw) >= 2 and raw[0] == raw[-1] == '"':
        return raw[1:-1]
    if raw.startswith("[") and raw.endswith("]"):
        return [_toml_value(x) for x in raw[1:-1].split(",") if x.strip()]
    return raw


def _toml(block: str) -> dict:
    """A subset: one ``key = value`` a line; booleans, quoted strings, flat lists, else the raw text."""
    out = {}
    for line in block.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, eq, value = line.partition("=")
        if not eq:
            raise ValueError(f"no value in {line!r}")
        out[key.strip()] = _toml_value(value)
    return out


def parse(source: str) -> Frontmatter:
    """The frontmatter that a source opens with, if any."""
    first, newline, rest = source.partition("\n")
    opener = first.rstrip("\r")
    if not newline or opener not in FENCES:
        return Frontmatter()
    closer, kind = FENCES[opener]
    at = 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", rest):
        if line.rstrip("\r\n") == closer:
            break
        at += len(line)
    else:
        return Frontmatter(kind, error="unclosed")
    block = rest[:at]
    body_start = len((first + newline + rest[: at + len(line)]).encode())
    try:
        metadata = _toml(block) if kind == "toml" else _tree(_yaml(block))
    except (yaml.YAMLError, ValueError) as e:
        return Frontmatter(kind, error=str(e).splitlines()[0])
    return Frontmatter(kind, body_start, metadata)


def filterable(metadata: object) -> dict[str, list[str]]:
    """Scalars and flat lists of a metadata tree as lists of strings; maps, nulls and lists with others in them are left out."""
    scalar = lambda v: ("true" if v else "false") if isinstance(v, bool) else v if isinstance(v, str) else None
    out = {}
    for k, v in metadata.items() if isinstance(metadata, dict) else ():
        values = [scalar(x) for x in v] if isinstance(v, list) else [scalar(v)]
        if values and None not in values:
            out[k] = values
    return out


def to_json(metadata: object) -> str | None:
    return None if metadata is None else json.dumps(metadata, ensure_ascii=False, separators=(",", ":"))


def _unquoted(v: str) -> str:
    v = v.strip()
    return v[1:-1] if len(v) > 1 and v.startswith('"') and v.endswith('"') else v


def governed_fields(content: str) -> dict[str, str] | None:
    """The validator's flat grammar: between the first two ``---`` anywhere; list items are joined by a comma.

    A key without value or items is dropped, but for the last one.
    """
    pieces = content.split("---", 2)
    if len(pieces) < 3:
        return None
    fields: dict[str, str] = {}
    pending: list | None = None  # key, text, items

    def close(last: bool) -> None:
        if pending and (last or pending[2] or pending[1].strip()):
            fields[pending[0]] = ", ".join(pending[2]) if pending[2] else _unquoted(pending[1])

    loose: list[str] = []
    for line in (x.strip() for x in pieces[1].splitlines()):
        if len(line) > 1 and line[0] == "-":
            (pending[2] if pending else loose).append(_unquoted(line[1:]))
        elif ":" in line:
            close(False)
            key, _, value = line.partition(":")
            left = pending[2] if pending and not (pending[2] or pending[1].strip()) else []
            pending = [key.strip(), value.strip(), [*loose, *left]]
            loose = []
        elif line and pending:
            pending[1] += " " + line
    close(True)
    return fields


def without(text: str) -> str:
    """A text without the strict frontmatter at its start."""
    m = re.match(r"---\r?\n.*?\r?\n---\r?\n", text, re.S)
    return text[m.end() :] if m else text


def scalar(text: str, key: str) -> str | None:
    """One scalar of a text's frontmatter."""
    head = text[: len(text) - len(without(text))]
    m = re.search(rf"(?m)^{re.escape(key)}:[ \t]*(.*?)[ \t]*\r?$", head)
    return m and m[1].strip("\"'")


def with_scalar(text: str, key: str, value: str) -> str:
    """The text with one scalar of its frontmatter replaced; unchanged without that key."""
    head = text[: len(text) - len(without(text))]
    new, n = re.subn(rf"(?m)^({re.escape(key)}:[ \t]*).*?(\r?)$", lambda m: f"{m[1]}{value}{m[2]}", head, count=1)
    return new + text[len(head) :] if n else text
