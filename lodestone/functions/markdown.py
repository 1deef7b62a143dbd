"""Markdown: headings, links and heading-aware chunks of one document. Offsets are UTF-8 bytes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from lodestone.functions import frontmatter as fm
from lodestone.functions.hashing import chunk_hash, chunk_id

_ATX = re.compile(r"\s*(#{1,6}) (.*)\Z", re.S)
_DEFINITION = re.compile(r"\s*\[(?P<label>.*?)\]:\s*(?P<target>\S+)")
_WIKI = re.compile(r"\[\[(?P<target>.*?)\]\]")
_AUTO = re.compile(r"<(?P<target>(?:https?://|mailto:)[^>]*)>")
#: A label in brackets that isn't an image's, with what follows it.
_BRACKET = re.compile(r"(?<!!)\[(?P<label>[^\]]*)\](?:\((?P<inline>[^)]*)\)|\[(?P<ref>[^\]]*)\])?")
_STEM = re.compile(r"((?:(?!\d+-)[a-z0-9]+-)+)(\d+)((?:-[a-z0-9]+)+)\Z")


@dataclass(frozen=True)
class Config:
    target: int = 350
    maximum: int = 500
    overlap: int = 0

    def __post_init__(self):
        if not 0 < self.target <= self.maximum or not 0 <= self.overlap < self.maximum:
            raise ValueError(f"chunk sizes don't fit: {self}")


class OversizedBlock(ValueError):
    pass


def words(text: str) -> int:
    """Words between Unicode white space."""
    return len(re.findall(r"[^\t-\r \x85\xa0  -     　]+", text))


def heading(line: str) -> tuple[int, str] | None:
    m = _ATX.match(line)
    text = m and m[2].strip().rstrip("#").strip()
    return (len(m[1]), text) if text else None


def anchor(text: str) -> str:
    out: list[str] = []
    for c in text.lower():
        if c.isascii() and c.isalnum():
            out.append(c)
        elif (c.isspace() or c == "-") and out and out[-1] != "-":
            out.append("-")
    return "".join(out).strip("-")


def lines(body: str, start: int):
    """(offset, line without its end, offset past the line)."""
    at = start
    for raw in body.split("\n"):
        size = len(raw.encode())
        yield at, raw.removesuffix("\r"), at + len(raw.removesuffix("\r").encode())
        at += size + 1


def open_lines(body: str, start: int):
    """lines() outside fenced code; any line that starts with three backticks or tildes toggles it."""
    fenced = False
    for at, line, end in lines(body, start):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced:
            yield at, line, end


def headings(body: str, start: int) -> tuple[list[dict], list[dict]]:
    found, problems, stack, seen = [], [], [], set()
    for at, line, end in open_lines(body, start):
        if (h := heading(line)) is None:
            continue
        level, text = h
        name = anchor(text)
        if name in seen:
            problems.append({"kind": "duplicate_anchor", "message": f"duplicate heading anchor `{name}`", "start": at, "end": end})
        seen.add(name)
        stack = [x for x in stack if x[0] < level]  # levels on the stack ascend
        stack = [*stack, (level, text)]
        found.append({"level": level, "text": text, "anchor": name, "ordinal": len(found), "path": [t for _, t in stack], "start": at, "end": end})
    return found, problems


def _link(kind: str, raw: str, target: str, label: str | None, line: str, m: re.Match, at: int) -> dict:
    target, mark, section = target.partition("#")
    a = at + len(line[: m.start()].encode())
    return {"kind": kind, "raw": raw, "target": target, "label": label, "heading": section if mark else None, "start": a, "end": a + len(raw.encode())}


def links(body: str, start: int) -> tuple[list[dict], list[dict]]:
    definitions = {m["label"].strip().lower(): m["target"] for _, line, _ in lines(body, 0) if (m := _DEFINITION.match(line))}
    found, problems = [], []
    for at, line, _ in open_lines(body, start):
        if _DEFINITION.match(line):
            continue
        for m in _WIKI.finditer(line):
            target, bar, label = m["target"].partition("|")
            found.append(_link("Wikilink", m[0], target, label if bar else None, line, m, at))
        brackets = list(_BRACKET.finditer(line))
        found += [_link("Inline", m[0], m["inline"], m["label"], line, m, at) for m in brackets if m["inline"] is not None]
        found += [_link("Autolink", m[0], m["target"], None, line, m, at) for m in _AUTO.finditer(line)]
        for m in brackets:
            if m["ref"] is None:
                continue
            name = (m["ref"] or m["label"]).lower()
            if name in definitions:
                found.append(_link("Reference", m[0], definitions[name], m["label"], line, m, at))
            else:
                a = at + len(line[: m.start()].encode())
                problems.append({"kind": "unresolved_reference_link", "message": f"reference-style link `{name}` could not be resolved", "start": a, "end": a + len(m[0].encode())})
    return sorted(found, key=lambda x: x["start"]), problems


def identity(stem: str) -> tuple[str, str, str] | None:
    m = _STEM.match(stem)
    return (m[1][:-1], m[2], m[3][1:]) if m else None


def extract(source: str) -> dict:
    """Frontmatter, body, headings, links and diagnostics; status 'failed' where the frontmatter is malformed."""
    f = fm.parse(source)
    if f.error is not None:
        return {"status": "failed", "error_kind": "malformed_frontmatter", "error": f.error, "format": f.format}
    body = source.encode()[f.body_start :].decode()
    heads, one = headings(body, f.body_start)
    found, two = links(body, f.body_start)
    return {"status": "extracted", "format": f.format, "metadata": f.metadata, "body_start": f.body_start, "body": body, "headings": heads, "links": found, "diagnostics": one + two}


# --- chunks


@dataclass(frozen=True)
class Block:
    text: str
    splittable: bool = False


def sections(body: str, start: int, heads: list[dict]) -> list[tuple[list[str], str]]:
    """(heading path, text): what precedes the first heading, then each heading to the next of its level or above.

    A heading with only headings or blank lines before the next one has no section of its own.
    """
    raw = body.encode()
    marks = [h["start"] - start for h in heads] + [len(raw)]
    out = [([], raw[: marks[0]].decode())]
    for i, h in enumerate(heads):
        direct = raw[marks[i] : marks[i + 1]].decode().split("\n")[1:]
        if all(not x.strip() or heading(x.strip()) for x in direct):
            continue
        stop = next((marks[j] for j in range(i + 1, len(heads)) if heads[j]["level"] <= h["level"]), len(raw))
        out.append((h["path"], raw[marks[i] : stop].decode()))
    return [(path, text.strip()) for path, text in out if text.strip()]


_ITEM = re.compile(r"\s*(?:[-*+] |\d+[.)] (?=.))")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")


def _separator(line: str) -> bool:
    line = line.strip()
    return "|" in line and not line.replace("|", "").strip(" -:\t")


def blocks(text: str) -> list[Block]:
    """Fences, table rows (each with header and separator), list items, paragraphs."""
    rows = text.splitlines()
    is_table = lambda i: i + 1 < len(rows) and "|" in rows[i] and _separator(rows[i + 1])
    out, i = [], 0
    while i < len(rows):
        j = i + 1
        if not rows[i].strip():
            i = j
            continue
        if fence := _FENCE.match(rows[i]):
            close = re.compile(rf"\s*{re.escape(fence[1][0])}{{{len(fence[1])},}}")
            while j < len(rows) and not close.match(rows[j]):
                j += 1
            j = min(j + 1, len(rows))
            out.append(Block("\n".join(rows[i:j])))
        elif is_table(i):
            j = i + 2
            while j < len(rows) and "|" in rows[j]:
                out.append(Block("\n".join((rows[i], rows[i + 1], rows[j]))))
                j += 1
            if j == i + 2:
                out.append(Block("\n".join(rows[i:j])))
        elif _ITEM.match(rows[i]):
            while j < len(rows) and rows[j].strip() and not _ITEM.match(rows[j]):
                j += 1
            out.append(Block("\n".join(rows[i:j])))
        else:
            while j < len(rows) and rows[j].strip() and not (_FENCE.match(rows[j]) or _ITEM.match(rows[j]) or is_table(j)):
                j += 1
            out.append(Block("\n".join(rows[i:j]), True))
        i = j
    return out


def split(text: str, config: Config, count: Callable[[str], int] = words) -> list[str]:
    """A section in pieces of at most the maximum; its heading is repeated in each."""
    if count(text) <= config.maximum:
        return [text]
    head, _, body = text.partition("\n")
    if heading(head) is None:
        head, body = "", text
    if not body.strip():
        return [text]
    whole = lambda parts: "\n\n".join(x for x in (head, "\n\n".join(b.text for b in parts if b.text.strip())) if x)
    size = lambda parts: count(whole(parts))

    def too_long(line: list[str], w: str) -> bool:
        if count is words:  # adds up: no need to count the line anew for each word
            return words(head) + len(line) + 1 > config.maximum
        return size([Block(" ".join([*line, w]))]) > config.maximum

    def checked(b: Block) -> Block:
        if size([b]) > config.maximum:
            raise OversizedBlock(f"a block has {size([b])} tokens; {config.maximum} are allowed")
        return b

    fitting: list[Block] = []
    for b in blocks(body):
        if size([b]) <= config.maximum or not b.splittable:
            fitting.append(checked(b))
            continue
        line: list[str] = []
        for w in b.text.split():
            if line and too_long(line, w):
                fitting.append(Block(" ".join(line), True))
                line = []
            line.append(w)
            if len(line) == 1:
                checked(Block(w))
        fitting.append(Block(" ".join(line), True))

    out: list[str] = []
    current: list[Block] = []
    for b in fitting:
        together = size([*current, b])
        if current and not (together <= config.target or together <= config.maximum and size(current) < config.target):
            out.append(whole(current))
            kept: list[Block] = []
            for x in reversed(current):  # the longest tail within the overlap
                if not config.overlap or size([x, *kept]) > config.overlap:
                    break
                kept.insert(0, x)
            current = kept if kept and size([*kept, b]) <= config.maximum else []
        current.append(b)
    return [*out, whole(current)] if current else out


def chunk(package: str | None, stem: str, extracted: dict, config: Config = Config(), count: Callable[[str], int] = words) -> list[dict]:
    rows = [(path, piece) for path, text in sections(extracted["body"], extracted["body_start"], extracted["headings"]) for piece in split(text, config, count)]
    out = []
    for k, (path, text) in enumerate(rows):
        digest = chunk_hash(package, stem, k, path, text)
        out.append({"chunk_id": chunk_id(package, stem, k, digest), "chunk_hash": digest, "chunk_ordinal": k, "heading_path": path, "text": text, "token_count": count(text)})
    return out

