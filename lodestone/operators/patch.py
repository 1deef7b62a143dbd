"""Patches of one document: unified diffs and update-file envelopes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_NO_END = "\\ No newline at end of file"


class PatchError(ValueError):
    pass


def _unfenced(payload: str) -> str:
    m = re.fullmatch(r"\s*```[^\n]*\n(.*?)\n?```\s*", payload, re.S)
    return m[1] if m else payload


def newline_mode(content: str) -> str:
    """The line ends of a document, which must all be alike."""
    crlf = content.count("\r\n")
    if content.count("\r") > crlf:
        raise PatchError("bare carriage returns can't be patched")
    if crlf and content.count("\n") > crlf:
        raise PatchError("mixed line endings can't be patched")
    return "\r\n" if crlf else "\n"


def _lines(text: str) -> list[str]:
    return text.split("\n")[: -1 if text.endswith("\n") else None] if text else []


def unified(content: str, payload: str, name: str) -> str:
    """content after a unified diff of the file ``name``."""
    end = newline_mode(content)
    plain = content.replace("\r\n", "\n")
    rows = _unfenced(payload).splitlines()
    first = next((i for i, r in enumerate(rows) if r.startswith(("diff ", "--- "))), None)
    rows = rows[first:] if first is not None else rows
    named = {k: next((r[4:].split("\t")[0].strip() for r in rows if r.startswith(k + " ")), None) for k in ("---", "+++")}
    if None in named.values():
        raise PatchError("the patch names no files")
    old, new = (re.sub(r"^[ab]/", "", named[k]) for k in ("---", "+++"))
    if new == "/dev/null":
        raise PatchError("the patch would delete the document")
    if old == "/dev/null":
        raise PatchError("the patch would create a document")
    if old != new:
        raise PatchError(f"the patch would rename {old} to {new}")
    if old.rsplit("/", 1)[-1] != name:
        raise PatchError(f"the patch is for {old}, the document is {name}")
    document, out, at = _lines(plain), [], 0
    ends_open = not plain.endswith("\n")
    i = 0
    while i < len(rows):
        m = _HUNK.match(rows[i])
        i += 1
        if not m:
            continue
        before, after, last = [], [], ""
        want = (int(m[2] or 1), int(m[4] or 1))
        while i < len(rows) and not _HUNK.match(rows[i]) and rows[i][:1] in (" ", "-", "+", "\\", ""):
            r = rows[i] or " "
            if r == _NO_END:
                ends_open = last in " +" or ends_open and last != "-"
            elif r[0] in " -":
                before.append(r[1:])
            if r[0] in " +":
                after.append(r[1:])
            last = r[0]
            i += 1
        while (len(before), len(after)) != want and before and after and before[-1] == after[-1] == "":  # blank lines after the last hunk
            before.pop(), after.pop()
        if (len(before), len(after)) != want:
            raise PatchError(f"a hunk has {len(before)} and {len(after)} lines, its header says {want[0]} and {want[1]}")
        start = int(m[1]) - (1 if before else 0)
        if start < at or document[start : start + len(before)] != before:
            raise PatchError(f"the context at line {start + 1} differs")
        out += document[at:start] + after
        at = start + len(before)
    out += document[at:]
    text = "\n".join(out) + ("" if ends_open or not out else "\n")
    if text.startswith("﻿"):
        raise PatchError("the result starts with a byte order mark")
    return text.replace("\n", end)


def envelope(content: str, payload: str, name: str) -> str:
    """content after an update-file envelope; each hunk's old lines must be found once after the hunk before."""
    end = newline_mode(content)
    plain = content.replace("\r\n", "\n")
    rows = [r for r in _unfenced(payload).strip().splitlines()]
    if not rows or rows[0].strip() != "*** Begin Patch" or rows[-1].strip() != "*** End Patch":
        raise PatchError("the patch isn't between its begin and end marks")
    document, at, hunk, targets = _lines(plain), 0, None, []
    hunks: list[tuple[list[str], list[str]]] = []
    for r in rows[1:-1]:
        mark = r.strip()
        if m := re.match(r"\*\*\* (Add File|Delete File|Move to): ", mark):
            raise PatchError(f"{m[1]} isn't supported")
        if mark.startswith("*** Update File: "):
            targets.append(mark[17:])
            hunk = None
        elif mark.startswith("@@"):
            hunk = ([], [])
            hunks.append(hunk)
        elif r == _NO_END or not mark and hunk is None:
            continue
        elif hunk is None:
            raise PatchError("a hunk header is missing")
        elif r[:1] not in (" ", "-", "+") or not r:
            raise PatchError(f"a line starts with {r[:1]!r}")
        else:
            if r[:1] in (" ", "-"):
                hunk[0].append(r[1:])
            if r[:1] in (" ", "+"):
                hunk[1].append(r[1:])
    if len(targets) != 1 or targets[0].rsplit("/", 1)[-1] != name:
        raise PatchError(f"the patch is for {targets}, the document is {name}")
    if not hunks:
        raise PatchError("the patch has no hunks")
    out: list[str] = []
    for before, after in hunks:
        if not before:
            raise PatchError("a hunk has no context")
        places = [k for k in range(at, len(document) - len(before) + 1) if document[k : k + len(before)] == before]
        if len(places) != 1:
            raise PatchError("the context isn't there" if not places else f"the context is there {len(places)} times")
        out += document[at : places[0]] + after
        at = places[0] + len(before)
    out += document[at:]
    return ("\n".join(out) + ("\n" if plain.endswith("\n") and out else "")).replace("\n", end)


def patched(content: Column, payload: Column, name: Column) -> Column:
    """struct(content, error) of each row's patch, in either format."""

    @F.pandas_udf("content string, error string")
    def run(contents: pd.Series, payloads: pd.Series, names: pd.Series) -> pd.DataFrame:
        def one(c, p, n):
            try:
                return ((envelope if "*** Begin Patch" in p else unified)(c, p, n), None)
            except PatchError as e:
                return (None, str(e))

        return pd.DataFrame([one(*x) for x in zip(contents, payloads, names)], columns=["content", "error"])

    return run(content, payload, name)


def replacement_error(content: Column, identity: dict[str, Column], fields: Column) -> Column:
    """Why a replacement is refused: a byte order mark, or an identity that isn't the path's; null if it is fine."""
    out = F.when(content.startswith("﻿"), F.lit("the content starts with a byte order mark"))
    for k, v in identity.items():
        out = out.when(~F.try_element_at(fields, F.lit(k)).eqNullSafe(v), F.lit(f"{k} isn't the document's"))
    return out
