"""Changes to single documents: creation, replacement, patching, status changes. Steps of the driver, on local files."""

from __future__ import annotations

import datetime
import os
from pathlib import Path

from lodestone.functions import frontmatter as fm
from lodestone.functions.markdown import identity
from lodestone.operators.catalog import target_path
from lodestone.operators.patch import PatchError, envelope, unified
from lodestone.sources.config import DocumentType

BOM = "﻿"


class AuthoringError(ValueError):
    pass


def _documents(root: str, doc_type: str) -> list[Path]:
    return sorted((p for p in Path(root, "doc", doc_type).rglob("*.md") if p.is_file()), key=lambda p: p.parts)


def next_code(root: str, doc_type: str) -> int:
    """One above the highest code; a file of the type with a malformed name is an error."""
    codes = [0]
    for p in _documents(root, doc_type):
        if p.name.startswith(f"{doc_type}-"):
            parts = identity(p.stem)
            if parts is None or parts[0] != doc_type:
                raise AuthoringError(f"{p.name} isn't a document's name")
            codes.append(int(parts[1]))
    return max(codes) + 1


def create(root: str, kind: DocumentType, slug: str, title: str, folder: str | None = None, today: datetime.date | None = None) -> Path:
    """A new document with the type's template, or else the frontmatter that validation asks for."""
    code = next_code(root, kind.name)
    folder = folder or (kind.initial_status if kind.layout == "status" else None)
    path = Path(root, target_path(kind.name, kind.layout, code, slug, kind.code_width, folder))
    if identity(path.stem) is None:
        raise AuthoringError(f"{path.stem} isn't a document's name")
    if path.exists():
        raise AuthoringError(f"{path} is there already")
    template = Path(root, kind.template) if kind.template else None
    if template and template.is_file():
        text = template.read_text(encoding="utf-8")
    else:
        fields = {"id": path.stem, "type": kind.name, "code": f"{code:0{kind.code_width}d}", "slug": slug, "title": title, "description": title, "created": (today or datetime.date.today()).isoformat()}
        fields |= {"status": folder} if kind.layout == "status" else {"category": folder} if kind.layout == "category" else {}
        text = "---\n" + "".join(f"{k}: {v}\n" for k, v in fields.items()) + f"tags:\n  - {kind.name}\n---\n\n# {title}\n"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8", newline="")
    return path


def find(root: str, doc_type: str, code: int) -> Path:
    for p in _documents(root, doc_type):
        parts = identity(p.stem)
        if parts and parts[0] == doc_type and int(parts[1]) == code:
            return p
    raise AuthoringError(f"there is no {doc_type} {code}")


def _write(path: Path, text: str) -> None:
    """Replace a file's content at once."""
    staged = path.with_name(f".{path.name}.{os.getpid()}")
    staged.write_text(text, encoding="utf-8", newline="")
    os.replace(staged, path)


def replace(path: Path, text: str) -> None:
    """Overwrite a document; the new content must have the identity that its path has."""
    if text.startswith(BOM):
        raise AuthoringError("the content starts with a byte order mark")
    kind, code, slug = identity(path.stem) or (None, None, None)
    fields = fm.governed_fields(text) or {}
    for name, value in (("id", path.stem), ("type", kind), ("code", code), ("slug", slug)):
        if fields.get(name) != value:
            raise AuthoringError(f"{name} must be {value!r}")
    _write(path, text)


def apply_patch(path: Path, payload: str) -> str:
    """Patch a document in either format; its line ends stay."""
    with open(path, encoding="utf-8", newline="") as f:
        content = f.read()
    new = (envelope if "*** Begin Patch" in payload else unified)(content, payload, path.name)
    if new == content:
        raise PatchError("the patch changes nothing")
    _write(path, new)
    return new


def change_status(path: Path, kind: DocumentType, status: str) -> Path:
    """Write a new status and move the file to its folder; if the move fails the old content comes back."""
    if status not in kind.statuses:
        raise AuthoringError(f"{status!r} isn't a status of {kind.name}")
    with open(path, encoding="utf-8", newline="") as f:
        old = f.read()
    target = path.parent.parent / status / path.name
    if target.exists():
        raise AuthoringError(f"{target} is there already")
    _write(path, fm.with_scalar(old, "status", status))
    try:
        target.parent.mkdir(parents=True, exist_ok=True)
        os.rename(path, target)
    except OSError:
        _write(path, old)
        raise
    return target
