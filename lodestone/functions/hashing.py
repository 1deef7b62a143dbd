"""Stable chunk hashes: FNV-1a, 64 bits."""

from __future__ import annotations

#: Fixed values of the hash.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MASK = (1 << 64) - 1
SEPARATOR = 0xFF


def fnv1a(data: bytes, state: int = FNV_BASIS) -> int:
    for b in data:
        state = ((state ^ b) * FNV_PRIME) & MASK
    return state


def chunk_hash(package: str | None, stem: str, ordinal: int, heading_path: list[str], text: str) -> str:
    """Over package, stem, ordinal, headings and text with Unix line ends, each followed by a separator byte."""
    parts = (package or "workspace", stem, str(ordinal), "\x1f".join(heading_path), text.replace("\r\n", "\n").replace("\r", "\n"))
    return f"{fnv1a(b''.join(p.encode() + bytes([SEPARATOR]) for p in parts)):016x}"


def chunk_id(package: str | None, stem: str, ordinal: int, digest: str) -> str:
    return f"{package or 'workspace'}/{stem}/{ordinal:04d}/{digest}"
