"""Byte-pair encoding and decoding with a merge queue over a doubly linked symbol list.

Defined cases: a null text is the empty text and gives no ids; empty texts give no ids and decode
to the empty text; equal texts, repeated rows and repeated ids are encoded independently; columns
other than the id and the text are left out, whatever their names; an empty table gives an empty
table. Texts of any length are encoded whole. Strings of added special tokens in a text become
those tokens, as the public library does it.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import _releases, batch, tidied

#: White space as Unicode's White_Space property has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The contractions that the vocabulary's pre-tokenizer splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WORD = regex.compile("|".join(CONTRACTIONS) + rf"|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Words, and runs of non-blank characters, that each Python worker keeps with their ids.
REMEMBERED = 3 << 18


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where printable, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def normalized(text: str) -> str:
    """NFC, then lower case character by character (a final sigma has no form of its own)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class Vocabulary:
    """A BPE vocabulary file in the tokenizers library's JSON format, with end-of-word marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in ids.items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
        self.inner = [ids[s] for s in byte_symbols()]
        self.last = [ids[s + end] for s in byte_symbols()]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merged(self, word: str) -> list[int]:
        """The ids of one word. Entries of the queue whose symbols have since changed are skipped."""
        raw = word.encode("utf-8")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        n, merges = len(symbols), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(m[0], i, m[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, whole, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = whole, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((whole, symbols[k])):
                    heapq.heappush(queue, (m[0], i, m[1], whole, symbols[k]))
            if (h := before[i]) >= 0 and (m := merges.get((symbols[h], whole))):
                heapq.heappush(queue, (m[0], h, m[1], symbols[h], whole))
        return [s for s in symbols if s >= 0]


class Remembered(dict):
    """Values made when first asked for. Of the last REMEMBERED at least half stay, those asked for of late."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.before: dict = {}

    def __missing__(self, key):
        if len(self) > REMEMBERED // 2:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.by_word = Remembered(self._word)
        self.by_chunk = Remembered(self._chunk)

    def _word(self, word: str) -> bytes:
        ids = self.vocabulary.merged(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        """Of a run of non-blank characters."""
        words = self.by_word
        if chunk.isalpha():
            return words[chunk]
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return words[chunk[:-1]] + words[chunk[-1]]
        return b"".join([words[w] for w in WORD.findall(chunk)])

    def words(self, text: str) -> bytes:
        text = normalized(text)
        if SEPARATORS.search(text):  # blank to str.split(), but not to the pre-tokenizer
            return b"".join([self.by_word[w] for w in WORD.findall(text)])
        return b"".join(map(self.by_chunk.__getitem__, text.split()))

    def encode(self, text: str) -> bytes:
        v = self.vocabulary
        if v.special_at is None or "<" not in text or not v.special_at.search(text):
            return self.words(text)
        parts, at = [], 0
        for m in v.special_at.finditer(text):
            parts += [self.words(text[at : m.start()]), np.array([v.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*parts, self.words(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The vocabulary's strings, set apart by spaces: this vocabulary has no decoder of its own."""
        return " ".join(map(self.vocabulary.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, Encoder] = {}
_releases.append(_encoders.clear)


def encoder_of(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; what it remembers serves the worker's next tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary(path))
    return _encoders[path]


def _select(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for b in batches:
            yield batch(schema, [b.column(0), [encoder.encode(t) for t in b.column(1).to_pylist()]])

    return _select(df, id_col, text_col).mapInArrow(tidied(run, keep=True), "doc_id long, ids binary")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded: the text of packed ids (null: no ids)."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for b in batches:
            yield batch(schema, [b.column(0), [encoder.decode(x or b"") for x in b.column(1).to_pylist()]])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(tidied(run, keep=True), "doc_id long, decoded string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 64) -> DataFrame:
    """doc_id, ids, decoded: encode and decode in one pass over the texts, in batches of ``rows`` rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                ids = [encoder.encode(t) for t in b.column(1).to_pylist()]
                yield batch(schema, [b.column(0), ids, [encoder.decode(x) for x in ids]])

    return _select(df, id_col, text_col).mapInArrow(tidied(run, keep=True), "doc_id long, ids binary, decoded string")
