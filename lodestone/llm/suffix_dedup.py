"""Removal of repeated passages by a collection suffix order that is built column by column.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a document with a
smaller id. Strings are judged on the input, matches don't cross documents.

0. Whole copies are settled first: a text's digest is counted (``sketch``); of texts that may occur
   twice only the one of the smallest document goes on, the others lose all their bytes.
1. Every window of LENGTH bytes has a key: from the least hash of its K-grams. Equal windows have equal
   keys. One pass counts in how many documents each key occurs (``sketch``); windows whose key occurs
   once are settled.
2. Runs of windows with one key are segments, dealt by key with a hash of their bytes. A key with
   one string, wherever it occurs, is settled: the smallest document keeps it. Of the keys with several
   strings the segments are dealt again with their bytes; equal ones are one string with its
   occurrences, a key's strings form a collection. Of these only the stretches whose windows' hashes
   occur in several strings go on. Collections hold keys of like lengths, so that no round is for a few.
3. A collection's suffix order is built as for a multi-document Burrows-Wheeler transform: round j
   inserts each string's suffix of length j, whose place follows from the ranks of equal symbols in
   the transform so far; the common prefixes of new neighbours follow from minima over the prefixes
   so far. Transform, common prefixes and owners are sequential arrays that each round reads once
   from front to back and writes anew; a collection's size is bounded, so they stay in memory where
   a single machine would keep them in files.
4. In the final order, neighbours with common prefixes of LENGTH or more are equal windows; the
   smallest document among them keeps its bytes.

Defined cases: null and empty texts, and those under LENGTH bytes, lose nothing; a row with a null
id has no place in the order: it loses nothing and takes nothing from others; of rows that share an
id neither precedes the other; other columns are left out (``removed`` returns spans to join to
any table); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from lodestone.llm import sketch
from lodestone.llm.common import batch, drop, shared_dir, stored, sweep, tidied, utf8
from lodestone.llm.sketch import mixed

LENGTH, K = 50, 24
WINDOWS = LENGTH - K + 1
SLOT_BITS = 28
#: Spans that a task holds before it sends them.
SPANS = 1 << 19
#: Windows of a segment, bytes that are looked through at once, segments a task holds before sending, bytes of a collection.
LONGEST, CHUNK, FLUSH, COLLECTION = 64, 1 << 17, 1 << 17, 1 << 17
_BYTES = mixed(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULTIPLIER = 0xA0761D6478BD642F


class _Powers:
    """Powers of a multiplier and their inverses, as far as the longest text so far."""

    def __init__(self):
        self.tables = [np.ones(1, np.uint64)] * 2

    def __call__(self, n: int) -> list[np.ndarray]:
        if n > len(self.tables[0]):
            for k, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                self.tables[k] = np.multiply.accumulate(table)
        return self.tables


_powers = _Powers()


def prefix_sums(buffer: np.ndarray) -> np.ndarray:
    """Of the bytes' hashes times powers; the hash of any string of the buffer follows from two of them."""
    power, _ = _powers(max(len(buffer), CHUNK))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTES[buffer] * power[: len(buffer)], out=sums[1:])
    return sums


def string_hashes(sums: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 48-bit hash of each string start : start + size of a buffer; it tells strings of one (64-bit) key apart."""
    _, inverse = _powers(max(len(sums), CHUNK))
    return mixed((sums[start + size] - sums[start]) * inverse[start] + size.astype(np.uint64)) >> np.uint64(16)


def gram_hashes(sums: np.ndarray, n: int) -> np.ndarray:
    """A hash of each string of n bytes."""
    count = len(sums) - n
    _, inverse = _powers(max(len(sums), CHUNK))
    return (sums[n:] - sums[:count]) * inverse[:count]


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """For chunks of texts: buffer, its prefix sums, and of each run of windows with one key: text's index, its offset, start, windows, key."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size + len(texts[at]) <= CHUNK):
            part.append(texts[at])
            size += len(texts[at])
            at += 1
        first = at - len(part)
        if size < LENGTH:
            continue
        buffer = np.frombuffer(b"".join(part), np.uint8)
        sums = prefix_sums(buffer)
        h = gram_hashes(sums, K)
        step = 1
        while 2 * step <= WINDOWS:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        if WINDOWS > step:
            h = np.minimum(h[: step - WINDOWS], h[WINDOWS - step :])
        lengths = np.array([len(x) for x in part])
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(part)), lengths)[: len(h)]
        valid = np.arange(len(h)) + LENGTH <= ends[owner]
        edge = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])]
        starts = np.flatnonzero(edge)
        sizes = np.diff(starts, append=len(h))
        ok = valid[starts]
        starts, sizes = starts[ok], sizes[ok]
        # a minimum is a small number; keys are spread over all numbers
        yield buffer, sums, owner[starts] + first, (ends - lengths)[owner[starts]], starts, sizes, mixed(h[starts])


def _text_token(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


def _id_tokens(ids: np.ndarray) -> np.ndarray:
    return mixed(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x5851F42D4C957F2D))


def _tags(ids: np.ndarray, texts: list[bytes], whole: sketch.Levels) -> np.ndarray:
    """What tells texts of one id apart: 0 for ids that surely have one row, else the text's crc32 and a bit above."""
    maybe = (whole.of(_id_tokens(ids)) > 0).tolist() if len(ids) else []
    return np.array([zlib.crc32(t) | 1 << 32 if m else 0 for t, m in zip(texts, maybe)], np.int64)


def _texts_surveyed(docs: DataFrame) -> DataFrame:
    """Levels of whole texts and of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for b in batches:
            ids = _id_tokens(b.column(0).to_numpy())
            held += [ids, np.array([_text_token(t) for t in utf8(b.column(1)) if len(t) >= LENGTH], np.uint64)]
            n_held += 2 * len(ids)
            if n_held >= sketch.FLUSH // 16:
                yield sketch.sent(held)
                held, n_held = [], 0
        if n_held:
            yield sketch.sent(held)

    return sketch.counted(docs.select("doc_id", "text").mapInArrow(tidied(run), sketch.DDL))


def _perhaps_copied(docs: DataFrame, whole: sketch.Levels) -> DataFrame:
    """doc_id, tag, digest, text of those whose text may be another's too."""
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("digest", pa.binary()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(1))
            use = np.flatnonzero(_copied(texts, whole))
            some = [texts[k] for k in use]
            if some:
                ids = b.column(0).take(pa.array(use))
                yield batch(schema, [ids, _tags(ids.to_numpy(), some, whole), [hashlib.blake2b(t, digest_size=16).digest() for t in some], some])

    return docs.mapInArrow(tidied(run), "doc_id long, tag long, digest binary, text binary")


def _copied(texts: list[bytes], whole: sketch.Levels | None) -> np.ndarray:
    if whole is None or not texts:
        return np.zeros(len(texts), bool)
    return (whole.of(np.array([_text_token(t) for t in texts], np.uint64)) > 0) & np.array([len(t) >= LENGTH for t in texts])


def _surveyed(docs: DataFrame, firsts: DataFrame, whole: sketch.Levels) -> DataFrame:
    """Levels of keys, over the documents that aren't copies and the first of each group of copies."""

    def over(skip: sketch.Levels | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n_held = [], 0
            for b in batches:
                texts = utf8(b.column(0))
                for _, _, owner, _, _, _, key in runs([b"" if c else t for t, c in zip(texts, _copied(texts, skip))]):
                    order = np.argsort(key, kind="stable")  # owners ascend already
                    o, k = owner[order], key[order]
                    held.append(k[np.r_[True, (o[1:] != o[:-1]) | (k[1:] != k[:-1])]] if len(k) else k)
                    n_held += len(held[-1])
                    if n_held >= sketch.FLUSH:
                        yield sketch.sent(held)
                        held, n_held = [], 0
            if n_held:
                yield sketch.sent(held)

        return run

    rows = docs.select("text").mapInArrow(tidied(over(whole)), sketch.DDL).union(firsts.select("text").mapInArrow(tidied(over(None)), sketch.DDL))
    return sketch.counted(rows, SLOT_BITS, (2,))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] numbers), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


_DEALT = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])


def _narrow(x: np.ndarray) -> bytes:
    """Non-negative or any 64-bit integers with as many bytes each as the largest needs, byte by byte; first their number of bytes."""
    x = np.ascontiguousarray(x, "<u8") if x.dtype.kind == "u" else np.ascontiguousarray(x, "<i8").view("<u8")
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _wide(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = raw[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
    return out.view("<u8").reshape(n), at + 1 + n * width


def _dealt(docs: DataFrame, firsts: DataFrame, whole: sketch.Levels, levels: sketch.Levels, bits: int, bytes_too: bool) -> DataFrame:
    """Segments by key: rows of a bucket and the distinct strings of a stretch of input (their bytes or else their hashes) with their occurrences."""

    def rows(held: list[tuple], squeeze) -> pa.RecordBatch:
        key, windows, seg_hash, doc, tag, start = (np.concatenate([x[k] for x in held]) for k in range(6))
        order = np.lexsort((seg_hash, key))
        k, s = key[order], seg_hash[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
        unique = order[new]
        number = np.cumsum(new) - 1
        bucket = (key[unique] >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        occurrence_edges = np.searchsorted(number, edges)
        if bytes_too:
            text = np.concatenate([x[6] for x in held])
            sizes = windows.astype(np.int64) + LENGTH - 1
            offsets = np.cumsum(sizes) - sizes
        payloads = []
        for u0, u1, o0, o1 in zip(edges[:-1], edges[1:], occurrence_edges[:-1], occurrence_edges[1:]):
            u, o = unique[u0:u1], order[o0:o1]
            strings = text[_ragged(offsets[u], sizes[u])].tobytes() if bytes_too else _narrow(seg_hash[u])
            nth = np.diff(number[o0:o1], prepend=u0)
            parts = (*map(_narrow, (key[u], windows[u], nth, doc[o], tag[o], start[o])), strings)
            payloads.append(squeeze(b"".join((np.array([u1 - u0, o1 - o0], "<i8").tobytes(), *parts))))
        return batch(_DEALT, [bucket[edges[:-1]].astype(np.int32), payloads])

    def over(skip: sketch.Levels | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squeeze = zstandard.ZstdCompressor(level=1).compress
            held, n_held = [], 0
            for b in batches:
                ids, texts = b.column(0).to_numpy(), utf8(b.column(1))
                tags = _tags(ids, texts, whole)
                texts = [b"" if c else t for t, c in zip(texts, _copied(texts, skip))]
                for buffer, sums, owner, base, start, windows, key in runs(texts):
                    use = levels.of(key) > 0
                    if not use.any():
                        continue
                    owner, base, start, windows, key = (x[use] for x in (owner, base, start, windows, key))
                    pieces = -(-windows // LONGEST)
                    nth = _ragged(np.zeros(len(pieces), np.int64), pieces)
                    owner, base, start, key = (np.repeat(x, pieces) for x in (owner, base, start, key))
                    windows = np.minimum(np.repeat(windows, pieces) - nth * LONGEST, LONGEST)
                    start = start + nth * LONGEST
                    sizes = windows + LENGTH - 1
                    text = buffer[_ragged(start, sizes)] if bytes_too else None
                    hashes = string_hashes(sums, start, sizes)
                    held.append((key, windows.astype(np.uint8), hashes, ids[owner], tags[owner], (start - base).astype(np.int32), text))
                    n_held += len(key)
                    if n_held >= FLUSH:
                        yield rows(held, squeeze)
                        held, n_held = [], 0
            if held:
                yield rows(held, squeeze)

        return run

    both = ((docs, whole), (firsts, None))
    one, two = (x.select("doc_id", "text").mapInArrow(tidied(over(skip)), "bucket int, payload binary") for x, skip in both)
    return one.union(two)


def suffix_order(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All non-empty suffixes of a collection in order: owner, suffix length, common prefix with the one before (up to 255).

    ``text``: the strings one after another, without the byte 255.
    """
    m = len(lengths)
    ends = np.cumsum(lengths)
    symbol = lambda doc, j: np.where(lengths[doc] > j, text[np.maximum(ends[doc] - 1 - j, 0)] + np.uint8(1), np.uint8(0))
    owner = np.arange(m, dtype=np.int32)
    size = np.zeros(m, np.uint8)
    before = symbol(owner, 0)  # the transform: the symbol before each suffix, 0 at a string's start
    common = np.zeros(m, np.uint8)
    rank = np.arange(m)
    active = np.arange(m)
    for j in range(1, int(lengths.max(initial=0)) + 1):
        going = lengths[active] >= j
        active, rank = active[going], rank[going]
        order = np.argsort(before, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ended = int((before == 0).sum())
        at = place[rank]  # among the suffixes' extensions, ordered by their first symbol
        both = np.unique(np.concatenate([at, at + 1]))
        both = both[(both < len(order)) & (both > ended)]
        same = before[order[both]] == before[order[both - 1]]
        lo, hi = order[both - 1][same] + 1, order[both][same] + 1
        prefixes = np.zeros(len(both), np.uint8)
        if len(lo):
            down = np.argsort(-lo, kind="stable")
            pairs = np.empty(2 * len(lo), np.int64)
            pairs[::2], pairs[1::2] = lo[down], hi[down]
            least = np.empty(len(lo), np.uint8)
            least[down] = np.minimum.reduceat(np.append(common, np.uint8(255)), pairs)[::2]
            prefixes[same] = np.minimum(least, 254) + 1
        spot = m + at - ended
        fresh = np.zeros(len(owner) + len(active), bool)
        fresh[spot] = True
        by_spot = np.argsort(spot)

        def grown(old: np.ndarray, new: np.ndarray) -> np.ndarray:
            out = np.empty(len(fresh), old.dtype)
            out[fresh] = new
            out[~fresh] = old
            return out

        doc = active[by_spot].astype(np.int32)
        owner = grown(owner, doc)
        size = grown(size, np.full(len(doc), j, np.uint8))
        before = grown(before, symbol(doc, j))
        common = grown(common, np.zeros(len(doc), np.uint8))
        common[m + both - ended] = prefixes
        rank = spot
    return owner[m:], size[m:], common[m:]


def _least_documents(text: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window of a collection's strings (in order): the smallest document with an equal window."""
    windows = sizes - (LENGTH - 1)
    base = np.cumsum(windows) - windows
    out = np.repeat(least, windows)
    owner, size, common = suffix_order(text, sizes)
    whole = size >= LENGTH
    owner, start, common = owner[whole].astype(np.int64), None, common[whole]
    start = sizes[owner] - size[whole]
    if len(owner):
        heads = np.flatnonzero(np.r_[True, common[1:] < LENGTH])
        lowest = np.minimum.reduceat(least[owner], heads)
        out[base[owner] + start] = np.repeat(lowest, np.diff(heads, append=len(owner)))
    return out


class _Bucket:
    """The distinct strings of one bucket by key, and their occurrences."""

    def __init__(self, payloads: list[bytes], bytes_too: bool):
        parts, shift, expand = [], 0, zstandard.ZstdDecompressor().decompress
        for p in map(expand, payloads):
            n, o = np.frombuffer(p, "<i8", 2).tolist()
            at, row = 16, []
            for count in (n, n, o, o, o, o):
                values, at = _wide(p, at, count)
                row.append(values.view(np.int64) if row else values)
            row[2] = np.cumsum(row[2]) + shift
            row.append(np.frombuffer(p, "u1", int(row[1].sum()) + n * (LENGTH - 1), at) if bytes_too else _wide(p, at, n)[0])
            parts.append(row)
            shift += n
        key, windows, string, self.doc, self.tag, self.start, last = (np.concatenate([x[k] for x in parts]) for k in range(7))
        sizes = windows + LENGTH - 1
        offsets = np.cumsum(sizes) - sizes
        seg_hash = string_hashes(prefix_sums(last), offsets, sizes) if bytes_too else last
        order = np.lexsort((seg_hash, key))
        k, s = key[order], seg_hash[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        unique, self.string = order[new], number[string]
        self.key, self.windows = key[unique], windows[unique]
        if bytes_too:
            self.text, self.offsets = last, offsets[unique]
        self.least = np.full(len(unique), np.iinfo(np.int64).max)
        most = np.full(len(unique), np.iinfo(np.int64).min)
        np.minimum.at(self.least, self.string, self.doc)
        np.maximum.at(most, self.string, self.doc)
        heads = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]])
        counts = np.diff(heads, append=len(self.key))
        shared = np.minimum.reduceat(self.least, heads) < np.maximum.reduceat(most, heads)  # by several documents
        self.settled = np.repeat(shared & (counts == 1), counts)
        self.open = np.repeat(shared & (counts > 1), counts)

    def spans(self, lowest: np.ndarray, of: np.ndarray) -> np.ndarray:
        """doc, tag, from, to of what goes of the strings ``of``, by the least document of each window of all strings."""
        base = np.cumsum(self.windows) - self.windows
        use = of[self.string]
        string, doc, tag, start = (x[use] for x in (self.string, self.doc, self.tag, self.start))
        n = self.windows[string]
        flag = lowest[_ragged(base[string], n)] < np.repeat(doc, n)
        occurrence = np.repeat(np.arange(len(string)), n)
        nth = _ragged(np.zeros(len(n), np.int64), n)
        link = flag[1:] & flag[:-1] & (occurrence[1:] == occurrence[:-1])
        first, last = np.flatnonzero(flag & ~np.r_[False, link][: len(flag)]), np.flatnonzero(flag & ~np.r_[link, False][: len(flag)])
        o = occurrence[first]
        return np.column_stack([doc[o], tag[o], start[o] + nth[first], start[o] + nth[last] + LENGTH]).astype(np.int64)

    def settled_spans(self) -> np.ndarray:
        return self.spans(np.repeat(self.least, self.windows), self.settled)

    def open_spans(self) -> np.ndarray:
        base = np.cumsum(self.windows) - self.windows
        lowest = np.repeat(self.least, self.windows)
        strings, skip, windows = self._stretches()
        key, sizes = self.key[strings], windows + LENGTH - 1
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        if len(heads):  # keys by their longest string
            counts = np.diff(heads, append=len(key))
            by_size = np.argsort(np.maximum.reduceat(sizes, heads), kind="stable")
            order = _ragged(heads[by_size], counts[by_size])
            strings, skip, windows, sizes, key = (x[order] for x in (strings, skip, windows, sizes, key))
        at, total = 0, np.cumsum(sizes)
        while at < len(strings):  # whole keys, COLLECTION bytes at once unless one key has more
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + COLLECTION)))
            while to < len(strings) and key[to] == key[to - 1]:
                to += 1
            u, first = strings[at:to], skip[at:to]
            text = self.text[_ragged(self.offsets[u] + first, sizes[at:to])]
            lowest[_ragged(base[u] + first, windows[at:to])] = _least_documents(text, sizes[at:to], self.least[u])
            at = to
        return self.spans(lowest, self.open)

    def _stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the open strings those with a window whose hash another string of its key has: string, windows before the first such, windows to the last."""
        strings = np.flatnonzero(self.open)
        windows = self.windows[strings]
        nth = _ragged(np.zeros(len(windows), np.int64), windows)
        owner = np.repeat(np.arange(len(strings)), windows)
        at = self.offsets[strings][owner] + nth
        hashes = mixed(string_hashes(prefix_sums(self.text), at, np.full(len(at), LENGTH)) + self.key[strings][owner]) if len(at) else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        h, o = hashes[order], owner[order]
        heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        several = np.minimum.reduceat(o, heads) < np.maximum.reduceat(o, heads) if len(heads) else np.empty(0, bool)
        shared = np.empty(len(h), bool)
        shared[order] = np.repeat(several, np.diff(heads, append=len(h)))
        where = np.flatnonzero(shared)
        use, first = np.unique(owner[where], return_index=True)
        last = np.r_[first[1:], len(where)] - 1
        skip = nth[where[first]] if len(use) else np.empty(0, np.int64)
        return strings[use], skip, (nth[where[last]] - skip + 1) if len(use) else np.empty(0, np.int64)


def _parts(found: list[np.ndarray], bits: int) -> tuple[list[int], list[bytes]]:
    """Spans dealt by document."""
    rows = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    if not len(rows):
        return [], []
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    part = (mixed(rows[:, 0].astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return part[edges[:-1]].tolist(), [squeeze(_packed(rows[a:b])) for a, b in zip(edges[:-1], edges[1:])]


def _packed(spans: np.ndarray) -> bytes:
    doc, tag, start, end = spans.T
    return b"".join((np.array([len(spans)], "<i8").tobytes(), *map(_narrow, (np.diff(doc, prepend=0), tag, start, end - start))))


def _unpacked(raw: bytes) -> np.ndarray:
    n, at, columns = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for _ in range(4):
        values, at = _wide(raw, at, n)
        columns.append(values.view(np.int64))
    return np.column_stack([np.cumsum(columns[0]), columns[1], columns[2], columns[2] + columns[3]])


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The payloads of each key of rows that are sorted by it."""
    held: list[bytes] = []
    last = None
    for b in batches:
        for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != last and held:
                yield last, held
                held = []
            last = k
            held.append(p)
    if held:
        yield last, held


def _settled(dealt: DataFrame, bits: int) -> DataFrame:
    """Spans of keys with one string (segment -1 - part), and levels of the keys with several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, several = [], []

        def held() -> Iterator[pa.RecordBatch]:
            parts, payloads = _parts(found, bits)
            n = len(parts)
            yield batch(sketch.SCHEMA, [[-1 - p for p in parts], payloads, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())])
            if (sent := sketch.sent(several)) is not None:
                yield sent

        for _, payloads in _by_key(batches):
            bucket = _Bucket(payloads, False)
            found.append(bucket.settled_spans())
            several.append(np.unique(bucket.key[bucket.open]))
            if sum(map(len, found)) + sum(map(len, several)) >= SPANS:
                yield from held()
                found, several = [], []
        yield from held()

    by_bucket = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return sketch.counted(by_bucket.mapInArrow(tidied(run), sketch.DDL), levels=(1, 2, 3))


def _searched(dealt: DataFrame, bits: int) -> DataFrame:
    """part, payload: spans of keys with several strings."""
    schema = pa.schema([("part", pa.int32()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []

        def held() -> pa.RecordBatch:
            parts, payloads = _parts(found, bits)
            return batch(schema, [pa.array(parts, pa.int32()), payloads])

        for _, payloads in _by_key(batches):
            found.append(_Bucket(payloads, True).open_spans())
            if sum(map(len, found)) >= SPANS:
                yield held()
                found = []
        yield held()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(run), "part int, payload binary")


def _gathered(parts: DataFrame) -> DataFrame:
    """doc_id, tag, spans (packed pairs of byte offsets): one row a document."""
    out = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("spans", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for _, payloads in _by_key(batches):
            rows = np.concatenate([_unpacked(expand(p)) for p in payloads])
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
            edges = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1), True])
            for at in range(0, len(edges) - 1, 10_000):
                a, z = edges[at : min(at + 10_000, len(edges) - 1)], edges[at + 1 : at + 10_001]
                yield batch(out, [rows[a, 0], rows[a, 1], [merged(rows[i:j, 2:]).tobytes() for i, j in zip(a, z)]])

    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(tidied(gather), "doc_id long, tag long, spans binary")


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of spans that are ordered by their starts."""
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.column_stack([spans[new, 0], reach[np.r_[new[1:], True]]])


def removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (of the text, where the id may have several rows), spans (packed 64-bit pairs: from, to), whole (all goes) for each document that loses bytes."""
    spark = df.sparkSession
    path = shared_dir(spark)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null")
    texts = stored(_texts_surveyed(docs), f"{path}/texts")
    whole = sketch.Levels(texts)
    copies = stored(_perhaps_copied(docs, whole), f"{path}/copies")
    least = stored(copies.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text")), f"{path}/firsts")
    sweep(spark)
    levels = sketch.Levels(stored(_surveyed(docs, least, whole), f"{path}/levels"), SLOT_BITS, one_bit=True)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits, part_bits = max(12, (16 * partitions).bit_length()), max(10, (4 * partitions).bit_length())
    sweep(spark)
    settled = stored(_settled(_dealt(docs, least, whole, levels, bits, False), part_bits), f"{path}/settled")
    sweep(spark)
    several = sketch.Levels(settled)
    searched = _searched(_dealt(docs, least, whole, several, bits, True), part_bits)
    found = _gathered(settled.where("segment < 0").select((-1 - F.col("segment")).alias("part"), "payload").union(searched))
    copied = copies.join(least.select("digest", F.col("doc_id").alias("least")), "digest").where("doc_id > least").select("doc_id", "tag").distinct()
    out = stored(found.withColumn("whole", F.lit(False)).union(copied.select("doc_id", "tag", F.lit(None).cast("binary"), F.lit(True))), f"{path}/removed")
    for x in (whole, levels, several):
        x.done()
    drop(spark, *(f"{path}/{x}" for x in ("texts", "copies", "firsts", "levels", "settled")))
    sweep(spark)
    return out


def _finished(df: DataFrame, id_col: str, text_col: str, then, schema: StructType) -> DataFrame:
    """``then`` (of batches, see ``texts_of``) over all rows of df.

    Only rows that may lose bytes move, and those have their text compressed in a column __packed.
    """
    spans = removed(df, id_col, text_col)
    here, rest = sketch.parted(df, id_col, spans.select("doc_id"), text_col, then, schema)
    # texts of one id are told apart by their tags
    there = spans.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("tag", "spans", "whole")).alias("__by_tag"))
    joined = here.withColumn("__id", F.col(f"`{id_col}`").cast("long")).join(there, "__id", "left").drop("__id")
    return joined.mapInArrow(tidied(lambda batches: map(then, batches)), schema).union(rest)


def texts_of(b: pa.RecordBatch, text_col: str) -> list[tuple[bytes, bytes | None, bool]]:
    """Text, spans (packed) and whether all goes, of rows of df with __packed and perhaps __by_tag."""
    out, expand = [], zstandard.ZstdDecompressor().decompress
    tags = b.column("__by_tag").to_pylist() if "__by_tag" in b.schema.names else [None] * b.num_rows
    for text, packed, by_tag in zip(b.column(text_col).to_pylist(), b.column("__packed").to_pylist(), tags):
        if packed is None:
            out.append(((text or "").encode("utf-8", "surrogatepass"), None, False))
            continue
        raw = expand(packed)
        tags = (0, zlib.crc32(raw) | 1 << 32)
        mine = next((x for x in by_tag or () if x["tag"] in tags), None)
        out.append((raw, mine and mine["spans"], bool(mine and mine["whole"])))
    return out


def kept(text: bytes, spans: bytes | None, whole: bool | None = False) -> tuple[bytes, int, int]:
    """What stays of a text, bytes removed, maximal removed runs."""
    if whole:
        return b"", len(text), 1
    if not spans:
        return text, 0, 0
    pairs = np.frombuffer(spans, np.int64).reshape(-1, 2).tolist()
    out, at = [], 0
    for a, b in pairs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]), sum(b - a for a, b in pairs), len(pairs)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes), kept_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def then(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b, "text")
        rest = [kept(*x) for x in texts]
        return batch(schema, [b.column("doc_id"), [len(x[0]) for x in texts], [r[1] for r in rest], [r[2] for r in rest], [r[0] for r in rest], [hashlib.sha256(r[0]).hexdigest() for r in rest]])

    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return _finished(docs, "doc_id", "text", then, from_arrow_schema(schema))


def shortened(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """df with what stays of its texts; size_col, if named, gets their new sizes in characters. A character that lost some of its bytes goes whole."""
    names = df.columns

    def then(b: pa.RecordBatch) -> pa.RecordBatch:
        columns = [b.column(c) for c in names]
        k = names.index(text_col)
        null = [t is None and p is None for t, p in zip(columns[k].to_pylist(), b.column("__packed").to_pylist())]
        texts = [None if x else kept(*t)[0].decode("utf-8", "ignore") for x, t in zip(null, texts_of(b, text_col))]
        columns[k] = pa.array(texts, columns[k].type)
        if size_col:
            at = names.index(size_col)
            columns[at] = pa.array([None if t is None else len(t) for t in texts], columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return _finished(df, id_col, text_col, then, df.schema)
