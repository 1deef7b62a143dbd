"""Best-fit decreasing packing of tokenized documents into fixed windows.

The ids are those of the public tokenizers library, from ``bpe``'s encoder.

Defined cases: a null text is the empty text, whose only id is the end mark; equal texts and
repeated rows are packed independently, each row in pieces of its own; other columns are left out;
an empty table gives an empty table. Documents longer than a window are first cut into full
windows, and only their rest is placed with the shorter documents.

Work goes block by block: a block is all documents of an input partition, up to ``BLOCK`` ids.
Within a block best-fit decreasing is exact. Windows of a block that stay loose (its last ones, or all
of a small partition's) are opened again: the lengths of their pieces, without ids, are dealt to as
many tasks as have a block each, and packed a second time. So padding is small in whatever partitions
the input comes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import encoder_of
from lodestone.llm.common import batch, shared_dir, stored, tidied

#: Ids in a block: 16 MB as 32-bit numbers, 1024 windows of 4096.
BLOCK = 1 << 22
#: A window with more than this share of its capacity left is loose.
LOOSE = 1 / 256
#: Sequence ids of the second packing start here.
SECOND = 1 << 62


class Windows:
    """A segment tree over remaining capacities; leaf c counts the open windows with c ids left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used: list[int] = []

    def _add(self, left: int, n: int) -> None:
        at = left + self.leaves
        while at:
            self.tree[at] += n
            at >>= 1

    def _tightest(self, length: int) -> int:
        """The least capacity of length or more with an open window, or -1."""
        at = length + self.leaves
        if self.tree[at]:
            return length
        while at > 1 and (at & 1 or not self.tree[at + 1]):
            at >>= 1
        if at <= 1:
            return -1
        at += 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.leaves

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for a piece; pieces come in order of decreasing length."""
        left = self._tightest(length)
        if left < 0:
            window, left = len(self.used), self.capacity
            self.used.append(0)
        else:
            window = self.open[left].pop()
            self._add(left, -1)
        offset = self.used[window]
        self.used[window] += length
        if left > length:
            self.open[left - length].append(window)
            self._add(left - length, 1)
        return window, offset


def pack_lengths(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document's index, start, length, window, offset) of every piece."""
    windows, placed, rest = Windows(capacity), [], []
    for k, n in enumerate(lengths):
        full = n // capacity * capacity
        for start in range(0, full, capacity):
            placed.append((k, start, capacity, *windows.place(capacity)))
        if n > full:
            rest.append((n - full, k, full))
    for n, k, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        placed.append((k, start, n, *windows.place(n)))
    return placed


PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _first(docs: DataFrame, path: str, end_id: int, capacity: int, keep_ids: bool) -> DataFrame:
    """Pieces by block; those of loose windows have no sequence yet."""
    end = np.array([end_id], "<u4").tobytes()

    def packed(doc_ids: list[int | None], coded: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = [len(ids) // 4 for ids in coded]
        owner, start, length, window, offset = np.array(pack_lengths(lengths, capacity), np.int64).T
        filled = np.bincount(window, weights=length).astype(np.int64)
        loose = (capacity - filled > capacity * LOOSE)[window]
        parts = [coded[k][4 * a : 4 * (a + n)] for k, a, n in zip(owner.tolist(), start.tolist(), length.tolist())]
        ids = pa.array(parts, pa.binary()) if keep_ids else pa.nulls(len(parts), pa.binary())
        doc_ids = pa.array(doc_ids, pa.int64()).take(pa.array(owner))
        columns = [doc_ids, start, length, ids, list(map(zlib.crc32, parts)), np.array(lengths)[owner], pa.array(first + window, mask=loose), offset]
        return batch(PIECE, columns), first + len(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, doc_ids, coded, held = encoder_of(path), [], [], 0
        following = TaskContext.get().partitionId() << 36
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                doc_ids.append(doc_id)
                coded.append(ids)
                held += len(ids) // 4
                if held >= BLOCK:
                    out, following = packed(doc_ids, coded, following)
                    doc_ids, coded, held = [], [], 0
                    yield out
        if coded:
            yield packed(doc_ids, coded, following)[0]

    return docs.mapInArrow(tidied(run, keep=True), DDL)


def _second(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pieces of loose windows, packed by their lengths; ids, if kept, move along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches, PIECE).combine_chunks()
        following = SECOND + (TaskContext.get().partitionId() << 36)
        lengths = whole.column("length").to_numpy()
        windows, place = Windows(capacity), np.empty((len(lengths), 2), np.int64)
        for k in np.argsort(-lengths, kind="stable").tolist():
            place[k] = windows.place(int(lengths[k]))
        for at, name in ((6, "sequence_id"), (7, "offset")):
            whole = whole.set_column(at, name, pa.array(place[:, at - 6] + (following if at == 6 else 0)))
        yield from whole.to_batches()

    # a task for each block of ids, of a stored table: dealt alike when a task runs again
    total = pieces.agg(F.sum("length")).first()[0] or 0
    return pieces.repartition(max(1, round(total / BLOCK))).mapInArrow(tidied(run), DDL)


def pack(df: DataFrame, path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (packed, null unless keep_ids), ids_crc32, doc_tokens, sequence_id, offset."""
    columns = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # sequence ids come from the task's number, so each partition stays a task
    pieces = stored(_first(columns, path, end_id, capacity, keep_ids), f"{shared_dir(df.sparkSession)}/pieces", files=0)
    return pieces.where("sequence_id is not null").union(_second(pieces.where("sequence_id is null"), capacity))
