"""In how many documents a hashed token occurs, as two bits for each of 2**SLOT_BITS slots.

Each task sends 40 bits of each token it has seen (once for each document), dealt by their first 12
bits; the counts of the 40-bit values are exact, and every value that occurs twice or more raises
its slot's level. The levels have one size (a quarter of a byte a slot, or an eighth with one level)
whatever the input's, so they may be broadcast. They are used only to order tokens and to rule out those that occur once: a slot shared
by chance lets more through, never less.

Where the slots may be crowded, ``surveyed`` also tells of each document how many of its tokens others
have too: tokens go out with their document's place in its task's chunk, and the places of those that
recur come back. Those counts depend on the 40 bits alone, so they stay as good as exact whatever the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lodestone.llm.common import _releases, batch, shared_dir, stored, tidied, utf8

SEGMENT_BITS, REST_BITS = 12, 28
SEGMENTS = 1 << SEGMENT_BITS
SUB = 1 << (REST_BITS - 24)
SLOT_BITS = 26
#: Documents from which a level holds: 1 shared, 2 common, 3 frequent.
LEVELS = (2, 17, 257)
#: Tokens that a task holds before it sends them.
FLUSH = 1 << 20

SCHEMA = pa.schema([("segment", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
DDL = "segment int, payload binary, doc_id long, n long, digest binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: well-spread bits from any."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sent(tokens: list[np.ndarray]) -> pa.RecordBatch | None:
    """The rows that carry these tokens (uint64, distinct within each array)."""
    if not tokens or not sum(map(len, tokens)):
        return None
    t = np.sort(np.concatenate(tokens) >> np.uint64(64 - SEGMENT_BITS - REST_BITS))
    low = np.ascontiguousarray((t & np.uint64(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
    bounds = np.searchsorted(t, np.arange(SEGMENTS * SUB + 1, dtype=np.uint64) << np.uint64(24))
    counts = np.diff(bounds).astype("<u4").reshape(SEGMENTS, SUB)
    edges = bounds[::SUB]
    some = np.flatnonzero(np.diff(edges))
    none = pa.nulls(len(some), pa.int64())
    return batch(SCHEMA, [pa.array(some.astype(np.int32)), [counts[s].tobytes() + low[edges[s] : edges[s + 1]].tobytes() for s in some], none, none, pa.nulls(len(some), pa.binary())])


#: Documents of a chunk: a place has 16 bits.
PLACES = 1 << 16
_LOW = np.uint64((1 << REST_BITS) - 1)


def placed(tokens: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Segments with the tokens (uint64, distinct within each array) and the places of their arrays, by place: a word of
    28 bits and the step from the place before for each, then the steps of 15 and more."""
    t = np.concatenate(tokens) >> np.uint64(64 - SEGMENT_BITS - REST_BITS)
    place = np.repeat(np.arange(len(tokens), dtype=np.uint64), [len(x) for x in tokens])
    x = np.sort(t >> np.uint64(REST_BITS) << np.uint64(52) | place << np.uint64(REST_BITS) | t & _LOW)
    edges = np.append(np.searchsorted(x, np.arange(SEGMENTS, dtype=np.uint64) << np.uint64(52)), len(x))
    place = (x >> np.uint64(REST_BITS) & np.uint64(PLACES - 1)).astype(np.int64)
    step = np.diff(place, prepend=0)
    starts = edges[:-1][np.diff(edges) > 0]
    step[starts] = place[starts]
    long = step >= 15
    words = ((x & _LOW) | np.minimum(step, 15).astype(np.uint64) << np.uint64(REST_BITS)).astype("<u4")
    before = np.append(0, np.cumsum(long))[edges]
    steps = step[long].astype("<u2")
    for s in np.flatnonzero(np.diff(edges)).tolist():
        a, b = edges[s], edges[s + 1]
        yield s, np.uint32(b - a).tobytes() + words[a:b].tobytes() + steps[before[s] : before[s + 1]].tobytes()


def _unplaced(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """28 bits of tokens, places."""
    m = int(np.frombuffer(payload, "<u4", 1)[0])
    words = np.frombuffer(payload, "<u4", m, 4)
    step = (words >> np.uint32(REST_BITS)).astype(np.int64)
    step[step == 15] = np.frombuffer(payload, "<u2", offset=4 + 4 * m)
    return words & np.uint32(_LOW), np.cumsum(step)


_SENT = pa.schema([("chunk", pa.int64()), ("segment", pa.int32()), ("payload", pa.binary()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
_SENT_DDL = "chunk long, segment int, payload binary, place int, doc_id long, n long, digest binary"
_SURVEYED = pa.schema([*SCHEMA, ("shared", pa.int64())])


def surveyed(docs: DataFrame, tokens_of, digest_of, counts: Levels | None = None, slot_bits: int | None = None) -> DataFrame:
    """Of docs (doc_id, text): rows as of ``counted``, those about documents (segment under 0) with n, digest and shared:
    how many tokens the set has, its digest (null if empty), and how many of its tokens other documents have too.

    tokens_of makes a function of a text's bytes that gives its tokens (uint64, distinct). Of documents with an id only
    those that may be among the ids ``counts`` count; of the others shared is 0.
    """
    slot_bits = slot_bits or SLOT_BITS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, n_held = tokens_of(), [], 0
        chunk = TaskContext.get().partitionId() << 32

        def flushed() -> pa.RecordBatch:
            some = list(placed(held))
            none = pa.nulls(len(some), pa.int64())
            return batch(_SENT, [[chunk] * len(some), [s for s, _ in some], [p for _, p in some], pa.nulls(len(some), pa.int32()), none, none, pa.nulls(len(some), pa.binary())])

        for b in batches:
            chunks, places, ns, digests = [], [], [], []
            ids = b.column(0)
            goes = may_be(counts, ids) | np.array(ids.is_null()) if counts else np.ones(b.num_rows, bool)
            for text, go in zip(utf8(b.column(1)), goes.tolist()):
                t = tokens(text)
                chunks.append(chunk)
                places.append(len(held))
                ns.append(len(t))
                digests.append(digest_of(t) if len(t) else None)
                held.append(t if go else t[:0])
                n_held += len(held[-1])
                if n_held >= FLUSH or len(held) == PLACES:
                    yield flushed()
                    held, n_held, chunk = [], 0, chunk + 1
            spread = [-1 - k % SEGMENTS for k in range(b.num_rows)]
            yield batch(_SENT, [chunks, spread, pa.nulls(b.num_rows, pa.binary()), places, ids, ns, digests])
        if n_held:
            yield flushed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: list[int] = []
        held: list[bytes] = []
        last = -1

        def done() -> pa.RecordBatch:
            parts = [_unplaced(p) for p in held]
            values, at, times = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True, return_counts=True)
            again = np.split(times[at] > 1, np.cumsum([len(v) for v, _ in parts])[:-1])
            back = [(c, place[x].astype("<u2").tobytes()) for c, (_, place), x in zip(chunks, parts, again) if x.any()]
            rows = [(-1 - last, last, _slots(values, times, slot_bits, LEVELS)), *((c, None, p) for c, p in back)]
            none = pa.nulls(len(rows), pa.int64())
            return batch(_SENT, [*map(list, zip(*rows)), pa.nulls(len(rows), pa.int32()), none, none, pa.nulls(len(rows), pa.binary())])

        for b in batches:
            segments = b.column(1).to_numpy()
            if (about := segments < 0).any():
                yield b.filter(pa.array(about))
            for c, s, p in zip(b.column(0).to_pylist(), segments.tolist(), b.column(2).to_pylist()):
                if s < 0:
                    continue
                if s != last and held:
                    yield done()
                    chunks, held = [], []
                last = s
                chunks.append(c)
                held.append(p)
        if held:
            yield done()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunk by chunk: places of tokens that recur, then the documents."""
        last, held, total = None, [], None
        for b in batches:
            out = []
            for c, segment, payload, place, *about in zip(*(x.to_pylist() for x in b.columns)):
                if c < 0:
                    out.append((segment, payload, None, None, None, None))
                    continue
                if c != last:
                    last, held, total = c, [], None
                if place is None:
                    held.append(payload)
                    continue
                if total is None:
                    total = np.bincount(np.frombuffer(b"".join(held), "<u2"), minlength=PLACES)
                out.append((-1, None, *about, int(total[place])))
            if out:
                yield batch(_SURVEYED, list(map(list, zip(*out))))

    counted = docs.mapInArrow(tidied(send), _SENT_DDL).repartition("segment").sortWithinPartitions("segment").mapInArrow(tidied(count), _SENT_DDL)
    back = counted.repartition("chunk").sortWithinPartitions("chunk", F.col("place").asc_nulls_first())
    return back.mapInArrow(tidied(gather), f"{DDL}, shared long")


def _levels(payloads: list[bytes], slot_bits: int, levels: tuple[int, ...]) -> bytes:
    parts = []
    for p in payloads:
        counts = np.frombuffer(p, "<u4", SUB)
        low = np.frombuffer(p, np.uint8, offset=4 * SUB).reshape(-1, 3).astype(np.uint32)
        parts.append(np.repeat(np.arange(SUB, dtype=np.uint32) << np.uint32(24), counts) | low[:, 0] | low[:, 1] << np.uint32(8) | low[:, 2] << np.uint32(16))
    return _slots(*np.unique(np.concatenate(parts), return_counts=True), slot_bits, levels)


def _slots(values: np.ndarray, times: np.ndarray, slot_bits: int, levels: tuple[int, ...]) -> bytes:
    slots = values >> np.uint32(REST_BITS - (slot_bits - SEGMENT_BITS))
    out = np.zeros(1 << (slot_bits - SEGMENT_BITS), np.uint8)
    for level, least in enumerate(levels, 1):
        out[slots[times >= least]] = level
    if len(levels) == 1:
        return np.packbits(out, bitorder="little").tobytes()
    out = out.reshape(-1, 4)
    return (out[:, 0] | out[:, 1] << 2 | out[:, 2] << 4 | out[:, 3] << 6).astype(np.uint8).tobytes()


def counted(rows: DataFrame, slot_bits: int | None = None, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Of rows of SCHEMA: one row with the levels of each segment met; rows about documents (segment under 0) pass."""
    slot_bits = slot_bits or SLOT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = -1

        def done() -> pa.RecordBatch:
            return batch(SCHEMA, [[last], [_levels(held, slot_bits, levels)], [None], [None], [None]])

        for b in batches:
            segments = b.column(0).to_numpy()
            if (about := segments < 0).any():
                yield b.filter(pa.array(about))
            for s, p in zip(segments.tolist(), b.column(1).to_pylist()):
                if s < 0:
                    continue
                if s != last and held:
                    yield done()
                    held = []
                last = s
                held.append(p)
        if held:
            yield done()

    return rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(tidied(run), DDL)


#: Levels that a Python worker has unpacked, until its task ends.
_unpacked: dict[int, np.ndarray] = {}
_releases.append(_unpacked.clear)


class Levels:
    """The levels of all segments, broadcast once, compressed."""

    def __init__(self, counted_rows: DataFrame, slot_bits: int | None = None, one_bit: bool = False):
        """one_bit: the rows were counted with one level."""
        slot_bits = slot_bits or SLOT_BITS
        self.slot_bits, self.one_bit = slot_bits, one_bit
        packed = bytearray(1 << (slot_bits - (3 if one_bit else 2)))
        width = len(packed) // SEGMENTS
        for r in counted_rows.where("segment >= 0").select("segment", "payload").toLocalIterator():
            packed[r[0] * width : (r[0] + 1) * width] = r[1]
        self.key = uuid.uuid4().int
        self.packed = counted_rows.sparkSession.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(packed))

    def done(self) -> None:
        """No task will ask any more: workers and executors forget the levels."""
        self.packed.unpersist()

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if self.key not in _unpacked:
            _unpacked[self.key] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.packed.value), np.uint8)
        slots = (tokens >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        if self.one_bit:
            return (_unpacked[self.key][slots >> 3] >> (slots & 7).astype(np.uint8)) & 1
        return (_unpacked[self.key][slots >> 2] >> ((slots & 3) << 1).astype(np.uint8)) & 3


def _id_tokens(x: pa.Array) -> np.ndarray:
    return mixed(np.array(x.cast(pa.int64()).fill_null(0)).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def of_ids(ids: DataFrame) -> Levels:
    """Of one column of longs, for ``may_be``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield sent([_id_tokens(b.column(0))])

    distinct = ids.toDF("id").where(F.col("id").isNotNull()).distinct()
    return Levels(stored(counted(distinct.mapInArrow(tidied(send), DDL), levels=(1, 2, 3)), f"{shared_dir(ids.sparkSession)}/ids"))


def may_be(held: Levels, x: pa.Array) -> np.ndarray:
    """Whether each of x may be among the ids; null isn't."""
    return (held.of(_id_tokens(x)) > 0) & np.array(x.is_valid())


def parted(df: DataFrame, id_col: str, ids: DataFrame, packed_col: str | None = None, then=None, schema: StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose id may be among ids (one column of longs), and those whose id surely isn't.

    The former are few more than needed, so a join with them moves few rows. Null ids are among the
    latter. With packed_col, that text moves compressed: the former have it in a further column
    __packed (binary) and null in its place; the latter have null in __packed. With ``then``, a function
    of batches that gives ``schema``, the latter go through it in the same pass.
    """

    def split(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = b.filter(pa.array(may_be(held, b.column(id_col)) == wanted))
                if packed_col:
                    k = b.schema.names.index(packed_col)
                    packed = pa.nulls(b.num_rows, pa.binary())
                    columns = list(b.columns)
                    if wanted:
                        squeeze = zstandard.ZstdCompressor(level=3).compress
                        packed = pa.array([None if t is None else squeeze(t.encode("utf-8", "surrogatepass")) for t in columns[k].to_pylist()], pa.binary())
                        columns[k] = pa.nulls(b.num_rows, columns[k].type)
                    b = pa.RecordBatch.from_arrays([*columns, packed], names=[*b.schema.names, "__packed"])
                yield then(b) if then and not wanted else b

        if then and not wanted:
            return df.mapInArrow(tidied(run), schema)
        return df.mapInArrow(tidied(run), StructType([*df.schema.fields, StructField("__packed", BinaryType())]) if packed_col else df.schema)

    held = of_ids(ids)
    return split(True), split(False)
