"""N-gram Jaccard join by a token-group matrix.

A document's set: the distinct n-word shingles of its text (A-Z lower-cased, words are runs of
bytes outside 0x20 and 0x09-0x0D); with fewer words the whole sequence as one. Two documents link
when their sets' Jaccard similarity is the threshold or more. Sets are held as 64-bit hashes.

1. One pass over the texts counts in how many documents each shingle occurs and how many of a
   document's shingles others have (``sketch.surveyed``), one of equal texts, and digests each set;
   equal sets are one node from here on. A set links only if ceil(t n) of its shingles are shared.
2. A second pass over one document of each set that may link orders its shingles by rarity. Two
   linked sets share one of their first n - ceil(t n) + 1 shingles.
3. The others are sorted by min-hashes of their common shingles and cut into groups of similar sets
   (``GROUP`` sets, ``GROUP_TOKENS`` shingles: a bound on memory, not on partners, as every pair of
   groups is looked at). Each group's row of the matrix is the union of its sets' shingles. Links
   within a group and to the one before are sought at once; a stretch of groups whose sets are all
   connected has one label.
4. Groups whose unions share one of the first shingles meet, unless they have one label: their sets
   are in one component already. Bits that bound the overlap from above (``marks``) rule out most pairs
   before any set moves; the others move in bounded rounds. For each query set of one, the overlap with the other's union bounds
   its similarity to all members; only where the bound allows a link is the group opened and the
   similarities computed. A tile returns a spanning forest of its links.
5. Where a bucket of shingles has very many pairs of groups, only neighbours meet first; components
   of all links so far then label the groups anew, and the pairs that still differ meet.

Defined cases: null and empty texts have an empty set, linked with nothing; of rows with a null id
none is a component's smallest unless all are; rows that repeat an id or a text are rows like any
other; other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import sketch
from lodestone.llm.common import batch, beside, drop, shared_dir, stored, sweep, tidied, utf8
from lodestone.llm.components import Forest, components
from lodestone.llm.sketch import mixed

GROUP, GROUP_TOKENS = 64, 1 << 16
#: Tiles that Python holds at once, first shingles in a bucket, pairs of groups for each shingle of a bucket that meet at once.
TILES, BUCKET, AT_ONCE = 16, 1 << 16, 16
#: What moves for pairs of groups in a round, in multiples of all groups.
MOVED = 1
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = np.uint64(0xD6E8FEB86659FD93)
#: Values of letters at the first places of a word.
_NEAR = 64
_PLACED = mixed(_BYTES[None, :] ^ (np.arange(1, _NEAR + 1, dtype=np.uint64) * _PLACE)[:, None]).reshape(-1)


class Shingler:
    def __init__(self, words: int = 5):
        self.words = words
        self.weights = mixed(np.arange(11, 11 + words, dtype=np.uint64)) | np.uint64(1)

    def shingles(self, text: bytes) -> np.ndarray:
        """Distinct hashes (uint64, ascending) of a text's shingles."""
        a = np.frombuffer(text.lower(), np.uint8)
        solid = ~_BLANK[a]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        letters = a[solid]
        starts = np.flatnonzero(first[solid])
        m = len(starts)
        if not m:
            return np.empty(0, np.uint64)
        sizes = np.diff(starts, append=len(letters))
        place = np.arange(len(letters)) - np.repeat(starts, sizes)
        # a word is the sum of independent values of its letters at their places
        if int(sizes.max()) <= _NEAR:
            values = _PLACED[(place << 8) | letters]
        else:
            values = mixed(_BYTES[letters] ^ ((place + 1).astype(np.uint64) * _PLACE))
        words = mixed(np.add.reduceat(values, starts))
        k = min(m, self.words)
        total = words[: m - k + 1] * self.weights[0]
        for j in range(1, k):
            total += words[j : m - k + 1 + j] * self.weights[j]
        return np.unique(mixed(total + np.uint64(k)))


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def digested(df: DataFrame, text_col: str = "text", words: int = 5) -> DataFrame:
    """df with the digest of its texts' sets in a further column __digest, null for empty sets."""
    schema = df.withColumn("__digest", F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            sets = (shingler.shingles(text) for text in utf8(b.column(b.schema.names.index(text_col))))
            digests = pa.array([_digest(t) if len(t) else None for t in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, digests], names=[*b.schema.names, "__digest"])

    return df.mapInArrow(tidied(run), schema)


def _open_sets(docs: DataFrame, wanted: sketch.Levels, levels: sketch.Levels, words: int, t: Fraction) -> DataFrame:
    """Sets that may link, of documents whose id is wanted or null: digest, n, prefix (how many of the shingles count as first), k1, k2, tokens (shared ones, rarest first)."""
    schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("prefix", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("tokens", pa.binary())])
    salts = mixed(np.array([101, 202], np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            rows = []
            ids = b.column(0)
            b = b.filter(pa.array(sketch.may_be(wanted, ids) | np.array(ids.is_null())))
            for text in utf8(b.column(1)):
                tokens = shingler.shingles(text)
                n = len(tokens)
                level = levels.of(tokens)
                prefix = n + int(-n * t // 1) + 1 - int((level == 0).sum())  # n - ceil(t n) + 1, less those that occur here only
                if not n or prefix <= 0:
                    continue
                shared = tokens[level > 0]
                order = np.argsort(level[level > 0], kind="stable")
                common = tokens[level == level.max()] if level.max() > 1 else shared
                keys = [int(mixed(common ^ s).min() >> np.uint64(1)) for s in salts]
                rows.append((_digest(tokens), n, min(prefix, len(shared)), *keys, shared[order].tobytes()))
            if rows:
                yield batch(schema, list(map(list, zip(*rows))))

    return docs.mapInArrow(tidied(run), "digest binary, n long, prefix long, k1 long, k2 long, tokens binary")


_GROUP_DDL = "gid binary, members binary, sizes binary, lengths binary, tokens binary, first binary, label binary, links binary, marks binary"
_GROUP = pa.schema([(c.split()[0], pa.binary()) for c in _GROUP_DDL.split(", ")])


def _grouped(sets: DataFrame, t: Fraction) -> DataFrame:
    """Groups of similar sets: members' digests, set sizes, shared shingles with their counts, union of the first ones.

    A set that comes more than once counts once. Also the links found so far (pairs of digests), and the label of the stretch of groups that they connect (null if
    some member isn't connected with the others), and the members' marks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held = 0
        before, label, last = None, None, None

        def group() -> pa.RecordBatch:
            nonlocal before, label
            tokens = [np.frombuffer(r[5], np.uint64) for r in held]
            first = np.unique(np.concatenate([x[: r[2]] for x, r in zip(tokens, held)]))
            members = [r[0] for r in held]
            now = (b"".join(members), np.array([r[1] for r in held]).tobytes(), np.array([len(x) for x in tokens]).tobytes(), b"".join(r[5] for r in held))
            links = tile_links(now, now, t) if len(held) > 1 else []
            forest = Forest()
            for a, b in links:
                forest.join(a, b)
            near = before is not None and before[1] == held[0][3]
            if near:
                links += (more := tile_links(before[0], now, t))
                for _, b in more if label else ():  # all of the group before are connected
                    forest.join(label, b)
            one = {forest.root(x) for x in members}
            if not (near and label and one == {forest.root(label)}):
                label = members[0] if len(one) == 1 else None
            before = now, held[0][3]
            row = (members[0], *now, first.tobytes(), label, b"".join(a + b for a, b in links), b"".join(marks(x) for x in tokens))
            return batch(_GROUP, [[x] for x in row])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] == last:
                    continue
                last = row[0]
                size = len(row[5]) // 8
                if held and (held[0][3] != row[3] or len(held) >= GROUP or n_held + size > GROUP_TOKENS):
                    yield group()
                    held, n_held = [], 0
                held.append(row)
                n_held += size
        if held:
            yield group()

    return sets.repartitionByRange("k1", "k2", "digest").sortWithinPartitions("k1", "k2", "digest").mapInArrow(tidied(run), _GROUP_DDL)


def _met(groups: DataFrame, t: Fraction, every: bool) -> DataFrame:
    """Pairs of groups (a: the one of fewer shingles, b) whose unions share a first shingle and whose sizes allow a link.

    groups: gid, sizes, first, weight, label. Groups of one label don't meet. Unless ``every``, buckets with very many
    pairs give neighbours only, and a row without a and b.
    """
    dealt_ddl = "bucket long, gid binary, least long, most long, weight long, label binary, tokens binary"
    sent = pa.schema([("bucket", pa.int64()), ("gid", pa.binary()), ("least", pa.int64()), ("most", pa.int64()), ("weight", pa.int64()), ("label", pa.binary()), ("tokens", pa.binary())])
    pairs = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    total = groups.agg(F.sum(F.octet_length("first").cast("long"))).first()[0] or 0
    bits = max(8, (total // 8 // BUCKET).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for gid, sizes, first, weight, label in zip(*(c.to_pylist() for c in b.columns)):
                sizes, first = np.frombuffer(sizes, np.int64), np.frombuffer(first, np.uint64)
                bucket = (first >> np.uint64(64 - bits)).astype(np.int64)
                edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                n = len(edges) - 1
                parts = [first[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])]
                yield batch(sent, [pa.array(bucket[edges[:-1]]), [gid] * n, [int(sizes.min())] * n, [int(sizes.max())] * n, [weight] * n, [label] * n, parts])

    def meet(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Of one bucket."""
        gids = [r[1] for r in rows]
        lo, hi = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        weights = [(r[4], r[1]) for r in rows]
        known: dict[bytes, int] = {}
        labels = np.array([-1 - k if r[5] is None else known.setdefault(r[5], len(known)) for k, r in enumerate(rows)])
        tokens = [np.frombuffer(r[6], np.uint64) for r in rows]
        value = np.concatenate(tokens)
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in tokens])
        order = np.lexsort((owner, labels[owner], value))
        value, owner = value[order], owner[order]
        starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        ends = np.r_[starts[1:], len(value)]
        several = labels[owner[starts]] != labels[owner[ends - 1]]
        lists, n_pairs = [], 0
        for s, e in zip(starts[several].tolist(), ends[several].tolist()):
            g = owner[s:e]
            after = np.searchsorted(labels[g], labels[g], side="right")  # the first of another label
            lists.append((g, after))
            n_pairs += int((len(g) - after).sum())
        some = not every and n_pairs > AT_ONCE * len(value)
        found, n_found, seen = [], 0, np.empty(0, np.int64)
        for g, after in lists:
            heads = np.unique(after)[:-1] if some else ()
            for i, rest in ((i - 1, g[i : i + 1]) for i in heads) if some else ((i, g[k:]) for i, k in enumerate(after)):
                a = g[i]
                rest = rest[(hi[rest] * t.denominator >= lo[a] * t.numerator) & (hi[a] * t.denominator >= lo[rest] * t.numerator)]
                found.append(np.minimum(a, rest) * len(gids) + np.maximum(a, rest))
                n_found += len(rest)
            if n_found > 1 << 20:
                seen = np.unique(np.concatenate([seen, *found]))
                found, n_found = [], 0
        seen = np.unique(np.concatenate([seen, *found]))
        if some:
            yield batch(pairs, [[None], [None]])
        for at in range(0, len(seen), 10_000):
            part = seen[at : at + 10_000]
            both = [sorted((weights[i], weights[j])) for i, j in zip(part // len(gids), part % len(gids))]
            yield batch(pairs, [[x[1] for x, _ in both], [y[1] for _, y in both]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][0] != row[0]:
                    yield from meet(held)
                    held = []
                held.append(row)
        if held:
            yield from meet(held)

    dealt = groups.select("gid", "sizes", "first", "weight", "label").mapInArrow(tidied(deal), dealt_ddl)
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(run), "a binary, b binary").distinct()


def tile_links(one: tuple, two: tuple, t: Fraction) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between the members of two groups (members, sizes, lengths, tokens)."""

    def parts(g):
        members = [g[0][k : k + 16] for k in range(0, len(g[0]), 16)]
        lengths = np.frombuffer(g[2], np.int64)
        return members, np.frombuffer(g[1], np.int64), np.repeat(np.arange(len(members)), lengths), np.frombuffer(g[3], np.uint64)

    m1, n1, o1, t1 = parts(one)
    m2, n2, o2, t2 = parts(two)
    union = np.unique(t2)
    at = np.minimum(np.searchsorted(union, t1), len(union) - 1)
    hit = union[at] == t1
    # |Q & S| p >= ... from |Q & S| / |Q | S| >= num / den:  (num + den) |Q & S| >= num (|Q| + |S|)
    num, den = t.numerator, t.denominator
    bound = np.bincount(o1[hit], minlength=len(m1))
    least = np.maximum(int(n2.min()), (n1 * num + den - 1) // den)
    opened = np.flatnonzero((num + den) * bound >= num * (n1 + least))
    if not len(opened):
        return []
    slot = np.full(len(m1), -1)
    slot[opened] = np.arange(len(opened))
    use = hit & (slot[o1] >= 0)
    columns, c1 = np.unique(at[use], return_inverse=True)
    a1 = np.zeros((len(opened), len(columns)), np.float32)
    a1[slot[o1[use]], c1] = 1
    at2 = np.minimum(np.searchsorted(union[columns], t2), len(columns) - 1)
    use2 = union[columns][at2] == t2
    a2 = np.zeros((len(m2), len(columns)), np.float32)
    a2[o2[use2], at2[use2]] = 1
    overlap = np.rint(a1 @ a2.T).astype(np.int64)
    rows, cols = np.nonzero((num + den) * overlap >= num * (n1[opened][:, None] + n2[None, :]))
    forest = Forest()
    return [(a, b) for a, b in ((m1[opened[r]], m2[c]) for r, c in zip(rows, cols)) if a != b and forest.join(a, b)]


def _bits(n: int) -> int:
    return max(64, 1 << (n - 1).bit_length())


def marks(tokens: np.ndarray) -> bytes:
    """As many bits as tokens, or up to twice: whether an odd number of tokens falls on each."""
    n = _bits(len(tokens))
    return np.packbits((np.bincount((tokens & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(bool), bitorder="little").tobytes()


def _rows_of_marks(lengths: np.ndarray, packed: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of bits: members and their marks, a row of 64-bit words each."""
    bits = np.array([_bits(n) for n in lengths.tolist()])
    at = np.r_[0, np.cumsum(bits // 8)]
    return {n: (own := np.flatnonzero(bits == n), np.stack([np.frombuffer(packed, "<u8", n // 64, at[k]) for k in own])) for n in set(bits.tolist())}


def may_link(one: tuple, two: tuple, t: Fraction) -> bool:
    """Whether marks allow a link between members of two groups (sizes, lengths, marks): an odd bit of the one that is
    even in the other is a token that only one of them has, so bits that differ bound the overlap from above."""
    (n1, s1), (n2, s2) = ([np.frombuffer(x, np.int64) for x in g[:2]] for g in (one, two))
    num, den = t.numerator, t.denominator
    for b1, (i, x) in _rows_of_marks(s1, one[2]).items():
        for b2, (j, y) in _rows_of_marks(s2, two[2]).items():
            sizes, shared = n1[i][:, None] + n2[j][None, :], s1[i][:, None] + s2[j][None, :]
            if not ((num + den) * 2 * np.minimum(s1[i][:, None], s2[j][None, :]) >= 2 * num * sizes).any():
                continue
            u, v = x, y
            while u.shape[1] != v.shape[1]:
                if u.shape[1] > v.shape[1]:
                    u = u[:, : u.shape[1] // 2] ^ u[:, u.shape[1] // 2 :]
                else:
                    v = v[:, : v.shape[1] // 2] ^ v[:, v.shape[1] // 2 :]
            for k in range(len(u)):
                differ = np.bitwise_count(u[k][None, :] ^ v).sum(axis=1, dtype=np.int64)
                if ((num + den) * (shared[k] - differ) >= 2 * num * sizes[k]).any():
                    return True
    return False


def _near(groups: DataFrame, pairs: DataFrame, t: Fraction) -> DataFrame:
    """The pairs of groups between which marks allow a link; marks have a sixtieth of the tokens' size."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    columns = ("sizes", "lengths", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns))
            if found := [(r[0], r[1]) for r in rows if may_link(r[2:5], r[5:8], t)]:
                yield batch(schema, list(map(list, zip(*found))))

    side = lambda s: groups.select(F.col("gid").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in columns))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{s}_{c}" for s in "ab" for c in columns))
    return both.mapInArrow(tidied(run), "a binary, b binary")


def _linked(groups: DataFrame, pairs: DataFrame, t: Fraction) -> DataFrame:
    """Links between the members of pairs of groups."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    columns = ("members", "sizes", "lengths", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = [c[k].as_py() for c in b.columns]
                if links := tile_links(tuple(row[:4]), tuple(row[4:]), t):
                    yield batch(schema, list(map(list, zip(*links))))

    side = lambda s: groups.select(F.col("gid").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in columns))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select(*(f"{s}_{c}" for s in "ab" for c in columns))
    return both.mapInArrow(tidied(run), "a binary, b binary")


def _found(groups: DataFrame, pairs: DataFrame, t: Fraction, path: str, name: str) -> DataFrame:
    """Links between the members of pairs of groups, in as many rounds as keep what moves for pairs within MOVED times the groups."""
    spark = groups.sparkSession
    near = stored(_near(groups, pairs, t), f"{path}/{name}-near")
    weights = groups.select(F.col("gid").alias("a"), F.octet_length("tokens").cast("long").alias("weight"))
    whole, moved = (df.agg(F.sum("weight")).first()[0] or 0 for df in (weights, near.join(weights, "a")))
    rounds = max(1, math.ceil(moved / (MOVED * max(1, whole))))
    out = None
    for k in range(rounds):
        part = near if rounds == 1 else near.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k)
        found = stored(_linked(groups, part, t), f"{path}/{name}-{k}", rows=TILES)
        out = found if out is None else out.union(found)
        if k + 1 < rounds:
            sweep(spark)
    return out


def _pieces(column: str, size: int) -> Column:
    """A row for each ``size`` bytes of a binary column that has some."""
    return F.explode(F.expr(f"transform(sequence(0, octet_length({column}) div {size} - 1), i -> substring({column}, cast(i * {size} + 1 as int), {size}))"))


def _links(groups: DataFrame, t: Fraction, path: str) -> DataFrame:
    """Links that connect what all links connect: those found with the groups, and those of pairs of groups."""
    pair = groups.where("octet_length(links) > 0").select(_pieces("links", 32).alias("l"))
    links = pair.select(F.expr("substring(l, 1, 16)").alias("a"), F.expr("substring(l, 17, 16)").alias("b"))
    small = groups.select("gid", "members", "sizes", "first", F.octet_length("tokens").cast("long").alias("weight"), "label")
    pairs = stored(_met(small, t, every=False), f"{path}/pairs")
    found = _found(groups, pairs.where("a is not null"), t, path, "found")
    links = links.union(found)
    if pairs.where("a is null").isEmpty():
        return links
    roots = components(links, f"{path}/first")
    member = small.select("gid", _pieces("members", 16).alias("node")).join(roots, "node", "left")
    member = member.groupBy("gid").agg(F.min(F.coalesce("root", "node")).alias("least"), F.max(F.coalesce("root", "node")).alias("most"))
    label = member.where("least = most").select("gid", F.col("least").alias("label"))
    rest = stored(_met(small.drop("label").join(label, "gid", "left"), t, every=True), f"{path}/rest")
    rest = rest.join(pairs.where("a is not null"), ["a", "b"], "left_anti")
    return links.union(_found(groups, rest, t, path, "found-rest"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: Fraction = Fraction(4, 5), nodes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    With ``nodes`` also digest (of the document's set, null if that is empty) and root, one digest of its component.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # of equal texts one is counted, so that only different ones make a shingle shared
    texts = docs.where("doc_id is not null").groupBy(F.xxhash64("text"), F.hash("text"), F.octet_length("text"))
    counts = sketch.of_ids(texts.agg(F.min("doc_id").alias("id")).select("id"))
    surveyed = stored(sketch.surveyed(docs, lambda: Shingler(words).shingles, _digest, counts), f"{path}/surveyed")
    counts.done()
    sweep(spark)
    # a set links only if others have at least that share of its shingles; of equal sets one is enough
    may = surveyed.where("segment < 0 and n > 0").where(F.col("shared") * threshold.denominator >= F.col("n") * threshold.numerator)
    levels, wanted = sketch.Levels(surveyed), sketch.of_ids(may.groupBy("digest").agg(F.min("doc_id").alias("id")).select("id"))
    sets = stored(_open_sets(docs, wanted, levels, words, threshold), f"{path}/sets")
    levels.done()
    wanted.done()
    sweep(spark)
    groups = stored(_grouped(sets, threshold), f"{path}/groups")
    drop(spark, f"{path}/sets")
    roots = components(_links(groups, threshold, f"{path}/linking"), path).withColumnRenamed("node", "digest")
    drop(spark, f"{path}/groups", f"{path}/linking")
    sweep(spark)
    every = surveyed.where("segment < 0").select("doc_id", F.col("n").alias("n_shingles"), "digest")
    some = every.where("digest is not null")
    # what is decided by set, then by component: copies don't meet, however many there are
    sets = some.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    sets = stored(sets.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest")), f"{path}/rooted")
    least = sets.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    decided = beside(sets.withColumnRenamed("n", "copies"), least, "root", sets.count())
    decided = stored(decided.select("digest", "root", "component_id", F.col("copies").alias("n")), f"{path}/decided")
    drop(spark, f"{path}/rooted")
    out = beside(some, decided, "digest", every.count()).select("doc_id", "n_shingles", "component_id", *(("digest", "root") if nodes else ()))
    empty = every.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "digest", F.col("digest").alias("root"))
    return out.union(empty.select(out.columns))
