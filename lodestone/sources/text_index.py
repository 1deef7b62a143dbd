"""A text index of postings dealt by term: blocks with score bounds, segments, increments without a rewrite.

A segment holds, of a set of documents, ``postings`` in folders by the term's hash: blocks of at most BLOCK postings of one term
by key, each with its first and last key, its number and the pairs of tf and length that can score best; and ``forward``, each document's
terms, in folders by the key's hash. A query opens its terms' folders only. It reads the blocks' heads (a few columns), so
document frequencies are sums; then it takes the blocks of the best bounds for a first threshold, the k-th best exact score found
there, and reads of the other blocks only those that a better document may be in: a block is passed over when its bound and
the best bounds of the other terms' blocks that share keys with it don't reach the threshold; of terms that can't reach it together only the blocks
in whose range a candidate of the others lies. The bounds hold whatever the mean length becomes. The result is exact BM25 over all documents, filters included.

An increment is one more segment; replaced and deleted documents are named in it (``gone``, with how often each
term lost a document, from ``forward``), and readers leave their older postings out. When more than TIER segments are of a size, they
are merged into one; larger ones stay as they are.

The list of segments is a value (a list of dicts) that the caller stores, as a store's pointer does, or ``save`` and
``opened`` keep in a file. Words are runs of letters and digits, lower-cased. Keys are strings, one row a key in a segment; a null key
is left out, a null text has no words. ``others`` are string columns that a filter may use.
"""

from __future__ import annotations

import bisect
import heapq
import json
import math
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.retrieval import BM25_B, BM25_K1, LEXICAL_LIMIT

BLOCK, PARTS, TIER = 128, 64, 4
#: Blocks of each term that are read for the first threshold; blocks of a term whose heads the driver takes.
FIRST, HEADS = 2, 50_000
#: Documents whose other postings are looked up by key; where more may reach the threshold, blocks are chosen by ranges only.
CANDIDATES = 10_000
#: Words or postings that a task packs by term before it sends them.
HELD = 1 << 19
#: Postings of one term that a task brings in key order before it cuts them into blocks.
SORTED = 1 << 16
#: Postings in one packed row from which a term is frequent, and over how many groups it is dealt.
MANY, SALTS = 1024, 64


@dataclass
class Plan:
    """Of a query's terms: frequency, weight, blocks with their bounds; the bound of terms with too many blocks to list."""

    df: dict[str, int]
    idf: dict[str, float]
    blocks: list[dict]
    wide: dict[str, float]

    def first(self) -> list[dict]:
        """The blocks of the best bounds of each term."""
        return [b for t in self.df for b in heapq.nlargest(FIRST, (b for b in self.blocks if b["term"] == t), key=lambda b: b["bound"])]

    def reaching(self, threshold: float) -> tuple[list[dict], list[str]]:
        """The blocks, and the terms of unlisted blocks, in which a document may reach the threshold.

        A block's bound and the best bound of each other term among the blocks that share keys with it add up.
        """
        threshold *= 1 - 1e-12
        most = dict(self.wide)
        runs: dict[str, list[_Run]] = {}
        for t in self.df:
            for chain in _chains([b for b in self.blocks if b["term"] == t]):
                runs.setdefault(t, []).append(_Run(chain))
            if t in runs:
                most[t] = max(r.highest for r in runs[t])
        total = sum(most.values())
        self.runs, self.most = runs, most
        out = []
        for t, mine in runs.items():
            for b in (b for r in mine for b in r.blocks):
                if b["bound"] + total - most[t] < threshold:
                    continue
                reach = b["bound"] + sum(self.wide.values())
                reach += sum(max(r.within(b["first"], b["last"]) for r in others) for u, others in runs.items() if u != t)
                if reach >= threshold:
                    out.append(b)
        return out, [t for t in self.wide if total >= threshold]

    def spare(self, threshold: float) -> tuple[set[str], float]:
        """Terms that can't reach the threshold together, so that every document in question has another; their bounds' sum."""
        out, total = set(), 0.0
        for t in sorted(self.most, key=lambda t: (self.most[t], t)):
            if t in self.wide or total + self.most[t] >= threshold * (1 - 1e-12):
                break
            out.add(t)
            total += self.most[t]
        return out, total

    def holding(self, terms: set[str], keys: list[str]) -> list[dict]:
        """The blocks of these terms in whose range a key is."""
        keys = sorted(k.encode() for k in keys)
        return [b for t in terms for r in self.runs[t] for b, first, last in zip(r.blocks, r.firsts, r.lasts) if bisect.bisect_left(keys, first) < bisect.bisect_right(keys, last)]


def _chains(blocks: list[dict]) -> list[list[dict]]:
    """Blocks dealt to as few lists as can be in which none overlaps another."""
    out: list[list[dict]] = []
    free: list[tuple[bytes, int]] = []  # each list's last key
    for b in sorted(blocks, key=lambda b: b["first"].encode()):
        if free and free[0][0] < b["first"].encode():
            k = heapq.heapreplace(free, (b["last"].encode(), free[0][1]))[1]
            out[k].append(b)
        else:
            heapq.heappush(free, (b["last"].encode(), len(out)))
            out.append([b])
    return out


class _Run:
    """Blocks of a term that don't overlap, and the greatest bound of any range of them."""

    def __init__(self, blocks: list[dict]):
        self.blocks = sorted(blocks, key=lambda b: b["first"].encode())
        self.firsts, self.lasts = ([b[x].encode() for b in self.blocks] for x in ("first", "last"))
        self.levels = [[b["bound"] for b in self.blocks]]
        while (step := 1 << (len(self.levels) - 1)) < len(self.levels[-1]):
            self.levels.append([max(x, y) for x, y in zip(self.levels[-1], self.levels[-1][step:])])
        self.highest = max(self.levels[0])

    def within(self, first: str, last: str) -> float:
        a, z = bisect.bisect_left(self.lasts, first.encode()), bisect.bisect_right(self.firsts, last.encode())
        if a >= z:
            return 0.0
        k = (z - a).bit_length() - 1
        return max(self.levels[k][a], self.levels[k][z - (1 << k)])


def _by_key(lists: list[list]) -> list[list]:
    """Lists side by side in the order of the first; code points order as UTF-8 does."""
    keys = lists[0]
    if all(map(str.__le__, keys, keys[1:])):
        return lists
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return [[x[i] for i in order] for x in lists]


def tops(tfs: Sequence[int], lengths: Sequence[int]) -> list[int]:
    """Those (tf, length), one after another, that no other has more of the one and less of the other: the best score is one of theirs, whatever the mean."""
    least: dict[int, int] = {}  # of a tf
    for tf, length in zip(tfs, lengths):
        if tf not in least or length < least[tf]:
            least[tf] = length
    out: list[int] = []
    for tf in sorted(least, reverse=True):
        if not out or least[tf] < out[-1]:
            out += [tf, least[tf]]
    return out


class TextIndex:
    """Operations on an index at a path; ``segments`` is a list of {name, n, words, gone}."""

    def __init__(self, spark: SparkSession, path: str, others: Sequence[str] = (), parts: int = PARTS):
        self.spark, self.path, self.others, self.parts = spark, path.rstrip("/"), list(others), parts
        listed = "".join(f", `{c}_of` array<string>" for c in self.others)
        self._blocks = T._parse_datatype_string(f"term string, first string, last string, n int, tf int, length int, tops array<int>, keys array<string>, tfs array<int>, lengths array<int>{listed}, part int")
        self._forward = T._parse_datatype_string("key string, length int, terms array<string>, part int")
        self._gone = T._parse_datatype_string("key string, part int")
        self._lost = T._parse_datatype_string("term string, n long, part int")

    # --- reading a segment's tables

    def _part(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.parts)).cast("int")

    def _parts_of(self, values: Sequence[str]) -> list[int]:
        rows = self.spark.createDataFrame([(v,) for v in values], "v string")
        return sorted({r[0] for r in rows.select(self._part("v")).collect()})

    def _read(self, segments: list[dict], table: str, schema: T.StructType, parts: list[int] | None = None) -> DataFrame:
        """A table of all segments, with the segment's place in the list as ``at``; only some folders of it."""
        out = self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("at", T.IntegerType())]))
        for at, s in enumerate(segments):
            there = [p for p in s["folders"][table] if parts is None or p in parts]
            if there:
                base = f"{self.path}/{s['name']}/{table}"
                rows = self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/part={p}" for p in there))
                out = out.unionByName(rows.withColumn("at", F.lit(at)))
        return out

    def postings(self, segments: list[dict], parts: list[int] | None = None, where: Column | None = None, named=None) -> DataFrame:
        """at, term, key, tf, length, others of all living postings; only blocks that ``where`` and ``named`` keep are opened."""
        blocks = self._read(segments, "postings", self._blocks, parts)
        blocks = blocks.where(where) if where is not None else blocks
        blocks = named(blocks) if named else blocks
        zipped = F.explode(F.arrays_zip("keys", "tfs", "lengths", *(f"{c}_of" for c in self.others))).alias("x")
        rows = blocks.select("at", "term", zipped).select("at", "term", F.col("x.keys").alias("key"), F.col("x.tfs").alias("tf"), F.col("x.lengths").alias("length"), *(F.col(f"x.{c}_of").alias(c) for c in self.others))
        return self._living(segments, rows)

    def _living(self, segments: list[dict], rows: DataFrame) -> DataFrame:
        """Rows (at, key, ...) of documents that no later segment replaced or deleted."""
        if not any(s["gone"] for s in segments):
            return rows
        gone = self._read(segments, "gone", self._gone).groupBy("key").agg(F.max("at").alias("until"))
        return rows.join(gone, (rows["key"] == gone["key"]) & (rows["at"] < gone["until"]), "left_anti")

    # --- writing

    def added(self, segments: list[dict], docs: DataFrame, key: str, text: str, gone: DataFrame | None = None) -> list[dict]:
        """The list with one more segment: docs(key, text, others) come, the keys of gone(key) and those of docs lose what older segments have."""
        name = f"segment-{uuid.uuid4().hex}"
        words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), *self.others, words.alias("words"))
        new = {"name": name, "n": 0, "words": 0, "gone": 0, "lost_n": 0, "lost_words": 0}
        keys = self.spark.createDataFrame([], "key string")
        if not docs.isEmpty():  # otherwise a deletion
            self._write_postings(rows.mapInArrow(self._packed, self._rows), name)
            self._write(rows.select("key", F.size("words").alias("length"), F.array_distinct("words").alias("terms")), "forward", name, "key")
            forward = self.spark.read.schema(self._forward).parquet(f"{self.path}/{name}/forward")
            sums = forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
            new |= {"n": sums["n"], "words": sums["words"]}
            keys = forward.select("key")
        if segments:
            keys = keys if gone is None else keys.union(gone.select(F.col(gone.columns[0]).cast("string"))).distinct()
            old = self._living(segments, self._read(segments, "forward", self._forward, self._touched(keys)))
            dead = old.join(keys, "key", "left_semi")
            self._write(dead.select("key").distinct(), "gone", name, "key")
            self._write(dead.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "lost", name, "term")
            r = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
            new |= {"gone": r["n"], "lost_n": r["n"], "lost_words": r["words"]}
        new["folders"] = {t: self._folders(f"{name}/{t}") for t in ("postings", "forward", "gone", "lost")}
        out = self._merged([*segments, new])
        self._forget({new["name"]} - {s["name"] for s in out})
        return out

    def _forget(self, names: set[str]) -> None:
        for name in names:
            fs, path = self._file(name)
            fs.delete(path, True)

    def vacuum(self, gone: list[list[dict]], stay: list[list[dict]]) -> None:
        """Delete the segments that only the lists ``gone`` name; their readers must be done."""
        self._forget({s["name"] for of in gone for s in of} - {s["name"] for of in stay for s in of})

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self._part("key")).distinct().collect()]  # numbers of folders

    def _folders(self, table: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[5:]) for n in names if n.startswith("part="))

    def _write(self, rows: DataFrame, table: str, name: str, by: str) -> None:
        rows.withColumn("part", self._part(by)).hint("rebalance", "part").sortWithinPartitions("part", by).write.partitionBy("part").parquet(f"{self.path}/{name}/{table}")

    @property
    def _packed(self):
        """A function from documents(key, others, words) or postings(term, key, length, tf, others) to rows of one term with its postings of a task, by key."""
        others, most = self.others, HELD

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, list[list]] = {}  # of a term: keys, tfs, lengths, others
            n = 0

            def sent() -> pa.RecordBatch:
                of = [_by_key(x) for x in held.values()]
                columns = {"term": pa.array(list(held), pa.string()), "first": pa.array([x[0][0] for x in of], pa.string())}
                names = [("keys", pa.string()), ("tfs", pa.int32()), ("lengths", pa.int32()), *((f"{c}_of", pa.string()) for c in others)]
                return pa.RecordBatch.from_pydict(columns | {name: pa.array([x[i] for x in of], pa.list_(kind)) for i, (name, kind) in enumerate(names)})

            gathered: list[pa.RecordBatch] = []

            def counted() -> Iterator[pa.RecordBatch]:
                """The postings of the documents gathered, counted as arrays: no Python object for a word or posting."""
                docs = pa.Table.from_batches(gathered).combine_chunks()
                gathered.clear()
                docs = docs.take(pc.sort_indices(docs["key"]))  # of strings, by bytes
                words, keys = docs["words"].combine_chunks(), docs["key"].combine_chunks()
                lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = words.flatten().dictionary_encode()
                if not len(flat):
                    return
                codes = flat.indices.to_numpy().astype(np.int64)
                pairs, tfs = np.unique(codes * len(keys) + np.repeat(np.arange(len(keys)), lengths), return_counts=True)
                doc = pairs % len(keys)
                starts = np.searchsorted(pairs, np.arange(len(flat.dictionary) + 1) * len(keys)).astype(np.int32)
                lists = [keys.take(pa.array(doc)), pa.array(tfs.astype(np.int32)), pa.array(lengths[doc].astype(np.int32)), *(docs[c].combine_chunks().take(pa.array(doc)) for c in others)]
                columns = [flat.dictionary, lists[0].take(pa.array(starts[:-1])), *(pa.ListArray.from_arrays(pa.array(starts), x) for x in lists)]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "first", "keys", "tfs", "lengths", *(f"{c}_of" for c in others)])

            def add(t: str, *x) -> None:
                lists = held.get(t)
                if lists is None:
                    held[t] = [[v] for v in x]
                else:
                    for of, v in zip(lists, x):
                        of.append(v)

            for b in batches:
                if "words" in b.schema.names:
                    at = 0
                    ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column("words")), 0).to_numpy(zero_copy_only=False))
                    while at < b.num_rows:  # as many documents as have ``most`` words, one at least
                        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                        gathered.append(b.slice(at, stop - at))
                        n += int(ends[stop - 1] - (ends[at - 1] if at else 0))
                        at = stop
                        if n >= most:
                            yield from counted()
                            n = 0
                else:
                    for x in zip(*(b.column(c).to_pylist() for c in ("term", "key", "tf", "length", *others))):
                        add(*x)
                    n += b.num_rows
                    if n > most:
                        yield sent()
                        held.clear()
                        n = 0
            if gathered:
                yield from counted()
            if held:
                yield sent()

        return run

    @property
    def _rows(self) -> str:
        return "term string, first string, keys array<string>, tfs array<int>, lengths array<int>" + "".join(f", `{c}_of` array<string>" for c in self.others)

    def _write_postings(self, rows: DataFrame, name: str) -> None:
        """Cut packed rows into blocks; a task holds SORTED postings of one term at most, and its share of a frequent term."""
        others = self.others
        schema = T.StructType([f for f in self._blocks.fields if f.name != "part"] + [T.StructField("part", T.IntegerType())])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = ["part", "term", "keys", "tfs", "lengths", *(f"{c}_of" for c in others)]
            held: list[list] = [[] for _ in columns[2:]]
            now = None

            def blocks(all_: bool) -> list[dict]:
                """Of what is held, in key order; without all_ what is less than a block stays."""
                nonlocal held
                held = _by_key(held)
                n = len(held[0])
                stop = n if all_ else n - n % BLOCK
                out = []
                for at in range(0, stop, BLOCK):
                    keys, tfs, lengths, *more = (x[at : at + BLOCK] for x in held)
                    out.append({"term": now[1], "first": keys[0], "last": keys[-1], "n": len(keys), "tf": max(tfs), "length": min(lengths), "tops": tops(tfs, lengths), "keys": keys, "tfs": tfs, "lengths": lengths} | {f"{c}_of": m for c, m in zip(others, more)} | {"part": now[0]})
                held = [x[stop:] for x in held]
                return out

            def batch(of: list[dict]) -> pa.RecordBatch:
                types = {"n": pa.int32(), "tf": pa.int32(), "length": pa.int32(), "part": pa.int32(), "tops": pa.list_(pa.int32()), "keys": pa.list_(pa.string()), "tfs": pa.list_(pa.int32()), "lengths": pa.list_(pa.int32())}
                return pa.RecordBatch.from_arrays([pa.array([x[f.name] for x in of], types.get(f.name, pa.list_(pa.string()) if f.name.endswith("_of") else pa.string())) for f in schema], names=schema.names)

            for b in batches:
                out = []
                for part, term, *lists in zip(*(b.column(c).to_pylist() for c in columns)):
                    if now != (part, term):
                        out += blocks(True)
                        now = part, term
                    for of, more in zip(held, lists):
                        of.extend(more)
                    if len(held[0]) >= SORTED:
                        out += blocks(False)
                if out:
                    yield batch(out)
            if held[0]:
                yield batch(blocks(True))

        # a term that is frequent in a task's rows is dealt over SALTS groups: its blocks then share keys, which bounds allow
        salt = F.when(F.size("keys") >= MANY, F.pmod(F.xxhash64("first"), F.lit(SALTS))).otherwise(0)
        dealt = rows.withColumns({"part": self._part("term"), "salt": salt}).repartition("part", "term", "salt").sortWithinPartitions("part", "term", "first")
        dealt.mapInArrow(cut, schema).write.partitionBy("part").parquet(f"{self.path}/{name}/postings")

    def _merged(self, segments: list[dict]) -> list[dict]:
        """While the newest TIER + 1 segments or more are of a size (none over TIER times the greatest newer one), they become one."""
        size = lambda s: max(1, s["n"] + s["gone"])
        run = 1
        while run < len(segments) and size(segments[-1 - run]) <= TIER * max(map(size, segments[-run:])):
            run += 1
        return self._merged(self._one(segments, run)) if run > TIER else segments

    def _one(self, segments: list[dict], run: int) -> list[dict]:
        """The newest ``run`` segments as one."""
        stay, these = segments[: len(segments) - run], segments[len(segments) - run :]
        name = f"segment-{uuid.uuid4().hex}"
        self._write_postings(self.postings(these).select("term", "key", "tf", "length", *self.others).mapInArrow(self._packed, self._rows), name)
        alive = self._living(these, self._read(these, "forward", self._forward))
        self._write(alive.select("key", "length", "terms"), "forward", name, "key")
        sums = self.spark.read.schema(self._forward).parquet(f"{self.path}/{name}/forward").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        new = {"name": name, "n": sums["n"], "words": sums["words"], "gone": 0, "lost_n": 0, "lost_words": 0}
        if stay:  # what the merged segments took from those that stay
            keys = self._read(these, "gone", self._gone).select("key").distinct()
            dead = self._living(stay, self._read(stay, "forward", self._forward, self._touched(keys))).join(keys, "key", "left_semi")
            self._write(dead.select("key").distinct(), "gone", name, "key")
            self._write(dead.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "lost", name, "term")
            r = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
            new |= {"gone": r["n"], "lost_n": r["n"], "lost_words": r["words"]}
        new["folders"] = {t: self._folders(f"{name}/{t}") for t in ("postings", "forward", "gone", "lost")}
        return [*stay, new]

    # --- searching

    @staticmethod
    def size(segments: list[dict]) -> tuple[int, float]:
        """Living documents and their mean length."""
        n = sum(s["n"] - s["lost_n"] for s in segments)
        return n, sum(s["words"] - s["lost_words"] for s in segments) / n if n else 0.0

    def topk(self, segments: list[dict], terms: Sequence[str], k: int = LEXICAL_LIMIT, where: Column | None = None) -> DataFrame:
        """key, lexical_rank, score of the k best living documents. ``where`` may use key and others.

        Heads of blocks come to the driver, HEADS of a term at most: a term with more has one bound for all its blocks.
        """
        terms = sorted(set(terms))
        n, mean = self.size(segments)
        parts = self._parts_of(terms) if terms and n else []
        plan = self._plan(segments, terms, parts, n, mean) if parts else None
        if not plan or not plan.df:
            return self.spark.createDataFrame([], "key string, lexical_rank int, score double")
        idf = F.create_map(*(F.lit(x) for t, v in plan.idf.items() for x in (t, v)))
        part = idf[F.col("term")] * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.lit(mean or 1.0)))

        def scores(blocks: list[dict], whole: list[str]) -> DataFrame:
            """By what the postings of these blocks, and all of the terms ``whole``, say."""
            rows = self.postings(segments, parts, F.col("term").isin(list(plan.df)), self._named(blocks, whole))
            rows = rows.where(where) if where is not None else rows
            parted = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("term", part.alias("part")))).alias("parts"))
            return parted.select("key", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]).alias("score"))

        best = lambda rows: rows.orderBy(F.desc("score"), "key").limit(k)
        found = best(scores(plan.first(), [])).collect() if len(plan.blocks) > FIRST * len(plan.df) else []  # k rows
        threshold = found[-1]["score"] if len(found) == k else 0.0
        chosen, whole = plan.reaching(threshold)
        spare, more = plan.spare(threshold)
        if spare:
            main = [b for b in chosen if b["term"] not in spare]
            asked = scores(main, whole).where(F.col("score") + more >= threshold * (1 - 1e-12)).select("key").limit(CANDIDATES + 1).collect()
            if len(asked) <= CANDIDATES:
                chosen = main + plan.holding(spare, [r["key"] for r in asked])
        self.last_read = (len(chosen), len(plan.blocks))
        # whoever reaches the threshold has all its postings in chosen blocks; others' scores may lack parts, but stay below it
        return best(scores(chosen, whole)).select("key", F.row_number().over(Window.orderBy(F.desc("score"), "key")).alias("lexical_rank"), "score")

    def _named(self, blocks: list[dict], whole: list[str]):
        """A function that keeps the rows of these blocks and terms; few blocks become a filter that reaches the files."""
        if len(blocks) <= 500:
            one = F.lit(False)
            for at in sorted({b["at"] for b in blocks}):
                for t in sorted({b["term"] for b in blocks if b["at"] == at}):
                    one = one | ((F.col("at") == at) & (F.col("term") == t) & F.col("first").isin([b["first"] for b in blocks if b["at"] == at and b["term"] == t]))
            return lambda rows: rows.where(F.col("term").isin(whole) | one)
        names = F.broadcast(self.spark.createDataFrame([(b["at"], b["term"], b["first"]) for b in blocks], "at int, term string, first string"))  # HEADS a term at most
        return lambda rows: rows.where(~F.col("term").isin(whole)).join(names, ["at", "term", "first"], "left_semi").select(rows.columns).unionByName(rows.where(F.col("term").isin(whole)))

    def _plan(self, segments: list[dict], terms: list[str], parts: list[int], n: int, mean: float) -> Plan:
        rows = self._read(segments, "postings", self._blocks, parts).where(F.col("term").isin(terms))
        sums = rows.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), F.max("tf").alias("tf"), F.min("length").alias("length")).collect()  # a row a term
        lost = self._read(segments, "lost", self._lost, parts).where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("n")).collect()
        minus = {r["term"]: r["n"] for r in lost}
        df = {r["term"]: m for r in sums if (m := r["n"] - minus.get(r["term"], 0)) > 0}
        idf = {t: math.log(1 + (n - m + 0.5) / (m + 0.5)) for t, m in df.items()}
        bound = lambda r, tf, length: idf[r["term"]] * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / (mean or 1.0)))
        few = [r["term"] for r in sums if r["term"] in df and r["blocks"] <= HEADS]
        heads = rows.where(F.col("term").isin(few)).select("at", "term", "first", "last", "tops").collect() if few else []
        return Plan(df, idf, [{"at": h["at"], "term": h["term"], "first": h["first"], "last": h["last"], "bound": max(map(bound, [h] * len(h["tops"]), h["tops"][::2], h["tops"][1::2]))} for h in heads], {r["term"]: bound(r, r["tf"], r["length"]) for r in sums if r["term"] in df and r["blocks"] > HEADS})

    # --- keeping the list in a file

    def save(self, segments: list[dict]) -> None:
        """As the next numbered file, which comes to its name whole; of two writers one fails."""
        fs, root = self._file("")
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        number = 1 + max((int(x[9:-5]) for x in names if x.startswith("segments-")), default=-1)
        (_, staged), (_, named) = self._file(f"staged-{uuid.uuid4().hex}.json"), self._file(f"segments-{number:08d}.json")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()
        if fs.exists(named) or not fs.rename(staged, named):
            raise RuntimeError(f"another writer was first at {named.getName()}")

    def opened(self) -> list[dict]:
        fs, root = self._file("")
        names = sorted(x for f in fs.listStatus(root) if (x := f.getPath().getName()).startswith("segments-")) if fs.exists(root) else []
        return json.loads(self.spark.read.text(f"{self.path}/{names[-1]}", wholetext=True).first()[0]) if names else []

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path
