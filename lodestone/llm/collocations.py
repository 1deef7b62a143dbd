"""Phrase collocations: n-grams mined by pivot partitioning, scored by their weakest cut.

Mining follows MG-FSM. Words that occur fewer than LEAST times in their language are blanks: no frequent phrase holds one.
Every n-gram belongs to its rarest word, its pivot (of the leftmost place, if that word occurs twice). For each place of a
frequent word a text sends the stretch around it in which no word is rarer, LONGEST - 1 words to either side at most, to
the word's partition; there the n-grams that hold the pivot's place are counted, and no other partition counts them. Words are ranked by
frequency in steps of a quarter of an octave, then by hash: a rank is a function of the word alone, so ownership is exact.

Ranks are looked up in a table of levels by hashed word, 16 slots a frequent word, 2**MOST_SLOT_BITS at most (64 MB); two words of one
slot share the higher level, which lets an infrequent word through at times and changes no count. A task packs the
stretches of a pivot into one row. Pivots of many stretches are dealt over several groups; those groups' partial counts
are added up by phrase. Other groups know the full count of what they own and emit only frequent phrases.

A frequent phrase's parts are frequent, so every cut finds both its counts in the mined table; keys of many rows meet
theirs by broadcast (``common.beside``). A phrase inside a longer one of the same count lies inside one that is longer by
one word and has that count too, which is a cut after the first word or before the last: no phrase is compared with others.
Scores are decimals of 38 digits: a, n, l and r may be up to 10**15.

Defined cases: a null text is the empty text and has no words; a null language is ``und``; rows are judged each by itself,
whatever their ids, so repeated rows count repeatedly; ties in rank go by score, count, then the phrase's bytes; other columns are left
out. Words and texts may have any length. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import batch, beside, shared_dir, stored, tidied, utf8

LEAST, LONGEST = 100, 5
#: Words that a task holds before it sends what it has; words that a table of counts holds at most.
FLUSH, HELD = 1 << 20, 1 << 20
#: Stretches of a pivot from which it is dealt over several groups, so many to each.
SPLIT = 1 << 18
MOST_SLOT_BITS = 26
#: Bytes of words whose ranks a task remembers.
REMEMBERED = 64 << 20
#: 0xFF is in no UTF-8 text: it stands between pieces.
_BREAK = b"\xff"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + _BREAK * 10)
_DIGITS = [b"%d" % i for i in range(10)]


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, and a break between pieces."""
    return text.translate(_TABLE).replace(_BREAK, b" \xff ").split()


def _inputs(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))


def _strings(of: list[bytes]) -> pa.Array:
    return pa.array(of, pa.binary()).cast(pa.string())


def counted(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """lang, word, n of the words that occur ``least`` times or more; a null word has the count of all of its language's."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                total = c.total() - c.pop(_BREAK, 0)
                yield batch(schema, [[lang] * (len(c) + 1), pa.concat_arrays([_strings(list(c)), pa.nulls(1, pa.string())]), [*c.values(), total]])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                held.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, held.values())) > HELD:
                yield from sent()
        yield from sent()

    rows = _inputs(df, text_col, lang_col).mapInArrow(tidied(run), "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= least))


def level(n: int) -> int:
    return min(255, 1 + int(4 * math.log2(max(n, 1))))


def _hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=zlib.crc32(lang.encode()))


class Levels:
    """The broadcast table of levels by hashed word."""

    def __init__(self, words: DataFrame):
        schema = pa.schema([("slot", pa.int32()), ("level", pa.int32())])
        n = words.count()
        self.bits = bits = max(1, min(MOST_SLOT_BITS, math.ceil(math.log2(16 * max(n, 1)))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                slots = [_hash(lang, w) >> (64 - bits) for lang, w in zip(b.column(0).to_pylist(), utf8(b.column(1)))]
                yield batch(schema, [slots, [level(n) for n in b.column(2).to_pylist()]])

        of = words.mapInArrow(tidied(run), "slot int, level int").groupBy("slot").agg(F.max("level").alias("level"))
        parts = of.groupBy(F.shiftright("slot", 12).alias("part")).agg(F.collect_list(F.struct("slot", "level")).alias("of"))  # 4096 at most
        table = np.zeros(1 << bits, np.uint8)
        for r in parts.toLocalIterator():
            for x in r["of"]:
                table[x["slot"]] = x["level"]
        self.packed = words.sparkSession.sparkContext.broadcast(zstandard.ZstdCompressor(level=3).compress(table.tobytes()))

    def table(self) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.packed.value), np.uint8)


class Ranks(dict):
    """Rank by word: a frequent word's level, then its hash; 0 for others and for breaks. Forgets when it holds too much."""

    def __init__(self, lang: str, table: np.ndarray, bits: int, most: int):
        self.lang, self.levels, self.shift, self.most, self.size = lang, table, 64 - bits, most, 0

    def __missing__(self, word: bytes) -> int:
        h = _hash(self.lang, word)
        k = int(self.levels[h >> self.shift])
        rank = 0 if word == _BREAK or not k else k << 55 | (h & ((1 << 55) - 1))
        self.size += len(word) + 120
        if self.size > self.most:
            self.clear()
            self.size = 0
        self[word] = rank
        return rank


def groups_of(rank: int, split: int) -> int:
    """Over how many groups a pivot's stretches are dealt, from the most that its level stands for."""
    return max(1, math.ceil(2 ** ((rank >> 55) / 4) / split))


def stretches(words: list[bytes], ranks: np.ndarray, longest: int) -> Iterator[tuple[int, bytes]]:
    """(pivot, its stretches by lines: the pivot's place in it as a digit, then the words)."""
    reach = longest - 1
    left, right = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    before, after = ranks > 0, ranks > 0
    for d in range(1, min(reach, len(words) - 1) + 1):
        before[d:] &= ranks[:-d] > ranks[d:]
        before[:d] = False
        after[:-d] &= ranks[d:] >= ranks[:-d]
        after[-d:] = False
        left += before
        right += after
    at = np.flatnonzero(left + right)
    at = at[np.argsort(ranks[at], kind="stable")]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    text = b" ".join(words)
    lines = [_DIGITS[k] + text[a:z] for k, a, z in zip(left[at].tolist(), (ends[at - left[at]] - sizes[at - left[at]] + 1).tolist(), ends[at + right[at]].tolist())]
    pivots = ranks[at]
    edges = [0, *(np.flatnonzero(np.diff(pivots)) + 1).tolist(), len(at)] if len(at) else []
    for a, z in zip(edges, edges[1:]):
        yield int(pivots[a]), b"\n".join(lines[a:z])


def owned(counts: dict[bytes, int], longest: int, into: Counter, least: int = 1) -> None:
    """Add the n-grams that hold the pivot's place of each stretch.

    With ``least``, counts are all that a group has: a pair of the pivot and its neighbour belongs to the pivot wherever it is, so
    pairs are counted first, and of pairs that are too few no longer phrase is made.
    """
    rows = [(line[0] - 48, line[1:].split(b" "), n) for line, n in counts.items()]
    pairs: Counter = Counter()
    if least > 1:
        for at, words, n in rows:
            if at:
                pairs[words[at - 1], words[at]] += n
            if at + 1 < len(words):
                pairs[words[at], words[at + 1]] += n
    for at, words, n in rows:
        first = 0 if least == 1 or at and pairs[words[at - 1], words[at]] >= least else at
        last = len(words) if least == 1 or at + 1 < len(words) and pairs[words[at], words[at + 1]] >= least else at + 1
        for a in range(max(first, at - longest + 1), at + 1):
            for z in range(max(at + 1, a + 2), min(last, a + longest) + 1):
                into[b" ".join(words[a:z])] += n


def mined(df: DataFrame, words: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, f: phrases of 2 to ``longest`` words that occur ``least`` times or more. words: as ``counted`` gives them."""
    if not 2 <= longest <= 10:
        raise ValueError("phrases have 2 to 10 words")
    levels = Levels(words.where(F.col("word").isNotNull()))
    route = pa.schema([("lang", pa.string()), ("pivot", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("payload", pa.binary())])
    found = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.table()
        ranks: dict[str, Ranks] = {}
        held: dict[str, list[bytes]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, of in held.items():
                if lang not in ranks:
                    if len(ranks) > 64:
                        ranks.clear()
                    ranks[lang] = Ranks(lang, table, levels.bits, REMEMBERED)
                rows = []
                for pivot, payload in stretches(of, np.fromiter(map(ranks[lang].__getitem__, of), np.int64, len(of)), longest):
                    parts = groups_of(pivot, SPLIT)
                    rows.append((pivot, zlib.crc32(payload) % parts, parts, payload))
                    if len(rows) == 10_000:
                        yield batch(route, [[lang] * len(rows), *map(list, zip(*rows))])
                        rows = []
                if rows:
                    yield batch(route, [[lang] * len(rows), *map(list, zip(*rows))])
            held.clear()

        n = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                of = held.setdefault(lang, [])
                before = len(of)
                of.extend(tokens(text))
                of.append(_BREAK)
                n += len(of) - before
                if n > FLUSH:
                    yield from sent()
                    n = 0
        yield from sent()

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        grams: Counter = Counter()
        key, partial = None, False

        def emitted(lang: str, floor: int) -> pa.RecordBatch:
            some = [(g, f) for g, f in grams.items() if f >= floor]
            grams.clear()
            return batch(found, [[lang] * len(some), _strings([g for g, _ in some]), [f for _, f in some]])

        for b in batches:
            for *k, payload in zip(*(b.column(c).to_pylist() for c in ("lang", "pivot", "part", "parts", "payload"))):
                if k != key:
                    if key:
                        owned(counts, longest, grams, 1 if partial else least)
                        counts.clear()
                        yield emitted(key[0], 1 if partial else least)
                    key, partial = k, k[3] > 1
                counts.update(payload.split(b"\n"))
                if len(counts) > HELD:
                    partial = True  # from here on the group's counts are parts
                    owned(counts, longest, grams)
                    counts.clear()
                    if len(grams) > HELD:
                        yield emitted(key[0], 1)
        if key:
            owned(counts, longest, grams, 1 if partial else least)
            yield emitted(key[0], 1 if partial else least)

    routed = _inputs(df, text_col, lang_col).mapInArrow(tidied(send), "lang string, pivot long, part int, parts int, payload binary")
    order = ["lang", "pivot", "part"]
    rows = routed.repartition(*order).sortWithinPartitions(*order).mapInArrow(tidied(mine), "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _key(phrase: Column) -> Column:
    return F.struct("lang", phrase.alias("phrase"))


def _known(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join by key with values that are one row a key."""
    return beside(rows, rows.groupBy(key).agg(F.count("*").alias("n")).join(values, key), key, total)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that are in no longer one of the same count.

    phrases: stored, as ``mined`` gives them; words: stored, as ``counted`` gives them.
    """
    path = shared_dir(phrases.sparkSession)
    split = F.split("phrase", " ")
    every = phrases.select("lang", "phrase", "f").unionByName(words.where(F.col("word").isNotNull()).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")))
    cut = phrases.select("lang", "phrase", F.col("f").alias("a"), split.alias("w"), F.explode(F.sequence(F.lit(1), F.size(split) - 1)).alias("k"))
    cut = cut.withColumns({"first": _key(F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")), "rest": _key(F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " "))})
    cut = stored(cut.select("lang", "phrase", "a", "k", F.size("w").alias("size"), "first", "rest"), f"{path}/cuts")
    total = cut.count()
    cut = _known(cut, every.select(_key(F.col("phrase")).alias("first"), F.col("f").alias("l")), "first", total)
    cut = stored(_known(cut, every.select(_key(F.col("phrase")).alias("rest"), F.col("f").alias("r")), "rest", total), f"{path}/known")
    cut = stored(_known(cut, words.where(F.col("word").isNull()).select("lang", F.col("n").alias("all")), "lang", total), f"{path}/valued")
    cut = cut.withColumn("score", F.expr("((a * 1000L)::decimal(18,0) * `all`::decimal(18,0)) div (l::decimal(18,0) * r::decimal(18,0))"))
    weakest = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", F.col("all").alias("n"))).alias("at"))
    inside = cut.where("size > 2 and k = 1 and a >= r").select("rest.*").unionByName(cut.where("size > 2 and k = size - 1 and a >= l").select("first.*")).distinct()
    return weakest.join(inside, ["lang", "phrase"], "left_anti").select("lang", "phrase", "at.a", "at.l", "at.r", "at.n", "at.score")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """All scored phrases of a table of texts."""
    path = shared_dir(df.sparkSession)
    words = stored(counted(df, text_col, lang_col, least), f"{path}/words")
    return scored(stored(mined(df, words, text_col, lang_col, least, longest), f"{path}/phrases"), words)


def best(of: DataFrame, n: int) -> DataFrame:
    """The first n of each language, with their rank; each task keeps n of a language before they meet."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return of.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM listed, range(1, 6) AS g(m))),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::bigint AS n FROM listed GROUP BY ALL),
cuts AS (SELECT lang, m, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM f, range(1, 5) AS c(k) WHERE m >= 2 AND k < m),
valued AS (
  SELECT c.lang, c.phrase, c.k, c.a, x.f AS l, y.f AS r, n.n, (1000::hugeint * c.a * n.n) // (x.f::hugeint * y.f) AS score
  FROM cuts c JOIN n USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
weakest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(f) AS f
  FROM (SELECT lang, f, w, i, unnest(range(i + 1, len(w) + 1)) AS j FROM (SELECT lang, f, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS i FROM f WHERE m > 2)) WHERE j - i + 1 < len(w) GROUP BY ALL)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, n, score::bigint AS score
FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
WHERE coalesce(100 * i.f < 100 * a, true)
QUALIFY row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) <= 2000
"""
