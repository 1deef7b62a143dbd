"""Toxicity by compression distance: two zstandard dictionaries, compressed lengths of windows, calibrated thresholds.

A window is a run of WINDOW lower-cased words (letters and digits; words over LONGEST characters are cut), a new one
every STEP words, so every phrase of WINDOW - STEP + 1 words lies whole in one. It is compressed twice: with the
dictionary trained on ordinary text, and with that of toxic text behind it. Its gain is the difference of the two
lengths: bytes that toxic text explains and ordinary text doesn't.

Labels are of documents, toxicity is of passages, so ``fit`` first attributes words: for each word it counts the sampled
toxic and ordinary documents that have it (no more than it has pairs of neighbours there, so that copies of one text
count once), and takes for toxic those whose surplus in toxic documents no chance explains (log-likelihood ratio over the
logarithm of the number of words compared). The toxic dictionary is trained on windows of these, the ordinary one on the
most widespread others. On further sampled documents, in neither dictionary's sample, the threshold is the least gain
that at most ORDINARY_RATE of ordinary windows reach, and a logistic function calibrates a document's greatest gain, mean
of three greatest, mean gain and share of windows at the threshold to a score.

The sample: of each label the SAMPLE documents whose hashed id is least (all, if there are fewer), whole texts; ids and
words in bounded numbers reach the driver, texts don't. Scoring is one pass without exchange over whole texts.

Defined cases: a null text is the empty text, which has no window and gets the score of no gain; labels that are null, or
of documents that aren't there, are left out, and a document labelled twice counts once for each label; of rows that share
an id the least text is learned from; a row with a null id is scored, not held out and not learned from. Without
documents of both labels, or without any word to tell them apart, every score is the share of label 1 (0.5 without
labels). Rows are scored one by one, so repeated rows get equal scores. Other columns are left out. An empty table gives
an empty table.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batch, drop, shared_dir, stored, tidied

WINDOW, STEP, LONGEST = 8, 6, 64
#: Documents of each label that are learned from, a third of them for calibration.
SAMPLE = 6000
#: Words that a dictionary is trained on at most, and its bytes at most.
TOXIC_WORDS, ORDINARY_WORDS, TOXIC_BYTES, ORDINARY_BYTES = 2000, 20_000, 32 << 10, 64 << 10
ORDINARY_RATE = 0.001
THRESHOLD = 0.5
FOLDS = 5
_WORD = re.compile(r"[^\W_]+")
#: Matches of at least 6 bytes: shorter ones are parts of any word.
_FORM = zstandard.ZstdCompressionParameters.from_level(12, min_match=6, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
_FEATURES = 5


def words(text: str | None) -> list[str]:
    return [w[i : i + LONGEST] for w in _WORD.findall((text or "").lower()) for i in range(0, len(w), LONGEST)]


def windows(of: list[str]) -> list[str]:
    return [" ".join(of[i : i + WINDOW]) for i in range(0, len(of) - (WINDOW - STEP) if len(of) > WINDOW else min(1, len(of)), STEP)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=_FORM)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=_FORM)


@dataclass
class Model:
    share: float
    #: What the two sides' compressors have seen: the ordinary dictionary, and it with the toxic one behind it.
    ordinary: bytes = b""
    toxic: bytes = b""
    threshold: int = 0
    weights: np.ndarray | None = None
    _both: tuple | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_both": None}

    def gains(self, of: list[str]) -> np.ndarray:
        """Of each window, how many bytes less the side that knows toxic text needs."""
        if self._both is None:
            self._both = _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)
        plain, toxic = self._both[0].compress, self._both[1].compress
        out = np.empty(len(of))
        for i, w in enumerate(of):
            b = f" {w} ".encode("utf-8", "surrogatepass")
            out[i] = len(plain(b)) - len(toxic(b))
        return out

    def features(self, gains: np.ndarray) -> list[float]:
        if not len(gains):
            return [1.0] + [0.0] * (_FEATURES - 1)
        best = np.sort(gains)[-3:]
        return [1.0, float(best[-1]), float(best.mean()), float(gains.mean()), math.log1p(1000 * float((gains >= self.threshold).mean())) if self.threshold else 0.0]

    def score(self, text: str | None) -> float:
        if not self.toxic or self.weights is None:
            return self.share
        return float(_logistic(np.dot(self.weights, self.features(self.gains(windows(words(text)))))))


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def trained(of: dict[str, int], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes, trained on words by weight; words that it left out weigh more in the next try.

    Where there is too little to train on, the words themselves are the dictionary.
    """
    weight, best, left = dict(of), b"", len(of) + 1
    for _ in range(6):
        # a word stands twice in its window, so that short ones are long enough to be counted
        samples = [f" {w} {w} ".encode() for w in weight for _ in range(weight[w])]
        random.Random(len(samples)).shuffle(samples)
        try:
            d = zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
        except zstandard.ZstdError:
            break
        missed = [w for w in of if f" {w} ".encode() not in d]
        if len(missed) < left:
            best, left = d, len(missed)
        if not missed or len(of) * 4 > size:  # not meant to hold them all
            break
        for w in missed:
            weight[w] = min(2 * weight[w], 64)
    return best or (" " + " ".join(of) + " ").encode()[:size]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", size: int = SAMPLE) -> DataFrame:
    """doc_id, label, text, calibrates of the documents learned from: ``size`` of each label at most."""
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    label = label.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    there = label.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    at = F.xxhash64(F.lit("sample"), "doc_id")
    ids = None
    for y in (0, 1):
        mine = there.where(F.col("label") == y).orderBy(at, "doc_id").limit(size)
        ids = mine if ids is None else ids.unionByName(mine)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(ids), "doc_id")  # 2 * size ids
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).withColumn("calibrates", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) == 0)


def attributed(sample: DataFrame) -> DataFrame:
    """word, a, b: of the sampled toxic and ordinary documents, how many have the word, or in fewer pairs of neighbours."""
    schema = pa.schema([("word", pa.string()), ("label", pa.int32()), ("doc_id", pa.int64()), ("beside", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, label, text in zip(*(c.to_pylist() for c in b.columns)):
                w = ["", *words(text), ""]
                once = {}
                for before, x, after in zip(w, w[1:], w[2:]):
                    once.setdefault(x, f"{before} {after}")
                yield batch(schema, [list(once), [label] * len(once), [doc_id] * len(once), list(once.values())])

    met = sample.select("doc_id", "label", "text").mapInArrow(tidied(run), "word string, label int, doc_id long, beside string")
    # a document's first pair of neighbours stands for it: documents that share it count once
    once = met.groupBy("word", "label", "beside").agg(F.lit(1).alias("one"))
    return once.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", size: int = SAMPLE) -> Model:
    """Learn from labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    sample = stored(sampled(docs, labels, label_col, size), f"{path}/sample")
    n = {(r["label"], r["calibrates"]): r["n"] for r in sample.groupBy("label", "calibrates").agg(F.count("*").alias("n")).collect()}
    ones, zeros = ((n.get((y, False), 0), n.get((y, True), 0)) for y in (1, 0))
    share = sum(ones) / (sum(ones) + sum(zeros)) if sum(ones) + sum(zeros) else 0.5
    model = Model(share)
    if ones[0] and zeros[0]:
        counts = stored(attributed(sample.where("not calibrates")), f"{path}/counts")
        compared = counts.count()
        p = ones[0] / (ones[0] + zeros[0])
        both = F.col("a") + F.col("b")
        surplus = F.col("a") * F.log(F.col("a") / (both * p)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (both * (1 - p)))).otherwise(0.0)
        surplus = F.when(F.col("a") > both * p, surplus).otherwise(0.0)
        ratios = counts.withColumn("surplus", surplus)
        marked = F.col("surplus") > math.log(max(compared, 2))
        told = {r["word"]: min(8 + int(r["surplus"]), 32) for r in ratios.where(marked).orderBy(F.desc("surplus"), "word").limit(TOXIC_WORDS).collect()}
        others = {r["word"]: min(r["b"], 20) for r in ratios.where(~marked & (F.col("b") > 0)).orderBy(F.desc("b"), "word").limit(ORDINARY_WORDS).collect()}
        if told:
            model = Model(share, trained(others, ORDINARY_BYTES) if others else b"", trained(told, TOXIC_BYTES))
            _calibrate(model, sample.where("calibrates") if ones[1] and zeros[1] else sample)
    drop(spark, path)
    return model


def _calibrate(model: Model, sample: DataFrame) -> None:
    """Set the threshold from the gains' histogram, then the weights from the documents' features."""
    rows = sample.select("label", "text")

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gain", pa.int32()), ("n", pa.int64())])
        for b in batches:
            found = np.concatenate([model.gains(windows(words(t))) for t in b.column(1).to_pylist()] or [np.zeros(0)])
            values, times = np.unique(found.astype(np.int32), return_counts=True)
            yield batch(schema, [pa.array(values), pa.array(times)])

    histogram = rows.where("label = 0").mapInArrow(tidied(gains), "gain int, n long").groupBy("gain").agg(F.sum("n").alias("n")).collect()  # one row a length
    total, above = sum(r["n"] for r in histogram), 0
    model.threshold = 1 + max((r["gain"] for r in histogram), default=0)
    for r in sorted(histogram, key=lambda r: -r["gain"]):
        above += r["n"]
        if above > ORDINARY_RATE * total or r["gain"] < 1:
            break
        model.threshold = r["gain"]
    model.threshold = max(model.threshold, 1)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])
        for b in batches:
            yield batch(schema, [b.column(0), [model.features(model.gains(windows(words(t)))) for t in b.column(1).to_pylist()]])

    got = rows.mapInArrow(tidied(features), "label int, x array<double>").collect()  # 2 * SAMPLE rows of five numbers at most
    got.sort()
    x, y = np.array([r["x"] for r in got]).reshape(-1, _FEATURES), np.array([r["label"] for r in got], float)
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    w, x = np.zeros(_FEATURES), x / scale
    ridge = np.diag([1e-6] + [0.1] * (_FEATURES - 1))
    for _ in range(50):  # Newton's steps on the penalised likelihood
        q = _logistic(x @ w)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge, x.T @ (y - q) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w / scale


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, [b.column(0), [model.score(t) for t in b.column(1).to_pylist()]])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(tidied(run), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """The windows that reach the threshold: doc_id, first_word (from 0), passage (lower-cased words), gain."""
    schema = pa.schema([("doc_id", pa.int64()), ("first_word", pa.int64()), ("passage", pa.string()), ("gain", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                mine = windows(words(text)) if model.toxic else []
                gains = model.gains(mine)
                some = np.flatnonzero(gains >= model.threshold).tolist()
                yield batch(schema, [[doc_id] * len(some), [k * STEP for k in some], [mine[k] for k in some], pa.array(gains[some].astype(np.int32))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(tidied(run), "doc_id long, first_word long, passage string, gain int")
