"""Quality classifier: regularised quadratic discriminant over transformed text statistics.

Each class has a mean and a shrunken covariance of the statistics; a score is the logistic function
of the log-priors' difference plus that of the classes' log-densities: Mahalanobis distances by the
inverted Cholesky factors, which are computed once and kept. The statistics aren't independent, so the
densities' difference is too sure of itself; it counts SHARPNESS of its size, and for texts of few
words still less (words / (words + HALF_EVIDENCE)), as their statistics say little. Neither changes
which class has the greater density. Statistics of every labelled row outside the held-out fold enter
the fit, as sums that Spark adds up; nothing is sampled. Texts of any length are measured whole.

Defined cases: a null text is the empty text, which has statistics and a score like any other;
labels that are null, or of documents that aren't there, are left out; a document labelled twice
counts once for each different label; if either class has under two rows, every score is the share
of label 1 (0.5 without labels). Rows are scored one by one, so repeated rows get equal scores. A
row with a null id is scored, not held out and never learned from. Other columns are left out (or
passed through by ``keep``). An empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batch, tidied, utf8

#: Weight of the diagonal and of the mean variance in a class's covariance, and of the log-odds in a score.
TO_DIAGONAL, TO_SPHERE, SHARPNESS = 0.1, 0.02, 0.25
#: Words at which a text's statistics count half: those of a few words say little.
HALF_EVIDENCE = 20
THRESHOLD = 0.3
FOLDS = 5
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_KIND[[*range(ord("A"), ord("Z") + 1)]] = 2
_KIND[[*range(ord("0"), ord("9") + 1)]] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:'\"?-()"]] = 5
STATISTICS = ("log_words", "lower", "upper", "digits", "blank", "stops", "symbols", "word_mean", "word_spread", "distinct", "top_word", "repeats", "short_words", "lines", "line_repeats")


def _logit(x: float, n: int) -> float:
    """Of a share of n, kept off 0 and 1."""
    p = (x * n + 0.5) / (n + 1)
    return float(np.log(p / (1 - p)))


def statistics(text: bytes) -> list[float]:
    n = len(text)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=6) / max(n, 1)
    words = text.split()
    m = len(words)
    sizes = np.fromiter(map(len, words), float, m) if m else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    return [
        float(np.log1p(m)), *(_logit(kinds[k], min(n, 200)) for k in (1, 2, 3, 4, 5, 0)),
        float(np.log1p(sizes.mean())), float(np.log1p(sizes.std())),
        _logit(len(counts) / max(m, 1), min(m, 200)), _logit(max(counts.values(), default=0) / max(m, 1), min(m, 200)),
        _logit(sum(map(bytes.__eq__, words, words[1:])) / max(m, 1), min(m, 200)), _logit(float((sizes <= 3).mean()), min(m, 200)),
        float(np.log1p(m / max(len(lines), 1))), _logit(1 - len(set(lines)) / max(len(lines), 1), min(len(lines), 200)),
    ]


@dataclass
class Model:
    share: float
    means: np.ndarray | None = None
    #: Cholesky factors of the classes' covariances, and their inverses.
    factors: np.ndarray | None = None
    log_dets: np.ndarray | None = None
    whiteners: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        density = [-0.5 * ((((x - self.means[c]) @ self.whiteners[c].T) ** 2).sum(1) + self.log_dets[c]) for c in (0, 1)]
        words = np.expm1(x[:, 0])
        odds = np.log(self.share / (1 - self.share)) + SHARPNESS * words / (words + HALF_EVIDENCE) * (density[1] - density[0])
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fitted(sums: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """From each class's count, sum and sum of outer products."""
    n = {c: sums[c][0] if c in sums else 0 for c in (0, 1)}
    share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
    if min(n.values()) < 2:
        return Model(share)
    means, factors, log_dets = [], [], []
    for c in (0, 1):
        mean = sums[c][1] / n[c]
        cov = (sums[c][2] / n[c] - np.outer(mean, mean)) * (n[c] / (n[c] - 1))
        cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov))
        cov = (1 - TO_SPHERE) * cov + TO_SPHERE * max(np.trace(cov) / len(mean), 1e-6) * np.eye(len(mean))
        means.append(mean)
        factors.append(np.linalg.cholesky(cov))
        log_dets.append(2 * np.log(np.diag(factors[-1])).sum())
    return Model(share, np.array(means), np.array(factors), np.array(log_dets), np.linalg.inv(np.array(factors)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one double column for each of STATISTICS."""
    schema = pa.schema([("doc_id", pa.int64()), *((s, pa.float64()) for s in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in utf8(b.column(1))]).reshape(-1, len(STATISTICS))
            yield batch(schema, [b.column(0), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(STATISTICS)))])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(tidied(run), "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


def fit(statistics_of: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Learn from the labelled rows outside the held-out fold; two rows of sums reach the driver."""
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1)").distinct()
    rows = statistics_of.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(label, "doc_id")
    pairs = [(a, b) for i, a in enumerate(STATISTICS) for b in STATISTICS[i:]]
    sums = {}
    for r in rows.groupBy("label").agg(F.count("*").alias("n"), *(F.sum(s) for s in STATISTICS), *(F.sum(F.col(a) * F.col(b)) for a, b in pairs)).collect():
        d, outer = len(STATISTICS), np.zeros((len(STATISTICS),) * 2)
        outer[np.triu_indices(d)] = r[2 + d :]
        sums[r["label"]] = (r["n"], np.array(r[2 : 2 + d], float), outer + np.triu(outer, 1).T)
    return fitted(sums)


def scored(statistics_of: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(s).to_numpy() for s in STATISTICS]) if b.num_rows else np.zeros((0, len(STATISTICS)))
            yield batch(schema, [b.column("doc_id"), pa.array(model.scores(x))])

    out = statistics_of.mapInArrow(tidied(run), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text scores THRESHOLD or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in utf8(b.column(text_col))]).reshape(-1, len(STATISTICS))
            yield b.filter(pa.array(model.scores(x) >= THRESHOLD))

    return df.mapInArrow(tidied(run), df.schema)
