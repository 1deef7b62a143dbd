"""Connected components of links between documents, in rounds of joins; nothing meets on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batch, beside, drop, stored, tidied

LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])
#: The number of rounds grows with the logarithm of the number of nodes; so many are never needed.
ROUNDS = 200


class Forest:
    """Union-find over hashable nodes; the least node is the root."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        return True


def _thinned(links: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """The same components with fewer links: of every ``limit`` nodes in a task only stars remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def stars() -> pa.RecordBatch:
            out = [(x, r) for x in list(forest.parent) if (r := forest.root(x)) != x]
            return batch(LINKS, [[x for x, _ in out], [r for _, r in out]])

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                forest.join(x, y)
            if len(forest.parent) > limit:
                yield stars()
                forest = Forest()
        yield stars()

    return links.mapInArrow(tidied(run), "a binary, b binary")


def components(links: DataFrame, path: str) -> DataFrame:
    """node, root (the least node that links reach from it) for every node of links(a binary, b binary).

    Alternating stars: each round hangs a node's larger neighbours on its least one, then its
    smaller ones; it ends when every node hangs on a root. Each round is a table in ``path``.
    """
    spark = links.sparkSession
    files = spark.sparkContext.defaultParallelism
    links = stored(_thinned(links.where("a <> b")), f"{path}/links-0", files=files)
    for k in range(1, ROUNDS):
        if _stars(links):
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b")).distinct()
        total = 2 * links.count()
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).select("a", F.least("a", "least").alias("m"), "n")
        large = beside(both.where("b > a"), least, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        m = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = beside(down, m, "a", total).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links = stored(_thinned(small.where("a <> b")), f"{path}/links-{k}", files=files)
        drop(spark, f"{path}/links-{k - 1}")
    raise RuntimeError(f"components have not settled in {ROUNDS} rounds")


def _stars(links: DataFrame) -> bool:
    """Whether every node hangs on one other, and that on none."""
    up = links.select(F.col("a").alias("node"), F.col("b").alias("up")).union(links.select("b", F.lit(None).cast("binary")))
    ends = up.groupBy("node").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.count("*").alias("n"), F.count("up").alias("hung"))
    return ends.where("least <> most or hung > 0 and hung < n").isEmpty()
