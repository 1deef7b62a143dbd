"""A vector index in coarse cells: k-means cells as partitions, nearest cells probed, exact distances, bounds for exact results.

Centroids come from k-means over a bounded sample (about SAMPLE_A_CELL vectors a cell, drawn by hash); their number
follows the table (root of its rows, MOST_CELLS at most), so a probe reads about a root of the rows. Every row has a cell; a
cell is one folder of Parquet files, several where it is large, and the index keeps each cell's number of rows and radius. A search
orders cells by their centroid's distance and reads the first ``probes``: as many as reached RECALL on CALIBRATED
sampled rows when the index was built. All distances are of the stored vectors, computed exactly. With ``exact`` it then reads
further cells, all those whose distance less their radius isn't beyond the last neighbour found, so that none is missed.

One query reads its cells' folders (partition pruning) and keeps k rows in each task. A table of queries is dealt to its
cells in blocks of at most BLOCK rows and BLOCK queries, so neither a crowded cell nor a popular one is one task, and only k rows
of each query and block are exchanged.

Rows without a key or vector, with nulls or non-finite entries, or of another dimension than the first have no place in an
index; ``add`` raises nothing for them and leaves them out. Ties go to the smaller key. A repeated key is two rows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.retrieval import squared_distance

SAMPLE_A_CELL, MOST_CELLS, ROUNDS = 48, 1 << 16, 12
RECALL, CALIBRATED, CALIBRATED_K = 0.95, 64, 20
BLOCK = 4096
#: Room for rounding where a bound decides that a cell can't hold a neighbour.
SLACK = 1e-9


def distances(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of rows (down) and queries (across), to rounding of their norms."""
    return np.maximum((rows * rows).sum(1)[:, None] + (queries * queries).sum(1) - 2 * rows @ queries.T, 0.0)


def cell_of(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the first in a tie) and the distance to it."""
    cells, away = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    step = max(1, (1 << 22) // max(1, len(centroids)))
    for at in range(0, len(vectors), step):
        d = distances(vectors[at : at + step], centroids)
        cells[at : at + step] = d.argmin(1)
        off = vectors[at : at + step] - centroids[cells[at : at + step]]
        away[at : at + step] = np.sqrt((off * off).sum(1))
    return cells, away


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)


@dataclass
class VectorIndex:
    path: str
    key: str
    dimension: int
    probes: int
    #: Recall on the calibration rows by number of probes, from 1.
    curve: list[float] = field(default_factory=list)
    #: Folders of rows, and for each cell its rows and radius.
    parts: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    radii: list[float] = field(default_factory=list)
    key_type: str = "string"
    others: dict[str, str] = field(default_factory=dict)
    centroids: np.ndarray | None = field(default=None, repr=False)

    # --- building

    @classmethod
    def build(cls, df: DataFrame, path: str, key: str, embedding: str = "embedding", others: Sequence[str] = (), cells: int | None = None) -> VectorIndex:
        """Index all of df: key, embedding and the columns ``others``, which filters may use."""
        spark = df.sparkSession
        types = {f.name: f.dataType.simpleString() for f in df.schema}
        first = df.where(F.size(embedding) > 0).select(F.size(embedding).alias("d")).first()
        index = cls(path.rstrip("/"), key, first["d"] if first else 0, 1, key_type=types[key], others={c: types[c] for c in others})
        rows = index._fit(df, embedding)
        n = rows.count()
        k = max(1, min(cells or math.ceil(math.sqrt(n)), MOST_CELLS))
        drawn = F.pmod(F.xxhash64(F.col(key).cast("string"), F.monotonically_increasing_id()), F.lit(max(n, 1))) < k * SAMPLE_A_CELL
        sample = rows.where(drawn).select(array_to_vector("embedding").alias("features"))
        if n:
            found = KMeans(k=k, seed=1, maxIter=ROUNDS).fit(sample).clusterCenters() if k > 1 else [sample.select(Summarizer.mean(F.col("features"))).first()[0].toArray()]
            index.centroids = np.array(found, float)
        else:
            index.centroids = np.zeros((0, index.dimension))
        index.sizes, index.radii = [0] * len(index.centroids), [0.0] * len(index.centroids)
        index._add(rows)
        index._calibrate(spark)
        index._save(spark)
        return index

    def _fit(self, df: DataFrame, embedding: str) -> DataFrame:
        whole = F.forall(embedding, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
        rows = df.where(F.col(self.key).isNotNull() & (F.size(embedding) == self.dimension) & whole)
        return rows.select(self.key, F.col(embedding).cast("array<float>").alias("embedding"), *self.others)

    def _add(self, rows: DataFrame) -> None:
        if not len(self.centroids):
            return
        centroids, d = self.centroids, self.dimension
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells, away = cell_of(_matrix(b.column("embedding"), d), centroids)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.astype(np.int32)), pa.array(away)], names=[*b.schema.names, "cell", "away"])

        part = f"rows-{uuid.uuid4().hex}"
        placed = rows.mapInArrow(assign, schema)
        placed.hint("rebalance", "cell").sortWithinPartitions("cell", self.key).write.partitionBy("cell").parquet(f"{self.path}/{part}")
        self.parts.append(part)
        written = rows.sparkSession.read.schema(self._schema()).parquet(f"{self.path}/{part}")
        for r in written.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():  # a row a cell
            self.sizes[r["cell"]] += r["n"]
            self.radii[r["cell"]] = max(self.radii[r["cell"]], r["away"])

    def add(self, df: DataFrame, embedding: str = "embedding") -> None:
        """More rows, in the cells that are there; nothing is rewritten."""
        self._add(self._fit(df, embedding))
        self._save(df.sparkSession)

    def _calibrate(self, spark: SparkSession) -> None:
        """Set probes from the cells in which the nearest rows of sampled rows lie."""
        rows = self.rows(spark)
        asked = rows.orderBy(F.xxhash64(F.lit("asked"), F.col(self.key).cast("string")), self.key).limit(CALIBRATED).select(F.monotonically_increasing_id().alias("query"), "embedding").collect()
        if not asked:
            return
        queries = np.array([r["embedding"] for r in asked], float)
        key_type, d = self.key_type, self.dimension

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield _block_best(_matrix(b.column("embedding"), d), b.column(0), b.column("cell"), queries, np.arange(len(queries)), CALIBRATED_K, self.key)

        best = rows.select(self.key, "embedding", "cell").mapInArrow(nearest, f"query long, `{self.key}` {key_type}, cell int, distance double")
        order = Window.partitionBy("query").orderBy("distance", self.key)
        near = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CALIBRATED_K).select("query", "cell").collect()
        seat = distances(self.centroids, queries).argsort(0, kind="stable").argsort(0)
        needed = np.array([seat[r["cell"], r["query"]] for r in near])
        self.curve = [float((needed < p).mean()) for p in range(1, len(self.centroids) + 1)][:256]
        self.probes = next((p for p, c in enumerate(self.curve, 1) if c >= RECALL), len(self.centroids))

    # --- storing

    def _file(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _save(self, spark: SparkSession) -> None:
        """Centroids as a table, the rest as a new numbered file, which comes to its name whole."""
        fs, root = self._file(spark, "")
        names = sorted(f.getPath().getName() for f in fs.listStatus(root)) if fs.exists(root) else []
        if "centroids" not in names:
            rows = [(i, c) for i, c in enumerate(self.centroids.tolist())]
            spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")
        number = 1 + max((int(n[6:-5]) for n in names if n.startswith("index-") and n.endswith(".json")), default=-1)
        staged, named = (self._file(spark, n)[1] for n in (f"staged-{uuid.uuid4().hex}", f"index-{number:08d}.json"))
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps({k: v for k, v in asdict(self).items() if k not in ("centroids", "path")}).encode()))
        out.close()
        if fs.exists(named) or not fs.rename(staged, named):
            raise RuntimeError(f"another writer was first at {named.getName()}")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        index = cls(path.rstrip("/"), "", 0, 1)
        fs, root = index._file(spark, "")
        name = max(n for f in fs.listStatus(root) if (n := f.getPath().getName()).startswith("index-"))
        for k, v in json.loads(spark.read.text(f"{index.path}/{name}", wholetext=True).first()[0]).items():
            setattr(index, k, v)
        rows = spark.read.schema("cell int, centroid array<double>").parquet(f"{index.path}/centroids").orderBy("cell").collect()
        index.centroids = np.array([r["centroid"] for r in rows], float).reshape(-1, index.dimension)
        return index

    # --- searching

    def _schema(self) -> T.StructType:
        return T._parse_datatype_string(", ".join([f"`{self.key}` {self.key_type}", "embedding array<float>", *(f"`{c}` {t}" for c, t in self.others.items()), "away double", "cell int"]))

    def rows(self, spark: SparkSession) -> DataFrame:
        """All indexed rows with their cell: the exact search's table."""
        if not self.parts:
            return spark.createDataFrame([], self._schema())
        out = None
        for part in self.parts:
            one = spark.read.schema(self._schema()).option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}")
            out = one if out is None else out.unionByName(one)
        return out

    def order(self, query: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """Cells by their centroid's distance, and those distances by cell."""
        away = np.sqrt(distances(self.centroids, np.array([query], float))[:, 0])
        return np.lexsort((np.arange(len(away)), away)), away

    def nearest(self, spark: SparkSession, query: Sequence[float], k: int = 20, probes: int | None = None, exact: bool = False, where: Column | None = None) -> DataFrame:
        """key, distance (squared), rank of the k nearest rows of the probed cells. Filters use key and others."""
        if len(query) != self.dimension:
            raise ValueError(f"the index has {self.dimension} dimensions")
        rows = self.rows(spark).where(where) if where is not None else self.rows(spark)
        order, away = self.order(query)
        first = order[: probes or self.probes].tolist()

        def best(cells: list[int]) -> DataFrame:
            return rows.where(F.col("cell").isin(cells)).select(self.key, squared_distance(F.col("embedding"), query).alias("distance")).orderBy("distance", self.key).limit(k)

        if exact:
            found = best(first).collect()  # k rows
            bound = math.sqrt(found[-1]["distance"]) * (1 + SLACK) + SLACK if len(found) == k else math.inf
            first = [c for c in order.tolist() if self.sizes[c] and (c in first or away[c] - self.radii[c] <= bound)]
        return best(first).select(self.key, "distance", F.row_number().over(Window.orderBy("distance", self.key)).alias("rank"))

    def nearest_of(self, queries: DataFrame, query_id: str, embedding: str = "embedding", k: int = 20, probes: int | None = None, exact: bool = False, work: str | None = None) -> DataFrame:
        """query, key, distance, rank of the k nearest rows of each query; queries without a fitting vector have no rows.

        With ``exact`` the neighbours found in the probed cells are written to ``work`` (a folder that executors share),
        then the cells that their bounds leave open are searched too.
        """
        spark = queries.sparkSession
        whole = F.forall(embedding, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
        asked = queries.where((F.size(embedding) == self.dimension) & whole).select(F.col(query_id).cast("string").alias("query"), F.col(embedding).cast("array<float>").alias("asked"))
        if not len(self.centroids):
            return spark.createDataFrame([], f"query string, `{self.key}` {self.key_type}, distance double, rank int")
        best = self._in_cells(self._sent(asked, probes or self.probes, 0), k)
        if not exact:
            return _ranked(best, self.key, k)
        if work is None:
            raise ValueError("an exact search of many queries needs a folder to work in")
        _ranked(best, self.key, k).write.parquet(f"{work}/probed")
        probed = spark.read.schema(f"query string, `{self.key}` {self.key_type}, distance double, rank int").parquet(f"{work}/probed")
        last = probed.groupBy("query").agg(F.when(F.count("*") >= k, F.max("distance")).alias("last"))
        more = self._in_cells(self._sent(asked.join(last, "query", "left"), probes or self.probes, 1), k)
        return _ranked(probed.drop("rank").unionByName(more), self.key, k)

    def _sent(self, asked: DataFrame, probes: int, rest: int) -> DataFrame:
        """query, asked, cell: of each query its first cells, or of the rest those whose bound is within ``last`` (null: all)."""
        centroids, radii, sizes, d = self.centroids, np.array(self.radii), np.array(self.sizes), self.dimension

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    x = _matrix(part.column("asked"), d)
                    away = np.sqrt(distances(centroids, x))
                    seat = away.argsort(0, kind="stable").argsort(0)
                    go = (seat < probes) if not rest else (seat >= probes)
                    if rest:
                        last = np.array([math.inf if y is None else math.sqrt(y) * (1 + SLACK) + SLACK for y in part.column("last").to_pylist()])
                        go &= away - radii[:, None] <= last
                    cells, of = np.nonzero(go & (sizes > 0)[:, None])
                    take = pa.array(of)
                    yield pa.RecordBatch.from_arrays([part.column("query").take(take), part.column("asked").take(take), pa.array(cells.astype(np.int32))], names=["query", "asked", "cell"])

        return asked.mapInArrow(send, "query string, asked array<float>, cell int")

    def _in_cells(self, sent: DataFrame, k: int) -> DataFrame:
        """The best k rows of each query in each block of its cells."""
        spark, d, key = sent.sparkSession, self.dimension, self.key
        asks = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        dealt = [(c, -(-self.sizes[c] // BLOCK), -(-n // BLOCK)) for c, n in asks.items()]
        dealt = F.broadcast(spark.createDataFrame(dealt, "cell int, blocks int, groups int"))  # MOST_CELLS rows of three numbers
        part = lambda what, n: F.pmod(F.xxhash64(*what), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = self.rows(spark).where(F.col("cell").isin(list(asks))) if len(asks) < 1000 else self.rows(spark)
        rows = rows.select(key, "embedding", "cell", "away").join(dealt, "cell")
        rows = rows.withColumn("block", part((F.monotonically_increasing_id(),), "blocks")).select(key, "embedding", "cell", "block", each("groups").alias("group"))
        asked = sent.join(dealt, "cell").withColumn("group", part(("query",), "groups")).select("query", "asked", "cell", "group", each("blocks").alias("block"))
        schema = f"query string, `{key}` {self.key_type}, distance double"

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                x = _matrix(left.column("embedding").combine_chunks(), d)
                keys = left.column(key).combine_chunks()
                for at in range(0, right.num_rows, 256):
                    q = _matrix(right.column("asked").slice(at, 256).combine_chunks(), d)
                    best = _block_best(x, keys, None, q, right.column("query").slice(at, 256).combine_chunks(), k, key)
                    out.append(best)
            return pa.Table.from_batches(out) if out else pa.table({"query": pa.array([], pa.string()), key: left.column(key).slice(0, 0), "distance": pa.array([], pa.float64())})

        place = ["cell", "block", "group"]
        return rows.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(meet, schema)


def _block_best(rows: np.ndarray, keys: pa.Array, cells: pa.Array | None, queries: np.ndarray, names, k: int, key: str) -> pa.RecordBatch:
    """Of each query the k nearest rows of a block, exactly and by key in a tie."""
    near = distances(rows, queries)
    margin = 1e-9 * (1 + (rows * rows).sum(1).max(initial=0) + (queries * queries).sum(1))
    cut = np.partition(near, min(k, len(rows)) - 1, axis=0)[min(k, len(rows)) - 1] + margin
    ordinals = np.empty(len(keys), np.int64)
    ordinals[pa.compute.sort_indices(keys).to_numpy()] = np.arange(len(keys))
    at, of, size = [], [], []
    for q in range(len(queries)):
        some = np.flatnonzero(near[:, q] <= cut[q])
        off = rows[some] - queries[q]
        exact = (off * off).sum(1)
        first = np.lexsort((ordinals[some], exact))[:k]
        at.append(some[first])
        of.append(np.full(len(first), q))
        size.append(exact[first])
    at, of, size = (np.concatenate(x) for x in (at, of, size))
    named = pa.array(names) if isinstance(names, np.ndarray) else names
    columns = {"query": named.take(pa.array(of)), key: keys.take(pa.array(at))} | ({} if cells is None else {"cell": cells.take(pa.array(at))})
    return pa.RecordBatch.from_pydict(columns | {"distance": pa.array(size)})


def _ranked(best: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
