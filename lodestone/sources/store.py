"""The chunk store: Parquet tables in buckets of documents, swapped by a pointer file. One writer at a time.

A document's chunks lie in the bucket of its name's hash. A change writes the buckets that it touches as a new version;
the pointer names each bucket's version, so the others stay as they are. It also lists the segments of the text index
(``text_index.TextIndex``), to which a change adds one: a lexical query opens its terms' folders and, of their blocks, those that
may hold a result. ``index_vectors`` makes a vector index of the chunks as they are; buckets that changed since are scanned beside it
until the next one. The number of buckets is fixed when a store is made: a large corpus takes thousands.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.retrieval import SEMANTIC_LIMIT, semantic_topk, squared_distance
from lodestone.sources.text_index import TextIndex
from lodestone.sources.vector_index import VectorIndex

SCHEMA_VERSION = 3
BUCKETS = 16
SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("package", T.StringType()),
        T.StructField("document_stem", T.StringType(), False),
        T.StructField("document_hash", T.StringType(), False),
        T.StructField("chunk_hash", T.StringType(), False),
        T.StructField("chunk_ordinal", T.IntegerType(), False),
        T.StructField("heading_path", T.ArrayType(T.StringType()), False),
        T.StructField("frontmatter", T.StringType()),
        T.StructField("text", T.StringType(), False),
        T.StructField("search_text", T.StringType(), False),
        T.StructField("token_count", T.IntegerType(), False),
        T.StructField("embedding_model", T.StringType(), False),
        T.StructField("embedding_dimension", T.IntegerType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), False),
    ]
)


def _name() -> Column:
    """A chunk's name in the text index: unique though packages may have equal chunk ids, in the order of the ids."""
    return F.expr(r"concat(chunk_id, '\u0000', coalesce(package, ''))")


_BUCKET = T.StructField("bucket", T.IntegerType())


class IncompatibleStore(ValueError):
    pass


class MissingStore(ValueError):
    pass


class StoreConflict(RuntimeError):
    """Two writers replaced one version."""


class Store:
    """A store at a path that Spark's file systems reach: of its numbered pointers pointer-N.json the greatest names each bucket's version.

    ``buckets`` is for a store that isn't there yet; later its own number counts.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, dimension: int, buckets: int = BUCKETS):
        if not model.strip() or dimension <= 0 or buckets <= 0:
            raise ValueError("a store needs a model name, a positive dimension and a positive number of buckets")
        self.buckets = buckets
        self.spark, self.path, self.model, self.dimension = spark, path.rstrip("/"), model, dimension

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _pointers(self) -> list[str]:
        """Pointers by number; a pointer is never changed."""
        fs, path = self._fs("")
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(n for n in names if n.startswith("pointer-") and n.endswith(".json"))

    def _read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def _meta(self) -> dict | None:
        names = self._pointers()
        return self._read(names[-1]) if names else None

    def _point(self, parts: dict, segments: list[dict], vectors: dict | None = None) -> None:
        """A rename to a name that isn't there yet: a crash before it leaves the old pointer, and of two writers one fails."""
        names = self._pointers()
        number = int(names[-1][8:-5]) + 1 if names else 0
        fs, path = self._fs(f"pointer-{number:012d}.json")
        staged = self._fs(f"staged-{uuid.uuid4().hex}.json")[1]
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps({"schema_version": SCHEMA_VERSION, "model": self.model, "dimension": self.dimension, "buckets": self._buckets(), "parts": parts, "segments": segments, "vectors": vectors}).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(staged, path):
            fs.delete(staged, False)
            raise StoreConflict(f"another writer was first at {path.getName()}")

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest ``keep`` pointers and delete versions that only the others name; how many pointers went.

        Readers of older ones must be done.
        """
        names = self._pointers()
        old = names[: max(0, len(names) - max(1, keep))]
        read = {n: self._read(n) for n in names}
        folders = lambda n: {p["version"] for p in read[n]["parts"].values()} | ({read[n]["vectors"]["name"]} if read[n]["vectors"] else set())
        kept = names[len(old) :]
        stay = set().union(*map(folders, kept))
        self._terms().vacuum([read[n]["segments"] for n in old], [read[n]["segments"] for n in kept])
        for name in old:
            for gone in [*(folders(name) - stay), name]:
                fs, path = self._fs(gone)
                fs.delete(path, True)
        return len(old)

    def ensure(self) -> None:
        """Create the store if it isn't there; otherwise its form, model and dimension must be ours."""
        meta = self._meta()
        if meta is None:
            self._point({}, [])
        elif (meta["schema_version"], meta["model"], meta["dimension"]) != (SCHEMA_VERSION, self.model, self.dimension):
            raise IncompatibleStore(f"the store holds {meta['model']} in {meta['dimension']} dimensions, form {meta['schema_version']}")

    def exists(self) -> bool:
        return self._meta() is not None

    def _buckets(self) -> int:
        meta = self._meta()
        return meta["buckets"] if meta else self.buckets

    def _there(self) -> dict:
        meta = self._meta()
        if meta is None:
            raise MissingStore(self.path)
        return meta

    def _parts(self) -> dict:
        return self._there()["parts"]

    def _terms(self) -> TextIndex:
        return TextIndex(self.spark, f"{self.path}/terms", ["package", "document_stem"], self._buckets())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("package", "document_stem"), F.lit(self._buckets())).cast("int")

    def _table(self, kind: str, schema: T.StructType, only: set[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/{p['version']}/{kind}/bucket={b}" for b, p in self._parts().items() if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, only: set[str] | None = None) -> DataFrame:
        """All chunks, or those of some buckets."""
        return self._table("chunks", SCHEMA, only)

    def text_index(self) -> tuple[DataFrame, int, float]:
        """postings(term, chunk_id, package, document_stem, tf, length) of the search texts, number of chunks, their mean length."""
        segments = self._there()["segments"]
        listed = self._terms().postings(segments)
        return listed.select("term", F.split_part("key", F.lit("\0"), F.lit(1)).alias("chunk_id"), "package", "document_stem", "tf", "length"), *TextIndex.size(segments)

    def lexical(self, terms: list[str], k: int, where: Column | None = None) -> DataFrame:
        """chunk_id, lexical_rank, score of the k best chunks; ``where`` may use package and document_stem."""
        best = self._terms().topk(self._there()["segments"], terms, k, where)
        return best.select(F.split_part("key", F.lit("\0"), F.lit(1)).alias("chunk_id"), "lexical_rank", "score")

    def index_vectors(self) -> VectorIndex:
        """Index the embeddings of all chunks as they are now."""
        meta = self._there()
        rows = self.rows().withColumn("bucket", self._bucket())
        name = f"vectors-{uuid.uuid4().hex}"
        index = VectorIndex.build(rows, f"{self.path}/{name}", "chunk_id", others=["package", "document_stem", "bucket"])
        self._point(meta["parts"], meta["segments"], {"name": name, "versions": {b: p["version"] for b, p in meta["parts"].items()}})
        return index

    def semantic(self, query: list[float], k: int = SEMANTIC_LIMIT, where: Column | None = None) -> DataFrame:
        """chunk_id, semantic_rank of the k nearest chunks: by the vector index in the buckets that are as it saw them, by a scan in the others."""
        meta = self._there()
        indexed = meta["vectors"] or {"versions": {}}
        same = [b for b, p in meta["parts"].items() if indexed["versions"].get(b) == p["version"]]
        others = self.rows(set(meta["parts"]) - set(same))
        if not same:
            return semantic_topk(others, query, "chunk_id", k=k, where=where)
        fresh = F.col("bucket").isin([int(b) for b in same])
        index = VectorIndex.open(self.spark, f"{self.path}/{indexed['name']}")
        near = index.nearest(self.spark, query, k, where=fresh if where is None else fresh & where).select("chunk_id", "distance")
        others = others.where(where) if where is not None else others
        near = near.union(others.select("chunk_id", squared_distance(F.col("embedding"), query).alias("distance")).orderBy("distance", "chunk_id").limit(k)) if len(same) < len(meta["parts"]) else near
        near = near.orderBy("distance", "chunk_id").limit(k)
        return near.select("chunk_id", F.row_number().over(Window.orderBy("distance", "chunk_id")).alias("semantic_rank"))

    def _write(self, rows: DataFrame) -> dict:
        """Write rows as a version of their buckets: what the pointer has to say of each. A bucket may take several files and tasks."""
        version = f"version-{uuid.uuid4().hex}"
        checked = F.when(F.size("embedding") == self.dimension, F.col("embedding")).otherwise(F.raise_error(F.lit("an embedding has another dimension")).cast("array<float>"))
        fixed = rows.select(*(checked.alias("embedding") if f.name == "embedding" else F.col(f.name).cast(f.dataType) for f in SCHEMA))
        fixed.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{version}/chunks")
        chunks = self.spark.read.schema(T.StructType([*SCHEMA.fields, _BUCKET])).parquet(f"{self.path}/{version}/chunks")
        sums = chunks.groupBy("bucket").agg(F.count("*").alias("n"))
        return {str(r["bucket"]): {"version": version, "n": r["n"]} for r in sums.collect()}  # one row a bucket

    def replace(self, rows: DataFrame) -> None:
        """Write all rows as new versions, then point at them: readers see the old ones or the new ones."""
        parts = self._write(rows)
        self._point(parts, self._terms().added([], self._chunks(parts), "name", "search_text"))

    def merge(self, gone: DataFrame, rows: DataFrame) -> None:
        """Delete the chunks of the documents gone(package, document_stem) and add rows; only their buckets are written."""
        meta = self._there()
        parts = meta["parts"]
        names = gone.select("package", "document_stem").unionByName(rows.select("package", "document_stem"))
        touched = {str(r["bucket"]) for r in names.select(self._bucket().alias("bucket")).distinct().collect()}  # numbers of buckets
        if not touched:
            return
        old = self.rows(touched)
        same = old["package"].eqNullSafe(gone["package"]) & (old["document_stem"] == gone["document_stem"])
        written = self._write(old.join(gone, same, "left_anti").select(*SCHEMA.names).unionByName(rows.select(*SCHEMA.names)))
        # chunks that were there before and are there still keep their postings: only what came or went makes the segment
        before, after = self._named(old), self._chunks(written)
        came, went = after.exceptAll(before), before.exceptAll(after)
        segments = self._terms().added(meta["segments"], came, "name", "search_text", went.select("name"))
        self._point({b: p for b, p in parts.items() if b not in touched} | written, segments, meta["vectors"])

    def _chunks(self, parts: dict) -> DataFrame:
        """What the text index takes of the buckets that were just written."""
        paths = [f"{self.path}/{p['version']}/chunks/bucket={b}" for b, p in parts.items()]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return self._named(rows)

    @staticmethod
    def _named(rows: DataFrame) -> DataFrame:
        return rows.select(_name().alias("name"), "search_text", "package", "document_stem")

    def documents(self) -> DataFrame:
        return self.rows().select("package", "document_stem").distinct()

    def _document(self, package: str | None, stem: str) -> DataFrame:
        """A document's chunks, looked for in its bucket only."""
        name = self.spark.createDataFrame([(package, stem)], "package string, document_stem string")
        bucket = str(name.select(self._bucket()).first()[0])
        return self.rows({bucket}).where(F.col("package").eqNullSafe(F.lit(package)) & (F.col("document_stem") == stem))

    def is_indexed(self, package: str | None, stem: str, digest: str) -> bool:
        return self.exists() and not self._document(package, stem).where(F.col("document_hash") == digest).isEmpty()

    def delete_document(self, package: str | None, stem: str) -> int:
        """Delete a document's chunks; how many there were."""
        if not self.exists():
            return 0
        mine = self._document(package, stem)
        n = mine.count()
        if n:
            self.merge(mine.select("package", "document_stem").distinct(), self.spark.createDataFrame([], SCHEMA))
        return n
