"""Discovery of governed Markdown files, as records and issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import is_stem

CORPUS_ROOT = "doc"
PACKAGES = ".lodestone/packages"


def files(spark: SparkSession, roots: Sequence[str], recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of all files below the roots."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(list(roots))


def ignored(path: Column, exclusions: Sequence[str]) -> Column:
    """Whether a path is, or lies below, one of the exclusions."""
    out = F.lit(False)
    for e in exclusions:
        e = e.rstrip("/")
        out = out | path.endswith("/" + e.lstrip("/")) | path.contains("/" + e.lstrip("/") + "/")
    return out


def path_order(path: Column) -> Column:
    """Paths in order of their components, not of their characters."""
    return F.split(path, "/")


def with_names(df: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    package = F.regexp_extract("path", rf"/{PACKAGES.replace('.', chr(92) + '.')}/([^/]+)/doc/", 1)
    return df.withColumns({
        "file_name": name,
        "extension": F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1)),
        "document_stem": F.regexp_replace(name, r"\.[^.]*\z", ""),
        "package": F.when(package != "", package),
    })


def discover(spark: SparkSession, workspace: str, packages: Sequence[str] = (), exclusions: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(records, issues): governed documents of the workspace and its packages with their content and hash.

    A missing workspace root is an error, a missing package root an issue. Content that isn't UTF-8 is an issue.
    """
    records = files(spark, [f"{workspace}/{CORPUS_ROOT}"])
    missing = []
    for p in sorted(packages):
        root = f"{workspace}/{PACKAGES}/{p}/doc"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            records = records.unionByName(files(spark, [root]))
        else:
            missing.append((p, root))
    found = with_names(records).where(F.col("extension").isin("md", "markdown"))
    if exclusions:
        found = found.where(~ignored(F.col("path"), exclusions))
    kind = F.when(~is_stem(F.col("document_stem")), "invalid_stem").when(~F.is_valid_utf8(F.col("content").cast("string")), "encoding")
    judged = found.withColumn("kind", kind)
    good = judged.where("kind is null").select("package", "document_stem", "path", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("document_hash"), F.lit("sha256").alias("hash_algo"), "content")
    issues = judged.where("kind is not null").select("kind", "package", "path", F.col("document_stem").alias("stem"))
    gone = spark.createDataFrame([("missing_package", p, r, None) for p, r in missing], "kind string, package string, path string, stem string")
    return good, issues.unionByName(gone)


def ordered_records(records: DataFrame) -> DataFrame:
    return records.orderBy(F.asc_nulls_first("package"), "document_stem", path_order(F.col("path")))


def ordered_issues(issues: DataFrame) -> DataFrame:
    return issues.orderBy("kind", F.asc_nulls_first("package"), path_order(F.col("path")), "stem")


def file_suggestions(df: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Files whose name holds the query, the first ten by path."""
    return with_names(df).where(F.col("file_name").contains(query)).orderBy(path_order(F.col("path"))).select("path").limit(limit)
