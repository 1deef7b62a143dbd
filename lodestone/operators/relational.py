"""Set and merge operators of the store: stale, unchanged and changed documents, reuse, merge, summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality that takes nulls as equal, on every key."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def stale(stored: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows that are no longer found."""
    return stored.join(found, null_safe(stored, found, keys), "left_anti")


def unchanged(found: DataFrame, stored: DataFrame, keys: Sequence[str], hash_col: str) -> DataFrame:
    return found.join(stored, null_safe(found, stored, [*keys, hash_col]), "left_semi")


def changed(found: DataFrame, stored: DataFrame, keys: Sequence[str], hash_col: str) -> DataFrame:
    """New rows and those with another hash."""
    return found.join(stored, null_safe(found, stored, [*keys, hash_col]), "left_anti")


def reuse(chunks: DataFrame, stored: DataFrame, keys: Sequence[str], embedding: str = "embedding") -> DataFrame:
    """chunks with the stored embedding of the same keys, null where it must be computed."""
    known = stored.dropDuplicates(list(keys)).select(*keys, embedding)
    right = known.select(*(F.col(k).alias(f"__{k}") for k in keys), embedding)
    on = reduce(lambda a, b: a & b, (chunks[k].eqNullSafe(right[f"__{k}"]) for k in keys))
    return chunks.join(right, on, "left").drop(*(f"__{k}" for k in keys))


def merged(old: DataFrame, new: DataFrame, key: str, document: Sequence[str]) -> DataFrame:
    """old with new rows upserted by key; old rows of documents in new that new lacks are deleted."""
    touched = new.select(*document).distinct()
    keep = old.join(touched, null_safe(old, touched, document), "left_anti").join(new.select(key), key, "left_anti")
    return keep.select(*old.columns).unionByName(new.select(*old.columns))


def merge_counts(old: DataFrame, new: DataFrame, key: str, document: Sequence[str]) -> DataFrame:
    """One row: inserted, updated, deleted of ``merged``."""
    touched = new.select(*document).distinct()
    mine = old.join(touched, null_safe(old, touched, document), "left_semi").select(key, F.lit(1).alias("o"))
    both = mine.join(new.select(key, F.lit(1).alias("n")), key, "full_outer")
    here, there = F.col("o").isNotNull(), F.col("n").isNotNull()
    return both.agg(F.count_if(~here).alias("inserted"), F.count_if(here & there).alias("updated"), F.count_if(~there).alias("deleted"))


def summary(actions: DataFrame) -> DataFrame:
    """One row of counts over actions(action)."""
    return actions.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("skipped", "reindexed", "deleted", "failed")))
