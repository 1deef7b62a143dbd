"""Document fingerprints by winnowing, as DataFrame expressions only.

A text's symbols are its runs of non-blank characters, cut after ``PIECE`` characters; each k-gram
of symbols gets a rolling (cyclic polynomial) hash; from every window of w successive k-grams the
least hash is chosen, on ties the rightmost. So any run of w + k - 1 symbols that two texts share
gives them a common fingerprint.

A fingerprint is an array of longs: 38 bits of hash, then 25 bits that hold 2**25 - 1 less the
position (so that the least long is the least hash with the rightmost position). Positions count
symbols; beyond 2**25 symbols of one text (some 100 MB) they start from 0 again.

Defined cases: a null text is the empty text; texts without symbols have an empty fingerprint,
equal to each other's (likeness 1) and unlike all others (0); texts with fewer than k symbols have
one hash over all of them. Equal texts have equal fingerprints, whatever row they are in. Rows with
a null id have no place in the order: their next document counts as empty. Of rows that share an
id, the order is that of their texts. Other columns are left out. An empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import let, shared_dir, stored

K, WINDOW, PIECE = 5, 4, 16
POSITION_BITS = 25
#: Ids of a bucket within which the next document is found.
BUCKET_BITS = 6


def _rotated(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def _packed(value: Column, position: Column) -> Column:
    last = (1 << POSITION_BITS) - 1
    return F.shiftleft(F.shiftrightunsigned(value, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(F.lit(last) - position.cast("long").bitwiseAND(F.lit(last)))


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<long>: the chosen k-grams of a text, in order of position."""

    def grams(h: Column) -> Column:
        gram = lambda i: reduce(lambda a, b: a.bitwiseXOR(b), [_rotated(F.get(h, i + j), k - 1 - j) for j in range(k)])
        short = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: _rotated(a, 1).bitwiseXOR(x))
        return (
            F.when(F.size(h) == 0, F.array().cast("array<long>"))
            .when(F.size(h) < k, F.array(_packed(short, F.lit(0))))
            .otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: _packed(gram(i), i)))
        )

    def chosen(g: Column) -> Column:
        windows = F.sequence(F.lit(1), F.size(g) - (window - 1))
        return (
            F.when(F.size(g) == 0, g)
            .when(F.size(g) <= window, F.array(F.array_min(g)))
            .otherwise(F.array_distinct(F.transform(windows, lambda i: F.array_min(F.slice(g, i, window)))))
        )

    symbols = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\S{{1,{PIECE}}}"), F.lit(0))
    return let(F.transform(symbols, lambda s: F.xxhash64(s)), lambda h: let(grams(h), chosen))


def hashes(chosen: Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftrightunsigned(x, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole == 0, F.lit(1.0)).otherwise(both / whole)


def cyclic_successors(keys: DataFrame, col: str) -> DataFrame:
    """col, following: each distinct non-null long with the next larger one; after the largest comes the smallest.

    Found within ranges, as many as there are shuffle partitions, however the keys lie; only one row a range meets in
    one task. The ranges are a table, so that all uses see the same.
    """
    spark = keys.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = keys.select(F.col(col).alias("k")).where("k is not null").distinct()
    dealt = every.repartitionByRange(ranges, "k").select("k", F.spark_partition_id().alias("b"))
    block = stored(dealt, f"{shared_dir(spark)}/ranges", files=0)
    inner = block.withColumn("n", F.lead("k").over(Window.partitionBy("b").orderBy("k")))
    tops = block.groupBy("b").agg(F.min("k").alias("t"))
    order = Window.orderBy("b")
    tops = tops.select("b", F.coalesce(F.lead("t").over(order), F.first("t").over(order)).alias("t"))
    return inner.join(tops, "b").select(F.col("k").alias(col), F.coalesce("n", "t").alias("following"))


def fingerprints_beside_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, edited, fingerprint, edited_fingerprint, next_fingerprint.

    ``edited``: the last floor(n / 2) code points replaced by the first as many of the next
    document's. Texts move once, to buckets of neighbouring ids.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    bucket = F.shiftright("doc_id", BUCKET_BITS)
    # rows without an id go to buckets below all others, spread by their texts
    apart = F.lit(-(1 << 60)) - F.pmod(F.xxhash64("text"), F.lit(4096))
    dealt = docs.withColumn("bucket", F.coalesce(bucket, apart)).repartition("bucket")
    after = cyclic_successors(docs.select(bucket.alias("bucket")), "bucket")
    # no filter here: it would go below the exchange, and the texts would move twice; rows without an id have buckets that ``after`` lacks
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("f"))
    borders = after.join(firsts.select(F.col("bucket").alias("following"), F.col("f.text").alias("border")), "following").select("bucket", "border")
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    marked = dealt.withColumn("fingerprint", fingerprint(F.col("text"))).withColumns(
        {"has_next": F.lead(F.lit(1)).over(order), "lead_text": F.lead("text").over(order), "lead_fingerprint": F.lead("fingerprint").over(order)}
    )
    joined = marked.join(borders, "bucket", "left")
    named = F.col("doc_id").isNotNull()
    inside = named & F.col("has_next").isNotNull()
    following = F.when(inside, F.col("lead_text")).when(named, F.col("border")).otherwise("")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring(following, F.lit(1), half))
    return joined.select(
        "doc_id", "text", edited.alias("edited"), "fingerprint",
        F.when(inside, F.col("lead_fingerprint")).otherwise(fingerprint(following)).alias("next_fingerprint"),
    ).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
