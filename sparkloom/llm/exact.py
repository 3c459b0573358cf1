"""Exact deduplication by distributed radix partitioning, most significant bytes first.

Documents are split by their successive bytes, a digit of several bytes at a
time and wider in each round, until a group has one document or its text has
ended. Only groups of two and more go on, so distinct texts leave early, and
what a round decides is written out at once. Bytes are compared themselves;
no digest decides about equality. A group is never brought together: each
round counts groups with partial sums and joins the counts of those with two
and more back, a join whose large keys Spark can split.

Defined cases: a null text is an empty one; texts of any length are compared
to their last byte (the longest decides how many rounds there are); of equal
texts the smallest doc_id stays, so there are no ties but among rows that
repeat an id; runs of white space count as one
space; a null doc_id comes after all others, so a group of nulls only has no
keep_id and keeps none; rows that repeat an id and its text are all kept or
all dropped, and each counts in group_size; an empty table gives no row;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fewer, free, remove, written

#: Bytes of the first digit, and how much wider each next one is.
FIRST, WIDER = 48, 6
#: Groups that go on are broadcast up to this size, and joined by a shuffle beyond it.
BROADCAST_BYTES = 32 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, first: int = FIRST, wider: int = WIDER) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256 (only a result, not compared)."""
    base = docs.select("doc_id", F.encode(normalised(F.col("text")), "UTF-8").alias("rest"))

    def digits(rows: DataFrame, width: int, *also: str | Column) -> DataFrame:
        """The next digit of each row and whether its text ends within it."""
        return rows.select("doc_id", "parent", F.substring("rest", 1, width).alias("digit"), (F.length("rest") < width).alias("ended"), *also)

    spark = docs.sparkSession
    start = base.withColumn("parent", F.lit(0).cast("long"))
    hashed = F.sha2("rest", 256).alias("text_sha256")
    rows = written(digits(start, first, hashed), "radix-rows")  # digits only: most texts are not needed again
    found, keys, width, texts = None, ["parent", "digit", "ended"], first, digits(start, first, "rest")
    while True:
        groups = rows.groupBy(*keys).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
        groups = written(fewer(groups).withColumn("group", F.monotonically_increasing_id()), "radix-groups")
        placed = rows.join(groups, keys, "left").where("ended OR group IS NULL")
        alone = F.col("group").isNull()
        placed = placed.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(alone, F.lit(1).cast("long")).otherwise(F.col("group_size")).alias("group_size"), "text_sha256")
        placed = written(fewer(placed), "radix-decided")
        found = placed if found is None else found.unionByName(placed)
        more = groups.where("NOT ended").select(*keys, "group")
        n = more.count()
        if n:
            if n * (width + 64) <= BROADCAST_BYTES:
                more = F.broadcast(more)
            left = texts.join(more, keys).select("doc_id", F.col("group").alias("parent"), *([hashed] if width == first else ["text_sha256"]), F.expr(f"substring(rest, {width + 1})").alias("rest"))
            width *= wider
            texts, done = written(digits(left, width, "text_sha256", "rest"), "radix-rows"), rows
            rows = texts
            remove(done, groups)
            free(spark)
        else:
            remove(rows, groups)
            break
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_groups() keeps, all columns."""
    kept = exact_groups(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
