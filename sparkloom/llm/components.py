"""Connected components of a table of links, by alternating large and small stars.

Both steps keep the connections and hang nodes under ever smaller ones, until
every node hangs under the smallest of its component. Each step is a minimum
by node, summed up before it is shuffled, and a join that Spark can split, so
a node with very many links is no burden to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fewer, remove, written


def _large(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: u, v. A row for each node but the smallest of its component: node, root.

    Defined cases: no links give no row; links of a node with itself, repeated ones and those with a null end
    connect nothing; other columns are ignored."""
    now, before = written(links.select("u", "v").where("u <> v").distinct(), "links"), None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark[0] == 0 or mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, last = mark, now
        now = written(fewer(_small(_large(last))), "links")
        remove(last)
