"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.plans.lineage import Table, in_few_files


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(edges: DataFrame, name: str = "cc", rows: int | None = None) -> DataFrame:
    """node and component (its least reachable node) of every node that has an edge in edges(a long, b long).

    Each round is written to the shared folder, so a lost executor costs one round at most; only a count and a checksum
    reach the driver. Loops, repeated edges and nulls are dropped; an empty table gives an empty table. rows: about how many
    edges there are at most, where that is known; it and the counts tell how many files a round is worth.
    """
    told = F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    own = Table(in_few_files(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), rows), f"{name}-0")
    state, now, n = None, own.df.agg(*told).first(), 0
    while now != state and now[0]:
        state = now
        n += 1
        following = Table(in_few_files(_small_star(_large_star(own.df).distinct()).distinct(), 2 * now[0]), f"{name}-{n}")
        own.drop()
        own = following
        now = own.df.agg(*told).first()
    roots = own.df.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return own.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
