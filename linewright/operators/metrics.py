"""Scores of clusterings and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions.text import tokens
from linewright.operators.blocks import Vectors, class_sums
from linewright.operators.distances import mirrored


def silhouette(pairs: DataFrame | Vectors, labels: DataFrame, by: str = "log_id") -> DataFrame:
    """Mean silhouette of each log; 0 for the only member of a cluster; null where there is one cluster, or n of n."""
    sized = labels.groupBy(by, "cluster").agg(F.count(F.lit(1)).alias("size"))
    own = labels.join(sized, [by, "cluster"])
    to = own.select(by, F.col("line_id").alias("j"), F.col("cluster").alias("other"), F.col("size").alias("other_size"))
    if isinstance(pairs, Vectors):
        labelled = pairs.features.select(by, "line_id", pairs.vector).join(labels.select(by, "line_id", "cluster"), [by, "line_id"])
        sums = class_sums(Vectors(labelled, pairs.vector, pairs.metric, by), "cluster").join(sized.select(by, F.col("cluster").alias("other"), F.col("size").alias("other_size")), [by, "other"])
    else:
        sums = mirrored(pairs.select(by, "i", "j", "d"), by).join(to, [by, "j"]).groupBy(by, "i", "other", "other_size").agg(F.sum("d").alias("s"))
    mine = own.select(by, F.col("line_id").alias("i"), "cluster", "size").join(sums, [by, "i"], "left")
    each = mine.groupBy(by, "i", "size").agg(
        F.sum(F.when(F.col("other") == F.col("cluster"), F.col("s"))).alias("inner"),
        F.min(F.when(F.col("other") != F.col("cluster"), F.col("s") / F.col("other_size"))).alias("b"),
    )
    a = F.coalesce("inner", F.lit(0.0)) / F.greatest(F.col("size") - 1, F.lit(1))
    top = F.greatest(a, F.col("b"))
    s = F.when(F.col("size") == 1, 0.0).when(top == 0, 0.0).otherwise((F.col("b") - a) / top)
    out = each.select(by, s.alias("s")).groupBy(by).agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))
    k = labels.groupBy(by).agg(F.count_distinct("cluster").alias("k"))
    return out.join(k, by).select(by, "k", F.when((F.col("k") > 1) & (F.col("k") < F.col("n")), F.col("silhouette")).alias("silhouette"))


def adjusted_rand(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Adjusted Rand index of two labellings within each group; 1 where both put everything, or nothing, together."""
    cells = df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: c * (c - 1) / 2
    both = cells.groupBy(*by).agg(F.sum(two(F.col("n"))).alias("index"), F.sum("n").alias("total"))
    left = cells.groupBy(*by, a).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two(F.col("n"))).alias("sa"))
    right = cells.groupBy(*by, b).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two(F.col("n"))).alias("sb"))
    if by:
        joined = both.join(left, by).join(right, by)
    else:
        joined = both.crossJoin(left).crossJoin(right)  # one row each
    expected = F.when(F.col("total") > 1, F.col("sa") * F.col("sb") / two(F.col("total"))).otherwise(0.0)
    most = (F.col("sa") + F.col("sb")) / 2
    return joined.select(*by, F.when(most == expected, 1.0).otherwise((F.col("index") - expected) / (most - expected)).alias("ari"))


def rouge1(candidate: Column, reference: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F of the sets of tokens."""
    a, b = F.array_distinct(tokens(candidate)), F.array_distinct(tokens(reference))
    same = F.size(F.array_intersect(a, b)).cast("double")
    p = F.when(F.size(a) > 0, same / F.size(a)).otherwise(0.0)
    r = F.when(F.size(b) > 0, same / F.size(b)).otherwise(0.0)
    return p, r, F.when(same > 0, 2 * p * r / (p + r)).otherwise(0.0)


def best_rouge(candidates: DataFrame, references: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the alternative with the highest F: its precision, recall and F."""
    p, r, f = rouge1(F.col("candidate"), F.col("reference"))
    scored = candidates.join(references, key).select(*key, F.struct(f.alias("f"), p.alias("p"), r.alias("r")).alias("x"))
    return scored.groupBy(*key).agg(F.max("x").alias("x")).select(*key, F.col("x.p").alias("p"), F.col("x.r").alias("r"), F.col("x.f").alias("f"))


def cluster_members(df: DataFrame, by: str = "log_id") -> DataFrame:
    """Members of each cluster but noise, in order."""
    one = df.where("cluster <> -1").groupBy(by, "cluster").agg(F.array_sort(F.collect_list("line_id")).alias("members"))
    return one.select(by, "cluster", F.size("members").cast("long").alias("n"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def cluster_summary(df: DataFrame, by: str = "log_id") -> DataFrame:
    """Clusters (noise left out), lines and outliers of each log."""
    return df.groupBy(by).agg(
        F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"), F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("cluster") == -1).alias("n_outliers")
    )


#: Ranges of values that are counted at a time while a quantile is narrowed down.
RANGES = 512


def exact_quantile(df: DataFrame, value: str, q: float) -> float | None:
    """The interpolated quantile of all rows' values; None without values.

    Counts of RANGES ranges reach the driver at a time, and the range that holds the rank is divided again, until it is
    one value: no task gathers the values.
    """
    v = F.col(value).cast("double")
    low, high, n = df.agg(F.min(v), F.max(v), F.count(v)).first()
    if not n:
        return None

    def at(rank: int) -> float:
        a, b, before = low, high, 0
        while a < b:
            width = (b - a) / RANGES
            cell = F.least(F.floor((v - a) / width), F.lit(RANGES - 1)) if width else F.when(v > a, 1).otherwise(0)
            cells = df.where(v.between(a, b)).groupBy(cell.alias("cell")).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("cell").collect()
            for r in cells:
                if before + r["n"] > rank:
                    a, b = r["low"], r["high"]
                    break
                before += r["n"]
        return a

    place = q * (n - 1)
    lower, upper = at(math.floor(place)), at(math.ceil(place))
    return lower + (upper - lower) * (place - math.floor(place))


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles (interpolated) and largest, of each group or of all rows."""
    v = F.col(value).cast("double")
    quarters = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found = {c: F.percentile(v, F.lit(q)) if by else F.lit(exact_quantile(df, value, q)).cast("double") for c, q in quarters.items()}
    return df.groupBy(*(by or [])).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), *[x.alias(c) for c, x in found.items()], F.max(v).alias("max"),
    )


def best_per_key(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row of each key with the highest score; ties go to the least `tie`."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), tie)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def extremes(df: DataFrame, key: str, value: str) -> DataFrame:
    """The keys with the least, the largest and the most median value; ties go to the least key."""
    middle = F.lit(exact_quantile(df, value, 0.5))
    return df.agg(
        F.min(F.struct(value, key))[key].alias("at_min"), F.min(F.struct((-F.col(value)).alias("v"), key))[key].alias("at_max"),
        F.min(F.struct(F.abs(F.col(value) - middle).alias("v"), key))[key].alias("at_median"),
    )


def conditional_score(df: DataFrame) -> DataFrame:
    """The silhouette, or the adjusted Rand index where k is -1."""
    return df.withColumn("score", F.when(F.col("k") != -1, F.col("silhouette")).otherwise(F.col("ari")))
