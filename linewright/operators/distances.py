"""Distances between the lines of one log, as pairs (log_id, i, j) with i < j: a self-join on the log, never a cross join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions.vectors import dot, norm, scale
from linewright.operators import blocks
from linewright.plans.lineage import materialize


def pairs(df: DataFrame, columns: list[str], key: str = "line_id", by: str = "log_id") -> DataFrame:
    """Pairs of rows of a group, with each column once as a_<name> and once as b_<name>."""
    side = lambda s: df.select(F.col(by), *[F.col(c).alias(f"{s}_{c}") for c in [key, *columns]])
    out = side("a").join(side("b"), by).where(F.col(f"a_{key}") < F.col(f"b_{key}"))
    return out.withColumnRenamed(f"a_{key}", "i").withColumnRenamed(f"b_{key}", "j")


def hashed_sets(df: DataFrame, *columns: str) -> DataFrame:
    """df with each array of strings as the set of its values' 64-bit hashes, which are quicker to send and to compare."""
    return df.withColumns({c: F.array_distinct(F.transform(c, lambda x: F.xxhash64(x))) for c in columns})


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """1 - |a and b| / |a or b| of two sets (arrays without repeats); two empty ones are `empty` apart."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(empty)).otherwise(1 - both / union)


def jaccard_by_index(df: DataFrame, values: str, key: str = "line_id", by: str = "log_id") -> DataFrame:
    """Pairs with a value in common and their Jaccard distance, through an inverted index; all other pairs are 1 apart."""
    each = df.select(by, key, F.size(F.array_distinct(values)).alias("n"), F.explode(F.array_distinct(values)).alias("v"))
    met = each.alias("a").join(each.alias("b"), (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.v") == F.col("b.v"))).where(F.col(f"a.{key}") < F.col(f"b.{key}"))
    same = met.groupBy(F.col(f"a.{by}").alias(by), F.col(f"a.{key}").alias("i"), F.col(f"b.{key}").alias("j"), F.col("a.n").alias("m"), F.col("b.n").alias("n")).agg(F.count(F.lit(1)).alias("both"))
    return same.select(by, "i", "j", (1 - F.col("both") / (F.col("m") + F.col("n") - F.col("both"))).alias("d"))


def cosine(a: Column, b: Column, na: Column, nb: Column, halved: bool = True) -> Column:
    """1 - cosine, halved to lie in [0, 1]; a zero vector is 1 (halved: 0.5) away from everything."""
    d = F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - dot(a, b) / (na * nb))
    return d / 2 if halved else d


def cosine_pairs(df: DataFrame, vector: str, key: str, by: str, halved: bool = True) -> DataFrame:
    normed = df.withColumn("norm", norm(F.col(vector)))
    p = pairs(normed, [vector, "norm"], key, by)
    return p.select(by, "i", "j", cosine(F.col(f"a_{vector}"), F.col(f"b_{vector}"), F.col("a_norm"), F.col("b_norm"), halved).alias("d"))


def euclidean_pairs(df: DataFrame, vector: str, key: str, by: str) -> DataFrame:
    """Euclidean distances between 0 (the least, a line's own) and 1 (the log's largest), in blocks: one pass for the largest, one for the pairs."""
    v = blocks.Vectors(df.select(by, F.col(key).alias("line_id"), vector), vector, "euclid", by)
    return blocks.pairs_within(v, top=materialize(blocks.largest(v), "largest-distances"))


def late_interaction(tokens: DataFrame, by: str = "log_id", key: str = "line_id", vector: str = "vec") -> DataFrame:
    """For ordered pairs of lines: mean over i's vectors of the largest dot product with j's, turned round and scaled to [0, 1]."""
    best = blocks.best_products(tokens.select(by, F.col(key).alias("line"), F.col("token").alias("line_id"), F.col(vector).alias("vec")), "line", by)
    sim = materialize(best.groupBy(by, F.col("line").alias("i"), F.col("other").alias("j")).agg(F.avg("best").alias("sim")), "late-interaction")
    ends = sim.groupBy(by).agg(F.max("sim").alias("high"), F.min("sim").alias("low"))
    return sim.where("i <> j").join(ends, by).select(by, "i", "j", scale(F.col("high") - F.col("sim"), F.lit(0.0), F.col("high") - F.col("low")).alias("d"))


def line_pairs(df: DataFrame, relative: bool = False, key: str = "line_id", by: str = "log_id") -> DataFrame:
    """|i - j| over the log's largest: of places (n - 1 in closed form), or of line numbers."""
    if not relative:
        sized = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
        place = df.select(by, F.col(key), (F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1).alias("place"))
        p = pairs(place, ["place"], key, by).join(sized, by)
        return p.select(by, "i", "j", ((F.col("b_place") - F.col("a_place")) / (F.col("n") - 1)).alias("d"))
    ends = df.groupBy(by).agg(F.min("line_num").alias("low"), F.max("line_num").alias("high"))
    p = pairs(df, ["line_num"], key, by).join(ends, by)
    return p.select(by, "i", "j", scale(F.abs(F.col("b_line_num") - F.col("a_line_num")).cast("double"), F.lit(0.0), (F.col("high") - F.col("low")).cast("double")).alias("d"))


#: Distances of vectors by name.
VECTOR_DISTANCES: dict[str, Callable[..., DataFrame]] = {"cosine": cosine_pairs, "euclid": euclidean_pairs}


def vector_distance(name: str) -> Callable[..., DataFrame]:
    if name not in VECTOR_DISTANCES:
        raise ValueError(f"no distance named {name!r}; there are {sorted(VECTOR_DISTANCES)}")
    return VECTOR_DISTANCES[name]


def combine(features: DataFrame, weights: tuple[float, float, float], empty: float = 0.0) -> DataFrame:
    """log_id, i, j and the weighted distance of features(log_id, line_id, variables, vec).

    weights: of variables, vectors and places; a weight of 0 leaves its distance out of the plan altogether. Weights
    that are negative or sum to more than 1 are refused.
    """
    if min(weights) < 0 or sum(weights) > 1 + 1e-9:
        raise ValueError("weights must not be negative, nor more than 1 together")
    alpha, beta, gamma = weights
    needs = [c for c, w in (("variables", alpha), ("vec", beta)) if w]
    base = features.select("log_id", "line_id", *needs)
    if alpha:
        base = hashed_sets(base, "variables")
    if beta:
        base = base.withColumn("norm", norm(F.col("vec")))
        needs.append("norm")
    if gamma:
        base = base.withColumn("place", F.row_number().over(Window.partitionBy("log_id").orderBy("line_id")) - 1)
        base = base.join(features.groupBy("log_id").agg(F.count(F.lit(1)).alias("n")), "log_id")
        needs += ["place", "n"]
    p = pairs(base, needs)
    total = F.lit(0.0)
    if alpha:
        total = total + alpha * jaccard(F.col("a_variables"), F.col("b_variables"), empty)
    if beta:
        total = total + beta * cosine(F.col("a_vec"), F.col("b_vec"), F.col("a_norm"), F.col("b_norm"))
    if gamma:
        total = total + gamma * (F.col("b_place") - F.col("a_place")) / (F.col("a_n") - 1)
    return p.select("log_id", "i", "j", total.alias("d"))


def mirrored(p: DataFrame, by: str = "log_id") -> DataFrame:
    """Both directions of each pair."""
    return p.unionByName(p.select(by, F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def closest_pairs(v: blocks.Vectors, k: int) -> DataFrame:
    """by, rank, i, j and d: each log's k closest pairs by distance (to nine places), then i and j."""
    w = Window.partitionBy(v.by).orderBy(F.round("d", 9), "i", "j")
    top = blocks.closest_pairs(v, k).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return top.select(v.by, "rank", "i", "j", "d")


def nearest_line(p: DataFrame, by: str = "log_id") -> DataFrame:
    """Of each line the nearest other one; ties go to the first."""
    best = mirrored(p, by).groupBy(by, "i").agg(F.min(F.struct("d", "j")).alias("b"))
    return best.select(by, F.col("i").alias("line_id"), F.col("b.j").alias("nearest"), F.col("b.d").alias("d"))


def cumulative(p: DataFrame | blocks.Vectors, by: str = "log_id") -> DataFrame:
    if isinstance(p, blocks.Vectors):
        return blocks.sums(p)
    return mirrored(p, by).groupBy(by, "i").agg(F.sum("d").alias("total"))


def kth_nearest(p: DataFrame, k: int, by: str = "log_id") -> DataFrame:
    """The k-th smallest distance of each row of the matrix, its own 0 counted as the first."""
    if isinstance(p, blocks.Vectors):
        near = blocks.nearest_few(p, k - 1)
        w = Window.partitionBy(by, "i").orderBy("d", "j")
        return near.withColumn("r", F.row_number().over(w)).where(F.col("r") == k - 1).select(by, "i", "d")
    w = Window.partitionBy(by, "i").orderBy("d", "j")
    return mirrored(p, by).withColumn("r", F.row_number().over(w)).where(F.col("r") == k - 1).select(by, "i", "d")
