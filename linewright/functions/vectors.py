"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scale(x: Column, low: Column, high: Column, top: float = 1.0) -> Column:
    """x between 0 and top as it lies between low and high; 0 where they are equal."""
    return F.when(high > low, (x - low) / (high - low) * top).otherwise(0.0)


def min_max(df: DataFrame, value: str, by: list[str], out: str, top: float = 1.0) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn(out, scale(F.col(value), F.min(value).over(w), F.max(value).over(w), top))


def pool(df: DataFrame, by: list[str], vector: str, kind) -> DataFrame:
    """One vector for each group: 'mean' or 'sum' by component, 'none' (the vectors as they are), or what a function makes of a component's column."""
    if kind == "none":
        return df.select(*by, F.col(vector).alias("pooled"))
    if not callable(kind) and kind not in ("mean", "sum"):
        raise ValueError(f"no pooling named {kind!r}")
    each = df.select(*by, F.posexplode(vector).alias("dim", "x"))
    one = each.groupBy(*by, "dim").agg((kind if callable(kind) else F.avg if kind == "mean" else F.sum)(F.col("x").cast("double")).alias("x"))
    pairs = one.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("p"))
    return pairs.select(*by, F.transform("p", lambda p: p["x"]).alias("pooled"))
