"""Coloured lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions.colours import hsv_rgb


def label_encode(df: DataFrame, label: str, by: list[str], out: str = "code") -> DataFrame:
    """Labels numbered from 0 in their order within each group."""
    return df.withColumn(out, (F.dense_rank().over(Window.partitionBy(*by).orderBy(label)) - 1).cast("long"))


def palette(df: DataFrame, label: str, by: list[str], s: float = 0.75, v: float = 1.0) -> DataFrame:
    """r, g and b of each label: hues spread evenly over the labels of a group."""
    coded = label_encode(df.select(*by, label).distinct(), label, by)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    r, g, b = hsv_rgb(F.col("code") / n, s, v)
    return coded.select(*by, label, "code", r.alias("r"), g.alias("g"), b.alias("b"))


def markdown_lines(df: DataFrame, by: list[str], cluster: str = "cluster") -> DataFrame:
    """by, line_id and markdown: the line's number, its cluster and its coloured text."""
    colours = palette(df, cluster, by)
    colour = F.format_string("rgb(%d,%d,%d)", "r", "g", "b")
    joined = df.join(colours, [*by, cluster])
    return joined.select(*by, "line_id", F.format_string("%03d-%d: <span style='color:%s'>%s</span>", "line_id", cluster, colour, "text").alias("markdown"))
