"""Least label of each connected component, by joins until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.plans.lineage import Table


def least_labels(edges: DataFrame, by: str) -> DataFrame:
    """by, node and label (the least node that it reaches) for every node of edges(by, i, j).

    Each round takes the least label among neighbours and then the label of that label, so that long chains close
    quickly; rounds are written to the shared folder, and only a count and a sum reach the driver.
    """
    both = edges.select(by, "i", "j").unionByName(edges.select(by, F.col("j").alias("i"), F.col("i").alias("j"))).where("i <> j").distinct()
    links = Table(both, "edges").df
    state = Table(links.groupBy(by, F.col("i").alias("node")).agg(F.least(F.col("i"), F.min("j")).alias("label")), "labels")
    before = None
    while True:
        now = state.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "label").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return state.df
        before = now
        labels = state.df
        seen = links.join(labels.withColumnRenamed("node", "j"), [by, "j"]).groupBy(by, F.col("i").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(seen, [by, "node"]).select(by, "node", F.least("label", "m").alias("label"))
        jump = step.join(labels.select(by, F.col("node").alias("label"), F.col("label").alias("next")), [by, "label"], "left")
        following = Table(jump.select(by, "node", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        state.drop()
        state = following
