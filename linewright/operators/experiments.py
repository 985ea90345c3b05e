"""Weight grids, samples and contrastive pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def weight_grid(spark: SparkSession, values: list[float], exact: bool = False) -> DataFrame:
    """alpha, beta and gamma out of the values that sum to 1: within 0.01, or to the last bit when added in that order."""
    one = spark.createDataFrame([(float(v),) for v in values], "v double")
    grid = one.select(F.col("v").alias("alpha")).crossJoin(one.select(F.col("v").alias("beta"))).crossJoin(one.select(F.col("v").alias("gamma")))
    total = F.col("alpha") + F.col("beta") + F.col("gamma")
    return grid.where(total == 1.0 if exact else F.abs(total - 1) < 0.01)


def grid_scores(distances: DataFrame, grid: DataFrame, by: str = "log_id") -> DataFrame:
    """Mean combined distance of each log for each triple, of the three distances (d_var, d_emb, d_line; none is null).

    The mean of a sum is the sum of the means, so pairs are averaged once and only the logs meet the grid.
    """
    means = distances.groupBy(by).agg(*[F.avg(c).alias(c) for c in ("d_var", "d_emb", "d_line")])
    d = F.col("alpha") * F.col("d_var") + F.col("beta") * F.col("d_emb") + F.col("gamma") * F.col("d_line")
    return means.crossJoin(F.broadcast(grid)).select(by, "alpha", "beta", "gamma", d.alias("mean_d"))  # a row for each triple


def by_hash(column: str) -> Column:
    """An order of ids that looks random and is the same everywhere."""
    return F.md5(F.col(column).cast("string"))


def sample_by_size(lines: DataFrame, most: int, by: str = "log_id") -> DataFrame:
    """Up to `most` logs of each number of lines."""
    sizes = lines.groupBy(by).agg(F.count(F.lit(1)).alias("n_lines")).where("n_lines > 1")
    w = Window.partitionBy("n_lines").orderBy(by_hash(by), by)
    return sizes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def slice_share(lines: DataFrame, share: float, by: str = "log_id", key: str = "line_id") -> DataFrame:
    """That share of each log's lines (rounded down), picked by hash; their order stays theirs."""
    w = Window.partitionBy(by)
    picked = lines.withColumn("_r", F.row_number().over(w.orderBy(F.md5(F.concat_ws("-", F.col(by).cast("string"), F.col(key).cast("string"))))))
    return picked.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_r") <= F.floor(F.col("_n") * share)).drop("_r", "_n")


def contrastive(rows: DataFrame, group: str, by: str = "log_id", key: str = "line_id") -> DataFrame:
    """Each line with how many lines of its log have its group (itself counted) and how many have another."""
    cells = rows.groupBy(by, group).agg(F.count(F.lit(1)).alias("pos"))
    totals = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(by, key, group).join(cells, [by, group]).join(totals, by).select(by, key, "pos", (F.col("n") - F.col("pos")).alias("neg"))


def contrastive_lists(rows: DataFrame, group: str, by: str = "log_id", key: str = "line_id") -> DataFrame:
    """Each line with the texts of both kinds. A log's lines are gathered, so logs must be of a moderate size."""
    a, b = rows.select(by, key, F.col(group).alias("g"), F.col("text").alias("query")), rows.select(by, F.col(group).alias("h"), "text")
    met = a.join(b, by)
    return met.groupBy(by, key, "query").agg(F.collect_list(F.when(F.col("g") == F.col("h"), F.col("text"))).alias("pos"), F.collect_list(F.when(F.col("g") != F.col("h"), F.col("text"))).alias("neg"))


def candidate_counts(sizes: DataFrame, by: str = "log_id", samples: int = 10) -> DataFrame:
    """by and k: up to `samples` counts spread evenly from 2 to n - 1, rounded half to even, without repeats."""
    m = F.least(F.lit(samples), F.col("n") - 2)
    step = F.when(m > 1, (F.col("n") - 3) / (m - 1)).otherwise(F.lit(0.0))
    points = F.transform(F.sequence(F.lit(0), (m - 1).cast("int")), lambda i: F.bround(2 + i * step, 0).cast("long"))
    return sizes.where("n >= 3").select(by, F.explode(F.array_distinct(points)).alias("k"))


def preference_trial(alpha: float, beta: float) -> tuple[float, float, float]:
    """Weights of a trial: the second is a share of what the first leaves, the third is the rest."""
    b = (1 - alpha) * beta
    return alpha, b, 1 - alpha - b


def flatten(df: DataFrame, column: str) -> DataFrame:
    """The fields of a nested column as columns of their own, in place of it."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")


def look_up(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """df with what is known of each key (null where nothing is); known has one row for each key."""
    return df.join(known, key, "left")


def zip_lines(left: DataFrame, right: DataFrame, by: str = "log_id", key: str = "line_id") -> DataFrame:
    """Lines of two files at the same place; the shorter one's end is the end."""
    place = lambda df: df.withColumn("place", (F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1).cast("long")).drop(key)
    return place(left).join(place(right), [by, "place"])


def first_of_equals(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("x"))
    return best.select(*[c if c in keys else F.col(f"x.{c}").alias(c) for c in df.columns])


def shuffled(df: DataFrame, key: str) -> DataFrame:
    """df with place (from 1) in an order that looks random and is the same everywhere.

    Rows are numbered by the first digits of their hash and by the counts of smaller ones, so that no task holds all.
    """
    ready = df.withColumn("_h", by_hash(key)).withColumn("_part", F.substring("_h", 1, 3))
    counts = ready.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # 4,096 rows at most
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = ready.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy("_h", key)))
    return within.join(F.broadcast(starts), "_part").withColumn("place", (F.col("_start") + F.col("_r")).cast("long")).drop("_h", "_part", "_r", "_start")


def head(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in an order that leaves no ties."""
    return df.orderBy(*order).limit(n)


def random_picks(df: DataFrame, key: str, n: int) -> DataFrame:
    """pick (from 0) and a key, n times with replacement; the same picks everywhere for the same keys."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    spot = F.conv(F.substring(F.md5(F.concat(F.lit("pick-"), F.col("pick").cast("string"))), 1, 8), 16, 10).cast("long")
    picks = df.sparkSession.range(n).withColumnRenamed("id", "pick").crossJoin(total).where("_total > 0").select("pick", (spot % F.col("_total") + 1).alias("place"))  # one row of total
    return shuffled(df.select(key), key).join(F.broadcast(picks), "place").select("pick", key)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of several results with the same columns, repeats included."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def instance_ids(df: DataFrame, by: str = "log_id", size: str = "n_tokens", order: str = "line_id") -> DataFrame:
    """df with seq, the number of a line among those of its log and length, and instance, a deterministic id made of the three."""
    numbered = df.withColumn("seq", F.row_number().over(Window.partitionBy(by, size).orderBy(order)).cast("long"))
    return numbered.withColumn("instance", F.xxhash64(by, size, "seq"))
