"""Sinks. Ordered single-file outputs are for results of a bounded size only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_structured(df: DataFrame, path: str) -> None:
    """Structured lines as CSV, arrays as JSON text."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").csv(path, header=True, escape='"')


def write_templates(df: DataFrame, path: str) -> None:
    df.select("EventId", "EventTemplate", "Occurrences").write.mode("overwrite").csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def encode_json(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def write_lines(df: DataFrame, value: str, path: str) -> None:
    df.select(F.col(value).alias("value")).write.mode("overwrite").text(path)


def write_pairs(df: DataFrame, path: str) -> None:
    """A distance matrix as a table of pairs."""
    df.write.mode("overwrite").parquet(path)


def append_run(df: DataFrame, run: int, path: str) -> None:
    """One run of a series, so that a series can go on where it was left."""
    df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def finished_runs(spark, path: str) -> set[int]:
    return {r["run"] for r in spark.read.parquet(path).select("run").distinct().collect()}


def write_cluster(df: DataFrame, cluster: int, path: str) -> None:
    write_lines(df.where(F.col("cluster") == cluster).orderBy("log_id", "line_id"), "text", path)


def one_hot(df: DataFrame, key: str, values: str) -> DataFrame:
    """A 0/1 column for each value, for looking at small frames."""
    return df.select(key, F.explode(values).alias("v")).groupBy(key).pivot("v").agg(F.lit(1)).fillna(0)


def html_page(rows: DataFrame, title: str = "clusters") -> str:
    """A page of coloured lines (line_id, html) of one log, in order."""
    body = "\n".join(r["html"] for r in rows.orderBy("line_id").collect())
    return f"<html><head><title>{title}</title></head><body>\n{body}\n</body></html>"


def grouped_lines(df: DataFrame, by: str = "log_id") -> DataFrame:
    """by, cluster and the text of its lines, one a line of text, in order; for printing."""
    one = df.groupBy(by, "cluster").agg(F.array_sort(F.collect_list(F.struct("line_id", "text"))).alias("x"))
    return one.select(by, "cluster", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))


#: Escape sequences of eight terminal colours.
COLOURS = tuple(f"\x1b[{30 + i}m" for i in range(8))


def console_lines(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """log_id, line_id and printed: the line in its cluster's terminal colour; noise (-1) in the plain one."""
    colour = F.when(F.col(cluster) < 0, "").otherwise(F.get(F.array(*[F.lit(c) for c in COLOURS]), F.pmod(F.col(cluster), F.lit(len(COLOURS))).cast("int")))
    return df.select("log_id", "line_id", F.concat(colour, F.format_string("%03d-%d: %s", "line_id", cluster, "text"), F.lit("\x1b[0m")).alias("printed"))


def print_side_by_side(left: DataFrame, right: DataFrame, most: int = 100, show=print) -> None:
    """The first lines of two results of one log next to each other, the shorter one's end being the end."""
    one, other = ([r["printed"] for r in console_lines(x).orderBy("line_id").limit(most).collect()] for x in (left, right))
    for a, b in zip(one, other, strict=False):
        show(f"{a} | {b}")


def html_lines(df: DataFrame, by: list[str], cluster: str = "cluster") -> DataFrame:
    """by, line_id and html: each line as an element in the colour of its cluster, with its text escaped."""
    from linewright.operators.render import palette

    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    joined = df.join(palette(df, cluster, by), [*by, cluster])
    return joined.select(*by, "line_id", F.format_string("<p style='background:rgb(%d,%d,%d)'>%03d %s</p>", "r", "g", "b", "line_id", escaped).alias("html"))


def one_hot_rows(df: DataFrame, key: str, values: str) -> DataFrame:
    """key and places: a sparse 0/1 vector over all values of the frame as the sorted places that are 1; the values are numbered in their order.

    Values are numbered by a count of the smaller ones by first letters, so that none of it is one task's work.
    """
    from pyspark.sql import Window

    each = df.select(key, F.explode(F.array_distinct(values)).alias("v"))
    part = F.substring("v", 1, 2)
    distinct = each.select("v").distinct().withColumn("part", part)
    counts = distinct.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each two letters
    numbered = distinct.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1).join(starts.drop("n"), "part").select("v", (F.col("r") + F.col("start")).alias("place"))
    return each.join(numbered, "v").groupBy(key).agg(F.array_sort(F.collect_list("place")).alias("places"))
