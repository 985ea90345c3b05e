"""Weights and vectors of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions.text import word_tokens


def tfidf(lines: DataFrame, by: tuple[str, ...] = ("log_id",), key: str = "line_id", text: str = "text") -> DataFrame:
    """by, key, token and weight: tf * (ln((1 + n) / (1 + df)) + 1), each line's weights of length 1.

    n and df are counted within `by`. Lines without a word have no rows.
    """
    by_ = list(by)
    n = lines.groupBy(*by_).agg(F.count(F.lit(1)).alias("n"))
    tf = lines.select(*by_, key, F.explode(word_tokens(F.col(text))).alias("token")).groupBy(*by_, key, "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(*by_, "token").agg(F.count(F.lit(1)).alias("df"))
    raw = tf.join(df, [*by_, "token"]).join(n, by_).withColumn("raw", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = raw.groupBy(*by_, key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return raw.join(length, [*by_, key]).select(*by_, key, "token", (F.col("raw") / F.col("length")).alias("weight"))


def tfidf_within(lines: DataFrame, by: str = "log_id", key: str = "line_id", text: str = "text") -> DataFrame:
    """tfidf where a log is a task's: lines are dealt once, by log, and all counts are windows over them. Lines without a word have one row without a token."""
    w = Window.partitionBy
    dealt = lines.select(by, key, F.col(text).alias("_text")).repartition(by)
    counted = dealt.withColumn("n", F.count(F.lit(1)).over(w(by)))  # before lines become words
    placed = counted.select(by, key, "n", F.explode_outer(word_tokens(F.col("_text"))).alias("token"))
    tf = placed.groupBy(by, key, "token").agg(F.count("token").alias("tf"), F.first("n").alias("n"))
    df = tf.withColumn("df", F.count(F.lit(1)).over(w(by, "token")))
    raw = df.withColumn("raw", F.when(F.col("token").isNotNull(), F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)))
    return raw.select(by, key, "token", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(w(by, key)))).alias("weight"))


def sparse_cosine(weights: DataFrame, by: str = "log_id", key: str = "line_id") -> DataFrame:
    """Halved cosine distances of lines that share a token (all others are 0.5 apart), through an inverted index."""
    left = weights.select(by, "token", F.col(key).alias("i"), F.col("weight").alias("u"))
    right = weights.select(by, "token", F.col(key).alias("j"), F.col("weight").alias("v"))
    met = left.join(right, [by, "token"]).where("i < j").groupBy(by, "i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("s"))
    return met.select(by, "i", "j", ((1 - F.col("s")) / 2).alias("d"))


def vocabulary(lines: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, token and n, the counts of every word."""
    return lines.select(by, F.explode(word_tokens(F.col(text))).alias("token")).groupBy(by, "token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_size(lines: DataFrame, by: str) -> DataFrame:
    return vocabulary(lines, by).groupBy(by).agg(F.count(F.lit(1)).alias("n_words"))


def hapaxes(lines: DataFrame, by: str) -> DataFrame:
    return vocabulary(lines, by).groupBy(by).agg(F.count_if(F.col("n") == 1).alias("n_hapax"))


def embed(lines: DataFrame, embedder) -> DataFrame:
    """Vectors from a function of batches: an iterator of pandas frames (log_id, line_id, text) to (log_id, line_id, vec)."""
    kind = f"log_id {lines.schema['log_id'].dataType.simpleString()}, line_id long, vec array<double>"
    return lines.select("log_id", "line_id", "text").mapInPandas(embedder, kind)


def limit_tokens(column, most: int):
    """The first `most` tokens; -1 keeps them all."""
    return column if most == -1 else F.slice(column, 1, most)
