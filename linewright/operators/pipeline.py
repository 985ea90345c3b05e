"""The whole way from raw lines to clusters, with each step a function that can be exchanged, and the search for weights."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.functions.text import TIMESTAMP, first_words, word_tokens
from linewright.operators import clustering, distances, metrics, render, templates, topics
from linewright.operators.blocks import Vectors, nearest_by_weights
from linewright.operators.experiments import preference_trial, weight_grid
from linewright.operators.features import sparse_cosine, tfidf

Step = Callable[[DataFrame], DataFrame]


class EmptyLog(ValueError):
    """There are no lines."""


class NoVariable(ValueError):
    """No line has a variable."""


def variable_pairs(parsed: DataFrame, strict: bool = False, empty: float | None = 0.0) -> DataFrame:
    """log_id, i, j and the Jaccard distance of all pairs of lines' variables; two empty sets are `empty` apart (None: NaN).

    strict: raises EmptyLog where there are no lines, NoVariable where no line has a variable. Otherwise an empty frame
    gives an empty frame, and lines without variables are `empty` apart.
    """
    if strict:
        found = parsed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("variables")).alias("most")).first()
        if not found["n"]:
            raise EmptyLog("there are no lines")
        if not found["most"] or found["most"] < 1:
            raise NoVariable("no line has a variable")
    p = distances.pairs(distances.hashed_sets(parsed, "variables"), ["variables"])
    return p.select("log_id", "i", "j", distances.jaccard(F.col("a_variables"), F.col("b_variables"), float("nan") if empty is None else empty).alias("d"))


def parse_lines(lines: DataFrame) -> DataFrame:
    return templates.mine_templates(lines, (TIMESTAMP, r"\d+\.\d+\.\d+\.\d+", r"\d+"))


def word_distances(lines: DataFrame) -> DataFrame:
    """Halved cosine distances of tf-idf weights; pairs without a word in common aren't listed: they are 0.5 apart."""
    return sparse_cosine(tfidf(lines))


@dataclass
class LinePipeline:
    """The steps by name. Each takes and gives frames, so any of them can be replaced.

    parse: lines to lines with `variables` and `template`; embed: lines to pairs (log_id, i, j, d), where pairs that are
    missing are `missing` apart; place: lines to pairs; cluster: points and pairs to log_id, line_id, cluster and, where
    it tries several, k. weights: of variables, embeddings and places; a weight of 0 leaves its step out.
    """

    weights: tuple[float, float, float] = (0.4, 0.4, 0.2)
    parse: Step = parse_lines
    embed: Step = word_distances
    place: Step = distances.line_pairs
    cluster: Callable[[DataFrame, DataFrame], DataFrame] = field(default=clustering.sweep_medoids)
    missing: float = 0.5

    def distances(self, lines: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
        """log_id, i, j and d, the weighted sum of the distances, for all pairs of lines of a log."""
        out = distances.pairs(lines.select("log_id", "line_id"), []).withColumn("d", F.lit(0.0))
        for weight, step, missing in zip(self.weights, (lambda: variable_pairs(self.parse(lines) if parsed is None else parsed), lambda: self.embed(lines), lambda: self.place(lines)), (0.0, self.missing, 0.0), strict=True):
            if weight:
                part = step().withColumnRenamed("d", "part")
                out = out.join(part, ["log_id", "i", "j"], "left").select("log_id", "i", "j", (F.col("d") + weight * F.coalesce("part", F.lit(missing))).alias("d"))
        return out

    def run(self, lines: DataFrame) -> DataFrame:
        """What cluster gives, with the weights in columns alpha, beta and gamma."""
        parsed = self.parse(lines) if self.weights[0] else None
        found = self.cluster(lines.select("log_id", "line_id"), self.distances(lines, parsed))
        return found.withColumns({name: F.lit(float(w)) for name, w in zip(("alpha", "beta", "gamma"), self.weights, strict=True)})

    def best(self, lines: DataFrame) -> DataFrame:
        """log_id, line_id and cluster of each log's best count of clusters by silhouette; ties go to the least."""
        found = self.run(lines)
        if "k" not in found.columns:
            return found.select("log_id", "line_id", "cluster")
        one = metrics.best_per_key(found.select("log_id", "k", "silhouette").distinct(), ["log_id"], "silhouette", "k")
        return found.join(one.select("log_id", "k"), ["log_id", "k"]).select("log_id", "line_id", "cluster")

    def coloured(self, lines: DataFrame) -> DataFrame:
        """Each line as marked-up text in the colour of its cluster."""
        return render.markdown_lines(lines.join(self.best(lines), ["log_id", "line_id"]), ["log_id"])


def grid_columns(triples: Iterable[tuple[float, float, float]]) -> list:
    """A column of the combined distance for each triple, of frames with d_var, d_emb and d_line."""
    return [(a * F.col("d_var") + b * F.col("d_emb") + g * F.col("d_line")).alias(f"d{n}") for n, (a, b, g) in enumerate(triples)]


def nearest_agreement(parts: DataFrame, labels: DataFrame, triples: list[tuple[float, float, float]]) -> DataFrame:
    """run and score: for each triple, the share of lines whose nearest line has their label.

    parts: log_id, i, j, d_var, d_emb, d_line; labels: log_id, line_id, label. The pairs are read once for all triples;
    ties go to the first line.
    """
    both = parts.unionByName(parts.select("log_id", F.col("j").alias("i"), F.col("i").alias("j"), "d_var", "d_emb", "d_line"))
    names = [f"d{n}" for n in range(len(triples))]
    nearest = both.select("log_id", "i", "j", *grid_columns(triples)).groupBy("log_id", "i").agg(*[F.min(F.struct(F.round(c, 9).alias("d"), "j")).alias(c) for c in names])
    each = nearest.select("log_id", "i", F.posexplode(F.array(*[F.col(f"{c}.j") for c in names])).alias("run", "j"))
    return _agreement(each, labels)


def nearest_agreement_of_vectors(features: DataFrame, variable: str, labels: DataFrame, triples: list[tuple[float, float, float]], metric: str = "cosine") -> DataFrame:
    """nearest_agreement of features(log_id, line_id, vec, a variable), block by block: d_var is 1 where the variable differs, d_line that of places."""
    w = Window.partitionBy("log_id")
    placed = features.select("log_id", "line_id", "vec", variable, (F.row_number().over(w.orderBy("line_id")) - 1).alias("place"), F.count(F.lit(1)).over(w).alias("n"))
    found = nearest_by_weights(Vectors(placed, "vec", metric), variable, "place", "n", triples)
    best = found.groupBy("log_id", "i", "run").agg(F.min(F.struct("d", "j")).alias("b"))
    return _agreement(best.select("log_id", "i", "run", F.col("b.j").alias("j")), labels)


def _agreement(each: DataFrame, labels: DataFrame) -> DataFrame:
    mine = labels.select("log_id", F.col("line_id").alias("i"), F.col("label").alias("a"))
    other = labels.select("log_id", F.col("line_id").alias("j"), F.col("label").alias("b"))
    return each.join(mine, ["log_id", "i"]).join(other, ["log_id", "j"]).groupBy("run").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("score"))


def weight_search(parts: DataFrame, labels: DataFrame, values: list[float], exact: bool = False, agreement: Callable[..., DataFrame] = nearest_agreement) -> DataFrame:
    """A row for each triple: run, alpha, beta, gamma, score, and the best triple so far (best_run, the first of equals).

    agreement: run and score of parts, labels and the triples; parts are what it takes.
    """
    spark = parts.sparkSession
    triples = sorted((r["alpha"], r["beta"], r["gamma"]) for r in weight_grid(spark, values, exact).collect())
    table = spark.createDataFrame([(n, *t) for n, t in enumerate(triples)], "run int, alpha double, beta double, gamma double")
    scored = table.join(agreement(parts, labels, triples), "run")
    so_far = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)  # a row for each triple
    return scored.withColumn("best_run", -F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("run")).alias("r"))).over(so_far)["r"])


def trials(spark: SparkSession, choose: Callable[[list[tuple[float, float, float]]], int], pairs: Iterable[tuple[tuple[float, float], tuple[float, float]]]) -> DataFrame:
    """A table of preference trials: of each two settings (alpha, share) the weights, and which one was chosen.

    choose gets the two triples and gives the place of the better; it may be a person's answer.
    """
    rows = []
    for n, two in enumerate(pairs):
        made = [preference_trial(*x) for x in two]
        rows += [(n, side, *[float(x) for x in w], choice == side) for choice in [choose(made)] for side, w in enumerate(made)]
    return spark.createDataFrame(rows, "trial int, side int, alpha double, beta double, gamma double, chosen boolean")


def append_trials(table: DataFrame, path: str) -> None:
    """The store of trials: a table that grows."""
    table.write.mode("append").parquet(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("trial int, side int, alpha double, beta double, gamma double, chosen boolean").parquet(path)


def topic_info(docs: DataFrame, topic: str, text: str = "text", key: str = "doc_id", top: int = 10) -> DataFrame:
    """topic, n (documents), name (the first words), words and the key of a representative document, for each topic."""
    words = topics.topic_words(docs.select(topic, text), [topic], text, top)
    listed = words.groupBy(topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words"))
    found = representative_docs(docs, listed, topic, text, key)
    return docs.groupBy(topic).agg(F.count(F.lit(1)).alias("n")).join(listed, topic, "left").join(found, topic, "left").select(topic, "n", first_words(F.array_join("words", " "), 4).alias("name"), F.array_join("words", ",").alias("words"), "representative")


def representative_docs(docs: DataFrame, listed: DataFrame, topic: str, text: str, key: str) -> DataFrame:
    """The document of each topic with most of its words in it, the least key of equals."""
    scored = docs.join(listed, topic).select(topic, key, F.size(F.array_intersect(F.array_distinct(word_tokens(F.col(text))), F.col("words"))).alias("hits"))
    return scored.groupBy(topic).agg((-F.max(F.struct("hits", (-F.col(key)).alias("k")))["k"]).alias("representative"))


def document_info(docs: DataFrame, topic: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, topic, the topic's words and whether the document represents it."""
    info = topic_info(docs, topic, text, key)
    return docs.select(key, topic).join(info.select(topic, "words", "representative"), topic).select(key, topic, "words", (F.col("representative") == F.col(key)).alias("represents"))
