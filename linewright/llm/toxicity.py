"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's chance of being toxic is a logistic score of its words; a document's is
the noisy-or of its sentences, 1 - prod(1 - p). Only documents are labelled: the gradient of the document's likelihood
is shared out among its sentences, so that the model learns which of them are to blame, and can then point at them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.llm._common import aside, bucket_of, released, slices
from linewright.plans.lineage import ship_package

#: Labelled documents that a model is fitted on, at most, of each label; and the features that it may keep.
TRAIN_ROWS, FEATURES = 3000, 3000
LIKELY = 0.7
#: Least G statistic of a feature that is kept.
ASSOCIATED = 20.0
SENTENCE_END = re.compile(r"[.!?\n]+")
EDGE = ".,;:!?\"'()[]{}<>|&*#-_/\\"
SLICE_BYTES, KEPT_WORDS = 1 << 20, 150_000


def features(word: str) -> list[str]:
    """A word, its beginnings of three to eight letters and its ends of three to five."""
    n = len(word)
    return [f"={word}", *(f"^{word[:i]}" for i in range(3, min(9, n))), *(f"${word[-i:]}" for i in range(3, min(6, n)))]


def sentences(text: str | None) -> list[str]:
    return [s for s in SENTENCE_END.split(text.lower()) if s and not s.isspace()] if text else []


def words(sentence: str) -> list[str]:
    return [w for x in sentence.split() if (w := x.strip(EDGE))]


def _select(bags: list[set[str]], labels: np.ndarray) -> list[str]:
    """Features most associated with the label, by the G statistic of document counts."""
    cache: dict[str, list[str]] = {}
    yes, all_ = Counter(), Counter()
    for bag, label in zip(bags, labels, strict=True):
        found = set()
        for w in bag:
            if w not in cache:
                cache[w] = features(w)
            found.update(cache[w])
        all_.update(found)
        if label:
            yes.update(found)
    names = [f for f, n in all_.items() if n >= 4]
    n1, n = float(labels.sum()), float(len(labels))
    b = np.array([all_[f] for f in names], float)
    a = np.array([yes[f] for f in names], float)

    def term(x: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0)

    g = 2 * (term(a, b * n1 / n) + term(b - a, b * (n - n1) / n) + term(n1 - a, (n - b) * n1 / n) + term(n - n1 - b + a, (n - b) * (n - n1) / n))
    order = sorted((i for i in np.flatnonzero(g > ASSOCIATED)), key=lambda i: (-g[i], names[i]))
    return [names[i] for i in order[:FEATURES]]


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, rounds: int = 400, ridge: float = 1e-5) -> tuple[dict[str, float], float]:
    """Weights of features and the bias of a sentence. weights: of each document in the likelihood."""
    split = [[words(s) for s in sentences(t)] for t in texts]
    prior = float((weights * labels).sum() / weights.sum()) if len(labels) else 0.0
    bias = math.log(max(prior, 1e-4) / max(1 - prior, 1e-4)) - 3
    if not len(labels) or labels.min() == labels.max():
        return {}, bias
    names = _select([{w for s in d for w in s} for d in split], labels)
    index = {f: i for i, f in enumerate(names)}
    of_word: dict[str, list[int]] = {}
    cell, sentence, document = [], [], []
    n = 0
    for d, parts in enumerate(split):
        for s in parts:
            document.append(d)
            for w in dict.fromkeys(s):
                if w not in of_word:
                    of_word[w] = [index[f] for f in features(w) if f in index]
                cell += of_word[w]
                sentence += [n] * len(of_word[w])
            n += 1
    cell, sentence, document = np.array(cell, np.int64), np.array(sentence, np.int64), np.array(document, np.int64)
    share = weights / weights.sum()
    w = np.zeros(len(names) + 1)
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):  # Adam on the whole sample
        z = np.bincount(sentence, w[cell], n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(document, -np.logaddexp(0, np.clip(z, -30, 30)), len(texts))
        any_ = np.maximum(-np.expm1(none), 1e-9)
        back = np.where(labels == 1, np.exp(none) / any_, -1.0) * share
        g = p * back[document]
        grad = np.concatenate([np.bincount(cell, g[sentence], len(names)), [g.sum()]]) - ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1])


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "text"])
    found, bias = fit(pdf["text"].tolist(), pdf["toxic"].to_numpy(), pdf["weight"].to_numpy())
    return pd.DataFrame({"feature": ["", *found], "weight": [bias, *found.values()]})


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> dict[str, float]:
    """Weights by feature ('' is the bias), from the labelled documents outside the held-out fold.

    Of each label, about `most` documents at most are used, picked by a hash of the id; each stands for as many as its
    label had. Only the labels' ids decide which texts are read. Null labels are ignored; of several labels for an id
    the largest counts.
    """
    ship_package(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").where(bucket_of("doc_id", 3) != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return {"": -6.0}
    rates = F.create_map(*[F.lit(x) for label, count in n.items() for x in (label, min(1.0, most / count))])
    picked = known.withColumn("rate", rates[F.col("toxic")]).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("rate") * 1_000_000)
    picked = picked.select("doc_id", "toxic", (1 / F.col("rate")).alias("weight"))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # about 2 * most rows
    out = sample.groupBy(F.lit(0).alias("one")).applyInPandas(_train, "feature string, weight double").collect()
    return {r["feature"]: r["weight"] for r in out} or {"": -6.0}


def score_text(text: str | None, model: dict[str, float], cache: dict[str, float]) -> tuple[float, int, float, str | None]:
    """The document's score, its count of sentences, and the worst sentence's score and text."""
    bias = model[""]
    none, worst, at = 0.0, -1.0, None
    parts = sentences(text)
    quiet = -math.log1p(math.exp(bias))
    for s in parts:
        z = 0.0
        for x in dict.fromkeys(s.split()):  # a word counts once in a sentence
            w = cache.get(x)
            if w is None:
                bare = x.strip(EDGE)
                w = cache[x] = sum(model.get(f, 0.0) for f in features(bare)) if bare else 0.0
            z += w
        if z == 0.0:
            none += quiet
            p = bias
        else:
            p = min(30.0, max(-30.0, z + bias))
            none -= math.log1p(math.exp(p))
        if at is None or p > worst:
            worst, at = p, s
    if not parts:
        return 0.0, 0, 0.0, None
    return -math.expm1(none), len(parts), 1 / (1 + math.exp(-worst)), at.strip()


def _mapper(sent, keep: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = sent.value, {}
        for part in slices(batches, "text", SLICE_BYTES):
            if len(cache) > KEPT_WORDS:
                cache.clear()
            found = [score_text(t, model, cache) for t in part.column("text").to_pylist()]
            columns = [part.column(c) for c in keep] + [pa.array(x) for x in (zip(*found, strict=True) if found else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def score_toxicity(docs: DataFrame, model: dict[str, float]) -> DataFrame:
    """All columns of docs, tox_score, n_sentences, worst_score and worst_sentence (lower-cased).

    Null, empty and blank texts score 0 and have no sentence. Only the text is looked at; rows are independent. Columns
    of docs that clash with those added are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(docs.sparkSession)
    added = T.StructType().add("tox_score", "double").add("n_sentences", "long").add("worst_score", "double").add("worst_sentence", "string")
    keep = [c for c in docs.columns if c not in added.fieldNames()]
    schema = T.StructType([docs.schema[c] for c in keep] + added.fields)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES entries
    return docs.select(*keep).mapInArrow(released(_mapper(sent, keep, to_arrow_schema(schema))), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the worst sentence's score, for every row of docs."""
    found = score_toxicity(docs.select("doc_id", "text"), train(docs, labels))
    return found.select(
        "doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= LIKELY).cast("int").alias("predicted"), "n_sentences", "worst_score",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below LIKELY, with their own columns."""
    own, back = aside(docs, ("tox_score", "n_sentences", "worst_score", "worst_sentence"))
    return score_toxicity(own, train(docs, labels)).where(F.col("tox_score") < LIKELY).select(*back)
