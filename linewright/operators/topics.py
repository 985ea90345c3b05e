"""Topic words, representative lines and extractive summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions.text import WORD, tokens, word_tokens
from linewright.plans.lineage import Table, ship_package

#: Weights that are gathered before whole logs of them are ranked; similarities and their terms that are summed at a time.
RANKED_ROWS, LINKED_CELLS = 200_000, 4_000_000
#: Topic weights of the commonest words, which are broadcast; words of texts that are fitted at a time, and their weights.
COMMON_CELLS, FITTED_WORDS, FITTED_CELLS = 4_000_000, 1_000_000, 2_000_000
#: Rounds count less the later they are: the n-th by (OFFSET + n) ** -DECAY. Mean change of a text's topics at which it is fitted.
OFFSET, DECAY, FITTED, FREE_STEPS = 1024, 0.51, 1e-3, 100


def topic_words(docs: DataFrame, by: list[str], text: str = "text", top: int = 10) -> DataFrame:
    """by, rank, word and weight: the best words of each class by class-based tf-idf, ties by word.

    weight = (share of the word in the class) * ln(1 + mean words of a class / count of the word in all classes).
    """
    counts = docs.select(*by, F.explode(word_tokens(F.col(text))).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    totals = counts.groupBy("word").agg(F.sum("n").alias("total"))
    scored = counts.join(sizes, by).join(totals, "word").crossJoin(F.broadcast(mean))  # one row
    weight = F.col("n") / F.col("size") * F.log(1 + F.col("mean") / F.col("total"))
    w = Window.partitionBy(*by).orderBy(F.round("weight", 9).desc(), "word")
    ranked = scored.select(*by, "word", weight.alias("weight")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select(*by, F.col("rank").cast("long").alias("rank"), "word", "weight")


def count_windows(lines: DataFrame, size: int = 20, by: str = "log_id", order: str = "line_id") -> DataFrame:
    """lines with `window`, the number of their run of `size` consecutive lines; a run that isn't full is left out."""
    w = Window.partitionBy(by).orderBy(order)
    numbered = lines.withColumn("window", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    return numbered.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(by, "window"))).where(F.col("_n") == size).drop("_n")


def representative(lines: DataFrame, topics: DataFrame, by: list[str], kind: str = "distinct") -> DataFrame:
    """The line of each class with most tokens in its topic, the first of equals.

    topics: by and words (array). kind: 'substring' counts tokens that occur anywhere in the joined words, 'member' counts
    tokens that are words, 'distinct' counts each of those once.
    """
    joined = lines.join(topics, by)
    own = tokens(F.lower("text"))
    if kind == "substring":
        score = F.size(F.filter(own, lambda t: F.contains(F.array_join("words", " "), t)))
    elif kind == "member":
        score = F.size(F.filter(own, lambda t: F.array_contains("words", t)))
    elif kind == "distinct":
        score = F.size(F.array_intersect(own, F.col("words")))
    else:
        raise ValueError(f"no way of counting named {kind!r}")
    best = joined.groupBy(*by).agg(F.max(F.struct(score.alias("score"), (-F.col("line_id")).alias("first"), "text")).alias("b"))
    return best.select(*by, (-F.col("b.first")).alias("line_id"), F.col("b.score").cast("long").alias("score"), F.col("b.text").alias("text"))


def _bag(words: DataFrame, vocabulary: int | None):
    """Counts of all words, or of the `vocabulary` most frequent. The model's words (times topics) must fit the driver."""
    from pyspark.ml.feature import CountVectorizer

    size = vocabulary or max(1, words.select(F.explode("words").alias("word")).distinct().count())
    return CountVectorizer(inputCol="words", outputCol="features", vocabSize=size).fit(words)


def lda_topics(docs: DataFrame, k: int, top: int = 10, text: str = "text", rounds: int = 5, vocabulary: int | None = None) -> DataFrame:
    """topic, rank, word and weight. One topic is the ranking by smoothed frequency, which is what it comes down to.

    All words are in the model, which no machine holds whole (see _topic_weights). Without words there are no rows.
    """
    words = docs.select(F.col(text), word_tokens(F.col(text)).alias("words"))
    if k == 1:
        counts = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        ranked = counts.orderBy(F.desc("n"), "word").limit(top).crossJoin(counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("v")))
        place = F.row_number().over(Window.orderBy(F.desc("n"), "word"))  # over `top` rows
        return ranked.select(F.lit(0).cast("long").alias("topic"), place.cast("long").alias("rank"), "word", ((F.col("n") + 1) / (F.col("all") + F.col("v"))).alias("weight"))
    weights = _topic_weights(docs, k, text, rounds, vocabulary)
    each = weights.select("word", F.posexplode(F.array(*[f"s{t}" for t in range(k)])).alias("topic", "weight"))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "word"))
    ranked = each.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.select(F.col("topic").cast("long").alias("topic"), F.col("rank").cast("long").alias("rank"), "word", "weight")


def _topic_weights(docs: DataFrame, k: int, text: str, rounds: int, vocabulary: int | None) -> DataFrame:
    """word and s0 to s(k - 1), its weight in each topic, by online variational inference (as Spark's, whose model is one matrix on the driver).

    A round takes the next of `rounds` parts of the texts, so every text is read once. Weights of the commonest words are
    broadcast; those of all others are a table, joined with the words of a round's texts. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    ship_package(spark)
    names = [f"s{t}" for t in range(k)]
    each = docs.select(F.explode(word_tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if vocabulary:
        each = each.orderBy(F.desc("n"), "word").limit(vocabulary)
    counts = Table(each.withColumn("id", F.xxhash64("word")), "topic-words").df
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("words")).first()
    common = np.sort(counts.where(F.col("n") >= max(1.0, sums["total"] * k / COMMON_CELLS)).select("id").toArrow().column("id").to_numpy())  # at most COMMON_CELLS / k rows
    kinds = ", ".join(f"{c} double" for c in names)
    first = counts.select("id").mapInArrow(_start_sums(k), kinds).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names]).first()
    first = np.array([first[c] for c in names])
    part = F.pmod(F.xxhash64(text), F.lit(rounds))
    sizes = {r["part"]: r["n"] for r in docs.where(F.lower(text).rlike(WORD)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # `rounds` rows

    # a word's weights are start * those it has at random + prior + those learnt, which only words read so far have
    start, prior, alpha = 1.0, 0.0, np.full(k, 1 / k)
    learnt, learnt_sums, rare = np.zeros((k, len(common))), np.zeros(k), None
    sent = spark.sparkContext.broadcast(common)
    for n in range(1, rounds + 1):
        if not sizes.get(n - 1):
            continue
        hashed = docs.where(part == n - 1).select(F.transform(word_tokens(F.col(text)), lambda w: F.xxhash64(w)).alias("ids"))
        coded = hashed.mapInArrow(_code(sent), "places array<int>, times array<int>, rare array<long>, rare_times array<int>")
        coded = Table(coded.withColumn("_row", F.monotonically_increasing_id()), "topic-texts")
        texts = coded.df.drop("_row")
        if rare is not None or vocabulary:
            own = coded.df.select("_row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("_row", F.col("x.rare").alias("id"), F.col("x.rare_times").alias("n"))
            if vocabulary:
                own = own.join(counts.select("id"), "id", "left_semi")
            zero = F.lit(0.0)
            own = own.select("*", *[zero.alias(c) for c in names]) if rare is None else own.join(rare.df, "id", "left").fillna(0.0, names)
            own = own.groupBy("_row").agg(F.collect_list(F.struct("id", "n", *names)).alias("x"))
            texts = coded.df.drop("rare", "rare_times").join(own, "_row", "left").select("places", "times", F.col("x.id").alias("rare"), F.col("x.n").alias("rare_times"), *[F.col(f"x.{c}").alias(c) for c in names])
        all_ = start * first + prior * sums["words"] + learnt_sums
        model = spark.sparkContext.broadcast((_chances(start * starts(common, k) + prior + learnt, all_), start, prior, all_, alpha))
        found = texts.mapInArrow(_fit_texts(model, k, FITTED, FITTED_CELLS // k), f"kind int, id long, {kinds}").groupBy("kind", "id").agg(*[F.sum(c).alias(c) for c in names])
        found = Table(found, "topic-sums")
        coded.drop()
        model.destroy()
        rate, scale = (OFFSET + n) ** -DECAY, sum(sizes.values()) / sizes[n - 1]
        start, prior = (1 - rate) * start, (1 - rate) * prior + rate / k
        of = found.df.where("kind = 0").toArrow()  # a row for each common word at most
        learnt *= 1 - rate
        learnt[:, of.column("id").to_numpy()] += rate * scale * np.stack([of.column(c).to_numpy() for c in names])
        got = {r["kind"]: np.array([r[c] for c in names]) for r in found.df.groupBy("kind").agg(*[F.sum(c).alias(c) for c in names]).collect()}  # three rows
        learnt_sums = (1 - rate) * learnt_sums + rate * scale * sum((got[x] for x in (0, 1) if x in got), np.zeros(k))
        alpha = _next_alpha(alpha, got[2] / sizes[n - 1], sizes[n - 1], rate) if 2 in got else alpha
        new = found.df.where("kind = 1").select("id", *[(F.col(c) * (rate * scale)).alias(c) for c in names])
        if rare is not None:
            new = rare.df.select("id", *[(F.col(c) * (1 - rate)).alias(c) for c in names]).unionAll(new).groupBy("id").agg(*[F.sum(c).alias(c) for c in names])
        before, rare = rare, Table(new, "topic-weights")
        found.drop()
        if before is not None:
            before.drop()
    known = spark.createDataFrame(pa.table({"id": pa.array(common), **{c: pa.array(x) for c, x in zip(names, learnt, strict=True)}}), f"id long, {kinds}")
    known = known if rare is None else known.unionAll(rare.df.select("id", *names))
    all_ = start * first + prior * sums["words"] + learnt_sums
    ready = counts.select("word", "id").join(known, "id", "left").fillna(0.0, names)
    return ready.mapInArrow(_shares(start, prior, all_), f"word string, {kinds}")


def starts(ids: np.ndarray, k: int) -> np.ndarray:
    """k rows of what words weigh before any text is read: from a gamma distribution of mean 1 and variance 0.01, drawn by their hashes."""

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    step = np.uint64(0x9E3779B97F4A7C15)
    a = mixed(np.ascontiguousarray(ids, np.int64).view(np.uint64)[None, :] + (np.arange(1, k + 1, dtype=np.uint64) * step)[:, None])
    u, v = ((a >> np.uint64(11)).astype(float) + 0.5) / 2**53, (mixed(a + step) >> np.uint64(11)).astype(float) / 2**53
    return (1 - 1 / 900 + np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v) / 30) ** 3


def _start_sums(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            total += starts(batch.column("id").to_numpy(), k).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"s{t}" for t in range(k)])

    return run


def _shares(start: float, prior: float, all_: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"s{t}" for t in range(len(all_))]
        for batch in batches:
            weight = start * starts(batch.column("id").to_numpy(), len(all_)) + prior + np.stack([batch.column(c).to_numpy() for c in names])
            yield pa.RecordBatch.from_arrays([batch.column("word"), *[pa.array(x) for x in weight / all_[:, None]]], ["word", *names])

    return run


def digamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for _ in range(6):
        shift -= 1 / x
        x = x + 1
    return shift + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def trigamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for _ in range(6):
        shift += 1 / x**2
        x = x + 1
    return shift + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5)


def _chances(weight: np.ndarray, all_: np.ndarray) -> np.ndarray:
    return np.exp(digamma(weight) - digamma(all_)[:, None])


def _next_alpha(alpha: np.ndarray, logs: np.ndarray, texts: int, rate: float) -> np.ndarray:
    """A step of Newton's method towards the texts' mean log shares of topics (Huang, 2005)."""
    slope = texts * (digamma(alpha.sum(keepdims=True)) - digamma(alpha) + logs)
    c, q = texts * trigamma(alpha.sum(keepdims=True)), -texts * trigamma(alpha)
    step = -(slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
    return alpha + rate * step if (alpha + rate * step > 0).all() else alpha


def _cut(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], most: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The rows in order, cut so that the named lists have about `most` values a part, and the lists' lengths."""
    for batch in batches:
        lengths = [batch.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
        ends, at = np.cumsum(sum(lengths)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at), [x[at:to] for x in lengths]
            at = to


def _values(part: pa.RecordBatch, column: str) -> np.ndarray:
    return part.column(column).flatten().to_numpy(zero_copy_only=False)


def _code(sent):
    """Each text's common words by their places, all others by their hashes, and how often it has them."""

    def lists(rows: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for part, (lengths,) in _cut(batches, ("ids",), FITTED_WORDS):
            n, ids = part.num_rows, _values(part, "ids")
            row = np.repeat(np.arange(n), lengths)
            at = np.minimum(np.searchsorted(common, ids), max(len(common) - 1, 0))
            on = common[at] == ids if len(common) else np.zeros(len(ids), bool)
            codes, times = np.unique(row[on] * max(len(common), 1) + at[on], return_counts=True)
            rows, places = codes // max(len(common), 1), codes % max(len(common), 1)
            other, others = row[~on], ids[~on]
            order = np.lexsort((others, other))
            other, others = other[order], others[order]
            new = np.flatnonzero(np.append(True, (other[1:] != other[:-1]) | (others[1:] != others[:-1]))[: len(other)])
            yield pa.RecordBatch.from_arrays(
                [lists(rows, n, places, pa.int32()), lists(rows, n, times, pa.int32()), lists(other[new], n, others[new], pa.int64()), lists(other[new], n, np.diff(np.append(new, len(other))), pa.int32())],
                ["places", "times", "rare", "rare_times"],
            )

    return run


def fitted(row: np.ndarray, chances: np.ndarray, times: np.ndarray, alpha: np.ndarray, least: float = FITTED) -> tuple[np.ndarray, np.ndarray]:
    """Log shares of topics of each text (k rows), and what each of its words adds to the topics; row: the text of each word, in order."""
    starts_at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    texts, k = len(starts_at), len(alpha)
    logs, left = np.zeros((k, texts)), np.arange(texts)
    gamma = np.ones((k, texts))
    whole = lengths = np.diff(np.append(starts_at, len(row)))
    x, n = chances, times.astype(float)

    def after(gamma: np.ndarray) -> np.ndarray:
        theta = np.exp(digamma(gamma) - digamma(gamma.sum(axis=0)))
        by_word = np.repeat(theta, lengths, axis=1)
        by_word *= x
        np.multiply(x, n / (by_word.sum(axis=0) + 1e-100), out=by_word)
        return alpha[:, None] + theta * np.add.reduceat(by_word, np.cumsum(lengths) - lengths, axis=1)

    farthest, last, steps = np.full(texts, np.inf), np.full(texts, np.inf), 0
    while len(left):
        steps += 1
        one = after(gamma)
        two = after(one)
        change = np.abs(two - one).mean(axis=0)
        on = change >= least
        logs[:, left[~on]] = (digamma(two) - digamma(two.sum(axis=0)))[:, ~on]
        if not on.all():
            words = np.repeat(on, lengths)
            x, n = x[:, words], n[words]
            left, lengths, gamma, one, two = left[on], lengths[on], gamma[:, on], one[:, on], two[:, on]
            change, farthest, last = change[on], farthest[on], last[on]
        # squared extrapolation of the logarithms (Varadhan and Roland, 2008): the same fixed point in fewer steps
        step = np.log(one / gamma)
        bend = np.log(two / one) - step
        length = np.maximum(1.0, np.minimum(farthest, np.sqrt((step**2).sum(axis=0) / np.maximum((bend**2).sum(axis=0), 1e-300))))
        # from the FREE_STEPS-th on, a text that went too far goes less far; a length of 1 is a plain step, which always gets nearer
        farthest, last = np.where((change > last) & (steps > FREE_STEPS), np.maximum(1.0, np.minimum(farthest, length) / 2), farthest), change
        length = np.minimum(length, farthest)
        far = np.log(gamma) + 2 * length * step + length**2 * bend
        far = np.exp(np.clip(far, np.log(two) - 5, np.log(two) + 5))
        gamma = np.where(length > 1, np.maximum(far * (two.sum(axis=0) / far.sum(axis=0)), alpha[:, None]), two)
    by_word = np.repeat(np.exp(logs), whole, axis=1) * chances
    return logs, by_word * (times / (by_word.sum(axis=0) + 1e-100))


def _fit_texts(model, k: int, least: float, most: int):
    """kind, id and s0 to s(k - 1): what a part of the texts adds to common words by place (0) and to others by hash (1), and their summed log shares (2)."""
    names = [f"s{t}" for t in range(k)]

    def out(kind: int, ids: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids.astype(np.int64)), *[pa.array(x.astype(float)) for x in sums]], ["kind", "id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chances, start, prior, all_, alpha = model.value
        known, logs, texts = np.zeros(chances.shape), np.zeros(k), 0
        for part, (own, more) in _cut(batches, ("places", "rare"), most):
            places, rare = _values(part, "places"), _values(part, "rare")
            if not len(places) + len(rare):
                continue
            weight = start * starts(rare, k) + prior
            if "s0" in part.schema.names:
                weight += np.stack([_values(part, c) for c in names])
            row = np.concatenate([np.repeat(np.arange(len(own)), own), np.repeat(np.arange(len(own)), more)])
            order = np.argsort(row, kind="stable")
            x = np.concatenate([chances[:, places], _chances(weight, all_)], axis=1)[:, order]
            times = np.concatenate([_values(part, "times"), _values(part, "rare_times")])[order]
            found, added = fitted(row[order], x, times, alpha, least)
            logs, texts = logs + found.sum(axis=1), texts + found.shape[1]
            back = np.empty_like(added)
            back[:, order] = added
            for t in range(k):
                known[t] += np.bincount(places, back[t, : len(places)], known.shape[1])
            ids, at = np.unique(rare, return_inverse=True)
            yield out(1, ids, np.stack([np.bincount(at, back[t, len(places) :], len(ids)) for t in range(k)]))
        if texts:
            at = np.flatnonzero(known.any(axis=0))
            yield out(0, at, known[:, at])
            yield out(2, np.zeros(1), logs[:, None])

    return run


def topic_mix(docs: DataFrame, key: str, k: int, text: str = "text", rounds: int = 5, vocabulary: int | None = None) -> DataFrame:
    """key and mix, each document's shares of k topics."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import vector_to_array

    words = docs.select(key, word_tokens(F.col(text)).alias("words"))
    ready = _bag(words, vocabulary).transform(words)
    return LDA(k=k, maxIter=rounds, seed=7).fit(ready).transform(ready).select(key, vector_to_array("topicDistribution").alias("mix"))


def rank_sentences(lines: DataFrame, weights: DataFrame | None = None, rounds: int = 10, damping: float = 0.85, by: str = "log_id") -> DataFrame:
    """by, line_id and score: centrality of lines in the graph of cosine similarities (weights: by, line_id, token, weight; None: tf-idf).

    Similarities are products of weights, so a round is two sums over the weights, token by token and line by line, without
    the pairs of lines.
    """
    return _centrality(lines, weights, None, rounds, damping, by)


def _centrality(lines: DataFrame, weights: DataFrame | None, threshold: float | None, rounds: int, damping: float, by: str) -> DataFrame:
    """Each log's lines are ranked in one task, many logs at a time; lines are dealt once, and no link becomes a row."""
    from linewright.operators.features import tfidf_within

    if weights is None:
        rows = tfidf_within(lines, by)
    else:
        none = lines.select(by, "line_id", F.lit(None).cast("string").alias("token"), F.lit(None).cast("double").alias("weight"))
        rows = weights.select(by, "line_id", "token", "weight").unionByName(none).repartition(by)
    rows = rows.select(by, F.col("line_id").cast("long").alias("line_id"), F.coalesce(F.xxhash64("token"), F.lit(0)).alias("token"), F.coalesce("weight", F.lit(float("nan"))).alias("weight")).sortWithinPartitions(by)
    ship_package(lines.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, most = [], 0, RANKED_ROWS
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < most:
                continue
            frame = pd.concat(held, ignore_index=True)
            logs = pd.factorize(frame[by], use_na_sentinel=False)[0]
            whole = int((logs != logs[-1]).sum())  # the last log may go on
            if whole:
                yield ranked_lines(frame[:whole], by, threshold, rounds, damping)
                frame = frame[whole:]
            held, size = [frame], len(frame)
            most = max(RANKED_ROWS, 2 * size)
        if size:
            yield ranked_lines(pd.concat(held, ignore_index=True), by, threshold, rounds, damping)

    return rows.mapInPandas(run, f"{by} {lines.schema[by].dataType.simpleString()}, line_id long, score double")


def ranked_lines(frame: pd.DataFrame, by: str, threshold: float | None, rounds: int, damping: float) -> pd.DataFrame:
    """by, line_id and score of whole logs' weights(by, line_id, token, weight); a weight that is NaN stands for its line only."""
    log, logs = pd.factorize(frame[by], use_na_sentinel=False)
    line, token, weight = frame["line_id"].to_numpy(np.int64), frame["token"].to_numpy(np.int64), frame["weight"].to_numpy(float)
    order = np.lexsort((line, log))
    log, line, token, weight = log[order], line[order], token[order], weight[order]
    new = np.append(True, (log[1:] != log[:-1]) | (line[1:] != line[:-1]))
    row = np.cumsum(new) - 1  # the line of each weight
    line_log, line_id = log[new], line[new]
    count = np.bincount(line_log)
    first = np.cumsum(count) - count  # of each log's lines
    n = count[line_log]
    on = ~np.isnan(weight)
    row, log, token, weight = row[on], log[on], token[on], weight[on]
    order = np.lexsort((row, token, log))
    new = np.append(True, (log[order][1:] != log[order][:-1]) | (token[order][1:] != token[order][:-1]))[: len(order)]
    term = np.empty(len(order), np.int64)
    term[order] = np.cumsum(new) - 1
    held = np.bincount(term)
    shared = held[term] > 1  # tokens of one line link nothing
    row, term, weight = row[shared], term[shared], weight[shared]
    lines, terms = len(line_id), len(held)
    if threshold is None:
        everywhere = np.bincount(term, weight, terms)
        total = np.bincount(row, weight * (everywhere[term] - weight), lines)
    else:
        i, j = _links(row, term, weight, terms, first[line_log], n, threshold)
        total = np.bincount(i, minlength=lines).astype(float)
    linked, score = total != 0, 1 / n
    for _ in range(rounds):
        given = np.divide(score, total, out=np.zeros(lines), where=linked)
        if threshold is None:
            own = weight * given[row]
            got = np.bincount(row, weight * (np.bincount(term, own, terms)[term] - own), lines)
        else:
            got = np.bincount(i, given[j], lines)
        score = (1 - damping) / n + damping * got
    return pd.DataFrame({by: logs.take(line_log), "line_id": line_id, "score": score})


def _links(row: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, first: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Both directions of all lines of a log whose weights' product is above the threshold, some lines at a time; rows are in order."""
    by_term = np.argsort(term, kind="stable")
    size = np.bincount(term, minlength=terms)
    start = np.cumsum(size) - size
    lines = len(n)
    work = np.cumsum(n + np.bincount(row, size[term], lines).astype(np.int64))
    ends = np.searchsorted(row, np.arange(lines + 1))
    i, j, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < lines:
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + LINKED_CELLS, side="right")))
        own = np.arange(ends[at], ends[to])
        times = size[term[own]]
        mine = np.repeat(own, times)
        other = by_term[np.arange(len(mine)) - np.repeat(np.cumsum(times) - times, times) + start[term[mine]]]
        cell = np.cumsum(n[at:to]) - n[at:to]  # of each line's similarities to its log's lines
        places = cell[row[mine] - at] + row[other] - first[row[mine]]
        close = np.flatnonzero(np.bincount(places, weight[mine] * weight[other], int(n[at:to].sum())) > threshold)
        a = np.searchsorted(cell, close, side="right") - 1
        b = close - cell[a] + first[at + a]
        keep = b != at + a
        i.append(at + a[keep])
        j.append(b[keep])
        at = to
    return np.concatenate(i), np.concatenate(j)


def frequent_word_sentences(lines: DataFrame, by: str = "log_id", share: float = 0.02) -> DataFrame:
    """by, line_id and score: the squared count of a line's frequent words over its words."""
    each = lines.select(by, "line_id", F.explode(word_tokens(F.col("text"))).alias("word"))
    counts = each.groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("total"))
    frequent = counts.join(totals, by).where(F.col("n") >= F.greatest(F.lit(2), share * F.col("total"))).select(by, "word", F.lit(1).alias("hit"))
    scored = each.join(frequent, [by, "word"], "left").groupBy(by, "line_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("h"), F.count(F.lit(1)).alias("n"))
    return scored.select(by, "line_id", (F.col("h") * F.col("h") / F.col("n")).alias("score"))


def lex_rank(lines: DataFrame, weights: DataFrame | None = None, threshold: float = 0.1, rounds: int = 10, by: str = "log_id") -> DataFrame:
    """by, line_id and score: centrality of lines in the graph whose links are cosine similarities above the threshold, all of equal weight."""
    return _centrality(lines, weights, threshold, rounds, 0.85, by)


def window_topics(windows: DataFrame, k: int = 10, top: int = 10, by: tuple[str, ...] = ("log_id", "window"), rounds: int = 30) -> DataFrame:
    """by, rank, word and weight: the words of the first of k topics of a latent Dirichlet model fitted to each window's lines.

    A window is a bounded group (20 lines), fitted in one task by variational inference from a start that depends on the
    words alone. A window without words has no rows. A word's ties go by the alphabet.
    """
    keys = list(by)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_id")
        words = sorted({w for x in pdf["words"] for w in x})
        if not words:
            return pd.DataFrame(columns=[*keys, "rank", "word", "weight"])
        place = {w: i for i, w in enumerate(words)}
        bag = np.zeros((len(pdf), len(words)))
        for d, x in enumerate(pdf["words"]):
            for w in x:
                bag[d, place[w]] += 1
        v = np.arange(len(words))
        lam = 1 + 0.5 * np.sin((v[None, :] + 1) * (np.arange(k)[:, None] + 1))
        for _ in range(rounds):
            beta = np.exp(digamma(lam) - digamma(lam.sum(axis=1, keepdims=True)))
            gamma = np.ones((len(pdf), k))
            for _ in range(10):
                theta = np.exp(digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True)))
                share = bag / (theta @ beta + 1e-100)
                gamma = 1 / k + theta * (share @ beta.T)
            lam = 1 / k + beta * (theta.T @ share)
        weight = lam[0] / lam[0].sum()
        best = sorted(range(len(words)), key=lambda i: (-round(float(weight[i]), 9), words[i]))[:top]
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in keys}, "rank": range(1, len(best) + 1), "word": [words[i] for i in best], "weight": weight[best]})

    ready = windows.select(*keys, "line_id", word_tokens(F.col("text")).alias("words"))
    kinds = ", ".join(f"{c} {ready.schema[c].dataType.simpleString()}" for c in keys)
    return ready.groupBy(*keys).applyInPandas(fit, f"{kinds}, rank long, word string, weight double")


def latent_sentences(weights: DataFrame, topics: int = 3, by: str = "log_id", key: str = "line_id") -> DataFrame:
    """by, key and score: the length of a line in the space of its log's strongest singular directions (latent semantic analysis).

    A log's lines are gathered in one task, where the matrix of its lines' similarities is decomposed.
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, row = np.unique(pdf[key].to_numpy(), return_inverse=True)
        words, column = np.unique(pdf["token"].to_numpy().astype(str), return_inverse=True)
        matrix = np.zeros((len(ids), len(words)))
        matrix[row, column] = pdf["weight"].to_numpy()
        values, vectors = np.linalg.eigh(matrix @ matrix.T)
        best = np.argsort(-values)[:topics]
        score = np.sqrt((vectors[:, best] ** 2 * np.maximum(values[best], 0)).sum(axis=1))
        return pd.DataFrame({by: pdf[by].iloc[0], key: ids, "score": score})

    return weights.groupBy(by).applyInPandas(fit, f"{by} {weights.schema[by].dataType.simpleString()}, {key} {weights.schema[key].dataType.simpleString()}, score double")


def corpus_topics(points: DataFrame, vector: str, texts: DataFrame, k: int, key: str, top: int = 10) -> DataFrame:
    """topic, rank, word and weight of k clusters of all points by their vectors, in full dimension; texts: key and text."""
    from linewright.operators.clustering import cluster_means

    found = cluster_means(points, vector, k).select(key, F.col("cluster").alias("topic"))
    return topic_words(texts.join(found, key), ["topic"], "text", top)
