import itertools
import math
import random

import numpy as np
import pytest

from linewright.operators import clustering, distances, experiments, metrics


def points(n=24, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.3, size=(n // 3, 2)) for c in (0, 4, 9)])
    return x, np.linalg.norm(x[:, None] - x[None], axis=2)


def frames(spark, matrix, log=1):
    n = len(matrix)
    p = spark.createDataFrame([(log, i) for i in range(n)], "log_id long, line_id long")
    d = spark.createDataFrame([(log, i, j, float(matrix[i, j])) for i in range(n) for j in range(i + 1, n)], "log_id long, i long, j long, d double")
    return p, d


def partition(labels):
    out = {}
    for i, c in labels:
        out.setdefault(c, set()).add(i)
    return sorted(map(sorted, out.values()))


def test_every_method_finds_the_blobs(spark):
    x, m = points()
    p, d = frames(spark, m)
    want = [list(range(8)), list(range(8, 16)), list(range(16, 24))]
    for df in (
        clustering.cluster_medoids(p, d, 3), clustering.cluster_linkage(p, d, 3), clustering.cluster_linkage(p, d, 3, "ward"), clustering.dbscan_pairs(p, d, 1.5),
        clustering.dbscan(p, d, 1.5, 3), clustering.cluster_density(p, d, 4),
    ):
        assert partition((r["line_id"], r["cluster"]) for r in df.collect()) == want
    best = metrics.best_per_key(clustering.sweep_medoids(p, d).select("log_id", "k", "silhouette").distinct(), ["log_id"], "silhouette", "k").first()
    assert best["k"] == 4 or best["k"] == 2 or best["k"] == 3


def test_density_against_plain_python(spark):
    rng = random.Random(5)
    n, eps, least = 30, 0.2, 4
    x = [(rng.random(), rng.random()) for _ in range(n)]
    m = np.array([[math.dist(a, b) for b in x] for a in x])
    near = [[j for j in range(n) if m[i, j] <= eps] for i in range(n)]
    core = [len(v) >= least for v in near]
    label = [-1] * n
    for i in range(n):
        if core[i] and label[i] == -1:
            stack = [i]
            while stack:
                a = stack.pop()
                if label[a] == -1:
                    label[a] = i
                    stack += [b for b in near[a] if core[b]]
    for i in range(n):
        if not core[i]:
            label[i] = min((label[j] for j in near[i] if core[j]), default=-1)
    p, d = frames(spark, m)
    got = {r["line_id"]: r["cluster"] for r in clustering.dbscan(p, d, eps, least).collect()}
    roots = sorted({v for v in label if v >= 0})
    assert [got[i] for i in range(n)] == [roots.index(v) if v >= 0 else -1 for v in label]


def test_links_and_completion():
    _, m = points()
    labels, objective, _ = clustering.medoids(m, 3, must=[(0, 8)])
    assert labels[0] == labels[8]
    labels, _, _ = clustering.medoids(m, 3, cannot=[(0, 1)])
    assert labels[0] != labels[1]
    more = clustering.complete(m, np.zeros(24, int), 4, must=[(0, 1)])
    assert len(set(more)) == 4 and more[0] == more[1] == 0
    with pytest.raises(ValueError):
        clustering.complete(np.zeros((2, 2)), np.zeros(2, int), 2, must=[(0, 1)])
    assert clustering.candidate_k(3) == [2] and clustering.candidate_k(2) == [] and clustering.candidate_k(12)[-1] == 11


def test_build_and_swap_is_best_on_small_inputs():
    rng = np.random.default_rng(2)
    for _ in range(10):
        x = rng.random((8, 2))
        m = np.linalg.norm(x[:, None] - x[None], axis=2)
        best = min(m[:, list(c)].min(axis=1).sum() for c in itertools.combinations(range(8), 2))
        assert clustering.medoids(m, 2)[1] <= best * 1.1 + 1e-9


def test_small_logs_and_empty(spark):
    p, d = frames(spark, np.zeros((1, 1)))
    assert clustering.sweep_medoids(p, d).first()["k"] == 1
    assert clustering.cluster_medoids(p.where("false"), d, 2).count() == 0
    assert clustering.dbscan_pairs(p, d, 0.5).first()["cluster"] == -1


def test_silhouette_and_rand_match_plain_python(spark):
    _, m = points(12, 3)
    labels = [0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 3]
    p, d = frames(spark, m)
    got = metrics.silhouette(d, spark.createDataFrame([(1, i, c) for i, c in enumerate(labels)], "log_id long, line_id long, cluster long")).first()["silhouette"]
    assert got == pytest.approx(clustering.silhouette_of(m, np.array(labels)))
    same = spark.createDataFrame([(1, 1), (2, 2), (2, 2)], "a int, b int")
    assert metrics.adjusted_rand(same, "a", "b", []).first()["ari"] == pytest.approx(1.0)


def test_weights_are_checked_and_zero_weights_pruned(spark):
    f = spark.createDataFrame([(1, 0, ["a"], [1.0]), (1, 1, ["a", "b"], [0.0]), (1, 2, [], [2.0])], "log_id long, line_id long, variables array<string>, vec array<double>")
    with pytest.raises(ValueError):
        distances.combine(f, (0.9, 0.9, 0.0))
    plan = distances.combine(f, (1.0, 0.0, 0.0))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "sqrt" not in plan.lower()
    both = {(r["i"], r["j"]): r["d"] for r in distances.combine(f, (0.0, 1.0, 0.0)).collect()}
    assert both[0, 1] == 0.5 and both[0, 2] == 0.0
    with pytest.raises(ValueError):
        distances.vector_distance("none")
    assert experiments.preference_trial(0.25, 0.5) == (0.25, 0.375, 0.375)


def test_topics_hold_all_words(spark):
    from linewright.operators import topics

    docs = spark.createDataFrame([(i, " ".join(f"word{100 * i + j}" for j in range(100))) for i in range(25)], "doc_id long, text string").coalesce(2)
    rows = topics.lda_topics(docs, 2, top=3000, rounds=1).collect()
    assert len({r["word"] for r in rows}) == 2500 and len(rows) == 5000


def plain_topics(docs, k, rounds, part_of):
    """Weights of all words by topic: online variational inference with one matrix, text by text, in plain steps to a finer end."""
    import re
    from collections import Counter

    from linewright.operators import topics

    digamma, trigamma = (lambda x, f=f: f(np.asarray(x, float)) for f in (topics.digamma, topics.trigamma))
    assert digamma([1.0])[0] == pytest.approx(-0.5772156649) and trigamma([1.0])[0] == pytest.approx(np.pi**2 / 6)
    texts = [(part_of[t], Counter(re.findall(r"[^\W]{2,}", t.lower()))) for t in docs]
    words = sorted({w for _, c in texts for w in c})
    place = {w: i for i, w in enumerate(words)}
    lam = topics.starts(np.array([part_of["id", w] for w in words]), k)
    alpha = np.full(k, 1 / k)
    sizes = Counter(p for p, c in texts if c)
    for n in range(1, rounds + 1):
        if not (size := sizes[n - 1]):
            continue
        beta = np.exp(digamma(lam) - digamma(lam.sum(axis=1, keepdims=True)))
        sums, logs = np.zeros(lam.shape), np.zeros(k)
        for p, c in texts:
            if p != n - 1 or not c:
                continue
            ids, times = np.array([place[w] for w in c]), np.array(list(c.values()))
            gamma, change = np.ones(k), 1.0
            while change > 1e-9:
                theta = np.exp(digamma(gamma) - digamma(gamma.sum()))
                new = alpha + theta * (beta[:, ids] @ (times / (theta @ beta[:, ids])))
                change, gamma = np.abs(new - gamma).mean(), new
            theta = np.exp(digamma(gamma) - digamma(gamma.sum()))
            logs += np.log(theta)
            np.add.at(sums.T, ids, (theta[:, None] * beta[:, ids] * (times / (theta @ beta[:, ids]))).T)
        rate = (1024 + n) ** -0.51
        lam = (1 - rate) * lam + rate * (1 / k + sum(sizes.values()) / size * sums)
        slope = size * (digamma(alpha.sum()) - digamma(alpha) + logs / size)
        c, q = size * trigamma(alpha.sum()), -size * trigamma(alpha)
        alpha = alpha - rate * (slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
    return words, lam / lam.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("cells", (0.5, 60, 4_000_000))
def test_topics_match_one_matrix(spark, monkeypatch, cells):
    """However few words are broadcast, the others' weights, which are joined, give what one matrix of all words gives."""
    from pyspark.sql import functions as F

    from linewright.operators import topics

    monkeypatch.setattr(topics, "COMMON_CELLS", cells)
    monkeypatch.setattr(topics, "FITTED", 1e-8)
    monkeypatch.setattr(topics, "FITTED_CELLS", 90)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'ab'[i % 2]}{int(x)}x" for x in rng.zipf(1.6, 40) % 60) for i in range(30)] + ["", "!!", None, "lone words", "lone words"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    part_of = {r["text"]: r["p"] for r in frame.select("text", F.pmod(F.xxhash64("text"), F.lit(3)).alias("p")).collect()}
    names = {w for t in texts if t for w in t.split()}
    part_of |= {("id", r["w"]): r["id"] for r in spark.createDataFrame([(w,) for w in names], "w string").select("w", F.xxhash64("w").alias("id")).collect()}
    words, want = plain_topics([t for t in texts if t], 2, 3, part_of)
    got = {(r["topic"], r["word"]): r["weight"] for r in topics.lda_topics(frame, 2, top=1000, rounds=3).collect()}
    assert len(got) == 2 * len(words)
    assert all(got[t, w] == pytest.approx(want[t, i], rel=1e-4) for t in range(2) for i, w in enumerate(words))


def test_topics_of_the_most_frequent_words_and_of_none(spark, monkeypatch):
    from linewright.operators import topics

    monkeypatch.setattr(topics, "COMMON_CELLS", 1)
    frame = spark.createDataFrame([("aa aa bb cc", 1), ("aa bb dd", 2), (None, 3)], "text string, n int")
    rows = topics.lda_topics(frame, 2, rounds=2, vocabulary=2).collect()
    assert {r["word"] for r in rows} == {"aa", "bb"} and len(rows) == 4
    assert topics.lda_topics(frame.where("n = 3"), 2).count() == 0
