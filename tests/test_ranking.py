import numpy as np
import pandas as pd
import pytest

from linewright.operators import features, topics

TEXTS = {"a": ["red fox runs far", "red red fox", "blue bird, far bird", "", "lone zebra", "blue fox bird"], "b": ["one line here"], "c": ["!!", "same words here", "same words here", "words"]}


def brute(weights, n, threshold, rounds=10, damping=0.85):
    w = np.zeros((n, 1 + max((t for _, t in weights), default=0)))
    for (i, t), x in weights.items():
        w[i, t] = x
    s = w @ w.T
    np.fill_diagonal(s, 0)
    if threshold is not None:
        s = (s > threshold).astype(float)
    p = s / np.maximum(s.sum(axis=1, keepdims=True), 1e-300)
    score = np.full(n, 1 / n)
    for _ in range(rounds):
        score = (1 - damping) / n + damping * (p.T @ score)
    return score


@pytest.mark.parametrize("threshold", (None, 0.3))
def test_centrality_without_rows_of_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(topics, "LINKED_CELLS", 5)
    lines = spark.createDataFrame([(log, 3 * i, t) for log, v in TEXTS.items() for i, t in enumerate(v)], "log_id string, line_id long, text string")
    rows = features.tfidf(lines).collect()
    given = features.tfidf_within(lines).where("token is not null").collect()
    assert sorted((r["log_id"], r["line_id"], r["token"], round(r["weight"], 12)) for r in rows) == sorted((r["log_id"], r["line_id"], r["token"], round(r["weight"], 12)) for r in given)
    token = {t: k for k, t in enumerate(sorted({r["token"] for r in rows}))}
    rank = lambda *w: topics.rank_sentences(lines, *w) if threshold is None else topics.lex_rank(lines, *w, threshold=threshold)
    for found in (rank(), rank(features.tfidf(lines))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Parquet" not in plan and "i#" not in plan  # neither tables of links nor joins of lines
        got = {(r["log_id"], r["line_id"]): r["score"] for r in found.collect()}
        assert len(got) == 11
        for log, texts in TEXTS.items():
            want = brute({(r["line_id"] // 3, token[r["token"]]): r["weight"] for r in rows if r["log_id"] == log}, len(texts), threshold)
            assert [got[log, 3 * i] for i in range(len(texts))] == pytest.approx(want.tolist(), abs=1e-9)


def test_links_are_taken_some_lines_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame([("a" if i < 30 else "b", i, int(t), float(rng.random())) for i in range(50) for t in rng.choice(40, 6, False)], columns=["log", "line_id", "token", "weight"])
    whole = topics.ranked_lines(frame, "log", 0.4, 10, 0.85)
    monkeypatch.setattr(topics, "LINKED_CELLS", 100)
    assert np.allclose(whole["score"], topics.ranked_lines(frame.sample(frac=1, random_state=0), "log", 0.4, 10, 0.85).sort_values(["log", "line_id"])["score"])
