import math

import numpy as np
import pytest

from linewright.llm import toxicity as tox


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = tox.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    pos = np.array([r["score"] for r in rows if r["toxic"] == 1])
    neg = np.array([r["score"] for r in rows if r["toxic"] == 0])
    auc = (pos[:, None] > neg[None, :]).mean()
    caught, false = (pos >= tox.LIKELY).mean(), (neg >= tox.LIKELY).mean()
    print(len(pos), len(neg), auc, caught, false)
    assert auc > 0.96 and caught > 0.85 and false < 0.01


def test_finds_the_sentence():
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(300):
        parts = [" ".join(rng.choice(plain, 6)) for _ in range(5)]
        if i % 3 == 0:
            parts[2] += f" vile{rng.integers(9)}x"
        texts.append(". ".join(parts))
        labels.append(int(i % 3 == 0))
    weights, bias = tox.fit(texts, np.array(labels), np.ones(len(texts)))
    score, n, worst, sentence = tox.score_text("w1 w2. w3 vile7x w4. w5", weights | {"": bias}, {})
    assert score > 0.7 and n == 3 and "vile7x" in sentence
    assert tox.score_text("w1 w2. w3 w4. w5", weights | {"": bias}, {})[0] < 0.5


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, " .!", 0.5), (3, "idiot " * 30000, 0.5), (3, "idiot", 0.5)], "doc_id long, text string, tox_score double")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    out = tox.toxicity(docs, labels)
    assert out.count() == 5 and all(0 <= r["score"] <= 1 for r in out.collect())
    assert tox.toxicity(docs.where("false"), labels.where("false")).count() == 0
    assert tox.drop_toxic(docs, labels).columns == docs.columns


def test_own_columns_and_repeated_labels(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} {'vile' if i % 2 else 'kind'} word", "own", 9.5) for i in range(60)] + [(3, "vile word", "own", 9.5)], "doc_id long, text string, worst_sentence string, worst_score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(i, 0) for i in range(60)], "doc_id long, toxic int")
    kept = tox.drop_toxic(docs, labels).collect()
    assert kept and all(r["worst_score"] == 9.5 and r["worst_sentence"] == "own" for r in kept)
    assert not any("vile" in r["text"] for r in kept) and any("kind" in r["text"] for r in kept)


def test_scores_match_noisy_or_by_hand():
    """Each document's score is one minus the product of its sentences' chances of being clean."""
    model = {"": -2.0, "=bad": 3.0, "^bad": 0.5, "$ad!": 1.0, "=worse": 4.0}
    for text in ("bad. fine", "Bad worse bad! ok\nbad", "fine", "bad, (worse)", ""):
        none = 1.0
        for s in tox.sentences(text):
            bare = {w for x in set(s.split()) if (w := x.strip(tox.EDGE))}
            z = sum(model.get(f, 0.0) for x in dict.fromkeys(s.split()) for f in (tox.features(x.strip(tox.EDGE)) if x.strip(tox.EDGE) else []))
            assert bare or not s.strip(tox.EDGE + " ")
            none *= 1 / (1 + math.exp(z - 2.0))
        assert tox.score_text(text, model, {})[0] == pytest.approx(1 - none, abs=1e-12)
