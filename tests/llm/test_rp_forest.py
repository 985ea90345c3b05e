import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from linewright.llm import rp_forest


def brute(rows, every, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    ids = np.array([i for i, _ in good])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def got(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_on_the_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in v.collect()], 20)
    for share, least in ((0.8, 100), (9.0, 4000)):
        rp_forest.LEAST = least
        found = got(rp_forest.nearest(v, F.col("vec_id") % 20 == 0, share=share))
        rp_forest.LEAST = 4000
        recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 5 for q in want])
        assert set(found) == set(want) and all(len(x) == 5 for x in found.values())
        assert recall >= (0.9 if share < 1 else 1.0)
        by = {q: dict(x) for q, x in want.items()}
        assert all(abs(s - by[q][i]) < 1e-12 for q, x in found.items() for i, s in x if i in by[q])


def test_copies_bad_vectors_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    same = rng.normal(size=64).tolist()
    rows = [(i, same) for i in range(200)] + [(1000 + i, rng.normal(size=64).tolist()) for i in range(100)]
    rows += [(5000, None), (5010, [0.0] * 64), (5020, [float("nan")] * 64), (5030, [1.0, None] * 32), (5040, [1.0] * 3), (None, same), (5050, [float("inf")] * 64), (5060, [])]
    v = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, rank int")
    monkeypatch.setattr(rp_forest, "BLOCK", 3)
    found = got(rp_forest.nearest(v, F.col("vec_id") % 50 == 0))
    want = brute([(a, b and np.array([np.nan if x is None else x for x in b], np.float32).tolist()) for a, b in rows], 50)
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert found[0][0][0] == 1 and found[50][0][0] == 0
    assert rp_forest.nearest(v.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert rp_forest.nearest(v.where("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0
