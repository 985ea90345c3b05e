import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from linewright.llm import winnow
from linewright.llm._common import bench_words


def brute(docs, items):
    items = [(n, bench_words(t)) for n, t in items]
    out = []
    for doc, text in docs:
        w = bench_words(text)
        hit, names = set(), set()
        for name, iw in items:
            if not iw:
                continue
            k = min(10, len(iw))
            windows = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    names.add(str(name))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "dé", "e1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 6, 9, 10, 11, 14, 30])))) for i in range(12)]
    items += [(99, None), (98, "..."), (7, "repeated id here with words a b c")]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(40)]
    docs += [(100 + i, f"x {rng.choice(items[:12])[1]}, Y. " * 2) for i in range(20)] + [(200, None), (201, ""), (202, items[3][1].upper())]
    return docs, items


def test_matches_brute_force(spark):
    for seed in range(3):
        docs, items = made(seed)
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        assert sorted(map(tuple, winnow.contamination_digest(d, b).collect()), key=repr) == brute(docs, items)


def test_blocks_give_the_same(spark):
    docs, items = made(5)
    d, b = spark.createDataFrame(docs + docs[:3], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = winnow.find_contamination(d, b).selectExpr("doc_id", "n_words", "items").collect()
    many = winnow.find_contamination(d, b, block_words=60).selectExpr("doc_id", "n_words", "items").collect()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, many), key=repr)


def test_query_matches_brute_force(spark, sf_dir):
    d, b = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in d.collect()], [(r["item_id"], r["text"]) for r in b.collect()])
    assert sorted(map(tuple, winnow.contamination_digest(d, b).collect()), key=repr) == want


def test_empty_tables_and_clashes(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, n_words int")
    assert winnow.contamination_digest(d, b).first()["contaminated"] is False
    assert winnow.drop_contaminated(d, b).columns == ["doc_id", "text", "n_words"]
    assert winnow.contamination_digest(d.where("false"), b).count() == 0


def test_repeated_words_cost_no_pairs():
    import time

    for n in (1, 2, 3, 9, 10, 11, 40):
        prints = winnow.Fingerprints([(1, "a " * n), (2, "a " * 25 + "b"), (3, "a " * 2000)])
        began = time.process_time()
        found = {k: (at, which) for k, at, which in winnow.hits(prints, np.array([prints.vocabulary[b"a"]] * 20_000 + [0]))}
        assert time.process_time() - began < 1
        at, which = found[10]
        assert at.tolist() == list(range(19_991)) and len(set(which.tolist())) == 1
        assert n >= 10 or found[n][0].tolist() == list(range(20_001 - n))


def test_repeated_runs_match_brute_force(spark):
    docs = [(1, "a " * 300), (2, "a b " * 80), (3, "a " * 9), (4, "b a " * 5), (5, "x " + "a b " * 5 + "y")]
    items = [(1, "a " * 200), (2, "a b " * 6), (3, "b a " * 30), (4, "a"), (5, "b a b")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, winnow.contamination_digest(d, b).collect()), key=repr) == brute(docs, items)


def test_own_columns_keep_their_values(spark):
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b", 5, "x", "i"), (2, "one two three", 6, "y", "j")], "doc_id long, text string, N_WORDS int, hit_spans string, items string")
    assert list(map(tuple, winnow.drop_contaminated(d, b).collect())) == [(1, "a b", 5, "x", "i")]
    more = spark.createDataFrame([(i, f"w{i} " * 20) for i in range(40)] + [(1, "one two three")], "item_id long, text string")
    many = winnow.find_contamination(d.withColumn("row_0", F.lit(3)), more, block_words=50)
    assert sorted((r["doc_id"], r["row_0"], len(r["items"])) for r in many.collect()) == [(1, 3, 0), (2, 3, 1)]
