import random
import zlib
from collections import Counter, defaultdict

from linewright.llm import packing


def plain_best_fit(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fit = [(r, i) for i, r in enumerate(rooms) if r >= s]
        i = min(fit)[1] if fit else len(rooms)
        if not fit:
            rooms.append(max(capacity, s))
        rooms[i] -= s
        out.append(i)
    return out


def test_runs_are_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(50):
        sizes = sorted((rng.randrange(1, 40) for _ in range(60)), reverse=True)
        classes = sorted(Counter(sizes).items(), reverse=True)
        runs = packing.best_fit(classes, 97)
        got = Counter()
        for p, b, n in runs:
            got[classes[p][0], b] += n
        assert got == Counter(zip(sizes, plain_best_fit(sizes, 97), strict=True))
        assert max(packing.fixed_capacity(sizes, 97)) == max(plain_best_fit(sizes, 97))


def checked(rows, docs, shards=40):
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in docs)
    slots, weight = defaultdict(list), Counter()
    text = defaultdict(set)
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes"
        slots[r["shard"]].append(r["slot"])
        weight[r["shard"]] += r["size"]
        text[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in text.values())
    return weight


def test_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = packing.shard(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    weight = checked(rows, docs)
    biggest = max(sum(len((t or "").encode()) + 16 for t in x) for x in [[t] * n for t, n in Counter(t for _, t in docs).items()])
    mean = sum(weight.values()) / 40
    assert max(weight.values()) <= max(biggest, mean * 1.01)
    by_id = dict(docs)
    assert all(r["text_crc32"] == zlib.crc32((by_id[r["doc_id"]] or "").encode()) for r in rows)


def test_hot_group_nulls_and_clashes(spark):
    docs = [(i, "same text") for i in range(400)] + [(1000 + i, f"t{i} " * (i % 50)) for i in range(700)] + [(None, "x"), (5, None), (6, ""), (1000, "t0")]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, shard int")
    weight = checked(packing.shard(d).collect(), docs)
    rest = sorted(weight.values())[:-1]
    assert rest[-1] <= rest[0] * 1.2
    assert packing.shard(d.where("false")).count() == 0


def test_own_columns_keep_their_values(spark):
    docs = spark.createDataFrame([(1, "a", 1, 2, "k", 4, "f", True)], "doc_id long, text string, first int, _r int, _key string, _run int, _FIRST string, _hot boolean")
    r = packing.shard(docs).first()
    assert (r["first"], r["_r"], r["_key"], r["_run"], r["_FIRST"], r["_hot"], r["size"], r["slot"]) == (1, 2, "k", 4, "f", True, 17, 0)
