import random

import numpy as np

from linewright.llm import near_dups
from linewright.llm._common import space_words


def brute(docs):
    sets = []
    for _, t in docs:
        w = space_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            n = len(s & sets[j])
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(docs[i][0]), find(docs[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d), find(d) == d) for (d, _), s in zip(docs, sets, strict=True))


def family(seed, n=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    out = []
    for i in range(n):
        words = list(base) if i % 3 else [f"v{rng.randrange(50)}" for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(6)):
            if words:
                words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        out.append((i * 7 + 3, " ".join(words)))
    return out


def run(spark, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(map(tuple, near_dups.near_duplicates(d).collect()))


EDGES = [(1, None), (2, ""), (4, " \t\n"), (5, "a b c"), (6, "A  B\tc"), (8, "a b c d"), (9, "one"), (10, "x " * 6000), (11, "x " * 5000)]


def test_family_and_edges(spark):
    docs = family(1) + EDGES
    assert run(spark, docs) == brute(docs)


def test_blocks_give_the_same(spark, monkeypatch):
    docs = family(2)
    monkeypatch.setattr(near_dups, "FAMILY_BLOCK", 9)
    monkeypatch.setattr(near_dups, "BUCKET_BLOCK", 7)
    assert run(spark, docs) == brute(docs)


def test_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert run(spark, docs) == brute(docs)


def test_repeated_ids_nulls_and_empty(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, near_dups.near_duplicates(d).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)], key=repr)
    assert near_dups.near_duplicates(d.where("false")).count() == 0


def test_estimates_are_near(spark):
    rng = np.random.default_rng(3)
    own = [np.unique(rng.integers(0, 2**64, 700, dtype=np.uint64))]
    own.append(np.unique(np.concatenate([own[0][:600], rng.integers(0, 2**64, 100, dtype=np.uint64)])))
    s = near_dups.odd_sketches(near_dups.min_hashes(own, near_dups._A, near_dups._B))
    assert abs(near_dups.estimates(s[0], s[1:])[0] - 0.75) < 0.15


def exact(spark, own, buckets):
    """Root by place of what exact_links links; buckets: bucket and members."""
    marks = near_dups.odd_sketches(near_dups.min_hashes(own, near_dups._A, near_dups._B))
    rows = [(i, bytearray(s.tobytes()), bytearray(m.tobytes())) for i, (s, m) in enumerate(zip(own, marks, strict=True))]
    table = spark.createDataFrame(rows, "rep long, shingles binary, sketch binary").cache()
    shared = spark.createDataFrame([(b, i, len(x)) for b, x in buckets.items() for i in x], "bucket long, rep long, n long")
    links = near_dups.exact_links(shared, table.select("rep", "sketch"), lambda f: table.select("rep", "shingles").join(f, "rep", "left_semi"))
    root = {r["node"]: r["component"] for r in near_dups.components(links).collect()}
    table.unpersist()
    return [root.get(i, i) for i in range(len(own))]


def linked(own):
    root = list(range(len(own)))
    for i, s in enumerate(own):
        for j in range(i):
            n = len(np.intersect1d(s, own[j]))
            if 100 * n >= 75 * (len(s) + len(own[j]) - n):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_hot_bucket_is_compared_across_blocks(spark, monkeypatch):
    """Pairs of a bucket whose members are all unlike otherwise, and a chain whose ends are unlike."""
    monkeypatch.setattr(near_dups, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dups, "FAMILY_BLOCK", 3)
    rng = np.random.default_rng(11)
    fresh = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    own = []
    for _ in range(30):
        own.append(fresh(400))
        own.append(np.concatenate([own[-1][:370], fresh(30)]))
    for _ in range(6):
        own.append(np.concatenate([own[-1][50:], fresh(50)]))
    own = [np.unique(s) for s in own]
    assert exact(spark, own, {7: range(len(own))}) == linked(own)


def test_members_between_two_leaders_are_linked(spark, monkeypatch):
    """x and y are alike, each is nearest to another set that isn't like the other's."""
    rng = np.random.default_rng(12)
    fresh = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    own = []
    for _ in range(25):
        x = fresh(400)
        y = np.concatenate([x[:350], fresh(50)])
        own += [np.concatenate([x[60:320], fresh(140)]), np.concatenate([y[100:], fresh(150)]), x, y]
    own = [np.unique(s) for s in own]
    want = linked(own)
    buckets = {b: range(4 * b, 4 * b + 4) for b in range(25)}
    assert sum(want[4 * b + 2] == want[4 * b + 3] for b in range(25)) == 25
    assert exact(spark, own, buckets) == want
    monkeypatch.setattr(near_dups, "BUCKET_BLOCK", 2)
    monkeypatch.setattr(near_dups, "FAMILY_BLOCK", 1)
    assert exact(spark, own, buckets) == want


def test_ids_with_different_texts(spark):
    """Every row of an id is one document with it, empty rows included."""
    rng = random.Random(13)
    text = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    rows, want = [], {}
    for g in range(12):
        one, other = text(60), text(80)
        near = lambda words: " ".join(["e", *words[1:]])
        ids = [100 * g + 50, 100 * g + 7, 100 * g + 20, 100 * g + 90]
        rows += [(ids[0], " ".join(one)), (ids[0], " ".join(other)), (ids[0], None), (ids[0], "a b"), (ids[1], near(one)), (ids[2], near(other)), (ids[3], " ".join(other))]
        want |= dict.fromkeys(ids, ids[1])
    rows += [(5000, "x y z"), (5000, ""), (5001, None)]
    want |= {5000: 5000, 5001: 5001}
    for g in range(12):  # "a b" is a text of every group, which makes all of them one
        want |= dict.fromkeys([100 * g + 50, 100 * g + 7, 100 * g + 20, 100 * g + 90], 7)
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in got)


def test_clashing_columns_and_very_long_texts(spark):
    rng = random.Random(14)
    long = [f"w{rng.randrange(90000)}" for _ in range(300_000)]
    word = "q" * 2_000_000
    texts = [" ".join(long), " ".join([*long[:-1], "other"]), " ".join([word, "a", "b", "c", "d", "e"]), f"{word} a b c d e", f"{word}z a b c d e"]
    frame = spark.createDataFrame([(9 - i, t, "x", 1, 2, "s") for i, t in enumerate(texts)], "doc_id long, text string, rep string, bucket int, component_id int, sketch string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(frame).collect()}
    assert got == {9: (299_996, 8), 8: (299_996, 8), 7: (2, 6), 6: (2, 6), 5: (2, 5)}
    kept = near_dups.drop_near_duplicates(frame)
    assert kept.columns == frame.columns and sorted((r["doc_id"], r["rep"], r["bucket"], r["component_id"], r["sketch"]) for r in kept.collect()) == [(5, "x", 1, 2, "s"), (6, "x", 1, 2, "s"), (8, "x", 1, 2, "s")]


def test_small_tables_are_few_files(spark, monkeypatch):
    """However many partitions shuffles have: each file is two processes of an executor, or requests to a store."""
    from pathlib import Path

    from linewright.plans import lineage

    files = {}
    write = lineage.Table.__init__

    def counted(self, df, name):
        write(self, df, name)
        files[name] = len(list(Path(self.path).glob("part-*")))

    monkeypatch.setattr(lineage.Table, "__init__", counted)
    docs = family(15, 200)
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        assert run(spark, docs) == brute(docs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 10 and max(files.values()) <= 2 * spark.sparkContext.defaultParallelism
