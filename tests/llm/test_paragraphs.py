import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from linewright.llm import groups, paragraphs
from linewright.llm._common import space_words
from linewright.llm.shingles import text_words


def cut(words):
    found = paragraphs.Paragraphs(*text_words(pa.array([b" ".join(words).decode()])))
    return list(zip(found.first.tolist(), found.end.tolist(), strict=True))


def planted(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(30000)}"
    passages = [[word() for _ in range(51 + i % 20)] for i in range(40)]
    docs, has = [], defaultdict(set)
    for i in range(300):
        words = [word() for _ in range(rng.randrange(40, 400))]
        if i < 160:
            p = i % 40
            cut = rng.randrange(len(words))
            words[cut:cut] = passages[p] if i % 5 else [*passages[p][:20], "edited", *passages[p][21:]]
            has[p].add(i)
        docs.append((i, " ".join(words)))
    return docs, has


def test_planted_passages_and_clean_documents(spark):
    docs, has = planted()
    docs += [(500, None), (501, ""), (502, "the " * 3000), (503, "the " * 2900), (504, "a b c d e f g h i j k l"), (505, "x | y | z | " * 200)]
    rows = paragraphs.repeated_passages(spark.createDataFrame([*docs, (None, docs[0][1])], "doc_id long, text string")).collect()
    caught = {r["doc_id"] for r in rows}
    assert not caught - set(range(160))
    assert len(caught) >= 0.96 * 160
    text = {d: space_words(t) for d, t in docs}
    by = defaultdict(list)
    for r in rows:
        by[r["component_id"]].append(r)
    for group in by.values():
        assert len({r["doc_id"] for r in group}) > 1 and sum(not r["removed"] for r in group) == 1
        assert all(r["group_size"] == len(group) for r in group)
        # every member is like another one, by brute force
        sets = [{tuple(text[r["doc_id"]][i : i + 5]) for i in range(r["first_word"], r["end_word"] - 4)} for r in group]
        for i, s in enumerate(sets):
            assert any(100 * len(s & x) >= 75 * len(s | x) for j, x in enumerate(sets) if j != i)


def test_table_against_brute_force(spark):
    docs = {r["doc_id"]: space_words(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = paragraphs.repeated_passages(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    got = {(r["doc_id"], r["first_word"], r["end_word"]) for r in rows}
    all_, of = [], defaultdict(list)
    for d, w in docs.items():
        for a, b in cut(w):
            s = frozenset(tuple(w[i : i + 5]) for i in range(a, b - 4))
            for x in s:
                of[x].append(len(all_))
            all_.append(((d, a, b), s))
    want = set()
    for i, (p, s) in enumerate(all_):
        for j in {j for x in s for j in of[x] if j < i}:
            q, t = all_[j]
            if p[0] != q[0] and 100 * len(s & t) >= 75 * len(s | t):
                want |= {p, q}
    assert got <= want | got and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(got)


def test_empty(spark):
    assert paragraphs.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def alike(docs):
    """Pairs of paragraphs (doc, first, end) at a Jaccard of 0.75 or more that don't overlap in a document."""
    of, all_, out = defaultdict(list), [], []
    for d, t in docs:
        w = space_words(t)
        for a, b in cut(w):
            all_.append(((d, a, b), frozenset(tuple(w[i : i + 5]) for i in range(a, b - 4))))
            for x in all_[-1][1]:
                of[x].append(len(all_) - 1)
    for i, (p, s) in enumerate(all_):
        for q, t in (all_[j] for j in {j for x in s for j in of[x] if j < i}):
            if 100 * len(s & t) >= 75 * len(s | t) and (p[0] != q[0] or p[2] <= q[1] or q[2] <= p[1]):
                out.append((p, q))
    return out


def found(spark, docs):
    rows = paragraphs.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return {(r["doc_id"], r["first_word"], r["end_word"]): r["component_id"] for r in rows}


def test_no_near_pair_is_missed(spark):
    rng = random.Random(5)
    docs = []
    for i in range(250):
        words = [f"w{rng.randrange(30000)}" for _ in range(160)]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(f"e{i}x{k}" if k % 40 == 20 else w for k, w in enumerate(words)))]
    pairs, got = alike(docs), found(spark, docs)
    edited = lambda p: any(w[0] == "e" for w in docs[p[0]][1].split()[p[1] : p[2]])
    near = [(p, q) for p, q in pairs if edited(p) != edited(q)]
    assert len(near) > 30 and all(got.get(p) is not None and got.get(p) == got.get(q) for p, q in near)


def test_similar_passages_with_the_same_documents_are_linked(spark):
    rng = random.Random(6)
    docs = []
    for i in range(0, 40, 2):
        word = lambda: f"w{rng.randrange(30000)}"
        passage = [word() for _ in range(120)]
        words = [*passage, *[word() for _ in range(30)], *[word() if k % 40 == 20 else w for k, w in enumerate(passage)]]
        docs += [(i, " ".join(words)), (i + 1, " ".join(words))]
    pairs, got = alike(docs), found(spark, docs)
    text = {d: t.split() for d, t in docs}
    near = [(p, q) for p, q in pairs if text[p[0]][p[1] : p[2]] != text[q[0]][q[1] : q[2]] and p[0] != q[0] and abs(p[1] - q[1]) > 100]
    assert len(near) > 10 and all(got.get(p) is not None and got.get(p) == got.get(q) for p, q in near)


def brute(docs):
    """Rows of repeated_passages but the component's name, by comparing every two paragraphs."""
    all_ = []
    for d, t in docs:
        w = space_words(t)
        for a, b in cut(w) if d is not None else ():
            all_.append((d, a, b, frozenset(tuple(w[i : i + 5]) for i in range(a, b - 4))))
    root = list(range(len(all_)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(all_):
        for j, y in enumerate(all_[:i]):
            n = len(x[3] & y[3])
            if 100 * n >= 75 * (len(x[3]) + len(y[3]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, x in enumerate(all_):
        groups[find(i)].append(x)
    return sorted((x[0], x[1], x[2], len(g), min(y[0] for y in g)) for g in groups.values() if len({y[0] for y in g}) > 1 for x in g)


def rows_of(spark, docs):
    rows = paragraphs.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all((r["removed"] is False) <= (r["doc_id"] == r["leader_doc_id"]) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["component_id"]].append(r["removed"])
    assert all(False in x for x in by.values())
    return sorted((r["doc_id"], r["first_word"], r["end_word"], r["group_size"], r["leader_doc_id"]) for r in rows)


def test_repeated_ids_with_texts_of_different_lengths(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(30000)}" for _ in range(n))
    passage, other = text(70), text(90)
    docs = [(1, f"{text(30)} {passage} {text(40)}"), (1, "short"), (1, None), (1, f"{other} {text(300)}"), (2, f"{passage} {text(20)}"), (3, other), (3, text(9)), (4, f"{text(200)} {other}")]
    got = rows_of(spark, docs)
    assert got == brute(docs) and {x[0] for x in got} == {1, 2, 3, 4}


def test_clashing_columns_and_repeated_rows(spark):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(30000)}" for _ in range(60))
    docs = [(1, text), (1, text), (2, text), (3, text.upper())]
    frame = spark.createDataFrame([(d, t, "x", "y", 5) for d, t in docs], "doc_id long, text string, class string, first string, rep int")
    got = sorted((r["doc_id"], r["first_word"], r["group_size"], r["removed"]) for r in paragraphs.repeated_passages(frame).collect())
    assert got == sorted((d, a, 4, d != 1) for d, t in docs for a, b in cut(space_words(t)) if True)


def near_copies(rng, n, words=40):
    """Texts that share a start of ten words with all and a body with few, some of them edited."""
    common = [f"c{i}" for i in range(14)]
    out = []
    for i in range(n):
        body = [f"w{rng.randrange(30000)}" for _ in range(words)] if i % 3 == 0 or not out else list(out[-1][14:])
        if i % 3 == 2:
            body[rng.randrange(words)] = f"e{i}"
        out.append([*common, *body])
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_hot_bands_are_dealt_anew_without_loss(spark, monkeypatch):
    docs = near_copies(random.Random(10), 150)
    want = brute(docs)
    monkeypatch.setattr(groups, "SMALL", 3)
    assert rows_of(spark, docs) == want
    monkeypatch.setattr(paragraphs, "BLOCK", 4)
    monkeypatch.setattr(paragraphs, "BROADCAST_IDS", 0)
    assert rows_of(spark, docs) == want


def test_large_bands_keep_every_component(monkeypatch):
    """Links of sets with a large common part, of near copies and of unlike sets, against all pairs."""
    monkeypatch.setattr(groups, "SMALL", 4)
    rng = np.random.default_rng(4)
    fresh = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    for case in range(12):
        core, own = fresh(case), []
        for i in range(120):
            near = own[rng.integers(0, len(own))].copy() if i % 3 and own else np.concatenate([core, fresh(rng.integers(2, 20))])
            if i % 3:
                near[rng.integers(0, len(near), rng.integers(0, 4))] = fresh(1)
            own.append(np.unique(near))
        sets = paragraphs.Sets(pa.array([s.tobytes() for s in own], pa.binary()))
        everyone = groups.pairs_within(np.array([0]), np.array([len(own)]))
        assert len(everyone[0]) == 120 * 119 // 2
        on = sets.alike(*everyone)
        assert on.tolist() == [100 * (n := len(np.intersect1d(own[a], own[b]))) >= 75 * (len(own[a]) + len(own[b]) - n) for a, b in zip(*everyone, strict=True)]
        want = groups.joined(len(own), everyone[0][on], everyone[1][on])
        for links in (sets.among(np.arange(len(own))), [sets.closure(np.arange(len(own)))]):
            i, j = (np.concatenate(x) for x in zip(*links, strict=True))
            assert sets.alike(i, j).mean() > 0 if len(i) else True
            assert groups.joined(len(own), i, j).tolist() == want.tolist()
