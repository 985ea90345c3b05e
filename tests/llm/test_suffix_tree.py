import math
import random
import zlib
from collections import Counter

import pytest

from linewright.llm import suffix_tree as st
from linewright.llm._common import space_words


def held(d):
    return zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False


def test_base_scores_match_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(9001, None), (9002, ""), (9003, "Never-Seen words HERE"), (9003, "the the"), (None, "the end")]
    rows = st.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    counts = Counter()
    for d, t in docs:
        if not held(d):
            counts.update(space_words(t))
            counts[st.END] += 1
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for d, t in docs:
        tokens = [*space_words(t), st.END]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        want.append((d, held(d), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6)))
    assert sorted(((*r[:5], round(r["base_score"], 6)) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(math.isfinite(r["score"]) for r in rows)


def test_contexts_help_and_sum_to_one(spark):
    texts = ["the cat sat on a mat", "a dog sat on the cat", "the dog ran to a cat"] * 40
    training = spark.createDataFrame([(t,) for t in texts], "text string")
    tree, rare = st.build_tree(training)
    assert len(tree.levels) == 3 and tree.levels[0].kept.any() and tree.levels[1].kept.any()
    import numpy as np

    words = np.arange(1, tree.width)
    for before in ([], [tree.ids[b"the"]], [tree.ids[b"sat"], tree.ids[b"on"]]):
        mass = 0.0
        for w in words:
            ids = np.array([*before, w])
            stopped = ids.copy()
            mass += 10 ** tree.score(ids, np.where(stopped == tree.end, 0, stopped))[-1]
        unseen = 1 / (tree.total + tree.distinct + 1)
        assert mass <= 1.0 + 1e-9 and mass > 1 - 2 * unseen - 1e-9
    docs = spark.createDataFrame([(1, texts[0]), (2, "mat a on sat cat the")], "doc_id long, text string")
    score = {r["doc_id"]: r for r in st.lm_scores(docs, training).collect()}
    assert score[1]["score"] > score[1]["base_score"] + 2 and score[1]["score"] > score[2]["score"] + 2


def test_empty_and_clashes(spark):
    d = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, score int")
    r = st.lm_scores(d, d.where("false")).first()
    assert r["base_score"] == pytest.approx(0) and r["n_known"] == 0 and r["train_tokens"] == 0
    assert st.score_documents(d.where("false")).count() == 0


def brute(training, docs, depth):
    """log10 probabilities of docs by a tree of dictionaries, grown and tested context by context."""
    texts = [[*space_words(t), st.END] for t in training]
    counts = Counter(w for t in texts for w in t)
    total, distinct = sum(counts.values()), len(counts)
    least = lambda share: max(2.0, total * share)
    symbols = {w for w, n in counts.items() if n >= least(st.SYMBOL)}
    inner = {w for w, n in counts.items() if n >= least(st.CONTEXT)} - {st.END}
    base = lambda w: (counts[w] + 1) / (total + distinct + 1)
    states: dict[tuple, tuple[float, dict]] = {}  # of the contexts that are kept: back-off weight and distribution

    def chance(context, w):
        p = base(w)
        for d in range(1, len(context) + 1):
            if (state := states.get(context[-d:])) is not None:
                p = state[1].get(w, p * state[0])
        return p

    contexts = {(w,): counts[w] for w in inner}
    for d in range(1, depth + 1):
        after: dict[tuple, Counter] = {c: Counter() for c in contexts}
        for t in texts:
            for i in range(d, len(t)):
                if (c := tuple(t[i - d : i])) in after and t[i] in symbols:
                    after[c][t[i]] += 1
        made, grown = {}, {}
        for c, n_all in contexts.items():
            n = {w: x for w, x in after[c].items() if x >= least(st.TRANSITION)}
            if not n:
                continue
            rest = max(n_all - sum(n.values()), 0)
            gamma = (rest + st.DISCOUNT * len(n)) / n_all
            parent = {w: chance(c[1:], w) for w in n}
            ratio = sum(x * math.log(x / n_all / parent[w]) for w, x in n.items())
            if rest:
                ratio += rest * math.log(rest / n_all / max(1 - sum(parent.values()), 1e-12))
            if 2 * ratio > len(n) + 4 * math.sqrt(2 * len(n)) + 4:
                made[c] = (gamma, {w: (x - st.DISCOUNT) / n_all + gamma * parent[w] for w, x in n.items()})
            grown |= {(*c, w): x for w, x in n.items() if x >= least(st.CONTEXT) and w in inner}
        states |= made
        contexts = grown
    out = []
    for t in docs:
        words = [*space_words(t), st.END]
        out.append(sum(math.log10(chance(tuple(words[max(0, i - depth) : i]), w)) for i, w in enumerate(words)))
    return out, states


def test_scores_match_a_tree_of_dictionaries(spark):
    rng = random.Random(3)
    chain = {w: rng.sample("abcdefgh", 3) for w in "abcdefgh"}
    texts = []
    for _ in range(150):
        words = [rng.choice("abcdefgh")]
        while len(words) < 30:
            words.append(rng.choice(chain[words[-1]]) if len(words) < 3 or words[-3] != "a" else "h")
        texts.append(" ".join(words) + rng.choice(["", f" rare{rng.randrange(60)}"]))
    texts += [None, "", "a", "zz yy"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for depth in (1, 2, 3, 4):
        want, states = brute(texts, texts, depth)
        assert depth == 4 or {len(c) for c in states} == set(range(1, depth + 1))
        got = {r["doc_id"]: r["score"] for r in st.lm_scores(frame, frame, depth).collect()}
        assert all(got[i] == pytest.approx(w, abs=1e-6) for i, w in enumerate(want))


def test_own_columns_keep_their_values(spark):
    d = spark.createDataFrame([(1, "a b a b c", 1, "x", 3, 4, 5)], "doc_id long, text string, _log int, _rare string, _row int, _TIMES int, _known int")
    r = st.lm_scores(d, d).first()
    assert (r["_log"], r["_rare"], r["_row"], r["_TIMES"], r["_known"], r["n_tokens"]) == (1, "x", 3, 4, 5, 6)


def test_rare_contexts_of_a_large_corpus_are_kept(spark):
    rng = random.Random(5)
    common = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choices(common, k=2000)) for _ in range(250)]
    texts += ["w1 quite seldom heard phrases w2", "w3 quite seldom heard phrases w4"]
    texts += [f"first{i} middle last{i}" for i in range(5) for _ in range(4)]
    docs = ["first1 middle last1", "first1 middle last2", "w5 quite seldom heard phrases w6", "w5 heard seldom phrases quite w6", "w7 quite seldom heard w2"]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in st.lm_scores(frame, spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got[0] > got[1] + 1 and got[2] > got[3] + 5
    want, states = brute(texts, docs, st.DEPTH)
    assert (b"quite",) in states and (b"first1", b"middle") in states
    assert all(got[i] == pytest.approx(w, abs=1e-6) for i, w in enumerate(want))


def test_scores_do_not_depend_on_the_parts(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(["the cat sat on"] * rng.randrange(4) + rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randrange(60)) + ["the", "cat", "sat"]) for _ in range(150)]
    texts += ["the cat", None, "the", " ".join(["on"] * 300), "never seen"]
    rows = [(i, t) for i, t in enumerate(texts)]
    training, asked = [t for i, t in rows if i % 3], rows
    want, _ = brute(training, [t for _, t in asked], st.DEPTH)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    whole = st.parts.find_hot
    monkeypatch.setattr(st.parts, "find_hot", lambda *a: found.append(whole(*a)) or found[-1])
    for size, per, common in ((250_000, 8, 1e-6), (120, 3, 1e-6), (120, 1, 0.01), (20, 2, 0.5)):
        for name, value in (("CELL_SIZE", size), ("PART_CELLS", per), ("COMMON", common), ("HELD", 10 * size)):
            monkeypatch.setattr(st, name, value)
        got = {r["doc_id"]: r["score"] for r in st.lm_scores(frame, frame.where("doc_id % 3 > 0")).collect()}
        assert len(got) == len(rows) and all(got[i] == pytest.approx(w, abs=1e-6) for i, w in enumerate(want))
    assert [len(h.codes) and len(h.codes[-1]) > 0 and len(h.codes) for h in found][1:] == [3, 3, 3]
