import random
import re
from collections import Counter

from linewright.functions.text import WILDCARD
from linewright.operators import templates


def lines(seed=0, n=300):
    rng = random.Random(seed)
    forms = ["user {} logged in from host{}", "connection to {} closed after {} ms", "disk {} is full", "start", "", "retry {} of {} for job {}", "retry later"]
    return [rng.choice(forms).format(*(rng.randrange(30) for _ in range(3))) for _ in range(n)]


def frame(spark, texts, logs=3):
    return spark.createDataFrame([(i % logs, i // logs, t) for i, t in enumerate(texts)], "log_id long, line_id long, text string")


def test_invariants(spark):
    texts = lines()
    out = templates.mine_templates(frame(spark, texts), (r"\d+ ms",), depth=3).collect()
    assert len(out) == len(texts)
    for r in out:
        t = r["template"].split()
        assert len(t) == len(r["tokens"])
        assert all(a in (WILDCARD, b) for a, b in zip(t, r["tokens"], strict=True))
        if len(r["tokens"]) < 3:
            assert r["template"] == " ".join(r["tokens"])
        if r["variables"]:
            pattern = r"\s+".join(re.escape(x).replace(re.escape(WILDCARD), "(.*?)") for x in re.sub("<.{1,5}>", WILDCARD, r["template"]).split(" "))
            assert list(re.match(f"^{pattern}$", r["text"]).groups()) == list(r["variables"])
    counts = templates.template_counts(spark.createDataFrame(out)).collect()
    assert sum(r["Occurrences"] for r in counts) == len(texts)


def test_partitions_do_not_matter(spark):
    df = frame(spark, lines(4))
    one = templates.mine_templates(df.coalesce(1)).select("log_id", "line_id", "template").collect()
    many = templates.mine_templates(df.repartition(7)).select("log_id", "line_id", "template").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_child_cap_and_digits():
    m = templates.FixedDepthMiner(depth=2, threshold=0.9, most=3)
    for line in ("a x", "b x", "c x", "d x", "7 x"):
        m.add(line.split())
    assert set(m.root.branches) == {"a", "b", WILDCARD}
    assert m.root.branches[WILDCARD].clusters == [2, 3, 4]


def test_ties_go_to_more_wildcards_then_first():
    m = templates.FixedDepthMiner(depth=1, threshold=0.0, most=3)
    m.templates = [["a", "b", "c", "d"], ["a", WILDCARD, "x", "d"], ["a", WILDCARD, "y", "d"]]
    m.root.clusters = [0, 1, 2]
    assert m.add(["a", "q", "z", "d"]) == 1


def test_adjacent_wildcards_fall_together(spark):
    d = spark.createDataFrame([("a <*> <*> b", "a 1 2 b"), ("a <*> <*> <*> b", "a 1 2 3 b"), ("x(<*>) $ <*>", "x(1) $ é"), ("no", "no"), ("a <*>", "b c")], "t string, x string")
    from pyspark.sql import functions as F

    from linewright.functions.text import variables

    got = [r["v"] for r in d.select(variables(F.col("t"), F.col("x")).alias("v")).collect()]
    assert got == [["1 2"], ["1", "2 3"], ["1", "é"], [], []]


def test_spell_counts_and_subsequences(spark):
    assert templates.longest_common("a b c d".split(), "a x c d".split()) == ["a", "c", "d"]
    assert templates.spell_template(["a", "c"], ["a", "b", "c", "d"]) == ["a", WILDCARD, "c", WILDCARD]
    assert templates.spell_template([], ["a"]) == []
    texts = [f"job j{i} finished in {i} s" for i in range(20)] + ["other words here"] * 3
    mined = templates.mine_subsequences(frame(spark, texts, 1))
    counts = Counter({r["template"]: r["Occurrences"] for r in templates.subsequence_counts(mined).collect()})
    assert counts["job <*> finished in <*> s"] == 20 and counts["other words here"] == 3
    assert templates.mine_subsequences(frame(spark, [])).count() == 0
