import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.functions import text, vectors
from linewright.operators import clustering, experiments, metrics, pipeline, topics
from linewright.sources import lines, sinks


@pytest.fixture(scope="module")
def log(spark):
    rows = [("a", i, i, f"user {i % 3} opened file {i}" if i % 2 else f"disk {i % 4} is full, code {i}") for i in range(14)] + [("b", 0, 0, "only line")]
    return spark.createDataFrame(rows, "log_id string, line_id long, line_num long, text string")


def test_pipeline_with_default_steps(spark, log):
    pipe = pipeline.LinePipeline()
    found = pipe.run(log).collect()
    assert {r["k"] for r in found if r["log_id"] == "a"} == {2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13} & {r["k"] for r in found} - {1}
    assert all((r["alpha"], r["beta"], r["gamma"]) == pipe.weights for r in found)
    best = {(r["log_id"], r["line_id"]): r["cluster"] for r in pipe.best(log).collect()}
    assert len(best) == 15 and len({best["a", i] for i in range(14)}) >= 2
    assert pipe.coloured(log).count() == 15
    assert pipe.run(log.where("false")).count() == 0


def test_pipeline_steps_are_exchanged_and_left_out(spark, log):
    def never(_):
        raise AssertionError("a step of weight 0 was taken")

    def embed(frame):
        return pipeline.distances.pairs(frame, ["text"]).select("log_id", "i", "j", (F.substring("a_text", 1, 4) != F.substring("b_text", 1, 4)).cast("double").alias("d"))

    pipe = pipeline.LinePipeline((0.0, 1.0, 0.0), parse=never, embed=embed, place=never, cluster=lambda p, d: clustering.cluster_medoids(p, d, 2))
    got = {r["line_id"]: r["cluster"] for r in pipe.best(log.where("log_id = 'a'")).collect()}
    assert all((got[i] == got[j]) == (i % 2 == j % 2) for i in range(14) for j in range(14))


def test_variable_pairs(spark):
    rows = spark.createDataFrame([("a", 0, ["x", "x", "y"]), ("a", 1, ["y"]), ("a", 2, []), ("a", 3, [])], "log_id string, line_id long, variables array<string>")
    got = {(r["i"], r["j"]): r["d"] for r in pipeline.variable_pairs(rows).collect()}
    assert got == {(0, 1): 0.5, (0, 2): 1.0, (0, 3): 1.0, (1, 2): 1.0, (1, 3): 1.0, (2, 3): 0.0}
    assert {(r["i"], r["j"]): r["d"] for r in pipeline.variable_pairs(rows, empty=1.0).collect()}[2, 3] == 1.0
    assert math.isnan({(r["i"], r["j"]): r["d"] for r in pipeline.variable_pairs(rows, empty=None).collect()}[2, 3])
    with pytest.raises(pipeline.EmptyLog):
        pipeline.variable_pairs(rows.where("false"), strict=True)
    with pytest.raises(pipeline.NoVariable):
        pipeline.variable_pairs(rows.where("line_id > 1"), strict=True)
    assert pipeline.variable_pairs(rows, strict=True).count() == 6


def points_and_pairs(spark, n=12):
    rng = np.random.default_rng(2)
    at = np.concatenate([rng.normal(0, 0.1, n // 2), rng.normal(3, 0.1, n // 2)])
    points = spark.createDataFrame([("a", i) for i in range(n)], "log_id string, line_id long")
    pairs = spark.createDataFrame([("a", i, j, float(abs(at[i] - at[j]))) for i in range(n) for j in range(i + 1, n)], "log_id string, i long, j long, d double")
    return points, pairs


def test_links_are_kept(spark):
    points, pairs = points_and_pairs(spark)
    links = spark.createDataFrame([("a", 0, 11, "must"), ("a", 11, 5, "must"), ("a", 1, 2, "cannot")], "log_id string, i long, j long, kind string")
    got = {r["line_id"]: r["cluster"] for r in clustering.cluster_medoids(points, pairs, 3, links=links).collect()}
    assert got[0] == got[11] == got[5] and got[1] != got[2] and len(set(got.values())) == 3
    free = {r["line_id"]: r["cluster"] for r in clustering.cluster_medoids(points, pairs, 2).collect()}
    assert free[0] != free[11]
    swept = clustering.sweep_medoids(points, pairs, links=links).collect()
    assert max(r["k"] for r in swept) <= 10
    for k in {r["k"] for r in swept}:
        of = {r["line_id"]: r["cluster"] for r in swept if r["k"] == k}
        assert of[0] == of[11] == of[5] and len(set(of.values())) == k
    every = spark.createDataFrame([("a", 0, i, "must") for i in range(1, 12)], "log_id string, i long, j long, kind string")
    assert {r["cluster"] for r in clustering.sweep_medoids(points, pairs, links=every).collect()} == {0}
    with pytest.raises(Exception, match="isn't there"):
        clustering.cluster_medoids(points, pairs, 2, links=spark.createDataFrame([("a", 0, 99, "must")], "log_id string, i long, j long, kind string")).collect()


def test_all_neighbours_are_linked(spark, sf_dir):
    from linewright import catalog_runs

    v = {r["line_id"]: r for r in catalog_runs.vecs(spark, sf_dir).select("log_id", "line_id", "label").collect()}
    want = {(i % 10, i, i + 10, "must" if v[i]["label"] == v[i + 10]["label"] else "cannot") for i in v if i + 10 in v}
    assert len(want) == 490 and {tuple(r) for r in catalog_runs._links(spark, sf_dir).select("log_id", "i", "j", "kind").collect()} == want
    got = {r["line_id"]: r["cluster"] for r in catalog_runs.constrained_medoids(spark, sf_dir).collect()}
    assert got.keys() == v.keys()
    assert all((got[i] == got[j]) == (kind == "must") for _, i, j, kind in want)


def test_grid_of_densities_and_rows(spark):
    points, pairs = points_and_pairs(spark, 24)
    got = clustering.density_grid(points, pairs, least=(30, 5), samples=(None, 3)).collect()
    assert {r["outliers"] for r in got} == {0} and {r["least"] for r in got} == {5} and len({r["cluster"] for r in got}) == 2
    rows = {r["line_id"]: r["cluster"] for r in clustering.cluster_matrix_rows(points, pairs, 2).collect()}
    assert len({rows[i] for i in range(12)}) == 1 and rows[0] != rows[23]
    vec = points.withColumn("vec", F.array(F.when(F.col("line_id") < 12, 0.0).otherwise(5.0), F.col("line_id") / 100))
    of = {r["line_id"]: r["cluster"] for r in clustering.feature_medoids(vec, "vec", 2).collect()}
    assert of[0] == of[11] != of[12] == of[23]


def test_trials_and_runs(spark, tmp_path):
    made = pipeline.trials(spark, lambda two: int(two[1][0] > two[0][0]), [((0.2, 0.5), (0.4, 0.5)), ((0.9, 0.1), (0.1, 0.1))])
    pipeline.append_trials(made, str(tmp_path / "t"))
    pipeline.append_trials(made.where("trial = 0"), str(tmp_path / "t"))
    rows = pipeline.read_trials(spark, str(tmp_path / "t")).collect()
    assert len(rows) == 6 and all(abs(r["alpha"] + r["beta"] + r["gamma"] - 1) < 1e-9 for r in rows)
    assert {(r["trial"], r["side"]) for r in rows if r["chosen"]} == {(0, 1), (1, 0)}


def test_sources_of_tables(spark, tmp_path):
    structured = spark.createDataFrame([(1, 'say "hi", x', "e1", "say <*>", ['"hi"', "x, y"]), (2, "b", "e2", "b", [])], "LineId long, Content string, EventId string, EventTemplate string, ParameterList array<string>")
    sinks.write_structured(structured, str(tmp_path / "s"))
    assert sorted(lines.read_structured_table(spark, str(tmp_path / "s")).collect()) == sorted(structured.collect())
    pairs = spark.createDataFrame([("a", 0, 1, 0.5)], "log_id string, i long, j long, d double")
    sinks.write_pairs(pairs, str(tmp_path / "p"))
    assert lines.read_pairs(spark, str(tmp_path / "p")).collect() == pairs.collect()
    calls = []

    def compute():
        calls.append(1)
        return pairs

    for _ in range(2):
        assert lines.load_or_compute(spark, str(tmp_path / "c"), compute).count() == 1
    assert calls == [1]
    with pytest.raises(ImportError, match="h5py"):
        lines.read_hdf5(spark, str(tmp_path), ("x",))


def test_text_files_in_many_blocks(spark, tmp_path):
    want = {}
    for name, n in (("one", 5000), ("two", 1), ("three", 0)):
        content = [f"{name} line {i} " + "x" * (i % 50) for i in range(n)]
        (tmp_path / name).write_text("\n".join(content) + ("\n" if name == "one" else ""))
        want |= {(name, i): t for i, t in enumerate(content)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frame = lines.read_text(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 1
        got = {(r["log_id"].rsplit("/", 1)[1], r["line_id"]): r["text"] for r in frame.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_small_functions(spark, log):
    row = spark.createDataFrame([("Ærø Straße ČŽş ﬁn áé",), (None,)], "t string").select(text.without_accents(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in row] == ["Ærø Straße CZs fin ae", None]
    assert log.limit(1).select(text.mask_last(F.lit("a 1 b"), [r"\d", "b"]).alias("t")).first()["t"] == "a 1 <*>"
    hot = sinks.one_hot_rows(spark.createDataFrame([(1, ["b", "a", "a"]), (2, ["c"]), (3, [])], "k long, v array<string>"), "k", "v").collect()
    assert {r["k"]: list(r["places"]) for r in hot} == {1: [0, 1], 2: [2]}
    shown = []
    one = log.where("log_id = 'a'").withColumn("cluster", F.col("line_id") % 3 - 1)
    sinks.print_side_by_side(one, one.where("line_id < 4"), show=shown.append)
    assert len(shown) == 4 and "\x1b[3" in shown[1] and " | " in shown[0]
    assert "&lt;" in sinks.html_lines(spark.createDataFrame([("a", 0, 1, "<b>")], "log_id string, line_id long, cluster long, text string"), ["log_id"]).first()["html"]
    pooled = vectors.pool(spark.createDataFrame([(1, [1.0, 5.0]), (1, [3.0, 1.0])], "g int, v array<double>"), ["g"], "v", F.max).first()["pooled"]
    assert pooled == [3.0, 5.0]
    with pytest.raises(ValueError):
        vectors.pool(log, ["log_id"], "text", "middle")
    assert experiments.instance_ids(log.withColumn("n_tokens", F.lit(3))).select("instance").distinct().count() == 15
    weights = topics.window_topics(log.withColumn("window", F.lit(0))).where("log_id = 'a'").collect()
    assert [r["rank"] for r in weights] == list(range(1, len(weights) + 1)) and weights[0]["weight"] >= weights[-1]["weight"]
    assert topics.window_topics(log.withColumn("window", F.lit(0)).withColumn("text", F.lit("?!"))).count() == 0


def test_plans_read_pairs_once(spark):
    plan = pipeline.weight_search.__doc__ and experiments.grid_scores(
        spark.createDataFrame([("a", 0.1, 0.2, 0.3)], "log_id string, d_var double, d_emb double, d_line double"), experiments.weight_grid(spark, [0.0, 1.0]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [log_id") > plan.index("Join Cross") if "Join Cross" in plan else "Aggregate [log_id" in plan


def test_quantiles_are_narrowed_down(spark):
    rng = np.random.default_rng(5)
    for values in ([3.0], [1.0, 2.0], [5.0] * 40 + [6.0] * 39, rng.lognormal(0, 4, 3001).tolist(), [0.0, 5e-324, 1e300]):
        frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        for q in (0.25, 0.5, 1.0):
            assert metrics.exact_quantile(frame, "v", q) == pytest.approx(np.quantile(values, q), rel=1e-12)
    assert metrics.exact_quantile(frame.where("false"), "v", 0.5) is None
    row = metrics.describe(frame, "v").first()
    assert (row["count"], row["q50"]) == (3, 5e-324)
