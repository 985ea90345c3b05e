import base64

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from linewright.llm import pii, toxicity, winnow
from linewright.plans.lineage import materialize
from tests.llm.test_near_dups import brute


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = materialize(stage(spark, before, sf_dir), "test-stage")
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        rows = {r["doc_id"]: r for r in kept.collect()}
        was = {r["doc_id"]: r for r in before.collect()}
        sizes.append(len(rows))
        if name == "toxicity":
            scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
            assert set(rows) == {d for d, s in scores.items() if s < toxicity.LIKELY}
        elif name == "near_dedup":
            assert set(rows) == {x[0] for x in brute([(d, r["text"]) for d, r in was.items()]) if x[3]}
        elif name == "decontamination":
            bad = winnow.contamination_digest(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
            assert set(rows) == set(was) - {r["doc_id"] for r in bad.collect()}
        else:
            assert set(rows) == set(was)
            assert pii.pii_digest(kept).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert sizes[0] > sizes[2] > 0
    with open(public_tokenizers.path(corpus_pipeline.TOKENIZER), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in out} == {d: own.encode_ordinary(r["text"]) for d, r in rows.items()}


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_edges_and_own_columns(spark, sf_dir):
    """Nulls, empty texts, repeated rows and columns with the names of what the stages add: all keep their values."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(900, None, "en", "a", 0), (901, "", "en", "a", 0), (None, "x y z", "en", "a", 5), (902, "once upon a time there was a word", "en", "a", 33), (902, "once upon a time there was a word", "en", "a", 33)], base.schema)
    names = ("pii", "_found", "n_words", "hit_spans", "items", "worst_score", "tox_score", "n_sentences", "rep", "bucket", "component_id")
    docs = materialize(base.unionByName(odd).withColumns({c: F.lit(f"own {c}") for c in names}), "odd-documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), "odd-stage")
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        assert all(r[c] == f"own {c}" for r in kept.collect() for c in names)
        ids = [r["doc_id"] for r in kept.collect()]
        assert {900, 901, None, 902} <= set(ids) and ids.count(902) == 2, name
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    got = {r["doc_id"]: r["ids"] for r in last.collect()}
    assert got[900] == got[901] == [] and len(got[902]) > 0 and all(r["pii"] == "own pii" for r in last.collect())
