"""The queries of this subpackage's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linewright.llm._common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linewright.llm.secrets import find_secrets, lexicon, seed_findings, train

    docs = table(spark, sf_dir, "documents")
    known = lexicon(docs)
    return find_secrets(docs, train(seed_findings(spark), known), known, path="source").drop("value")


def op2_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linewright.llm.paragraphs import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linewright.llm.pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linewright.llm.packing import shard

    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from linewright.llm.rp_forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linewright.llm.suffix_tree import score_documents

    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_multiple_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linewright.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linewright.llm.winnow import contamination_digest

    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linewright.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from linewright.llm.bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_random_forest, op2_paragraph_bands, op3_weak_supervision, op4_best_fit, op5_projection_forest, op6_suffix_tree, op7_multiple_instance, op8_winnowing, op9_odd_sketches, op10_byte_bpe)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACE_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

_WINNOWING = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_BENCH_WORDS} AS w FROM documents), b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
  bk AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0), ks AS (SELECT DISTINCT k FROM bk),
  bs AS (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM bk), bw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS x FROM bs),
  ds AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k), dw AS (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS x FROM ds),
  hit AS (SELECT r, s, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.x = bw.x), pos AS (SELECT r, unnest(range(s, s + k)) AS p FROM hit), n AS (SELECT r, count(DISTINCT p) AS n_hit FROM pos GROUP BY r),
  i AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS sha FROM hit GROUP BY r)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)"""

_ODD_SKETCHES = f"""WITH RECURSIVE d AS (SELECT doc_id, {_SPACE_WORDS} AS w FROM documents), k AS (SELECT doc_id, w, least(5, len(w)) AS k FROM d WHERE len(w) > 0),
  u AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM k), sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + k - 1], ' ') AS x FROM u), z AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
  c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS n FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
  e AS (SELECT i, j FROM c JOIN z p ON p.doc_id = i JOIN z q ON q.doc_id = j WHERE 100 * c.n >= 75 * (p.n + q.n - c.n)), l AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
  reach(i, j) AS (SELECT i, j FROM l UNION SELECT r.i, l.j FROM reach r JOIN l ON l.i = r.j), root AS (SELECT i, least(i, min(j)) AS root FROM reach GROUP BY i)
  SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN z USING (doc_id) LEFT JOIN root ON root.i = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others have a trained model, a packing or byte-pair merges in them, which SQL doesn't express."""
    return {"op8_winnowing": _WINNOWING, "op9_odd_sketches": _ODD_SKETCHES}
