"""Named queries over the driver's tables, and the SQL that gives the same rows.

`docs` are the lines of documents (log_id = doc_id), `vecs` the embeddings (log_id = vec_id % 10, line_id = vec_id),
`conv` the turns of conversations. Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.functions import text, vectors
from linewright.operators import clustering, distances, experiments, features, metrics, render, templates, topics
from linewright.operators.blocks import Vectors
from linewright.sources import lines as sources
from linewright.streaming.windows import counts_by_window

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: Masks of the line queries.
MASKS = (text.TIMESTAMP, r"\d+\.\d+\.\d+\.\d+", r"[0-9a-f]{18,40}", r"\d+")
STOP = ("the", "and", "of", "to", "in", "der", "die", "und", "de", "la", "le", "les", "el", "que")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from linewright import catalog_runs  # noqa: F401  registers its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from linewright import catalog_runs  # noqa: F401

    return dict(_sql)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.split_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "embeddings").where("embedding is not null")
    return t.select((F.col("vec_id") % 10).alias("log_id"), F.col("vec_id").alias("line_id"), vectors.as_double(F.col("embedding")).alias("vec"), F.col("label").cast("long").alias("label"))


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("log_id"), F.col("turn").alias("line_id"), F.col("turn").alias("line_num"), "role", "text")


def r6(c) -> F.Column:
    return F.round(c, 6)


LINES = """lines AS (SELECT doc_id AS log_id, unnest(string_split(text, chr(10))) AS text,
  CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS line_id FROM documents WHERE text IS NOT NULL)"""
VECS = "vecs AS (SELECT vec_id % 10 AS log_id, vec_id AS line_id, embedding::DOUBLE[] AS vec, CAST(label AS BIGINT) AS label FROM embeddings WHERE embedding IS NOT NULL)"
CONV = "conv AS (SELECT conv_id AS log_id, turn AS line_id, turn AS line_num, role, text FROM conversations)"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
FULL = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
TOKENS = FULL.format("text")
MASKED = "text"
for _m in MASKS:
    MASKED = f"regexp_replace({MASKED}, '{_m}', '<*>', 'g')"
VEC_PAIRS = f"""{VECS}, p AS (SELECT a.log_id, a.line_id AS i, b.line_id AS j, a.label AS la, b.label AS lb,
  list_cosine_distance(a.vec, b.vec) / 2 AS d, list_distance(a.vec, b.vec) AS e FROM vecs a JOIN vecs b ON a.log_id = b.log_id AND a.line_id < b.line_id),
  m AS (SELECT log_id, i, j, d, e, lb AS other FROM p UNION ALL SELECT log_id, j, i, d, e, la FROM p)"""


def vec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.cosine_pairs(vecs(spark, sf_dir), "vec", "line_id", "log_id")


def near_vecs(spark: SparkSession, sf_dir: str) -> Vectors:
    """The pairs of vec_pairs, not as rows."""
    return Vectors(vecs(spark, sf_dir).select("log_id", "line_id", "vec"))


# --- scans ---------------------------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT log_id, line_id, text FROM lines")
def raw_text_scan(spark, sf_dir):
    return docs(spark, sf_dir).select("log_id", "line_id", "text")


@query(f"WITH {LINES} SELECT log_id, line_id, regexp_replace(text, '[^\\x00-\\x7F]+', '<NASCII>', 'g') AS folded FROM lines")
def ascii_fold_scan(spark, sf_dir):
    return docs(spark, sf_dir).select("log_id", "line_id", text.fold_non_ascii(F.col("text")).alias("folded"))


@query("""SELECT event_type AS log_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS LineId,
  CAST(user_id AS VARCHAR) AS "User", event_type AS "Type", CAST(event_id AS VARCHAR) AS "Content" FROM events WHERE user_id % 3 <> 0""")
def format_regex_scan(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    rendered = F.when(F.col("user_id") % 3 != 0, F.concat_ws(" ", F.lit("user"), "user_id", F.concat(F.lit("["), F.col("event_type"), F.lit("]")), F.lit("id:"), "event_id")).otherwise(F.concat_ws("|", "user_id", "event_type"))
    return sources.read_structured(e.select(F.col("event_type").alias("log_id"), F.col("event_id").alias("line_id"), rendered.alias("text")), "user <User> [<Type>] id: <Content>")


@query(f"""WITH {CONV} SELECT log_id, CAST(line_id AS BIGINT) AS block, text, role AS summary FROM conv
  WHERE trim(text) <> '' AND NOT regexp_matches(text, '^#\\d+#\\s*$') AND NOT regexp_matches(text, '^#summary:#')""")
def annotated_blocks(spark, sf_dir):
    c = conv(spark, sf_dir)
    body = F.array(F.concat(F.lit("#"), F.col("line_id"), F.lit("#")), F.regexp_replace("text", "\n", " "), F.lit(""), F.lit("#summary:#"), F.col("role"), F.lit(""))
    flat = c.select("log_id", "line_id", "text", F.posexplode(body).alias("place", "piece"))
    made = sources.read_annotated(flat.select("log_id", (F.col("line_id") * 10 + F.col("place")).alias("line_id"), F.col("piece").alias("text")))
    place = F.floor(F.col("line_id") / 10)
    return made.withColumn("turn", place).join(c.select("log_id", F.col("line_id").alias("turn"), F.col("text").alias("whole")), ["log_id", "turn"]).select("log_id", F.col("turn").cast("long").alias("block"), F.col("whole").alias("text"), "summary")


@query(f"""WITH {LINES}, a AS (SELECT log_id, line_id, string_split(text, '.') AS v FROM lines),
  b AS (SELECT log_id, line_id, unnest(v) AS s, CAST(unnest(range(len(v))) AS BIGINT) AS alternative FROM a)
  SELECT log_id, line_id, alternative, trim(s) AS summary FROM b WHERE trim(s) <> ''""")
def summary_alternatives(spark, sf_dir):
    return sources.split_alternatives(docs(spark, sf_dir).withColumn("text", F.translate("text", ";.", ",;")))


_sql["summary_alternatives"] = _sql["summary_alternatives"].replace("string_split(text, '.')", "string_split(replace(replace(text, ';', ','), '.', ';'), ';')")

# --- projections ---------------------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT log_id, line_id, {MASKED} AS masked FROM lines")
def mask_regex_sequence(spark, sf_dir):
    return docs(spark, sf_dir).select("log_id", "line_id", text.mask(F.col("text"), MASKS).alias("masked"))


@query(f"WITH {LINES} SELECT log_id, line_id, CAST(len({TOKENS}) AS BIGINT) AS n, array_to_string({TOKENS}, '~') AS tokens FROM lines")
def whitespace_tokens(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return docs(spark, sf_dir).select("log_id", "line_id", F.size(t).cast("long").alias("n"), F.array_join(t, "~").alias("tokens"))


@query(f"""WITH {LINES}, t AS (SELECT log_id, line_id, list_filter(regexp_split_to_array({MASKED}, '[\\s=:,]'), lambda x: x <> '') AS v FROM lines)
  SELECT log_id, line_id, array_to_string(v, '~') AS tokens, array_to_string(list_filter(v, lambda x: x <> '<*>'), '~') AS constant FROM t""")
def spell_tokens(spark, sf_dir):
    t = docs(spark, sf_dir).select("log_id", "line_id", text.spell_tokens(text.mask(F.col("text"), MASKS)).alias("v"))
    return t.select("log_id", "line_id", F.array_join("v", "~").alias("tokens"), F.array_join(text.constant_tokens(F.col("v")), "~").alias("constant"))


@query(f"WITH {LINES} SELECT log_id, line_id, substr(md5({MASKED}), 1, 8) AS event_id, regexp_matches(text, '\\p{{Nd}}') AS digits FROM lines")
def template_id(spark, sf_dir):
    return docs(spark, sf_dir).select("log_id", "line_id", text.template_id(text.mask(F.col("text"), MASKS)).alias("event_id"), text.has_digit(F.col("text")).alias("digits"))


LINE_PAIRS = f"""{LINES}, t AS (SELECT log_id, line_id, {TOKENS} AS v FROM lines),
  q AS (SELECT a.log_id, a.line_id AS i, b.line_id AS j, a.v AS x, b.v AS y FROM t a JOIN t b ON a.log_id = b.log_id AND a.line_id < b.line_id AND len(a.v) = len(b.v))"""


def _equal_length_pairs(spark, sf_dir):
    t = docs(spark, sf_dir).select("log_id", "line_id", text.tokens(F.col("text")).alias("v")).withColumn("n", F.size("v"))
    a, b = t.select("log_id", "n", F.col("line_id").alias("i"), F.col("v").alias("x")), t.select("log_id", "n", F.col("line_id").alias("j"), F.col("v").alias("y"))
    return a.join(b, ["log_id", "n"]).where("i < j")


@query(f"""WITH {LINE_PAIRS} SELECT log_id, i, j, round(CASE WHEN len(x) = 0 THEN 1.0 ELSE
  len(list_filter(range(1, len(x) + 1), lambda k: x[k] = y[k] AND x[k] <> '<*>')) / len(x) END, 6) AS sim FROM q""")
def positional_similarity(spark, sf_dir):
    return _equal_length_pairs(spark, sf_dir).select("log_id", "i", "j", r6(text.similarity(F.col("x"), F.col("y"))).alias("sim"))


@query(f"""WITH {LINE_PAIRS} SELECT log_id, i, j, array_to_string(list_transform(range(1, len(x) + 1), lambda k: CASE WHEN x[k] = y[k] THEN x[k] ELSE '<*>' END), ' ') AS template FROM q""")
def template_merge(spark, sf_dir):
    return _equal_length_pairs(spark, sf_dir).select("log_id", "i", "j", F.array_join(text.merge_template(F.col("x"), F.col("y")), " ").alias("template"))


@query(f"""WITH {LINES}, t AS (SELECT log_id, line_id, {TOKENS} AS v FROM lines),
  c AS (SELECT log_id, line_id AS template_no, list_transform(range(1, len(v) + 1), lambda k: CASE WHEN k % 3 = 0 THEN '<*>' ELSE v[k] END) AS w FROM t WHERE len(v) > 0),
  s AS (SELECT t.log_id, t.line_id, c.template_no, len(list_filter(range(1, len(w) + 1), lambda k: w[k] = v[k] AND w[k] <> '<*>')) / len(w) AS sim, len(list_filter(w, lambda x: x = '<*>')) AS wild
    FROM t JOIN c ON t.log_id = c.log_id AND len(v) = len(w)),
  r AS (SELECT *, row_number() OVER (PARTITION BY log_id, line_id ORDER BY sim DESC, wild DESC, template_no) AS r FROM s)
  SELECT log_id, line_id, template_no, round(sim, 6) AS sim FROM r WHERE r = 1 AND sim >= 0.3""")
def leaf_best_match(spark, sf_dir):
    t = docs(spark, sf_dir).select("log_id", "line_id", text.tokens(F.col("text")).alias("tokens"))
    stored = t.where(F.size("tokens") > 0).select("log_id", F.col("line_id").alias("template_no"), F.transform("tokens", lambda x, i: F.when((i + 1) % 3 == 0, text.WILDCARD).otherwise(x)).alias("template"))
    return templates.best_template(t, stored, 0.3).select("log_id", "line_id", "template_no", r6("sim").alias("sim"))


@query(r"""WITH t AS (SELECT event_id, 'user ' || user_id || ' did ' || event_type || ' at ' || event_id AS line FROM events),
  s AS (SELECT * FROM (VALUES (1, 'user <*> did <*> at <*>'), (2, 'user <*> did buy at <*>'), (3, 'user <*> left')) v(no, template))
  SELECT event_id, no, CASE no WHEN 1 THEN regexp_extract(line, '^user\s+(.*?)\s+did\s+(.*?)\s+at\s+(.*?)$', 1) || '~' || regexp_extract(line, '^user\s+(.*?)\s+did\s+(.*?)\s+at\s+(.*?)$', 2) || '~' || regexp_extract(line, '^user\s+(.*?)\s+did\s+(.*?)\s+at\s+(.*?)$', 3)
    WHEN 2 THEN CASE WHEN regexp_matches(line, '^user\s+(.*?)\s+did\s+buy\s+at\s+(.*?)$') THEN regexp_extract(line, '^user\s+(.*?)\s+did\s+buy\s+at\s+(.*?)$', 1) || '~' || regexp_extract(line, '^user\s+(.*?)\s+did\s+buy\s+at\s+(.*?)$', 2) ELSE '' END
    ELSE '' END AS variables FROM t, s""")
def variables_extract(spark, sf_dir):
    line = F.concat(F.lit("user "), F.col("user_id"), F.lit(" did "), F.col("event_type"), F.lit(" at "), F.col("event_id"))
    t = _table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    s = spark.createDataFrame([(1, "user <*> did <*> at <*>"), (2, "user <*> did buy at <*>"), (3, "user <*> left")], "no int, template string")
    return t.crossJoin(F.broadcast(s)).select("event_id", "no", F.array_join(text.variables(F.col("template"), F.col("line")), "~").alias("variables"))


@query(f"""WITH {LINES}, t AS (SELECT log_id, line_id, {TOKENS} AS v FROM lines), h AS (SELECT log_id, line_id AS template_id, v AS w FROM t)
  SELECT t.log_id, t.line_id, CAST(count(*) AS BIGINT) AS n_templates FROM t JOIN h ON t.log_id = h.log_id AND len(list_filter(h.w, lambda x: x <> '<*>' AND NOT list_contains(t.v, x))) = 0 GROUP BY 1, 2""")
def subset_match(spark, sf_dir):
    t = docs(spark, sf_dir).select("log_id", "line_id", text.tokens(F.col("text")).alias("v"))
    h = t.select("log_id", F.col("v").alias("w"))
    return t.join(h, "log_id").where(text.is_subset(F.col("w"), F.col("v"))).groupBy("log_id", "line_id").agg(F.count(F.lit(1)).alias("n_templates"))


@query(f"""WITH {LINES}, t AS (SELECT log_id, line_id, regexp_split_to_array(text, '\\s+') AS v, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS w FROM lines)
  SELECT log_id, line_id, array_to_string(v[1:5], ' ') AS head, CAST(len(w) AS BIGINT) AS n_words, array_to_string(list_filter(w, lambda x: lower(x) NOT IN {STOP}), ' ') AS kept FROM t""")
def word_projections(spark, sf_dir):
    w = text.all_words(F.col("text"))
    return docs(spark, sf_dir).select("log_id", "line_id", text.first_words(F.col("text"), 5).alias("head"), F.size(w).cast("long").alias("n_words"), F.array_join(text.remove_words(w, STOP), " ").alias("kept"))


@query("SELECT event_id, array_to_string(regexp_extract_all(props, '\"[a-z_]+\":\\s*\"([^\"]*)\"', 1), '~') AS vals FROM events")
def json_values(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(F.regexp_extract_all("props", F.lit('"[a-z_]+":\\s*"([^"]*)"'), F.lit(1)), "~").alias("vals"))


# --- template mining -----------------------------------------------------------------------------------------------


@query()
def drain_templates(spark, sf_dir):
    mined = templates.mine_templates(docs(spark, sf_dir), MASKS, depth=3, threshold=0.4, most=5)
    return mined.select("log_id", "line_id", "event_id", "template", F.array_join("variables", "~").alias("variables"))


@query()
def drain_counts(spark, sf_dir):
    return templates.template_counts(templates.mine_templates(docs(spark, sf_dir), MASKS))


@query()
def spell_templates(spark, sf_dir):
    return templates.subsequence_counts(templates.mine_subsequences(docs(spark, sf_dir), MASKS)).select("log_id", "cluster", "EventId", "template", "Occurrences")


# --- features ------------------------------------------------------------------------------------------------------


@query(f"""WITH {LINES}, n AS (SELECT log_id, count(*) AS n FROM lines GROUP BY 1), w AS (SELECT log_id, line_id, unnest({WORDS}) AS token FROM lines),
  tf AS (SELECT log_id, line_id, token, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT log_id, token, count(*) AS df FROM tf GROUP BY ALL),
  r AS (SELECT tf.log_id, line_id, tf.token, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN df ON tf.log_id = df.log_id AND tf.token = df.token JOIN n ON n.log_id = tf.log_id),
  l AS (SELECT log_id, line_id, sqrt(sum(raw * raw)) AS len FROM r GROUP BY ALL)
  SELECT r.log_id, r.line_id, token, round(raw / len, 6) AS weight FROM r JOIN l ON r.log_id = l.log_id AND r.line_id = l.line_id""")
def tfidf_weights(spark, sf_dir):
    return features.tfidf(docs(spark, sf_dir)).withColumn("weight", r6("weight"))


DOC_WORDS = f"w AS (SELECT lang, unnest({WORDS}) AS token FROM documents), c AS (SELECT lang, token, count(*) AS n FROM w GROUP BY ALL)"


@query(f"WITH {DOC_WORDS} SELECT lang, CAST(count(*) AS BIGINT) AS n_words FROM c GROUP BY lang")
def vocabulary(spark, sf_dir):
    return features.vocabulary_size(_table(spark, sf_dir, "documents"), "lang")


@query(f"WITH {DOC_WORDS} SELECT lang, CAST(count(*) FILTER (n = 1) AS BIGINT) AS n_hapax FROM c GROUP BY lang")
def hapaxes(spark, sf_dir):
    return features.hapaxes(_table(spark, sf_dir, "documents"), "lang")


@query(f"WITH {LINES} SELECT log_id, round(sum(len({TOKENS})) / count(*), 6) AS avg_tokens FROM lines GROUP BY 1")
def avg_tokens(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("log_id").agg(r6(F.sum(F.size(text.tokens(F.col("text")))) / F.count(F.lit(1))).alias("avg_tokens"))


@query(f"""WITH {VECS}, e AS (SELECT label, unnest(vec) AS x, CAST(unnest(range(1, len(vec) + 1)) - 1 AS BIGINT) AS dim FROM vecs)
  SELECT label, dim, round(avg(x), 6) AS mean, round(sum(x), 6) AS total FROM e GROUP BY ALL""")
def pooling_mean_sum(spark, sf_dir):
    v = vecs(spark, sf_dir)
    flat = lambda kind, out: vectors.pool(v, ["label"], "vec", kind).select("label", F.posexplode("pooled").alias("dim", out))
    return flat("mean", "mean").join(flat("sum", "total"), ["label", "dim"]).select("label", F.col("dim").cast("long").alias("dim"), r6("mean").alias("mean"), r6("total").alias("total"))


@query(f"""WITH {VECS}, x AS (SELECT log_id, line_id, vec[1] AS x FROM vecs), r AS (SELECT *, min(x) OVER (PARTITION BY log_id) AS lo, max(x) OVER (PARTITION BY log_id) AS hi FROM x)
  SELECT log_id, line_id, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) * 0.75 ELSE 0 END, 6) AS scaled FROM r""")
def minmax_scale(spark, sf_dir):
    x = vecs(spark, sf_dir).select("log_id", "line_id", F.col("vec")[0].alias("x"))
    return vectors.min_max(x, "x", ["log_id"], "scaled", 0.75).select("log_id", "line_id", r6("scaled").alias("scaled"))


# --- distances -----------------------------------------------------------------------------------------------------

SETS = f"{LINES}, s AS (SELECT log_id, line_id, list_distinct({WORDS}) AS v FROM lines)"
SET_PAIRS = f"""{SETS}, q AS (SELECT a.log_id, a.line_id AS i, b.line_id AS j, len(list_intersect(a.v, b.v)) AS common, len(a.v) + len(b.v) - len(list_intersect(a.v, b.v)) AS either
  FROM s a JOIN s b ON a.log_id = b.log_id AND a.line_id < b.line_id)"""


def line_sets(spark, sf_dir) -> DataFrame:
    return distances.hashed_sets(docs(spark, sf_dir).withColumn("variables", text.word_tokens(F.col("text"))), "variables")


@query(f"WITH {SET_PAIRS} SELECT log_id, i, j, round(CASE WHEN either = 0 THEN 0 ELSE 1 - common / either END, 6) AS d FROM q")
def jaccard_distance(spark, sf_dir):
    p = distances.pairs(line_sets(spark, sf_dir), ["variables"])
    return p.select("log_id", "i", "j", r6(distances.jaccard(F.col("a_variables"), F.col("b_variables"))).alias("d"))


@query(f"WITH {SET_PAIRS} SELECT log_id, i, j, round(1 - common / either, 6) AS d FROM q WHERE common > 0")
def jaccard_distance_empty_one(spark, sf_dir):
    return distances.jaccard_by_index(line_sets(spark, sf_dir), "variables").withColumn("d", r6("d"))


@query(f"WITH {VEC_PAIRS} SELECT log_id, i, j, round(d, 6) AS d FROM p")
def cosine_distance(spark, sf_dir):
    return vec_pairs(spark, sf_dir).withColumn("d", r6("d"))


@query(f"WITH {VEC_PAIRS} SELECT log_id, i, j, round(e / max(e) OVER (PARTITION BY log_id), 6) AS d FROM p")
def euclidean_minmax(spark, sf_dir):
    return distances.vector_distance("euclid")(vecs(spark, sf_dir), "vec", "line_id", "log_id").withColumn("d", r6("d"))


@query("""WITH t AS (SELECT vec_id % 3 AS log_id, vec_id % 30 AS line_id, vec_id AS token, embedding::DOUBLE[] AS vec FROM embeddings WHERE embedding IS NOT NULL),
  b AS (SELECT a.log_id, a.line_id AS i, c.line_id AS j, a.token, max(list_inner_product(a.vec, c.vec)) AS best FROM t a JOIN t c ON a.log_id = c.log_id GROUP BY ALL),
  s AS (SELECT log_id, i, j, avg(best) AS sim FROM b GROUP BY ALL), r AS (SELECT *, max(sim) OVER (PARTITION BY log_id) AS hi, min(sim) OVER (PARTITION BY log_id) AS lo FROM s)
  SELECT log_id, i, j, round(CASE WHEN hi > lo THEN (hi - sim) / (hi - lo) ELSE 0 END, 6) AS d FROM r WHERE i <> j""")
def late_interaction(spark, sf_dir):
    v = vecs(spark, sf_dir).select((F.col("line_id") % 3).alias("log_id"), (F.col("line_id") % 30).alias("line_id"), F.col("line_id").alias("token"), "vec")
    return distances.late_interaction(v).withColumn("d", r6("d"))


@query(f"WITH {LINES}, n AS (SELECT log_id, count(*) AS n FROM lines GROUP BY 1) SELECT a.log_id, a.line_id AS i, b.line_id AS j, round((b.line_id - a.line_id) / (n - 1), 6) AS d FROM lines a JOIN lines b ON a.log_id = b.log_id AND a.line_id < b.line_id JOIN n ON n.log_id = a.log_id")
def line_distance_abs(spark, sf_dir):
    return distances.line_pairs(docs(spark, sf_dir)).withColumn("d", r6("d"))


@query(f"""WITH {CONV}, n AS (SELECT log_id, max(line_num) - min(line_num) AS n FROM conv GROUP BY 1)
  SELECT a.log_id, a.line_id AS i, b.line_id AS j, round(CASE WHEN n > 0 THEN abs(b.line_num - a.line_num) / n ELSE 0 END, 6) AS d FROM conv a JOIN conv b ON a.log_id = b.log_id AND a.line_id < b.line_id JOIN n ON n.log_id = a.log_id""")
def line_distance_rel(spark, sf_dir):
    return distances.line_pairs(conv(spark, sf_dir), relative=True).withColumn("d", r6("d"))


COMBINED = f"""{SET_PAIRS}, n AS (SELECT log_id, count(*) AS n FROM lines GROUP BY 1),
  g AS (SELECT q.log_id, i, j, 0.6180339887 * CASE WHEN either = 0 THEN 0 ELSE 1 - common / either END + 0.3819660112 * (j - i) / (n - 1) AS d FROM q JOIN n ON n.log_id = q.log_id)"""


def combined(spark, sf_dir) -> DataFrame:
    return distances.combine(docs(spark, sf_dir).withColumn("variables", text.word_tokens(F.col("text"))), (0.6180339887, 0.0, 0.3819660112))


@query(f"WITH {COMBINED} SELECT log_id, i, j, round(d, 6) AS d FROM g")
def combined_distance(spark, sf_dir):
    return combined(spark, sf_dir).withColumn("d", r6("d"))


@query(f"""WITH {COMBINED}, m AS (SELECT log_id, i, j, round(d, 9) AS d FROM g UNION ALL SELECT log_id, j, i, round(d, 9) FROM g),
  r AS (SELECT *, row_number() OVER (PARTITION BY log_id, i ORDER BY d, j) AS r FROM m) SELECT log_id, i AS line_id, j AS nearest, round(d, 6) AS d FROM r WHERE r = 1""")
def nearest_line(spark, sf_dir):
    return distances.nearest_line(combined(spark, sf_dir).withColumn("d", F.round("d", 9))).withColumn("d", r6("d"))


@query(f"WITH {VEC_PAIRS}, r AS (SELECT log_id, i, j, d, row_number() OVER (PARTITION BY log_id ORDER BY round(d, 9), i, j) AS r FROM p) SELECT log_id, CAST(r AS BIGINT) AS rank, i, j, round(d, 6) AS d FROM r WHERE r <= 25")
def similar_pairs_ranked(spark, sf_dir):
    return distances.closest_pairs(near_vecs(spark, sf_dir), 25).withColumn("d", r6("d"))


@query(f"WITH {VEC_PAIRS} SELECT log_id, i, round(sum(d), 6) AS total FROM m GROUP BY ALL")
def cumulative_distance(spark, sf_dir):
    return distances.cumulative(near_vecs(spark, sf_dir)).withColumn("total", r6("total"))


@query(f"WITH {VEC_PAIRS}, r AS (SELECT log_id, i, d, row_number() OVER (PARTITION BY log_id, i ORDER BY d, j) AS r FROM m) SELECT log_id, i, round(d, 6) AS d FROM r WHERE r = 11")
def kth_nearest(spark, sf_dir):
    return distances.kth_nearest(near_vecs(spark, sf_dir), 12).withColumn("d", r6("d"))


# --- grids and samples ---------------------------------------------------------------------------------------------

TENTHS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
GRID = f"v AS (SELECT unnest({TENTHS}::DOUBLE[]) AS v), grid AS (SELECT a.v AS alpha, b.v AS beta, c.v AS gamma FROM v a, v b, v c)"


@query("WITH v AS (SELECT unnest([0.0, 0.33, 0.5, 0.66, 1.0]::DOUBLE[]) AS v) SELECT a.v AS alpha, b.v AS beta, c.v AS gamma FROM v a, v b, v c WHERE abs(a.v + b.v + c.v - 1) < 0.01")
def weight_grid_tolerance(spark, sf_dir):
    return experiments.weight_grid(spark, [0.0, 0.33, 0.5, 0.66, 1.0])


@query(f"WITH {GRID} SELECT * FROM grid WHERE alpha + beta + gamma = 1.0::DOUBLE")
def weight_grid_exact(spark, sf_dir):
    return experiments.weight_grid(spark, TENTHS, exact=True)


@query(f"""WITH {SET_PAIRS}, n AS (SELECT log_id, count(*) AS n FROM lines GROUP BY 1),
  d AS (SELECT q.log_id, CASE WHEN either = 0 THEN 0 ELSE 1 - common / either END AS dv, (j - i) / (n - 1) AS dl FROM q JOIN n ON n.log_id = q.log_id),
  v AS (SELECT unnest([0.0, 0.5, 1.0]::DOUBLE[]) AS v), grid AS (SELECT a.v AS alpha, b.v AS beta, c.v AS gamma FROM v a, v b, v c WHERE abs(a.v + b.v + c.v - 1) < 0.01)
  SELECT log_id, alpha, beta, gamma, round(avg(alpha * dv + beta * 0.5 + gamma * dl), 6) AS mean_d FROM d, grid GROUP BY ALL""")
def weight_grid_scores(spark, sf_dir):
    base = line_sets(spark, sf_dir)
    sized = base.groupBy("log_id").agg(F.count(F.lit(1)).alias("n"))
    p = distances.pairs(base, ["variables"]).join(sized, "log_id")
    d = p.select("log_id", distances.jaccard(F.col("a_variables"), F.col("b_variables")).alias("d_var"), F.lit(0.5).alias("d_emb"), ((F.col("j") - F.col("i")) / (F.col("n") - 1)).alias("d_line"))
    return experiments.grid_scores(d, experiments.weight_grid(spark, [0.0, 0.5, 1.0])).withColumn("mean_d", r6("mean_d"))


@query(f"""WITH {LINES}, s AS (SELECT log_id, count(*) AS n_lines FROM lines GROUP BY 1 HAVING count(*) > 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY n_lines ORDER BY md5(CAST(log_id AS VARCHAR)), log_id) AS r FROM s) SELECT log_id, n_lines FROM r WHERE r <= 3""")
def sample_by_size(spark, sf_dir):
    return experiments.sample_by_size(docs(spark, sf_dir), 3)


@query(f"""WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY md5(log_id || '-' || line_id)) AS r, count(*) OVER (PARTITION BY log_id) AS n FROM lines)
  SELECT log_id, line_id FROM r WHERE r <= floor(n * 0.2)""")
def slice_20pct(spark, sf_dir):
    return experiments.slice_share(docs(spark, sf_dir).select("log_id", "line_id"), 0.2)


@query(f"""WITH {LINES}, n AS (SELECT log_id, count(*) AS n FROM lines GROUP BY 1 HAVING count(*) >= 3), m AS (SELECT log_id, n, least(10, n - 2) AS m FROM n),
  i AS (SELECT log_id, n, m, unnest(range(m)) AS i FROM m) SELECT DISTINCT log_id, CAST(round_even(2 + i * CASE WHEN m > 1 THEN (n - 3) / (m - 1) ELSE 0 END, 0) AS BIGINT) AS k FROM i""")
def candidate_k(spark, sf_dir):
    return experiments.candidate_counts(docs(spark, sf_dir).groupBy("log_id").agg(F.count(F.lit(1)).alias("n")))


@query(f"""WITH {VECS}, c AS (SELECT log_id, label, count(*) AS pos FROM vecs GROUP BY ALL), n AS (SELECT log_id, count(*) AS n FROM vecs GROUP BY 1)
  SELECT v.log_id, v.line_id, pos, n - pos AS neg FROM vecs v JOIN c ON c.log_id = v.log_id AND c.label = v.label JOIN n ON n.log_id = v.log_id""")
def contrastive_pairs(spark, sf_dir):
    return experiments.contrastive(vecs(spark, sf_dir), "label")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_sample(spark, sf_dir):
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(good, "doc_id", "left_semi")


# --- clustering ----------------------------------------------------------------------------------------------------

EPS = 0.32


def _points(spark, sf_dir) -> DataFrame:
    return vecs(spark, sf_dir).select("log_id", "line_id")


@query(f"""WITH RECURSIVE {VEC_PAIRS}, near AS (SELECT log_id, i, j FROM m WHERE d <= {EPS}),
  reach(log_id, i, j) AS (SELECT log_id, i, j FROM near UNION SELECT r.log_id, r.i, n.j FROM reach r JOIN near n ON n.log_id = r.log_id AND n.i = r.j),
  root AS (SELECT log_id, i, least(i, min(j)) AS root FROM reach GROUP BY log_id, i)
  SELECT v.log_id, v.line_id, CASE WHEN root IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY v.log_id ORDER BY root NULLS LAST) - 1 END AS cluster FROM vecs v LEFT JOIN root ON root.log_id = v.log_id AND root.i = v.line_id""")
def dbscan_min2(spark, sf_dir):
    return clustering.dbscan_pairs(_points(spark, sf_dir), near_vecs(spark, sf_dir), EPS)


@query(f"""WITH RECURSIVE {VEC_PAIRS}, near AS (SELECT log_id, i, j FROM m WHERE d <= 0.35), core AS (SELECT log_id, i FROM near GROUP BY ALL HAVING count(*) + 1 >= 3),
  link AS (SELECT n.log_id, n.i, n.j FROM near n JOIN core a ON a.log_id = n.log_id AND a.i = n.i JOIN core b ON b.log_id = n.log_id AND b.i = n.j),
  reach(log_id, i, j) AS (SELECT log_id, i, i FROM core UNION SELECT r.log_id, r.i, l.j FROM reach r JOIN link l ON l.log_id = r.log_id AND l.i = r.j),
  own AS (SELECT log_id, i, min(j) AS root FROM reach GROUP BY ALL),
  border AS (SELECT n.log_id, n.i, min(o.root) AS root FROM near n JOIN own o ON o.log_id = n.log_id AND o.i = n.j WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.log_id = n.log_id AND c.i = n.i) GROUP BY ALL),
  root AS (SELECT * FROM own UNION ALL SELECT * FROM border)
  SELECT v.log_id, v.line_id, CASE WHEN root IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY v.log_id ORDER BY root NULLS LAST) - 1 END AS cluster FROM vecs v LEFT JOIN root ON root.log_id = v.log_id AND root.i = v.line_id""")
def dbscan_general(spark, sf_dir):
    return clustering.dbscan(_points(spark, sf_dir), near_vecs(spark, sf_dir), 0.35, 3)


@query()
def kmedoids(spark, sf_dir):
    return clustering.cluster_medoids(_points(spark, sf_dir), near_vecs(spark, sf_dir), 5)


@query()
def kmedoids_sweep(spark, sf_dir):
    swept = clustering.sweep_medoids(_points(spark, sf_dir), near_vecs(spark, sf_dir))
    one = swept.select("log_id", "k", "silhouette", "objective").distinct()
    return metrics.best_per_key(one, ["log_id"], "silhouette", "k")


@query()
def kmeans_rows(spark, sf_dir):
    return clustering.cluster_matrix_rows(_points(spark, sf_dir), near_vecs(spark, sf_dir), 5)


@query()
def kmeans_features(spark, sf_dir):
    v = vecs(spark, sf_dir)
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: F.when(x == F.col("label"), 1.0).otherwise(0.0))
    return clustering.cluster_means(v.withColumn("features", F.concat("vec", one_hot)), "features", 10).select("log_id", "line_id", "cluster")


@query()
def agglomerative(spark, sf_dir):
    return clustering.cluster_linkage(_points(spark, sf_dir), near_vecs(spark, sf_dir), 5)


@query()
def hdbscan(spark, sf_dir):
    return clustering.cluster_density(_points(spark, sf_dir), near_vecs(spark, sf_dir), 3)


@query(f"""WITH {VEC_PAIRS}, z AS (SELECT log_id, label, count(*) AS size FROM vecs GROUP BY ALL), s AS (SELECT m.log_id, m.i, m.other, sum(m.d) AS s FROM m GROUP BY ALL),
  a AS (SELECT v.log_id, v.line_id, v.label, z.size, coalesce((SELECT s FROM s WHERE s.log_id = v.log_id AND s.i = v.line_id AND s.other = v.label), 0) / greatest(z.size - 1, 1) AS a FROM vecs v JOIN z ON z.log_id = v.log_id AND z.label = v.label),
  b AS (SELECT s.log_id, s.i, min(s.s / z.size) AS b FROM s JOIN z ON z.log_id = s.log_id AND z.label = s.other JOIN vecs v ON v.log_id = s.log_id AND v.line_id = s.i WHERE s.other <> v.label GROUP BY ALL)
  SELECT a.log_id, CAST(count(DISTINCT label) AS BIGINT) AS k, round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM a JOIN b ON a.log_id = b.log_id AND a.line_id = b.i GROUP BY 1""")
def silhouette(spark, sf_dir):
    labels = vecs(spark, sf_dir).select("log_id", "line_id", F.col("label").alias("cluster"))
    return metrics.silhouette(near_vecs(spark, sf_dir), labels).withColumn("silhouette", r6("silhouette"))


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS t FROM c),
  a AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY lang)), b AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY source))
  SELECT round((i.x - a.x * b.x / (t * (t - 1) / 2)) / ((a.x + b.x) / 2 - a.x * b.x / (t * (t - 1) / 2)), 6) AS ari FROM i, a, b""")
def adjusted_rand(spark, sf_dir):
    return metrics.adjusted_rand(_table(spark, sf_dir, "documents").select("lang", "source"), "lang", "source", []).withColumn("ari", r6("ari"))


@query(f"WITH {VECS} SELECT log_id, label AS cluster, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(line_id AS VARCHAR), ',' ORDER BY line_id) AS members FROM vecs GROUP BY ALL")
def cluster_members(spark, sf_dir):
    return metrics.cluster_members(vecs(spark, sf_dir).withColumn("cluster", F.col("label")))


@query(f"WITH {VECS} SELECT log_id, CAST(count(DISTINCT label) FILTER (label <> 3) AS BIGINT) AS n_clusters, count(*) AS n_lines, CAST(count(*) FILTER (label = 3) AS BIGINT) AS n_outliers FROM vecs GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return metrics.cluster_summary(vecs(spark, sf_dir).withColumn("cluster", F.when(F.col("label") == 3, -1).otherwise(F.col("label"))))


# --- topics and summaries ------------------------------------------------------------------------------------------

TOPICS = """c AS (SELECT {0}, word, count(*) AS n FROM w GROUP BY ALL), z AS (SELECT {0}, sum(n) AS size FROM c GROUP BY ALL), avg_ AS (SELECT avg(size) AS mean FROM z), t AS (SELECT word, sum(n) AS total FROM c GROUP BY 1),
  k AS (SELECT {0}, word, n / size * ln(1 + mean / total) AS weight FROM c JOIN z USING ({0}) JOIN t USING (word), avg_),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY round(weight, 9) DESC, word) AS rank FROM k)"""


@query(f"WITH w AS (SELECT source, unnest({WORDS}) AS word FROM documents), {TOPICS.format('source')} SELECT source, rank, word, round(weight, 6) AS weight FROM ranked WHERE rank <= 10")
def topic_words(spark, sf_dir):
    return topics.topic_words(_table(spark, sf_dir, "documents").select("source", "text"), ["source"]).withColumn("weight", r6("weight"))


WINDOWS = f"""{LINES}, u AS (SELECT log_id, line_id, text, CAST(floor((row_number() OVER (PARTITION BY log_id ORDER BY line_id) - 1) / 20) AS BIGINT) AS "window" FROM lines),
  f AS (SELECT *, count(*) OVER (PARTITION BY log_id, "window") AS n FROM u), full_ AS (SELECT log_id, line_id, text, "window" FROM f WHERE n = 20)"""


@query(f"""WITH {WINDOWS}, w AS (SELECT log_id, "window", unnest({WORDS}) AS word FROM full_), {TOPICS.format('log_id, "window"')}
  SELECT log_id, "window", rank, word, round(weight, 6) AS weight FROM ranked WHERE rank <= 10""")
def window20_topics(spark, sf_dir):
    w = topics.count_windows(docs(spark, sf_dir))
    return topics.topic_words(w, ["log_id", "window"]).withColumn("weight", r6("weight"))


@query(f"""WITH {LINES}, h AS (SELECT log_id, list_distinct({WORDS}) AS words FROM lines WHERE line_id = 0),
  s AS (SELECT l.log_id, line_id, text, len(list_intersect({FULL.format("lower(text)")}, words)) AS score FROM lines l JOIN h ON h.log_id = l.log_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY score DESC, line_id) AS r FROM s) SELECT log_id, line_id, CAST(score AS BIGINT) AS score, text FROM r WHERE r = 1""")
def representative_line(spark, sf_dir):
    lines = docs(spark, sf_dir)
    head = lines.where("line_id = 0").select("log_id", F.array_distinct(text.word_tokens(F.col("text"))).alias("words"))
    return topics.representative(lines.select("log_id", "line_id", "text"), head, ["log_id"])


@query()
def lda_topics(spark, sf_dir):
    return topics.lda_topics(_table(spark, sf_dir, "documents"), 4)


@query(f"""WITH w AS (SELECT unnest({WORDS}) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS v FROM c)
  SELECT 0 AS topic, row_number() OVER (ORDER BY n DESC, word) AS rank, word, round((n + 1) / (total + v), 9) AS weight FROM c, t ORDER BY n DESC, word LIMIT 10""")
def lda_single(spark, sf_dir):
    return topics.lda_topics(_table(spark, sf_dir, "documents"), 1).withColumn("weight", F.round("weight", 9))


TFIDF = f"""n AS (SELECT log_id, count(*) AS n FROM lines GROUP BY 1), w AS (SELECT log_id, line_id, unnest({WORDS}) AS token FROM lines),
  tf AS (SELECT log_id, line_id, token, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT log_id, token, count(*) AS df FROM tf GROUP BY ALL),
  r AS (SELECT tf.log_id, line_id, tf.token, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN df ON tf.log_id = df.log_id AND tf.token = df.token JOIN n ON n.log_id = tf.log_id),
  l AS (SELECT log_id, line_id, sqrt(sum(raw * raw)) AS len FROM r GROUP BY ALL), u AS (SELECT r.log_id, r.line_id, token, raw / len AS x FROM r JOIN l ON r.log_id = l.log_id AND r.line_id = l.line_id),
  sim AS (SELECT a.log_id, a.line_id AS i, b.line_id AS j, sum(a.x * b.x) AS s FROM u a JOIN u b ON a.log_id = b.log_id AND a.token = b.token AND a.line_id <> b.line_id GROUP BY ALL)"""


def _ranked_sql(links: str) -> str:
    """Ten rounds of damped centrality over links(log_id, i, j, s)."""
    rounds = "".join(
        f""", s{r + 1} AS (SELECT b.log_id, b.line_id, 0.15 / n + 0.85 * coalesce(g.got, 0) AS score FROM lines b JOIN n ON n.log_id = b.log_id
  LEFT JOIN (SELECT p.log_id, p.j, sum(p.p * s{r}.score) AS got FROM p JOIN s{r} ON s{r}.log_id = p.log_id AND s{r}.line_id = p.i GROUP BY ALL) g ON g.log_id = b.log_id AND g.j = b.line_id)"""
        for r in range(10)
    )
    return f"""WITH {LINES}, {TFIDF}, links AS ({links}), p AS (SELECT log_id, i, j, s / sum(s) OVER (PARTITION BY log_id, i) AS p FROM links),
  s0 AS (SELECT b.log_id, b.line_id, 1 / n AS score FROM lines b JOIN n ON n.log_id = b.log_id){rounds} SELECT log_id, line_id, round(score, 6) AS score FROM s10"""


@query(_ranked_sql("SELECT * FROM sim"))
def textrank_sentences(spark, sf_dir):
    return topics.rank_sentences(docs(spark, sf_dir)).withColumn("score", r6("score"))


@query(f"""WITH {LINES}, w AS (SELECT log_id, line_id, unnest({WORDS}) AS word FROM lines), c AS (SELECT log_id, word, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT log_id, sum(n) AS total FROM c GROUP BY 1),
  f AS (SELECT c.log_id, word FROM c JOIN t USING (log_id) WHERE n >= greatest(2, 0.02 * total)), h AS (SELECT w.log_id, w.line_id, count(f.word) AS h, count(*) AS n FROM w LEFT JOIN f ON f.log_id = w.log_id AND f.word = w.word GROUP BY ALL)
  SELECT log_id, line_id, round(h * h / n, 6) AS score FROM h""")
def luhn_sentences(spark, sf_dir):
    return topics.frequent_word_sentences(docs(spark, sf_dir)).withColumn("score", r6("score"))


ROUGE = f"""h AS (SELECT log_id, list_distinct({TOKENS}) AS c FROM lines WHERE line_id = 0), g AS (SELECT doc_id AS log_id, list_distinct({TOKENS}) AS r FROM documents WHERE text IS NOT NULL),
  o AS (SELECT log_id, len(c) AS nc, len(r) AS nr, len(list_intersect(c, r)) AS same FROM h JOIN g USING (log_id)),
  pr AS (SELECT log_id, CASE WHEN nc > 0 THEN same / nc ELSE 0 END AS p, CASE WHEN nr > 0 THEN same / nr ELSE 0 END AS r, same FROM o)"""


def _rouge(spark, sf_dir) -> DataFrame:
    head = docs(spark, sf_dir).where("line_id = 0").select("log_id", F.col("text").alias("candidate"))
    whole = _table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("log_id"), F.col("text").alias("reference"))
    return metrics.best_rouge(head, whole, ["log_id"])


@query(f"WITH {LINES}, {ROUGE} SELECT log_id, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN same > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f FROM pr")
def rouge1(spark, sf_dir):
    return _rouge(spark, sf_dir).select("log_id", r6("p").alias("p"), r6("r").alias("r"), r6("f").alias("f"))


@query(f"WITH {LINES}, {ROUGE} SELECT round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(CASE WHEN same > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f FROM pr")
def rouge1_avg(spark, sf_dir):
    return _rouge(spark, sf_dir).agg(*[r6(F.avg(c)).alias(c) for c in "prf"])


# --- analysis ------------------------------------------------------------------------------------------------------

LINE_METRICS = f"{LINES}, x AS (SELECT log_id, line_id, length(text) AS n FROM lines)"


def _line_lengths(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select("log_id", "line_id", F.length("text").cast("long").alias("n"))


@query(f"WITH {LINE_METRICS}, r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY n DESC, line_id) AS r FROM x) SELECT log_id, line_id, n FROM r WHERE r = 1")
def best_k_per_group(spark, sf_dir):
    return metrics.best_per_key(_line_lengths(spark, sf_dir), ["log_id"], "n", "line_id")


@query("""WITH m AS (SELECT quantile_cont(n_chars, 0.5) AS m FROM documents) SELECT (SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 1) AS at_min,
  (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1) AS at_max, (SELECT doc_id FROM documents, m ORDER BY abs(n_chars - m), doc_id LIMIT 1) AS at_median""")
def extremes(spark, sf_dir):
    return metrics.extremes(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars")


@query("""SELECT lang, count(n_chars) AS count, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, CAST(min(n_chars) AS DOUBLE) AS min, quantile_cont(n_chars::DOUBLE, 0.25) AS q25,
  quantile_cont(n_chars::DOUBLE, 0.5) AS q50, quantile_cont(n_chars::DOUBLE, 0.75) AS q75, CAST(max(n_chars) AS DOUBLE) AS max FROM documents GROUP BY 1""")
def describe_stats(spark, sf_dir):
    d = metrics.describe(_table(spark, sf_dir, "documents"), "n_chars", ["lang"])
    return d.withColumns({"mean": r6("mean"), "std": r6("std")})


@query("SELECT printf('%s %.2f', lang, CAST(n_chars % 3 AS DOUBLE) / 3) AS params, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy(F.format_string("%s %.2f", "lang", (F.col("n_chars") % 3).cast("double") / 3).alias("params")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY lang ORDER BY source) - 1 AS BIGINT) AS code FROM documents")
def label_encode(spark, sf_dir):
    return render.label_encode(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "source", ["lang"]).select("doc_id", "code")


_HSV = """h AS (SELECT log_id, label, code, code / n * 6 AS h FROM u), s AS (SELECT *, h - floor(h) AS f, CAST(floor(h) AS BIGINT) % 6 AS x FROM h),
  q AS (SELECT *, 1 - 0.75 AS p, 1 - 0.75 * f AS q, 1 - 0.75 * (1 - f) AS t FROM s),
  rgb AS (SELECT log_id, label, code, CAST(floor(CASE x WHEN 0 THEN 1.0 WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE 1.0 END * 255) AS BIGINT) AS r,
    CAST(floor(CASE x WHEN 0 THEN t WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN q ELSE p END * 255) AS BIGINT) AS g,
    CAST(floor(CASE x WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 ELSE q END * 255) AS BIGINT) AS b FROM q)"""
PALETTE = f"{VECS}, l AS (SELECT DISTINCT log_id, label FROM vecs), u AS (SELECT log_id, label, CAST(dense_rank() OVER (PARTITION BY log_id ORDER BY label) - 1 AS BIGINT) AS code, CAST(count(*) OVER (PARTITION BY log_id) AS DOUBLE) AS n FROM l), {_HSV}"


@query(f"WITH {PALETTE} SELECT log_id, label, code, r, g, b FROM rgb")
def hsv_palette(spark, sf_dir):
    return render.palette(vecs(spark, sf_dir), "label", ["log_id"])


@query(f"""WITH {PALETTE} SELECT v.log_id, v.line_id, printf('%03d-%d: <span style=''color:rgb(%d,%d,%d)''>%s</span>', v.line_id, v.label, r, g, b, 'line ' || v.line_id) AS markdown
  FROM vecs v JOIN rgb ON rgb.log_id = v.log_id AND rgb.label = v.label""")
def markdown_lines(spark, sf_dir):
    v = vecs(spark, sf_dir).select("log_id", "line_id", F.col("label").alias("cluster"), F.concat(F.lit("line "), F.col("line_id")).alias("text"))
    return render.markdown_lines(v, ["log_id"])


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    """An extension: the same plan runs on a stream."""
    return counts_by_window(_table(spark, sf_dir, "events"), "1 hour", "2 hours").withColumn("total", F.round("total", 4))



