"""More named queries with their SQL: projections, joins, runs of the whole pipeline, and what they report."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linewright.catalog import (
    CONV, FULL, LINES, MASKS, TFIDF, TOKENS, VEC_PAIRS, VECS, WORDS, _points, _ranked_sql, _table, conv, docs, near_vecs, query, r6, vecs,
)
from linewright.functions import text
from linewright.operators import clustering, distances, experiments, features, metrics, pipeline, topics
from linewright.operators.blocks import Vectors
from linewright.sources import sinks

# --- projections ---------------------------------------------------------------------------------------------------


@query("SELECT to_json({'doc_id': doc_id, 'quality': quality, 'toxic': toxic}) AS json FROM labels")
def json_rows(spark, sf_dir):
    return sinks.encode_json(_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


@query(f"WITH {LINES} SELECT log_id, line_id, regexp_replace(text, '{MASKS[-1]}', '<*>', 'g') AS masked FROM lines")
def mask_last_regex(spark, sf_dir):
    return docs(spark, sf_dir).select("log_id", "line_id", text.mask_last(F.col("text"), MASKS).alias("masked"))


@query("SELECT event_id, event_type || ' by ' || user_id AS stripped FROM events")
def strip_time(spark, sf_dir):
    stamped = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.col("event_type"), F.lit(" by "), F.col("user_id"))
    return _table(spark, sf_dir, "events").select("event_id", text.strip_time(stamped).alias("stripped"))


@query("SELECT event_id, user_id || '~' || event_type AS variables FROM events")
def spell_variables(spark, sf_dir):
    line = F.concat(F.lit("user: ("), F.col("user_id"), F.lit(") did, "), F.col("event_type"), F.lit("; end"))
    found = text.spell_variables(F.lit("user <*> did <*> end"), line)
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(found, "~").alias("variables"))


@query(f"WITH {LINES} SELECT log_id, line_id, lower(regexp_replace(text, '[[:punct:]]', '', 'g')) AS plain FROM lines")
def without_punctuation(spark, sf_dir):
    return docs(spark, sf_dir).select("log_id", "line_id", text.without_punctuation(F.col("text")).alias("plain"))


@query(f"WITH {LINES}, t AS (SELECT log_id, line_id, {TOKENS} AS v FROM lines) SELECT log_id, line_id, array_to_string(v[1:3], '~') AS first3, array_to_string(v, '~') AS whole FROM t")
def limit_tokens(spark, sf_dir):
    t = docs(spark, sf_dir).select("log_id", "line_id", text.tokens(F.col("text")).alias("v"))
    return t.select("log_id", "line_id", F.array_join(features.limit_tokens(F.col("v"), 3), "~").alias("first3"), F.array_join(features.limit_tokens(F.col("v"), -1), "~").alias("whole"))


@query(f"WITH {LINES} SELECT log_id, line_id, strip_accents(lower(text)) AS plain FROM lines WHERE regexp_matches(text, '^[\\x00-\\x7FÀ-ÖØ-öø-ÿ]*$') AND NOT regexp_matches(text, '[ÆÐØÞßæðøþ]')")
def accents_folded(spark, sf_dir):
    plain = docs(spark, sf_dir).where(F.col("text").rlike("^[\\x00-\\x7FÀ-ÖØ-öø-ÿ]*$") & ~F.col("text").rlike("[ÆÐØÞßæðøþ]"))
    return plain.select("log_id", "line_id", text.without_accents(F.lower("text")).alias("plain"))


@query("SELECT p_partkey, p_size AS size, p_retailprice AS price, lower(p_brand) AS brand FROM part")
def flatten_parameters(spark, sf_dir):
    nested = _table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.lower("p_brand").alias("brand")).alias("hyperparameters"))
    return experiments.flatten(nested, "hyperparameters")


@query("SELECT vec_id, k, CASE WHEN k <> -1 THEN s ELSE a END AS score FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE vec_id % 3 END AS k, vec_id / 7.0::DOUBLE AS s, vec_id / 9.0::DOUBLE AS a FROM embeddings)")
def conditional_score(spark, sf_dir):
    k = F.when(F.col("vec_id") % 3 == 0, -1).otherwise(F.col("vec_id") % 3)
    runs = _table(spark, sf_dir, "embeddings").select("vec_id", k.alias("k"), (F.col("vec_id") / 7.0).alias("silhouette"), (F.col("vec_id") / 9.0).alias("ari"))
    return metrics.conditional_score(runs).select("vec_id", "k", "score")


@query(f"WITH {LINES} SELECT log_id, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY 1 HAVING count(*) > 10 AND count(*) < 20")
def filter_predicates(spark, sf_dir):
    sized = docs(spark, sf_dir).groupBy("log_id").agg(F.count(F.lit(1)).alias("n"))
    return sized.where((F.col("n") > 10) & (F.col("n") < 20))


@query(f"""WITH {LINES}, t AS (SELECT log_id, line_id, CAST(unnest(range(1, len({TOKENS}) + 1)) AS BIGINT) AS place, unnest({TOKENS}) AS token FROM lines),
  v AS (SELECT DISTINCT token FROM t), z AS (SELECT token, row_number() OVER (ORDER BY hex(encode(token))) - 1 AS no FROM v)
  SELECT log_id, line_id, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS places FROM (SELECT DISTINCT log_id, line_id, no FROM t JOIN z USING (token)) GROUP BY ALL""")
def one_hot_places(spark, sf_dir):
    lines = docs(spark, sf_dir).select(F.struct("log_id", "line_id").alias("key"), text.tokens(F.col("text")).alias("v"))
    found = sinks.one_hot_rows(lines, "key", "v")
    return found.select("key.log_id", "key.line_id", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


# --- joins, order and samples --------------------------------------------------------------------------------------


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)")
def lookup_by_id(spark, sf_dir):
    known = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    found = experiments.look_up(_table(spark, sf_dir, "documents").select("doc_id"), known, "doc_id")
    return found.select("doc_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("quality", "toxic")])


@query("""WITH a AS (SELECT doc_id AS log_id, unnest(string_split(text, chr(10))) AS x, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS place FROM documents WHERE text IS NOT NULL),
  b AS (SELECT conv_id AS log_id, text AS y, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations)
  SELECT log_id, place, x, y FROM a JOIN b USING (log_id, place)""")
def positional_zip(spark, sf_dir):
    left = docs(spark, sf_dir).select("log_id", "line_id", F.col("text").alias("x"))
    right = conv(spark, sf_dir).select("log_id", "line_id", F.col("text").alias("y"))
    return experiments.zip_lines(left, right).select("log_id", "place", "x", "y")


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_templates(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query(f"""WITH {LINES}, r AS (SELECT log_id, line_id, length(text) AS n, row_number() OVER (PARTITION BY log_id, length(text) ORDER BY line_id) AS r FROM lines) SELECT log_id, line_id, n FROM r WHERE r = 1""")
def first_of_equals(spark, sf_dir):
    sized = docs(spark, sf_dir).select("log_id", "line_id", F.length("text").alias("n"))
    return experiments.first_of_equals(sized, ["log_id", "n"], "line_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents")
def shuffled(spark, sf_dir):
    return experiments.shuffled(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def head_rows(spark, sf_dir):
    return experiments.head(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 50)


@query("""WITH p AS (SELECT unnest(range(200)) AS pick), n AS (SELECT count(*) AS n FROM documents), f AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place FROM documents)
  SELECT CAST(pick AS BIGINT) AS pick, doc_id FROM p, n JOIN f ON f.place = (('0x' || substr(md5('pick-' || CAST(pick AS VARCHAR)), 1, 8))::BIGINT) % n""")
def random_picks(spark, sf_dir):
    return experiments.random_picks(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 200)


@query("SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT conv_id, 'turn' FROM conversations UNION ALL SELECT item_id, 'item' FROM benchmark")
def union_of_runs(spark, sf_dir):
    parts = [("documents", "doc_id", "document"), ("conversations", "conv_id", "turn"), ("benchmark", "item_id", "item")]
    return experiments.union_all([_table(spark, sf_dir, t).select(F.col(c).alias("id"), F.lit(k).alias("kind")) for t, c, k in parts])


# --- distances -----------------------------------------------------------------------------------------------------


@query(f"WITH {VEC_PAIRS} SELECT log_id, i, j, round(2 * d, 6) AS d FROM p")
def cosine_plain(spark, sf_dir):
    return distances.cosine_pairs(vecs(spark, sf_dir), "vec", "line_id", "log_id", halved=False).withColumn("d", r6("d"))


@query(f"""WITH {LINES}, s AS (SELECT log_id, line_id, list_distinct(regexp_extract_all(text, '\\d+')) AS v FROM lines),
  q AS (SELECT a.log_id, a.line_id AS i, b.line_id AS j, len(list_intersect(a.v, b.v)) AS common, len(a.v) + len(b.v) - len(list_intersect(a.v, b.v)) AS either FROM s a JOIN s b ON a.log_id = b.log_id AND a.line_id < b.line_id)
  SELECT log_id, i, j, either = 0 AS undefined, CASE WHEN either > 0 THEN round(1 - common / either, 6) END AS d FROM q""")
def jaccard_undefined(spark, sf_dir):
    numbers = docs(spark, sf_dir).withColumn("variables", F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)))
    found = pipeline.variable_pairs(numbers, empty=None)
    return found.select("log_id", "i", "j", F.isnan("d").alias("undefined"), F.when(~F.isnan("d"), r6("d")).alias("d"))


# --- runs ----------------------------------------------------------------------------------------------------------

VALUES = [0.0, 0.25, 0.5, 0.75, 1.0]


@query(f"""WITH {VEC_PAIRS}, n AS (SELECT log_id, line_id, row_number() OVER (PARTITION BY log_id ORDER BY line_id) - 1 AS place, count(*) OVER (PARTITION BY log_id) AS n FROM vecs),
  v AS (SELECT unnest({VALUES}::DOUBLE[]) AS v), grid AS (SELECT a.v AS alpha, b.v AS beta, c.v AS gamma FROM v a, v b, v c WHERE abs(a.v + b.v + c.v - 1) < 0.01),
  g AS (SELECT *, row_number() OVER (ORDER BY alpha, beta, gamma) - 1 AS run FROM grid),
  parts AS (SELECT p.log_id, p.i, p.j, CASE WHEN la % 2 <> lb % 2 THEN 1.0 ELSE 0.0 END AS dv, d AS de, (y.place - x.place) / (x.n - 1) AS dl FROM p JOIN n x ON x.log_id = p.log_id AND x.line_id = p.i JOIN n y ON y.log_id = p.log_id AND y.line_id = p.j),
  b AS (SELECT log_id, i, j, dv, de, dl FROM parts UNION ALL SELECT log_id, j, i, dv, de, dl FROM parts),
  r AS (SELECT run, b.log_id, i, j, row_number() OVER (PARTITION BY run, b.log_id, i ORDER BY round(alpha * dv + beta * de + gamma * dl, 9), j) AS r FROM b, g),
  s AS (SELECT run, avg(CASE WHEN x.label = y.label THEN 1.0 ELSE 0.0 END) AS score FROM r JOIN vecs x ON x.log_id = r.log_id AND x.line_id = r.i JOIN vecs y ON y.log_id = r.log_id AND y.line_id = r.j WHERE r.r = 1 GROUP BY 1),
  f AS (SELECT g.run, alpha, beta, gamma, score FROM g JOIN s USING (run))
  SELECT a.run, alpha, beta, gamma, round(score, 6) AS score, (SELECT b.run FROM f b WHERE b.run <= a.run ORDER BY round(b.score, 9) DESC, b.run LIMIT 1) AS best_run FROM f a""")
def weight_search_best(spark, sf_dir):
    v = vecs(spark, sf_dir)
    parity = v.select("log_id", "line_id", "vec", (F.col("label") % 2).alias("parity"))
    found = pipeline.weight_search(parity, v.select("log_id", "line_id", "label"), VALUES, agreement=lambda f, labels, triples: pipeline.nearest_agreement_of_vectors(f, "parity", labels, triples))
    return found.select("run", "alpha", "beta", "gamma", r6("score").alias("score"), "best_run")


@query()
def full_pipeline(spark, sf_dir):
    """Turns of conversations, from raw lines to the best count of clusters, by the default steps."""
    return pipeline.LinePipeline().best(conv(spark, sf_dir).select("log_id", "line_id", "line_num", "text"))


def _links(spark, sf_dir):
    """Vectors of a log whose ids are 10 apart and share a label must be together, those that don't cannot."""
    v = vecs(spark, sf_dir).select("log_id", "line_id", "label")
    after = v.select("log_id", (F.col("line_id") - 10).alias("line_id"), F.col("label").alias("next"))
    return v.join(after, ["log_id", "line_id"]).select("log_id", F.col("line_id").alias("i"), (F.col("line_id") + 10).alias("j"), F.when(F.col("label") == F.col("next"), "must").otherwise("cannot").alias("kind"))


@query()
def constrained_medoids(spark, sf_dir):
    return clustering.cluster_medoids(_points(spark, sf_dir), near_vecs(spark, sf_dir), 5, links=_links(spark, sf_dir))


@query()
def medoids_of_features(spark, sf_dir):
    return clustering.feature_medoids(vecs(spark, sf_dir), "vec", 5)


@query()
def linkage_of_features(spark, sf_dir):
    v = vecs(spark, sf_dir)
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: F.when(x == F.col("label"), 1.0).otherwise(0.0))
    return clustering.cluster_linkage(_points(spark, sf_dir), Vectors(v.withColumn("features", F.concat("vec", one_hot)), "features", "euclid"), 5, "ward")


@query()
def density_fewest_outliers(spark, sf_dir):
    return clustering.density_grid(_points(spark, sf_dir), near_vecs(spark, sf_dir))


# --- topics and reports --------------------------------------------------------------------------------------------


@query(_ranked_sql("SELECT log_id, i, j, 1.0 AS s FROM sim WHERE s > 0.1"))
def lexrank_sentences(spark, sf_dir):
    return topics.lex_rank(docs(spark, sf_dir)).withColumn("score", r6("score"))


@query()
def latent_sentences(spark, sf_dir):
    return topics.latent_sentences(features.tfidf(docs(spark, sf_dir))).withColumn("score", r6("score"))


@query()
def window_lda(spark, sf_dir):
    return topics.window_topics(topics.count_windows(docs(spark, sf_dir))).withColumn("weight", r6("weight"))


@query()
def corpus_topics(spark, sf_dir):
    """Topics of the documents that have a vector of the same number."""
    points = vecs(spark, sf_dir).select(F.col("line_id").alias("doc_id"), "vec")
    return topics.corpus_topics(points, "vec", _table(spark, sf_dir, "documents").select("doc_id", "text"), 8, "doc_id").withColumn("weight", r6("weight"))


@query()
def topic_mixes(spark, sf_dir):
    mixed = topics.topic_mix(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 4)
    return mixed.select("doc_id", F.posexplode("mix").alias("topic", "share")).select("doc_id", "topic", r6("share").alias("share"))


INFO = f"""w AS (SELECT source, unnest({WORDS}) AS word FROM documents), c AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL), z AS (SELECT source, sum(n) AS size FROM c GROUP BY 1),
  avg_ AS (SELECT avg(size) AS mean FROM z), t AS (SELECT word, sum(n) AS total FROM c GROUP BY 1), k AS (SELECT source, word, n / size * ln(1 + mean / total) AS weight FROM c JOIN z USING (source) JOIN t USING (word), avg_),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(weight, 9) DESC, word) AS rank FROM k), l AS (SELECT source, list(word ORDER BY rank) AS words FROM r WHERE rank <= 10 GROUP BY 1),
  h AS (SELECT d.source, doc_id, len(list_intersect(list_distinct({WORDS}), words)) AS hits FROM documents d JOIN l ON l.source = d.source),
  b AS (SELECT source, doc_id AS representative FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hits DESC, doc_id) AS r FROM h WHERE hits IS NOT NULL) WHERE r = 1)"""


@query(f"WITH {INFO} SELECT source, count(*) AS n, array_to_string(words[1:4], ' ') AS name, array_to_string(words, ',') AS words, representative FROM documents LEFT JOIN l USING (source) LEFT JOIN b USING (source) GROUP BY source, words, representative")
def topic_info(spark, sf_dir):
    return pipeline.topic_info(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source")


@query(f"WITH {INFO} SELECT doc_id, d.source, array_to_string(words, ',') AS words, representative = doc_id AS represents FROM documents d JOIN l ON l.source = d.source JOIN b ON b.source = d.source")
def document_info(spark, sf_dir):
    return pipeline.document_info(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source")


_HEADS = f"h AS (SELECT log_id, list_distinct({WORDS}) AS words FROM lines WHERE line_id = 0)"


def _representative(kind: str):
    def run(spark, sf_dir):
        lines = docs(spark, sf_dir)
        head = lines.where("line_id = 0").select("log_id", F.array_distinct(text.word_tokens(F.col("text"))).alias("words"))
        return topics.representative(lines.select("log_id", "line_id", "text"), head, ["log_id"], kind)

    run.__name__ = f"representative_{kind}"
    return run


for _kind, _hit in (("substring", "contains(array_to_string(words, ' '), x)"), ("member", "list_contains(words, x)")):
    query(f"""WITH {LINES}, {_HEADS}, s AS (SELECT l.log_id, line_id, text, len(list_filter({FULL.format("lower(text)")}, lambda x: {_hit})) AS score FROM lines l JOIN h ON h.log_id = l.log_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY score DESC, line_id) AS r FROM s) SELECT log_id, line_id, CAST(score AS BIGINT) AS score, text FROM r WHERE r = 1""")(_representative(_kind))


@query(f"WITH {VECS} SELECT log_id, label AS cluster, string_agg('line ' || line_id, chr(10) ORDER BY line_id) AS text FROM vecs GROUP BY ALL")
def lines_by_cluster(spark, sf_dir):
    return sinks.grouped_lines(vecs(spark, sf_dir).select("log_id", "line_id", F.col("label").alias("cluster"), F.concat(F.lit("line "), F.col("line_id")).alias("text")))


@query(f"""WITH {CONV}, p AS (SELECT log_id, line_id, role AS g, text AS query FROM conv), m AS (SELECT p.log_id, p.line_id, p.query, p.g, c.role, c.text FROM p JOIN conv c ON c.log_id = p.log_id)
  SELECT log_id, line_id, query, coalesce(string_agg(text, '~' ORDER BY text) FILTER (g = role), '') AS pos, coalesce(string_agg(text, '~' ORDER BY text) FILTER (g <> role), '') AS neg FROM m GROUP BY ALL""")
def contrastive_texts(spark, sf_dir):
    found = experiments.contrastive_lists(conv(spark, sf_dir), "role")
    return found.select("log_id", "line_id", "query", *[F.array_join(F.array_sort(c), "~").alias(c) for c in ("pos", "neg")])


@query(f"WITH {LINES}, t AS (SELECT log_id, line_id, {TOKENS} AS v FROM lines) SELECT log_id, line_id, CAST(len(v) AS BIGINT) AS n_tokens, row_number() OVER (PARTITION BY log_id, len(v) ORDER BY line_id) AS seq FROM t")
def template_instances(spark, sf_dir):
    t = docs(spark, sf_dir).select("log_id", "line_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))
    return experiments.instance_ids(t).select("log_id", "line_id", "n_tokens", "seq")
