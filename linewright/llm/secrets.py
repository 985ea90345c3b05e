"""Secret scanning with a random forest that removes false positives, in DataFrame expressions and JVM models alone.

Candidates are long tokens, what is assigned to a name that speaks of a secret, and headers of private keys. Features of a
candidate are its length, the changes between classes of its characters, how likely its letters follow one another, how
much of it a dictionary covers, the file's path, and the words beside it. Dictionary and letter transitions are those of
the corpus itself. The forest is trained on labelled findings (candidate, neighbours, path, label).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm._common import matches
from linewright.plans.lineage import materialize

LEAST = 0.5
SIDE = 40
_WORD = "A-Za-z0-9+/_-"
#: Tokens of 12 characters and more with a digit or with letters of both cases inside, and of 20 and more of any kind.
TOKEN = rf"(?<![{_WORD}])(?:(?=[A-Za-z+/_-]*+[0-9])[{_WORD}]{{12,}}+|(?=[A-Z0-9+/_-]*+[a-z0-9+/_-]++[A-Z])[{_WORD}]{{12,}}+|[{_WORD}]{{20,}}+)={{0,2}}"
#: What is assigned to a password, a token or a key: eight characters and more without space or quotes.
CUE = r"(?i:passw(?:or)?d|passwd|pwd|secret|token|api_?key)[\"']?\s{0,2}[=:]"
ASSIGNED = rf"(?<=[\s\"'=:])(?<={CUE}\s{{0,2}}[\"']?)[^\s\"'<>=:][^\s\"'<>]{{7,}}+"
HEADER = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
CANDIDATE = f"{HEADER}|{ASSIGNED}|{TOKEN}"
#: Share of all words from which a word is in the dictionary, so that there are at most 1 / SHARE; words that may be broadcast.
SHARE, BROADCAST_WORDS = 1e-6, 200_000
# Words whose presence speaks against a secret, and letter pairs of plain text.
PLACEHOLDERS = "example|sample|dummy|changeme|placeholder|default|your|here|none|null|test|xxxx"
BIGRAMS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le"
CUES = r"passw|pwd|secret|token|api|key|auth|cred|private|bearer|access|login"
DENIALS = r"commit|checksum|md5|sha|hash|uuid|guid|digest|etag|version|isbn|example|sample|dummy|order|invoice|image|file|page|tel"
QUIET_PATHS = r"(?i)test|example|sample|fixture|mock|/docs?/|readme|\.lock$|\.min\.|vendor|node_modules"

FEATURES = (
    "length", "digits", "upper", "lower", "changes", "case_changes", "distinct", "entropy", "hex", "placeholder", "bigrams", "prefix",
    "quiet_path", "cue", "denial", "assigned", "quoted", "header", "punctuation", "transitions", "dictionary",
)
#: Letters and one sign for all that is none.
SIGNS = 27


@dataclass
class Lexicon:
    """What the corpus says of plain words: the dictionary (column word) and the log10 probability of each sign after each."""

    words: DataFrame
    few: bool
    transitions: list[float]


def lexicon(docs: DataFrame) -> Lexicon:
    """The dictionary and letter transitions of docs(text). Null and empty texts have no words; without words nothing is known."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    counts = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "secret-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    known = counts.where((F.col("n") >= 3) & (F.col("n") >= SHARE * total)).select("word")
    signs = _signs(F.concat(F.lit(" "), F.col("word"), F.lit(" ")))
    pairs = counts.select("n", F.explode(_pairs(signs)).alias("x")).groupBy("x").agg(F.sum("n").alias("n")).collect()  # at most SIGNS ** 2 rows
    n = [1.0] * SIGNS**2
    for r in pairs:
        n[r["x"]] += r["n"]
    sums = [sum(n[i * SIGNS : (i + 1) * SIGNS]) for i in range(SIGNS)]
    return Lexicon(known, known.count() <= BROADCAST_WORDS, [math.log10(x / sums[i // SIGNS]) for i, x in enumerate(n)])


def _signs(v: Column) -> Column:
    """Place in the alphabet of each character, 0 for what is no letter."""
    return F.transform(F.filter(F.split(F.lower(v), ""), lambda c: c != ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 96).otherwise(0))


def _pairs(signs: Column) -> Column:
    """SIGNS * sign + next sign, for each two neighbours; a single sign has none."""
    zipped = F.arrays_zip(F.slice(signs, F.lit(1), F.greatest(F.lit(0), F.size(signs) - 1)).alias("a"), F.slice(signs, F.lit(2), F.greatest(F.lit(0), F.size(signs) - 1)).alias("b"))
    return F.transform(zipped, lambda x: x["a"] * SIGNS + x["b"])


def _count(v: Column, pattern: str) -> Column:
    return F.regexp_count(v, F.lit(pattern)).cast("double")


def _spread(v: Column) -> tuple[Column, Column]:
    """Different characters and bits of entropy of a whole candidate, in one pass over its sorted characters."""
    none = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("kinds"))
    bits = lambda n: F.when(n > 1, n * F.log2(F.greatest(n, F.lit(1.0)))).otherwise(F.lit(0.0))

    def step(a: Column, c: Column) -> Column:
        same = a["c"] == c
        return F.struct(
            c.alias("c"), F.when(same, a["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
            F.when(same, a["sum"]).otherwise(a["sum"] + bits(a["run"])).alias("sum"), F.when(same, a["kinds"]).otherwise(a["kinds"] + 1.0).alias("kinds"),
        )

    end = F.aggregate(F.array_sort(F.filter(F.split(v, ""), lambda c: c != "")), none, step)
    n = F.length(v).cast("double")
    return end["kinds"] / n, F.log2(n) - (end["sum"] + bits(end["run"])) / n


def features(v: Column, left: Column, right: Column, path: Column, transitions: list[float]) -> list[Column]:
    """The columns of FEATURES for a candidate, its neighbours and its path, but for the dictionary's share of it."""
    n = F.length(v).cast("double")
    low = F.lower(v)
    kinds, entropy = _spread(v)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    near = F.concat_ws(" ", left, right)
    table = F.lit(transitions)
    pairs = _pairs(_signs(v))
    follows = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.get(table, x)) / F.greatest(F.lit(1), F.size(pairs))
    values = [
        n, _count(v, "[0-9]") / n, _count(v, "[A-Z]") / n, _count(v, "[a-z]") / n,
        (_count(v, "[0-9](?=[A-Za-z])") + _count(v, "[A-Za-z](?=[0-9])")) / n, (_count(v, "[a-z](?=[A-Z])") + _count(v, "[A-Z](?=[a-z])")) / n,
        kinds, entropy, flag(low.rlike("^[0-9a-f]+$")), flag(low.rlike(PLACEHOLDERS)), _count(low, BIGRAMS) / n,
        flag(v.rlike("^(?:A[KS]IA|gh[pousr]_|sk_|pk_|xox[abp]-|AIza|eyJ|glpat-)")), flag(path.rlike(QUIET_PATHS)), flag(F.lower(near).rlike(CUES)),
        flag(F.lower(near).rlike(DENIALS)), flag(left.rlike(r"[=:]\s*[\"']?$")), flag(left.rlike("[\"']$") & right.rlike("^[\"']")),
        flag(v.startswith("-----BEGIN")), _count(v, "[^A-Za-z0-9]") / n, follows,
    ]
    return [x.alias(name) for x, name in zip(values, FEATURES, strict=False)]


def seed_findings(spark: SparkSession, each: int = 150) -> DataFrame:
    """Labelled findings to start from: value, left, right, path and label, made up from hashes by form.

    Twelve forms of secrets and twelve of harmless strings, `each` of either form. Findings that people have labelled
    replace or join them.
    """
    hexes = F.sha2(F.concat(F.lit("finding-"), F.col("id").cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(hexes)), "[^A-Za-z0-9]", "x")
    base32 = F.translate(F.upper(hexes), "01", "QZ")
    wide = F.translate(F.substring(mixed, 1, 30), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    words = F.array(*[F.lit(w) for w in ("thereding", "oneration", "schaftlich", "entelleau", "cionmente", "andhation", "erstandung", "reportable")])
    word = F.concat(F.get(words, (F.col("id") % 8).cast("int")), F.get(words, (F.col("id") / 8 % 8).cast("int")))
    cut = lambda c, n: F.substring(c, 1, n)
    text = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    forms = [
        (1, text("AKIA", cut(wide, 16)), "of the ", " and to", "a"), (1, text("AKIA", cut(base32, 16)), "in that ", "", "config/aws"), (1, cut(hexes, 18), "the password=", " is", "a"),
        (1, cut(hexes, 40), 'token = "', '" of', "a"), (1, text("ghp_", cut(mixed, 36)), "export ", "", "deploy.sh"), (1, text("sk_live_", cut(mixed, 24)), "key: ", "", "app.env"),
        (1, cut(mixed, 32), "api_key=", "", "settings.py"), (1, cut(mixed, 40), 'secret: "', '"', "a"), (1, text("eyJ", cut(mixed, 40)), "Authorization: Bearer ", "", "a"),
        (1, text("xoxb-", cut(mixed, 30)), "slack ", "", "bot.js"), (1, text("Pw", cut(mixed, 12), "9x"), "passwd: ", "", "a"), (1, text("-----BEGIN RSA PRIVATE KEY-----"), "", "", "id_rsa"),
        (0, text(cut(hexes, 8), "-", F.substring(hexes, 9, 4), "-", F.substring(hexes, 13, 4), "-", F.substring(hexes, 17, 12)), "uuid ", "", "a"),
        (0, cut(hexes, 40), "commit ", " by", "a"), (0, cut(hexes, 32), "md5 checksum ", "", "a"), (0, text("EXAMPLEtoken", F.lit("1234567890")), "token=", "", "docs/readme"),
        (0, text("changeme", F.col("id").cast("string"), "password"), "password=", "", "tests/x"), (0, text(word, (F.col("id") % 10).cast("string")), "of ", " the", "a"),
        (0, text("4", F.lpad((F.col("id") * 7919 % 1000000007).cast("string"), 15, "3")), "en ", " the", "a"), (0, text("2024-0", (F.col("id") % 9 + 1).cast("string"), "-11T10-00-00"), "at ", "", "a"),
        (0, text("image_", word, "_2024"), "see ", ".png", "a"), (0, text("/page/", word, "/", (F.col("id") % 100).cast("string")), "com", "", "a"), (0, cut(mixed, 32), 'secret = "', '"', "tests/fixtures/mock.py"),
        (0, text(word, "-", word, "-v2"), "file ", "", "a"),
    ]
    frames = None
    for k, (label, value, left, right, path) in enumerate(forms):
        one = spark.range(k * each, (k + 1) * each).select(value.alias("value"), F.lit(left).alias("left"), F.lit(right).alias("right"), F.lit(path).alias("path"), F.lit(float(label)).alias("label"))
        frames = one if frames is None else frames.unionByName(one)
    return frames


def _assembled(findings: DataFrame, known: Lexicon) -> DataFrame:
    """findings (with a key of their own, `finding`) with their features as a vector."""
    split = F.lower(F.regexp_replace("value", "([a-z])([A-Z])", "$1 $2"))
    pieces = findings.select("finding", F.explode(F.regexp_extract_all(split, F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    covered = pieces.join(F.broadcast(known.words) if known.few else known.words, "word").groupBy("finding").agg(F.sum(F.length("word")).alias("covered"))
    ready = findings.join(covered, "finding", "left").select("*", *features(F.col("value"), F.col("left"), F.col("right"), F.col("path"), known.transitions))
    ready = ready.withColumn("dictionary", F.coalesce("covered", F.lit(0)) / F.length("value"))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features", handleInvalid="keep").transform(ready).drop("covered", *FEATURES)


def train(findings: DataFrame, known: Lexicon, trees: int = 40, depth: int = 8) -> RandomForestClassificationModel:
    """A forest from labelled findings (value, left, right, path, label 0 or 1). Rows without a value or label are left out."""
    usable = findings.where("value is not null and value <> '' and label is not null").fillna("", ["left", "right", "path"]).select("value", "left", "right", "path", "label")
    usable = materialize(usable.withColumn("finding", F.monotonically_increasing_id()), "secret-findings")
    return RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, subsamplingRate=0.8).fit(_assembled(usable, known))


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each candidate: doc_id, path, start, end (code points, end exclusive), value, left and right."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    text = docs.select("doc_id", where.alias("path"), "text")
    cue = F.col("text").rlike(CUE)  # without one nothing can be assigned to it, and the look back from each place is left out
    plain = f"{HEADER}|{TOKEN}"
    found = matches(text, F.col("text"), {"found": (CANDIDATE, cue), "plain": (plain, ~cue & F.col("text").rlike(plain))}, SIDE, SIDE)
    return found.select("doc_id", "path", F.explode(F.concat("found", "plain")).alias("x")).select("doc_id", "path", F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.v").alias("value"), F.col("x.l").alias("left"), F.col("x.r").alias("right"))


def find_secrets(docs: DataFrame, model: RandomForestClassificationModel, known: Lexicon, path: str | None = None, least: float = LEAST) -> DataFrame:
    """A row for each finding that the forest keeps: doc_id, start, end (code points, end exclusive), value and score.

    path: a column of docs with the file's path, if there is one. Null and empty texts have no findings, very long ones
    are scanned whole; rows are scanned one by one, so repeated rows repeat their findings, and rows without an id keep
    a null one. A score of `least` is kept. Other columns of docs are ignored, whatever their names. An empty table
    gives an empty table.
    """
    found = materialize(candidates(docs, path).withColumn("finding", F.monotonically_increasing_id()), "secret-candidates")
    scored = model.transform(_assembled(found, known)).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.where(F.col("score") >= least).select("doc_id", "start", "end", "value", "score")
