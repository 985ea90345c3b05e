"""Personal data by weak supervision, in DataFrame expressions alone.

Candidate spans come from the base patterns and from looser ones. Four labelers (pattern, gazetteer, left context and
shape) vote on each candidate or abstain. The votes of all candidates are counted by their combination; expectation
maximisation over that table (its size is fixed by the number of combinations) estimates how reliable each labeler is,
and a logistic span classifier is fitted to the resulting soft labels. Looser candidates that the classifier accepts
join the base spans, which always stay. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm._common import aside, earlier, matches
from linewright.plans.lineage import Table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with possessive repeats and guards that change no match but keep a scan linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns, whose matches are candidates only.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+(])(?<!\+[0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a scan to be worth while; where it is empty, a match.
GATE = {"email": "@", "ip": ".", "card": "", "phone": "+", "loose_email": "at", "loose_phone": ""}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
LEFT = 40
# Gazetteers and cues of the labelers.
TOP_DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|it|nl|ch|at|ca|au)$"
RESERVED_IP = r"^(?:0|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\."
CARD_ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6)"
COUNTRY_CODE = r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {
    "email": r"mail|contact|write to|reach|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|adress|adresse|dirección",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|cell|fax|telefon|teléfono|téléphone|whatsapp",
}
DENIALS = r"version|isbn|order|invoice|serial|\bref\b|section|\bid\b|build|release"
def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + twice

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """What a base match must fulfil besides its pattern."""
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, x: Column, base: Column) -> list[Column]:
    """The labelers' votes (1, -1; 0 abstains): pattern, gazetteer, left context, shape."""
    v, d = x["v"], digits(x["v"])
    n = F.length(d)
    never = F.lit(False)
    gazetteer = {
        "email": _vote(F.regexp_replace(v, r" ?(?:\(dot\)|\[dot\]) ?", ".").rlike(TOP_DOMAINS), never),
        "ip": _vote(~v.rlike(RESERVED_IP), v.rlike(RESERVED_IP)),
        "card": _vote(d.rlike(CARD_ISSUER), ~d.rlike(CARD_ISSUER)),
        "phone": _vote(F.when(v.startswith("+"), d.rlike(COUNTRY_CODE)).otherwise(d.rlike("^[2-9]")), F.when(v.startswith("+"), ~d.rlike(COUNTRY_CODE)).otherwise(~d.rlike("^[2-9]"))),
    }[kind]
    shape = {
        "email": _vote(F.length(v) <= 80, F.length(v) > 254),
        "ip": _vote(F.length(v) >= 8, F.length(v) > 15),
        "card": _vote(v.rlike(r"^(?:[0-9]{15,16}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), ~n.between(14, 16)),
        "phone": _vote(n.between(10, 13), n > 14),
    }[kind]
    return [_vote(base, ~base), gazetteer, _vote(x["l"].rlike(CUES[kind]), x["l"].rlike(DENIALS)), shape]


def traits(x: Column) -> list[Column]:
    """What the classifier sees of a span besides the votes: its length, its separators and its left neighbour, each in four kinds."""
    v, before = x["v"], F.right(x["l"], F.lit(1))
    length = F.least(F.lit(3), F.floor(F.length(v) / 7)).cast("int")
    separators = F.when(v.rlike("[@(]"), 3).when(v.contains("-"), 2).when(v.rlike("[ .]"), 1).otherwise(0)
    left = F.when(before.rlike("[A-Za-z0-9]"), 3).when(before.rlike("[\\x20\\t]"), 1).when(before.rlike("[^\\s]"), 2).otherwise(0)
    return [length, separators, left]


BALLOTS, TRAITS = 4, 3


def _judged(kind: str, strict: bool):
    """Of a match: where it is, whether it is a base span, the votes and the traits. A loose match has no vote by its pattern."""

    def struct(x: Column) -> Column:
        base = valid(kind, x["v"]) if strict else F.lit(False)
        x = {"s": x["s"], "e": x["e"], "v": x["v"], "l": F.lower(x["l"])}
        ballots = votes(kind, x, base)
        if not strict:
            ballots[0] = F.lit(0)
        return F.struct(
            x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), base.alias("base"),
            *[b.alias(f"v{i}") for i, b in enumerate(ballots)], *[t.alias(f"t{i}") for i, t in enumerate(traits(x))],
        )

    return struct


def _of_kind(i: int):
    return lambda x: x["k"] == i


def candidates(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all of docs) with `_found`: every candidate's start, kind (its place in KINDS), end, base, votes and traits, in order."""
    t = F.coalesce(F.col(text), F.lit(""))
    sources = {f"_base_{k}": (k, BASE[k], GATE[k], True) for k in KINDS} | {f"_loose_{k}": (k, LOOSE[k], GATE[f"loose_{k}"], False) for k in LOOSE}
    worth = lambda pattern, gate: F.contains(t, F.lit(gate)) if gate else t.rlike(pattern)
    scanned = matches(docs, t, {name: (p, worth(p, g)) for name, (_, p, g, _) in sources.items()}, LEFT, 0)
    arrays = [F.transform(F.col(name), _judged(k, base)) for name, (k, _, _, base) in sources.items()]
    return scanned.select(*(docs.columns if keep is None else keep), F.array_sort(F.concat(*arrays)).alias("_found"))


def expectation_maximisation(table: list[tuple[int, tuple[int, ...], int]], rounds: int = 40) -> dict[tuple[int, tuple[int, ...]], float]:
    """Chance that a candidate of a kind with these votes is personal data, from counts of (kind, votes)."""
    out = {}
    for kind in {k for k, _, _ in table}:
        rows = [(v, n) for k, v, n in table if k == kind]
        n = np.array([x[1] for x in rows], float)
        cast = np.array([x[0] for x in rows])
        p = 1 / (1 + np.exp(-1.5 * cast.sum(axis=1)))  # majority vote to begin with
        for _ in range(rounds):
            prior = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
            log = np.full(len(rows), math.log(prior / (1 - prior)))
            for j in range(BALLOTS):
                for vote in (-1, 0, 1):
                    on = cast[:, j] == vote
                    # counts with a prior belief that labelers are right more often than not
                    hit = (n * p)[on].sum() + {1: 3.0, 0: 2.0, -1: 1.0}[vote]
                    miss = (n * (1 - p))[on].sum() + {1: 1.0, 0: 2.0, -1: 3.0}[vote]
                    log[on] += math.log(hit / ((n * p).sum() + 6)) - math.log(miss / ((n * (1 - p)).sum() + 6))
            p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        out |= {(kind, v): float(x) for (v, _), x in zip(rows, p, strict=True)}
    return out


def _inputs(votes: tuple[int, ...], kinds: tuple[int, ...]) -> list[float]:
    return [*votes, *[float(t == i) for t in kinds for i in (1, 2, 3)], 1.0]


def span_classifier(table: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], soft: dict[tuple[int, tuple[int, ...]], float]) -> dict[int, list[float]]:
    """Weights by kind of a logistic classifier of votes and traits, with its bias last, fitted to the soft labels (Newton). table: kind, votes, traits and count."""
    out = {}
    for kind in {x[0] for x in table}:
        rows = [(v, t, n) for k, v, t, n in table if k == kind]
        x = np.array([_inputs(v, t) for v, t, _ in rows], float)
        n = np.array([c for *_, c in rows], float)
        y = np.array([soft[kind, v] for v, _, _ in rows])
        w = np.zeros(x.shape[1])
        n = n / n.max()
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
            w = w + np.clip(np.linalg.solve(h, x.T @ (n * (y - p)) - 0.01 * w), -2, 2)
        out[kind] = w.tolist()
    return out


def find_pii(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all of docs) with `pii`: array of start, kind, end, base, in order of start and kind.

    The candidates are written to the shared folder once, and read for the votes and for the result. Null and empty
    texts have no spans, very long ones are scanned whole; repeated rows and rows without an id are found one by one. Of
    spans that overlap, base ones stay and others give way to them. Columns of docs named `pii` or `_found` are replaced.
    An empty table trains nothing.
    """
    own = [c for c in docs.columns if c.lower() not in ("_found", "pii")]
    kept = own if keep is None else keep
    found = Table(candidates(docs.select(*own), text, kept), "pii-candidates").df
    ballots, kinds = [f"v{i}" for i in range(BALLOTS)], [f"t{i}" for i in range(TRAITS)]
    counted = found.select(F.explode("_found").alias("x")).select("x.k", *[f"x.{b}" for b in ballots + kinds]).groupBy("k", *ballots, *kinds).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.collect()  # at most 4 kinds * 3 ** 4 votes * 4 ** 3 traits
    table = [(r["k"], tuple(r[b] for b in ballots), tuple(r[t] for t in kinds), r["n"]) for r in rows]
    by_votes: dict[tuple[int, tuple[int, ...]], int] = {}
    for k, v, _, n in table:
        by_votes[k, v] = by_votes.get((k, v), 0) + n
    soft = expectation_maximisation([(k, v, n) for (k, v), n in sorted(by_votes.items())])
    weights = span_classifier(sorted(table), soft)

    def accepted(x: Column) -> Column:
        score = F.lit(-1.0)
        for kind, w in weights.items():
            own = F.lit(w[-1])
            for b, c in zip(ballots, w, strict=False):
                own = own + x[b] * c
            for j, t in enumerate(kinds):
                for i in (1, 2, 3):
                    own = own + F.when(x[t] == i, w[BALLOTS + 3 * j + i - 1]).otherwise(0.0)
            score = F.when(x["k"] == kind, own).otherwise(score)
        return x["base"] | (score > 0)

    # an added span gives way to base spans that it overlaps: those before it that end, and those after it that begin, too late or soon
    far = 2**31 - 1
    ends = earlier(F.transform("_found", lambda x: F.when(x["base"], x["e"]).otherwise(0)), F.greatest)
    backward = earlier(F.reverse(F.transform("_found", lambda x: F.when(x["base"], x["s"]).otherwise(far))), F.least, far)
    told = F.transform(F.arrays_zip(F.col("_found").alias("x"), ends.alias("e"), F.reverse(backward).alias("s")), lambda z: F.struct(z["x"].alias("x"), (z["x"]["base"] | ((z["e"] <= z["x"]["s"]) & (z["s"] >= z["x"]["e"]))).alias("apart")))
    chosen = F.filter(told, lambda z: z["apart"] & accepted(z["x"]))
    return found.select(*kept, F.transform(chosen, lambda z: F.struct(z["x"]["s"].alias("s"), z["x"]["k"].alias("k"), z["x"]["e"].alias("e"), z["x"]["base"].alias("base"))).alias("pii"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans, for every row of docs(doc_id, text)."""
    found = find_pii(docs.select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("pii", lambda x: x["base"])
    counts = [F.size(F.filter(base, _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))


#: Spans of a text that are replaced in one go.
REPLACED = 64


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets, and n_chars (where there) counted anew. Spans that overlap become one, named by the first.

    All columns keep their names and values, whatever their names.
    """
    own, back = aside(docs, ("_found", "pii", "_kept", *[f"_base_{k}" for k in KINDS], *[f"_loose_{k}" for k in LOOSE]))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ends = earlier(F.transform("pii", lambda x: x["e"]), F.greatest)
    zipped = F.arrays_zip(F.col("pii").alias("x"), ends.alias("at"))
    # a span that begins inside an earlier one goes with it
    kept = F.transform(F.filter(zipped, lambda z: z["x"]["s"] >= z["at"]), lambda z: F.struct(z["at"].alias("at"), z["x"]["s"].alias("s"), F.get(names, z["x"]["k"]).alias("name")))
    found = find_pii(own).withColumn("_kept", kept)
    text, last = F.col("text"), F.floor((F.size("_kept") - 1) / REPLACED).cast("int")

    def block(b: Column) -> Column:  # the text up to the block's last span is cut out once
        spans = F.slice("_kept", b * REPLACED + 1, F.lit(REPLACED))
        first, end = F.get(spans, F.lit(0))["at"], F.element_at(spans, -1)["s"]
        cut = F.struct(F.substring(text, first + 1, end - first).alias("t"), first.alias("at"))
        part = lambda c: F.array_join(F.transform(spans, lambda x: F.concat(F.substring(c["t"], x["at"] - c["at"] + 1, x["s"] - x["at"]), x["name"])), "")
        return F.get(F.transform(F.array(cut), part), F.lit(0))

    rest = F.substring(text, F.array_max(F.transform("pii", lambda x: x["e"])) + 1, F.length(text))
    folded = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), last), block), ""), rest)
    out = found.withColumn("text", F.when(F.size("pii") > 0, folded).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*back)
