"""Masking, tokenizing and comparing lines."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"
#: A time stamp within a line, and one with the space behind it.
TIMESTAMP = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
LEADING_TIME = r"[0-9]+-[0-9]+-[0-9]+ [0-9]+:[0-9]+:[0-9]+ "
WORD = r"[\p{L}\p{N}_]{2,}"


def mask(text: Column, patterns: Sequence[str], by: str = WILDCARD) -> Column:
    """Each pattern in turn replaced, so that later ones see what earlier ones left."""
    for p in patterns:
        text = F.regexp_replace(text, p, by)
    return text


def mask_last(text: Column, patterns: Sequence[str], by: str = WILDCARD) -> Column:
    """Each pattern replaced in the text as it was, the last one's result kept: what a loop that forgets its result gives."""
    return mask(text, patterns[-1:], by)


def strip_time(text: Column) -> Column:
    return F.regexp_replace(text, LEADING_TIME, "")


def fold_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]+", "<NASCII>")


def _full(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def tokens(text: Column) -> Column:
    """Runs without white space."""
    return _full(F.split(text, r"\s+"))


def spell_tokens(text: Column) -> Column:
    return _full(F.split(text, r"[\s=:,]"))


def constant_tokens(tokens_: Column) -> Column:
    return F.filter(tokens_, lambda t: t != WILDCARD)


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def word_tokens(text: Column) -> Column:
    """Lower-cased words of two or more letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def all_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def without_punctuation(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\p{Punct}", ""))


def _unmarked(text: pd.Series) -> pd.Series:
    marked = text.str.normalize("NFKD")
    return marked.map(lambda t: t if t is None or t.isascii() else "".join(c for c in t if not unicodedata.combining(c)), na_action="ignore")


def without_accents(text: Column) -> Column:
    """Every letter without its marks (compatibility decomposition), in Arrow batches: no native expression decomposes letters."""
    return F.pandas_udf(_unmarked, "string")(text)


def simple_words(text: Column, least: int = 2, most: int = 15, accents: bool = True) -> Column:
    """Lower-cased alphabetic tokens of a length between least and most; accents: folded to their letters."""
    plain = without_accents(F.lower(text)) if accents else F.lower(text)
    return F.filter(F.regexp_extract_all(plain, F.lit(r"\p{L}+"), F.lit(0)), lambda t: F.length(t).between(least, most))


def remove_words(tokens_: Column, stop: Sequence[str]) -> Column:
    """Tokens that aren't stop words in any case; repeats stay."""
    return F.filter(tokens_, lambda t: ~F.lower(t).isin(*stop)) if stop else tokens_


def similarity(template: Column, line: Column) -> Column:
    """Share of places with the same token; a wildcard in the template never counts. Lists of equal length."""
    same = F.zip_with(template, line, lambda a, b: F.when((a == b) & (a != WILDCARD), 1).otherwise(0))
    n = F.size(template)
    return F.when(n == 0, 1.0).otherwise(F.aggregate(same, F.lit(0), lambda s, x: s + x) / n)


def wildcards(template: Column) -> Column:
    return F.size(F.filter(template, lambda t: t == WILDCARD))


def merge_template(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.when(x == y, x).otherwise(WILDCARD))


def template_id(template: Column) -> Column:
    return F.substring(F.md5(template), 1, 8)


def variable_pattern(template: Column) -> Column:
    """An anchored pattern with a lazy group for each wildcard of the template; close wildcards fall together."""
    collapsed = F.regexp_replace(template, "<.{1,5}>", WILDCARD)
    escaped = F.regexp_replace(collapsed, r"([^A-Za-z0-9])", r"\\$1")
    spaced = F.regexp_replace(escaped, r"(\\\s)+", r"\\s+")
    return F.concat(F.lit("(?dU)^"), F.replace(spaced, F.lit(r"\<\*\>"), F.lit("(.*?)")), F.lit("$"))


def variables(template: Column, text: Column) -> Column:
    """What the line has in place of each wildcard; none without wildcards or where the line doesn't match."""
    collapsed = F.regexp_replace(template, "<.{1,5}>", WILDCARD)
    n = F.size(F.split(collapsed, r"<\*>", -1)) - 1
    pattern = variable_pattern(template)
    groups = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.call_function("regexp_extract", text, pattern, i))
    return F.when((n > 0) & F.call_function("rlike", text, pattern), groups).otherwise(F.array().cast("array<string>"))


def spell_variables(template: Column, text: Column) -> Column:
    """As variables, with separators between words loosely matched and punctuation stripped from the values."""
    parts = F.split(template, r"<\*>", -1)
    quoted = F.transform(parts, lambda p: F.regexp_replace(F.trim(p), "[^A-Za-z0-9]+", "[^A-Za-z0-9]+"))
    pattern = F.concat(F.lit("(?dU)^"), F.array_join(quoted, "(.*?)"), F.lit("$"))
    n = F.size(parts) - 1
    raw = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.call_function("regexp_extract", text, pattern, i))
    punctuation = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ "
    return F.when((n > 0) & F.call_function("rlike", text, pattern), F.transform(raw, lambda x: F.btrim(x, F.lit(punctuation)))).otherwise(F.array().cast("array<string>"))


def is_subset(template: Column, line: Column) -> Column:
    """Every token of the template is a wildcard or in the line, in any order."""
    return F.forall(template, lambda t: (t == WILDCARD) | F.array_contains(line, t))


def first_words(text: Column, most: int) -> Column:
    return F.array_join(F.slice(F.split(text, r"\s+"), 1, most), " ")


def quoted_values(text: Column, name: str) -> Column:
    """Values of "name": "…" in JSON-like text."""
    return F.regexp_extract_all(text, F.lit(rf'"{name}":\s*"([^"]*)"'), F.lit(1))
