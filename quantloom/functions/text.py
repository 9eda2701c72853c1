"""Column expressions for text keys, numbers and codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def price_key(text: Column) -> Column:
    """Letters and digits of any script in lower case, all else gone."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def description_key(text: Column) -> Column:
    """Without bracketed parts and punctuation, for comparing descriptions."""
    bare = F.regexp_replace(F.lower(text), r"\([^()]*\)|\[[^\]]*\]|（[^（）]*）", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))


def rate_key(text: Column, length: int = 120) -> Column:
    return F.substring(description_key(text), 1, length)


def number(text: Column) -> Column:
    """A number with thousands commas, blanks or a currency tail; null if it is none."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"[,\s]|(usd|cny|rmb|bdt|eur)$", "")
    return bare.try_cast("double")


def scaled_number(text: Column) -> Column:
    """As number, with a factor for 亿, 万 and % at the end."""
    factor = F.when(text.endswith("亿"), 1e8).when(text.endswith("万"), 1e4).when(text.endswith("%"), 0.01).otherwise(1.0)
    return number(F.regexp_replace(text, "[亿万%]$", "")) * factor


def code_depth(code: Column) -> Column:
    return F.when(F.length(code) > 0, F.size(F.split(code, r"\."))).otherwise(0)


def code_prefixes(code: Column) -> Column:
    """All ancestors of a dotted code, from the top, without itself."""
    parts = F.split(code, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).otherwise(F.array().cast("array<string>"))


def natural_key(code: Column, width: int = 12) -> Column:
    """A text that sorts as the code does when runs of digits compare as numbers."""
    parts = F.regexp_extract_all(code, F.lit(r"\d+|\D+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def first_true(rules: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule whose predicate holds."""
    if not rules:
        return F.lit(default)
    (first, value), *rest = rules
    return reduce(lambda acc, r: acc.when(r[0], F.lit(r[1])), rest, F.when(first, F.lit(value))).otherwise(F.lit(default))
