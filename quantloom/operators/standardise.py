"""Jobs that bring columns of item lists and price pools into one form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.text import first_true, number, scaled_number, squeezed


def standardise_units(df: DataFrame, col: str, aliases: DataFrame) -> DataFrame:
    """Adds unit_std: the canonical unit that aliases (alias, canonical) has for the squeezed text, else the text."""
    known = aliases.select(squeezed(F.col("alias")).alias("alias_key"), "canonical").groupBy("alias_key").agg(F.min("canonical").alias("canonical"))
    key = squeezed(F.col(col))
    return df.join(F.broadcast(known), key == F.col("alias_key"), "left").withColumn("unit_std", F.coalesce("canonical", key)).drop("alias_key", "canonical")


def split_unit_factor(df: DataFrame, col: str) -> DataFrame:
    """Adds factor and bare_unit: "100m3" is 100 and m3; without a leading number the factor is 1."""
    head = F.regexp_extract(col, r"^\s*(\d+(?:\.\d+)?)\s*(\D.*)$", 1)
    rest = F.regexp_extract(col, r"^\s*(\d+(?:\.\d+)?)\s*(\D.*)$", 2)
    return df.withColumns({"factor": F.coalesce(head.try_cast("double"), F.lit(1.0)), "bare_unit": F.when(head != "", F.trim(rest)).otherwise(F.trim(F.col(col)))})


def repair_units(df: DataFrame, col: str, rules: list[tuple[str, str]], known: list[str]) -> DataFrame:
    """Adds unit_fixed: ordered regex repairs, then the Latin head of the text, then a known unit within it."""
    fixed = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, F.trim(F.col(col)))
    latin = F.regexp_extract(fixed, r"^([A-Za-z]+[0-9²³]?)", 1)
    inside = reduce(lambda acc, u: acc.when(fixed.contains(u), F.lit(u)), known, F.when(F.lit(False), F.lit("")))
    return df.withColumn("unit_fixed", F.when(latin != "", latin).otherwise(F.coalesce(inside, fixed)))


def parse_quantities(df: DataFrame, col: str, mode: str = "null") -> DataFrame:
    """Adds qty_num, and qty_text in mode "keep" (what is no number stays as text); mode "scale" knows 亿, 万, %."""
    value = scaled_number(F.col(col)) if mode == "scale" else number(F.col(col))
    out = df.withColumn("qty_num", value)
    return out.withColumn("qty_text", F.when(F.col("qty_num").isNull(), F.nullif(F.trim(F.col(col)), F.lit("")))) if mode == "keep" else out


def leaf_filter(df: DataFrame, unit: str = "unit", qty: str = "qty") -> DataFrame:
    """Rows with a unit and a numeric quantity; zero is a quantity."""
    return df.where((F.length(F.trim(F.coalesce(F.col(unit), F.lit("")))) > 0) & F.col(qty).try_cast("double").isNotNull())


def deep_leaves(df: DataFrame, code: str, qty: str, other_qty: str, depth: int) -> DataFrame:
    """Rows whose code is deep enough or an addition, with a positive quantity; the second column stands in."""
    amount = F.when(F.col(qty) > 0, F.col(qty)).otherwise(F.col(other_qty))
    deep = (F.size(F.split(code, r"\.")) >= depth) | F.upper(code).contains("ADD")
    return df.withColumn("use_qty", amount).where(deep & (F.col("use_qty") > 0))


def exclude_rows(df: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    """Without rows whose text matches one of the patterns; nulls stay."""
    return df.where(~F.coalesce(F.col(col).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)))


def where_presets(df: DataFrame, presets: dict[str, Column], names: list[str], extra: str | None = None) -> DataFrame:
    """Rows that any of the named predicates holds for, and the SQL expression as well; a null is false."""
    kept = df.where(reduce(lambda a, b: a | b, (F.coalesce(presets[n], F.lit(False)) for n in names))) if names else df
    return kept.where(F.coalesce(F.expr(extra), F.lit(False))) if extra else kept


def derive_code_fields(df: DataFrame, code: str = "code") -> DataFrame:
    """Adds clean_code, is_add, group_id (head of the last token), depth and region (the first two parts if the
    first is alphabetic)."""
    clean = F.trim(F.regexp_replace(F.col(code), r"(?i)[\s_-]*\bADD\b[\s_-]*", ""))
    parts = F.split(clean, r"\.")
    return df.withColumns({
        "clean_code": clean,
        "is_add": F.upper(code).contains("ADD"),
        "group_id": F.element_at(F.split(F.element_at(F.split(clean, r"\s+"), -1), r"\."), 1),
        "depth": F.size(parts).cast("bigint"),
        "region": F.when(F.element_at(parts, 1).rlike("^[A-Za-z]+$"), F.array_join(F.slice(parts, 1, 2), ".")),
    })


def rounded_purchase_qty(df: DataFrame, qty: str, factor: float = 1.05) -> DataFrame:
    """Adds buy_qty: qty times factor, rounded half-even to hundreds, fifties, tens, ones or tenths by size."""
    raw = F.col(qty) * factor
    step = F.when(raw >= 10000, F.bround(raw / 100) * 100).when(raw >= 1000, F.bround(raw / 50) * 50).when(raw >= 100, F.bround(raw / 10) * 10).when(raw >= 10, F.bround(raw))
    return df.withColumn("buy_qty", step.otherwise(F.bround(raw, 1)))


def landed_cost(quotes: DataFrame, price: str, basis: str, place: str, origins: list[tuple[str, list[str]]], rates: dict[str, float], local: str) -> DataFrame:
    """Adds origin and the ladder exw, fob, cif, ddp and vat.

    origin is the first whose keyword the place contains, else the last. Each step up adds its share; a price
    given at a later step is taken back down. rates: exw_to_fob, freight, duty, clearing, inland, vat. For the
    local origin, a delivered price is taken back without the inland part.
    """
    origin = first_true([(F.lower(place).rlike("|".join(words)), name) for name, words in origins[:-1]], origins[-1][0])
    p, b = F.col(price), F.col(basis)
    up, freight, duty = 1 + rates["exw_to_fob"], 1 + rates["freight"], 1 + rates["duty"] + rates["clearing"]
    inland = F.when(F.col("origin") == local, 0.0).otherwise(rates["inland"])
    cif = F.when(b == "EXW", p * up * freight).when(b == "FOB", p * freight).when(b == "CIF", p).otherwise((p - inland) / duty)
    out = df_with = quotes.withColumn("origin", origin).withColumn("cif", cif)
    out = df_with.withColumns({"fob": F.col("cif") / freight, "exw": F.col("cif") / freight / up, "ddp": F.when(b == "DDP", p).otherwise(F.col("cif") * duty + rates["inland"])})
    return out.withColumn("vat", F.col("cif") * (1 + rates["duty"]) * rates["vat"])


def convert_unit_price(df: DataFrame, price: str, have: str, want: str, text: str) -> DataFrame:
    """Adds price_conv and rule: a price per one unit as a price per another, with sizes from the text.

    thickness comes as "<n> mm thick" or "t=<n>", height as "h=<n>" in mm; what has no rule is flagged.
    """
    size = lambda rx: F.coalesce(F.nullif(F.regexp_extract(F.lower(text), rx, 1), F.lit("")), F.lit(None)).try_cast("double") / 1000
    thick, high = size(r"(?:t=|thk\s*)(\d+)"), size(r"h=(\d+)")
    p, a, b = F.col(price), F.col(have), F.col(want)
    pair = lambda x, y: (a == x) & (b == y)
    rules = [
        (a == b, p, "same"), (pair("t", "kg"), p / 1000, "t_kg"), (pair("kg", "t"), p * 1000, "kg_t"),
        (pair("m3", "m2") & thick.isNotNull(), p * thick, "m3_m2"), (pair("m2", "m3") & (thick > 0), p / thick, "m2_m3"),
        (pair("m3", "t"), p / 2.4, "m3_t"), (pair("t", "m3"), p * 2.4, "t_m3"),
        (pair("m2", "m") & high.isNotNull(), p * high, "m2_m"), (pair("m", "m2") & (high > 0), p / high, "m_m2"),
    ]
    value, rule = F.when(F.lit(False), p), F.when(F.lit(False), F.lit(""))
    for when, amount, name in rules:
        value, rule = value.when(when, amount), rule.when(when, F.lit(name))
    return df.withColumns({"price_conv": value, "rule": rule.otherwise("unresolved")})


def explain_ratio(df: DataFrame, original: str, converted: str) -> DataFrame:
    """Adds ratio and ratio_rule, for prices of equal units: converted over original as a multiple (layers), a
    divisor, a currency (about 5, or 32 to 35), large (over 20) or factor. Both are null where the prices agree
    within 0.01 or one is missing or zero."""
    a, b = F.col(original), F.col(converted)
    ratio = F.when((a != 0) & (b != 0) & (F.abs(b - a) > 0.01), b / a)
    part = F.rint(1 / ratio)
    rule = (
        F.when(ratio.isNull(), F.lit(None)).when((F.abs(ratio - F.rint(ratio)) < 0.02) & (ratio > 1.01), "multiple")
        .when((ratio < 0.99) & (part != 0) & (F.abs(ratio - 1 / F.nullif(part, F.lit(0.0))) < 0.02), "divisor")
        .when((ratio > 4.5) & (ratio < 5.5), "cny").when((ratio > 32) & (ratio < 35), "usd").when(ratio > 20, "large").otherwise("factor")
    )
    return df.withColumns({"ratio": ratio, "ratio_rule": rule})


def post_edit(df: DataFrame, source: str, target: str, fixes: list[tuple[str, str, str]], glossary: dict[str, str]) -> DataFrame:
    """Adds edited: where the source has a word, its wrong translations are replaced; then glossary words,
    the longest first; then blanks and doubled stops are cleaned, and repeated word pairs are written once."""
    out = F.col(target)
    for word, wrong, right in fixes:
        out = F.when(F.col(source).contains(word), F.regexp_replace(out, wrong, right)).otherwise(out)
    for word in sorted(glossary, key=lambda w: (-len(w), w)):
        out = F.replace(out, F.lit(word), F.lit(glossary[word]))
    out = F.regexp_replace(F.regexp_replace(out, r"\.{2,}", "."), r"\s+", " ")
    return df.withColumn("edited", F.trim(F.regexp_replace(out, r"\b(\w+ \w+)(?: \1)+\b", "$1")))


def patch_by_rule(df: DataFrame, text: str, fields: list[str], rules: list[tuple[str, tuple, tuple]]) -> DataFrame:
    """Sets the fields where the text matches a rule's regex and the fields have the expected values, rule by
    rule, each on what earlier ones left. Adds hits: the numbers of the rules that took effect."""
    out = df.withColumn("hits", F.array().cast("array<int>"))
    for number_, (rx, expected, new) in enumerate(rules):
        same = reduce(lambda a, b: a & b, (F.col(f).eqNullSafe(F.lit(v)) for f, v in zip(fields, expected, strict=True)))
        hit = F.col(text).rlike(rx) & same
        out = out.withColumn("_hit", hit).withColumns({f: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(f)) for f, v in zip(fields, new, strict=True)} | {"hits": F.when(F.col("_hit"), F.concat("hits", F.array(F.lit(number_)))).otherwise(F.col("hits"))}).drop("_hit")
    return out


def priced_amounts(items: DataFrame, norm_rates: DataFrame, ref_rates: DataFrame, labour_share: float = 0.75) -> DataFrame:
    """Adds norm_amount, ref_amount (quantity times the rate found by key; null without one) and the labour
    part of the cost rate. Rates with a repeated key count by their smallest row."""
    norm = norm_rates.groupBy("key").agg(F.min_by("rate", "row").alias("norm_rate"))
    ref = ref_rates.groupBy("key").agg(F.min_by("rate", "row").alias("ref_rate"))
    out = items.join(norm, "key", "left").join(ref, "key", "left")
    return out.withColumns({"norm_amount": F.col("qty") * F.col("norm_rate"), "ref_amount": F.col("qty") * F.col("ref_rate"), "labour": F.col("norm_rate") * labour_share})


def normalise_timestamps(df: DataFrame, col: str, fallback: str) -> DataFrame:
    """Adds at: dates as midnight UTC, times without zone as UTC, what cannot be read as the fallback."""
    read = F.coalesce(F.try_to_timestamp(F.col(col)), F.try_to_timestamp(F.col(col), F.lit("yyyy/MM/dd")))
    return df.withColumn("at", F.coalesce(read, F.col(fallback)))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row for each key: the first in the given order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")
