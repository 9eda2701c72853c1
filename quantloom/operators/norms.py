"""Matching of items with norms inside the category that an item's name names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Category:
    """A kind of item: the keys that name it, words that its norms have and must not have, and their chapters."""

    keys: Sequence[str]
    keywords: Sequence[str] = ()
    excluded: Sequence[str] = ()
    chapters: Sequence[str] = ()


@dataclass(frozen=True)
class Material:
    """Words of an item that imply a material, and resources of a norm one of which it then needs."""

    signs: Sequence[str]
    needs: Sequence[str]
    hit: int
    miss: int


@dataclass(frozen=True)
class Scores:
    """Points of the seven dimensions, and the lists that they rest on."""

    keyword: int = 30
    no_keyword: int = -15
    excluded: int = -50
    chapter: int = 15
    same_unit: int = 30
    compatible_unit: int = 20
    other_kind_of_unit: int = -30
    other_unit: int = -100
    no_unit: int = -20
    verbs: int = 20
    attributes: int = 10
    manual: int = -30
    least: int = 30
    compatible: Sequence[tuple[str, str]] = (("kg", "t"), ("mm", "cm"), ("m", "cm"))
    conceptual: Sequence[str] = ("项", "ls", "lump sum", "item", "lot")
    materials: Sequence[Material] = ()
    process: Sequence[str] = ()
    machine_work: Sequence[str] = ()  # a category with one of these keywords rates manual norms lower
    titles: str = r"[【《]"
    specs: str = r"[CM]\d{2,3}|\d{2,4}\s*(?:mm|cm|m|直径|厚|宽|高|深)"
    tokens: str = r"[一-鿿]{2,}"


def _plain(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def _has_any(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(map(_plain, words))) if words else F.lit(False)


def named_category(name: Column, categories: Sequence[Category]) -> Column:
    """The number of the category whose key is the longest in the name, of equally long ones the leftmost; null
    without one. One pattern finds, at each place, the longest key that begins there."""
    of = {key.lower(): n for n, c in enumerate(categories) for key in c.keys}
    pattern = "(?=(" + "|".join(_plain(k) for k in sorted(of, key=len, reverse=True)) + "))"
    found = F.regexp_extract_all(F.lower(F.trim(name)), F.lit(pattern), 1)
    best = F.array_max(F.transform(found, lambda k, i: F.struct(F.length(k).alias("size"), (-i).alias("at"), k.alias("key"))))
    numbers = F.create_map(*(F.lit(x) for pair in of.items() for x in pair))
    return numbers[best["key"]]


def no_norm_reason(name: Column, unit: Column, category: Column, categories: Sequence[Category], scores: Scores) -> Column:
    """Why an item gets no norm, whatever the norms are: title, conceptual unit, no category or empty category (one
    without chapters and keywords); null for an item that may get one."""
    empty = [n for n, c in enumerate(categories) if not c.chapters and not c.keywords]
    return F.when(name.rlike(scores.titles), "title").when(F.lower(unit).isin(*scores.conceptual), "conceptual unit").when(category.isNull(), "no category").when(category.isin(*empty), "empty category")


def unit_fit(unit: Column, norm_unit: Column, scores: Scores) -> Column:
    """How an item's unit and a norm's go together: none (the norm has none), unknown (the item has none), same,
    compatible, other kind (a conceptual unit and another) or other."""
    pair = F.lit(False)
    for a, b in scores.compatible:
        pair |= ((unit == a) & (norm_unit == b)) | ((unit == b) & (norm_unit == a))
    kind = F.lower(unit).isin(*scores.conceptual) != F.lower(norm_unit).isin(*scores.conceptual)
    return F.when(norm_unit == "", "none").when(unit == "", "unknown").when(unit == norm_unit, "same").when(pair, "compatible").when(kind, "other kind").otherwise("other")


def _candidates(norms: DataFrame, categories: Sequence[Category], scores: Scores) -> DataFrame:
    """Norms of each category with what they score whatever the item is."""
    spark = norms.sparkSession
    asked = sorted({chapter for c in categories for chapter in c.chapters})
    there = {r.chapter for r in norms.where(F.col("chapter").isin(asked)).select("chapter").distinct().collect()} if asked else set()
    scoped = {n: [x for x in c.chapters if x in there] for n, c in enumerate(categories)}
    of_chapter = spark.createDataFrame([(n, x, at) for n, found in scoped.items() for at, x in enumerate(found)], "cat int, chapter string, place int")
    whole = [n for n, c in enumerate(categories) if not scoped[n] and (c.chapters or c.keywords)]
    config = spark.createDataFrame([(n, list(c.keywords), list(c.excluded), list(c.chapters), any(k in scores.machine_work for k in c.keywords)) for n, c in enumerate(categories)], "cat int, keywords array<string>, excluded array<string>, chapters array<string>, machine boolean")

    inside = norms.join(F.broadcast(of_chapter), "chapter")  # as large as the lists of chapters
    inside = inside.groupBy("cat", "code").agg(F.min_by(F.struct(*inside.columns), F.struct("place", "norm")).alias("r")).select("r.*")
    pairs = inside
    if whole:
        pairs = pairs.unionByName(norms.withColumns({"cat": F.explode(F.array(*map(F.lit, whole))), "place": F.lit(0)}))
    pairs = pairs.join(F.broadcast(config), "cat")
    count = lambda words: F.size(F.filter(words, lambda w: F.col("search").contains(w)))
    pairs = pairs.withColumn("hits", count("keywords")).withColumn("asked", F.size("keywords") > 0)
    reached = pairs.groupBy("cat").agg(F.max("hits").alias("most"))
    pairs = pairs.join(F.broadcast(reached), "cat").where("not asked or most = 0 or hits > 0")  # a row for each category
    base = F.col("hits") * scores.keyword + F.when(F.col("asked") & (F.col("hits") == 0), scores.no_keyword).otherwise(0) + count("excluded") * scores.excluded
    base += F.when(F.exists("chapters", lambda c: F.col("chapter").contains(c)), scores.chapter).otherwise(0)
    base += F.when(F.col("machine") & F.col("manual"), scores.manual).otherwise(0)
    return pairs.withColumn("base", base)


def scoped_match(items: DataFrame, norms: DataFrame, categories: Sequence[Category], scores: Scores, top: int = 5, most: int | None = 200) -> DataFrame:
    """(item, verdict, nth, norm, code, score): the `top` norms of each item's category by seven dimensions.

    Items are (item, name, descr, unit), norms (norm, code, search, chapter, unit, resources, work, attributes,
    manual); nulls count as empty (manual: false). The longest key in the name gives the category; its chapters,
    where there are such norms, give the candidates (else all norms do), one for each code, and its keywords
    leave those with one of them, if any has one. Without keywords the item's own tokens do so. Of these the
    first `most` in the order of chapters and norm ids count (null: all). Scores add up keywords, chapter and
    manual work, units, implied materials, process words and attributes; the best norm of each code stays,
    equal scores in the order of candidates.

    Verdicts: no norm (title, conceptual unit, no category or one without chapters and keywords), low score
    (below `least`, or no candidate), no unit (the best norm has none), matched. Items without norms have one
    row with a null nth; items that read alike are scored once.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    items = items.select("item", *(text(c).alias(c) for c in ("name", "descr", "unit")))
    norms = norms.select("norm", "code", *(text(c).alias(c) for c in ("search", "chapter", "unit", "resources", "work", "attributes")), F.coalesce("manual", F.lit(False)).alias("manual"))
    form = ["name", "descr", "unit"]
    forms = items.select(*form).distinct().withColumn("cat", named_category(F.col("name"), categories))
    reason = no_norm_reason(F.col("name"), F.col("unit"), F.col("cat"), categories, scores)
    forms = forms.where(reason.isNull())

    whole = F.concat_ws(" ", "name", "descr")
    own = {f"needs{i}": _has_any(F.lower(whole), m.signs) for i, m in enumerate(scores.materials)}
    own["verbs"] = F.filter(F.array(*map(F.lit, scores.process)).cast("array<string>"), lambda v: F.contains(whole, v))
    own["specs"] = F.array_distinct(F.transform(F.regexp_extract_all(whole, F.lit(scores.specs), 0), lambda s: F.replace(s, F.lit(" "), F.lit(""))))
    own["own_tokens"] = F.array_distinct(F.regexp_extract_all(F.lower(whole), F.lit(scores.tokens), 0))
    has = {f"has{i}": _has_any(F.lower("resources"), m.needs) for i, m in enumerate(scores.materials)}
    pool = _candidates(norms, categories, scores).withColumnRenamed("unit", "norm_unit").withColumns(has or {"has": F.lit(True)})
    named = pool.where("asked")
    if most:
        named = named.withColumn("_n", F.row_number().over(Window.partitionBy("cat").orderBy("place", "norm"))).where(F.col("_n") <= most).drop("_n")
    forms = forms.withColumns(own)
    met = forms.join(named, "cat")
    silent = [n for n, c in enumerate(categories) if c.chapters and not c.keywords]
    if silent:
        loose = forms.where(F.col("cat").isin(*silent)).join(pool.where("not asked"), "cat").withColumn("_hit", F.exists("own_tokens", lambda t: F.col("search").contains(t)))
        hit = loose.where("_hit").withColumn("_n", F.row_number().over(Window.partitionBy(*form).orderBy("place", "norm")))
        hit = hit.where(F.col("_n") <= most if most else F.lit(True)).drop("_n")
        met = met.unionByName(hit.drop("_hit")).unionByName(loose.join(hit.select(*form).distinct(), form, "left_anti").drop("_hit"))

    fit = unit_fit(F.col("unit"), F.col("norm_unit"), scores)
    points = {"none": scores.no_unit, "same": scores.same_unit, "compatible": scores.compatible_unit, "other kind": scores.other_kind_of_unit, "other": scores.other_unit, "unknown": 0}
    units = F.create_map(*(F.lit(x) for pair in points.items() for x in pair))[fit]
    score = F.col("base") + units
    for i, m in enumerate(scores.materials):
        score += F.when((F.col("resources") != "") & F.col(f"needs{i}"), F.when(F.col(f"has{i}"), m.hit).otherwise(m.miss)).otherwise(0)
    count = lambda words, where: F.size(F.filter(words, lambda w: F.col(where).contains(w)))
    for words, where, points in (("verbs", "work", scores.verbs), ("specs", "attributes", scores.attributes)):
        score += F.least(F.lit(points), count(words, where) * (points // 2))
    rank = F.struct((-F.col("score")).alias("minus"), "place", "norm")
    best = met.withColumn("score", score.cast("bigint")).groupBy(*form, "code").agg(F.min(F.struct(rank.alias("rank"), "norm_unit")).alias("b"))
    best = best.select(*form, "code", "b.rank", "b.norm_unit").withColumn("nth", F.row_number().over(Window.partitionBy(*form).orderBy("rank"))).where(F.col("nth") <= top)
    best = best.select(*form, "nth", "code", F.col("rank.norm").alias("norm"), (-F.col("rank.minus")).alias("score"), "norm_unit")
    first = best.where("nth = 1").select(*form, F.when(F.col("score") < scores.least, "low score").when(F.col("norm_unit") == "", "no unit").otherwise("matched").alias("first"))
    judged = forms.select(*form).join(first, form, "left").withColumn("first", F.coalesce("first", F.lit("low score")))
    found = items.join(judged, form, "left").join(best, form, "left")
    return found.select("item", F.coalesce("first", F.lit("no norm")).alias("verdict"), "nth", "norm", "code", "score")


def no_norm_reasons(items: DataFrame, categories: Sequence[Category], scores: Scores, n: int = 20) -> DataFrame:
    """(reason, items): the n commonest reasons for which items get no norm."""
    name, unit = (F.coalesce(F.col(c), F.lit("")) for c in ("name", "unit"))
    reason = no_norm_reason(name, unit, named_category(name, categories), categories, scores)
    return items.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("items")).orderBy(F.desc("items"), "reason").limit(n)


def unit_problems(matches: DataFrame, items: DataFrame, norms: DataFrame, scores: Scores) -> DataFrame:
    """(item, unit, norm, norm_unit, fit): items of low score whose best norm has another unit, or none."""
    best = matches.where("verdict = 'low score' and nth = 1").select("item", "norm")
    met = best.join(items.select("item", F.coalesce("unit", F.lit("")).alias("unit")), "item").join(norms.select("norm", F.coalesce("unit", F.lit("")).alias("norm_unit")), "norm")
    out = met.withColumn("fit", unit_fit(F.col("unit"), F.col("norm_unit"), scores))
    return out.where(F.col("fit").isin("none", "other kind", "other")).select("item", "unit", "norm", "norm_unit", "fit")
