"""Candidates for items by product family: terms in two languages, a pool for each family, scores for each item."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.udfs import token_set_ratio
from quantloom.sources.scratch import stored

# Aliases of units, units of one kind, what a discipline has to do with a specialty, materials that
# exclude each other and materials that are the same (pattern for the item, pattern for the rate, points).
UNIT_ALIASES = {"sqm": "m2", "cum": "m3", "cbm": "m3", "kgs": "kg", "tonne": "ton", "t": "ton", "ea": "no", "each": "no", "pcs": "no", "pc": "no", "nos": "no", "sets": "set"}
UNIT_KINDS = [["m", "mm", "cm", "米"], ["m2", "㎡"], ["m3", "立方"], ["kg", "ton", "吨"], ["no", "set", "个", "件", "项", "套", "块", "根", "樘"]]
AFFINITY = {
    "土建工程": {"土建": 1.0, "材料": 0.7, "数据中心": 0.6, "周转材料": 0.5, "专业分包": 0.5, "机械台班": 0.3},
    "装饰工程": {"外立面": 1.0, "数据中心": 0.9, "材料": 0.7, "专业分包": 0.6, "土建": 0.4},
    "室外工程": {"土建": 0.9, "数据中心": 0.7, "材料": 0.6, "绿化": 1.0, "标识标牌": 0.9, "专业分包": 0.7, "机电": 0.3},
    "钢结构工程": {"材料": 0.9, "数据中心": 0.7, "专业分包": 0.6, "土建": 0.5},
    "安装工程": {"机电": 1.0, "专业分包": 0.7, "数据中心": 0.6},
}
MATERIALS = [
    (r"crushed\s*rock|subbase|sub\s*base|aggregate|gravel|crushed\s*stone", r"concrete|asphalt|mortar|grout|plaster", -30.0),
    (r"sand\s+blind", r"concrete|asphalt|reinforced", -30.0),
    (r"formwork|shuttering", r"concrete|mortar|block|brick", -20.0),
    (r"excavation|earthwork|backfill", r"formwork|concrete\s+road|concrete\s+base|asphalt", -20.0),
    (r"fine\s+aggregate\s+concrete|concrete\s+screed", r"plaster|mortar|grout|waterproof|render", -25.0),
    (r"crushed\s*rock|subbase|aggregate|gravel|crushed\s*stone", r"crushed\s*rock|compacted|subbase|aggregate|gravel", 15.0),
    (r"formwork|shuttering", r"formwork|shuttering", 15.0),
    (r"lean\s*concrete|concrete\s*blind", r"lean\s*concrete|blind", 15.0),
]


@dataclass(frozen=True)
class Lexicon:
    """Configuration, read whole: glossary gives the local word of a phrase (lower case) found anywhere in a text,
    synonyms the phrases of a local word."""

    glossary: Mapping[str, str] = field(default_factory=dict)
    synonyms: Mapping[str, Sequence[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Factors:
    """What the scores are made of; the defaults are the usual ones."""

    fuzzy: float = 0.4
    word: float = 5.0
    local: float = 7.0
    unit: float = 20.0
    specialty: float = 10.0
    preferred: float = 4.0
    materials: Sequence[tuple[str, str, float]] = tuple(MATERIALS)
    affinity: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: AFFINITY)


def _listed(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def query_terms(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(text, word, local), each once, of the distinct texts of column text: words of three characters or more that
    are no number; local words by the glossary, concrete grades and thicknesses; local words one of whose phrases is
    or holds a word; and the phrases of each local word of the dictionary that equals one found or (two characters
    or more) holds it or is held. Null texts have none."""
    texts, spark = texts.select("text").where("text is not null").distinct(), texts.sparkSession
    low = F.lower("text")
    words = texts.select("text", F.explode(F.regexp_extract_all(low, F.lit(r"(?U)(\w{3,})"))).alias("word")).where(~F.col("word").rlike(r"(?U)^\d+$")).distinct()
    grades = F.concat(F.regexp_extract_all(low, F.lit(r"f'c\(mpa\)(\d+)")), F.regexp_extract_all(low, F.lit(r"c(\d+)\s*concrete")))
    sizes = F.regexp_extract_all(low, F.lit(r"(\d+)\s*mm"))
    phrases = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in lexicon.glossary.items())) if lexicon.glossary else F.array().cast("array<struct<k:string,v:string>>")
    named = F.transform(F.filter(phrases, lambda p: F.contains(low, p["k"])), lambda p: p["v"])
    found = F.concat(named, F.transform(grades, lambda g: F.concat(F.lit("C"), g)), F.transform(sizes, lambda s: F.concat(s, F.lit("mm"))))
    local = texts.select("text", F.explode(F.array_distinct(found)).alias("word"))
    if lexicon.synonyms:
        parts = [(w, key) for key, said in lexicon.synonyms.items() for s in said for w in {s.lower(), *s.lower().split()}]
        by_word = spark.createDataFrame(parts, "word string, key string").distinct()
        local = local.union(words.join(by_word, "word").select("text", "key"))
    local = local.distinct()
    if lexicon.synonyms:
        w = F.col("word")
        near = F.filter(_listed(list(lexicon.synonyms)), lambda k: (k == w) | ((F.length(w) >= 2) & (F.contains(k, w) | F.contains(w, k))))
        said = spark.createDataFrame([(k, s.lower()) for k, all_said in lexicon.synonyms.items() for s in all_said], "key string, said string").distinct()
        back = local.select("word").distinct().select("word", F.explode(near).alias("key")).join(said, "key").select("word", "said").distinct()
        words = words.union(local.join(back, "word").select("text", "said")).distinct()
    return words.withColumn("local", F.lit(False)).unionByName(local.withColumn("local", F.lit(True)))


def holders(words: DataFrame, texts: DataFrame, shown: Column) -> DataFrame:
    """(word, text) for each of the distinct words and each text whose `shown` form contains it.

    What has no blank in it stands within one blank-free token, so a word is looked for among the distinct tokens
    that have the first four characters of its longest piece, and the texts of those that hold it are verified.
    Words of blanks only are in no text.
    """
    pieces = F.filter(F.split("word", r"(?U)\s+"), lambda p: p != "")
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    wanted = words.select("word").distinct().withColumn("piece", longest).where("piece is not null").withColumn("gram", F.substring("piece", 1, 4))
    tokens = texts.select("text", shown.alias("shown")).distinct().select("text", "shown", F.explode(F.array_distinct(F.split("shown", r"(?U)\s+"))).alias("token")).where("token <> ''")
    grams = "array_distinct(flatten(transform(sequence(1, least(4, length(token))), n -> transform(sequence(1, length(token) - n + 1), i -> substring(token, i, n)))))"
    vocabulary = tokens.select("token").distinct().select("token", F.explode(F.expr(grams)).alias("gram"))
    met = vocabulary.join(wanted, "gram").where(F.contains("token", "piece")).select("word", "token")
    return tokens.join(met, "token").where(F.contains("shown", "word")).select("word", "text").distinct()


def family_pool(items: DataFrame, rates: DataFrame, lexicon: Lexicon, k: int = 40, word: float = 4, local: float = 6, preferred: float = 8) -> DataFrame:
    """The k best rates (rate_id, name, preferred) of each family of items (family, text): points for each term of
    any of its texts that the name holds, and for a preferred project; (family, nth, rate_id, score), ties by
    rate_id. Rates without a term, null families and null names are in no pool.

    Terms are met with distinct names; then each (name, preferred) is one class, and only the k best classes of a
    family, with their k smallest ids, are met with the rates: no other rate can be among its k.
    """
    rates = rates.select("rate_id", F.col("name").alias("text"), F.coalesce("preferred", F.lit(False)).alias("preferred")).where("text is not null and rate_id is not null")
    texts = items.select("family", "text").where("family is not null").distinct()
    terms = texts.join(query_terms(texts, lexicon), "text").select("family", "word", "local").distinct()
    names = rates.select("text").distinct()
    found = holders(terms.where("not local"), names, F.lower("text")).withColumn("local", F.lit(False))
    found = found.unionByName(holders(terms.where("local"), names, F.col("text")).withColumn("local", F.lit(True)))
    hits = terms.join(found, ["word", "local"]).groupBy("family", "text").agg(F.sum(F.when(F.col("local"), local).otherwise(word)).cast("double").alias("score"))
    classes = rates.groupBy("text", "preferred").agg(F.min("rate_id").alias("first"))
    ranked = hits.join(classes, "text").withColumn("score", F.col("score") + F.when(F.col("preferred"), float(preferred)).otherwise(0.0))
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("score"), "first"))).where(F.col("n") <= k)
    heads = rates.withColumn("n", F.row_number().over(Window.partitionBy("text", "preferred").orderBy("rate_id"))).where(F.col("n") <= k).drop("n")
    best = Window.partitionBy("family").orderBy(F.desc("score"), "rate_id")
    out = ranked.drop("n", "first").join(heads, ["text", "preferred"]).withColumn("nth", F.row_number().over(best))
    return out.where(F.col("nth") <= k).select("family", "nth", "rate_id", "score")


def plain_unit(unit: Column) -> Column:
    """A unit in lower case without blanks and points, by its usual name; null is empty."""
    bare = F.translate(F.regexp_replace(F.lower(F.trim(unit)), "[ .]", ""), "²³", "23")
    aliases = F.create_map(*(F.lit(v) for pair in UNIT_ALIASES.items() for v in pair))
    return F.coalesce(F.try_element_at(aliases, bare), bare, F.lit(""))


def unit_tier(a: Column, b: Column) -> Column:
    """For plain units: 1 for equal ones, 0.9 for two of one kind, 0.4 for others, 0.3 where one is missing."""
    kind = F.create_map(*(F.lit(v) for n, kind in enumerate(UNIT_KINDS) for u in kind for v in (u, n)))
    return F.when((a == "") | (b == ""), 0.3).when(a == b, 1.0).when(F.try_element_at(kind, a) == F.try_element_at(kind, b), 0.9).otherwise(0.4)


def _strength(text: Column, patterns: Sequence[tuple[str, int]]) -> Column:
    """The number after or before the first pattern that the lower-cased text has, over its divisor."""
    low = F.lower(text)
    return F.coalesce(*(F.nullif(F.regexp_extract(low, p, 1), F.lit("")).try_cast("double") / d for p, d in patterns))


def grade_points(text: Column, name: Column) -> Column:
    """15 for the concrete strength that the text asks for, 10, 3, -5 for up to 4, 8, 15 MPa off it and -15 beyond;
    -3 if the name gives none, 0 if the text asks for none."""
    given = [(r"(\d+)\s*mpa", 1), (r"(\d+)\s*ksc", 10), (r"(?U)\bc(\d{2})\b", 1)]
    asked, has = _strength(text, [(r"f'?c\s*\(\s*mpa\s*\)\s*(\d+)", 1), *given]), _strength(name, given)
    off = F.abs(asked - has)
    points = F.when(off == 0, 15.0).when(off <= 4, 10.0).when(off <= 8, 3.0).when(off <= 15, -5.0).otherwise(-15.0)
    return F.when(asked.isNull(), 0.0).when(has.isNull(), -3.0).otherwise(points)


def rerank_candidates(items: DataFrame, pool: DataFrame, rates: DataFrame, lexicon: Lexicon, factors: Factors | None = None, k: int = 8, least: float = 12) -> DataFrame:
    """The best k rates of at least `least` points for each item out of its family's pool; (item, nth, rate_id,
    score), ties by rate_id.

    items (item, family, text, unit, discipline), pool (family, rate_id), rates (rate_id, name, unit, specialty,
    preferred). What rests on texts is computed between distinct texts and names of a family; items of a family that
    read alike (text, unit, discipline) are ranked once. A null text or name counts as empty.
    """
    f = factors or Factors()
    items = items.select("item", "family", F.coalesce("text", F.lit("")).alias("text"), plain_unit(F.col("unit")).alias("_unit"), "discipline")
    offers = pool.select("family", "rate_id").join(rates.select("rate_id", F.coalesce("name", F.lit("")).alias("name"), plain_unit(F.col("unit")).alias("unit"), "specialty", "preferred"), "rate_id")
    offers = stored(offers)  # a pool for each family, of which two joins read: the rates are read once
    terms = query_terms(items, lexicon).groupBy("text").agg(*(F.collect_set(F.when(F.col("local") == flag, F.col("word"))).alias(c) for c, flag in (("en", False), ("cn", True))))
    pairs = items.select("family", "text").distinct().join(offers.select("family", "name").distinct(), "family").select("text", "name").distinct().join(terms, "text", "left")
    held = lambda words, name: F.coalesce(F.size(F.filter(words, lambda w: F.contains(name, w))), F.lit(0))
    points = f.word * held("en", F.lower("name")) + f.local * held("cn", F.col("name")) + grade_points(F.col("text"), F.col("name"))
    for item_rx, rate_rx, p in f.materials:
        points = points + F.when(F.lower("text").rlike(item_rx) & F.lower("name").rlike(rate_rx), float(p)).otherwise(0.0)
    if f.fuzzy:
        points = points + f.fuzzy * token_set_ratio("text", "name")
    pairs = pairs.select("text", "name", points.alias("points"))
    table = [F.lit(v) for d, to in f.affinity.items() for s, share in to.items() for v in (f"{d}\n{s}", float(share))]
    close = F.coalesce(F.try_element_at(F.create_map(*table), F.concat("discipline", F.lit("\n"), "specialty")), F.lit(0.2)) if table else F.lit(0.2)
    form = ["family", "text", "_unit", "discipline"]
    met = items.select(*form).distinct().join(offers, "family").join(pairs, ["text", "name"])
    score = F.col("points") + f.unit * unit_tier(F.col("_unit"), F.col("unit")) + f.specialty * close + F.when(F.col("preferred"), f.preferred).otherwise(0.0)
    best = Window.partitionBy(*form).orderBy(F.desc("score"), "rate_id")
    met = met.withColumn("score", F.round(score, 6)).where(F.col("score") >= least).withColumn("nth", F.row_number().over(best))
    ranked = met.where(F.col("nth") <= k).groupBy(*form).agg(F.collect_list(F.struct("nth", "rate_id", "score")).alias("ranked"))
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"r.{c}")) if c == "discipline" else F.col(f"i.{c}") == F.col(f"r.{c}") for c in form]
    return items.alias("i").join(ranked.alias("r"), same).select("i.item", F.inline("r.ranked"))
