"""Rule cascades: the first rule that holds decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.similar import similar_texts


def first_match(df: DataFrame, text: str, rules: DataFrame, key: str, default: str) -> DataFrame:
    """Adds label: that of the rule (priority, word, label) with the lowest priority whose word the text has.

    The words of the distinct texts are joined with the rules, so a long list of rules costs no more per row;
    a rule's word is one word of the text.
    """
    words = df.select(text).distinct().select(text, F.explode(F.array_distinct(F.split(F.lower(text), r"\W+"))).alias("word"))
    found = words.join(F.broadcast(rules), "word").groupBy(text).agg(F.min(F.struct("priority", "label")).alias("r"))
    return df.join(found, text, "left").withColumn("label", F.coalesce("r.label", F.lit(default))).drop("r")


def route_rows(df: DataFrame, rules: list[tuple[str, Column]], candidates: DataFrame, key: str) -> DataFrame:
    """Adds route: the first rule's name, else ZERO, UNIQUE, LOW (up to 3) or HIGH by the number of candidate
    divisions of the row's group."""
    counted = candidates.groupBy(key).agg(F.count_distinct("division").alias("_n"))
    met = df.join(counted, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    by_count = F.when(F.col("_n") == 0, "ZERO").when(F.col("_n") == 1, "UNIQUE").when(F.col("_n") <= 3, "LOW").otherwise("HIGH")
    named = reduce(lambda acc, r: acc.when(r[1], F.lit(r[0])), rules, F.when(F.lit(False), F.lit("")))
    return met.withColumn("route", F.coalesce(named, by_count)).drop("_n")


def classify_taxonomy(df: DataFrame, text: str, stages: list[tuple[str, list[tuple[str, str]]]]) -> DataFrame:
    """Adds discipline and source: stages of (regex, discipline) rules in order; what none fits is unresolved."""
    value, source = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for name, rules in stages:
        for rx, discipline in rules:
            hit = F.lower(text).rlike(rx)
            value, source = value.when(hit, F.lit(discipline)), source.when(hit, F.lit(name))
    return df.withColumns({"discipline": value.otherwise("unresolved"), "source": source.otherwise("none")})


def classify_price_rows(df: DataFrame, category: str, text: str, price: str, pay: float = 2000) -> DataFrame:
    """Adds class: labour, material or plant by category, then by words, then by the size of a monthly price."""
    c, t = F.lower(category), F.lower(text)
    out = F.when(c.rlike("labou?r|wage"), "labour").when(c.rlike("plant|equipment"), "plant").when(t.rlike("mason|fitter|helper"), "labour").when(t.rlike("crane|truck|mixer"), "plant")
    return df.withColumn("class", out.when((c == "month") & (F.col(price) >= pay), "labour").otherwise("material"))


def classify_resource(df: DataFrame, name: str, known: DataFrame, rules: list[tuple[str, str]], tree: dict[str, list[str]], default: str) -> DataFrame:
    """Adds class and how: a known name's class, else the first rule's, else the branch whose matching words are
    longest together, else the default. known (name, class) joins by name."""
    out = df.join(known.select(F.lower("name").alias("_k"), F.col("class").alias("_known")).dropDuplicates(["_k"]), F.lower(name) == F.col("_k"), "left")
    low = F.lower(name)
    by_rule = reduce(lambda acc, r: acc.when(low.rlike(r[0]), F.lit(r[1])), rules, F.when(F.lit(False), F.lit("")))
    scores = [F.struct(sum((F.when(low.contains(w), len(w)).otherwise(0) for w in words), F.lit(0)).alias("s"), F.lit(-i).alias("i"), F.lit(branch).alias("b")) for i, (branch, words) in enumerate(tree.items())]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    by_tree = F.when(best["s"] > 0, best["b"])
    how = F.when(F.col("_known").isNotNull(), "known").when(by_rule.isNotNull(), "rule").when(by_tree.isNotNull(), "tree").otherwise("default")
    return out.withColumns({"class": F.coalesce("_known", by_rule, by_tree, F.lit(default)), "how": how}).drop("_k", "_known")


def known_names(spark: SparkSession, base: str, version: int) -> DataFrame:
    """The name table (name, class) at a version; version 0 is empty."""
    if version == 0:
        return spark.createDataFrame([], "name string, class string")
    return spark.read.schema("name string, class string").parquet(f"{base}/v{version}")


def classify_and_remember(df: DataFrame, name: str, base: str, version: int, rules: list[tuple[str, str]], tree: dict[str, list[str]], default: str) -> DataFrame:
    """classify_resource against the name table of `version` under base, and the table's next version, which adds
    what rules, tree and default decided for names that it did not hold.

    A version is never changed: a run that is repeated reads the same one, decides the same and writes the same
    next one again. Null names are classified, not remembered.
    """
    known = known_names(df.sparkSession, base, version)
    names = classify_resource(df.select(F.lower(name).alias("name")).where("name is not null").distinct(), "name", known, rules, tree, default)
    fresh = names.where("how <> 'known'").select("name", "class")
    known.unionByName(fresh).write.mode("overwrite").parquet(f"{base}/v{version + 1}")
    return classify_resource(df, name, known, rules, tree, default)


def product_family(df: DataFrame, text: str, families: list[tuple[str, list[str]]], packages: dict[str, str]) -> DataFrame:
    """Adds family, the first one of whose triggers the text has, and its work package."""
    low = F.lower(text)
    hit = reduce(lambda acc, f: acc.when(low.rlike("|".join(f[1])), F.lit(f[0])), families, F.when(F.lit(False), F.lit("")))
    out = df.withColumn("family", hit.otherwise("no_family"))
    package = reduce(lambda acc, p: acc.when(F.col("family") == p[0], F.lit(p[1])), packages.items(), F.when(F.lit(False), F.lit("")))
    return out.withColumn("package", package.otherwise("other"))


def classify_messages(df: DataFrame, subject: str, body: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds class: rules (where, regex, class) in order, where is subject, body or any."""
    place = {"subject": F.lower(subject), "body": F.lower(body), "any": F.lower(F.concat_ws(" ", subject, body))}
    out = reduce(lambda acc, r: acc.when(place[r[0]].rlike(r[1]), F.lit(r[2])), rules, F.when(F.lit(False), F.lit("")))
    return df.withColumn("class", out.otherwise("other"))


def validate_vocab(df: DataFrame, col: str, vocabulary: DataFrame, universal: list[str], least: float = 0.5, under: str | None = None) -> DataFrame:
    """Adds fixed and how: exact, universal, prefix (known after a leading code is taken off), suggested (the value
    with the highest ratio of at least `least`, in lower case; of equals the first by place) or invalid.

    vocabulary (value, optionally place: its order, else that of the values). With `under`, a column of both sides,
    only the vocabulary of the row's own parent counts, and suggestions rest on the value without its code. Empty
    and null values are invalid, as are those with a null parent but for universal ones. Only distinct failing
    values meet the vocabulary, by an index of rare characters.
    """
    keys = [under] if under else []
    place = F.col("place") if "place" in vocabulary.columns else F.col("value")
    known = vocabulary.groupBy(*keys, "value").agg(F.min(place).alias("place"))
    values = df.select(*keys, F.col(col).alias("v")).distinct().where("v <> ''").withColumn("bare", F.trim(F.regexp_replace("v", r"^[A-Z]?[\d.]+\s+", "")))
    values = values.join(known.select(*keys, F.col("value").alias("v"), F.lit(1).alias("as_is")), [*keys, "v"], "left")
    values = values.join(known.select(*keys, F.col("value").alias("bare"), F.lit(1).alias("as_bare")), [*keys, "bare"], "left")
    always = F.col("v").isin(universal)
    failing = values.where(F.col("as_is").isNull() & F.col("as_bare").isNull() & ~always).select(*keys, "v", F.lower(F.when(F.col("bare") != "", F.col("bare")).otherwise(F.col("v")) if under else F.col("v")).alias("a"))
    pool = known.where("value <> ''").withColumn("b", F.lower("value"))
    near = failing.join(similar_texts(failing, pool, least, keys), "a").join(pool, [*keys, "b"])
    near = near.groupBy(*keys, "v").agg(F.min_by("value", F.struct((-F.col("score")).alias("s"), "place", "value")).alias("near"))
    values = values.join(near, [*keys, "v"], "left")
    how = F.when(F.col("as_is").isNotNull(), "exact").when(always, "universal").when(F.col("as_bare").isNotNull(), "prefix").when(F.col("near").isNotNull(), "suggested")
    fixed = F.when(F.col("as_is").isNotNull() | always, F.col("v")).when(F.col("as_bare").isNotNull(), F.col("bare")).otherwise(F.col("near"))
    values = values.select(*(F.col(k).alias("_under") for k in keys), F.col("v").alias("_v"), fixed.alias("fixed"), how.alias("how"))
    same = F.col(col) == F.col("_v")
    out = df.join(values, same & F.col(under).eqNullSafe(F.col("_under")) if under else same, "left")
    return out.withColumn("how", F.coalesce("how", F.lit("invalid"))).drop("_v", "_under")


def validate_levels(df: DataFrame, category: str, sub: str, categories: DataFrame, subs: DataFrame, universal: list[str], least: float = 0.5) -> DataFrame:
    """validate_vocab for two levels: adds category_fixed and category_how against categories (value), then sub_fixed
    and sub_how against the subs (category, value) of the corrected category."""
    out = validate_vocab(df, category, categories, universal, least).withColumnsRenamed({"fixed": "category_fixed", "how": "category_how"})
    below = subs.withColumnRenamed("category", "category_fixed")
    return validate_vocab(out, sub, below, universal, least, under="category_fixed").withColumnsRenamed({"fixed": "sub_fixed", "how": "sub_how"})


def dispatch(items: DataFrame, text: str, workers: list[tuple[str, list[str]]]) -> DataFrame:
    """Adds worker: the one with most of its words in the text (of equals the first), else no-match."""
    low = F.lower(text)
    scores = [F.struct(sum((low.contains(w).cast("int") for w in words), F.lit(0)).alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("w")) for i, (name, words) in enumerate(workers)]
    best = F.greatest(*scores)
    return items.withColumn("worker", F.when(best["s"] > 0, best["w"]).otherwise("no-match"))


