"""Matching items with norms in another language by the concepts that both name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.families import holders


def item_concepts(texts: DataFrame, concepts: DataFrame) -> DataFrame:
    """(text, concept) of the distinct texts of column text, by the dictionary (term, concept): a term that is a word
    of two characters or more, class codes left out; one of over five characters that is part of a word of five or
    more; a phrase that stands in the text, or all of whose words do."""
    texts = texts.select("text").where("text is not null").distinct()
    terms = concepts.select(F.lower(F.trim("term")).alias("term"), "concept").distinct()
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)[^\w\s/]", " ")
    words = texts.select("text", F.explode(F.array_distinct(F.split(bare(F.regexp_replace("text", r"(?U)\b[A-I]\.\d+(?:\.\d+)*\b", "")), r"(?U)\s+"))).alias("word")).where("length(word) > 1")
    out = words.join(terms, F.col("word") == F.col("term")).select("text", "concept")
    parts = terms.where("length(term) > 5 and term not like '% %'")
    tokens = words.select(F.col("word").alias("text")).where("length(text) > 4").distinct()
    within = holders(parts.select(F.col("term").alias("word")), tokens, F.col("text")).select(F.col("word").alias("term"), F.col("text").alias("word"))
    out = out.union(words.join(within, "word").join(parts, "term").select("text", "concept"))
    phrases = terms.where("length(term) > 5 and term like '% %'")
    stand = holders(phrases.select(F.col("term").alias("word")), texts, bare(F.col("text"))).select(F.col("word").alias("term"), "text")
    out = out.union(stand.join(phrases, "term").select("text", "concept"))
    needed = phrases.select("term").distinct().select("term", F.explode(F.array_distinct(F.filter(F.split("term", r"(?U)\s+"), lambda w: w != ""))).alias("word"))
    sizes = needed.groupBy("term").agg(F.count("*").alias("size"))
    present = texts.select("text", F.explode(F.array_distinct(F.split(bare(F.col("text")), r"(?U)\s+"))).alias("word"))
    spread = present.join(needed, "word").groupBy("text", "term").agg(F.count("*").alias("n")).join(sizes, "term").where("n = size")
    return out.union(spread.join(phrases, "term").select("text", "concept")).distinct()


def norm_concepts(texts: DataFrame, concepts: DataFrame) -> DataFrame:
    """(text, concept) of the distinct texts of column text: a term that is a word, or two or three characters in a
    row of the text without its blanks and marks."""
    texts = texts.select("text").where("text is not null").distinct()
    terms = concepts.select(F.lower(F.trim("term")).alias("term"), "concept").distinct()
    plain = texts.select("text", F.regexp_replace(F.lower("text"), r"(?U)[（）()\s,，.。、/·:：;；\-+]+", " ").alias("t")).withColumn("s", F.replace("t", F.lit(" "), F.lit("")))
    grams = F.expr("flatten(transform(array(2, 3), n -> if(length(s) >= n, transform(sequence(1, length(s) - n + 1), i -> substring(s, i, n)), array())))")
    words = plain.select("text", F.explode(F.array_distinct(F.concat(F.split("t", " "), grams))).alias("term")).where("term <> ''")
    return words.join(terms, "term").select("text", "concept").distinct()


def _heads(code: Column) -> list[Column]:
    """Of a code: nothing, its class letter, that with the first number, with the first two; null beyond its end."""
    numbers = F.transform(F.regexp_extract_all(code, F.lit(r"(\d+)")), lambda n: F.regexp_replace(n, r"^0+(?=\d)", ""))
    letter = F.when(F.length(code) > 0, F.upper(F.substring(code, 1, 1)))
    one, two = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    return [F.lit(""), letter, F.concat(letter, F.lit("."), one), F.concat(letter, F.lit("."), one, F.lit("."), two)]


def concept_match(items: DataFrame, norms: DataFrame, concepts: DataFrame, generic: Sequence[str], bridge: Mapping[str, Sequence[str]], least: float = 0.3) -> DataFrame:
    """The best norm of each item among those with its unit or one that the bridge names; (item, norm, score).

    items (item, code, text, unit, section), norms (norm, code, text, unit), section being the titles over the item,
    whose concepts count as the item's. Score: Jaccard of the concepts, half if only generic ones are shared, less
    0.12 for each concept of one side only, less 0.15 if the norm has none of the section's, plus 0.03 for the same
    class letter, 0.06 with the same first number, 0.09 with more, plus 0.05 for the very unit; `least` at least, ties
    by norm. Items without text, unit or concept, and norms without any, are not matched.

    Sets of concepts are compared, not rows: distinct sets of either side meet in a join on (unit, concept), and a
    norm set stands for its smallest norm at each depth of the code.
    """
    heads = lambda df, key, text, own: df.select(F.col(key).alias("id"), F.coalesce("unit", F.lit("")).alias("unit"), F.array(*_heads(F.col("code"))).alias("heads"), F.col(text).alias("text"), *own)
    listed = lambda df, name: df.groupBy("text").agg(F.array_sort(F.collect_set("concept")).alias(name))
    none = F.array().cast("array<string>")
    it = heads(items, "item", "text", ["section"]).where("text <> '' and unit <> ''")
    known = listed(item_concepts(it.select("text").union(it.select("section")), concepts), "c")
    it = it.join(known.withColumnRenamed("c", "own"), "text", "left").join(known.select(F.col("text").alias("section"), F.col("c").alias("over")), "section", "left")
    over = F.coalesce("over", none)
    it = it.select("id", "unit", "heads", F.array_sort(F.array_union(F.coalesce("own", none), over)).alias("ic"), over.alias("sc"))
    nm = heads(norms, "norm", "text", [])
    nm = nm.join(listed(norm_concepts(nm, concepts), "nc"), "text").select(F.col("unit").alias("nu"), "nc", "id", F.posexplode("heads").alias("depth", "head"))
    nm = nm.where("head is not null").groupBy("nu", "nc", "depth", "head").agg(F.min("id").alias("norm"))

    to = F.array_distinct(F.concat(F.array("unit"), *(F.when(F.col("unit") == u, F.array(*map(F.lit, to))).otherwise(none) for u, to in bridge.items())))
    sets = it.select("unit", "ic", "sc").distinct()
    wanted = sets.select("unit", "ic", "sc", F.explode(to).alias("nu")).select("*", F.explode("ic").alias("concept"))
    pairs = wanted.join(nm.select("nu", "nc").distinct().select("nu", "nc", F.explode("nc").alias("concept")), ["nu", "concept"]).select("unit", "ic", "sc", "nu", "nc").distinct()
    both, either = F.array_intersect("ic", "nc"), F.size(F.array_union("ic", "nc"))
    share = F.size(both) / either * F.when(F.size(F.array_except(both, F.array(*map(F.lit, generic)).cast("array<string>"))) > 0, 1.0).otherwise(0.5)
    astray = F.when((F.size("sc") > 0) & ~F.arrays_overlap("sc", "nc"), 0.15).otherwise(0.0)
    base = share - 0.12 * (either - F.size(both)) - astray + F.when(F.col("unit") == F.col("nu"), 0.05).otherwise(0.0)
    pairs = pairs.withColumn("base", base).where(F.col("base") + 0.1 > least)

    classes = it.select("unit", "ic", "sc", "heads").distinct().select("*", F.posexplode("heads").alias("depth", "head")).where("head is not null")
    met = classes.join(pairs, ["unit", "ic", "sc"]).join(nm, ["nu", "nc", "depth", "head"])
    met = met.withColumn("score", F.round(F.col("base") + 0.03 * F.col("depth"), 6)).where(F.col("score") >= least)
    best = met.groupBy("unit", "ic", "sc", "heads").agg(F.min(F.struct((-F.col("score")).alias("s"), "norm")).alias("b"))
    return it.join(best, ["unit", "ic", "sc", "heads"]).select(F.col("id").alias("item"), "b.norm", (-F.col("b.s")).alias("score"))
