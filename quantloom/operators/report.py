"""Summaries, coverage reports and control totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grade_quantities(df: DataFrame, code: str, text: str, qty: str, rx: str) -> DataFrame:
    """Quantity of each code and grade; the grade is the regex's first group in the text."""
    grade = F.nullif(F.regexp_extract(text, rx, 1), F.lit(""))
    return df.withColumn("grade", grade).where("grade is not null").groupBy(code, "grade").agg(F.sum(qty).alias("qty"), F.count("*").alias("n"))


def group_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each group, the largest first."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def pattern_summary(df: DataFrame, keys: list[str], order: str, text: str, samples: int = 3) -> DataFrame:
    """Rows of each group and its first few texts in row order; only these are collected."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    few = df.select(*keys, order, text).withColumn("nth", nth).where(F.col("nth") <= samples)
    texts = few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", text))), lambda x: x[text]).alias("samples"))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).join(texts, keys)


def pricing_coverage(results: DataFrame, group: str) -> DataFrame:
    """For each group and in total (group null): items, matched ones, coverage in percent, and priced amount."""
    matched = F.col("status").isin("high", "medium", "low", "estimated")
    out = results.rollup(group).agg(F.count("*").alias("items"), F.count_if(matched).alias("matched"), F.count_if(F.col("price") > 0).alias("priced"), F.sum(F.when(F.col("price") > 0, F.col("price") * F.col("qty"))).alias("amount"))
    return out.withColumn("coverage", F.round(F.col("matched") * 100.0 / F.col("items"), 1))


def match_quality(results: DataFrame, group: str, verdicts: list[str]) -> DataFrame:
    """For each group the rows of each verdict, score buckets, and average, least and largest score."""
    bucket = lambda lo, hi: F.count_if((F.col("score") >= lo) & (F.col("score") < hi))
    scores = results.groupBy(group).agg(bucket(90, 1e9).alias("b90"), bucket(60, 90).alias("b60"), bucket(30, 60).alias("b30"), bucket(-1e9, 30).alias("b0"), F.round(F.avg("score"), 6).alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))
    return results.groupBy(group).pivot("verdict", verdicts).count().fillna(0, verdicts).join(scores, group)


def comparison_summary(rows: DataFrame, group: str, labels: list[str], threshold: float) -> DataFrame:
    """For each group: items of each list, rows over the threshold, rows that one list alone has."""
    held = [F.count_if(F.col(f"{n}_qty").isNotNull()).alias(f"{n}_items") for n in labels]
    alone = F.size(F.filter(F.array(*(F.col(f"{n}_qty") for n in labels)), lambda x: x.isNotNull())) == 1
    return rows.groupBy(group).agg(*held, F.count_if(F.col("diff") > threshold).alias("over"), F.count_if(alone).alias("alone"))


def control_totals(source: DataFrame, output: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """Quantity and amount of each section on both sides, and PASS if they agree; a section of one side fails."""
    total = lambda df, s: df.groupBy(key).agg(F.sum("qty").alias(f"{s}_qty"), F.sum("amount").alias(f"{s}_amount"))
    met = total(source, "src").join(total(output, "out"), key, "full")
    good = (F.abs(F.col("src_qty") - F.col("out_qty")) < tolerance) & (F.abs(F.col("src_amount") - F.col("out_amount")) < tolerance)
    return met.withColumn("verdict", F.when(F.coalesce(good, F.lit(False)), "PASS").otherwise("FAIL"))


def term_frequency(docs: DataFrame, text: str, stop: list[str], n: int) -> DataFrame:
    """The n commonest words of three letters or more that are no stop words."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), 0)).alias("term"))
    return words.where(~F.col("term").isin(stop)).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def session_stats(messages: DataFrame, error: str) -> DataFrame:
    """For each conversation: turns by role, messages with an error marker, characters."""
    role = lambda r: F.count_if(F.col("role") == r)
    return messages.groupBy("conv_id").agg(F.count("*").alias("turns"), role("user").alias("user_turns"), role("assistant").alias("assistant_turns"), F.count_if(F.col("text").rlike(error)).alias("errors"), F.sum(F.length("text")).alias("chars"))


def session_findings(messages: DataFrame, tool: str, error: str, tools: int = 5, pitfalls: int = 3) -> DataFrame:
    """(conv_id, tools, pitfalls, smooth): the commonest tools, by the first group of the pattern `tool` (as name:n,
    of equals the one used first), the first distinct answers with an error marker, cut to 200 characters, and
    whether there are answers and none of them has one. Null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    used = messages.select("conv_id", "turn", F.posexplode(F.regexp_extract_all(text, F.lit(tool), 1)).alias("at", "name")).groupBy("conv_id", "name").agg(F.count("*").alias("n"), F.min(F.struct("turn", "at")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "first"))
    used = used.withColumn("nth", nth).where(F.col("nth") <= tools).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name", "n"))), lambda t: F.concat(t["name"], F.lit(":"), t["n"].cast("string"))).alias("tools"))
    bad = messages.where((F.col("role") == "assistant") & text.rlike(error)).select("conv_id", "turn", F.trim(F.substring(text, 1, 200)).alias("said"))
    bad = bad.groupBy("conv_id", "said").agg(F.min("turn").alias("turn"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "said"))
    bad = bad.withColumn("nth", nth).where(F.col("nth") <= pitfalls).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "said"))), lambda t: t["said"]).alias("pitfalls"))
    out = messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("answers")).join(used, "conv_id", "left").join(bad, "conv_id", "left")
    none = F.array().cast("array<string>")
    return out.select("conv_id", F.coalesce("tools", none).alias("tools"), F.coalesce("pitfalls", none).alias("pitfalls"), ((F.col("answers") > 0) & F.col("pitfalls").isNull()).alias("smooth"))


def nested_tree(items: DataFrame, chapter: str, section: str, item: str) -> DataFrame:
    """One row for each chapter with its sections and their distinct items, all in order. An item list holds
    the items of one section."""
    inner = items.select(chapter, section, item).distinct().groupBy(chapter, section).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return inner.groupBy(chapter).agg(F.array_sort(F.collect_list(F.struct(F.col(section).alias("section"), "items"))).alias("sections"))


def price_sheet_groups(rows: DataFrame, l1: str, l2: str, l3: str, threshold: int, order: list[str]) -> DataFrame:
    """Groups of l1 and l2, cut by l3 where they are larger than the threshold; listed l1 values come first."""
    sized = rows.withColumn("_n", F.count("*").over(Window.partitionBy(l1, l2)))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(l1)), F.lit(0))
    out = sized.groupBy(l1, l2, F.when(F.col("_n") > threshold, F.col(l3)).alias(l3)).agg(F.count("*").alias("n"))
    return out.withColumn("pos", F.when(place > 0, place).otherwise(99)).orderBy("pos", l1, l2, l3)


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def quote_dashboard(quotes: DataFrame, section: Column) -> DataFrame:
    """Quotes, priced ones and origins of each section."""
    return quotes.withColumn("section", section).groupBy("section").agg(F.count("*").alias("quotes"), F.count_if(F.col("price") > 0).alias("priced"), F.count_distinct("origin").alias("origins"))


def quote_totals(quotes: DataFrame, sections: list[tuple[str, Column]], rest: str) -> DataFrame:
    """(level, pos, section, origin, quotes, priced, unpriced): quotes of each origin in each section (level 0), of
    each section (1) and of all (3). A quote belongs to the first section whose condition holds, else to `rest`;
    pos is the section's place in that order, null in the total."""
    number = F.when(F.lit(False), F.lit(0))
    for n, (_, when) in enumerate(sections):
        number = number.when(when, F.lit(n))
    names = [*(name for name, _ in sections), rest]
    out = quotes.withColumn("pos", number.otherwise(len(sections))).rollup("pos", "origin").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("quotes"), F.count_if(F.col("price") > 0).alias("priced"))
    return out.select("level", "pos", F.get(F.array(*map(F.lit, names)), F.col("pos")).alias("section"), "origin", "quotes", "priced", (F.col("quotes") - F.col("priced")).alias("unpriced"))
