"""Rankings, trees and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.text import code_depth, code_prefixes
from quantloom.operators.ordered import carried
from quantloom.sources.scratch import stored


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in the given order, numbered from 1 in column n."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= k)


def top_differences(df: DataFrame, key: str, a: str, b: str, n: int) -> DataFrame:
    """The n rows with the largest difference in percent of the larger quantity; both must be positive."""
    high, low = F.greatest(a, b), F.least(a, b)
    diff = F.round((high - low) / high * 100, 6)
    return df.where((F.col(a) > 0) & (F.col(b) > 0)).withColumn("diff", diff).where("diff <> 0").orderBy(F.desc("diff"), key).limit(n)


def configured_order(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """Sorted by place in the list, what is not in it last (99), then by name."""
    place = F.when(F.lit(False), F.lit(0))
    for i, value in enumerate(order):
        place = place.when(F.col(col) == value, F.lit(i))
    return df.withColumn("pos", place.otherwise(99)).orderBy("pos", col)


def path_codes(df: DataFrame, code: str) -> DataFrame:
    """Adds ancestors (all prefixes of the code, from the top) and depth."""
    return df.withColumns({"ancestors": code_prefixes(F.col(code)), "depth": code_depth(F.col(code)).cast("bigint")})


def ancestor_rows(df: DataFrame, code: str) -> DataFrame:
    """The distinct codes above those of df."""
    return df.select(F.explode(code_prefixes(F.col(code))).alias(code)).distinct()


def subtree_by_keyword(df: DataFrame, code: str, text: str, keyword: str) -> DataFrame:
    """Rows whose text has the keyword, their ancestors and their descendants by code; marker tells the first.

    All are equi-joins: a row is an ancestor if a marker has its code among its prefixes, a descendant if it
    has a marker's code among its own.
    """
    rows = df.withColumn("marker", F.col(text).contains(keyword))
    marks = rows.where("marker").select(F.col(code).alias("m")).distinct()
    above = marks.select(F.explode(code_prefixes(F.col("m"))).alias(code)).distinct()
    below = rows.select(code, F.explode(code_prefixes(F.col(code))).alias("m")).join(marks, "m", "left_semi").select(code)
    wanted = above.unionByName(below).unionByName(marks.select(F.col("m").alias(code))).distinct()
    return rows.join(wanted, code, "left_semi")


def keyword_subtrees(df: DataFrame, keys: list[str], order: str, code: str, text: str, keyword: str, block: int = 1 << 24) -> DataFrame:
    """Rows of df around those whose text has the keyword, each once, with role: marker, section, class, parent, child.

    A marker has the keyword and an item's code (A.1...). Its section is the last row before it that starts with 【; its
    class and parents are the rows between that and the marker with code "Class A", and with codes above its own. Its
    children are the rows after it below its code, and rows with code ADD, up to the next marker or the first item whose
    code is no deeper than the marker's.

    What is above a row comes from carried() in blocks of order numbers; parents and classes from equi-joins on
    (section, code), with one row for each code that markers of a section have above them.
    """
    dots = F.length(F.col(code)) - F.length(F.replace(F.col(code), F.lit("."), F.lit("")))
    item = F.coalesce(F.col(code).rlike(r"^[A-Z]\.\d+"), F.lit(False))
    marker = item & F.coalesce(F.contains(F.lower(text), F.lit(keyword.lower())), F.lit(False))
    rows = df.withColumns({"_item": item, "_marker": marker, "_dots": dots})
    head = F.when(F.coalesce(F.col(text).startswith("【"), F.lit(False)), F.col(order))
    rows = carried(rows, keys, order, {"_section": head, "_m": F.when(F.col("_marker"), F.struct(F.col(order).alias("at"), F.col(code).alias("code"), F.col("_dots").alias("dots")))}, block)
    stops = F.when(F.col("_item") & ~F.col("_marker") & (F.col("_dots") <= F.col("_m.dots")), F.col(order))
    rows = stored(carried(rows, keys, order, {"_stop": stops}, block).withColumn("_section", F.coalesce("_section", F.lit(-1 << 62))))
    marks = rows.where("_marker")
    last = lambda named: marks.select(*keys, "_section", F.col(order).alias("_at"), named.alias("_above")).groupBy(*keys, "_section", "_above").agg(F.max("_at").alias("_last"))
    above = lambda role, named, own: rows.where(own).join(last(named).withColumnRenamed("_above", code), [*keys, "_section", code]).where(F.col(order) < F.col("_last")).select(*keys, order, F.lit(role).alias("_role"))
    below = (F.col(code) == "ADD") | (F.col("_item") & F.col(code).startswith(F.concat(F.col("_m.code"), F.lit("."))))
    parts = [
        marks.select(*keys, order, F.lit(1).alias("_role")), marks.where(F.col("_section") > (-1 << 62)).select(*keys, F.col("_section").alias(order), F.lit(2).alias("_role")),
        above(3, F.concat(F.lit("Class "), F.substring(code, 1, 1)), F.col(code).startswith("Class ")), above(4, F.explode(code_prefixes(F.col(code))), F.col("_item")),
        rows.where(~F.col("_marker") & F.col("_m").isNotNull() & F.coalesce(F.col("_stop") < F.col("_m.at"), F.lit(True)) & below).select(*keys, order, F.lit(5).alias("_role")),
    ]
    roles = reduce(DataFrame.unionByName, parts).groupBy(*keys, order).agg(F.min("_role").alias("_role"))
    names = F.array(*map(F.lit, ("marker", "section", "class", "parent", "child")))
    return df.join(roles, [*keys, order]).withColumn("role", F.element_at(names, F.col("_role"))).drop("_role")


def tree_root(nodes: DataFrame, most: int = 10) -> DataFrame:
    """(id, root, hops) for every node of an adjacency list (id, parent_id); nodes deeper than `most` have none.

    One join for each level until no node is left on the way; a cycle ends at `most`.
    """
    at = nodes.select("id", F.col("id").alias("root"), F.col("parent_id").alias("up"), F.lit(0).alias("hops"))
    step = nodes.select(F.col("id").alias("up"), F.col("parent_id").alias("next"))
    done = at.where("up is null")
    going = at.where("up is not null")
    for _ in range(most):
        moved = stored(going.join(step, "up").select("id", F.col("up").alias("root"), F.col("next").alias("up"), (F.col("hops") + 1).alias("hops")))
        done = done.unionByName(moved.where("up is null"))
        going = moved.where("up is not null")
        if going.isEmpty():
            break
    return done.select("id", "root", "hops")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that the seeds reach over edges (a, b), seeds included: the frontier is joined until it is empty."""
    frontier = seen = stored(seeds.select("node").distinct())
    while not frontier.isEmpty():
        met = frontier.join(edges, frontier["node"] == edges["a"]).select(F.col("b").alias("node")).distinct()
        frontier = stored(met.join(seen, "node", "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def name_verdicts(names: DataFrame, edges: DataFrame) -> DataFrame:
    """names (id, external, used, junk, builtin, skip) with both marks spread over the graph, and a verdict.

    edges (a, b): a refers to b. What an external name is referred to by is external too; what a used name refers to is
    used. Both marks spread at once: the frontier of (mark, node) is joined with the edges of that mark's direction
    until it is empty. Then the first rule that holds: junk goes, built-in names stay, external names stay if they are
    used or skipped, skipped and used names stay, all others go. Edges to what is no name lead nowhere.
    """
    ids = names.select(F.col("id").alias("node"))
    steps = edges.select(F.lit("used").alias("mark"), F.col("a").alias("node"), F.col("b").alias("next")).unionByName(edges.select(F.lit("external").alias("mark"), F.col("b").alias("node"), F.col("a").alias("next")))
    steps = stored(steps.distinct().join(ids.withColumnRenamed("node", "next"), "next", "left_semi"))
    marks = F.explode(F.array_compact(F.array(F.when(F.col("external"), F.lit("external")), F.when(F.col("used"), F.lit("used")))))
    frontier = seen = stored(names.select(marks.alias("mark"), F.col("id").alias("node")).distinct())
    while not frontier.isEmpty():
        met = frontier.join(steps, ["mark", "node"]).select("mark", F.col("next").alias("node")).distinct()
        frontier = stored(met.join(seen, ["mark", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    spread = seen.groupBy(F.col("node").alias("id")).agg(F.max(F.col("mark") == "external").alias("_external"), F.max(F.col("mark") == "used").alias("_used"))
    out = names.join(spread, "id", "left").withColumns({"external": F.coalesce("_external", F.lit(False)), "used": F.coalesce("_used", F.lit(False))}).drop("_external", "_used")
    rules = [("junk", "delete: junk"), ("builtin", "keep: builtin"), ("external and not skip and not used", "delete: unused external"), ("external", "keep: external in use"), ("skip", "keep: skipped"), ("used", "keep: used")]
    return out.withColumn("verdict", F.coalesce(*(F.when(F.expr(rule), F.lit(said)) for rule, said in rules), F.lit("delete: unused")))


def chapter_for_page(chapters: DataFrame, pages: DataFrame, key: str, page: str) -> DataFrame:
    """The deepest chapter (of equals the largest) whose page range covers the page; null if none does.

    Ranges are exploded to their pages, so the join is on equality.
    """
    by_page = chapters.select("chapter", "level", F.explode(F.sequence("lo", "hi")).alias(page)).groupBy(page).agg(F.max(F.struct("level", "chapter")).alias("c"))
    return pages.join(by_page, page, "left").select(key, F.col("c.chapter").alias("chapter"))
