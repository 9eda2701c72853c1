"""Grids, spans and indicator tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid_to_long(grid: DataFrame, page: str) -> DataFrame:
    """(page, row, code, attribute, name, value) from rows of cells (page, row, cells): value columns are those
    whose header (row 0) is a five-digit code; row 1 has their attributes; the first cell is the row's name.
    Rows without a name or cells without a value are left out."""
    cells = grid.select(page, "row", F.col("cells")[0].alias("name"), F.posexplode("cells").alias("col", "value"))
    heads = cells.where("row = 0").where(F.col("value").rlike(r"^\d{5}$")).select(page, "col", F.col("value").alias("code"))
    attributes = cells.where("row = 1").select(page, "col", F.col("value").alias("attribute"))
    body = cells.where("row > 1 and length(trim(name)) > 0 and length(trim(value)) > 0")
    return body.join(heads, [page, "col"]).join(attributes, [page, "col"], "left").select(page, "row", "code", "attribute", "name", "value")


_UNIT_CELL = r"^(?:\d*\s*(?:m[23²³]?|㎡|km|kg|t|No\.?|set|pc|day|hour|工日|元|%|个|套|艘|台|台班|班|艘班|组日))$"


def read_grid(grid: DataFrame, page: str, first_data: DataFrame | None = None, unit: str = _UNIT_CELL, code: str = r"^\d{11,12}$", heads: tuple[str, ...] = ("代码", "code"), units: tuple[str, ...] = ("单位", "unit")) -> DataFrame:
    """(page, row, norm_code, attributes, name, unit, code, value) from rows of cells (page, row, cells), with the
    columns' roles found on each page at run time.

    Value columns have a five-digit code above the data. Data begin at `first_data` (page, first_data) or, without
    it, at the first row below the codes with numbers, and with nothing else, in its value columns. Of the columns
    before the first value column, not counting the first (sequence numbers), the code column is the one with most
    cells like `code` if these are over half of its cells, the unit column the same with `unit`, and the name
    column the first other one, else the sequence column without its number. Where no column qualifies, a header
    cell of `heads` or `units` tells. Header rows become attributes: one text alone in its row holds for all value
    columns. Rows with neither name nor code are left out; empty values stay as "".
    """
    rows = grid.select(page, "row", F.transform("cells", lambda c: F.coalesce(F.trim(c), F.lit(""))).alias("cells"))
    cells = rows.select(page, "row", F.posexplode("cells").alias("col", "v"))
    is_head = F.col("v").rlike(r"^\d{5}$")
    if first_data is None:
        top = cells.where(is_head).groupBy(page).agg(F.min("row").alias("top"))
        over = cells.join(top, page).where(F.col("row") == F.col("top")).where(is_head).select(page, "top", "col")
        number, blank = F.col("v").rlike(r"^-?\d+\.?\d*$"), F.col("v").isin("", "－", "—", "...")
        below = cells.join(over, [page, "col"]).where("row > top").groupBy(page, "row").agg(F.count_if(number).alias("n"), F.count_if(~number & ~blank).alias("other"))
        first_data = below.where("n > 0 and other = 0").groupBy(page).agg(F.min("row").alias("first_data"))
    cells = cells.join(first_data.select(page, "first_data"), page)
    head, body = cells.where("row < first_data"), cells.where("row >= first_data")

    codes = head.where(is_head).groupBy(page, "col").agg(F.min_by("v", "row").alias("norm_code"))
    texts = head.where((F.col("v") != "") & ~is_head).join(codes, [page, "col"])
    lone = texts.groupBy(page, "row").agg(F.count_distinct("v").alias("kinds"), F.min("v").alias("v"))
    own = texts.join(lone.where("kinds > 1").select(page, "row"), [page, "row"], "left_semi").select(page, "col", "row", "v")
    every = codes.select(page, "col").join(lone.where("kinds = 1").select(page, "row", "v"), page)
    attributes = own.unionByName(every).groupBy(page, "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "v"))), lambda a: a["v"]).alias("attributes"))
    values = codes.join(attributes, [page, "col"], "left").groupBy(page).agg(F.min("col").alias("first_value"), F.collect_list(F.struct("col", "norm_code", F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes"))).alias("value_cols"))

    said = lambda words: F.lower("v").isin(*words)
    profile = body.where("v <> ''").groupBy(page, "col").agg(F.count("*").alias("n"), F.count_if(F.col("v").rlike(code)).alias("codes"), F.count_if(F.col("v").rlike(unit)).alias("units"))
    named = head.groupBy(page, "col").agg(F.max(said(heads)).alias("code_head"), F.max(said(units)).alias("unit_head"))
    fixed = named.join(profile, [page, "col"], "left").join(values.select(page, "first_value"), page).where("col < first_value")
    zero = lambda c: F.coalesce(c, F.lit(0))
    cols = fixed.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("col", zero("n").alias("n"), zero("codes").alias("codes"), zero("units").alias("units"), "code_head", "unit_head"))).alias("f"))
    most = lambda field, keep: F.array_max(F.transform(F.filter("f", lambda c: (c["col"] > 0) & (c[field] * 2 > c["n"]) & keep(c)), lambda c: F.struct(c[field].alias("s"), (-c["col"]).alias("m"))))["m"] * -1
    first = lambda keep: F.get(F.filter("f", keep), F.lit(0))["col"]
    none = F.lit(-1)
    roles = cols.withColumn("c", F.coalesce(most("codes", lambda c: F.lit(True)), none)).withColumn("u", F.coalesce(most("units", lambda c: c["col"] != F.col("c")), none))
    roles = roles.withColumn("nm", F.coalesce(first(lambda c: (c["col"] > 0) & (c["col"] != F.col("c")) & (c["col"] != F.col("u"))), F.lit(0)))
    roles = roles.withColumn("c", F.when(F.col("c") >= 0, F.col("c")).otherwise(F.coalesce(first(lambda c: c["code_head"]), none)))
    roles = roles.withColumn("u", F.when(F.col("u") >= 0, F.col("u")).otherwise(F.coalesce(first(lambda c: c["unit_head"] & (c["col"] > 0) & (c["col"] != F.col("c")) & (c["col"] != F.col("nm"))), none)))

    plan = values.join(roles.select(page, "c", "u", "nm"), page, "left").join(first_data.select(page, "first_data"), page)
    at = lambda i: F.when(i >= 0, F.coalesce(F.get("cells", i), F.lit(""))).otherwise("")
    name = F.when(F.col("nm") > 0, at(F.col("nm"))).otherwise(F.regexp_replace(at(F.coalesce("nm", F.lit(0))), r"^\d{1,2}\s+", ""))
    name = F.when(F.col("first_value") > 0, name).otherwise("")
    data = rows.join(plan, page).where("row >= first_data").select(page, "row", "cells", name.alias("name"), at(F.coalesce("u", none)).alias("unit"), at(F.coalesce("c", none)).alias("code"), "value_cols")
    long = data.where("name <> '' or code <> ''").withColumn("k", F.explode("value_cols"))
    return long.select(page, "row", "k.norm_code", "k.attributes", "name", "unit", "code", F.coalesce(F.get("cells", F.col("k.col")), F.lit("")).alias("value"))


def fill_spans(cells: DataFrame, spans: DataFrame, leftmost: bool = False) -> DataFrame:
    """Cells (sheet, row, col, value) with the top left value of each merged span (sheet, r1, c1, r2, c2) in
    the span's empty cells; `leftmost` fills those of its first column only."""
    if leftmost:
        spans = spans.withColumn("c2", F.col("c1"))
    inside = spans.select("sheet", "r1", "c1", "c2", F.explode(F.sequence("r1", "r2")).alias("row"))
    inside = inside.select("sheet", "r1", "c1", "row", F.explode(F.sequence("c1", "c2")).alias("col"))
    top = cells.select("sheet", F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("value").alias("_top"))
    fill = inside.join(top, ["sheet", "r1", "c1"]).select("sheet", "row", "col", "_top")
    out = cells.join(fill, ["sheet", "row", "col"], "left")
    return out.withColumn("value", F.coalesce(F.nullif("value", F.lit("")), "_top")).drop("_top")


def indicator_long(wide: DataFrame, key: str, periods: list[str]) -> DataFrame:
    """(key, period, value) without null values."""
    return wide.unpivot([key], periods, "period", "value").where("value is not null")


def derived_growth(long: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Compound growth over 3 and 5 periods back from the newest: null without enough values or with a sign
    change."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(period)))
    pick = long.withColumn("_n", nth).where(F.col("_n").isin(1, 4, 6)).groupBy(key).agg(*(F.max(F.when(F.col("_n") == i, F.col(value))).alias(f"v{i}") for i in (1, 4, 6)))
    rate = lambda old, years: F.when((F.col(old) > 0) & (F.col("v1") > 0), F.pow(F.col("v1") / F.col(old), F.lit(1.0 / years)) - 1)
    return pick.select(key, rate("v4", 3).alias("cagr3"), rate("v6", 5).alias("cagr5"))


def expand_variants(norms: DataFrame, consumption: DataFrame, grades: DataFrame) -> DataFrame:
    """Copies of norms (norm_id, code, grade) for the other grades that are wanted of them: code with "c" and
    the grade, its graded resources in the new grade. Wanted grades equal to the norm's own are left out."""
    wanted = norms.join(grades, "norm_id").where("new_grade <> grade").dropDuplicates(["norm_id", "new_grade"])
    variants = wanted.select("norm_id", F.concat("code", F.lit("c"), "new_grade").alias("code"), "grade", "new_grade")
    uses = consumption.join(variants, "norm_id").withColumn("resource", F.when(F.col("resource").contains(F.col("grade")), F.replace("resource", "grade", "new_grade")).otherwise(F.col("resource")))
    return uses.select("norm_id", "code", "resource", "amount")
