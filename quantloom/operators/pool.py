"""Price pools: reading, flattening, loading, de-duplicating and rolling up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.text import number
from quantloom.operators.families import holders


def rates_source(raw: DataFrame, where: Column) -> DataFrame:
    """Price observations with a usable price: with tax if positive, else without; the filter reaches the scan.

    supplier may be text or a struct with name or company_name.
    """
    price = F.coalesce(*(F.when(number(F.col(c).cast("string")) > 0, number(F.col(c).cast("string"))) for c in ("price_incl", "price_excl")))
    out = raw.where(where).withColumn("price", price).where("price > 0")
    if raw.schema["supplier"].dataType.typeName() == "struct":
        out = out.withColumn("supplier", F.coalesce("supplier.name", "supplier.company_name"))
    return out.drop("price_incl", "price_excl")


def flatten_quotes(projects: DataFrame) -> DataFrame:
    """One row for each item of each supplier of each project; what an item leaves out comes from above it."""
    s = projects.select("project", "country", "currency", F.explode("suppliers").alias("s"))
    i = s.select("project", "country", F.col("currency").alias("project_currency"), F.col("s.name").alias("supplier"), F.explode("s.items").alias("i"))
    return i.select(
        "project", "country", "supplier", F.col("i.name").alias("name"), F.coalesce("i.name_en", "i.name").alias("name_en"),
        F.coalesce("i.currency", "project_currency").alias("currency"), F.col("i.price").alias("price"),
        F.lower(F.concat_ws(" ", "i.name", "i.name_en", "supplier", "project")).alias("search_text"),
    )


def replace_where_append(target: DataFrame, new: DataFrame, keys: list[str], date: str, since: Column) -> tuple[DataFrame, DataFrame]:
    """(the target after the load, its counts): rows of the new rows' keys from `since` on make way for them."""
    groups = new.select(*keys).distinct()
    stale = target.where(F.col(date) >= since).join(groups, keys, "left_semi")
    kept = target.where((F.col(date) < since) | F.col(date).isNull()).unionByName(target.where(F.col(date) >= since).join(groups, keys, "left_anti"))
    counts = stale.agg(F.count("*").alias("deleted")).crossJoin(new.agg(F.count("*").alias("inserted")))  # one row each
    return kept.unionByName(new), counts


def dedup_rate_pool(rates: DataFrame, name_key: Column, unit_key: Column, least_name: int = 4) -> DataFrame:
    """One row for each normalised name and unit: the latest observation (of equals the smallest id), and the
    range, mean and number of prices. Short and purely numeric names are left out."""
    keyed = rates.withColumns({"name_key": name_key, "unit_key": unit_key})
    keyed = keyed.where((F.length("name_key") >= least_name) & ~F.col("name_key").rlike(r"^[\d\s.]+$"))
    last = F.min_by(F.struct("rate_id", "price", "supplier", "date"), F.struct((-F.unix_date("date")).alias("age"), "rate_id"))
    out = keyed.groupBy("name_key", "unit_key").agg(last.alias("last"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.round(F.avg("price"), 2).alias("avg_price"), F.count("*").alias("n"))
    return out.select("name_key", "unit_key", "last.rate_id", "last.price", "last.supplier", "last.date", "min_price", "max_price", "avg_price", "n")


def price_records(raw: DataFrame) -> DataFrame:
    """Rows for the price index: without a name or a price none; keys for lookup."""
    value = number(F.col("price"))
    squeezed = F.trim(F.regexp_replace("name", r"\s+", " "))
    out = raw.withColumns({"name": squeezed, "price_value": value}).where((F.col("name") != "") & F.col("price_value").isNotNull())
    return out.withColumns({"lookup_key": F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", ""), "material_key": F.concat_ws("|", F.lower("name"), F.lower("unit"))})


def consolidate(items: DataFrame, groups: list[tuple[str, list[str], bool]], text: str = "descr") -> DataFrame:
    """Items of each group, merged by their lower-case description: the first group whose words occur (all of
    them, or any) takes an item; quantities add up, unit comes from the first row; group is null if none fits."""
    low = F.lower(text)
    found: Column = F.when(F.lit(False), F.lit(""))
    for name, words, every in groups:
        tests = [low.contains(w) for w in words]
        hit = tests[0]
        for t in tests[1:]:
            hit = hit & t if every else hit | t
        found = found.when(hit, F.lit(name))
    keyed = items.withColumns({"grp": found, "descr_key": low})
    return keyed.groupBy("grp", "descr_key").agg(F.sum("qty").alias("qty"), F.min_by("unit", "row_no").alias("unit"), F.count("*").alias("n"))


def qty_by_code(items: DataFrame, code: str = "code", qty: str = "qty", headers: tuple[str, ...] = ("code", "no.", "item")) -> DataFrame:
    """Total quantity of each code; blank, 0 and header codes and what is no number do not count."""
    amount = F.col(qty).try_cast("double")
    usable = (F.trim(F.col(code)) != "") & (F.col(code) != "0") & ~F.lower(code).isin(*headers)
    return items.where(usable & amount.isNotNull()).groupBy(code).agg(F.sum(amount).alias("qty"))


def resource_rollup(consumption: DataFrame, norm_qty: DataFrame) -> DataFrame:
    """Need of each resource over all norms: sum of amount times the norm's quantity, by name and unit."""
    return consumption.join(norm_qty, "norm_id").groupBy("resource", "unit").agg(F.sum(F.col("amount") * F.col("qty")).alias("need"), F.count_distinct("norm_id").alias("norms"), F.max("rate").alias("max_rate"), F.count_distinct("rate").alias("rates"))


def composite_rate(norms: DataFrame, consumption: DataFrame, prices: DataFrame, classes: list[str]) -> DataFrame:
    """Rate of each norm as the sum of its classes: amount times the resource's price."""
    priced = consumption.join(prices, ["resource", "unit"]).withColumn("cost", F.col("amount") * F.col("unit_price"))
    wide = priced.groupBy("norm_id").pivot("class", classes).agg(F.sum("cost")).fillna(0.0, classes)
    rate = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return norms.join(wide.withColumn("rate", rate), "norm_id")


def price_sources(prices: DataFrame, source: str, date: str, where: Column) -> DataFrame:
    """Records and last update of each source."""
    return prices.where(where).groupBy(source).agg(F.count("*").alias("records"), F.max(date).alias("last_update"))


def majority_unit(rows: DataFrame, name: str, unit: str) -> DataFrame:
    """The commonest valid unit of each name (of equals the first in order); not empty, not the name itself."""
    valid = rows.where((F.trim(unit) != "") & (F.lower(unit) != F.lower(name)))
    counts = valid.groupBy(name, unit).agg(F.count("*").alias("n"))
    best = counts.groupBy(name).agg(F.min_by(F.struct(unit, "n"), F.struct((-F.col("n")).alias("minus"), unit)).alias("b"))
    return best.select(name, F.col(f"b.{unit}").alias(unit), "b.n")


def price_lookup(prices: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """Best price records for each wanted name: key equal 300, key prefix 200, name contains 120, key contains
    80; then the shorter name, then the newer record, then the id.

    Names and keys are met through an index of their tokens (families.holders), as distinct texts; of the prices of
    one text, the `limit` newest are looked at. Null names are not found, nor do names without a letter or digit
    match any key.
    """
    wanted = names.select(F.col("name").alias("wanted"), F.lower("name").alias("low"), F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", "").alias("key")).where("wanted is not null").distinct()
    texts = prices.select("name", "lookup_key").where("name is not null").distinct()
    by_key = holders(wanted.select(F.col("key").alias("word")), texts.select(F.col("lookup_key").alias("text")).where("text is not null"), F.col("text")).toDF("key", "lookup_key")
    by_name = holders(wanted.select(F.col("low").alias("word")), texts.select(F.col("name").alias("text")), F.lower("text")).toDF("low", "name")
    met = by_key.join(wanted, "key").join(texts, "lookup_key").select("wanted", "low", "key", "name", "lookup_key")
    met = met.union(by_name.join(wanted, "low").join(texts, "name").select("wanted", "low", "key", "name", "lookup_key")).distinct()
    keyed = (F.col("key") != "") & F.col("lookup_key").isNotNull()
    score = F.when(keyed & (F.col("lookup_key") == F.col("key")), 300).when(keyed & F.col("lookup_key").startswith(F.col("key")), 200).when(F.lower("name").contains(F.col("low")), 120).otherwise(80)
    met = met.select("wanted", F.col("name").alias("_n"), F.col("lookup_key").alias("_k"), score.alias("score"))
    newest = Window.partitionBy("name", "lookup_key").orderBy(F.desc("date"), "rate_id")
    heads = prices.select("rate_id", "name", "lookup_key", "date").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= limit)
    best = Window.partitionBy("wanted").orderBy(F.desc("score"), F.length("name"), F.desc("date"), "rate_id")
    out = met.join(heads, (F.col("_n") == F.col("name")) & F.col("_k").eqNullSafe(F.col("lookup_key"))).withColumn("nth", F.row_number().over(best))
    return out.where(F.col("nth") <= limit).select("wanted", "nth", "rate_id", "name", "score")
