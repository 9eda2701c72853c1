"""Arithmetic closure of read tables: which numbers of a page prove each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.page_proofs import findings, grades
from quantloom.sources.scratch import stored

# Tolerances of products and sums, for each row of a column sum, and of ratios; the share up to which a
# sum is a near miss; usual percentages.
TOL_PRODUCT, TOL_SUM_PER_ITEM, TOL_RATIO_REL, NEAR = "0.02", "0.02", "0.0002", "0.005"
PERCENTAGES = ("0.05", "0.07", "0.10", "0.12", "0.15", "0.17", "0.18", "0.20")

_MONEY = "decimal(16,4)"


def _exact(text: str) -> Column:
    return F.lit(text).cast(f"decimal(9,{len(text.partition('.')[2])})")


def _tolerance(value: Column) -> Column:
    """Two cents, or a thousand-millionth of the value if that is more."""
    return F.greatest(_exact(TOL_PRODUCT), F.abs(value) * _exact("0.000000001"))


def _met(sought: DataFrame, target: Column, reach: Column, numbers: DataFrame, keys: list[str], relative: bool = False) -> DataFrame:
    """sought joined with the numbers (found, ...) of the same keys that lie within `reach` of target: an equi-join
    on whole units, or (relative, for a reach that grows with the target) on steps of its arsinh, which rounding may
    only widen. The caller compares exactly."""
    middle, far = target.cast("double"), reach.cast("double") + target.cast("double") * 1e-12 + 1e-6
    step = (lambda c: F.asinh(c) * 25) if relative else (lambda c: c)
    slack = 1e-6 if relative else 0.0
    units = F.sequence(F.floor(step(middle - far) - slack).cast("bigint"), F.floor(step(middle + far) + slack).cast("bigint"))
    return sought.withColumn("unit", F.explode(units)).join(numbers.withColumn("unit", F.floor(step(F.col("found").cast("double"))).cast("bigint")), [*keys, "unit"]).drop("unit")


def numbered_cells(cells: DataFrame) -> DataFrame:
    """(page, row, idx, value, upto): a row's cells with a number, from left to right, with running sums."""
    order = Window.partitionBy("page", "row").orderBy("x")
    base = cells.where("value is not null").withColumn("value", F.col("value").cast(_MONEY))
    return base.select("page", "row", F.row_number().over(order).alias("idx"), "value", F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast(_MONEY).alias("upto"))


def row_products(base: DataFrame) -> DataFrame:
    """(page, row, terms, total): two positive numbers of a row, in their order, whose product is a third one."""
    own = base.where("value > 0")
    pairs = own.select("page", "row", F.col("idx").alias("i"), F.col("value").alias("a")).join(own.select("page", "row", F.col("idx").alias("j"), F.col("value").alias("b")), ["page", "row"]).where("i < j")
    pairs = pairs.withColumn("product", F.col("a") * F.col("b")).where("product < 1.1e12")  # no value is that large
    met = _met(pairs, F.col("product"), F.greatest(F.lit(0.02), F.col("product").cast("double") * 1.1e-9), own.select("page", "row", F.col("idx").alias("k"), F.col("value").alias("found")), ["page", "row"])
    met = met.where((F.col("k") != F.col("i")) & (F.col("k") != F.col("j")) & (F.abs(F.col("product") - F.col("found")) <= _tolerance(F.col("found"))))
    return met.select("page", "row", F.array("a", "b").alias("terms"), F.col("found").alias("total")).distinct()


def _runs(base: DataFrame) -> DataFrame:
    """(page, row, i, j, sum): runs of two cells or more whose sum is positive, from running sums."""
    starts = base.select("page", "row", F.col("idx").alias("i"), (F.col("upto") - F.col("value")).alias("before"))
    runs = starts.join(base.select("page", "row", F.col("idx").alias("j"), "upto"), ["page", "row"]).where("i < j")
    return runs.select("page", "row", "i", "j", (F.col("upto") - F.col("before")).alias("sum")).where("sum > 0")


def _terms(runs: DataFrame, base: DataFrame, keys: list[str], key: str, value: str) -> DataFrame:
    """runs with terms: the values of their members i to j, in order."""
    members = runs.join(base.select(*keys, F.col(key).alias("at"), F.col(value).alias("v")), keys).where("at between i and j")
    return members.groupBy(*runs.columns).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda m: m["v"]).alias("terms"))


def row_sums(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums of neighbouring cells that a cell further right repeats: (page, row, terms, total). Then, of rows without
    one, those that miss it by half a percent at most: (page, row, terms, total, delta)."""
    runs = _runs(base)
    right = base.select("page", "row", F.col("idx").alias("k"), F.col("value").alias("found")).where("found > 0")
    met = _met(runs, F.col("sum"), F.col("sum").cast("double") * 0.0051 + 0.03, right, ["page", "row"], relative=True).where("k > j").withColumn("delta", F.col("found") - F.col("sum"))
    closed = F.abs("delta") <= _tolerance(F.col("found"))
    close = ~closed & (F.abs("delta") <= F.col("found") * _exact(NEAR))
    met = stored(_terms(met.withColumn("closed", closed).where(closed | close), base, ["page", "row"], "idx", "value"))
    sums = met.where("closed").select("page", "row", "terms", F.col("found").alias("total")).distinct()
    near = met.where(~F.col("closed")).join(sums.select("page", "row").distinct(), ["page", "row"], "left_anti")
    return sums, near.select("page", "row", "terms", F.col("found").alias("total"), "delta").distinct()


def column_sums_of_rows(base: DataFrame, products: DataFrame, sums: DataFrame) -> DataFrame:
    """(page, terms, total): amounts of neighbouring rows whose sum some number of the page repeats.

    A row's amount is that of its largest product, else that of its longest sum (of equals the largest)."""
    by_product = products.groupBy("page", "row").agg(F.max("total").alias("p"))
    by_sum = sums.groupBy("page", "row").agg(F.max(F.struct(F.size("terms").alias("size"), "total")).alias("s"))
    amounts = by_product.join(by_sum, ["page", "row"], "full").select("page", "row", F.coalesce("p", "s.total").alias("value"))
    order = Window.partitionBy("page").orderBy("row")
    rows = amounts.select("page", "row", "value", F.row_number().over(order).alias("idx"), F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast(_MONEY).alias("upto"))
    runs = _runs(rows.withColumn("row", F.lit(0))).drop("row")
    reach = (F.col("j") - F.col("i") + 1) * _exact(TOL_SUM_PER_ITEM)
    numbers = base.where("value > 0").select("page", F.col("value").alias("found")).distinct()
    met = _met(runs, F.col("sum"), reach, numbers, ["page"]).where(F.abs(F.col("found") - F.col("sum")) <= reach)
    return _terms(met, rows, ["page"], "idx", "value").select("page", "terms", F.col("found").alias("total")).distinct()


def page_ratios(base: DataFrame) -> DataFrame:
    """(page, kind, terms, total): of a page's distinct positive numbers, a + b = c with a > b, and a usual percentage
    of a, b = p * a (terms a and p)."""
    numbers = base.where("value > 0").select("page", F.col("value").alias("found")).distinct()
    one, two = numbers.withColumnRenamed("found", "a"), numbers.withColumnRenamed("found", "b")
    pairs = one.join(two, "page").where("a > b").withColumn("sum", (F.col("a") + F.col("b")).cast(_MONEY))
    sums = _met(pairs, F.col("sum"), _exact(TOL_PRODUCT), numbers, ["page"]).where((F.abs(F.col("found") - F.col("sum")) <= _exact(TOL_PRODUCT)) & (F.col("found") != F.col("a")) & (F.col("found") != F.col("b")))
    share = one.withColumn("p", F.explode(F.array(*(F.lit(p).cast("decimal(5,4)") for p in PERCENTAGES)))).withColumn("part", F.col("a") * F.col("p"))
    reach = F.col("a") * _exact(TOL_RATIO_REL)
    parts = _met(share, F.col("part"), reach, numbers, ["page"]).where((F.abs(F.col("found") - F.col("part")) <= reach) & (F.col("found") != F.col("a")))
    terms = lambda x, y: F.array(F.col(x), F.col(y).cast(_MONEY))
    return sums.select("page", F.lit("ratio sum").alias("kind"), terms("a", "b").alias("terms"), F.col("found").alias("total")).unionByName(
        parts.select("page", F.lit("percentage").alias("kind"), terms("a", "p").alias("terms"), F.col("found").alias("total"))
    )


def _by_page(cells: DataFrame, adjacent: bool, *more: Column) -> DataFrame:
    """(page, row, x, v, ...): cells of each page next to each other in one task, v in ten-thousandths."""
    dealt = cells.where("page is not null")
    dealt = dealt if adjacent else dealt.repartition("page").sortWithinPartitions("page")
    return dealt.select("page", "row", "x", (F.col("value").cast(_MONEY) * 10000).cast("bigint").alias("v"), *more)


def _long_pages(cells: DataFrame, most: int, sizes: DataFrame | None) -> DataFrame:
    sizes = cells.where("page is not null").groupBy("page").count() if sizes is None else sizes
    return stored(sizes.where(F.col("count") > most).select("page"))


def _closures_of_short_pages(cells: DataFrame, adjacent: bool = False) -> DataFrame:
    """As closures, for short pages: at most one shuffle brings a page together, nothing else is moved or held."""
    kind = {n: cells.schema[n].dataType.simpleString() for n in ("page", "row")}
    names = ["page", "row", "kind", "terms", "total", "delta"]
    schema = f"page {kind['page']}, row {kind['row']}, kind string, terms array<{_MONEY}>, total {_MONEY}, delta {_MONEY}"
    return _by_page(cells.where("value is not null"), adjacent).mapInArrow(lambda batches: findings(batches, names), schema)


def closures(cells: DataFrame, most: int = 128, sizes: DataFrame | None = None, adjacent: bool = False) -> DataFrame:
    """(page, row, kind, terms, total, delta, implied): everything by which numbers of a page prove each other.

    cells: (page, row, x, value); x orders a row's cells, row a page's rows. Kinds: product, sum, near (a sum missed
    by more than two cents and half a percent at most, in a row without a sum; delta is what it misses, implied what
    each term would have to be), column sum, ratio sum, percentage; the last three belong to the page (row null).
    Values are exact to four decimals and below 10^12. Runs of cells come from differences of running sums. A page with
    up to `most` cells meets in one task, which compares all of it (see page_proofs); of longer pages totals are met in
    equi-joins on whole units or steps, so that a row costs its number of runs and no task gets a page. Null values
    take no part; repeated findings of a row count once. sizes (page, count) may give the pages' numbers of cells, or
    bounds above them, where the caller has them more cheaply; adjacent says that the cells of a page stand next to each
    other in one partition already, so that they need not be dealt and sorted.
    """
    long = _long_pages(cells, most, sizes)
    if long.isEmpty():
        found = _closures_of_short_pages(cells, adjacent)
    else:
        short = cells.join(long, "page", "left_anti").select(*cells.columns)
        found = _closures_of_short_pages(short).unionByName(_closures_of_long_pages(cells.join(long, "page", "left_semi").select(*cells.columns)))
    return found.withColumn("implied", F.when(F.col("delta").isNotNull(), F.transform("terms", lambda v: (v + F.col("delta")).cast(_MONEY))))


def _closures_of_long_pages(cells: DataFrame) -> DataFrame:
    base = stored(numbered_cells(cells))
    products = stored(row_products(base))
    sums, near = row_sums(base)
    money = F.lit(None).cast(_MONEY)
    row = lambda df, kind: df.select("page", "row", F.lit(kind).alias("kind"), "terms", "total", money.alias("delta"))
    none = F.lit(None).cast(cells.schema["row"].dataType)
    page = column_sums_of_rows(base, products, sums).withColumn("kind", F.lit("column sum")).unionByName(page_ratios(base))
    out = row(products, "product").unionByName(row(sums, "sum")).unionByName(near.select("page", "row", F.lit("near").alias("kind"), "terms", "total", F.col("delta").cast(_MONEY).alias("delta")))
    return out.unionByName(page.select("page", none.alias("row"), "kind", "terms", "total", money.alias("delta")))


def cell_grades(cells: DataFrame, found: DataFrame) -> DataFrame:
    """cells with grade: arith if a closure of the page (near ones apart) has the value, dual if the second reading
    (column other) agrees, else none; null where there is no number. found comes from closures."""
    proven = found.where("kind <> 'near'")
    terms = F.when(F.col("kind") == "percentage", F.slice("terms", 1, 1)).when(F.col("kind") == "column sum", F.array().cast(f"array<{_MONEY}>")).otherwise(F.col("terms"))
    proven = proven.select("page", F.explode(F.concat(terms, F.array("total"))).alias("exact")).distinct()
    met = cells.withColumn("exact", F.col("value").cast(_MONEY)).join(proven.withColumn("proven", F.lit(True)), ["page", "exact"], "left")
    grade = F.when(F.col("exact").isNull(), None).when(F.col("proven"), "arith").when(F.col("other").cast(_MONEY) == F.col("exact"), "dual").otherwise("none")
    return met.withColumn("grade", grade).select(*cells.columns, "grade")


def graded_cells(cells: DataFrame, most: int = 128, sizes: DataFrame | None = None, adjacent: bool = False) -> DataFrame:
    """As cell_grades with the closures of all pages; the cells of a page of up to `most` are graded where its closures
    are found, so that neither is stored or joined."""
    long = _long_pages(cells, most, sizes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [cells.schema["page"], *(f for f in cells.schema if f.name != "page")])
    names = ["page", *(c for c in cells.columns if c != "page"), "grade"]
    dual = (F.col("other").cast(_MONEY) == F.col("value").cast(_MONEY)).alias("dual")
    some = not long.isEmpty()
    short = cells.join(long, "page", "left_anti").select(*cells.columns) if some else cells
    pages = _by_page(short, adjacent and not some, dual, *(F.col(c).alias(f"c_{c}") for c in cells.columns if c != "page"))
    out = pages.mapInArrow(lambda batches: grades(batches, names), f"{schema}, grade string").select(*cells.columns, "grade")
    alone = cells.where("page is null")
    out = out.unionByName(alone.withColumn("grade", F.when(F.col("value").isNull(), None).when(dual, "dual").otherwise("none")))
    if some:
        rest = cells.join(long, "page", "left_semi").select(*cells.columns)
        out = out.unionByName(cell_grades(rest, stored(_closures_of_long_pages(rest))))
    return out
