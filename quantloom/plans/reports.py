"""Queries on summaries, checks, rules and reshaping (D, J, L and M of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import checks, report, reshape, rules
from quantloom.operators.taxonomy import Routing, Target, Taxonomy, candidates, classify, route
from quantloom.plans.registry import query
from quantloom.sources.fixtures import table
from quantloom.sources.lists import labelled, union_by_header
from quantloom.sources.scratch import scratch_path, stored


@query("a1_read_lists", "SELECT 'one' AS list_id, p_partkey AS code, p_name AS descr, CAST(p_size AS DOUBLE) AS qty FROM part UNION ALL SELECT 'two', l_partkey, l_returnflag, l_quantity FROM lineitem")
def a1(spark, sf_dir):
    one = labelled(table(spark, sf_dir, "part").withColumn("q", F.col("p_size").cast("double")), "one", {"code": "p_partkey", "descr": "p_name", "qty": "q"})
    return one.unionByName(labelled(table(spark, sf_dir, "lineitem"), "two", {"code": "l_partkey", "descr": "l_returnflag", "qty": "l_quantity"}))


@query("a2_union_by_header", """
SELECT 'x' AS list_id, o_orderkey AS No, o_orderpriority AS Description, o_totalprice AS Amount, o_orderstatus AS Remark FROM orders
UNION ALL SELECT 'y', c_custkey, c_name, c_acctbal, NULL FROM customer
""")
def a2(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("No"), F.col("o_orderpriority").alias("Description"), F.col("o_totalprice").alias("Amount"), F.col("o_orderstatus").alias("Remark"))
    y = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("no"), F.col("c_name").alias("Item"), F.col("c_acctbal").alias("Total Price"))
    return union_by_header([("x", x), ("y", y), ("sum", x)], [{"amount", "total", "total price"}], skip=("sum",))


@query("d5_grade_quantities", "SELECT p_brand AS code, regexp_extract(p_type, '^([A-Z]+)', 1) AS grade, sum(CAST(p_size AS BIGINT)) AS qty, count(*) AS n FROM part WHERE regexp_matches(p_type, '^[A-Z]') GROUP BY 1, 2".replace("sum(CAST(p_size AS BIGINT)) AS qty", "CAST(sum(p_size) AS BIGINT) AS qty"))
def d5(spark, sf_dir):
    return report.grade_quantities(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "code"), "code", "p_type", "p_size", "^([A-Z]+)")


@query("d6_group_count", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type")
def d6(spark, sf_dir):
    return report.group_count(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("d7_pattern_summary", """
SELECT p_brand, p_type, count(*) AS n, string_agg(CASE WHEN k <= 3 THEN p_name END, '|' ORDER BY k) AS samples FROM
(SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part) GROUP BY p_brand, p_type
""")
def d7(spark, sf_dir):
    return report.pattern_summary(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey", "p_name").withColumn("samples", F.array_join("samples", "|"))


_RESULTS = """
SELECT p_partkey, p_brand, CASE p_partkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'none' WHEN 3 THEN 'estimated' ELSE 'low' END AS status,
       CASE WHEN p_partkey % 5 = 2 THEN 0 ELSE p_retailprice END AS price, CAST(p_size AS DOUBLE) AS qty, CAST(p_partkey % 100 AS DOUBLE) AS score FROM part
"""


def _results(spark, sf_dir):
    k = F.col("p_partkey") % 5
    status = F.when(k == 0, "high").when(k == 1, "medium").when(k == 2, "none").when(k == 3, "estimated").otherwise("low")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", status.alias("status"), F.when(k == 2, 0.0).otherwise(F.col("p_retailprice")).alias("price"), F.col("p_size").cast("double").alias("qty"), (F.col("p_partkey") % 100).cast("double").alias("score"))


@query("d8_pricing_coverage", f"""
WITH r AS ({_RESULTS}) SELECT p_brand, count(*) AS items, count(*) FILTER (status <> 'none') AS matched, count(*) FILTER (price > 0) AS priced,
  round(sum(CASE WHEN price > 0 THEN price * qty END), 2) AS amount, round(count(*) FILTER (status <> 'none') * 100.0 / count(*), 1) AS coverage FROM r GROUP BY ROLLUP (p_brand)
""")
def d8(spark, sf_dir):
    return report.pricing_coverage(_results(spark, sf_dir), "p_brand").withColumns({"amount": F.round("amount", 2), "coverage": F.col("coverage").cast("double")})


@query("d9_match_quality", f"""
WITH r AS ({_RESULTS}) SELECT p_brand, count(*) FILTER (status = 'high') AS high, count(*) FILTER (status = 'low') AS low, count(*) FILTER (status = 'none') AS none,
  count(*) FILTER (score >= 90) AS b90, count(*) FILTER (score >= 60 AND score < 90) AS b60, count(*) FILTER (score >= 30 AND score < 60) AS b30, count(*) FILTER (score < 30) AS b0,
  round(avg(score), 6) AS avg_score, min(score) AS min_score, max(score) AS max_score FROM r GROUP BY p_brand
""")
def d9(spark, sf_dir):
    return report.match_quality(_results(spark, sf_dir).withColumnRenamed("status", "verdict"), "p_brand", ["high", "low", "none"])


@query("d10_comparison_summary", """
WITH m AS (SELECT coalesce(a.unit, b.unit) AS unit, a.qty AS a, b.qty AS b, abs(a.qty - b.qty) AS diff FROM boq_a a FULL JOIN boq_b b ON a.code = b.code)
SELECT unit, count(a) AS a_items, count(b) AS b_items, count(*) FILTER (diff > 100) AS over, count(*) FILTER ((a IS NULL) <> (b IS NULL)) AS alone FROM m GROUP BY unit
""")
def d10(spark, sf_dir):
    a = table(spark, sf_dir, "boq_a").select("code", F.col("unit").alias("ua"), F.col("qty").alias("a_qty"))
    b = table(spark, sf_dir, "boq_b").select("code", F.col("unit").alias("ub"), F.col("qty").alias("b_qty"))
    rows = a.join(b, "code", "full").withColumns({"unit": F.coalesce("ua", "ub"), "diff": F.abs(F.col("a_qty") - F.col("b_qty"))})
    return report.comparison_summary(rows, "unit", ["a", "b"], 100)


@query("d11_control_totals", """
WITH s AS (SELECT l_suppkey, sum(l_quantity) AS q, sum(l_extendedprice) AS a FROM lineitem GROUP BY l_suppkey), o AS (SELECT l_suppkey, sum(l_quantity) AS q, sum(l_extendedprice) AS a FROM lineitem WHERE NOT (l_suppkey % 4 = 0 AND l_linenumber = 1) GROUP BY l_suppkey)
SELECT s.l_suppkey, round(s.q, 2) AS src_qty, round(s.a, 2) AS src_amount, round(o.q, 2) AS out_qty, round(o.a, 2) AS out_amount, CASE WHEN abs(s.q - o.q) < 0.01 AND abs(s.a - o.a) < 0.01 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s JOIN o USING (l_suppkey)
""")
def d11(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amount"))
    out = report.control_totals(line, line.where("not (l_suppkey % 4 = 0 and l_linenumber = 1)"), "l_suppkey")
    return out.select("l_suppkey", *(F.round(c, 2).alias(c) for c in ("src_qty", "src_amount", "out_qty", "out_amount")), "verdict")


@query("d14_term_frequency", """
SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) WHERE term NOT IN ('the', 'and', 'for') GROUP BY term ORDER BY n DESC, term LIMIT 50
""")
def d14(spark, sf_dir):
    return report.term_frequency(table(spark, sf_dir, "documents"), "text", ["the", "and", "for"], 50)


@query("d15_session_stats", """
SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns,
       count(*) FILTER (regexp_matches(text, '(?i)error|fail|of the')) AS errors, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id
""")
def d15(spark, sf_dir):
    return report.session_stats(table(spark, sf_dir, "conversations"), "(?i)error|fail|of the")


@query("d15_session_findings", """
WITH u AS (SELECT conv_id, turn, unnest(regexp_extract_all(coalesce(text, ''), '(error|fail|the|de|of|un) ', 1)) AS name, generate_subscripts(regexp_extract_all(coalesce(text, ''), '(error|fail|the|de|of|un) ', 1), 1) AS place FROM conversations),
t AS (SELECT conv_id, name, count(*) AS n, min({'t': turn, 'a': place}) AS first FROM u GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS nth FROM t),
b AS (SELECT conv_id, trim(substr(text, 1, 200)) AS said, min(turn) AS turn FROM conversations WHERE role = 'assistant' AND regexp_matches(text, 'error|ab|the th') GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, said) AS nth FROM b)
SELECT c.conv_id, coalesce((SELECT string_agg(concat(name, ':', n), '|' ORDER BY nth) FROM k WHERE k.conv_id = c.conv_id AND nth <= 5), '') AS tools,
  coalesce((SELECT string_agg(said, '|' ORDER BY nth) FROM p WHERE p.conv_id = c.conv_id AND nth <= 3), '') AS pitfalls, count(*) FILTER (role = 'assistant') > 0 AND c.conv_id NOT IN (SELECT conv_id FROM b) AS smooth FROM conversations c GROUP BY c.conv_id
""")
def d15_findings(spark, sf_dir):
    found = report.session_findings(table(spark, sf_dir, "conversations"), "(error|fail|the|de|of|un) ", "error|ab|the th")
    return found.withColumns({c: F.array_join(c, "|") for c in ("tools", "pitfalls")})


@query("d16_nested_tree", """
SELECT n_regionkey, string_agg(concat(n_name, ':', names), ';' ORDER BY n_name) AS tree FROM (
  SELECT n_regionkey, n_name, string_agg(s_name, ',' ORDER BY s_name) AS names FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey, n_name) GROUP BY n_regionkey
""")
def d16(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    tree = report.nested_tree(rows, "n_regionkey", "n_name", "s_name")
    return tree.select("n_regionkey", F.array_join(F.transform("sections", lambda s: F.concat(s["section"], F.lit(":"), F.array_join(s["items"], ","))), ";").alias("tree"))


@query("d17_price_sheet_groups", """
WITH s AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type) AS c FROM part)
SELECT p_brand, p_type, CASE WHEN c > 8 THEN p_size END AS p_size, count(*) AS n, CASE p_brand WHEN 'Brand#33' THEN 1 WHEN 'Brand#11' THEN 2 ELSE 99 END AS pos FROM s GROUP BY 1, 2, 3, 5
""")
def d17(spark, sf_dir):
    return report.price_sheet_groups(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_size", 8, ["Brand#33", "Brand#11"]).withColumn("pos", F.col("pos").cast("int"))


@query("d18_duplicate_report", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def d18(spark, sf_dir):
    return report.duplicate_report(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("d20_quote_dashboard", """
SELECT CASE WHEN name LIKE '%red%' THEN 'red' WHEN name LIKE '%gear%' THEN 'gear' ELSE 'rest' END AS section, count(*) AS quotes, count(*) FILTER (price > 500) AS priced, count(DISTINCT supplier) AS origins FROM rates GROUP BY 1
""")
def d20(spark, sf_dir):
    quotes = table(spark, sf_dir, "rates").select("name", F.when(F.col("price") > 500, F.col("price")).alias("price"), F.col("supplier").alias("origin"))
    section = F.when(F.col("name").contains("red"), "red").when(F.col("name").contains("gear"), "gear").otherwise("rest")
    return report.quote_dashboard(quotes, section)


@query("d20_quote_totals", """
WITH q AS (SELECT CASE WHEN name LIKE '%red%' THEN 0 WHEN name LIKE '%gear%' THEN 1 ELSE 2 END AS pos, specialty AS origin, price FROM rates)
SELECT CAST(grouping_id(pos, origin) AS INTEGER) AS level, pos, CASE pos WHEN 0 THEN 'red' WHEN 1 THEN 'gear' WHEN 2 THEN 'rest' END AS section, origin, count(*) AS quotes, count(*) FILTER (price > 500) AS priced, count(*) - count(*) FILTER (price > 500) AS unpriced FROM q GROUP BY ROLLUP (pos, origin)
""")
def d20_totals(spark, sf_dir):
    quotes = table(spark, sf_dir, "rates").select("name", F.when(F.col("price") > 500, F.col("price")).alias("price"), F.col("specialty").alias("origin"))
    return report.quote_totals(quotes, [("red", F.col("name").contains("red")), ("gear", F.col("name").contains("gear"))], "rest")


def _grid(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    counts = part.groupBy("p_brand", "p_type").pivot("p_size", list(range(1, 51))).count()
    body = counts.select("p_brand", F.expr("cast(2 + ascii(p_type) as int)").alias("row"), F.array("p_type", *(F.coalesce(F.col(str(i)).cast("string"), F.lit("")) for i in range(1, 51))).alias("cells"))
    brands = part.select("p_brand").distinct()
    heads = brands.select("p_brand", F.lit(0).alias("row"), F.array(F.lit("name"), *(F.lit(str(10000 + i)) for i in range(1, 51))).alias("cells"))
    attributes = brands.select("p_brand", F.lit(1).alias("row"), F.array(F.lit(""), *(F.lit(f"size {i}") for i in range(1, 51))).alias("cells"))
    return body.unionByName(heads).unionByName(attributes)


@query("j1_grid_to_long", """
SELECT p_brand, CAST(2 + ascii(p_type) AS INTEGER) AS row, CAST(10000 + p_size AS VARCHAR) AS code, concat('size ', p_size) AS attribute, p_type AS name, CAST(count(*) AS VARCHAR) AS value FROM part GROUP BY p_brand, p_type, p_size
""")
def j1(spark, sf_dir):
    return reshape.grid_to_long(_grid(spark, sf_dir), "p_brand")


def _moved_grid(spark, sf_dir):
    """Sheets whose name, unit and code columns stand in another order by brand."""
    part = table(spark, sf_dir, "part")
    counts = part.groupBy("p_brand", "p_type").pivot("p_size", list(range(1, 51))).count()
    kind = F.expr("ascii(substr(p_brand, 7, 1)) % 3")

    def laid(rows, row, name, unit, code, values):
        order = F.when(kind == 0, F.array(name, unit, code)).when(kind == 1, F.array(code, name, unit)).otherwise(F.array(unit, code, name))
        return rows.select("p_brand", row.cast("int").alias("row"), F.concat(F.array(F.lit("1")), order, F.array(*values)).alias("cells"))

    lit, sizes, brands = F.lit, range(1, 51), part.select("p_brand").distinct()
    out = laid(counts, F.expr("3 + ascii(p_type)"), F.col("p_type"), F.when(F.expr("ascii(p_type) % 2 = 0"), "kg").otherwise("m2"), F.expr("cast(10000000000 + ascii(p_type) as string)"), [F.coalesce(F.col(str(i)).cast("string"), lit("")) for i in sizes])
    out = out.unionByName(laid(brands, lit(0), lit("item"), lit(""), lit(""), [lit(str(10000 + i)) for i in sizes]))
    out = out.unionByName(laid(brands, lit(1), lit(""), lit(""), lit(""), [lit("sizes" if i < 30 else "") for i in sizes]))
    return out.unionByName(laid(brands, lit(2), lit(""), lit(""), lit(""), [lit("small" if i <= 25 else "large") for i in sizes]))


@query("j1_read_grid", """
WITH n AS (SELECT p_brand, p_type, p_size, CAST(count(*) AS VARCHAR) AS v FROM part GROUP BY 1, 2, 3), s AS (SELECT CAST(unnest(range(1, 51)) AS BIGINT) AS i), k AS (SELECT DISTINCT p_brand, p_type FROM part)
SELECT k.p_brand, CAST(3 + ascii(k.p_type) AS INTEGER) AS row, CAST(10000 + i AS VARCHAR) AS norm_code, CASE WHEN i <= 25 THEN 'sizes|small' ELSE 'sizes|large' END AS attributes, k.p_type AS name,
  CASE WHEN ascii(k.p_type) % 2 = 0 THEN 'kg' ELSE 'm2' END AS unit, CAST(10000000000 + ascii(k.p_type) AS VARCHAR) AS code, coalesce(v, '') AS value
FROM k CROSS JOIN s LEFT JOIN n ON n.p_brand = k.p_brand AND n.p_type = k.p_type AND n.p_size = i
""")
def j1_read(spark, sf_dir):
    return reshape.read_grid(stored(_moved_grid(spark, sf_dir)), "p_brand").withColumn("attributes", F.array_join("attributes", "|"))


@query("j2_fill_spans", """
WITH c AS (SELECT CAST(p_partkey / 100 AS BIGINT) AS s, p_partkey FROM part)
SELECT p_partkey // 100 AS sheet, p_partkey % 100 AS row, CAST(0 AS INTEGER) AS col, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE (SELECT p_name FROM part b WHERE b.p_partkey = part.p_partkey - part.p_partkey % 5) END AS value FROM part
""".replace("WITH c AS (SELECT CAST(p_partkey / 100 AS BIGINT) AS s, p_partkey FROM part)\n", ""))
def j2(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.expr("p_partkey div 100").alias("sheet"), (F.col("p_partkey") % 100).alias("row"), F.lit(0).alias("col"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).alias("value"))
    spans = part.where("row % 5 = 0").select("sheet", F.col("row").alias("r1"), F.col("col").alias("c1"), (F.col("row") + 4).alias("r2"), F.col("col").alias("c2"))
    return reshape.fill_spans(part, spans)


_YEARS = [str(y) for y in range(1992, 2002)]


@query("j3_indicator_long", "SELECT o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS period, round(sum(o_totalprice), 2) AS value FROM orders WHERE year(o_orderdate) BETWEEN 1992 AND 2001 GROUP BY 1, 2")
def j3(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")).groupBy("o_orderpriority").pivot("y", [int(y) for y in _YEARS]).agg(F.round(F.sum("o_totalprice"), 2))
    return reshape.indicator_long(wide, "o_orderpriority", _YEARS)


@query("j4_derived_growth", """
WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC) AS k FROM y),
p AS (SELECT o_custkey, max(v) FILTER (k = 1) AS a, max(v) FILTER (k = 4) AS b, max(v) FILTER (k = 6) AS c FROM n GROUP BY o_custkey)
SELECT o_custkey, round(CASE WHEN b > 0 THEN pow(a / b, 1.0::DOUBLE / 3) - 1 END, 8) AS cagr3, round(CASE WHEN c > 0 THEN pow(a / c, 0.2::DOUBLE) - 1 END, 8) AS cagr5 FROM p
""")
def j4(spark, sf_dir):
    long = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    return reshape.derived_growth(long, "o_custkey", "y", "v").select("o_custkey", F.round("cagr3", 8).alias("cagr3"), F.round("cagr5", 8).alias("cagr5"))


@query("j5_expand_variants", """
WITH g AS (SELECT DISTINCT p_partkey AS norm_id, concat('S', p_size % 3) AS grade, concat('S', (p_size + p_partkey) % 3) AS ng FROM part)
SELECT c.norm_id, concat('N', c.norm_id, 'c', ng) AS code, CASE WHEN contains(concat(c.class, ' ', CASE WHEN l_linenumber % 2 = 0 THEN grade ELSE 'any' END), grade) THEN concat(c.class, ' ', ng) ELSE concat(c.class, ' any') END AS resource, amount
FROM consumption c JOIN g ON g.norm_id = c.norm_id WHERE ng <> grade
""")
def j5(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    grade = F.concat(F.lit("S"), F.col("p_size") % 3)
    norms = part.select(F.col("p_partkey").alias("norm_id"), F.concat(F.lit("N"), "p_partkey").alias("code"), grade.alias("grade"))
    wanted = part.select(F.col("p_partkey").alias("norm_id"), F.concat(F.lit("S"), (F.col("p_size") + F.col("p_partkey")) % 3).alias("new_grade"))
    use = table(spark, sf_dir, "consumption").join(norms.select("norm_id", F.col("grade").alias("g")), "norm_id")
    use = use.select("norm_id", F.concat_ws(" ", "class", F.when(F.col("l_linenumber") % 2 == 0, F.col("g")).otherwise("any")).alias("resource"), "amount")
    return reshape.expand_variants(norms, use, wanted)


@query("j7_dispatch", """
SELECT p_partkey, CASE WHEN a = 0 AND b = 0 THEN 'no-match' WHEN a >= b THEN 'alpha' ELSE 'beta' END AS worker FROM (SELECT p_partkey, CAST(p_name LIKE '%red%' AS INTEGER) + CAST(p_name LIKE '%gear%' AS INTEGER) AS a,
  CAST(p_name LIKE '%ring%' AS INTEGER) + CAST(p_name LIKE '%new%' AS INTEGER) AS b FROM part)
""")
def j7(spark, sf_dir):
    return rules.dispatch(table(spark, sf_dir, "part"), "p_name", [("alpha", ["red", "gear"]), ("beta", ["ring", "new"])]).select("p_partkey", "worker")


_RULES = [(1, "ring", "seal"), (2, "red", "paint"), (3, "gear", "drive"), (4, "new", "fresh")]


@query("l1_first_match", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\\bring\\b') THEN 'seal' WHEN regexp_matches(p_name, '\\bred\\b') THEN 'paint' WHEN regexp_matches(p_name, '\\bgear\\b') THEN 'drive' WHEN regexp_matches(p_name, '\\bnew\\b') THEN 'fresh' ELSE 'other' END AS label FROM part")
def l1(spark, sf_dir):
    return rules.first_match(table(spark, sf_dir, "part"), "p_name", spark.createDataFrame(_RULES, "priority int, word string, label string"), "p_partkey", "other").select("p_partkey", "label")


@query("l2_route_rows", """
WITH c AS (SELECT p_brand, count(DISTINCT p_type) AS n FROM part WHERE p_size > 40 GROUP BY p_brand)
SELECT p_partkey, CASE WHEN p_name LIKE '%old%' THEN 'SKIP' WHEN p_size < 3 THEN 'PRELIM' WHEN n IS NULL THEN 'ZERO' WHEN n = 1 THEN 'UNIQUE' WHEN n <= 3 THEN 'LOW' ELSE 'HIGH' END AS route FROM part LEFT JOIN c USING (p_brand)
""")
def l2(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = part.where("p_size > 40").select("p_brand", F.col("p_type").alias("division"))
    return rules.route_rows(part, [("SKIP", F.col("p_name").contains("old")), ("PRELIM", F.col("p_size") < 3)], found, "p_brand").select("p_partkey", "route")


@query("l3_classify_taxonomy", """
SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 'colour' WHEN p_name LIKE '%gear%' THEN 'drive' WHEN p_name LIKE '%bolt%' THEN 'fixing' ELSE 'unresolved' END AS discipline,
  CASE WHEN p_name LIKE 'red%' THEN 'section' WHEN p_name LIKE '%gear%' OR p_name LIKE '%bolt%' THEN 'words' ELSE 'none' END AS source FROM part
""")
def l3(spark, sf_dir):
    return rules.classify_taxonomy(table(spark, sf_dir, "part"), "p_name", [("section", [("^red", "colour")]), ("words", [("gear", "drive"), ("bolt", "fixing")])]).select("p_partkey", "discipline", "source")


_FREE, _PRE = Target("A.07", "drives", "A.07.1", "gears"), "PRELIM"
_TAXONOMY = Taxonomy(
    sections={**{f"Brand#{n}": "A" for n in range(1, 10)}, **{f"Brand#{n}": "B" for n in range(10, 16)}, **{f"Brand#{n}": "D" for n in range(16, 20)}, "Brand#20": _PRE, "Brand#21": "F"},
    information="please share|note:",
    sums=r"allow a provision for the \"(.+)\"\.?\s*$",
    sum_targets={"GEAR": Target("B.01", "sums", discipline="B"), "RING": Target("A.22", "rings", discipline="A")},
    patterns=[(r"hot\s+gear", Target("B.05", "hot gears", discipline="B")), (r"^cold widget$", Target("A.25", "cold", discipline="A"))],
    subsections={"ECONOMY": Target("A.01", "economy"), "PROMO\nof the year": Target("A.29", "promo")},
    keywords={"A": [("gear", _FREE), ("bolt", Target("A.20", "bolts")), ("rod|nut", Target("A.12", "rods"))], "B": [("ring", Target("B.02", "rings"))], "D": [("widget", Target("D.01", "widgets"))]},
    other_keywords="A",
    lent={"D": ("A", ["A.20"], False), "B": ("A", ["A.12"], True)},
    split={"A": (20, 29, "Decoration", "Civil")},
)
_TAXONOMY_ROWS = """
SELECT p_partkey, p_brand AS section, CASE p_partkey % 4 WHEN 0 THEN concat(p_type, ' ', chr(10), 'second line') WHEN 1 THEN p_type END AS subsection,
  CASE p_partkey % 11 WHEN 0 THEN 'Please share the taxes' WHEN 1 THEN 'Allow a provision for the "gear".' WHEN 2 THEN 'allow a provision for the "none"' WHEN 3 THEN NULL WHEN 4 THEN upper(p_name) ELSE p_name END AS descr FROM part
"""


@query("l3_taxonomy", rf"""
WITH r AS ({_TAXONOMY_ROWS}), n AS (SELECT *, coalesce(descr, '') AS t, split_part(coalesce(subsection, ''), chr(10), 1) AS head, CAST(substr(section, 7) AS INTEGER) AS b FROM r),
d AS (SELECT *, CASE WHEN b BETWEEN 1 AND 9 THEN 'A' WHEN b BETWEEN 10 AND 15 THEN 'B' WHEN b BETWEEN 16 AND 19 THEN 'D' WHEN b = 20 THEN 'PRELIM' WHEN b = 21 THEN 'F' END AS di FROM n),
k AS (SELECT *, CASE WHEN di = 'PRELIM' THEN 'PRELIM||rule|' WHEN di IS NULL THEN '||unresolved|' WHEN regexp_matches(t, '(?i)^(please share|note:)') THEN 'INFO||rule|' WHEN upper(regexp_extract(t, '(?i)^allow a provision for the "(.+)"\.?\s*$', 1)) = 'GEAR' THEN 'B.01|sums|provisional_sum|B'
  WHEN regexp_matches(t, '(?i)hot\s+gear') THEN 'B.05|hot gears|pattern|B' WHEN lower(t) = 'cold widget' THEN 'A.25|cold|pattern|A' WHEN trim(head) = 'ECONOMY' THEN 'A.01|economy|subsection|' WHEN trim(head) = 'PROMO' THEN 'A.29|promo|subsection|'
  WHEN di IN ('A', 'F') AND t ILIKE '%gear%' THEN 'A.07|drives|keyword|' WHEN di IN ('A', 'F') AND t ILIKE '%bolt%' THEN 'A.20|bolts|keyword|' WHEN di IN ('A', 'F') AND regexp_matches(lower(t), 'rod|nut') THEN 'A.12|rods|keyword|' WHEN di = 'B' AND t ILIKE '%ring%' THEN 'B.02|rings|keyword|' WHEN di = 'D' AND t ILIKE '%widget%' THEN 'D.01|widgets|keyword|'
  WHEN di = 'D' AND t ILIKE '%gear%' THEN 'A.07|drives|keyword of A|' WHEN di IN ('B', 'D') AND regexp_matches(lower(t), 'rod|nut') THEN 'A.12|rods|keyword of A|' ELSE '||unresolved|' END AS w FROM d),
o AS (SELECT p_partkey, coalesce(nullif(split_part(w, '|', 4), ''), di) AS discipline, split_part(w, '|', 1) AS division, split_part(w, '|', 2) AS name, split_part(w, '|', 3) AS source FROM k)
SELECT p_partkey, discipline, division, name, CASE WHEN division = 'A.07' THEN 'A.07.1' ELSE '' END AS sub, source, division AS sort_key,
  CASE WHEN discipline = 'A' AND regexp_matches(division, '^[A-Z]\.\d') THEN CASE WHEN split_part(division, '.', 2)::INTEGER BETWEEN 20 AND 29 THEN 'Decoration' ELSE 'Civil' END ELSE discipline END AS "group" FROM o
""")
def l3_taxonomy(spark, sf_dir):
    rows = spark.sql(_TAXONOMY_ROWS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return classify(rows, _TAXONOMY).select("p_partkey", "discipline", "division", "name", "sub", "source", "sort_key", "group")


_DIVISIONS = [("A", "A.01", "齿轮 works"), ("A", "A.02", "Ring 环 works"), ("B", "B.01", "螺栓"), ("B", "B.02", "其他"), ("C", "C.01", "小 Widgets"), ("D", "D.01", "齿轮 D")]
_SUBS = [("A", "A.02", "A.02.1", "红环"), ("A", "A.01", "A.01.1", "spur"), ("B", "B.02", "B.02.1", "螺栓 and nuts"), ("B", "B.02", "B.02.2", "misc")]
_GLOSSARY = {"A": [("gear/toothed wheel", ["齿轮"]), ("red ring", ["红环", "环"])], "B": [("bolt", ["螺栓"]), ("nut", ["螺母"])], "C": [("widget", ["WIDGETS"])], "D": [("gear", ["齿轮"])]}
_ROUTER = [("brand#1[0-2]", [("B", None)]), ("brand#2$", [("A", "A.01"), ("A", "nope")]), ("brand#3", [("C", "C.01"), ("D", None)])]
_VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in rows)
_CANDIDATE_SQL = rf"""
dv(book, code, name) AS (VALUES {_VALUES(_DIVISIONS)}), sb(book, code, sub, name) AS (VALUES {_VALUES(_SUBS)}), ro(rx, book, sole) AS (VALUES {_VALUES((rx, *to) for rx, all_to in _ROUTER for to in all_to)}),
gl(entry, book, phrase, local) AS (VALUES {_VALUES((f"{b}{n}", b, p, w) for b, listed in _GLOSSARY.items() for n, (p, words) in enumerate(listed) for w in words)}),
he AS (SELECT DISTINCT grp, entry FROM g JOIN gl ON contains(text, local) OR len(list_filter(string_split_regex(phrase, '[/\s]+'), lambda x: len(x) >= 4 AND regexp_matches(lower(text), concat('\b', x, '\b')))) > 0),
wd AS (SELECT grp, book, lower(local) AS word FROM he JOIN gl USING (entry)), nm AS (SELECT book, code, name FROM dv UNION ALL SELECT book, code, name FROM sb),
al AS (SELECT grp, dv.book, dv.code FROM g JOIN ro ON regexp_matches(path, rx) JOIN dv ON dv.book = ro.book AND (sole IS NULL OR sole = dv.code) UNION SELECT grp, wd.book, code FROM wd JOIN nm ON nm.book = wd.book AND contains(lower(name), word))
"""


def _vocabulary(spark):
    return spark.createDataFrame(_DIVISIONS, "book string, code string, name string"), spark.createDataFrame(_SUBS, "book string, code string, sub string, name string")


@query("c21_divisions_with_subs", f"""
WITH g AS (SELECT DISTINCT p_brand AS grp, lower(p_brand) AS path, p_name AS text FROM part), {_CANDIDATE_SQL}
SELECT grp, book, code, name, coalesce((SELECT string_agg(concat(sub, ':', sb.name), '|' ORDER BY sub) FROM sb WHERE sb.book = al.book AND sb.code = al.code), '') AS subs FROM al JOIN dv USING (book, code)
""")
def c21_with_subs(spark, sf_dir):
    groups = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_brand").alias("path"), F.col("p_name").alias("text"))
    found = candidates(groups, *_vocabulary(spark), _GLOSSARY, _ROUTER)
    return found.withColumn("subs", F.array_join(F.transform("subs", lambda s: F.concat(s["code"], F.lit(":"), s["name"])), "|"))


_ROUTING = Routing(headers=["(?-i)^[A-Z ]+$", "^page "], skip=["^(subtotal|total)\\b", "^note:"], preliminaries=["brand#7", "general"], sums="allow a provision for the (\\w+)", sum_targets=["gear"], patterns=["fire\\s?stop"])
_ROUTE_ROWS = """
SELECT p_partkey AS row_no, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_brand END AS dept1, CASE p_size % 10 WHEN 0 THEN '' ELSE p_type END AS dept2, CASE p_size % 13 WHEN 0 THEN 'Firestopping' WHEN 1 THEN '' END AS dept3,
  CASE p_partkey % 17 WHEN 0 THEN 'Subtotal of it' WHEN 1 THEN '' WHEN 2 THEN 'Allow a provision for the gear' WHEN 3 THEN 'allow a provision for the rest' WHEN 4 THEN NULL WHEN 5 THEN 'Note: bolts' WHEN 6 THEN 'fire stop' ELSE p_name END AS descr FROM part
"""


@query("l2_route_list", rf"""
WITH r AS ({_ROUTE_ROWS.replace("ELSE p_name", "WHEN 7 THEN concat(' ', upper(p_name), ' ') ELSE p_name")}),
n AS (SELECT *, coalesce(descr, '') AS t, lower(concat_ws(' ', nullif(dept1, ''), nullif(dept2, ''))) AS path, coalesce(dept1, '') AS a, coalesce(dept2, '') AS b FROM r),
f AS (SELECT *, t = '' OR regexp_matches(trim(t), '(?i)^page ') OR regexp_matches(trim(t), '^[A-Z ]+$') AS title, contains(path, 'brand#7') OR contains(path, 'general') AS early FROM n),
s AS (SELECT * FROM f WHERE NOT title AND NOT early QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY row_no) <= 15),
g AS (SELECT concat(a, '|', b) AS grp, min(path) AS path, string_agg(descr, ' ' ORDER BY row_no) AS text FROM s GROUP BY 1), {_CANDIDATE_SQL},
c AS (SELECT grp, count(*) AS k FROM al WHERE book IN ('A', 'B', 'C') GROUP BY grp)
SELECT row_no, CASE WHEN title OR regexp_matches(t, '(?i)^((subtotal|total)\b|note:)') THEN 'SKIP' WHEN early THEN 'PRELIM' WHEN t ILIKE 'allow a provision for the gear%' THEN 'SUM' WHEN t ILIKE 'allow a provision for the %' THEN 'PRELIM'
  WHEN regexp_matches(concat_ws(' ', t, dept1, dept2, dept3), '(?i)fire\s?stop') THEN 'PATTERN' WHEN k IS NULL THEN 'ZERO' WHEN k = 1 THEN 'UNIQUE' WHEN k <= 3 THEN 'LOW' ELSE 'HIGH' END AS route FROM f LEFT JOIN c ON grp = concat(a, '|', b)
""")
def l2_list(spark, sf_dir):
    rows = spark.sql(_ROUTE_ROWS.replace("ELSE p_name", "WHEN 7 THEN concat(' ', upper(p_name), ' ') ELSE p_name").replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return route(rows, _ROUTING, *_vocabulary(spark), _GLOSSARY, _ROUTER).select("row_no", "route")


@query("l4_classify_price_rows", """
SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'labour' WHEN p_brand = 'Brand#12' AND p_retailprice >= 950 THEN 'labour' ELSE 'material' END AS class FROM part
""")
def l4(spark, sf_dir):
    category = F.when(F.col("p_brand") == "Brand#11", "Labour").when(F.col("p_brand") == "Brand#12", "month").otherwise("misc")
    return rules.classify_price_rows(table(spark, sf_dir, "part").withColumn("cat", category), "cat", "p_name", "p_retailprice", 950).select("p_partkey", "class")


@query("l5_classify_resource", """
SELECT p_partkey, CASE WHEN p_name = 'red ring' THEN 'known one' WHEN regexp_matches(p_name, 'gear') THEN 'drive' WHEN 3 * CAST(p_name LIKE '%red%' AS INTEGER) + 3 * CAST(p_name LIKE '%new%' AS INTEGER) >= 4 * CAST(p_name LIKE '%bolt%' AS INTEGER) AND (p_name LIKE '%red%' OR p_name LIKE '%new%') THEN 'look'
  WHEN p_name LIKE '%bolt%' THEN 'fixing' ELSE 'general' END AS class FROM part
""")
def l5(spark, sf_dir):
    known = spark.createDataFrame([("Red Ring", "known one")], "name string, class string")
    return rules.classify_resource(table(spark, sf_dir, "part"), "p_name", known, [("gear", "drive")], {"look": ["red", "new"], "fixing": ["bolt"]}, "general").select("p_partkey", "class")


_DECIDED = """CASE WHEN regexp_matches(name, 'gear') THEN 'drive' WHEN 3 * CAST(name LIKE '%red%' AS INTEGER) + 3 * CAST(name LIKE '%new%' AS INTEGER) >= 4 * CAST(name LIKE '%bolt%' AS INTEGER) AND (name LIKE '%red%' OR name LIKE '%new%') THEN 'look'
  WHEN name LIKE '%bolt%' THEN 'fixing' ELSE 'general' END"""


@query("l5_known_names", f"""
WITH a AS (SELECT p_partkey, lower(p_name) AS name, TRUE AS old FROM part UNION ALL SELECT p_partkey, lower(concat(p_type, ' ', p_name)), FALSE FROM part)
SELECT p_partkey, name, {_DECIDED} AS class, CASE WHEN old THEN 'known' WHEN regexp_matches(name, 'gear') THEN 'rule' WHEN regexp_matches(name, 'red|new|bolt') THEN 'tree' ELSE 'default' END AS how FROM a
""")
def l5_known(spark, sf_dir):
    part, base = table(spark, sf_dir, "part"), scratch_path(spark)
    first = part.select("p_partkey", F.lower("p_name").alias("name"))
    config = [("gear", "drive")], {"look": ["red", "new"], "fixing": ["bolt"]}, "general"
    rules.classify_and_remember(first, "name", base, 0, *config)
    both = first.unionByName(part.select("p_partkey", F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("name")))
    return rules.classify_and_remember(both, "name", base, 1, *config)


@query("l6_product_family", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring|gear') THEN 'mech' WHEN regexp_matches(p_name, 'bolt|nut') THEN 'fix' ELSE 'no_family' END AS family, CASE WHEN regexp_matches(p_name, 'ring|gear') THEN 'P1' ELSE 'other' END AS package FROM part")
def l6(spark, sf_dir):
    return rules.product_family(table(spark, sf_dir, "part"), "p_name", [("mech", ["ring", "gear"]), ("fix", ["bolt", "nut"])], {"mech": "P1"}).select("p_partkey", "family", "package")


@query("l7_classify_messages", "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'setup' WHEN regexp_matches(lower(text), 'the (and|of)') THEN 'odd' ELSE 'other' END AS class FROM conversations")
def l7(spark, sf_dir):
    return rules.classify_messages(table(spark, sf_dir, "conversations"), "role", "text", [("subject", "^system$", "setup"), ("body", "the (and|of)", "odd")]).select("conv_id", "turn", "class")


@query("l8_validate_vocab")
def l8(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("v", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("A.1 "), "p_type")).when(F.col("p_partkey") % 7 == 0, F.concat("p_type", F.lit("X"))).otherwise(F.col("p_type")))
    return rules.validate_vocab(part, "v", part.select(F.col("p_type").alias("value")), ["General"]).select("p_partkey", "fixed", "how")


@query("l8_validate_levels")
def l8_levels(spark, sf_dir):
    """Brands and types of parts as two levels, some of them misspelt, coded or of another brand."""
    k = F.col("p_partkey") % 7
    part = table(spark, sf_dir, "part")
    rows = part.withColumns({"c": F.when(k == 0, F.concat(F.lit("A.1 "), "p_brand")).when(k == 1, F.concat(F.lower("p_brand"), F.lit("x"))).otherwise(F.col("p_brand")), "s": F.when(k == 2, F.concat(F.lit("01 "), "p_type")).when(k == 3, F.reverse("p_type")).when(k == 4, "General").when(k == 5, F.lower("p_type")).otherwise(F.col("p_type"))})
    known = part.where("p_size > 5")
    fixed = rules.validate_levels(rows, "c", "s", known.select(F.col("p_brand").alias("value")), known.select(F.col("p_brand").alias("category"), F.col("p_type").alias("value")), ["General"])
    return fixed.select("p_partkey", "category_fixed", "category_how", "sub_fixed", "sub_how")


@query("m1_quality_checks", """
SELECT name, round(metric, 6) AS metric, threshold, metric <= threshold AS passed FROM (
  SELECT 'short name' AS name, avg(CAST(length(p_name) < 8 AS DOUBLE)) AS metric, 0.25::DOUBLE AS threshold FROM part UNION ALL SELECT 'no price', avg(CAST(p_retailprice IS NULL AS DOUBLE)), 0.0 FROM part UNION ALL SELECT 'large', avg(CAST(p_size > 25 AS DOUBLE)), 0.2 FROM part)
""")
def m1(spark, sf_dir):
    return checks.quality_checks(table(spark, sf_dir, "part"), [("short name", F.length("p_name") < 8, 0.25), ("no price", F.col("p_retailprice").isNull(), 0.0), ("large", F.col("p_size") > 25, 0.2)])


@query("m1_orphans", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY l_orderkey")
def m1b(spark, sf_dir):
    return checks.orphans(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0"), "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("m1_sequence_gaps", "SELECT l_orderkey, after, missing FROM (SELECT l_orderkey, l_linenumber AS after, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - l_linenumber - 1 AS missing FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE missing > 0")
def m1c(spark, sf_dir):
    return checks.sequence_gaps(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("m2_validate_units", "SELECT p_type, count(*) AS n, regexp_matches(p_type, '^(?:[A-Z]{1,5})$|^(?:PROMO)$') AS valid FROM part GROUP BY p_type")
def m2(spark, sf_dir):
    return checks.validate_units(table(spark, sf_dir, "part"), "p_type", ["[A-Z]{1,5}", "PROMO"])


@query("m3_mapping_precheck", """
WITH p AS (SELECT p_brand, CASE WHEN p_partkey % 20 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN 'zzz' ELSE p_type END AS v FROM part),
g AS (SELECT p_brand, count(*) AS n, count(*) FILTER (v IS NULL) AS unmapped, count(*) FILTER (v = 'zzz') AS unknown FROM p GROUP BY p_brand)
SELECT *, round(1 - (unmapped + unknown) / n, 6) AS coverage, unknown = 0 AND round(1 - (unmapped + unknown) / n, 6) >= 0.9 AS passed FROM g
""")
def m3(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    v = F.when(F.col("p_partkey") % 20 == 0, None).when(F.col("p_partkey") % 31 == 0, "zzz").otherwise(F.col("p_type"))
    return checks.mapping_precheck(part.withColumn("v", v), part.select(F.col("p_type").alias("value")), "p_brand", "v")


@query("m4_row_closure", """
WITH i AS (SELECT *, floor(a * b * 100 + 0.5) / 100 AS implied FROM item_cells)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN abs(c - implied) < 0.015 THEN 'arith' WHEN abs(c - implied) <= 0.005 * abs(implied) THEN 'near' ELSE 'none' END AS grade FROM i
""")
def m4(spark, sf_dir):
    return checks.row_closure(table(spark, sf_dir, "item_cells")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "grade")


@query("m5_same_content_pairs", """
WITH s AS (SELECT page_id AS id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://(m\\.|blog\\.)?', ''), '[?#].*$', ''), '/[^/]*$', '') AS stem FROM pages),
a AS (SELECT * FROM s WHERE id % 2 = 0), b AS (SELECT * FROM s WHERE id % 2 = 1)
SELECT a.id AS id_a, b.id AS id_b FROM a JOIN b ON (contains(b.stem, a.stem) OR contains(a.stem, b.stem)) WHERE length(a.stem) >= 8 AND length(b.stem) >= 8
""")
def m5(spark, sf_dir):
    stem = F.regexp_replace(F.regexp_replace("url", r"^https?://(m\.|blog\.)?", ""), r"[?#].*$", "")
    stem = F.regexp_replace(stem, r"/[^/]*$", "")
    s = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), stem.alias("stem"))
    return checks.same_content_pairs(s.where("id % 2 = 0"), s.where("id % 2 = 1"))


@query("m6_duplicate_messages", """
SELECT event_id, user_id, event_type FROM (SELECT *, max(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) AS m FROM events) WHERE value > 50 OR m = 0
""")
def m6(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumns({"day": F.to_date("ts"), "stable": F.when(F.col("value") > 50, F.col("event_id"))})
    return checks.duplicate_messages(events, ["user_id", "event_type", "day"], "stable").select("event_id", "user_id", "event_type")


@query("m7_conservation_check", """
SELECT count(*) AS rows_before, count(*) FILTER (unit IS NOT NULL AND qty IS NOT NULL) AS leaves_before, count(*) FILTER (unit IS NOT NULL AND qty IS NOT NULL AND descr IS NULL) AS blank_before,
  count(*) FILTER (row_no % 50 <> 4) AS rows_after, count(*) FILTER (row_no % 50 <> 4 AND unit IS NOT NULL AND qty IS NOT NULL) AS leaves_after, count(*) FILTER (row_no % 50 <> 4 AND unit IS NOT NULL AND qty IS NOT NULL AND descr IS NULL) AS blank_after,
  count(*) FILTER (row_no % 50 = 4 AND descr IS NOT NULL) AS changed, count(*) = count(*) FILTER (row_no % 50 <> 4) AS passed FROM outline
""")
def m7(spark, sf_dir):
    before = table(spark, sf_dir, "outline")
    return checks.conservation_check(before, before.where("row_no % 50 <> 4"), "row_no", "descr")


@query("m8_recall_check", """
WITH g AS (SELECT supplier, count(*) AS priced, count(*) FILTER (length(rate_id) % 7 = 0) AS missed FROM rates WHERE price > 0 GROUP BY supplier)
SELECT *, round(1 - missed / priced, 6) AS recall, round(1 - missed / priced, 6) >= 0.85 AS passed FROM g
""")
def m8(spark, sf_dir):
    rates = table(spark, sf_dir, "rates")
    return checks.recall_check(rates, rates.where("length(rate_id) % 7 <> 0"), "rate_id", "supplier")


@query("m9_data_row_checks", """
WITH d AS (SELECT p_brand, p_partkey AS row, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS c0, CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE p_name END AS c1,
  CASE WHEN p_size > 45 THEN NULL ELSE 'x' END AS c2, CASE WHEN p_size * 2 > 100 - ascii(substr(p_brand, 7, 1)) % 5 * 10 THEN 'x' ELSE '' END AS c3 FROM part)
SELECT p_brand, 'empty row' AS check, row AS at FROM d WHERE trim(c0) = '' AND trim(c1) = '' UNION ALL SELECT p_brand, 'no number', row FROM d WHERE NOT regexp_matches(c0, '^\s*\d')
UNION ALL SELECT p_brand, 'sparse column', 2 FROM d GROUP BY p_brand HAVING count(*) FILTER (coalesce(c2, '') = '') > 0.8 * count(*) UNION ALL SELECT p_brand, 'sparse column', 3 FROM d GROUP BY p_brand HAVING count(*) FILTER (c3 = '') > 0.8 * count(*)
""")
def m9_rows(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    line = F.array(F.when(k % 3 == 0, "").otherwise(k.cast("string")), F.when(k % 6 == 0, " ").otherwise(F.col("p_name")), F.when(size <= 45, "x"), F.when(size * 2 > 100 - F.expr("ascii(substr(p_brand, 7, 1))") % 5 * 10, "x").otherwise(""))
    cells = table(spark, sf_dir, "part").select("p_brand", k.alias("row"), F.posexplode(line).alias("col", "value"))
    return checks.data_row_checks(cells, "p_brand", "row", "col", "value", [0, 1], 0)


@query("m9_table_shape_checks")
def m9(spark, sf_dir):
    cells = _grid(spark, sf_dir).where("row > 1").select("p_brand", "row", F.posexplode("cells").alias("col", "value"))
    return checks.table_shape_checks(cells, "p_brand", "row", "col", "value")
