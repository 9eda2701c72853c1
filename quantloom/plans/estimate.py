"""Queries on ordered rows, hierarchies and rankings (E, F and K of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import hierarchy, ordered
from quantloom.plans.registry import query
from quantloom.sources.fixtures import table

_HEADS = "regexp_extract(descr, '^【(.*)】$', 1) AS a, regexp_extract(descr, '^《(.*)》$', 1) AS b, regexp_extract(descr, '^[{](.*)[}]$', 1) AS c"
_FILLED = f"""
h AS (SELECT *, {_HEADS} FROM outline),
g AS (SELECT *, count(nullif(a, '')) OVER (ORDER BY row_no) AS s1, count(nullif(a, '')) OVER (ORDER BY row_no) + count(nullif(b, '')) OVER (ORDER BY row_no) AS s2 FROM h),
o AS (SELECT *, max(nullif(a, '')) OVER (PARTITION BY s1) AS l1, max(nullif(b, '')) OVER (PARTITION BY s2) AS l2,
             last_value(nullif(c, '') IGNORE NULLS) OVER (PARTITION BY s2 ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS l3 FROM g)
"""
_BLOCK = 800000000


@query("e1_forward_fill_context", f"WITH {_FILLED} SELECT row_no, descr, unit, qty, l1, l2, l3 FROM o")
def e1(spark, sf_dir):
    df = table(spark, sf_dir, "outline")
    return ordered.forward_fill_context(df, [], "row_no", *ordered.heading_columns("descr"), block=_BLOCK)


@query("e2_classify_outline", f"""
WITH {_FILLED} SELECT row_no, CASE WHEN a <> '' THEN 'group' WHEN b <> '' THEN 'section' WHEN unit IS NOT NULL AND qty IS NOT NULL THEN 'item' ELSE 'note' END AS kind, l1 AS grp,
  last_value(nullif(b, '') IGNORE NULLS) OVER (ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS section FROM o
""")
def e2(spark, sf_dir):
    return ordered.classify_outline(table(spark, sf_dir, "outline"), [], "row_no", _BLOCK).select("row_no", "kind", "grp", "section")


@query("e3_fill_description_down", "SELECT row_no, last_value(descr IGNORE NULLS) OVER (ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS filled, qty FROM outline")
def e3(spark, sf_dir):
    return ordered.carried(table(spark, sf_dir, "outline"), [], "row_no", {"filled": F.col("descr")}, _BLOCK).select("row_no", "filled", "qty")


@query("e4_inherit_previous", """
WITH l AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS n, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag END AS u, CASE WHEN l_partkey % 5 = 0 THEN 'rule' END AS r FROM lineitem),
k AS (SELECT *, coalesce(u, r) AS k, last_value(coalesce(u, r) IGNORE NULLS) OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM l)
SELECT l_orderkey, n, l_suppkey, coalesce(k, p) AS filled, CASE WHEN u IS NOT NULL THEN 'own' WHEN k IS NOT NULL THEN 'rule' WHEN p IS NOT NULL THEN 'previous' ELSE 'none' END AS method FROM k
""")
def e4(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("n"), "l_suppkey", F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag")).alias("u"), F.col("l_partkey"))
    return ordered.inherit_previous(line, ["l_orderkey", "l_suppkey"], "n", "u", F.when(F.col("l_partkey") % 5 == 0, "rule")).select("l_orderkey", "n", "l_suppkey", "filled", "method")


@query("e5_context_window", """
SELECT conv_id, turn, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before,
       list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS after FROM conversations WHERE length(trim(text)) > 0
""".replace("SELECT conv_id, turn, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before,\n       list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS after", "SELECT conv_id, turn, coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS after"))
def e5(spark, sf_dir):
    out = ordered.context_window(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return out.select("conv_id", "turn", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query("e6_balanced_batches", """
SELECT l_suppkey, batch, count(*) AS n, min(k) AS first_key, max(k) AS last_key FROM (
  SELECT l_suppkey, k, CAST(floor((row_number() OVER (PARTITION BY l_suppkey ORDER BY k) - 1) / ceil(count(*) OVER (PARTITION BY l_suppkey) / 7.0)) AS BIGINT) AS batch
  FROM (SELECT l_suppkey, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS k FROM lineitem)) GROUP BY l_suppkey, batch
""")
def e6(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("k"))
    return ordered.balanced_batches(rows, ["l_suppkey"], "k", 7).groupBy("l_suppkey", "batch").agg(F.count("*").alias("n"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))


@query("e7_pack_sections")
def e7(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("doc_id", "line", F.length("t").alias("size"))
    return ordered.pack_sections(sizes, "doc_id", "line", "size", 400, 1200).groupBy("doc_id", "chunk").agg(F.sum("size").alias("chars"), F.count("*").alias("lines"))


@query("e8_infer_levels", f"""
WITH o AS (SELECT row_no, trim(coalesce(descr, '')) AS t, trim(coalesce(code, '')) AS code, unit, qty FROM drawn_outline),
f AS (SELECT row_no, t, CASE WHEN t = '' THEN 'L4' WHEN unit IS NOT NULL AND qty IS NOT NULL THEN 'L4' WHEN regexp_matches(t, '{ordered._PAGINATION.replace("'", "''")}') THEN 'Note' WHEN regexp_matches(t, '{ordered._PREAMBLE}') THEN 'Note'
  WHEN regexp_matches(t, '{ordered._NUMBERED_TITLE}') THEN 'L1' WHEN contains(t, '【') THEN 'L1' WHEN regexp_matches(code, '^\\d+\\.0$') THEN 'L2' WHEN regexp_matches(code, '^[A-Z]\\.\\d+') THEN 'L3'
  WHEN regexp_matches(t, '^\\d+\\.\\d+\\s+\\w') THEN 'Note' WHEN regexp_matches(t, '[一-鿿]') THEN 'Note'
  WHEN NOT regexp_matches(t, '{ordered._EXPLAINING}') AND NOT regexp_matches(t, '[.。;；]$') AND length(t) <= 60 AND len(regexp_extract_all(t, '\\S+')) <= 10 THEN 'L3' ELSE 'Note' END AS first FROM o),
g AS (SELECT *, first_value(CASE WHEN first IN ('L1', 'L2') OR starts_with(t, '《') OR contains(t, '【') THEN 'b' WHEN first = 'L3' AND starts_with(t, '{{') THEN 'L3' WHEN first = 'L4' THEN 'L4' END IGNORE NULLS)
  OVER (ORDER BY row_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM f),
h AS (SELECT *, CASE WHEN first <> 'L3' OR starts_with(t, '{{') THEN first WHEN below = 'L3' THEN 'L2' WHEN below = 'L4' THEN 'L3' ELSE 'Note' END AS second FROM g),
i AS (SELECT *, first_value(CASE WHEN first IN ('L1', 'L2') OR second = 'L2' OR contains(t, '【') THEN 'b' WHEN second IN ('L3', 'L4') THEN second END IGNORE NULLS)
  OVER (ORDER BY row_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM h)
SELECT row_no, CASE WHEN second = 'L3' AND next = 'L3' THEN 'L2' ELSE second END AS level,
  CASE WHEN second = 'L3' AND next = 'L3' THEN 'promoted by child' WHEN first <> 'L3' OR starts_with(t, '{{') THEN 'form' WHEN second = 'L2' THEN 'promoted' WHEN second = 'L3' THEN 'confirmed' ELSE 'demoted' END AS reason FROM i
""")
def e8(spark, sf_dir):
    return ordered.infer_levels(table(spark, sf_dir, "drawn_outline"), [], "row_no").select("row_no", "level", "reason")


@query("e9_rule_levels", """
SELECT row_no, CASE WHEN row_no % 1000 = 4 THEN 'L9' WHEN descr LIKE '【%' THEN 'L1' WHEN descr LIKE '《%' THEN 'L2' WHEN qty IS NOT NULL THEN 'L4' ELSE 'Note' END AS level,
       CASE WHEN row_no % 1000 = 4 THEN 'assigned' WHEN descr LIKE '【%' OR descr LIKE '《%' THEN 'rule' ELSE 'default' END AS how FROM outline
""")
def e9(spark, sf_dir):
    df = table(spark, sf_dir, "outline")
    given = df.where("row_no % 1000 = 4").select("row_no", F.lit("L9").alias("level"))
    return ordered.rule_levels(df, [(F.col("descr").startswith("【"), "L1"), (F.col("descr").startswith("《"), "L2")], given, "row_no").select("row_no", "level", "how")


@query("e10_cluster_by_gap", """
SELECT page, line, count(*) AS n, min(y) AS top, max(y) AS bottom FROM (
  SELECT page, y, CAST(sum(CASE WHEN gap > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, token_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM
  (SELECT *, y - lag(y) OVER (PARTITION BY page ORDER BY y, token_id) AS gap FROM points)) GROUP BY page, line
""")
def e10(spark, sf_dir):
    return ordered.cluster_by_gap(table(spark, sf_dir, "points"), ["page"], "y", "token_id", 30).groupBy("page", "line").agg(F.count("*").alias("n"), F.min("y").alias("top"), F.max("y").alias("bottom"))


_LINES = """
WITH g AS (SELECT page, median(height) * 0.6::DOUBLE AS least FROM type_tokens GROUP BY page),
d AS (SELECT t.*, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y, token_id) > least THEN 1 ELSE 0 END AS fresh FROM type_tokens t JOIN g USING (page)),
n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY page ORDER BY y, token_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM d)
"""


@query("e10_text_lines", f"{_LINES} SELECT page, token_id, line, CAST(row_number() OVER (PARTITION BY page, line ORDER BY x, token_id) AS INTEGER) AS nth FROM n")
def e10_lines(spark, sf_dir):
    return ordered.text_lines(table(spark, sf_dir, "type_tokens"), ["page"], "y", "height", "x", "token_id").select("page", "token_id", "line", "nth")


@query("e10_paragraphs", f"""
{_LINES}, l AS (SELECT page, line, min(y) AS top, max(y + height) AS bottom FROM n GROUP BY page, line),
p AS (SELECT *, top - lag(bottom) OVER (PARTITION BY page ORDER BY line) AS gap FROM l),
m AS (SELECT page, greatest(coalesce(avg(gap) * 1.5::DOUBLE, 0), avg(bottom - top) * 0.5::DOUBLE) AS least FROM p GROUP BY page)
SELECT page, line, CAST(sum(CASE WHEN gap > least THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM p JOIN m USING (page)
""")
def e10_paragraphs(spark, sf_dir):
    lines = ordered.text_lines(table(spark, sf_dir, "type_tokens"), ["page"], "y", "height", "x", "token_id")
    spans = lines.groupBy("page", "line").agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("height")).alias("bottom"))
    return ordered.paragraphs(spans, ["page"], "top", "bottom", "line").select("page", "line", "paragraph")


@query("e11_nearest_code_columns", """
WITH t AS (SELECT page, token_id, x, CASE token_id % 4 WHEN 0 THEN '—' WHEN 1 THEN text ELSE CAST(token_id AS VARCHAR) END AS text FROM type_tokens),
h AS (SELECT page, text AS code, avg(x) AS cx FROM type_tokens GROUP BY page, text)
SELECT page, token_id, code, value FROM (SELECT t.page, token_id, code, TRY_CAST(t.text AS DOUBLE) AS value, row_number() OVER (PARTITION BY t.page, token_id ORDER BY abs(x - cx), cx, code) AS k
  FROM t JOIN h ON t.page = h.page AND abs(x - cx) < 10 WHERE token_id % 4 <> 1) WHERE k = 1
""")
def e11_nearest(spark, sf_dir):
    tokens = table(spark, sf_dir, "type_tokens")
    heads = tokens.groupBy("page", F.col("text").alias("code")).agg(ordered.exact_mean("x").alias("cx"))
    text = F.when(F.col("token_id") % 4 == 0, "—").when(F.col("token_id") % 4 == 1, F.col("text")).otherwise(F.col("token_id").cast("string"))
    return ordered.nearest_code_columns(tokens.withColumn("text", text), heads, ["page"], 10).select("page", "token_id", "code", "value")


@query("e11_assign_to_columns", """
WITH h AS (SELECT page, text AS col, avg(x) AS hx FROM points GROUP BY page, text),
s AS (SELECT *, (lag(hx) OVER w + hx) / 2 AS lo, (lead(hx) OVER w + hx) / 2 AS hi FROM h WINDOW w AS (PARTITION BY page ORDER BY hx, col))
SELECT points.page, s.col AS column, count(*) AS n FROM points LEFT JOIN s ON points.page = s.page AND (lo IS NULL OR x >= lo) AND (hi IS NULL OR x < hi) GROUP BY points.page, s.col
""")
def e11(spark, sf_dir):
    points = table(spark, sf_dir, "points")
    heads = points.groupBy("page", F.col("text").alias("column")).agg(ordered.exact_mean("x").alias("hx"))
    return ordered.assign_to_columns(points, heads, ["page"]).groupBy("page", "column").agg(F.count("*").alias("n"))


@query("e12_chain_continued", """
SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), event_id) AS chain FROM events
""")
def e12(spark, sf_dir):
    return ordered.chain_continued(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "signup").select("event_id", "user_id", "chain")


@query("e13_span_overlap", """
WITH i AS (SELECT l_orderkey, l_linenumber * 3 + l_partkey % 4 AS a, l_linenumber * 3 + l_partkey % 4 + l_suppkey % 3 AS b FROM lineitem),
r AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
k AS (SELECT *, CAST(sum(CASE WHEN a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM r)
SELECT l_orderkey, block, min(a) AS a, max(b) AS b, count(*) AS rows FROM k GROUP BY l_orderkey, block
""")
def e13(spark, sf_dir):
    a = F.col("l_linenumber") * 3 + F.col("l_partkey") % 4
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", a.alias("a"), (a + F.col("l_suppkey") % 3).alias("b"))
    return ordered.merged_intervals(spans, ["l_orderkey"], "a", "b")


@query("e13_span_blocks")
def e13b(spark, sf_dir):
    """All lines as one sheet: the columns that a line fills follow from its numbers; every tenth row or so is empty."""
    a = (F.col("l_linenumber") * 3 + F.col("l_partkey") % 4).cast("int")
    row = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    columns = F.when(F.col("l_partkey") % 10 == 0, F.array().cast("array<int>")).when(F.col("l_suppkey") % 3 == 0, F.array(a)).otherwise(F.array(a, a + 2, a + (F.col("l_suppkey") % 5).cast("int")))
    rows = table(spark, sf_dir, "lineitem").groupBy(row.alias("row")).agg(F.min(columns).alias("columns"))
    return ordered.span_blocks(rows, [], "row", "columns").select("row", "block")


@query("e14_region_ranges", """
SELECT name, start, next FROM (SELECT nullif(regexp_extract(descr, '^[{](.*)[}]$', 1), '') AS name, row_no AS start, lead(row_no) OVER (ORDER BY row_no) AS next FROM outline
WHERE regexp_matches(descr, '^[{].*[}]$') OR regexp_matches(descr, '^《.*》$')) WHERE name IS NOT NULL
""")
def e14(spark, sf_dir):
    _, stop, start = ordered.heading_columns("descr")
    return ordered.region_ranges(table(spark, sf_dir, "outline"), [], "row_no", start, stop)


@query("e15_section_subtotals", f"""
WITH {_FILLED} SELECT max(CASE WHEN b <> '' THEN row_no END) AS start, max(nullif(b, '')) AS heading, count(qty) AS n, round(sum(qty), 4) AS total FROM
(SELECT *, count(nullif(b, '')) OVER (ORDER BY row_no) AS sec FROM o) WHERE sec > 0 GROUP BY sec
""")
def e15(spark, sf_dir):
    _, heading, _ = ordered.heading_columns("descr")
    return ordered.section_subtotals(table(spark, sf_dir, "outline"), [], "row_no", heading, "qty", _BLOCK).withColumn("total", F.round("total", 4))


@query("e17_merge_continuations", """
WITH r AS (SELECT l_suppkey, CAST((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS DOUBLE) AS place, l_linenumber IN (1, 4) AS d, l_returnflag AS t, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END AS v FROM lineitem),
u AS (SELECT *, last_value(CASE WHEN d THEN place END IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY place ROWS UNBOUNDED PRECEDING) AS up,
             first_value(CASE WHEN d THEN place END IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS down FROM r),
o AS (SELECT *, CASE WHEN down IS NULL OR place - up <= down - place THEN up ELSE down END AS owner FROM u)
SELECT l_suppkey, owner AS place, string_agg(t, ' ' ORDER BY place) AS t, arg_min(v, (place <> owner, place)) FILTER (v IS NOT NULL) AS v, count(*) AS merged FROM o GROUP BY l_suppkey, owner
""")
def e17(spark, sf_dir):
    place = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).cast("double")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", place.alias("place"), F.col("l_linenumber").isin(1, 4).alias("d"), F.col("l_returnflag").alias("t"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity")).alias("v"))
    return ordered.merge_continuations(rows, ["l_suppkey"], "place", F.col("d"), ["t"], ["v"])


@query("f1_top_k_per_group", "SELECT unit, n, rate_id, price FROM (SELECT *, CAST(row_number() OVER (PARTITION BY unit ORDER BY price DESC, rate_id) AS INTEGER) AS n FROM rates) WHERE n <= 5")
def f1(spark, sf_dir):
    return hierarchy.top_k(table(spark, sf_dir, "rates"), ["unit"], [F.desc("price"), F.asc("rate_id")], 5).select("unit", "n", "rate_id", "price")


@query("f2_top_differences", """
SELECT code, a_qty, b_qty, diff FROM (SELECT a.code, a.qty AS a_qty, b.qty AS b_qty, round((greatest(a.qty, b.qty) - least(a.qty, b.qty)) / greatest(a.qty, b.qty) * 100, 6) AS diff
FROM boq_a a JOIN boq_b b ON a.code = b.code WHERE a.qty > 0 AND b.qty > 0) WHERE diff <> 0 ORDER BY diff DESC, code LIMIT 20
""")
def f2(spark, sf_dir):
    a = table(spark, sf_dir, "boq_a").select("code", F.col("qty").alias("a_qty"))
    b = table(spark, sf_dir, "boq_b").select("code", F.col("qty").alias("b_qty"))
    return hierarchy.top_differences(a.join(b, "code"), "code", "a_qty", "b_qty", 20)


@query("f4_configured_order", """
SELECT p_brand, coalesce(pos, 99) AS pos, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) LEFT JOIN (VALUES ('Brand#33', 0), ('Brand#11', 1), ('Brand#55', 2)) AS o(b, pos) ON b = p_brand ORDER BY 2, 1
""")
def f4(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return hierarchy.configured_order(counts, "p_brand", ["Brand#33", "Brand#11", "Brand#55"]).select("p_brand", "pos", "n")


@query("k1_subtree_by_keyword", """
WITH m AS (SELECT code FROM boq_a WHERE descr LIKE '%red%'), p AS (SELECT DISTINCT code, split_part(code, '.', 1) AS p1, concat(split_part(code, '.', 1), '.', split_part(code, '.', 2)) AS p2 FROM m),
t AS (SELECT DISTINCT c FROM (SELECT code AS c FROM p UNION ALL SELECT p1 FROM p UNION ALL SELECT p2 FROM p))
SELECT c AS code, c IN (SELECT code FROM m) AS marker FROM t
""")
def k1(spark, sf_dir):
    boq = table(spark, sf_dir, "boq_a")
    codes = boq.select("code", "descr").unionByName(hierarchy.ancestor_rows(boq, "code").withColumn("descr", F.lit("")))
    return hierarchy.subtree_by_keyword(codes, "code", "descr", "red").select("code", "marker")


@query("k1_keyword_subtrees", r"""
WITH r AS (SELECT *, regexp_matches(code, '^[A-Z]\.\d+') AS item, regexp_matches(code, '^[A-Z]\.\d+') AND contains(descr, 'red') AS marker, len(code) - len(replace(code, '.', '')) AS dots FROM coded_list),
w AS (SELECT *, last_value(CASE WHEN starts_with(descr, '【') THEN row_no END IGNORE NULLS) OVER o AS section, last_value(CASE WHEN marker THEN row_no END IGNORE NULLS) OVER o AS m_row,
  last_value(CASE WHEN marker THEN code END IGNORE NULLS) OVER o AS m_code, last_value(CASE WHEN marker THEN dots END IGNORE NULLS) OVER o AS m_dots FROM r WINDOW o AS (ORDER BY row_no ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, last_value(CASE WHEN item AND NOT marker AND dots <= m_dots THEN row_no END IGNORE NULLS) OVER (ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS stop FROM w),
mk AS (SELECT * FROM w WHERE marker),
x AS (SELECT row_no, 1 AS rank FROM mk UNION ALL SELECT section, 2 FROM mk
  UNION ALL SELECT c.row_no, 3 FROM w c JOIN mk ON c.section IS NOT DISTINCT FROM mk.section AND c.row_no < mk.row_no AND c.code = 'Class ' || substr(mk.code, 1, 1)
  UNION ALL SELECT c.row_no, 4 FROM w c JOIN mk ON c.section IS NOT DISTINCT FROM mk.section AND c.row_no < mk.row_no AND c.item AND starts_with(mk.code, c.code || '.')
  UNION ALL SELECT row_no, 5 FROM s WHERE NOT coalesce(marker, false) AND m_row IS NOT NULL AND coalesce(stop < m_row, true) AND (code = 'ADD' OR item AND starts_with(code, m_code || '.')))
SELECT row_no, CASE min(rank) WHEN 1 THEN 'marker' WHEN 2 THEN 'section' WHEN 3 THEN 'class' WHEN 4 THEN 'parent' ELSE 'child' END AS role FROM x WHERE row_no IS NOT NULL GROUP BY row_no
""")
def k1_ordered(spark, sf_dir):
    return hierarchy.keyword_subtrees(table(spark, sf_dir, "coded_list"), [], "row_no", "code", "descr", "red").select("row_no", "role")


@query("k2_tree_root", """
WITH RECURSIVE up AS (SELECT id, id AS node, parent_id AS p, 0 AS hops FROM tree UNION ALL SELECT up.id, tree.id, tree.parent_id, hops + 1 FROM up JOIN tree ON tree.id = up.p WHERE hops < 10)
SELECT id, node AS root, CAST(hops AS INTEGER) AS hops FROM up WHERE p IS NULL
""")
def k2(spark, sf_dir):
    return hierarchy.tree_root(table(spark, sf_dir, "tree"), 10)


@query("k3_reachable", """
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_suppkey * 3 % 97 + l_partkey % 2 AS b FROM lineitem),
r AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT e.b FROM r JOIN e ON e.a = r.node)
SELECT node FROM r
""")
def k3(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") * 3 % 97 + F.col("l_partkey") % 2).alias("b")).distinct()
    return hierarchy.reachable(edges, spark.range(1, 2).select(F.col("id").alias("node")))


_NAMES = "SELECT s_suppkey AS id, s_suppkey % 23 = 1 AS external, s_suppkey % 19 = 1 AS used, s_suppkey % 17 = 1 AS junk, s_suppkey % 13 = 1 AS builtin, s_suppkey % 11 = 1 AS skip FROM supplier"


@query("k3_name_verdicts", f"""
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_suppkey * 3 % 997 + l_partkey % 2 AS b FROM lineitem), n AS ({_NAMES}),
x AS (SELECT id AS node FROM n WHERE external UNION SELECT e.a FROM x JOIN e ON e.b = x.node JOIN n ON n.id = e.a),
u AS (SELECT id AS node FROM n WHERE used UNION SELECT e.b FROM u JOIN e ON e.a = u.node JOIN n ON n.id = e.b)
SELECT id, id IN (SELECT node FROM x) AS external, id IN (SELECT node FROM u) AS used,
  CASE WHEN builtin THEN CASE WHEN junk THEN 'delete: junk' ELSE 'keep: builtin' END WHEN junk THEN 'delete: junk'
    WHEN id IN (SELECT node FROM x) THEN CASE WHEN NOT skip AND id NOT IN (SELECT node FROM u) THEN 'delete: unused external' ELSE 'keep: external in use' END
    WHEN skip THEN 'keep: skipped' WHEN id IN (SELECT node FROM u) THEN 'keep: used' ELSE 'delete: unused' END AS verdict FROM n
""")
def k3_verdicts(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") * 3 % 997 + F.col("l_partkey") % 2).alias("b")).distinct()
    names = spark.sql(_NAMES.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    return hierarchy.name_verdicts(names, edges).select("id", "external", "used", "verdict")


@query("k4_path_codes", """
SELECT row_no, code, concat(split_part(code, '.', 1), '/', split_part(code, '.', 1), '.', split_part(code, '.', 2)) AS ancestors, CAST(3 AS BIGINT) AS depth FROM boq_a
""")
def k4(spark, sf_dir):
    return hierarchy.path_codes(table(spark, sf_dir, "boq_a"), "code").select("row_no", "code", F.array_join("ancestors", "/").alias("ancestors"), "depth")


@query("k5_chapter_for_page", """
WITH c AS (SELECT n_regionkey AS chapter, 1 AS level, min(n_nationkey) * 10 AS lo, max(n_nationkey) * 10 + 9 AS hi FROM nation GROUP BY n_regionkey
  UNION ALL SELECT 100 + n_nationkey, 2, n_nationkey * 10, n_nationkey * 10 + 4 FROM nation)
SELECT p_partkey, (SELECT arg_max(chapter, (level, chapter)) FROM c WHERE p_size * 5 BETWEEN lo AND hi) AS chapter FROM part
""")
def k5(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    top = nation.groupBy(F.col("n_regionkey").alias("chapter")).agg(F.lit(1).alias("level"), (F.min("n_nationkey") * 10).alias("lo"), (F.max("n_nationkey") * 10 + 9).alias("hi"))
    low = nation.select((F.col("n_nationkey") + 100).alias("chapter"), F.lit(2).alias("level"), (F.col("n_nationkey") * 10).alias("lo"), (F.col("n_nationkey") * 10 + 4).alias("hi"))
    pages = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 5).alias("page"))
    return hierarchy.chapter_for_page(top.unionByName(low), pages, "p_partkey", "page")
