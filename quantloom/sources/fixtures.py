"""Tables derived from the given ones, in SQL that Spark and other engines read alike.

Item lists, price pools, norms and so on are views of the order tables; each is one SELECT, so that tests can
make the same rows elsewhere. Row numbers ascend but have gaps: no global sort is needed to make them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_BOQ = """
SELECT '{flag}' AS list_id, CAST(n_regionkey * 1000 + n_nationkey AS BIGINT) * 100000000 + p_partkey AS row_no,
       concat(substr('ABCDE', n_regionkey + 1, 1), '.', n_nationkey, '.', p_partkey) AS code,
       concat(p_name, ' ', p_type) AS descr, p_type AS unit, p_partkey, n_nationkey, n_regionkey, n_name, r_name, p_brand, qty
FROM (SELECT l_partkey, s_nationkey, sum(l_quantity) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
      WHERE l_returnflag = '{flag}' GROUP BY l_partkey, s_nationkey) AS q
JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

FIXTURES = {
    "rates": """
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS rate_id, p_name AS name, p_type AS unit,
       floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 AS price, p_brand AS specialty, s_name AS supplier, CAST(l_shipdate AS DATE) AS date
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
""",
    "items_a": _BOQ.format(flag="A"),
    "items_r": _BOQ.format(flag="R"),
    "items_n": _BOQ.format(flag="N"),
    "boq_a": "SELECT 'a' AS list_id, row_no, code, descr, unit, qty FROM items_a",
    "boq_b": """
SELECT 'b' AS list_id, row_no, CASE WHEN p_partkey % 11 = 0 THEN concat(code, '.1') ELSE code END AS code,
       CASE WHEN p_partkey % 13 = 0 THEN concat(descr, ' (rev)') ELSE descr END AS descr, unit, qty
FROM items_r WHERE p_partkey % 7 <> 0
""",
    "boq_c": """
SELECT 'c' AS list_id, row_no * 2 AS row_no, code, descr, unit, qty FROM items_n
UNION ALL SELECT 'c', row_no * 2 + 1, code, descr, unit, qty + 1 FROM items_n WHERE p_partkey % 3 = 0
""",
    "outline": """
SELECT row_no * 8 + 4 AS row_no, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE descr END AS descr, unit, qty FROM items_a
UNION ALL SELECT min(row_no) * 8, concat('【', r_name, '】'), NULL, NULL FROM items_a GROUP BY n_regionkey, r_name
UNION ALL SELECT min(row_no) * 8 + 1, concat('《', n_name, '》'), NULL, NULL FROM items_a GROUP BY n_nationkey, n_name
UNION ALL SELECT min(row_no) * 8 + 2, concat('{', p_brand, '}'), NULL, NULL FROM items_a GROUP BY n_nationkey, p_brand
""",
    "drawn_outline": """
SELECT row_no, CASE row_no % 160 WHEN 4 THEN 'Concrete works' WHEN 12 THEN 'Part of the works' WHEN 20 THEN '1 - Preliminaries' WHEN 28 THEN 'Rates shall include all labour' WHEN 36 THEN '{Sub group}'
         WHEN 44 THEN '2.3 clause of the contract' WHEN 52 THEN 'Chapter of codes' WHEN 60 THEN '钢筋 works' WHEN 68 THEN 'Subtotal carried forward' WHEN 76 THEN 'Formwork' WHEN 84 THEN 'A full sentence stands here.' WHEN 92 THEN NULL ELSE descr END AS descr,
       CASE row_no % 160 WHEN 12 THEN 'B.2' WHEN 52 THEN '3.0' WHEN 100 THEN 'C.1' END AS code, CASE WHEN row_no % 160 < 90 OR row_no % 480 = 100 THEN NULL ELSE unit END AS unit, qty FROM outline
""",
    "coded_list": """
SELECT row_no * 8 + 4 AS row_no, CASE p_partkey % 6 WHEN 0 THEN concat(substr(code, 1, 1), '.', n_nationkey) WHEN 1 THEN code WHEN 2 THEN concat(substr(code, 1, 1), '.', n_nationkey, '.', p_partkey - 1, '.1')
         WHEN 3 THEN 'ADD' WHEN 4 THEN concat(substr(code, 1, 1), '.', n_nationkey, '.', p_partkey - 3, '.2') END AS code, descr FROM items_a
UNION ALL SELECT min(row_no) * 8, NULL, concat('【', n_name, '】') FROM items_a GROUP BY n_name
UNION ALL SELECT min(row_no) * 8 + 1, concat('Class ', min(substr(code, 1, 1))), 'heading' FROM items_a GROUP BY n_nationkey
""",
    "norms": """
SELECT p_partkey AS norm_id, concat('N', p_partkey) AS code, p_name AS name, p_type AS unit, p_brand AS chapter,
       p_size AS attr1, p_brand AS attr2, p_retailprice AS price FROM part
""",
    "consumption": """
SELECT l_partkey AS norm_id, s_name AS resource, p_type AS unit, l_quantity AS amount, l_orderkey, l_linenumber, l_suppkey,
       CASE l_suppkey % 3 WHEN 0 THEN 'labour' WHEN 1 THEN 'material' ELSE 'plant' END AS class
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
""",
    "item_cells": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS a, round(l_extendedprice / l_quantity, 2) AS b,
       CASE WHEN l_linenumber = 7 THEN round(l_quantity * round(l_extendedprice / l_quantity, 2), 2) + 0.08
            WHEN l_linenumber = 6 THEN l_extendedprice * 3 + 11
            ELSE round(l_quantity * round(l_extendedprice / l_quantity, 2), 2) END AS c
FROM lineitem
""",
    "price_lines": """
SELECT page, n, k, a, b, CAST(a * b + CASE n WHEN 7 THEN 0.08 WHEN 6 THEN 11 ELSE 0 END AS DECIMAL(16,4)) AS c
FROM (SELECT l_orderkey AS page, l_linenumber AS n, min(l_partkey) AS k, CAST(min(l_quantity) AS DECIMAL(9,2)) AS a,
             CAST(floor(min(l_extendedprice) / min(l_quantity) * 100 + 0.5) / 100 AS DECIMAL(9,2)) AS b FROM lineitem GROUP BY l_orderkey, l_linenumber) AS q
""",
    "price_cells": """
SELECT page, n AS row, 1 AS x, CAST(a AS DECIMAL(16,4)) AS value, CASE WHEN k % 3 = 0 THEN CAST(a AS DECIMAL(16,4)) END AS other FROM price_lines
UNION ALL SELECT page, n, 2, CAST(b AS DECIMAL(16,4)), CAST(b AS DECIMAL(16,4)) FROM price_lines
UNION ALL SELECT page, n, 3, c, CASE WHEN k % 2 = 0 THEN c ELSE c + 1 END FROM price_lines
UNION ALL SELECT page, n, 4, CAST(k % 90 + 10 AS DECIMAL(16,4)), NULL FROM price_lines
UNION ALL SELECT page, n, 5, CAST(c + k % 90 + 10 + CASE WHEN k % 5 = 0 THEN 0.08 ELSE 0 END AS DECIMAL(16,4)), NULL FROM price_lines
UNION ALL SELECT page, n, 6, NULL, NULL FROM price_lines
UNION ALL SELECT page, 100, 1, CAST(sum(c) AS DECIMAL(16,4)), NULL FROM price_lines GROUP BY page
UNION ALL SELECT page, 101, 1, CAST(sum(c) * 0.15 AS DECIMAL(16,4)), NULL FROM price_lines GROUP BY page
""",
    "points": """
SELECT event_id AS token_id, user_id AS page, CAST(value AS DOUBLE) AS x,
       CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) AS y, event_type AS text FROM events
""",
    "type_tokens": """
SELECT event_id AS token_id, user_id AS page, CAST(value AS DOUBLE) AS x, CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) AS y,
       CAST(20 + user_id % 5 * 30 + event_id % 3 AS DOUBLE) AS height, event_type AS text FROM events
""",
    "access": "SELECT user_id AS item_id, ts FROM events",
    "task_log": """
SELECT user_id AS task_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing'
       WHEN 'purchase' THEN 'done' ELSE 'failed' END AS status FROM events
""",
    "tree": """
SELECT concat('r', r_regionkey) AS id, CAST(NULL AS VARCHAR(20)) AS parent_id, r_name AS name FROM region
UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name FROM nation
UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), c_name FROM customer
""",
}


def _needed(sql: str) -> list[str]:
    """Derived tables that a statement names, those first that others are made from."""
    out: list[str] = []
    for name in re.findall(r"\w+", sql):
        if name in FIXTURES and name not in out:
            out += [x for x in _needed(FIXTURES[name]) if x not in out] + [name]
    return list(dict.fromkeys(out))


def with_fixtures(sql: str) -> str:
    """The statement with the derived tables that it names in front, as WITH clauses."""
    names = _needed(sql)
    if not names:
        return sql
    parts = ", ".join(f"{name} AS ({FIXTURES[name]})" for name in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts}, {body[14:]}"
    return f"WITH {parts}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {parts} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one derived from these."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = with_fixtures(f"SELECT * FROM {name}")
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})
