"""Queries on units, quantities and price pools (A, B, D and I of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.text import description_key, natural_key, price_key, rate_key
from quantloom.operators import pool, standardise
from quantloom.plans.registry import query
from quantloom.sources.fixtures import table

_KEY_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\([^()]*\)|\[[^\]]*\]|（[^（）]*）', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query("d1_dedup_rate_pool", f"""
WITH k AS (SELECT *, substr({_KEY_SQL.format('name')}, 1, 120) AS name_key, trim(lower(unit)) AS unit_key FROM rates),
f AS (SELECT * FROM k WHERE length(name_key) >= 4 AND NOT regexp_matches(name_key, '^[0-9\\s.]+$')),
b AS (SELECT *, row_number() OVER (PARTITION BY name_key, unit_key ORDER BY date DESC, rate_id) AS nth FROM f)
SELECT name_key, unit_key, max(CASE WHEN nth = 1 THEN rate_id END) AS rate_id, max(CASE WHEN nth = 1 THEN price END) AS price,
       max(CASE WHEN nth = 1 THEN supplier END) AS supplier, max(CASE WHEN nth = 1 THEN date END) AS date,
       min(price) AS min_price, max(price) AS max_price, round(avg(price), 2) AS avg_price, count(*) AS n
FROM b GROUP BY name_key, unit_key
""")  # fmt: skip
def d1(spark, sf_dir):
    rates = table(spark, sf_dir, "rates")
    return pool.dedup_rate_pool(rates, rate_key(F.col("name")), F.trim(F.lower("unit")))


@query("a5_rates_source", """
SELECT rate_id, name, unit, specialty, supplier, date, price FROM (
  SELECT rate_id, name, unit, specialty, supplier, date, CASE WHEN incl > 0 THEN incl WHEN excl > 0 THEN excl END AS price FROM (
    SELECT *, CASE WHEN hash_no % 5 = 0 THEN 0 ELSE price * 1.15::DOUBLE END AS incl, CASE WHEN hash_no % 10 = 0 THEN 0 ELSE price END AS excl
    FROM (SELECT *, length(rate_id) + length(supplier) + length(name) AS hash_no FROM rates))
  WHERE specialty NOT IN ('Brand#11', 'Brand#12')) WHERE price > 0
""")
def a5(spark, sf_dir):
    no = F.length("rate_id") + F.length("supplier") + F.length("name")
    raw = table(spark, sf_dir, "rates").withColumns({"price_incl": F.when(no % 5 == 0, 0.0).otherwise(F.col("price") * 1.15), "price_excl": F.when(no % 10 == 0, 0.0).otherwise(F.col("price"))}).drop("price")
    return pool.rates_source(raw, ~F.col("specialty").isin("Brand#11", "Brand#12"))


@query("a6_flatten_quotes", """
SELECT s_nationkey AS project, CASE WHEN s_nationkey % 2 = 0 THEN 'BD' ELSE 'CN' END AS country, s_name AS supplier, p_name AS name,
       CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS name_en,
       CASE WHEN p_partkey % 4 = 0 THEN 'EUR' ELSE 'USD' END AS currency, l_extendedprice AS price,
       lower(concat_ws(' ', p_name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END, s_name, CAST(s_nationkey AS VARCHAR))) AS search_text
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
""")
def a6(spark, sf_dir):
    line, supplier, part = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    item = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("name_en"), F.when(F.col("p_partkey") % 4 == 0, "EUR").alias("currency"), F.col("l_extendedprice").alias("price"))
    by_supplier = line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy("l_suppkey").agg(F.collect_list(item).alias("items"))
    offers = by_supplier.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    projects = offers.groupBy(F.col("s_nationkey").alias("project")).agg(F.collect_list(F.struct(F.col("s_name").alias("name"), "items")).alias("suppliers"))
    projects = projects.withColumns({"country": F.when(F.col("project") % 2 == 0, "BD").otherwise("CN"), "currency": F.lit("USD")})
    return pool.flatten_quotes(projects)


@query("a7_replace_where_append", """
WITH n AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_custkey % 5 = 0 AND o_orderdate >= TIMESTAMP '1996-01-01'),
k AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey IN (SELECT o_custkey FROM n)))
SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM (SELECT * FROM n UNION ALL SELECT * FROM k) GROUP BY o_custkey
""")
def a7(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    since = F.lit("1996-01-01").cast("timestamp")
    new = orders.where((F.col("o_custkey") % 5 == 0) & (F.col("o_orderdate") >= since)).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    loaded, _ = pool.replace_where_append(orders, new, ["o_custkey"], "o_orderdate", since)
    return loaded.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a8_price_records", """
SELECT rate_id, trim(name) AS name, price AS price_value, regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '', 'g') AS lookup_key,
       concat(lower(trim(name)), '|', lower(unit)) AS material_key FROM rates WHERE specialty <> 'Brand#13'
""")
def a8(spark, sf_dir):
    raw = table(spark, sf_dir, "rates").select("rate_id", "name", "unit", F.when(F.col("specialty") == "Brand#13", "n/a").otherwise(F.col("price").cast("string")).alias("price"))
    return pool.price_records(raw).select("rate_id", "name", "price_value", "lookup_key", "material_key")


@query("a9_export_manifest", "SELECT p_brand, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM part GROUP BY p_brand")
def a9(spark, sf_dir):
    from quantloom.sources.lists import export_manifest

    return export_manifest(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


_ALIASES = [("standard anodized", "std"), ("STANDARD  POLISHED", "std"), ("small plated", "sm"), ("economy brushed", "eco"), ("promo burnished", "promo"), ("steel", "st"), ("copper", "cu")]


@query("b1_standardise_units", f"""
WITH a(alias, canonical) AS (VALUES {", ".join(f"('{' '.join(a.lower().split())}', '{c}')" for a, c in _ALIASES)})
SELECT p_partkey, coalesce(canonical, trim(regexp_replace(lower(p_type), '\\s+', ' ', 'g'))) AS unit_std FROM part LEFT JOIN a ON trim(regexp_replace(lower(p_type), '\\s+', ' ', 'g')) = alias
""")
def b1(spark, sf_dir):
    aliases = spark.createDataFrame(_ALIASES, "alias string, canonical string")
    return standardise.standardise_units(table(spark, sf_dir, "part"), "p_type", aliases).select("p_partkey", "unit_std")


@query("b2_split_unit_factor", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE CAST(p_size AS DOUBLE) END AS factor, p_type AS bare_unit FROM part")
def b2(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("u", F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.concat("p_size", "p_type")))
    return standardise.split_unit_factor(part, "u").select("p_partkey", "factor", "bare_unit")


@query("b3_repair_units")
def b3(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("u", F.concat(F.lit(" rn"), F.col("p_size") % 4, F.lit(" "), "p_type"))
    return standardise.repair_units(part, "u", [("^rn", "m"), ("0 ", "³ ")], ["根", "块"]).select("p_partkey", "u", "unit_fixed")


@query("b4_text_keys", f"""
SELECT doc_id, {_KEY_SQL.format('text')} AS compare_key, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS match_key, substr({_KEY_SQL.format('text')}, 1, 120) AS name_key FROM documents
""")
def b4(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", description_key(t).alias("compare_key"), price_key(t).alias("match_key"), rate_key(t).alias("name_key"))


@query("b5_search_key", "SELECT p_partkey, trim(p_name) AS display, regexp_replace(lower(p_name), '[^\\w]+', '', 'g') AS search_key FROM part")
def b5(spark, sf_dir):
    from quantloom.functions.udfs import search_key

    return search_key(table(spark, sf_dir, "part"), "p_name").select("p_partkey", "display", "search_key")


@query("b6_parse_quantities", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 2 THEN l_quantity * 1000 ELSE l_quantity END AS qty_num,
       CASE WHEN l_linenumber = 3 THEN 'by others' END AS qty_text FROM lineitem
""")
def b6(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint").cast("string")
    text = F.when(F.col("l_linenumber") == 3, " by others ").when(F.col("l_linenumber") == 2, F.concat(q, F.lit(",000"))).when(F.col("l_linenumber") == 1, F.concat(q, F.lit(" USD"))).otherwise(q)
    return standardise.parse_quantities(table(spark, sf_dir, "lineitem").withColumn("q", text), "q", "keep").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty_num", "qty_text")


@query("b7_leaf_filter", "SELECT row_no, descr, unit, qty FROM outline WHERE unit IS NOT NULL AND trim(unit) <> '' AND qty IS NOT NULL")
def b7(spark, sf_dir):
    return standardise.leaf_filter(table(spark, sf_dir, "outline"))


@query("b8_exclude_rows", """
SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE NOT regexp_matches(line, '(?:[|] .*[|])|(?:^[A-Z!. ]+$)|(?:[0-9]{6,})') GROUP BY doc_id
""")
def b8(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return standardise.exclude_rows(lines, "line", ["[|] .*[|]", "^[A-Z!. ]+$", "[0-9]{6,}"]).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("b9_where_presets", "SELECT p_partkey, p_name, p_size FROM part WHERE (p_size > 45 OR p_name LIKE '%red%') AND p_retailprice > 950")
def b9(spark, sf_dir):
    presets = {"large": F.col("p_size") > 45, "red": F.col("p_name").contains("red"), "cheap": F.col("p_retailprice") < 100}
    return standardise.where_presets(table(spark, sf_dir, "part"), presets, ["large", "red"], "p_retailprice > 950").select("p_partkey", "p_name", "p_size")


@query("b10_derive_code_fields", """
SELECT row_no, code AS clean_code, row_no % 9 = 0 AS is_add, split_part(code, '.', 1) AS group_id, CAST(3 AS BIGINT) AS depth,
       concat(split_part(code, '.', 1), '.', split_part(code, '.', 2)) AS region FROM boq_a
""")
def b10(spark, sf_dir):
    boq = table(spark, sf_dir, "boq_a").withColumn("code", F.when(F.col("row_no") % 9 == 0, F.concat("code", F.lit("-ADD"))).otherwise(F.col("code")))
    return standardise.derive_code_fields(boq).select("row_no", "clean_code", "is_add", "group_id", "depth", "region")


@query("b11_rounded_purchase_qty", """
SELECT l_partkey, CASE WHEN q >= 10000 THEN round_even(q / 100, 0) * 100 WHEN q >= 1000 THEN round_even(q / 50, 0) * 50
       WHEN q >= 100 THEN round_even(q / 10, 0) * 10 WHEN q >= 10 THEN round_even(q, 0) ELSE round_even(q, 1) END AS buy_qty
FROM (SELECT l_partkey, sum(l_quantity) * CAST(1.05 AS DOUBLE) AS q FROM lineitem GROUP BY l_partkey)
""")
def b11(spark, sf_dir):
    totals = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return standardise.rounded_purchase_qty(totals, "q").select("l_partkey", "buy_qty")


_ORIGINS = [("asia", ["china", "japan", "india", "indonesia", "vietnam"]), ("europe", ["france", "germany", "romania", "russia", "kingdom"]), ("other", [])]
_STEPS = {"exw_to_fob": 0.05, "freight": 0.1, "duty": 0.2, "clearing": 0.03, "inland": 2.0, "vat": 0.15}


@query("b12_landed_cost", """
WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS p,
  CASE l_linenumber % 4 WHEN 0 THEN 'EXW' WHEN 1 THEN 'FOB' WHEN 2 THEN 'CIF' ELSE 'DDP' END AS basis,
  CASE WHEN regexp_matches(lower(n_name), 'china|japan|india|indonesia|vietnam') THEN 'asia' WHEN regexp_matches(lower(n_name), 'france|germany|romania|russia|kingdom') THEN 'europe' ELSE 'other' END AS origin
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT *, CASE basis WHEN 'EXW' THEN p * 1.05::DOUBLE * 1.1::DOUBLE WHEN 'FOB' THEN p * 1.1::DOUBLE WHEN 'CIF' THEN p ELSE (p - CASE WHEN origin = 'asia' THEN 0 ELSE 2 END) / 1.23::DOUBLE END AS cif FROM o)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, origin, round(cif / 1.1::DOUBLE / 1.05::DOUBLE, 8) AS exw, round(cif, 8) AS cif,
       round(CASE WHEN basis = 'DDP' THEN p ELSE cif * 1.23::DOUBLE + 2 END, 8) AS ddp, round(cif * 1.2::DOUBLE * 0.15::DOUBLE, 8) AS vat FROM c
""")
def b12(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    n = F.col("l_linenumber") % 4
    line = line.withColumn("basis", F.when(n == 0, "EXW").when(n == 1, "FOB").when(n == 2, "CIF").otherwise("DDP"))
    out = standardise.landed_cost(line, "l_extendedprice", "basis", "n_name", _ORIGINS, _STEPS, "asia")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "origin", *(F.round(c, 8).alias(c) for c in ("exw", "cif", "ddp", "vat")))


@query("b13_convert_unit_price", """
WITH u AS (SELECT p_partkey, p_retailprice AS p, p_size AS s, CASE p_partkey % 4 WHEN 0 THEN 't' WHEN 1 THEN 'm3' WHEN 2 THEN 'm2' ELSE 'm' END AS a,
                  CASE p_size % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'm2' WHEN 2 THEN 'm3' ELSE 'm' END AS b FROM part)
SELECT p_partkey, CASE WHEN a = b THEN 'same' WHEN a = 't' AND b = 'kg' THEN 't_kg' WHEN a = 'm3' AND b = 'm2' THEN 'm3_m2' WHEN a = 'm2' AND b = 'm3' THEN 'm2_m3'
       WHEN a = 't' AND b = 'm3' THEN 't_m3' ELSE 'unresolved' END AS rule,
       round(CASE WHEN a = b THEN p WHEN a = 't' AND b = 'kg' THEN p / 1000 WHEN a = 'm3' AND b = 'm2' THEN p * (s / 1000.0::DOUBLE) WHEN a = 'm2' AND b = 'm3' THEN p / (s / 1000.0::DOUBLE)
       WHEN a = 't' AND b = 'm3' THEN p * 2.4::DOUBLE END, 4) AS price_conv FROM u
""")
def b13(spark, sf_dir):
    k, s = F.col("p_partkey") % 4, F.col("p_size") % 4
    part = table(spark, sf_dir, "part").withColumns({"a": F.when(k == 0, "t").when(k == 1, "m3").when(k == 2, "m2").otherwise("m"), "b": F.when(s == 0, "kg").when(s == 1, "m2").when(s == 2, "m3").otherwise("m"), "txt": F.concat("p_name", F.lit(" t="), "p_size")})
    return standardise.convert_unit_price(part, "p_retailprice", "a", "b", "txt").select("p_partkey", "rule", F.round("price_conv", 4).alias("price_conv"))


_FACTORS = [1.0, 3.0, 0.25, 4.7, 33.4, 25.55, 1.37, 0.0, 0.7]


@query("b13_explain_ratio", f"""
WITH p AS (SELECT p_partkey, p_retailprice AS a, p_retailprice * {_FACTORS}[p_partkey % {len(_FACTORS)} + 1]::DOUBLE AS b FROM part), r AS (SELECT *, CASE WHEN a <> 0 AND b <> 0 AND abs(b - a) > 0.01 THEN b / a END AS r FROM p)
SELECT p_partkey, round(r, 6) AS ratio, CASE WHEN r IS NULL THEN NULL WHEN abs(r - round_even(r, 0)) < 0.02 AND r > 1.01 THEN 'multiple' WHEN r < 0.99 AND round_even(1 / r, 0) <> 0 AND abs(r - 1 / round_even(1 / r, 0)) < 0.02 THEN 'divisor'
  WHEN r > 4.5 AND r < 5.5 THEN 'cny' WHEN r > 32 AND r < 35 THEN 'usd' WHEN r > 20 THEN 'large' ELSE 'factor' END AS ratio_rule FROM r
""")
def b13_ratio(spark, sf_dir):
    factor = F.get(F.array(*map(F.lit, _FACTORS)), F.col("p_partkey") % len(_FACTORS))
    part = table(spark, sf_dir, "part").withColumn("b", F.col("p_retailprice") * factor)
    return standardise.explain_ratio(part, "p_retailprice", "b").select("p_partkey", F.round("ratio", 6).alias("ratio"), "ratio_rule")


@query("b15_translation_post_edit")
def b15(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("draft", F.regexp_replace("text", r"\.", ".."))
    return standardise.post_edit(docs, "lang", "draft", [("en", r"\bthe the\b", "the")], {"the": "THE", "and": "&"}).select("doc_id", "edited")


@query("b16_patch_by_rule", """
WITH one AS (SELECT p_partkey, p_name, CASE WHEN p_name LIKE '%red%' AND p_brand = 'Brand#11' THEN 'Brand#99' ELSE p_brand END AS brand, p_name LIKE '%red%' AND p_brand = 'Brand#11' AS h FROM part)
SELECT p_partkey, CASE WHEN brand = 'Brand#99' AND regexp_matches(p_name, 'a') THEN 'Brand#98' ELSE brand END AS p_brand,
       CAST(h AS BIGINT) + CAST(brand = 'Brand#99' AND regexp_matches(p_name, 'a') AS BIGINT) AS n_hits FROM one
""")
def b16(spark, sf_dir):
    rules = [("red", ("Brand#11",), ("Brand#99",)), ("a", ("Brand#99",), ("Brand#98",))]
    return standardise.patch_by_rule(table(spark, sf_dir, "part"), "p_name", ["p_brand"], rules).select("p_partkey", "p_brand", F.size("hits").cast("bigint").alias("n_hits"))


@query("b17_priced_amounts", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * p_retailprice, 4) AS norm_amount, round(l_quantity * r, 4) AS ref_amount, round(p_retailprice * 0.75, 4) AS labour
FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT p_partkey AS k, p_size * 1.5::DOUBLE AS r FROM part WHERE p_partkey % 2 = 0) ON k = l_partkey
""")
def b17(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").alias("key"), F.col("l_quantity").alias("qty"))
    part = table(spark, sf_dir, "part")
    norm = part.select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("rate"), F.lit(1).alias("row"))
    ref = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), (F.col("p_size") * 1.5).alias("rate"), F.lit(1).alias("row"))
    out = standardise.priced_amounts(items, norm, ref)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.round(c, 4).alias(c) for c in ("norm_amount", "ref_amount", "labour")))


@query("b18_normalise_timestamps", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) WHEN event_id % 3 = 1 THEN date_trunc('second', ts) ELSE TIMESTAMP '2024-02-01 00:00:00' END AS at FROM events
""")
def b18(spark, sf_dir):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    events = table(spark, sf_dir, "events").withColumns({"t": text, "f": F.lit("2024-02-01 00:00:00").cast("timestamp")})
    return standardise.normalise_timestamps(events, "t", "f").select("event_id", F.col("at").cast("timestamp_ntz").alias("at"))


@query("d2_consolidate", """
SELECT CASE WHEN d LIKE '%red%' AND d LIKE '%steel%' THEN 'red steel' WHEN d LIKE '%blue%' OR d LIKE '%copper%' THEN 'blue or copper' END AS grp, d AS descr_key, round(sum(qty), 2) AS qty, arg_min(unit, row_no) AS unit, count(*) AS n
FROM (SELECT *, lower(descr) AS d FROM boq_a) GROUP BY 1, 2
""")
def d2(spark, sf_dir):
    out = pool.consolidate(table(spark, sf_dir, "boq_a"), [("red steel", ["red", "steel"], True), ("blue or copper", ["blue", "copper"], False)])
    return out.withColumn("qty", F.round("qty", 2))


@query("d3_qty_by_code", "SELECT code, round(sum(qty), 4) AS qty FROM boq_c GROUP BY code")
def d3(spark, sf_dir):
    return pool.qty_by_code(table(spark, sf_dir, "boq_c")).withColumn("qty", F.round("qty", 4))


@query("d4_resource_rollup", """
WITH q AS (SELECT p_partkey AS norm_id, CAST(p_size AS DOUBLE) AS qty FROM part), r AS (SELECT *, round(amount / 10, 1) AS rate FROM consumption)
SELECT resource, unit, round(sum(amount * qty), 2) AS need, count(DISTINCT r.norm_id) AS norms, max(rate) AS max_rate, count(DISTINCT rate) AS rates FROM r JOIN q ON r.norm_id = q.norm_id GROUP BY resource, unit
""")
def d4(spark, sf_dir):
    use = table(spark, sf_dir, "consumption").withColumn("rate", F.round(F.col("amount") / 10, 1))
    qty = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("norm_id"), F.col("p_size").cast("double").alias("qty"))
    return pool.resource_rollup(use, qty).withColumn("need", F.round("need", 2))


@query("d12_price_sources", "SELECT supplier, count(*) AS records, max(date) AS last_update FROM rates WHERE name LIKE '%a%' GROUP BY supplier")
def d12(spark, sf_dir):
    return pool.price_sources(table(spark, sf_dir, "rates"), "supplier", "date", F.col("name").contains("a"))


@query("d13_majority_unit", """
SELECT name, unit, n FROM (SELECT name, unit, n, row_number() OVER (PARTITION BY name ORDER BY n DESC, unit) AS k FROM
  (SELECT name, unit, count(*) AS n FROM rates WHERE trim(unit) <> '' AND lower(unit) <> lower(name) GROUP BY name, unit)) WHERE k = 1
""")
def d13(spark, sf_dir):
    return pool.majority_unit(table(spark, sf_dir, "rates"), "name", "unit")


@query("d19_composite_rate", """
WITH p AS (SELECT resource, unit, avg(amount) / 7 AS unit_price FROM consumption GROUP BY resource, unit),
w AS (SELECT norm_id, class, sum(amount * unit_price) AS c FROM consumption JOIN p USING (resource, unit) GROUP BY norm_id, class)
SELECT norms.norm_id, round(coalesce(sum(CASE WHEN class = 'labour' THEN c END), 0), 3) AS labour, round(coalesce(sum(CASE WHEN class = 'material' THEN c END), 0), 3) AS material,
       round(coalesce(sum(CASE WHEN class = 'plant' THEN c END), 0), 3) AS plant, round(sum(c), 3) AS rate FROM w JOIN norms ON norms.norm_id = w.norm_id GROUP BY norms.norm_id
""")
def d19(spark, sf_dir):
    use = table(spark, sf_dir, "consumption")
    prices = use.groupBy("resource", "unit").agg((F.avg("amount") / 7).alias("unit_price"))
    out = pool.composite_rate(table(spark, sf_dir, "norms").select("norm_id"), use, prices, ["labour", "material", "plant"])
    return out.select("norm_id", *(F.round(c, 3).alias(c) for c in ("labour", "material", "plant", "rate")))


@query("i6_price_lookup", """
WITH w(wanted) AS (VALUES ('steel'), ('red'), ('almond')), p AS (SELECT *, regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '', 'g') AS k FROM rates),
s AS (SELECT wanted, rate_id, name, date, CASE WHEN k = wanted THEN 300 WHEN starts_with(k, wanted) THEN 200 WHEN contains(lower(name), wanted) THEN 120 WHEN contains(k, wanted) THEN 80 END AS score FROM p JOIN w ON contains(k, wanted))
SELECT wanted, nth, rate_id, name, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY wanted ORDER BY score DESC, length(name), date DESC, rate_id) AS INTEGER) AS nth FROM s) WHERE nth <= 20
""")
def i6(spark, sf_dir):
    prices = table(spark, sf_dir, "rates").withColumn("lookup_key", price_key(F.col("name")))
    return pool.price_lookup(prices, spark.createDataFrame([("steel",), ("red",), ("almond",)], "name string"))


@query("f3_natural_sort", "SELECT row_no, code, concat(substr(code, 1, 2), lpad(split_part(code, '.', 2), 12, '0'), '.', lpad(split_part(code, '.', 3), 12, '0')) AS sort_key FROM boq_a ORDER BY sort_key")
def f3(spark, sf_dir):
    return table(spark, sf_dir, "boq_a").select("row_no", "code", natural_key(F.col("code")).alias("sort_key")).orderBy("sort_key", "row_no")


@query("e16_latest_per_key", "SELECT supplier, rate_id, price, date FROM (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY date DESC, rate_id) AS n FROM rates) WHERE n = 1")
def e16(spark, sf_dir):
    rates = table(spark, sf_dir, "rates")
    return standardise.latest_per_key(rates, ["supplier"], [F.desc("date"), F.asc("rate_id")]).select("supplier", "rate_id", "price", "date")
