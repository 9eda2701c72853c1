"""Queries on matching, carrying over and synchronising lists (C and G of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import reconcile
from quantloom.operators.align import sequence_align
from quantloom.operators.concepts import concept_match
from quantloom.operators.families import AFFINITY, MATERIALS, UNIT_ALIASES, UNIT_KINDS, Factors, Lexicon, family_pool, rerank_candidates
from quantloom.operators.norms import Category, Material, Scores, no_norm_reasons, scoped_match, unit_problems
from quantloom.plans.registry import query
from quantloom.sources.fixtures import table
from quantloom.sources.scratch import stored

_BLOCK = "concat(split_part(code, '.', 1), '.', split_part(code, '.', 2))"
_STAGES = """
x AS (SELECT o.row_no AS other_row, b.row_no AS base_row, 1 AS stage, 1.0 AS score FROM boq_b o JOIN boq_a b ON o.code = b.code
  UNION ALL SELECT o.row_no, b.row_no, 2, 0.85 FROM boq_b o JOIN boq_a b ON starts_with(b.code, o.code || '.')),
c AS (SELECT other_row, base_row, stage, score FROM (SELECT *, row_number() OVER (PARTITION BY other_row ORDER BY stage, score DESC, base_row) AS n FROM x) WHERE n = 1)
"""
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\([^()]*\)|\[[^\]]*\]|（[^（）]*）', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _clean(col: str) -> str:
    return _CLEAN.format(col)


def _boq(spark, sf_dir, *names):
    return [table(spark, sf_dir, f"boq_{n}") for n in names]


@query("c1_cascade_exact_prefix", f"WITH {_STAGES} SELECT other_row, base_row, stage, CAST(score AS DOUBLE) AS score FROM c")
def c1(spark, sf_dir):
    a, b = _boq(spark, sf_dir, "a", "b")
    return reconcile.cascade_match(a, b, None)


@query("c1_cascade_fuzzy")
def c1f(spark, sf_dir):
    a, b = _boq(spark, sf_dir, "a", "b")
    return reconcile.cascade_match(a, b, 0.75)


@query("c2_cascade_one_to_one", f"""
WITH {_STAGES}, k AS (SELECT other_row, base_row, stage, score FROM (SELECT *, row_number() OVER (PARTITION BY base_row ORDER BY other_row) AS n FROM c) WHERE n = 1)
SELECT row_no AS other_row, base_row, stage, CAST(score AS DOUBLE) AS score FROM boq_b LEFT JOIN k ON row_no = other_row
""")
def c2(spark, sf_dir):
    a, b = _boq(spark, sf_dir, "a", "b")
    return reconcile.cascade_match_one_to_one(a, b, None, None)


@query("c2_one_to_one_similar")
def c2s(spark, sf_dir):
    a, b = _boq(spark, sf_dir, "a", "b")
    return reconcile.cascade_match_one_to_one(a, b)


@query("c3_compare_many", """
WITH fb AS (SELECT code, arg_min(qty, row_no) AS q FROM boq_b GROUP BY code), fc AS (SELECT code, arg_min(qty, row_no) AS q FROM boq_c GROUP BY code)
SELECT a.row_no, a.code, a.qty AS base_qty, fb.q AS b_qty, fc.q AS c_qty,
  CASE WHEN fb.q IS NULL AND fc.q IS NULL THEN NULL ELSE round((greatest(a.qty, fb.q, fc.q) - least(a.qty, fb.q, fc.q)) / greatest(a.qty, fb.q, fc.q) * 100, 6) END AS diff, NULL AS only
FROM boq_a a LEFT JOIN fb ON fb.code = a.code LEFT JOIN fc ON fc.code = a.code
UNION ALL SELECT NULL, code, q, NULL, NULL, NULL, 'b' FROM fb WHERE code NOT IN (SELECT code FROM boq_a)
UNION ALL SELECT NULL, code, q, NULL, NULL, NULL, 'c' FROM fc WHERE code NOT IN (SELECT code FROM boq_a)
""")
def c3(spark, sf_dir):
    a, b, c = _boq(spark, sf_dir, "a", "b", "c")
    return reconcile.compare_many(a, {"b": b, "c": c}).withColumn("diff", F.round("diff", 6))


@query("c4_two_way_price_match", f"""
WITH s AS (SELECT *, {_clean('descr')} AS t, {_BLOCK} AS block FROM boq_b), g AS (SELECT *, {_clean('descr')} AS t, {_BLOCK} AS block FROM boq_a),
f AS (SELECT s.row_no, s.t, s.block, g.row_no AS target_row, CASE WHEN g.row_no IS NULL THEN 'none' WHEN g.t = s.t THEN 'fill' ELSE 'conflict' END AS kind FROM s LEFT JOIN g ON g.code = s.code),
r AS (SELECT block, t, count(*) AS n, min(row_no) AS second_row FROM g WHERE row_no NOT IN (SELECT target_row FROM f WHERE kind = 'fill') GROUP BY block, t),
o AS (SELECT row_no, kind, target_row FROM f WHERE kind = 'fill' UNION ALL
  SELECT f.row_no, CASE WHEN n = 1 THEN 'fill' WHEN n > 1 THEN 'multi' ELSE kind END, CASE WHEN n = 1 THEN second_row ELSE target_row END FROM f LEFT JOIN r ON r.block = f.block AND r.t = f.t WHERE kind <> 'fill')
SELECT * FROM o UNION ALL SELECT NULL, 'target_only', row_no FROM g WHERE row_no NOT IN (SELECT target_row FROM o WHERE target_row IS NOT NULL)
""")
def c4(spark, sf_dir):
    a, b = _boq(spark, sf_dir, "a", "b")
    return reconcile.two_way_price_match(b.withColumn("price", F.col("qty")), a)


@query("c5_occurrence_join", """
WITH t AS (SELECT code, row_number() OVER (PARTITION BY code ORDER BY row_no) AS nth, qty AS target_qty FROM boq_c),
s AS (SELECT code, row_number() OVER (PARTITION BY code ORDER BY row_no) AS nth, qty AS source_qty FROM boq_a)
SELECT * FROM (SELECT coalesce(t.code, s.code) AS code, CAST(coalesce(t.nth, s.nth) AS INTEGER) AS nth, target_qty, source_qty,
  CASE WHEN source_qty IS NULL THEN 'MISSING_IN_SOURCE' WHEN target_qty IS NULL THEN 'MISSING_IN_TARGET' WHEN abs(target_qty - source_qty) > 1 THEN 'QUANTITY_MISMATCH' END AS issue
  FROM t FULL JOIN s ON t.code = s.code AND t.nth = s.nth) WHERE issue IS NOT NULL
""")
def c5(spark, sf_dir):
    c, a = _boq(spark, sf_dir, "c", "a")
    return reconcile.occurrence_join(c, a)


@query("c6_sequence_align")
def c6(spark, sf_dir):
    """List b as a new version of list a, within each L2 block."""
    a, b = (df.withColumn("block", F.substring_index("code", ".", 2)) for df in _boq(spark, sf_dir, "a", "b"))
    return sequence_align(a, b, "block")


_WORDS = [("red", "colour"), ("blue", "colour"), ("hot", "heat"), ("cold", "heat"), ("gear", "machine"), ("rod", "shape"), ("ring", "shape"), ("bolt", "fixing"), ("nut", "fixing"), ("new", "state"), ("old", "state"), ("widget", "machine"), ("螺栓", "fixing"), ("齿轮", "machine"), ("hot ring", "forged"), ("锻件", "forged"), ("anodized", "coat")]
_BRIDGE = {"kg": ["t", "kg"], "set": ["no"]}
_CONCEPT_ITEMS = """
SELECT p_partkey AS item, concat(substr('ABC', CAST(p_size % 3 + 1 AS INTEGER), 1), '.', p_size % 4, '.', p_partkey % 5) AS code, CASE p_partkey % 5 WHEN 0 THEN concat('A.1.2 ', p_name, 's hot') WHEN 1 THEN concat(upper(p_name), ', ', lower(p_type)) ELSE p_name END AS text,
  CASE p_partkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'set' WHEN 2 THEN 'm2' ELSE '' END AS unit, CASE p_size % 5 WHEN 0 THEN 'cold works' WHEN 1 THEN 'gear' WHEN 2 THEN p_type END AS section FROM part
"""
_CONCEPT_NORMS = """
SELECT p_partkey AS norm, concat(substr('abc', CAST(p_partkey % 3 + 1 AS INTEGER), 1), '0', p_partkey % 4, '-', p_size % 5) AS code, CASE p_partkey % 6 WHEN 0 THEN concat('M12螺栓(', p_name, ')') WHEN 1 THEN concat('齿轮，锻件 ', p_name) ELSE p_name END AS text,
  CASE p_size % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 't' WHEN 2 THEN 'no' ELSE 'm2' END AS unit FROM part
"""


@query("c7_concept_match", rf"""
WITH it AS ({_CONCEPT_ITEMS}), nm AS ({_CONCEPT_NORMS}), d(term, concept) AS (VALUES {", ".join(f"('{w}', '{c}')" for w, c in _WORDS)}), br(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, to in _BRIDGE.items() for b in to)}),
tx AS (SELECT text, regexp_replace(lower(text), '[^\w\s/]', ' ', 'g') AS bare, regexp_replace(lower(regexp_replace(text, '\b[A-I]\.\d+(\.\d+)*\b', '', 'g')), '[^\w\s/]', ' ', 'g') AS own FROM (SELECT text FROM it UNION SELECT section FROM it) WHERE text IS NOT NULL),
wd AS (SELECT DISTINCT text, unnest(string_split_regex(own, '\s+')) AS word FROM tx),
co AS (SELECT text, concept FROM wd JOIN d ON word = term WHERE length(word) > 1 UNION SELECT text, concept FROM wd JOIN d ON length(term) > 5 AND NOT contains(term, ' ') AND length(word) > 4 AND contains(word, term)
  UNION SELECT text, concept FROM tx JOIN d ON length(term) > 5 AND contains(term, ' ') AND (contains(bare, term) OR list_has_all(string_split_regex(bare, '\s+'), string_split(term, ' ')))),
cl AS (SELECT text, list(concept) AS c FROM co GROUP BY text),
ic AS (SELECT item, code, unit, coalesce(o.c, []) AS own, coalesce(s.c, []) AS sc FROM it LEFT JOIN cl o ON o.text = it.text LEFT JOIN cl s ON s.text = it.section WHERE unit <> '' AND it.text <> ''),
iu AS (SELECT DISTINCT item, code, unit, list_distinct(list_concat(own, sc)) AS ic, sc, u FROM (SELECT *, unit AS u FROM ic UNION ALL SELECT ic.*, b FROM ic JOIN br ON a = unit)),
ns AS (SELECT *, regexp_replace(lower(text), '[（）()\s,，.。、/·:：;；\-+]+', ' ', 'g') AS t FROM nm), nb AS (SELECT *, replace(t, ' ', '') AS s FROM ns),
nc AS (SELECT norm, code, unit, list_distinct(list(concept)) AS nc FROM nb JOIN d ON list_contains(string_split(t, ' '), term) OR (length(term) IN (2, 3) AND contains(s, term)) GROUP BY norm, code, unit),
pr AS (SELECT item, norm, iu.unit = nc.unit AS same, ic, sc, nc, list_intersect(ic, nc) AS bt, iu.code AS a, nc.code AS b, regexp_extract_all(iu.code, '\d+')::BIGINT[] AS x, regexp_extract_all(nc.code, '\d+')::BIGINT[] AS y FROM iu JOIN nc ON u = nc.unit AND list_has_any(ic, nc)),
sc AS (SELECT item, norm, round(CAST(len(bt) AS DOUBLE) / (len(ic) + len(nc) - len(bt)) * CASE WHEN bt = ['colour'] THEN 0.5 ELSE 1 END - 0.12::DOUBLE * (len(ic) + len(nc) - 2 * len(bt)) - CASE WHEN len(sc) > 0 AND NOT list_has_any(sc, nc) THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN same THEN 0.05::DOUBLE ELSE 0 END + 0.03::DOUBLE * CASE WHEN upper(a[1]) <> upper(b[1]) THEN 0 WHEN x[1] <> y[1] THEN 1 WHEN x[2] <> y[2] THEN 2 ELSE 3 END, 6) AS score FROM pr)
SELECT item, norm, score FROM sc WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, norm) = 1
""")
def c7(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    items, norms = (spark.sql(side.replace("FROM part", "FROM {part}"), part=part) for side in (_CONCEPT_ITEMS, _CONCEPT_NORMS))
    return concept_match(items, norms, spark.createDataFrame(_WORDS, "term string, concept string"), ["colour"], _BRIDGE)


_WEIGHTS = {"keyword": 30.0, "chapter": 15.0, "unit": 30.0, "other_unit": -30.0}
_SCORED = """
i AS (SELECT p_partkey AS item, p_type AS u, p_brand AS ch, unnest(list_distinct(string_split(lower(p_name), ' '))) AS word FROM part WHERE p_partkey % 100 = 0),
n AS (SELECT p_partkey AS norm, p_type AS unit, p_brand AS chapter, concat('N', p_partkey % 50) AS code, unnest(list_distinct(string_split(lower(p_name), ' '))) AS word FROM part WHERE p_partkey % 100 <> 0),
s AS (SELECT item, norm, code, count(*) * 30.0 + CASE WHEN ch = chapter THEN 15 ELSE 0 END + CASE WHEN u = unit THEN 30 ELSE -30 END AS score FROM i JOIN n USING (word) WHERE length(word) > 2 GROUP BY item, norm, code, ch, chapter, u, unit),
b AS (SELECT item, code, CAST(score AS DOUBLE) AS score, norm FROM (SELECT *, row_number() OVER (PARTITION BY item, code ORDER BY score DESC, norm) AS k FROM s) WHERE k = 1),
m AS (SELECT item, code, score, norm, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, norm) AS INTEGER) AS nth FROM b)
"""


def _scored(spark, sf_dir, top=3):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("unit"), F.col("p_brand").alias("chapter"), F.col("p_name").alias("text"))
    items = part.where("p_partkey % 100 = 0").withColumnRenamed("p_partkey", "item")
    norms = part.where("p_partkey % 100 <> 0").withColumn("code", F.concat(F.lit("N"), F.col("p_partkey") % 50)).withColumnRenamed("p_partkey", "norm")
    return reconcile.multi_factor_match(items, norms, _WEIGHTS, top)


@query("c8_multi_factor_match", f"WITH {_SCORED} SELECT item, code, score, norm, nth, CASE WHEN score >= 30 THEN 'matched' ELSE 'low score' END AS verdict FROM m WHERE nth <= 3")
def c8(spark, sf_dir):
    return _scored(spark, sf_dir)


_CATEGORIES = [
    Category(["gear", "cold gear"], ["gear", "ring"], ["old"], ["Brand#11", "Brand#12", "Brand#2", "Brand#13"]),
    Category(["rod", "ring"], ["rod", "nut"], ["hot"]),
    Category(["widget"], chapters=["Brand#8", "Brand#5", "Brand#21"]),
    Category(["bolt"]),
    Category(["hot nut"], ["nut"], chapters=["no such chapter"]),
]
_SCORES = Scores(materials=[Material(["concrete"], ["cement", "sand"], 40, -50), Material(["steel"], ["plate"], 30, -40)], process=["weld", "paint", "drill"], machine_work=["nut"], tokens="[a-z]{4,}", titles="^small")
_UNIT_OF = "CASE {} % 7 WHEN 0 THEN 'm2' WHEN 1 THEN 'kg' WHEN 2 THEN 't' WHEN 3 THEN 'm' WHEN 4 THEN '' WHEN 5 THEN 'item' ELSE 'cm' END"
_NORM_SIDE = f"""SELECT p_partkey AS norm, concat('N', p_partkey % 500) AS code, p_name AS search, p_brand AS chapter, {_UNIT_OF.format('p_size')} AS unit, CASE p_size % 3 WHEN 0 THEN 'steel plate' WHEN 1 THEN 'cement' ELSE '' END AS resources,
  CASE p_size % 4 WHEN 0 THEN 'weld and paint' WHEN 1 THEN 'drill' ELSE '' END AS work, concat('C', p_size) AS attributes, p_size % 5 = 0 AS manual FROM part"""
_ITEM_SIDE = f"""SELECT p_partkey AS item, p_name AS name, concat('grade C', p_partkey % 60, CASE p_partkey % 4 WHEN 0 THEN ' concrete' WHEN 1 THEN ' steel, weld' WHEN 2 THEN ' paint and drill and weld' ELSE '' END) AS descr, {_UNIT_OF.format('p_partkey')} AS unit FROM part"""
_KEYS_SQL = ", ".join(f"('{k}', {n})" for n, c in enumerate(_CATEGORIES) for k in c.keys)
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"
_CONFIG_SQL = ", ".join(f"({n}, {_LIST(c.keywords)}, {_LIST(c.excluded)}, {_LIST(c.chapters)}, {any(k in _SCORES.machine_work for k in c.keywords)})" for n, c in enumerate(_CATEGORIES))


_SCOPED = rf"""
WITH nm AS ({_NORM_SIDE}), it AS ({_ITEM_SIDE}), ky(key, cat) AS (VALUES {_KEYS_SQL}), cf(cat, kw, ex, ch, machine) AS (VALUES {_CONFIG_SQL}),
ic AS (SELECT it.*, concat(name, ' ', descr) AS t, (SELECT cat FROM ky WHERE position(key IN lower(trim(name))) > 0 ORDER BY length(key) DESC, position(key IN lower(trim(name))) LIMIT 1) AS cat FROM it),
ok AS (SELECT * FROM ic JOIN cf USING (cat) WHERE NOT starts_with(name, 'small') AND unit <> 'item' AND len(kw) + len(ch) > 0),
sc AS (SELECT DISTINCT cat FROM cf JOIN nm ON list_contains(ch, chapter)),
c1 AS (SELECT cat, nm.*, list_position(ch, chapter) AS place FROM cf JOIN nm ON list_contains(ch, chapter)),
c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY cat, code ORDER BY place, norm) = 1 UNION ALL SELECT cat, nm.*, 0 FROM cf CROSS JOIN nm WHERE cat NOT IN (SELECT cat FROM sc) AND len(kw) + len(ch) > 0),
c3 AS (SELECT c2.*, kw, len(list_filter(kw, lambda x: contains(search, x))) AS hits, len(list_filter(ex, lambda x: contains(search, x))) AS bad, len(list_filter(ch, lambda x: contains(chapter, x))) AS inch, machine FROM c2 JOIN cf USING (cat)),
c4 AS (SELECT * FROM c3 QUALIFY len(kw) = 0 OR max(hits) OVER (PARTITION BY cat) = 0 OR hits > 0),
c5 AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY place, norm) AS k FROM c4),
m0 AS (SELECT ok.item, ok.name, ok.t, ok.unit AS iu, c5.*, len(list_filter(regexp_extract_all(lower(t), '[a-z]{{4,}}'), lambda x: contains(search, x))) > 0 AS th FROM ok JOIN c5 ON ok.cat = c5.cat WHERE len(c5.kw) = 0 OR k <= 200),
m1 AS (SELECT *, bool_or(th) OVER (PARTITION BY item) AS any_th FROM m0),
m2 AS (SELECT * FROM m1 WHERE len(kw) > 0 OR NOT any_th OR th QUALIFY len(kw) > 0 OR NOT any_th OR row_number() OVER (PARTITION BY item ORDER BY place, norm) <= 200),
m3 AS (SELECT *, CAST(hits * 30 + CASE WHEN len(kw) > 0 AND hits = 0 THEN -15 ELSE 0 END - 50 * bad + CASE WHEN inch > 0 THEN 15 ELSE 0 END + CASE WHEN machine AND manual THEN -30 ELSE 0 END
  + CASE WHEN unit = '' THEN -20 WHEN iu = '' THEN 0 WHEN iu = unit THEN 30 WHEN concat(least(iu, unit), '/', greatest(iu, unit)) IN ('kg/t', 'cm/mm', 'cm/m') THEN 20 WHEN unit = 'item' THEN -30 ELSE -100 END
  + CASE WHEN resources = '' OR NOT contains(t, 'concrete') THEN 0 WHEN contains(resources, 'cement') THEN 40 ELSE -50 END + CASE WHEN resources = '' OR NOT contains(t, 'steel') THEN 0 WHEN contains(resources, 'plate') THEN 30 ELSE -40 END
  + least(20, 10 * (CAST(contains(t, 'weld') AND contains(work, 'weld') AS INTEGER) + CAST(contains(t, 'paint') AND contains(work, 'paint') AS INTEGER) + CAST(contains(t, 'drill') AND contains(work, 'drill') AS INTEGER)))
  + least(10, 5 * len(list_filter(list_distinct(regexp_extract_all(t, '[CM]\d{{2,3}}')), lambda x: contains(attributes, x)))) AS BIGINT) AS score FROM m2),
b AS (SELECT * FROM m3 QUALIFY row_number() OVER (PARTITION BY item, code ORDER BY score DESC, place, norm) = 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, place, norm) AS INTEGER) AS nth FROM b),
v AS (SELECT item, CASE WHEN score < 30 THEN 'low score' WHEN unit = '' THEN 'no unit' ELSE 'matched' END AS verdict FROM r WHERE nth = 1)
"""


def _sides(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return [spark.sql(side.replace("FROM part", "FROM {part}"), part=part) for side in (_ITEM_SIDE, _NORM_SIDE)]


@query("c8_scoped_match", f"""
{_SCOPED} SELECT it.item, CASE WHEN it.item NOT IN (SELECT item FROM ok) THEN 'no norm' ELSE coalesce(v.verdict, 'low score') END AS verdict, nth, norm, code, score FROM it LEFT JOIN v ON v.item = it.item LEFT JOIN (SELECT * FROM r WHERE nth <= 5) r ON r.item = it.item
""")
def c8_scoped(spark, sf_dir):
    return scoped_match(*_sides(spark, sf_dir), _CATEGORIES, _SCORES)


@query("d9_no_norm_reasons", f"""
{_SCOPED}, rs AS (SELECT CASE WHEN starts_with(name, 'small') THEN 'title' WHEN unit = 'item' THEN 'conceptual unit' WHEN cat IS NULL THEN 'no category' ELSE 'empty category' END AS reason FROM ic WHERE item NOT IN (SELECT item FROM ok))
SELECT reason, count(*) AS items FROM rs GROUP BY reason
""")
def d9_reasons(spark, sf_dir):
    return no_norm_reasons(_sides(spark, sf_dir)[0], _CATEGORIES, _SCORES)


@query("d9_unit_problems", f"""
{_SCOPED.replace('<= 200', '<= 2')} SELECT item, iu AS unit, norm, unit AS norm_unit, CASE WHEN unit = '' THEN 'none' WHEN unit = 'item' THEN 'other kind' ELSE 'other' END AS fit FROM r
WHERE nth = 1 AND score < 30 AND (unit = '' OR (iu <> '' AND iu <> unit AND concat(least(iu, unit), '/', greatest(iu, unit)) NOT IN ('kg/t', 'cm/mm', 'cm/m')))
""")
def d9_units(spark, sf_dir):
    items, pool = _sides(spark, sf_dir)
    return unit_problems(scoped_match(items, pool, _CATEGORIES, _SCORES, most=2), items, pool, _SCORES)


@query("c9_fallback_match", f"""
WITH {_SCORED}, p AS (SELECT item, code, score FROM m WHERE nth <= 3 AND norm % 2 = 0), q AS (SELECT item, code, score FROM m WHERE nth <= 3 AND norm % 2 = 1),
w AS (SELECT item FROM p GROUP BY item HAVING max(score) < 70),
u AS (SELECT *, 1 AS library FROM p UNION ALL SELECT *, 2 FROM q WHERE item IN (SELECT item FROM w)),
o AS (SELECT item, code, score, library FROM (SELECT *, row_number() OVER (PARTITION BY item, code ORDER BY score DESC, library) AS k FROM u) WHERE k = 1)
SELECT * FROM (SELECT item, code, score, library, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, code) AS INTEGER) AS nth FROM o) WHERE nth <= 2
""")
def c9(spark, sf_dir):
    hits = _scored(spark, sf_dir)
    one, two = (hits.where(f"norm % 2 = {i}").select("item", "code", "score") for i in (0, 1))
    return reconcile.fallback_match(one, two, 70, 2)


_LEXICON = Lexicon({"gear": "齿轮", "cold ring": "冷环", "bolt": "螺栓"}, {"齿轮": ["gear", "toothed wheel"], "螺栓": ["bolt", "screw bolt"], "混凝土": ["concrete", "lean mix"], "环": ["ring"]})
_OFFER_ITEMS = """
SELECT p_partkey AS item, p_brand AS family, concat(p_name, CASE p_partkey % 6 WHEN 0 THEN concat(' C', 20 + p_size % 30, ' concrete') WHEN 1 THEN ' Formwork 20 mm' WHEN 2 THEN ' crushed rock' WHEN 3 THEN ' 28 MPa lean concrete' WHEN 4 THEN ' screw' ELSE '' END) AS text,
  CASE p_size % 5 WHEN 0 THEN 'sqm' WHEN 1 THEN 'Kgs' WHEN 2 THEN 'm ³' WHEN 3 THEN 'pcs.' END AS unit, CASE p_size % 3 WHEN 0 THEN '土建工程' WHEN 1 THEN '安装工程' ELSE 'other' END AS discipline FROM part
"""
_OFFER_RATES = """
SELECT rate_id, concat(name, CASE CAST(floor(price) AS BIGINT) % 7 WHEN 0 THEN ' 齿轮' WHEN 1 THEN ' C30 concrete' WHEN 2 THEN ' formwork 20mm' WHEN 3 THEN ' gravel 300 ksc' WHEN 4 THEN ' Compacted rock C25' WHEN 5 THEN ' Screws' ELSE '' END) AS name,
  CASE CAST(floor(price) AS BIGINT) % 4 WHEN 0 THEN 'm2' WHEN 1 THEN 'ton' WHEN 2 THEN 'no' ELSE 'm3' END AS unit, CASE CAST(floor(price) AS BIGINT) % 3 WHEN 0 THEN '土建' WHEN 1 THEN '专业分包' ELSE '机电' END AS specialty, specialty = 'Brand#11' AS preferred FROM rates
"""
_OFFER_TERMS = rf"""
gl(k, v) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _LEXICON.glossary.items())}), sy(key, said) AS (VALUES {", ".join(f"('{k}', '{s}')" for k, said in _LEXICON.synonyms.items() for s in said)}),
it AS ({_OFFER_ITEMS}), rt AS ({_OFFER_RATES}), tx AS (SELECT DISTINCT text FROM it), nm AS (SELECT DISTINCT name FROM rt),
en AS (SELECT DISTINCT text, word FROM (SELECT text, unnest(regexp_extract_all(lower(text), '\w{{3,}}')) AS word FROM tx) WHERE NOT regexp_matches(word, '^\d+$')),
cn AS (SELECT text, v AS word FROM tx JOIN gl ON contains(lower(text), k) UNION SELECT text, concat('C', unnest(regexp_extract_all(lower(text), 'c(\d+)\s*concrete', 1))) FROM tx
  UNION SELECT text, concat(unnest(regexp_extract_all(lower(text), '(\d+)\s*mm', 1)), 'mm') FROM tx UNION SELECT text, key FROM en JOIN sy ON list_contains(string_split(said, ' '), word)),
bk AS (SELECT DISTINCT text, said AS word FROM cn JOIN sy ON key = word OR (length(word) >= 2 AND (contains(key, word) OR contains(word, key)))),
te AS (SELECT text, word, FALSE AS local FROM en UNION SELECT text, word, FALSE FROM bk UNION SELECT text, word, TRUE FROM cn),
ft AS (SELECT DISTINCT family, word, local FROM it JOIN te USING (text)),
hn AS (SELECT word, local, name FROM (SELECT DISTINCT word, local FROM ft) JOIN nm ON contains(CASE WHEN local THEN name ELSE lower(name) END, word)),
fs AS (SELECT family, name, CAST(sum(CASE WHEN local THEN 6 ELSE 4 END) AS DOUBLE) AS s FROM ft JOIN hn USING (word, local) GROUP BY family, name)
"""
_POOL = """
po AS (SELECT family, CAST(row_number() OVER (PARTITION BY family ORDER BY s + CASE WHEN preferred THEN 8 ELSE 0 END DESC, rate_id) AS INTEGER) AS nth, rate_id, s + CASE WHEN preferred THEN 8 ELSE 0 END AS score FROM fs JOIN rt USING (name) QUALIFY nth <= 40)
"""


def _offers(spark, sf_dir):
    items = spark.sql(_OFFER_ITEMS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return items, spark.sql(_OFFER_RATES.replace("FROM rates", "FROM {rates}"), rates=table(spark, sf_dir, "rates"))


@query("c11_family_pool", f"WITH {_OFFER_TERMS}, {_POOL} SELECT * FROM po")
def c11(spark, sf_dir):
    return family_pool(*_offers(spark, sf_dir), _LEXICON)


def _reranked(spark, sf_dir, factors):
    items, rates = _offers(spark, sf_dir)
    pool = stored(family_pool(items, rates, _LEXICON))
    return rerank_candidates(items, pool, rates, _LEXICON, factors)


@query("c10_rerank_candidates")
def c10(spark, sf_dir):
    return _reranked(spark, sf_dir, None)


def _plain_unit(unit: str) -> str:
    bare = f"translate(regexp_replace(lower(trim({unit})), '[ .]', '', 'g'), '²³', '23')"
    return f"coalesce(CASE {bare} {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in UNIT_ALIASES.items())} ELSE {bare} END, '')"


_GRADES = r"""nullif(regexp_extract(lower({0}), '(\d+)\s*mpa', 1), '')::DOUBLE, nullif(regexp_extract(lower({0}), '(\d+)\s*ksc', 1), '')::DOUBLE / 10, nullif(regexp_extract(lower({0}), '\bc(\d{{2}})\b', 1), '')::DOUBLE"""
_MATERIAL_SQL = " + ".join(f"CASE WHEN regexp_matches(lower(text), '{a}') AND regexp_matches(lower(name), '{b}') THEN {p} ELSE 0 END" for a, b, p in MATERIALS)
_AFFINITY_SQL = ", ".join(f"('{d}', '{s}', {v})" for d, to in AFFINITY.items() for s, v in to.items())
_KINDS_SQL = ", ".join(f"('{u}', {n})" for n, kind in enumerate(UNIT_KINDS) for u in kind)


@query("c10_rerank_without_fuzzy", f"""
WITH {_OFFER_TERMS}, {_POOL}, af(discipline, specialty, v) AS (VALUES {_AFFINITY_SQL}), ki(u, kind) AS (VALUES {_KINDS_SQL}),
mt AS (SELECT item, text, discipline, {_plain_unit('it.unit')} AS iu, rt.*, {_plain_unit('rt.unit')} AS ru FROM it JOIN po USING (family) JOIN rt USING (rate_id)),
pr AS (SELECT DISTINCT text, name FROM mt),
hi AS (SELECT text, name, count(*) FILTER (NOT local AND contains(lower(name), word)) * 5 + count(*) FILTER (local AND contains(name, word)) * 7 AS h FROM pr JOIN te USING (text) GROUP BY text, name),
gr AS (SELECT text, name, h + {_MATERIAL_SQL} AS h, coalesce({_GRADES.format('text')}) AS ga, coalesce({_GRADES.format('name')}) AS gb FROM hi),
gp AS (SELECT text, name, h + CASE WHEN ga IS NULL THEN 0 WHEN gb IS NULL THEN -3 WHEN ga = gb THEN 15 WHEN abs(ga - gb) <= 4 THEN 10 WHEN abs(ga - gb) <= 8 THEN 3 WHEN abs(ga - gb) <= 15 THEN -5 ELSE -15 END AS h FROM gr),
sc AS (SELECT item, rate_id, round(CAST(h AS DOUBLE) + 20 * CASE WHEN iu = '' OR ru = '' THEN 0.3::DOUBLE WHEN iu = ru THEN 1 WHEN (SELECT kind FROM ki WHERE u = iu) = (SELECT kind FROM ki WHERE u = ru) THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END
  + 10 * coalesce(af.v, 0.2)::DOUBLE + CASE WHEN preferred THEN 4 ELSE 0 END, 6) AS score FROM mt JOIN gp USING (text, name) LEFT JOIN af USING (discipline, specialty))
SELECT item, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, rate_id) AS INTEGER) AS nth, rate_id, score FROM sc WHERE score >= 12 QUALIFY nth <= 8
""")
def c10_without_fuzzy(spark, sf_dir):
    return _reranked(spark, sf_dir, Factors(fuzzy=0))


@query("c12_code_join_writeback", f"""
WITH u AS (SELECT concat({_clean('descr')}, '|', lower(unit)) AS k, min(code) AS norm_code FROM boq_a WHERE row_no % 3 <> 0 GROUP BY 1)
SELECT row_no, norm_code FROM boq_b LEFT JOIN u ON k = concat({_clean('descr')}, '|', lower(unit))
""")
def c12(spark, sf_dir):
    a, b = _boq(spark, sf_dir, "a", "b")
    return reconcile.code_join_writeback(a.where("row_no % 3 <> 0").withColumn("norm_code", F.col("code")), b).select("row_no", "norm_code")


@query("c13_variant_join", """
WITH l AS (SELECT p_name AS key, min(p_brand) AS code FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name),
m AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat('{', p_name, '}') WHEN 2 THEN concat('- ', p_name) ELSE concat('3. ', p_name) END AS t, p_partkey % 4 AS v, p_name FROM part)
SELECT p_partkey, CASE WHEN code IS NOT NULL THEN CAST(v AS INTEGER) END AS variant, code FROM m LEFT JOIN l ON key = p_name
""")
def c13(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("{"), "p_name", F.lit("}"))).when(k == 2, F.concat(F.lit("- "), "p_name")).otherwise(F.concat(F.lit("3. "), "p_name"))
    lookup = part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("key"), F.col("p_brand").alias("code"))
    return reconcile.variant_join(part.withColumn("t", text), lookup, "p_partkey", "t").select("p_partkey", "variant", "code")


@query("c14_writeback_guarded", """
WITH r AS (SELECT code, qty AS price, CASE row_no % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'none' ELSE 'low' END AS status FROM boq_b),
m AS (SELECT row_no, row_no % 17 = 0 AS is_total, CASE WHEN row_no % 5 = 0 THEN 9.5 WHEN row_no % 5 = 1 THEN 0.0 END AS mp, price, status FROM boq_a LEFT JOIN r USING (code)),
x AS (SELECT *, CASE WHEN is_total THEN 'skip total' WHEN mp > 0 THEN 'skip manual' WHEN status IS NULL THEN 'missing' WHEN status IN ('high', 'low') THEN 'written' ELSE 'cleared' END AS action FROM m)
SELECT row_no, action, CAST(CASE WHEN action = 'written' THEN price WHEN action IN ('skip total', 'skip manual') THEN mp END AS DOUBLE) AS new_price FROM x
""")
def c14(spark, sf_dir):
    a, b = _boq(spark, sf_dir, "a", "b")
    n = F.col("row_no") % 5
    current = a.select("row_no", "code", (F.col("row_no") % 17 == 0).alias("is_total"), F.when(n == 0, 9.5).when(n == 1, 0.0).alias("manual_price"))
    s = F.col("row_no") % 3
    results = b.select("code", F.col("qty").alias("price"), F.when(s == 0, "high").when(s == 1, "none").otherwise("low").alias("status"))
    return reconcile.writeback_guarded(current, results).select("row_no", "action", "new_price")


@query("c15_apply_decisions", """
WITH m AS (SELECT p_partkey AS source, p_partkey AS target, p_retailprice AS price FROM part WHERE p_partkey % 9 <> 4), d AS (SELECT p_partkey AS source, p_partkey + 1 AS target, p_retailprice * 2 AS price FROM part WHERE p_partkey % 9 = 3),
p AS (SELECT * FROM (SELECT * FROM m WHERE source NOT IN (SELECT source FROM d) UNION ALL SELECT * FROM d) WHERE source % 13 <> 0)
SELECT (SELECT count(*) FROM (SELECT target FROM p GROUP BY target HAVING count(*) > 1)) AS targets_hit_twice, round(sum(price), 2) AS total FROM p
""")
def c15(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.col("p_partkey").alias("target"), F.col("p_retailprice").alias("price"))
    manual = part.where("source % 9 = 3").select("source", (F.col("target") + 1).alias("target"), (F.col("price") * 2).alias("price"))
    _, checks = reconcile.apply_decisions(part.where("source % 9 <> 4"), manual, part.where("source % 13 = 0"))
    return checks.withColumn("total", F.round("total", 2))


@query("c16_layered_override", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Brand#00' WHEN p_partkey % 3 = 0 THEN 'Brand#03' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part
""")
def c16(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    one = part.where("p_partkey % 3 = 0").withColumns({"p_brand": F.lit("Brand#03"), "p_size": F.col("p_size") + 100})
    two = part.where("p_partkey % 5 = 0").withColumns({"p_brand": F.lit("Brand#00"), "p_size": F.lit(None).cast("int")})
    return reconcile.layered_override(part, [one, two], "p_partkey", ["p_brand", "p_size"])


@query("c17_hierarchical_lookup", """
SELECT o_orderkey, concat_ws('/', r_name, n_name, c_name) AS path FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def c17(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("node"))
    return reconcile.hierarchical_lookup(rows, table(spark, sf_dir, "tree"), "node").select("o_orderkey", "path")


@query("c18_stale_sources", """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'source_missing' WHEN doc_id % 7 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM documents
""")
def c18(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/d/"), "doc_id").alias("path"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mtime"))
    files = docs.where("doc_id % 10 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.lit("2024-01-02 00:00:00").cast("timestamp")).otherwise(F.col("mtime")).alias("mtime"))
    return reconcile.stale_sources(docs, files).select("doc_id", "state")


@query("c19_nearest_token_join", """
WITH a AS (SELECT * FROM points WHERE token_id % 2 = 0), b AS (SELECT * FROM points WHERE token_id % 2 = 1)
SELECT a.token_id, arg_min(b.token_id, (pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.token_id)) AS b_id, min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d2
FROM a JOIN b ON a.page = b.page AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 2500 GROUP BY a.token_id
""")
def c19(spark, sf_dir):
    p = table(spark, sf_dir, "points")
    return reconcile.nearest_token_join(p.where("token_id % 2 = 0"), p.where("token_id % 2 = 1"), 50.0)


@query("c20_place_unmatched", """
WITH s AS (SELECT DISTINCT concat(split_part(code, '.', 1), '.', split_part(code, '.', 2)) AS sc FROM boq_a WHERE n_ok), boq AS (SELECT 1)
SELECT row_no, CASE WHEN sc IS NOT NULL THEN concat('S', sc) WHEN unit = 'SMALL' THEN 'S-small' ELSE 'new' END AS section, CASE WHEN sc IS NOT NULL THEN 'code' WHEN unit = 'SMALL' THEN 'unit' ELSE 'new' END AS how FROM boq_b LEFT JOIN s ON sc = concat(split_part(code, '.', 1), '.', split_part(code, '.', 2))
""".replace("FROM boq_a WHERE n_ok), boq AS (SELECT 1)", "FROM boq_a WHERE substr(code, 1, 1) < 'C')"))
def c20(spark, sf_dir):
    a, b = _boq(spark, sf_dir, "a", "b")
    sc = F.substring_index("code", ".", 2)
    sections = a.where(F.substring("code", 1, 1) < "C").select(sc.alias("section_code"), F.concat(F.lit("S"), sc).alias("section"), F.lit("").alias("unit_group")).distinct()
    sections = sections.unionByName(spark.createDataFrame([("?", "S-small", "SMALL")], "section_code string, section string, unit_group string"))
    return reconcile.place_unmatched(b, sections).select("row_no", "section", "how")


_VOCAB = [("gear works", "spur gears"), ("rings", "red ring seals"), ("fasteners", "bolt and nut"), ("general", "widget")]


@query("c21_candidate_divisions", f"""
WITH v(division, sub) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _VOCAB)}),
d AS (SELECT DISTINCT division, unnest(list_concat(string_split(division, ' '), string_split(sub, ' '))) AS word FROM v),
g AS (SELECT DISTINCT p_brand AS grp, unnest(string_split(lower(p_name), ' ')) AS word FROM part)
SELECT DISTINCT grp, division FROM g JOIN d USING (word) WHERE length(word) > 2 UNION SELECT DISTINCT p_brand, 'forced' FROM part WHERE p_brand LIKE 'Brand#1%'
""")
def c21(spark, sf_dir):
    groups = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_brand").alias("path"), F.col("p_name").alias("text"))
    return reconcile.candidate_divisions(groups, spark.createDataFrame(_VOCAB, "division string, sub string"), [("^Brand#1", ["forced"])])


@query("c22_unified_list", f"""
WITH {_STAGES}, k AS (SELECT other_row, base_row FROM (SELECT *, row_number() OVER (PARTITION BY base_row ORDER BY other_row) AS n FROM c) WHERE n = 1)
SELECT {_BLOCK} AS block, 0 AS kind, 0 AS source_no, a.row_no, a.code, a.qty AS base_qty, b.qty AS b_qty FROM boq_a a LEFT JOIN k ON base_row = a.row_no LEFT JOIN (SELECT row_no AS brow, qty FROM boq_b) b ON brow = other_row
UNION ALL SELECT {_BLOCK}, 1, 1, row_no, code, NULL, qty FROM boq_b WHERE row_no NOT IN (SELECT other_row FROM k)
""")
def c22(spark, sf_dir):
    a, b = _boq(spark, sf_dir, "a", "b")
    return reconcile.unified_list(a, {"b": b}, None, None)


@query("c22_unified_list_similar")
def c22s(spark, sf_dir):
    a, b, c = _boq(spark, sf_dir, "a", "b", "c")
    return reconcile.unified_list(a, {"b": b, "c": c})


@query("g1_three_way_sync", f"""
WITH n AS (SELECT {_clean('descr')} AS key FROM boq_a WHERE row_no % 2 = 0 GROUP BY 1), o AS (SELECT {_clean('descr')} AS key, arg_max(code, row_no) AS note FROM boq_b WHERE row_no % 3 = 0 GROUP BY 1)
SELECT coalesce(n.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'new' WHEN n.key IS NULL THEN 'deleted' ELSE 'matched' END AS state, note FROM n FULL JOIN o ON n.key = o.key
""")
def g1(spark, sf_dir):
    a, b = _boq(spark, sf_dir, "a", "b")
    return reconcile.three_way_sync(a.where("row_no % 2 = 0"), b.where("row_no % 3 = 0").withColumn("note", F.col("code")))


def _updates(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    one = part.where("p_partkey % 3 = 0").select("p_partkey", F.lit(1).alias("seq"), F.lit("fix").alias("action"), F.lit("p_brand").alias("field"), F.lit("X").alias("value"))
    two = part.where("p_partkey % 6 = 0").select("p_partkey", F.lit(2).alias("seq"), F.lit("fix").alias("action"), F.lit("p_brand").alias("field"), F.lit("").alias("value"))
    keep = part.select("p_partkey", F.lit(3).alias("seq"), F.lit("keep").alias("action"), F.lit("p_type").alias("field"), F.lit("Z").alias("value"))
    typed = part.where("p_partkey % 5 = 0").select("p_partkey", F.lit(1).alias("seq"), F.lit("fix").alias("action"), F.lit("p_type").alias("field"), F.lit("T").alias("value"))
    return one.unionByName(two).unionByName(keep).unionByName(typed)


_AFTER = "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'X' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 5 = 0 THEN 'T' ELSE p_type END AS p_type FROM part"


@query("g2_apply_updates", _AFTER)
def g2(spark, sf_dir):
    master = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return reconcile.apply_updates(master, _updates(spark, sf_dir), "p_partkey", ["p_brand", "p_type"])


@query("g3_change_log", f"""
WITH a AS ({_AFTER}) SELECT a.p_partkey, 'p_brand' AS field, part.p_brand AS old, a.p_brand AS new FROM a JOIN part USING (p_partkey) WHERE part.p_brand IS DISTINCT FROM a.p_brand
UNION ALL SELECT a.p_partkey, 'p_type', part.p_type, a.p_type FROM a JOIN part USING (p_partkey) WHERE part.p_type IS DISTINCT FROM a.p_type
""")
def g3(spark, sf_dir):
    master = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    after = reconcile.apply_updates(master, _updates(spark, sf_dir), "p_partkey", ["p_brand", "p_type"])
    return reconcile.change_log(master, after, "p_partkey", ["p_brand", "p_type"])


@query("g5_union_distinct", """
SELECT p_partkey, p_name, part FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY part) AS n FROM (
  SELECT p_partkey, p_name, 0 AS part FROM part WHERE p_name LIKE '%red%' UNION ALL SELECT p_partkey, p_name, 1 FROM part WHERE p_size > 25)) WHERE n = 1
""")
def g5(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return reconcile.union_distinct([part.where("p_name like '%red%'"), part.where("p_size > 25")], "p_partkey").select("p_partkey", "p_name", "part")


@query("g6_dedupe_exact", "SELECT p_name, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY p_name, p_type")
def g6(spark, sf_dir):
    return reconcile.dedupe_exact(table(spark, sf_dir, "part").select("p_name", "p_type", "p_partkey"), ["p_name", "p_type"], "p_partkey")


@query("g8_maintenance_level", """
WITH o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id % 11 <> 1),
n AS (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 7 = 0 THEN concat(text, chr(10), 'x', chr(10), 'y') ELSE text END, chr(10))) AS line FROM documents WHERE doc_id % 10 <> 0),
d AS (SELECT coalesce(a.doc_id, b.doc_id) AS path, sum(abs(coalesce(now, 0) - coalesce(was, 0))) AS changed, sum(was) AS ol, sum(now) AS nl FROM
  (SELECT doc_id, line, count(*) AS was FROM o GROUP BY 1, 2) a FULL JOIN (SELECT doc_id, line, count(*) AS now FROM n GROUP BY 1, 2) b ON a.doc_id = b.doc_id AND a.line = b.line GROUP BY 1)
SELECT path, CASE WHEN nl IS NULL THEN 'L0' WHEN ol IS NULL THEN 'L1' WHEN changed = 0 THEN 'skip' WHEN changed / ol >= 0.05 THEN 'L1' ELSE 'L0' END AS level, CAST(changed AS BIGINT) AS changed FROM d
""")
def g8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    new = docs.where("path % 10 <> 0").withColumn("text", F.when(F.col("path") % 7 == 0, F.concat("text", F.lit("\nx\ny"))).otherwise(F.col("text")))
    return reconcile.maintenance_level(docs.where("path % 11 <> 1"), new)


@query("g9_memory_upsert", """
WITH c AS (SELECT concat('k', conv_id % 40) AS key, conv_id * 100 + turn AS seq, CASE WHEN turn % 7 = 3 THEN 'remove' ELSE 'add' END AS action, text FROM conversations),
l AS (SELECT key, arg_max(action, seq) AS action, arg_max(text, seq) AS text FROM c WHERE NOT regexp_matches(text, '(?i)today|temp') GROUP BY key),
m AS (SELECT concat('k', n_nationkey) AS key, n_name AS text FROM nation)
SELECT coalesce(m.key, l.key) AS key, coalesce(l.text, m.text) AS text FROM m FULL JOIN l ON m.key = l.key WHERE l.action IS NULL OR l.action <> 'remove'
""")
def g9(spark, sf_dir):
    commands = table(spark, sf_dir, "conversations").select(F.concat(F.lit("k"), F.col("conv_id") % 40).alias("key"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.when(F.col("turn") % 7 == 3, "remove").otherwise("add").alias("action"), "text")
    current = table(spark, sf_dir, "nation").select(F.concat(F.lit("k"), "n_nationkey").alias("key"), F.col("n_name").alias("text"))
    kept, _ = reconcile.memory_upsert(current, commands, "(?i)today|temp")
    return kept
