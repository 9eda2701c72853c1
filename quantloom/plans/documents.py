"""Queries on documents, messages and search (H and I of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import retrieval, text_jobs
from quantloom.plans.registry import query
from quantloom.sources.fixtures import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("h1_chunk_documents")
def h1(spark, sf_dir):
    return text_jobs.chunk_documents(_docs(spark, sf_dir), "doc_id", "text")


#: Texts of one paragraph without headings and rules, which SQL can cut.
_PLAIN = r"text is not null and not {0}(text, '(^|\n)(#|[ \t]*[-_*]{{3,}}[ \t]*(\n|$))') and not {0}(text, '\n\s*\n')"


@query("h1_chunk_totals", f"""
WITH p AS (SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents WHERE {_PLAIN.format("regexp_matches")}),
c AS (SELECT doc_id, trim(substr(t, 800 * i + 1, 800), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS chunk FROM (SELECT doc_id, t, unnest(range(CAST(ceil(length(t) / 800.0) AS BIGINT))) AS i FROM p))
SELECT doc_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM c WHERE chunk <> '' GROUP BY doc_id
""")
def h1b(spark, sf_dir):
    docs = _docs(spark, sf_dir).where(_PLAIN.format("regexp").replace("\\", "\\\\"))
    chunks = text_jobs.chunk_documents(docs, "doc_id", "text")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


@query("h2_quality_gate", """
WITH m AS (SELECT doc_id, trim(text) AS t FROM documents), c AS (SELECT doc_id, length(t) AS chars, length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) AS word_chars, len(list_filter(string_split(t, chr(10)), lambda x: length(trim(x)) >= 4)) AS lines FROM m)
SELECT *, CASE WHEN chars = 0 THEN 'empty' WHEN chars < 80 THEN 'short' WHEN word_chars < 50 THEN 'sparse' WHEN lines < 3 THEN 'few lines' ELSE 'accepted' END AS verdict FROM c
""")
def h2(spark, sf_dir):
    return text_jobs.quality_gate(_docs(spark, sf_dir), "doc_id", "text")


@query("h3_find_price_documents", """
WITH d AS (SELECT page_id AS doc_id, replace(html, '><', '>' || chr(10) || '<') AS text FROM pages),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS t FROM d),
m AS (SELECT *, last_value(CASE WHEN regexp_matches(t, '^<article') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS h FROM l),
g AS (SELECT doc_id, count(*) FILTER (contains(t, '|')) AS tables, count(*) FILTER (contains(t, '|') AND regexp_matches(t, '[0-9]')) AS nt, count(*) FILTER (regexp_matches(t, '[0-9]') AND line - h <= 200) AS numeric_after FROM m GROUP BY doc_id)
SELECT doc_id, tables, numeric_after FROM g WHERE numeric_after >= 5 OR (tables >= 3 AND nt > 0.25 * tables)
""")
def h3(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.replace("html", F.lit("><"), F.lit(">\n<")).alias("text"))
    return text_jobs.find_price_documents(pages, "doc_id", "text", "^<article")


@query("h4_numeric_blocks")
def h4(spark, sf_dir):
    return text_jobs.numeric_blocks(_docs(spark, sf_dir), "doc_id", "text", "(?i)token|price")


@query("h5_price_rows_from_cells", """
SELECT DISTINCT p_brand, p_type AS name, CAST(p_retailprice AS VARCHAR) AS price, concat('s', p_size) AS note FROM part
""")
def h5(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cells = part.select("p_brand", F.col("p_partkey").alias("row"), F.posexplode(F.array("p_type", F.col("p_retailprice").cast("string"), F.concat(F.lit("s"), "p_size"))).alias("col", "value")).where("row > 0")
    cells = cells.unionByName(part.where("p_partkey = 0").select("p_brand", F.lit(1 << 40).alias("row"), F.posexplode(F.array("p_type", F.col("p_retailprice").cast("string"), F.concat(F.lit("s"), "p_size"))).alias("col", "value")))
    heads = part.select("p_brand").distinct().select("p_brand", F.lit(0).cast("bigint").alias("row"), F.posexplode(F.array(F.lit("Item name"), F.lit("Unit price"), F.lit("Size"))).alias("col", "value"))
    return text_jobs.price_rows_from_cells(cells.unionByName(heads), "p_brand", "row", "col", "value", {"name": "name|item", "price": "price"})


_WORDS = [("the", "x"), ("of", "x"), ("der", "y"), ("die", "y"), ("la", "z"), ("que", "z")]


@query("h5_infer_headers", """
WITH r AS (SELECT p_brand AS sheet, p_partkey + 1 AS row, p_name AS a, CAST(p_partkey AS VARCHAR) AS b, CAST(p_size AS VARCHAR) AS c FROM part UNION ALL SELECT DISTINCT p_brand, 0, 'Name', 'Price', 'Price' FROM part WHERE ascii(substr(p_brand, 7, 1)) % 2 = 0),
s AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY row) AS n, 4 + CAST(length(b) >= 2 AS INTEGER) + CAST(length(c) >= 2 AS INTEGER) AS score FROM r),
h AS (SELECT x.sheet, x.row, x.a, x.b, CASE WHEN x.b = x.c THEN concat(x.c, '_2') ELSE x.c END AS c FROM s x JOIN s y ON y.sheet = x.sheet AND y.n = 2 WHERE x.n = 1 AND x.score >= y.score),
l AS (SELECT sheet, row, 0 AS col, a AS value FROM r UNION ALL SELECT sheet, row, 1, b FROM r UNION ALL SELECT sheet, row, 2, c FROM r)
SELECT l.sheet, l.row, l.col, value, CASE WHEN h.sheet IS NULL THEN concat('col_', col + 1) WHEN col = 0 THEN h.a WHEN col = 1 THEN h.b ELSE h.c END AS header FROM l LEFT JOIN h ON h.sheet = l.sheet WHERE h.row IS NULL OR l.row <> h.row
""")
def h5_headers(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    body = part.select(F.col("p_brand").alias("sheet"), (F.col("p_partkey") + 1).alias("row"), F.array("p_name", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).alias("v"))
    heads = part.where("ascii(substr(p_brand, 7, 1)) % 2 = 0").select(F.col("p_brand").alias("sheet")).distinct().withColumns({"row": F.lit(0), "v": F.array(*map(F.lit, ("Name", "Price", "Price")))})
    cells = body.unionByName(heads).select("sheet", "row", F.posexplode("v").alias("col", "value"))
    return text_jobs.infer_headers(cells, "sheet", "row", "col", "value")


@query("h7_qa_category", f"""
WITH d(word, category) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _WORDS)}),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM documents), s AS (SELECT doc_id, category, count(*) AS score FROM w JOIN d USING (word) GROUP BY 1, 2),
b AS (SELECT doc_id, category, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category DESC) AS n FROM s) WHERE n = 1)
SELECT doc_id, coalesce(category, 'none') AS category, coalesce(score, 0) AS score FROM documents LEFT JOIN b USING (doc_id)
""")
def h7(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return text_jobs.qa_category(docs, "doc_id", "text", spark.createDataFrame(_WORDS, "word string, category string"), ["z", "y", "x"])


@query("h8_memory_candidates", """
WITH l AS (SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS pos, trim(unnest(string_split(text, chr(10)))) AS line FROM conversations),
o AS (SELECT conv_id, line, min(turn * 100000 + pos) AS f FROM l WHERE length(line) BETWEEN 6 AND 120 AND regexp_matches(line, 'the|de') AND NOT regexp_matches(line, '[!$]') GROUP BY 1, 2)
SELECT conv_id, nth, line FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY f, line) AS INTEGER) AS nth FROM o) WHERE nth <= 8
""")
def h8(spark, sf_dir):
    return text_jobs.memory_candidates(table(spark, sf_dir, "conversations"), "the|de", "[!$]")


@query("h9_novelty")
def h9(spark, sf_dir):
    lines = text_jobs.memory_candidates(table(spark, sf_dir, "conversations"), "the|de", "[!$]").withColumnRenamed("line", "text")
    memory = _docs(spark, sf_dir).select("text", "doc_id")
    return text_jobs.novel_candidates(lines, memory, "text", "doc_id")


@query("h10_procedural_steps")
def h10(spark, sf_dir):
    return text_jobs.procedural_steps(table(spark, sf_dir, "conversations"))


@query("h11_topic_snippets", """
SELECT doc_id, topic, keyword, substr(text, CAST(greatest(instr(text, keyword) - 100, 1) AS BIGINT), 1600) AS snippet FROM (
  SELECT doc_id, text, 'articles' AS topic, CASE WHEN contains(text, 'der ') THEN 'der ' WHEN contains(text, 'the ') THEN 'the ' END AS keyword FROM documents
  UNION ALL SELECT doc_id, text, 'links', CASE WHEN contains(text, 'und') THEN 'und' WHEN contains(text, 'and') THEN 'and' END FROM documents) WHERE keyword IS NOT NULL
""")
def h11(spark, sf_dir):
    return text_jobs.topic_snippets(_docs(spark, sf_dir), "doc_id", "text", {"articles": ["der ", "the "], "links": ["und", "and"]})


@query("h12_spec_tokens", "SELECT doc_id, array_to_string(regexp_extract_all(text, '\\b[A-Z]\\d{1,3}\\b'), ',') AS grades, array_to_string(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), ',') AS numbers FROM documents")
def h12(spark, sf_dir):
    return text_jobs.spec_tokens(_docs(spark, sf_dir), "text").select("doc_id", "grades", "numbers")


@query("h13_bilingual_terms", """
WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS term FROM part), d(a, b) AS (VALUES ('red', 'rot'), ('blau', 'blue'), ('ring', 'ringe'))
SELECT * FROM w WHERE length(term) >= 3 UNION SELECT p_partkey, b FROM w JOIN d ON a = term UNION SELECT p_partkey, a FROM w JOIN d ON b = term
""")
def h13(spark, sf_dir):
    pairs = spark.createDataFrame([("red", "rot"), ("blau", "blue"), ("ring", "ringe")], "a string, b string")
    return text_jobs.bilingual_terms(table(spark, sf_dir, "part"), "p_partkey", "p_name", pairs)


@query("i1_norm_index", """
SELECT norm_id, code, unit, lower(concat_ws(' ', name, concat('chapter ', chapter), attr1, attr2)) AS search_text FROM norms
""")
def i1(spark, sf_dir):
    norms = table(spark, sf_dir, "norms")
    chapters = norms.select("chapter", F.concat(F.lit("chapter "), "chapter").alias("chapter_name")).distinct()
    return retrieval.norm_index(norms, chapters).select("norm_id", "code", "unit", "search_text")


_QUERIES = [(1, "onthe"), (2, "schung"), (3, "eaux de")]
_BM25 = f"""
q(query, terms) AS (VALUES {", ".join(f"({n}, '{t}')" for n, t in _QUERIES)}),
qg AS (SELECT DISTINCT query, substr(lower(terms), CAST(i AS BIGINT), 3) AS gram FROM (SELECT query, terms, unnest(range(1, length(terms) - 1)) AS i FROM q)),
"""


def _bm25_sql(source: str, id_: str) -> str:
    return f"""
dt AS (SELECT {id_} AS id, lower(text) AS t, greatest(length(text) - 2, 0) AS len FROM {source}),
g AS (SELECT id, len, substr(t, CAST(i AS BIGINT), 3) AS gram FROM (SELECT id, len, t, unnest(range(1, length(t) - 1)) AS i FROM dt)),
tf AS (SELECT id, len, gram, count(*) AS tf FROM g WHERE gram IN (SELECT gram FROM qg) GROUP BY 1, 2, 3),
dfs AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram), st AS (SELECT count(*) AS n, avg(len) AS mean FROM dt),
sc AS (SELECT query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
  FROM tf JOIN dfs USING (gram) JOIN qg USING (gram) CROSS JOIN st GROUP BY query, id),
rk AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS nth, id, score FROM sc)
"""


def _queries(spark):
    return spark.createDataFrame(_QUERIES, "query bigint, terms string")


@query("i2_bm25_search", f"WITH {_BM25} {_bm25_sql('documents', 'doc_id')} SELECT query, nth, id AS doc_id, score FROM rk WHERE nth <= 10")
def i2(spark, sf_dir):
    return retrieval.bm25_search(_docs(spark, sf_dir), _queries(spark), "doc_id", "text", 10)


_NEAR = "nv AS (SELECT q.vec_id AS query, v.vec_id, round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS distance, v.label AS label FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0)"


def _vector_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))


@query("i3_vector_topk", f"WITH {_NEAR} SELECT query, nth, vec_id, distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS INTEGER) AS nth FROM nv) WHERE nth <= 5")
def i3(spark, sf_dir):
    return retrieval.vector_topk(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), 5)


@query("i4_vector_topk_filtered", f"WITH {_NEAR} SELECT query, nth, vec_id, distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS INTEGER) AS nth FROM nv WHERE label % 2 = 0) WHERE nth <= 5")
def i4(spark, sf_dir):
    return retrieval.vector_topk(table(spark, sf_dir, "embeddings").where("label % 2 = 0"), _vector_queries(spark, sf_dir), 5)


@query("i5_hybrid_search")
def i5(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    asked = retrieval.embed_passages(_queries(spark), "query", "terms").withColumnRenamed("embedding", "q")
    near = retrieval.passage_topk(docs, asked, "doc_id", "text", 20).withColumnRenamed("vec_id", "doc_id")
    return retrieval.hybrid(retrieval.bm25_search(docs, _queries(spark), "doc_id", "text", 20), near, "doc_id", 10)


@query("i7_session_search", f"""
WITH {_BM25} {_bm25_sql('(SELECT CAST(conv_id AS HUGEINT) * 4294967296 + turn AS mk, text FROM conversations)', 'mk')},
b AS (SELECT query, id // 4294967296 AS conv_id, min(nth) AS nth FROM rk WHERE nth <= 15 GROUP BY 1, 2)
SELECT query, n, CAST(conv_id AS BIGINT) AS conv_id, CAST(id % 4294967296 AS BIGINT) AS turn, score FROM (SELECT b.query, CAST(row_number() OVER (PARTITION BY b.query ORDER BY b.nth) AS INTEGER) AS n, conv_id, id, score FROM b JOIN rk ON rk.query = b.query AND rk.nth = b.nth) WHERE n <= 3
""")
def i7(spark, sf_dir):
    return retrieval.session_search(table(spark, sf_dir, "conversations"), _queries(spark), 3)


@query("i8_reembed_passages")
def i8(spark, sf_dir):
    out = retrieval.embed_passages(_docs(spark, sf_dir), "doc_id", "text")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return out.select("doc_id", F.size("embedding").alias("dim"), F.round(norm, 3).alias("norm"))


@query("i9_message_lookup", """
SELECT conv_id, turn, role, c_name AS name FROM conversations LEFT JOIN customer ON c_custkey = conv_id WHERE contains(text, 'ing ') AND role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 30
""")
def i9(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("conv_id"), F.col("c_name").alias("name"))
    return retrieval.message_lookup(table(spark, sf_dir, "conversations"), names, "ing ", "user").select("conv_id", "turn", "role", "name")


@query("i10_passages_by_heading")
def i10(spark, sf_dir):
    return retrieval.passages_by_heading(text_jobs.chunk_documents(_docs(spark, sf_dir), "doc_id", "text"), "doc_id").select("doc_id", "heading", F.length("text").alias("chars"))
