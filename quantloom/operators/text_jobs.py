"""Jobs on documents and messages: chunks, gates, price documents, snippets, candidates for memory."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_HEADING = re.compile(r"^#{1,6}\s+(.*?)\s*$", re.M)
_RULE = re.compile(r"^[^\S\n]*[-_*]{3,}[^\S\n]*$\n?", re.M)


def chunk_text(text: str, most: int) -> list[tuple[str | None, str]]:
    """(heading, chunk): each section's paragraphs, packed up to `most` characters; a longer paragraph is cut
    there and shares no chunk with others. Lines of -, _ or * alone are dropped. Blank texts have no chunk."""
    parts = _HEADING.split(text)  # text before any heading, then heading and text in turn
    out: list[tuple[str | None, str]] = []
    for heading, body in zip([None, *parts[1::2]], parts[0::2], strict=True):
        held: list[str] = []
        for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", _RULE.sub("", body)))):
            if held and sum(map(len, held)) + 2 * len(held) + len(paragraph) > most:
                out.append((heading, "\n\n".join(held)))
                held = []
            if len(paragraph) <= most:
                held.append(paragraph)
            else:
                cuts = (paragraph[i : i + most].strip() for i in range(0, len(paragraph), most))
                out += [(heading, c) for c in cuts if c]
        if held:
            out.append((heading, "\n\n".join(held)))
    return out


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, most: int = 800) -> DataFrame:
    """(id, chunk_order from 1, heading, chunk) of each document; null and blank texts have none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = [(at, n, h, c) for at, t in enumerate(part.column(1).to_pylist()) if t is not None for n, (h, c) in enumerate(chunk_text(t, most), 1)]
                if rows:
                    at, n, h, c = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(n, pa.int32()), pa.array(h, pa.string()), pa.array(c, pa.string())], names=[id_col, "chunk_order", "heading", "chunk"])

    return docs.select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, chunk_order int, heading string, chunk string")


def quality_gate(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, chars, word_chars, lines, verdict): empty, short (under 80 characters), sparse (under 50 letters and
    digits), few lines (under 3 of 4 characters or more), or accepted."""
    t = F.trim(F.coalesce(text_col, F.lit("")))
    lines = F.size(F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) >= 4)).cast("bigint")
    out = docs.select(id_col, F.length(t).cast("bigint").alias("chars"), F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")).cast("bigint").alias("word_chars"), lines.alias("lines"))
    verdict = F.when(F.col("chars") == 0, "empty").when(F.col("chars") < 80, "short").when(F.col("word_chars") < 50, "sparse").when(F.col("lines") < 3, "few lines").otherwise("accepted")
    return out.withColumn("verdict", verdict)


def document_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "text"))


def find_price_documents(docs: DataFrame, id_col: str, text_col: str, heading: str, reach: int = 200) -> DataFrame:
    """Documents with five or more numeric lines within `reach` lines after a heading, or with three or more
    table lines of which a quarter have numbers: (id, tables, numeric_after)."""
    lines = document_lines(docs, id_col, text_col)
    numeric, table = F.col("text").rlike(r"\d"), F.col("text").contains("|")
    w = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("last", F.last(F.when(F.col("text").rlike(heading), F.col("line")), True).over(w))
    out = marked.groupBy(id_col).agg(F.count_if(table).alias("tables"), F.count_if(table & numeric).alias("numeric_tables"), F.count_if(numeric & (F.col("line") - F.col("last") <= reach)).alias("numeric_after"))
    return out.where("numeric_after >= 5 or (tables >= 3 and numeric_tables > 0.25 * tables)").select(id_col, "tables", "numeric_after")


def numeric_blocks(docs: DataFrame, id_col: str, text_col: str, anchor: str, back: int = 5, ahead: int = 80, step: int = 30, least: int = 8, marked: str | None = None, few: int = 4, chars: int = 150) -> DataFrame:
    """(id, first, last, numeric): blocks of more than `chars` characters around the first ten anchors, and where a
    document has fewer than two of these, windows of 60 lines every `step` with `least` numeric lines or more, or
    with `few` of them and a line that `marked` (headings, units) fits."""
    lines = document_lines(docs, id_col, text_col)
    anchors = lines.where(F.col("text").rlike(anchor)).withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy("line"))).where("n <= 10")
    around = anchors.select(id_col, F.greatest(F.col("line") - back, F.lit(0)).alias("first"), (F.col("line") + ahead).alias("last"))
    inside = around.join(lines, id_col).where("line between first and last")  # a line is in ten blocks at most
    sized = inside.groupBy(id_col, "first", "last").agg((F.sum(F.length("text")) + F.count("*") - 1).alias("chars"))
    around = around.join(sized.where(F.col("chars") > chars), [id_col, "first", "last"], "left_semi")
    several = around.groupBy(id_col).agg(F.count("*").alias("n")).where("n >= 2")
    fits = F.col("text").rlike(marked) if marked else F.lit(False)
    told = lines.withColumns({"numeric": F.col("text").rlike(r"\d").cast("bigint"), "fits": fits}).where("numeric = 1 or fits").join(several, id_col, "left_anti")
    start = F.explode(F.array_distinct(F.array(F.floor(F.col("line") / step) * step, F.greatest(F.floor(F.col("line") / step) * step - step, F.lit(0)))))
    sliding = told.select(id_col, "line", "numeric", "fits", start.alias("first")).where(F.col("line") < F.col("first") + 60).groupBy(id_col, "first").agg(F.sum("numeric").alias("numeric"), F.max("fits").alias("fits"))
    sliding = sliding.where((F.col("numeric") >= least) | (F.col("fits") & (F.col("numeric") >= few)))
    counted = around.withColumn("numeric", F.lit(None).cast("bigint"))
    return counted.unionByName(sliding.select(id_col, F.col("first").cast("int").alias("first"), (F.col("first") + 59).cast("int").alias("last"), "numeric"))


def price_rows_from_cells(cells: DataFrame, table: str, row: str, col: str, value: str, roles: dict[str, str]) -> DataFrame:
    """Rows of tables (cells in long form) by role: a column's role is the first regex that its header (row 0)
    fits. Rows without a name or repeating the header are left out; columns without a role are appended to
    note."""
    head = cells.where(F.col(row) == 0)
    role = F.when(F.lit(False), F.lit(""))
    for name, rx in roles.items():
        role = role.when(F.lower(value).rlike(rx), F.lit(name))
    known = head.select(table, col, role.otherwise("note").alias("role"), F.col(value).alias("_head"))
    body = cells.where(F.col(row) > 0).join(known, [table, col]).where(F.col(value) != F.col("_head"))
    texts = body.groupBy(table, row, "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(col, value))), lambda x: x[value]), " ").alias("v"))
    wide = texts.groupBy(table, row).pivot("role", [*roles, "note"]).agg(F.first("v"))
    return wide.where("length(name) > 0").drop(row).distinct()


def infer_headers(cells: DataFrame, table: str, row: str, col: str, value: str) -> DataFrame:
    """Cells in long form (rows and columns from 0) with header, the column's name: adds header, and leaves the
    header row out.

    The first row with any text is the header if it scores no less than the second one and at least half the
    width (2 or more); a cell scores 1 for text and 1 for two or more word characters. Else, and where it is the
    only row, columns are named col_1, col_2 and so on, as are header cells without text; a name that comes
    again gets _2, _3.
    """
    text = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    full = cells.withColumn("_t", text)
    score = F.sum((F.col("_t") != "").cast("int") + (F.length(F.regexp_replace("_t", r"(?U)\W+", "")) >= 2).cast("int"))
    scores = full.groupBy(table, row).agg(score.alias("s"), F.max("_t").alias("any")).where("any <> ''")
    sheet = F.slice(F.array_sort(F.collect_list(F.struct(row, "s"))), 1, 2)
    width = full.where("_t <> ''").groupBy(table).agg((F.max(col) + 1).alias("width"))
    firsts = scores.withColumn("_n", F.row_number().over(Window.partitionBy(table).orderBy(row))).where("_n <= 2")
    firsts = firsts.groupBy(table).agg(sheet.alias("f")).join(width, table)
    one, two = F.col("f")[0], F.get("f", F.lit(1))
    is_head = two.isNotNull() & (one["s"] >= two["s"]) & (one["s"] >= F.greatest(F.lit(2), F.floor(F.col("width") / 2)))
    heads = firsts.select(table, F.when(is_head, one[row]).otherwise(F.lit(-1)).alias("_head"))
    met = full.join(heads, table)
    plain = F.concat(F.lit("col_"), (F.col(col) + 1).cast("string"))
    named = met.where(F.col(row) == F.col("_head")).select(table, col, F.coalesce(F.nullif("_t", F.lit("")), plain).alias("_h"))
    named = named.withColumn("_k", F.row_number().over(Window.partitionBy(table, "_h").orderBy(col)))
    named = named.select(table, col, F.when(F.col("_k") > 1, F.concat("_h", F.lit("_"), F.col("_k").cast("string"))).otherwise(F.col("_h")).alias("_h"))
    out = met.where(F.col(row) != F.col("_head")).join(named, [table, col], "left")
    return out.withColumn("header", F.coalesce("_h", plain)).drop("_t", "_h", "_head")


def qa_category(rows: DataFrame, id_col: str, text_col: str, words: DataFrame, priority: list[str]) -> DataFrame:
    """(id, category, score): the class with most of its words in the text; of equals the first in priority."""
    found = rows.select(id_col, F.explode(F.split(F.lower(text_col), r"\W+")).alias("word")).join(F.broadcast(words), "word")
    scores = found.groupBy(id_col, "category").agg(F.count("*").alias("score"))
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("category"))
    best = scores.groupBy(id_col).agg(F.max(F.struct("score", (-place).alias("p"), "category")).alias("b"))
    return rows.select(id_col).join(best, id_col, "left").select(id_col, F.coalesce("b.category", F.lit("none")).alias("category"), F.coalesce("b.score", F.lit(0)).alias("score"))


def memory_candidates(messages: DataFrame, keyword: str, blocked: str, most: int = 8) -> DataFrame:
    """(conv_id, nth, line): the first distinct lines of 6 to 120 characters with a keyword and no blocked word."""
    lines = messages.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "raw")).withColumn("line", F.trim("raw"))
    fit = lines.where(F.length("line").between(6, 120) & F.col("line").rlike(keyword) & ~F.col("line").rlike(blocked))
    once = fit.groupBy("conv_id", "line").agg(F.min(F.struct("turn", "at")).alias("first"))
    return once.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("first", "line"))).where(F.col("nth") <= most).select("conv_id", "nth", "line")


def novel_candidates(candidates: DataFrame, memory: DataFrame, text: str, newest: str, most: int = 50, limit: float = 0.5) -> DataFrame:
    """Adds overlap: the largest word-set Jaccard with one of the last `most` memory entries, and novel. Null texts count
    as empty."""
    recent = memory.orderBy(F.desc(newest)).limit(most).select(F.col(text).alias("known"))
    sets = [(r.known or "").lower().split() for r in recent.collect()]  # at most `most` rows
    own = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))
    score = lambda s: F.size(F.array_intersect(own, F.array(*map(F.lit, s)))) / F.size(F.array_union(own, F.array(*map(F.lit, s))))
    overlaps = [score(sorted(set(s))) for s in sets if s]
    overlap = F.round(F.array_max(F.array(*overlaps)), 6) if overlaps else F.lit(0.0)
    return candidates.withColumn("overlap", overlap).withColumn("novel", F.col("overlap") < limit)


def procedural_steps(messages: DataFrame, most: int = 8) -> DataFrame:
    """(conv_id, nth, step): the first distinct bullets or sentences with a sequence word, up to 120 characters."""
    pieces = messages.select("conv_id", "turn", F.posexplode(F.split("text", r"\n|(?<=[.!?])\s+")).alias("at", "raw")).withColumn("step", F.trim(F.regexp_replace("raw", r"^\s*(?:[-*]|\d+[.)])\s+", "")))
    fit = pieces.where((F.col("raw").rlike(r"^\s*(?:[-*]|\d+[.)])\s+") | F.lower("raw").rlike(r"\b(?:first|then|next|after|finally)\b")) & F.length("step").between(1, 120))
    once = fit.groupBy("conv_id", "step").agg(F.min(F.struct("turn", "at")).alias("first"))
    return once.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("first", "step"))).where(F.col("nth") <= most).select("conv_id", "nth", "step")


def topic_snippets(docs: DataFrame, id_col: str, text_col: str, topics: dict[str, list[str]], back: int = 100, ahead: int = 1500) -> DataFrame:
    """(id, topic, keyword, snippet): for each topic its first keyword that the text has, and the text around."""
    parts = []
    for topic, words in topics.items():
        word = F.when(F.lit(False), F.lit(""))
        for w in words:
            word = word.when(F.col(text_col).contains(w), F.lit(w))
        parts.append(F.struct(F.lit(topic).alias("topic"), word.alias("keyword")))
    found = docs.select(id_col, text_col, F.explode(F.array(*parts)).alias("p")).where("p.keyword is not null")
    start = F.greatest(F.locate("x", F.lit("")) + F.expr(f"locate(p.keyword, {text_col})") - back, F.lit(1))
    return found.select(id_col, "p.topic", "p.keyword", F.substring(F.col(text_col), start, F.lit(back + ahead)).alias("snippet"))


def spec_tokens(df: DataFrame, text: str) -> DataFrame:
    """Adds grades, sizes and numbers found in the text, joined by commas."""
    all_of = lambda rx: F.array_join(F.regexp_extract_all(text, F.lit(rx), 0), ",")
    return df.withColumns({"grades": all_of(r"\b[A-Z]\d{1,3}\b"), "sizes": all_of(r"\d+(?:x\d+)+|\d+ ?mm"), "numbers": all_of(r"\d+(?:\.\d+)?")})


def bilingual_terms(items: DataFrame, id_col: str, text_col: str, dictionary: DataFrame) -> DataFrame:
    """(id, term): words of three letters or more, and both sides of each dictionary entry one of which occurs."""
    words = items.select(id_col, F.explode(F.split(F.lower(text_col), r"\W+")).alias("term")).where(F.length("term") >= 3).distinct()
    pairs = dictionary.select(F.col("a").alias("term"), F.col("b").alias("other")).unionByName(dictionary.select(F.col("b").alias("term"), F.col("a").alias("other")))
    return words.unionByName(words.join(F.broadcast(pairs), "term").select(id_col, F.col("other").alias("term"))).distinct()


def rank_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_first = 1").drop("_first")
