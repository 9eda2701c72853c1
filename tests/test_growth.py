"""Streams with state, restarted in the middle, against their batch forms; tables that grow; roles found on pages."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import norms, ordered, reshape, retrieval, rules, text_jobs
from quantloom.streaming import jobs


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def feed(spark, df, folder, part):
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{part}")


def watch(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_stuck_tasks_fail_on_the_stream_as_in_the_batch(spark, tmp_path):
    rng = random.Random(3)
    log = [(i, i // 4 * 20 + rng.randrange(20), rng.randrange(40), rng.choice(["pending", "processing", "done"])) for i in range(160)]
    df = spark.createDataFrame(log, "event_id bigint, m int, task_id bigint, status string").select("event_id", "task_id", "status", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m, 0)").alias("ts"))
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for half in (0, 1):  # the second run goes on from the first one's checkpoint
        for part in (0, 1):
            n = half * 2 + part
            feed(spark, df.where(f"event_id >= {n * 40} and event_id < {n * 40 + 40}"), source, n)
        jobs.upserted(jobs.watched_state_stream(watch(spark, df.schema, source), "2 hours", late="1 hour"), out, ["task_id"], "rev", "update")
    last = max(int(p.name[1:]) for p in (tmp_path / "out").glob("v*"))
    want = jobs.watched_states(df, "2 hours")
    assert want.where("status = 'failed'").count() > 3
    assert rows(spark.read.parquet(f"{out}/v{last}"), "task_id", "status", "changes") == rows(want, "task_id", "status", "changes")


def test_an_index_follows_its_listings_over_a_restart(spark, tmp_path):
    schema = "scan bigint, path string, mtime bigint, text string"
    scans = [[("a", 1, "one"), ("b", 1, "two")], [("a", 1, "never read"), ("b", 2, "new two"), ("c", 1, "three")], [("c", 1, "three"), ("d", 4, None)]]
    work = lambda df: df.select("path", "mtime", F.upper("text").alias("text"))
    for n, scan in enumerate(scans):
        feed(spark, spark.createDataFrame([(n, *r) for r in scan], schema), f"{tmp_path}/in", n)
        if n != 1:  # two scans are waiting at the second start
            jobs.incremental_index(watch(spark, spark.createDataFrame([], schema).schema, f"{tmp_path}/in"), f"{tmp_path}/out", work)
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    assert rows(read("v1"), "path", "mtime", "text") == [("a", 1, "ONE"), ("b", 2, "NEW TWO"), ("c", 1, "THREE")]
    assert rows(read("v2"), "path", "mtime", "text") == [("c", 1, "THREE"), ("d", 4, None)]
    assert rows(read("counts/n1"), "action", "n") == [("index changed", 1), ("index new", 1), ("skip", 1)]
    assert rows(read("counts/n2"), "action", "n") == [("delete", 2), ("index new", 1), ("skip", 1)]


@pytest.mark.parametrize("apply", [True, False])
def test_closed_sessions_are_mined_once(spark, tmp_path, apply):
    talk = [(c, t, f"2024-01-{1 + d:02d} 0{c}:{t:02d}:00", f"rule {c % 2} of day {d % 2}: keep it") for d in range(4) for c in range(3) for t in range(3)]
    df = spark.createDataFrame(talk, "conv_id bigint, turn int, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    mine = lambda m: text_jobs.memory_candidates(m, "rule", "never")
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for day in range(4):
        feed(spark, df.where(f"day(ts) = {day + 1}"), source, day)
        if day % 2:
            jobs.grow_from_sessions(watch(spark, df.schema, source), lambda: spark.read.option("recursiveFileLookup", True).parquet(source), out, "30 minutes", "1 hour", mine, apply)
    newest = F.expr("timestamp'2024-01-04 01:02:00'")  # less the hour that late messages have
    want = jobs.mined_sessions(jobs.sessions(df, "30 minutes").where(F.col("last") <= newest), df, mine)
    mined = spark.read.parquet(*map(str, (tmp_path / "out" / "mined").glob("n*")))
    assert rows(mined, "conv_id", "first", "line") == rows(want, "conv_id", "first", "line")
    assert mined.count() >= 9
    memory = sorted((tmp_path / "out" / "memory").glob("v*"), key=lambda p: int(p.name[1:]))
    assert bool(memory) == apply
    if apply:
        assert rows(spark.read.parquet(str(memory[-1])), "line") == rows(want.select("line").distinct(), "line")


def test_names_are_known_in_the_next_version(spark, tmp_path):
    df = spark.createDataFrame([("Gear box",), ("red ring",), ("odd",), (None,), ("gear BOX",)], "name string")
    args = [("gear", "drive")], {"look": ["red"]}, "general"
    first = rules.classify_and_remember(df, "name", str(tmp_path), 0, *args)
    assert rows(first, "name", "class", "how") == sorted([("Gear box", "drive", "rule"), ("gear BOX", "drive", "rule"), ("red ring", "look", "tree"), ("odd", "general", "default"), (None, "general", "default")], key=repr)
    second = rules.classify_and_remember(df.union(spark.createDataFrame([("gear wheel",)], "name string")), "name", str(tmp_path), 1, [("gear", "other")], {"look": ["x"]}, "rest")
    assert dict(rows(second.where("name is not null"), "name", "how")) == {"Gear box": "known", "gear BOX": "known", "red ring": "known", "odd": "known", "gear wheel": "rule"}
    assert rows(second.where("name = 'odd'"), "class") == [("general",)]
    assert rows(rules.known_names(spark, str(tmp_path), 2), "name", "class") == [("gear box", "drive"), ("gear wheel", "other"), ("odd", "general"), ("red ring", "look")]


def read_page(cells, first):
    """One page by loops: roles of columns, attributes of value columns, then a record for each row and value."""
    import re

    width = max(map(len, cells))
    at = lambda r, c: (cells[r][c] or "").strip() if c < len(cells[r]) else ""
    value = [c for c in range(width) if any(re.fullmatch(r"\d{5}", at(r, c)) for r in range(first))]
    fixed, body = range(min(value)), range(first, len(cells))

    def role(rx, barred):
        best = None
        for c in fixed:
            texts = [at(r, c) for r in body if at(r, c)]
            hits = sum(bool(re.search(rx, t)) for t in texts)
            if c not in barred and hits * 2 > len(texts) and hits > (best[0] if best else 0):
                best = (hits, c)
        return best[1] if best else None

    code = role(r"^\d{11,12}$", {0})
    unit = role(reshape._UNIT_CELL, {0, code})
    name = next((c for c in fixed if c not in {0, code, unit}), 0)
    head = lambda word, barred: next((c for c in fixed if c not in barred and any(at(r, c).lower() == word for r in range(first))), None)
    code = head("code", set()) if code is None else code
    unit = head("unit", {0, code, name}) if unit is None else unit
    attributes = {c: [] for c in value}
    for r in range(first):
        said = {c: at(r, c) for c in value if at(r, c) and not re.fullmatch(r"\d{5}", at(r, c))}
        for c in value:
            if len(set(said.values())) == 1:
                attributes[c].append(next(iter(said.values())))
            elif c in said:
                attributes[c].append(said[c])
    out = []
    for r in body:
        title = at(r, name) if name else re.sub(r"^\d{1,2}\s+", "", at(r, 0))
        own = at(r, code) if code is not None else ""
        if title or own:
            out += [(r, next(at(h, c) for h in range(first) if re.fullmatch(r"\d{5}", at(h, c))), tuple(attributes[c]), title, at(r, unit) if unit is not None else "", own, at(r, c)) for c in value]
    return out


def test_roles_of_columns_are_found_wherever_they_are(spark):
    rng, pages = random.Random(5), {}
    for page in range(30):
        fixed = ["name", "unit", "code"][: rng.randint(0, 3)]
        rng.shuffle(fixed)
        wide = rng.randint(1, 4)
        head = [["", *fixed, *(str(10000 + page * 10 + i) for i in range(wide))], ["", *[""] * len(fixed), *["all alike"] * wide], ["", *[None] * len(fixed), *(rng.choice(["thin", "thick", ""]) for _ in range(wide))]]
        body = []
        for n in range(rng.randint(2, 6)):
            cell = {"name": rng.choice(["pipe", "beam", ""]), "unit": rng.choice(["m2", "kg", "odd"]), "code": rng.choice(["12345678901", "", "x1"])}
            body.append([f"{n + 1} row", *(cell[f] for f in fixed), *([str(rng.randrange(99)) for _ in range(wide - 1)] + ["7.5"])])
        pages[page] = (head + body, len(head))
    df = spark.createDataFrame([(p, r, c) for p, (cells, _) in pages.items() for r, c in enumerate(cells)], "page int, row int, cells array<string>")
    want = sorted((p, *rec) for p, (cells, first) in pages.items() for rec in read_page(cells, first))
    given = spark.createDataFrame([(p, first) for p, (_, first) in pages.items()], "page int, first_data int")
    for found in (reshape.read_grid(df, "page"), reshape.read_grid(df, "page", given)):
        got = found.select("page", "row", "norm_code", "attributes", "name", "unit", "code", "value").collect()
        assert sorted((r[0], r[1], r[2], tuple(r[3]), *r[4:]) for r in got) == want
    assert reshape.read_grid(df.limit(0), "page").count() == 0


def test_headers_are_inferred(spark):
    sheets = {"head": [["Name", "Price", "Price"], ["a", "1", "2"], ["b", "3", ""]], "none": [["1", "2"], ["name", "price"]], "one": [["Name", "Price"]], "blank": [["", ""], ["Name", ""], ["x", "1"]]}
    df = spark.createDataFrame([(s, r, c, v) for s, m in sheets.items() for r, line in enumerate(m) for c, v in enumerate(line)], "sheet string, row int, col int, value string")
    out = text_jobs.infer_headers(df, "sheet", "row", "col", "value")
    names = {s: [tuple(r)[1] for r in rows(out.where(F.col("sheet") == s).select("col", "header").distinct(), "col", "header")] for s in sheets}
    assert names == {"head": ["Name", "Price", "Price_2"], "none": ["col_1", "col_2"], "one": ["col_1", "col_2"], "blank": ["Name", "col_2"]}
    assert rows(out.where("sheet = 'head'").select("row").distinct(), "row") == [(1,), (2,)]


def test_lines_read_alike_at_any_size(spark):
    small = [(1, i, line * 10 + i % 2, 8.0, float(50 - i)) for line in range(3) for i in range(line * 4, line * 4 + 4)]
    large = [(2, i, y * 7, h * 7, x * 7) for _, i, y, h, x in small]
    df = spark.createDataFrame([(p, i, float(y), h, x) for p, i, y, h, x in small + large], "page int, id int, y double, height double, x double")
    out = ordered.text_lines(df, ["page"], "y", "height", "x", "id")
    one, two = (rows(out.where(f"page = {p}"), "id", "line", "nth") for p in (1, 2))
    assert one == two and {line for _, line, _ in one} == {0, 1, 2}
    assert [n for i, line, n in one if line == 0] == [4, 3, 2, 1]


def test_cells_go_to_the_nearest_code_column(spark):
    cells = spark.createDataFrame([(1, 0.0, "5"), (1, 149.0, " 7.5 "), (1, 150.0, "8"), (1, 301.0, "9"), (1, 199.0, "—"), (1, 100.0, "text"), (1, 250.0, "-3"), (2, 1.0, "1")], "page int, x double, text string")
    heads = spark.createDataFrame([(1, "A", 100.0), (1, "B", 200.0)], "page int, code string, cx double")
    assert rows(ordered.nearest_code_columns(cells, heads, ["page"]), "x", "code", "value") == sorted([(149.0, "A", 7.5), (150.0, "A", 8.0), (199.0, "B", None), (250.0, "B", -3.0)], key=repr)


def test_search_with_many_trigrams_and_long_conversations(spark):
    talk = spark.createDataFrame([(1, 1500, "the pump has failed again"), (2, 0, "nothing of it"), (2, 500, "a pump"), (3, 1, None)], "conv_id bigint, turn bigint, text string")
    asked = spark.createDataFrame([(1, "pump failed"), (2, "nothing")], "query bigint, terms string")
    hits = retrieval.session_search(talk, asked, 3)
    assert rows(hits, "query", "n", "conv_id", "turn") == [(1, 1, 1, 1500), (1, 2, 2, 500), (2, 1, 2, 0)]
    columns = ["query", "nth", "conv_id", "score"]
    few, many = (retrieval.bm25_search(talk.where("turn <> 500"), asked, "conv_id", "text", 5, most_grams=m) for m in (10_000, 2))
    assert rows(few, *columns) == rows(many, *columns)


def test_norms_outside_the_named_chapters_serve_where_those_are_empty(spark):
    fields = "norm bigint, code string, search string, chapter string, unit string, resources string, work string, attributes string, manual boolean"
    pool = spark.createDataFrame([(1, "A", "dig trench", "earth", "m3", None, None, None, True), (2, "B", "dig by machine", "earth", "m3", None, None, None, None), (3, "C", "lay pipe", "pipes", None, "pipe", "lay", "DN200", False), (4, "A", "dig pit", "earth", "m2", None, None, None, False)], fields)
    asked = spark.createDataFrame([(1, "Dig the trench", None, "m3"), (2, "trench", None, "m3"), (3, "Pipe", "lay DN200", "m"), (4, None, None, None), (5, "dig", None, "LS"), (6, "vain words", None, "m3"), (7, "quiet", "", "m3")], "item bigint, name string, descr string, unit string")
    kinds = [norms.Category(["dig"], ["dig"], ["pit"], ["earth"]), norms.Category(["trench"], ["dig"], [], ["gone"]), norms.Category(["pipe"], ["pipe", "lay"]), norms.Category(["vain"], ["nowhere"], [], ["earth"]), norms.Category(["quiet"], [], [], ["earth"])]
    scores = norms.Scores(machine_work=["dig"], process=["lay"], specs=r"DN\d+")
    got = rows(norms.scoped_match(asked, pool, kinds, scores), "item", "verdict", "nth", "norm", "score")
    assert got == sorted([
        (1, "matched", 1, 2, 60), (1, "matched", 2, 1, 30),  # "trench" is longer than "dig"; all norms serve, as its chapter is gone
        (2, "matched", 1, 2, 60), (2, "matched", 2, 1, 30),
        (3, "no unit", 1, 3, 55), (4, "no norm", None, None, None), (5, "no norm", None, None, None),
        (6, "matched", 1, 1, 30), (6, "matched", 2, 2, 30), (7, "matched", 1, 1, 45), (7, "matched", 2, 2, 45),
    ], key=repr)


def test_numeric_blocks_are_those_of_a_loop(spark):
    import re

    rng = random.Random(11)
    pick = lambda: rng.choices(["12 m2 of it", "plain words", "Price list", "Section", "", "7"], [3, 8, 0.4, 0.3, 1, 2])[0]
    docs = {d: "\n".join(pick() for _ in range(rng.choice([1, 20, 70, 200]))) for d in range(40)} | {40: "", 41: "\n".join(["Price list"] * 14 + ["word " * 9] * 30)}
    want = []
    for d, text in docs.items():
        lines = text.split("\n")
        blocks = [(max(i - 5, 0), i + 80) for i, t in enumerate(lines) if "Price" in t][:10]
        blocks = [b for b in blocks if len("\n".join(lines[b[0] : b[1] + 1])) > 150]
        want += [(d, *b, None) for b in blocks]
        if len(blocks) < 2:
            for first in range(0, len(lines), 30):
                window = lines[first : first + 60]
                n = sum(bool(re.search(r"\d", t)) for t in window)
                if n >= 8 or (n >= 4 and "Section" in window):
                    want.append((d, first, first + 59, n))
    df = spark.createDataFrame([*docs.items(), (99, None)], "id bigint, text string")
    assert rows(text_jobs.numeric_blocks(df, "id", "text", "Price", marked="^Section$"), "id", "first", "last", "numeric") == sorted(want, key=repr)


def test_steps_are_those_of_a_loop(spark):
    import re

    talk = [(c, t, text) for c in range(6) for t, text in enumerate(random.Random(c).choices(["- mix it\n- pour it\n2) wait", "First mix. Then pour! Nothing else.", "no steps here", "Finally, " + "x" * 130 + ". Then stop.", "* mix it", "1. one\n2. two\n3. three\n4. four\n5. five\n6. six"], k=4))]
    want = []
    for c in range(6):
        seen = []
        for text in (x for cc, _, x in talk if cc == c):
            for piece in re.split(r"\n|(?<=[.!?])\s+", text):
                step = re.sub(r"^\s*(?:[-*]|\d+[.)])\s+", "", piece).strip()
                told = re.match(r"\s*(?:[-*]|\d+[.)])\s+", piece) or re.search(r"\b(?:first|then|next|after|finally)\b", piece.lower())
                if told and 1 <= len(step) <= 120 and step not in seen:
                    seen.append(step)
        want += [(c, n + 1, s) for n, s in enumerate(seen[:8])]
    df = spark.createDataFrame(talk, "conv_id bigint, turn int, text string")
    assert rows(text_jobs.procedural_steps(df), "conv_id", "nth", "step") == sorted(want, key=repr)


def test_passages_are_embedded_and_searched_in_one_step(spark):
    rng = random.Random(8)
    texts = [None, "", "ab"] + ["".join(rng.choice("abc é") for _ in range(rng.randrange(3, 60))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    asked = retrieval.embed_passages(docs.where("id % 20 = 3"), "id", "text").select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    got = retrieval.passage_topk(docs, asked, "id", "text", 4)
    vectors = retrieval.embed_passages(docs, "id", "text").withColumnRenamed("id", "vec_id")
    names = ("query", "nth", "vec_id", "distance")
    assert rows(got, *names) == rows(retrieval.vector_topk(vectors, asked, 4), *names)
    assert rows(got, *names) == rows(retrieval.passage_topk(docs, asked, "id", "text", 4, most_queries=2), *names)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert retrieval.passage_topk(docs.where("id < 3"), asked, "id", "text", 4).count() == 0
