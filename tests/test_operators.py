"""Ties, nulls and order on literal rows, and streams against their batch forms."""

import pytest
from pyspark.sql import functions as F

from quantloom.functions.text import code_prefixes, natural_key, number, scaled_number
from quantloom.operators import align, checks, hierarchy, ordered, pool, reconcile, standardise, text_jobs
from quantloom.streaming import jobs


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_numbers(spark):
    df = spark.createDataFrame([("1,234.5",), ("12 USD",), ("3万",), ("50%",), ("-",), ("nan of",), ("",), (None,)], "t string")
    assert values(df, number(F.col("t"))) == [(1234.5,), (12.0,), (None,), (None,), (None,), (None,), (None,), (None,)]
    assert values(df, scaled_number(F.col("t")))[2:4] == [(30000.0,), (0.5,)]


def test_codes_sort_naturally(spark):
    df = spark.createDataFrame([("A.01.10",), ("A.01.2",), ("A.1.1",)], "c string")
    assert [r.c for r in df.orderBy(natural_key(F.col("c"))).collect()] == ["A.1.1", "A.01.2", "A.01.10"]
    assert values(df, code_prefixes(F.col("c")))[0] == (["A", "A.01"],)


def test_purchase_quantities_round_half_even(spark):
    df = spark.createDataFrame([(10050.0,), (10150.0,), (1025.0,), (25.5,), (2.25,)], "q double")
    assert [r.buy_qty for r in standardise.rounded_purchase_qty(df, "q", 1.0).collect()] == [10000.0, 10200.0, 1000.0, 26.0, 2.2]


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_headings_carry_over_blocks(spark, block):
    rows = [(1, "【A】"), (2, "《a》"), (3, "x"), (4, None), (5, "【B】"), (6, "y"), (7, "《b》"), (8, "{c}"), (9, "z")]
    df = spark.createDataFrame(rows, "row_no bigint, descr string")
    out = ordered.forward_fill_context(df, [], "row_no", *ordered.heading_columns("descr"), block=block)
    got = {r.row_no: (r.l1, r.l2, r.l3) for r in out.collect()}
    assert got[3] == ("A", "a", None) and got[4] == ("A", "a", None) and got[6] == ("B", None, None) and got[9] == ("B", "b", "c")
    kept = ordered.forward_fill_context(df, [], "row_no", *ordered.heading_columns("descr"), reset=False, block=block)
    assert {r.row_no: r.l2 for r in kept.collect()}[6] == "a"
    counted = ordered.running_count(df, [], "row_no", F.col("descr").startswith("【"), "k", block)
    assert {r.row_no: r.k for r in counted.collect()} == {i: 1 if i < 5 else 2 for i in range(1, 10)}


def test_occurrences_pair_in_order(spark):
    t = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 3, 9.0), ("b", 4, 1.0)], "code string, row_no bigint, qty double")
    s = spark.createDataFrame([("a", 1, 5.5), ("a", 2, 2.0), ("c", 3, 1.0)], "code string, row_no bigint, qty double")
    got = sorted(values(reconcile.occurrence_join(t, s), "code", "nth", "issue"))
    assert got == [("a", 2, "QUANTITY_MISMATCH"), ("b", 1, "MISSING_IN_SOURCE"), ("c", 1, "MISSING_IN_TARGET")]


def test_one_base_row_goes_to_one_row(spark):
    schema = "row_no bigint, code string, descr string, unit string, qty double"
    base = spark.createDataFrame([(1, "A.1.1", "steel pipe 100", "m", 1.0), (2, "A.1.2", "copper wire", "m", 1.0)], schema)
    other = spark.createDataFrame([(1, "A.1.1", "steel pipe", "m", 1.0), (2, "A.1.1", "steel pipe", "m", 2.0), (3, "A.1.9", "copper wires", "m", 1.0)], schema)
    got = {r.other_row: (r.base_row, r.stage) for r in reconcile.cascade_match_one_to_one(base, other).collect()}
    assert got == {1: (1, 1), 2: (None, None), 3: (2, 3)}


def test_pool_keeps_the_latest_with_the_smallest_id(spark):
    df = spark.createDataFrame([("2", "steel bar", "m", 5.0, "s", "2024-01-02"), ("1", "Steel Bar", "m", 6.0, "s", "2024-01-02"), ("3", "steel bar", "m", 1.0, "s", "2024-01-01"), ("4", "123", "m", 1.0, "s", "2024-01-01")], "rate_id string, name string, unit string, price double, supplier string, date string").withColumn("date", F.to_date("date"))
    got = pool.dedup_rate_pool(df, F.lower("name"), F.col("unit")).collect()
    assert [(r.rate_id, r.price, r.min_price, r.max_price, r.avg_price, r.n) for r in got] == [("1", 6.0, 1.0, 6.0, 4.0, 3)]


def test_chunks():
    text = "ahead\n# A\n\n" + "x" * 500 + "\n \n" + "y" * 200 + "\n\n***\n" + "z" * 1700 + "\n\ntail\n## B c \nmore\n___\nlines"
    chunks = text_jobs.chunk_text(text, 800)
    assert [(h, len(c)) for h, c in chunks] == [(None, 5), ("A", 702), ("A", 800), ("A", 800), ("A", 100), ("A", 4), ("B c", 10)]
    assert text_jobs.chunk_text(" \n", 800) == []


def test_alignment_keeps_order(spark):
    schema = "block string, row_no bigint, descr string, qty double, code string, unit string"
    old = spark.createDataFrame([("k", 1, "one", 1.0, "c", "m"), ("k", 2, "two", 2.0, None, "m"), ("k", 3, "three", 3.0, None, "m")], schema)
    new = spark.createDataFrame([("k", 1, "one", 1.0, "c", "m"), ("k", 2, "new", 9.0, None, "m"), ("k", 3, "three!", 3.0, None, "kg")], schema)
    got = sorted(values(align.sequence_align(old, new, "block"), "kind", "old_row", "new_row", "anchor"), key=repr)
    assert got == [("deleted", 2, None, None), ("inserted", None, 2, 1), ("modified", 3, 3, None), ("same", 1, 1, None)]


def test_reachability_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a bigint, b bigint")
    assert sorted(values(hierarchy.reachable(edges, spark.createDataFrame([(1,)], "node bigint")), "node")) == [(1,), (2,), (3,)]


def test_checks_pass_on_an_empty_table(spark):
    df = spark.createDataFrame([], "a int")
    assert values(checks.quality_checks(df, [("null", F.col("a").isNull(), 0.1)]), "metric", "passed") == [(0.0, True)]


@pytest.fixture
def event_folder(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 7, ("pending", "done")[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, task_id bigint, status string").withColumn("ts", F.to_timestamp("ts"))
    for part in range(4):  # four micro-batches
        df.where(f"event_id % 4 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), tmp_path


def test_streams_equal_batches(spark, event_folder):
    df, stream, folder = event_folder
    assert sorted(values(jobs.drained(jobs.deduplicated_stream(stream, ["task_id", "status"], "ts", "2 hours").select("task_id", "status")), "task_id", "status")) == sorted(values(df.select("task_id", "status").distinct(), "task_id", "status"))
    jobs.upserted(stream.select("task_id", "event_id", "status"), f"{folder}/table", ["task_id"], "event_id")
    last = max(int(p.name[1:]) for p in (folder / "table").glob("v*"))
    want = jobs.latest(df.select("task_id", "event_id", "status"), ["task_id"], "event_id")
    assert sorted(values(spark.read.parquet(f"{folder}/table/v{last}"), "task_id", "event_id", "status")) == sorted(values(want, "task_id", "event_id", "status"))


def test_task_state_stream_equals_batch(spark, event_folder):
    df, stream, folder = event_folder
    query = jobs.task_state_stream(stream).writeStream.outputMode("update").format("memory").queryName("task_states").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.task_id: r for r in sorted(spark.table("task_states").collect(), key=lambda r: r.changes)}
    want = jobs.task_states(df).collect()
    assert {(r.task_id, r.status, r.changes) for r in want} == {(t, r.status, r.changes) for t, r in got.items()}


def test_novelty_of_null_texts(spark):
    schema = "at bigint, text string"
    memory = spark.createDataFrame([(1, "red pipe"), (2, None), (3, "")], schema)
    found = text_jobs.novel_candidates(spark.createDataFrame([(1, "Red pipe valve"), (2, None)], schema), memory, "text", "at")
    assert sorted(values(found, "at", "overlap", "novel")) == [(1, 0.666667, False), (2, 0.0, True)]


def test_columns_do_not_depend_on_the_order_of_tokens(spark, tmp_path):
    from quantloom.plans.registry import QUERIES

    rows = [(1, "a", 0.1), (2, "a", 0.2), (3, "a", 0.3), (4, "b", 0.4)]
    found = []
    for name, part in (("up", rows), ("down", rows[::-1])):
        df = spark.createDataFrame(part, "event_id bigint, event_type string, value double").coalesce(1)
        df.selectExpr("event_id", "timestamp'2024-01-01 00:00:00' ts", "7L user_id", "event_type", "value", "'' props").write.parquet(f"{tmp_path}/{name}/events.parquet")
        found.append(values(QUERIES["e11_assign_to_columns"](spark, f"{tmp_path}/{name}").orderBy("column"), "column", "n"))
    assert found[0] == found[1]
    odd = spark.createDataFrame([(1, float("nan")), (1, 2.0), (2, 1e30), (3, None), (3, 4.0), (4, None)], "k int, x double")
    assert str([r["m"] for r in odd.groupBy("k").agg(ordered.exact_mean("x").alias("m")).orderBy("k").collect()]) == "[nan, 1e+30, 4.0, None]"


def test_tied_intervals_stay_in_one_block(spark):
    spans = spark.createDataFrame([(1, 6, 7)] + [(1, 16, 18)] * 3 + [(1, 22, 24)] * 2, "k int, a bigint, b bigint")
    found = ordered.merged_intervals(spans, ["k"], "a", "b").orderBy("block")
    assert values(found, "block", "a", "b", "rows") == [(0, 6, 7, 1), (1, 16, 18, 3), (2, 22, 24, 2)]


def test_same_content_pairs_equal_all_pairs_and_repeat_with_their_ids(spark):
    a = [(2, "tion.example.com/en"), (4, "example.com"), (4, "example.com"), (6, "short"), (8, None), (10, "example.org/de")]
    b = [(1, "example.com"), (3, "n.example.com/e"), (5, "tion.example.com/en/tion.example.com/en"), (7, "example.org/de"), (9, "short")]
    found = checks.same_content_pairs(*(spark.createDataFrame(rows, "id bigint, stem string") for rows in (a, b)))
    want = [(i, j) for i, s in a for j, t in b if s and len(s) >= 8 and len(t) >= 8 and (s in t or t in s)]
    assert sorted(values(found, "id_a", "id_b")) == sorted(want)


def test_multi_factor_match_equals_all_pairs_without_meeting_them(spark):
    texts, units, chapters = ["cold bolt", "hot bolt nut", "hot nut", "rod", None], ["a", "b", None], ["x", "y", None]
    items = [(n, texts[n % 5], units[n % 3], chapters[n // 2 % 3]) for n in range(30)]
    norms = [(n, f"N{n % 4}", texts[n % 5], units[n // 3 % 3], chapters[n % 3]) for n in range(100, 160)]
    weights = {"keyword": 30.0, "chapter": 15.0, "unit": 30.0, "other_unit": -30.0}
    want = []
    for item, text, unit, chapter in items:
        best = {}
        for norm, code, other, u, c in norms:
            words = len(set((text or "").split()) & set((other or "").split()))
            if words:
                score = words * 30.0 + (15 if chapter and c == chapter else 0) + (30 if unit and u == unit else -30)
                best[code] = max(best.get(code, (-1e9, 0)), (score, -norm))
        want += [(item, code, s, -m, k + 1) for k, (code, (s, m)) in enumerate(sorted(best.items(), key=lambda b: (-b[1][0], -b[1][1]))[:3])]
    found = reconcile.multi_factor_match(spark.createDataFrame(items, "item int, text string, unit string, chapter string"), spark.createDataFrame(norms, "norm int, code string, text string, unit string, chapter string"), weights)
    assert sorted(values(found, "item", "code", "score", "norm", "nth")) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [item#" not in plan  # no table of items by norms
