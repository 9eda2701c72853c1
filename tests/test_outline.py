"""Rules on ordered rows, row by row, with lists cut into many blocks of order numbers."""

import random

import pytest

from quantloom.operators import hierarchy, ordered

ROWS = "list string, row_no bigint, code string, descr string, unit string, qty double"


def settled(levels, texts):
    """Both passes from the top down, as loops."""
    level, n = list(levels), len(levels)
    edges = {i for i in range(n) if level[i] in ("L1", "L2")}
    for i in range(n):
        if level[i] != "L3" or texts[i].startswith("{"):
            continue
        hit = None
        for j in range(i + 1, n):
            if j in edges or texts[j].startswith("《") or "【" in texts[j]:
                break
            if level[j] == "L3" and texts[j].startswith("{") or level[j] == "L4":
                hit = level[j]
                break
        level[i] = {"L3": "L2", "L4": "L3"}.get(hit, "Note")
        edges |= {i} if level[i] == "L2" else set()
    for i in range(n):
        if level[i] != "L3":
            continue
        for j in range(i + 1, n):
            if j in edges or "【" in texts[j] or level[j] == "L4":
                break
            if level[j] == "L3":
                level[i] = "L2"
                edges.add(i)
                break
    return level


@pytest.mark.parametrize("block", [1, 7, 1 << 24])
def test_levels_equal_the_loops(spark, block):
    r = random.Random(8)
    forms = [("Concrete works", "L3", None), ("{Group}", "L3", None), ("1 - Title", "L1", None), ("x", "L2", "3.0"), ("y", "L3", "A.1"), ("rates shall include", "Note", None), ("《old》", "L3", None), ("【part】", "L1", None), ("item", "L4", "unit"), ("", "L4", None), ("说明", "Note", None), ("4.2 clause", "Note", None), ("Carried forward", "Note", None), ("It ends.", "Note", None)]
    rows, want = [], {}
    for name in "abc":
        picked = [r.choice(forms) for _ in range(150)]
        rows += [(name, 3 * i - 100, None if code == "unit" else code, text or None, "m" if code == "unit" else None, 1.0 if code == "unit" else None) for i, (text, _, code) in enumerate(picked)]
        want |= {(name, 3 * i - 100): level for i, level in enumerate(settled([p[1] for p in picked], [p[0] for p in picked]))}
    found = ordered.infer_levels(spark.createDataFrame(rows, ROWS), ["list"], "row_no", block).collect()
    assert {(x.list, x.row_no): x.level for x in found} == want
    assert {x.reason for x in found} == {"form", "promoted", "confirmed", "demoted", "promoted by child"}


@pytest.mark.parametrize("block", [1, 10, 1 << 24])
def test_span_blocks_equal_one_pass(spark, block):
    r = random.Random(6)
    rows = [(name, i, sorted(r.sample(range(8), r.choice([0, 1, 1, 2, 3]))) if r.random() < 0.9 else None) for name in "ab" for i in range(300)]
    want = {}
    for name in "ab":
        start = None
        for _, i, columns in (x for x in rows if x[0] == name):
            if not columns:
                start = None
                want[name, i] = None
                continue
            alone = len(columns) == 1 and start is not None and wide and columns[0] not in wide  # noqa: F821
            if start is None or alone or columns[0] > high or columns[-1] < low:  # noqa: F821
                start, low, high, wide = i, columns[0], columns[-1], set()
            low, high = min(low, columns[0]), max(high, columns[-1])
            wide |= set(columns) if len(columns) > 1 else set()
            want[name, i] = start
    found = ordered.span_blocks(spark.createDataFrame(rows, "list string, row bigint, columns array<int>"), ["list"], "row", "columns", block).collect()
    assert {(x.list, x.row): x.block for x in found} == want


@pytest.mark.parametrize("block", [3, 1 << 24])
def test_subtrees_stop(spark, block):
    text = """0 - 【one】|1 Class_A x|2 A.1 top|3 A.1.1 pump|4 A.1.1.1 child|5 ADD extra|6 A.1.1.2 child|7 A.2.9.9 stranger|8 A.1.2 stop|9 A.1.1.3 late|10 ADD late|11 A.1.3 PUMP two|12 A.1.3.1 child|13 A.1.3.2 pump|14 ADD after
    15 - 【two】|16 Class_B x|17 Class_A x|18 A.5 up|19 A.5.1 pump|20 B.1 stop|21 A.5.1.1 late|22 - pump"""
    rows = [("l", int(n), None if code == "-" else code.replace("_", " "), descr, None, None) for n, code, descr in (x.strip().split(" ", 2) for x in text.replace("\n", "|").split("|"))]
    found = hierarchy.keyword_subtrees(spark.createDataFrame(rows, ROWS), ["list"], "row_no", "code", "descr", "pump", block).collect()
    assert {x.row_no: x.role for x in found} == {
        0: "section", 1: "class", 2: "parent", 3: "marker", 4: "child", 5: "child", 6: "child", 11: "marker", 12: "child", 13: "marker", 14: "child", 15: "section", 17: "class", 18: "parent", 19: "marker",
    }


def test_verdicts_follow_both_marks(spark):
    names = [(i, i == 1, i == 6, i == 7, i in (5, 8), i in (4, 9)) for i in range(12)]
    frame = spark.createDataFrame(names, "id bigint, external boolean, used boolean, junk boolean, builtin boolean, skip boolean")
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (6, 3), (6, 10), (10, 6), (10, 77), (77, 0)], "a bigint, b bigint")
    found = {x.id: (x.external, x.used, x.verdict) for x in hierarchy.name_verdicts(frame, edges).collect()}
    assert {i for i, f in found.items() if f[0]} == {1, 2, 3, 4, 6, 10} and {i for i, f in found.items() if f[1]} == {6, 3, 2, 1, 10}
    assert [found[i][2] for i in (0, 1, 4, 5, 7, 9, 10)] == ["delete: unused", "keep: external in use", "keep: external in use", "keep: builtin", "delete: junk", "keep: skipped", "keep: external in use"]


def test_blocks_and_chunks_run_as_streams_of_batches(spark):
    rows = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [2]), (1, 3, [])], "k int, row bigint, columns array<int>")
    for found in (ordered.span_blocks(rows, ["k"], "row", "columns"), ordered.pack_sections(rows.selectExpr("k", "row", "size(columns) as size"), "k", "row", "size", 1, 2)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan  # a call of Python for each small group costs more than its rows
