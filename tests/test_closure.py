"""Closures of price tables against brute force over all cells."""

import random
from decimal import Decimal as D
from itertools import combinations

from quantloom.operators.closure import cell_grades, closures

SCHEMA = "page bigint, row int, x int, value decimal(16,4), other decimal(16,4)"


def by_force(cells):
    out, pages = set(), {}
    for page, row, x, value, _ in cells:
        if value is not None:
            pages.setdefault(page, {}).setdefault(row, []).append((x, value))
    tol = lambda v: max(D("0.02"), abs(v) * D("1e-9"))
    for page, rows in pages.items():
        amounts = []
        for row, held in sorted(rows.items()):
            v = [value for _, value in sorted(held)]
            products = {((v[i], v[j]), v[k]) for i, j in combinations(range(len(v)), 2) for k in range(len(v)) if k not in (i, j) and min(v[i], v[j], v[k]) > 0 and abs(v[i] * v[j] - v[k]) <= tol(v[k])}
            runs = [(tuple(v[i : j + 1]), v[k]) for i, j in combinations(range(len(v)), 2) for k in range(j + 1, len(v)) if sum(v[i : j + 1]) > 0 and v[k] > 0]
            sums = {(t, c) for t, c in runs if abs(sum(t) - c) <= tol(c)}
            near = set() if sums else {(t, c) for t, c in runs if tol(c) < abs(c - sum(t)) <= c * D("0.005")}
            out |= {(page, row, "product", *f, None) for f in products} | {(page, row, "sum", *f, None) for f in sums} | {(page, row, "near", t, c, c - sum(t)) for t, c in near}
            if products or sums:
                amounts.append(max(c for _, c in products) if products else max(sums, key=lambda f: (len(f[0]), f[1]))[1])
        numbers = {value for held in rows.values() for _, value in held if value > 0}
        for i, j in combinations(range(len(amounts)), 2):
            run = tuple(amounts[i : j + 1])
            out |= {(page, None, "column sum", run, n, None) for n in numbers if sum(run) > 0 and abs(n - sum(run)) <= D("0.02") * len(run)}
        for a in numbers:
            out |= {(page, None, "ratio sum", (a, b), c, None) for b in numbers for c in numbers if a > b and abs(a + b - c) <= D("0.02") and c not in (a, b)}
            out |= {(page, None, "percentage", (a, D(p)), b, None) for b in numbers for p in ("0.05", "0.07", "0.10", "0.12", "0.15", "0.17", "0.18", "0.20") if a != b and abs(b - a * D(p)) <= a * D("0.0002")}
    return out


def test_closures_equal_brute_force(spark):
    r = random.Random(4)
    cells = []
    for page in range(12):
        total = D(0)
        for row in range(r.randint(1, 5)):
            a, b, e = D(r.randint(1, 60)), D(r.randint(100, 9000)) / 100, D(r.randint(-20, 40))
            c = (a * b).quantize(D("0.01"))
            values = [a, b, c, e, c + e + r.choice([0, 0, D("0.08"), D("0.01"), 5]), None, r.choice([None, D(0), c])]
            r.shuffle(values) if page % 4 == 0 else None
            cells += [(page, row, x, v, r.choice([None, v, D(1)])) for x, v in enumerate(values)]
            total += c
        cells += [(page, 90, 0, total, None), (page, 91, 0, (total * D("0.07")).quantize(D("0.0001")), total)]
    cells += [(99, 0, x, D(v), None) for x, v in enumerate(("123456.78", "98765.4321", "12193257897.6386", "12193257909.8"))]  # a billionth of the total counts
    frame = spark.createDataFrame(cells, SCHEMA)
    found = closures(frame).collect()
    got = {(f.page, f.row, f.kind, tuple(f.terms), f.total, f.delta) for f in found}
    assert got == by_force(cells) and len(found) == len(got)
    assert {f.kind for f in found} == {"product", "sum", "near", "column sum", "ratio sum", "percentage"}
    assert all(f.implied == [v + f.delta for v in f.terms] for f in found if f.kind == "near") and all(f.implied is None for f in found if f.kind != "near")
    proven = {}
    for page, _, kind, terms, total, _ in got:
        if kind != "near":
            proven.setdefault(page, {total}).update({total}, terms if kind in ("product", "sum", "ratio sum") else terms[:1] if kind == "percentage" else ())
    want = sorted(((p, w, x, None if v is None else "arith" if v in proven.get(p, ()) else "dual" if o == v else "none") for p, w, x, v, o in cells), key=repr)
    assert sorted(((g.page, g.row, g.x, g.grade) for g in cell_grades(frame, closures(frame)).collect()), key=repr) == want
    assert {g for *_, g in want} == {None, "arith", "dual", "none"}


def test_closures_of_nothing(spark):
    frame = spark.createDataFrame([(1, 1, 1, None, None)], SCHEMA)
    assert closures(frame).collect() == [] == closures(frame.limit(0)).collect()
    assert [g.grade for g in cell_grades(frame, closures(frame)).collect()] == [None]


def test_long_and_short_pages_are_alike(spark):
    r = random.Random(9)
    cells = []
    for page in range(8):
        for row in range(page + 1):
            a, b = D(r.randint(1, 60)), D(r.randint(100, 900000)) / 100
            c = (a * b).quantize(D("0.01"))
            values = [a, b, c, D(r.randint(-3, 9)), c + r.choice([0, D("0.03"), 2])]
            cells += [(page, row, x, v, None) for x, v in enumerate(values)]
    cells += [(8, 0, x, D(v), None) for x, v in enumerate(("0.01", "0.01", "0.03", "0.02", "400000000.5", "100000000.25", "498000000.1"))]
    cells += [(None, 1, x, D(v), None) for x, v in enumerate((1, 2, 3))] + [(8, None, x, D(v), None) for x, v in enumerate((5, 7, 12))]
    frame = spark.createDataFrame(cells, SCHEMA)
    as_set = lambda found: [(f.page, f.row, f.kind, tuple(f.terms), f.total, f.delta) for f in found.collect()]
    got = [as_set(closures(frame, most)) for most in (128, 20, 0)]
    assert len(got[0]) == len(set(got[0])) and set(got[0]) == set(got[1]) == set(got[2]) and len({len(g) for g in got}) == 1
    plain = [c for c in cells if c[0] is not None and c[1] is not None]
    assert set(as_set(closures(spark.createDataFrame(plain, SCHEMA)))) == by_force(plain)


def test_near_sums_of_large_totals_are_met_in_few_steps(spark):
    from pyspark.sql import functions as F

    from quantloom.operators.closure import _met

    runs = spark.createDataFrame([(1, 1, 5e8)], "page int, row int, sum double")
    numbers = spark.range(1000).selectExpr("1 as page", "1 as row", "4.9e8 + id * 2e4 as found")
    met = _met(runs, F.col("sum"), F.col("sum") * 0.0051, numbers, ["page", "row"], relative=True)
    assert met.where("abs(found - sum) <= sum * 0.005").count() == numbers.where("abs(found - 5e8) <= 2.5e6").count()
    assert met.count() < 1001


def test_cells_of_any_pages_are_graded_in_one_pass(spark):
    """As cell_grades over closures: repeated values and runs, negative numbers, null pages, rows and numbers, long pages."""
    from quantloom.operators.closure import graded_cells

    r = random.Random(11)
    cells = [(page, row, x, v, r.choice([None, v, D(3)])) for page in range(40) for row in range(page % 7) for x in range(page % 9 + 1) for v in [r.choice([None, D(r.randint(-2, 4)), D(r.randint(1, 9)) / 2, D(r.randint(1, 4000)) / 100])]]
    cells += [(None, 1, 1, D(2), D(2)), (None, 1, 2, D(3), None), (None, 1, 3, None, D(1)), (5, None, 1, D(4), D(4)), (5, None, 2, D(77), D(77)), (5, 1, 20, D("9999999999.9999"), None)]
    cells += [(60, row, x, D(1), None) for row in range(5) for x in range(6)]
    frame = spark.createDataFrame(cells, SCHEMA).repartition(4)
    plain = [c for c in cells if c[0] is not None and c[1] is not None]
    got = [(f.page, f.row, f.kind, tuple(f.terms), f.total, f.delta) for f in closures(spark.createDataFrame(plain, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == by_force(plain)
    want = sorted(map(tuple, cell_grades(frame, closures(frame, 0)).collect()), key=repr)
    for most in (128, 12, 0):
        found = graded_cells(frame, most)
        assert found.columns == [*frame.columns, "grade"] and sorted(map(tuple, found.collect()), key=repr) == want


def test_price_tables_are_shuffled_once(spark):
    """Cells come from one pass over the lines, dealt by page; neither cells nor findings are moved or stored again."""
    from quantloom.plans.closure import price_cells
    from quantloom.plans.registry import QUERIES
    from quantloom.sources.fixtures import table

    folder = "/root/testdata/sf0.001"
    cells, want = price_cells(spark, folder), table(spark, folder, "price_cells")
    assert cells.dtypes == want.dtypes and cells.exceptAll(want).isEmpty() and want.exceptAll(cells).isEmpty()
    for name, shuffles in (("m4_closures", 1), ("m4_cell_grades", 2)):  # grades: one for pages without a number, of which there are none
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == shuffles and plan.count("FileScan") == shuffles and "Join" not in plan
