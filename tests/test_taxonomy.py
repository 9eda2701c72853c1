"""Divisions by rules, candidate divisions and routes against plain loops."""

import random
import re

from pyspark.sql import functions as F

from quantloom.operators.taxonomy import Routing, Target, Taxonomy, candidates, classify, route

RULES = Taxonomy(
    sections={"civil": "A", "mep": "B", "sea": "D", "roads": "C", "general": "PRELIM"},
    information="please share",
    sums=r"allow for the \"(.+)\"",
    sum_targets={"PAINT": Target("A.25", discipline="A")},
    patterns=[(r"fire\s*stop", Target("B.09", "fire", discipline="B"))],
    subsections={"Piles": Target("A.03"), "Doors\nall kinds": Target("A.21"), "": Target("A.99")},
    keywords={"A": [("concrete", Target("A.04")), ("paint", Target("A.25")), ("support", Target("A.32"))], "B": [("cable", Target("B.03"))], "D": [("fender", Target("D.02"))]},
    other_keywords="A",
    lent={"D": ("A", ["A.25"], False), "B": ("A", ["A.32"], True)},
    split={"A": (20, 29, "Decoration", "Civil")},
)


def test_rows_land_where_the_first_rule_puts_them(spark):
    cases = [
        (("general", None, "paint"), ("PRELIM", "PRELIM", "rule", "PRELIM")),
        (("nowhere", "Piles", "paint"), (None, "", "unresolved", None)),
        ((None, None, None), (None, "", "unresolved", None)),
        (("civil", "x", "Please share: paint"), ("A", "INFO", "rule", "A")),
        (("mep", "x", 'Allow for the " paint"'), ("A", "A.25", "provisional_sum", "Decoration")),
        (("civil", "x", 'allow for the "rest" paint'), ("A", "A.25", "keyword", "Decoration")),
        (("civil", "Piles", "FireStop paint"), ("B", "B.09", "pattern", "B")),
        (("mep", "Piles", "cable"), ("B", "A.03", "subsection", "B")),
        (("civil", "Doors \nother", "concrete"), ("A", "A.21", "subsection", "Decoration")),
        (("sea", None, "concrete"), ("D", "A.99", "subsection", "D")),
        (("civil", "x", "Concrete paint"), ("A", "A.04", "keyword", "Civil")),
        (("roads", "x", "paint"), ("C", "A.25", "keyword", "C")),
        (("sea", "x", "fender concrete"), ("D", "D.02", "keyword", "D")),
        (("sea", "x", "concrete"), ("D", "A.04", "keyword of A", "D")),
        (("sea", "x", "paint"), ("D", "", "unresolved", "D")),
        (("mep", "x", "support concrete"), ("B", "A.32", "keyword of A", "B")),
        (("mep", "x", "concrete"), ("B", "", "unresolved", "B")),
    ]
    df = spark.createDataFrame([(n, *row) for n, (row, _) in enumerate(cases * 2)], "id int, section string, subsection string, descr string")
    got = classify(df.withColumn("name", F.lit("clash")), RULES).orderBy("id").select("discipline", "division", "source", "group", "sort_key", "name").collect()
    assert [tuple(r[:4]) for r in got] == [want for _, want in cases * 2]
    assert all(r.sort_key == r.division and r.name != "clash" for r in got)
    assert classify(df.where("false"), RULES).count() == 0


DIVISIONS = [("A", "A.01", "桩基 Piling"), ("A", "A.02", "混凝土"), ("B", "B.01", "电气"), ("B", "B.02", "给排水"), ("C", "C.01", "道路"), ("E", "E.01", "修缮"), ("C", "C.02", None)]
SUBS = [("A", "A.02", "1", "模板"), ("A", "A.02", "2", "钢筋混凝土"), ("B", "B.02", "1", "电气管"), ("C", "C.01", "1", "人行道"), ("C", "C.02", "1", "道路标线")]
GLOSSARY = {"A": [("pile/piling works", ["PILING", "桩"]), ("concrete", ["混凝土"]), ("c+f form", ["模板"])], "B": [("power cable", ["电气"]), ("sanitary", ["排水"])], "C": [("road", ["道路"]), ("of all", ["道"])], "E": [("repair", ["修缮"])]}
ROUTER = [("electric", [("B", None)]), ("sub", [("A", "A.01"), ("Z", "Z.1")]), ("road$", [("C", "C.01")])]
WORDS = ["pile", "piles", "works", "Concrete", "cable", "c+f", "formwork", "桩", "道路", "road", "broad", "of", "repair", "混凝土墙", ""]


def plain_candidates(path, texts):
    out = set()
    for rx, to in ROUTER:
        if re.search(rx, (path or "").lower()):
            out |= {(b, c) for b, c, _ in DIVISIONS for book, only in to if b == book and only in (None, c)}
    for text in texts:
        for book, listed in GLOSSARY.items():
            for phrase, local in listed:
                whole = any(len(p) > 3 and re.search(rf"\b{re.escape(p)}\b", text.lower()) for p in re.split(r"[/\s]+", phrase))
                if whole or any(w in text for w in local):
                    low = [w.lower() for w in local]
                    out |= {(b, c) for b, c, *_, name in DIVISIONS + SUBS if b == book and name and any(w in name.lower() for w in low)}
    return out


def vocabulary(spark):
    return spark.createDataFrame(DIVISIONS, "book string, code string, name string"), spark.createDataFrame(SUBS, "book string, code string, sub string, name string")


def test_candidate_divisions_with_their_subs(spark):
    rng = random.Random(5)
    groups = [(n % 40, rng.choice([None, "Electrical", "Substructure", "Ring road", "x"]), rng.choice([None, *(" ".join(rng.sample(WORDS, 3)) for _ in range(4))])) for n in range(70)]
    df = spark.createDataFrame(groups, "grp int, path string, text string")
    got = {(r.grp, r.book, r.code): [tuple(s) for s in r.subs] for r in candidates(df, *vocabulary(spark), GLOSSARY, ROUTER).collect()}
    want = {(g, *d) for g, path, text in groups for d in plain_candidates(path, [text or ""])}
    assert set(got) == want and len(want) > 60
    assert all(subs == sorted((s, name) for b, c, s, name in SUBS if (b, c) == key[1:]) for key, subs in got.items())
    assert candidates(df.where("false"), *vocabulary(spark), GLOSSARY, ROUTER).count() == 0
    assert candidates(df, *vocabulary(spark), {}, []).count() == 0


def test_routes_share_the_candidates_of_their_titles(spark):
    rng = random.Random(9)
    rules = Routing(["^page"], [r"^total\b"], ["general"], sums=r"allow for (\w+)", sum_targets=["paint"], patterns=["firestop"], sample=2)
    special = [None, "", "Page 1", "TOTAL of it", "Allow for paint", "allow for rest", "fire firestop"]
    rows = [(n, rng.choice([None, "", "Electric", "Sub"]), rng.choice(["general", "road", "p", "q", None]), rng.choice([None, None, None, "Firestop"]), rng.choice(special) if n % 3 == 0 else " ".join(rng.sample(WORDS, 2))) for n in range(150)]
    df = spark.createDataFrame(rows, "row_no int, dept1 string, dept2 string, dept3 string, descr string")
    path = lambda r: " ".join(filter(None, r[1:3])).lower()
    title = lambda r: not r[4] or bool(re.match("page", r[4].strip(), re.I))
    want = {}
    for r in rows:
        asked = [o for o in rows if ((o[1] or ""), (o[2] or "")) == ((r[1] or ""), (r[2] or "")) and not title(o) and "general" not in path(o)][:2]
        n = len([d for d in plain_candidates(path(r), [" ".join(o[4] for o in asked)]) if d[0] in "ABC"]) if asked else 0
        if title(r) or re.match(r"total\b", r[4], re.I):
            want[r[0]] = "SKIP"
        elif "general" in path(r):
            want[r[0]] = "PRELIM"
        elif m := re.match(r"allow for (\w+)", r[4], re.I):
            want[r[0]] = "SUM" if m.group(1) == "paint" else "PRELIM"
        elif re.search("firestop", " ".join(filter(None, [r[4], *r[1:4]])), re.I):
            want[r[0]] = "PATTERN"
        else:
            want[r[0]] = "ZERO" if n == 0 else "UNIQUE" if n == 1 else "LOW" if n <= 3 else "HIGH"
    got = {r.row_no: r.route for r in route(df, rules, *vocabulary(spark), GLOSSARY, ROUTER).collect()}
    assert got == want and len(set(want.values())) >= 7
