"""Terms in two languages, family pools and re-ranked candidates against plain loops."""

import random
import re

from pyspark.sql import functions as F

from quantloom.functions.similarity import token_set
from quantloom.operators.families import AFFINITY, MATERIALS, UNIT_ALIASES, UNIT_KINDS, Factors, Lexicon, family_pool, holders, query_terms, rerank_candidates

LEXICON = Lexicon({"steel bar": "钢筋", "wall": "墙", "glaz": "玻璃"}, {"钢筋": ["Rebar", "steel bar"], "墙体": ["block wall"], "玻璃幕墙": ["glass", "curtain wall"], "混凝土": ["concrete"]})
PARTS = ["steel bar", "wall", "Glazing", "C30 concrete", "f'c(MPa)28", "20 mm", "block", "rebar", "crushed rock", "formwork", "lean concrete", "300 ksc", "12345", "of", "x-y", "glass"]
NAMES = ["钢筋 C30", "墙体 block", "玻璃幕墙 20mm", "Rebars 12mm", "concrete C28", "gravel 280 ksc", "Formwork", "lean  concrete 32 MPa", "混凝土 C30", "curtain wall", "asphalt", "no such"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_terms(text):
    low = text.lower()
    en = {w for w in re.findall(r"\w+", low) if len(w) >= 3 and not w.isdigit()}
    cn = {v for k, v in LEXICON.glossary.items() if k in low}
    cn |= {"C" + g for g in re.findall(r"f'c\(mpa\)(\d+)", low) + re.findall(r"c(\d+)\s*concrete", low)} | {f"{m}mm" for m in re.findall(r"(\d+)\s*mm", low)}
    cn |= {key for w in en for key, said in LEXICON.synonyms.items() for s in said if w == s.lower() or w in s.lower().split()}
    back = {s.lower() for w in cn for key, said in LEXICON.synonyms.items() if w == key or (len(w) >= 2 and (w in key or key in w)) for s in said}
    return en | back, cn


def made(seed, n_items=60, n_rates=150):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(PARTS) for _ in range(rng.randrange(5)))
    units, disciplines = [None, "", "sqm", "M 2", "m²", "t", "kg", "nos", "块", "bag"], [None, "土建工程", "安装工程", "x"]
    items = [(i, rng.choice(["f", "g", "h", None]), rng.choice([None, text(), text(), text()]), rng.choice(units), rng.choice(disciplines)) for i in range(n_items)]
    rates = [(f"r{i:03d}", rng.choice([None, *(" ".join(rng.sample(NAMES, 2)) for _ in range(6)), *NAMES]), rng.choice(units), rng.choice([None, "土建", "机电"]), rng.choice([True, False, None])) for i in range(n_rates)]
    return items, rates


def frames(spark, items, rates):
    return spark.createDataFrame(items, "item int, family string, text string, unit string, discipline string"), spark.createDataFrame(rates, "rate_id string, name string, unit string, specialty string, preferred boolean")


def test_terms_and_what_holds_them(spark):
    items, _ = made(1)
    got = rows(query_terms(frames(spark, items, [])[0], LEXICON))
    want = {(t, w, local) for _, _, t, *_ in items if t is not None for local, words in zip((False, True), plain_terms(t), strict=True) for w in words}
    assert got == sorted(want, key=repr) and any(local for *_, local in got)
    words = ["a", "wall", "curtain wall", "墙", "幕墙 20mm", "ksc", "lean  con", "30 ", " ", "", "zz", "墙"]
    texts = [*NAMES, *NAMES, "", "a b  lean  con", "curtain-wall"]
    found = holders(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in texts], "text string"), F.col("text"))
    assert rows(found) == sorted({(w, t) for w in words if w.strip() for t in texts if w in t}, key=repr)


def plain_pool(items, rates, k):
    out = []
    for family in {f for _, f, *_ in items if f is not None}:
        both = [plain_terms(t) for _, f, t, *_ in items if f == family and t is not None]
        en, cn = (set().union(*(b[n] for b in both)) for n in (0, 1))
        scored = []
        for rate, name, _, _, liked in rates:
            if name is not None and (h := 4.0 * sum(w in name.lower() for w in en) + 6 * sum(w in name for w in cn)):
                scored.append((-(h + 8 * bool(liked)), rate))
        out += [(family, n + 1, rate, -s) for n, (s, rate) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_pools_keep_the_best_rates_of_each_family(spark):
    for seed, k in ((2, 7), (3, 1000)):
        items, rates = made(seed)
        a, b = frames(spark, items, rates)
        assert rows(family_pool(a, b, LEXICON, k)) == plain_pool(items, rates, k)
    assert rows(family_pool(a.where("false"), b, LEXICON)) == rows(family_pool(a, b.where("false"), LEXICON)) == []
    bare = Lexicon()
    assert {r[0] for r in rows(family_pool(a, b, bare))} == {"f", "g", "h"}


def plain_unit(u):
    u = (u or "").strip().lower().replace(" ", "").replace(".", "").replace("²", "2").replace("³", "3")
    return UNIT_ALIASES.get(u, u)


def strength(text, asked):
    for rx, d in ([(r"f'?c\s*\(\s*mpa\s*\)\s*(\d+)", 1)] if asked else []) + [(r"(\d+)\s*mpa", 1), (r"(\d+)\s*ksc", 10), (r"\bc(\d{2})\b", 1)]:
        if m := re.search(rx, text.lower()):
            return int(m.group(1)) / d


def plain_score(item, rate, fuzzy):
    (_, _, text, unit, discipline), (_, name, rate_unit, specialty, liked) = item, rate
    text, name = text or "", name or ""
    en, cn = plain_terms(text)
    s = 5 * sum(w in name.lower() for w in en) + 7 * sum(w in name for w in cn) + fuzzy * token_set(text, name) + 4 * bool(liked)
    s += sum(p for a, b, p in MATERIALS if re.search(a, text.lower()) and re.search(b, name.lower()))
    a, b = plain_unit(unit), plain_unit(rate_unit)
    s += 20 * (0.3 if not a or not b else 1 if a == b else 0.9 if any(a in kind and b in kind for kind in UNIT_KINDS) else 0.4)
    s += 10 * AFFINITY.get(discipline, {}).get(specialty, 0.2)
    asked, has = strength(text, True), strength(name, False)
    if asked is not None:
        off = None if has is None else abs(asked - has)
        s += -3 if off is None else 15 if off == 0 else 10 if off <= 4 else 3 if off <= 8 else -5 if off <= 15 else -15
    return round(s, 6)


def test_candidates_are_ranked_by_all_factors(spark):
    items, rates = made(5)
    a, b = frames(spark, items, rates)
    pool = [(f, r[0]) for n, f in enumerate(["f", "g", "x"]) for i, r in enumerate(rates) if (i + n) % 3]
    by_id = {r[0]: r for r in rates}
    for fuzzy, k, least in ((0.4, 8, 12), (0.0, 3, 30)):
        got = rerank_candidates(a, spark.createDataFrame(pool, "family string, rate_id string"), b, LEXICON, Factors(fuzzy=fuzzy), k, least)
        want = []
        for item in items:
            scored = sorted((-s, r) for f, r in pool if f == item[1] and (s := plain_score(item, by_id[r], fuzzy)) >= least)
            want += [(item[0], n + 1, r, -s) for n, (s, r) in enumerate(scored[:k])]
        assert rows(got) == sorted(want, key=repr) and want


def test_items_that_read_alike_are_ranked_once(spark):
    items = spark.createDataFrame([(i, "f", "gear bolt", "kg", None if i % 2 else "other") for i in range(40)], "item bigint, family string, text string, unit string, discipline string")
    rates = spark.createDataFrame([(f"r{i}", f"gear {i}", "kg", "x", False) for i in range(10)], "rate_id string, name string, unit string, specialty string, preferred boolean")
    pool = rates.selectExpr("'f' AS family", "rate_id")
    got = rerank_candidates(items, pool, rates, LEXICON, Factors(), 3, 12)
    found = {}
    for item, *rest in rows(got):
        found.setdefault(item, []).append(tuple(rest))
    assert len(found) == 40 and len({tuple(r) for r in found.values()}) == 1 and len(found[0]) == 3
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(family" in plan and "windowspecdefinition(item" not in plan


def longest_common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], max(best[j], best[j - 1], last + (x == y))
    return best[-1]


def test_the_ratio_of_word_sets():
    rng = random.Random(7)
    for _ in range(400):
        a, b = (" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5))) for _ in range(2))
        x, y = set(a.split()), set(b.split())
        both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
        one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
        ratio = lambda p, q: 100 * 2 * longest_common(p, q) / (len(p) + len(q))
        if not x or not y:
            want = 0
        elif both and (not left or not right):
            want = 100
        else:
            apart = len(left) + len(right) - 2 * longest_common(left, right)
            want = max([100 * (1 - apart / (len(one) + len(two)))] + ([ratio(both, one), ratio(both, two)] if both else []))
        assert abs(token_set(a, b) - want) < 1e-9, (a, b)
