"""Values held against vocabularies of two levels, prices looked up by name, units repaired, sections packed; against plain loops."""

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quantloom.operators import ordered, pool, rules, standardise

CATEGORIES = ["Concrete", "Concreet", "Masonry", "Steel works", "Finishes"]
SUBS = [("Concrete", "Walls"), ("Concrete", "Slabs"), ("Masonry", "Walls"), ("Masonry", "Blocks"), ("Steel works", "Bolts"), ("Concrete", "Sla")]


def checked(value, known, by_bare):
    if not value:
        return None, "invalid"
    if value in known:
        return value, "exact"
    if value == "Info":
        return value, "universal"
    bare = re.sub(r"^[A-Z]?[\d.]+\s+", "", value).strip()
    if bare in known:
        return bare, "prefix"
    asked = (bare or value) if by_bare else value
    ratio = lambda c: SequenceMatcher(None, asked.lower(), c.lower()).ratio()
    best = max(known, key=lambda c: (ratio(c), -known.index(c)), default=None)
    return (best, "suggested") if best and ratio(best) >= 0.5 else (None, "invalid")


def test_two_levels_are_validated_in_order(spark):
    rng = random.Random(4)
    bend = lambda t: rng.choice([t, t, t.lower(), "A.1 " + t, "02 " + t[:-1], t[::-1], t[1:], t + "x", "Info", "", None, "qq"])
    rows = [(n, bend(rng.choice(CATEGORIES)), bend(rng.choice(SUBS)[1])) for n in range(300)]
    df = spark.createDataFrame(rows, "id int, c string, s string")
    categories = spark.createDataFrame([(v, n) for n, v in enumerate(CATEGORIES)], "value string, place int")
    subs = spark.createDataFrame([(*r, n) for n, r in enumerate(SUBS)], "category string, value string, place int")
    got = rules.validate_levels(df, "c", "s", categories, subs, ["Info"]).orderBy("id").select("id", "category_fixed", "category_how", "sub_fixed", "sub_how").collect()
    want = []
    for n, c, s in rows:
        fixed = checked(c, CATEGORIES, False)
        want.append((n, *fixed, *checked(s, [v for k, v in SUBS if k == fixed[0]], True)))
    assert [tuple(r) for r in got] == want and len({r[4] for r in want}) == 5
    assert rules.validate_vocab(df.where("false"), "c", categories, ["Info"]).count() == 0


def test_prices_by_name(spark):
    rng = random.Random(6)
    words = ["Steel", "steel bar", "red", "-", "bar", "Ste", "el", "b ar", "红 钢"]
    prices = [(f"r{n:03d}", rng.choice([None, " ".join(rng.sample(words, rng.randrange(1, 4)))]) if n % 9 == 0 else " ".join(rng.sample(words, rng.randrange(1, 4))), f"2024-01-{1 + n % 28:02d}") for n in range(200)]
    asked = ["steel", "Steel bar", "el st", "红钢", "--", "bar", "zz", None, "steel", "r-e-d"]
    df = spark.createDataFrame(prices, "rate_id string, name string, date string").withColumn("lookup_key", F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", ""))
    bare = lambda t: re.sub(r"[\W_]+", "", t.lower())
    want = []
    for name in {a for a in asked if a is not None}:
        scored, key = [], bare(name)
        for rate, said, date in prices:
            if said is None:
                continue
            k = bare(said)
            s = 300 if key and k == key else 200 if key and k.startswith(key) else 120 if name.lower() in said.lower() else 80 if key and key in k else None
            if s:
                scored.append((-s, len(said), [-ord(c) for c in date], rate, said))
        want += [(name, n + 1, rate, said, -s) for n, (s, _, _, rate, said) in enumerate(sorted(scored)[:7])]
    got = pool.price_lookup(df, spark.createDataFrame([(a,) for a in asked], "name string"), 7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_units_are_repaired_by_rule_then_head_then_known(spark):
    repairs, known = [(r"^sq\.?\s*m", "m2"), (r"\s*\(.*\)$", "")], ["米", "吨"]
    cases = {"sq. m": "m2", " kg (net)": "kg", "m2/day": "m2", "每吨": "吨", "5 米吨": "米", "??": "??", "": "", None: None, "100 m": "100 m", "m³x": "m³"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.unit_fixed for r in standardise.repair_units(df, "u", repairs, known).collect()} == cases


def test_sections_are_packed_in_order(spark):
    rng = random.Random(8)
    rows = [(k, n, rng.choice([0, 1, 5, 30, 200])) for k in range(6) for n in range(rng.randrange(1, 60))]
    want = []
    for k in range(6):
        chunk = total = 0
        for _, n, size in sorted(r for r in rows if r[0] == k):
            if total and total + size > 100 and total >= 40:
                chunk, total = chunk + 1, 0
            total += size
            want.append((k, n, size, chunk))
    rng.shuffle(rows)
    got = ordered.pack_sections(spark.createDataFrame(rows, "k int, n int, size int"), "k", "n", "size", 40, 100)
    assert sorted(tuple(r) for r in got.collect()) == want
