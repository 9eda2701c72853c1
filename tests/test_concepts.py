"""Matching by concepts in two languages against plain loops."""

import random
import re

from quantloom.operators.concepts import concept_match

GROUPS = [["钢筋", "rebar", "steel bar"], ["混凝土", "concrete"], ["墙", "wall panel"], ["crane rail", "轨道"], ["painting", "涂料"], ["gate", "大门", "main gate"]]
TERMS = [(t, f"c{n}") for n, group in enumerate(GROUPS) for t in group]
BRIDGE = {"kg": ["t", "kg"], "no": ["set"]}
ENGLISH = ["rebar", "Steel-bar", "concrete", "panel", "wall", "crane rails", "rail of crane", "Repaintings", "gate", "A.1.2", "gates", "B.3", "x", ""]
LOCAL = ["钢筋", "混 凝土", "墙", "轨道(新)", "涂料", "大门", "gate", "concrete", "无"]


def of_item(text):
    words = {w for w in re.sub(r"[^\w\s/]", " ", re.sub(r"\b[A-I]\.\d+(?:\.\d+)*\b", "", text).lower()).split() if len(w) > 1}
    bare = re.sub(r"[^\w\s/]", " ", text.lower())
    out = set()
    for term, concept in TERMS:
        if term in words:
            out.add(concept)
        if len(term) > 5 and " " in term and (term in bare or set(term.split()) <= set(bare.split())):
            out.add(concept)
        if len(term) > 5 and " " not in term and any(len(w) > 4 and term in w for w in words):
            out.add(concept)
    return out


def of_norm(text):
    spaced = re.sub(r"[（）()\s,，.。、/·:：;；\-+]+", " ", text.lower())
    solid = spaced.replace(" ", "")
    words = set(spaced.split()) | {solid[i : i + n] for n in (2, 3) for i in range(len(solid) - n + 1)}
    return {c for t, c in TERMS if t in words}


def depth(a, b):
    if not a or not b or a[0].upper() != b[0].upper():
        return 0
    x, y = ([int(n) for n in re.findall(r"\d+", c)][:2] for c in (a, b))
    n = 1
    for p, q in zip(x, y):
        if p != q:
            break
        n += 1
    return n


def test_the_best_norm_by_concepts(spark):
    rng = random.Random(11)
    code = lambda: rng.choice([None, "", "A.1", "a.01.2", "A", "B.1.2.3", "b-1-2"])
    text = lambda words: rng.choice([None, *(" ".join(rng.choice(words) for _ in range(rng.randrange(4))) for _ in range(9))])
    items = [(i, code(), text(ENGLISH), rng.choice(["kg", "t", "no", "m2", "", None]), rng.choice([None, "", "Concrete works", "gate", "zz"])) for i in range(220)]
    norms = [(i, code(), text(LOCAL), rng.choice(["kg", "t", "set", "m2", "no", None])) for i in range(160)]
    norms += norms[:3]
    want = []
    for item, a, said, unit, section in items:
        if not said or not unit:
            continue
        sc = of_item(section or "")
        ic, scored = of_item(said) | sc, []
        for norm, b, name, nu in norms:
            nc = of_norm(name or "")
            if nu is None or nu not in {unit, *BRIDGE.get(unit, [])} or not ic & nc:
                continue
            s = len(ic & nc) / len(ic | nc) * (0.5 if ic & nc <= {"c1"} else 1) - 0.12 * len(ic ^ nc) - (0.15 if sc and not sc & nc else 0)
            s = round(s + 0.03 * depth(a, b) + (0.05 if nu == unit else 0), 6)
            if s >= 0.3:
                scored.append((-s, norm))
        if scored:
            s, norm = min(scored)
            want.append((item, norm, -s))
    a = spark.createDataFrame(items, "item int, code string, text string, unit string, section string")
    b = spark.createDataFrame(norms, "norm int, code string, text string, unit string")
    terms = spark.createDataFrame(TERMS, "term string, concept string")
    got = lambda *sides: sorted(map(tuple, concept_match(*sides, terms, ["c1"], BRIDGE).collect()))
    assert got(a, b) == want and len(want) > 40
    assert got(a.where("false"), b) == got(a, b.where("false")) == []
