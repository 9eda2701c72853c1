"""Alignment of two versions of a list against brute force over all pairs of rows."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest

from quantloom.operators.align import best_chain, longest_rise, sequence_align

SCHEMA = "row_no bigint, code string, descr string, unit string, qty double, block string"


def score(new, old):
    r = SequenceMatcher(None, (new[2] or "").lower(), (old[2] or "").lower()).ratio()
    if new[4] is not None and new[4] == old[4]:
        return 3 + r
    if new[1] is not None and new[1] == old[1]:
        return 2 + r
    return r if r > 0.7 else 0.0


def aligned(old, new):
    """The largest sum of scores of pairs that ascend on both sides, by the full table; the pairs by row numbers."""
    table = [[(0.0, ())] * (len(old) + 1) for _ in range(len(new) + 1)]
    for i in range(len(new) - 1, -1, -1):
        for j in range(len(old) - 1, -1, -1):
            options = [table[i + 1][j], table[i][j + 1]]
            if (s := score(new[i], old[j])) > 0:
                options.append((table[i + 1][j + 1][0] + s, ((new[i][0], old[j][0]), *table[i + 1][j + 1][1])))
            table[i][j] = max(options, key=lambda t: (round(t[0], 9), *((-n, -o) for n, o in t[1])))
    return table[0][0]


def versions(seed, size):
    """An old list, and a new one with rows cut, added and changed."""
    r = random.Random(seed)
    words = "pipe valve pump copper steel cable tray duct fan wall door lamp".split()
    old = [(10 * i, f"A.{i}", " ".join(r.sample(words, 4)), "m", float(r.randint(1, 400)), "A") for i in range(size)]
    new = []
    for row in old:
        what = r.random()
        if what < 0.1:
            continue
        if what < 0.2:
            new.append((f"N.{r.random()}", " ".join(r.sample(words, 4)), "m", float(r.randint(1000, 2000))))
        descr, code, qty, unit = row[2], row[1], row[4], row[3]
        if 0.2 < what < 0.4:
            qty += 0.5
        if 0.3 < what < 0.45:
            code = f"{code}.x"
        if 0.4 < what < 0.5:
            descr, unit = f"{descr} new", "kg"
        new.append((code, descr, unit, qty))
    return old, [(7 * i + 3, code, descr, unit, qty, "A") for i, (code, descr, unit, qty) in enumerate(new)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_alignment_equals_the_full_table(spark, seed):
    old, new = versions(seed, 60)
    rows = sequence_align(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA), "block").collect()
    total, pairs = aligned(old, new)
    found = sorted((r.new_row, r.old_row) for r in rows if r.kind in ("same", "modified"))
    assert found == list(pairs) and abs(sum(r.score or 0 for r in rows) - total) < 1e-4
    by_old, by_new = {r[0]: r for r in old}, {r[0]: r for r in new}
    for r in rows:
        if r.kind in ("same", "modified"):
            x, y = by_new[r.new_row], by_old[r.old_row]
            assert (r.change_qty, r.change_unit) == (x[4] != y[4], x[3] != y[3]) and (r.kind == "modified") == (r.change_qty or r.change_unit)
        elif r.kind == "inserted":
            earlier, later = [o for n, o in pairs if n < r.new_row], [o for n, o in pairs if n > r.new_row]
            assert r.anchor == (earlier[-1] if earlier else later[0] if later else None)
    assert sorted(r.old_row for r in rows if r.kind == "deleted") == sorted(set(by_old) - {o for _, o in pairs})
    assert {r.kind for r in rows} == {"same", "modified", "inserted", "deleted"}


def test_helpers_equal_enumeration():
    r = random.Random(5)
    for _ in range(60):
        order = r.sample(range(9), 7)
        pairs = list(zip(range(7), order, strict=True))
        rises = [c for k in range(8) for c in combinations(pairs, k) if all(x[1] < y[1] for x, y in zip(c, c[1:], strict=False))]
        assert len(longest_rise(pairs)) == max(map(len, rises)) and tuple(longest_rise(pairs)) in rises
        scored = [(*p, r.choice([1.0, 2.0, 2.5])) for p in {(r.randrange(5), r.randrange(5)) for _ in range(8)}]
        chains = [c for k in range(6) for c in combinations(sorted(scored), k) if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(c, c[1:], strict=False))]
        best = max(chains, key=lambda c: sum(x[2] for x in c))
        found = best_chain(scored)
        assert sum(s for n, o, s in scored if (n, o) in found) == sum(x[2] for x in best)
    assert best_chain([]) == [] == longest_rise([])


def test_alignment_of_a_long_block_and_of_odd_rows(spark):
    old, new = versions(9, 20_000)
    one, two = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    counts = {r.kind: r["count"] for r in sequence_align(one, two, "block").groupBy("kind").count().collect()}
    assert counts["same"] + counts["modified"] + counts["deleted"] == 20_000
    assert counts["same"] + counts["modified"] + counts.get("inserted", 0) == len(new)
    assert counts["same"] > 10_000 and counts["deleted"] < 4_000
    odd = spark.createDataFrame([(1, None, None, None, None, "A"), (2, "x", "pump", "m", 1.0, None), (3, None, "pump", None, None, "B")], SCHEMA)
    rows = sequence_align(odd, odd.where("row_no < 3"), "block").collect()
    # Two empty texts are alike, so the rows without anything else are a pair.
    assert sorted((r.block, r.kind, r.old_row, r.new_row) for r in rows) == [("A", "same", 1, 1), ("B", "deleted", 3, None)]
    assert sequence_align(odd.limit(0), odd.limit(0), "block").count() == 0
