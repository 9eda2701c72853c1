"""Order-preserving alignment of two versions of a list, blocks of any length."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.text import description_key
from quantloom.operators.similar import similar_pairs, text_ratios
from quantloom.sources.scratch import stored


def longest_rise(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that ascend on both sides; each value occurs once on its side."""
    tails, ends, before = [], [], {}
    for a, b in sorted(pairs):
        at = bisect_left(tails, b)
        before[a, b] = ends[at - 1] if at else None
        tails[at : at + 1], ends[at : at + 1] = [b], [(a, b)]
    out, now = [], ends[-1] if ends else None
    while now:
        out.append(now)
        now = before[now]
    return out[::-1]


def best_chain(rows: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Of scored pairs (new, old), those that ascend on both sides and have the largest sum of scores; of equal sums,
    the one that begins with the smallest new row, then the smallest old row.

    From the last new row backwards; a tree of running maxima over old rows gives the best that can follow.
    """
    place = {old: i for i, old in enumerate(sorted({old for _, old, _ in rows}, reverse=True), 1)}
    tree: list = [None] * (len(place) + 1)  # at i: the best of the pairs in its reach of old rows, from the last on
    after: dict[tuple[int, int], tuple[int, int] | None] = {}
    waiting, last, best = [], None, None
    for new, old, score in sorted(rows, key=lambda r: (-r[0], r[1])):
        if new != last:  # pairs of one new row do not follow each other
            for at, found in waiting:
                while at < len(tree):
                    if tree[at] is None or found > tree[at]:
                        tree[at] = found
                    at += at & -at
            waiting, last = [], new
        follow, at = None, place[old] - 1
        while at:
            if tree[at] is not None and (follow is None or tree[at] > follow):
                follow = tree[at]
            at -= at & -at
        found = (score + (follow[0] if follow else 0.0), -new, -old)
        after[new, old] = (-follow[1], -follow[2]) if follow else None
        waiting.append((place[old], found))
        best = found if best is None or found > best else best
    out, now = [], (-best[1], -best[2]) if best else None
    while now:
        out.append(now)
        now = after[now]
    return out


def _picked(pairs: DataFrame, keys: list[str], schema: str, anchors: bool) -> DataFrame:
    def pick(group: pd.DataFrame) -> pd.DataFrame:
        new, old = group["new"].tolist(), group["old"].tolist()
        found = longest_rise(list(zip(new, old, strict=True))) if anchors else best_chain(list(zip(new, old, group["score"].tolist(), strict=True)))
        return pd.DataFrame({**{k: [group[k].iloc[0]] * len(found) for k in keys}, "new": [n for n, _ in found], "old": [o for _, o in found]})

    return pairs.groupBy(*keys).applyInPandas(pick, schema)


def sequence_align(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Alignment of two versions of a list within each block `key`: (key, kind, old_row, new_row, anchor, score,
    change_qty, change_unit), a row for each row of either list. Lists have row_no, code, descr, unit, qty.

    kind is same, modified (paired; quantity or unit differ), inserted (new only, with the old row of the last pair
    before it as anchor, else of the first one after it) or deleted (old only). Pairs ascend on both sides. A pair
    scores 3 + r if quantities agree to six decimals, else 2 + r if codes are equal, else r if it is over 0.7, r being
    difflib's ratio(new, old) of the cleaned descriptions.

    1. Anchors: pairs of rows whose (code, quantity) occurs once in the block on either side; of these, the longest run
       that ascends on both sides, from the row numbers alone.
    2. Between neighbouring anchors, pairs with a score are found in joins: equal quantities, equal codes, and texts
       that are similar enough (similar_pairs).
    3. From these scored pairs, each stretch takes the ascending ones with the largest sum (best_chain). So a stretch
       costs its scored pairs, and not its rows times its rows; a row that moved over an anchor counts as deleted and
       inserted.

    Blocks may be of any length; no task holds the rows of a block, but row numbers of its anchors and the scored
    pairs of a stretch. Null texts count as empty; null codes and quantities equal nothing; rows with a null key are
    left out; row numbers are unique within a list.
    """
    kind = old.schema[key].dataType.simpleString()
    text = F.coalesce(description_key(F.col("descr")), F.lit(""))
    sides = {side: df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("row_no").alias(side), "code", text.alias("text"), "unit", F.round("qty", 6).alias("qty")) for side, df in (("old", old), ("new", new))}
    sides = {side: stored(df) for side, df in sides.items()}
    unique = {side: df.where("code is not null and qty is not null").groupBy("key", "code", "qty").agg(F.count("*").alias("n"), F.min(side).alias(side)).where("n = 1").drop("n") for side, df in sides.items()}
    anchors = unique["old"].join(unique["new"], ["key", "code", "qty"]).select("key", "new", "old")
    anchors = stored(_picked(anchors, ["key"], f"key {kind}, new bigint, old bigint", True))

    gaps = {}
    for side, df in sides.items():
        marked = df.join(anchors.select("key", side, F.lit(1).alias("anchor")), ["key", side], "left")
        upto = F.count("anchor").over(Window.partitionBy("key").orderBy(side).rowsBetween(Window.unboundedPreceding, 0))
        gaps[side] = stored(marked.withColumn("gap", upto).where("anchor is null").select("key", "gap", side, "code", "text", "qty"))
    x = gaps["new"].select("key", "gap", "new", F.col("code").alias("new_code"), F.col("text").alias("a"), F.col("qty").alias("new_qty"))
    y = gaps["old"].select("key", "gap", "old", F.col("code").alias("old_code"), F.col("text").alias("b"), F.col("qty").alias("old_qty"))
    shape = ["key", "gap", "new", "old", "a", "b"]
    on = (x["key"] == y["key"]) & (x["gap"] == y["gap"])
    merged = [x["key"], x["gap"], "new", "old", "a", "b", "new_code", "old_code", "new_qty", "old_qty"]
    by_qty = x.join(y, on & (F.col("new_qty") == F.col("old_qty"))).select(*merged).select(*shape, F.lit(3.0).alias("plus"))
    apart = ~F.coalesce(F.col("new_qty") == F.col("old_qty"), F.lit(False))
    by_code = x.join(y, on & (F.col("new_code") == F.col("old_code"))).select(*merged).where(apart).select(*shape, F.lit(2.0).alias("plus"))
    coded = stored(by_qty.unionByName(by_code))
    coded = coded.join(stored(text_ratios(coded, "a", "b")), ["a", "b"]).select("key", "gap", "new", "old", (F.col("plus") + F.col("r")).alias("score"))
    similar = similar_pairs(x.select("key", "gap", "a"), y.select("key", "gap", "b"), 0.7, ["key", "gap"]).where("score > 0.7")
    other = ~F.coalesce(F.col("new_code") == F.col("old_code"), F.lit(False))
    by_text = x.join(similar, "a").join(y, ["key", "gap", "b"]).where(apart & other).select("key", "gap", "new", "old", "score")
    scored = stored(coded.unionByName(by_text))
    chains = _picked(scored, ["key", "gap"], f"key {kind}, gap bigint, new bigint, old bigint", False)
    pairs = stored(chains.select("key", "new", "old").unionByName(anchors.select("key", "new", "old")))

    o, n = sides["old"].select("key", "old", F.col("text").alias("b"), F.col("unit").alias("old_unit"), F.col("qty").alias("old_qty"), F.col("code").alias("old_code")), sides["new"].select("key", "new", F.col("text").alias("a"), F.col("unit").alias("new_unit"), F.col("qty").alias("new_qty"), F.col("code").alias("new_code"))
    met = stored(n.join(pairs, ["key", "new"], "left").join(o, ["key", "old"], "left"))
    met = met.join(stored(text_ratios(met, "a", "b")), ["a", "b"], "left")
    order = Window.partitionBy("key").orderBy("new")
    before = F.last("old", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.last("old", ignorenulls=True).over(Window.partitionBy("key").orderBy(F.desc("new")).rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumns({"before": before, "later": later})
    paired = F.col("old").isNotNull()
    change_qty = F.coalesce(F.col("new_qty") != F.col("old_qty"), F.lit(False))
    change_unit = ~F.lower(F.trim("new_unit")).eqNullSafe(F.lower(F.trim("old_unit")))
    score = F.when(F.col("new_qty") == F.col("old_qty"), 3.0).when(F.col("new_code") == F.col("old_code"), 2.0).otherwise(0.0) + F.col("r")
    out = met.select(
        "key", F.when(~paired, "inserted").when(change_qty | change_unit, "modified").otherwise("same").alias("kind"), F.col("old").alias("old_row"), F.col("new").alias("new_row"),
        F.when(~paired, F.coalesce("before", "later")).alias("anchor"), F.when(paired, F.round(score, 6)).alias("score"), F.when(paired, change_qty).alias("change_qty"), F.when(paired, change_unit).alias("change_unit"),
    )
    gone = o.join(pairs, ["key", "old"], "left_anti").select("key", F.lit("deleted").alias("kind"), F.col("old").alias("old_row"))
    return out.unionByName(gone, allowMissingColumns=True).withColumnRenamed("key", key)
