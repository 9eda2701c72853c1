"""Secret scans by a trigram inverted index (operator 4), with DataFrame operations only."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import documents, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` count if group `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The kinds that a result must have, in the order that ties of start follow.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Published formats of keys.
FORMAT_RULES = (
    Rule("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + FORMAT_RULES

Clauses = frozenset[frozenset[str]]


def _all(a: Clauses, b: Clauses) -> Clauses:
    return _short(frozenset(x | y for x in a for y in b))


def _short(clauses: Clauses) -> Clauses:
    """Without the clauses that ask for more than another one does."""
    return frozenset(x for x in clauses if not any(y < x for y in clauses))


_ANY: Clauses = frozenset([frozenset()])


def trigram_query(pattern: str, most: int = 64) -> Clauses:
    """The trigrams, in lower case, that any text with a match must have: one of these sets as a whole.

    The pattern is read part by part. Runs of parts with few possible strings are multiplied out, and each
    of the strings asks for its trigrams; where a part can be too many things, a new run begins. An empty set
    among the clauses means that nothing is mandatory.
    """

    def of_strings(strings: set[str]) -> Clauses:
        return _short(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))

    def walk(parts) -> tuple[set[str] | None, Clauses]:
        """The strings that the parts can be, None if too many, and the clauses then."""
        done, run = _ANY, {""}
        whole = True
        for op, arg in parts:
            op, strings, clauses = str(op), None, _ANY
            if op == "LITERAL":
                strings = {chr(arg).lower()}
            elif op == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
                found = {chr(c).lower() for o, a in arg for c in (range(a[0], a[1] + 1) if str(o) == "RANGE" else [a])}
                strings = found if len(found) <= 8 else None
            elif op == "SUBPATTERN":
                strings, clauses = walk(arg[-1])
            elif op == "BRANCH":
                each = [walk(x) for x in arg[1]]
                strings = set().union(*(s for s, _ in each)) if all(s is not None for s, _ in each) else None
                clauses = _short(frozenset().union(*((of_strings(s) if s is not None else c) for s, c in each)))
            elif op == "MAX_REPEAT":
                low, high, inner = arg
                s, c = walk(inner)
                if s is not None and high in (0, 1):
                    strings = s | {""} if low == 0 else s
                elif low:
                    clauses = of_strings(s) if s is not None else c
            if strings is not None and len(run) * len(strings) <= most:
                run = {a + b for a, b in itertools.product(run, strings)}
                continue
            whole = False
            done = _all(_all(done, of_strings(run)), of_strings(strings) if strings is not None else clauses)
            run = {""}
        return (run, _ANY) if whole else (None, _all(done, of_strings(run)))

    strings, clauses = walk(re._parser.parse(pattern))
    return of_strings(strings) if strings is not None else clauses


def posting_lists(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """The inverted index (trigram, id) of those trigrams that some rule asks for."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    held = docs.select(F.col(id_col).alias("id"), low.alias("low")).select("id", F.array_compact(F.array(*(F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams))).alias("held"))
    return held.select(F.explode("held").alias("trigram"), "id")


def candidates(postings: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """(id, rules) of the documents that a rule's query lets through: for each clause, the postings of its
    trigrams are intersected by counting how many of them have the document."""
    rows = [(kind, nth, t, len(clause)) for kind, clauses in queries.items() for nth, clause in enumerate(sorted(clauses, key=sorted)) for t in sorted(clause)]
    asked = postings.sparkSession.createDataFrame(rows, "kind string, clause int, trigram string, needed int")
    met = postings.join(F.broadcast(asked), "trigram")  # as many rows as the rules have trigrams
    met = met.groupBy("id", "kind", "clause", "needed").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == F.col("needed"))
    return met.groupBy("id").agg(F.collect_set("kind").alias("rules"))


def _spans(text: Column, order: int, rule: Rule) -> Column:
    """Matches from left to right as array<struct<start, kind_no, end, kind>>, without those too short.

    The text is split at the matches; the lengths of gaps and matches add up to the places, in code points.
    """
    rx = F.lit(rule.pattern)
    gaps, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, rx, 0)
    values = F.regexp_extract_all(text, rx, rule.group)
    span = "struct<start:int,kind_no:int,end:int,kind:string>"
    parts = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("found"))

    def step(acc: Column, part: Column) -> Column:
        first = acc["at"] + F.length(part["gap"])
        last = first + F.coalesce(F.length(part["hit"]), F.lit(0))
        own = F.struct(first.alias("start"), F.lit(order).alias("kind_no"), last.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(last.alias("at"), F.when(F.length(part["value"]) >= rule.least, F.concat(acc["found"], F.array(own))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(parts, start, step)["found"]


def _must_hold(rule: Rule) -> str:
    """A pattern that every text with a valid match has, cheap to look for first."""
    return rule.pattern[:-1] + "{%d}" % rule.least if rule.kind == "hex" else rule.pattern


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, whole_rows: bool = False) -> DataFrame:
    """(id, spans array<struct<start, kind_no, end, kind>>[, row]) for every row; row is the whole row of docs.

    Spans are in order of start, then of rules.

    From each rule's regex a Boolean query over trigrams is derived. One pass builds the posting lists of the
    trigrams in these queries; intersecting them gives the candidates of each rule, and only those texts are
    searched with its regex. Rules without mandatory trigrams search every text. Matches of a rule are
    leftmost and do not overlap; start and end count code points, end exclusive.

    Edge cases: a null text is empty and has no spans; a null id is like any other value; rows that repeat an
    id get a row each; an empty table gives no rows; other columns are left alone. Whole texts are searched.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if frozenset() not in q}
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), text, *([F.struct("*").alias("row")] if whole_rows else []))
    if indexed:
        trigrams = sorted({t for q in indexed.values() for clause in q for t in clause})
        postings = stored(posting_lists(docs, trigrams, id_col, text_col))
        found = candidates(postings, indexed).withColumnRenamed("id", "of")
        rows = rows.join(found, rows["id"].eqNullSafe(found["of"]), "left").drop("of")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")

    def of(order: int, rule: Rule) -> Column:
        wanted = F.coalesce(F.array_contains("rules", rule.kind), F.lit(False)) if rule.kind in indexed else F.lit(True)
        return F.when(wanted & F.col("text").rlike(_must_hold(rule)), _spans(F.col("text"), order, rule)).otherwise(none)

    spans = F.array_sort(F.concat(*(of(i, r) for i, r in enumerate(rules))))
    return rows.select(F.col("id").alias(id_col), spans.alias("spans"), *["row"] * whole_rows)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, parted by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind_no"] == i)).cast("bigint")
    return found.select(
        "doc_id", *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)),
        F.sha2(joined(F.filter("spans", lambda s: s["kind_no"] < len(BASE_RULES))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _kind_sql(order: int, rule: Rule) -> str:
    rx = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""
      SELECT doc_id, {order} AS k, '{rule.kind}' AS kind, s, s + length(a[i]) AS e
      FROM (
        SELECT doc_id, a, v, i,
               list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(a[1:i - 1], lambda x: length(x))), 0) AS s
        FROM (
          SELECT *, unnest(range(1, len(a) + 1)) AS i
          FROM (SELECT doc_id, string_split_regex(t, {rx}) AS g, regexp_extract_all(t, {rx}, 0) AS a, regexp_extract_all(t, {rx}, {rule.group}) AS v
                FROM d WHERE regexp_matches(t, {("'" + _must_hold(rule).replace("'", "''") + "'")}))
        )
      ) WHERE length(v[i]) >= {rule.least}"""


OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_kind_sql(i, r) for i, r in enumerate(RULES))}),
j AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {len(BASE_RULES)}) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM s GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""
