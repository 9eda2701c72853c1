"""Sorting list rows into the divisions of a classification: by rules, and by candidate divisions for the rest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.families import holders


@dataclass(frozen=True)
class Target:
    """Where a rule puts a row."""

    division: str
    name: str = ""
    sub: str = ""
    sub_name: str = ""
    discipline: str | None = None


@dataclass(frozen=True)
class Taxonomy:
    """The rules, in the order in which classify asks them; regexes are found anywhere in the description, in either
    case, those of `information` and `sums` at its start."""

    sections: Mapping[str, str]
    preliminaries: str = "PRELIM"
    information: str | None = None
    sums: str | None = None
    sum_targets: Mapping[str, Target] = field(default_factory=dict)
    patterns: Sequence[tuple[str, Target]] = ()
    subsections: Mapping[str, Target] = field(default_factory=dict)
    keywords: Mapping[str, Sequence[tuple[str, Target]]] = field(default_factory=dict)
    other_keywords: str | None = None
    lent: Mapping[str, tuple[str, Sequence[str], bool]] = field(default_factory=dict)
    """discipline -> (whose keywords it asks too, divisions, whether these alone count or are left out)."""
    split: Mapping[str, tuple[int, int, str, str]] = field(default_factory=dict)
    """discipline -> (lowest, highest division number, group of these, group of the others)."""


def _first(text: Column, rules: Sequence[tuple[str, Target]], at_start: bool = False) -> Column:
    """Number of the first rule whose regex the text has, or null."""
    out = F.when(F.lit(False), F.lit(0))
    for n, (rx, _) in enumerate(rules):
        out = out.when(text.rlike(f"(?i){'^(?:' if at_start else '(?:'}{rx})"), F.lit(n))
    return out


def _target(t: Target) -> Column:
    return F.struct(*(F.lit(v).cast("string").alias(c) for c, v in zip(("division", "name", "sub", "sub_name", "discipline"), (t.division, t.name, t.sub, t.sub_name, t.discipline), strict=True)))


def _pick(number: Column, rules: Sequence[Target]) -> Column:
    return F.get(F.array(*map(_target, rules)), number) if rules else F.lit(None).cast("struct<division:string,name:string,sub:string,sub_name:string,discipline:string>")


def _head(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(text, "\n", 1), r"(?U)^\s+|\s+$", "")


def classify(df: DataFrame, rules: Taxonomy) -> DataFrame:
    """Adds to rows (section, subsection, descr): discipline, division, name, sub, sub_name, source, sort_key (the
    division) and group (the discipline, or its part by division number).

    A section without a discipline leaves the row unresolved; preliminaries stay what they are; then information
    rows, provisional sums by the works that their first group names (in upper case), patterns, the subsection
    (as it is, else by its first line), the discipline's keywords, and those that another discipline lends. Rows are
    decided where they are; nulls count as empty, and columns of these names are replaced.
    """
    clean = df.withColumns({f"_{c}": F.coalesce(c, F.lit("")) for c in ("section", "subsection", "descr")})
    descr, section = F.col("_descr"), F.col("_section")
    discipline = reduce(lambda acc, s: acc.when(section == s[0], F.lit(s[1])), rules.sections.items(), F.when(F.lit(False), F.lit("")))
    clean = clean.withColumn("_d", discipline)
    known = F.col("_d").isNotNull() & (F.col("_d") != rules.preliminaries)

    found: list[tuple[Column, Column, str]] = [(F.col("_d") == rules.preliminaries, _target(Target(rules.preliminaries)), "rule")]
    if rules.information:
        found.append((known & descr.rlike(f"(?i)^(?:{rules.information})"), _target(Target("INFO")), "rule"))
    if rules.sums and rules.sum_targets:
        works = F.upper(F.trim(F.regexp_extract(descr, f"(?i)^(?:{rules.sums})", 1)))
        clean = clean.withColumn("_sum", reduce(lambda acc, w: acc.when(works == w[1], F.lit(w[0])), enumerate(rules.sum_targets), F.when(F.lit(False), F.lit(0))))
        found.append((known & F.col("_sum").isNotNull(), _pick(F.col("_sum"), list(rules.sum_targets.values())), "provisional_sum"))

    def by_rules(column: str, source: str, listed: Sequence[tuple[str, Target]], where: Column) -> None:
        nonlocal clean
        if listed:
            clean = clean.withColumn(column, F.when(where, _first(descr, listed)))
            found.append((F.col(column).isNotNull(), _pick(F.col(column), [t for _, t in listed]), source))

    by_rules("_pattern", "pattern", rules.patterns, known)
    if rules.subsections:
        sub = F.col("_subsection")
        exact = reduce(lambda acc, s: acc.when(sub == s[1], F.lit(s[0])), enumerate(rules.subsections), F.when(F.lit(False), F.lit(0)))
        loose = reduce(lambda acc, s: acc.when(_head(sub) == s[1].split("\n")[0].strip(), F.lit(s[0])), enumerate(rules.subsections), F.when(F.lit(False), F.lit(0)))
        clean = clean.withColumn("_sub", F.when(known, F.coalesce(exact, loose)))
        found.append((F.col("_sub").isNotNull(), _pick(F.col("_sub"), list(rules.subsections.values())), "subsection"))
    for n, (d, listed) in enumerate(rules.keywords.items()):
        others = ~F.col("_d").isin(list(rules.keywords)) if d == rules.other_keywords else F.lit(False)
        by_rules(f"_own{n}", "keyword", listed, known & ((F.col("_d") == d) | others))
    for n, (d, (lender, divisions, alone)) in enumerate(rules.lent.items()):
        listed = [r for r in rules.keywords.get(lender, ()) if (r[1].division in divisions) == alone]
        by_rules(f"_lent{n}", f"keyword of {lender}", listed, F.col("_d") == d)

    to = reduce(lambda acc, f: acc.when(f[0], f[1]), found, F.when(F.lit(False), _pick(F.lit(0), [Target("")])))
    source = reduce(lambda acc, f: acc.when(f[0], F.lit(f[2])), found, F.when(F.lit(False), F.lit(""))).otherwise("unresolved")
    out = clean.withColumns({"_to": to, "_source": source})
    division = F.coalesce("_to.division", F.lit(""))
    number = F.regexp_extract(division, r"^[A-Z]\.(\d+)", 1).try_cast("int")
    landed = F.coalesce("_to.discipline", "_d")
    group = reduce(lambda acc, s: acc.when((landed == s[0]) & number.isNotNull(), F.when(number.between(s[1][0], s[1][1]), s[1][2]).otherwise(s[1][3])), rules.split.items(), F.when(F.lit(False), F.lit("")))
    added = {"discipline": landed, **{c: F.coalesce(f"_to.{c}", F.lit("")) for c in ("division", "name", "sub", "sub_name")}, "source": F.col("_source"), "sort_key": division, "group": group.otherwise(landed)}
    return out.select(*(c for c in df.columns if c not in added), *(v.alias(c) for c, v in added.items()))


def candidates(groups: DataFrame, divisions: DataFrame, subs: DataFrame, glossary: Mapping[str, Sequence[tuple[str, Sequence[str]]]], router: Sequence[tuple[str, Sequence[tuple[str, str | None]]]]) -> DataFrame:
    """(grp, book, code, name, subs): the divisions that may hold a group (grp, path, text), with all their
    sub-divisions as sorted structs (code, name).

    divisions (book, code, name), subs (book, code, sub, name). The router's regexes are found in the lower-cased
    path and force (book, code), a code of None all divisions of the book. A book's glossary gives local words for a
    phrase ('a/b c'): they count if the text has one of them, or as a whole word a part of the phrase of four
    characters or more; then divisions count whose name, or the name of one of whose sub-divisions, has such a word.
    Nulls count as empty.
    """
    spark = groups.sparkSession
    texts = groups.select("grp", F.coalesce("text", F.lit("")).alias("text"), F.lower(F.coalesce("path", F.lit(""))).alias("path")).distinct()
    one = "struct<book:string,only:string>"
    forced = [F.when(F.col("path").rlike(rx), F.array(*(F.struct(F.lit(b).alias("book"), F.lit(c).cast("string").alias("only")) for b, c in to))).otherwise(F.array().cast(f"array<{one}>")) for rx, to in router]
    forced = F.flatten(F.array(*forced)) if router else F.array().cast(f"array<{one}>")
    out = texts.select("grp", F.explode(forced).alias("f")).select("grp", "f.*").distinct().join(divisions.select("book", "code"), "book").where("only is null or only = code").select("grp", "book", "code")
    entries = [(f"{book}/{n}", book, phrase, word) for book, listed in glossary.items() for n, (phrase, words) in enumerate(listed) for word in words if word]
    if entries:
        glossed = spark.createDataFrame(entries, "entry string, book string, phrase string, local string")
        parts = glossed.select("entry", F.explode(F.split("phrase", r"(?U)[/\s]+")).alias("part")).where("length(part) > 3").withColumn("part", F.lower("part")).distinct()
        said = texts.select("text").distinct()
        whole = holders(parts.select(F.col("part").alias("word")), said, F.lower("text"))
        whole = whole.where(F.regexp_like(F.lower("text"), F.concat(F.lit(r"(?U)\b\Q"), "word", F.lit(r"\E\b")))).join(parts.withColumnRenamed("part", "word"), "word").select("text", "entry")
        own = holders(glossed.select(F.col("local").alias("word")), said, F.col("text")).join(glossed.select("entry", F.col("local").alias("word")), "word").select("text", "entry")
        words = whole.union(own).distinct().join(glossed, "entry").select("text", "book", F.lower("local").alias("word")).distinct()
        named = divisions.select("book", "code", "name").union(subs.select("book", "code", "name")).where("name is not null").distinct()
        held = holders(words, named.select(F.lower("name").alias("text")).distinct(), F.col("text")).withColumnRenamed("text", "name")
        fit = named.withColumn("name", F.lower("name")).join(held, "name").select("book", "code", "word").distinct()
        out = out.union(words.join(fit, ["book", "word"]).select("text", "book", "code").distinct().join(texts, "text").select("grp", "book", "code"))
    below = subs.groupBy("book", "code").agg(F.array_sort(F.collect_set(F.struct(F.col("sub").alias("code"), "name"))).alias("subs"))
    known = divisions.groupBy("book", "code").agg(F.min("name").alias("name")).join(below, ["book", "code"], "left")
    return out.distinct().join(known, ["book", "code"]).select("grp", "book", "code", "name", F.coalesce("subs", F.array().cast("array<struct<code:string,name:string>>")).alias("subs"))


@dataclass(frozen=True)
class Routing:
    """headers: regexes of rows that are titles; skip: of totals and notes; preliminaries: markers in the lower-cased
    titles; sums, sum_targets, patterns: as in Taxonomy; unique, low: up to so many candidate divisions of `books`."""

    headers: Sequence[str]
    skip: Sequence[str]
    preliminaries: Sequence[str]
    sums: str | None = None
    sum_targets: Sequence[str] = ()
    patterns: Sequence[str] = ()
    books: Sequence[str] = ("A", "B", "C")
    unique: int = 1
    low: int = 3
    sample: int = 15


def route(df: DataFrame, rules: Routing, divisions: DataFrame, subs: DataFrame, glossary: Mapping[str, Sequence[tuple[str, Sequence[str]]]], router: Sequence[tuple[str, Sequence[tuple[str, str | None]]]]) -> DataFrame:
    """Adds route to rows (row_no, dept1, dept2, dept3, descr): SKIP for empty rows, titles, totals and notes; PRELIM
    under titles with a marker; for provisional sums SUM if their first group is a target, else PRELIM; PATTERN where
    a pattern is found in the description or its titles; else ZERO, UNIQUE, LOW or HIGH by the candidate divisions of
    all rows of the same dept1 and dept2, for which their first `sample` rows stand, as one text, empty rows, titles
    and preliminaries aside."""
    text = F.coalesce("descr", F.lit(""))
    titles = F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in ("dept1", "dept2", "dept3")))
    path = F.lower(F.concat_ws(" ", F.nullif("dept1", F.lit("")), F.nullif("dept2", F.lit(""))))
    any_of = lambda c, listed: reduce(lambda acc, rx: acc | c.rlike(f"(?i){rx}"), listed, F.lit(False))
    title = (text == "") | any_of(F.trim(text), rules.headers)
    early = reduce(lambda acc, m: acc | F.contains(path, F.lit(m)), rules.preliminaries, F.lit(False))
    df = df.withColumns({"_title": title, "_skip": title | any_of(text, rules.skip), "_early": early, "_path": path, "_a": F.coalesce("dept1", F.lit("")), "_b": F.coalesce("dept2", F.lit(""))})
    asked = df.where("not _title and not _early").select("_a", "_b", "_path", "row_no", "descr")
    asked = asked.withColumn("n", F.row_number().over(Window.partitionBy("_a", "_b").orderBy("row_no", "descr"))).where(F.col("n") <= rules.sample)
    pools = asked.groupBy("_a", "_b").agg(F.min("_path").alias("path"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "descr"))), lambda s: s["descr"]), " ").alias("text"))
    found = candidates(pools.select(F.struct("_a", "_b").alias("grp"), "path", "text"), divisions, subs, glossary, router)
    counts = found.where(F.col("book").isin(list(rules.books))).groupBy("grp._a", "grp._b").agg(F.count("*").alias("_n"))
    out = df.join(counts, ["_a", "_b"], "left")
    n = F.coalesce("_n", F.lit(0))
    by_count = F.when(n == 0, "ZERO").when(n <= rules.unique, "UNIQUE").when(n <= rules.low, "LOW").otherwise("HIGH")
    named = F.when(F.col("_skip"), "SKIP").when(F.col("_early"), "PRELIM")
    if rules.sums:
        rx = f"(?i)^(?:{rules.sums})"
        named = named.when(text.rlike(rx), F.when(F.regexp_extract(text, rx, 1).isin(list(rules.sum_targets)), "SUM").otherwise("PRELIM"))
    named = named.when(any_of(F.concat_ws(" ", text, titles), rules.patterns), "PATTERN")
    return out.withColumn("route", named.otherwise(by_count)).drop("_a", "_b", "_n", "_title", "_skip", "_early", "_path")
