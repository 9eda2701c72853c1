"""Reading and writing lists of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def labelled(df: DataFrame, label: str, columns: dict[str, str]) -> DataFrame:
    """The wanted columns of a list under their common names, with the list's label."""
    return df.select(F.lit(label).alias("list_id"), *(F.col(source).alias(name) for name, source in columns.items()))


def read_lists(spark: SparkSession, specs: list[tuple[str, str, str, dict[str, str]]]) -> DataFrame:
    """Several files as one table; each spec is (label, format, path, columns by common name)."""
    frames = [labelled(spark.read.format(kind).load(path), label, columns) for label, kind, path, columns in specs]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def union_by_header(frames: list[tuple[str, DataFrame]], synonyms: list[set[str]], skip: tuple[str, ...] = ()) -> DataFrame:
    """Tables of different width as one with the widest one's columns.

    A column finds its place by equal name, then by a synonym, then by position among the places that are
    still free; what finds none keeps its own name. Tables whose label is in skip (summaries, which would
    count twice) are left out. Only schemas are compared on the driver.
    """
    used = [(label, df) for label, df in frames if label not in skip]
    template = max((df.columns for _, df in used), key=len)
    low = {c.lower(): c for c in template}
    out = None
    for label, df in used:
        to: dict[str, str] = {c: low[c.lower()] for c in df.columns if c.lower() in low}
        for c in df.columns:
            if c not in to:
                group = next((g for g in synonyms if c.lower() in g), set())
                place = next((t for t in template if t.lower() in group and t not in to.values()), None)
                if place:
                    to[c] = place
        for at, c in enumerate(df.columns):
            if c not in to:
                to[c] = template[at] if at < len(template) and template[at] not in to.values() else c
        frame = df.select(F.lit(label).alias("list_id"), *(F.col(c).alias(to[c]) for c in df.columns))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def read_master(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A master table of JSON lines; all fields as the schema says, what is missing null."""
    return spark.read.schema(schema).json(path)


def write_master(df: DataFrame, path: str) -> None:
    """The whole table as JSON lines in a new folder; readers of the old one are not disturbed."""
    df.write.mode("errorifexists").json(path)


def export_partitions(df: DataFrame, by: str, path: str) -> None:
    """One folder for each value of a column."""
    df.write.partitionBy(by).parquet(path)


def export_manifest(df: DataFrame, by: str, key: str) -> DataFrame:
    """Rows and first and last key of each exported part."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
