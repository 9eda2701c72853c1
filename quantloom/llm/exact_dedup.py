"""Exact dedup by content sort (operator 8), with DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from quantloom.llm.common import documents, stored


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of ASCII only take the faster lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _sorted(docs: DataFrame, id_col: str, text_col: str, keep: str, salts: int, whole_rows: bool) -> tuple[DataFrame, WindowSpec]:
    """Rows (id, norm, h, salt[, row]) in content order, and the window of a run of equal texts and salts.

    Splitters are samples of (first characters, hash, salt), so that the driver gets short keys whatever the
    texts' length; within a range the sort goes on over the whole text.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), *([F.struct("*").alias("row")] if whole_rows else []))
    base = base.withColumns({"head": F.substring("norm", 1, 64), "h": F.xxhash64("norm"), "salt": F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(salts)).cast("int")})
    return base.repartitionByRange("head", "h", "salt"), Window.partitionBy("head", "h", "salt", "norm")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", salts: int = 64) -> DataFrame:
    """Classes of equal texts: (id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. `keep` says whether the
    smallest or the largest id of a class stays.

    Method: Spark samples splitters and range-partitions the normalised texts, sorts each range externally,
    and the window over the sorted run compares the whole text of each row with its neighbour's. A salt of the
    id is part of the sort key, so that a class, however large, lies in up to `salts` runs, and no range holds
    it whole. The runs of a class, one small row for each, are put together by its digest.

    Edge cases: an empty table gives no rows; null and empty texts are one class; of rows that repeat an id,
    each gets its own result row, and group_size counts rows (those of one id lie in one run); other columns of
    docs, whatever their names, are left alone. A null id never stays if the class has another.
    """
    best = F.min if keep == "smallest" else F.max
    rows, run = _sorted(docs, id_col, text_col, keep, salts, False)
    rows = stored(rows.select("id", "salt", F.sha2("norm", 256).alias("text_sha256"), best("id").over(run).alias("best"), F.count("*").over(run).alias("n")))
    runs = rows.groupBy("text_sha256", "salt").agg(best("best").alias("best"), F.max("n").alias("n"))
    whole = Window.partitionBy("text_sha256")  # at most `salts` rows
    runs = runs.select("text_sha256", "salt", best("best").over(whole).alias("keep_id"), F.sum("n").over(whole).alias("group_size"))
    out = rows.join(runs, ["text_sha256", "salt"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", salts: int = 64) -> DataFrame:
    """One whole row of docs for each class of equal texts, by the same sort as exact_dedup.

    The first row of each run goes on, and of these the first of each class. Of rows that repeat the id that
    stays, the one with the smallest text (as it is spelt) is returned.
    """
    rows, run = _sorted(docs, id_col, text_col, keep, salts, True)
    order = [F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last(), F.col(f"row.`{text_col}`")]
    firsts = rows.withColumn("nth", F.row_number().over(run.orderBy(*order))).where("nth = 1")
    firsts = firsts.select("id", F.sha2("norm", 256).alias("sha"), "row")
    return firsts.withColumn("nth", F.row_number().over(Window.partitionBy("sha").orderBy(*order))).where("nth = 1").select("row.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest")


OP8_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
