"""A corpus pipeline over `documents`: each stage filters or places what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import documents, stored
from quantloom.llm.exact_dedup import distinct_texts
from quantloom.llm.language_id import UNKNOWN, has_letter, language_id
from quantloom.llm.minhash import near_duplicates
from quantloom.llm.packing import pack_documents
from quantloom.llm.secret_scan import secret_scan


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter have no language and go. The others keep their columns; lang stays what the
    source said, and takes the prediction where it said nothing. Where no row has a language to learn from,
    nothing is predicted and lang stays null."""
    found = language_id(docs, whole_rows=True).where(has_letter("row.text"))
    lang = F.coalesce(F.col("row.lang"), F.nullif(F.col("lang_pred"), F.lit(UNKNOWN)))
    return found.select(*(lang.alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z), the document with the smallest doc_id stays."""
    return distinct_texts(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8), the smallest doc_id stays."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["kept_key"])
    return docs.join(kept, same, "left_semi")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a secret go."""
    return secret_scan(docs, whole_rows=True).where(F.size("spans") == 0).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in training sequences."""
    return pack_documents(docs, keep_ids=False)


STAGES = [
    ("language ID", identified),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: SQL has neither the language model nor the tokenizer; tests/llm holds the stages against literal rows, and run() against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again before the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
