"""Keyword, vector and hybrid search over all rows, many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.text_jobs import rank_first


def _trigrams(text):
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def _gram_pattern(grams: list[str]) -> str:
    """A pattern that finds each place where one of the trigrams begins, also where they overlap."""
    plain = lambda s: "".join(c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}" for c in s)
    heads: dict[str, list[str]] = {}
    for g in sorted(grams):
        heads.setdefault(g[0], []).append(plain(g[1:]))
    return "(?=(" + "|".join(f"{plain(h)}(?:{'|'.join(rest)})" for h, rest in heads.items()) + "))"


def bm25_search(passages: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int, k1: float = 1.2, b: float = 0.75, most_grams: int = 10_000) -> DataFrame:
    """(query, nth, id, score): the k best passages of each query by BM25 over character trigrams.

    The distinct trigrams of queries (query, terms) make one pattern that finds them in the passages, so that no
    other trigram of a passage becomes a row. With more than `most_grams` of them, every trigram of the passages
    is met with those of the queries in a join. Either way a passage costs in proportion to its length; passage
    lengths and the number of passages cover the whole table. Rows with the same id count as one passage only
    if they are as long.
    """
    wanted = queries.select("query", F.explode(F.array_distinct(_trigrams(F.col("terms")))).alias("gram"))
    grams = [r.gram for r in wanted.select("gram").distinct().limit(most_grams + 1).collect()]
    many = len(grams) > most_grams
    pattern = r"(?s)(?=(.{3}))" if many else _gram_pattern(grams)
    found = F.regexp_extract_all(F.lower(text_col), F.lit(pattern), 1) if grams else F.array().cast("array<string>")
    stats = passages.agg(F.count("*").alias("n"), F.avg(F.greatest(F.length(text_col) - 2, F.lit(0))).alias("mean")).first()
    postings = passages.select(F.col(id_col).alias("id"), F.greatest(F.length(text_col) - 2, F.lit(0)).alias("len"), F.explode(found).alias("gram"))
    if many:
        postings = postings.join(wanted.select("gram").distinct(), "gram", "left_semi")
    tf = postings.groupBy("id", "len", "gram").agg(F.count("*").alias("tf"))
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(stats["mean"])))
    met = tf.join(df, "gram").join(wanted if many else F.broadcast(wanted), "gram")
    scored = met.groupBy("query", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).select("query", "nth", F.col("id").alias(id_col), "score")


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, most_queries: int = 10_000) -> DataFrame:
    """(query, nth, vec_id, distance): the k nearest vectors of each query by Euclidean distance, exactly.

    Up to `most_queries` of the queries (query, q) go to all tasks as one matrix; each batch of vectors keeps
    its k best for each query, and a window joins these. More queries are cut in halves by hash, and each half
    reads the vectors again: any number is answered, in memory that does not grow.
    """

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)

    return _nearest(vectors.select("vec_id", "embedding"), read, queries, k, most_queries)


def passage_topk(passages: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int, dim: int = 64, most_queries: int = 10_000) -> DataFrame:
    """As vector_topk of embed_passages, with vec_id the passage's id: texts are embedded and searched by the same
    Python workers, which hold one batch of texts and its vectors."""
    spread = []

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        if not spread:
            spread.append(_spread(dim))
        keep, x = _embedded(batch.column(1), spread[0])
        return np.asarray(batch.column(0))[keep], x

    return _nearest(passages.select(id_col, text_col), read, queries, k, most_queries)


def _nearest(source: DataFrame, read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], queries: DataFrame, k: int, most_queries: int, depth: int = 0) -> DataFrame:
    """vector_topk over batches of source, of which `read` makes ids and vectors."""
    rows = queries.limit(most_queries + 1).collect()
    if len(rows) > most_queries:
        if depth > 40:
            raise ValueError(f"one query stands more than {most_queries} times")
        half = F.pmod(F.xxhash64(F.lit(depth), "query"), F.lit(2))
        one, two = (_nearest(source, read, queries.where(half == i), k, most_queries, depth + 1) for i in (0, 1))
        return one.unionByName(two)
    names, matrix = np.array([r["query"] for r in rows]), np.array([r["q"] for r in rows], float)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            ids, x = read(batch)
            if not len(ids):
                continue
            x = x.astype(float)
            for first in range(0, len(names), 256):
                q = matrix[first : first + 256]
                d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0))
                order = np.lexsort((np.broadcast_to(ids, d.shape), np.round(d, 6)), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[first : first + 256], order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.round(np.take_along_axis(d, order, 1), 6).ravel())], names=["query", "vec_id", "distance"])
            del batch, ids, x  # before the next batch comes, not after
            pa.default_memory_pool().release_unused()

    near = source.mapInArrow(search, "query bigint, vec_id bigint, distance double")
    best = Window.partitionBy("query").orderBy("distance", "vec_id")
    return near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).select("query", "nth", "vec_id", "distance")


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, id_col: str, k: int, weight: float = 0.4) -> DataFrame:
    """Combined ranking of (query, id, score) and (query, id, distance): weight times score over the largest,
    plus the rest times 1 - distance over the largest."""
    by = Window.partitionBy("query")
    t = text_hits.select("query", id_col, (F.col("score") / F.max("score").over(by)).alias("t"))
    v = vector_hits.select("query", id_col, (1 - F.col("distance") / F.max("distance").over(by)).alias("v"))
    both = t.join(v, ["query", id_col], "full").withColumn("score", F.round(weight * F.coalesce("t", F.lit(0.0)) + (1 - weight) * F.coalesce("v", F.lit(0.0)), 6))
    return both.withColumn("nth", F.row_number().over(by.orderBy(F.desc("score"), id_col))).where(F.col("nth") <= k).select("query", "nth", id_col, "score")


def session_search(messages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, n, conv_id, turn, score): the best message of each conversation among the top max(5 k, 10)
    messages, then the k best of these. Messages are told apart by conversation and turn."""
    keyed = messages.select(F.struct("conv_id", "turn").alias("key"), "text")
    hits = bm25_search(keyed, queries, "key", "text", max(5 * k, 10)).withColumn("conv_id", F.col("key.conv_id"))
    best = rank_first(hits, ["query", "conv_id"], [F.asc("nth")])
    return best.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("nth"))).where(F.col("n") <= k).select("query", "n", "conv_id", "key.turn", "score")


def _spread(dim: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((4096, dim))


def _embedded(texts: pa.Array, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the texts of three bytes or more, and their vectors."""
    keep, x = [], np.empty((len(texts), spread.shape[1]), np.float32)
    for at, text in enumerate(texts):
        data = np.frombuffer((text.as_py() or "").lower().encode(), np.uint8).astype(np.int64)
        if len(data) < 3:
            continue
        grams = (data[:-2] * 65536 + data[1:-1] * 256 + data[2:]) * 2654435761 % 4294967296 >> 20
        v = np.bincount(grams, minlength=4096) @ spread
        x[len(keep)] = v / max(np.linalg.norm(v), 1e-9)
        keep.append(at)
    return np.array(keep, np.int64), x[: len(keep)]


def embed_passages(passages: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, embedding): hashed character trigrams, normalised; empty texts are skipped. It stands in where no
    model is installed, and has the same shape of job: batches, with the state made once for each worker."""
    kind = passages.schema[id_col].dataType.simpleString()

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = _spread(dim)
        for batch in batches:
            keep, x = _embedded(batch.column(1), spread)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.ListArray.from_arrays(np.arange(0, x.size + 1, dim, dtype=np.int32), pa.array(x.ravel()))], names=[id_col, "embedding"])

    return passages.select(id_col, text_col).mapInArrow(embed, f"`{id_col}` {kind}, embedding array<float>")


def message_lookup(messages: DataFrame, names: DataFrame, term: str, role: str, limit: int = 30) -> DataFrame:
    """Messages of a role with the term; if none, those of any role; with their group's name, newest first."""
    hits = messages.where(F.col("text").contains(term))
    typed = hits.where(F.col("role") == role)
    any_typed = typed.limit(1).select(F.lit(1).alias("one"))
    rest = hits.join(any_typed, F.lit(True), "left_anti")
    both = typed.unionByName(rest.where(F.col("role") != role))
    return both.join(names, "conv_id", "left").orderBy(F.desc("conv_id"), F.desc("turn")).limit(limit)


def passages_by_heading(chunks: DataFrame, id_col: str) -> DataFrame:
    """(id, heading, text): the chunks below each heading of each document in order, parted by blank lines; the
    heading is null for what comes before any. A section's chunks fit a row."""
    return chunks.groupBy(id_col, "heading").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_order", "chunk"))), lambda c: c["chunk"]), "\n\n").alias("text"))


def norm_index(norms: DataFrame, chapters: DataFrame) -> DataFrame:
    """Norms with their chapter's name, one for each code and attributes (the smallest id), and search text."""
    met = norms.join(chapters, "chapter", "left")
    once = rank_first(met, ["code", "attr1", "attr2"], [F.asc("norm_id")])
    return once.withColumns({"search_text": F.lower(F.concat_ws(" ", "name", "chapter_name", "attr1", "attr2")), "unit": F.coalesce(F.nullif("unit", F.lit("")), F.lit("No."))})
