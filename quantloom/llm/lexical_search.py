"""Ranked lexical search with ball trees over sparse integer vectors (operator 12)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import LOWER, documents, slices, stored, word_hashes, words

#: What parts terms: ASCII other than digits and letters.
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Bounds are raised by this share, which is far above the rounding of sums over a hundred thousand doubles.
_SAFE = 1e-9


def _terms(text: str | None) -> set[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    low = LOWER[data]
    starts, ends, _ = words(low, np.array([0, len(low)]), APART)
    return {low[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}


def term_vectors(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of the documents with a term: how many terms the whole text has, and the numbers and
    counts of those in the vocabulary. A hash finds the candidates, and the bytes decide."""
    kind = docs.schema[id_col].dataType.simpleString()
    letters = np.frombuffer(b"".join(vocabulary), np.uint8)
    edge = np.cumsum([0, *map(len, vocabulary)])
    hashes = word_hashes(letters, edge[:-1], edge[1:])
    order = np.argsort(hashes)
    hashes = hashes[order]

    def numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place in the vocabulary of each word, or -1."""
        if not len(hashes) or not len(starts):
            return np.full(len(starts), -1)
        found = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        out = np.where(hashes[at] == found, order[at], -1)
        size = ends - starts
        out[(out >= 0) & (edge[out + 1] - edge[out] != size)] = -1
        for length in np.unique(size[out >= 0]).tolist():
            same = np.flatnonzero((out >= 0) & (size == length))
            for some in np.array_split(same, 1 + len(same) * length // (1 << 22)):
                reach = np.arange(length)
                equal = (data[starts[some][:, None] + reach] == letters[edge[out[some]][:, None] + reach]).all(1)
                out[some[~equal]] = -1
        return out

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch, batch.schema.names[1]):
                data = LOWER[data]
                starts, ends, before = words(data, offsets, APART)
                n = np.diff(before)
                term = numbers(data, starts, ends)
                text = np.repeat(np.arange(last - first), n)[term >= 0]
                pair, tf = np.unique(text * max(1, len(vocabulary)) + term[term >= 0], return_counts=True)
                text, term = np.divmod(pair, max(1, len(vocabulary)))
                at = np.searchsorted(text, np.arange(last - first + 1)).astype(np.int32)
                out = [batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(term, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, names=["id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return docs.select(id_col, text_col).mapInArrow(vectors, f"id {kind}, n bigint, terms array<int>, tfs array<bigint>")


class BallTree:
    """Sparse vectors of integers under nested balls; node i has the rows order[first[i]:last[i]]."""

    def __init__(self, at: np.ndarray, term: np.ndarray, value: np.ndarray, leaf: int):
        self.columns, term = np.unique(term, return_inverse=True)
        self.at, self.term, self.value, self.leaf = at, term, value, leaf
        self.real = value.astype(np.float64)
        rows = len(at) - 1
        self.row = np.repeat(np.arange(rows), np.diff(at))
        self.square = np.bincount(self.row, self.real * self.real, rows)
        self.order = np.arange(rows)
        self.first, self.last, self.children, self.centre, self.radius, self.held = [], [], [], [], [], []
        self._grow(0, rows)
        entries, which = self._entries(self.order)  # from now on in the order of the leaves
        self.term, self.value = term[entries], value[entries]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=rows))])

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of some rows, and to which of them each belongs."""
        size = self.at[rows + 1] - self.at[rows]
        which = np.repeat(np.arange(len(rows)), size)
        return np.arange(len(which)) + np.repeat(self.at[rows] - np.cumsum(size) + size, size), which

    def _distances(self, rows: np.ndarray, entries: np.ndarray, which: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Upper bounds of the squared distances from a point."""
        dot = np.bincount(which, self.real[entries] * point[self.term[entries]], len(rows))
        scale = self.square[rows] + point @ point
        return np.maximum(scale - 2 * dot, 0) + _SAFE * scale

    def _point(self, row: int) -> np.ndarray:
        point = np.zeros(len(self.columns))
        own = slice(self.at[row], self.at[row + 1])
        point[self.term[own]] = self.real[own]
        return point

    def _grow(self, first: int, last: int) -> int:
        node, rows = len(self.first), self.order[first:last]
        entries, which = self._entries(rows)
        total = np.bincount(self.term[entries], self.real[entries], len(self.columns))
        centre = total / len(rows)
        far = self._distances(rows, entries, which, centre)
        for part, x in zip((self.first, self.last, self.children, self.centre, self.radius, self.held), (first, last, (), centre, math.sqrt(far.max()) * (1 + _SAFE), total > 0), strict=True):
            part.append(x)
        if len(rows) > self.leaf:
            one = self._point(rows[far.argmax()])
            to_one = self._distances(rows, entries, which, one)
            two = self._point(rows[to_one.argmax()])
            nearer = np.argsort(to_one - self._distances(rows, entries, which, two), kind="stable")
            self.order[first:last] = rows[nearer]
            middle = first + len(rows) // 2
            self.children[node] = (self._grow(first, middle), self._grow(middle, last))
        return node

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of 0/1 queries with the members of each node, as [query, node].

        A query meets a ball's members in the terms that any of them holds, so that its length there counts.
        """
        dot = asked @ np.stack(self.centre).T
        met = asked @ np.stack(self.held).T.astype(np.float64)
        return (dot + np.sqrt(met) * np.array(self.radius)) * (1 + _SAFE) + 1

    def search(self, asked: np.ndarray, bounds: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of all rows that may be among the k best with `least` or more, and above 0.

        Nodes are visited from the largest bound on; what is left when the bound falls below the k-th best score
        is pruned. Scores are sums of 64-bit integers.
        """
        floor, best = max(1, least), []
        queue, rows, scores = [(-bounds[0], 0)], [], []
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor:
                break
            for child in self.children[node]:
                heapq.heappush(queue, (-bounds[child], child))
            if not self.children[node]:
                own = self.order[self.first[node] : self.last[node]]
                edge = self.at[self.first[node] : self.last[node] + 1]
                entries = slice(edge[0], edge[-1])
                score = np.add.reduceat(self.value[entries] * asked[self.term[entries]], edge[:-1] - edge[0])
                good = np.flatnonzero(score >= floor)
                rows.append(own[good])
                scores.append(score[good])
                for s in score[good].tolist():
                    if len(best) < k:
                        heapq.heappush(best, s)
                    elif s > best[0]:
                        heapq.heapreplace(best, s)
                if len(best) == k:
                    floor = max(floor, best[0])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, score = np.concatenate(rows), np.concatenate(scores)
        return row[score >= floor], score[score >= floor]


def _searched(vectors: DataFrame, asked: list[list[int]], weights: list[int], n: int, total: int, least: list[int], k: int, tree: int, leaf: int) -> DataFrame:
    """(item, id, score): from each tree of `tree` neighbouring vectors, the k best rows for each item."""
    kind = vectors.schema["id"].dataType.simpleString()
    weight = np.array(weights, np.int64)
    mask = np.zeros((len(asked), len(weights)), bool)
    for i, own in enumerate(asked):
        mask[i, own] = True

    def found(batch: pa.Table) -> pa.RecordBatch:
        ids, terms, tfs = (batch.column(i).combine_chunks() for i in (0, 2, 3))
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))]).astype(np.int64)
        term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs))
        m = 100 - 50 + (50 * batch.column(1).to_numpy() * n) // total
        value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(at))))
        balls = BallTree(at, term, value, leaf)
        own = mask[:, balls.columns]
        bounds = balls.bounds(own.astype(np.float64))
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))  # nulls last
        items, rows, scores = [], [], []
        for item in np.flatnonzero(bounds[:, 0] >= np.maximum(1, least)).tolist():
            row, score = balls.search(own[item], bounds[item].tolist(), least[item], k)
            top = np.lexsort((place[row], -score))[:k]
            items.append(np.full(len(top), item))
            rows.append(row[top])
            scores.append(score[top])
        whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(whole(items), pa.int32()), ids.take(pa.array(whole(rows))), pa.array(whole(scores), pa.int64())], names=["item", "id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, tree):
                part = batch.slice(first, tree)
                if rows + part.num_rows > tree:
                    yield found(pa.Table.from_batches(held))
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield found(pa.Table.from_batches(held))

    # Vectors whose weightiest terms agree lie side by side, so that balls are small; a hash parts equal ones.
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    heavy = F.slice(F.array_sort(F.transform("terms", lambda t: F.struct((-F.get(table, t)).alias("w"), t.alias("t")))), 1, 2)
    near = vectors.where(F.size("terms") > 0).withColumn("heavy", F.transform(heavy, lambda x: x["t"]))
    near = near.repartitionByRange(F.col("heavy")[0], F.get("heavy", F.lit(1)), F.xxhash64("id", "n")).sortWithinPartitions(F.col("heavy")[0], F.get("heavy", F.lit(1)), F.xxhash64("id", "n"))
    return near.select("id", "n", "terms", "tfs").mapInArrow(search, f"item int, id {kind}, score bigint")


def _best(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_items(docs: DataFrame, terms: dict, kind: str, k: int, id_col: str, text_col: str, tree: int, leaf: int, first_share: int) -> DataFrame:
    """(item_id, rank, id, score) for items with these terms."""
    spark = docs.sparkSession
    items = list(terms)
    vocabulary = sorted(set().union(*terms.values()))
    number = {t: i for i, t in enumerate(vocabulary)}
    asked = [sorted(number[t] for t in terms[i]) for i in items]
    vectors = stored(term_vectors(docs, vocabulary, id_col, text_col))
    n, total = vectors.agg(F.count("*"), F.sum("n")).first()
    df = {r.term: r["count"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # as many rows as the items have terms
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))]

    def searched(part: DataFrame, least: list[int]) -> DataFrame:
        return _searched(part, asked, weights, n, total or 1, least, k, tree, leaf)

    sample = F.pmod(F.xxhash64(F.lit(12), "id", "n"), F.lit(first_share)) == 0
    begun = stored(_best(searched(vectors.where(sample), [0] * len(items)), k))
    least = {r["item"]: r["score"] for r in begun.where(F.col("rank") == k).select("item", "score").collect()}  # a row for each item
    rest = searched(vectors.where(~sample), [least.get(i, 0) for i in range(len(items))])
    best = _best(begun.drop("rank").unionByName(rest), k)
    names = spark.createDataFrame(list(enumerate(items)), f"item int, item_id {kind}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias(id_col), "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = 256, tree: int = 4096, leaf: int = 32, first_share: int = 16) -> DataFrame:
    """(item_id, rank, id, score): for each item, the k rows of docs with the highest scores above 0.

    Terms are runs of ASCII digits and letters (A-Z lower-cased) and all that is not ASCII. An item's terms count
    once each. Statistics (N, L, df) are those of all docs. A document's score is the inner product of its vector,
    weight * ((10^9 * tf) div (1000 * tf + 20 * m)) for each term, with the item's 0/1 vector.

    1. One pass over the texts makes sparse vectors of the items' terms, written once.
    2. Vectors are range-partitioned by their weightiest terms (a hash of the row is part of the key, so that equal
       ones are dealt out), and every `tree` neighbours get a ball tree: balls are halved by their two farthest
       members down to `leaf` rows; each knows its centroid, a radius rounded up, and the terms held in it.
    3. An item's inner product with any member of a ball is at most that with the centroid plus radius times the
       length of the item's part that the ball holds. Subtrees are visited from the largest bound on, and those
       below the k-th best score are pruned. Scores in leaves are sums of 64-bit integers.
    4. One row in `first_share` is searched first: the k-th best scores there are lower bounds from which the
       search of all others starts. The k best of each tree meet for the final order.

    Items come in blocks of about `block`, by a hash of item_id, each with its own pass over docs; a block's texts
    reach the driver, as do the document frequencies of its terms.

    Edge cases: null texts, and texts without a term, are in no count and no result; equal scores are in the order
    of id (null last), rows that repeat an id are ranked each; an item_id that repeats, or is null, is one item with
    the terms of all its rows; items without terms, and an empty table, have no rows; other columns are left alone.
    """
    kind, doc_kind = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    blocks = -(-rows.count() // block)
    found = []
    for nth in range(blocks):
        terms: dict = {}
        for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == nth).collect():
            terms.setdefault(r.item_id, set()).update(_terms(r.text))
        if any(terms.values()):
            found.append(_search_items(docs, terms, kind, k, id_col, text_col, tree, leaf, first_share))
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, `{id_col}` {doc_kind}, score bigint").withColumnRenamed("item_id", item_col)
    return reduce(DataFrame.unionByName, found).withColumnRenamed("item_id", item_col)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_RUNS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format("text")}, '{_RUNS}') AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOW.format("text")}, '{_RUNS}')) AS term FROM benchmark),
e AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
v AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS part FROM tf JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM v JOIN q USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 50
"""
