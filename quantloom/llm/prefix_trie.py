"""Prefix trie of conversations by collapsing whole sequences (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import salted_join, stored

WORD = r"[^\x20\x09-\x0D]+"

#: The key of the sequence without a turn.
ROOT = hashlib.blake2b(b"root", digest_size=16).digest()

#: Ids of a sequence's members are joined to strings by ranges of so many ids.
_RANGE = 4096


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(c, pos, digest, words): each conversation's turns, numbered from 1.

    Turns are in the order of turn (null first); equal ones by role, then by the digest of role and text, so that
    texts stay out of the shuffle.
    """
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("c"), "turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.withColumn("pos", F.row_number().over(order).cast("bigint")).select("c", "pos", "digest", "words")


def rebuilt_turns(numbered: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """(c, idx, size, digest, words): the turns of each conversation once it is rebuilt, with a row 0 before them.

    Conversation c gets the first h turns of conversation c - c % block, and its own after its first h; h is the
    crc32 of c in decimal, modulo `heads`. For a negative c, the remainder is negative or 0. size is the number of turns that it then has.
    """
    lengths = numbered.groupBy("c").agg(F.max("pos").alias("n"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    each = lengths.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % block).alias("base"))
    each = each.join(lengths.select(F.col("c").alias("base"), F.col("n").alias("base_n")), "base", "left")
    each = each.withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("size", F.col("lent") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    first = numbered.where((F.col("c") % block == 0) & (F.col("pos") < heads)).withColumnRenamed("c", "base")
    lent = each.select("c", "base", "h", "size").join(first, "base").where("pos <= h").select("c", F.col("pos").alias("idx"), "size", "digest", "words")
    own = numbered.join(each.select("c", "h", "lent", "size"), "c").where("pos > h").select("c", (F.col("lent") + F.col("pos") - F.col("h")).alias("idx"), "size", "digest", "words")
    top = each.select("c", F.lit(0).cast("bigint").alias("idx"), "size", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("words"))
    return top.unionByName(lent).unionByName(own)


def prefix_keys(rebuilt: DataFrame) -> DataFrame:
    """(c, idx, size, key, parent, words): key stands for the conversation's first idx turns.

    Keys are chained 128-bit digests, made while the sorted rows stream through; a worker holds one key.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ROOT
        for batch in batches:
            keys, parents = [], []
            for idx, digest in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                parents.append(key if idx else None)
                key = hashlib.blake2b(key + digest, digest_size=16).digest() if idx else ROOT
                keys.append(key)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), batch.column(4)], names=["c", "idx", "size", "key", "parent", "words"])

    rows = rebuilt.repartition("c").sortWithinPartitions("c", "idx")
    return rows.mapInArrow(chain, "c bigint, idx bigint, size bigint, key binary, parent binary, words bigint")


def end_lists(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of members (key, c): the SHA-256 of each key's ids in ascending order, joined by commas.

    Ids are sorted and joined by ranges of ids side by side; the ranges' strings then stream through the digest,
    so that no task holds a whole list.
    """
    parts = ends.groupBy("key", F.floor(F.col("c") / _RANGE).alias("range")).agg(F.array_sort(F.collect_list("c")).alias("ids"))
    parts = parts.select("key", "range", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key == now:
                    running.update(b"," + text.encode())
                    continue
                if now is not None:
                    keys.append(now)
                    found.append(running.hexdigest())
                now, running = key, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return parts.repartition("key").sortWithinPartitions("key", "range").mapInArrow(digests, "key binary, ends_sha256 string")


def conversation_trie(conversations: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row for each
    distinct beginning of the rebuilt conversations (see rebuilt_turns), the textless root included.

    1. Identical rebuilt conversations collapse into one sequence with a weight (how many), its smallest id and
       the list of ids that end there. Only one conversation of each sequence goes on.
    2. A sequence that is a proper prefix of another is found among the others' beginnings; an anti-join drops
       it, and what is left are the leaves.
    3. Beginnings of the sequences are aggregated with their weights: members, smallest id, leaves below.
    4. saved_tokens, the sum over a subtree of (n_convs - 1) times the words of a node's last text: each node's
       value lies on the path of its smallest id alone; sums from the end of each path up to each of its nodes,
       added up by node, are the subtree's.

    A beginning that many conversations share is summed up before the shuffle, and joins with a parent of many
    children are salted. The digest of a long list of ends reads that list in one task, as text of joined ranges.

    Edge cases: a null role or text counts as empty; a null turn comes first; equal turns are in the order of
    role, then of the digest of role and text (repeated rows are turns of their own); rows with a null conv_id
    belong to no conversation; an empty table has no node; other columns are left alone. Sequences are compared
    by chained 128-bit digests.
    """
    rows = stored(prefix_keys(rebuilt_turns(stored(numbered_turns(conversations)), block, heads)))
    ends = rows.where("idx = size").select("key", "c")
    sequences = stored(ends.groupBy("key").agg(F.count("*").alias("weight"), F.min("c").alias("conv")))
    paths = stored(rows.join(sequences.select(F.col("conv").alias("c"), "weight"), "c"))
    leaves = sequences.join(paths.where("idx < size").select("key").distinct(), "key", "left_anti").select(F.col("conv").alias("c"), F.lit(1).cast("bigint").alias("leaf"))
    nodes = paths.join(leaves, "c", "left").groupBy("key").agg(
        F.min("c").alias("conv_id"), F.max("idx").alias("depth"), F.first("parent").alias("parent"), F.sum("weight").alias("n_convs"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.max("words").alias("words"),
    )
    nodes = stored(nodes)

    value = nodes.select(F.col("conv_id").alias("c"), F.col("depth").alias("idx"), ((F.col("n_convs") - 1) * F.col("words")).alias("value"))
    below = Window.partitionBy("c").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    saved = paths.join(value, ["c", "idx"], "left").select("key", F.sum(F.coalesce("value", F.lit(0))).over(below).alias("part")).groupBy("key").agg(F.sum("part").alias("saved_tokens"))

    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "key")
    tops = stored(nodes.select("key", "conv_id").join(children, "key"))
    out = salted_join(nodes, tops.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("seen")), ["parent"], F.col("key"), "left")
    out = out.join(tops.select("key", "n_children"), "key", "left").join(saved, "key").join(end_lists(ends), "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# CRC-32 of the decimal id: each byte is followed by its eight shifts.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""

OP13_SQL = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, sha256(strlen(role)::VARCHAR || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
             row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(strlen(role)::VARCHAR || ':' || role || text)) AS pos FROM t),
e AS (SELECT c, c - c % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM n)),
r AS (SELECT e.c, n.pos, n.digest, n.words FROM e JOIN n ON n.c = e.base AND n.pos <= e.h
      UNION ALL SELECT e.c, 1000000 + n.pos, n.digest, n.words FROM e JOIN n ON n.c = e.c AND n.pos > e.h),
s AS (SELECT e.c, coalesce(list(digest ORDER BY pos) FILTER (digest IS NOT NULL), []) AS seq, coalesce(list(words ORDER BY pos) FILTER (digest IS NOT NULL), []) AS counts
      FROM e LEFT JOIN r ON r.c = e.c GROUP BY e.c),
x AS (SELECT c, seq, counts, unnest(generate_series(0, len(seq))) AS depth FROM s),
y AS (SELECT seq[1:depth] AS key, seq[1:greatest(depth - 1, 0)] AS up, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, coalesce(any_value(counts[depth]), 0) AS words,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(seq) = depth), '')) AS ends_sha256
      FROM x GROUP BY 1, 2),
k AS (SELECT up AS key, count(*) AS n_children FROM y WHERE depth > 0 GROUP BY up),
z AS (SELECT y.*, coalesce(n_children, 0) AS n_children FROM y LEFT JOIN k USING (key)),
b AS (SELECT key[1:d] AS key, sum((n_convs - 1) * words) AS saved_tokens, sum((n_children = 0)::BIGINT) AS n_leaves
      FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM z) GROUP BY 1)
SELECT z.conv_id, z.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, z.n_convs, z.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, z.ends_sha256
FROM z JOIN b USING (key) LEFT JOIN z p ON p.key = z.up AND z.depth > 0
"""
