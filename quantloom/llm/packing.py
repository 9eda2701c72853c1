"""Best-fit packing by minimum bin slack (operator 10)."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import documents, slices, stored


#: A run of white space of this length or more, which the rank encoder's pattern matching cannot hold.
_LONG_BLANK = re.compile(r"\s{2000}")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str, added: tuple[tuple[str, int], ...]):
    """The public byte-level BPE vocabulary. Its rank file and the added tokens of the JSON file give the same
    ids as that file with the tokenizers library (the tests compare them), in a third of the time."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path of a public vocabulary and its word pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def json_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of the same vocabulary as the tokenizers library reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that a vocabulary finds in a text before any merge, with their ids."""
    with open(path, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def bin_slack_plan(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many bins are filled so), from the number of pieces of each length.

    Minimum bin slack: the longest piece left opens a bin; a subset-sum over the lengths that are left, whose
    set of reachable sums is one integer used as bitset, finds the fullest way to use the room; what was used
    is removed. A combination is used again as long as its pieces last, so that the work depends on the
    number of lengths (at most `size`), not of pieces.
    """
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    plan: list[tuple[list[int], int]] = []
    while left:
        first = next(iter(left))
        room = size - first
        if room >= min(left):
            mask, sums, steps = (1 << (room + 1)) - 1, 1, []
            for n, c in left.items():
                c -= n == first
                part = 1
                while c > 0 and n * part <= room:
                    take = min(part, c)
                    more = (sums | (sums << (n * take))) & mask
                    if more != sums:
                        steps.append((n, take, sums))
                        sums = more
                    c -= take
                    part *= 2
                if sums >> room & 1:
                    break
            at, used = sums.bit_length() - 1, [first]
            for n, take, before in reversed(steps):
                if not before >> at & 1:
                    used += [n] * take
                    at -= n * take
        else:
            used = [first]
        need = {n: used.count(n) for n in used}
        times = min(left[n] // c for n, c in need.items())
        plan.append((sorted(used, reverse=True), times))
        for n, c in need.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return plan


def token_pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, path: str | None = None, pattern: str | None = None, json_path: str | None = None) -> DataFrame:
    """The pieces of every document: (id, piece, start, length, ids_crc32[, ids], part, rank).

    A document's ids are those of its text by the JSON vocabulary, and `end_id`. The rank file gives the same in
    less time; texts with very long runs of white space go to the tokenizers library itself. A longer one is cut into pieces of `size`, of which
    the first may be shorter. part is the task that read the row, rank counts the task's pieces of that length.
    """
    here, json_path = vocabulary(), json_path or json_vocabulary()
    path, pattern, special = path or here[0], pattern or here[1], tuple(added_tokens(json_path).items())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern, special)
        part, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, last, _, _ in slices(batch, batch.schema.names[1], 1 << 21):
                rows: list[tuple] = []
                for at in range(first, last):
                    text = texts[at].as_py() or ""
                    if _LONG_BLANK.search(text):
                        tokens = _tokenizer(json_path).encode(text, add_special_tokens=False).ids
                    elif any(token in text for token, _ in special):
                        tokens = encoding.encode(text, allowed_special="all")
                    else:
                        tokens = encoding.encode_ordinary(text)
                    tokens.append(end_id)
                    data = memoryview(np.asarray(tokens, "<u4").tobytes())
                    n, start, piece = len(tokens), 0, 0
                    while start < n:
                        length = (n - start) % size or size
                        own = data[4 * start : 4 * (start + length)]
                        rows.append((at, piece, start, length, zlib.crc32(own), part, seen[length], *([bytes(own)] * keep_ids)))
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                at, *rest = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=False))], names=[id_col, "piece", "start", "length", "ids_crc32", "part", "rank", "ids"][: 7 + keep_ids])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, path: str | None = None, pattern: str | None = None, json_path: str | None = None) -> DataFrame:
    """Pack the tokens of all documents into as few sequences of at most `size` as minimum bin slack finds.

    One row per piece: (id, piece, start, length, ids_crc32[, ids], sequence_id, offset); the pieces of a
    sequence lie without gaps from offset 0. `path` and `pattern` name the vocabulary as a rank file,
    `json_path` as the JSON file that also holds its added tokens.

    Only the number of pieces of each length (at most `size` numbers) reaches the driver; it returns a plan
    of bins in which each combination of lengths stands once with the number of its bins. Pieces of equal
    length are interchangeable: each takes the place in the plan of its number among them, which is its
    number within its task plus the count of that length in earlier tasks. So no length, however common,
    meets in one task. The pieces are stored first: they are counted and placed from the same table.

    Edge cases: a null or empty text has the one id `end_id`; rows that repeat a document are packed each;
    an empty table gives no rows; other columns are left alone. An added token in a text is that token.
    """
    pieces = stored(token_pieces(docs, size, end_id, id_col, text_col, keep_ids, path, pattern, json_path))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows

    slots, sequence, used = [], 0, dict.fromkeys(totals, 0)
    for lengths, times in bin_slack_plan(totals, size):
        offset = 0
        for n in sorted(set(lengths), reverse=True):
            each = lengths.count(n)
            slots.append((n, used[n], used[n] + each * times, each, sequence, offset))
            used[n] += each * times
            offset += each * n
        sequence += times
    plan = docs.sparkSession.createDataFrame(slots, "length bigint, lo bigint, hi bigint, each bigint, seq bigint, off bigint")
    nth = F.col("rank") + F.col("shift")
    placed = pieces.join(shifts, ["part", "length"]).withColumn("nth", nth)
    # The plan has a row for each length of each combination; a combination uses up at least one length.
    placed = placed.join(F.broadcast(plan), "length").where((F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi")))
    place = F.col("nth") - F.col("lo")
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids,
        (F.col("seq") + F.floor(place / F.col("each"))).alias("sequence_id"),
        (F.col("off") + place % F.col("each") * F.col("length")).alias("offset"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), keep_ids=False)
