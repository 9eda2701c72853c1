"""What the training-data operators share: shared scratch tables and views of Arrow text as bytes."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: A key with more than this share of a table's rows is dealt over SALTS tasks: at most 1 / HOT_SHARE keys are.
HOT_SHARE, SALTS = 0.001, 64

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, a session on one machine gets a new local
    folder; on a cluster that is an error, as executors share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quantloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write df to a new table in the shared folder and read it back.

    This cuts the lineage, and an executor that is lost later takes nothing with it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def freed(table: DataFrame) -> DataFrame:
    """The stored table, after Spark was asked to delete the shuffle files of the steps that led to it: it does
    so when the driver's JVM finds that nothing refers to them, which else may take until the end of the job."""
    for _ in range(2):  # the listeners of the last step let go of it a little later
        gc.collect()
        table.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)
    return table


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], by: Column, how: str) -> DataFrame:
    """big joined with the stored table small on keys, of which none has many rows of big in one task.

    small's column seen says how many rows of big have the key. Keys with a larger share than HOT_SHARE, fewer
    than 1 / HOT_SHARE of them, are broadcast; their rows in big get a salt from `by`, and those in small
    stand once for each salt.
    """
    limit = (small.agg(F.sum("seen")).first()[0] or 0) * HOT_SHARE
    hot = F.broadcast(small.where(F.col("seen") > limit).select(*keys, F.lit(True).alias("hot")))
    spread = F.when(F.col("seen") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    left = big.join(hot, keys, "left").withColumn("salt", salt).drop("hot")
    return left.join(small.withColumn("salt", F.explode(spread)).drop("seen"), [*keys, "salt"], how).drop("salt")


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about `most` bytes each.

    offsets count from the start of the run's bytes and have one entry more than the run has rows.
    A null text has no bytes. A text longer than `most` makes a run of its own.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, index, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    index = np.frombuffer(index, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(index, index[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last, data[index[first] : index[last]], index[first : last + 1] - index[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of words before it; `apart` marks the bytes
    between words.

    No word reaches over the end of a text.
    """
    solid = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = True
        before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = True
        after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
        if len(have) > 1 << 23:
            del _powers[base]
    return have[: n + 1]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose results look random."""
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for many spans at once.

    The polynomial sum(values[i] * m ** (i - start)) comes from running sums, so that a span costs the
    same whatever its length; the result is mixed with the span's length.
    """
    up = powers(len(values), _MULTIPLIER)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed(values.astype(np.uint64) + np.uint64(1), 0x51ED2700 + seed) * up[:-1], dtype=np.uint64, out=total[1:])
    down = powers(len(values), _INVERSE)
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F), seed)


class ByteSpans:
    """Hashes of data[start:end] for many spans, from running sums over data that are made once."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        table = mixed(np.arange(1, 257, dtype=np.uint64), 0x51ED2700 + seed)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * powers(len(data), _MULTIPLIER)[:-1], dtype=np.uint64, out=self.total[1:])
        self.down, self.seed = powers(len(data), _INVERSE), seed

    def sums(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The polynomials of the spans, before they are mixed with their lengths."""
        return (self.total[ends] - self.total[starts]) * self.down[starts]

    def finished(self, sums: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return mixed(sums + np.asarray(lengths).astype(np.uint64) * np.uint64(0xA0761D6478BD642F), self.seed)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.finished(self.sums(starts, ends), ends - starts)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """As spans_hash, with a table in place of mixing each byte."""
    return ByteSpans(data, seed).hashes(starts, ends)
