"""Substring dedup by De Bruijn compaction (operator 9)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import HOT_SHARE, SALTS, SPACE, documents, freed, salted_join, slices, spans_hash, stored, word_hashes, words

#: Two hashes of a text name it; equal texts share them.
KEY = ["t1", "t2"]

def _paths(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: (text, start word in the text, number of windows, anchor hash).

    A window's anchor is the run of `anchor` words in it with the smallest hash, the leftmost of equals. It
    depends on the window's words only, so equal windows have equal anchors, wherever they are.
    """
    starts, ends, before = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n = len(hashes)
    if n < window:
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(n - anchor + 1)
    short = spans_hash(hashes, at, at + anchor, 1)
    place = np.arange(n - window + 1) + sliding_window_view(short, window - anchor + 1).argmin(1)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))[: n - window + 1]
    inside = np.arange(n - window + 1) + window <= before[text + 1]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(first)
    number = np.cumsum(first) - 1
    size = np.bincount(number[inside], minlength=len(head)).astype(np.int64)
    return text[head], head - before[text[head]], size, short[place[head]].view(np.int64)


def window_paths(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(t1, t2, start, n, anchor): the windows of every text, in runs that share an anchor."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in slices(batch, "text"):
                text, start, size, value = _paths(data, offsets, window, anchor)
                of = pa.array(first + text)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(value)], names=[*KEY, "start", "n", "anchor"])

    return rows.select(*KEY, "text").mapInArrow(walk, "t1 bigint, t2 bigint, start int, n int, anchor bigint")


def _single_blanks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """The words with one blank after each, and their places there."""
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    solid = np.flatnonzero(~SPACE[data])
    out[solid + np.repeat(at - starts, sizes)] = data[solid]
    return out.tobytes(), at.tolist(), (at + sizes).tolist()


def _number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True) or 1


def read_paths(rows: DataFrame, window: int) -> DataFrame:
    """(t1, t2, weight, start, anchor, c, ws, before, after) of rows (t1, t2, weight, text, paths).

    Each path's text is read at its coordinates: ws has a digest of the words of each of its windows, c one of
    all its words; before and after are those of the windows next to it, 0 where the text begins or ends.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch, "text"):
                part = batch.slice(first, last - first)
                starts, ends, before = words(data, offsets)
                line, at, to = _single_blanks(data, starts, ends)
                paths = part.column(4)
                flat = paths.flatten()
                start, size, anchor = (np.asarray(flat.field(i)) for i in range(3))
                owner = np.repeat(np.arange(last - first), np.asarray(paths.value_lengths()))
                low, high = before[owner].tolist(), before[owner + 1].tolist()
                found, ws, ahead, behind = [], [], [], []
                for a, b, s, n in zip(low, high, start.tolist(), size.tolist(), strict=True):
                    i = a + s
                    found.append(_number(line[at[i] : to[i + n + window - 2]]))
                    ws.append([_number(line[at[j] : to[j + window - 1]]) for j in range(i, i + n)])
                    ahead.append(_number(line[at[i - 1] : to[i + window - 2]]) if s else 0)
                    behind.append(_number(line[at[i + n] : to[i + n + window - 1]]) if i + n + window <= b else 0)
                of = pa.array(owner)
                columns = [part.column(0).take(of), part.column(1).take(of), part.column(2).take(of), pa.array(start), pa.array(anchor), pa.array(found, pa.int64()), pa.array(ws, pa.list_(pa.int64())), pa.array(ahead, pa.int64()), pa.array(behind, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "weight", "start", "anchor", "c", "ws", "before", "after"])

    return rows.select(*KEY, "weight", "text", "paths").mapInArrow(read, "t1 bigint, t2 bigint, weight int, start int, anchor bigint, c bigint, ws array<bigint>, before bigint, after bigint")


def unbranched_runs(found: DataFrame) -> DataFrame:
    """(anchor, c, nth, n, head, prior, tail, later): the paths' stretches of repeated windows without branch.

    Equal paths count together first. Windows are the edges of the graph; one that occurs once is left out. An
    edge goes on from the edge before it if it has no other predecessor in any text, and that one no other
    successor; the start and the end of a text count as neighbours of their own. head and tail are the first and
    the last edge of a stretch; prior and later are their only neighbours, null where there are several.
    """
    paths = found.groupBy("anchor", "c", "ws").agg(F.sum("weight").alias("copies"), *(f(x).alias(f"{x}_{n}") for x in ("before", "after") for n, f in (("lo", F.min), ("hi", F.max))))
    w = paths.select("anchor", "c", "ws", "copies", *(f"{x}_{n}" for x in ("before", "after") for n in ("lo", "hi")), F.posexplode("ws").alias("nth", "w"))
    beside = lambda step, x: F.coalesce(F.get("ws", F.col("nth") + step), F.col(x))
    w = w.select("anchor", "c", "nth", "w", "copies", *(beside(s, f"{x}_{n}").alias(f"{x}_{n}") for s, x in ((-1, "before"), (1, "after")) for n in ("lo", "hi")))
    edge = Window.partitionBy("anchor", "w")
    only = lambda x: F.when(F.min(f"{x}_lo").over(edge) == F.max(f"{x}_hi").over(edge), F.nullif(F.col(f"{x}_lo"), F.lit(0)))
    w = w.select("anchor", "c", "nth", "w", only("before").alias("prior"), only("after").alias("later"), F.sum("copies").over(edge).alias("total")).where("total > 1")
    # A path has at most window - anchor + 1 windows.
    order = Window.partitionBy("anchor", "c").orderBy("nth")
    goes_on = (F.lag("nth").over(order) == F.col("nth") - 1) & (F.lag("w").over(order) == F.col("prior")) & (F.lag("later").over(order) == F.col("w"))
    w = w.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    run = w.groupBy("anchor", "c", "run").agg(F.min("nth").alias("nth"), F.count("*").alias("n"), *(f(F.struct("nth", "w", x)).alias(x) for x, f in (("prior", F.min), ("later", F.max))))
    return run.select("anchor", "c", "nth", "n", F.col("prior.w").alias("head"), F.col("prior.prior").alias("prior"), F.col("later.w").alias("tail"), F.col("later.later").alias("later"))


def compacted_paths(runs: DataFrame) -> DataFrame:
    """(head, tail, length) of each first stretch: windows in the whole nonbranching path that begins there.

    Stretches of different paths are linked where one's last edge and the other's first are each other's only
    neighbours. Pointers to the stretch before are doubled until they reach the beginning: about log2 of the
    longest path in rounds, each with a join in which every key occurs once on either side.
    """
    once = stored(runs.groupBy("head", "tail").agg(F.max("n").alias("n"), F.max("prior").alias("prior"), F.max("later").alias("later")))
    ups = once.where("later is not null").select(F.col("later").alias("head"), F.col("tail").alias("prior"), F.col("head").alias("up_head"), F.col("tail").alias("up_tail"), F.col("n").alias("far"))
    now = once.where("prior is not null").join(ups, ["head", "prior"]).select("head", "tail", "n", "up_head", "up_tail", "far")
    linked = now.select(F.col("head").alias("up_head"), F.col("tail").alias("up_tail"), F.lit(True).alias("more"))
    now = stored(now.join(linked, ["up_head", "up_tail"], "left").select("head", "tail", "n", "up_head", "up_tail", "far", F.col("more").isNull().alias("done")))
    done = now.where("done")
    while True:
        rest = now.where("not done")
        if rest.isEmpty():
            break
        above = now.select(F.col("head").alias("up_head"), F.col("tail").alias("up_tail"), F.col("up_head").alias("to_head"), F.col("up_tail").alias("to_tail"), F.col("far").alias("more"), F.col("done").alias("ends"))
        step = rest.join(above, ["up_head", "up_tail"]).select("head", "tail", "n", F.col("to_head").alias("up_head"), F.col("to_tail").alias("up_tail"), (F.col("far") + F.col("more")).alias("far"), F.col("ends").alias("done"))
        # Those that are done now stay in the table, as others' pointers may still meet them.
        now = stored(step.unionByName(now.where("done")))
        done = now.where("done")
    tails = done.groupBy(F.col("up_head").alias("head"), F.col("up_tail").alias("tail")).agg(F.max(F.col("far") + F.col("n")).alias("length"))
    firsts = once.join(done.select("head", "tail"), ["head", "tail"], "left_anti").select("head", "tail", "n")
    return firsts.join(tails, ["head", "tail"], "left").select("head", "tail", F.coalesce("length", "n").alias("length"))


def repeated_spans(rows: DataFrame, first: DataFrame, salted: DataFrame, window: int, anchor: int) -> DataFrame:
    """(t1, t2, weight, start, length): where nonbranching paths of repeated windows begin in the texts, and
    over how many windows they go. rows has (t1, t2, text); first (t1, t2, salt, weight, text) each text once,
    dealt by key and salt; salted (t1, t2, least) the few texts whose salt is not 0."""
    paths = window_paths(rows, window, anchor)
    seen = stored(paths.groupBy("anchor").agg(F.count("*").alias("seen")).where("seen > 1"))
    shared = salted_join(paths, seen, ["anchor"], F.struct(*KEY, "start"), "left_semi")
    listed = shared.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n", "anchor")).alias("paths"))
    listed = listed.join(salted, KEY, "left").select(*KEY, F.coalesce("least", F.lit(0)).alias("salt"), "paths")
    found = freed(stored(read_paths(first.join(listed, [*KEY, "salt"]), window)))

    runs = freed(stored(unbranched_runs(found)))
    begins = runs.join(compacted_paths(runs), ["head", "tail"])
    begins = begins.groupBy("anchor", "c").agg(F.collect_list(F.struct("nth", "length")).alias("begins"))
    counts = found.groupBy("anchor", "c").agg(F.count("*").alias("seen"))
    begins = stored(begins.join(counts, ["anchor", "c"]))
    met = salted_join(found.select(*KEY, "weight", "start", "anchor", "c"), begins, ["anchor", "c"], F.struct(*KEY, "start"), "inner")
    met = met.select(*KEY, "weight", "start", F.explode("begins").alias("b"))
    return met.select(*KEY, "weight", (F.col("start") + F.col("b.nth")).alias("start"), F.col("b.length").alias("length"))


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, again, marks) to (id, words, words removed, kept text)."""
    for batch in batches:
        for first, last, data, offsets in slices(batch, "text"):
            part = batch.slice(first, last - first)
            starts, ends, before = words(data, offsets)
            counts = np.diff(before)
            marked = part.column(3)
            flat = marked.flatten()
            owner = np.repeat(np.arange(last - first), np.asarray(marked.value_lengths().fill_null(0)))
            at = before[owner] + np.asarray(flat.field(0))
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + np.asarray(flat.field(1)) + window - 1, -1)
            whole = np.flatnonzero(np.asarray(part.column(2)) & (counts >= window))
            np.add.at(change, before[whole], 1)
            np.add.at(change, before[whole + 1], -1)
            gone = np.cumsum(change[:-1]) > 0
            text = np.repeat(np.arange(last - first), counts)
            removed = np.bincount(text[gone], minlength=last - first)
            stay = np.flatnonzero(~gone)
            # A kept word takes one byte after it along, as the blank, unless it is the text's last one.
            followed = np.zeros(len(stay), bool)
            followed[:-1] = text[stay[1:]] == text[stay[:-1]]
            change = np.zeros(len(data) + 1, np.int64)
            change[starts[stay]] += 1
            change[ends[stay]] -= 1
            keep = np.cumsum(change[:-1]) > 0
            blanks = ends[stay][followed]
            out = data.copy()
            out[blanks] = 0x20
            keep[blanks] = True
            sizes = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int32)
            kept = pa.StringArray.from_buffers(last - first, pa.py_buffer(sizes.tobytes()), pa.py_buffer(out[keep].tobytes()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(removed.astype(np.int64)), kept], names=names)


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, anchor: int = 16) -> DataFrame:
    """(id, n_words, n_removed, kept): each text without its words in windows that occur more than once.

    Words are runs without ASCII white space. A window is `window` consecutive words of one text; a word goes
    if a window over it has the same words as one that starts anywhere else, in this text or another. kept is
    the remaining words, joined by one blank. Windows are judged on the input.

    The windows are the edges of a De Bruijn graph of words. Consecutive windows that share their anchor (the
    run of `anchor` words with the smallest hash in them) are dealt with as one path, and paths whose anchor
    occurs once are left out. The others are read at their coordinates, and their windows compared by digests
    of their words. Of the windows that repeat, stretches without branch are compacted, within paths and then
    by joins from path to path (see unbranched_runs, compacted_paths); each occurrence of a stretch goes
    through all of it, so that its begin and its length mark the words to remove. Windows count as equal if
    64-bit digests of their words and 64-bit hashes of their anchors are. Equal texts go through once, and
    count twice; their copies go whole, if they have a window at all. Keys with many rows are salted.

    Edge cases: null, empty and blank texts have no words and keep nothing; texts shorter than a window stay
    whole; rows that are equal in text, or in id and text, repeat each other's windows; a null id is like any
    other; an empty table gives no rows; other columns are left alone.
    """
    if not 1 <= anchor <= window:
        raise ValueError("anchor is from 1 to window")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text"), "salt": F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(SALTS)).cast("int")})
    copies = stored(rows.groupBy(*KEY).agg(F.count("*").alias("copies"), F.min("salt").alias("least")).where("copies > 1"))
    limit = (copies.agg(F.sum("copies")).first()[0] or 0) * HOT_SHARE
    hot = F.broadcast(copies.where(F.col("copies") > limit).select(*KEY, "least"))  # fewer than 1 / HOT_SHARE texts
    dealt = rows.join(hot, KEY, "left").withColumn("salt", F.when(F.col("least").isNotNull(), F.col("salt")).otherwise(0))
    dealt = dealt.repartition(*KEY, "salt")
    same = Window.partitionBy(*KEY, "salt").orderBy("t1")
    dealt = dealt.withColumns({"nth": F.row_number().over(same), "beside": F.lead("t1").over(same)})
    dealt = dealt.withColumn("again", F.col("least").isNotNull() | (F.col("nth") > 1) | F.col("beside").isNotNull())
    first = dealt.where((F.col("nth") == 1) & (F.col("salt") == F.coalesce("least", F.lit(0))))
    first = first.select(*KEY, "salt", F.when(F.col("again"), 2).otherwise(1).alias("weight"), "text")

    spans = repeated_spans(rows, first, hot, window, anchor).where("weight = 1")
    marks = spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "length")).alias("marks")).withColumn("salt", F.lit(0))
    names = [id_col, "n_words", "n_removed", "kept"]
    met = dealt.join(marks, [*KEY, "salt"], "left").select("id", "text", "again", "marks")
    return met.mapInArrow(lambda batches: _cut(batches, names, window), f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept string")


def op9_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
