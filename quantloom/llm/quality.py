"""Quality classifier: a linear-chain conditional random field over lines (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE, documents, mixed, slices, word_hashes, words

_UPPER, _LOWER, _DIGIT, _HIGH, _SPACE, _STOP, _OTHER = range(7)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A], _KIND[0x80:] = _UPPER, _LOWER, _DIGIT, _HIGH
_KIND[SPACE] = _SPACE
_KIND[[0x2C, 0x2E]] = _STOP

#: What is known of a line by itself.
FEATURES = ("log words", "upper", "digits", "high", "blanks", "stops", "other", "word length", "distinct words", "ends in stop", "starts upper", "seen before", "log bytes")


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte lengths of all lines that have a word, and the number of lines of each text."""
    starts, ends, before = words(data, offsets)
    breaks = data == 0x0A
    breaks_before = np.concatenate([[0], np.cumsum(breaks)])
    text_of_word = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    row = breaks_before[starts] + text_of_word  # grows at each line and at each text
    first = np.ones(len(starts), bool)
    first[1:] = row[1:] != row[:-1]
    head = np.flatnonzero(first)
    n = len(head)
    if not n:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    line = np.cumsum(first) - 1
    count = np.bincount(line, minlength=n)
    begin, end = starts[head], ends[np.append(head[1:], len(starts)) - 1]
    size = end - begin
    kinds = _KIND[data]
    share = []
    for kind in range(7):
        running = np.concatenate([[0], np.cumsum(kinds == kind)])
        share.append((running[end] - running[begin]) / size)
    hashes = word_hashes(data, starts, ends)
    key = mixed(hashes + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(line[np.unique(key, return_index=True)[1]], minlength=n) / count
    text = text_of_word[head]
    whole = word_hashes(data, begin, end, 5)
    again = np.ones(n, bool)
    again[np.unique(mixed(whole + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]] = False
    columns = [np.log1p(count), *(share[k] for k in (_UPPER, _DIGIT, _HIGH, _SPACE, _STOP, _OTHER)), (size - count + 1) / count / 10, distinct, data[end - 1] == 0x2E, kinds[begin] == _UPPER, again, np.log1p(size)]
    return np.stack(columns, 1).astype(np.float32), size, np.bincount(text, minlength=len(offsets) - 1)


def _with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after, and flags for the first and last line."""
    n = len(x)
    edge = np.cumsum(counts)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[(edge - counts)[counts > 0]] = True
    last[edge[counts > 0] - 1] = True
    up, down = np.zeros_like(x), np.zeros_like(x)
    up[1:], down[:-1] = x[:-1], x[1:]
    up[first], down[last] = 0, 0
    return np.concatenate([x, up, down, first[:, None], last[:, None], np.ones((n, 1))], 1)


def _marginals(unary: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, expected moves between the two states, and the sum of log partition values.

    Forward and backward passes go over all chains side by side; unary is the score of good against bad.
    """
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    begin = (np.cumsum(counts) - counts)[order]
    steps = int(sizes.max(initial=0))
    active = np.searchsorted(-sizes, -np.arange(steps), "left")
    forward, backward = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    for step, n in enumerate(active):
        at = begin[:n] + step
        if step:
            prior = forward[at - 1]
            forward[at] = np.logaddexp(prior[:, :1] + moves[0], prior[:, 1:] + moves[1])
        forward[at, 1] += unary[at]
    for step in range(steps - 2, -1, -1):
        at = begin[: active[step + 1]] + step
        later = backward[at + 1]
        later = later + np.stack([np.zeros(len(at)), unary[at + 1]], 1)
        backward[at] = np.logaddexp(moves[:, 0] + later[:, :1], moves[:, 1] + later[:, 1:])
    total = forward + backward
    z = np.logaddexp(total[:, 0], total[:, 1])
    good = np.exp(total[:, 1] - z)
    inner = np.ones(len(unary), bool)
    inner[np.cumsum(counts)[counts > 0] - 1] = False
    at = np.flatnonzero(inner)
    pair = forward[at][:, :, None] + moves[None] + (backward[at + 1] + np.stack([np.zeros(len(at)), unary[at + 1]], 1))[:, None, :]
    expected = np.exp(pair - z[at][:, None, None]).sum(0) if len(at) else np.zeros((2, 2))
    return good, expected, float(z[(np.cumsum(counts) - counts)[counts > 0]].sum())


def _document_quality(good: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of the lines' P(good), weighted by length; 0 for texts without lines."""
    text = np.repeat(np.arange(len(counts)), counts)
    weight = np.bincount(text, size, len(counts))
    return np.bincount(text, good * size, len(counts)) / np.maximum(weight, 1)


@dataclass(frozen=True)
class LineField:
    """A fitted field: feature scaling, weights, moves between states, and the calibration of the mean."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float
    shift: float

    def lines(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        unary = _with_neighbours((x - self.mean) / self.scale, counts) @ self.weights
        return _marginals(unary, self.moves, counts)[0]

    def documents(self, x: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        quality = _document_quality(self.lines(x, counts), size, counts)
        return 1 / (1 + np.exp(-(self.slope * _logit(quality) + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_field(x: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 200, decay: float = 2.0) -> LineField:
    """Fit by the likelihood of the lines' labels, which are their document's, with Adam steps; then fit a
    logistic curve from document quality to label."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    f = _with_neighbours((x - mean) / scale, counts)
    y = np.repeat(labels, counts).astype(float)
    inner = np.repeat(labels, np.maximum(counts - 1, 0))
    seen = np.array([[(inner == 0).sum(), 0], [0, (inner == 1).sum()]], float)
    theta = np.zeros(f.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        good, expected, _ = _marginals(f @ w, moves, counts)
        slope = np.concatenate([f.T @ (y - good), (seen - expected).ravel()]) - decay * theta
        slope /= max(1, len(y))
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, moves = theta[:-4], theta[-4:].reshape(2, 2)
    q = _logit(_document_quality(_marginals(f @ w, moves, counts)[0], size, counts))
    a = np.array([1.0, 0.0])
    design = np.stack([q, np.ones_like(q)], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-design @ a))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1e-2, 1e-2])
        a = a + np.linalg.solve(hessian, design.T @ (labels - p) - 1e-2 * (a - [1, 0]))
    return LineField(mean, scale, w, moves, float(a[0]), float(a[1]))


def _lines_of(docs: DataFrame, text_col: str, most_lines: int) -> DataFrame:
    """(h, label, lines, sizes, features): the lines of each row, as bytes, for fitting. Of a text with more than
    `most_lines`, so many in a row, from a place that h chooses."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch, "text"):
                x, size, counts = line_features(data, offsets)
                part = batch.slice(first, last - first)
                begin = np.cumsum(counts) - counts
                begin = begin + np.asarray(part.column(1)) % np.maximum(1, counts - most_lines + 1)
                counts = np.minimum(counts, most_lines)
                xs = [x[a:b].tobytes() for a, b in zip(begin, begin + counts, strict=True)]
                ss = [size[a:b].tobytes() for a, b in zip(begin, begin + counts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(counts, pa.int64()), pa.array(ss, pa.binary()), pa.array(xs, pa.binary())], names=["h", "label", "lines", "sizes", "features"])

    return docs.select(F.col(text_col).alias("text"), "h", "label").mapInArrow(lines, "h bigint, label int, lines bigint, sizes binary, features binary")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_docs: int = 3000, most_lines: int = 200) -> LineField | None:
    """Fit on at most `most_docs` labelled rows with a line: those with the smallest hashes of their ids. Of a row with
    more than `most_lines` lines, so many that follow one another are taken.

    Executors make the features of whole texts; the driver gets this bounded sample. None if nothing is labelled.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("id"))
    picked = F.broadcast(known.orderBy("h", "id").limit(2 * most_docs))  # some will have no text
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = _lines_of(texts.join(picked, "id").select("t", "h", "label"), "t", most_lines).where("lines > 0")
    rows = found.orderBy("h", "sizes", "features").limit(most_docs).collect()
    if not rows:
        return None
    counts = np.array([r.lines for r in rows])
    x = np.frombuffer(b"".join(r.features for r in rows), np.float32).reshape(-1, len(FEATURES)).astype(np.float64)
    return fit_field(x, np.frombuffer(b"".join(r.sizes for r in rows), np.int64), counts, np.array([r.label for r in rows]))


def score_quality(docs: DataFrame, field: LineField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, lines, good_lines) for every row: P(label 1), number of lines, expected number of good ones.

    Every line with a word is scored; line marginals come from forward and backward passes over the whole text,
    and their mean, weighted by length, goes through the calibration. Texts without a word (null, empty, blank)
    count as quality 0 before calibration, so they get the lowest score. Without a fitted field all get 0.5.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch, batch.schema.names[1]):
                x, size, counts = line_features(data, offsets)
                good = field.lines(x, counts) if field else np.full(len(x), 0.5)
                result = field.documents(x, size, counts) if field else np.full(last - first, 0.5)
                expected = np.bincount(np.repeat(np.arange(last - first), counts), good, last - first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(result), pa.array(counts), pa.array(expected.astype(float))], names=[id_col, "score", "lines", "good_lines"])

    return docs.select(id_col, text_col).mapInArrow(score, f"`{id_col}` {kind}, score double, lines bigint, good_lines double")


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted): learn from labels whose crc32(id as text) mod 5 is not 0, score all.

    A null id is not held out, and has no label. Rows that repeat an id are scored each by their own text; of several labels of an id the largest counts;
    an empty table gives no rows; other columns are left alone. See fit_quality and score_quality.
    """
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    field = fit_quality(docs, labels.where(~held_out), id_col, text_col, label_col)
    scored = score_quality(docs, field, id_col, text_col)
    return scored.select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
