"""Toxicity classifier regularised by counterfactual sentences (operator 11)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import LOWER, ByteSpans, documents, slices, words

# Names of groups of people by which a sentence may be about one or another. Within a row, each can
# stand for each.
IDENTITY_TERMS = (
    "women men", "woman man", "girls boys", "female male transgender", "gay lesbian bisexual straight queer", "homosexual heterosexual",
    "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists",
    "black white asian latino", "african american european mexican chinese indian arab", "immigrants refugees natives", "disabled deaf blind", "old young",
    "frauen männer", "frau mann", "muslimisch christlich jüdisch", "muslime christen juden", "schwarze weiße", "schwule lesben",
    "femmes hommes", "femme homme", "musulmans chrétiens juifs", "musulman chrétien juif", "noirs blancs", "homosexuels hétérosexuels",
    "mujeres hombres", "mujer hombre", "musulmanes cristianos judíos", "musulmán cristiano judío", "negros blancos", "homosexuales heterosexuales",
)

#: Bytes that part words: all but ASCII letters and what is not ASCII.
APART = np.ones(256, bool)
APART[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: A word's features are its first bytes, for these numbers of bytes, and the whole word.
PREFIXES = (3, 4, 5, 6, 7, 8)

_SENTENCE = re.compile(rb"[.!?\n]+")
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin letters of two bytes that start with 0xC3."""
    out = LOWER[data]
    if len(out):
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def _hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) for every word, by kind of feature; a feature is a 64-bit hash."""
    data = _folded(data)
    starts, ends, before = words(data, offsets, APART)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    spans = ByteSpans(data)
    for size in PREFIXES:
        long = np.flatnonzero(ends - starts >= size)
        yield text[long], spans.finished(spans.sums(starts[long], starts[long] + size), size)
    yield text, spans.finished(spans.sums(starts, ends), ends - starts + (1 << 32))


class Kept:
    """The features of a model: a lookup of their hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.hashes >> np.uint64(46)] = True

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, number of the feature), by text."""
        found = []
        for text, feature in _hashes(data, offsets):
            some = np.flatnonzero(self.maybe[feature >> np.uint64(46)])
            at = np.searchsorted(self.hashes, feature[some])
            hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == feature[some]
            found.append(text[some[hit]] * len(self.hashes) + at[hit])
        return np.divmod(np.unique(np.concatenate(found)), len(self.hashes))


@dataclass(frozen=True)
class ToxicityModel:
    """A logistic model over the presence of features."""

    kept: Kept
    weights: np.ndarray
    shift: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, number = self.kept(data, offsets)
        return 1 / (1 + np.exp(-(np.bincount(text, self.weights[number], len(offsets) - 1) + self.shift)))


def swapped_sentences(text: bytes, groups: tuple[str, ...], swaps: int) -> Iterator[tuple[bytes, bytes]]:
    """(sentence, the same with its identity terms swapped), up to `swaps` for each sentence that has such a term:
    the n-th has the terms that stand n places further in their rows."""
    place = {term.encode(): (row.split(), i) for row in groups for i, term in enumerate(row.split())}
    for sentence in _SENTENCE.split(_folded(np.frombuffer(text, np.uint8)).tobytes()):
        met = [place[w] for w in _LETTERS.findall(sentence) if w in place]
        for step in range(1, min(swaps, max((len(row) - 1 for row, _ in met), default=0)) + 1):

            def other(m: re.Match, step: int = step) -> bytes:
                row, i = place.get(m[0], ((), 0))
                return row[(i + step) % len(row)].encode() if row else m[0]

            if (changed := _LETTERS.sub(other, sentence)) != sentence:
                yield sentence, changed


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], features: int, penalty: float = 1.0, decay: float = 0.3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and shift of least log loss (both labels weigh the same), plus decay / 2 times the squared weights
    over the number of rows, plus penalty times the mean squared change of the score between the two sentences of
    a pair; by Adam steps."""
    row, number = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    both = [np.concatenate([a, b]) for a, b in pairs]
    pair, moved = np.repeat(np.arange(len(pairs)), [len(x) for x in both]), np.concatenate([*both, np.zeros(0, np.int64)]).astype(np.int64)
    sign = np.concatenate([np.zeros(0), *(np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b in pairs)])
    share = np.where(labels > 0, 0.5 / max(1, (labels > 0).sum()), 0.5 / max(1, (labels == 0).sum()))
    theta = np.zeros(features + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w = theta[:-1]
        miss = (1 / (1 + np.exp(-(np.bincount(row, w[number], len(rows)) + theta[-1]))) - labels) * share
        slope = np.append(np.bincount(number, miss[row], features) + decay * w / len(rows), miss.sum())
        if pairs:
            change = np.bincount(pair, sign * w[moved], len(pairs))
            slope[:-1] += 2 * penalty / len(pairs) * np.bincount(moved, sign * change[pair], features)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        theta = theta - 0.1 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def _feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): how many texts of either label have each feature."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for first, last, data, offsets in slices(batch, "text"):
                pairs = np.concatenate([np.stack([text.astype(np.uint64), feature]) for text, feature in _hashes(data, offsets)], 1)
                order = np.lexsort(pairs)
                text, feature = pairs[:, order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
                own, label_of = feature[new], label[first:last][text[new].astype(np.int64)]
                distinct, which = np.unique(own, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *(pa.array(np.bincount(which, label_of == x, len(distinct)).astype(np.int64)) for x in (1, 0))], names=["feature", "toxic", "clean"])

    counted = sample.select("text", "label").mapInArrow(features, "feature bigint, toxic bigint, clean bigint")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _encoded(sample: DataFrame, kept: Kept, groups: tuple[str, ...], swaps: int) -> DataFrame:
    """(h, label, nth, one, two): a row (nth 0) with each text's features, and one for each pair of sentences with
    those that only the first, and only the second has. Numbers are 32-bit, as bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, last, data, offsets in slices(batch, "text"):
                text, number = kept(data, offsets)
                at = np.searchsorted(text, np.arange(last - first + 1))
                for i in range(last - first):
                    h, label = batch.column(2)[first + i].as_py(), batch.column(1)[first + i].as_py()
                    out.append((h, label, 0, number[at[i] : at[i + 1]].astype("<i4").tobytes(), b""))
                    for nth, pair in enumerate(swapped_sentences(data[offsets[i] : offsets[i + 1]].tobytes(), groups, swaps)):
                        own, number_of = kept(np.frombuffer(b" ".join(pair), np.uint8), np.array([0, len(pair[0]), sum(map(len, pair)) + 1]))
                        a, b = number_of[own == 0], number_of[own == 1]
                        out.append((h, label, nth + 1, np.setdiff1d(a, b).astype("<i4").tobytes(), np.setdiff1d(b, a).astype("<i4").tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["h", "label", "nth", "one", "two"])

    return sample.select("text", "label", "h").mapInArrow(encode, "h bigint, label int, nth int, one binary, two binary")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int = 4000, most_features: int = 4096, most_pairs: int = 20_000, groups: tuple[str, ...] = IDENTITY_TERMS, swaps: int = 3, penalty: float = 1.0) -> ToxicityModel | None:
    """Fit on at most `per_label` labelled rows of either label, those with the smallest hashes of their ids, whole
    texts of any length; None if not both labels are there.

    Executors count in how many texts of either label each feature is. Of those that are in two toxic texts or more,
    and in a larger share of these than of the clean ones, the `most_features` with the largest chi-square go on,
    besides those of the identity terms. The driver gets the numbers of these features for the
    bounded sample, and for at most `most_pairs` pairs of sentences that differ in identity terms.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("id"))
    picked = known.where("label = 1").orderBy("h", "id").limit(per_label).unionByName(known.where("label = 0").orderBy("h", "id").limit(per_label))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(picked), "id").select("text", "label", "h")  # 2 * per_label short rows
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    p, n = F.col("toxic") / sizes[1], F.col("clean") / sizes[0]
    counts = _feature_counts(sample).where((F.col("toxic") > 1) & (p > n))
    found = counts.withColumn("gain", (p - n) * (p - n) / ((F.col("toxic") + F.col("clean") + 1) / (sizes[0] + sizes[1])))
    best = [r.feature for r in found.orderBy(F.desc("gain"), "feature").limit(most_features).collect()]
    named = " ".join(groups).encode()
    identity = [feature for _, feature in _hashes(np.frombuffer(named, np.uint8), np.array([0, len(named)]))]
    kept = Kept(np.concatenate([np.array(best, np.int64).view(np.uint64), *identity]))
    encoded = _encoded(sample, kept, groups, swaps)
    number = lambda raw: np.frombuffer(raw, "<i4").astype(np.int64)
    rows = encoded.where("nth = 0").orderBy("h", "one").limit(2 * per_label).collect()
    pairs = encoded.where((F.col("nth") > 0) & (F.length("one") + F.length("two") > 0)).orderBy(F.xxhash64("h", "nth"), "one", "two").limit(most_pairs).collect()
    weights, shift = fit_weights([number(r.one) for r in rows], np.array([r.label for r in rows]), [(number(r.one), number(r.two)) for r in pairs], len(kept.hashes), penalty)
    return ToxicityModel(kept, weights, shift)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, from the whole text; without a model all get 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch, batch.schema.names[1]):
                result = model.scores(data, offsets) if model else np.zeros(last - first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(result)], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(score, f"`{id_col}` {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, penalty: float = 1.0) -> DataFrame:
    """(id, held_out, score, predicted): learn from labels whose crc32(id as text) mod 5 is not 0, score all.

    The model is logistic over the presence of words and of their first bytes (words are runs of letters in lower
    case). Labelled sentences that name a group of people are written anew with other groups of the same row of
    IDENTITY_TERMS, and the fit is penalised by how much the score changes thereby: a group that labelled toxic
    texts often name is no sign of toxicity, while the words said about it are. score is P(label 1) if both labels
    were equally frequent.

    Edge cases: null and empty texts have no feature and get the score of the shift alone; a null id is not held
    out, and has no label; rows that repeat an id are scored each by their own text, and of several labels of an id
    the largest counts; where not both labels are there to learn from, all scores are 0; an empty table gives no
    rows; other columns are left alone. Scoring shuffles nothing.
    """
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit_toxicity(docs, labels.where(~held_out), id_col, text_col, label_col, penalty=penalty)
    scored = score_toxicity(docs, model, id_col, text_col)
    return scored.select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
