"""Language identification by cross-parsing entropy (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quantloom.llm.common import LOWER, documents, slices

#: The string for texts without a letter.
UNKNOWN = "und"
#: Symbols that are parsed side by side, and those of a long text that are dealt with at a time.
_SEGMENT, _BLOCK = 512, 1 << 20


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of letters in lower case, all else as one 0 for a run of it; and the texts' new offsets.

    Lower case covers A-Z and the Latin letters of two bytes that start with 0xC3.
    """
    out = LOWER[data]
    out = np.where((out >= 0x61) & (out <= 0x7A) | (out >= 0x80), out, 0).astype(np.uint8)
    if len(out):
        upper = np.zeros(len(out), bool)
        upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[upper] += 0x20
    keep = out != 0
    if len(out):
        keep[1:] |= out[:-1] != 0
        keep[0] = True
        starts = offsets[:-1][offsets[:-1] < len(out)]
        keep[starts] = True
    kept_before = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=kept_before[1:])
    return out[keep], kept_before[offsets]


def _suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that has read exactly the substrings of text at each of its
    states; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in go[at]:
            go[at][c] = new
            at = link[at]
        if at >= 0:
            other = go[at][c]
            if length[other] == length[at] + 1:
                link[new] = other
            else:
                split = len(go)
                go.append(dict(go[other]))
                length.append(length[at] + 1)
                link.append(link[other])
                while at >= 0 and go[at].get(c) == other:
                    go[at][c] = split
                    at = link[at]
                link[other] = link[new] = split
        last = new
    return go


@lru_cache(maxsize=2)
def _parser(texts: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One table of moves for the automata of all languages: (symbol of each byte, moves, start states,
    first moves). A move of -1 ends a phrase."""
    symbol = np.full(256, 0, np.int64)
    seen = sorted({b for text in texts for b in text})
    symbol[seen] = range(1, len(seen) + 1)
    moves, starts = [], []
    for text in texts:
        go = _suffix_automaton(symbol[np.frombuffer(text, np.uint8)])
        shift = sum(map(len, moves))
        table = np.full((len(go), len(seen) + 1), -1, np.int32)
        for state, out in enumerate(go):
            for c, to in out.items():
                table[state, c] = to + shift
        moves.append(table)
        starts.append(shift)
    table, start = np.concatenate(moves), np.array(starts)
    first = table[start]
    return symbol, table.ravel(), start, np.where(first < 0, start[:, None], first)


def _phrases(texts: tuple[bytes, ...], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases that each language needs for each text, as [language, text].

    From left to right, each phrase is the longest match with a language's text. Very long texts go block by
    block, each from the states that the one before ends with.
    """
    if len(offsets) != 2 or offsets[1] <= _BLOCK:
        return _ended(texts, data, offsets, None)[0] + (np.diff(offsets) > 0)
    total, state = 1, None
    for first in range(0, len(data), _BLOCK):
        part = data[first : first + _BLOCK]
        ended, state = _ended(texts, part, np.array([0, len(part)]), state)
        total = total + ended
    return total


def _ended(texts: tuple[bytes, ...], data: np.ndarray, offsets: np.ndarray, entry: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that end within each text, as [language, text], and the states at the end of the last text; the
    first one begins in the states `entry`, if given.

    Texts are parsed in segments side by side, each from the start of a phrase; then those are parsed again that
    the segment before leaves within a phrase, up to where both ways meet (from there on they agree), until
    nothing changes.
    """
    symbol, moves, start, first = _parser(texts)
    data = symbol[data]
    sizes = np.diff(offsets)
    pieces = -(-sizes // _SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = offsets[owner] + nth * _SEGMENT
    length = np.minimum(_SEGMENT, sizes[owner] - nth * _SEGMENT)
    order = np.argsort(-length, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at, length, ahead = at[order], length[order], nth[order] > 0
    symbols, lanes = first.shape[1], len(at)
    if not lanes:
        return np.zeros((len(texts), len(sizes)), np.int64), start
    steps = int(length.max())
    active = np.searchsorted(-length, -np.arange(steps), "left")
    # States and phrases that ended so far after each symbol, of the segments of texts that have several.
    traced = np.flatnonzero(pieces[owner[order]] > 1)
    slot = np.full(lanes, -1)
    slot[traced] = np.arange(len(traced))
    traced_active = np.searchsorted(-length[traced], -np.arange(steps), "left")
    state, count = np.zeros((steps, len(texts), len(traced)), np.int32), np.zeros((steps, len(texts), len(traced)), np.int16)
    now, ended = np.repeat(start[:, None], lanes, 1), np.zeros((len(texts), lanes), np.int64)
    if entry is not None:
        now[:, place[0]] = entry
    for step, (n, m) in enumerate(zip(active, traced_active, strict=True)):
        c = data[at[:n] + step]
        to = moves[now[:, :n] * symbols + c]
        end = to < 0
        now[:, :n] = np.where(end, first[:, c], to)
        ended[:, :n] += end
        state[step, :, :m], count[step, :, :m] = now[:, traced[:m]], ended[:, traced[:m]]
    leave, finished = now, ended
    # (language, lane) whose way in differs from the start of a phrase.
    before = place[np.maximum(np.arange(lanes) - 1, 0)][order]
    follow = np.flatnonzero(ahead)
    lang, lane = np.repeat(np.arange(len(texts)), len(follow)), np.tile(follow, len(texts))
    came = np.repeat(start[:, None], lanes, 1)
    while len(lane):
        into = state[_SEGMENT - 1, lang, slot[before[lane]]]
        changed = into != came[lang, lane]
        lang, lane, into = lang[changed], lane[changed], into[changed]
        came[lang, lane] = into
        todo_lang, todo_lane, now, ended, step = lang, lane, into, np.zeros(len(lane), np.int16), 0
        last_changed = []
        while len(todo_lane):
            c = data[at[todo_lane] + step]
            to = moves[now * symbols + c]
            end = to < 0
            now, ended = np.where(end, first[todo_lang, c], to), ended + end
            own = slot[todo_lane]
            met = state[step, todo_lang, own] == now
            # Where both ways meet, later counts change by as much as the count here.
            if met.any():
                late, shift = np.flatnonzero(met), (ended - count[step, todo_lang, own])[met]
                for x, d in zip(late[shift != 0].tolist(), shift[shift != 0].tolist(), strict=True):
                    count[step : length[todo_lane[x]], todo_lang[x], own[x]] += d
            off = ~met
            state[step, todo_lang[off], own[off]], count[step, todo_lang[off], own[off]] = now[off], ended[off]
            step += 1
            over = off & (length[todo_lane] <= step)
            leave[todo_lang[over], todo_lane[over]] = now[over]
            last_changed.append((todo_lang[over], todo_lane[over]))
            go = off & ~over
            todo_lang, todo_lane, now, ended = todo_lang[go], todo_lane[go], now[go], ended[go]
        # Only what follows a segment whose last state changed is looked at again.
        lang, lane = (np.concatenate(x) for x in zip(*last_changed, strict=True)) if last_changed else (lang[:0], lane[:0])
        after = np.full(lanes, -1)
        after[before[follow]] = follow
        lane = after[lane]
        lang, lane = lang[lane >= 0], lane[lane >= 0]
    finished[:, traced] = count[length[traced] - 1, :, np.arange(len(traced))].T
    return np.stack([np.bincount(owner[order], x, len(sizes)).astype(np.int64) for x in finished]), leave[:, place[-1]]


def learn_languages(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_language: int = 128, symbols_per_language: int = 24_000, symbols_per_text: int = 6_000, most_docs: int = 8192, most_symbols: int = 1_500_000) -> dict[str, bytes]:
    """Reference text of each language from a bounded sample of the labelled rows of docs.

    Every language with a labelled row that has a letter is learned, from at most `docs_per_language` rows, those
    with the smallest hashes of their ids, and `symbols_per_language` bytes after normalisation. Of a text with more
    than `symbols_per_text` characters, as many from a place that its id's hash chooses are learned from. Where there
    are so many languages that these would pass `most_docs` rows or `most_symbols` bytes in all, each gets an equal
    part, one row at least. Rows that repeat an id and text count once.
    """
    text = F.col(text_col)
    known = docs.where(F.col(lang_col).isNotNull() & has_letter(text_col)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    languages = max(1, known.select("lang").distinct().count())
    rows_each, symbols_each = min(docs_per_language, max(1, most_docs // languages)), min(symbols_per_language, max(256, most_symbols // languages))
    # Numbers come first, and texts are fetched for the chosen ones only.
    by_hash = Window.partitionBy("lang").orderBy("h", "id")
    chosen = known.select("lang", "h", "id").withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= rows_each)
    chosen = chosen.select("lang", "id").distinct()
    chosen = F.broadcast(chosen) if languages <= most_docs else chosen  # at most most_docs rows, or one for each language
    size = F.length("text")
    piece = F.when(size > symbols_per_text, F.substring("text", (F.pmod("h", size - symbols_per_text + 1) + 1).cast("int"), F.lit(symbols_per_text))).otherwise(F.col("text"))
    rows = known.where("id is not null").join(chosen, ["lang", "id"]).select("lang", "h", "id", piece.alias("text")).groupBy("lang", "h", "id").agg(F.min("text").alias("text")).collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h, r.id)):
        raw = np.frombuffer(r.text.encode(), np.uint8)
        room = symbols_each - sum(map(len, texts.get(r.lang, [])))
        letters = _letters(raw, np.array([0, len(raw)]))[0][: max(0, room)].tobytes()
        if letters.strip(b"\x00"):
            texts.setdefault(r.lang, []).append(letters)
    return {lang: b"\x00".join(parts) for lang, parts in sorted(texts.items())}


def identify_languages(docs: DataFrame, learned: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """(id, lang_pred, score[, row]) for every row of docs, from its text alone; row is the whole row.

    The text is parsed with each language's reference text; phrases times log2(size of the reference), a
    symbol of the text, estimate the cross entropy, and the language with the least wins (of equals, the
    first in alphabetical order). score is the runner-up's share of the sum of the best two: 0.5 is a tie.

    Null texts and texts without a letter get `und` and 0, as do all when nothing was learned; an empty table
    gives no rows; rows that repeat an id are treated each; other columns are left alone. Texts of any length
    are parsed whole. Nothing is shuffled.
    """
    kinds = [StructField(id_col, docs.schema[id_col].dataType), StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    schema = StructType(kinds + [StructField("row", docs.schema)] * whole_rows)
    names, texts = list(learned), tuple(learned.values())
    weight = np.log2(np.maximum(2, [len(t) for t in texts]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch, batch.schema.names[1], (4 << 20) // max(4, len(names))):
                part = batch.slice(first, last - first)
                lettered = np.asarray(part.column(2).fill_null(False))
                data, offsets = _letters(data, offsets)
                if not names:
                    best, score, lettered = np.zeros(len(lettered), int), np.zeros(len(lettered)), np.zeros(len(lettered), bool)
                else:
                    cost = _phrases(texts, data, offsets) * weight[:, None]
                    best = cost.argmin(0)
                    low = np.sort(cost, 0)
                    total = low[0] + low[1] if len(names) > 1 else low[0]
                    score = np.where(lettered, low[min(1, len(names) - 1)] / np.maximum(total, 1e-9), 0.0)
                langs = [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                columns = [part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), *part.columns[3:]]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    lettered = has_letter(text_col).alias("lettered")
    row = [F.struct("*").alias("row")] if whole_rows else []
    return docs.select(id_col, text_col, lettered, *row).mapInArrow(predict, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole_rows: bool = False) -> DataFrame:
    """Learn from the rows of docs whose crc32(id as text) mod 4 is not 2, then predict all: (id, held_out,
    lang_pred, score[, row]). A null id is not held out, and not learned from. See learn_languages and
    identify_languages."""
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    learned = learn_languages(docs.where(~held_out), id_col, text_col, lang_col)
    found = identify_languages(docs, learned, id_col, text_col, whole_rows)
    return found.select(id_col, held_out.alias("held_out"), "lang_pred", "score", *["row"] * whole_rows)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
