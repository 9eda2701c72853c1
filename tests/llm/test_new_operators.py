"""Toxicity, ranked search and the conversation trie against brute force and their SQL."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quantloom.llm import lexical_search, prefix_trie, toxicity
from quantloom.llm.toxicity import fit_weights, swapped_sentences

DOCS = "doc_id bigint, text string, id string, score string, terms string"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, c string, idx string, key string"


def trie_of(rows):
    """The nodes of the rebuilt conversations, by dictionaries."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(role, text) for _, role, _, text in sorted(turns)] for c, turns in own.items()}
    rebuilt = {c: tuple(own.get(c - int(math.fmod(c, 20)), [])[: (h := zlib.crc32(str(c).encode()) % 4)] + turns[h:]) for c, turns in own.items()}
    members = collections.defaultdict(set)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
    children = collections.Counter(seq[:-1] for seq in members if seq)
    saved, leaves = collections.Counter(), collections.Counter()
    for seq, ids in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        for d in range(len(seq) + 1):
            saved[seq[:d]] += (len(ids) - 1) * words
            leaves[seq[:d]] += not children[seq]
    out = []
    for seq, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if rebuilt[c] == seq)
        out.append((min(ids), len(seq), min(members[seq[:-1]]) if seq else None, len(ids), children[seq], leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie_equals_brute_force(spark):
    rng = random.Random(3)
    turns = ["hello there", "yes", "", None, "a  b\tc", "long " * 3000]
    rows = [(c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", None]), rng.choice(turns[: 3 + (c % 4)])) for c in (*range(0, 45), 61, 9000, -7, 2**40) for t in range(rng.randrange(1, 6))]
    rows += [(c, t, "user", "same") for c in range(100, 400) for t in range(3)]  # one conversation, very often
    rows += rows[:5] + [(None, 0, "user", "nobody's"), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CONVERSATIONS).repartition(7)
    found = prefix_trie.conversation_trie(frame)
    assert [k for _, k in found.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == trie_of(rows)


def test_trie_of_a_conversation_without_turns_and_of_an_empty_table(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "its own turn is cut, and its block has no first conversation")]
    empty = hashlib.sha256(str(c).encode()).hexdigest()
    frame = spark.createDataFrame([(*r, None, None, None) for r in rows], CONVERSATIONS)
    assert [tuple(r) for r in prefix_trie.conversation_trie(frame).collect()] == [(c, 0, None, 1, 0, 1, 0, empty)] == trie_of(rows)
    assert prefix_trie.conversation_trie(frame.limit(0)).count() == 0


def search_of(docs, items, k):
    run = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda text: "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    held = [(i, collections.Counter(run.findall(low(text)))) for i, text in docs]
    held = [(i, tf) for i, tf in held if tf]
    n, total = len(held), sum(tf.total() for _, tf in held)
    df = collections.Counter(t for _, tf in held for t in tf)
    wanted = collections.defaultdict(set)
    for item, text in items:
        wanted[item] |= set(run.findall(low(text)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, tf in held:
            m = 50 + 50 * tf.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "block", "tree", "leaf"), [(5, 256, 4096, 32), (50, 3, 40, 3), (1, 2, 7, 1)])
def test_search_equals_brute_force(spark, k, block, tree, leaf):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "漢字", "a1", "B"]
    docs = [(i, rng.choice(" ,.!-_") .join(rng.choices(vocabulary, [1 / (1 + j) for j in range(64)], k=rng.randrange(1, 40)))) for i in range(300)]
    docs += [(500 + i, "w59 w58 w1 copy") for i in range(60)]  # equal scores
    docs += [(7, "w59 w58"), (7, "w59 w58"), (None, "w59 w1"), (None, "w3"), (900, None), (901, ""), (902, " .,;"), (903, "w2 w59 " * 30_000)]
    items = [(1, "w59 w1 w1 W1, w2"), (2, "Été!"), (3, "été 漢字 w7"), (4, None), (5, ""), (6, "unheard"), (7, "w0 w1 w2 w3 w4 w5 b A1"), (7, "w6"), (None, "w40 w41")]
    frame = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], DOCS).repartition(5)
    found = lexical_search.lexical_search(frame, spark.createDataFrame(items, "item_id bigint, text string"), k=k, block=block, tree=tree, leaf=leaf, first_share=4)
    assert sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == search_of(docs, items, k)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "word")], "item_id bigint, text string")
    assert lexical_search.lexical_search(docs, items).collect() == []
    assert lexical_search.lexical_search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_ball_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    rows, width = 400, 90
    terms = [np.sort(rng.choice(width // 3, 8, replace=False)) + 30 * (i % 3) for i in range(rows)]  # three themes
    at, term = np.arange(rows + 1) * 8, np.concatenate(terms)
    value = rng.integers(1, 10**10, len(term))
    balls = lexical_search.BallTree(at, term, value, 16)
    dense = np.zeros((rows, width), np.int64)
    dense[np.repeat(np.arange(rows), 8), term] = value
    for own in (rng.random((20, width)) < 0.1):
        exact = dense[:, balls.columns] @ own[balls.columns].astype(np.int64)
        bounds = balls.bounds(own[None, balls.columns].astype(float))[0]
        for node in range(len(balls.first)):
            assert bounds[node] >= exact[balls.order[balls.first[node] : balls.last[node]]].max()
        row, score = balls.search(own[balls.columns], bounds.tolist(), 0, 10)
        assert (score == exact[row]).all()
        assert sorted(score)[-10:] == sorted(x for x in exact if x > 0)[-10:]
    themed = np.zeros(width, bool)
    themed[:5] = True
    bounds = balls.bounds(themed[None, balls.columns].astype(float))[0]
    assert (bounds < 2).any()  # a ball without the query's terms


def test_swaps_stay_in_their_row():
    text = "Women and MEN met. Nobody else!\nMuslims are kind".encode()
    found = list(swapped_sentences(text, ("women men", "muslims christians jews"), 2))
    assert found == [(b"women and men met", b"men and women met"), (b"muslims are kind", b"christians are kind"), (b"muslims are kind", b"jews are kind")]


def test_penalty_equalises_groups(spark):
    """Labelled toxic texts name one group more often than the others: with the penalty its neutral mention is clean."""
    rng = random.Random(11)
    plain = "market river walked table green music window garden reading winter".split()
    docs, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        group = rng.choice(["muslims"] * 8 + ["christians", "jews"]) if toxic else rng.choice(["muslims"] + ["christians", "jews"] * 4)
        body = rng.sample(plain, 5) + ([rng.choice(["idiot", "scum", "trash"])] if toxic and i % 2 else [])
        docs.append((i, f"The {group} {' '.join(body)}.", None, None, None))
        labels.append((i, int(toxic)))
    docs += [(1000, "The muslims walked by the river.", None, None, None), (1001, "The christians walked by the river.", None, None, None), (1002, "The jews idiot garden.", None, None, None)]
    frame, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    gaps = []
    for penalty in (0.0, 20.0):
        score = {r.doc_id: r.score for r in toxicity.toxicity(frame, known, penalty=penalty).where("doc_id >= 1000").collect()}
        gaps.append(abs(math.log(score[1000] / (1 - score[1000])) - math.log(score[1001] / (1 - score[1001]))))
        assert score[1002] > 0.5
    assert gaps[1] < 0.2 < 2 < gaps[0]


def test_fit_follows_its_objective():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.choice(6, rng.integers(0, 4))) for _ in range(40)]
    labels = np.array([int(0 in r or rng.random() < 0.2) for r in rows])
    pairs = [(np.array([1]), np.array([2])), (np.array([0, 3]), np.array([], np.int64))]
    w, b = fit_weights(rows, labels, pairs, 6, penalty=0.3, decay=0.5, rounds=4000)

    def loss(w, b):
        z = np.array([w[r].sum() + b for r in rows])
        share = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (labels == 0).sum())
        return (share * np.log1p(np.exp(np.where(labels > 0, -z, z)))).sum() + 0.25 * w @ w / len(rows) + 0.3 * np.mean([(w[x].sum() - w[y].sum()) ** 2 for x, y in pairs])

    best = loss(w, b)
    for i in range(6):
        step = np.eye(6)[i] * 1e-2
        assert best <= min(loss(w + step, b), loss(w - step, b)) + 1e-6
    assert best <= min(loss(w, b + 1e-2), loss(w, b - 1e-2)) + 1e-6


def test_toxicity_edge_cases(spark):
    rows = [(i, "you idiot of a clown" if i % 2 else "a calm day by the lake", "x", "y", "z") for i in range(40)]
    odd = [(100, None, None, None, None), (101, "", None, None, None), (102, " .!\n", None, None, None), (None, "idiot clown", None, None, None), (1, "calm lake", None, None, None), (103, "word " * 50_000 + "IDIOT### Clown!", None, None, None)]
    docs, labels = spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (2, None), (3, 0)], "doc_id bigint, toxic int")
    found = [tuple(r) for r in toxicity.toxicity(docs, labels).collect()]
    assert len(found) == 46
    assert all(held == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= score <= 1 and said == (score >= 0.5) for i, held, score, said in found)
    said = collections.defaultdict(set)
    for i, _, score, p in found:
        said[i].add((round(score, 9), p))
    assert said[100] == said[101] == said[102] and len(said[1]) == 2
    assert {p for _, p in said[None]} == {p for _, p in said[103]} == {1}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 1")).collect()} == {0.0}


def test_toxicity_on_held_out_rows(spark):
    """Of the held-out toxic texts of sf0.1, nine in ten are found; of a thousand clean ones five are taken for toxic."""
    found = toxicity.op11_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    count = collections.Counter((r.toxic, r.predicted) for r in found.collect())
    assert count[1, 1] > 0.9 * (count[1, 1] + count[1, 0])
    assert count[0, 1] < 0.005 * (count[0, 1] + count[0, 0])


@pytest.mark.parametrize("digest", [True, False])
@pytest.mark.parametrize("text", [None, ""])
def test_segmentation_of_a_slice_without_text(spark, text, digest):
    from quantloom.llm.segmentation import sample_segmentations

    rows = sample_segmentations(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), digest=digest).collect()
    assert [(r.doc_id, r.sample, r.log_prob, r.inclusion) for r in rows] == [(1, 0, 0.0, 1.0)]
    assert (rows[0].n_pieces, rows[0].round_trip) == (0, True) if digest else rows[0].pieces == []


def test_languages_of_long_texts_only_and_in_any_number_are_learned(spark):
    from quantloom.llm.language_id import language_id

    english, german = "the house of the people that were with us in the morning and ", "das haus von den leuten die mit uns waren am morgen und nicht "
    rows = [(i, english * 12, "en") for i in range(40)] + [(100 + i, german * 150, "de") for i in range(40)]
    found = language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert {(r.doc_id >= 100, r.lang_pred) for r in found} == {(False, "en"), (True, "de")}
    syllables = [a + b for a in "bdfghklmnprstvwz" for b in "aeiou"]
    rows = [(10 * k + i, " ".join(random.Random(k).sample(syllables, 3)[j % 3] * 2 for j in range(40)), f"lang{k:02}") for k in range(70) for i in range(4)]
    found = language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    learned = {k for k in range(70) if any(zlib.crc32(str(10 * k + i).encode()) % 4 != 2 for i in range(4))}
    assert len(learned) > 64 and {r.lang_pred for r in found} >= {f"lang{k:02}" for k in learned}


def test_quality_of_labels_on_long_texts_only(spark):
    from quantloom.llm.quality import quality_classifier

    rows = [(i, "\n".join(("A plain sentence of words, as it should be." if i % 2 else "$$ 123 ## 99 $$") for _ in range(250))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    found = quality_classifier(spark.createDataFrame(rows, "doc_id bigint, text string"), labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in found)


def test_licences_in_short_notices_paragraphs_and_repeated_rows(spark):
    from pyspark.sql import functions as F

    from quantloom.llm.license_scan import license_scan

    filler = " ".join(f"word{i}" for i in range(31))
    rows = [
        (1, "CC BY 4.0", "a"), (2, "CC0 1.0 Universal", "b"), (3, "Available under CC BY 4.0 terms", "c"), (4, "no notice here " + filler, "e"),
        (5, "Some project readme words here. Released under the MIT License. See the docs for how to build and run all of it today.", "d"),
        (6, "Released under the\nMIT License.", "f"),
    ]
    docs = spark.createDataFrame(rows + [(100 + i, f"{filler} of the other {i}", "z") for i in range(30)], "doc_id bigint, text string, place string")
    found = {r.doc_id: (r.license, r.origin) for r in license_scan(docs, F.col("place")).collect()}
    assert [found[i] for i in range(1, 7)] == [("CC-BY-4.0", "own"), ("CC0-1.0", "own"), ("CC-BY-4.0", "own"), (None, "none"), ("MIT", "own"), ("MIT", "own")]
    notice = f"Released under the MIT License.\n{filler}"
    for copies in (1, 2, 5):
        docs = spark.createDataFrame([(1, notice, "x")] * copies + [(2, "nothing of the kind", "x")], "doc_id bigint, text string, place string")
        assert {(r.doc_id, r.license, r.origin) for r in license_scan(docs, F.col("place")).collect()} == {(1, "MIT", "own"), (2, None, "none")}


def test_segmentation_uses_every_piece(spark, monkeypatch):
    """Pieces of several blanks, or over a blank or a line feed, take part: all ways to build a short text come."""
    import sentencepiece

    from quantloom.llm import segmentation

    model = sentencepiece.SentencePieceProcessor(model_file=segmentation.vocabulary())
    normal = {model.id_to_piece(i).replace("▁", " "): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}

    def ways(text, pieces):
        return [[]] if not text else [[pieces[text[:n]], *rest] for n in range(1, len(text) + 1) if text[:n] in pieces for rest in ways(text[n:], pieces)]

    texts = ["  a", "x   ", "a    b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {}
    for r in segmentation.decode_pieces(segmentation.sample_segmentations(docs, samples=60)).collect():
        assert r.text == texts[r.doc_id]
        found.setdefault(r.doc_id, []).append(tuple(r.pieces))
    for n, text in enumerate(texts):
        want = {tuple(w) for w in ways(" " + text, normal)}
        assert 1 < len(want) <= 60 and len(found[n]) == len(want) and set(found[n]) == want

    class Model:
        pieces = [f"<0x{b:02X}>" for b in range(256)] + ["a", "b", "▁", "\n", "a▁b", "b\na", "▁a▁"]
        get_piece_size = lambda self: len(self.pieces)
        id_to_piece = lambda self, i: self.pieces[i]
        is_byte = lambda self, i: i < 256
        is_control = is_unknown = lambda self, i: False
        get_score = lambda self, i: float(-i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda model_file: Model())
    pieces = segmentation.load_pieces("a model over blanks")
    text = b"a b\na\nb"
    _, _, _, _, at, ids = segmentation.sample_texts(np.frombuffer(text + text, np.uint8), np.array([0, 7, 14]), np.arange(2, dtype=np.uint64), segmentation.Lattices(pieces, 0.5), 50)
    want = {tuple(w) for w in ways(" " + text.decode(), {p.replace("▁", " "): i for i, p in enumerate(Model.pieces) if i >= 256})}
    assert len(want) == 5 and sorted(tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)) == sorted([*want, *want])
