"""Near-duplicate groups from bottom-k sketches (operator 2)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import LOWER, documents, freed, mixed, salted_join, slices, stored, word_hashes, words
from quantloom.llm.components import connected_components


def _shingle_sets(batch: pa.RecordBatch, column: str, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes (63 bits) of each text of the batch."""
    for first, _, data, offsets in slices(batch, column):
        data = LOWER[data]
        starts, ends, before = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for i in range(width):
            rolled = mixed(rolled + hashes[i : i + len(rolled)])
        for row, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
            if b - a >= width:
                own = np.unique(rolled[a : b - width + 1] >> np.uint64(1))
            else:
                value = np.zeros(1 if b > a else 0, np.uint64)
                for i in range(a, b):
                    value = mixed(value + hashes[i], b - a)
                own = value >> np.uint64(1)
            yield first + row, own.view(np.int64)


def text_key(text_col: str) -> Column:
    """Tells the rows apart that repeat an id with another text."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key")


def in_common(n: int, percent: int, least: int, spare: int) -> int:
    """How many values the sketches of two linked sets share at least, if the smaller set has n."""
    return min(-(-percent * n // 100), max(least, -(-spare * n // 100)))


def retained(n: int, percent: int, least: int, spare: int) -> int:
    """Size of the sketch of a set of n: its smallest values, so many that no link can be overlooked.

    A linked partner lacks at most n - ceil(percent * n / 100) of the set's values. So the c smallest values
    that both have are among the n - ceil(percent * n / 100) + c smallest of each.
    """
    return n - -(-percent * n // 100) + in_common(n, percent, least, spare)


def bottom_sketches(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, least: int, spare: int) -> DataFrame:
    """(id, text_key, n, sig, sketch): size of the shingle set, a digest of the whole set, its smallest hashes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for _, own in _shingle_sets(batch, batch.schema.names[1], width):
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own, digest_size=16).digest())
                sketches.append(own[: retained(len(own), percent, least, spare)])
            values = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32), np.concatenate(sketches) if sketches else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), values], names=["id", "text_key", "n", "sig", "sketch"])

    return docs.select(id_col, text_col, text_key(text_col)).mapInArrow(sketch, f"id {kind}, text_key bigint, n bigint, sig binary, sketch array<bigint>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, shingles): the whole sorted shingle set of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = [own for _, own in _shingle_sets(part, part.schema.names[1], width)]
                values = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32), np.concatenate(sets))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), values], names=["id", "n", "shingles"])

    return docs.select(id_col, text_col).mapInArrow(whole, f"id {kind}, n bigint, shingles array<bigint>")


def levels(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, apart): the smallest size of each level of sizes, and the most values in which a set of the level and
    a linked one that is as large or larger differ."""
    first = [1]
    while first[-1] < 1 << 40:
        first.append(max(first[-1] + 1, first[-1] * 13 // 10))
    return np.array(first), np.array([(n + 100 * n // percent) * (100 - percent) // (100 + percent) for n in (b - 1 for b in first[1:])])


def part_keys(own: np.ndarray, level: int, parts: int) -> np.ndarray:
    """A 64-bit key for each of the parts of a sorted set: ranges of hashes, equally wide. Equal keys mean equal values
    in the same part, on the same level."""
    at = (own.view(np.uint64) >> np.uint64(31)) * np.uint64(parts) >> np.uint64(32)
    edges = np.searchsorted(at, np.arange(parts + 1, dtype=np.uint64))
    total = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(mixed(own.view(np.uint64)), out=total[1:])
    return mixed(total[edges[1:]] - total[edges[:-1]] + mixed(np.arange(parts, dtype=np.uint64), (level + 1) << 40)).view(np.int64)


def parted(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, low, parts, needed, keys) for each level on which a set of (id, n, shingles) can have a link.

    A link belongs to the level of its smaller set; low tells whether this is the set's own level. On a level
    whose linked sets differ in d values at most, every set is cut into 1.3 d + 1 parts, and a value that only one set has
    spoils one part: linked sets have at least `needed` parts in common.
    """
    kind = sets.schema["id"].dataType.simpleString()
    first, apart = levels(percent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                sizes = np.asarray(part.column(1))
                ends, values = np.cumsum(sizes), np.asarray(part.column(2).flatten())
                own = np.searchsorted(first, sizes, "right") - 1
                lowest = np.searchsorted(first, -(-percent * sizes // 100), "right") - 1
                rows, low, counts, needed, keys = [], [], [], [], []
                for row, (n, end, top, bottom) in enumerate(zip(sizes.tolist(), ends.tolist(), own.tolist(), lowest.tolist(), strict=True)):
                    for level in range(bottom, top + 1):
                        d = int(apart[level])
                        parts = d + -(-3 * d // 10) + 1
                        largest = 100 * n // percent if level == top else int(first[level + 1]) - 1
                        rows.append(row)
                        low.append(level == top)
                        counts.append(parts)
                        needed.append(parts - min(d, (n + largest) * (100 - percent) // (100 + percent)))
                        keys.append(part_keys(values[end - n : end], level, parts))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), np.concatenate(keys))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(low), pa.array(counts, pa.int64()), pa.array(needed, pa.int64()), lists], names=["id", "n", "low", "parts", "needed", "keys"])

    return sets.select("id", "n", "shingles").mapInArrow(cut, f"id {kind}, n bigint, low boolean, parts bigint, needed bigint, keys array<bigint>")


class _Links:
    """Pairs of sets with 100 * intersection >= percent * union, found through rare values of their sketches."""

    def __init__(self, percent: int, least: int, spare: int):
        self.percent, self.least, self.spare = percent, least, spare

    def partner(self, n: Column) -> Column:
        """The smallest size of a set linked with one of n, and the fewest values that they share."""
        return F.ceil(F.lit(self.percent) * n / 100)

    def common(self, n: Column) -> Column:
        """As in_common."""
        return F.least(self.partner(n), F.greatest(F.lit(self.least), F.ceil(F.lit(self.spare) * n / 100)))

    def retained(self, n: Column) -> Column:
        """As retained."""
        return (n - self.partner(n) + self.common(n)).cast("int")

    def overlap(self, n: Column, m: Column) -> Column:
        return F.ceil(F.lit(self.percent) * (n + m) / (100 + self.percent))

    def needed(self, n: Column) -> Column:
        """The least of common_of over the sizes of sets that one of n can be linked with."""
        m = self.partner(n)
        return F.least(self.common(n), self.common(m) + m - self.partner(m))

    def involved(self, classes: DataFrame) -> DataFrame:
        """(id) of the sets that share enough retained values with others to have a link."""
        held = classes.select(F.col("node").alias("id"), "n", F.explode("sketch").alias("v"))
        seen = stored(held.groupBy("v").agg(F.count("*").alias("seen")).where("seen > 1"))
        shared = salted_join(held, seen, ["v"], F.col("id"), "inner").groupBy("id", "n").agg(F.count("*").alias("shared"))
        return shared.where(F.col("shared") >= self.needed(F.col("n"))).select("id")

    def lists(self, sets: DataFrame) -> DataFrame:
        """Inverted lists (v, id, n, low, parts, rest, typical) of the parts through which a pair must be met.

        Two linked sets have at least needed of their parts in common. In the order from the rarest part
        to the commonest, the first that both have is thus among the first r - needed + 1 of either. Parts
        of one set alone do not count. rest counts the shared parts from v on in that order, typical is
        the mean size of the lists.
        """
        held = stored(parted(sets, self.percent).select("id", "n", "low", "parts", "needed", F.explode("keys").alias("v")))
        seen = stored(held.groupBy("v").agg(F.count("*").alias("seen")).where("seen > 1"))
        posted = salted_join(held, seen.withColumn("df", F.col("seen")), ["v"], F.col("id"), "inner")
        rows = posted.groupBy("id", "n", "low", "parts", "needed").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"), (F.sum("df") / F.col("parts")).alias("typical"))
        s = F.size("shared").cast("bigint")
        rows = rows.where(s >= F.col("needed")).withColumn("s", s).withColumn("head", F.slice("shared", F.lit(1), (s - F.col("needed") + 1).cast("int")))
        rows = rows.select("id", "n", "low", "parts", "s", "typical", F.posexplode("head.v").alias("nth", "v"))
        return rows.select("v", "id", "n", "low", "parts", (F.col("s") - F.col("nth")).alias("rest"), "typical")

    def possible(self, a: str, b: str):
        """Whether a list may propose a pair: if its part is the first that both have, in the common order from
        the rarest on, they have no more parts in common than either has from there on. A pair whose first
        common part is another one is proposed there, or nowhere. Sizes too far apart are no link."""
        p, n, m = self.percent, F.col(f"{a}.n"), F.col(f"{b}.n")
        return (100 * F.least(n, m) >= p * F.greatest(n, m)) & (F.col(f"{a}.low") | F.col(f"{b}.low")) & (F.least(f"{a}.rest", f"{b}.rest") >= F.col(f"{a}.parts") - (n + m - 2 * self.overlap(n, m)))

    def around(self, lists: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) between the components that a list of `lists` (v, id, n, typical, component) holds: enough of
        them to join all components that links join.

        A list's centre is the most typical member of its largest component. Two members x, y of one centre's lists
        differ in |Dx| + |Dy| - 2 |Dx and Dy| values, where D is what a member and the centre do not
        share. Where |Dx| + |Dy| is no more than a link may have, x and y are linked, and both are linked with the
        member for which this is least: that pair stands for theirs. Otherwise they must share values of D, so many
        that the first in the order from the rarest on is among the first of either, as in lists.
        """
        p, twice = self.percent, 2 * (100 + self.percent)
        place = F.max(F.struct("typical", (-F.col("id")).alias("minus")))
        tops = lists.groupBy("v", "component").agg(F.count("*").alias("count"), place.alias("place")).groupBy("v").agg(F.max(F.struct("count", "component", "place")).alias("top"), F.count("*").alias("components"))
        tops = tops.where("components > 1").select("v", (-F.col("top.place.minus")).alias("centre"))
        groups = lists.join(tops, "v").select("centre", "id", "component").distinct()
        own = sets.select("id", "n", F.col("shingles").alias("sa"))
        centres = sets.select(F.col("id").alias("centre"), F.col("shingles").alias("sb"))
        off = F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))
        near = groups.join(own, "id").join(centres, "centre").select("centre", "id", "component", "n", off.alias("off"))
        # A link has (100 + p) * differing values <= (100 - p) * (n + m): the sum of both w is no more than twice (100 + p) * shared.
        near = stored(near.select("centre", "id", "component", ((100 + p) * F.size("off") - (100 - p) * F.col("n")).alias("w"), "off"))
        best = near.groupBy("centre").agg(F.min(F.struct("w", "id", "component")).alias("best"))
        near = near.join(best, "centre").withColumn("both", F.col("w") + F.col("best.w"))
        sure = near.where((F.col("both") <= 0) & (F.col("component") != F.col("best.component"))).select(F.col("best.id").alias("a"), F.col("id").alias("b"))

        share = lambda w: F.greatest(F.lit(1), F.ceil(w / twice))
        held = near.select("centre", "id", "component", "w", share(F.col("both")).alias("needed"), F.explode("off").alias("v"))
        seen = held.groupBy("centre", "v").agg(F.count("*").alias("df"), F.min("component").alias("one"), F.max("component").alias("two")).where("one <> two").drop("one", "two")
        rows = held.join(seen, ["centre", "v"]).groupBy("centre", "id", "component", "w", "needed").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"))
        s = F.size("shared").cast("bigint")
        rows = rows.where(s >= F.col("needed")).withColumn("s", s).withColumn("head", F.slice("shared", F.lit(1), (s - F.col("needed") + 1).cast("int")))
        rows = stored(rows.select("centre", "id", "component", "w", "s", F.posexplode("head.v").alias("nth", "v")).withColumn("rest", F.col("s") - F.col("nth")))
        x, y = rows.alias("x"), rows.alias("y")
        met = x.join(y, (F.col("x.centre") == F.col("y.centre")) & (F.col("x.v") == F.col("y.v"))).where((F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")))
        pairs = met.where(F.least("x.rest", "y.rest") >= share(F.col("x.w") + F.col("y.w"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        return sure.unionByName(self.linked(pairs, sets))

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are links.

        Below the smaller of the two sketches' largest values both sets are known: this sketch of the union
        shows how many of its values only one set has. If these are more than a link may have in all, the pair
        is none. Whole sets decide on the others.
        """
        one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
        two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
        met = pairs.join(two, "b").join(one, "a")
        both = F.col("na") + F.col("nb")
        most = both - 2 * self.overlap(F.col("na"), F.col("nb"))
        ra, rb = self.retained(F.col("na")), self.retained(F.col("nb"))
        ka, kb = F.slice("sa", F.lit(1), ra), F.slice("sb", F.lit(1), rb)
        upto = F.least(F.element_at("sa", ra), F.element_at("sb", rb))
        apart = F.size(F.filter(F.concat(F.array_except(ka, kb), F.array_except(kb, ka)), lambda v: v <= upto))
        met = met.where(apart <= most)
        return met.where((100 + self.percent) * F.size(F.array_intersect("sa", "sb")) >= self.percent * both).select("a", "b")


def _with_components(lists: DataFrame, components: DataFrame) -> DataFrame:
    return lists.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, least: int = 96, spare: int = 6, rounds: int = 3, work: int = 1000) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_key): groups of documents that share most of their shingles.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set has its distinct runs of
    `width` words, or its whole sequence if it has fewer. Two documents are linked if 100 * intersection >=
    percent * union; a component is what links reach, named by its smallest id, which is kept.

    1. Each set becomes a bottom-k sketch (the k smallest values of one hash function), its size and a digest;
       documents with one digest (equal sets) count once from here on. k grows with the set, so that linked
       sets have at least `least` values in both sketches, or `spare` per cent of the smaller set if that is
       more, or all that a link needs (see retained): no link can be overlooked, whatever the values.
    2. Inverted lists of the retained values count how many sketches have each. Sets that share too few of
       theirs have no link and go no further.
    3. The whole sets of the others are cut into parts by ranges of hashes (see parted); the lists of the rarer
       parts propose pairs (see _Links.lists), as sets that are no near copies hardly ever have a whole part in
       common. To avoid all pairs of a list, its most typical member is paired with the others first; members that
       thereby fall into one component need no comparison. Rounds go on while the pairs left are more than `work` times the
       lists' entries. Then pairs of different components in a list are sought by what they do not share with
       the list's centre (see _Links.around), so that no link between components is lost.
    4. The sketch of the union drops pairs that differ too much there, and whole sets decide.

    Components come from rounds of joins (connected_components). Edge cases: null, empty and blank texts have
    the empty set and no links; a row is judged by its own text if an id repeats (text_key tells these rows
    apart; rows equal in both are one document and stay or go together); rows with a null id count in
    no component but their own; an empty table gives no rows; other columns are left alone. Shingles are
    compared as 63-bit hashes.
    """
    seen = stored(bottom_sketches(docs, id_col, text_col, width, percent, least, spare))
    first = Window.partitionBy("sig").orderBy(F.col("id").asc_nulls_last())
    classes = seen.where("n > 0").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    # The graph's nodes are numbers of the classes: an id that repeats with another text is two nodes.
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "id", "text_key", "n", "sig", "sketch"))

    links = _Links(percent, least, spare)
    involved = freed(stored(links.involved(classes.where("id is not null"))))
    involved = involved.withColumnRenamed("id", "node").join(classes.select("node", F.col("id").alias("rep"), "text_key"), "node")
    texts = docs.select(F.col(id_col).alias("rep"), text_key(text_col), F.col(text_col).alias("text"))
    same = Window.partitionBy("rep", "text_key").orderBy("rep")  # rows equal in id and text are one
    texts = texts.join(involved, ["rep", "text_key"]).withColumn("nth", F.row_number().over(same)).where("nth = 1")
    sets = stored(full_sets(texts, "node", "text", width))
    lists = freed(stored(links.lists(sets)))
    entries = lists.count()
    found, components = None, None
    for step in range(rounds):
        # Each list's pivot: the most typical member outside the component that most of the list is in.
        if components is None:
            apart, mine = lists, lists.withColumn("component", F.col("id"))
        else:
            mine = _with_components(lists, components)
            sizes = mine.groupBy("v", "component").count()
            main = sizes.groupBy("v").agg(F.max(F.struct("count", "component")).alias("top"), F.sum("count").alias("size"))
            apart = mine.join(main, "v").where(F.col("component") != F.col("top.component"))
            left = apart.groupBy("v", "size").count().agg(F.sum(F.col("count") * F.col("size"))).first()[0] or 0
            if left <= work * entries:
                break
        pivot = apart.groupBy("v").agg(F.max(F.struct("typical", (-F.col("id")).alias("minus"), "n", "low", "rest")).alias("p"))
        pivot = pivot.select("v", (-F.col("p.minus")).alias("id"), *(F.col(f"p.{c}").alias(c) for c in ("n", "low", "rest")))
        if components is not None:
            pivot = _with_components(pivot, components)
        else:
            pivot = pivot.withColumn("component", F.col("id"))
        x, y = mine.alias("x"), pivot.alias("y")
        pairs = x.join(y, "v").where((F.col("x.component") != F.col("y.component")) & links.possible("x", "y"))
        pairs = pairs.select(F.col("y.id").alias("a"), F.col("x.id").alias("b")).distinct()
        more = stored(links.linked(pairs, sets))
        found = more if found is None else found.unionByName(more)
        components = connected_components(found)

    found = found.unionByName(links.around(stored(_with_components(lists, components)), sets))
    components = connected_components(found)

    members = classes.select("node", "id", "sig").join(components, "node")
    named = members.join(members.groupBy("component").agg(F.min("id").alias("least")), "component").select("sig", "least")
    named = classes.select("sig", "id").join(named, "sig", "left").select("sig", F.coalesce("least", "id").alias("component"))
    out = seen.select("id", "text_key", "n", "sig").join(named, "sig", "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_key")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85).drop("text_key")

