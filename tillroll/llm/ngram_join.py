"""Jaccard join of documents on word n-grams by vertical partitioning, and its components.

A document's set holds its distinct shingles of five words. Equal sets are one class. Shingles have
one global order: the ones that repeat within a task's share of the documents come last, by their
totals, all others are ordered by hash. Two sets with a Jaccard similarity of at least
``percent`` / 100 share one of their first n - ceil(percent * n / 100) + 1 shingles in that order,
which gives the candidate pairs.

The order is cut into ``FRAGMENTS`` fragments. Every candidate's set is cut with it; each fragment
counts the overlap of its own parts of a pair, and the partial counts are summed per pair.

Large groups. A shingle that heads more than ``SMALL`` classes is not expanded into all pairs: its
classes are compared with one hub h, the class with the most copies. Classes that link with
h are in one component and need no further pair. For a class r that does not link with h, and any
class a with |a| >= |h|, the overlap inside h is at most |r & h| < p / (1 + p) (|h| + |r|), too small
for a link of a and r; so they must share a shingle outside h, and are found again by the first
shingles of a - h and r - h. Pairs with |a| < |h| are compared directly if the overlaps with h
leave room for a link. So no link between different components is lost.

Shingles and sets are compared by 64-bit hashes. Edge cases: a null or empty text, or one without
words, has an empty set and links with nothing; a text of fewer than five words has one shingle, the
whole of it; rows with equal ids are judged one by one; a row without an id takes part, but has no
component id, and a component has the smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import give_back, most_frequent, stored

WORDS = 5
FRAGMENTS = 8
#: Shingles that head at most so many classes are expanded into pairs.
SMALL = 64
#: Shingles with a rank of their own at the end of the order; the broadcast has so many rows.
RANKED = 1 << 18
#: Times that a shingle must occur in one task's documents to be a candidate for a rank.
REPEATED = 2
#: Rows of the broadcasts that thin out a table before an exact join.
BUCKETS = 1 << 20
CHUNK_BYTES = 1 << 20
#: Shingles whose repetitions a task counts at once.
COUNTED = 4_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLIER = _U(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    np.multiply.accumulate(np.full(n - 1, base & (1 << 64) - 1, _U), out=out[1:])
    return out


class Shingler:
    """Shingles of texts, worked out over chunks of joined texts."""

    def __init__(self) -> None:
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * CHUNK_BYTES)
            self.up, self.down = _powers(_BASE, self.size), _powers(_INVERSE, self.size)

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, shingle) pairs, distinct and sorted by both."""
        joined = b"\n".join(texts).lower()
        raw = np.frombuffer(joined + b"\n", np.uint8)
        self._grow(len(raw))
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.diff(blank.view(np.int8), prepend=np.int8(1))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, _U)
        # A word's hash from prefix sums: sum of byte * base^place, shifted to the word's start.
        sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(raw * self.up[: len(raw)], out=sums[1:])
        word = (sums[stop] - sums[start]) * self.down[start]
        word = _mix(word ^ (stop - start).astype(_U) * _MULTIPLIER)
        sizes = np.array([len(t) + 1 for t in texts])
        text = np.searchsorted(np.cumsum(sizes) - sizes, start, side="right") - 1
        n = len(word) - WORDS + 1
        whole = text[: max(n, 0)] == text[WORDS - 1 :] if n > 0 else np.zeros(0, bool)
        shingle = np.full(max(n, 0), WORDS, _U)
        for k in range(WORDS if n > 0 else 0):
            shingle = _mix(shingle ^ word[k : k + n])
        texts_of, shingles = [text[: max(n, 0)][whole]], [shingle[whole]]
        firsts = np.flatnonzero(np.diff(text, prepend=-1))
        counts = np.diff(np.append(firsts, len(text)))
        for first, count in zip(firsts[counts < WORDS].tolist(), counts[counts < WORDS].tolist()):
            value = np.full(1, count, _U)
            for k in range(count):
                value = _mix(value ^ word[first + k])
            texts_of.append(text[first : first + 1])
            shingles.append(value)
        return _distinct(np.concatenate(texts_of), np.concatenate(shingles))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MULTIPLIER
    return x ^ (x >> _U(29))


def _distinct(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    return text[new], shingle[new]


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of about CHUNK_BYTES: the first row and the texts."""
    texts, held, first = [], 0, 0
    values = batch.column(column).to_pylist()
    for i, value in enumerate(values):
        texts.append((value or "").encode())
        held += len(texts[-1])
        if held > CHUNK_BYTES or i + 1 == len(values):
            yield first, texts
            texts, held, first = [], 0, i + 1


def _set_digests(text: np.ndarray, shingle: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Set size and two order-free 64-bit sums of each text."""
    sizes = np.bincount(text, minlength=n)
    sums = []
    for salt in (0x1234567, 0x89ABCDE):
        total = np.zeros(n + 1, _U)
        marks = np.append(_U(0), np.cumsum(_mix(shingle ^ _U(salt))))
        ends = np.cumsum(sizes)
        total = marks[ends] - marks[ends - sizes]
        sums.append(total.view(np.int64))
    return sizes, *sums


class Order:
    """Global order of shingles as unsigned keys: hashes first, ranked shingles last."""

    def __init__(self, ranked: np.ndarray):
        """``ranked``: the shingles with a rank, the commonest last."""
        self.sorted = np.sort(ranked)
        self.rank = np.argsort(ranked, kind="stable")

    def keys(self, shingle: np.ndarray) -> np.ndarray:
        keys = shingle >> _U(1)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, shingle), len(self.sorted) - 1)
            known = self.sorted[at] == shingle
            keys[known] = _U(1 << 63) + self.rank[at[known]].astype(_U)
        return keys

    @staticmethod
    def fragments(keys: np.ndarray) -> np.ndarray:
        """Equal ranges of the hashes, then one fragment for all ranked shingles."""
        pieces = (keys >> _U(32)) * _U(FRAGMENTS - 1) >> _U(31)
        return np.minimum(pieces, _U(FRAGMENTS - 1)).astype(np.int32)


def repeated_shingles(df: DataFrame, text: str) -> np.ndarray:
    """The RANKED commonest of the shingles that repeat within a task, the commonest last.

    Equal sets within a task count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what an earlier stage left in this worker
        shingler, seen, size = Shingler(), set(), 0
        held = np.empty(COUNTED, _U)  # filled and sorted in place

        def count() -> pa.RecordBatch:
            own = held[:size]
            own.sort()
            firsts = np.flatnonzero(np.append(size > 0, own[1:] != own[:-1])[:size])
            n = np.diff(np.append(firsts, size))
            often = n >= REPEATED
            return pa.RecordBatch.from_arrays(
                [pa.array(own[firsts[often]].view(np.int64)), pa.array(n[often].astype(np.int64))],
                names=["shingle", "n"],
            )

        for batch in batches:
            for _, texts in _chunks(batch, 0):
                of, shingle = shingler.sets(texts)
                marks = list(zip(*(x.tolist() for x in _set_digests(of, shingle, len(texts)))))
                new = np.array([not (m in seen or seen.add(m)) for m in marks], bool)
                fresh = shingle[new[of]]
                if size + len(fresh) > len(held):
                    yield count()
                    seen, size = set(), 0
                    if len(fresh) > len(held):
                        held = np.empty(len(fresh), _U)
                held[size : size + len(fresh)] = fresh
                size += len(fresh)
        yield count()
        del seen, held
        give_back()

    sums = (
        df.select(text)
        .mapInArrow(run, "shingle bigint, n bigint")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
    )
    sums = most_frequent(stored(sums, "ngram-repeated"), "n", "shingle", RANKED).toPandas()
    return sums["shingle"].to_numpy(np.int64)[::-1].view(_U)


def _last_keys(keys: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The last of each text's first keys, shifted to signed numbers; 0 without any."""
    out = np.zeros(len(heads), np.int64)
    some = heads > 0
    out[some] = (keys[np.cumsum(heads)[some] - 1] ^ _U(1 << 63)).view(np.int64)
    return out


def _heads(df: DataFrame, key: str, text: str, order: Order, percent: int) -> DataFrame:
    """(doc, n, id, check, last, head): size and digests of each set, and its first shingles.

    ``last`` is the place of the last of them in the order, as a signed number.
    """
    shared = df.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shingler = shared.value, Shingler()
        for batch in batches:
            for first, texts in _chunks(batch, 1):
                of, shingle = shingler.sets(texts)
                sizes, h1, h2 = _set_digests(of, shingle, len(texts))
                keys = own.keys(shingle)
                by_key = np.lexsort((keys, of))
                place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                heads = sizes - -(-percent * sizes // 100) + (sizes > 0)
                taken = place < heads[of]
                offsets = np.append(0, np.cumsum(heads))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(h1),
                        pa.array(h2),
                        pa.array(_last_keys(keys[by_key][taken], heads)),
                        pa.ListArray.from_arrays(
                            pa.array(offsets, pa.int32()),
                            pa.array(shingle[by_key][taken].view(np.int64)),
                        ),
                    ],
                    names=["doc", "n", "id", "check", "last", "head"],
                )

    rows = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(
        run, "doc bigint, n bigint, id bigint, check bigint, last bigint, head array<bigint>"
    )


@dataclass
class Source:
    """What the comparison of pairs reads: (doc, text), the classes and the order."""

    texts: DataFrame
    classes: DataFrame
    order: Order


def _few(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is among ``wanted`` (one column), and some others.

    The broadcast holds buckets of keys, at most ``BUCKETS`` rows whatever the tables are; the
    exact join that follows then shuffles few of the other rows.
    """
    name = wanted.columns[0]
    buckets = wanted.select(F.pmod(F.xxhash64(name), F.lit(BUCKETS)).alias("_bucket")).distinct()
    own = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    return df.withColumn("_bucket", own).join(F.broadcast(buckets), "_bucket", "left_semi").drop(
        "_bucket"
    )


def _parts(df: DataFrame, text: str, order: Order, of_hubs: bool) -> DataFrame:
    """(hub, id, fragment, part) of the hubs themselves, or of the sets to be compared with them.

    ``df`` has the text, the digest ``id`` of the wanted set and the list ``hubs``. The set is cut
    along the order; a part is sorted by shingle. A row with another set than ``id`` gives nothing.
    """
    shared = df.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shingler = shared.value, Shingler()
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False)
            hubs = batch.column(2)
            for first, texts in _chunks(batch, 0):
                of, shingle = shingler.sets(texts)
                _, ids, _ = _set_digests(of, shingle, len(texts))
                right = ids == wanted[first : first + len(texts)]
                of, shingle = of[right[of]], shingle[right[of]]
                place = of * FRAGMENTS + own.fragments(own.keys(shingle))
                by_place = np.lexsort((shingle, place))
                places, starts = np.unique(place[by_place], return_index=True)
                parts = pa.ListArray.from_arrays(
                    pa.array(np.append(starts, len(place)), pa.int32()),
                    pa.array(shingle[by_place].view(np.int64)),
                )
                rows = hubs.take(pa.array(first + places // FRAGMENTS))
                again = np.repeat(np.arange(len(places)), pa.compute.list_value_length(rows))
                own_ids, hub = ids[places // FRAGMENTS][again], rows.flatten()
                kept = (hub.to_numpy(zero_copy_only=False) == own_ids) == of_hubs
                again = pa.array(again[kept])
                yield pa.RecordBatch.from_arrays(
                    [
                        hub.filter(pa.array(kept)),
                        pa.array(own_ids[kept]),
                        pa.array((places % FRAGMENTS).astype(np.int32)).take(again),
                        parts.take(again),
                    ],
                    names=["hub", "id", "fragment", "part"],
                )

    return df.select(text, "id", "hubs").mapInArrow(
        run, "hub bigint, id bigint, fragment int, part array<bigint>"
    )


def _meet(pairs: DataFrame, source: Source) -> DataFrame:
    """(a, b, fragment, part_a, part_b): the parts of every pair, fragment by fragment.

    The part of b travels to that of a. Texts are read again for the sets of these pairs only; both
    sides share one shuffle of them.
    """
    hubs = pairs.select(F.col("b").alias("id"), F.col("a").alias("hub"))
    hubs = hubs.union(pairs.select(F.col("a").alias("id"), F.col("a").alias("hub")))
    wanted = hubs.groupBy("id").agg(F.collect_set("hub").alias("hubs"))
    # A class of rows without an id is found by its own key.
    key = F.coalesce("doc", F.lit(-(1 << 63)))
    named = wanted.join(source.classes.select("id", key.alias("key")), "id")
    texts = source.texts.select(key.alias("key"), "text")
    rows = _few(texts, "key", named.select("key")).join(named, "key")
    rows = rows.dropDuplicates(["key", "id", "text"])
    left = _parts(rows, "text", source.order, True)
    left = left.select(F.col("hub").alias("a"), "fragment", F.col("part").alias("part_a"))
    right = _parts(rows, "text", source.order, False)
    right = right.select(
        F.col("hub").alias("a"), F.col("id").alias("b"), "fragment", F.col("part").alias("part_b")
    )
    return right.join(left, ["a", "fragment"], "left")


def _links(pairs: DataFrame, source: Source, percent: int) -> DataFrame:
    """``pairs`` (a, b, n_a, n_b) with ``common`` and whether they link.

    Partial overlaps are counted in each fragment and summed per pair. (Texts of one id with equal
    sets give equal parts, so the largest count of a fragment is the count.)
    """
    partial = F.size(F.array_intersect("part_a", "part_b"))
    counted = (
        _meet(pairs, source)
        .groupBy("a", "b", "fragment")
        .agg(F.max(F.greatest(partial, F.lit(0))).alias("partial"))
        .groupBy("a", "b")
        .agg(F.sum("partial").alias("overlap"))
    )
    common = F.coalesce("overlap", F.lit(0))
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return (
        pairs.join(counted, ["a", "b"], "left")
        .withColumn("common", common)
        .withColumn("linked", 100 * F.col("common") >= percent * union)
        .drop("overlap")
    )


def _near_sizes(a: str, b: str, percent: int):
    """Sizes that allow a link."""
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def link_classes(df: DataFrame, key: str, text: str, percent: int = 80):
    """Classes of equal sets and the links between them.

    Returns (sets, links). sets has (doc, n, id) for every row, where id is the digest of its set;
    links has pairs (a, b) of such ids that link, at least enough of them to connect every component.
    """
    order = Order(repeated_shingles(df, text))
    sets = stored(_heads(df, key, text, order, percent), "ngram-sets")
    classes = stored(
        sets.where("n > 0")
        .groupBy("id", "check", "n", "last")
        .agg(F.min("doc").alias("doc"), F.count("*").alias("copies")),
        "ngram-classes",
    )
    texts = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    source = Source(texts, classes, order)
    # Shingles that head several rows; copies are folded after the rest has gone.
    heads = sets.select("id", F.explode("head").alias("shingle"))
    several = heads.groupBy("shingle").agg(F.count("*").alias("rows")).where("rows > 1")
    several = stored(several.select("shingle"), "ngram-shingles")
    rows = _few(heads, "shingle", several).join(several, "shingle", "left_semi").distinct()
    rows = stored(rows, "ngram-rows")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("classes")).where("classes > 1")
    rows = stored(
        rows.join(shared, "shingle").join(classes.select("id", "n", "last", "copies"), "id"),
        "ngram-shared",
    )
    small = _small_pairs(rows, percent)
    many = rows.where(F.col("classes") > SMALL)
    best = F.struct("copies", (-F.col("n")).alias("size"), "id")
    hubs = many.groupBy("shingle").agg(F.max(best).alias("hub"))
    stars = (
        many.join(hubs, "shingle")
        .select(
            F.col("hub.id").alias("a"),
            F.col("id").alias("b"),
            (-F.col("hub.size")).alias("n_a"),
            F.col("n").alias("n_b"),
            F.lit(True).alias("star"),
        )
        .where("a <> b")
    )
    pairs = small.withColumn("star", F.lit(False)).unionByName(
        stars.withColumn("shared", F.lit(0).cast("bigint"))
    )
    pairs = pairs.groupBy("a", "b", "n_a", "n_b").agg(
        F.max("star").alias("star"), F.max("shared").alias("shared")
    )
    pairs = stored(pairs, "ngram-pairs")
    # First the hubs and one partner of each class; what they connect needs no other pair.
    best = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    ranked = pairs.withColumn("place", F.when(~F.col("star"), F.row_number().over(best)))
    ranked = stored(ranked, "ngram-ranked")
    early = ranked.where("star or place = 1").select("a", "b", "n_a", "n_b", "star")
    found = stored(_links(early, source, percent), "ngram-found")
    again = _second_pairs(found.where("star"), source, percent)
    late = ranked.where("not star and place > 1").select("a", "b", "n_a", "n_b")
    rest = stored(again.union(late).distinct(), "ngram-again")
    linked = found.where("linked").select("a", "b")
    rest = _apart(rest, components(linked))
    more = _links(stored(rest, "ngram-rest"), source, percent)
    links = stored(linked.union(more.where("linked").select("a", "b")), "ngram-links")
    return sets.select("doc", "n", "id"), links


def _small_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b, shared): pairs that share a small shingle and may have overlap enough.

    Say the first shingles of a end before those of b. What a and b share up to there are first
    shingles of both; beyond there a has only its n - (number of first shingles) others. So the
    overlap is at most the shared first shingles plus those; of first shingles with large groups,
    which are not expanded here, no more can be shared than either has.
    """
    large = rows.groupBy("id").agg(F.count_if(F.col("classes") > SMALL).alias("large"))
    few = rows.where(F.col("classes") <= SMALL).join(large, "id")
    few = few.select("shingle", *[F.col(c) for c in ("id", "n", "last", "large")])
    one = few.select("shingle", F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "last", "large")])
    two = few.select("shingle", F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "last", "large")])
    near = one.join(two, "shingle").where(
        (F.col("a") < F.col("b")) & _near_sizes("n_a", "n_b", percent)
    )
    n = F.when(F.col("last_a") < F.col("last_b"), F.col("n_a")).otherwise(F.col("n_b"))
    rest = F.ceil(percent * n / 100) - 1
    same = F.col("last_a") == F.col("last_b")
    rest = F.when(same, F.ceil(percent * F.greatest("n_a", "n_b") / 100) - 1).otherwise(rest)
    most = F.col("shared") + F.least("large_a", "large_b") + rest
    facts = ["a", "b", "n_a", "n_b", "last_a", "last_b", "large_a", "large_b"]
    return (
        near.groupBy(*facts)
        .agg(F.count("*").alias("shared"))
        .where((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))
        .select("a", "b", "n_a", "n_b", "shared")
    )


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not connected yet."""
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("label_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("label_b"))
    known = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    apart = F.coalesce(F.col("label_a") != F.col("label_b"), F.lit(True))
    return known.where(apart).drop("label_a", "label_b")


def _second_pairs(starred: DataFrame, source: Source, percent: int) -> DataFrame:
    """Pairs that share a hub, do not both link with it and may still link with each other."""
    open_hubs = starred.where("not linked").select("a").distinct()
    rows = starred.join(open_hubs, "a", "left_semi").select(
        F.col("a").alias("hub"),
        F.col("b").alias("id"),
        F.col("n_a").alias("n_hub"),
        F.col("n_b").alias("n"),
        "common",
        "linked",
    )
    rows = stored(rows, "ngram-open")
    # The first shingles outside the hub, in the global order: fragment by fragment.
    pairs = rows.select(F.col("hub").alias("a"), F.col("id").alias("b"))
    none = F.array().cast("array<bigint>")
    outside = (
        _meet(pairs, source)
        .select(
            F.col("a").alias("hub"),
            F.col("b").alias("id"),
            F.array_except("part_b", F.coalesce("part_a", none)).alias("rest"),
        )
        .groupBy("hub", "id")
        .agg(F.array_distinct(F.flatten(F.collect_list("rest"))).alias("rest"))
        .join(rows.select("hub", "id", "n", "linked"), ["hub", "id"])
    )
    head = _first_in_order(outside, source.order, percent)
    one = head.select("hub", "shingle", F.col("id").alias("a"), F.col("n").alias("n_a"),
                      F.col("linked").alias("linked_a"))
    two = head.select("hub", "shingle", F.col("id").alias("b"), F.col("n").alias("n_b"),
                      F.col("linked").alias("linked_b"))
    sharing = one.join(two, ["hub", "shingle"]).where(
        (F.col("a") < F.col("b"))
        & ~(F.col("linked_a") & F.col("linked_b"))
        & _near_sizes("n_a", "n_b", percent)
    )
    short = rows.where("n < n_hub").select(
        "hub", F.col("id").alias("s"), F.col("n").alias("n_s"), F.col("common").alias("c_s")
    )
    loose = rows.where("not linked").select(
        "hub", F.col("id").alias("r"), F.col("n").alias("n_r"), F.col("common").alias("c_r")
    )
    room = F.least("c_s", "c_r") + F.least(F.col("n_s") - F.col("c_s"), F.col("n_r") - F.col("c_r"))
    shorter = short.join(loose, "hub").where(
        (F.col("s") != F.col("r"))
        & _near_sizes("n_s", "n_r", percent)
        & ((100 + percent) * room >= percent * (F.col("n_s") + F.col("n_r")))
    )
    first = F.col("s") < F.col("r")
    shorter = shorter.select(
        F.least("s", "r").alias("a"),
        F.greatest("s", "r").alias("b"),
        F.when(first, F.col("n_s")).otherwise(F.col("n_r")).alias("n_a"),
        F.when(first, F.col("n_r")).otherwise(F.col("n_s")).alias("n_b"),
    )
    return sharing.select("a", "b", "n_a", "n_b").union(shorter).distinct()


def _first_in_order(rows: DataFrame, order: Order, percent: int) -> DataFrame:
    """(hub, id, n, linked, shingle): the head of each ``rest``, as long as that of the whole set."""
    shared = rows.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rest = batch.column("rest")
            sizes = pa.compute.list_value_length(rest).to_numpy(zero_copy_only=False)
            shingle = rest.flatten().to_numpy(zero_copy_only=False).view(_U)
            of = np.repeat(np.arange(len(sizes)), sizes)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            heads = n - -(-percent * n // 100) + 1
            by_key = np.lexsort((own.keys(shingle), of))
            place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            taken = place < heads[of]
            rows_of = pa.array(of[taken])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(rows_of) for c in ("hub", "id", "n", "linked")),
                    pa.array(shingle[by_key][taken].view(np.int64)),
                ],
                names=["hub", "id", "n", "linked", "shingle"],
            )

    return rows.mapInArrow(
        run, "hub bigint, id bigint, n bigint, linked boolean, shingle bigint"
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node can reach.

    Every round takes the smallest label of the neighbours and then the label of that label, so
    long chains halve.
    """
    edges = stored(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges"
    )
    labels = stored(
        edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")),
        "labels",
    )
    while True:
        near = (
            edges.join(labels, edges.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", "label", F.least("label", "near").alias("new")
        )
        over = labels.select(F.col("node").alias("new"), F.col("label").alias("over"))
        moved = stored(
            lower.join(over, "new").select("node", "label", F.least("new", "over").alias("new")),
            "labels",
        )
        changed = moved.where("new <> label").limit(1).count()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def join(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``df``.

    A row without an id has no component; one with an empty set is a component of its own.
    """
    sets, links = link_classes(df.select(key, text), key, text, percent)
    labels = components(links)
    named = sets.join(labels, (F.col("id") == F.col("node")) & (F.col("n") > 0), "left")
    label = F.when(F.col("n") > 0, F.coalesce("component", "id"))
    named = stored(named.select("doc", "n", label.alias("label")), "ngram-named")
    smallest = named.groupBy(F.col("label").alias("of")).agg(F.min("doc").alias("smallest"))
    return named.join(smallest, F.col("label") == F.col("of"), "left").select(
        F.col("doc").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("smallest", "doc")).alias("component_id"),
    )
