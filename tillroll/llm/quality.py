"""Document quality as an ordinal regression on graded ratings.

A cumulative-link model: P(grade <= k) = sigmoid(threshold_k - score), with one score per text
from weights shared by all grades and ordered thresholds. The score is a sum of weights of hashed
text features: the distinct words, and binned shares of word shapes, of repeated neighbours and of
distinct words. The expected grade and the probability of a high grade follow from it.

Rated texts are folded first: equal texts with one grade are one fitted row, however many copies
there are, and only hashes and ids travel for that. At most ``max_rows`` of them are fitted, those
with the smallest hashes; their texts alone are read again and shuffled. The weights are fitted by
L-BFGS. Every step is one Spark job over the stored features of the fitted rows: the weights go
out as a broadcast that is destroyed after the step, and the gradient comes back in blocks that
Spark sums.

Edge cases: a null text is an empty one and has its features; documents without a rating and
ratings without a document are not fitted; of rows with one id and different texts all get its
rating; of an id's ratings the lowest counts; without any rated row all weights are 0 and all
grades equally likely.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import give_back, stored

FEATURE_BITS = 20
FEATURES = 1 << FEATURE_BITS
#: Features of fewer fitted rows have no weight.
MIN_ROWS = 5
MEMO_ENTRIES = 100_000
#: Weights of a gradient that travel together.
BLOCK = 1 << 15

_SHARES = (0.0, 0.01, 0.03, 0.1, 0.2, 0.4, 0.7)
_MARKS = b".,;:!?\"'()[]"


@dataclass
class QualityModel:
    places: np.ndarray  # features with a weight
    weights: np.ndarray
    thresholds: np.ndarray  # ordered, one fewer than grades

    def dense(self) -> np.ndarray:
        """Weights of all features; models travel without the zeros."""
        out = np.zeros(FEATURES)
        out[self.places] = self.weights
        return out

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade, one row per score."""
        below = 1.0 / (1.0 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))
        edges = np.hstack([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))])
        return np.diff(edges, axis=1)


class FeatureHasher:
    """Hashed features of texts; remembers words between texts."""

    def __init__(self) -> None:
        self.words: dict[bytes, tuple[int, bytes]] = {}

    @staticmethod
    def _bucket(name: bytes) -> int:
        return xxhash.xxh64_intdigest(name) >> (64 - FEATURE_BITS)

    def _word(self, word: bytes) -> tuple[int, bytes]:
        found = self.words.get(word)
        if found is None:
            core = word.lower().strip(_MARKS)
            shape = re.sub(rb"[a-z\x80-\xff]+", b"a", word)
            shape = re.sub(rb"[A-Z]+", b"A", shape)
            shape = re.sub(rb"[0-9]+", b"0", shape)
            found = self.words[word] = (self._bucket(b"w" + core) if core else -1, shape)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.words) > MEMO_ENTRIES:
            self.words.clear()
        words = (text or "").encode().split()
        counts = Counter(words)
        found = [self._word(w) for w in counts]
        buckets = {b for b, _ in found}
        buckets.discard(-1)
        total = max(1, len(words))
        shapes: Counter = Counter()
        for (_, shape), n in zip(found, counts.values()):
            shapes[shape] += n
        facts = {b"s" + shape: n / total for shape, n in shapes.items()}
        facts[b"repeated"] = sum(map(eq, words, words[1:])) / total
        facts[b"distinct"] = len(counts) / total
        for name, share in facts.items():
            level = sum(share > s for s in _SHARES)
            buckets.add(self._bucket(b"%b/%d" % (name, level)))
        length = len(words).bit_length()
        buckets.add(self._bucket(b"length/%d" % length))
        return np.fromiter(buckets, np.int64, len(buckets))


def _features(rows: DataFrame) -> DataFrame:
    """Grade and feature list of each row (grade, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what an earlier stage left in this worker
        hasher = FeatureHasher()
        for batch in batches:
            lists = [np.sort(hasher(t.as_py())).astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["grade", "at"]
            )
        del hasher
        give_back()

    return rows.select("grade", "text").mapInArrow(run, "grade int, at array<int>")


def fitted_rows(documents: DataFrame, ratings: DataFrame, max_rows: int) -> DataFrame:
    """grade, text: distinct rated texts, the ``max_rows`` with the smallest hashes.

    ``documents`` has (key, text), ``ratings`` (key, grade). Texts are compared by two 64-bit hashes.
    """
    text = F.coalesce("text", F.lit(""))
    hashes = [F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("h2")]
    rated = ratings.where("key is not null and grade is not null")
    rated = rated.groupBy("key").agg(F.min("grade").cast("int").alias("grade"))
    folded = (
        documents.select("key", *hashes)
        .join(rated, "key")
        .groupBy("h", "h2", "grade")
        .agg(F.min("key").alias("key"))
    )
    # A small table by now: it is counted, thinned to a little over the bound, then cut exactly.
    folded = stored(folded, "quality-rated")
    total = folded.count()
    order = F.xxhash64("h", "h2", "grade")
    if total > max_rows:
        share = min(1.0, (max_rows + 10 * max_rows**0.5) / total)
        near = folded.where(F.pmod(order, F.lit(1 << 32)) < int(share * (1 << 32)))
        folded = near.orderBy(F.pmod(order, F.lit(1 << 32)), "h", "h2", "grade").limit(max_rows)
    chosen = F.broadcast(folded)  # max_rows rows of 36 bytes at most
    return (
        documents.select("key", text.alias("text"), *hashes)
        .join(chosen, ["key", "h", "h2"])
        .groupBy("h", "h2", "grade")
        .agg(F.min("text").alias("text"))
        .select("grade", "text")
    )


def _listed(rows: DataFrame, places: np.ndarray) -> DataFrame:
    """``rows`` with positions in ``places`` instead of features; the others are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(FEATURES, -1, np.int32)
        number[shared.value] = np.arange(len(shared.value))
        for batch in batches:
            lists = batch.column("at")
            at = number[lists.flatten().to_numpy(zero_copy_only=False)]
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            kept = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[at >= 0], minlength=len(sizes))
            offsets = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[at >= 0]))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), found], names=["grade", "at"])

    return rows.mapInArrow(run, "grade int, at array<int>")


def _loss_rows(shared: Broadcast):
    """Loss and gradient over the rows of a task, in blocks (block, sums).

    They are the weights' slopes, then those of the thresholds, then the loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        listed, steps = len(weights), len(thresholds)
        out = np.zeros(listed + steps + 1)
        cuts = np.concatenate([[-np.inf], thresholds, [np.inf]])
        for batch in batches:
            lists = batch.column("at")
            at = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            grade = batch.column("grade").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(grade)), sizes)
            scores = np.bincount(row, weights[at], minlength=len(grade))
            high = _sigmoid(cuts[grade + 1] - scores)
            low = _sigmoid(cuts[grade] - scores)
            p = np.maximum(high - low, 1e-12)
            slope_high, slope_low = high * (1 - high) / p, low * (1 - low) / p
            out[-1] -= np.log(p).sum()
            out[:listed] += np.bincount(at, (slope_high - slope_low)[row], minlength=listed)
            for k in range(steps):
                out[listed + k] -= slope_high[grade == k].sum() - slope_low[grade == k + 1].sum()
        blocks = [out[i : i + BLOCK].tobytes() for i in range(0, len(out), BLOCK)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())],
            names=["block", "sums"],
        )

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sum of one block over all tasks."""
    sums = sum(np.frombuffer(b) for b in table.column("sums").to_pylist())
    return pa.table(
        {"block": table.column("block").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())}
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _ordered(raw: np.ndarray) -> np.ndarray:
    """Thresholds from a first value and logs of the gaps."""
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(raw[1:], -20, 20)))])


def fit(
    documents: DataFrame,
    ratings: DataFrame,
    grades: int,
    key: str = "doc_id",
    text: str = "text",
    grade: str = "grade",
    max_rows: int = 20_000,
    rounds: int = 25,
    ridge: float = 1.0,
) -> QualityModel:
    """Fit on the documents that ``ratings`` gives a grade 0 ... grades - 1.

    ``max_rows`` bounds the fitted rows, whatever the number of copies.
    """
    chosen = fitted_rows(
        documents.select(F.col(key).alias("key"), F.col(text).alias("text")),
        ratings.select(F.col(key).alias("key"), F.col(grade).alias("grade")),
        max_rows,
    )
    rows = stored(_features(chosen), "quality-features")
    sums = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    if not sums:
        return QualityModel(np.zeros(0, np.int64), np.zeros(0), np.arange(grades - 1, dtype=float))
    if min(sums) < 0 or max(sums) >= grades:
        raise ValueError("a grade is out of range")
    used = (
        rows.select(F.explode("at").alias("at"))
        .groupBy("at")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= MIN_ROWS)
        .select("at")
        .toArrow()
    )
    places = np.sort(used.column("at").to_numpy().astype(np.int64))
    n = sum(sums.values())
    rows = stored(_listed(rows, places), "quality-listed")
    spark = rows.sparkSession

    def spread(x: np.ndarray) -> QualityModel:
        return QualityModel(places, x[: len(places)], _ordered(x[len(places) :]))

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, raw = x[: len(places)], x[len(places) :]
        shared = spark.sparkContext.broadcast((w, _ordered(raw)))
        parts = rows.mapInArrow(_loss_rows(shared), "block int, sums binary")
        found = parts.groupBy("block").applyInArrow(_added, "block int, sums binary").toArrow()
        shared.destroy()
        found = found.sort_by("block").column("sums").to_pylist()
        full = np.concatenate([np.frombuffer(b) for b in found])
        gaps = np.exp(np.clip(raw[1:], -20, 20))
        by_cut = full[len(places) : -1]
        later = np.cumsum(by_cut[::-1])[::-1]
        by_raw = np.concatenate([[later[0]], later[1:] * gaps])
        loss = full[-1] + 0.5 * ridge * (w @ w)
        return loss / n, np.concatenate([full[: len(places)] + ridge * w, by_raw]) / n

    share = np.array([sums.get(g, 0) + 0.5 for g in range(grades)])
    below = np.cumsum(share)[:-1] / share.sum()
    cuts = np.log(below / (1 - below))
    start = np.concatenate([np.zeros(len(places)), cuts[:1], np.log(np.diff(cuts))])
    return spread(_descend(evaluate, start, rounds))


def _descend(evaluate, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with halving steps."""
    loss, slope = evaluate(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, factors = -slope, []
        for s, y in reversed(moves):
            a = (s @ step) / (s @ y)
            factors.append(a)
            step = step - a * y
        if moves:
            s, y = moves[-1]
            step = step * ((s @ y) / (y @ y))
        for (s, y), a in zip(moves, reversed(factors)):
            step = step + (a - (y @ step) / (s @ y)) * s
        if not moves:
            step = step / max(1e-12, np.abs(step).max())
        if slope @ step >= 0:
            break
        length = 1.0
        while length > 1e-3:
            new_loss, new_slope = evaluate(x + length * step)
            if new_loss <= loss + 1e-4 * length * (slope @ step):
                break
            length /= 3
        else:
            break
        s, y = length * step, new_slope - slope
        if s @ y > 1e-12:
            moves = [*moves[1 - memory :], (s, y)]
        done = loss - new_loss < 1e-5 * abs(loss)
        x, loss, slope = x + s, new_loss, new_slope
        if done:
            break
    return x


def score(df: DataFrame, model: QualityModel, text: str = "text", tail: int = 1) -> DataFrame:
    """``df`` with ``expected_grade`` and ``tail_probability``: that the grade is ``tail`` or more."""
    added = ["expected_grade", "tail_probability"]
    kept = [c for c in df.columns if c not in added]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own, hasher = shared.value, FeatureHasher()
        weights = own.dense()
        for batch in batches:
            scores = np.array([weights[hasher(t.as_py())].sum() for t in batch.column(text)])
            p = own.probabilities(scores)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array(p @ np.arange(p.shape[1]), pa.float64()),
                    pa.array(p[:, tail:].sum(axis=1), pa.float64()),
                ],
                names=[*kept, *added],
            )
        del hasher, weights
        give_back()

    fields = [T.StructField(c, T.DoubleType()) for c in added]
    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), *fields]))
