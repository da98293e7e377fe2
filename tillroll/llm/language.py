"""Language shares of a text by a mixture over byte trigrams.

Each language is a multinomial over hashed byte trigrams of lower-cased words, counted over all
training texts. A document is a mixture of languages: expectation-maximisation estimates the
shares from the trigram likelihoods. The languages are taken in the order of their shares while
each further one raises the log-likelihood by more than a penalty.

Edge cases: a text that is null or has no letter is ``und`` with score 0 and no shares, and so is
every text when nothing was learned; training rows with a null text or language are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 15
MAX_LANGUAGES = 512
UNKNOWN = "und"
ROUNDS = 12
#: Documents whose trigrams are held at once.
BLOCK_TRIGRAMS = 400_000

# Bytes that are kept: ASCII lower-case letters and all parts of other characters.
_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass
class LanguageModel:
    """Log-probabilities of the trigram buckets, one column per language."""

    names: list[str]
    log_p: np.ndarray  # (BUCKETS, languages)
    penalty: float


def trigrams(text: str) -> np.ndarray:
    """Bucket of every trigram of the padded, lower-cased words; empty without letters."""
    if not any(map(str.isalpha, text)):
        return np.zeros(0, np.int64)
    words = text.lower().encode().translate(_KEEP).split()
    codes = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    packed = codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]
    return ((packed * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", penalty: float = 3.0):
    """Count trigrams per language over all rows of ``df``; returns a ``LanguageModel``.

    Counts leave a task as at most languages x BUCKETS rows; so many rows reach the driver.
    ``penalty`` multiplies half the log of the document's trigrams; overlapping trigrams carry
    each letter three times, hence 3.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    names = [r.lang for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names.sort()
    place = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[place[name]] += np.bincount(trigrams(value), minlength=BUCKETS)
        at, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(bucket, pa.int64()), pa.array(seen[at, bucket])],
            names=["at", "bucket", "n"],
        )

    parts = rows.mapInArrow(count, "at bigint, bucket bigint, n bigint")
    totals = parts.groupBy("at", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(names), BUCKETS), 0.5)
    counts[totals["at"], totals["bucket"]] += totals["n"]
    log_p = np.log(counts / counts.sum(axis=1, keepdims=True)).T
    return LanguageModel(names, np.ascontiguousarray(log_p), penalty)


def _mixture(p: np.ndarray, n: np.ndarray, first: np.ndarray, doc: np.ndarray, share: np.ndarray):
    """EM from the given shares; returns shares and log-likelihood per document."""
    total = np.add.reduceat(n, first)
    for _ in range(ROUNDS):
        joint = p * share[doc]
        joint *= (n / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
        share = np.add.reduceat(joint, first, axis=0) / total[:, None]
    mixed = (p * share[doc]).sum(axis=1)
    return share, np.add.reduceat(n * np.log(np.maximum(mixed, 1e-300)), first)


def shares(found: list[np.ndarray], model: LanguageModel) -> np.ndarray:
    """Language shares of documents given by their trigrams; languages not chosen have 0."""
    pairs = [np.unique(f, return_counts=True) for f in found]
    sizes = np.array([len(b) for b, _ in pairs])
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(pairs)), sizes)
    n = np.concatenate([c for _, c in pairs]).astype(float)
    log_p = model.log_p[np.concatenate([b for b, _ in pairs])]
    top = log_p.max(axis=1)
    p = np.exp(log_p - top[:, None])  # a factor per trigram leaves the shares as they are
    size = len(model.names)
    full, full_fit = _mixture(p, n, first, doc, np.full((len(pairs), size), 1.0 / size))
    order = np.argsort(-full, axis=1, kind="stable")
    price = model.penalty * 0.5 * np.log(np.add.reduceat(n, first) + 1)
    rows = np.arange(len(pairs))
    best = np.zeros_like(full)
    best[rows, order[:, 0]] = 1.0
    one = np.log(np.maximum(p[np.arange(len(doc)), order[doc, 0]], 1e-300))
    best_fit = np.add.reduceat(n * one, first)
    # A larger set fits no better than all languages together, so most documents stop here.
    open_docs = rows[full_fit - best_fit > price]
    for count in range(2, size + 1):
        if not len(open_docs):
            break
        picked = np.isin(doc, open_docs)
        start = np.zeros((len(open_docs), size))
        chosen = order[open_docs, :count]
        np.put_along_axis(start, chosen, 1.0 / count, axis=1)
        own = np.searchsorted(open_docs, doc[picked])
        begins = np.searchsorted(own, np.arange(len(open_docs)))
        share, fit_now = _mixture(p[picked], n[picked], begins, own, start)
        better = fit_now - best_fit[open_docs] > price[open_docs]
        best[open_docs[better]], best_fit[open_docs[better]] = share[better], fit_now[better]
        open_docs = open_docs[better]
    return best


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (its share) and ``lang_shares`` of all found."""
    added = ["lang_pred", "score", "lang_shares"]
    kept = [c for c in df.columns if c not in added]
    shared = df.sparkSession.sparkContext.broadcast(model)
    share_type = pa.map_(pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            values = batch.column(text).to_pylist()
            out: list[tuple] = []
            waiting, size = [], 0
            for i, value in enumerate(values):
                found = trigrams(value) if value and own.names else np.zeros(0, np.int64)
                out.append((UNKNOWN, 0.0, []))
                if len(found):
                    waiting.append((i, found))
                    size += len(found)
                if waiting and (size > BLOCK_TRIGRAMS or i + 1 == len(values)):
                    for (j, _), row in zip(waiting, shares([f for _, f in waiting], own)):
                        pairs = [(own.names[k], float(row[k])) for k in np.argsort(-row) if row[k]]
                        out[j] = (*pairs[0], pairs)
                    waiting, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array([o[0] for o in out], pa.string()),
                    pa.array([min(1.0, o[1]) for o in out], pa.float64()),
                    pa.array([o[2] for o in out], share_type),
                ],
                names=[*kept, *added],
            )

    schema = T.StructType(
        [
            *(df.schema[c] for c in kept),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("lang_shares", T.MapType(T.StringType(), T.DoubleType())),
        ]
    )
    return df.mapInArrow(run, schema)
