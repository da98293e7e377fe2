"""Spelling variants: words one edit apart, grouped under their far commoner neighbour.

The vocabulary is put into blocked Bloom filters, one shard per word length; a word sets all its
bits in one 64-bit block of its shard. The filters are broadcast, and every word probes its edits
against the shard of the edit's length. Only positives are shuffled: the exact join with the
vocabulary removes what the filter let through by mistake. A filter never misses a word, so no
pair is lost.

A pair of neighbours is found from one side only: the longer word deletes a letter (the first one
of a run of equal letters, as the others give the same word), and of two words of one length the
one with the rarer letter replaces it by the commoner one. Letters are ordered by their count in
the vocabulary, so that few replacements are left to try. Hashes of edits come from the word's own
hash, whatever its length.

The broadcast has a proven size: a filter has BITS bits per word, and a vocabulary that would need
more than FILTER_BYTES is cut by hash into parts, each of which is one filter and one pass of all
words over it.

Edge cases: null and empty texts have no words; without an id no letter of a run is deleted; rows
with equal ids and texts count each; ties go to the word that is smaller in code-point order;
letters outside of A-Z, a-z and U+00C0 to U+00FF part words; runs of any length are whole words;
an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import stored

BITS = 20
#: Bits that a word sets in its block.
SET_BITS = 5
FILTER_BYTES = 32 << 20
#: A task sends its counts on when it holds so many words.
HELD_WORDS = 400_000
#: Edits probed at once.
PROBES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ONE = np.uint64(1)

#: Latin-1 bytes: A-Z in lower case, letters as they are, all else a space.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256)
)


def runs_of(text: str | None) -> list[bytes]:
    """The letter runs of a text, one Latin-1 byte per code point."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def count_words(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shortest: int = 6,
    least: int = 5,
    lose_one_in: int = 199,
) -> DataFrame:
    """word, n: the words of at least ``shortest`` letters that occur ``least`` times or more.

    A run whose hash with its row's key is divisible by ``lose_one_in`` loses one letter first.
    """

    def sent(counts: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays(
            [words, pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for start, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                if start is not None:
                    start = zlib.crc32(f"{start}:".encode())
                for word, n in Counter(runs_of(whole.as_py())).items():
                    if len(word) < shortest:
                        continue
                    if start is not None:
                        utf8 = word if word.isascii() else word.decode("latin-1").encode()
                        h = zlib.crc32(utf8, start)
                        if not h % lose_one_in:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield sent(held)
                    held = {}
        yield sent(held)

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    counts = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least)


# ---- filters ---------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _letters(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def _by_length(words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Words of one length at a time, few enough that their edits fit into PROBES."""
    groups: dict[int, list[bytes]] = {}
    for word in words:
        groups.setdefault(len(word), []).append(word)
    for length, group in groups.items():
        step = max(1, PROBES // (length * 16))
        for start in range(0, len(group), step):
            yield length, group[start : start + step]


def _mask(mixed: np.ndarray) -> np.ndarray:
    """The bits of a word inside its block."""
    mask = np.zeros(len(mixed), np.uint64)
    for i in range(SET_BITS):
        mask |= _ONE << ((mixed >> np.uint64(6 * i)) & np.uint64(63))
    return mask


@dataclass
class Filters:
    """The shards of one part of the vocabulary, laid behind each other."""

    first: dict[int, int]  # first block of a length's shard
    size: dict[int, int]
    blocks: np.ndarray
    order: np.ndarray  # letters, the commonest first
    part: int
    parts: int

    def place(self, length: int, mixed: np.ndarray) -> np.ndarray:
        high = (mixed >> np.uint64(32)) * np.uint64(self.size[length]) >> np.uint64(32)
        return high.astype(np.int64) + self.first[length]

    def holds(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Whether words of that length may be in the vocabulary."""
        mixed = _mixed(hashes)
        mask = _mask(mixed)
        return self.blocks[self.place(length, mixed)] & mask == mask

    def own(self, hashes: np.ndarray) -> np.ndarray:
        """Words of this part."""
        return _mixed(~hashes) % np.uint64(self.parts) == self.part


def _layout(vocabulary: DataFrame) -> tuple[list[Filters], np.ndarray]:
    """Empty filters for every part."""
    sizes = vocabulary.groupBy(F.char_length("word").alias("length")).count().orderBy("length")
    lengths = {r["length"]: r["count"] for r in sizes.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(256, np.int64)
        for batch in batches:
            text = "".join(batch.column(0).to_pylist()).encode("latin-1")
            seen += np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["letter", "n"])

    letters = vocabulary.select("word").mapInArrow(run, "letter bigint, n bigint")
    letters = letters.groupBy("letter").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter")
    order = np.array([r.letter for r in letters.collect()], np.uint8)
    parts = max(1, -(-sum(lengths.values()) * BITS // (8 * FILTER_BYTES)))
    first, size, total = {}, {}, 0
    for length, n in lengths.items():
        first[length], size[length] = total, -(-n * BITS // (64 * parts))
        total += size[length]
    return [Filters(first, size, np.zeros(total, np.uint64), order, p, parts) for p in range(parts)]


def _fill(vocabulary: DataFrame, filters: Filters) -> None:
    """Set the bits of a part's words: tasks hash, Spark joins the bits of a block."""
    layout = Filters(**{**vars(filters), "blocks": None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for length, group in _by_length(words):
                letters = _letters(group, length).astype(np.uint64) + _ONE
                hashes = (letters * _powers(length)).sum(axis=1, dtype=np.uint64)
                mixed = _mixed(hashes[layout.own(hashes)])
                places = pa.array(layout.place(length, mixed))
                bits = pa.array(_mask(mixed).view(np.int64))
                yield pa.RecordBatch.from_arrays([places, bits], names=["place", "bits"])

    found = (
        vocabulary.select("word")
        .mapInArrow(run, "place bigint, bits bigint")
        .groupBy("place")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    places = found["place"].to_numpy()
    filters.blocks[places] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)


def edits(words: list[bytes], filters: Filters) -> Iterator[tuple[bytes, bytes]]:
    """(word, edit) for the edits that may be words of the filters' part."""
    for length, group in _by_length(words):
        letters = _letters(group, length)
        powers = _powers(length + 1)
        terms = (letters.astype(np.uint64) + _ONE) * powers[:length]
        upto = np.cumsum(terms, axis=1, dtype=np.uint64)
        whole = upto[:, -1]
        if length - 1 in filters.size:
            fresh = np.ones(letters.shape, bool)
            fresh[:, 1:] = letters[:, 1:] != letters[:, :-1]
            at, place = np.nonzero(fresh)
            before = upto[at, place] - terms[at, place]
            hashes = before + (whole[at] - upto[at, place]) * _INVERSE
            hit = filters.holds(length - 1, hashes) & filters.own(hashes)
            for i, j in zip(at[hit].tolist(), place[hit].tolist()):
                yield group[i], group[i][:j] + group[i][j + 1 :]
        if length not in filters.size:
            continue
        rank = np.zeros(256, np.int64)
        rank[filters.order] = np.arange(len(filters.order))
        ranks = rank[letters].ravel()
        # One slice of places at a time, so that the edits of a very long word stay few.
        ends = np.cumsum(ranks)
        start = 0
        while start < len(ranks):
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + PROBES, "right")))
            flat = np.repeat(np.arange(start, end), ranks[start:end])
            new = np.arange(len(flat)) - np.repeat(ends[start:end] - ranks[start:end] - done, ranks[start:end])
            at, place = np.divmod(flat, length)
            letter = filters.order[new]
            old = letters[at, place].astype(np.uint64)
            hashes = whole[at] + (letter.astype(np.uint64) - old) * powers[place]
            hit = filters.holds(length, hashes) & filters.own(hashes)
            for i, j, c in zip(at[hit].tolist(), place[hit].tolist(), letter[hit].tolist()):
                yield group[i], group[i][:j] + bytes([c]) + group[i][j + 1 :]
            start = end


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Pairs of vocabulary words one edit apart, each once: word, n, near, near_n."""
    spark = vocabulary.sparkSession
    found = None
    for filters in _layout(vocabulary):
        _fill(vocabulary, filters)
        shared = spark.sparkContext.broadcast(filters)

        def run(
            batches: Iterator[pa.RecordBatch], shared=shared
        ) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
                count = dict(zip(words, batch.column(1).to_pylist()))
                pairs = list(edits(words, own))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a.decode("latin-1") for a, _ in pairs], pa.string()),
                        pa.array([count[a] for a, _ in pairs], pa.int64()),
                        pa.array([b.decode("latin-1") for _, b in pairs], pa.string()),
                    ],
                    names=["word", "n", "near"],
                )

        part = vocabulary.select("word", "n").mapInArrow(run, "word string, n bigint, near string")
        found = part if found is None else found.unionByName(part)
    exact = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(exact, "near").select("word", "n", "near", "near_n")


# ---- groups ----------------------------------------------------------------------------------


def group(vocabulary: DataFrame, factor: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of a vocabulary (word, n).

    ``form`` is the commonest word one edit away, if it is ``factor`` times as common or more;
    ``root`` is the end of the chain of forms. As counts grow by that factor with each form, a
    chain has at most log(2^63) / log(factor) of them; their ends are found by doubling.
    """
    vocabulary = stored(vocabulary, "spelling-words")
    pairs = stored(near_words(vocabulary), "spelling-pairs")
    other = pairs.select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"),
        F.col("n").alias("near_n"),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    chosen = (
        pairs.unionByName(other)
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), best.alias("best"))
    )
    common = -F.col("best.less") >= F.col("n") * factor
    forms = vocabulary.join(chosen, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(common, F.col("best.near")).alias("form"),
        F.when(common, -F.col("best.less")).alias("form_n"),
    )
    forms = stored(forms, "spelling-forms")
    ends = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = stored(ends.join(onward, "root", "left"), "spelling-roots")
        moved = ends.where("next is not null").limit(1).count()
        ends = ends.select("word", F.coalesce("next", "root").alias("root"))
        if not moved:
            break
    return forms.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
