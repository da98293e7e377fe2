"""Byte-level BPE with a two-tier lookup.

Each match of the split pattern is looked up as a whole in a minimal perfect hash over the
vocabulary. What is not in it is merged from its bytes: a linked list of parts and a heap of
neighbouring pairs by (rank, place), O(n log n) for a match of n bytes.

The vocabulary is read by the driver and broadcast; its size is checked against
``MAX_VOCABULARY``. Edge cases: a null text is an empty text and has no ids; ids of a null list
decode to no bytes; a column that already has the output's name is replaced.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillroll.llm.common import give_back

MAX_VOCABULARY = 1_000_000
_ID_BITS = 20
#: Texts are handed on after so many characters.
CHUNK_CHARS = 2_000_000
#: Pre-tokens remembered by one worker process.
MEMO_ENTRIES = 400_000
#: The same for encoding and decoding in one worker, which holds the state of both.
ROUND_TRIP_CHARS = 250_000
ROUND_TRIP_ENTRIES = 150_000


class PerfectHash:
    """Minimal perfect hash: each level keeps the keys that are alone in their cell.

    Keys that share a cell go on to the next level. The slot of a key is the number of set
    cells before its own. A key outside the set gets no slot or any slot, so the caller
    compares the stored key.
    """

    def __init__(self, keys: list[bytes], spread: float = 2.0):
        left = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("two keys have one hash")
        cells, self.starts = [], [0]
        while len(left):
            size = max(64, int(spread * len(left)))
            at = self._cell(left, len(cells), size)
            alone = np.bincount(at, minlength=size) == 1
            cells.append(alone)
            self.starts.append(self.starts[-1] + size)
            left = left[~alone[at]]
        self.cells = np.concatenate(cells) if cells else np.zeros(0, bool)
        self.before = np.cumsum(self.cells) - self.cells

    @staticmethod
    def _cell(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (digests ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(
            0xBF58476D1CE4E5B9
        )
        mixed ^= mixed >> np.uint64(31)
        return (mixed % np.uint64(size)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key, -1 where no level knows it."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        for level in range(len(self.starts) - 1):
            if not len(left):
                break
            size = self.starts[level + 1] - self.starts[level]
            at = self.starts[level] + self._cell(digests[left], level, size)
            hit = self.cells[at]
            found[left[hit]] = self.before[at[hit]]
            left = left[~hit]
        return found


class Vocabulary:
    """Byte strings and their ranks, with both tiers of the lookup."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if len(ranks) > MAX_VOCABULARY or max(ranks.values()) >> _ID_BITS:
            raise ValueError(f"more than {MAX_VOCABULARY} entries")
        self.ranks, self.pattern = ranks, pattern
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.memo: _Memo | None = None
        self._by_pair = self._by_bytes = self._split = self._split_ascii = None
        self.hash = PerfectHash(list(ranks))
        keys = list(ranks)
        self.key_at: list[bytes] = [b""] * len(keys)
        for key, slot in zip(keys, self.hash.slots(keys).tolist()):
            self.key_at[slot] = key
        self.id_at = [ranks[k] for k in self.key_at]

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """A rank file: one base64 token and its rank per line."""
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls({base64.b64decode(t): int(r) for t, r in pairs}, pattern)

    def ids(self, tokens: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        keys = [t.encode() for t in tokens]
        slots = self.hash.slots(keys).tolist()
        return [
            [self.id_at[s]] if s >= 0 and self.key_at[s] == k else self.merge(k)
            for k, s in zip(keys, slots)
        ]

    def _pairs(self) -> dict[int, int]:
        """Rank of every two neighbouring ids that make a token; built once per process."""
        if self._by_pair is None:
            get, found = self.ranks.get, {}
            for token, rank in self.ranks.items():
                for cut in range(1, len(token)):
                    left, right = get(token[:cut]), get(token[cut:])
                    if left is not None and right is not None:
                        found[left << _ID_BITS | right] = rank
            self._by_pair = found
            # The same for two bytes, by their values.
            self._by_bytes = [[get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        return self._by_pair

    def merge(self, token: bytes) -> list[int]:
        """Merge the bytes of ``token``, the pair of lowest rank first, the left one on ties.

        ``rank[i]`` is the rank of the pair that starts at part i, so an entry of the heap holds as
        long as it equals it.
        """
        pair, n = self._pairs().get, len(token)
        ids = [self.byte_id[b] for b in token]
        rank = [self._by_bytes[a][b] for a, b in zip(token, token[1:])]
        rank.append(-1)
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heapq.heappop(heap)
            i, merged = entry & 0xFFFFFFFF, entry >> 32
            if rank[i] != merged:
                continue
            gone = right[i]
            after, before = right[gone], left[i]
            ids[i], ids[gone], rank[gone] = merged, -1, -1
            right[i] = after
            rank[i] = -1
            if after < n:
                left[after] = i
                rank[i] = found = pair(merged << _ID_BITS | ids[after], -1)
                if found >= 0:
                    heapq.heappush(heap, found << 32 | i)
            if before >= 0:
                rank[before] = found = pair(ids[before] << _ID_BITS | merged, -1)
                if found >= 0:
                    heapq.heappush(heap, found << 32 | before)
        return [i for i in ids if i >= 0]

    def pre_tokens(self, text: str) -> list[str]:
        """Matches of the split pattern; ASCII texts take the pattern's ASCII form."""
        if self._split is None:
            self._split = regex.compile(self.pattern).findall
            self._split_ascii = re.compile(_ascii_form(self.pattern), re.ASCII).findall
        return self._split_ascii(text) if text.isascii() else self._split(text)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_by_pair": None, "_by_bytes": None, "_split": None, "_split_ascii": None, "memo": None}


def _ascii_form(pattern: str) -> str:
    """The same pattern over ASCII texts, with ranges for the letter and number properties."""
    out, inside, i = [], False, 0
    ranges = {"\\p{L}": "A-Za-z", "\\p{N}": "0-9"}
    while i < len(pattern):
        known = ranges.get(pattern[i : i + 5])
        if known:
            out.append(known if inside else f"[{known}]")
            i += 5
            continue
        if pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out.append(pattern[i])
        i += 1
    return "".join(out)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i) for i in kept), values],
        names=[*(batch.schema.names[i] for i in kept), name],
    )


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType(
        [*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)]
    )


def _chunks(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` in total size, one row at least."""
    marks = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        done = marks[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(marks, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _laid(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of runs laid end to end, given the start and size of each."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class _Memo:
    """Ids of pre-tokens in one pool; each pre-token has a number."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.bounds = array("i"), array("q", [0])

    def add(self, tokens: list[str], ids: list[list[int]]) -> None:
        self.number.update(zip(tokens, range(len(self.number), len(self.number) + len(tokens))))
        for row in ids:
            self.ids.extend(row)
            self.bounds.append(len(self.ids))

    def lay(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``tokens`` and how many each has."""
        numbers = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        # Views; they end with this call, before the pool grows again.
        bounds, ids = np.frombuffer(self.bounds, np.int64), np.frombuffer(self.ids, np.int32)
        sizes = bounds[numbers + 1] - bounds[numbers]
        return ids[_laid(bounds[numbers], sizes)], sizes


def _encoder(shared, text: str, out: str, chars: int, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pa.compute.utf8_length(batch.column(text)).fill_null(0)
            for part in _chunks(batch, lengths.to_numpy(), chars):
                texts = [own.pre_tokens(t) if t else [] for t in part.column(text).to_pylist()]
                tokens = list(chain.from_iterable(texts))
                if own.memo is None or len(own.memo.number) > entries:
                    own.memo = _Memo()
                new = list(set(tokens).difference(own.memo.number))
                own.memo.add(new, own.ids(new))
                values, sizes = own.memo.lay(tokens)
                before = np.append(0, np.cumsum(sizes))
                offsets = before[np.cumsum([0, *map(len, texts)])]
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
                yield _with_column(part, out, ids)

    return run


def _decoder(shared, ids: str, out: str, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value.ranks
        size_of = np.zeros(max(ranks.values()) + 1, np.int64)
        size_of[list(ranks.values())] = [len(k) for k in ranks]
        start_of = np.cumsum(size_of) - size_of
        pool = np.zeros(size_of.sum(), np.uint8)
        for token, rank in ranks.items():
            pool[start_of[rank] : start_of[rank] + len(token)] = list(token)
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pa.compute.list_value_length(batch.column(ids)).fill_null(0)
            for part in _chunks(batch, lengths.to_numpy(), chars):
                lists = part.column(ids)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                counts = pa.compute.list_value_length(lists).fill_null(0).to_numpy()
                sizes = size_of[flat]
                before = np.append(0, np.cumsum(sizes))
                offsets = before[np.append(0, np.cumsum(counts))].astype(np.int32)
                data = pool[_laid(start_of[flat], sizes)]
                texts = pa.Array.from_buffers(
                    pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
                )
                yield _with_column(part, out, texts)

    return run


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids"):
    """``df`` with the list of token ids of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    run = _encoder(shared, text, out, CHUNK_CHARS, MEMO_ENTRIES)
    return df.mapInArrow(run, _schema(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded"):
    """``df`` with the bytes that each list of ids stands for."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    return df.mapInArrow(_decoder(shared, ids, out, CHUNK_CHARS), _schema(df, out, T.BinaryType()))


def round_trip(
    df: DataFrame,
    vocabulary: Vocabulary,
    text: str = "text",
    ids: str = "ids",
    out: str = "decoded",
):
    """``decode(encode(df))`` without the text, in one Python call: a task needs one worker, not two."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    there = _encoder(shared, text, ids, ROUND_TRIP_CHARS, ROUND_TRIP_ENTRIES)
    back = _decoder(shared, ids, out, ROUND_TRIP_CHARS)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in there(batches):
            yield batch.select([n for n in batch.schema.names if n != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what an earlier stage left in this worker
        yield from back(coded(batches))
        shared.value.memo = None
        give_back()

    kept = [f for f in df.schema.fields if f.name not in (text, ids, out)]
    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.BinaryType())]
    return df.mapInArrow(run, T.StructType([*kept, *added]))
