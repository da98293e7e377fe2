"""Benchmark passages in documents, found by shared q-grams and verified by banded alignment.

Both sides are folded: letters and digits in lower case, one space for everything between them.
An item of at most ``ITEM`` characters is one window. A longer one is cut into windows of ``WINDOW``
characters that begin as many characters apart as a window may have edits, so that a region as long
as a window is found wherever it begins and ends: at most half of those edits go to its ends. A window of m characters
with at most e edits shares at least (m - q + 1) - q * e of its q-grams with the document (the
q-gram lemma), and all of them lie within e + 1 neighbouring diagonals. So shared q-grams are
counted in diagonal bands of twice that width that overlap by half; bands that reach the bound are
kept, and a semi-global alignment restricted to the band gives the edits.

Items of fewer than ``MIN_CHARS`` folded characters are looked up exactly: as whole words, or
anywhere where their edges are of a script without spaces; those of fewer than ``Q`` characters
only as a whole text, as they tell nothing inside of one.

The middle of a long run of one character is left out of the comparison (no window can tell it from
a shorter run), and equal pieces of a text are aligned with a window once, so that repetition costs
no more than other text.

Long items are cut in the tasks into overlapping pieces; pieces go to the driver in a stream and from
there to the tasks in blocks of at most ``BLOCK_CHARS`` characters of windows and one piece, however
large the benchmark or one item of it is; documents are read once for each block.

Edge cases: null and empty texts have no leak, null and empty items match nothing; equal items
are each reported, an item whose row is repeated once; every row is judged on its own, so repeated
rows repeat their leaks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import give_back

Q = 10
ITEM = 120
WINDOW = 60
#: Shorter items are found without edits only.
MIN_CHARS = 30
#: Folded characters of an item that travel together.
PIECE = 1 << 16
#: Edits allowed per character of a window.
EDIT_RATE = 0.06
BLOCK_CHARS = 4_000_000
#: Characters of documents that are compared at once.
CHUNK_CHARS = 100_000

_FILTER_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def stride(edit_rate: float) -> int:
    """How far apart windows begin."""
    return max(1, int(WINDOW * edit_rate))


def _fold_table() -> np.ndarray:
    """Folded code of each character of the basic plane; 32 for what is neither letter nor digit."""
    table = np.full(1 << 16, 32, np.uint32)
    for code in range(1 << 16):
        lower = chr(code).lower()
        if lower.isalnum():
            table[code] = ord(lower[0])
    return table


_FOLD = _fold_table()


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters and the place of each in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = np.where(codes < 1 << 16, _FOLD[np.minimum(codes, (1 << 16) - 1)], codes)
    space = folded == 32
    kept = ~space
    kept[1:] |= ~space[:-1]  # the first space of a run
    at = np.flatnonzero(kept)
    return folded[at], at


def short_runs(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the middle of runs of one character that are longer than any match twice over."""
    keep = ITEM + 10
    changes = np.flatnonzero(np.diff(codes))
    starts, ends = np.append(0, changes + 1), np.append(changes + 1, len(codes))
    long = ends - starts > 2 * keep
    if not long.any():
        return codes, places
    kept = np.ones(len(codes), bool)
    for start, end in zip(starts[long], ends[long]):
        kept[start + keep : end - keep] = False
    return codes[kept], places[kept]


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of Q characters."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    pairs = wide[:-1] * np.uint64(0x100000001B3) + wide[1:]
    out = np.zeros(len(codes) - Q + 1, np.uint64)
    n = len(out)
    for j in range(0, Q - 1, 2):
        out = (out ^ pairs[j : j + n]) * _MIX
        out ^= out >> np.uint64(29)
    if Q % 2:
        out = (out ^ wide[Q - 1 : Q - 1 + n]) * _MIX
    return out


def _trimmed(codes: np.ndarray) -> np.ndarray:
    """Without a space at either end."""
    codes = codes[1:] if len(codes) and codes[0] == 32 else codes
    return codes[:-1] if len(codes) and codes[-1] == 32 else codes


def _without_spaces(code: int) -> bool:
    """Whether a character is of a script whose words are not parted by spaces."""
    return 0x0E00 <= code < 0x1000 or 0x1780 <= code < 0x1800 or 0x2E80 <= code < 0xA4D0 or code >= 0x20000


def short_leaks(codes: np.ndarray, places: np.ndarray, short: dict) -> dict[int, tuple[int, int, int]]:
    """The first place of each item that a folded text holds unchanged."""
    found: dict[int, tuple[int, int, int]] = {}
    own = np.flatnonzero(codes != 32)
    whole = codes[own[0] : own[-1] + 1].tobytes() if len(own) else b""
    for size, items in sorted(short.items()):
        if size < Q:
            hits = [(int(own[0]), whole)] if whole in items else []
        else:
            # A window of the text per place, compared as bytes of the same length.
            grams = np.lib.stride_tricks.sliding_window_view(codes, size) if len(codes) >= size else []
            firsts = [np.frombuffer(k, np.uint32)[0] for k in items]
            starts = np.flatnonzero(np.isin(codes[: max(0, len(codes) - size + 1)], firsts))
            hits = [(at, key) for at in starts.tolist() if (key := grams[at].tobytes()) in items]
        for at, key in hits:
            end = at + size
            left = at == 0 or codes[at - 1] == 32 or _without_spaces(codes[at])
            right = end == len(codes) or codes[end] == 32 or _without_spaces(codes[end - 1])
            if left and right:
                for item in items[key]:
                    where = (int(places[at]), int(places[end - 1]) + 1, 0)
                    found[item] = min(found.get(item, where), where)
    return found


@dataclass
class Windows:
    """Folded windows of benchmark items and an index of their q-grams."""

    codes: list[np.ndarray]
    items: list[list[int]]  # the items that hold each window
    edits: np.ndarray
    needed: np.ndarray  # shared q-grams that the bound asks for
    grams: np.ndarray  # distinct q-grams, sorted
    starts: np.ndarray  # where the places of each begin
    of: np.ndarray  # window of each place
    offset: np.ndarray  # and offset in it
    seen: np.ndarray  # a filter by the top bits of the hash
    short: dict[int, dict[bytes, list[int]]]  # items by length that are looked up exactly

    @classmethod
    def of_items(cls, items: list[tuple[int, str]], edit_rate: float) -> Windows:
        found: dict[bytes, list[int]] = defaultdict(list)
        short: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        for number, text in items:
            codes = _trimmed(fold(text)[0])
            if len(codes) < MIN_CHARS:
                own = short[len(codes)][codes.tobytes()] if len(codes) else [number]
                if number not in own:
                    own.append(number)
                continue
            size = WINDOW if len(codes) > ITEM else ITEM
            last = max(0, len(codes) - size)
            for start in [*range(0, last, stride(edit_rate)), last]:
                own = found[codes[start : start + size].tobytes()]
                if number not in own:
                    own.append(number)
        windows = [np.frombuffer(k, np.uint32) for k in found]
        sizes = np.array([len(w) for w in windows], np.int64)
        grams = sizes - Q + 1
        edits = np.minimum(np.floor(sizes * edit_rate), (grams - 1) // Q).astype(np.int64)
        hashes = [gram_hashes(w) for w in windows]
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        of = np.repeat(np.arange(len(windows)), grams)
        offset = np.concatenate([np.zeros(0, np.int64), *[np.arange(g) for g in grams]])
        order = np.argsort(flat, kind="stable")
        distinct, starts = np.unique(flat[order], return_index=True)
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[distinct >> np.uint64(64 - _FILTER_BITS)] = True
        return cls(
            windows, list(found.values()), edits, grams - Q * edits, distinct,
            np.append(starts, len(flat)), of[order], offset[order], seen,
            {size: dict(own) for size, own in short.items()},
        )

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``codes``, window and offset of every shared q-gram.

        Places are dropped early where too few known q-grams lie around them for any window.
        """
        none = np.zeros(0, np.int64)
        hashes = gram_hashes(codes)
        if not len(self.grams) or not len(hashes):
            return none, none, none
        known = self.seen[hashes >> np.uint64(64 - _FILTER_BITS)]
        at = np.flatnonzero(known)
        where = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        right = self.grams[where] == hashes[at]
        at, where = at[right], where[right]
        # Any place of a match has the match's other places at most this far away.
        reach = ITEM + int(self.edits.max())
        around = np.searchsorted(at, at + reach) - np.searchsorted(at, at - reach)
        near = around >= self.needed.min()
        at, where = at[near], where[near]
        counts = self.starts[where + 1] - self.starts[where]
        rows = np.repeat(np.arange(len(at)), counts)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = self.starts[where][rows] + inner
        return at[rows], self.of[place], self.offset[place]


def align(window: np.ndarray, text: np.ndarray, low: int, high: int, limit: int):
    """Fewest edits of ``window`` against a part of ``text``, on diagonals ``low`` ... ``high``.

    A diagonal is the place in the text minus the place in the window. Both ends in the text are
    free. Returns (edits, start, end) or None when more than ``limit`` edits are needed.
    """
    width = high - low + 1
    far = len(window) + len(text) + 1
    lanes = np.arange(width)
    # cost[k]: window[:i] against text ending at low + k + i.
    ends = low + lanes
    inside = (ends >= 0) & (ends <= len(text))
    cost = np.where(inside, 0, far)
    begin = ends.copy()
    for i, code in enumerate(window):
        ends = low + lanes + i  # text place of the diagonal step
        fits = (ends >= 0) & (ends < len(text))
        same = np.zeros(width, bool)
        same[fits] = text[ends[fits]] == code
        step = np.where(fits, cost + ~same, far)
        skip = np.append(cost[1:] + 1, far)  # the window's character is missing in the text
        take = skip < step
        new = np.where(take, skip, step)
        start = np.where(take, np.append(begin[1:], 0), begin)
        new = np.where((ends + 1 >= 0) & (ends + 1 <= len(text)), new, far)
        # Extra characters in the text: a step to the next lane costs one.
        slid = new - lanes
        best = np.minimum.accumulate(slid)
        source = np.maximum.accumulate(np.where(slid == best, lanes, 0))
        cost, begin = best + lanes, start[source]
    k = int(cost.argmin())
    if cost[k] > limit:
        return None
    return int(cost[k]), int(begin[k]), low + k + len(window)


def leaks_in(texts: list[str | None], windows: Windows) -> list[list[tuple[int, int, int, int]]]:
    """(item, start, end, edits) of each text, one entry per item: the fewest edits, then first."""
    folded = [fold(t) if t else (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for t in texts]
    out: list[dict[int, tuple[int, int, int]]] = [
        short_leaks(*own, windows.short) if windows.short else {} for own in folded
    ]
    folded = [short_runs(*own) for own in folded]
    sizes = np.array([len(c) + 1 for c, _ in folded], np.int64)
    begins = np.cumsum(sizes) - sizes
    mark = np.array([0], np.uint32)  # between texts; no folded text holds it
    codes = np.concatenate([part for c, _ in folded for part in (c, mark)])
    at, of, offset = windows.hits(codes)
    if len(at):
        text_of = np.searchsorted(begins, at, side="right") - 1
        diagonal = at - begins[text_of] - offset + ITEM  # not negative
        step = windows.edits[of] + 1
        candidates = []
        for shift in (0, 1):
            band = diagonal // step
            band = (band + shift) // 2  # pairs of neighbouring strips, overlapping by one strip
            rows = np.stack([text_of, of, band, offset])
            order = np.lexsort(rows[::-1])
            ordered = rows[:, order]
            changes = np.diff(ordered) != 0
            firsts = np.flatnonzero(np.append(True, changes[:3].any(axis=0)))
            # A q-gram of the window counts once, however often the text repeats it.
            counts = np.add.reduceat(np.append(True, changes.any(axis=0)).astype(np.int64), firsts)
            enough = counts >= windows.needed[ordered[1, firsts]]
            for first, count in zip(firsts[enough], counts[enough].tolist()):
                text, window, number = (int(x) for x in ordered[:3, first])
                strip = int(windows.edits[window]) + 1
                low = (2 * number - shift) * strip - ITEM
                missing = len(windows.codes[window]) - Q + 1 - count
                fewest = max(0, -(-missing // Q))
                candidates.append((text, fewest, low, window, low + 2 * strip - 1))
        aligned: dict[tuple, tuple | None] = {}
        for text, fewest, low, window, high in sorted(candidates):
            _verify(windows, window, folded[text], low, high, fewest, out[text], aligned)
    return [[(item, *where) for item, where in sorted(found.items())] for found in out]


def _find(text: np.ndarray, window: np.ndarray) -> int:
    """Where ``window`` occurs unchanged in ``text``, or -1."""
    whole, own = text.tobytes(), window.tobytes()
    at = whole.find(own)
    while at >= 0 and at % 4:
        at = whole.find(own, at + 1)
    return at // 4 if at >= 0 else -1


def _verify(
    windows: Windows, window: int, folded, low: int, high: int, fewest: int, found: dict, aligned: dict
) -> None:
    """Align a window in a band; not where ``fewest`` edits at its first place could not be better.

    ``aligned`` remembers the outcome for equal pieces of text.
    """
    codes, places = folded
    own, limit = windows.codes[window], int(windows.edits[window])
    # Diagonals of a path can leave the strips of its q-grams by the edits at its ends.
    low, high = low - limit, high + limit
    first = max(0, low)
    if first >= len(places):
        return
    best = (fewest, int(places[first]))
    if all(i in found and best > (found[i][2], found[i][0]) for i in windows.items[window]):
        return
    part = codes[first : max(0, high + len(own))]
    exact = _find(part, own)
    if exact >= 0:
        edits, start, end = 0, exact, exact + len(own)
    elif all(i in found and found[i][2] == 0 for i in windows.items[window]):
        return
    else:
        key = (window, low - first, high - first, part.tobytes())
        if key not in aligned:
            aligned[key] = align(own, part, low - first, high - first, limit)
        hit = aligned[key]
        if hit is None or hit[2] <= hit[1]:
            return
        edits, start, end = hit
    where = (int(places[first + start]), int(places[first + end - 1]) + 1)
    for item in windows.items[window]:
        old = found.get(item)
        if old is None or (edits, *where) < (old[2], old[0], old[1]):
            found[item] = (*where, edits)


LEAK = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("edits", T.IntegerType()),
    ]
)


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    edit_rate: float = EDIT_RATE,
    out: str = "leaks",
) -> DataFrame:
    """``df`` with the array ``leaks`` of (item_id, start, end, edits), in characters of the text."""
    kept = [c for c in df.columns if c != out]
    found = df.select(*kept).withColumn(out, F.array().cast(T.ArrayType(LEAK)))
    items = benchmark.select(F.col(item).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    for block in _item_blocks(_pieces(items), edit_rate):
        found = _add_leaks(found, Windows.of_items(block, edit_rate), text, out)
    return found


def _pieces(items: DataFrame) -> DataFrame:
    """(i, t): folded pieces of the items, each of them once; neighbours share a window and a stride."""
    step = PIECE - 2 * ITEM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, value in zip(batch.column(0), batch.column(1)):
                codes = _trimmed(fold(value.as_py())[0])
                starts = range(0, max(1, len(codes) - 2 * ITEM), step)
                parts = [codes[s : s + PIECE] for s in starts]
                texts = [p.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.as_py()] * len(texts), pa.int64()), pa.array(texts, pa.string())],
                    names=["i", "t"],
                )

    rows = items.where("i is not null and t is not null")
    return rows.mapInArrow(run, "i bigint, t string").where("t <> ''").distinct()


def _item_blocks(pieces: DataFrame, edit_rate: float) -> Iterator[list[tuple[int, str]]]:
    """Pieces in blocks of bounded size; the driver holds one block and one partition of pieces."""
    times = WINDOW // stride(edit_rate) + 2  # a character is in so many windows at most
    block, held = [], 0
    for row in pieces.orderBy("i", "t").toLocalIterator():
        block.append((row.i, row.t))
        held += times * len(row.t)
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def _add_leaks(df: DataFrame, windows: Windows, text: str, out: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(windows)
    names = [f.name for f in LEAK.fields]
    kind = pa.list_(
        pa.struct([("item_id", pa.int64()), *((n, pa.int32()) for n in names[1:])])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what an earlier stage left in this worker
        own = shared.value
        at = None
        for batch in batches:
            at = batch.schema.names.index(out) if at is None else at
            column = [row or [] for row in batch.column(out).to_pylist()]
            texts = batch.column(text).to_pylist()
            start, held = 0, 0
            for i, value in enumerate(texts):
                held += len(value or "")
                if held > CHUNK_CHARS or i + 1 == len(texts):
                    for j, leaks in enumerate(leaks_in(texts[start : i + 1], own), start):
                        column[j] = [*column[j], *(dict(zip(names, leak)) for leak in leaks)]
                    start, held = i + 1, 0
            arrays = [*batch.columns]
            arrays[at] = pa.array(column, kind)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)
            del texts, column, arrays
        give_back()

    return df.mapInArrow(run, df.schema)
