"""Language-model scores of whole documents by a gated recurrent network.

Tokens are the words of the text between ASCII white space, A-Z lower-cased, and one end token.
Word counts are taken over all training texts. The commonest ``listed`` words and the end token are
listed words; in the order of their counts they are cut into ``classes`` of equal sums of the square
root of the count, so common words are in small classes and rare ones in large, and the classes are
cut into groups in the same way. Every other word, seen or not, belongs to one of ``tail_classes``
tail classes by its first letters. The network reads the token before (or its tail class) and gives
the group or tail class of the next token by one softmax, the class of a listed word by a second
inside its group and the word by a third inside its class; inside a tail class a word has the
probability (count + 1) / (counts + words + 1) of that class, so one unseen word is provided for.

All known words are listed by default.

Training is truncated backpropagation in numpy. A step changes the rows that its window read and the
classes that it gave. Every training document is read once, in ``rounds`` parts; in each part at
most one task per core starts from the same weights, and the changes, in half precision, are averaged
over tasks by their tokens, in blocks. Documents go through lanes with the state carried over all
windows of a document, in training as in scoring, so a text of any length is scored whole.

Counts of the ``known`` commonest words are broadcast (a fixed number of rows); the counts of
all other words are joined. Words are compared by their 64-bit digests.

Edge cases: a null text is an empty text, whose only token is the end; rows with equal ids are
scored one by one; without training texts the counts are empty and the network stays at its start.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import give_back, most_frequent, stored

#: Digest of the end token; the empty word does not occur in a text.
END = xxhash.xxh64_intdigest(b"") - (1 << 63)
#: Bytes of text whose words are found together.
READ_BYTES = 1 << 22
#: Bound of a logit; its exponential and a sum of them stay finite in single precision.
_LOGIT = 60.0
#: Tokens that a task holds at once.
HELD_TOKENS = 5_000_000
#: Tokens whose output probabilities are taken together in scoring.
OUTPUT_TOKENS = 1 << 16
#: Outputs that are worked on at once, and words whose weights are, to stay in the cache.
CACHED_OUTPUTS = 1 << 16
CACHED_WORDS = 1024
#: Weights are averaged in blocks of so many.
BLOCK_WEIGHTS = 1 << 15


@dataclass(frozen=True)
class Settings:
    listed: int = 65_535
    classes: int = 192
    tail_classes: int = 16
    known: int = 65_536
    hidden: int = 16
    rounds: int = 3
    rate: float = 0.01
    train_lanes: int = 2048
    train_window: int = 16
    train_steps: int = 150
    lanes: int = 512
    window: int = 32
    seed: int = 5


def digest(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def tail_class(word: bytes, classes: int) -> int:
    return xxhash.xxh32_intdigest(word[:2]) % classes


def words_of(text: str | None) -> list[bytes]:
    """Words of a text; bytes are lower-cased and split in their ASCII meaning only."""
    return text.encode().lower().split() if text else []


@dataclass
class Words:
    """Words of several texts one after the other: the distinct ones and, per word, which it is."""

    distinct: np.ndarray  # bytes
    digests: np.ndarray
    at: np.ndarray
    sizes: np.ndarray  # words of each text


def _distinct(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    coded = words.cast(pa.binary()).dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    digests = np.array([xxhash.xxh64_intdigest(w) for w in distinct.tolist()], np.uint64)
    return distinct, (digests ^ np.uint64(1 << 63)).view(np.int64), coded.indices.to_numpy()


def read_words(texts: pa.Array) -> Iterator[Words]:
    """The words of the texts as in ``words_of``, of about READ_BYTES at a time."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts).cast(pa.int64()), 0)).to_numpy()
    first = 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + READ_BYTES, side="right")))
        lowered = pc.ascii_lower(pc.fill_null(texts.slice(first, last - first), ""))
        split = pc.ascii_split_whitespace(lowered)
        words = split.flatten()
        # White space at an end of a text leaves an empty word there.
        full = pc.greater(pc.binary_length(words), 0)
        of = np.repeat(np.arange(last - first), pc.list_value_length(split).to_numpy())
        sizes = np.bincount(of[full.to_numpy(zero_copy_only=False)], minlength=last - first)
        yield Words(*_distinct(words.filter(full)), sizes)
        first = last


# ---- counts ----------------------------------------------------------------------------------


def count_words(df: DataFrame, settings: Settings, text: str = "text") -> DataFrame:
    """(word, tail, n) of all rows, the end token included. Tasks send partial counts."""
    tails = settings.tail_classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in read_words(batch.column(0)):
                counts = np.bincount(words.at, minlength=len(words.distinct))
                own = [tail_class(w, tails) for w in words.distinct.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(words.digests, END), pa.int64()),
                        pa.array([*own, -1], pa.int32()),
                        pa.array(np.append(counts, len(words.sizes)), pa.int64()),
                    ],
                    names=["word", "tail", "n"],
                )
        give_back()

    parts = df.select(text).mapInArrow(run, "word bigint, tail int, n bigint")
    return parts.groupBy("word", "tail").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Counts of the commonest words and the sums over all."""

    settings: Settings
    tokens: int
    types: int
    counts: dict[int, int]  # the known words
    tail_of: dict[int, int]  # their tail classes; the end token has -1
    place: dict[int, int]  # the listed words, by falling count; the end token is among them
    tail_sums: np.ndarray  # counts + words + 1 of each tail class

    @property
    def base_total(self) -> int:
        return self.tokens + self.types + 1

    def mass(self) -> np.ndarray:
        """count + 1 of the listed words, in their order."""
        found = np.empty(len(self.place))
        for word, at in self.place.items():
            found[at] = self.counts.get(word, 0) + 1
        return found


def cut(mass: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of at most ``parts`` runs with nearly equal sums of the square root of ``mass``."""
    marks = np.cumsum(np.sqrt(mass))
    inner = np.searchsorted(marks, marks[-1] * np.arange(1, parts) / parts)
    return np.unique(np.concatenate([[0], inner, [len(mass)]]))


def read_lexicon(counts: DataFrame, settings: Settings) -> Lexicon:
    """What every task needs of the counts: ``known`` rows and one sum per tail class."""
    top = most_frequent(counts, "n", "word", settings.known).toPandas()
    words = [w for w in top["word"].tolist() if w != END]
    by_word = dict(zip(top["word"].tolist(), top["n"].tolist()))
    listed = set(words[: settings.listed]) | {END}
    order = sorted(listed, key=lambda w: (-by_word.get(w, 0), w))
    sums = {r.tail: (r.n, r.v) for r in counts.groupBy("tail").agg(
        F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    tails = np.array([sum(sums.get(t, (0, 0))) + 1 for t in range(settings.tail_classes)], float)
    for word, tail, n in zip(top["word"].tolist(), top["tail"].tolist(), top["n"].tolist()):
        if word in listed and word != END:
            tails[tail] -= n + 1
    return Lexicon(
        settings,
        sum(n for n, _ in sums.values()),
        sum(v for _, v in sums.values()),
        by_word,
        dict(zip(top["word"].tolist(), top["tail"].tolist())),
        {w: i for i, w in enumerate(order)},
        tails,
    )


# ---- network ---------------------------------------------------------------------------------


class Network:
    """Weights in one flat vector with views; tokens are listed words, then tail classes."""

    def __init__(self, lexicon: Lexicon, flat: np.ndarray | None = None):
        s, mass = lexicon.settings, lexicon.mass()
        self.hidden, self.listed, self._room = s.hidden, len(mass), None
        #: Words of each class, classes of each group.
        self.words = cut(mass, s.classes)
        class_mass = np.add.reduceat(mass, self.words[:-1])
        self.classes = cut(class_mass, max(1, round(len(class_mass) ** 0.5)))
        self.class_of = np.repeat(np.arange(len(class_mass)), np.diff(self.words))
        self.group_of = np.repeat(np.arange(len(self.classes) - 1), np.diff(self.classes))
        outputs = len(self.classes) - 1 + s.tail_classes
        self.shapes = {
            "read": (self.listed + s.tail_classes, s.hidden),
            "into": (s.hidden, 3 * s.hidden),
            "carry": (s.hidden, 3 * s.hidden),
            "group": (outputs, s.hidden + 1),
            "class": (len(class_mass), s.hidden + 1),
            "word": (self.listed, s.hidden + 1),
        }
        size = sum(int(np.prod(v)) for v in self.shapes.values())
        self._lay(np.zeros(size, np.float32) if flat is None else flat)
        if flat is None:
            self._start(lexicon, mass, class_mass)

    def _lay(self, flat: np.ndarray) -> None:
        self.flat, start = flat, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[start : start + size].reshape(shape))
            start += size
        for name in ("group", "class", "word"):  # weights and, last, the bias
            setattr(self, f"{name}_w", getattr(self, name)[:, :-1])
            setattr(self, f"{name}_b", getattr(self, name)[:, -1])

    def _start(self, lexicon: Lexicon, mass: np.ndarray, class_mass: np.ndarray) -> None:
        """Small random weights; the biases give the counted frequencies."""
        rng = np.random.default_rng(lexicon.settings.seed)
        scales = {"read": 0.3, "into": self.hidden**-0.5, "carry": 0.3, "group_w": 0.05, "class_w": 0.05, "word_w": 0.05}
        for name, scale in scales.items():
            view = getattr(self, name)
            view[:] = rng.standard_normal(view.shape) * scale
        tails = np.zeros(self.listed, np.int64)
        for word, at in lexicon.place.items():
            tails[at] = lexicon.tail_of.get(word, -1)
        # A rare word is read nearly as its tail class is; training takes it from there.
        seldom = np.where(tails < 0, 0, 100 / (99 + mass)).astype(np.float32)[:, None]
        words = self.read[: self.listed]
        words += seldom * (self.read[self.listed + tails] - words)
        group_mass = np.add.reduceat(class_mass, self.classes[:-1])
        outputs = np.concatenate([group_mass, lexicon.tail_sums])
        self.group_b[:] = np.log(outputs / outputs.sum())
        self.class_b[:] = np.log(class_mass / group_mass[self.group_of])
        self.word_b[:] = np.log(mass / class_mass[self.class_of])

    def steps(self, read: np.ndarray, fresh: np.ndarray, state: np.ndarray):
        """States after each token. read: (steps, lanes, hidden); fresh: first token of a text.

        Inside, lanes are the last axis, so that the gates of a step lie one after the other.
        """
        h, rows = self.hidden, read
        read = np.matmul(self.into.T, rows.transpose(0, 2, 1))
        states, kept = np.empty(rows.shape, np.float32), []
        going = (~fresh).astype(np.float32)
        state, carry = np.ascontiguousarray(state.T), np.ascontiguousarray(self.carry.T)
        for t in range(len(read)):
            state = state * going[t]
            carried = carry @ state
            gates = read[t, : 2 * h]
            gates += carried[: 2 * h]
            hold, reset = _sigmoid(gates).reshape(2, h, -1)
            new = reset * carried[2 * h :]
            new += read[t, 2 * h :]
            np.tanh(new, out=new)
            kept.append((state, carried[2 * h :], hold, reset, new))
            state = state - new
            state *= hold
            state += new
            states[t] = state.T
        return states, state.T, (rows, kept)

    def log_probability(self, states: np.ndarray, tokens: np.ndarray, grad: Network | None = None):
        """Natural log of the group and, for a listed word, its class and the word in its class.

        With ``grad`` also adds the output weights' gradients of the summed loss there and
        returns the gradient of the states.
        """
        groups = len(self.classes) - 1
        classes = np.append(self.class_of, len(self.group_of))[np.minimum(tokens, self.listed)]
        order = np.argsort(classes.astype(np.uint16), kind="stable")
        tokens, classes = tokens[order], classes[order]
        states = np.hstack([states, np.ones((len(states), 1), np.float32)])[order]
        top = np.append(self.group_of, 0)[classes]
        ends = np.searchsorted(classes, np.arange(len(self.words)))
        top[ends[-1] :] = tokens[ends[-1] :] - self.listed + groups
        found = np.zeros(len(tokens), np.float32)
        back = None if grad is None else np.zeros((len(states), self.hidden), np.float32)
        whole = np.array([0, len(self.group_b)])
        for name, picked, parts, at in (
            ("group", top, whole, np.array([0, len(tokens)])),
            ("class", classes, self.classes, ends[self.classes]),
            ("word", tokens, self.words, ends),
        ):
            self._inside(name, states, picked, parts, at, found, grad, back)
        given = np.empty_like(found)
        given[order] = found
        if grad is None:
            return given, None
        d_states = np.empty_like(back)
        d_states[order] = back
        return given, d_states

    def _inside(self, name, states, picked, parts, at, found, grad, back) -> None:
        """Adds what the picked outputs have among those of their part; rows at[i] to at[i + 1] are in part i.

        ``states`` end with a one, which meets the bias.
        """
        outputs, w = getattr(self, name), getattr(self, f"{name}_w")
        # A state is within -1 and 1, so few logits can ever be out of bounds.
        most = np.abs(outputs) @ np.ones(outputs.shape[1], np.float32)
        wide = np.maximum.reduceat(most, parts[:-1]) > _LOGIT
        for part in np.flatnonzero(np.diff(at)).tolist():
            of = slice(parts[part], parts[part + 1])
            size = of.stop - of.start
            if size == 1:
                continue
            own = None if grad is None else getattr(grad, name)[of]
            step = max(1, CACHED_OUTPUTS // size)
            for first in range(at[part], at[part + 1], step):
                here = slice(first, min(first + step, at[part + 1]))
                room, chosen = self.room(size, here), picked[here] - of.start
                logs, slope = _softmax(states[here], outputs[of], w[of], chosen, room, wide[part], own)
                found[here] += logs
                if back is not None:
                    back[here] += slope

    def room(self, size: int, rows: slice) -> np.ndarray:
        """Place for the outputs of ``rows``, used again for the next ones."""
        need = size * (rows.stop - rows.start)
        if self._room is None or len(self._room) < need:
            self._room = np.empty(max(need, CACHED_OUTPUTS), np.float32)
        return self._room[:need].reshape(-1, size)

    def backward(self, kept, d_states: np.ndarray, fresh: np.ndarray, grad: Network) -> np.ndarray:
        """Gradient of what was read, through all steps of a window; adds to grad.carry and grad.into."""
        h, (rows, kept) = self.hidden, kept
        steps, lanes = fresh.shape
        d_read = np.empty((steps, 3 * h, lanes), np.float32)
        back = np.zeros((h, lanes), np.float32)
        going = (~fresh).astype(np.float32)
        through, into = np.empty((3 * h, lanes), np.float32), np.zeros_like(self.into)
        for t in range(steps - 1, -1, -1):
            state, carried, hold, reset, new = kept[t]
            back += d_states[t].T
            own = d_read[t]
            d_hold, d_reset, d_new = own.reshape(3, h, lanes)
            free = 1 - hold
            np.multiply(back, free, out=d_new)
            d_new *= 1 - new * new
            np.subtract(state, new, out=d_hold)
            d_hold *= back
            d_hold *= hold
            d_hold *= free
            np.multiply(d_new, reset, out=through[2 * h :])
            np.multiply(through[2 * h :], carried, out=d_reset)
            d_reset *= 1 - reset
            through[: 2 * h] = own[: 2 * h]
            grad.carry += state @ through.T
            into += rows[t].T @ own.T
            back *= hold
            back += self.carry @ through
            back *= going[t]
        grad.into += into
        return np.matmul(d_read.transpose(0, 2, 1), self.into.T)


def _softmax(states, biased, w, picked, room, bound: bool, grad=None):
    """Log-probability of the picked output of each row, and with ``grad`` the slope of the states.

    ``biased``: weights ``w`` and bias; ``room`` takes the outputs, as a new array of that size costs
    more than they do.
    """
    p = np.matmul(states, biased.T, out=room)
    if bound:
        np.clip(p, -_LOGIT, _LOGIT, out=p)  # cheaper than a maximum per row
    cells, at = p.reshape(-1), np.arange(0, p.size, p.shape[1]) + picked
    found = cells.take(at)
    np.exp(p, out=p)
    total = p @ np.ones(p.shape[1], np.float32)
    found -= np.log(total)
    if grad is None:
        return found, None
    p *= (1 / total)[:, None]
    cells[at] -= 1
    grad[:, :-1] += p.T @ states[:, :-1]
    grad[:, -1] += np.ones(len(p), np.float32) @ p
    return found, p @ w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; an exponential that overflows gives 0."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Lanes:
    """Texts laid end to end in lanes of nearly equal length, the longest lane first."""

    def __init__(self, texts: list[np.ndarray], lanes: int, end: int):
        loads = [(0, i) for i in range(min(lanes, len(texts)))]
        own: list[list[int]] = [[] for _ in loads]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            load, lane = heapq.heappop(loads)
            own[lane].append(i)
            heapq.heappush(loads, (load + len(texts[i]), lane))
        own.sort(key=lambda lane: -sum(len(texts[i]) for i in lane))
        self.lengths = np.array([sum(len(texts[i]) for i in lane) for lane in own])
        steps = self.lengths[0]
        self.tokens = np.zeros((steps, len(own)), np.int32)
        self.fresh = np.zeros((steps, len(own)), bool)
        self.text = np.zeros((steps, len(own)), np.int32)
        for lane, mine in enumerate(own):
            self.tokens[: self.lengths[lane], lane] = np.concatenate([texts[i] for i in mine])
            sizes = [len(texts[i]) for i in mine]
            self.fresh[np.cumsum([0, *sizes[:-1]]), lane] = True
            self.text[: self.lengths[lane], lane] = np.repeat(mine, sizes)
        self.before = np.vstack([np.full((1, len(own)), end, np.int32), self.tokens[:-1]])
        self.before[self.fresh] = end

    def windows(self, size: int):
        """(first step, last step, lanes still running to the end, valid tokens of the window)."""
        for start in range(0, len(self.tokens), size):
            stop = min(start + size, len(self.tokens))
            lanes = int((self.lengths > start).sum())
            valid = np.arange(start, stop)[:, None] < self.lengths[None, :lanes]
            yield start, stop, lanes, valid


def score_texts(network: Network, texts: list[np.ndarray], settings: Settings, end: int):
    """Natural log-probability of the classes and listed words of each text."""
    lanes = Lanes(texts, settings.lanes, end)
    out = np.zeros(len(texts))
    state = np.zeros((lanes.tokens.shape[1], settings.hidden), np.float32)
    waiting, held = [], 0
    for start, stop, n, valid in lanes.windows(settings.window):
        here = np.s_[start:stop, :n]
        states, state, _ = network.steps(network.read[lanes.before[here]], lanes.fresh[here], state[:n])
        laid = (states, lanes.tokens[here], lanes.text[here])
        if valid.all():
            waiting.append([x.reshape(valid.size, *x.shape[2:]) for x in laid])
        else:
            waiting.append([x[valid] for x in laid])
        held += len(waiting[-1][1])
        if held >= OUTPUT_TOKENS or stop == len(lanes.tokens):
            given, tokens, text = map(np.concatenate, zip(*waiting))
            found, _ = network.log_probability(given, tokens)
            out += np.bincount(text, found, minlength=len(out))
            waiting, held = [], 0
    return out


class Adam:
    """Steps on what a window touched: the moments of other rows and classes stay as they are."""

    def __init__(self, network: Network, rate: float):
        self.m, self.v = (_view(network, np.zeros_like(network.flat)) for _ in range(2))
        self.rate, self.t = rate, 0

    def step(self, network: Network, grad: Network, count: int, weight: float, read, slope, classes) -> None:
        """A step of ``weight`` times the rate, less where the window is not full; empties ``grad``.

        ``slope`` is that of the rows ``read``, of which the window took each; ``classes`` are those
        of its words. The larger floor under the output weights, a share of the slope of one token,
        keeps the steps of outputs that a window does not hold in proportion to their small slopes.
        """
        self.t += 1
        floor = 0.3 / count
        parts = [("into", ..., 1e-6), ("carry", ..., 1e-6)]
        parts += [(name, ..., floor) for name in ("group", "class")]
        bounds = network.words
        for run in np.split(classes, np.flatnonzero(np.diff(classes) > 1) + 1) if len(classes) else []:
            last = bounds[run[-1] + 1]
            for first in range(bounds[run[0]], last, CACHED_WORDS):
                own = slice(first, min(first + CACHED_WORDS, last))
                parts.append(("word", own, floor))
        for name, at, least in parts:
            w, g, m, v = (getattr(x, name)[at] for x in (network, grad, self.m, self.v))
            g *= 1 / count
            w -= self._move(g, m, v, least, weight)
            g[...] = 0
        m, v = self.m.read[read], self.v.read[read]
        network.read[read] -= self._move(slope / count, m, v, 1e-6, weight)
        self.m.read[read], self.v.read[read] = m, v

    def _move(self, g, m, v, least: float, weight: float) -> np.ndarray:
        """Takes ``g`` into the moments, in place, and gives the step."""
        change = g - m
        change *= np.float32(0.1)
        m += change
        np.multiply(g, g, out=change)
        change -= v
        change *= np.float32(0.01)
        v += change
        size = np.multiply(v, np.float32(1 / (1 - 0.99**self.t)), out=change)
        np.sqrt(size, out=size)
        size += np.float32(least)
        np.divide(m, size, out=size)
        size *= np.float32(weight * self.rate / (1 - 0.9**self.t))
        return size


def train_texts(network: Network, adam: Adam, texts: list[np.ndarray], settings: Settings, end: int):
    """One pass of truncated backpropagation over the texts laid end to end.

    The stream is cut into lanes of equal length, at most ``train_lanes`` and so few that there are
    about ``train_steps`` windows; a lane starts with an empty state, and the state goes on over
    the windows of a lane until its text ends.
    """
    stream, window = np.concatenate(texts), settings.train_window
    starts = np.zeros(len(stream), bool)
    starts[np.cumsum([0, *map(len, texts[:-1])])] = True
    lanes = min(settings.train_lanes, max(8, len(stream) // (window * settings.train_steps)))
    steps = -(-len(stream) // lanes)
    rest = steps * lanes - len(stream)

    def lay(values: np.ndarray, fill) -> np.ndarray:
        return np.append(values, np.full(rest, fill, values.dtype)).reshape(lanes, steps).T.copy()

    tokens, valid = lay(stream, end), lay(np.ones(len(stream), bool), False)
    fresh = lay(starts, True)
    before = lay(np.where(starts, end, np.roll(stream, 1)), end)
    state = np.zeros((lanes, settings.hidden), np.float32)
    fresh[0] = True
    grad = _view(network, np.zeros_like(network.flat))
    for start in range(0, steps, window):
        here = slice(start, start + window)
        states, state, kept = network.steps(network.read[before[here]], fresh[here], state)
        ok, d_states = valid[here], np.zeros_like(states)
        if ok.all():
            given = tokens[here].ravel()
            _, own = network.log_probability(states.reshape(len(given), -1), given, grad)
            d_states = own.reshape(states.shape)
        else:
            given = tokens[here][ok]
            _, d_states[ok] = network.log_probability(states[ok], given, grad)
        d_read = network.backward(kept, d_states, fresh[here], grad)
        at = before[here].ravel()
        order = np.argsort(at, kind="stable")
        firsts = np.flatnonzero(np.diff(at[order], prepend=-1))
        slope = np.add.reduceat(d_read.reshape(len(at), -1)[order], firsts)
        count = max(1, len(given))
        classes = np.flatnonzero(np.bincount(network.class_of[given[given < network.listed]]))
        adam.step(network, grad, count, count / ok.size, at[order][firsts], slope, classes)


def _view(network: Network, flat: np.ndarray) -> Network:
    """A network with the same shapes over another vector."""
    other = object.__new__(Network)
    other.__dict__.update(network.__dict__)
    other._lay(flat)
    return other


# ---- on Spark --------------------------------------------------------------------------------


class Reader:
    """Codes of words: the rank of a known word, -1 - (tail class) of any other."""

    def __init__(self, lexicon: Lexicon):
        self.tails = lexicon.settings.tail_classes
        known = list(lexicon.counts)
        digests = np.array(known, np.int64)
        self.order = np.argsort(digests)
        self.sorted = digests[self.order]
        listed = len(lexicon.place)
        #: Token of each known word, then of the tail classes from the back.
        self.token = np.array(
            [lexicon.place.get(w, listed + max(0, lexicon.tail_of[w])) for w in known]
            + [listed + t for t in range(self.tails - 1, -1, -1)],
            np.int32,
        )
        self.end = lexicon.place[END]
        #: log10(count + 1) of each known word, 0 for the tail classes.
        self.logged = np.log10(
            np.array([*lexicon.counts.values()] + [0] * self.tails, float) + 1
        )

    def codes(self, words: list[bytes]) -> np.ndarray:
        distinct, digests, at = _distinct(pa.array(words, pa.binary()))
        return self.codes_of(distinct, digests)[at]

    def codes_of(self, distinct: np.ndarray, digests: np.ndarray) -> np.ndarray:
        found = np.searchsorted(self.sorted, digests)
        codes = np.append(self.order, -1)[found].astype(np.int32)
        codes[np.append(self.sorted, 0)[found] != digests] = -1
        other = np.flatnonzero(codes < 0)
        codes[other] = [-1 - tail_class(w, self.tails) for w in distinct[other].tolist()]
        return codes

    def read(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Tokens of each text."""
        for words in read_words(texts):
            codes = self.codes_of(words.distinct, words.digests)[words.at]
            for own in np.split(codes, np.cumsum(words.sizes)[:-1]):
                yield self.tokens(own)

    def tokens(self, codes: np.ndarray) -> np.ndarray:
        """Tokens of the network, the end token last."""
        return np.append(self.token[codes], np.int32(self.end))


def _average(table: pa.Table) -> pa.Table:
    """One block of changes: the mean over tasks by their tokens."""
    totals = table.column("total").to_pylist()
    parts = [np.frombuffer(w, np.float16) for w in table.column("change").to_pylist()]
    mean = sum(p.astype(float) * n for p, n in zip(parts, totals)) / sum(totals)
    return pa.table(
        {
            "block": table.column("block").slice(0, 1),
            "change": pa.array([mean.astype(np.float32).tobytes()], pa.binary()),
        }
    )


def train(df: DataFrame, lexicon: Lexicon, part_of: str, text: str = "text") -> np.ndarray:
    """Weights after one reading of all rows; ``part_of`` names a column that splits the rounds."""
    settings = lexicon.settings
    flat = Network(lexicon).flat
    end = lexicon.place[END]
    session = df.sparkSession
    for number in range(settings.rounds):
        shared = session.sparkContext.broadcast((lexicon, flat))
        rate = settings.rate / (1 + number)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate):
            own, start = shared.value
            network = Network(own, start.copy())
            adam, reader = Adam(network, rate), Reader(own)
            waiting, held, total = [], 0, 0
            for batch in batches:
                for tokens in reader.read(batch.column(0)):
                    waiting.append(tokens)
                    held += len(waiting[-1])
                    if held > HELD_TOKENS:
                        train_texts(network, adam, waiting, settings, end)
                        total, waiting, held = total + held, [], 0
            if waiting:
                train_texts(network, adam, waiting, settings, end)
                total += held
            if total:
                for block, at in enumerate(range(0, len(start), BLOCK_WEIGHTS)):
                    own = slice(at, at + BLOCK_WEIGHTS)
                    part = (network.flat[own] - start[own]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block], pa.int32()),
                            pa.array([total], pa.int64()),
                            pa.array([part.tobytes()], pa.binary()),
                        ],
                        names=["block", "total", "change"],
                    )
            del network, adam, reader, waiting
            give_back()

        rows = df.where(F.pmod(F.xxhash64(part_of), F.lit(settings.rounds)) == number).select(text)
        rows = rows.coalesce(session.sparkContext.defaultParallelism)
        parts = (
            rows.mapInArrow(run, "block int, total bigint, change binary")
            .groupBy("block")
            .applyInArrow(_average, "block int, change binary")
            .collect()
        )
        shared.destroy()
        for part in parts:
            at = part.block * BLOCK_WEIGHTS
            flat[at : at + BLOCK_WEIGHTS] += np.frombuffer(part.change, np.float32)
    return flat


def score(
    df: DataFrame, counts: DataFrame, lexicon: Lexicon, flat: np.ndarray, text: str = "text"
) -> DataFrame:
    """``df`` without its text, with n_tokens, n_known, train_tokens, base_score and score.

    ``base_score`` is the log10 probability under the smoothed counts alone, ``score`` that of the
    network.
    """
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in df.columns if c not in (*added, text)]
    settings = lexicon.settings
    shared = df.sparkSession.sparkContext.broadcast((lexicon, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = shared.value
        network, reader = Network(own, weights.copy()), Reader(own)
        listed = len(own.place)
        base = np.log10(own.base_total)
        tail_base = np.concatenate([np.zeros(listed), np.log10(own.tail_sums)])
        end_count = own.counts.get(END, 0)
        row = TaskContext.get().partitionId() << 40

        def rare_of(words: Words, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of the unknown words of each text: how many, their digests, how often each occurs."""
            unknown, of = codes < 0, np.repeat(np.arange(len(words.sizes)), words.sizes)
            width = max(1, len(words.distinct))
            pairs, times = np.unique(of[unknown] * width + words.at[unknown], return_counts=True)
            texts, rare = np.divmod(pairs, width)
            return np.bincount(texts, minlength=len(words.sizes)), words.digests[rare], times

        def finish(batch: pa.RecordBatch, first: int, codes: list, rare: list):
            tokens = [reader.tokens(c) for c in codes]
            found = score_texts(network, tokens, settings, reader.end) / np.log(10)
            sizes, n = np.array([len(c) for c in codes]), len(codes)
            of = np.repeat(np.arange(n), sizes)
            flat_codes = np.concatenate(codes)
            flat_tokens, logged = reader.token[flat_codes], reader.logged[flat_codes]
            in_tail = flat_tokens >= listed
            base_sum = np.bincount(of, logged, n) - base * (sizes + 1) + np.log10(end_count + 1)
            found += np.bincount(of, in_tail * (logged - tail_base[flat_tokens]), n)
            known = np.bincount(of, flat_codes >= 0, n).astype(np.int64) + (end_count > 0)
            per_text, digests, times = map(np.concatenate, zip(*rare))
            offsets = pa.array(np.cumsum([0, *per_text]), pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(first, n) for c in kept),
                    pa.array(row + np.arange(n), pa.int64()),
                    pa.array(sizes + 1, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(base_sum, pa.float64()),
                    pa.array(found, pa.float64()),
                    pa.ListArray.from_arrays(offsets, pa.array(digests, pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                names=[*kept, "_row", "n_tokens", "_known", "_base", "_score", "_rare", "_times"],
            )

        for batch in batches:
            codes, rare, held, first = [], [], 0, 0
            for words in read_words(batch.column(text)):
                own = reader.codes_of(words.distinct, words.digests)[words.at]
                codes += np.split(own, np.cumsum(words.sizes)[:-1])
                rare.append(rare_of(words, own))
                held += len(own)
                if held > HELD_TOKENS:
                    yield finish(batch, first, codes, rare)
                    row += len(codes)
                    first += len(codes)
                    codes, rare, held = [], [], 0
            if codes:
                yield finish(batch, first, codes, rare)
                row += len(codes)
        give_back()

    extra = T._parse_datatype_string(
        "_row bigint, n_tokens bigint, _known bigint, _base double, _score double,"
        " _rare array<bigint>, _times array<bigint>"
    )
    passed = stored(
        df.select(*kept, text).mapInArrow(
            run, T.StructType([*(df.schema[c] for c in kept), *extra.fields])
        ),
        "lm-scores",
    )
    shared.destroy()
    logged = F.col("n") * F.log10(F.col("c") + 1)
    rare = (
        passed.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("r"))
        .select("_row", F.col("r._rare").alias("word"), F.col("r._times").alias("n"))
        .join(counts.select("word", F.col("n").alias("c")), "word")
        .groupBy("_row")
        .agg(
            F.sum(logged).alias("more"),
            F.sum("n").alias("more_known"),
        )
    )
    zero = F.lit(0.0)
    return passed.join(rare, "_row", "left").select(
        *kept,
        "n_tokens",
        (F.col("_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("bigint").alias("train_tokens"),
        (F.col("_base") + F.coalesce("more", zero)).alias("base_score"),
        (F.col("_score") + F.coalesce("more", zero)).alias("score"),
    )
