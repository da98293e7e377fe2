"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is content or not. Its features (words of its class, id and role, amounts of text with
the share of linked text) have a likelihood under either state, and a potential for each tag
connects its state with its parent's: the chance of the child's state given both. Sum-product messages go from the leaves to the root and back,
which gives the exact marginal of every element; text whose element is content with probability
0.5 or more is kept.

Both tables of the model are counts over all labelled pages, summed by Spark. A page is labelled
when its markup names its main part (``article``, ``main`` or a class, id or role of
``MAIN_WORDS``); inside it everything is content except the parts that name themselves as something
else. Those names also enter the model as priors, so that a part that no page of the corpus holds
is still known.

Edge cases: null, empty or textless pages give an empty text; markup that breaks off or is closed
in the wrong order is read as far as it goes; tag and attribute names beyond the known ones are
hashed, so that the model has a fixed size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places of hashed features.
PLACES = 1 << 14
#: Weight of a tag in SIDE_TAGS or MAIN_TAGS, in links seen.
PRIOR = 500.0
#: Share of the elements of its state that is taken to hold a word of SIDE_WORDS or MAIN_WORDS.
WORD_SHARE = 0.02
#: The same of the other state, as a part of WORD_SHARE; a class of the main part says less.
SIDE_WORD_ELSEWHERE, MAIN_WORD_ELSEWHERE = 1e-5, 1e-2
#: Least chance of a content child elsewhere, and of another child in content.
LEAST_ON, LEAST_OFF = 1e-5, 1e-3

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style template".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav"
    " ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
MAIN_TAGS = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article articlebody content entry main maincontent post story".split())
SIDE_TAGS = frozenset(
    "aside body button dialog fieldset footer form head header html input label menu nav option"
    " select textarea title".split()
)
SIDE_WORDS = frozenset(
    "ad ads advert advertisement alert banner breadcrumb breadcrumbs comment comments consent"
    " contentinfo cookie cookies disclaimer disqus feedback footer form header masthead menu modal"
    " nav navbar navigation newsletter notice notification pagination popup promo promoted related"
    " replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe"
    " toolbar widget".split()
)
#: Start tags that end an open element of the second kind.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
         "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Open elements that an implied end does not cross.
_FENCES = frozenset("table ul ol dl select article section div body html".split())
#: A document type with declarations in brackets, which hold no bracket themselves.
_DOCTYPE = re.compile(r"<!doctype[^>\[]*\[[^\[\]]*\]\s*>", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+[a-z]*")


@dataclass
class Page:
    """Elements in document order; text pieces with their element, None between blocks."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    words: list[list[str]] = field(default_factory=list)
    pieces: list[tuple[int, str] | None] = field(default_factory=list)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.open, self.hidden = Page(), [], 0
        self._element("#page", [])

    def _element(self, tag: str, attrs: list) -> None:
        page = self.page
        page.parents.append(self.open[-1] if self.open else -1)
        page.tags.append(tag)
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop"))
        page.words.append([w.lower() for w in _WORD.findall(named)] if named else [])
        self.open.append(len(page.tags) - 1)

    def _close(self, depth: int) -> None:
        for at in self.open[depth:]:
            tag = self.page.tags[at]
            self.hidden -= tag in HIDDEN
            if tag in BLOCKS:
                self.page.pieces.append(None)
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        tags = self.page.tags
        ends = _ENDS.get(tag, {"p"} if tag in BLOCKS and tag != "br" else ())
        if ends:
            for depth in range(len(self.open) - 1, 0, -1):
                at = tags[self.open[depth]]
                if at in ends or at == "p" and tag in BLOCKS:
                    self._close(depth)
                    break
                if at in _FENCES:
                    break
        if tag in BLOCKS:
            self.page.pieces.append(None)
        self._element(tag, attrs)
        if tag in VOID:
            self.open.pop()
        else:
            self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.page.tags[self.open[depth]] == tag:
                self._close(depth)
                break

    def handle_data(self, data):
        if not self.hidden and self.open:
            self.page.pieces.append((self.open[-1], data))


    def parse_marked_section(self, i, report=1):
        """A marked section is a comment up to the next ``>``, as browsers read it."""
        return self.parse_bogus_comment(i)

    def parse_html_declaration(self, i):
        """A document type goes to the end of its own declarations, if it has any."""
        own = _DOCTYPE.match(self.rawdata, i)
        return own.end() if own else super().parse_html_declaration(i)

    def unknown_decl(self, data):
        """The rest of a page that ends inside a declaration is not text."""


def parse(html: str) -> Page:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.page


def labels(page: Page) -> list[bool] | None:
    """Whether each element is content; None when the markup does not name a main part."""
    if not any(t in MAIN_TAGS for t in page.tags) and not any(
        w in MAIN_WORDS for words in page.words for w in words
    ):
        return None
    tagged = any(t in MAIN_TAGS for t in page.tags)
    states: list[bool] = []
    for tag, parent, words in zip(page.tags, page.parents, page.words):
        inside = parent >= 0 and states[parent]
        main = tag in MAIN_TAGS if tagged else any(w in MAIN_WORDS for w in words)
        side = tag in SIDE_TAGS or any(w in SIDE_WORDS for w in words)
        states.append((inside or main) and not side and tag not in HIDDEN)
    return states


def _place(name: str) -> int:
    return xxhash.xxh64_intdigest(name) % PLACES


def features(page: Page) -> list[list[str]]:
    """Names of the features of each element."""
    n = len(page.tags)
    own, linked = [0] * n, [0] * n
    anchors = [False] * n
    for i, (tag, parent) in enumerate(zip(page.tags, page.parents)):
        anchors[i] = tag == "a" or parent >= 0 and anchors[parent]
    for piece in page.pieces:
        if piece:
            size = len(piece[1].strip())
            own[piece[0]] += size
            linked[piece[0]] += size * anchors[piece[0]]
    whole, whole_linked = own[:], linked[:]
    for i in range(n - 1, 0, -1):
        whole[page.parents[i]] += whole[i]
        whole_linked[page.parents[i]] += whole_linked[i]
    out = []
    for i in range(n):
        links = 4 * whole_linked[i] // whole[i] if whole[i] else 0
        # One feature, because its parts go together.
        names = [f"text {own[i].bit_length()} {whole[i].bit_length()} {links}"]
        names.extend({f"word {w}" for w in page.words[i]})
        out.append(names)
    return out


@dataclass
class TreeModel:
    """Log-odds of features and the log-potentials of (parent, child) states by tag."""

    odds: dict[int, float]
    links: dict[int, tuple[float, float, float, float]]
    link_default: tuple[float, float, float, float]
    root: float

    def marginals(self, page: Page) -> list[float]:
        """Probability that each element is content, by messages up and down the tree."""
        n = len(page.tags)
        local = [sum(self.odds.get(_place(f), 0.0) for f in names) for names in features(page)]
        links = [self.links.get(_place(f"tag {t}"), self.link_default) for t in page.tags]
        # Messages as log-odds: up[i] goes from i to its parent.
        belief, up = local[:], [0.0] * n
        for i in range(n - 1, 0, -1):
            up[i] = _through(links[i], belief[i])
            belief[page.parents[i]] += up[i]
        belief[0] += self.root
        for i in range(1, n):
            parent = page.parents[i]
            off_off, off_on, on_off, on_on = links[i]
            rest = belief[parent] - up[i]
            belief[i] += _through((off_off, on_off, off_on, on_on), rest)
        return [1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, b)))) for b in belief]


def _through(link: tuple[float, float, float, float], odds: float) -> float:
    """Log-odds sent over a link (a0b0, a0b1, a1b0, a1b1) to a, from log-odds at b."""
    a0b0, a0b1, a1b0, a1b1 = link
    return _log_sum(a1b0, a1b1 + odds) - _log_sum(a0b0, a0b1 + odds)


def _log_sum(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(max(low - high, -700.0)))


def fit(df: DataFrame, html: str = "html") -> TreeModel:
    """Count features and links of all labelled pages; at most 6 x PLACES sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                page = parse(text)
                states = labels(page)
                if states is None:
                    continue
                for names, state in zip(features(page), states):
                    seen[-1, -1, state] += 1
                    for name in names:
                        seen[_place(name), -1, state] += 1
                for tag, parent, state in zip(page.tags[1:], page.parents[1:], states[1:]):
                    seen[_place(f"tag {tag}"), int(states[parent]), state] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array([int(k[i]) for k in keys], pa.int32()) for i in range(3)),
                pa.array([seen[k] for k in keys], pa.int64()),
            ],
            names=["place", "parent", "state", "n"],
        )

    pages = df.select(F.col(html).alias("html")).where("html is not null")
    found = (
        pages.mapInArrow(count, "place int, parent int, state int, n bigint")
        .groupBy("place", "parent", "state")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    sums = Counter({(r.place, r.parent, r.state): float(r.n) for r in found})
    # A tag that was seen too little goes by all tags without a meaning of their own.
    pairs = ((0, 0), (0, 1), (1, 0), (1, 1))
    named = {_place(f"tag {t}") for t in MAIN_TAGS | SIDE_TAGS}
    pooled = [0.0] * 4
    for (place, parent, state), n in sums.items():
        if parent >= 0 and place not in named:
            pooled[2 * parent + state] += n
    default = [
        (1 - LEAST_ON) + 4 * pooled[0] / (1 + pooled[0] + pooled[1]),
        LEAST_ON + 4 * pooled[1] / (1 + pooled[0] + pooled[1]),
        LEAST_OFF + 4 * pooled[2] / (1 + pooled[2] + pooled[3]),
        (1 - LEAST_OFF) + 4 * pooled[3] / (1 + pooled[2] + pooled[3]),
    ]
    total = [max(sums[-1, -1, s], 2 * PRIOR) for s in (0, 1)]
    for side in SIDE_TAGS:
        sums[_place(f"tag {side}"), 1, 0] += PRIOR
        sums[_place(f"tag {side}"), 0, 0] += PRIOR
    for tag in MAIN_TAGS:
        sums[_place(f"tag {tag}"), 0, 1] += PRIOR
    priors = ((SIDE_WORDS, 0, SIDE_WORD_ELSEWHERE), (MAIN_WORDS, 1, MAIN_WORD_ELSEWHERE))
    least = dict.fromkeys((p for p, a, _ in sums if p >= 0 and a < 0), 0.5)
    for words, state, elsewhere in priors:
        for place in {_place(f"word {w}") for w in words}:
            sums[place, -1, state] += WORD_SHARE * total[state]
            sums[place, -1, 1 - state] += WORD_SHARE * elsewhere * total[1 - state]
            least[place] = 0.0
    places = {p for p, a, _ in sums if p >= 0 and a < 0}
    odds = {
        p: math.log((sums[p, -1, 1] + least[p]) / (total[1] + 1))
        - math.log((sums[p, -1, 0] + least[p]) / (total[0] + 1))
        for p in places
    }

    def link(counts: list[float]) -> tuple[float, float, float, float]:
        on_in_off = max(LEAST_ON, counts[1] / (counts[0] + counts[1]))
        off_in_on = max(LEAST_OFF, counts[2] / (counts[2] + counts[3]))
        chances = (1 - on_in_off, on_in_off, off_in_on, 1 - off_in_on)
        return tuple(math.log(max(c, LEAST_ON)) for c in chances)

    links = {
        p: link([sums[p, a, s] + d for (a, s), d in zip(pairs, default)])
        for p in {p for p, a, _ in sums if a >= 0}
    }
    # The page itself is not content unless much speaks for it.
    return TreeModel(odds, links, link(default), math.log(LEAST_OFF))


def blocks(page: Page, chances: list[float]) -> list[tuple[str, float]]:
    """Text blocks in page order, white space joined, with the chance of their surest piece."""
    out: list[tuple[str, float]] = []
    parts: list[str] = []
    chance = 0.0
    for piece in [*page.pieces, None]:
        if piece is not None:
            if chances[piece[0]] >= 0.5:
                parts.append(piece[1])
                chance = max(chance, chances[piece[0]])
            continue
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, chance))
        parts, chance = [], 0.0
    return out


def extract(df: DataFrame, model: TreeModel, html: str = "html") -> DataFrame:
    """``df`` with the main ``text`` and its ``blocks`` with their content marginals."""
    added = ["text", "blocks"]
    kept = [c for c in df.columns if c not in added]
    shared = df.sparkSession.sparkContext.broadcast(model)
    block_type = pa.list_(pa.struct([("block", pa.string()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = []
            for value in batch.column(html).to_pylist():
                page = parse(value) if value else None
                found.append(blocks(page, own.marginals(page)) if page else [])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array(["\n".join(b for b, _ in row) for row in found], pa.string()),
                    pa.array([[{"block": b, "chance": c} for b, c in row] for row in found], block_type),
                ],
                names=[*kept, *added],
            )

    pair = T.StructType(
        [T.StructField("block", T.StringType()), T.StructField("chance", T.DoubleType())]
    )
    fields = [T.StructField("text", T.StringType()), T.StructField("blocks", T.ArrayType(pair))]
    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), *fields]))
