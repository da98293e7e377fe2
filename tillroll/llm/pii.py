"""Personal data in texts by weak supervision, with DataFrame functions only.

Spans of four kinds are found by their patterns and always kept. Looser patterns give further
candidates: obfuscated mail addresses and numbers with separators. On every candidate (and on the
pattern spans, from which the labelers are learned) labelers vote 1, 0 or abstain (-1): shapes and
check digits, gazetteers, and the words around. Expectation-maximisation over the counted vote
patterns estimates each labeler's reliability and the chance of each pattern; a logistic span
classifier over the candidate's features is trained on those chances, and candidates with a
probability of at least 0.5 for which some labeler voted 1 are added.

Only counts per (votes, features) reach the driver; their number is bounded by the number of
such combinations, not by the data. Everything per text is one expression per row.

Patterns use possessive loops, so that long runs cost neither stack nor quadratic time.

Edge cases: a null text is an empty text and has no span; without any candidate the classifier
adds none; equal rows have equal spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import stored, whole_text

KINDS = ["email", "ip", "card", "phone"]

_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
# A match that starts inside a run would also start at the run's begin or at the last match's end.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "mail": rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\(at\)|\[at\]|@) ?{_LABEL}++"
    rf"(?: ?(?:\(dot\)|\[dot\]|\.) ?{_LABEL}++)++",
    "number": r"(?<![A-Za-z0-9.+-])[(]?[0-9](?:[ ().-]{0,2}[0-9])++",
}

MAIL_HOSTS = "gmail|googlemail|yahoo|hotmail|outlook|icloud|aol|gmx|web|mail|posteo|orange|free"
CALL_WORDS = "tel|telephone|phone|call|fax|mobile|cell|whatsapp|sms|telefon|teléfono|téléphone"
CARD_WORDS = "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta"
MAIL_WORDS = "mail|email|e-mail|contact|write|kontakt|correo|courriel"
NOT_WORDS = "version|page|figure|table|isbn|issn|doi|chapter|line|order|invoice|article|section"

#: Characters before a span that the context labelers read.
CONTEXT = 24
FEATURES = ["mail", "area", "grouped", "check", "failed", "word", "host", "not_word", "dated", "long", "known"]


def _spans(text: Column, pattern: str) -> Column:
    """(start, end, match) of all matches in order, in characters, by the lengths between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    none = F.array().cast("array<struct<start: int, end: int, match: string>>")

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    laid = F.aggregate(pairs, start, add, lambda state: state["out"])
    return F.when(text.rlike(pattern), laid).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string holds."""

    def add(total: Column, place: Column) -> Column:
        digit = F.substr(digits, F.char_length(digits) - place + 1, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(place % 2 == 0, twice).otherwise(digit)

    places = F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1)))
    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(match, r"\."),
            lambda part: (F.char_length(F.regexp_replace(part, "^0+", "")) <= 3)
            & (F.right(part, F.lit(3)).cast("int") <= 255),
        )
    if kind == "card":
        digits = _digits(match)
        return F.char_length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.char_length(_digits(match)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind that pass its check."""
    return F.filter(_spans(text, BASE[kind]), lambda span: _passes(kind, span["match"]))


def _features(text: Column, kind: Column, span: Column, known: Column) -> Column:
    """What the labelers and the classifier see of a span."""
    match, digits = span["match"], _digits(span["match"])
    begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = F.lower(F.substr(text, begin + 1, span["start"] - begin))
    words = F.when(kind == "email", before.rlike(rf"\b(?:{MAIL_WORDS})\b")).otherwise(
        before.rlike(rf"\b(?:{CALL_WORDS}|{CARD_WORDS})\b")
    )
    flags = {
        "mail": kind == "email",
        "area": match.rlike(r"^(?:\+1 ?)?[(]?[2-9][0-9]{2}[)]?[ .-]{0,2}[2-9][0-9]{2}[ .-]?[0-9]{4}$"),
        "grouped": match.rlike(r"^[0-9]{4}(?:[ -][0-9]{4}){2,3}[0-9]{0,3}$"),
        "check": F.char_length(digits).between(13, 19) & _luhn(digits),
        "failed": (F.char_length(digits) >= 13) & ~_luhn(digits),
        "word": words,
        "host": match.rlike(rf"(?i)(?:@|at[\])]) ?(?:{MAIL_HOSTS})[0-9]*\b"),
        "not_word": before.rlike(rf"(?:[$€£#=]|\b(?:{NOT_WORDS})\b.?) ?$"),
        "dated": match.rlike(
            r"^(?:(?:19|20)[0-9]{2}[ .-].*|[0-9]{1,2}[.-][0-9]{1,2}[.-](?:19|20)[0-9]{2}.*"
            r"|[0-9]{1,3}(?:[ .][0-9]{3})+|[0-9]+[.][0-9]+)$"
        ),
        "long": F.char_length(digits) > 19,
        "known": known,
    }
    return F.struct(*[F.coalesce(flags[f], F.lit(False)).alias(f) for f in FEATURES])


def _votes(f: Column) -> dict[str, Column]:
    """1, 0 or -1 of every labeler."""

    def vote(yes: Column, no: Column) -> Column:
        return F.when(no, 0).when(yes, 1).otherwise(-1)

    never = F.lit(False)
    return {
        "pattern": vote(f["known"], never),
        "shape": vote(f["area"] | f["grouped"], f["dated"] | f["long"]),
        "check": vote(f["check"], f["failed"]),
        "gazetteer": vote(f["host"], f["not_word"]),
        "context": vote(f["word"], f["not_word"]),
        "form": vote(f["mail"], f["long"]),
    }


def _candidates(text: Column, base: dict[str, str]) -> Column:
    """(kind, start, end, f) of pattern spans and of looser candidates that touch none of them."""
    every = F.concat(*[F.col(c) for c in base.values()])

    def described(spans: Column, kind_of, known: bool) -> Column:
        def one(s: Column) -> Column:
            kind = kind_of(_digits(s["match"]))
            seen = _features(text, kind, s, F.lit(known))
            return F.struct(kind.alias("kind"), s["start"], s["end"], seen.alias("f"))

        return F.transform(spans, one)

    def free(pattern: str, least_digits: int) -> Column:
        return F.filter(
            _spans(text, pattern),
            lambda s: (F.char_length(_digits(s["match"])) >= least_digits)
            & ~F.exists(every, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        )

    def number(digits: Column) -> Column:
        return F.when(F.char_length(digits) >= 13, "card").otherwise("phone")

    def fixed(kind: str):
        return lambda digits: F.lit(kind)

    return F.concat(
        *[described(F.col(c), fixed(kind), True) for kind, c in base.items()],
        described(free(LOOSE["mail"], 0), fixed("email"), False),
        described(free(LOOSE["number"], 7), number, False),
    )


# ---- reliabilities and classifier ------------------------------------------------------------


@dataclass
class LabelModel:
    """Prior chance and, per labeler, the chances of votes -1, 0, 1 under either class."""

    prior: float
    rates: list[list[list[float]]]  # labeler, class, vote + 1

    def chance(self, votes: tuple[int, ...]) -> float:
        odds = math.log(self.prior / (1 - self.prior))
        for rate, vote in zip(self.rates, votes):
            odds += math.log(rate[1][vote + 1] / rate[0][vote + 1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def fit_labelers(counts: dict[tuple[int, ...], float], rounds: int = 25) -> LabelModel:
    """EM over counted vote patterns, from the majority vote; pseudo-counts favour right votes."""
    size = len(next(iter(counts), ()))
    right = [[[2.0, 3.0, 1.0], [2.0, 1.0, 3.0]]] * size

    def share(votes: tuple[int, ...]) -> float:
        said = [v for v in votes if v >= 0]
        return (sum(said) + 0.5) / (len(said) + 1)

    chances = {v: share(v) for v in counts}
    model = LabelModel(0.5, [])
    for _ in range(rounds):
        total = sum(counts.values())
        yes = sum(n * chances[v] for v, n in counts.items())
        rates = []
        for j in range(size):
            sums = [list(row) for row in right[j]]
            for votes, n in counts.items():
                sums[1][votes[j] + 1] += n * chances[votes]
                sums[0][votes[j] + 1] += n * (1 - chances[votes])
            rates.append([[x / sum(row) for x in row] for row in sums])
        model = LabelModel((yes + 1) / (total + 2), rates)
        chances = {v: model.chance(v) for v in counts}
    return model


def fit_classifier(
    rows: list[tuple[tuple[bool, ...], float, float]], rounds: int = 300, ridge: float = 1.0
) -> list[float]:
    """Logistic weights (bias first) for features with a chance and a count, by gradient steps."""
    weights = [0.0] * (len(FEATURES) + 1)
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        slope = [ridge * w / total for w in weights]
        slope[0] = 0.0
        for flags, chance, n in rows:
            odds = weights[0] + sum(w for w, f in zip(weights[1:], flags) if f)
            gap = (1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) - chance) * n / total
            slope[0] += gap
            for i, f in enumerate(flags):
                if f:
                    slope[i + 1] += gap
        weights = [w - 2.0 * s for w, s in zip(weights, slope)]
    return weights


def train(candidates: DataFrame) -> list[float]:
    """Classifier weights from a table with a column ``f`` of features."""
    f = F.col("f")
    votes = _votes(f)
    counted = (
        candidates.select(
            F.array(*votes.values()).alias("votes"), F.array(*[f[x] for x in FEATURES]).alias("flags")
        )
        .groupBy("votes", "flags")
        .count()
        .collect()
    )
    patterns: dict[tuple[int, ...], float] = {}
    for r in counted:
        patterns[tuple(r["votes"])] = patterns.get(tuple(r["votes"]), 0.0) + r["count"]
    model = fit_labelers(patterns)
    return fit_classifier(
        [(tuple(r["flags"]), model.chance(tuple(r["votes"])), float(r["count"])) for r in counted]
    )


def probability(f: Column, weights: list[float]) -> Column:
    """The classifier's probability for a feature struct."""
    parts = [F.when(f[name], w).otherwise(0.0) for name, w in zip(FEATURES, weights[1:])]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts, F.lit(weights[0]))))


def find(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with ``base`` and ``spans``: arrays of (kind, start, end) by kind, then start.

    ``base`` has the pattern spans, ``spans`` also those that the classifier adds. Columns of these
    names are replaced. The spans and features of all rows are stored once and read twice.
    """
    kept = [c for c in df.columns if c not in ("base", "spans")]
    columns = {kind: f"_{kind}" for kind in KINDS}
    whole = F.col("_whole")
    wide = df.select(*kept, whole_text(text).alias("_whole"))
    wide = wide.withColumns({c: base_spans(whole, kind) for kind, c in columns.items()})
    wide = wide.withColumn("_found", _candidates(whole, columns))
    kept = kept if keep_text else [c for c in kept if c != text]
    rows = stored(wide.select(*kept, "_found"), "pii-candidates")
    weights = train(rows.select(F.explode("_found").alias("c")).select("c.f"))

    def listed(chosen: Column) -> Column:
        order = F.array(*[F.lit(k) for k in KINDS])
        keyed = F.transform(
            chosen,
            lambda s: F.struct(
                F.array_position(order, s["kind"]).alias("at"), s["start"], s["end"], s["kind"]
            ),
        )
        return F.transform(
            F.array_sort(keyed), lambda s: F.struct(s["kind"], s["start"], s["end"])
        )

    found = F.col("_found")
    base = F.filter(found, lambda s: s["f"]["known"])

    def added(s: Column) -> Column:
        supported = F.array_contains(F.array(*_votes(s["f"]).values()), 1)
        return supported & (probability(s["f"], weights) >= 0.5)

    every = F.filter(found, lambda s: s["f"]["known"] | added(s))
    return rows.select(*kept, listed(base).alias("base"), listed(every).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets.

    Overlapping spans are replaced together, from the start of the first to the end of the last, by
    the kind of the first.
    """
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["kind"]))
    )

    def put(state: Column, s: Column) -> Column:
        gap = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        sign = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        end = F.greatest(state["at"], -s["back"])
        out = F.when(s["start"] < state["at"], state["out"]).otherwise(
            F.concat(state["out"], gap, sign)
        )
        return F.struct(end.alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.char_length(text)
    masked = F.aggregate(
        ordered, start, put,
        lambda state: F.concat(state["out"], F.substr(text, state["at"] + 1, rest)),
    )
    return F.when(F.size(spans) > 0, masked).otherwise(text)
