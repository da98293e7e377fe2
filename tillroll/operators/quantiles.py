"""Exact, linearly interpolated quantiles that no single task has to hold."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The sketch returns a value whose rank is off by at most rows / accuracy.
SKETCH_ACCURACY = 10_000
# Rows inside a bracket that are sorted; wider brackets are narrowed first, in so many steps.
MAX_INSIDE = 200_000
NARROW_STEPS = 500


def to_long(df: DataFrame, columns: list[str], key: str | None = None) -> DataFrame:
    """(key,) feature, value rows from numeric columns, all in one pass."""
    cells = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for c in columns
    ]
    return df.select(*([key] if key else []), F.inline(F.array(*cells)))


def _number(column: str = "value"):
    """The value, or null where it is not a number."""
    return F.when(~F.isnan(column), F.col(column))


def _sketch(values: DataFrame, probabilities: list[float], accuracy: int, *more) -> list:
    """One row per feature: n, min, max, values around each wanted rank, and ``more``."""
    reach = 4.0 / accuracy
    bounds = [p for q in probabilities for p in (max(0.0, q - reach), min(1.0, q + reach))]
    found = values.groupBy("feature").agg(
        F.percentile_approx(_number(), bounds, accuracy).alias("cut"),
        F.count(_number()).alias("n"),
        F.min(_number()).alias("low"),
        F.max(_number()).alias("high"),
        *more,
    )
    return found.where("n > 0").collect()


def _first_brackets(sketch: list, probabilities: list[float], accuracy: int) -> dict[str, list]:
    """(probability, low, high, rows at most inside) of every wanted rank, per feature."""
    found = {}
    for row in sketch:
        # Between few rows one rank is wider than a bracket; they are all sorted.
        few = row["n"] <= 2 * accuracy
        found[row["feature"]] = [
            (q, row["low"], row["high"], row["n"])
            if few
            else (q, row["cut"][2 * i], row["cut"][2 * i + 1], math.ceil(10 * row["n"] / accuracy))
            for i, q in enumerate(probabilities)
        ]
    return found


def _narrowed(values: DataFrame, brackets: dict[str, list], sizes: dict[str, int], accuracy: int):
    """Brackets around the same ranks with about a hundredth of the rows, by one scan.

    The values strictly inside each bracket get a sketch of their own. Copies of an end count apart:
    when a rank falls among them the bracket closes on that value.
    """
    count = max(len(b) for b in brackets.values())
    bounds = values.sparkSession.createDataFrame(
        [(f, [b[1] for b in own], [b[2] for b in own]) for f, own in brackets.items()],
        "feature string, low array<double>, high array<double>",
    )
    steps = [i / NARROW_STEPS for i in range(NARROW_STEPS + 1)]
    x, cells = _number(), []
    for i in range(count):
        low, high = F.col("low")[i], F.col("high")[i]
        inner = F.when((x > low) & (x < high), x)
        cells.append(
            F.struct(
                F.count_if(x < low).alias("below"),
                F.count_if(x == low).alias("at_low"),
                F.count(inner).alias("inner"),
                F.count_if((x == high) & (low < high)).alias("at_high"),
                F.percentile_approx(inner, steps, accuracy).alias("grid"),
            ).alias(f"c{i}")
        )
    rows = values.join(F.broadcast(bounds), "feature").groupBy("feature").agg(*cells).collect()
    found = {}
    for row in rows:
        own = []
        for i, (q, low, high, _) in enumerate(brackets[row["feature"]]):
            cell, rank = row[f"c{i}"], q * (sizes[row["feature"]] - 1)
            first = math.floor(rank) - cell["below"]
            last = math.ceil(rank) - cell["below"]
            if first < 0 or last >= cell["at_low"] + cell["inner"] + cell["at_high"]:
                raise ValueError("a quantile fell outside its bracket")
            inner = cell["inner"]
            # Steps of the sketch around the rank, with a step to spare for its error.
            scale = NARROW_STEPS / max(inner, 1)
            start = min(math.floor((first - cell["at_low"]) * scale) - 2, NARROW_STEPS)
            stop = max(math.ceil((last - cell["at_low"]) * scale) + 2, 0)
            new_low = cell["grid"][start] if inner and start >= 0 else low
            new_high = cell["grid"][stop] if inner and stop <= NARROW_STEPS else high
            if last < cell["at_low"]:
                new_high, inner = low, 0
            elif first >= cell["at_low"] + inner:
                new_low, inner = high, 0
            own.append((q, new_low, new_high, math.ceil(inner * 7 / NARROW_STEPS)))
        found[row["feature"]] = own
    return found


def exact_quantiles(
    values: DataFrame, probabilities: list[float], accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """Quantiles of ``value`` per ``feature``: columns feature, probability, quantile.

    The built-in ``percentile`` keeps every distinct value of a group in one task. Here a
    sketch first brackets each wanted rank. A bracket that may hold more than MAX_INSIDE rows is
    narrowed about a hundredfold by another scan, so the sort never sees more, whatever the rows.
    The last scan counts the rows below each bracket and the copies of the values inside it, and
    the two order statistics around the rank are picked from those. The result is exact for any
    ``accuracy``. Two scans do for some hundred million rows, each hundredfold more takes one more.
    """
    return _picked(values, _sketch(values, probabilities, accuracy), probabilities, accuracy)


def _picked(
    values: DataFrame, sketch: list, probabilities: list[float], accuracy: int
) -> DataFrame:
    brackets = _first_brackets(sketch, probabilities, accuracy)
    sizes = {row["feature"]: row["n"] for row in sketch}
    while True:
        wide = {f: own for f, own in brackets.items() if any(b[3] > MAX_INSIDE for b in own)}
        if not wide:
            break
        brackets |= _narrowed(values, wide, sizes, accuracy)
    # One bracket row per feature column, whatever the number of rows.
    table = values.sparkSession.createDataFrame(
        [(f, [b[:3] for b in own]) for f, own in brackets.items()],
        "feature string, wanted array<struct<probability: double, low: double, high: double>>",
    )
    spots = range(len(probabilities))
    any_inside = F.lit(False)
    for w in (F.col("wanted")[i] for i in spots):
        any_inside = any_inside | F.col("value").between(w["low"], w["high"])
    counted = (
        values.where(F.col("value").isNotNull() & ~F.isnan("value"))
        .join(F.broadcast(table), "feature")
        .groupBy("feature", F.when(any_inside, F.col("value")).alias("value"))
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.array(
                *[F.count_if(F.col("value") < F.col("wanted")[i]["low"]) for i in spots]
            ).alias("smaller"),
        )
        .join(F.broadcast(table), "feature")
        .select("feature", "value", "copies", "smaller", F.posexplode("wanted").alias("i", "w"))
        .select(
            "feature",
            F.col("w.probability").alias("probability"),
            F.when(F.col("value").between(F.col("w.low"), F.col("w.high")), F.col("value")).alias(
                "value"
            ),
            "copies",
            F.col("smaller")[F.col("i")].alias("below"),
        )
    )
    group = Window.partitionBy("feature", "probability")
    inside_copies = F.when(F.col("value").isNotNull(), F.col("copies")).otherwise(0)
    ranked = counted.select(
        "feature",
        "probability",
        "value",
        F.sum("copies").over(group).alias("rows"),
        F.sum("below").over(group).alias("below"),
        F.sum(inside_copies).over(group.orderBy(F.asc_nulls_first("value"))).alias("inside"),
    ).withColumn("rank", F.col("probability") * (F.col("rows") - 1))

    # The order statistic at 0-based rank r is the first value with more than r rows up to it.
    def statistic(rank):
        return F.min(F.when(F.col("below") + F.col("inside") > rank, F.col("value")))

    lower, upper = F.floor("rank"), F.ceil("rank")
    picked = (
        ranked.filter(F.col("value").isNotNull())
        .groupBy("feature", "probability")
        .agg(
            F.any_value("rank").alias("rank"),
            F.any_value("below").alias("below"),
            statistic(lower).alias("lo"),
            statistic(upper).alias("hi"),
        )
    )
    bracketed = (F.col("below") <= F.floor("rank")) & F.col("hi").isNotNull()
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("rank") - F.floor("rank"))
    missed = F.raise_error(F.lit("a quantile fell outside its bracket")).cast("double")
    return picked.select(
        "feature", "probability", F.when(bracketed, value).otherwise(missed).alias("quantile")
    )


def _wide(found: DataFrame, names: dict[str, float]) -> DataFrame:
    return found.groupBy("feature").agg(
        *[
            F.max(F.when(F.col("probability") == F.lit(float(q)), F.col("quantile"))).alias(name)
            for name, q in names.items()
        ]
    )


def quantiles_wide(values: DataFrame, names: dict[str, float]) -> DataFrame:
    """One row per feature with one named column per probability."""
    return _wide(exact_quantiles(values, list(names.values())), names)


def below_quantile(df: DataFrame, column: str, probability: float = 0.99) -> DataFrame:
    """Rows whose ``column`` is strictly below its quantile."""
    cut = exact_quantiles(to_long(df, [column]), [probability])
    return df.filter(F.col(column) < cut.select("quantile").scalar())


def describe(values: DataFrame) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per feature of a long table.

    The moments come from the scan that brackets the quartiles.
    """
    names = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    moments = {
        "count": F.count("value"),
        "mean": F.avg("value"),
        "std": F.stddev_samp("value"),
        "min": F.min("value"),
        "max": F.max("value"),
    }
    probabilities = list(names.values())
    sketch = _sketch(
        values, probabilities, SKETCH_ACCURACY, *[c.alias(name) for name, c in moments.items()]
    )
    known = values.sparkSession.createDataFrame(
        [tuple(row[c] for c in ("feature", *moments)) for row in sketch],
        "feature string, count bigint, mean double, std double, min double, max double",
    )
    quartiles = _wide(_picked(values, sketch, probabilities, SKETCH_ACCURACY), names)
    return quartiles.join(F.broadcast(known), "feature").select(
        "feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )
