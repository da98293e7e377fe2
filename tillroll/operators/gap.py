"""Choice of the number of clusters by the gap statistic.

The dispersion of k clusters (their inertia) is held against that of tables without any clusters:
uniform draws inside the ranges of the columns, with as many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.clustering import fit_kmeans
from tillroll.schema import FEATURES

DRAWS = 10
STARTS = 3
SEED = 42


def column_ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of each column, from one aggregation; (0, 0) without rows."""
    found = df.agg(*[F.min(c) for c in columns], *[F.max(c) for c in columns]).first()
    n = len(columns)
    return {c: (float(found[i] or 0), float(found[n + i] or 0)) for i, c in enumerate(columns)}


def reference_draw(
    df: DataFrame,
    ranges: dict[str, tuple[float, float]],
    draw: int,
    seed: int = SEED,
    key: str = "CustomerID",
) -> DataFrame:
    """``key`` and a uniform value per column inside its range, one row per row of ``df``.

    A value follows from the key, the draw, the seed and the column alone, so a task that runs
    again, or another partitioning, gives the same table. ``key`` is unique.
    """
    columns = []
    for number, (name, (low, high)) in enumerate(ranges.items()):
        bits = F.xxhash64(F.col(key), F.lit(draw), F.lit(seed), F.lit(number))
        share = F.shiftrightunsigned(bits, 11) * 2.0**-53
        columns.append((F.lit(low) + (high - low) * share).alias(name))
    return df.select(key, *columns)


def _inertias(df: DataFrame, k_values: list[int], columns: list[str], options: dict):
    """(k, inertia) of the fits; a single cluster is the whole table."""
    found = {}
    if 1 in k_values:
        squares = [F.var_pop(c) * F.count(c) for c in columns]
        found[1] = float(sum(x or 0.0 for x in df.agg(*squares).first()))
    several = [k for k in k_values if k > 1]
    if several:
        fits = fit_kmeans(df, several, columns=columns, order_by=columns[0], **options)
        found |= {k: fit.inertia for k, fit in fits.items()}
    return sorted(found.items())


def dispersions(
    scaled: DataFrame,
    k_values,
    columns: list[str] = FEATURES,
    draws: int = DRAWS,
    n_init: int = STARTS,
    seed: int = SEED,
    key: str = "CustomerID",
    **options,
) -> DataFrame:
    """k, draw, dispersion: of the rows themselves (draw is null) and of every reference draw.

    The table and the draws are clustered alike, with ``n_init`` starts; ``options`` go to
    ``fit_kmeans``. The result has one row per k and draw.
    """
    k_values, columns = sorted(set(k_values)), list(columns)
    settings = {"n_init": n_init, "key": key, **options}
    ranges = column_ranges(scaled, columns)
    tables = [(None, scaled.select(key, *columns))]
    tables += [(d, reference_draw(scaled, ranges, d, seed, key)) for d in range(draws)]
    rows = [
        (k, draw, float(inertia))
        for draw, table in tables
        for k, inertia in _inertias(table, k_values, columns, settings)
    ]
    return scaled.sparkSession.createDataFrame(rows, "k int, draw int, dispersion double")


def gap_table(dispersed: DataFrame) -> DataFrame:
    """k, gap, error and whether k is chosen, from (k, draw, dispersion).

    The gap is the mean log dispersion of the draws less that of the rows; the error is the
    standard deviation over the B draws times sqrt(1 + 1 / B). Chosen is the smallest k whose gap
    is at least the next k's gap less the next k's error, else the last k. A dispersion of 0 has
    no logarithm: a draw with it is left out, and a k whose rows have it has no gap and is not
    chosen by the rule.
    """
    logged = F.when(F.col("dispersion") > 0, F.ln("dispersion"))
    drawn = F.when(F.col("draw").isNotNull(), logged)
    own = F.when(F.col("draw").isNull(), logged)
    error = F.stddev_pop(drawn) * F.sqrt(1 + F.try_divide(F.lit(1.0), F.count(drawn)))
    table = dispersed.groupBy("k").agg(
        (F.avg(drawn) - F.max(own)).alias("gap"), error.alias("error")
    )
    # One row per k.
    following, whole = Window.orderBy("k"), Window.partitionBy()
    enough = F.col("gap") >= F.lead("gap").over(following) - F.lead("error").over(following)
    chosen = F.coalesce(F.min(F.when(F.col("enough"), F.col("k"))).over(whole), F.max("k").over(whole))
    return (
        table.withColumn("enough", enough)
        .withColumn("is_chosen", F.col("k") == chosen)
        .select("k", "gap", "error", "is_chosen")
    )
