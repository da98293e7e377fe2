"""Correlations of columns: of their values and of their ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.quantiles import to_long
from tillroll.operators.ranking import running_sums
from tillroll.schema import FEATURES
from tillroll.session import stage


def average_ranks(long: DataFrame) -> DataFrame:
    """feature, value, rank for the distinct values: the mean position of the rows that hold one.

    Equal values are counted before anything is sorted, so a value of many rows is one row.
    """
    values = long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count("*").alias("n")
    )
    upto = running_sums(values, ["feature"], [F.asc("value")], {"last": "n"}, "ranks")
    return upto.select("feature", "value", (F.col("last") - (F.col("n") - 1) / 2).alias("rank"))


def ranked(table: DataFrame, columns: list[str] = FEATURES, key: str = "CustomerID") -> DataFrame:
    """``key`` and the average rank of every column; a missing value has none."""
    long = to_long(table, columns, key)
    ranks = stage(average_ranks(long), "average-ranks")
    placed = long.join(ranks, ["feature", "value"])
    return table.select(key).join(
        placed.groupBy(key).agg(*[F.max(F.when(F.col("feature") == c, F.col("rank"))).alias(c) for c in columns]),
        key,
        "left",
    )


def _pairs(table: DataFrame, columns: list[str], name: str) -> DataFrame:
    """a, b and the correlation of every pair, from one pass; tasks send one row per pair."""
    cells = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[: i + 1]):
            x, y = F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), x, y))
    spread = F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))
    found = (
        table.select(F.inline(F.array(*cells)))
        .where("x is not null and y is not null")
        .groupBy("i", "j")
        .agg((F.covar_pop("x", "y") / spread).alias(name))
    )
    names = F.array(*[F.lit(c) for c in columns])
    a, b = F.element_at(names, F.col("i") + 1), F.element_at(names, F.col("j") + 1)
    both = F.array(
        F.struct(a.alias("a"), b.alias("b"), name), F.struct(b.alias("a"), a.alias("b"), name)
    )
    once = F.array(F.struct(a.alias("a"), b.alias("b"), name))
    return found.select(F.inline(F.when(F.col("i") == F.col("j"), once).otherwise(both)))


def correlation(table: DataFrame, columns: list[str] = FEATURES, key: str = "CustomerID") -> DataFrame:
    """a, b, pearson, spearman for every ordered pair of columns, a column with itself included.

    A constant column correlates with nothing, itself included: null. Rows that lack one of two
    values do not count for that pair; a pair without any row is left out.
    """
    table = stage(table.select(key, *columns), "correlated")
    ranks = stage(ranked(table, columns, key), "ranked")
    return _pairs(table, columns, "pearson").join(_pairs(ranks, columns, "spearman"), ["a", "b"])
