"""Positions and running sums over a whole table, which no single task has to see."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import stage


def running_sums(
    df: DataFrame, groups: list[str], order: list, sums: dict[str, str], name: str
) -> DataFrame:
    """``df`` with running sums inside its groups, the row itself included: new column -> summed column.

    Rows are dealt out by ranges of (groups, order) and written; each range is summed up by itself and
    starts at the totals of the ranges before it. Those totals, one row per group and range that
    meet, are added up by a join of ranges with earlier ranges. ``order`` should leave no large ties,
    as equal rows lie in one range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(g) for g in groups], *order]
    dealt = df.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id())
    dealt = stage(dealt, name)
    totals = dealt.groupBy(*groups, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    totals = stage(totals, f"{name}-totals")
    earlier = totals.select(*groups, F.col("_range").alias("_of"), *[f"_{n}" for n in sums])
    here = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_range")
    same = F.col("_of") <= F.col("_range")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    own = F.col("_of") < F.col("_range")
    starts = (
        here.join(earlier, same)
        .groupBy("_range", *[f"_g{i}" for i in range(len(groups))])
        .agg(*[F.coalesce(F.sum(F.when(own, F.col(f"_{n}"))), F.lit(0)).alias(f"_s{n}") for n in sums])
    )
    starts = stage(starts, f"{name}-starts").withColumnRenamed("_range", "_start")
    match = F.col("_range") == F.col("_start")
    for i, g in enumerate(groups):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    upto = (
        Window.partitionBy(*groups, "_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return dealt.join(starts, match).select(
        *df.columns, *[(F.sum(c).over(upto) + F.col(f"_s{n}")).alias(n) for n, c in sums.items()]
    )
