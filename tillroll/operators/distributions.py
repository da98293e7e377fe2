"""The tables behind histograms, density curves and box plots.

All take long tables (feature, value) with a fixed, short list of features; the per-feature
statistics that are joined back are one row per feature and therefore broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import equal_width_bin
from tillroll.operators.quantiles import quantiles_wide

# Bins of a histogram, points of a density curve, whisker reach in IQRs.
BINS = 30
GRID = 200
WHISKER = 1.5

# exp(-z*z/2) is exactly 0.0 in double arithmetic for |z| above 38.7.
KERNEL_REACH = 39.0
# Distinct values of a batch that meet the grid at once.
KERNEL_ROWS = 2_048


def _present(values: DataFrame) -> DataFrame:
    return values.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def histogram(values: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width histogram per feature: feature, bin, lo, hi, count; empty bins are 0.

    A feature with a single value gets a range of half a unit to either side.
    """
    values = _present(values)
    pad = F.when(F.max("value") == F.min("value"), 0.5).otherwise(0.0)
    ranges = values.groupBy("feature").agg(
        (F.min("value") - pad).alias("low"), (F.max("value") + pad).alias("high")
    )
    counts = (
        values.join(F.broadcast(ranges), "feature")
        .groupBy(
            "feature",
            equal_width_bin(F.col("value"), F.col("low"), F.col("high"), bins).alias("bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("high") - F.col("low")) / bins
    spine = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(counts, ["feature", "bin"], "left").select(
        "feature",
        "bin",
        (F.col("low") + F.col("bin") * width).alias("lo"),
        F.when(F.col("bin") == bins - 1, F.col("high"))
        .otherwise(F.col("low") + (F.col("bin") + 1) * width)
        .alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
    )


def _kernel_sums(held: dict[str, tuple[float, float, float]], grid: int):
    """Task function: sums of the kernel on each feature's grid; ``held`` has low, step and h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {feature: np.zeros(grid) for feature in held}
        for batch in batches:
            features = batch.column(0).to_pandas()
            values = batch.column(1).to_numpy(zero_copy_only=False)
            for feature, places in features.groupby(features).indices.items():
                if feature not in held:
                    continue
                low, step, h = held[feature]
                own, times = np.unique(values[places], return_counts=True)
                for start in range(0, len(own), KERNEL_ROWS):
                    x = own[start : start + KERNEL_ROWS]
                    first = np.floor((x[0] - KERNEL_REACH * h - low) / step)
                    last = np.ceil((x[-1] + KERNEL_REACH * h - low) / step)
                    reach = np.arange(max(first, 0), min(last, grid - 1) + 1, dtype=int)
                    z = (low + reach * step - x[:, None]) / h
                    weight = times[start : start + KERNEL_ROWS].astype(float)
                    sums[feature][reach] += weight @ np.exp(-0.5 * z * z)
        columns = [
            pa.array([feature for feature in sums for _ in range(grid)], pa.string()),
            pa.array(list(range(grid)) * len(sums), pa.int32()),
            pa.array(np.concatenate([*sums.values(), np.zeros(0)])),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "point", "kernel"])

    return run


def density_curve(values: DataFrame, grid: int = GRID, bins: int = BINS) -> DataFrame:
    """Gaussian kernel density on a grid from min to max, scaled to the counts of a histogram.

    Bandwidth is Scott's: sample std times n**(-1/5). A value only visits the grid points
    where its kernel is not zero in double arithmetic; as n grows the bandwidth shrinks and
    so does the number of visits. Tasks add up whole batches, in which equal values are one, and send
    on one row per feature and grid point; no row is copied or shuffled.
    """
    values = _present(values)
    n, std = F.count("value"), F.stddev_samp("value")
    shape = values.groupBy("feature").agg(
        n.alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        (std * F.pow(n.cast("double"), F.lit(-0.2))).alias("h"),
    )
    # No curve exists for a constant feature.
    shape = shape.filter((F.col("h") > 0) & (F.col("high") > F.col("low"))).withColumn(
        "step", (F.col("high") - F.col("low")) / (grid - 1)
    )
    held = {r["feature"]: (r["low"], r["step"], r["h"]) for r in shape.collect()}
    sums = (
        values.select("feature", "value")
        .mapInArrow(_kernel_sums(held, grid), "feature string, point int, kernel double")
        .groupBy("feature", "point")
        .agg(F.sum("kernel").alias("kernel"))
    )
    scale = (F.col("high") - F.col("low")) / bins / (F.col("h") * F.sqrt(2.0 * F.pi()))
    spine = shape.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    return spine.join(sums, ["feature", "point"], "left").select(
        "feature",
        "point",
        (F.col("low") + F.col("point") * F.col("step")).alias("x"),
        (F.coalesce("kernel", F.lit(0.0)) * scale).alias("density"),
    )


def box_stats(values: DataFrame) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, and the number of outliers."""
    values = _present(values)
    quartiles = quantiles_wide(values, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    x, iqr = F.col("value"), F.col("q3") - F.col("q1")
    fence_low, fence_high = F.col("q1") - WHISKER * iqr, F.col("q3") + WHISKER * iqr
    per_feature = (
        values.join(F.broadcast(quartiles), "feature")
        .groupBy("feature")
        .agg(
            F.any_value("q1").alias("q1"),
            F.any_value("median").alias("median"),
            F.any_value("q3").alias("q3"),
            F.min(F.when(x >= fence_low, x)).alias("first_inside"),
            F.max(F.when(x <= fence_high, x)).alias("last_inside"),
            F.count_if((x < fence_low) | (x > fence_high)).alias("outliers"),
        )
    )
    # A whisker never ends inside the box.
    return per_feature.select(
        "feature",
        "q1",
        "median",
        "q3",
        F.least("first_inside", "q1").alias("whisker_low"),
        F.greatest("last_inside", "q3").alias("whisker_high"),
        "outliers",
    )
