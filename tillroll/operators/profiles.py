"""Sizes, means and radar profiles of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import label_of, persona_of
from tillroll.schema import FEATURE_LABELS, FEATURES


def attach_labels(df: DataFrame, labels: DataFrame, key: str = "CustomerID") -> DataFrame:
    """Cluster labels joined to any table by customer, one output row per label."""
    return df.join(labels, key)


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """k, Cluster, customers, share_pct from rows (k, CustomerID, Cluster)."""
    whole = Window.partitionBy("k")
    return (
        labels.groupBy("k", "Cluster")
        .agg(F.count(F.lit(1)).alias("customers"))
        .withColumn("share_pct", F.col("customers") * 100.0 / F.sum("customers").over(whole))
        .orderBy("k", "Cluster")
    )


def cluster_means_wide(
    original: DataFrame, labels: DataFrame, columns: list[str] = FEATURES
) -> DataFrame:
    """Mean of every original feature per k and cluster, one column per feature."""
    return (
        attach_labels(original, labels)
        .groupBy("k", "Cluster")
        .agg(*[F.avg(c).alias(c) for c in columns])
    )


def cluster_means(
    original: DataFrame, labels: DataFrame, columns: list[str] = FEATURES
) -> DataFrame:
    """The means in long form: k, Cluster, feature, mean."""
    wide = cluster_means_wide(original, labels, columns)
    return wide.unpivot(["k", "Cluster"], columns, "feature", "mean")


def radar_profile(
    means: DataFrame,
    axes: dict[str, str],
    names: dict[int, list[str]] | None = None,
    fallback: str = "Nhóm",
) -> DataFrame:
    """Cluster means on the chosen axes, scaled to [0, 1] over the clusters of the same k.

    An axis on which all clusters agree is 0. ``means`` has columns k, Cluster, feature, mean.
    """
    over_clusters = Window.partitionBy("k", "feature")
    low, high = F.min("mean").over(over_clusters), F.max("mean").over(over_clusters)
    scaled = means.filter(F.col("feature").isin(list(axes))).withColumn(
        "value", F.coalesce(F.try_divide(F.col("mean") - low, high - low), F.lit(0.0))
    )
    return with_personas(scaled, names, fallback).select(
        "k",
        "Cluster",
        "persona",
        "feature",
        label_of(F.col("feature"), axes).alias("axis"),
        "mean",
        "value",
    )


def with_personas(
    clusters: DataFrame, names: dict[int, list[str]] | None = None, fallback: str = "Nhóm"
) -> DataFrame:
    """Add the persona of each (k, Cluster) by position in ``names[k]``."""
    persona = persona_of(F.col("Cluster"), None, fallback)
    for k, listed in (names or {}).items():
        named = persona_of(F.col("Cluster"), listed, fallback)
        persona = F.when(F.col("k") == k, named).otherwise(persona)
    return clusters.withColumn("persona", persona)


def with_feature_labels(df: DataFrame, labels: dict[str, str] = FEATURE_LABELS) -> DataFrame:
    return df.withColumn("label", label_of(F.col("feature"), labels))
