"""A hierarchy of groups over many small clusters.

Ward's method needs all pairs of its items, so it is not run on rows. K-Means first folds the rows
into many small clusters; a cluster is described by its number of rows, its sums and its sum of
squares, which add up when clusters merge. The merges are found on that bounded table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.clustering import PARTITIONS, SEED
from tillroll.operators.reduction import with_vector
from tillroll.schema import FEATURES

MICRO_CLUSTERS = 200
MAX_ITER = 50

# The merges hold all distances between small clusters on the driver: 4,096 of them take 128 MB.
MAX_MICRO_CLUSTERS = 4_096


def micro_clusters(
    scaled: DataFrame,
    columns: list[str] = FEATURES,
    micro: int = MICRO_CLUSTERS,
    max_iter: int = MAX_ITER,
    seed: int = SEED,
    key: str = "CustomerID",
    partitions: int = PARTITIONS,
) -> DataFrame:
    """``key``, ``micro`` and ``vector`` (array of doubles) of every row, by a K-Means of many centers.

    Rows are dealt by key over a stated number of sorted partitions, so the labels do not depend on
    how they arrive. Fewer distinct rows than ``micro`` give fewer clusters; some numbers may be unused.
    """
    if not 2 <= micro <= MAX_MICRO_CLUSTERS:
        raise ValueError(f"from 2 to {MAX_MICRO_CLUSTERS} small clusters, not {micro}")
    dealt = scaled.repartition(partitions, key).sortWithinPartitions(key, *columns)
    vectors = with_vector(dealt, columns).select(key, "vector").persist()
    try:
        kmeans = KMeans(
            k=micro, seed=seed, maxIter=max_iter, featuresCol="vector", predictionCol="micro"
        )
        model = kmeans.fit(vectors)
    finally:
        vectors.unpersist()
    labelled = model.transform(with_vector(scaled, columns))
    return labelled.select(key, "micro", vector_to_array("vector").alias("vector"))


def cluster_features(points: DataFrame, label: str, vector: str = "vector") -> DataFrame:
    """cluster, n, sums (array), squares: the mergeable description of every cluster.

    Partial sums are taken before the shuffle, so a large cluster is no hot key. ``squares`` is the
    sum of the squared lengths of its rows.
    """
    total = Summarizer.sum(array_to_vector(F.col(vector)))
    length = F.aggregate(vector, F.lit(0.0), lambda found, x: found + x * x)
    return (
        points.select(F.col(label).alias("cluster"), vector, length.alias("length"))
        .groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("n"), total.alias("total"), F.sum("length").alias("squares")
        )
        .select("cluster", "n", vector_to_array("total").alias("sums"), "squares")
    )


def merge_features(features: DataFrame, group: str = "group") -> DataFrame:
    """cluster, n, sums, squares of groups of clusters: descriptions add up."""
    total = Summarizer.sum(array_to_vector(F.col("sums")))
    return (
        features.groupBy(F.col(group).alias("cluster"))
        .agg(F.sum("n").alias("n"), total.alias("total"), F.sum("squares").alias("squares"))
        .select("cluster", "n", vector_to_array("total").alias("sums"), "squares")
    )


def spread_within(features: DataFrame) -> DataFrame:
    """cluster, n, within: sum of squared distances of a cluster's rows to their mean."""
    length = F.aggregate("sums", F.lit(0.0), lambda found, x: found + x * x)
    within = F.greatest(F.col("squares") - length / F.col("n"), F.lit(0.0))
    return features.select("cluster", "n", within.alias("within"))


@dataclass
class Dendrogram:
    """Merges of Ward's method.

    A leaf has its cluster's number; the result of step s has the number ``first + s``, where
    ``first`` is one more than the largest leaf. ``merges`` holds step, left, right (left the smaller), cost
    and n; the cost of a merge is the growth of the sum of squares within clusters.
    """

    leaves: list[int]
    merges: list[tuple[int, int, int, float, int]]

    @property
    def first(self) -> int:
        return max(self.leaves) + 1 if self.leaves else 0

    def table(self, spark) -> DataFrame:
        """step, left, right, node, cost, height, n; height is the usual distance sqrt(2 x cost)."""
        rows = [
            (step, left, right, self.first + step, cost, float(np.sqrt(2 * cost)), n)
            for step, left, right, cost, n in self.merges
        ]
        schema = "step int, left int, right int, node int, cost double, height double, n bigint"
        return spark.createDataFrame(rows, schema)

    def groups(self, k: int) -> dict[int, int]:
        """Group (from 0) of every leaf when k groups are left, numbered by their smallest leaf.

        With fewer leaves than k every leaf is a group.
        """
        if k < 1:
            raise ValueError("at least one group")
        members = {leaf: [leaf] for leaf in self.leaves}
        for step, left, right, _, _ in self.merges[: max(len(self.leaves) - k, 0)]:
            members[self.first + step] = members.pop(left) + members.pop(right)
        ranked = sorted(members.values(), key=min)
        return {leaf: number for number, group in enumerate(ranked) for leaf in group}

    def cut(self, labelled: DataFrame, k_values, key: str = "CustomerID") -> DataFrame:
        """k, key, Cluster of every row of ``micro_clusters``, for all k in one pass without a join.

        Each k has one array constant with a place per small cluster, which MAX_MICRO_CLUSTERS bounds.
        """
        pairs = []
        for k in k_values:
            groups = self.groups(k)
            places = F.array(*[F.lit(groups.get(leaf)) for leaf in range(self.first)])
            pairs.append(F.struct(F.lit(k).alias("k"), places[F.col("micro")].alias("Cluster")))
        found = labelled.select(key, F.inline(F.array(*pairs)))
        return found.select("k", key, "Cluster")


def ward(features: DataFrame) -> Dendrogram:
    """Ward's merges over a table of cluster features.

    The number of clusters is counted first; only a table within MAX_MICRO_CLUSTERS is gathered.
    Each step merges the pair whose merge adds least to the squares within clusters; of equal pairs
    the one with the smallest numbers. Distances are updated from the merged means, in whole rows.
    """
    count = features.count()
    if count > MAX_MICRO_CLUSTERS:
        raise ValueError(f"{count} clusters are too many to merge on the driver")
    rows = features.select("cluster", "n", "sums").orderBy("cluster").collect()
    leaves = [int(r["cluster"]) for r in rows]
    if not rows:
        return Dendrogram([], [])
    weights = np.array([float(r["n"]) for r in rows])
    means = np.array([r["sums"] for r in rows], dtype=float) / weights[:, None]
    nodes, first = np.array(leaves), leaves[-1] + 1

    def costs(i: int) -> np.ndarray:
        apart = ((means - means[i]) ** 2).sum(axis=1)
        found = apart * weights * weights[i] / (weights + weights[i])
        found[~alive] = np.inf
        found[i] = np.inf
        return found

    alive = np.ones(count, bool)
    table = np.array([costs(i) for i in range(count)])
    merges = []
    for step in range(count - 1):
        least = table.min(axis=1)
        cost = least.min()
        left = min(np.flatnonzero(least == cost), key=lambda i: nodes[i])
        right = min(np.flatnonzero(table[left] == cost), key=lambda i: nodes[i])
        small, large = sorted((int(nodes[left]), int(nodes[right])))
        whole = weights[left] + weights[right]
        merges.append((step, small, large, float(cost), int(whole)))
        means[left] = (means[left] * weights[left] + means[right] * weights[right]) / whole
        weights[left], nodes[left], alive[right] = whole, first + step, False
        table[right, :] = table[:, right] = np.inf
        table[left, :] = table[:, left] = costs(left)
    return Dendrogram(leaves, merges)
