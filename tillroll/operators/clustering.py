"""K-Means fits, the scan over k, and assignment to given centroids."""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.reduction import with_vector
from tillroll.operators.silhouette import mean_silhouettes, squared_silhouette
from tillroll.schema import FEATURES
from tillroll.session import stage

# Defaults of the clustering.
SEED = 42
STARTS = 10
MAX_ITER = 300
TOL = 1e-4
K_SCAN = range(2, 11)
K_VALUES = (3, 4)

# Partitions of the cached vectors. The start of a fit draws per partition, so their number is a
# parameter that does not follow the rows. Rule of thumb: one per 500,000 customers, so that a
# partition of sixteen features stays below 100 MB, and at least one per core.
PARTITIONS = 8

# Centroid tables are attached to every row, so their size is checked.
MAX_CENTROID_CELLS = 1_000_000


# Points that a task holds against all centers in one step.
STEP_POINTS = 1_024


@dataclass
class FitSummary:
    """Cost before the last move of the centers, and the number of moves."""

    trainingCost: float
    numIter: int


@dataclass
class Centers:
    """The centers of one fit under their raw numbers."""

    centers: np.ndarray
    summary: FitSummary

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centers)


@dataclass
class KMeansFit:
    """A fitted model with its clusters renumbered in a stated order.

    ``starts`` holds the inertia and the model of every start, the chosen one among them.
    """

    k: int
    model: Centers
    inertia: float
    columns: list[str]
    number: list[int]
    starts: list[tuple[float, Centers]]

    def assign(self, scaled: DataFrame, column: str = "Cluster") -> DataFrame:
        """Add the cluster number of every row. Row-wise, no join and no shuffle."""
        return _assign(scaled, {column: self})


def _assign(scaled: DataFrame, fits: dict[str, KMeansFit]) -> DataFrame:
    """Cluster numbers of several fits of the same columns, from one Python call per batch."""
    columns, models = next(iter(fits.values())).columns, [fit.model for fit in fits.values()]
    raw = with_vector(scaled, columns, "_point").withColumn(
        "_raw", _nearest_centers(models)(vector_to_array("_point"))
    )
    numbers = {
        name: F.element_at(F.array(*[F.lit(n) for n in fit.number]), F.col("_raw")[i] + 1)
        for i, (name, fit) in enumerate(fits.items())
    }
    return raw.withColumns(numbers).drop("_point", "_raw")


class _Meeting:
    """Centers of several models, those with as many centers side by side in one array.

    Points and centers are moved by the mean center first, so that products keep their digits.
    """

    def __init__(self, centers: list[np.ndarray]):
        self.centers = centers
        self.origin = np.concatenate(centers).mean(axis=0)
        by_size: dict[int, list[int]] = {}
        for i, own in enumerate(centers):
            by_size.setdefault(len(own), []).append(i)
        self.groups = []
        for models in by_size.values():
            stack = np.stack([centers[i] - self.origin for i in models], axis=1)
            self.groups.append((models, -2 * stack, (stack * stack).sum(axis=2)))

    def steps(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """The batch's points, moved, in steps of bounded size. A cell is a point or packed points."""
        width = len(self.origin)
        if pa.types.is_binary(batch.schema.types[0]):
            blocks = [np.frombuffer(cell.as_buffer()) for cell in batch.column(0)]
        else:
            blocks = [batch.column(0).flatten().to_numpy(zero_copy_only=False)]
        for block in blocks:
            points = block.reshape(-1, width)
            for at in range(0, len(points), STEP_POINTS):
                yield points[at : at + STEP_POINTS] - self.origin

    def labels(self, points: np.ndarray) -> Iterator[tuple]:
        """Per group: its models, the nearest center of each point, its squared distance less the
        point's squared length, and a used buffer. The first center wins a tie."""
        for models, centers, norms in self.groups:
            k, m, width = centers.shape
            scores = (centers.reshape(k * m, width) @ points.T).reshape(k, m, len(points))
            scores += norms[:, :, None]
            least, label = scores[0].copy(), np.zeros((m, len(points)), np.int32)
            for j in range(1, k):
                np.copyto(label, j, where=scores[j] < least)
                np.minimum(least, scores[j], out=least)
            yield models, label, least, scores


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points of a batch as the bytes of one cell, so that a pass copies no single number."""
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["points"])


def _nearest_centers(models: list[Centers]):
    """Column function: the raw number of the nearest center under each model, as one array."""
    centers = [model.centers for model in models]

    @F.arrow_udf("array<int>")
    def nearest(vectors: pa.Array) -> pa.Array:
        meeting, found = _Meeting(centers), [np.empty((0, len(centers)), np.int32)]
        for points in meeting.steps(pa.RecordBatch.from_arrays([vectors], names=["vector"])):
            step = np.empty((len(points), len(centers)), np.int32)
            for own, label, _, _ in meeting.labels(points):
                step[:, own] = label.T
            found.append(step)
        flat = np.concatenate(found).ravel()
        ends = np.arange(0, len(flat) + 1, len(centers), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return nearest


def _inertias(models: list[Centers], points: DataFrame) -> list[float]:
    """Sum of squared distances to the nearest center of each model, from one pass for all.

    A model's own summary tells the cost before the last move of its centers.
    """
    centers = [model.centers for model in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, cost = _Meeting(centers), np.zeros(len(centers))
        moved = [own - meeting.origin for own in centers]
        for batch in batches:
            for step in meeting.steps(batch):
                for own, label, _, _ in meeting.labels(step):
                    for row, i in enumerate(own):
                        away = step - moved[i][label[row]]
                        cost[i] += np.einsum("ij,ij->", away, away)
        yield pa.RecordBatch.from_arrays([pa.array([cost.tobytes()], pa.binary())], names=["cost"])

    parts = points.mapInArrow(run, "cost binary").collect()
    return sum((np.frombuffer(r.cost) for r in parts), np.zeros(len(models))).tolist()


def _moves(points: DataFrame, centers: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """The next centers of every model and the cost of the present ones, from one pass for all.

    A task sends back the sums and the number of the points of every center, and no point. They
    are added up in the order of the partitions. A center without points stays.
    """
    width = centers[0].shape[1]
    places = np.cumsum([0, *map(len, centers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = _Meeting(centers)
        sums = [np.zeros((*stack.shape[:2], width + 1)) for _, stack, _ in meeting.groups]
        cost = np.zeros(len(centers))
        for batch in batches:
            for step in meeting.steps(batch):
                whole = np.hstack([step, np.ones((len(step), 1))])
                length = (step * step).sum()
                for total, (own, label, least, buffer) in zip(sums, meeting.labels(step)):
                    cost[own] += least.sum(axis=1) + length
                    for j in range(len(buffer)):
                        np.equal(label, j, out=buffer[j])
                    total += (buffer.reshape(-1, len(step)) @ whole).reshape(total.shape)
        ordered = [None] * len(centers)
        for total, (own, _, _) in zip(sums, meeting.groups):
            for row, i in enumerate(own):
                ordered[i] = total[:, row]
        found = [pa.array([x.tobytes()], pa.binary()) for x in (np.concatenate(ordered), cost)]
        yield pa.RecordBatch.from_arrays(found, names=["sums", "cost"])

    parts = points.mapInArrow(run, "sums binary, cost binary").collect()
    sums = sum(np.frombuffer(r["sums"]) for r in parts).reshape(-1, width + 1)
    cost = sum(np.frombuffer(r["cost"]) for r in parts)
    origin, found = _Meeting(centers).origin, []
    for i, own in enumerate(centers):
        part = sums[places[i] : places[i + 1]]
        count = part[:, -1:]
        mean = part[:, :-1] / np.where(count > 0, count, 1) + origin
        found.append((np.where(count > 0, mean, own), float(cost[i])))
    return found


def _lloyd(
    points: DataFrame, starts: list[np.ndarray], moves: list[float], max_iter: int
) -> list[Centers]:
    """Lloyd's rounds of all starts side by side: a round is one pass for all that still move.

    A start ends when none of its centers moves further than its bound in ``moves``.
    """
    centers = [np.array(start, float) for start in starts]
    summaries = [FitSummary(math.inf, 0) for _ in starts]
    open_ = list(range(len(starts)))
    for number in range(1, max_iter + 1):
        if not open_:
            break
        still = []
        for i, (moved, cost) in zip(open_, _moves(points, [centers[i] for i in open_])):
            furthest = ((moved - centers[i]) ** 2).sum(axis=1).max()
            centers[i], summaries[i] = moved, FitSummary(cost, number)
            if furthest > moves[i] ** 2:
                still.append(i)
        open_ = still
    return [Centers(c, summary) for c, summary in zip(centers, summaries)]


def _number_clusters(models: dict[int, Centers], vectors: DataFrame) -> dict[int, list[int]]:
    """Position of each raw cluster by descending mean of ``order``, ties by centroid.

    One aggregation over the cached vectors serves all models and returns sum(k) rows.
    """
    nearest = _nearest_centers(list(models.values()))
    labelled = vectors.select("order", nearest("point").alias("raws"))
    pairs = F.array(
        *[F.struct(F.lit(k).alias("k"), F.col("raws")[i].alias("raw")) for i, k in enumerate(models)]
    )
    rows = (
        labelled.select("order", F.inline(pairs))
        .groupBy("k", "raw")
        .agg(F.avg("order").alias("mean"))
        .collect()
    )
    means = {(r["k"], r["raw"]): r["mean"] for r in rows}
    numbers = {}
    for k, model in models.items():
        centers = [tuple(float(x) for x in c) for c in model.clusterCenters()]
        ranked = sorted(
            range(len(centers)), key=lambda c: (-means.get((k, c), float("-inf")), centers[c])
        )
        numbers[k] = [ranked.index(c) for c in range(len(centers))]
    return numbers


def fit_kmeans(
    scaled: DataFrame,
    k_values,
    original: DataFrame | None = None,
    columns: list[str] = FEATURES,
    n_init: int = STARTS,
    max_iter: int = MAX_ITER,
    tol: float = TOL,
    seed: int = SEED,
    parallelism: int = 4,
    order_by: str = "Sum_TotalPrice",
    partitions: int = PARTITIONS,
    key: str = "CustomerID",
) -> dict[int, KMeansFit]:
    """Best of ``n_init`` starts for each k, by the inertia of its final centers.

    A fit ends when the squared moves of all centers sum to at most ``tol`` times the mean
    variance of the columns.

    The vectors are cached once for all fits. Spark's K-Means draws the first centers of every
    start, ``parallelism`` of them at once from driver threads; then all starts of all k move
    together, one pass over the vectors per round, so the passes are as many as the longest fit
    has rounds. The vectors are dealt by ``key`` over ``partitions`` and sorted, so the fit does not
    depend on how the rows arrive. Clusters are renumbered by descending mean of ``order_by`` in
    ``original`` (in ``scaled`` without it), as raw numbers mean nothing. ``partitions``: see
    PARTITIONS; another number draws other starts.
    """
    if original is None:
        ordered = scaled.withColumn("order", F.col(order_by))
    else:
        order = original.select(key, F.col(order_by).alias("order"))
        ordered = scaled.join(order, key)
    variance = sum(scaled.agg(*[F.var_pop(c) for c in columns]).first()) / len(columns)
    dealt = ordered.repartition(partitions, key).sortWithinPartitions(key, *columns)
    point = vector_to_array("vector").alias("point")
    vectors = with_vector(dealt, columns).select("vector", point, "order").persist()
    # Spark's K-Means keeps its rows as objects over its passes only if its input is not itself a
    # cached table; else it decodes the cached columns in every pass.
    drawn_from, points = vectors.select("vector"), None
    try:

        def first_centers(job):
            k, start = job
            kmeans = KMeans(
                k=k, seed=seed + start, maxIter=0, featuresCol="vector", solver="row"
            )
            return np.array(kmeans.fit(drawn_from).clusterCenters())

        jobs = [(k, start) for k in k_values for start in range(n_init)]
        with ThreadPoolExecutor(parallelism) as pool:
            first = list(pool.map(first_centers, jobs))
        # No center moves further than this at the end, which bounds the sum of the squared
        # moves by tol times the variance.
        moves = [math.sqrt(tol * variance / k) for k, _ in jobs]
        points = vectors.select("point").mapInArrow(_pack, "points binary").persist()
        fitted = _lloyd(points, first, moves, max_iter)
        starts: dict[int, list[tuple[float, Centers]]] = {k: [] for k in k_values}
        for (k, _), cost, model in zip(jobs, _inertias(fitted, points), fitted):
            starts[k].append((cost, model))
        # Costs that agree to ten digits are the same clustering; the first start has it.
        best = {k: min(own, key=lambda s: float(f"{s[0]:.10g}")) for k, own in starts.items()}
        numbers = _number_clusters({k: model for k, (_, model) in best.items()}, vectors)
        return {
            k: KMeansFit(k, model, cost, list(columns), numbers[k], starts[k])
            for k, (cost, model) in best.items()
        }
    finally:
        if points is not None:
            points.unpersist()
        vectors.unpersist()


def fit_kmeans_chained(
    scaled: DataFrame, k_values=K_VALUES, original: DataFrame | None = None, **options
) -> dict[int, KMeansFit]:
    """Like ``fit_kmeans``, but each k also sees the labels of the k before it as columns.

    This repeats a habit of the original analysis; the plain fit is the one to use.
    """
    columns = list(options.pop("columns", FEATURES))
    fits: dict[int, KMeansFit] = {}
    for k in k_values:
        fits |= fit_kmeans(scaled, [k], original, columns=list(columns), **options)
        scaled = fits[k].assign(scaled, f"Cluster_{k}")
        columns.append(f"Cluster_{k}")
    return fits


def assign_chained(scaled: DataFrame, fits: dict[int, KMeansFit]) -> DataFrame:
    """Labels of a chained fit, one column ``Cluster_k`` per k; of fits of the same columns in one go."""
    if len({tuple(fit.columns) for fit in fits.values()}) == 1:
        return _assign(scaled, {f"Cluster_{k}": fit for k, fit in fits.items()})
    for k, fit in fits.items():
        scaled = fit.assign(scaled, f"Cluster_{k}")
    return scaled


def labels_long(scaled: DataFrame, fits: dict[int, KMeansFit]) -> DataFrame:
    """k, CustomerID, Cluster rows for every fitted k, from one pass over the features."""
    wide = assign_chained(scaled, fits)
    pairs = F.array(
        *[F.struct(F.lit(k).alias("k"), F.col(f"Cluster_{k}").alias("Cluster")) for k in fits]
    )
    return wide.select("CustomerID", F.inline(pairs)).select("k", "CustomerID", "Cluster")


def elbow(spark, fits: dict[int, KMeansFit]) -> DataFrame:
    rows = [(k, float(f.inertia)) for k, f in fits.items()]
    return spark.createDataFrame(rows, "k int, inertia double")


def adjusted_rand(labels: DataFrame, a: str, b: str, groups: list[str]) -> DataFrame:
    """``groups``, rows and ``ari``: agreement of two labels of the same rows, corrected for chance.

    From the counts of label pairs, which are as many as there are clusters times clusters. Two
    labelings that both have one cluster, or one per row, agree wholly.
    """
    return _rand_of_cells(labels.groupBy(*groups, a, b).agg(F.count(F.lit(1)).alias("n")), a, b, groups)


def _rand_of_cells(cells: DataFrame, a: str, b: str, groups: list[str]) -> DataFrame:
    """``adjusted_rand`` from the number n of rows of every pair of labels."""
    cells = cells.withColumn("n", F.col("n").cast("double"))
    by_a = cells.groupBy(*groups, a).agg(F.sum("n").alias("n"))
    by_b = cells.groupBy(*groups, b).agg(F.sum("n").alias("n"))

    def pairs(name: str) -> Column:
        return F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name)

    together = cells.groupBy(*groups).agg(pairs("both"), F.sum("n").alias("rows"))
    found = together.join(by_a.groupBy(*groups).agg(pairs("in_a")), groups)
    found = found.join(by_b.groupBy(*groups).agg(pairs("in_b")), groups)
    chance = F.try_divide(
        F.col("in_a") * F.col("in_b"), F.col("rows") * (F.col("rows") - 1) / 2
    )
    most = (F.col("in_a") + F.col("in_b")) / 2
    ari = F.coalesce(F.try_divide(F.col("both") - chance, most - chance), F.lit(1.0))
    return found.select(*groups, F.col("rows").cast("bigint").alias("rows"), ari.alias("ari"))


def start_costs(spark, fits: dict[int, KMeansFit]) -> DataFrame:
    """k, start, inertia, is_chosen of every start of a scan."""
    rows = [
        (k, start, float(cost), model is fit.model)
        for k, fit in fits.items()
        for start, (cost, model) in enumerate(fit.starts)
    ]
    return spark.createDataFrame(rows, "k int, start int, inertia double, is_chosen boolean")


def stability(scaled: DataFrame, fits: dict[int, KMeansFit]) -> DataFrame:
    """k, start_a, start_b, ari: agreement between the starts of each k, start_a < start_b.

    One pass labels every row by all models and counts the pairs of labels in the task; only these
    counts are shuffled.
    """
    columns = next(iter(fits.values())).columns
    places = [(k, start) for k, fit in fits.items() for start in range(len(fit.starts))]
    centers = [fits[k].starts[start][1].centers for k, start in places]
    at = {place: i for i, place in enumerate(places)}
    pairs = [(k, other, start) for k, start in places for other in range(start)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = _Meeting(centers)
        sizes = [(len(centers[at[k, i]]), len(centers[at[k, j]])) for k, i, j in pairs]
        cells = [np.zeros(m * n, np.int64) for m, n in sizes]
        for batch in batches:
            for step in meeting.steps(batch):
                labels = {i: own for models, label, _, _ in meeting.labels(step) for i, own in zip(models, label)}
                for (k, i, j), (m, n), cell in zip(pairs, sizes, cells):
                    cell += np.bincount(labels[at[k, i]] * n + labels[at[k, j]], minlength=m * n)
        for (k, i, j), (_, n), cell in zip(pairs, sizes, cells):
            seen = np.flatnonzero(cell)
            columns = [np.full(len(seen), x) for x in (k, i, j)] + [seen // n, seen % n]
            parts = [pa.array(x.astype(np.int32)) for x in columns] + [pa.array(cell[seen])]
            yield pa.RecordBatch.from_arrays(parts, names=["k", "start_a", "start_b", "a", "b", "n"])

    points = with_vector(scaled, columns).select(vector_to_array("vector").alias("point"))
    schema = "k int, start_a int, start_b int, a int, b int, n bigint"
    groups = ["k", "start_a", "start_b"]
    cells = points.mapInArrow(run, schema).groupBy(*groups, "a", "b").agg(F.sum("n").alias("n"))
    return _rand_of_cells(cells, "a", "b", groups).drop("rows")


def k_selection(
    scaled: DataFrame, fits: dict[int, KMeansFit], metric: str = "euclidean"
) -> DataFrame:
    """k, inertia, silhouette and whether k has the best silhouette (the smaller k on a tie).

    With ``metric="euclidean"`` all k share one silhouette job, since the distances do not
    depend on k; its work grows with the square of the rows. ``metric="squaredEuclidean"``
    is Spark's own measure: other values, but work linear in the rows.
    """
    spark = scaled.sparkSession
    columns = next(iter(fits.values())).columns
    if metric == "euclidean":
        labelled = stage(assign_chained(scaled, fits), "assigned")
        names = {k: f"Cluster_{k}" for k in fits}
        scores = mean_silhouettes(labelled, columns, names, "CustomerID")
    elif metric == "squaredEuclidean":
        rows = [
            (k, squared_silhouette(with_vector(fit.assign(scaled), columns), "vector", "Cluster"))
            for k, fit in fits.items()
        ]
        scores = spark.createDataFrame(rows, "k int, silhouette double")
    else:
        raise ValueError(f"unknown metric {metric!r}")
    first = Window.orderBy(F.desc("silhouette"), F.asc("k"))
    return (
        elbow(spark, fits)
        .join(F.broadcast(scores), "k")
        .withColumn("is_best", F.row_number().over(first) == 1)
    )


def best_k(selection: DataFrame) -> DataFrame:
    return (
        selection.orderBy(F.desc("silhouette"), F.asc("k"))
        .limit(1)
        .select("k", "silhouette")
    )


def assign_nearest_centroid(
    points: DataFrame, centroids: DataFrame, vector: str = "vector"
) -> DataFrame:
    """Add the nearest centroid's cluster and its squared distance to every point.

    ``centroids`` has columns cluster and center (array of doubles), one row per cluster.
    Their size is summed first; only a table within the bound is gathered and broadcast. Arrow
    batches of points are held against one centroid after the other. The smaller cluster number wins
    a tie. A vector that is null, has a null component or another length than the centers has none.
    """
    cells = centroids.agg(F.sum(F.size("center"))).first()[0] or 0
    if cells > MAX_CENTROID_CELLS:
        raise ValueError(f"{cells} centroid cells are too many to send to every task")
    rows = centroids.select("cluster", "center").orderBy("cluster").collect()
    shared = points.sparkSession.sparkContext.broadcast(
        (np.array([r["cluster"] for r in rows], object), [np.array(r["center"], float) for r in rows])
    )
    number = centroids.schema["cluster"].dataType.simpleString()

    @F.pandas_udf(f"cluster {number}, distance_sq double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        numbers, centers = shared.value
        found = np.full(len(vectors), -1)
        least = np.full(len(vectors), np.inf)
        width = len(centers[0]) if centers else 0
        fits = np.array([v is not None and len(v) == width for v in vectors], bool)
        if centers and fits.any():
            own = np.stack(vectors[fits].to_numpy()).astype(float)
            best, at = least[fits], found[fits]
            for i, center in enumerate(centers):
                distance = ((own - center) ** 2).sum(axis=1)
                closer = distance < best
                best[closer], at[closer] = distance[closer], i
            least[fits], found[fits] = best, at
        none = found < 0
        cluster = pd.Series([None if i < 0 else numbers[i] for i in found], dtype=object)
        return pd.DataFrame({"cluster": cluster, "distance_sq": pd.Series(least).mask(none)})

    return points.withColumn("_nearest", nearest(vector)).select(
        *points.columns,
        F.col("_nearest.cluster").alias("cluster"),
        F.col("_nearest.distance_sq").alias("distance_sq"),
    )


def centroids_of(points: DataFrame, label: str, vector: str = "vector") -> DataFrame:
    """Mean vector per label: columns cluster, center. Partial sums before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return (
        points.groupBy(F.col(label).alias("cluster"))
        .agg(mean.alias("mean"))
        .select("cluster", vector_to_array("mean").alias("center"))
    )
