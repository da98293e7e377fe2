"""Soft groups: Gaussian mixtures, and the number of components by the Bayesian criterion."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.stat import MultivariateGaussian
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.clustering import PARTITIONS, SEED
from tillroll.operators.reduction import with_vector
from tillroll.schema import FEATURES

STARTS = 3
MAX_ITER = 200
TOL = 1e-4

# Points of one step of a task, and what Spark's mixture adds to every weighted density.
STEP_POINTS = 1_024
EPSILON = float(np.finfo(float).eps)


@dataclass
class Mixture:
    """Weights and densities of the components under their raw numbers."""

    weights: list[float]
    gaussians: list[MultivariateGaussian]


@dataclass
class MixtureFit:
    """A fitted mixture; components are renumbered by falling weight, ties by their means."""

    k: int
    model: Mixture
    log_likelihood: float
    columns: list[str]
    order: list[int]

    def memberships(self, scaled: DataFrame, key: str = "CustomerID") -> DataFrame:
        """k, key, component, probability: how much of each row belongs to each component."""
        parts = F.array(
            *[
                F.struct(F.lit(i).alias("component"), F.col("_shares")[raw].alias("probability"))
                for i, raw in enumerate(self.order)
            ]
        )
        rows = with_vector(scaled.select(key, *self.columns), self.columns)
        scored = rows.select(key, _shares(self.model)(vector_to_array("vector")).alias("_shares"))
        return scored.select(F.lit(self.k).alias("k"), key, F.inline(parts))

    def components(self, spark) -> DataFrame:
        """k, component, weight, feature, mean: one row per component and column."""
        means = [g.mean.toArray() for g in self.model.gaussians]
        rows = [
            (self.k, i, float(self.model.weights[raw]), name, float(mean))
            for i, raw in enumerate(self.order)
            for name, mean in zip(self.columns, means[raw])
        ]
        schema = "k int, component int, weight double, feature string, mean double"
        return spark.createDataFrame(rows, schema)


def _densities(model: Mixture) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Mean, scaled directions and log factor of each component's density, without its weight.

    Directions without any spread are left out.
    """
    own = []
    for gaussian in model.gaussians:
        values, directions = np.linalg.eigh(gaussian.cov.toArray())
        live = values > EPSILON * max(values.max(), 0.0) * len(values)
        if not live.any():
            raise ValueError("a component has no spread in any direction")
        constant = -0.5 * (len(values) * np.log(2 * np.pi) + np.log(values[live]).sum())
        own.append((gaussian.mean.toArray(), directions[:, live] / np.sqrt(values[live]), constant))
    return own


def _logs(points: np.ndarray, densities: list[tuple]) -> Iterator[np.ndarray]:
    """The log density of every point under each component."""
    for mean, scale, constant in densities:
        away = (points - mean) @ scale
        yield constant - 0.5 * np.einsum("ij,ij->i", away, away)


def _weighted(points: np.ndarray, weights: list[float], densities: list[tuple]) -> np.ndarray:
    """Components x points: the weighted densities, each with EPSILON added."""
    each = zip(weights, _logs(points, densities))
    return np.array([EPSILON + weight * np.exp(logs) for weight, logs in each])


def _steps(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
    points = flat.reshape(len(batch), -1) if len(batch) else flat.reshape(0, 0)
    for at in range(0, len(points), STEP_POINTS):
        yield points[at : at + STEP_POINTS]


def _shares(model: Mixture):
    """Column function: how much of a vector belongs to each component."""
    weights, densities = model.weights, _densities(model)

    @F.arrow_udf("array<double>")
    def shares(vectors: pa.Array) -> pa.Array:
        found = [np.empty((0, len(weights)))]
        for points in _steps(pa.RecordBatch.from_arrays([vectors], names=["vector"])):
            each = _weighted(points, weights, densities)
            found.append((each / each.sum(axis=0)).T)
        flat = np.concatenate(found).ravel()
        ends = np.arange(0, len(flat) + 1, len(weights), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return shares


def _log_likelihoods(models: list[Mixture], points: DataFrame) -> list[float]:
    """Log-likelihood of the rows under each returned model, from one pass for all.

    The fit itself only knows the value before its last step.
    """
    given = [(np.log(np.maximum(m.weights, 1e-300)), _densities(m)) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(given))
        for batch in batches:
            for step in _steps(batch):
                for i, (weights, densities) in enumerate(given):
                    logs = np.full(len(step), -np.inf)
                    for weight, own in zip(weights, _logs(step, densities)):
                        logs = np.logaddexp(logs, weight + own)
                    total[i] += logs.sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = points.mapInArrow(run, "total binary").collect()
    return sum((np.frombuffer(r.total) for r in parts), np.zeros(len(models))).tolist()


def _maximised(points: DataFrame, models: list[Mixture]) -> list[tuple[Mixture, float]]:
    """The next step of every model and the log-likelihood of the present one, from one pass for all.

    A task sends back per component the weight, the weighted sums and the weighted products of its
    points, and no point. They are added up in the order of the partitions.
    """
    given = [(m.weights, _densities(m)) for m in models]
    width = len(given[0][1][0][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(weights), 1 + width + width * width)) for weights, _ in given]
        likelihood = np.zeros(len(given))
        for batch in batches:
            for step in _steps(batch):
                products = (step[:, :, None] * step[:, None, :]).reshape(len(step), -1)
                whole = np.hstack([np.ones((len(step), 1)), step, products])
                for i, (weights, densities) in enumerate(given):
                    each = _weighted(step, weights, densities)
                    total = each.sum(axis=0)
                    likelihood[i] += np.log(total).sum()
                    sums[i] += (each / total) @ whole
        found = [pa.array([x.tobytes()], pa.binary()) for x in (np.concatenate(sums), likelihood)]
        yield pa.RecordBatch.from_arrays(found, names=["sums", "likelihood"])

    parts = points.mapInArrow(run, "sums binary, likelihood binary").collect()
    sums = sum(np.frombuffer(r["sums"]) for r in parts).reshape(-1, 1 + width + width * width)
    likelihood = sum(np.frombuffer(r["likelihood"]) for r in parts)
    found, at = [], 0
    for i, (weights, _) in enumerate(given):
        own = sums[at : at + len(weights)]
        at += len(weights)
        gaussians = []
        for row in own:
            mean = row[1 : 1 + width] / row[0]
            cov = row[1 + width :].reshape(width, width) / row[0] - np.outer(mean, mean)
            matrix = DenseMatrix(width, width, cov.ravel(order="F").tolist())
            gaussians.append(MultivariateGaussian(Vectors.dense(mean), matrix))
        share = own[:, 0] / own[:, 0].sum()
        found.append((Mixture(share.tolist(), gaussians), float(likelihood[i])))
    return found


def _maximise(points: DataFrame, starts: list[Mixture], max_iter: int, tol: float) -> list[Mixture]:
    """Expectation and maximisation of all starts side by side: a round is one pass for all.

    A start ends when its log-likelihood changes by at most ``tol``.
    """
    models, before = list(starts), [-float(np.finfo(float).max)] * len(starts)
    open_ = list(range(len(starts)))
    for _ in range(max_iter):
        if not open_:
            break
        still = []
        for i, (model, likelihood) in zip(open_, _maximised(points, [models[i] for i in open_])):
            if abs(likelihood - before[i]) > tol:
                still.append(i)
            models[i], before[i] = model, likelihood
        open_ = still
    return models


def fit_mixtures(
    scaled: DataFrame,
    k_values,
    columns: list[str] = FEATURES,
    n_init: int = STARTS,
    max_iter: int = MAX_ITER,
    tol: float = TOL,
    seed: int = SEED,
    parallelism: int = 4,
    partitions: int = PARTITIONS,
    key: str = "CustomerID",
) -> dict[int, MixtureFit]:
    """For each k the start with the largest likelihood.

    The vectors are cached once and dealt as in ``fit_kmeans``, so that a fit does not depend on
    how the rows arrive. Spark's Gaussian mixture draws the first components of every start; then all
    starts of all k step together, one pass over the vectors per round. ``k_values`` are 2 or more. A component has a whole covariance matrix, so
    the driver holds k times the square of the number of columns per fit, whatever the rows.
    """
    columns = list(columns)
    dealt = scaled.select(key, *columns).repartition(partitions, key)
    sorted_rows = dealt.sortWithinPartitions(key, *columns)
    point = vector_to_array("vector").alias("point")
    vectors = with_vector(sorted_rows, columns).select("vector", point).persist()
    try:

        def first_components(job):
            k, start = job
            mixture = GaussianMixture(k=k, seed=seed + start, maxIter=0, featuresCol="vector")
            model = mixture.fit(vectors)
            return Mixture(list(model.weights), list(model.gaussians))

        jobs = [(k, start) for k in k_values for start in range(n_init)]
        with ThreadPoolExecutor(parallelism) as pool:
            first = list(pool.map(first_components, jobs))
        points = vectors.select("point")
        models = _maximise(points, first, max_iter, tol)
        best: dict[int, MixtureFit] = {}
        for (k, _), model, found in zip(jobs, models, _log_likelihoods(models, points)):
            if k in best and found <= best[k].log_likelihood:
                continue
            means = [tuple(g.mean.toArray()) for g in model.gaussians]
            order = sorted(range(k), key=lambda i: (-model.weights[i], means[i]))
            best[k] = MixtureFit(k, model, found, columns, order)
        return best
    finally:
        vectors.unpersist()


def _parameters(k: Column, d: Column) -> Column:
    """Free parameters of k components in d columns: weights, means and covariances."""
    return k - 1 + k * d + k * d * (d + 1) / 2


def bayesian_criterion(likelihoods: DataFrame) -> DataFrame:
    """Adds parameters, bic and is_best to (k, rows, columns, log_likelihood), one row per k.

    The best k has the smallest value, the smaller k on a tie.
    """
    parameters = _parameters(F.col("k"), F.col("columns"))
    bic = F.col("parameters") * F.ln("rows") - 2 * F.col("log_likelihood")
    first = Window.orderBy("bic", "k")
    return (
        likelihoods.withColumn("parameters", parameters.cast("bigint"))
        .withColumn("bic", bic)
        .withColumn("is_best", F.row_number().over(first) == 1)
    )


def mixture_selection(scaled: DataFrame, fits: dict[int, MixtureFit]) -> DataFrame:
    """k, rows, columns, log_likelihood, parameters, bic, is_best of the fits."""
    n = scaled.count()
    rows = [(k, n, len(f.columns), float(f.log_likelihood)) for k, f in fits.items()]
    schema = "k int, rows bigint, columns int, log_likelihood double"
    return bayesian_criterion(scaled.sparkSession.createDataFrame(rows, schema))
