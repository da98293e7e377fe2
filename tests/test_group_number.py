"""Gap statistic and mixtures against plain versions and planted groups."""

import math

import numpy as np
import pytest
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tillroll.operators import gap, mixture
from tillroll.operators.reduction import with_vector

COLUMNS = ["x", "y"]
CENTERS = np.array([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0]])


def planted(spark, spread=1.0, n=240, seed=3):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, len(CENTERS), n)
    points = CENTERS[truth] + rng.normal(0, spread, (n, 2))
    rows = [(f"{i:04d}", *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "CustomerID string, x double, y double"), points, truth


def test_gap_finds_planted_groups_and_repeats(spark):
    df, points, _ = planted(spark)
    tables = [
        gap.dispersions(d, range(1, 6), COLUMNS, draws=4, n_init=2, max_iter=30)
        for d in (df, df.repartition(7))
    ]
    first, second = (t.orderBy("draw", "k").collect() for t in tables)
    assert [(r.k, r.draw) for r in first] == [(r.k, r.draw) for r in second]
    assert [r.dispersion for r in first] == pytest.approx([r.dispersion for r in second])
    whole = [r.dispersion for r in first if r.k == 1 and r.draw is None]
    assert whole == pytest.approx([((points - points.mean(0)) ** 2).sum()])
    found = gap.gap_table(tables[0]).collect()
    assert [r.k for r in found if r.is_chosen] == [3]


def test_one_cloud_is_one_group(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), *map(float, p)) for i, p in enumerate(rng.uniform(0, 1, (200, 2)))]
    df = spark.createDataFrame(rows, "CustomerID string, x double, y double")
    found = gap.gap_table(gap.dispersions(df, range(1, 4), COLUMNS, draws=5, n_init=1, max_iter=20))
    assert [r.k for r in found.collect() if r.is_chosen] == [1]


def test_reference_draws_fill_the_ranges(spark):
    df, points, _ = planted(spark, n=2000)
    df = df.withColumn("flat", F.lit(5.0))
    ranges = gap.column_ranges(df, [*COLUMNS, "flat"])
    drawn = gap.reference_draw(df, ranges, 0).toPandas()
    other = gap.reference_draw(df, ranges, 1).toPandas()
    assert len(drawn) == 2000 and (drawn["flat"] == 5).all()
    for i, c in enumerate(COLUMNS):
        low, high = points[:, i].min(), points[:, i].max()
        assert drawn[c].between(low, high).all()
        shares = np.sort((drawn[c] - low) / (high - low))
        assert np.abs(shares - np.arange(2000) / 2000).max() < 0.05
        assert (drawn[c] != other[c]).mean() > 0.99
    assert abs(np.corrcoef(drawn["x"], drawn["y"])[0, 1]) < 0.1
    assert gap.column_ranges(df.limit(0), COLUMNS) == {"x": (0, 0), "y": (0, 0)}


def test_gap_rule_on_given_dispersions(spark):
    logs = {2: (4.0, [4.2, 4.4]), 3: (2.0, [3.4, 3.8]), 4: (1.9, [3.1, 3.3]), 5: (1.0, [3.0, 3.2])}
    rows = [
        (k, d, math.exp(x)) for k, (own, drawn) in logs.items() for d, x in [(None, own), *enumerate(drawn)]
    ]
    schema = "k int, draw int, dispersion double"
    found = gap.gap_table(spark.createDataFrame(rows, schema)).orderBy("k").collect()
    for r in found:
        own, drawn = logs[r.k]
        assert r.gap == pytest.approx(np.mean(drawn) - own)
        assert r.error == pytest.approx(np.std(drawn) * math.sqrt(1.5))
    assert [r.is_chosen for r in found] == [False, True, False, False]
    rising = spark.createDataFrame([(k, d, math.exp(-k * k * (d is None))) for k in (2, 3) for d in (None, 0, 1)], schema)
    assert [r.k for r in gap.gap_table(rising).collect() if r.is_chosen] == [3]
    flat = spark.createDataFrame([(2, None, 0.0), (2, 0, 1.0), (3, None, 1.0), (3, 0, 1.0)], schema)
    assert [(r.gap, r.is_chosen) for r in gap.gap_table(flat).orderBy("k").collect()] == [(None, False), (0, True)]
    assert gap.gap_table(flat.limit(0)).count() == 0


def density(point, mean, cov):
    away = point - mean
    power = away @ np.linalg.inv(cov) @ away
    return math.exp(-power / 2) / (2 * math.pi * math.sqrt(np.linalg.det(cov)))


def test_mixture_of_overlapping_groups(spark):
    df, points, truth = planted(spark, spread=2.2)
    fits = mixture.fit_mixtures(df, [2, 3, 4], COLUMNS, n_init=3, max_iter=100)
    fit = fits[3]
    weights = [fit.model.weights[i] for i in fit.order]
    parts = [fit.model.gaussians[i] for i in fit.order]
    each = np.array(
        [[w * density(p, g.mean.toArray(), g.cov.toArray()) for w, g in zip(weights, parts)] for p in points]
    )
    assert fit.log_likelihood == pytest.approx(np.log(each.sum(1)).sum())
    assert weights == sorted(weights, reverse=True)
    rows = fit.memberships(df).toPandas()
    wide = rows.pivot(index="CustomerID", columns="component", values="probability").sort_index()
    assert len(rows) == 3 * len(points) and wide.sum(axis=1).to_numpy() == pytest.approx(1)
    assert np.allclose(wide.to_numpy(), each / each.sum(1, keepdims=True), atol=1e-6)
    hard = wide.to_numpy().argmax(1)
    assert np.mean([np.bincount(hard[truth == t]).max() / (truth == t).sum() for t in range(3)]) > 0.9
    table = mixture.mixture_selection(df, fits).orderBy("k").collect()
    assert [r.is_best for r in table] == [False, True, False]
    assert [r.parameters for r in table] == [11, 17, 23]
    assert table[1].bic == pytest.approx(17 * math.log(240) - 2 * fit.log_likelihood)
    shown = fit.components(spark).toPandas()
    assert len(shown) == 6 and shown.groupby("component")["weight"].first().sum() == pytest.approx(1)


def test_constant_column_in_a_mixture(spark):
    df, _, _ = planted(spark)
    fits = mixture.fit_mixtures(df.withColumn("flat", F.lit(1.0)), [2], [*COLUMNS, "flat"], n_init=1, max_iter=20)
    assert math.isfinite(fits[2].log_likelihood)


def test_all_mixture_starts_step_together_as_in_separate_fits(spark):
    df, _, _ = planted(spark, spread=2.2)
    dealt = df.repartition(2, "CustomerID").sortWithinPartitions("CustomerID", *COLUMNS)
    vectors = with_vector(dealt, COLUMNS).select("vector", vector_to_array("vector").alias("point")).persist()
    options = [{"k": k, "seed": seed, "featuresCol": "vector"} for k in (2, 3) for seed in (1, 2)]
    whole = [GaussianMixture(maxIter=15, tol=1e-9, **o).fit(vectors) for o in options]
    drawn = [GaussianMixture(maxIter=0, **o).fit(vectors) for o in options]
    starts = [mixture.Mixture(list(m.weights), list(m.gaussians)) for m in drawn]
    for one, other in zip(whole, mixture._maximise(vectors.select("point"), starts, 15, 1e-9)):
        assert other.weights == pytest.approx(one.weights, rel=1e-6)
        for a, b in zip(one.gaussians, other.gaussians):
            assert np.allclose(a.mean.toArray(), b.mean.toArray()) and np.allclose(a.cov.toArray(), b.cov.toArray())
    vectors.unpersist()
