"""Spend curve, correlations and the agreement of labelings against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array

from tillroll.operators import clustering, concentration, correlation
from tillroll.operators.reduction import with_vector


def test_spend_curve_and_gini(spark):
    rng = np.random.default_rng(2)
    spend = np.round(rng.lognormal(3, 1, 400), 2)
    spend[:60] = 25.0  # ties
    rows = [(f"{i:04d}", float(x)) for i, x in enumerate(spend)] + [("none", None)]
    table = spark.createDataFrame(rows, "CustomerID string, spend double")
    curve = concentration.spend_curve(table).orderBy("position").collect()
    order = sorted(range(400), key=lambda i: (-spend[i], f"{i:04d}"))
    assert [r.CustomerID for r in curve] == [f"{i:04d}" for i in order]
    assert [r.position for r in curve] == list(range(1, 401))
    assert [r.running for r in curve] == pytest.approx(np.cumsum(spend[order]))
    assert curve[-1].spend_share == pytest.approx(1) and curve[-1].customer_share == 1
    row = concentration.concentration(table).first()
    gaps = np.abs(spend[:, None] - spend[None, :]).sum()
    assert row.gini == pytest.approx(gaps / (2 * 400 * spend.sum()))
    assert row.top_share == pytest.approx(np.sort(spend)[::-1][:80].sum() / spend.sum())
    shares = np.cumsum(spend[order]) / spend.sum()
    assert row.customers_for == (np.argmax(shares >= 0.8) + 1) / 400
    plan = concentration.spend_curve(table)._jdf.queryExecution().executedPlan().toString()
    assert "Window [" in plan  # the total is a subquery of its own, which only counts
    assert "SinglePartition" not in plan.split("Subquery", 1)[0]


def test_spend_curve_of_few_customers(spark):
    table = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "CustomerID string, spend double")
    assert [r.spend_share for r in concentration.spend_curve(table).collect()] == [None, None]
    assert concentration.spend_curve(table.limit(0)).count() == 0
    assert concentration.concentration(table.limit(0)).first().customers == 0


def plain_ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_correlations(spark):
    rng = np.random.default_rng(5)
    n = 300
    a = rng.normal(size=n)
    data = {"a": a, "b": np.exp(a + rng.normal(size=n) / 4), "c": rng.integers(0, 3, n).astype(float),
            "flat": np.full(n, 2.0), "hot": np.where(rng.random(n) < 0.7, 1.0, a)}
    rows = [(str(i), *(float(x[i]) for x in data.values())) for i in range(n)] + [("gap", None, 1.0, None, 2.0, 1.0)]
    schema = "CustomerID string, " + ", ".join(f"{c} double" for c in data)
    found = correlation.correlation(spark.createDataFrame(rows, schema).repartition(3), list(data)).collect()
    assert len(found) == 25
    data["b"], data["flat"], data["hot"] = (np.append(data[c], v) for c, v in (("b", 1.0), ("flat", 2.0), ("hot", 1.0)))
    ranks = {c: plain_ranks(x) for c, x in data.items()}
    for r in found:
        m = min(len(data[r.a]), len(data[r.b]))
        if "flat" in (r.a, r.b):
            assert r.pearson is None and r.spearman is None
            continue
        assert r.pearson == pytest.approx(np.corrcoef(data[r.a][:m], data[r.b][:m])[0, 1])
        assert r.spearman == pytest.approx(np.corrcoef(ranks[r.a][:m], ranks[r.b][:m])[0, 1])


def plain_rand(a, b):
    """Adjusted Rand index from all pairs of rows."""
    pairs = list(itertools.combinations(range(len(a)), 2))
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    in_a, in_b = sum(a[i] == a[j] for i, j in pairs), sum(b[i] == b[j] for i, j in pairs)
    chance, most = in_a * in_b / len(pairs), (in_a + in_b) / 2
    return 1.0 if most == chance else (both - chance) / (most - chance)


def test_adjusted_rand_index(spark):
    rng = np.random.default_rng(1)
    groups = {"noise": rng.integers(0, 4, (2, 90)), "one": np.zeros((2, 20), int)}
    groups["same"] = np.vstack([groups["noise"][0], 3 - groups["noise"][0]])
    groups["near"] = np.vstack([groups["noise"][0], np.where(rng.random(90) < 0.2, 0, groups["noise"][0])])
    rows = [(g, int(x), int(y)) for g, (a, b) in groups.items() for x, y in zip(a, b)]
    table = spark.createDataFrame(rows, "g string, a int, b int")
    found = {r.g: r.ari for r in clustering.adjusted_rand(table, "a", "b", ["g"]).collect()}
    for g, (a, b) in groups.items():
        assert found[g] == pytest.approx(plain_rand(a.tolist(), b.tolist()))
    assert found["same"] == found["one"] == 1 and found["near"] > 0.5 > abs(found["noise"])


def test_stability_of_starts(spark):
    rng = np.random.default_rng(4)
    points = np.repeat(rng.normal(0, 8, (3, 2)), 40, axis=0) + rng.normal(size=(120, 2))
    rows = [(str(i), *map(float, p)) for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, "CustomerID string, x0 double, x1 double").persist()
    fits = clustering.fit_kmeans(table, [3, 5], columns=["x0", "x1"], n_init=3, order_by="x0", partitions=2)
    found = clustering.stability(table, fits).collect()
    assert sorted((r.k, r.start_a, r.start_b) for r in found) == [
        (k, a, b) for k in (3, 5) for a, b in ((0, 1), (0, 2), (1, 2))
    ]
    for r in found:
        a, b = (
            [min(range(r.k), key=lambda c: ((p - m.clusterCenters()[c]) ** 2).sum()) for p in points]
            for m in (fits[r.k].starts[i][1] for i in (r.start_a, r.start_b))
        )
        assert r.ari == pytest.approx(plain_rand(a, b))
    costs = clustering.start_costs(spark, fits).collect()
    assert len(costs) == 6 and sum(r.is_chosen for r in costs) == 2


def test_all_starts_move_together_as_in_separate_fits(spark):
    """A round is one pass for all starts, and each start ends where Spark's own fit ends."""
    rng = np.random.default_rng(8)
    points = rng.normal(0, 3, (6, 3))[rng.integers(0, 6, 300)] + rng.normal(size=(300, 3))
    table = spark.createDataFrame([(str(i), *map(float, p)) for i, p in enumerate(points)], "CustomerID string, x double, y double, z double")
    columns = ["x", "y", "z"]
    dealt = table.repartition(2, "CustomerID").sortWithinPartitions("CustomerID", *columns)
    vectors = with_vector(dealt, columns).select("vector", vector_to_array("vector").alias("point")).persist()
    options = [{"k": k, "seed": seed, "featuresCol": "vector"} for k in (2, 4, 7) for seed in (1, 2)]
    whole = [KMeans(maxIter=50, tol=0.01, **o).fit(vectors) for o in options]
    starts = [np.array(KMeans(maxIter=0, **o).fit(vectors).clusterCenters()) for o in options]
    spark.sparkContext.setJobGroup("rounds", "")
    try:
        found = clustering._lloyd(vectors.select("point"), starts, [0.01] * len(starts), 50)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for one, other in zip(whole, found):
        assert np.allclose(one.clusterCenters(), other.clusterCenters(), rtol=1e-9)
        assert one.summary.numIter == other.summary.numIter
        assert one.summary.trainingCost == pytest.approx(other.summary.trainingCost)
    longest = max(m.summary.numIter for m in found)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")
    assert longest <= len(jobs) <= longest + 1 < sum(m.summary.numIter for m in found)
    vectors.unpersist()
