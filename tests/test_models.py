import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks import queries
from tillroll.operators import clustering, profiles, reduction, shapley, silhouette, surrogate
from tillroll.schema import FEATURES, RADAR_AXES_6

COLUMNS = [f"x{i}" for i in range(16)]


def blobs(spark, k, n=300, seed=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 6, (k, 16))
    truth = rng.integers(0, k, n)
    points = centers[truth] + rng.normal(0, 1, (n, 16))
    rows = [(f"{i:05d}", int(t), *map(float, p)) for i, (t, p) in enumerate(zip(truth, points))]
    schema = "CustomerID string, truth int, " + ", ".join(f"{c} double" for c in COLUMNS)
    return spark.createDataFrame(rows, schema).repartition(3), points, truth


def fit(df, ks, **options):
    settings = {"columns": COLUMNS, "n_init": 3, "max_iter": 50, "order_by": "x0"} | options
    return clustering.fit_kmeans(df, ks, **settings)


@pytest.fixture(scope="module")
def three(spark):
    df, points, truth = blobs(spark, 3)
    df = df.persist()
    return df, points, truth, fit(df, [2, 3, 4])


@pytest.mark.parametrize("k", [3, 4])
def test_kmeans_finds_planted_clusters(spark, k):
    df, points, truth = blobs(spark, k)
    fits = fit(df, [k])
    rows = fits[k].assign(df).select("truth", "Cluster", "x0").toPandas()
    assert rows.groupby("truth")["Cluster"].nunique().max() == 1
    assert rows.groupby("Cluster")["truth"].nunique().max() == 1
    means = rows.groupby("Cluster")["x0"].mean()
    assert list(means) == sorted(means, reverse=True)  # numbered by descending mean
    inertia = sum(
        ((points[truth == t] - points[truth == t].mean(0)) ** 2).sum() for t in range(k)
    )
    assert fits[k].inertia == pytest.approx(inertia)


def test_inertia_falls_and_best_k_is_planted(three, spark):
    df, _, _, fits = three
    table = clustering.k_selection(df, fits).orderBy("k").collect()
    inertias = [r.inertia for r in table]
    assert inertias == sorted(inertias, reverse=True)
    assert [r.is_best for r in table] == [False, True, False]
    assert clustering.best_k(clustering.k_selection(df, fits)).first().k == 3
    squared = clustering.k_selection(df, fits, "squaredEuclidean").orderBy("k").collect()
    assert [r.is_best for r in squared] == [False, True, False]
    with pytest.raises(ValueError):
        clustering.k_selection(df, fits, "cosine")


def test_inertia_is_that_of_the_returned_centers(spark):
    """Also where the fit ended with a move, on the real features at sf0.01."""
    scaled = queries.scaled_table(spark, "/root/testdata/sf0.01")
    fits = clustering.fit_kmeans(scaled, [3, 6], n_init=2, tol=1e-2, order_by="Sum_Quantity")
    points = np.array(scaled.select(*FEATURES).collect())
    for own in fits.values():
        for cost, model in own.starts:
            gaps = [((points - c) ** 2).sum(axis=1) for c in model.clusterCenters()]
            assert cost == pytest.approx(np.min(gaps, axis=0).sum(), rel=1e-12)
        assert own.inertia == min(cost for cost, _ in own.starts)
        assert any(abs(m.summary.trainingCost / cost - 1) > 1e-9 for cost, m in own.starts)


def test_spark_keeps_the_rows_of_a_start_as_objects(three, monkeypatch):
    """It does so only for input that is not itself a cached table. The draws are the same."""
    df, _, _, fits = three
    plain, seen = clustering.KMeans.fit, []

    def fit_and_note(self, rows, params=None):
        seen.append(rows.storageLevel.useMemory)
        return plain(self, rows, params)

    monkeypatch.setattr(clustering.KMeans, "fit", fit_and_note)
    again = fit(df, [2, 3])
    assert seen == [False] * 6
    for k, own in again.items():
        costs = [cost for cost, _ in fits[k].starts]
        assert [cost for cost, _ in own.starts] == pytest.approx(costs, rel=1e-12)


def test_packed_points_give_the_sums_of_single_points(three):
    df, points, _, _ = three
    rows = reduction.with_vector(df, COLUMNS).select(vector_to_array("vector").alias("point"))
    packed = rows.mapInArrow(clustering._pack, "points binary")
    starts = [points[:3], points[5:7]]
    for a, b in zip(clustering._moves(rows, starts), clustering._moves(packed, starts)):
        assert np.array_equal(a[0], b[0]) and a[1] == b[1]
    assert packed.count() < len(points)


def test_best_k_prefers_the_smaller_on_ties(spark):
    table = spark.createDataFrame([(4, 0.5), (3, 0.5), (2, 0.1)], "k int, silhouette double")
    assert clustering.best_k(table).first().k == 3


def test_fit_does_not_depend_on_how_rows_arrive(spark):
    df, _, _ = blobs(spark, 5, n=200, seed=9)
    noisy = df.withColumn("x0", F.col("x0") * 0.1)
    found = []
    for parts in (1, 7):
        fits = fit(noisy.repartition(parts), [4])
        rows = fits[4].assign(noisy).select("CustomerID", "Cluster").collect()
        found.append(sorted(tuple(r) for r in rows))
    assert found[0] == found[1]


def test_too_many_centroids_are_refused(spark, monkeypatch):
    points = spark.createDataFrame([([1.0, 2.0],)], "vector array<double>")
    centers = spark.createDataFrame([(0, [1.0, 2.0])], "cluster int, center array<double>")
    monkeypatch.setattr(clustering, "MAX_CENTROID_CELLS", 1)
    with pytest.raises(ValueError):
        clustering.assign_nearest_centroid(points, centers)


def test_too_large_a_forest_is_refused(small_forest, monkeypatch):
    df, _, _, model = small_forest
    monkeypatch.setattr(shapley, "MAX_LEAF_CELLS", 10)
    with pytest.raises(ValueError):
        shapley.shap_wide(df, model)


def test_chained_fit_sees_earlier_labels(three):
    df, _, _, _ = three
    fits = clustering.fit_kmeans_chained(
        df, [2, 3], columns=COLUMNS, n_init=1, max_iter=20, order_by="x0"
    )
    assert fits[3].columns == [*COLUMNS, "Cluster_2"]
    wide = clustering.assign_chained(df, fits)
    assert {"Cluster_2", "Cluster_3"} <= set(wide.columns)


def numpy_silhouette(points, labels):
    distance = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(2))
    out = []
    for i, own in enumerate(labels):
        size = (labels == own).sum()
        if size == 1:
            out.append(0.0)
            continue
        a = distance[i][labels == own].sum() / (size - 1)
        b = min(distance[i][labels == c].mean() for c in set(labels) if c != own)
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("block_rows", [16_384, 37])
def test_silhouette_equals_numpy(three, monkeypatch, block_rows):
    df, points, truth, _ = three
    monkeypatch.setattr(silhouette, "STRIP_ROWS", 16)
    lonely = df.withColumn("other", F.when(F.col("CustomerID") == "00007", 2).otherwise(F.col("truth") % 2))
    rows = silhouette.silhouettes(
        lonely, COLUMNS, {"a": "truth", "b": "other"}, "CustomerID", block_rows=block_rows
    ).toPandas()
    other = truth % 2
    other[7] = 2
    for name, labels in (("a", truth), ("b", other)):
        got = rows[rows["k"] == name].sort_values("CustomerID")["silhouette"].to_numpy()
        assert np.allclose(got, numpy_silhouette(points, labels), atol=1e-9)


def test_nearest_centroid(spark):
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0]), (3, [1.0, 0.0])], "id int, vector array<double>")
    centers = spark.createDataFrame([(7, [5.0, 5.0]), (1, [0.0, 0.0]), (0, [2.0, 0.0])], "cluster int, center array<double>")
    got = {r.id: (r.cluster, r.distance_sq) for r in clustering.assign_nearest_centroid(points, centers).collect()}
    assert got == {1: (1, 0.0), 2: (7, 0.0), 3: (0, 1.0)}


def test_pca_equals_numpy(three, spark):
    df, points, _, _ = three
    pca = reduction.fit_pca(df, columns=COLUMNS)
    table = pca.variance(spark).orderBy("component").toPandas()
    values, vectors = np.linalg.eigh(np.cov(points.T))
    assert np.allclose(table["ratio"], values[::-1] / values.sum())
    assert table["cumulative"].iloc[-1] == pytest.approx(1.0)
    scores = pca.scores(df).toPandas().sort_values("CustomerID")[pca.names].to_numpy()
    expected = (points - points.mean(0)) @ vectors[:, ::-1]
    assert np.allclose(np.abs(scores[:, :3]), np.abs(expected[:, :3]))
    top = np.abs(scores).argmax(0)
    assert (scores[top, range(16)] > 0).all()
    assert len(reduction.fit_pca(df, 2, COLUMNS).names) == 2


def test_profiles(spark):
    means = spark.createDataFrame(
        [(2, c, f, v) for f, vs in {"Sum_Quantity": (1.0, 3.0), "Count_Stock": (4.0, 4.0), "Mean_TotalPrice": (1.0, 2.0)}.items() for c, v in enumerate(vs)],
        "k int, Cluster int, feature string, mean double",
    )
    rows = profiles.radar_profile(means, RADAR_AXES_6, {2: ["big"]}, "Cluster").collect()
    got = {(r.Cluster, r.feature): (r.persona, r.axis, r.value) for r in rows}
    assert got == {
        (0, "Sum_Quantity"): ("big", "Khối lượng mua", 0.0),
        (1, "Sum_Quantity"): ("Cluster 1", "Khối lượng mua", 1.0),
        (0, "Count_Stock"): ("big", "Đa dạng sản phẩm", 0.0),
        (1, "Count_Stock"): ("Cluster 1", "Đa dạng sản phẩm", 0.0),
    }


def test_sizes_and_shares(three):
    df, _, truth, fits = three
    labels = clustering.labels_long(df, fits)
    sizes = profiles.cluster_sizes(labels).toPandas()
    assert (sizes.groupby("k")["customers"].sum() == 300).all()
    assert np.allclose(sizes.groupby("k")["share_pct"].sum(), 100)


# ---- surrogate and Shapley values ----------------------------------------------------------


@pytest.fixture(scope="module")
def small_forest(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 1)
    rows = [(f"{i:05d}", int(c), *map(float, p)) for i, (c, p) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "CustomerID string, Cluster int, f0 double, f1 double, f2 double, f3 double")
    columns = ["f0", "f1", "f2", "f3"]
    model = surrogate.train_surrogate(df, 3, columns, trees=8, max_depth=5)
    return df.persist(), x, columns, model


def test_surrogate_tables(small_forest):
    df, _, _, model = small_forest
    predictions = model.predictions(df)
    table = surrogate.confusion(predictions, [3]).toPandas()
    assert len(table) == 9 and table["n"].sum() == 400
    accuracy = surrogate.fidelity(predictions).first()
    diagonal = table[table["label"] == table["prediction"]]["n"].sum()
    assert accuracy.fidelity == pytest.approx(diagonal / 400)
    assert accuracy.verdict == ("CHÍNH XÁC" if accuracy.fidelity >= 0.95 else "HỢP LÝ")
    with pytest.raises(ValueError):
        surrogate.train_surrogate(df.drop("Cluster"), 3)


def tree_value(tree, node, row, known):
    """Expected class shares when only the features in ``known`` are followed."""
    n = tree[node]
    if n.left < 0:
        return np.array(n.stats) / sum(n.stats)
    if n.feature in known:
        return tree_value(tree, n.left if row[n.feature] <= n.threshold else n.right, row, known)
    parts = [
        sum(tree[c].stats) / sum(n.stats) * tree_value(tree, c, row, known) for c in (n.left, n.right)
    ]
    return parts[0] + parts[1]


def test_shapley_values_equal_brute_force(small_forest, spark):
    df, x, columns, model = small_forest
    nodes = shapley.forest_nodes(model, spark).persist()
    values = shapley.shap_values(df, model, shapley.leaf_paths(nodes)).toPandas()
    trees = {}
    for n in nodes.collect():
        trees.setdefault(n.tree, {})[n.node] = n
    d = len(columns)
    for i in (0, 17, 200):
        game = {
            known: sum(tree_value(t, 0, x[i], known) for t in trees.values()) / len(trees)
            for r in range(d + 1)
            for known in map(frozenset, itertools.combinations(range(d), r))
        }
        mine = values[values["CustomerID"] == f"{i:05d}"].set_index(["cluster", "feature"])["shap"]
        for j in range(d):
            phi = sum(
                math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d)
                * (game[s | {j}] - game[s])
                for s in game
                if j not in s
            )
            for c in range(3):
                assert mine[c, columns[j]] == pytest.approx(phi[c], abs=1e-12)


def test_shapley_weights_are_tabled_once_a_batch(monkeypatch):
    """Against the integral of each leaf, with missing and infinite values and a long path."""
    rng, width = np.random.default_rng(4), 12
    paths = []
    for d, leaves in ((2, 5), (4, 70), (11, 3)):
        feature = np.array([rng.permutation(width)[:d] for _ in range(leaves)])
        ends = np.sort(np.round(rng.normal(size=(2, leaves, d)), 1), axis=0)
        low = np.where(rng.random((leaves, d)) < 0.4, -np.inf, ends[0])
        high = np.where(rng.random((leaves, d)) < 0.4, np.inf, ends[1])
        paths.append((feature, low, high, rng.uniform(0.1, 0.9, (leaves, d)), rng.dirichlet([1, 1], leaves)))
    x = np.round(rng.normal(size=(700, width)), 1)  # many values lie on a threshold
    x[:20] = np.where(rng.random((20, width)) < 0.2, np.nan, x[:20])
    x[20:40] = np.where(rng.random((20, width)) < 0.2, -np.inf, x[20:40])
    x[40:60] = np.where(rng.random((20, width)) < 0.2, np.inf, x[40:60])
    expected = np.zeros((len(x), 2, width))
    for feature, low, high, z, shares in paths:
        for f, lo, hi, share, v in zip(feature, low, high, z, shares):
            met = ((x[:, f] > lo) & (x[:, f] <= hi)).astype(float)
            nodes, weights = np.polynomial.legendre.leggauss(12)
            terms = [share * (1 - s) + met * s for s in (nodes + 1) / 2]
            for j in range(len(f)):
                rest = sum(w / 2 * np.delete(t, j, 1).prod(1) for w, t in zip(weights, terms))
                expected[:, :, f[j]] += ((met[:, j] - share[j]) * rest)[:, None] * v
    tabled, plain = [], shapley._pattern_weights
    monkeypatch.setattr(shapley, "_pattern_weights", lambda z: tabled.append(z.shape) or plain(z))
    columns = [f"x{i}" for i in range(width)]
    paths_bc = type("Shared", (), {"value": paths})
    done = next(shapley._explain_batches(paths_bc, columns, 2, 1)(iter([pd.DataFrame(x, columns=columns)])))
    assert np.abs(np.stack(done["shap"]).reshape(expected.shape) - expected).max() < 1e-12
    assert tabled == [(5, 2), (64, 4), (6, 4)]


def test_shapley_quadrature_is_exact_and_found_once():
    for n in range(1, 6):
        nodes, weights = shapley._quadrature(n)
        assert shapley._quadrature(n)[0] is nodes
        for power in range(2 * n):
            assert weights @ nodes**power == pytest.approx(1 / (power + 1), rel=1e-12)


def test_shapley_values_add_up(small_forest, spark):
    df, _, columns, model = small_forest
    paths = shapley.leaf_paths(shapley.forest_nodes(model, spark))
    base = shapley.base_values(paths, 8)
    sums = shapley.shap_values(df, model, paths).groupBy("CustomerID", "cluster").agg(F.sum("shap").alias("s"))
    scored = model.model.transform(reduction.with_vector(df, columns)).select(
        "CustomerID", vector_to_array("probability").alias("p")
    )
    for r in sums.join(scored, "CustomerID").collect():
        assert base[r.cluster] + r.s == pytest.approx(r.p[r.cluster], abs=1e-12)


def test_shap_summary(small_forest, spark):
    df, _, _, model = small_forest
    values = shapley.shap_values(df, model).persist()
    top = shapley.top_features(values, 3).toPandas()
    assert (top.groupby("cluster").size() == 3).all()
    means = values.toPandas().assign(size=lambda t: t["shap"].abs()).groupby(["cluster", "feature"])["size"].mean()
    for c in range(3):
        best = means[c].sort_values(ascending=False).index[:3].tolist()
        assert top[top["cluster"] == c].sort_values("rank")["feature"].tolist() == best
    one = shapley.shap_summary(values, 3, cluster_id=1)
    assert one.count() == 3 * 400 and {r.cluster for r in one.select("cluster").distinct().collect()} == {1}
