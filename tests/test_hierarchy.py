"""Ward's hierarchy over small clusters, and the silhouette from anchors, against plain versions."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tillroll.operators import hierarchy, silhouette

COLUMNS = ["x", "y"]


def plain_ward(points, labels):
    """Merges (members, cost) by trying every pair in every step."""
    groups = {int(c): points[labels == c] for c in sorted(set(labels))}
    number, merges = max(groups) + 1, []

    def within(p):
        return ((p - p.mean(0)) ** 2).sum()

    while len(groups) > 1:
        pairs = [
            (within(np.vstack([groups[a], groups[b]])) - within(groups[a]) - within(groups[b]), a, b)
            for a in groups
            for b in groups
            if a < b
        ]
        cost, a, b = min(pairs)
        groups[number] = np.vstack([groups.pop(a), groups.pop(b)])
        merges.append((a, b, number, cost, len(groups[number])))
        number += 1
    return merges


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 12, 400)
    spots = rng.normal(0, 5, (12, 2))[labels] + rng.normal(0, 1, (400, 2))
    rows = [
        (f"{i:04d}", int(c) + 3, [float(p[0]), float(p[1])], float(p[0]), float(p[1]))
        for i, (c, p) in enumerate(zip(labels, spots))
    ]
    schema = "CustomerID string, micro int, vector array<double>, x double, y double"
    return spark.createDataFrame(rows, schema).repartition(5).persist(), spots, labels + 3


def test_ward_equals_plain_version(spark, points):
    df, spots, labels = points
    found = hierarchy.ward(hierarchy.cluster_features(df, "micro")).table(spark).orderBy("step").collect()
    expected = plain_ward(spots, labels)
    assert [(r.left, r.right, r.node, r.n) for r in found] == [(a, b, c, n) for a, b, c, _, n in expected]
    assert [r.cost for r in found] == pytest.approx([cost for *_, cost, _ in expected])
    assert [r.height for r in found] == pytest.approx([np.sqrt(2 * m[3]) for m in expected])


def test_descriptions_add_up(points):
    df, spots, _ = points
    parts = hierarchy.cluster_features(df.withColumn("part", F.col("micro") % 3), "part")
    whole = hierarchy.merge_features(parts.withColumn("group", F.lit(0)))
    row = hierarchy.spread_within(whole).first()
    assert row.n == 400 and row.within == pytest.approx(((spots - spots.mean(0)) ** 2).sum())


def test_cuts_nest_and_find_planted_groups(spark):
    rng = np.random.default_rng(8)
    truth = rng.integers(0, 3, 300)
    spots = np.array([[0.0, 0.0], [20.0, 0.0], [0.0, 20.0]])[truth] + rng.normal(0, 1, (300, 2))
    rows = [(f"{i:04d}", *map(float, p)) for i, p in enumerate(spots)]
    df = spark.createDataFrame(rows, "CustomerID string, x double, y double")
    labels = []
    for arrived in (df, df.repartition(7)):
        micro = hierarchy.micro_clusters(arrived, COLUMNS, micro=30)
        merges = hierarchy.ward(hierarchy.cluster_features(micro, "micro"))
        labels.append(merges.cut(micro, [1, 3, 6, 500]).toPandas())
    pair = [t.sort_values(["k", "CustomerID"]).reset_index(drop=True) for t in labels]
    assert pair[0].equals(pair[1])
    by_k = {k: t.sort_values("CustomerID")["Cluster"].to_numpy() for k, t in labels[0].groupby("k")}
    assert set(by_k[1]) == {0}
    assert len({(a, b) for a, b in zip(by_k[3], truth)}) == 3
    assert len({(a, b) for a, b in zip(by_k[6], by_k[3])}) == 6
    assert len(set(by_k[500])) <= 30


def test_equal_rows_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in (0, 1, 2, 3)], "c int, vector array<double>")
    merges = hierarchy.ward(hierarchy.cluster_features(df, "c"))
    assert [(m[1], m[2]) for m in merges.merges] == [(0, 1), (2, 3), (4, 5)]
    same = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "c int, vector array<double>")
    assert hierarchy.ward(hierarchy.cluster_features(same, "c")).merges == [(0, 0, 1, 0.0, 2)]
    none = hierarchy.ward(hierarchy.cluster_features(df.limit(0), "c"))
    assert none.merges == [] and none.table(spark).count() == 0 and none.groups(2) == {}
    with pytest.raises(ValueError):
        merges.groups(0)


def test_too_many_small_clusters_are_refused(spark, points, monkeypatch):
    df, _, _ = points
    monkeypatch.setattr(hierarchy, "MAX_MICRO_CLUSTERS", 5)
    with pytest.raises(ValueError):
        hierarchy.ward(hierarchy.cluster_features(df, "micro"))
    with pytest.raises(ValueError):
        hierarchy.micro_clusters(df, COLUMNS, micro=6)


def test_all_rows_as_anchors_give_the_exact_silhouette(points):
    df, _, _ = points
    names = {"a": "micro", "b": "half"}
    df = df.withColumn("half", F.col("micro") % 2)
    exact = silhouette.mean_silhouettes(df, COLUMNS, names, "CustomerID").collect()
    found = silhouette.estimated_silhouettes(df, COLUMNS, names, "CustomerID", anchors=400).collect()
    assert {r.k: r.silhouette for r in found} == pytest.approx({r.k: r.silhouette for r in exact})
    assert {(r.rows, r.anchors, r.error) for r in found} == {(400, 400, 0.0)}


def test_exact_silhouette_lies_within_three_errors(points):
    df, _, _ = points
    exact = silhouette.mean_silhouettes(df, "vector", {1: "micro"}, "CustomerID").first().silhouette
    for seed in range(3):
        options = {"anchors": 60, "seed": seed}
        row = silhouette.estimated_silhouettes(df, "vector", {1: "micro"}, "CustomerID", **options).first()
        again = silhouette.estimated_silhouettes(
            df.repartition(3), "vector", {1: "micro"}, "CustomerID", **options
        ).first()
        assert row.anchors == 60 and row.error > 0
        assert abs(row.silhouette - exact) < 3 * row.error
        assert again.silhouette == pytest.approx(row.silhouette)


def test_unfit_numbers_of_anchors_are_refused(points, monkeypatch):
    df, _, _ = points
    monkeypatch.setattr(silhouette, "MAX_ANCHOR_CELLS", 100)
    for anchors in (0, 50):
        with pytest.raises(ValueError):
            silhouette.anchor_silhouettes(df, COLUMNS, {1: "micro"}, "CustomerID", anchors=anchors)


def test_blocks_stay_few():
    assert [silhouette.block_count(n) for n in (1, 5_000, 500_000, 2_000_000)] == [1, 5, 31, 64]
    assert silhouette.block_count(100_000_000) == 763


def test_silhouette_in_tiles(points, monkeypatch):
    df, _, _ = points
    whole = silhouette.silhouettes(df, COLUMNS, {1: "micro"}, "CustomerID").toPandas()
    monkeypatch.setattr(silhouette, "TILE_ROWS", 30)
    monkeypatch.setattr(silhouette, "STRIP_ROWS", 7)
    tiled = silhouette.silhouettes(df, COLUMNS, {1: "micro"}, "CustomerID", block_rows=150).toPandas()
    a, b = (t.sort_values("CustomerID")["silhouette"].to_numpy() for t in (whole, tiled))
    assert a == pytest.approx(b)


def test_a_block_task_holds_little_beside_its_points():
    """Points come as Arrow columns and meet in small tiles: no object per row, no wide matrix."""
    n, width = 12_000, 16
    points = np.random.default_rng(3).normal(size=(n, width))
    lists = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), width).cast(pa.list_(pa.float64()))
    labels = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(n, dtype=np.int32) % 2), 1).cast(pa.list_(pa.int32()))
    block = np.repeat(np.array([0, 1], np.int32), n // 2)
    table = pa.table(
        {"id": np.arange(n), "point": lists, "labels": labels, "block": block,
         "first": np.zeros(n, np.int32), "second": np.ones(n, np.int32)}
    )
    kernel = silhouette._block_sums([2], silhouette.STRIP_ROWS, silhouette.TILE_ROWS)
    tracemalloc.start()
    try:
        found = kernel(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60e6
    row = found.filter(pc.equal(found["id"], 5)).to_pylist()[0]
    away = np.sqrt(((points[n // 2 :] - points[5]) ** 2).sum(1))
    assert row["s0"] == pytest.approx(away[::2].sum()) and row["s1"] == pytest.approx(away[1::2].sum())
