"""The feature state and the scoring of arriving lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import clustering, features, transforms
from tillroll.schema import FEATURES
from tillroll.streaming import feature_state, scoring
from tillroll.streaming.feature_state import FeatureState
from tillroll.streaming.scoring import SegmentModel

SCHEMA = (
    "InvoiceNo string, StockCode string, Quantity bigint, UnitPrice double, TotalPrice double,"
    " CustomerID string"
)


def make_lines(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        customer = None if rng.random() < 0.03 else f"{int(rng.integers(0, 40)) % 29:05d}"
        invoice = None if rng.random() < 0.02 else f"{customer}-{rng.integers(0, 6)}"
        stock = None if rng.random() < 0.02 else f"s{rng.integers(0, 15)}"
        quantity, price = int(rng.integers(1, 30)), float(rng.integers(1, 64)) / 4
        rows.append((invoice, stock, quantity, price, quantity * price, customer))
    return spark.createDataFrame(rows, SCHEMA).persist()


def table_of(df):
    return {r.CustomerID: [r[c] for c in FEATURES] for r in df.collect()}


def same(got, wanted):
    got, wanted = table_of(got), table_of(wanted)
    assert set(got) == set(wanted)
    for key, row in wanted.items():
        assert got[key] == pytest.approx(row, rel=1e-12)


def batches_of(lines, n=3):
    """Lines of one invoice fall into several batches; the later ones are late."""
    dealt = F.pmod(F.xxhash64("InvoiceNo", "StockCode", "Quantity", "UnitPrice"), F.lit(n))
    return [lines.where(dealt == i) for i in range(n)]


def test_state_equals_the_one_shot_features(spark, tmp_path):
    lines = make_lines(spark)
    state = FeatureState(spark, str(tmp_path / "state"), buckets=5)
    assert state.features().count() == 0 and state.commits() == []
    parts = batches_of(lines)
    for number, batch in enumerate(parts):
        assert state.merge(batch, number)
        before = parts[0]
        for part in parts[1 : number + 1]:
            before = before.unionByName(part)
        same(state.features(), features.customer_features(before))
    assert not state.merge(parts[1], 1) and not state.merge(lines, 2)  # replays
    same(state.features(), features.customer_features(lines))
    some = lines.select("CustomerID").where("CustomerID < '00007'")
    same(state.features(some), features.customer_features(lines.where("CustomerID < '00007'")))
    assert state.vacuum() > 0 and state.commits() == [2]
    same(FeatureState(spark, state.folder, 5).features(), features.customer_features(lines))
    assert not state.merge(parts[0], 0)  # still known after the old commits are gone
    with pytest.raises(ValueError, match="buckets"):
        FeatureState(spark, state.folder, 6).features()


def test_only_touched_buckets_are_written_and_a_broken_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    lines = make_lines(spark)
    state = FeatureState(spark, str(tmp_path / "state"), buckets=8)
    state.merge(lines, 0)
    one = lines.where("CustomerID = '00003'")
    state.merge(one, 1)
    assert sorted(state.versions().values()) == [0] * 7 + [1]
    wanted = features.customer_features(lines.unionByName(one))
    same(state.features(), wanted)
    create = spark.createDataFrame
    with monkeypatch.context() as m:  # the writer dies before its commit
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            state.merge(lines, 2)
    assert spark.createDataFrame.__func__ is create.__func__
    same(state.features(), wanted)
    assert state.merge(lines, 2)  # and does it again
    same(state.features(), features.customer_features(lines.unionByName(one).unionByName(lines)))
    assert state.merge(lines.limit(0), 3) and state.commits()[-1] == 3
    assert set(state.versions().values()) == {2}


@pytest.fixture(scope="module")
def model(spark):
    table = features.customer_features(make_lines(spark)).persist()
    boxcox = transforms.fit_box_cox(table)
    moved = transforms.apply_box_cox(table, boxcox)
    scaled = transforms.standardize(moved)
    fit = clustering.fit_kmeans(scaled, [3], table, n_init=2, partitions=2)[3]
    labels = {r.CustomerID: r.Cluster for r in fit.assign(scaled).collect()}
    return SegmentModel.of(boxcox, transforms.fit_scale(moved), fit), labels


def test_saved_model_gives_the_labels_of_the_fit(spark, tmp_path, model):
    made, labels = model
    made.save(spark, str(tmp_path / "model"))
    loaded = SegmentModel.load(spark, str(tmp_path / "model"))
    assert loaded == made
    table = features.customer_features(make_lines(spark))
    got = {r.CustomerID: r.Cluster for r in loaded.score(table).collect()}
    assert got == labels and len(set(labels.values())) == 3


def test_stream_in_two_batches_equals_one_run(spark, tmp_path, model):
    made, labels = model
    lines = make_lines(spark)
    source, model_path, out = (str(tmp_path / n) for n in ("in", "model", "labels"))
    made.save(spark, model_path)
    state = FeatureState(spark, str(tmp_path / "state"), buckets=4)

    def run():
        scoring.follow(
            spark, source, state, model_path, out, str(tmp_path / "checkpoint"),
            clean=lambda batch: batch.where("Quantity > 0"), schema=SCHEMA, files_per_batch=1,
        ).awaitTermination()
        return {r.CustomerID: (r.Cluster, r.distance_sq) for r in scoring.current_labels(spark, out).collect()}

    first, second = batches_of(lines, 2)
    first.coalesce(1).write.parquet(source)
    run()
    second.coalesce(1).write.mode("append").parquet(source)
    found = run()
    assert {c: k for c, (k, _) in found.items()} == labels and state.commits() == [0, 1]
    assert run() == found  # nothing new arrived
    # A replay of either batch, as after a failure behind its writes, changes nothing.
    for number, batch in enumerate((first, second)):
        scoring.score_batch(batch, number, state, made, out)
    again = scoring.current_labels(spark, out).collect()
    assert {r.CustomerID: (r.Cluster, r.distance_sq) for r in again} == found


def test_a_merge_shuffles_the_state_once(spark, tmp_path):
    lines = make_lines(spark)
    state = FeatureState(spark, str(tmp_path / "state"), buckets=3)
    state.merge(lines, 0)
    old = state.sums().withColumn("bucket", state.bucket())
    both = state._added(old, old, 4, 12)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning(bucket" in plan
    found = {tuple(r[:5]): tuple(r[5:]) for r in both.select("bucket", *features.PAIR, *features.SUMS).collect()}
    twice = {
        tuple(r[:5]): tuple(None if x is None else 2 * x for x in r[5:])
        for r in old.select("bucket", *features.PAIR, *features.SUMS).collect()
    }
    assert found == twice


def test_tasks_that_write_a_state_follow_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feature_state, "WRITER_ROWS", 20)
    lines = make_lines(spark)
    state = FeatureState(spark, str(tmp_path / "state"), buckets=2)
    state.merge(lines, 0)
    files = state.sums().select(F.input_file_name().alias("file")).groupBy("file").count().collect()
    assert len(files) > 2 * feature_state.WRITERS
    found = {r.CustomerID: r.Sum_Quantity for r in state.features().collect()}
    assert found == {r.CustomerID: r.Sum_Quantity for r in features.customer_features(lines).collect()}
