"""All queries with SQL at the smallest scale, and the whole study end to end."""

import os

import pytest

from checks import adaptor, compare
from checks.oracles import ORACLES
from checks.queries import PERSONAS, QUERIES
from tillroll.plans import segmentation
from tillroll.sources import transactions as io

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare.difference(spark, duck, SF, name) is None


@pytest.mark.parametrize("name", ["boxcox_lambda", "pca_check", "scaled_describe"])
def test_model_query_equals_sql_at_the_next_scale(spark, name):
    """Narrow columns, which only this scale has."""
    sf = "/root/testdata/sf0.01"
    assert compare.difference(spark, compare.connect(sf), sf, name) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_whole_study(spark, tmp_path):
    export = str(tmp_path / "export")
    adaptor.transactions(spark, SF).write.options(
        **io.CSV_OPTIONS, encoding="ISO-8859-1", timestampNTZFormat="yyyy-MM-dd HH:mm:ss"
    ).csv(export)
    folder = str(tmp_path / "out")
    explored = segmentation.explore(spark, export, folder, country=None)
    lines = explored["clean"].count()
    assert explored["cleaning_report"].first().rows_after == lines
    assert all(df.limit(1).count() == 1 for df in explored.values())
    engineered = segmentation.engineer(explored["clean"], folder)
    customers = engineered["scaled"].count()
    assert customers == explored["customer_totals"].count()
    done = segmentation.segment(
        engineered["scaled"],
        engineered["features"],
        folder,
        k_values=(3,),
        k_scan=range(2, 4),
        personas=PERSONAS,
        n_init=1,
        max_iter=20,
        trees=5,
        max_depth=4,
    )
    assert all(df.limit(1).count() == 1 for df in done.tables.values())
    assert done.tables["shap_values"].count() == customers * 16 * 3
    assert done.tables["surrogate_confusion"].agg({"n": "sum"}).first()[0] == customers
    stored = spark.read.options(**io.CSV_OPTIONS).schema("CustomerID string, Cluster int, k int")
    labels = stored.csv(f"{folder}/customer_clusters")
    assert labels.exceptAll(
        done.tables["labels"].select("CustomerID", "Cluster", "k")
    ).isEmpty() and labels.count() == customers


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_feature_tables_round_trip(spark, tmp_path, fmt):
    from checks.queries import customer_table

    table = customer_table(spark, SF)
    io.write_features(table, table, table, str(tmp_path), fmt)
    back = io.read_features(spark, str(tmp_path), "customer_features_scaled", fmt)
    assert back.exceptAll(table).isEmpty() and back.count() == table.count()
    with pytest.raises(ValueError):
        io.read_features(spark, str(tmp_path), "other")
