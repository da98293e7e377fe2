"""Features and scores against their written definitions, with missing keys and a hot customer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillroll.operators import features, rfm, sales
from tillroll.schema import FEATURES


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(2)
    n = 6000
    customer = rng.integers(0, 60, n).astype(str)
    customer[rng.random(n) < 0.35] = "hot"  # a third of all lines
    pdf = pd.DataFrame(
        {
            "CustomerID": customer,
            "InvoiceNo": rng.integers(0, 400, n).astype(str),
            "StockCode": rng.integers(0, 80, n).astype(str),
            "Quantity": rng.integers(1, 20, n),
            "UnitPrice": np.round(rng.lognormal(1, 1, n) + 0.01, 2),
            "InvoiceDate": pd.Timestamp("2011-01-01")
            + pd.to_timedelta(rng.integers(0, 300 * 86400, n), unit="s"),
        }
    )
    pdf.loc[rng.random(n) < 0.05, "InvoiceNo"] = None
    pdf.loc[rng.random(n) < 0.05, "StockCode"] = None
    pdf.loc[rng.random(n) < 0.02, "CustomerID"] = None
    pdf["TotalPrice"] = pdf["Quantity"] * pdf["UnitPrice"]
    return pdf


@pytest.fixture(scope="module")
def clean(spark, frame):
    schema = (
        "CustomerID string, InvoiceNo string, StockCode string, Quantity bigint, "
        "UnitPrice double, InvoiceDate timestamp_ntz, TotalPrice double"
    )
    rows = [
        (
            *(None if pd.isna(v) else v for v in (r.CustomerID, r.InvoiceNo, r.StockCode)),
            int(r.Quantity),
            float(r.UnitPrice),
            r.InvoiceDate.to_pydatetime(),
            float(r.TotalPrice),
        )
        for r in frame.itertuples()
    ]
    return spark.createDataFrame(rows, schema).repartition(6).persist()


def rows_by_customer(frame):
    """Lines of each customer as dictionaries; missing values are None."""
    out = {}
    for line in frame.astype(object).where(frame.notna(), None).to_dict("records"):
        if line["CustomerID"] is not None:
            out.setdefault(line["CustomerID"], []).append(line)
    return out


def average(values):
    return sum(values) / len(values)


def expected(lines):
    """The sixteen features from their written definitions, line by line."""
    out = {
        "Sum_Quantity": sum(x["Quantity"] for x in lines),
        "Mean_UnitPrice": average([x["UnitPrice"] for x in lines]),
        "Mean_TotalPrice": average([x["TotalPrice"] for x in lines]),
        "Sum_TotalPrice": sum(x["TotalPrice"] for x in lines),
    }
    counts = {"Invoice": "Mean_StockCountPerInvoice", "Stock": "Mean_InvoiceCountPerStock"}
    for name, key in (("Invoice", "InvoiceNo"), ("Stock", "StockCode")):
        groups = {}
        for x in lines:
            if x[key] is not None:
                groups.setdefault(x[key], []).append(x)
        out[f"Count_{name}"] = len(groups)
        out[counts[name]] = average([len(g) for g in groups.values()])
        for column in ("UnitPrice", "TotalPrice"):
            means = [average([x[column] for x in g]) for g in groups.values()]
            out[f"Mean_{column}MeanPer{name}"] = average(means)
        for column in ("Quantity", "TotalPrice"):
            sums = [sum(x[column] for x in g) for g in groups.values()]
            out[f"Mean_{column}SumPer{name}"] = average(sums)
    return out


def test_features_equal_their_definitions(clean, frame):
    got = features.customer_features(clean).toPandas().set_index("CustomerID")
    customers = rows_by_customer(frame)
    assert set(got.index) == set(customers)
    for customer, lines in customers.items():
        want = expected(lines)
        for f in FEATURES:
            assert got.loc[customer, f] == pytest.approx(want[f], rel=1e-12), (customer, f)


def test_dealt_sums_are_the_same_and_no_task_holds_all(clean, frame):
    plain = features.customer_features(clean).toPandas().set_index("CustomerID").sort_index()
    dealt = features.customer_features(clean, 7).toPandas().set_index("CustomerID").sort_index()
    assert list(plain.index) == list(dealt.index)
    assert np.allclose(plain[FEATURES], dealt[FEATURES], rtol=1e-12, equal_nan=True)
    pairs = features.partial_sums(clean, 7)
    assert pairs.schema == features.partial_sums(clean).schema
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    whole = sum(sizes)
    assert len(sizes) == 7 and max(sizes) < whole / 4
    # Nothing is summed before the lines are dealt by pair.
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan[plan.index("REPARTITION_BY_NUM") :]
    assert features.tasks_for(0) == 1 and features.tasks_for(36_000_000) == 72


def test_scores_equal_their_definitions(clean, frame):
    got = {r.CustomerID: r for r in rfm.rfm(clean).collect()}
    customers = rows_by_customer(frame)
    newest = max(frame["InvoiceDate"])
    for customer, lines in customers.items():
        seconds = (newest - max(x["InvoiceDate"] for x in lines)).total_seconds() + 86_400
        assert got[customer].Recency == seconds // 86_400
        assert got[customer].Frequency == len({x["InvoiceNo"] for x in lines})
        assert got[customer].Monetary == pytest.approx(sum(x["TotalPrice"] for x in lines))
    assert set(got) == set(customers)


def test_totals_equal_pandas(clean, frame):
    got = sales.customer_totals(clean).toPandas().set_index("CustomerID")
    groups = frame.groupby("CustomerID")
    assert got["invoices"].to_dict() == groups["InvoiceNo"].nunique().to_dict()
    assert np.allclose(got["spend"].sort_index(), groups["TotalPrice"].sum().sort_index())
    summary = sales.spend_summary(sales.customer_totals(clean)).first()
    assert summary.median_spend == pytest.approx(groups["TotalPrice"].sum().median())
    assert summary.mean_invoices == pytest.approx(groups["InvoiceNo"].nunique().mean())


def test_daily_and_monthly_revenue_equal_pandas(clean, frame):
    daily = {pd.Timestamp(r.day): r.revenue for r in sales.daily_revenue(clean).collect()}
    want = frame.groupby(frame["InvoiceDate"].dt.normalize())["TotalPrice"].sum()
    assert daily == pytest.approx(want.to_dict())
    months = {}
    for day, revenue in want.items():
        months[day.year, day.month] = months.get((day.year, day.month), 0.0) + revenue
    monthly = {(r.month.year, r.month.month): r.revenue for r in sales.monthly_revenue(clean).collect()}
    assert monthly == pytest.approx(months)
