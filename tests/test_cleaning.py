import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtures import write_raw
from tillroll.functions.columns import normalize_customer_id, parse_invoice_date, persona_of
from tillroll.operators import cleaning, features, rfm, sales
from tillroll.sources import transactions as io


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    return io.read_transactions(spark, write_raw(tmp_path_factory.mktemp("raw") / "raw.csv"))


@pytest.fixture(scope="module")
def clean(raw):
    return cleaning.time_features(cleaning.clean_transactions(raw)).persist()


def test_scan_decodes_and_parses(raw):
    rows = {r.InvoiceNo: r for r in raw.collect() if r.InvoiceNo}
    assert rows["536505"].Description == 'CAFÉ, "LARGE"'
    assert rows["581587"].CustomerID == "012680"
    assert [r.InvoiceDate for r in raw.filter("InvoiceNo = '536503'").collect()] == [
        dt.datetime(2011, 3, 5)
    ] * 2


def test_both_date_formats(spark):
    texts = [("2010-12-01 08:26:00",), ("12/1/2010 8:26",), ("1/9/2011 18:05",), ("x",), (None,)]
    df = spark.createDataFrame(texts, "t string").select(parse_invoice_date(F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == [
        dt.datetime(2010, 12, 1, 8, 26),
        dt.datetime(2010, 12, 1, 8, 26),
        dt.datetime(2011, 1, 9, 18, 5),
        None,
        None,
    ]


def test_customer_id_forms(spark):
    given = {"17850.0": "017850", "12.05": "000125", "1234567": "1234567", "-12": "-00012"}
    df = spark.createDataFrame([(k,) for k in [*given, None]], "id string")
    out = df.select(
        "id",
        normalize_customer_id(F.col("id")).alias("a"),
        normalize_customer_id(F.col("id"), "placeholder").alias("b"),
    ).collect()
    assert {r.id: r.a for r in out} == {**given, None: None}
    assert {r.id: r.b for r in out}[None] == "000nan"
    with pytest.raises(ValueError):
        normalize_customer_id(F.col("id"), "keep")


def test_kept_lines(clean):
    kept = sorted((r.InvoiceNo or "", r.StockCode or "") for r in clean.collect())
    assert kept == sorted(
        [
            ("581587", "22613"),
            ("c536380", "22960"),
            ("", "22961"),
            ("536502", "22731"),
            ("536503", "22732"),
            ("536503", "22732"),
            ("536504", ""),
            ("536505", "22733"),
        ]
    )


def test_placeholder_mode_keeps_the_unknown_customer(spark, tmp_path):
    raw = io.read_transactions(spark, write_raw(tmp_path / "raw.csv"), "placeholder")
    ids = {r.CustomerID for r in cleaning.clean_transactions(raw).collect()}
    assert "000nan" in ids and len(ids) == 5


def test_time_features_monday_is_zero(clean):
    row = clean.filter("InvoiceNo = '581587'").first()  # a Friday
    assert (row.DayOfWeek, row.HourOfDay) == (4, 12)


def test_rfm(clean):
    scores = {r.CustomerID: r for r in rfm.rfm(clean).collect()}
    assert scores["012680"].Recency == 1
    assert scores["015000"].Recency == 1  # 47 hours and 59 minutes
    assert scores["014527"].Frequency == 4  # the missing invoice number counts
    assert scores["014527"].Monetary == pytest.approx(4.25 + 1 + 3 + 3 + 2)


def test_features_of_the_edge_customer(clean):
    row = features.customer_features(clean).filter("CustomerID = '014527'").first()
    assert row.Count_Invoice == 3  # the missing invoice number does not count
    assert row.Count_Stock == 3
    assert row.Sum_Quantity == 7
    assert row.Mean_InvoiceCountPerStock == pytest.approx(4 / 3)  # lines, not invoices
    assert row.Mean_StockCountPerInvoice == pytest.approx(4 / 3)
    assert row.Mean_UnitPrice == pytest.approx((4.25 + 1 + 1.5 + 1.5 + 2) / 5)
    assert row.Mean_TotalPriceSumPerStock == pytest.approx((4.25 + 1 + 6) / 3)
    assert row.Mean_TotalPriceMeanPerInvoice == pytest.approx((4.25 + 3 + 2) / 3)


def test_months_without_lines_are_zero(clean):
    months = {str(r.month): r.revenue for r in sales.monthly_revenue(clean).collect()}
    assert len(months) == 13
    assert months["2011-01-31"] == months["2011-02-28"] == months["2011-11-30"] == 0
    assert months["2010-12-31"] == pytest.approx(6.25)
    days = {str(r.day) for r in sales.daily_revenue(clean).collect()}
    assert "2011-01-01" not in days and "2011-03-05" in days


def test_activity_covers_observed_days_and_hours(clean):
    activity = sales.day_hour_activity(clean)
    rows = {(r.DayOfWeek, r.HourOfDay): r.lines for r in activity.collect()}
    days, hours = {d for d, _ in rows}, {h for _, h in rows}
    assert days == {2, 3, 4, 5} and hours == {0, 9, 10, 12, 23}
    assert len(rows) == len(days) * len(hours) and sum(rows.values()) == clean.count()
    matrix = sales.day_hour_matrix(activity)
    assert set(matrix.columns) == {"DayOfWeek", *map(str, hours)}


def test_top_products_break_ties_by_name(spark):
    rows = [("B", 1), ("A", 1), ("C", 5), (None, 9)]
    df = spark.createDataFrame(rows, "Description string, Quantity long")
    got = [r.Description for r in sales.top_products(df, "Quantity", 2).collect()]
    assert got == ["C", "A"]


def test_profile_and_report(raw):
    summary = cleaning.dataset_summary(raw).first()
    assert (summary.rows, summary.columns, summary.missing_cells) == (13, 8, 4)
    profile = {r.column: r for r in cleaning.dataset_profile(raw).collect()}
    assert profile["CustomerID"].missing == 1 and profile["Quantity"].type == "bigint"
    report = cleaning.cleaning_report(raw).first()
    assert (report.rows_before, report.rows_after, report.customers) == (13, 8, 4)
    assert report.removed_pct == pytest.approx(500 / 13)


def test_persona_fallbacks(spark):
    df = spark.range(3).select(
        persona_of(F.col("id").cast("int"), ["x", "y"], "Cluster").alias("named"),
        persona_of(F.col("id").cast("int"), None, "Cluster").alias("plain"),
    )
    assert [tuple(r) for r in df.collect()] == [
        ("x", "Nhóm 0"),
        ("y", "Nhóm 1"),
        ("Cluster 2", "Nhóm 2"),
    ]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_clean_lines_round_trip(spark, clean, tmp_path, fmt):
    io.write_transactions(clean, str(tmp_path / "clean"), fmt)
    back = io.read_clean_transactions(spark, str(tmp_path / "clean"), fmt)
    assert back.schema.simpleString() == clean.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, clean.collect()))


def test_preview_is_ordered(clean):
    first = io.preview(clean, ["InvoiceDate", "StockCode"], 2).collect()
    assert [r.StockCode for r in first] == ["22960", "22961"]


HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"


def read_lines(spark, tmp_path, lines, **options):
    path = tmp_path / "lines.csv"
    path.write_text(HEADER + lines, encoding="ISO-8859-1")
    return io.read_transactions(spark, str(path), **options)


def test_missing_texts_in_numbers_and_dates(spark, tmp_path):
    lines = "1,A,x,NA,2010-12-01 08:26:00,nan,17850,UK\n2,B,y,3,N/A,1.5,17850,UK\n"
    first, second = sorted(read_lines(spark, tmp_path, lines).collect())
    assert first.Quantity is None and first.UnitPrice is None
    assert second.InvoiceDate is None and second.Quantity == 3 and second.UnitPrice == 1.5


@pytest.mark.parametrize(
    "line",
    ["1,A,x,3,2010-12-01 08:26:00,cheap,17850,UK\n", "1,A,x,3,some day,1.5,17850,UK\n"],
)
def test_unreadable_values_stop_the_read(spark, tmp_path, line):
    with pytest.raises(Exception, match="cannot be read"):
        read_lines(spark, tmp_path, line).collect()


def test_line_breaks_inside_quotes(spark, tmp_path):
    line = '1,A,"two\nlines",3,2010-12-01 08:26:00,1.5,17850,UK\n'
    (row,) = read_lines(spark, tmp_path, line, multi_line=True).collect()
    assert row.Description == "two\nlines" and row.Country == "UK"
