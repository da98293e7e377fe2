import decimal
import math

import numpy as np
import pytest

from tillroll import session
from tillroll.operators import distributions, quantiles, transforms


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 3000
    return {
        "normal": rng.normal(10, 2, n),
        "skewed": np.exp(rng.normal(0, 1, n)),
        "square": rng.normal(20, 2, n) ** 2,
        "whole": rng.integers(0, 40, n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 5.0, rng.normal(5, 1, n)),
        "constant": np.full(n, 3.0),
    }


@pytest.fixture(scope="module")
def wide(spark, data):
    rows = list(zip(map(str, range(3000)), *[map(float, v) for v in data.values()]))
    schema = "CustomerID string, " + ", ".join(f"{c} double" for c in data)
    return spark.createDataFrame(rows, schema).repartition(5).persist()


@pytest.fixture(scope="module")
def long(wide, data):
    return quantiles.to_long(wide, list(data))


def by_feature(df):
    out = {}
    for row in df.collect():
        out.setdefault(row.feature, []).append(row)
    return out


def test_quantiles_equal_numpy(long, data):
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = by_feature(quantiles.exact_quantiles(long, probabilities))
    for name, x in data.items():
        got = {r.probability: r.quantile for r in found[name]}
        for p in probabilities:
            assert got[p] == pytest.approx(np.quantile(x, p), rel=1e-14), (name, p)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_quantiles_of_few_rows(spark, n):
    values = [1.0, 2.0, 3.0, 10.0, 11.0][:n]
    df = spark.createDataFrame([("x", v) for v in values], "feature string, value double")
    found = {r.probability: r.quantile for r in quantiles.exact_quantiles(df, [0.25, 0.99]).collect()}
    assert found[0.25] == pytest.approx(np.quantile(values, 0.25))
    assert found[0.99] == pytest.approx(np.quantile(values, 0.99))


def test_quantiles_with_narrow_brackets(spark, monkeypatch):
    """Brackets far smaller than the data, so that most rows are only counted."""
    rng = np.random.default_rng(3)
    x = np.round(rng.lognormal(3, 2, 200_000), 2)
    df = spark.createDataFrame(
        [("x", float(v)) for v in x], "feature string, value double"
    ).repartition(8)
    for p in (0.25, 0.5, 0.99):
        got = quantiles.exact_quantiles(df, [p]).first().quantile
        assert got == pytest.approx(np.quantile(x, p), rel=1e-13)


@pytest.mark.parametrize("inside", [1, 40])
def test_quantiles_narrowed_in_rounds(spark, long, data, monkeypatch, inside):
    """Brackets are narrowed until almost nothing is left to sort, copies of one value included."""
    monkeypatch.setattr(quantiles, "MAX_INSIDE", inside)
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = by_feature(quantiles.exact_quantiles(long, probabilities))
    for name, x in data.items():
        got = {r.probability: r.quantile for r in found[name]}
        for p in probabilities:
            assert got[p] == pytest.approx(np.quantile(x, p), rel=1e-14), (name, p)


def test_quantiles_leave_out_missing_values(spark):
    rows = [("x", 1.0), ("x", None), ("x", float("nan")), ("x", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "feature string, value double")
    assert [(r.feature, r.quantile) for r in quantiles.exact_quantiles(df, [0.5]).collect()] == [("x", 2.5)]
    assert quantiles.exact_quantiles(df.limit(0), [0.5]).count() == 0
    assert quantiles.describe(df.limit(0)).count() == 0


def test_below_quantile_is_strict(wide, data):
    kept = quantiles.below_quantile(wide, "whole", 0.99).count()
    assert kept == int((data["whole"] < np.quantile(data["whole"], 0.99)).sum())


def test_describe(long, data):
    found = {r.feature: r for r in quantiles.describe(long).collect()}
    for name, x in data.items():
        r = found[name]
        assert r["count"] == len(x) and r.min == x.min() and r.max == x.max()
        assert r["mean"] == pytest.approx(x.mean()) and r["std"] == pytest.approx(x.std(ddof=1))
        assert [r.p25, r.p50, r.p75] == pytest.approx(list(np.percentile(x, [25, 50, 75])))


def test_histograms_equal_numpy(long, data):
    found = by_feature(distributions.histogram(long))
    for name, x in data.items():
        rows = sorted(found[name], key=lambda r: r.bin)
        counts, edges = np.histogram(x, 30)
        assert [r["count"] for r in rows] == counts.tolist(), name
        assert [r.lo for r in rows] == pytest.approx(edges[:-1].tolist())
        assert [r.hi for r in rows] == pytest.approx(edges[1:].tolist())


def test_density_equals_numpy(long, data):
    found = by_feature(distributions.density_curve(long))
    assert "constant" not in found
    for name in ("normal", "skewed", "hot"):
        x = data[name]
        h = x.std(ddof=1) * len(x) ** -0.2
        grid = np.linspace(x.min(), x.max(), 200)
        kernels = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2)
        expected = kernels.sum(1) / (h * math.sqrt(2 * math.pi)) * (x.max() - x.min()) / 30
        rows = sorted(found[name], key=lambda r: r.point)
        assert [r.x for r in rows] == pytest.approx(grid.tolist())
        assert [r.density for r in rows] == pytest.approx(expected.tolist(), rel=1e-9, abs=1e-12)


def test_box_stats(long, data):
    found = {r.feature: r for r in distributions.box_stats(long).collect()}
    for name, x in data.items():
        q1, median, q3 = np.percentile(x, [25, 50, 75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        r = found[name]
        assert [r.q1, r.median, r.q3] == pytest.approx([q1, median, q3])
        assert r.whisker_low == pytest.approx(min(x[x >= low].min(), q1))
        assert r.whisker_high == pytest.approx(max(x[x <= high].max(), q3))
        assert r.outliers == int(((x < low) | (x > high)).sum())


def slope(x, lam):
    """Derivative of the profile log-likelihood, from the definition."""
    y = (x**lam - 1) / lam
    dy = (x**lam * np.log(x) - y) / lam
    return np.log(x).sum() - len(x) * np.mean((y - y.mean()) * (dy - dy.mean())) / y.var()


def test_box_cox_parameter_is_the_maximum(wide, data):
    names = ["normal", "skewed", "square", "whole", "hot"]
    found = transforms.fit_box_cox(wide, [*names, "constant"])
    assert found["constant"] is None
    for name in names:
        lam, x = found[name], data[name] + 1
        assert slope(x, lam - 1e-5) > 0 > slope(x, lam + 1e-5), name


def test_box_cox_recovers_known_shapes(spark):
    rng = np.random.default_rng(1)
    rows = [
        (float(a - 1), float(b - 1))
        for a, b in zip(np.exp(rng.normal(2, 0.7, 4000)), rng.normal(30, 4, 4000) ** 2)
    ]
    found = transforms.fit_box_cox(spark.createDataFrame(rows, "log double, root double"), ["log", "root"])
    assert abs(found["log"]) < 0.05 and abs(found["root"] - 0.5) < 0.1


def test_box_cox_of_a_nearly_constant_column(spark):
    rows = [(1.0,)] * 500 + [(1.02,), (1.1,), (1.05,)]
    lam = transforms.fit_box_cox(spark.createDataFrame(rows, "x double"), ["x"])["x"]
    assert math.isfinite(lam) and lam < -5


def test_fitted_transform_keeps_a_narrow_column(spark):
    """z-scores in double against 400 digits, where x**lambda is the same double in every row."""
    values = [2.0 + 0.003 * (i % 61) for i in range(400)] + [1.0] * 2
    table = spark.createDataFrame([(x,) for x in values], "x double")
    fit = transforms.fit_box_cox(table, ["x"])
    got = transforms.standardize(transforms.apply_box_cox(table, fit), ["x"])
    got = [r.x for r in got.collect()]
    far = transforms.BoxCoxFit({"x": -340.0}, fit.mean_log)
    narrow = transforms.standardize(transforms.apply_box_cox(table, far), ["x"])

    def exact(lam):
        with decimal.localcontext(prec=400):
            lam = decimal.Decimal(lam)
            y = [(decimal.Decimal(x + 1) ** lam - 1) / lam for x in values]
            mean = sum(y) / len(y)
            return [float((v - mean) / (sum((w - mean) ** 2 for w in y) / len(y)).sqrt()) for v in y]

    assert got == pytest.approx(exact(fit["x"]), abs=1e-9)
    assert [r.x for r in narrow.collect()] == pytest.approx(exact(-340.0), abs=1e-9)
    assert np.std(exact(-340.0)) == pytest.approx(1)


def test_box_cox_rejects_non_positive_data(spark):
    with pytest.raises(ValueError, match="positive"):
        transforms.fit_box_cox(spark.createDataFrame([(-1.0,), (2.0,)], "x double"), ["x"])


def test_log_likelihood(wide, data):
    rows = transforms.box_cox_log_likelihood(wide, [-0.5, 0.0, 1.0], ["skewed", "square"]).collect()
    for r in rows:
        x, lam = data[r.feature] + 1, r["lambda"]
        y = np.log(x) if lam == 0 else (x**lam - 1) / lam
        expected = (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())
        assert r.loglik == pytest.approx(expected, rel=1e-9)


def test_standardize(wide, data):
    out = transforms.standardize(wide, list(data)).toPandas()
    for name in data:
        z = out[name].to_numpy()
        assert abs(z.mean()) < 1e-10
        assert z.std() == pytest.approx(0.0 if name == "constant" else 1.0)


def test_staged_tables_can_be_discarded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    session.stage(spark.range(3), "kept")
    own = tmp_path / "tillroll" / spark.sparkContext.applicationId
    assert any(own.iterdir())
    session.discard_staged(spark)
    assert not own.exists()
