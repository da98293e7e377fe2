"""The queries again, as DuckDB SQL over the same tables.

Money is summed in whole pence, so the sums are exact; averages divide exact sums.
"""

from __future__ import annotations

from checks.queries import FIXED_LAMBDAS, HOME, LOGLIK_GRID, PERSONAS, ROUND_SHIFT, SEGMENTS
from tillroll.schema import FEATURE_LABELS, FEATURES, RADAR_AXES_6, RADAR_AXES_8

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}

RAW = """
raw AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS InvoiceNo,
         CAST(l_partkey AS VARCHAR) AS StockCode,
         p_name AS Description,
         CAST(l_quantity AS BIGINT) AS Quantity,
         o_orderdate AS InvoiceDate,
         CAST(floor(round(l_extendedprice * 100) / l_quantity) AS BIGINT) AS pence,
         CAST(o_custkey AS VARCHAR) AS CustomerID,
         n_name AS Country
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
)"""

LINES = """
lines AS (
  SELECT *, Quantity * pence AS total FROM raw
  WHERE InvoiceNo NOT LIKE 'C%' AND CustomerID IS NOT NULL AND Quantity > 0 AND pence > 0
)"""

SPEND = """
spend AS (
  SELECT CustomerID, CAST(sum(total) AS BIGINT) / 100.0 AS spend FROM lines GROUP BY CustomerID
)"""

INVOICES = """
invoices AS (
  SELECT CustomerID, count(DISTINCT InvoiceNo) AS invoices FROM lines GROUP BY CustomerID
)"""

RFM = """
rfm AS (
  SELECT CustomerID,
         datediff('hour', max(InvoiceDate), (SELECT max(InvoiceDate) + INTERVAL 1 DAY FROM lines)) // 24 AS Recency,
         count(DISTINCT InvoiceNo) AS Frequency,
         CAST(sum(total) AS BIGINT) / 100.0 AS Monetary
  FROM lines GROUP BY CustomerID
)"""

FEATURE_TABLE = """
per_invoice AS (
  SELECT CustomerID, InvoiceNo, count(*) AS n, sum(Quantity) AS q,
         CAST(sum(pence) AS BIGINT) AS p, CAST(sum(total) AS BIGINT) AS t
  FROM lines GROUP BY CustomerID, InvoiceNo
), per_stock AS (
  SELECT CustomerID, StockCode, count(*) AS n, sum(Quantity) AS q,
         CAST(sum(pence) AS BIGINT) AS p, CAST(sum(total) AS BIGINT) AS t
  FROM lines GROUP BY CustomerID, StockCode
), by_line AS (
  SELECT CustomerID, count(*) AS n, CAST(sum(Quantity) AS DOUBLE) AS q,
         CAST(sum(pence) AS BIGINT) / 100.0 AS p, CAST(sum(total) AS BIGINT) / 100.0 AS t
  FROM lines GROUP BY CustomerID
), by_invoice AS (
  SELECT CustomerID, count(*) AS groups, avg(p / 100.0 / n) AS mean_p, avg(t / 100.0 / n) AS mean_t
  FROM per_invoice GROUP BY CustomerID
), by_stock AS (
  SELECT CustomerID, count(*) AS groups, avg(p / 100.0 / n) AS mean_p, avg(t / 100.0 / n) AS mean_t
  FROM per_stock GROUP BY CustomerID
), features AS (
  SELECT CustomerID,
         l.q AS Sum_Quantity,
         l.p / l.n AS Mean_UnitPrice,
         l.t / l.n AS Mean_TotalPrice,
         l.t AS Sum_TotalPrice,
         CAST(i.groups AS DOUBLE) AS Count_Invoice,
         CAST(s.groups AS DOUBLE) AS Count_Stock,
         l.n / s.groups AS Mean_InvoiceCountPerStock,
         l.n / i.groups AS Mean_StockCountPerInvoice,
         i.mean_p AS Mean_UnitPriceMeanPerInvoice,
         l.q / i.groups AS Mean_QuantitySumPerInvoice,
         i.mean_t AS Mean_TotalPriceMeanPerInvoice,
         l.t / i.groups AS Mean_TotalPriceSumPerInvoice,
         s.mean_p AS Mean_UnitPriceMeanPerStock,
         l.q / s.groups AS Mean_QuantitySumPerStock,
         s.mean_t AS Mean_TotalPriceMeanPerStock,
         l.t / s.groups AS Mean_TotalPriceSumPerStock
  FROM by_line l JOIN by_invoice i USING (CustomerID) JOIN by_stock s USING (CustomerID)
)"""

LONG_FEATURES = f"""
long AS (
  UNPIVOT features ON {', '.join(FEATURES)} INTO NAME feature VALUE value
)"""


def r(expression: str, digits: int = 4) -> str:
    return f"round(CAST({expression} AS DOUBLE) + {ROUND_SHIFT!r}, {digits})"


def query(*parts: str) -> str:
    """The last part is the select; the others are common table expressions."""
    return "WITH " + ",".join(parts[:-1]) + "\n" + parts[-1]


def describe(digits: int = 4) -> str:
    quartiles = ", ".join(
        f"{r(f'quantile_cont(value, {q})', digits)} AS {name}" for name, q in QUARTILES.items()
    )
    return f"""
SELECT feature, count(value) AS "count", {r('avg(value)', digits)} AS mean,
       {r('stddev_samp(value)', digits)} AS std, {r('min(value)', digits)} AS min,
       {r('max(value)', digits)} AS max, {quartiles}
FROM long GROUP BY feature"""


HISTOGRAM = f"""
ranges AS (
  SELECT feature,
         min(value) - CASE WHEN min(value) = max(value) THEN 0.5 ELSE 0 END AS low,
         max(value) + CASE WHEN min(value) = max(value) THEN 0.5 ELSE 0 END AS high
  FROM long GROUP BY feature
), edges AS (
  SELECT feature, bin, low + bin * ((high - low) / 30) AS lo,
         CASE WHEN bin = 29 THEN high ELSE low + (bin + 1) * ((high - low) / 30) END AS hi
  FROM ranges, (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
)
SELECT e.feature, e.bin, {r('e.lo')} AS lo, {r('e.hi')} AS hi, count(value) AS "count"
FROM edges e LEFT JOIN long ON long.feature = e.feature AND value >= e.lo
     AND (value < e.hi OR (e.bin = 29 AND value <= e.hi))
GROUP BY e.feature, e.bin, e.lo, e.hi"""

DENSITY = f"""
shape AS (
  SELECT feature, count(value) AS n, min(value) AS low, max(value) AS high,
         stddev_samp(value) * pow(count(value), -0.2) AS h
  FROM long GROUP BY feature
), points AS (
  SELECT shape.*, point, low + point * ((high - low) / 199) AS x
  FROM shape, (SELECT CAST(range AS INTEGER) AS point FROM range(200))
)
SELECT p.feature, p.point, {r('p.x')} AS x,
       {r('sum(exp(-0.5 * ((p.x - value) / p.h) * ((p.x - value) / p.h))) * any_value((p.high - p.low) / 30 / (p.h * sqrt(2 * pi())))')} AS density
FROM points p JOIN long ON long.feature = p.feature
GROUP BY p.feature, p.point, p.x"""

LONG_SPEND = """
long AS (SELECT 'spend' AS feature, spend AS value FROM spend)"""

LONG_TRIMMED_SPEND = """
long AS (
  SELECT 'spend' AS feature, spend AS value FROM spend
  WHERE spend < (SELECT quantile_cont(spend, 0.99) FROM spend)
)"""

LONG_INVOICES = """
long AS (SELECT 'invoices' AS feature, CAST(invoices AS DOUBLE) AS value FROM invoices)"""

LONG_RFM = """
long AS (
  SELECT 'Recency' AS feature, CAST(Recency AS DOUBLE) AS value FROM rfm
  UNION ALL SELECT 'Frequency', CAST(Frequency AS DOUBLE) FROM rfm
  UNION ALL SELECT 'Monetary', Monetary FROM rfm
  WHERE Monetary < (SELECT quantile_cont(Monetary, 0.99) FROM rfm)
)"""


def box_cox(name: str, lam: float) -> str:
    return f"ln({name} + 1)" if lam == 0 else f"(pow({name} + 1, {lam!r}) - 1) / {lam!r}"


MOVED = "\nmoved AS (SELECT CustomerID, " + ", ".join(
    f"{box_cox(f, lam)} AS {f}" for f, lam in FIXED_LAMBDAS.items()
) + " FROM features)"

LONG_MOVED = LONG_FEATURES.replace("UNPIVOT features", "UNPIVOT moved")

FENCES = """
quartiles AS (
  SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3
  FROM long GROUP BY feature
), fences AS (
  SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM quartiles
)"""

BOX_STATS = f"""SELECT f.feature, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
        {r('least(min(value) FILTER (value >= low), q1)')} AS whisker_low,
        {r('greatest(max(value) FILTER (value <= high), q3)')} AS whisker_high,
        count(*) FILTER (value < low OR value > high) AS outliers
        FROM fences f JOIN long ON long.feature = f.feature GROUP BY f.feature, q1, median, q3"""

# The maximum-likelihood parameter by zooming into a grid of 41 points. The first grid spans
# every parameter for which the powers stay finite.
LOGS = """
centred AS (
  SELECT feature, value, ln(value + 1) - avg(ln(value + 1)) OVER (PARTITION BY feature) AS u
  FROM long
), zoom0 AS (
  SELECT feature, 0.0 AS lam, 300 / max(abs(u)) AS span FROM centred GROUP BY feature
)"""


def _zoom(step: int) -> str:
    z = "CASE WHEN abs(g.lam) < 1e-12 THEN u ELSE exp(g.lam * u) / g.lam END"
    return f"""
grid{step} AS (
  SELECT feature, lam + span * (i - 20) / 20.0 AS lam, span / 20.0 AS span
  FROM zoom{step - 1}, (SELECT range AS i FROM range(41))
), scores{step} AS (
  SELECT g.feature, g.lam, any_value(g.span) AS span, ln(var_pop({z})) AS score
  FROM grid{step} g JOIN centred c ON g.feature = c.feature
  GROUP BY g.feature, g.lam
), zoom{step} AS (
  SELECT feature, arg_min(lam, score) AS lam, any_value(span) AS span
  FROM scores{step} GROUP BY feature
)"""


ZOOMS = [_zoom(step) for step in range(1, 9)]

# x over its geometric mean: the plain powers of a narrow column with a large parameter have no
# digits left, and its z-scores would all be 0.
SCALED = """
transformed AS (
  SELECT c.feature, (exp(lam * u) - 1) / lam AS y
  FROM centred c JOIN zoom8 z ON c.feature = z.feature
), moments AS (
  SELECT feature, avg(y) AS mean, var_pop(y) AS var, CAST(count(*) AS DOUBLE) AS n
  FROM transformed GROUP BY feature
), long_scaled AS (
  SELECT t.feature,
         (y - mean) / CASE WHEN var <= n * pow(2, -52) * var + pow(n * pow(2, -52) * mean, 2)
                           THEN 1 ELSE sqrt(var) END AS value
  FROM transformed t JOIN moments m ON t.feature = m.feature
)"""

SEGMENT_LABELS = "\nlabels AS (SELECT 5 AS k, CAST(c_custkey AS VARCHAR) AS CustomerID, CASE c_mktsegment " + (
    " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEGMENTS))
) + " END AS Cluster FROM customer)"

MEANS = """
means AS (
  SELECT k, Cluster, feature, avg(value) AS mean
  FROM long JOIN labels USING (CustomerID) GROUP BY k, Cluster, feature
)"""

NEAREST = """
cells AS (
  SELECT vec_id, CAST(label AS INTEGER) AS label,
         unnest(range(len(embedding))) AS position, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings
), centers AS (
  SELECT label AS cluster, position, avg(x) AS center FROM cells GROUP BY label, position
), distances AS (
  SELECT vec_id, any_value(label) AS label, cluster, sum((x - center) * (x - center)) AS distance_sq
  FROM cells JOIN centers USING (position) GROUP BY vec_id, cluster
), nearest AS (
  SELECT vec_id, any_value(label) AS label, arg_min(cluster, (distance_sq, cluster)) AS cluster,
         min(distance_sq) AS distance_sq
  FROM distances GROUP BY vec_id
)"""


def case_map(key: str, labels: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


ID_FORM = """
forms AS (
  SELECT c_custkey, CASE c_custkey % 4
           WHEN 0 THEN CAST(c_custkey AS VARCHAR)
           WHEN 1 THEN CAST(c_custkey AS VARCHAR) || '.0'
           WHEN 2 THEN CAST(c_custkey + 1000000 AS VARCHAR) END AS form
  FROM customer
), filled AS (
  SELECT c_custkey, CASE WHEN length(replace(form, '.0', '')) < 6
                         THEN lpad(replace(form, '.0', ''), 6, '0')
                         ELSE replace(form, '.0', '') END AS id
  FROM forms
)"""

PROFILE_COLUMNS = [
    "InvoiceNo",
    "StockCode",
    "Description",
    "Quantity",
    "InvoiceDate",
    "pence",
    "CustomerID",
    "Country",
]

SCANNED = """
SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, pence / 100.0 AS UnitPrice,
       CASE WHEN length(CustomerID) < 6 THEN lpad(CustomerID, 6, '0') ELSE CustomerID END AS CustomerID,
       Country
FROM raw"""

ORACLES = {
    "scan_transactions": query(RAW, SCANNED),
    "normalize_customer_id": query(
        ID_FORM,
        "SELECT c_custkey, id AS dropped_form, coalesce(id, '000nan') AS placeholder_form FROM filled",
    ),
    "clean_transactions": query(
        RAW,
        LINES,
        f"""SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate,
        pence / 100.0 AS UnitPrice, CustomerID, Country, Quantity * (pence / 100.0) AS TotalPrice
        FROM lines WHERE Country = '{HOME}'""",
    ),
    "stored_clean_lines": query(
        RAW,
        LINES,
        f"""SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate,
        pence / 100.0 AS UnitPrice, CustomerID, Country, Quantity * (pence / 100.0) AS TotalPrice,
        CAST(isodow(InvoiceDate) - 1 AS INTEGER) AS DayOfWeek, CAST(hour(InvoiceDate) AS INTEGER) AS HourOfDay
        FROM lines""",
    ),
    "stored_features": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        MOVED,
        "SELECT CustomerID, "
        + ", ".join(f"{r('f.' + f)} AS {f}" for f in FEATURES)
        + ", "
        + ", ".join(
            r(f"(m.{f} - avg(m.{f}) OVER ()) / stddev_pop(m.{f}) OVER ()") + f" AS {f}_z"
            for f in FEATURES
        )
        + " FROM features f JOIN moved m USING (CustomerID)",
    ),
    "inertia_given": query(
        NEAREST, f"SELECT 10 AS k, {r('sum(distance_sq)')} AS inertia FROM nearest"
    ),
    "fidelity_given": query(
        NEAREST,
        f"""SELECT 10 AS k, {r('avg(CAST(label = cluster AS INTEGER))')} AS fidelity,
        CASE WHEN avg(CAST(label = cluster AS INTEGER)) >= 0.95 THEN 'CHÍNH XÁC' ELSE 'HỢP LÝ' END AS verdict
        FROM nearest""",
    ),
    "top_features_given": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        LONG_FEATURES,
        SEGMENT_LABELS,
        """
z AS (
  SELECT CustomerID, feature, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value
  FROM long WINDOW w AS (PARTITION BY feature)
), sizes AS (
  SELECT k, Cluster AS cluster, feature, avg(abs(value)) AS mean_abs
  FROM z JOIN labels USING (CustomerID) GROUP BY k, Cluster, feature
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean_abs DESC, feature) AS rank FROM sizes
)""",
        f"SELECT k, cluster, feature, {r('mean_abs')} AS mean_abs_shap, rank FROM ranked WHERE rank <= 3",
    ),
    "cluster_export_given": query(SEGMENT_LABELS, "SELECT * FROM labels"),
    "time_features": "SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS DayOfWeek, CAST(hour(ts) AS INTEGER) AS HourOfDay FROM events",
    "dataset_profile": query(
        RAW,
        " UNION ALL ".join(
            f"""SELECT {i} AS position, '{'UnitPrice' if c == 'pence' else c}' AS "column", count(*) AS "rows", count({c}) AS non_null, count(*) - count({c}) AS missing FROM raw"""
            for i, c in enumerate(PROFILE_COLUMNS)
        ),
    ),
    "dataset_summary": query(
        RAW,
        'SELECT count(*) AS "rows", CAST(8 AS BIGINT) AS columns, 8 * count(*) - '
        + " - ".join(f"count({c})" for c in PROFILE_COLUMNS)
        + " AS missing_cells, count(DISTINCT CustomerID) AS customers FROM raw",
    ),
    "cleaning_report": query(
        RAW,
        LINES,
        f"""SELECT b AS rows_before, a AS rows_after, b - a AS rows_removed,
        {r('(b - a) * 100.0 / b')} AS removed_pct, c AS customers
        FROM (SELECT count(*) AS b FROM raw),
             (SELECT count(*) AS a, count(DISTINCT CustomerID) AS c FROM lines WHERE Country = '{HOME}')""",
    ),
    "daily_revenue": query(
        RAW,
        LINES,
        f"SELECT CAST(InvoiceDate AS DATE) AS day, {r('sum(total) / 100.0', 2)} AS revenue FROM lines GROUP BY 1",
    ),
    "monthly_revenue": query(
        RAW,
        LINES,
        f"""SELECT last_day(start) AS month, {r('coalesce(sum(total), 0) / 100.0', 2)} AS revenue
        FROM (SELECT CAST(unnest(generate_series(date_trunc('month', min(InvoiceDate)), date_trunc('month', max(InvoiceDate)), INTERVAL 1 MONTH)) AS DATE) AS start FROM lines)
        LEFT JOIN lines ON date_trunc('month', InvoiceDate) = start GROUP BY start""",
    ),
    "day_hour_activity": """
SELECT CAST(d.day AS INTEGER) AS DayOfWeek, CAST(h.hour AS INTEGER) AS HourOfDay, count(event_id) AS lines
FROM (SELECT DISTINCT isodow(ts) - 1 AS day FROM events) d
CROSS JOIN (SELECT DISTINCT hour(ts) AS hour FROM events) h
LEFT JOIN events ON isodow(ts) - 1 = d.day AND hour(ts) = h.hour
GROUP BY d.day, h.hour""",
    "day_hour_matrix": "SELECT CAST(isodow(ts) - 1 AS INTEGER) AS DayOfWeek, "
    + ", ".join(f'count(*) FILTER (hour(ts) = {h}) AS "{h}"' for h in range(24))
    + " FROM events GROUP BY 1",
    "top_products_quantity": query(
        RAW,
        LINES,
        "SELECT Description, CAST(sum(Quantity) AS BIGINT) AS total FROM lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "top_products_revenue": query(
        RAW,
        LINES,
        f"SELECT Description, {r('sum(total) / 100.0', 2)} AS total FROM lines GROUP BY 1 ORDER BY sum(total) DESC, 1 LIMIT 10",
    ),
    "invoices_per_customer": query(RAW, LINES, INVOICES, "SELECT * FROM invoices"),
    "spend_per_customer": query(
        RAW, LINES, SPEND, f"SELECT CustomerID, {r('spend', 2)} AS spend FROM spend"
    ),
    "spend_summary": query(
        RAW,
        LINES,
        SPEND,
        INVOICES,
        f"""SELECT {r('avg(spend)')} AS mean_spend, {r('median(spend)')} AS median_spend,
        {r('(SELECT avg(invoices) FROM invoices)')} AS mean_invoices FROM spend""",
    ),
    "spend_describe": query(RAW, LINES, SPEND, LONG_SPEND, describe()),
    "spend_below_p99": query(
        RAW,
        LINES,
        SPEND,
        f"""SELECT CustomerID, {r('spend', 2)} AS spend FROM spend
        WHERE spend < (SELECT quantile_cont(spend, 0.99) FROM spend)""",
    ),
    "rfm": query(
        RAW,
        LINES,
        RFM,
        f"SELECT CustomerID, Recency, Frequency, {r('Monetary', 2)} AS Monetary FROM rfm",
    ),
    "rfm_summary": query(
        RAW,
        LINES,
        RFM,
        f"""SELECT {r('avg(Recency)')} AS mean_recency, {r('avg(Frequency)')} AS mean_frequency,
        {r('avg(Monetary)')} AS mean_monetary FROM rfm""",
    ),
    "monetary_below_p99": query(
        RAW,
        LINES,
        RFM,
        f"""SELECT CustomerID, {r('Monetary', 2)} AS Monetary FROM rfm
        WHERE Monetary < (SELECT quantile_cont(Monetary, 0.99) FROM rfm)""",
    ),
    "customer_features": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        "SELECT CustomerID, " + ", ".join(f"{r(f)} AS {f}" for f in FEATURES) + " FROM features",
    ),
    "feature_labels": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        LONG_FEATURES,
        f"SELECT feature, {r('avg(value)')} AS mean, {case_map('feature', FEATURE_LABELS)} AS label FROM long GROUP BY feature",
    ),
    "feature_describe": query(RAW, LINES, FEATURE_TABLE, LONG_FEATURES, describe()),
    "feature_boxstats": query(RAW, LINES, FEATURE_TABLE, LONG_FEATURES, FENCES, BOX_STATS),
    "transformed_boxstats": query(
        RAW, LINES, FEATURE_TABLE, MOVED, LONG_MOVED, FENCES, BOX_STATS
    ),
    "boxcox_apply_fixed": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        MOVED,
        "SELECT CustomerID, " + ", ".join(f"{r(f)} AS {f}" for f in FEATURES) + " FROM moved",
    ),
    "boxcox_loglik_grid": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        LONG_FEATURES,
        f"""
centred AS (
  SELECT feature, ln(value + 1) AS log_x, ln(value + 1) - avg(ln(value + 1)) OVER (PARTITION BY feature) AS u
  FROM long
), grid AS (SELECT CAST(unnest({LOGLIK_GRID}) AS DOUBLE) AS lam)""",
        f"""SELECT feature, lam AS "lambda",
        {r('-sum(log_x) - count(*) / 2 * ln(var_pop(CASE WHEN lam = 0 THEN u ELSE exp(lam * u) / nullif(lam, 0) END))')} AS loglik
        FROM centred, grid GROUP BY feature, lam""",
    ),
    "boxcox_lambda": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        LONG_FEATURES,
        LOGS,
        *ZOOMS,
        f"SELECT feature, {r('lam', 2)} AS \"lambda\" FROM zoom8",
    ),
    "zscore_features": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        "SELECT CustomerID, "
        + ", ".join(
            r(f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER ()") + f" AS {f}" for f in FEATURES
        )
        + " FROM features",
    ),
    "scaled_describe": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        LONG_FEATURES,
        LOGS,
        *ZOOMS,
        SCALED,
        describe(3).replace("FROM long", "FROM long_scaled"),
    ),
    "cluster_sizes_given": query(
        SEGMENT_LABELS,
        f"""SELECT k, Cluster, count(*) AS customers,
        {r('count(*) * 100.0 / sum(count(*)) OVER ()')} AS share_pct FROM labels GROUP BY k, Cluster""",
    ),
    "cluster_means_given": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        LONG_FEATURES,
        SEGMENT_LABELS,
        MEANS,
        f"SELECT k, Cluster, feature, {r('mean')} AS mean FROM means",
    ),
    "radar_minmax": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        LONG_FEATURES,
        SEGMENT_LABELS,
        MEANS,
        f"""SELECT k, Cluster, 'Nhóm ' || CAST(Cluster AS VARCHAR) AS persona, feature,
        {case_map('feature', RADAR_AXES_8)} AS axis, {r('mean')} AS mean,
        {r('coalesce((mean - min(mean) OVER w) / nullif(max(mean) OVER w - min(mean) OVER w, 0), 0)')} AS value
        FROM means WHERE feature IN ({', '.join(f"'{f}'" for f in RADAR_AXES_8)})
        WINDOW w AS (PARTITION BY k, feature)""",
    ),
    "assign_nearest_centroid": query(
        NEAREST, f"SELECT vec_id, cluster, {r('distance_sq')} AS distance_sq FROM nearest"
    ),
    "cluster_sizes_total": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        """SELECT CAST(k AS INTEGER) AS k, (SELECT count(*) FROM features) AS customers
        FROM range(2, 11) t(k)""",
    ),
    "kmeans_check": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        """SELECT CAST(k AS INTEGER) AS k, (SELECT count(*) FROM features) AS customers,
        CAST(0 AS BIGINT) AS mismatches, CAST(0 AS DOUBLE) AS inertia_gap FROM range(2, 11) t(k)""",
    ),
    "pca_check": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        "SELECT count(*) AS customers, CAST(0 AS DOUBLE) AS mixed, CAST("
        + " + ".join(f"CASE WHEN var_pop({f}) > 0 THEN 1 ELSE 0 END" for f in FEATURES)
        + " AS DOUBLE) AS variance FROM features",
    ),
    "confusion_total": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        """SELECT CAST(k AS INTEGER) AS k, k * k AS cells, (SELECT count(*) FROM features) AS customers
        FROM range(3, 5) t(k)""",
    ),
    "shap_total": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        f"""SELECT CAST(k AS INTEGER) AS k, CAST(c AS INTEGER) AS cluster,
        {len(FEATURES)} * (SELECT count(*) FROM features) AS n, CAST({len(FEATURES)} AS BIGINT) AS features
        FROM range(3, 5) t(k) JOIN range(4) u(c) ON c < k""",
    ),
    "confusion_given": query(
        NEAREST,
        """SELECT CAST(10 AS INTEGER) AS k, CAST(a AS INTEGER) AS label, CAST(b AS INTEGER) AS prediction, count(vec_id) AS n
        FROM range(10) t(a) CROSS JOIN range(10) u(b)
        LEFT JOIN nearest ON label = a AND cluster = b GROUP BY a, b""",
    ),
    "silhouette_squared_given": query(
        """
cells AS (
  SELECT vec_id, CAST(label AS INTEGER) AS label, unnest(CAST(embedding AS DOUBLE[])) AS x,
         generate_subscripts(embedding, 1) AS i
  FROM embeddings
), norms AS (SELECT vec_id, label, sum(x * x) AS q FROM cells GROUP BY ALL
), sizes AS (SELECT label AS c, count(*) AS n, sum(q) AS psi FROM norms GROUP BY ALL
), sums AS (SELECT label AS c, i, sum(x) AS y FROM cells GROUP BY ALL
), dots AS (SELECT vec_id, c, sum(x * y) AS d FROM cells JOIN sums USING (i) GROUP BY ALL
), means AS (
  SELECT vec_id, label, c, n, q + psi / n - 2 * d / n AS m
  FROM norms JOIN dots USING (vec_id) JOIN sizes USING (c)
), own AS (SELECT vec_id, n, m * n / nullif(n - 1, 0) AS a FROM means WHERE label = c
), other AS (SELECT vec_id, min(m) AS b FROM means WHERE label <> c GROUP BY ALL)""",
        f"""SELECT CAST(10 AS INTEGER) AS k,
        {r('avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END)', 5)}
        AS silhouette FROM own JOIN other USING (vec_id)""",
    ),
    "silhouette_euclidean": query(
        """
points AS (
  SELECT vec_id, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), sizes AS (SELECT label, count(*) AS n FROM points GROUP BY label
), sums AS (
  SELECT x.vec_id, x.label, y.label AS other, sum(list_distance(x.v, y.v)) AS d
  FROM points x CROSS JOIN points y GROUP BY x.vec_id, x.label, y.label
), ab AS (
  SELECT vec_id, s.label,
         max(d / nullif(n - 1, 0)) FILTER (other = s.label) AS a,
         min(d / n) FILTER (other <> s.label) AS b,
         max(n) FILTER (other = s.label) AS own
  FROM sums s JOIN sizes ON sizes.label = other GROUP BY vec_id, s.label
)""",
        f"""SELECT 10 AS k, vec_id, label AS cluster, {r('a', 5)} AS a, {r('b', 5)} AS b,
        {r('CASE WHEN own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END', 5)} AS silhouette FROM ab""",
    ),
}

ORACLES |= {
    "gap_given": query(
        """
given AS (
  SELECT CAST(l_linenumber AS INTEGER) AS k, nullif(l_suppkey % 5, 0) AS draw, ln(sum(CAST(l_quantity AS DOUBLE))) AS d
  FROM lineitem GROUP BY ALL
), gaps AS (
  SELECT k, avg(d) FILTER (draw IS NOT NULL) - max(d) FILTER (draw IS NULL) AS gap,
    stddev_pop(d) FILTER (draw IS NOT NULL) * sqrt(1 + 1.0 / count(draw)) AS error
  FROM given GROUP BY k
), ruled AS (
  SELECT *, gap >= lead(gap) OVER (ORDER BY k) - lead(error) OVER (ORDER BY k) AS enough FROM gaps
)""",
        f"""SELECT k, {r('gap', 6)} AS gap, {r('error', 6)} AS error,
        k = coalesce(min(k) FILTER (enough) OVER (), max(k) OVER ()) AS is_chosen FROM ruled""",
    ),
    "bic_given": query(
        """
given AS (
  SELECT CAST(l_linenumber AS INTEGER) AS k, count(*) AS rows, 3 AS columns,
    -sum(CAST(l_quantity AS DOUBLE)) AS log_likelihood
  FROM lineitem GROUP BY ALL
), measured AS (
  SELECT *, CAST(k - 1 + 3 * k + 6 * k AS BIGINT) AS parameters,
    (k - 1 + 9 * k) * ln(rows) - 2 * log_likelihood AS bic FROM given
)""",
        f"""SELECT k, rows, columns, {r('log_likelihood')} AS log_likelihood, parameters, {r('bic')} AS bic,
        row_number() OVER (ORDER BY bic, k) = 1 AS is_best FROM measured""",
    ),
    "mixture_check": query(
        RAW,
        LINES,
        """SELECT count(DISTINCT CustomerID) AS customers, 0 AS wrong FROM lines""",
    ),
    "spend_curve": query(
        RAW,
        LINES,
        SPEND,
        f"""SELECT CustomerID, {r('spend')} AS spend, row_number() OVER best AS position,
        {r('row_number() OVER best / count(*) OVER ()')} AS customer_share,
        {r('sum(spend) OVER best')} AS running,
        {r('sum(spend) OVER best / sum(spend) OVER ()')} AS spend_share
        FROM spend WINDOW best AS (ORDER BY spend DESC, CustomerID)""",
    ),
    "spend_concentration": query(
        RAW,
        LINES,
        SPEND,
        """
shares AS (
  SELECT spend, row_number() OVER best AS position, count(*) OVER () AS n,
    sum(spend) OVER best / sum(spend) OVER () AS share
  FROM spend WINDOW best AS (ORDER BY spend DESC, CustomerID)
), gaps AS (
  SELECT sum(abs(a.spend - b.spend)) AS gap FROM spend a CROSS JOIN spend b
)""",
        f"""SELECT count(*) AS customers, {r('sum(spend)')} AS spend,
        {r('any_value(gap) / (2 * count(*) * sum(spend))')} AS gini,
        {r('max(share) FILTER (position = ceil(n * 0.2 - 1e-9))')} AS top_share,
        {r('min(position / n) FILTER (share >= 0.8 - 1e-12)')} AS customers_for
        FROM shares, gaps""",
    ),
    "feature_correlation": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        "\nshown AS (SELECT CustomerID, " + ", ".join(f"{r(f)} AS {f}" for f in FEATURES) + " FROM features)",
        LONG_FEATURES.replace("UNPIVOT features", "UNPIVOT shown"),
        """
ranks AS (
  SELECT CustomerID, feature, value, rank() OVER (PARTITION BY feature ORDER BY value)
    + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS place
  FROM long
)""",
        f"""SELECT x.feature AS a, y.feature AS b,
        {r('CASE WHEN var_pop(x.value) > 0 AND var_pop(y.value) > 0 THEN corr(x.value, y.value) END')} AS pearson,
        {r('CASE WHEN var_pop(x.place) > 0 AND var_pop(y.place) > 0 THEN corr(x.place, y.place) END')} AS spearman
        FROM ranks x JOIN ranks y USING (CustomerID) GROUP BY ALL""",
    ),
    "rand_index_given": query(
        """
labels AS (
  SELECT c_nationkey % 3 AS part, c_mktsegment AS a,
    CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS b
  FROM customer
), cells AS (SELECT part, a, b, count(*) AS n FROM labels GROUP BY ALL
), whole AS (SELECT part, sum(n) AS n, sum(n * (n - 1) / 2) AS s FROM cells GROUP BY part
), of_a AS (
  SELECT part, sum(n * (n - 1) / 2) AS s FROM (SELECT part, a, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY part
), of_b AS (
  SELECT part, sum(n * (n - 1) / 2) AS s FROM (SELECT part, b, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY part
)""",
        f"""SELECT w.part, CAST(w.n AS BIGINT) AS rows,
        {r('(w.s - x.s * y.s / (w.n * (w.n - 1) / 2)) / ((x.s + y.s) / 2 - x.s * y.s / (w.n * (w.n - 1) / 2))', 6)} AS ari
        FROM whole w JOIN of_a x USING (part) JOIN of_b y USING (part)""",
    ),
    "state_features": ORACLES["customer_features"],
    "stream_labels_given": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        MOVED,
        "\nscaled AS (SELECT CustomerID, "
        + ", ".join(f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS {f}" for f in FEATURES)
        + " FROM moved)",
        "\ncenters AS (SELECT c_mktsegment, "
        + ", ".join(f"avg({f}) AS {f}" for f in FEATURES)
        + " FROM scaled JOIN customer ON CustomerID = CAST(c_custkey AS VARCHAR) GROUP BY c_mktsegment)",
        """
numbered AS (SELECT *, row_number() OVER (ORDER BY c_mktsegment) - 1 AS Cluster FROM centers)""",
        "\ngaps AS (SELECT s.CustomerID, c.Cluster, "
        + " + ".join(f"(s.{f} - c.{f}) * (s.{f} - c.{f})" for f in FEATURES)
        + " AS distance_sq FROM scaled s CROSS JOIN numbered c)",
        f"""SELECT CustomerID, CAST(arg_min(Cluster, distance_sq) AS INTEGER) AS Cluster,
        {r('min(distance_sq)')} AS distance_sq FROM gaps GROUP BY CustomerID""",
    ),
}

_HISTOGRAMS = {
    "spend_histogram": (SPEND, LONG_TRIMMED_SPEND),
    "invoice_histogram": (INVOICES, LONG_INVOICES),
    "rfm_histogram": (RFM, LONG_RFM),
    "feature_histogram": (FEATURE_TABLE, LONG_FEATURES),
    "transformed_histogram": (
        FEATURE_TABLE,
        MOVED,
        LONG_MOVED,
    ),
}
_DENSITIES = {
    "spend_kde": (SPEND, LONG_TRIMMED_SPEND),
    "invoice_kde": (INVOICES, LONG_INVOICES),
    "rfm_kde": (RFM, LONG_RFM),
}
for _name, _parts in _HISTOGRAMS.items():
    ORACLES[_name] = "WITH " + ",".join([RAW, LINES, *_parts, HISTOGRAM])
for _name, _parts in _DENSITIES.items():
    ORACLES[_name] = "WITH " + ",".join([RAW, LINES, *_parts, DENSITY])

ORACLES |= {
    "silhouette_estimate_given": query(
        """
points AS (
  SELECT vec_id, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), anchors AS (
  SELECT * FROM points ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id LIMIT 40
), sizes AS (SELECT label, count(*) AS n FROM points GROUP BY label
), sums AS (
  SELECT x.vec_id, x.label, y.label AS other, sum(list_distance(x.v, y.v)) AS d
  FROM anchors x CROSS JOIN points y GROUP BY x.vec_id, x.label, y.label
), ab AS (
  SELECT vec_id, s.label,
         max(d / nullif(n - 1, 0)) FILTER (other = s.label) AS a,
         min(d / n) FILTER (other <> s.label) AS b,
         max(n) FILTER (other = s.label) AS own
  FROM sums s JOIN sizes ON sizes.label = other GROUP BY vec_id, s.label
), scores AS (SELECT CASE WHEN own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab
), whole AS (SELECT count(*) AS n FROM points)""",
        f"""SELECT CAST(10 AS INTEGER) AS k, any_value(n) AS rows, count(*) AS anchors,
        {r('avg(s)', 5)} AS silhouette,
        {r('stddev_samp(s) * sqrt((1 - count(*) / any_value(n)) / count(*))', 5)} AS error FROM scores, whole""",
    ),
    "cluster_features_given": query(
        """
cells AS (
  SELECT CAST(label AS INTEGER) AS cluster, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x,
         generate_subscripts(embedding, 1) AS i
  FROM embeddings
), spread AS (
  SELECT cluster, i, count(*) AS n, sum(x * x) AS squares, var_pop(x) * count(*) AS within
  FROM cells GROUP BY cluster, i
)""",
        f"""SELECT cluster, max(n) AS n, {r('sum(squares)')} AS squares, {r('sum(within)')} AS within
        FROM spread GROUP BY cluster""",
    ),
    "ward_given": query(
        """
groups AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS g, CAST(count(*) AS DOUBLE) AS n,
    avg(CAST(l_quantity AS DOUBLE)) AS x, avg(CAST(l_extendedprice AS DOUBLE) / 1000) AS y,
    avg(CAST(l_discount AS DOUBLE) * 100) AS z
  FROM lineitem GROUP BY ALL
), pairs AS (
  SELECT a.g AS a, b.g AS b, a.n AS na, b.n AS nb,
    a.n * b.n / (a.n + b.n) * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS cost
  FROM groups a JOIN groups b ON a.g < b.g
), nearest AS (SELECT * FROM pairs ORDER BY cost, a, b LIMIT 1
), rest AS (
  SELECT f.a, f.b, f.cost, f.na, f.nb, c.g AS c, c.n AS nc,
    ((f.na + c.n) * pa.cost + (f.nb + c.n) * pb.cost - c.n * f.cost) / (f.na + f.nb + c.n) AS last
  FROM nearest f JOIN groups c ON c.g NOT IN (f.a, f.b)
  JOIN pairs pa ON pa.a = least(f.a, c.g) AND pa.b = greatest(f.a, c.g)
  JOIN pairs pb ON pb.a = least(f.b, c.g) AND pb.b = greatest(f.b, c.g)
), steps AS (
  SELECT 0 AS step, a AS "left", b AS "right", 3 AS node, cost, na + nb AS n FROM rest
  UNION ALL SELECT 1, c, 3, 4, last, na + nb + nc FROM rest
)""",
        f"""SELECT CAST(step AS INTEGER) AS step, CAST("left" AS INTEGER) AS "left", CAST("right" AS INTEGER) AS "right",
        CAST(node AS INTEGER) AS node, {r('cost')} AS cost, {r('sqrt(2 * cost)')} AS height, CAST(n AS BIGINT) AS n
        FROM steps""",
    ),
    "hierarchy_check": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        """SELECT CAST(k AS INTEGER) AS k, CAST(k AS BIGINT) AS groups,
        (SELECT count(*) FROM features) AS customers, CAST(0 AS DOUBLE) AS missed FROM range(2, 7) t(k)""",
    ),
    "shap_check": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        """SELECT CAST(k AS INTEGER) AS k, (SELECT count(*) FROM features) AS customers,
        CAST(0 AS DOUBLE) AS missed FROM range(3, 5) t(k)""",
    ),
    "shap_summary_given": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        LONG_FEATURES,
        SEGMENT_LABELS,
        """
z AS (
  SELECT CustomerID, feature, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value
  FROM long WINDOW w AS (PARTITION BY feature)
), sizes AS (
  SELECT k, Cluster AS cluster, feature, avg(abs(value)) AS mean_abs
  FROM z JOIN labels USING (CustomerID) GROUP BY k, Cluster, feature
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean_abs DESC, feature) AS rank FROM sizes
)""",
        f"""SELECT r.k, r.cluster, r.feature, z.CustomerID, {r('z.value')} AS shap, r.rank
        FROM ranked r JOIN labels l ON l.Cluster = r.cluster
        JOIN z ON z.CustomerID = l.CustomerID AND z.feature = r.feature WHERE r.rank <= 3""",
    ),
    "radar_6_given": query(
        RAW,
        LINES,
        FEATURE_TABLE,
        LONG_FEATURES,
        SEGMENT_LABELS,
        MEANS,
        f"""SELECT k, Cluster, 'Nhóm ' || CAST(Cluster AS VARCHAR) AS persona, feature,
        {case_map('feature', RADAR_AXES_6)} AS axis, {r('mean')} AS mean,
        {r('coalesce((mean - min(mean) OVER w) / nullif(max(mean) OVER w - min(mean) OVER w, 0), 0)')} AS value
        FROM means WHERE feature IN ({', '.join(f"'{f}'" for f in RADAR_AXES_6)})
        WINDOW w AS (PARTITION BY k, feature)""",
    ),
    "personas_given": query(
        """
labels AS (
  SELECT CAST(k AS INTEGER) AS k, CAST(c_custkey % k AS INTEGER) AS Cluster FROM customer, range(3, 6) t(k)
)""",
        f"""SELECT k, Cluster, count(*) AS customers,
        {r('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY k)')} AS share_pct,
        CASE {' '.join(
            f"WHEN k = {k} AND Cluster = {i} THEN '{name}'" for k, names in PERSONAS.items() for i, name in enumerate(names)
        )} ELSE 'Nhóm ' || CAST(Cluster AS VARCHAR) END AS persona FROM labels GROUP BY k, Cluster""",
    ),
    "best_k_given": """SELECT CAST(l_linenumber AS INTEGER) AS k, round(avg(CAST(l_discount AS DOUBLE)), 6) AS silhouette
        FROM lineitem GROUP BY ALL ORDER BY silhouette DESC, k LIMIT 1""",
}
