"""Every operator as a query over the given tables.

Values are rounded only where sums of doubles meet another engine's sums. A small shift before
rounding keeps exact halves, which are common in averages of pence, on the same side.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.adaptor import table, transactions
from tillroll.functions.columns import normalize_customer_id
from tillroll.operators import cleaning, clustering, concentration, correlation, distributions
from tillroll.operators import features, gap, hierarchy, mixture, profiles, quantiles
from tillroll.operators import reduction, sales, shapley, silhouette, surrogate, transforms
from tillroll.operators import rfm as rfm_ops
from tillroll.schema import FEATURES, RADAR_AXES_6, RADAR_AXES_8
from tillroll.session import stage, staging_path
from tillroll.sources import transactions as sources
from tillroll.streaming import scoring
from tillroll.streaming.feature_state import FeatureState
from tillroll.streaming.scoring import SegmentModel

HOME = "NATION_2"
ROUND_SHIFT = 1.2345e-8
LOGLIK_GRID = [-2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0]
FIXED_LAMBDAS = {f: (0.0, 0.5, -0.5, 0.25)[i % 4] for i, f in enumerate(FEATURES)}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
EXPLAINED_K = (3, 4)

# Persona names by cluster position.
PERSONAS = {
    3: ["Khách hàng Premium", "Khách hàng mua số lượng lớn", "Khách mua đa dạng"],
    4: [
        "Khách hàng Premium",
        "Khách hàng nhỏ",
        "Khách hàng thường xuyên",
        "Khách mua đa dạng",
    ],
}

LINE = ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID"]


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns(
        {c: F.round(F.col(c).cast("double") + ROUND_SHIFT, digits) for c in columns}
    )


# ---- shared steps --------------------------------------------------------------------------

_stored: dict = {}


def forget() -> None:
    """Drop the remembered steps, so that the next query computes everything again."""
    _stored.clear()


def once(build):
    """Remember a staged step per session and data folder."""

    def step(spark: SparkSession, sf: str):
        key = (spark.sparkContext.applicationId, sf, build.__name__)
        if key not in _stored:
            _stored[key] = build(spark, sf)
        return _stored[key]

    return step


def lines(spark: SparkSession, sf: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Cleaned lines of all nations."""
    return cleaning.clean_transactions(transactions(spark, sf, [*LINE, *extra]), country=None)


def _features(spark, sf):
    tasks = features.tasks_for(table(spark, sf, "lineitem").count())
    return features.customer_features(lines(spark, sf), tasks)


@once
def customer_table(spark, sf):
    return stage(_features(spark, sf), "features")


@once
def totals_table(spark, sf):
    return stage(sales.customer_totals(lines(spark, sf)), "totals")


@once
def rfm_table(spark, sf):
    return stage(rfm_ops.rfm(lines(spark, sf)), "rfm")


@once
def lambdas(spark, sf):
    return transforms.fit_box_cox(customer_table(spark, sf))


@once
def scaled_table(spark, sf):
    transformed = transforms.apply_box_cox(customer_table(spark, sf), lambdas(spark, sf))
    return stage(transforms.standardize(transformed), "scaled")


@once
def pca_fit(spark, sf):
    return reduction.fit_pca(scaled_table(spark, sf))


@once
def kmeans_fits(spark, sf):
    return clustering.fit_kmeans(
        scaled_table(spark, sf),
        clustering.K_SCAN,
        customer_table(spark, sf),
        parallelism=8,
    )


@once
def selection(spark, sf):
    return stage(
        clustering.k_selection(scaled_table(spark, sf), kmeans_fits(spark, sf)), "selection"
    )


@once
def explained_labels(spark, sf):
    fits = kmeans_fits(spark, sf)
    return stage(
        clustering.labels_long(scaled_table(spark, sf), {k: fits[k] for k in EXPLAINED_K}),
        "labels",
    )


@once
def surrogates(spark, sf):
    fits, scaled = kmeans_fits(spark, sf), scaled_table(spark, sf)
    return surrogate.train_surrogates({k: fits[k].assign(scaled) for k in EXPLAINED_K})


@once
def surrogate_rows(spark, sf):
    fits, scaled = kmeans_fits(spark, sf), scaled_table(spark, sf)
    found = [s.predictions(fits[k].assign(scaled)) for k, s in surrogates(spark, sf).items()]
    return stage(found[0].unionByName(found[1]), "predictions")


@once
def shap_rows(spark, sf):
    found = [
        shapley.shap_values(scaled_table(spark, sf), s) for s in surrogates(spark, sf).values()
    ]
    return stage(found[0].unionByName(found[1]), "shap")


# ---- sources and scalar functions ----------------------------------------------------------


def scan_transactions(spark, sf):
    """Write the lines as a Latin-1 CSV export and read it back under the fixed schema."""
    path = staging_path(spark, "export")
    raw = transactions(spark, sf)
    raw.write.options(
        **sources.CSV_OPTIONS,
        encoding="ISO-8859-1",
        timestampNTZFormat="yyyy-MM-dd HH:mm:ss",
    ).csv(path)
    return sources.read_transactions(spark, path)


def normalize_ids(spark, sf):
    """Customer numbers in the forms found in exports: 17, 17.0, too long, missing."""
    key = F.col("c_custkey")
    form = (
        F.when(key % 4 == 0, key.cast("string"))
        .when(key % 4 == 1, F.concat(key.cast("string"), F.lit(".0")))
        .when(key % 4 == 2, (key + 1_000_000).cast("string"))
    )
    return table(spark, sf, "customer").select(
        "c_custkey",
        normalize_customer_id(form).alias("dropped_form"),
        normalize_customer_id(form, "placeholder").alias("placeholder_form"),
    )


def clean_home(spark, sf):
    return cleaning.clean_transactions(transactions(spark, sf), HOME)


def stored_clean_lines(spark, sf):
    """Clean lines with time columns, written as CSV and read back with their types."""
    path = staging_path(spark, "clean")
    every = cleaning.clean_transactions(transactions(spark, sf), None)
    sources.write_transactions(cleaning.time_features(every), path, "csv")
    return sources.read_clean_transactions(spark, path, "csv")


def stored_features(spark, sf):
    """The three feature tables written and the original and scaled ones joined by customer."""
    folder = staging_path(spark, "tables")
    raw = customer_table(spark, sf)
    moved = transforms.apply_box_cox(raw, FIXED_LAMBDAS)
    sources.write_features(raw, moved, transforms.standardize(moved), folder)
    original = sources.read_features(spark, folder, "customer_features")
    scaled = sources.read_features(spark, folder, "customer_features_scaled")
    z = [F.col(f).alias(f"{f}_z") for f in FEATURES]
    joined = original.join(scaled.select("CustomerID", *z), "CustomerID")
    return rounded(joined, [*FEATURES, *[f"{f}_z" for f in FEATURES]])


def time_columns(spark, sf):
    events = cleaning.time_features(table(spark, sf, "events"), "ts")
    return events.select("event_id", "DayOfWeek", "HourOfDay")


def dataset_profile(spark, sf):
    return cleaning.dataset_profile(transactions(spark, sf)).drop("type")


def dataset_summary(spark, sf):
    return cleaning.dataset_summary(transactions(spark, sf))


def cleaning_report(spark, sf):
    raw = transactions(spark, sf, ["InvoiceNo", "Quantity", "UnitPrice", "CustomerID", "Country"])
    return rounded(cleaning.cleaning_report(raw, HOME), ["removed_pct"])


# ---- aggregates ----------------------------------------------------------------------------


def daily_revenue(spark, sf):
    return rounded(sales.daily_revenue(lines(spark, sf)), ["revenue"], 2)


def monthly_revenue(spark, sf):
    return rounded(sales.monthly_revenue(lines(spark, sf)), ["revenue"], 2)


def day_hour_activity(spark, sf):
    events = cleaning.time_features(table(spark, sf, "events"), "ts")
    return sales.day_hour_activity(events)


def day_hour_matrix(spark, sf):
    return sales.day_hour_matrix(stage(day_hour_activity(spark, sf), "activity"))


def top_products_quantity(spark, sf):
    return sales.top_products(lines(spark, sf, ("Description",)), "Quantity")


def top_products_revenue(spark, sf):
    top = sales.top_products(lines(spark, sf, ("Description",)), "TotalPrice")
    return rounded(top, ["total"], 2)


def invoices_per_customer(spark, sf):
    return sales.invoices_per_customer(lines(spark, sf))


def spend_per_customer(spark, sf):
    return rounded(sales.spend_per_customer(lines(spark, sf)), ["spend"], 2)


def spend_summary(spark, sf):
    summary = sales.spend_summary(totals_table(spark, sf))
    return rounded(summary, ["mean_spend", "median_spend", "mean_invoices"])


def _long_spend(spark, sf):
    return quantiles.to_long(totals_table(spark, sf), ["spend"])


STATS = ["mean", "std", "min", "p25", "p50", "p75", "max"]


def spend_describe(spark, sf):
    return rounded(quantiles.describe(_long_spend(spark, sf)), STATS)


def feature_describe(spark, sf):
    long = quantiles.to_long(customer_table(spark, sf), FEATURES)
    return rounded(quantiles.describe(long), STATS)


def scaled_describe(spark, sf):
    long = quantiles.to_long(scaled_table(spark, sf), FEATURES)
    return rounded(quantiles.describe(long), STATS, 3)


def rfm(spark, sf):
    return rounded(rfm_ops.rfm(lines(spark, sf)), ["Monetary"], 2)


def rfm_summary(spark, sf):
    summary = rfm_ops.rfm_summary(rfm_table(spark, sf))
    return rounded(summary, ["mean_recency", "mean_frequency", "mean_monetary"])


def spend_below_p99(spark, sf):
    spend = totals_table(spark, sf).select("CustomerID", "spend")
    return rounded(quantiles.below_quantile(spend, "spend"), ["spend"], 2)


def monetary_below_p99(spark, sf):
    scores = rfm_table(spark, sf)
    kept = quantiles.below_quantile(scores, "Monetary").select("CustomerID", "Monetary")
    return rounded(kept, ["Monetary"], 2)


def customer_features(spark, sf):
    return rounded(_features(spark, sf), FEATURES)


def feature_labels(spark, sf):
    means = quantiles.to_long(customer_table(spark, sf), FEATURES).groupBy("feature")
    return rounded(profiles.with_feature_labels(means.agg(F.avg("value").alias("mean"))), ["mean"])


# ---- distributions -------------------------------------------------------------------------


def feature_histogram(spark, sf):
    long = quantiles.to_long(customer_table(spark, sf), FEATURES)
    return rounded(distributions.histogram(long), ["lo", "hi"])


def transformed_histogram(spark, sf):
    moved = transforms.apply_box_cox(customer_table(spark, sf), FIXED_LAMBDAS)
    long = quantiles.to_long(moved, FEATURES)
    return rounded(distributions.histogram(long), ["lo", "hi"])


def feature_boxstats(spark, sf):
    long = quantiles.to_long(customer_table(spark, sf), FEATURES)
    box = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    return rounded(distributions.box_stats(long), box)


def transformed_boxstats(spark, sf):
    moved = transforms.apply_box_cox(customer_table(spark, sf), FIXED_LAMBDAS)
    box = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    return rounded(distributions.box_stats(quantiles.to_long(moved, FEATURES)), box)


def _long_invoices(spark, sf):
    return quantiles.to_long(totals_table(spark, sf), ["invoices"])


@once
def _long_trimmed_spend(spark, sf):
    trimmed = quantiles.below_quantile(totals_table(spark, sf), "spend")
    return stage(quantiles.to_long(trimmed, ["spend"]), "trimmed_spend")


@once
def _long_rfm(spark, sf):
    """Recency, Frequency and Monetary below its 99th percentile."""
    scores = rfm_table(spark, sf)
    trimmed = quantiles.below_quantile(scores, "Monetary")
    long = quantiles.to_long(scores, ["Recency", "Frequency"])
    return stage(long.unionByName(quantiles.to_long(trimmed, ["Monetary"])), "rfm_long")


def _histogram_of(long):
    def query(spark, sf):
        return rounded(distributions.histogram(long(spark, sf)), ["lo", "hi"])

    return query


def _density_of(long):
    def query(spark, sf):
        return rounded(distributions.density_curve(long(spark, sf)), ["x", "density"])

    return query


# ---- transformation ------------------------------------------------------------------------


def boxcox_apply_fixed(spark, sf):
    moved = transforms.apply_box_cox(customer_table(spark, sf), FIXED_LAMBDAS)
    return rounded(moved, FEATURES)


def boxcox_loglik_grid(spark, sf):
    scores = transforms.box_cox_log_likelihood(customer_table(spark, sf), LOGLIK_GRID)
    return rounded(scores, ["loglik"])


def boxcox_lambda(spark, sf):
    rows = [(f, lam) for f, lam in lambdas(spark, sf).items()]
    return rounded(spark.createDataFrame(rows, "feature string, lambda double"), ["lambda"], 2)


def zscore_features(spark, sf):
    return rounded(transforms.standardize(customer_table(spark, sf)), FEATURES)


# ---- given labels --------------------------------------------------------------------------


def segment_labels(spark, sf):
    """Market segments as a given clustering of the customers."""
    number = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")) - 1
    return table(spark, sf, "customer").select(
        F.lit(len(SEGMENTS)).alias("k"),
        F.col("c_custkey").cast("string").alias("CustomerID"),
        number.cast("int").alias("Cluster"),
    )


def cluster_sizes_given(spark, sf):
    return rounded(profiles.cluster_sizes(segment_labels(spark, sf)), ["share_pct"])


def cluster_means_given(spark, sf):
    means = profiles.cluster_means(customer_table(spark, sf), segment_labels(spark, sf))
    return rounded(means, ["mean"])


def radar_minmax(spark, sf):
    means = profiles.cluster_means(customer_table(spark, sf), segment_labels(spark, sf))
    return rounded(profiles.radar_profile(means, RADAR_AXES_8), ["mean", "value"])


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
        F.col("label").cast("int").alias("label"),
    )


def _nearest(spark, sf):
    points = _vectors(spark, sf)
    return clustering.assign_nearest_centroid(points, clustering.centroids_of(points, "label"))


def assign_nearest_centroid(spark, sf):
    return rounded(_nearest(spark, sf).select("vec_id", "cluster", "distance_sq"), ["distance_sq"])


def confusion_given(spark, sf):
    pairs = _nearest(spark, sf).select(
        F.lit(10).alias("k"), "label", F.col("cluster").alias("prediction")
    )
    return surrogate.confusion(pairs, [10])


def silhouette_euclidean(spark, sf):
    scores = silhouette.silhouettes(_vectors(spark, sf), "vector", {10: "label"}, "vec_id")
    return rounded(scores, ["a", "b", "silhouette"], 5)


def silhouette_squared_given(spark, sf):
    """The linear silhouette over squared distances, for the given labels."""
    points = _vectors(spark, sf).withColumn("vector", array_to_vector("vector"))
    score = silhouette.squared_silhouette(points, "vector", "label")
    return rounded(spark.createDataFrame([(10, score)], "k int, silhouette double"), ["silhouette"], 5)


def silhouette_estimate_given(spark, sf):
    """The mean of 40 anchors and its error, for the given labels."""
    found = silhouette.estimated_silhouettes(
        _vectors(spark, sf), "vector", {10: "label"}, "vec_id", anchors=40
    )
    return rounded(found, ["silhouette", "error"], 5)


def cluster_features_given(spark, sf):
    """Rows, squares and spread of every given cluster, from its mergeable description."""
    found = hierarchy.cluster_features(_vectors(spark, sf), "label")
    spread = hierarchy.spread_within(found).select("cluster", "within")
    return rounded(found.join(spread, "cluster").drop("sums"), ["squares", "within"])


def ward_given(spark, sf):
    """Ward's merges of the three return flags, by quantity, price and discount."""
    points = table(spark, sf, "lineitem").select(
        (F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")) - 1)
        .cast("int")
        .alias("flag"),
        F.array(
            F.col("l_quantity").cast("double"),
            F.col("l_extendedprice").cast("double") / 1000,
            F.col("l_discount").cast("double") * 100,
        ).alias("vector"),
    )
    merges = hierarchy.ward(hierarchy.cluster_features(points, "flag"))
    return rounded(merges.table(spark), ["cost", "height"])


def inertia_given(spark, sf):
    nearest = _nearest(spark, sf)
    total = nearest.agg(F.lit(10).alias("k"), F.sum("distance_sq").alias("inertia"))
    return rounded(total, ["inertia"])


def fidelity_given(spark, sf):
    """How often the nearest centroid repeats the label."""
    pairs = _nearest(spark, sf).select(
        F.lit(10).alias("k"), "label", F.col("cluster").alias("prediction")
    )
    return rounded(surrogate.fidelity(pairs), ["fidelity"])


def top_features_given(spark, sf):
    """The ranking of features per cluster, on z-scores of the market segments."""
    scores = stage(transforms.standardize(customer_table(spark, sf)), "z")
    values = quantiles.to_long(scores, FEATURES, "CustomerID").withColumnRenamed("value", "shap")
    labelled = profiles.attach_labels(values, segment_labels(spark, sf))
    top = shapley.top_features(labelled.withColumnRenamed("Cluster", "cluster"))
    return rounded(top, ["mean_abs_shap"])


def cluster_export_given(spark, sf):
    folder = staging_path(spark, "segments")
    sources.write_clusters(segment_labels(spark, sf), folder)
    return _read_clusters(spark, folder)


def shap_summary_given(spark, sf):
    """The points of a summary plot, on z-scores of the market segments."""
    scores = stage(transforms.standardize(customer_table(spark, sf)), "z")
    values = quantiles.to_long(scores, FEATURES, "CustomerID").withColumnRenamed("value", "shap")
    labelled = profiles.attach_labels(values, segment_labels(spark, sf))
    labelled = stage(labelled.withColumnRenamed("Cluster", "cluster"), "z-long")
    return rounded(shapley.shap_summary(labelled), ["shap"])


def radar_6_given(spark, sf):
    means = profiles.cluster_means(customer_table(spark, sf), segment_labels(spark, sf))
    return rounded(profiles.radar_profile(means, RADAR_AXES_6, PERSONAS), ["mean", "value"])


def personas_given(spark, sf):
    """Personas of three and four groups of customers by their number."""
    number = F.col("c_custkey")
    labels = table(spark, sf, "customer").select(
        number.cast("string").alias("CustomerID"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("k"), (number % k).cast("int").alias("Cluster"))
                    for k in (3, 4, 5)
                ]
            )
        ),
    )
    found = profiles.with_personas(profiles.cluster_sizes(labels), PERSONAS, "Cluster")
    return rounded(found, ["share_pct"])


def best_k_given(spark, sf):
    """The choice of k on given scores: the mean discount per line number."""
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("k")).agg(
        F.round(F.avg(F.col("l_discount").cast("double")), 6).alias("silhouette")
    )
    return clustering.best_k(scores)


# ---- models --------------------------------------------------------------------------------


def pca_scores(spark, sf):
    return pca_fit(spark, sf).scores(scaled_table(spark, sf))


def pca_variance(spark, sf):
    return pca_fit(spark, sf).variance(spark)


def cluster_pca_points(spark, sf):
    points = pca_scores(spark, sf).select("CustomerID", "PC1", "PC2", "PC3")
    return profiles.attach_labels(points, explained_labels(spark, sf))


def kmeans_labels(spark, sf):
    return clustering.labels_long(scaled_table(spark, sf), kmeans_fits(spark, sf))


def kmeans_elbow(spark, sf):
    return clustering.elbow(spark, kmeans_fits(spark, sf))


def kmeans_silhouette(spark, sf):
    return selection(spark, sf).select("k", "silhouette")


def k_selection(spark, sf):
    return selection(spark, sf)


def best_k(spark, sf):
    return clustering.best_k(selection(spark, sf))


def cluster_export(spark, sf):
    """Write the labels as CSV, one folder per k, and read them back."""
    folder = staging_path(spark, "clusters")
    sources.write_clusters(explained_labels(spark, sf), folder)
    return _read_clusters(spark, folder)


def _read_clusters(spark, folder):
    reader = spark.read.options(**sources.CSV_OPTIONS)
    return reader.schema("CustomerID string, Cluster int, k int").csv(f"{folder}/customer_clusters")


def cluster_sizes(spark, sf):
    return profiles.cluster_sizes(explained_labels(spark, sf))


def cluster_means(spark, sf):
    return profiles.cluster_means(customer_table(spark, sf), explained_labels(spark, sf))


def cluster_personas(spark, sf):
    return profiles.with_personas(cluster_sizes(spark, sf), PERSONAS, "Cluster")


def radar_profile_6(spark, sf):
    return profiles.radar_profile(cluster_means(spark, sf), RADAR_AXES_6, PERSONAS)


def radar_profile_8(spark, sf):
    return profiles.radar_profile(cluster_means(spark, sf), RADAR_AXES_8, PERSONAS, "Cluster")


def surrogate_accuracy(spark, sf):
    return surrogate.fidelity(surrogate_rows(spark, sf))


def surrogate_confusion(spark, sf):
    return surrogate.confusion(surrogate_rows(spark, sf), EXPLAINED_K)


def shap_top_features(spark, sf):
    return shapley.top_features(shap_rows(spark, sf))


def shap_summary(spark, sf):
    return shapley.shap_summary(shap_rows(spark, sf))


def kmeans_silhouette_estimate(spark, sf):
    """Mean silhouette and error of every k from 500 anchors."""
    fits, scaled = kmeans_fits(spark, sf), scaled_table(spark, sf)
    labelled = stage(clustering.assign_chained(scaled, fits), "anchored")
    names = {k: f"Cluster_{k}" for k in fits}
    return silhouette.estimated_silhouettes(labelled, FEATURES, names, "CustomerID", anchors=500)


def shap_base(spark, sf):
    """What the Shapley values of each cluster are added to."""
    found = [shapley.base_table(s, spark) for s in surrogates(spark, sf).values()]
    return found[0].unionByName(found[1])


def surrogate_trees(spark, sf):
    """Depth and leaves of every tree of the surrogates."""
    found = [surrogate.tree_table(s, spark) for s in surrogates(spark, sf).values()]
    return found[0].unionByName(found[1])


@once
def hierarchy_steps(spark, sf):
    labelled = stage(hierarchy.micro_clusters(scaled_table(spark, sf)), "micro")
    described = stage(hierarchy.cluster_features(labelled, "micro"), "micro-features")
    return labelled, described, hierarchy.ward(described)


def hierarchy_merges(spark, sf):
    """Ward's merges of 200 small clusters of the customers."""
    return hierarchy_steps(spark, sf)[2].table(spark)


def hierarchy_labels(spark, sf):
    """The customers in two to six groups, cut from one hierarchy."""
    labelled, _, merges = hierarchy_steps(spark, sf)
    return merges.cut(labelled, range(2, 7))


# ---- properties of the models that SQL can state -------------------------------------------


def cluster_sizes_total(spark, sf):
    """Customers of all clusters together, for every k of the scan."""
    sizes = profiles.cluster_sizes(kmeans_labels(spark, sf))
    return sizes.groupBy("k").agg(F.sum("customers").alias("customers"))


def kmeans_check(spark, sf):
    """Labels that are not the nearest center's, and the part by which the squared distances miss
    the model's inertia."""
    scaled, found = scaled_table(spark, sf), None
    for k, fit in kmeans_fits(spark, sf).items():
        centers = [
            (fit.number[i], [float(x) for x in c])
            for i, c in enumerate(fit.model.clusterCenters())
        ]
        table_of = spark.createDataFrame(centers, "cluster int, center array<double>")
        points = fit.assign(scaled).select(
            "Cluster", F.array(*[F.col(c).cast("double") for c in fit.columns]).alias("vector")
        )
        near = clustering.assign_nearest_centroid(
            points.withColumnRenamed("Cluster", "label"), table_of
        )
        row = near.agg(
            F.lit(k).alias("k"),
            F.count(F.lit(1)).alias("customers"),
            F.count_if(F.col("label") != F.col("cluster")).alias("mismatches"),
            F.round(F.abs(F.sum("distance_sq") / fit.inertia - 1), 6).alias("inertia_gap"),
        )
        found = row if found is None else found.unionByName(row)
    return found


def pca_check(spark, sf):
    """Customers, the largest covariance between two components, and the whole variance."""
    scores = pca_scores(spark, sf)
    names = [c for c in scores.columns if c != "CustomerID"]
    mixed = [F.abs(F.covar_pop(a, b)) for i, a in enumerate(names) for b in names[i + 1 :]]
    return scores.agg(
        F.count(F.lit(1)).alias("customers"),
        F.round(F.greatest(*mixed), 6).alias("mixed"),
        F.round(sum(F.var_pop(c) for c in names), 6).alias("variance"),
    )


# ---- concentration, correlation, stability ---------------------------------------------------


def spend_curve(spark, sf):
    found = concentration.spend_curve(totals_table(spark, sf).select("CustomerID", "spend"))
    return rounded(found, ["spend", "customer_share", "running", "spend_share"])


def spend_concentration(spark, sf):
    found = concentration.concentration(totals_table(spark, sf).select("CustomerID", "spend"))
    return rounded(found, ["spend", "gini", "top_share", "customers_for"])


def feature_correlation(spark, sf):
    # Rounded first: whether two values tie must not hang on the last digit of a mean.
    found = correlation.correlation(rounded(customer_table(spark, sf), FEATURES))
    return rounded(found, ["pearson", "spearman"])


def kmeans_starts(spark, sf):
    return clustering.start_costs(spark, kmeans_fits(spark, sf))


def kmeans_stability(spark, sf):
    return clustering.stability(scaled_table(spark, sf), kmeans_fits(spark, sf))


def rand_index_given(spark, sf):
    """Agreement of two given labels of the customers, per region number."""
    labels = table(spark, sf, "customer").select(
        (F.col("c_nationkey") % 3).alias("part"),
        F.col("c_mktsegment").alias("a"),
        F.when(F.col("c_acctbal") < 0, "low").when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("b"),
    )
    return rounded(clustering.adjusted_rand(labels, "a", "b", ["part"]), ["ari"], 6)


# ---- number of groups ------------------------------------------------------------------------


def gap_statistic(spark, sf):
    """Gap, error and choice for one to five groups of the customers."""
    scaled = scaled_table(spark, sf)
    return gap.gap_table(gap.dispersions(scaled, range(1, 6), draws=5, n_init=1, parallelism=8))


def gap_given(spark, sf):
    """The gap and its rule on given dispersions: quantities by line number, a draw per supplier group."""
    given = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("k"),
        F.nullif(F.col("l_suppkey") % 5, F.lit(0)).cast("int").alias("draw"),
        F.col("l_quantity").cast("double").alias("q"),
    )
    found = gap.gap_table(given.groupBy("k", "draw").agg(F.sum("q").alias("dispersion")))
    return rounded(found, ["gap", "error"], 6)


@once
def mixture_fits(spark, sf):
    scores = stage(pca_scores(spark, sf), "mixture-scores")
    names = [c for c in scores.columns if c != "CustomerID"][:3]
    return scores, mixture.fit_mixtures(scores, range(2, 6), names, parallelism=8)


def mixture_selection(spark, sf):
    """Likelihood and criterion of two to five components over three principal components."""
    return mixture.mixture_selection(*mixture_fits(spark, sf))


def mixture_memberships(spark, sf):
    """How much of each customer belongs to each of four components."""
    scores, fits = mixture_fits(spark, sf)
    return fits[4].memberships(scores)


def mixture_check(spark, sf):
    """Customers whose memberships do not sum to 1 or leave 0 to 1."""
    whole = mixture_memberships(spark, sf).groupBy("CustomerID").agg(
        F.sum("probability").alias("whole"), F.min("probability").alias("least")
    )
    wrong = (F.abs(F.col("whole") - 1) > 1e-9) | (F.col("least") < 0)
    return whole.agg(F.count(F.lit(1)).alias("customers"), F.count_if(wrong).alias("wrong"))


def bic_given(spark, sf):
    """The criterion on given likelihoods: a sum of quantities per line number."""
    given = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("k")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(3).alias("columns"),
        (-F.sum(F.col("l_quantity").cast("double"))).alias("log_likelihood"),
    )
    return rounded(mixture.bayesian_criterion(given), ["log_likelihood", "bic"])


# ---- batches and streams ---------------------------------------------------------------------


def _batches(spark, sf):
    """All cleaned lines in three batches; the lines of an invoice fall into several of them."""
    dealt = F.pmod(F.xxhash64("InvoiceNo", "StockCode", "Quantity"), F.lit(3))
    return [lines(spark, sf).where(dealt == i) for i in range(3)]


@once
def merged_state(spark, sf):
    state = FeatureState(spark, staging_path(spark, "feature-state"), buckets=8)
    for number, batch in enumerate(_batches(spark, sf)):
        state.merge(batch, number)
    state.merge(_batches(spark, sf)[1], 1)  # a replay, which changes nothing
    return state


def state_features(spark, sf):
    """The features from a state that three batches and a replayed one were merged into."""
    return rounded(merged_state(spark, sf).features(), FEATURES)


@once
def given_model(spark, sf):
    """Fixed parameters, the scale of the table, and the mean of each market segment as a center."""
    moved = transforms.apply_box_cox(customer_table(spark, sf), FIXED_LAMBDAS)
    scale = transforms.fit_scale(moved)
    segment = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("CustomerID"), "c_mktsegment"
    )
    z = moved.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()})
    means = z.join(segment, "CustomerID").groupBy("c_mktsegment").agg(*[F.avg(c).alias(c) for c in FEATURES])
    centers = [[float(r[c]) for c in FEATURES] for r in means.orderBy("c_mktsegment").collect()]
    return SegmentModel(FEATURES, FIXED_LAMBDAS, {}, scale, centers)


def stream_labels_given(spark, sf):
    """Segments kept by a stream over files of lines, under a given model."""
    folder = staging_path(spark, "stream")
    for number, batch in enumerate(_batches(spark, sf)):
        batch.coalesce(1).write.parquet(f"{folder}/in-{number}")
    given_model(spark, sf).save(spark, f"{folder}/model")
    state = FeatureState(spark, f"{folder}/state", buckets=8)
    schema = spark.read.parquet(f"{folder}/in-0").schema
    scoring.follow(
        spark, f"{folder}/in-*", state, f"{folder}/model", f"{folder}/labels",
        f"{folder}/checkpoint", schema=schema, files_per_batch=1,
    ).awaitTermination()
    return rounded(scoring.current_labels(spark, f"{folder}/labels"), ["distance_sq"])


def confusion_total(spark, sf):
    cells = surrogate_confusion(spark, sf)
    return cells.groupBy("k").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("n").alias("customers")
    )


def shap_check(spark, sf):
    """Per k: customers, and the largest part by which the base and the Shapley values of a cluster
    miss the probability that the forest gives it."""
    found = None
    for k, s in surrogates(spark, sf).items():
        scored = s.model.transform(reduction.with_vector(scaled_table(spark, sf), s.columns)).select(
            "CustomerID",
            F.posexplode(vector_to_array("probability")).alias("cluster", "probability"),
        )
        explained = (
            shap_rows(spark, sf)
            .where(F.col("k") == k)
            .groupBy("CustomerID", "cluster")
            .agg(F.sum("shap").alias("shap"))
        )
        missed = F.abs(F.col("base_value") + F.col("shap") - F.col("probability"))
        row = (
            scored.join(explained, ["CustomerID", "cluster"])
            .join(F.broadcast(shap_base(spark, sf).where(F.col("k") == k)), "cluster")
            .agg(
                F.lit(k).alias("k"),
                F.count_distinct("CustomerID").alias("customers"),
                F.round(F.max(missed), 6).alias("missed"),
            )
        )
        found = row if found is None else found.unionByName(row)
    return found


def hierarchy_check(spark, sf):
    """Per cut: groups, customers, and the part by which the squares within the groups and the costs
    of the later merges miss the squares of the whole table."""
    labelled, described, merges = hierarchy_steps(spark, sf)
    scaled = scaled_table(spark, sf)
    whole = scaled.agg(sum(F.var_pop(c) * F.count(c) for c in FEATURES).alias("whole")).first()[0]
    found = None
    for k in range(2, 7):
        groups = list(merges.groups(k).items())
        named = described.join(
            F.broadcast(spark.createDataFrame(groups, "cluster int, group int")), "cluster"
        )
        later = sum(cost for *_, cost, _ in merges.merges[1 - k :])
        row = hierarchy.spread_within(hierarchy.merge_features(named)).agg(
            F.lit(k).alias("k"),
            F.count(F.lit(1)).alias("groups"),
            F.sum("n").alias("customers"),
            F.round(F.abs((F.sum("within") + later) / whole - 1), 6).alias("missed"),
        )
        found = row if found is None else found.unionByName(row)
    return found


def shap_total(spark, sf):
    """Rows of the Shapley table per k and cluster."""
    return shap_rows(spark, sf).groupBy("k", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("feature").alias("features")
    )


QUERIES = {
    "silhouette_estimate_given": silhouette_estimate_given,
    "kmeans_silhouette_estimate": kmeans_silhouette_estimate,
    "cluster_features_given": cluster_features_given,
    "ward_given": ward_given,
    "hierarchy_merges": hierarchy_merges,
    "hierarchy_labels": hierarchy_labels,
    "hierarchy_check": hierarchy_check,
    "shap_base": shap_base,
    "shap_check": shap_check,
    "shap_summary_given": shap_summary_given,
    "radar_6_given": radar_6_given,
    "personas_given": personas_given,
    "best_k_given": best_k_given,
    "surrogate_trees": surrogate_trees,
    "gap_statistic": gap_statistic,
    "gap_given": gap_given,
    "mixture_selection": mixture_selection,
    "mixture_memberships": mixture_memberships,
    "mixture_check": mixture_check,
    "bic_given": bic_given,
    "spend_curve": spend_curve,
    "spend_concentration": spend_concentration,
    "feature_correlation": feature_correlation,
    "kmeans_starts": kmeans_starts,
    "kmeans_stability": kmeans_stability,
    "rand_index_given": rand_index_given,
    "state_features": state_features,
    "stream_labels_given": stream_labels_given,
    "cluster_sizes_total": cluster_sizes_total,
    "kmeans_check": kmeans_check,
    "pca_check": pca_check,
    "confusion_total": confusion_total,
    "shap_total": shap_total,
    "scan_transactions": scan_transactions,
    "normalize_customer_id": normalize_ids,
    "clean_transactions": clean_home,
    "stored_clean_lines": stored_clean_lines,
    "time_features": time_columns,
    "dataset_profile": dataset_profile,
    "dataset_summary": dataset_summary,
    "cleaning_report": cleaning_report,
    "daily_revenue": daily_revenue,
    "monthly_revenue": monthly_revenue,
    "day_hour_activity": day_hour_activity,
    "day_hour_matrix": day_hour_matrix,
    "top_products_quantity": top_products_quantity,
    "top_products_revenue": top_products_revenue,
    "invoices_per_customer": invoices_per_customer,
    "spend_per_customer": spend_per_customer,
    "spend_summary": spend_summary,
    "spend_describe": spend_describe,
    "spend_below_p99": spend_below_p99,
    "spend_histogram": _histogram_of(_long_trimmed_spend),
    "spend_kde": _density_of(_long_trimmed_spend),
    "invoice_histogram": _histogram_of(_long_invoices),
    "invoice_kde": _density_of(_long_invoices),
    "rfm": rfm,
    "rfm_summary": rfm_summary,
    "monetary_below_p99": monetary_below_p99,
    "rfm_histogram": _histogram_of(_long_rfm),
    "rfm_kde": _density_of(_long_rfm),
    "customer_features": customer_features,
    "feature_labels": feature_labels,
    "stored_features": stored_features,
    "feature_describe": feature_describe,
    "feature_histogram": feature_histogram,
    "transformed_histogram": transformed_histogram,
    "feature_boxstats": feature_boxstats,
    "transformed_boxstats": transformed_boxstats,
    "boxcox_apply_fixed": boxcox_apply_fixed,
    "boxcox_loglik_grid": boxcox_loglik_grid,
    "boxcox_lambda": boxcox_lambda,
    "zscore_features": zscore_features,
    "scaled_describe": scaled_describe,
    "cluster_sizes_given": cluster_sizes_given,
    "cluster_means_given": cluster_means_given,
    "radar_minmax": radar_minmax,
    "assign_nearest_centroid": assign_nearest_centroid,
    "inertia_given": inertia_given,
    "confusion_given": confusion_given,
    "fidelity_given": fidelity_given,
    "top_features_given": top_features_given,
    "cluster_export_given": cluster_export_given,
    "silhouette_euclidean": silhouette_euclidean,
    "silhouette_squared_given": silhouette_squared_given,
    "pca_scores": pca_scores,
    "pca_variance": pca_variance,
    "kmeans_labels": kmeans_labels,
    "kmeans_elbow": kmeans_elbow,
    "kmeans_silhouette": kmeans_silhouette,
    "k_selection": k_selection,
    "best_k": best_k,
    "cluster_pca_points": cluster_pca_points,
    "cluster_export": cluster_export,
    "cluster_sizes": cluster_sizes,
    "cluster_means": cluster_means,
    "cluster_personas": cluster_personas,
    "radar_profile_6": radar_profile_6,
    "radar_profile_8": radar_profile_8,
    "surrogate_predictions": surrogate_rows,
    "surrogate_accuracy": surrogate_accuracy,
    "surrogate_confusion": surrogate_confusion,
    "shap_values": shap_rows,
    "shap_top_features": shap_top_features,
    "shap_summary": shap_summary,
}
