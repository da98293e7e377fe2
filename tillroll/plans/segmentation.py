"""The whole study in three steps, each reading the tables the step before it wrote."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tillroll.operators import cleaning, clustering, distributions, features, profiles
from tillroll.operators import quantiles, reduction, rfm, sales, shapley, surrogate, transforms
from tillroll.schema import FEATURES, RADAR_AXES_6, RADAR_AXES_8
from tillroll.session import stage
from tillroll.sources import transactions as io


def explore(
    spark: SparkSession,
    csv_path: str,
    folder: str,
    country: str | None = cleaning.HOME_COUNTRY,
    missing_id: str = "drop",
    top_n: int = 10,
) -> dict[str, DataFrame]:
    """Read and clean an export, store the clean lines, and return the exploratory tables.

    The export is parsed once; the reports on raw lines read the stored copy.
    """
    raw = stage(io.read_transactions(spark, csv_path, missing_id), "raw")
    path = f"{folder}/cleaned_transactions"
    clean = cleaning.time_features(cleaning.clean_transactions(raw, country))
    io.write_transactions(clean, path)
    clean = io.read_clean_transactions(spark, path)

    totals = stage(sales.customer_totals(clean), "totals")
    scores = stage(rfm.rfm(clean), "rfm")
    trimmed = quantiles.below_quantile(totals, "spend")
    spend = stage(quantiles.to_long(trimmed, ["spend"]), "trimmed_spend")
    invoices = quantiles.to_long(totals, ["invoices"])
    trimmed = quantiles.to_long(quantiles.below_quantile(scores, "Monetary"), ["Monetary"])
    rfm_long = stage(
        quantiles.to_long(scores, ["Recency", "Frequency"]).unionByName(trimmed), "rfm_long"
    )
    return {
        "dataset_summary": cleaning.dataset_summary(raw),
        "dataset_profile": cleaning.dataset_profile(raw),
        "cleaning_report": cleaning.cleaning_report(raw, country),
        "clean": clean,
        "daily_revenue": sales.daily_revenue(clean),
        "monthly_revenue": sales.monthly_revenue(clean),
        "day_hour_activity": sales.day_hour_activity(clean),
        "top_products_quantity": sales.top_products(clean, "Quantity", top_n),
        "top_products_revenue": sales.top_products(clean, "TotalPrice", top_n),
        "customer_totals": totals,
        "spend_summary": sales.spend_summary(totals),
        "spend_describe": quantiles.describe(quantiles.to_long(totals, ["spend"])),
        "invoice_histogram": distributions.histogram(invoices),
        "invoice_density": distributions.density_curve(invoices),
        "spend_histogram": distributions.histogram(spend),
        "spend_density": distributions.density_curve(spend),
        "rfm": scores,
        "rfm_summary": rfm.rfm_summary(scores),
        "rfm_histogram": distributions.histogram(rfm_long),
        "rfm_density": distributions.density_curve(rfm_long),
    }


def engineer(clean: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Compute, transform and scale the features, store the three tables, describe them."""
    spark = clean.sparkSession
    tasks = features.tasks_for(clean.count())
    raw = stage(features.customer_features(clean, tasks), "features")
    moved = transforms.apply_box_cox(raw, transforms.fit_box_cox(raw))
    io.write_features(raw, moved, transforms.standardize(moved), folder)
    raw, moved, scaled = (io.read_features(spark, folder, name) for name in io.FEATURE_TABLES)
    raw_long, moved_long = (quantiles.to_long(t, FEATURES) for t in (raw, moved))
    return {
        "features": raw,
        "transformed": moved,
        "scaled": scaled,
        "feature_describe": quantiles.describe(raw_long),
        "scaled_describe": quantiles.describe(quantiles.to_long(scaled, FEATURES)),
        "feature_boxstats": distributions.box_stats(raw_long),
        "transformed_boxstats": distributions.box_stats(moved_long),
        "feature_histogram": distributions.histogram(raw_long),
        "transformed_histogram": distributions.histogram(moved_long),
    }


@dataclass
class Segments:
    """Fitted models and their tables."""

    fits: dict[int, clustering.KMeansFit]
    surrogates: dict[int, surrogate.Surrogate]
    tables: dict[str, DataFrame]


def segment(
    scaled: DataFrame,
    original: DataFrame,
    folder: str,
    k_values=clustering.K_VALUES,
    k_scan=clustering.K_SCAN,
    personas: dict[int, list[str]] | None = None,
    chain_labels: bool = False,
    metric: str = "squaredEuclidean",
    trees: int = surrogate.TREES,
    max_depth: int = 10,
    partitions: int = clustering.PARTITIONS,
    **kmeans,
) -> Segments:
    """Reduce, choose k, cluster, profile and explain; the labels are stored as CSV.

    With ``chain_labels`` each k of ``k_values`` also sees the labels of the k before it. The
    silhouette is Spark's linear one; ``metric="euclidean"`` asks for plain distances, whose work
    grows with the square of the customers. ``partitions`` deals the customers out for the fits:
    about one per 500,000 of them, and at least one per core.
    """
    kmeans["partitions"] = partitions
    spark = scaled.sparkSession
    pca = reduction.fit_pca(scaled)
    scan = clustering.fit_kmeans(scaled, k_scan, original, **kmeans)
    selection = stage(clustering.k_selection(scaled, scan, metric), "selection")
    if chain_labels:
        fits = clustering.fit_kmeans_chained(scaled, k_values, original, **kmeans)
    else:
        missing = [k for k in k_values if k not in scan]
        more = clustering.fit_kmeans(scaled, missing, original, **kmeans) if missing else {}
        fits = {k: (scan | more)[k] for k in k_values}

    labels = stage(clustering.labels_long(scaled, fits), "labels")
    io.write_clusters(labels, folder)
    means = stage(profiles.cluster_means(original, labels), "means")
    labelled = {
        k: profiles.attach_labels(
            scaled, labels.filter(labels.k == k).select("CustomerID", "Cluster")
        )
        for k in k_values
    }
    models = surrogate.train_surrogates(labelled, trees=trees, max_depth=max_depth)
    predictions = [models[k].predictions(labelled[k]) for k in k_values]
    shap = [shapley.shap_values(scaled, models[k]) for k in k_values]
    predicted, explained = predictions[0], shap[0]
    for more_predictions, more_shap in zip(predictions[1:], shap[1:]):
        predicted = predicted.unionByName(more_predictions)
        explained = explained.unionByName(more_shap)
    predicted, explained = stage(predicted, "predictions"), stage(explained, "shap")
    scores = pca.scores(scaled)
    tables = {
        "pca_scores": scores,
        "pca_variance": pca.variance(spark),
        "k_selection": selection,
        "best_k": clustering.best_k(selection),
        "labels": labels,
        "cluster_sizes": profiles.cluster_sizes(labels),
        "cluster_means": means,
        "cluster_pca_points": profiles.attach_labels(
            scores.select("CustomerID", "PC1", "PC2", "PC3"), labels
        ),
        "radar_profile_6": profiles.radar_profile(means, RADAR_AXES_6, personas),
        "radar_profile_8": profiles.radar_profile(means, RADAR_AXES_8, personas, "Cluster"),
        "surrogate_accuracy": surrogate.fidelity(predicted),
        "shap_values": explained,
        "shap_summary": shapley.shap_summary(explained),
        "shap_top_features": shapley.top_features(explained),
    }
    tables["surrogate_confusion"] = surrogate.confusion(predicted, k_values)
    return Segments(fits, models, tables)
