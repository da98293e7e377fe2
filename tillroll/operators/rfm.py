"""Recency, frequency and monetary value per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import elapsed_days


def rfm(clean: DataFrame) -> DataFrame:
    """CustomerID, Recency (whole days to the snapshot), Frequency (invoices), Monetary.

    The snapshot is one day after the newest line. Frequency counts a missing invoice number
    as one more value. Lines collapse to (customer, invoice) first. The snapshot is a scalar
    subquery over the customers, lines without a customer included; it asks for the same columns
    as the result, so both share one shuffle and the lines are read once.
    """
    invoices = clean.groupBy("CustomerID", "InvoiceNo").agg(
        F.max("InvoiceDate").alias("last"),
        F.sum("TotalPrice").alias("total"),
        F.max(F.col("CustomerID").isNotNull()).alias("known"),
    )
    per_customer = invoices.groupBy("CustomerID").agg(
        F.max("last").alias("last"),
        F.count(F.lit(1)).alias("Frequency"),
        F.coalesce(F.sum("total"), F.lit(0.0)).alias("Monetary"),
        F.max("known").alias("known"),
    )
    every = F.struct("last", "Frequency", "Monetary", "known")
    snapshot = per_customer.agg(F.max(every)["last"] + F.expr("interval 1 day")).scalar()
    return per_customer.where("known").select(
        "CustomerID",
        elapsed_days(snapshot, F.col("last")).alias("Recency"),
        "Frequency",
        "Monetary",
    )


def rfm_summary(table: DataFrame) -> DataFrame:
    return table.agg(
        F.avg("Recency").alias("mean_recency"),
        F.avg("Frequency").alias("mean_frequency"),
        F.avg("Monetary").alias("mean_monetary"),
    )
