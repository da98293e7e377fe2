"""Sixteen purchase features per customer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.schema import FEATURES


def customer_features(clean: DataFrame, tasks: int | None = None) -> DataFrame:
    """CustomerID and the sixteen features, all doubles.

    One scan and two shuffles, no join. Grouping sets collapse the lines to (customer,
    invoice) and (customer, stock) partial sums in one pass; the partial sums then roll up
    to the customer. The first shuffle is keyed by the pair, so a customer with a large
    share of all lines is spread over many tasks. ``tasks``: see ``partial_sums``.

    Averages "per invoice" and "per stock" run over the customer's distinct invoices or
    stock codes. The two counts among them are lines per stock and lines per invoice.
    """
    return features_of_sums(partial_sums(clean, tasks))


# The sums that lines of one (customer, invoice) or (customer, stock) pair collapse to.
SUMS = ["lines", "quantity", "price", "prices", "total", "totals"]
PAIR = ["CustomerID", "is_invoice", "InvoiceNo", "StockCode"]

# Lines of a task that sums up pairs; each line is in two pairs.
TASK_LINES = 500_000


def tasks_for(lines: int) -> int:
    """Tasks of ``partial_sums`` for so many lines."""
    return max(1, math.ceil(lines / TASK_LINES))


def partial_sums(clean: DataFrame, tasks: int | None = None) -> DataFrame:
    """PAIR and SUMS: one row per (customer, invoice) and one per (customer, stock) pair.

    Sums of different lines may be added up pair by pair. With ``tasks`` the lines are dealt by pair
    over so many tasks before anything is summed, so what a task holds follows the lines per task;
    without it each task that reads lines holds the pairs of all of them, and the session's number
    of shuffle partitions decides how many pairs a later task has.
    """
    sums = [
        F.count(F.lit(1)).alias("lines"),
        F.sum("Quantity").alias("quantity"),
        F.sum("UnitPrice").alias("price"),
        F.count("UnitPrice").alias("prices"),
        F.sum("TotalPrice").alias("total"),
        F.count("TotalPrice").alias("totals"),
    ]
    known = clean.filter(F.col("CustomerID").isNotNull())
    if tasks is not None:
        kind = {f.name: f.dataType for f in clean.schema}
        none = {c: F.lit(None).cast(kind[c]).alias(c) for c in ("InvoiceNo", "StockCode")}
        both = F.array(
            F.struct(F.lit(1).cast("tinyint").alias("is_invoice"), "InvoiceNo", none["StockCode"]),
            F.struct(F.lit(0).cast("tinyint").alias("is_invoice"), none["InvoiceNo"], "StockCode"),
        )
        values = ["Quantity", "UnitPrice", "TotalPrice"]
        dealt = known.select("CustomerID", *values, F.inline(both)).repartition(tasks, *PAIR)
        return dealt.groupBy(*PAIR).agg(*sums).select(*PAIR, *SUMS)
    return (
        known.groupingSets(
            [["CustomerID", "InvoiceNo"], ["CustomerID", "StockCode"]],
            "CustomerID",
            "InvoiceNo",
            "StockCode",
        )
        .agg(F.grouping("StockCode").alias("is_invoice"), *sums)
        .select(*PAIR, *SUMS)
    )


def features_of_sums(pairs: DataFrame) -> DataFrame:
    """CustomerID and the sixteen features from whole ``partial_sums``."""
    every_invoice = F.col("is_invoice") == 1
    invoice = every_invoice & F.col("InvoiceNo").isNotNull()
    stock = ~every_invoice & F.col("StockCode").isNotNull()

    def total(column: str):
        return F.coalesce(F.sum(F.when(every_invoice, F.col(column))), F.lit(0))

    def mean_per_line(value: str, count: str):
        return F.try_divide(total(value), total(count))

    def mean_of_counts(group):
        return F.avg(F.when(group, F.col("lines")))

    def mean_of_means(group, value: str, count: str):
        return F.avg(F.when(group, F.try_divide(F.col(value), F.col(count))))

    def mean_of_sums(group, value: str):
        return F.avg(F.when(group, F.coalesce(F.col(value), F.lit(0))))

    definitions = {
        "Sum_Quantity": total("quantity"),
        "Mean_UnitPrice": mean_per_line("price", "prices"),
        "Mean_TotalPrice": mean_per_line("total", "totals"),
        "Sum_TotalPrice": total("total"),
        "Count_Invoice": F.count_if(invoice),
        "Count_Stock": F.count_if(stock),
        "Mean_InvoiceCountPerStock": mean_of_counts(stock),
        "Mean_StockCountPerInvoice": mean_of_counts(invoice),
        "Mean_UnitPriceMeanPerInvoice": mean_of_means(invoice, "price", "prices"),
        "Mean_QuantitySumPerInvoice": mean_of_sums(invoice, "quantity"),
        "Mean_TotalPriceMeanPerInvoice": mean_of_means(invoice, "total", "totals"),
        "Mean_TotalPriceSumPerInvoice": mean_of_sums(invoice, "total"),
        "Mean_UnitPriceMeanPerStock": mean_of_means(stock, "price", "prices"),
        "Mean_QuantitySumPerStock": mean_of_sums(stock, "quantity"),
        "Mean_TotalPriceMeanPerStock": mean_of_means(stock, "total", "totals"),
        "Mean_TotalPriceSumPerStock": mean_of_sums(stock, "total"),
    }
    return pairs.groupBy("CustomerID").agg(
        *[definitions[f].cast("double").alias(f) for f in FEATURES]
    )
