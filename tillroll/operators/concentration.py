"""How much of the spend the best customers bring in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.ranking import running_sums
from tillroll.session import stage


def spend_curve(totals: DataFrame) -> DataFrame:
    """CustomerID, spend, position, customer_share, running, spend_share; the best customer first.

    ``totals`` has one row per customer with CustomerID and spend; customers without a spend are
    left out, ties go by CustomerID. The shares reach 1 at the last customer; without any spend at
    all they are null.
    """
    rows = totals.where("spend is not null").select("CustomerID", "spend", F.lit(1).alias("one"))
    order = [F.desc("spend"), F.asc("CustomerID")]
    curve = running_sums(rows, [], order, {"position": "one", "running": "spend"}, "spend-curve")
    whole = rows.agg(F.struct(F.count("*").alias("n"), F.sum("spend").alias("spend"))).scalar()
    return curve.withColumn("_whole", whole).select(
        "CustomerID",
        "spend",
        "position",
        (F.col("position") / F.col("_whole.n")).alias("customer_share"),
        "running",
        F.try_divide("running", "_whole.spend").alias("spend_share"),
    )


def concentration(totals: DataFrame, customers: float = 0.2, spend: float = 0.8) -> DataFrame:
    """One row: customers, spend, gini, top_share and customers_for.

    ``top_share`` is what the best ``customers`` share of them spend (whole customers, rounded up),
    ``customers_for`` the smallest share of customers that spends at least ``spend`` of it all.
    """
    curve = stage(spend_curve(totals), "spend-shares")
    n, total = F.count("*"), F.sum("spend")
    ascending = n + 1 - F.sum(F.col("position") * F.col("spend")) * 2 / total  # over n: minus Gini
    reached = F.col("spend_share") >= spend - 1e-12
    held = curve.agg(F.count("*").alias("n")).scalar()
    top = F.col("position") == F.ceil(held * customers - 1e-9)
    return curve.agg(
        n.alias("customers"),
        total.alias("spend"),
        (ascending / n).alias("gini"),
        F.max(F.when(top, F.col("spend_share"))).alias("top_share"),
        F.min(F.when(reached, F.col("customer_share"))).alias("customers_for"),
    )
