"""Cleaning rules and the reports about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import day_of_week, hour_of_day, is_cancelled, total_price

# Fixed value: the home market.
HOME_COUNTRY = "United Kingdom"


def keep_line(country: str | None = HOME_COUNTRY) -> Column:
    """Condition for a usable line: not cancelled, home market, known customer, positive sale.

    ``country=None`` keeps every market. Exact duplicates are ordinary lines and stay.
    """
    keep = (
        ~is_cancelled(F.col("InvoiceNo"))
        & F.col("CustomerID").isNotNull()
        & (F.col("Quantity") > 0)
        & (F.col("UnitPrice") > 0)
        & ~F.isnan("UnitPrice")
    )
    return keep if country is None else keep & (F.col("Country") == country)


def clean_transactions(raw: DataFrame, country: str | None = HOME_COUNTRY) -> DataFrame:
    return raw.filter(keep_line(country)).withColumn("TotalPrice", total_price())


def time_features(df: DataFrame, ts: str = "InvoiceDate") -> DataFrame:
    return df.withColumns(
        {"DayOfWeek": day_of_week(F.col(ts)), "HourOfDay": hour_of_day(F.col(ts))}
    )


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, non-null and missing cells. One pass over the data."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.col(c)).alias(f"filled_{i}") for i, c in enumerate(df.columns)],
    )
    per_column = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col("rows"),
                F.col(f"filled_{i}").alias("non_null"),
                (F.col("rows") - F.col(f"filled_{i}")).alias("missing"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counts.select(F.inline(per_column))


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, distinct customers."""
    filled = [F.count(F.col(c)) for c in df.columns]
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        (rows * len(df.columns) - sum(filled[1:], filled[0])).alias("missing_cells"),
        F.count_distinct("CustomerID").alias("customers"),
    )


def cleaning_report(raw: DataFrame, country: str | None = HOME_COUNTRY) -> DataFrame:
    """Rows before and after cleaning, from one pass over the raw lines."""
    keep = F.coalesce(keep_line(country), F.lit(False))
    before, after = F.count(F.lit(1)), F.count_if(keep)
    return raw.agg(
        before.alias("rows_before"),
        after.alias("rows_after"),
        (before - after).alias("rows_removed"),
        F.try_divide((before - after) * 100.0, before).alias("removed_pct"),
        F.count_distinct(F.when(keep, F.col("CustomerID"))).alias("customers"),
    )
