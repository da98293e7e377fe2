"""The given order tables in the shape of retail invoice lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.schema import RAW_TRANSACTIONS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(
    spark: SparkSession, sf_dir: str, columns: list[str] | None = None
) -> DataFrame:
    """Invoice lines; only the tables that the wanted columns need are joined.

    Returned lines count as cancelled. The unit price is the line's price per piece in whole
    pence, so every price is exact in both engines.
    """
    wanted = columns or RAW_TRANSACTIONS.fieldNames()
    lines = table(spark, sf_dir, "lineitem")
    if {"InvoiceDate", "CustomerID", "Country"} & set(wanted):
        orders = table(spark, sf_dir, "orders")
        lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    if "Country" in wanted:
        customer = table(spark, sf_dir, "customer")
        nation = table(spark, sf_dir, "nation")
        homes = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        lines = lines.join(homes, lines.o_custkey == homes.c_custkey)
    if "Description" in wanted:
        part = table(spark, sf_dir, "part")
        lines = lines.join(part, lines.l_partkey == part.p_partkey)
    pence = F.round(F.col("l_extendedprice") * 100)
    shape = {
        "InvoiceNo": lambda: F.concat(
            F.when(F.col("l_returnflag") == "R", "C").otherwise(""),
            F.col("l_orderkey").cast("string"),
        ),
        "StockCode": lambda: F.col("l_partkey").cast("string"),
        "Description": lambda: F.col("p_name"),
        "Quantity": lambda: F.col("l_quantity").cast("bigint"),
        "InvoiceDate": lambda: F.col("o_orderdate"),
        "UnitPrice": lambda: F.floor(pence / F.col("l_quantity")) / 100,
        "CustomerID": lambda: F.col("o_custkey").cast("string"),
        "Country": lambda: F.col("n_name"),
    }
    return lines.select(*[shape[c]().alias(c) for c in wanted])
