"""Reading and writing the pipeline's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import normalize_customer_id, parse_invoice_date
from tillroll.schema import CLEAN_TRANSACTIONS, CUSTOMER_FEATURES, RAW_TRANSACTIONS

# Quotes inside quoted fields are doubled in these exports.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


# Texts that mean "missing" in such exports.
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def _text_dates(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(f.name, T.StringType()) if isinstance(f.dataType, T.TimestampNTZType) else f
            for f in schema.fields
        ]
    )


def _parsed(text: Column, value: Column, name: str) -> Column:
    """``value``, or an error where a text that is not missing did not give one."""
    fault = F.concat(F.lit(f"{name} cannot be read: "), text)
    kind = "timestamp_ntz" if name == "InvoiceDate" else RAW_TRANSACTIONS[name].dataType
    return F.when(text.isNull() | value.isNotNull(), value).otherwise(
        F.raise_error(fault).cast(kind)
    )


def read_transactions(
    spark: SparkSession,
    path: str,
    missing_id: str = "drop",
    encoding: str = "ISO-8859-1",
    mode: str = "FAILFAST",
    multi_line: bool = False,
) -> DataFrame:
    """Raw invoice lines from CSV under the fixed schema, customer numbers normalised.

    Texts that mean "missing" are null in every column, numbers and dates included; any other
    number or date that cannot be read stops the read. ``multi_line`` admits line breaks inside
    quotes; files are then not split between tasks.
    """
    fields = RAW_TRANSACTIONS.fields
    raw = (
        spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in fields]))
        .options(**CSV_OPTIONS, encoding=encoding, mode=mode, multiLine=str(multi_line).lower())
        .csv(path)
    )
    columns = {}
    for f in fields:
        text = F.when(~F.col(f.name).isin(MISSING_TEXTS), F.col(f.name))
        if f.name == "CustomerID":
            columns[f.name] = normalize_customer_id(text, missing_id)
        elif isinstance(f.dataType, T.StringType):
            columns[f.name] = text
        elif isinstance(f.dataType, T.TimestampNTZType):
            columns[f.name] = _parsed(text, parse_invoice_date(text), f.name)
        else:
            columns[f.name] = _parsed(text, F.trim(text).try_cast(f.dataType), f.name)
    return raw.withColumns(columns)


def _write(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.options(**CSV_OPTIONS, timestampNTZFormat="yyyy-MM-dd HH:mm:ss").csv(path)
    else:
        raise ValueError(f"format must be 'parquet' or 'csv', not {fmt!r}")


def write_transactions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(df, path, fmt)


def read_clean_transactions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Cleaned lines, with the same types whichever format they were written in."""
    if fmt == "parquet":
        return spark.read.schema(CLEAN_TRANSACTIONS).parquet(path)
    text = spark.read.schema(_text_dates(CLEAN_TRANSACTIONS)).options(**CSV_OPTIONS).csv(path)
    return text.withColumn("InvoiceDate", parse_invoice_date(F.col("InvoiceDate")))


# The three feature tables of a run.
FEATURE_TABLES = (
    "customer_features",
    "customer_features_transformed",
    "customer_features_scaled",
)


def write_features(
    raw: DataFrame, transformed: DataFrame, scaled: DataFrame, folder: str, fmt: str = "parquet"
) -> None:
    for name, df in zip(FEATURE_TABLES, (raw, transformed, scaled)):
        _write(df, f"{folder}/{name}", fmt)


def read_features(spark: SparkSession, folder: str, table: str, fmt: str = "parquet") -> DataFrame:
    if table not in FEATURE_TABLES:
        raise ValueError(f"unknown feature table {table!r}")
    reader = spark.read.schema(CUSTOMER_FEATURES)
    path = f"{folder}/{table}"
    return reader.parquet(path) if fmt == "parquet" else reader.options(**CSV_OPTIONS).csv(path)


def write_clusters(labels: DataFrame, folder: str, fmt: str = "csv") -> None:
    """One sorted table per k. ``labels`` has columns k, CustomerID, Cluster."""
    ordered = labels.orderBy("k", "Cluster", "CustomerID")
    _partitioned = ordered.write.mode("overwrite").partitionBy("k")
    path = f"{folder}/customer_clusters"
    if fmt == "csv":
        _partitioned.options(**CSV_OPTIONS).csv(path)
    elif fmt == "parquet":
        _partitioned.parquet(path)
    else:
        raise ValueError(f"format must be 'parquet' or 'csv', not {fmt!r}")


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in a stated order; a DataFrame has none of its own."""
    return df.orderBy(*order).limit(n)
