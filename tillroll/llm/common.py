"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import staging_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def id_remainder(name: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % divisor


def held_out(name: str, divisor: int, remainder: int) -> Column:
    """Whether a row belongs to the test fold; a row without an id does not."""
    return F.coalesce(id_remainder(name, divisor) == remainder, F.lit(False))


def most_frequent(df: DataFrame, count: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows with the largest count, ties by the hash of ``key``, largest first.

    Rows that cannot be among them are dropped behind an approximate quantile first, with room for
    its error, so that few more than ``k`` rows are sent on altogether and not ``k`` by each task.
    """
    order = F.col(count) + F.pmod(F.xxhash64(key), F.lit(1 << 20)) / float(1 << 20)
    ranked = df.withColumn("_order", order.cast("double"))
    total, accuracy = df.count(), 100_000
    if total > 2 * k:
        share = (k + 2 * total / accuracy) / total
        cut = ranked.select(F.percentile_approx("_order", max(0.0, 1 - share), accuracy)).first()[0]
        ranked = ranked.where(F.col("_order") >= cut)
    return ranked.orderBy(F.desc("_order"), key).limit(k).drop("_order")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; cuts the lineage."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps a Python worker for the tasks after this one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
