"""Rendezvous hashing of record keys over weighted shards.

Every shard draws an exponential waiting time from the hash of (key, shard), divided by its
weight; the shortest wait owns the key. A shard wins a share of the keys in proportion to its
weight, and a new shard only takes keys for which its own wait is the shortest, so no key moves
between old shards.

Edge cases: rows with equal keys go to one shard; a null key is a key of its own; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbering works on (shard, bucket) groups, so that no task holds a whole shard.
SLOT_BUCKETS = 1024
#: Repeated rows are counted and unfolded in runs of this length.
UNFOLD = 65_536


def _draw(key: Column, number: Column) -> Column:
    """A double in (0, 1) that depends on the key and the shard number only."""
    bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), number), 11)
    return (bits.cast("double") + 0.5) / float(2**53)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The owner of a key among ``len(weights)`` shards; the smaller number on a tie."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    waits = F.transform(
        F.array(*[F.lit(float(w)) for w in weights]),
        lambda weight, i: F.struct((-F.log(_draw(key, i)) / weight).alias("wait"), i.alias("shard")),
    )
    return F.array_min(waits)["shard"]


def assign(
    df: DataFrame, key: str, weights: Sequence[float], out: str = "shard"
) -> DataFrame:
    """``df`` with the owner of each row's key; an older column of that name is replaced."""
    return df.withColumn(out, shard_of(F.col(key), weights))


def number_slots(df: DataFrame, shard: str, key: str, out: str = "slot") -> DataFrame:
    """``df`` with gapless numbers from 0 inside each shard.

    Within a shard rows are ordered by the key's bucket, the key and the other columns. Equal
    rows are counted before the shuffle and unfolded after it, so a key with a large share of
    all rows stays one group row. Counts per (shard, bucket) need only the key column; they are
    at most shards x SLOT_BUCKETS rows and are broadcast.
    """
    rest = [c for c in df.columns if c != out]
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(SLOT_BUCKETS)).cast("int")
    counts = df.groupBy(shard, bucket.alias("_bucket")).agg(F.count("*").alias("_in_bucket"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    first = counts.select(
        F.col(shard).alias("_shard"),
        F.col("_bucket").alias("_of"),
        F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_first"),
    )
    folded = df.groupBy(*rest).agg(F.count("*").alias("_times")).withColumn("_bucket", bucket)
    order = [F.col(key).asc_nulls_first(), *[F.col(c) for c in rest if c != key]]
    ahead = (
        Window.partitionBy(shard, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        folded.withColumn("_ahead", F.coalesce(F.sum("_times").over(ahead), F.lit(0)))
        .join(
            F.broadcast(first),
            (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_of")),
        )
        .withColumn("_run", F.explode(F.sequence(F.lit(0), F.col("_times") - 1, F.lit(UNFOLD))))
        .withColumn(
            "_copy",
            F.explode(
                F.sequence(F.col("_run"), F.least(F.col("_run") + UNFOLD, F.col("_times")) - 1)
            ),
        )
    )
    return placed.select(*rest, (F.col("_first") + F.col("_ahead") + F.col("_copy")).alias(out))
