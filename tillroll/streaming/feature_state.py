"""The sums behind the features as a stored state that batches of lines are merged into.

The state holds ``features.partial_sums`` in buckets of customers. A batch is summed, and only the
buckets that it touches are read, added to and written anew, under the batch's number; lines that
were merged before are never read again. A table of the bucket versions is written last: it is the
commit, and readers follow the newest one. So a batch that failed half-way leaves nothing behind
that is read, a batch that is replayed after its commit changes nothing, and late lines of an old
invoice just add to its sums.

Batch numbers must rise, as those of a streaming query do; there is one writer. Versions that no
commit needs any more can be removed by ``vacuum``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.features import PAIR, SUMS, features_of_sums, partial_sums

BUCKETS = 64
#: A bucket is written by so many tasks, as one customer can hold a third of all pairs.
WRITERS = 4
#: More tasks write a bucket when a task would hold more pairs than this, old and new ones together.
WRITER_ROWS = 500_000

_SCHEMA = (
    "CustomerID string, is_invoice tinyint, InvoiceNo string, StockCode string, lines bigint,"
    " quantity bigint, price double, prices bigint, total double, totals bigint, bucket int"
)


class FeatureState:
    """The state in ``folder``; the number of buckets is fixed by the first batch."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # ---- commits

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def commits(self) -> list[int]:
        """Numbers of the committed batches that are kept, the newest last."""
        path = self._path("commits")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [s.getPath() for s in files.listStatus(path)]
        done = [p for p in names if files.exists(self._path(f"commits/{p.getName()}/_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("batch=")) for p in done)

    def versions(self) -> dict[int, int]:
        """The batch that wrote each bucket last; at most ``buckets`` entries."""
        done = self.commits()
        if not done:
            return {}
        table = self.spark.read.schema("bucket int, version bigint, buckets int").parquet(
            f"{self.folder}/commits/batch={done[-1]}"
        )
        rows = table.collect()
        if any(r.buckets != self.buckets for r in rows):
            raise ValueError(f"the state has {rows[0].buckets} buckets, not {self.buckets}")
        return {r.bucket: r.version for r in rows}

    # ---- reading

    def sums(self, buckets: list[int] | None = None) -> DataFrame:
        """The merged sums of all customers, or of those in the given buckets."""
        known = self.versions()
        paths = [
            f"{self.folder}/sums/version={version}/bucket={bucket}"
            for bucket, version in sorted(known.items())
            if buckets is None or bucket in buckets
        ]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA).drop("bucket")
        schema = _SCHEMA.rsplit(",", 1)[0]
        return self.spark.read.schema(schema).parquet(*paths)

    def features(self, customers: DataFrame | None = None) -> DataFrame:
        """``customer_features`` of all lines so far, or of the customers in a table (CustomerID).

        For some customers only their buckets are read.
        """
        if customers is None:
            return features_of_sums(self.sums())
        wanted = customers.select("CustomerID").distinct()
        touched = [r.bucket for r in wanted.select(self.bucket().alias("bucket")).distinct().collect()]
        # Summed up first, so that a row per customer and writer is shuffled and not every pair.
        return features_of_sums(self.sums(touched)).join(wanted, "CustomerID", "left_semi")

    def bucket(self):
        return F.pmod(F.xxhash64("CustomerID"), F.lit(self.buckets)).cast("int")

    # ---- writing

    def merge(self, clean: DataFrame, batch: int) -> bool:
        """Add a batch of cleaned lines; False if that batch was committed before."""
        known, done = self.versions(), self.commits()
        if done and batch <= done[-1]:
            return False
        fresh = partial_sums(clean).withColumn("bucket", self.bucket())
        path = f"{self.folder}/incoming/batch={batch}"
        fresh.write.mode("overwrite").parquet(path)
        fresh = self.spark.read.schema(_SCHEMA).parquet(path)
        counted = fresh.groupBy("bucket").count().collect()
        touched = sorted(r.bucket for r in counted)
        old = self.sums(touched).withColumn("bucket", self.bucket())
        rows = old.count() + sum(r["count"] for r in counted)
        writers = max(WRITERS, math.ceil(rows / (WRITER_ROWS * max(1, len(touched)))))
        merged = self._added(old, fresh, writers, max(1, min(writers * len(touched), 4096)))
        target = f"{self.folder}/sums/version={batch}"
        merged.write.mode("overwrite").partitionBy("bucket").parquet(target)
        now = known | dict.fromkeys(touched, batch)
        rows = [(bucket, version, self.buckets) for bucket, version in sorted(now.items())]
        table = self.spark.createDataFrame(rows, "bucket int, version bigint, buckets int")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch={batch}")
        return True

    @staticmethod
    def _added(old: DataFrame, fresh: DataFrame, writers: int, parts: int) -> DataFrame:
        """The sums of both, dealt once to the tasks that write them.

        The writer is a key, so the sums need no shuffle of their own.
        """
        writer = F.pmod(F.xxhash64("InvoiceNo", "StockCode"), F.lit(writers)).cast("int")
        dealt = old.unionByName(fresh).withColumn("writer", writer)
        dealt = dealt.repartition(parts, "bucket", "writer")
        merged = dealt.groupBy("bucket", "writer", *PAIR).agg(*[F.sum(c).alias(c) for c in SUMS])
        return merged.drop("writer")

    def vacuum(self) -> int:
        """Remove what the newest commit does not need; returns the number of removed folders."""
        done = self.commits()
        if not done:
            return 0
        needed = set(self.versions().values())
        configuration, removed = self.spark._jsc.hadoopConfiguration(), 0
        for name, kept in (("sums", needed), ("incoming", set()), ("commits", {done[-1]})):
            path = self._path(name)
            files = path.getFileSystem(configuration)
            for status in files.listStatus(path) if files.exists(path) else []:
                number = status.getPath().getName().partition("=")[2]
                # A newer number belongs to a batch that is being written.
                if number.isdigit() and int(number) not in kept and int(number) <= done[-1]:
                    removed += files.delete(status.getPath(), True)
        return removed
