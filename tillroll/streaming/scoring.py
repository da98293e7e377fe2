"""Segments of customers kept up to date while lines arrive as files.

A saved ``SegmentModel`` turns features into cluster numbers row by row. ``follow`` reads new files
with Structured Streaming; each micro-batch is merged into the feature state, and the customers that
it touched are scored again. Both writes are keyed by the batch's number, so a batch that is replayed
after a failure leaves the same files.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillroll.operators import transforms
from tillroll.operators.clustering import KMeansFit
from tillroll.schema import CLEAN_TRANSACTIONS
from tillroll.streaming.feature_state import FeatureState

# The centers are literals of one expression.
MAX_CELLS = 20_000


@dataclass
class SegmentModel:
    """Box-Cox parameters, scales and centers, in the order of ``columns``; clusters by position."""

    columns: list[str]
    lambdas: dict[str, float | None]
    mean_log: dict[str, float]
    scale: dict[str, tuple[float, float]]
    centers: list[list[float]]

    @classmethod
    def of(cls, boxcox: dict, scale: dict, fit: KMeansFit) -> SegmentModel:
        """The model of fitted parts; ``boxcox`` may be given parameters or a ``BoxCoxFit``."""
        centers = [None] * fit.k
        for raw, center in enumerate(fit.model.clusterCenters()):
            centers[fit.number[raw]] = [float(x) for x in center]
        return cls(list(fit.columns), dict(boxcox), dict(getattr(boxcox, "mean_log", {})), scale, centers)

    def scaled(self, features: DataFrame) -> DataFrame:
        lambdas = self.lambdas
        if self.mean_log:
            lambdas = transforms.BoxCoxFit(lambdas, self.mean_log)
        moved = transforms.apply_box_cox(features, lambdas)
        return moved.withColumns(
            {c: (F.col(c) - mean) / std for c, (mean, std) in self.scale.items()}
        )

    def score(self, features: DataFrame) -> DataFrame:
        """CustomerID, Cluster, distance_sq: the nearest center, the smaller number on a tie."""
        if len(self.centers) * len(self.columns) > MAX_CELLS:
            raise ValueError("too many center cells for one expression")
        gaps = []
        for number, center in enumerate(self.centers):
            squares = [(F.col(c) - x) * (F.col(c) - x) for c, x in zip(self.columns, center)]
            total = squares[0]
            for square in squares[1:]:
                total = total + square
            gaps.append(F.struct(total.alias("distance_sq"), F.lit(number).alias("Cluster")))
        nearest = F.array_min(F.array(*gaps)).alias("nearest")
        found = self.scaled(features).select("CustomerID", nearest)
        return found.select("CustomerID", "nearest.Cluster", "nearest.distance_sq")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SegmentModel:
        held = json.loads(spark.read.text(path, wholetext=True).first().value)
        return cls(**held | {"scale": {c: tuple(v) for c, v in held["scale"].items()}})


def score_batch(lines: DataFrame, batch: int, state: FeatureState, model: SegmentModel, out: str) -> None:
    """Merge cleaned lines and score the customers that they touch; a replay writes the same rows."""
    customers = lines.where("CustomerID is not null").select("CustomerID").distinct()
    if not state.merge(lines, batch):
        # Committed before: the state may be ahead by now, the labels of later batches stand.
        if state.commits()[-1] > batch:
            return
    labels = model.score(state.features(customers))
    labels.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def follow(
    spark: SparkSession,
    source: str,
    state: FeatureState,
    model_path: str,
    out: str,
    checkpoint: str,
    clean=None,
    schema=CLEAN_TRANSACTIONS,
    files_per_batch: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Start scoring the Parquet files that arrive in ``source``.

    ``clean`` is applied to every batch, ``trigger`` goes to the query's trigger (``availableNow=True``
    takes what is there and ends). The model is read anew for each batch, so a new fit takes effect.
    """

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # merged and scored from one reading
        try:
            lines = clean(held) if clean else held
            score_batch(lines, number, state, SegmentModel.load(spark, model_path), out)
        finally:
            held.unpersist()

    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return (
        stream.parquet(source)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_labels(spark: SparkSession, out: str) -> DataFrame:
    """CustomerID, Cluster, distance_sq of each customer's newest batch."""
    table = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    newest = F.max(F.struct(F.col("batch").cast("bigint"), "Cluster", "distance_sq")).alias("newest")
    return table.groupBy("CustomerID").agg(newest).select(
        "CustomerID", "newest.Cluster", "newest.distance_sq"
    )
