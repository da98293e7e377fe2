"""Principal components of the scaled features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.schema import FEATURES


def with_vector(df: DataFrame, columns: list[str] = FEATURES, name: str = "vector") -> DataFrame:
    """Add the named columns as one ML vector."""
    return VectorAssembler(inputCols=columns, outputCol=name).transform(df)


@dataclass
class PcaFit:
    model: PCAModel
    signs: list[float]
    columns: list[str]
    means: list[float]

    @property
    def names(self) -> list[str]:
        return [f"PC{i + 1}" for i in range(len(self.signs))]

    def scores(self, scaled: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """CustomerID (or ``keep``) and PC1 ... PCn."""
        pc = _scores(self.model, scaled, self.columns, self.means)
        return pc.select(
            *(keep or ["CustomerID"]),
            *[(F.col("pc")[i] * s).alias(n) for i, (n, s) in enumerate(zip(self.names, self.signs))],
        )

    def variance(self, spark) -> DataFrame:
        """Explained share per component with its running total and the 80 % and 90 % marks."""
        rows = [(i + 1, float(r)) for i, r in enumerate(self.model.explainedVariance)]
        running = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
        return (
            spark.createDataFrame(rows, "component int, ratio double")
            .withColumn("cumulative", F.sum("ratio").over(running))
            .withColumn("reaches_80", F.col("cumulative") >= 0.8)
            .withColumn("reaches_90", F.col("cumulative") >= 0.9)
        )


def _centred(df: DataFrame, columns: list[str], means: list[float]) -> DataFrame:
    """Spark's model projects without centring, so the means are taken off first."""
    shifted = F.array(*[F.col(c) - F.lit(m) for c, m in zip(columns, means)])
    return df.withColumn("vector", array_to_vector(shifted))


def _scores(model: PCAModel, df: DataFrame, columns: list[str], means: list[float]) -> DataFrame:
    return model.transform(_centred(df, columns, means)).withColumn("pc", vector_to_array("pc"))


def fit_pca(
    scaled: DataFrame, n_components: int | None = None, columns: list[str] = FEATURES
) -> PcaFit:
    """Fit; each component is turned so that its score of largest size is positive."""
    first = scaled.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns]).first()
    rows, means = first[0], [float(m) for m in first[1:]]
    k = n_components or min(len(columns), rows)
    model = PCA(k=k, inputCol="vector", outputCol="pc").fit(_centred(scaled, columns, means))
    pc = _scores(model, scaled, columns, means)
    extreme = pc.agg(*[F.max_by(F.col("pc")[i], F.abs(F.col("pc")[i])) for i in range(k)]).first()
    return PcaFit(model, [-1.0 if v < 0 else 1.0 for v in extreme], columns, means)
