"""Box-Cox fit and transform, and standardisation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import box_cox, box_cox_of_log
from tillroll.operators.quantiles import to_long
from tillroll.schema import FEATURES

SHIFT = 1.0

# Fixed value: spacing of doubles at 1.
EPSILON = 2.0**-52


def _phi(s: Column) -> tuple[Column, Column, Column]:
    """expm1(s)/s and its first two derivatives, with a Taylor form near 0."""
    e = F.exp(s)
    safe = F.when(F.abs(s) < 0.2, F.lit(1.0)).otherwise(s)
    direct0 = F.expm1(safe) / safe
    direct1 = (e - direct0) / safe
    direct2 = (e - 2 * direct1) / safe

    def taylor(order: int) -> Column:
        # The m-th derivative of sum s^k/(k+1)! is sum s^k / (k! (k+m+1)).
        terms = [1.0 / (math.factorial(k) * (k + order + 1)) for k in range(10)]
        out = F.lit(terms[-1])
        for c in reversed(terms[:-1]):
            out = out * s + c
        return out

    near = F.abs(s) < 0.2
    return tuple(
        F.when(near, taylor(i)).otherwise(d) for i, d in enumerate((direct0, direct1, direct2))
    )


@dataclass
class _Search:
    """Safeguarded Newton search for the minimum of log var(z) in one variable.

    ``scale`` is the natural size of the parameter, one over the spread of ln x.
    """

    scale: float
    lam: float = 0.0
    lo: float = -math.inf
    hi: float = math.inf
    done: bool = False

    def update(self, var: float, cov1: float, var1: float, cov2: float, tol: float) -> None:
        if var > 0 and all(map(math.isfinite, (var, cov1, var1, cov2))):
            slope = 2 * cov1 / var
            curve = 2 * (var1 + cov2) / var - slope * slope
        else:  # ran into overflow: go back towards the start
            slope, curve = math.copysign(1.0, self.lam), 0.0
        if slope > 0:
            self.hi = self.lam
        else:
            self.lo = self.lam
        reach = max(self.scale, abs(self.lam))
        step = -slope / curve if curve > 0 else -math.copysign(reach, slope)
        guess = self.lam + max(-reach, min(reach, step))
        if not self.lo <= guess <= self.hi:
            guess = (self.lo + self.hi) / 2
        # Close to the minimum the error after a step is of the order of the step squared.
        self.done = abs(guess - self.lam) <= math.sqrt(tol) * max(self.scale, abs(guess))
        self.lam = guess


class BoxCoxFit(dict[str, float | None]):
    """The parameter of each column; ``mean_log`` holds the mean of ln x for each of them."""

    def __init__(self, lambdas: dict[str, float | None], mean_log: dict[str, float]):
        super().__init__(lambdas)
        self.mean_log = mean_log


def fit_box_cox(
    features: DataFrame, columns: list[str] = FEATURES, tol: float = 1e-10, max_rounds: int = 60
) -> BoxCoxFit:
    """Maximum-likelihood Box-Cox parameter of ``x + 1`` for each column.

    With x divided by its geometric mean, the profile likelihood is -n/2 log var(z), so its
    slope and curvature follow from five moments of z and its derivatives. Each round is one
    aggregation over the data that returns those moments for every column; Newton's method
    needs about six rounds. ``features`` should be a stored table, it is read once a round.

    The parameter of a constant column does not exist and is None. Non-positive data fail.
    """
    logs = to_long(features, columns).filter(F.col("value").isNotNull()).select(
        "feature", (F.col("value") + SHIFT).alias("x")
    )
    log_x = F.log(F.when(F.col("x") > 0, F.col("x")))
    start = (
        logs.groupBy("feature")
        .agg(
            F.min("x").alias("low"),
            F.max("x").alias("high"),
            F.avg(log_x).alias("mean_log"),
            F.stddev_pop(log_x).alias("spread"),
        )
        .collect()
    )
    bad = sorted(r.feature for r in start if r.low <= 0)
    if bad:
        raise ValueError(f"Box-Cox needs positive data after the shift: {', '.join(bad)}")
    mean_log = {r.feature: r.mean_log for r in start}
    found = {r.feature: _Search(1.0 / r.spread) for r in start if r.low < r.high}

    def lookup(values: dict[str, float]) -> Column:
        parts = [F.lit(v) for item in values.items() for v in item]
        return F.try_element_at(F.create_map(*parts), F.col("feature"))

    u = F.col("u")
    p0, p1, p2 = _phi(F.col("lam") * u)
    z = [(u * p0).alias("z"), (u * u * p1).alias("z1"), (u * u * u * p2).alias("z2")]
    moments = [
        F.var_pop("z").alias("var"),
        F.covar_pop("z", "z1").alias("cov1"),
        F.var_pop("z1").alias("var1"),
        F.covar_pop("z", "z2").alias("cov2"),
    ]
    centred = logs.filter(F.col("feature").isin(list(found))).select(
        "feature", (F.log("x") - lookup(mean_log)).alias("u")
    )
    for _ in range(max_rounds):
        active = {f: s.lam for f, s in found.items() if not s.done}
        if not active:
            break
        lam = lookup(active)
        current = centred.select("feature", "u", lam.alias("lam")).filter("lam is not null")
        for r in current.select("feature", *z).groupBy("feature").agg(*moments).collect():
            found[r.feature].update(r["var"], r["cov1"], r["var1"], r["cov2"], tol)
    else:
        open_ = sorted(f for f, s in found.items() if not s.done)
        if open_:
            raise RuntimeError(f"Box-Cox search did not settle for {', '.join(open_)}")
    return BoxCoxFit({c: found[c].lam if c in found else None for c in columns}, mean_log)


def apply_box_cox(
    features: DataFrame, lambdas: dict[str, float | None], shift: float = SHIFT
) -> DataFrame:
    """Transform each named column of ``x + shift``; a column without parameter is unchanged.

    Fitted parameters are applied to x over its geometric mean. That changes a column by a factor
    and a constant only, so z-scores are the same, but a large parameter of a narrow column, for
    which x**lambda is 0 or infinite in every row, keeps the column's digits.
    """
    mean_log = lambdas.mean_log if isinstance(lambdas, BoxCoxFit) else {}

    def moved(name: str, lam: float) -> Column:
        x = F.col(name) + shift
        if name not in mean_log:
            return box_cox(x, lam)
        return box_cox_of_log(F.log(x) - F.lit(mean_log[name]), lam)

    return features.withColumns(
        {name: moved(name, lam) for name, lam in lambdas.items() if lam is not None}
    )


def box_cox_log_likelihood(
    features: DataFrame, grid: list[float], columns: list[str] = FEATURES, shift: float = SHIFT
) -> DataFrame:
    """Profile log-likelihood per feature and grid value: feature, lambda, loglik.

    Written with x over its geometric mean, where (lambda - 1) sum(ln x) - n/2 log var(y) is
    -sum(ln x) - n/2 log var(z); the plain form loses all digits for large x and negative
    lambda. There is one geometric mean per feature column.
    """
    logs = to_long(features, columns).filter(F.col("value").isNotNull()).select(
        "feature", F.log(F.col("value") + shift).alias("log_x")
    )
    means = logs.groupBy("feature").agg(F.avg("log_x").alias("mean_log"))
    lam = F.col("lambda")
    return (
        logs.join(F.broadcast(means), "feature")
        .withColumn("lambda", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
        .withColumn("z", box_cox(F.exp(F.col("log_x") - F.col("mean_log")), lam))
        .groupBy("feature", "lambda")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("log_x").alias("sum_log"),
            F.var_pop("z").alias("var"),
        )
        .select(
            "feature",
            "lambda",
            (-F.col("sum_log") - F.col("n") / 2 * F.log("var")).alias("loglik"),
        )
    )


def standardize(features: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """z-scores with the population standard deviation; a constant column becomes 0.

    A variance within rounding error of a constant column's counts as constant. The
    statistics are one row, taken as a scalar subquery.
    """
    stats = features.agg(_scale(columns)).scalar()
    others = [c for c in features.columns if c not in columns]
    with_stats = features.select(*features.columns, stats.alias("_stats"))
    z = {
        c: F.when(
            F.col(c).isNotNull(),
            (F.col(c) - F.col(f"_stats.{c}.mean")) / F.col(f"_stats.{c}.std"),
        )
        for c in columns
    }
    return with_stats.select(*others, *[z[c].alias(c) for c in columns])


def fit_scale(features: DataFrame, columns: list[str] = FEATURES) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation of each column, as ``standardize`` uses them."""
    row = features.agg(_scale(columns).alias("stats")).first().stats
    return {c: (row[c].mean, row[c].std) for c in columns}


def _scale(columns: list[str]) -> Column:
    """One struct with mean and std of each column."""

    def scale(c: str) -> Column:
        n, var = F.count(c).cast("double"), F.var_pop(c)
        noise = n * EPSILON * var + F.pow(n * EPSILON * F.avg(c), F.lit(2.0))
        return F.when(var <= noise, 1.0).otherwise(F.sqrt(var))

    return F.struct(
        *[F.struct(F.avg(c).alias("mean"), scale(c).alias("std")).alias(c) for c in columns]
    )
