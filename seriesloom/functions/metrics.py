"""Forecast metrics as aggregate columns over true values, predictions and weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.errors import TimeSeriesError
from seriesloom.series import Series, col, known

EPSILON = 1e-8


def _mean(e: Column, w: Column | None) -> Column:
    return F.avg(e) if w is None else F.try_divide(F.sum(w * e), F.sum(F.when(e.isNotNull(), w)))


def mae(y: Column, p: Column, w: Column | None = None) -> Column:
    return _mean(F.abs(y - p), w)


def rmse(y: Column, p: Column, w: Column | None = None) -> Column:
    return F.sqrt(_mean((y - p) * (y - p), w))


def mape(y: Column, p: Column, w: Column | None = None, epsilon: float = EPSILON) -> Column:
    """As a fraction; small true values count as epsilon."""
    return _mean(F.abs(y - p) / F.greatest(F.abs(y), F.lit(epsilon)), w)


def smape(y: Column, p: Column, w: Column | None = None, symmetric: bool = True) -> Column:
    return _mean(F.abs(y - p) / F.greatest(F.abs(y) + F.abs(p), F.lit(EPSILON)), w) * (1 if symmetric else 2)


def r2(y: Column, p: Column, w: Column | None = None) -> Column:
    """0 where the true values do not vary."""
    both = y.isNotNull() & p.isNotNull()
    w = F.lit(1.0) if w is None else w
    y, p, w = F.when(both, y), F.when(both, p), F.when(both, w)
    n, s = F.sum(w), F.sum(w * y)
    spread = F.sum(w * y * y) - s * F.try_divide(s, n)
    return F.when(F.try_divide(spread, n) < EPSILON, 0.0).otherwise(1 - F.try_divide(F.sum(w * (y - p) * (y - p)), spread))


def peak_error(y: Column, p: Column) -> Column:
    """Mean error as a percentage of the highest true value."""
    return 100 * F.try_divide(F.avg(F.abs(y - p)), F.max(y))


def normalized_mae(y: Column, p: Column, by: str = "std") -> Column:
    """MAE over the standard deviation, the range or the mean of the true values; as it is where that is 0."""
    of = {"std": F.stddev_pop(y), "range": F.max(y) - F.min(y), "mean": F.abs(F.avg(y))}
    if by not in of:
        raise TimeSeriesError(f"unknown norm {by}")
    return F.coalesce(F.try_divide(F.avg(F.abs(y - p)), F.when(of[by] > EPSILON, of[by])), F.avg(F.abs(y - p)))


def mase(df: DataFrame, series: Series, y: str, p: str, seasonality: int = 1, train: DataFrame | None = None) -> DataFrame:
    """One row for each key. Scaled by the seasonal differences within df, or by a forecast that repeats the last season of train."""
    wide = df.select(*series.keys(), *map(col, series.order), known(col(y)).alias("__y"), known(col(p)).alias("__p"))
    if train is None:
        wide = wide.withColumn("__n", F.lag("__y", seasonality).over(series.rows()))
    else:
        back = Series(series.order, series.key)
        last = train.withColumn("__r", F.count("*").over(series.whole()) - back.position()).where(F.col("__r") < seasonality)
        last = last.groupBy(*series.keys()).agg(F.array_sort(F.collect_list(F.struct((-F.col("__r")).alias("r"), known(col(y)).alias("v")))).alias("__season"))
        wide = wide.withColumn("__at", series.position() - 1)
        if series.key:
            wide = wide.join(last, list(series.key))
        else:
            season = last.head()["__season"]
            wide = wide.withColumn("__season", F.array(*[F.struct(F.lit(x["v"]).alias("v")) for x in season]))
        wide = wide.withColumn("__n", F.get("__season", (F.col("__at") % F.size("__season")).cast("int"))["v"])
    e, naive = F.avg(F.abs(F.col("__y") - F.col("__p"))), F.avg(F.abs(F.col("__y") - F.col("__n")))
    return wide.groupBy(*series.keys()).agg((e / F.greatest(naive, F.lit(EPSILON))).alias("mase"))


def directional_accuracy(df: DataFrame, series: Series, y: str, p: str, threshold: float = 0.0) -> DataFrame:
    """The share of steps whose true and predicted change have one sign, or, with a threshold, are both as large."""
    w = series.rows()
    wide = df.select(*series.keys(), (known(col(y)) - F.lag(known(col(y))).over(w)).alias("a"), (known(col(p)) - F.lag(known(col(p))).over(w)).alias("b"))
    right = F.signum("a") == F.signum("b")
    if threshold > 0:
        right = right & (F.abs("a") >= threshold) & (F.abs("b") >= threshold)
    return wide.where("a is not null and b is not null").groupBy(*series.keys()).agg(F.avg(right.cast("double")).alias("directional_accuracy"))


def recency_weights(df: DataFrame, series: Series, decay: float = 0.99, recent: float = 1.0, name: str = "weight") -> DataFrame:
    """Weights decay ** age, the last one times `recent`, that sum to 1 in each series."""
    wide = df.withColumn("__age", F.count("*").over(series.whole()) - series.position())
    wide = wide.withColumn("__w", F.pow(F.lit(decay), F.col("__age")) * F.when(F.col("__age") == 0, recent).otherwise(1.0))
    return wide.withColumn(name, F.col("__w") / F.sum("__w").over(series.whole())).drop("__age", "__w")


def area_under_curve(df: DataFrame, horizon: str, error: str, key: tuple[str, ...] = ()) -> DataFrame:
    """Trapezoids of error over horizon / longest horizon."""
    s = Series((horizon,), key)
    h = col(horizon) / F.max(col(horizon)).over(s.whole())
    wide = df.withColumn("__h", h)
    step = (F.col("__h") - F.lag("__h").over(s.rows())) * (col(error) + F.lag(col(error)).over(s.rows())) / 2
    return wide.withColumn("__a", step).groupBy(*s.keys()).agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias("auc"))


SCORERS: dict[str, tuple[Callable[..., Column], bool]] = {
    "mae": (mae, False), "rmse": (rmse, False), "mape": (mape, False), "smape": (smape, False), "r2": (r2, True),
    "neg_mean_absolute_error": (lambda y, p: -mae(y, p), True), "neg_mae": (lambda y, p: -mae(y, p), True), "neg_rmse": (lambda y, p: -rmse(y, p), True), "neg_mape": (lambda y, p: -mape(y, p), True), "neg_smape": (lambda y, p: -smape(y, p), True),
}


#: Metrics that need the order of rows, and so a frame and its series.
SERIES_SCORERS: dict[str, tuple[Callable[..., DataFrame], bool]] = {"mase": (mase, False), "directional_accuracy": (directional_accuracy, True)}


def get_scorer(name: str) -> tuple[Callable, bool]:
    """A metric, and whether more of it is better: over columns (y, p), or for SERIES_SCORERS over a frame (df, series, y, p)."""
    known_ = SCORERS | SERIES_SCORERS
    if name not in known_:
        raise TimeSeriesError(f"unknown scorer {name}; known: {sorted(known_)}")
    return known_[name]
