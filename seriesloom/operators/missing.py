"""Filling, normalising, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.errors import TimeSeriesError
from seriesloom.functions.rolling import FLAT
from seriesloom.series import Series, col, known

FILLS = ("linear", "time", "ffill", "bfill", "seasonal")


def _seconds(ts: str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp")) / 1e6


def _between(x: Column, at: Column, series: Series) -> Column:
    """x, or its interpolation by `at` between the nearest known values; at the ends the nearest one."""
    before, after = series.before(), series.after()
    here = F.when(x.isNotNull(), at)
    v0, t0 = F.last(x, True).over(before), F.last(here, True).over(before)
    v1, t1 = F.first(x, True).over(after), F.first(here, True).over(after)
    return F.coalesce(x, v0 + (v1 - v0) * F.try_divide(at - t0, t1 - t0), v0, v1)


def fill_missing_temporal(df: DataFrame, series: Series, value: str, method: str = "linear", max_gap: int | None = None, period: int | None = None, name: str | None = None) -> DataFrame:
    """df with `value` filled (or a column `name`).

    linear: by position, both ways; time: by the first order column's time; ffill, bfill: the last or next known value;
    seasonal: the mean of the known values one and two periods before and after, else linear. Gaps longer than max_gap
    rows stay.
    """
    if method not in FILLS:
        raise TimeSeriesError(f"unknown method {method}; known: {FILLS}")
    wide = df.withColumn("__x", known(col(value))).withColumn("__p", series.position().cast("double"))
    x, w = F.col("__x"), series.rows()
    linear = _between(x, F.col("__p"), series)
    if method == "linear":
        filled = linear
    elif method == "time":
        wide = wide.withColumn("__s", _seconds(series.order[0]))
        filled = _between(x, F.col("__s"), series)
    elif method == "ffill":
        filled = F.last(x, True).over(series.before())
    elif method == "bfill":
        filled = F.first(x, True).over(series.after())
    else:
        if not period or period < 2:
            filled = linear
        else:
            near = F.filter(F.array(*[f(x, k * period).over(w) for f in (F.lag, F.lead) for k in (1, 2)]), lambda v: v.isNotNull())
            filled = F.coalesce(x, F.try_divide(F.aggregate(near, F.lit(0.0), lambda s, v: s + v), F.size(near)), linear)
    wide = wide.withColumn("__f", filled)
    if max_gap is not None:
        wide = wide.withColumn("__run", F.count("__x").over(series.before()))
        size = F.count(F.when(x.isNull(), 1)).over(series.whole().partitionBy(*series.keys(), F.col("__run")))
        wide = wide.withColumn("__f", F.when(x.isNotNull() | (size <= max_gap), F.col("__f")))
    return wide.withColumn(name or value, F.col("__f")).drop("__x", "__p", "__s", "__f", "__run")


def fill_for_features(df: DataFrame, series: Series, value: str, fill_method: str = "linear") -> DataFrame:
    """As the meta-features want it: linear, forward, backward or none, then the series' mean for what is left."""
    methods = {"linear": "linear", "forward": "ffill", "backward": "bfill", "none": None}
    if fill_method not in methods:
        raise TimeSeriesError(f"unknown fill_method {fill_method}")
    out = fill_missing_temporal(df, series, value, methods[fill_method]) if methods[fill_method] else df
    x = known(col(value))
    return out.withColumn(value, F.coalesce(x, F.avg(x).over(series.whole())))


def normalize_series(df: DataFrame, series: Series, value: str, method: str = "zscore", window_size: int | None = None, name: str | None = None) -> DataFrame:
    """zscore, minmax, robust or log; with a window, the first two by trailing full windows, whose first window_size rows share its first frame."""
    x, out = known(col(value)), name or value
    if method not in ("zscore", "minmax", "robust", "log"):
        raise TimeSeriesError(f"unknown method {method}")
    if window_size:
        if method not in ("zscore", "minmax"):
            raise TimeSeriesError("a window goes with zscore and minmax only")
        wide = df.withColumn("__x", x).withColumn("__p", series.position())
        x, head = F.col("__x"), F.when(F.col("__p") <= window_size, F.col("__x"))
        full, whole = series.trailing(window_size), series.whole()
        pick = lambda f: F.when(F.col("__p") > window_size, f(x).over(full)).otherwise(f(head).over(whole))
        if method == "zscore":
            e = (x - pick(F.avg)) / (pick(F.stddev_samp) + FLAT)
        else:
            e = (x - pick(F.min)) / (pick(F.max) - pick(F.min) + FLAT)
        return wide.withColumn(out, e).drop("__x", "__p")
    if method == "log":
        return df.withColumn(out, F.when(x < 0, F.raise_error(F.lit("log of a negative value"))).otherwise(F.log1p(x)))
    w = series.whole()
    if method == "zscore":
        return df.withColumn(out, (x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + FLAT))
    if method == "minmax":
        lo = F.min(x).over(w)
        return df.withColumn(out, (x - lo) / (F.max(x).over(w) - lo + FLAT))
    wide = df.withColumn("__q", F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w))
    q = lambda i: F.get("__q", F.lit(i))
    return wide.withColumn(out, (x - q(1)) / (q(2) - q(0) + FLAT)).drop("__q")


def resample_time_series(df: DataFrame, series: Series, value: str, freq: str, method: str = "mean", fill: str | None = None) -> DataFrame:
    """One row for each period of `freq` (such as '1 hour') from the first to the last of a series, empty ones too.

    method: mean, sum (0 for an empty period), median, first, last; fill: ffill, bfill, interpolate (by time) or none.
    """
    ts = series.order[0]
    x = known(col(value))
    by = F.struct(*map(col, series.order))
    aggregates = {"mean": F.avg(x), "sum": F.sum(x), "median": F.median(x), "first": F.min_by(x, F.when(x.isNotNull(), by)), "last": F.max_by(x, F.when(x.isNotNull(), by))}
    if method not in aggregates:
        raise TimeSeriesError(f"unknown method {method}")
    bins = df.groupBy(*series.keys(), F.window(col(ts), freq).alias("__w")).agg(aggregates[method].alias(value)).withColumn(ts, F.col("__w.start")).drop("__w")
    ends = bins.groupBy(*series.keys()).agg(F.min(ts).alias("__a"), F.max(ts).alias("__b"))
    spine = ends.withColumn(ts, F.explode(F.sequence("__a", "__b", F.expr(f"interval {freq}")))).drop("__a", "__b")
    out = spine.join(bins, [*series.key, ts], "left") if series.key else spine.join(bins, ts, "left")
    if method == "sum":
        out = out.withColumn(value, F.coalesce(col(value), F.lit(0.0)))
    periods = Series((ts,), series.key)
    kind = {"ffill": "ffill", "bfill": "bfill", "interpolate": "time"}
    if fill is not None and fill not in kind:
        raise TimeSeriesError(f"unknown fill {fill}")
    return fill_missing_temporal(out, periods, value, kind[fill]) if fill else out
