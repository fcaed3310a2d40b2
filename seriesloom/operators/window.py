"""Lags and statistics of row windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.errors import TimeSeriesError
from seriesloom.functions.rolling import items, statistic
from seriesloom.operators.base import TimeSeriesTransformer
from seriesloom.series import Series, col, known

TRANSFORMATIONS = ("identity", "diff", "pct_change", "sma")
STATISTICS = ("mean", "std", "min", "max", "slope", "acf1", "skewness", "kurtosis")
#: What compute_rolling_statistics gives by default.
ROLLING = ("mean", "std", "min", "max", "median", "skew", "kurt", "slope")


class LagTransformer(TimeSeriesTransformer):
    """Each value column shifted by each lag: {column}_lag_{k}; the head of a series is NULL."""

    def __init__(self, lags: list[int]):
        if not lags or any(not isinstance(k, int) or isinstance(k, bool) or k <= 0 for k in lags):
            raise TimeSeriesError("lags must be positive integers")
        self.lags = sorted(set(lags))

    def _fit(self, df: DataFrame, target: str | None) -> None:
        longest = df.groupBy(*self.series.keys()).count().agg(F.max("count")).head()[0] or 0
        if max(self.lags) >= longest:
            raise TimeSeriesError(f"lag {max(self.lags)} is not shorter than any series ({longest} rows)")

    def get_feature_names_out(self) -> list[str]:
        return [f"{c}_lag_{k}" for c in self.feature_names_in_ for k in self.lags]

    def add(self, df: DataFrame) -> DataFrame:
        w = self._ready().rows()
        return df.withColumns({f"{c}_lag_{k}": F.lag(known(col(c)), k).over(w) for c in self.feature_names_in_ for k in self.lags})


class WindowTransformer(TimeSeriesTransformer):
    """Statistics of trailing windows over transformed columns ({column}.{transformation}.{statistic}), and lags ({column}.lag_{k})."""

    def __init__(self, window_size: int, transformations: list[str] | None = None, statistics: list[str] | None = None, min_periods: int = 1):
        self.window_size, self.min_periods = window_size, min_periods
        self.transformations = list(transformations or ["identity"])
        self.statistics = list(statistics or ["mean", "std"])
        if not isinstance(window_size, int) or window_size < 2:
            raise TimeSeriesError("window_size must be an integer of 2 or more")
        if not 1 <= min_periods <= window_size:
            raise TimeSeriesError("min_periods must be between 1 and window_size")
        if unknown := [t for t in self.transformations if t not in TRANSFORMATIONS]:
            raise TimeSeriesError(f"unknown transformations {unknown}")
        if unknown := [s for s in self.statistics if s not in STATISTICS and not re.fullmatch(r"lag_[1-9]\d*", s)]:
            raise TimeSeriesError(f"unknown statistics {unknown}")

    def _fit(self, df: DataFrame, target: str | None) -> None:
        longest = df.groupBy(*self.series.keys()).count().agg(F.max("count")).head()[0] or 0
        if self.window_size >= longest:
            raise TimeSeriesError(f"window {self.window_size} is not shorter than any series ({longest} rows)")

    def _lags(self) -> list[int]:
        return sorted({int(s[4:]) for s in self.statistics if s.startswith("lag_")})

    def get_feature_names_out(self) -> list[str]:
        stats = [s for s in self.statistics if not s.startswith("lag_")]
        return [n for c in self.feature_names_in_ for n in [*(f"{c}.{t}.{s}" for t in self.transformations for s in stats), *(f"{c}.lag_{k}" for k in self._lags())]]

    def add(self, df: DataFrame) -> DataFrame:
        series = self._ready()
        w, frame = series.rows(), series.trailing(self.window_size)
        inputs: dict[str, Column] = {"__position": series.position()}
        for c in self.feature_names_in_:
            x = known(col(c))
            inputs[f"__{c}.identity"] = x
            inputs[f"__{c}.diff"] = x - F.lag(x).over(w)
            if "pct_change" in self.transformations:
                inputs[f"__{c}.filled"] = F.last(x, True).over(series.before())
            if "sma" in self.transformations:
                inputs[f"__{c}.sma"] = statistic("mean", x, F.lit(0), frame, self.min_periods)
        wide = df.withColumns(inputs)
        if "pct_change" in self.transformations:
            wide = wide.withColumns({f"__{c}.pct_change": F.try_divide(col(f"__{c}.filled"), F.lag(col(f"__{c}.filled")).over(w)) - 1 for c in self.feature_names_in_})
        out = {}
        for name in self.get_feature_names_out():
            c, rest = next((c, name[len(c) + 1 :]) for c in sorted(self.feature_names_in_, key=len, reverse=True) if name.startswith(f"{c}."))
            if rest.startswith("lag_"):
                out[name] = F.lag(known(col(c)), int(rest[4:])).over(w)
            else:
                t, s = rest.split(".")
                out[name] = statistic(s, col(f"__{c}.{t}"), col("__position"), frame, self.min_periods)
        return wide.withColumns(out).drop(*[c for c in wide.columns if c not in df.columns])


def create_sliding_windows(df: DataFrame, series: Series, value: str, window_size: int, stride: int = 1, drop_incomplete: bool = True) -> DataFrame:
    """Key, order and `window`, the array of the next window_size values (NULL elements kept), from every stride-th row.

    A series with no full window gives nothing, or one short window of all its rows where incomplete ones are wanted.
    """
    if window_size < 1 or stride < 1:
        raise TimeSeriesError("window_size and stride must be positive")
    ahead = series.rows().rowsBetween(0, window_size - 1)
    wide = df.withColumns({"__at": series.position(), "__n": F.count("*").over(series.whole()), "window": F.transform(items(F.struct(known(col(value)).alias("v")), ahead), lambda s: s["v"])})
    full = (F.size("window") == window_size) & ((F.col("__at") - 1) % stride == 0)
    short = F.lit(not drop_incomplete) & (F.col("__n") < window_size) & (F.col("__at") == 1)
    return wide.where(full | short).select(*series.keys(), *map(col, series.order), "window")


def compute_rolling_statistics(df: DataFrame, series: Series, value: str, window_size: int, statistics: list[str] | None = None, center: bool = False, min_periods: int | None = None) -> DataFrame:
    """Key, order and {value}.{statistic}: of trailing windows, or, for mean, std, min, max, median and sum, centred ones."""
    names = list(statistics or ROLLING)
    least = max(1, window_size // 4) if min_periods is None else min_periods
    x = known(col(value))
    wide = df.withColumn("__position", series.position()).withColumn("__x", x)
    # slopes here are over the values that are there, one after the other
    wide = wide.withColumn("__dense", F.count("__x").over(series.before()))
    out = {}
    for s in names:
        centred = center and s in ("mean", "std", "min", "max", "median", "sum")
        frame = series.centered(window_size) if centred else series.trailing(window_size)
        name = "acf1_ratio" if s == "acf1" else s
        out[f"{value}.{s}"] = statistic(name, F.col("__x"), F.col("__dense"), frame, least)
    return wide.withColumns(out).select(*series.keys(), *map(col, series.order), *[col(n) for n in out])


def create_lagged_features(df: DataFrame, series: Series, lags: list[int], columns: list[str] | None = None, drop_original: bool = False) -> DataFrame:
    if not lags or any(k <= 0 for k in lags):
        raise TimeSeriesError("lags must be positive")
    names = series.values(df, columns)
    out = df.withColumns({f"{c}_lag_{k}": F.lag(known(col(c)), k).over(series.rows()) for c in names for k in lags})
    return out.drop(*names) if drop_original else out


def create_rolling_features(df: DataFrame, series: Series, windows: list[int], statistics: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    names = series.values(df, columns)
    wide = df.withColumn("__position", series.position())
    out = {f"{c}_roll_{w}_{s}": statistic(s, known(col(c)), F.col("__position"), series.trailing(w)) for c in names for w in windows for s in statistics or ["mean", "std"]}
    return wide.withColumns(out).drop("__position")


def add_target(df: DataFrame, series: Series, value: str, horizon: int, name: str = "target", keep_tail: bool = False) -> DataFrame:
    """df with the value `horizon` rows ahead; rows without one go unless kept."""
    out = df.withColumn(name, F.lead(known(col(value)), horizon).over(series.rows()))
    return out if keep_tail else out.where(col(name).isNotNull())


def naive_forecast(df: DataFrame, series: Series, value: str, lag: int = 1, name: str = "forecast") -> DataFrame:
    """The value `lag` rows ago (a season for a seasonal forecast); before there is one, the series' mean."""
    x = known(col(value))
    return df.withColumn(name, F.coalesce(F.lag(x, lag).over(series.rows()), F.avg(x).over(series.whole())))
