"""Wavelets, seasonal-trend decomposition, autocorrelation, seasonality and trends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.errors import TimeSeriesError
from seriesloom.functions.wavelets import decompose, deepest, low_pass
from seriesloom.operators.base import TimeSeriesTransformer
from seriesloom.series import Series, col, known

DWT_STATISTICS = ("mean", "std", "energy", "entropy", "max", "zero_crossings")
STL_STATISTICS = ("mean", "std", "min", "max", "skewness", "kurtosis", "range", "energy")


def per_series(df: DataFrame, series: Series, columns: list[str], schema: T.StructType, run) -> DataFrame:
    """run(ordered pandas rows of one series) -> dict, for each series; for computations that walk a whole series."""
    keys = list(series.key)
    names = [*keys, *series.order, *columns]

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(series.order))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **run(pdf)}], columns=[f.name for f in out.fields])

    out = T.StructType([f for f in df.schema.fields if f.name in keys] + schema.fields)
    rows = df.select(*[col(k) for k in keys], *map(col, series.order), *[known(col(c)).alias(c) for c in columns])
    return rows.select(*map(col, names)).groupBy(*series.keys()).applyInPandas(group, out)


def beside(df: DataFrame, per: DataFrame, series: Series) -> DataFrame:
    """df with the one row of its series beside each row."""
    if series.key:
        return df.join(per, list(series.key), "left")
    row = per.head()
    return df.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in per.schema.fields})


def interpolated(x: np.ndarray) -> np.ndarray:
    ok = np.isfinite(x)
    if not ok.any():
        return np.zeros(len(x))
    return np.interp(np.arange(len(x)), np.flatnonzero(ok), x[ok])


def coefficient_statistics(c: np.ndarray, names: list[str]) -> dict[str, float]:
    energy = float((c * c).sum())
    p = c * c / energy if energy > 0 else np.zeros(len(c))
    signs = np.sign(c[c != 0])
    of = {
        "mean": lambda: float(c.mean()), "std": lambda: float(c.std(ddof=1)) if len(c) > 1 else 0.0, "energy": lambda: energy,
        "entropy": lambda: float(-(p * np.log2(p + 1e-10)).sum()) if energy > 0 else 0.0, "max": lambda: float(np.abs(c).max()), "zero_crossings": lambda: float((np.diff(signs) != 0).sum()),
    }
    return {s: of[s]() if len(c) else 0.0 for s in names}


class DWTTransformer(TimeSeriesTransformer):
    """Statistics of each level's detail and of the deepest approximation, one value a series beside each of its rows.

    {column}.dwt.level_{j}.{detail|approx}.{statistic}. Levels are capped by the longest series at fit; a shorter one has
    NULL in levels that it cannot have.
    """

    def __init__(self, wavelet: str = "db4", max_level: int | None = None, statistics: list[str] | None = None):
        low_pass(wavelet)
        self.wavelet, self.max_level = wavelet, max_level
        self.statistics = list(statistics or ["mean", "std", "energy", "entropy"])
        if unknown := [s for s in self.statistics if s not in DWT_STATISTICS]:
            raise TimeSeriesError(f"unknown statistics {unknown}")

    def _fit(self, df: DataFrame, target: str | None) -> None:
        longest = df.groupBy(*self.series.keys()).count().agg(F.max("count")).head()[0] or 0
        most = deepest(longest, self.wavelet)
        self.level_ = min(self.max_level or most, most)
        if self.level_ < 1:
            raise TimeSeriesError("the series are too short for this wavelet")

    def get_feature_names_out(self) -> list[str]:
        self._ready()
        return [f"{c}.dwt.level_{j}.{kind}.{s}" for c in self.feature_names_in_ for j in range(1, self.level_ + 1) for kind in (["detail", "approx"] if j == self.level_ else ["detail"]) for s in self.statistics]

    def add(self, df: DataFrame) -> DataFrame:
        series, columns, level, wavelet, statistics = self._ready(), self.feature_names_in_, self.level_, self.wavelet, self.statistics

        def run(pdf: pd.DataFrame) -> dict:
            out = {}
            for c in columns:
                x = interpolated(pdf[c].to_numpy(float))
                own = min(level, deepest(len(x), wavelet))
                parts = decompose(x, wavelet, own)
                for j in range(1, own + 1):
                    out |= {f"{c}.dwt.level_{j}.detail.{k}": v for k, v in coefficient_statistics(parts[own + 1 - j], statistics).items()}
                if own == level:
                    out |= {f"{c}.dwt.level_{own}.approx.{k}": v for k, v in coefficient_statistics(parts[0], statistics).items()}
            return out

        schema = T.StructType([T.StructField(n, T.DoubleType()) for n in self.get_feature_names_out()])
        return beside(df, per_series(df, series, columns, schema, run), series)


def haar_details(df: DataFrame, series: Series, value: str, level: int = 1) -> DataFrame:
    """The haar details of a level as rows (key, k, detail), by joins of neighbours only; an odd last value is its own mirror."""
    now = df.select(*series.keys(), (series.position() - 1).alias("k"), known(col(value)).alias("a"))
    for _ in range(level):
        half = now.groupBy(*series.keys(), F.floor(F.col("k") / 2).alias("h")).agg(F.min_by("a", "k").alias("x"), F.max_by("a", "k").alias("y"))
        now = half.select(*series.keys(), F.col("h").alias("k"), ((F.col("x") + F.col("y")) / 2**0.5).alias("a"), ((F.col("x") - F.col("y")) / 2**0.5).alias("detail"))
    return now.select(*series.keys(), "k", "detail")


def _loess(y: np.ndarray, span: int, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Local linear fits with tricube weights at positions, on points 0..n-1."""
    n = len(y)
    width = min(span, n)
    start = np.clip(np.round(at).astype(int) - width // 2, 0, n - width)
    index = start[:, None] + np.arange(width)[None, :]
    d = np.abs(index - at[:, None])
    far = d.max(1) if span <= n else d.max(1) + (span - n) // 2
    w = np.clip(1 - (d / np.maximum(far, 1e-12)[:, None] * 0.999) ** 3, 0, None) ** 3 * weights[index]
    s = w.sum(1)
    s = np.where(s > 0, s, 1)
    xm, ym = (w * index).sum(1) / s, (w * y[index]).sum(1) / s
    dx = index - xm[:, None]
    var = (w * dx * dx).sum(1)
    slope = np.where(var > 1e-9 * n, (w * dx * y[index]).sum(1) / np.where(var > 0, var, 1), 0)
    return ym + slope * (at - xm)


def _moving(x: np.ndarray, size: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([[0.0], x]))
    return (c[size:] - c[:-size]) / size


def stl(x: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, low_pass_span: int | None = None, robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """trend, seasonal, remainder by repeated local regressions (Cleveland and others, 1990); they add up to x."""
    n = len(x)
    trend = trend or int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    trend += trend % 2 == 0
    low = low_pass_span or period + (period % 2 == 0)
    weights, t, s = np.ones(n), np.zeros(n), np.zeros(n)
    for outer in range(16 if robust else 1):
        for _ in range(2 if robust else 5):
            y, cycle = x - t, np.empty(n + 2 * period)
            for k in range(period):
                own = y[k::period]
                at = np.arange(-1, len(own) + 1, dtype=float)
                cycle[k::period][: len(at)] = _loess(own, seasonal, weights[k::period], at)
            smooth = _moving(_moving(_moving(cycle, period), period), 3)[:n]
            s = cycle[period : period + n] - _loess(smooth, low, np.ones(n), np.arange(n, dtype=float))
            t = _loess(x - s, trend, weights, np.arange(n, dtype=float))
        if not robust:
            break
        rest = np.abs(x - t - s)
        h = 6 * np.median(rest)
        new = np.clip(1 - (rest / h) ** 2, 0, None) ** 2 if h > 1e-12 else np.ones(n)
        if outer and np.abs(new - weights).max() < 1e-3:
            break
        weights = new
    return t, s, x - t - s


def series_statistics(x: np.ndarray, names: list[str]) -> dict[str, float]:
    m, sd = x.mean(), x.std()
    z = (x - m) / sd if sd > 1e-10 else None
    of = {
        "mean": lambda: m, "std": lambda: x.std(ddof=1) if len(x) > 1 else 0.0, "min": x.min, "max": x.max, "range": lambda: x.max() - x.min(), "energy": lambda: (x * x).sum(),
        "skewness": lambda: (z**3).mean() if z is not None else 0.0, "kurtosis": lambda: (z**4).mean() - 3 if z is not None else 0.0,
    }
    return {s: float(of[s]()) for s in names}


class STLTransformer(TimeSeriesTransformer):
    """Statistics of trend, seasonal part and remainder of each series, beside its rows: {column}.stl.{part}.{statistic}."""

    def __init__(self, period: int | None = None, seasonal: int = 7, trend: int | None = None, low_pass: int | None = None, statistics: list[str] | None = None):
        for name, v in (("seasonal", seasonal), ("trend", trend), ("low_pass", low_pass)):
            if v is not None and (v < 3 or v % 2 == 0):
                raise TimeSeriesError(f"{name} must be odd and at least 3")
        if period is not None and period < 2:
            raise TimeSeriesError("period must be at least 2")
        self.period, self.seasonal, self.trend, self.low_pass = period, seasonal, trend, low_pass
        self.statistics = list(statistics or ["mean", "std", "min", "max", "skewness", "kurtosis"])
        if unknown := [s for s in self.statistics if s not in STL_STATISTICS]:
            raise TimeSeriesError(f"unknown statistics {unknown}")

    def _fit(self, df: DataFrame, target: str | None) -> None:
        self.period_ = self.period or estimate_period(df, self.series, self.feature_names_in_[0])
        trend = self.trend or int(1.5 * self.period_ + 1)
        self.trend_ = trend + (trend % 2 == 0)

    def get_feature_names_out(self) -> list[str]:
        return [f"{c}.stl.{part}.{s}" for c in self.feature_names_in_ for part in ("trend", "seasonal", "resid") for s in self.statistics]

    def add(self, df: DataFrame) -> DataFrame:
        series, columns, statistics = self._ready(), self.feature_names_in_, self.statistics
        period, seasonal, trend, low = self.period_, self.seasonal, self.trend_, self.low_pass

        def run(pdf: pd.DataFrame) -> dict:
            out = {}
            for c in columns:
                x = interpolated(pdf[c].to_numpy(float))
                if len(x) >= 2 * period:
                    for part, v in zip(("trend", "seasonal", "resid"), stl(x, period, seasonal, trend, low), strict=True):
                        out |= {f"{c}.stl.{part}.{k}": w for k, w in series_statistics(v, statistics).items()}
            return out

        schema = T.StructType([T.StructField(n, T.DoubleType()) for n in self.get_feature_names_out()])
        return beside(df, per_series(df, series, columns, schema, run), series)


def acf(df: DataFrame, series: Series, value: str, lags: list[int]) -> DataFrame:
    """One row a series: acf_{k}, the biased autocorrelations, 0 where the series does not vary. One sort, no join."""
    x = known(col(value))
    w = series.rows()
    d = df.select(*series.keys(), (x - F.avg(x).over(series.whole())).alias("__d"), *map(col, series.order))
    d = d.withColumns({f"__l{k}": F.lag("__d", k).over(w) for k in lags})
    squares = F.sum(F.col("__d") * F.col("__d"))
    return d.groupBy(*series.keys()).agg(*[F.coalesce(F.try_divide(F.sum(F.col("__d") * F.col(f"__l{k}")), F.when(squares > 0, squares)), F.lit(0.0)).alias(f"acf_{k}") for k in lags])


def _first_peak(values: list[float], height: float, distance: int) -> int | None:
    """The first of the local maxima of that height that stay when, from the highest on, nearer ones go."""
    peaks = [i for i in range(1, len(values) - 1) if values[i] > values[i - 1] and values[i] >= values[i + 1] and values[i] >= height]
    kept: list[int] = []
    for i in sorted(peaks, key=lambda i: -values[i]):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    return min(kept, default=None)


def estimate_period(df: DataFrame, series: Series, value: str) -> int:
    """The first autocorrelation peak of 0.3 or more, averaged over the series; 24 without one."""
    longest = df.groupBy(*series.keys()).count().agg(F.max("count")).head()[0] or 0
    if longest < 24:
        return 24
    lags = list(range(1, min(100, longest // 2) + 1))
    row = acf(df, series, value, lags).agg(*[F.avg(f"acf_{k}").alias(f"acf_{k}") for k in lags]).head()
    peak = _first_peak([1.0, *(row[f"acf_{k}"] or 0.0 for k in lags)], 0.3, 5)
    return max(2, peak) if peak else 24


def detect_seasonality(df: DataFrame, series: Series, value: str, max_period: int = 100, method: str = "acf") -> DataFrame:
    """period and strength of each series; 0 for a series shorter than two longest periods, or without a season."""
    if method not in ("acf", "fft"):
        raise TimeSeriesError(f"unknown method {method}")

    def run(pdf: pd.DataFrame) -> dict:
        x = interpolated(pdf[value].to_numpy(float))
        n = len(x)
        if n < 2 * max_period or x.std() < 1e-10:
            return {"period": 0, "strength": 0.0}
        d = x - x.mean()
        if method == "acf":
            r = [float((d[k:] * d[: n - k]).sum() / (d * d).sum()) for k in range(max_period + 2)]
            peak = _first_peak(r[2:], 0.2, 3)
            return {"period": peak + 2, "strength": r[peak + 2]} if peak is not None else {"period": 0, "strength": 0.0}
        size = np.abs(np.fft.rfft(d))
        periods = np.divide(n, np.arange(len(size)), out=np.full(len(size), np.inf), where=np.arange(len(size)) > 0)
        ok = (periods >= 2) & (periods <= max_period)
        if not ok.any() or size[ok].sum() == 0:
            return {"period": 0, "strength": 0.0}
        best = np.flatnonzero(ok)[size[ok].argmax()]
        return {"period": int(round(periods[best])), "strength": float(size[best] / size[ok].sum())}

    return per_series(df, series, [value], T.StructType.fromDDL("period int, strength double"), run)


def detrend_series(df: DataFrame, series: Series, value: str, method: str = "linear", order: int = 1, name: str | None = None) -> DataFrame:
    """linear, poly, diff (the first is 0) or median: what is left of the value without the trend."""
    x, out, whole = known(col(value)), name or value, series.whole()
    if method == "diff":
        return df.withColumn(out, x - F.coalesce(F.lag(x).over(series.rows()), x))
    wide = df.withColumn("__x", x).withColumn("__p", series.position().cast("double"))
    if method == "linear" or (method == "poly" and order == 1):
        fit = F.regr_intercept(F.col("__x"), F.col("__p")).over(whole) + F.regr_slope(F.col("__x"), F.col("__p")).over(whole) * F.col("__p")
        return wide.withColumn(out, F.col("__x") - fit).drop("__x", "__p")
    if method == "median":
        n = F.count("*").over(whole)
        wide = wide.withColumn("__n", n)
        size = F.greatest(F.lit(5), F.floor(F.col("__n") / 20).cast("int"))
        half = F.floor((size + (1 - size % 2)) / 2).cast("int")
        wide = wide.withColumn("__all", F.transform(F.array_sort(F.collect_list(F.struct("__p", "__x")).over(whole)), lambda s: s["__x"])).withColumn("__h", half)
        near = F.transform(F.sequence(-F.col("__h"), F.col("__h")), lambda i: F.coalesce(F.when(F.col("__p") + i >= 1, F.get("__all", (F.col("__p") + i - 1).cast("int"))), F.lit(0.0)))
        return wide.withColumn(out, F.col("__x") - F.get(F.array_sort(near), F.col("__h"))).drop("__x", "__p", "__n", "__all", "__h")
    if method != "poly":
        raise TimeSeriesError(f"unknown method {method}")
    schema = T.StructType.fromDDL("__c array<double>, __m double, __s double")

    def run(pdf: pd.DataFrame) -> dict:
        p = np.arange(1, len(pdf) + 1, dtype=float)
        m, s, y = p.mean(), p.std() or 1.0, pdf[value].to_numpy(float)
        ok = np.isfinite(y)
        return {"__c": np.polyfit((p[ok] - m) / s, y[ok], min(order, max(ok.sum() - 1, 0))).tolist() if ok.any() else [0.0], "__m": m, "__s": s}

    wide = beside(wide, per_series(df, series, [value], schema, run), series)
    fit = F.aggregate("__c", F.lit(0.0), lambda a, c: a * (F.col("__p") - F.col("__m")) / F.col("__s") + c)
    return wide.withColumn(out, F.col("__x") - fit).drop("__x", "__p", "__c", "__m", "__s")


def change_points(df: DataFrame, series: Series, value: str, method: str = "pelt", min_size: int = 10, penalty: float = 10.0) -> DataFrame:
    """`points` of each series: the last positions (from 0) of the segments of squared-error cost but the last one.

    pelt: the optimal segmentation with a penalty for each segment, by pruned dynamic programming; binary: greedy splits
    that gain more than the penalty; window: peaks of the gain of a split in the middle of two windows of min_size.
    """
    if method not in ("pelt", "binary", "window"):
        raise TimeSeriesError(f"unknown method {method}")

    def run(pdf: pd.DataFrame) -> dict:
        x = interpolated(pdf[value].to_numpy(float))
        n = len(x)
        s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
        cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
        if n < 2 * min_size:
            return {"points": []}
        if method == "window":
            at = np.arange(min_size, n - min_size + 1)
            gain = cost(at - min_size, at + min_size) - cost(at - min_size, at) - cost(at, at + min_size)
            around = np.lib.stride_tricks.sliding_window_view(np.pad(gain, min_size, constant_values=-np.inf), 2 * min_size + 1)
            ends = at[(gain > penalty) & (gain == around.max(1))].tolist()
        elif method == "binary":
            ends, todo = [], [(0, n)]
            while todo:
                a, b = todo.pop()
                cuts = np.arange(a + min_size, b - min_size + 1)
                if len(cuts):
                    gain = cost(a, b) - cost(a, cuts) - cost(cuts, b)
                    k = len(gain) - 1 - int(gain[::-1].argmax())
                    if gain[k] > penalty:
                        i = int(cuts[k])
                        ends.append(i)
                        todo += [(a, i), (i, b)]
        else:
            best, last, open_ = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(1, int)
            best[0] = -penalty
            for i in range(min_size, n + 1):
                far = int(np.searchsorted(open_, i - min_size, side="right"))
                ready = open_[:far]
                values = best[ready] + cost(ready, i) + penalty
                k = int(values.argmin())
                best[i], last[i] = values[k], ready[k]
                open_ = np.concatenate([ready[values - penalty <= best[i]], open_[far:], [i]])
            ends, i = [], n
            while last[i] > 0:
                i = int(last[i])
                ends.append(i)
        return {"points": [int(e) - 1 for e in sorted(ends)]}

    return per_series(df, series, [value], T.StructType.fromDDL("points array<int>"), run)


