"""Meta-features: one row of numbers for each series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.errors import TimeSeriesError
from seriesloom.operators.missing import fill_for_features
from seriesloom.operators.spectral import acf, interpolated, per_series
from seriesloom.series import Series, col, known

CATEGORIES = ("simple", "statistical", "spectral", "complexity", "landmarking")
ACF_LAGS = (1, 24, 168, 30, 365)
# fixed values: MacKinnon's (1994) p-value surface and (2010) bounds for one series with a constant
ADF_MAX, ADF_MIN, ADF_STAR = 2.74, -18.83, -1.61
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
# fixed values: critical values of KPSS (1992) for a constant level, and their p-values
KPSS_LEVELS, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def _normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """By Newton steps from a rough start."""
    z = np.sign(p - 0.5) * np.sqrt(np.maximum(-2 * np.log(np.minimum(p, 1 - p)), 0)) * 0.8
    for _ in range(60):
        cdf = np.array([_normal_cdf(v) for v in z])
        pdf = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        step = np.clip((cdf - p) / np.maximum(pdf, 1e-12), -0.5, 0.5)
        z = z - step
        if np.abs(step).max() < 1e-13:
            break
    return z


def chi2_upper(x: float, df: int) -> float:
    """The upper tail of chi-squared, by the series or continued fraction of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, y = df / 2, x / 2
    front = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= y / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = y + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ b
    s2 = float(rest @ rest) / max(len(y) - x.shape[1], 1)
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(x.T @ x)) * s2, 0))
    return b, se, float(rest @ rest)


def adf(x: np.ndarray) -> float:
    """p of the augmented Dickey-Fuller test with a constant, lags by AIC."""
    n = len(x)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    if most < 0 or x.std() < 1e-10:
        return float("nan")
    d = np.diff(x)

    def design(k: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(start, len(d))
        return d[rows], np.column_stack([x[rows], np.ones(len(rows)), *(d[rows - i] for i in range(1, k + 1))])

    def aic(k: int) -> float:
        y, z = design(k, most)
        return len(y) * math.log(max(_ols(y, z)[2] / len(y), 1e-300)) + 2 * z.shape[1]

    y, z = design(k := min(range(most + 1), key=aic), k)
    b, se, _ = _ols(y, z)
    t = b[0] / se[0] if se[0] > 0 else -np.inf
    if t > ADF_MAX:
        return 1.0
    if t < ADF_MIN:
        return 0.0
    terms = ADF_SMALL if t <= ADF_STAR else ADF_LARGE
    return _normal_cdf(sum(c * t**i for i, c in enumerate(terms)))


def kpss(x: np.ndarray) -> float:
    """p of the KPSS test of a level, within 0.01 and 0.1; lags by the data-driven rule of Hobijn and others."""
    n, e = len(x), x - x.mean()
    if e.std() < 1e-10:
        return float("nan")
    m = int(n ** (2 / 9))
    s0 = float(e @ e) / n
    cov = [float(e[i:] @ e[: n - i]) / n for i in range(1, m + 1)]
    s1 = 2 * sum(i * c for i, c in enumerate(cov, 1))
    gamma = 1.1447 * ((s1 / (s0 + 2 * sum(cov))) ** 2) ** (1 / 3) if s0 + 2 * sum(cov) else 0
    lags = min(int(gamma * n ** (1 / 3)), n - 1)
    s2 = s0 + 2 * sum((1 - i / (lags + 1)) * float(e[i:] @ e[: n - i]) / n for i in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum()) / (n * n * s2) if s2 > 0 else np.inf
    return float(np.interp(stat, KPSS_LEVELS, KPSS_P))


def shapiro(x: np.ndarray) -> float:
    """p of the Shapiro-Wilk test by Royston's (1995) approximation, for 12 to 5000 values."""
    x = np.sort(x[:5000])
    n = len(x)
    if n < 12 or x[-1] - x[0] < 1e-12:
        return float("nan")
    m = _normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    u, mm = 1 / math.sqrt(n), float(m @ m)
    # fixed values: Royston's polynomials for the two largest weights and for the mean and spread of log(1 - W)
    a_n = m[-1] / math.sqrt(mm) + np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0], u)
    a_m = m[-2] / math.sqrt(mm) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a_n**2 - 2 * a_m**2)
    a = m / math.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = a_n, a_m, -a_n, -a_m
    w = min(float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()), 1 - 1e-12)
    ln = math.log(n)
    mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return 1 - _normal_cdf((math.log(1 - w) - mu) / sd)


def simple(df: DataFrame, series: Series, value: str) -> DataFrame:
    """length, missing_ratio of the raw values, num_features, and freq_hourly: the median gap in hours, where the order is a time."""
    ts = series.order[0]
    timed = isinstance(df.schema[ts].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    gap = (F.unix_micros(col(ts).cast("timestamp")) - F.unix_micros(F.lag(col(ts)).over(series.rows()).cast("timestamp"))) / 3.6e9 if timed else F.lit(None).cast("double")
    wide = df.select(*series.keys(), known(col(value)).alias("__x"), gap.alias("__g"))
    return wide.groupBy(*series.keys()).agg(F.count("*").alias("length"), F.avg(F.col("__x").isNull().cast("double")).alias("missing_ratio"), F.lit(len(series.values(df))).cast("long").alias("num_features"), F.median("__g").alias("freq_hourly"))


def statistical(df: DataFrame, series: Series, value: str) -> DataFrame:
    """variance, skewness, kurtosis, linearity, normality_jarque, homoskedasticity_bp natively; NULL under ten values."""
    whole = series.whole()
    wide = df.withColumn("__x", known(col(value))).withColumn("__p", series.position().cast("double"))
    fit = F.regr_intercept(F.col("__x"), F.col("__p")).over(whole) + F.regr_slope(F.col("__x"), F.col("__p")).over(whole) * F.col("__p")
    wide = wide.withColumn("__e", F.pow(F.col("__x") - fit, F.lit(2)))
    n, varies = F.count("__x"), F.stddev_pop("__x") >= 1e-10
    agg = wide.groupBy(*series.keys()).agg(n.alias("__n"), F.var_samp("__x").alias("variance"), F.when(varies, F.skewness("__x")).alias("skewness"), F.when(varies, F.kurtosis("__x")).alias("kurtosis"), F.when(varies, F.regr_r2("__x", "__p")).alias("linearity"), F.when(F.stddev_pop("__e") >= 1e-12, F.regr_r2("__e", "__p")).alias("__r2"))
    jb = F.col("__n") / 6 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4)
    out = {"variance": F.col("variance"), "skewness": F.col("skewness"), "kurtosis": F.col("kurtosis"), "linearity": F.col("linearity"), "normality_jarque": F.exp(-jb / 2), "bp_statistic": F.col("__n") * F.col("__r2")}
    return agg.select(*series.keys(), *[F.when(F.col("__n") >= 10, e).alias(k) for k, e in out.items()])


def tests(df: DataFrame, series: Series, value: str) -> DataFrame:
    """p-values that walk the whole series: Dickey-Fuller, KPSS, Shapiro-Wilk, Ljung-Box (least of the first lags), Breusch-Pagan."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in ("stationarity_adf", "stationarity_kpss", "normality_shapiro", "autocorrelation_ljungbox", "homoskedasticity_bp")])

    def run(pdf: pd.DataFrame) -> dict:
        x = interpolated(pdf[value].to_numpy(float))
        n = len(x)
        if n < 10 or x.std() < 1e-10:
            return {}
        d, q, least = x - x.mean(), 0.0, 1.0
        for k in range(1, min(10, n // 10) + 1):
            q += float((d[k:] @ d[:-k]) / (d @ d)) ** 2 / (n - k)
            least = min(least, chi2_upper(n * (n + 2) * q, k))
        t = np.arange(n, dtype=float)
        e = (x - np.polyval(np.polyfit(t, x, 1), t)) ** 2
        r2 = np.corrcoef(t, e)[0, 1] ** 2 if e.std() > 1e-12 else 0.0
        found = {"stationarity_adf": adf(x), "stationarity_kpss": kpss(x), "normality_shapiro": shapiro(x), "autocorrelation_ljungbox": least, "homoskedasticity_bp": math.erfc(math.sqrt(n * r2 / 2))}
        return {k: None if v != v else v for k, v in found.items()}

    return per_series(df, series, [value], schema, run)


def autocorrelations(df: DataFrame, series: Series, value: str) -> DataFrame:
    """acf_1, acf_24, acf_168, acf_30, acf_365; NULL beyond half of the series or lag 400."""
    n = df.groupBy(*series.keys()).agg(F.count("*").alias("__n"))
    r = acf(df, series, value, list(ACF_LAGS))
    both = r.join(n, list(series.key)) if series.key else r.withColumn("__n", F.lit(n.head()["__n"]))
    return both.select(*series.keys(), *[F.when(F.least(F.floor(F.col("__n") / 2), F.lit(400)) >= k, F.col(f"acf_{k}")).alias(f"acf_{k}") for k in ACF_LAGS])


def permutation_entropy(df: DataFrame, series: Series, value: str, delay: int = 1) -> DataFrame:
    """Entropy of the orders of three values, over log 3!; from two lags and a count of six kinds."""
    x, w = known(col(value)), series.rows()
    wide = df.select(*series.keys(), F.lag(x, 2 * delay).over(w).alias("__a"), F.lag(x, delay).over(w).alias("__b"), x.alias("__c")).dropna(subset=["__a", "__b", "__c"])
    # ties count as ascending
    kind = F.concat((F.col("__a") <= F.col("__b")).cast("int"), (F.col("__b") <= F.col("__c")).cast("int"), (F.col("__a") <= F.col("__c")).cast("int"))
    counts = wide.groupBy(*series.keys(), kind.alias("__k")).agg(F.count("*").alias("__n"))
    p = F.col("__n") / F.sum("__n").over(series.whole())
    return counts.withColumn("__p", p).groupBy(*series.keys()).agg((-F.sum(F.col("__p") * F.log("__p")) / math.log(6)).alias("permutation_entropy"))


def hurst(df: DataFrame, series: Series, value: str, most: int = 100) -> DataFrame:
    """Twice the slope of log root standard deviation of k-step differences on log k, k from 2 to min(most, half) - 1."""
    x, w = known(col(value)), series.rows()
    wide = df.select(*series.keys(), *map(col, series.order), x.alias("__x"), F.count("*").over(series.whole()).alias("__n"))
    lags = range(2, most)
    wide = wide.select(*series.keys(), "__n", *[(F.col("__x") - F.lag("__x", k).over(w)).alias(f"__d{k}") for k in lags])
    spread = wide.groupBy(*series.keys()).agg(F.max("__n").alias("__n"), *[F.stddev_pop(f"__d{k}").alias(f"__d{k}") for k in lags])
    pairs = F.filter(F.array(*[F.struct(F.lit(math.log(k)).alias("k"), F.when((F.lit(k) < F.least(F.lit(most), F.floor(F.col("__n") / 2))) & (F.col(f"__d{k}") > 1e-10), 0.5 * F.log(f"__d{k}")).alias("s")) for k in lags]), lambda p: p["s"].isNotNull())
    long = spread.select(*series.keys(), F.explode(pairs).alias("__q"))
    return long.groupBy(*series.keys()).agg(F.when(F.count("*") >= 2, 2 * F.regr_slope("__q.s", "__q.k")).alias("hurst_exponent"))


def density_entropy(df: DataFrame, series: Series, value: str, bins: int = 10) -> DataFrame:
    """-sum d ln d over the density histogram of the standardised values, in ten bins between least and greatest.

    A value on a bin's edge falls by the last bit of mean and deviation; both are taken in the series' order, so that reruns agree.
    """
    x, w = known(col(value)), series.all_in_order()
    wide = df.select(*series.keys(), F.try_divide(x - F.avg(x).over(w), F.stddev_pop(x).over(w)).alias("__z")).dropna(subset=["__z"])
    whole = series.whole()
    wide = wide.withColumn("__lo", F.min("__z").over(whole)).withColumn("__hi", F.max("__z").over(whole)).withColumn("__n", F.count("*").over(whole)).where("__hi > __lo")
    cells = wide.groupBy(*series.keys(), F.least(F.floor((F.col("__z") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins), F.lit(bins - 1)).alias("__b")).agg(F.count("*").alias("__c"), F.max("__n").alias("__n"), F.max(F.col("__hi") - F.col("__lo")).alias("__r"))
    d = F.col("__c") / F.col("__n") / (F.col("__r") / bins)
    return cells.withColumn("__d", d).groupBy(*series.keys()).agg((-F.sum(F.col("__d") * F.log("__d"))).alias("entropy"))


def nonlinearity(df: DataFrame, series: Series, value: str) -> DataFrame:
    """How much less a centred moving mean is off than a line: (line - mean) / line, window min(10, n / 10)."""
    sizes = sorted({min(10, max(2, k)) for k in range(1, 11)})
    x, whole = known(col(value)), series.whole()
    wide = df.select(*series.keys(), *map(col, series.order), x.alias("__x"), series.position().cast("double").alias("__p"), F.count("*").over(whole).alias("__n"))
    fit = F.regr_intercept(F.col("__x"), F.col("__p")).over(whole) + F.regr_slope(F.col("__x"), F.col("__p")).over(whole) * F.col("__p")
    w = F.least(F.lit(10), F.greatest(F.lit(2), F.floor(F.col("__n") / 10)))
    mean = F.coalesce(*[F.when(w == k, F.avg("__x").over(series.centered(k))) for k in sizes])
    wide = wide.withColumn("__l", F.abs(F.col("__x") - fit)).withColumn("__m", F.abs(F.col("__x") - mean))
    return wide.groupBy(*series.keys()).agg(F.try_divide(F.avg("__l") - F.avg("__m"), F.avg("__l")).alias("nonlinearity"))


def spectrum(df: DataFrame, series: Series, value: str) -> DataFrame:
    """dominant_freq and spectral_entropy of the power between the mean and the highest frequency; NULL under twenty values."""

    def run(pdf: pd.DataFrame) -> dict:
        x = interpolated(pdf[value].to_numpy(float))
        n = len(x)
        if n < 20:
            return {}
        power = np.abs(np.fft.rfft(x - x.mean()))[1 : n // 2] ** 2
        if power.sum() <= 1e-20:
            return {}
        p = power / power.sum()
        return {"dominant_freq": float((power.argmax() + 1) / n), "spectral_entropy": float(-(p[p > 0] * np.log(p[p > 0])).sum())}

    return per_series(df, series, [value], T.StructType.fromDDL("dominant_freq double, spectral_entropy double"), run)


def landmarking(df: DataFrame, series: Series, value: str, season: int = 24) -> DataFrame:
    """Mean absolute errors of the last value, the last season's, and a first-order autoregression run on from the first value."""
    x, w, whole = known(col(value)), series.rows(), series.whole()
    wide = df.select(*series.keys(), *map(col, series.order), x.alias("__x"), (series.position() - 1).cast("double").alias("__t"))
    wide = wide.withColumn("__l", F.lag("__x").over(w)).withColumn("__s", F.lag("__x", season).over(w)).withColumn("__0", F.first("__x", True).over(series.before()))
    wide = wide.withColumn("__a", F.regr_slope("__x", "__l").over(whole)).withColumn("__b", F.regr_intercept("__x", "__l").over(whole))
    power = F.pow(F.col("__a"), F.col("__t"))
    run_on = F.when(F.abs(F.col("__a") - 1) < 1e-12, F.col("__0") + F.col("__b") * F.col("__t")).otherwise(power * F.col("__0") + F.col("__b") * F.try_divide(1 - power, 1 - F.col("__a")))
    wide = wide.withColumn("__r", run_on)
    out = wide.groupBy(*series.keys()).agg(F.avg(F.abs(F.col("__x") - F.coalesce("__l", "__x"))).alias("naive_error"), F.avg(F.abs(F.col("__x") - F.col("__s"))).alias("seasonal_naive_error"), F.avg(F.abs(F.col("__x") - F.col("__r"))).alias("ar_error"))
    return out.withColumn("error_ratio", F.try_divide("ar_error", "naive_error"))


class MetaFeatureExtractor:
    """One row for each series with the features of the chosen categories, joined on the key.

    With a fill_method (linear, forward, backward, none), missing values are filled first, and what is left by the mean, for
    all features but the simple ones, which count what is missing.
    """

    def __init__(self, categories: str | list[str] = "all", fill_method: str | None = None):
        self.fill_method = fill_method
        self.categories = list(CATEGORIES) if categories == "all" else list(categories)
        if unknown := [c for c in self.categories if c not in CATEGORIES]:
            raise TimeSeriesError(f"unknown categories {unknown}; known: {CATEGORIES}")

    def extract(self, df: DataFrame, series: Series, value: str) -> DataFrame:
        parts: dict[str, list] = {
            "simple": [simple], "statistical": [statistical, tests], "spectral": [autocorrelations, spectrum],
            "complexity": [density_entropy, permutation_entropy, hurst, nonlinearity], "landmarking": [landmarking],
        }
        out, full = None, df if self.fill_method is None else fill_for_features(df, series, value, self.fill_method)
        for f in [f for c in self.categories for f in parts[c]]:
            found = f(df if f is simple else full, series, value)
            if out is None:
                out = found
            elif series.key:
                out = out.join(found, list(series.key), "full")
            else:
                out = out.withColumn("__one", F.lit(1)).join(found.withColumn("__one", F.lit(1)), "__one", "full").drop("__one")
        return out


def recommend_core_features(meta: dict) -> dict:
    """Lags and windows that a series' autocorrelations speak for."""
    lags = [k for k in (1, 24, 168) if abs(meta.get(f"acf_{k}") or 0.0) > 0.1] or [1]
    return {"lags": lags, "windows": sorted({max(3, k) for k in lags}), "stl": abs(meta.get("acf_24") or 0.0) > 0.1, "dwt": (meta.get("spectral_entropy") or 0.0) > 1.0}


def profiles(df: DataFrame, ts: str, value: str, by: str) -> DataFrame:
    """Mean and standard deviation of the value by hour, weekday or month."""
    of = {"hour": F.hour, "weekday": F.weekday, "month": F.month}
    if by not in of:
        raise TimeSeriesError(f"unknown profile {by}")
    x = known(col(value))
    return df.groupBy(of[by](col(ts)).alias(by)).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(x).alias("n"))
