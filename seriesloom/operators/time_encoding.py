"""Calendar features and encodings of time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.errors import TimeSeriesError
from seriesloom.operators.base import TimeSeriesTransformer
from seriesloom.series import col, known

# fixed values: cycles of the components, hints for a time column, periods of time2vec in hours
CYCLES = {"hour": 24, "day_of_week": 7, "day_of_month": 31, "month": 12, "minute": 60, "second": 60}
TIME_NAMES = ("timestamp", "date", "datetime", "time", "ds")
PERIODS = (24, 168, 720, 8760, 336, 1440, 17520)
CALENDAR = ("hour", "part_of_day", "day_of_week", "is_weekend", "month", "season", "is_business_hour")


def component(name: str, ts: Column) -> Column:
    """A component of time; day_of_week counts from Monday, 0; month from 1."""
    of = {"hour": F.hour, "day_of_week": F.weekday, "day_of_month": F.dayofmonth, "month": F.month, "minute": F.minute, "second": F.second}
    if name not in of:
        raise TimeSeriesError(f"unknown component {name}; known: {sorted(of)}")
    return of[name](ts)


def cycle(value: Column, length: float) -> tuple[Column, Column]:
    angle = 2 * math.pi * value / length
    return F.sin(angle), F.cos(angle)


def seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp")).cast("double")


def detect_time_column(df: DataFrame, wanted: str | None = None) -> str:
    """The wanted column if it is a time, else the first time column, else one named like a time."""
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    if wanted:
        if wanted not in times:
            raise TimeSeriesError(f"{wanted} is not a time column")
        return wanted
    if times:
        return times[0]
    for c in df.columns:
        if any(h == c.lower() or h in c.lower() for h in TIME_NAMES):
            return c
    raise TimeSeriesError("no time column")


class _OfTime(TimeSeriesTransformer):
    numeric = False
    time_col: str | None = None

    def _fit(self, df: DataFrame, target: str | None) -> None:
        self.time_col_ = detect_time_column(df, self.time_col)

    def ts(self) -> Column:
        self._ready()
        return col(self.time_col_)

    def features(self) -> dict[str, Column]:
        raise NotImplementedError

    def get_feature_names_out(self) -> list[str]:
        return list(self.features())

    def add(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.features())


class TimeEncodingTransformer(_OfTime):
    """cyclic: sine and cosine of components. time2vec: a linear term and periodic ones of the time in seconds.

    With fit_params, the time is standardised and the phases are intercepts of the detrended target on each period's sine;
    without, the frequencies are fixed, phases 0 and the linear weight 1.
    """

    def __init__(self, mode: str = "cyclic", time_col: str | None = None, cyclic_components: list[str] | None = None, time2vec_dim: int = 8, time2vec_periodic_func: str = "sin", scale_time: bool = True, fit_params: bool = True):
        if mode not in ("cyclic", "time2vec"):
            raise TimeSeriesError(f"unknown mode {mode}")
        if time2vec_periodic_func not in ("sin", "cos"):
            raise TimeSeriesError("time2vec_periodic_func is sin or cos")
        if time2vec_dim < 2:
            raise TimeSeriesError("time2vec_dim is 2 or more")
        self.mode, self.time_col = mode, time_col
        self.cyclic_components = list(cyclic_components or ["hour", "day_of_week", "month"])
        self.time2vec_dim, self.time2vec_periodic_func = time2vec_dim, time2vec_periodic_func
        self.scale_time, self.fit_params = scale_time, fit_params
        for c in self.cyclic_components:
            if c not in CYCLES:
                raise TimeSeriesError(f"unknown component {c}")

    def _fit(self, df: DataFrame, target: str | None) -> None:
        super()._fit(df, target)
        if self.mode == "cyclic":
            return
        t = seconds(self.ts())
        self.center_, self.scale_ = 0.0, 1.0
        if self.scale_time:
            row = df.agg(F.avg(t).alias("m"), F.stddev_pop(t).alias("s")).head()
            self.center_, self.scale_ = row["m"] or 0.0, row["s"] or 1.0
        k = self.time2vec_dim - 1
        if not self.fit_params or target is None:
            self.weights_ = [1.0, *(2 * math.pi / PERIODS[i % len(PERIODS)] for i in range(k))]
            self.phases_ = [0.0] * (k + 1)
            return
        used = PERIODS[:4]
        rows = df.select(known(col(target)).alias("y"), ((t - self.center_) / self.scale_).alias("t"), self.series.position().cast("double").alias("p"))
        line = rows.agg(F.regr_slope("y", "p").alias("b"), F.regr_intercept("y", "p").alias("a"), F.regr_slope("y", "t").alias("w"), F.regr_intercept("y", "t").alias("c")).head()
        rest = rows.withColumn("r", F.col("y") - line["a"] - line["b"] * F.col("p"))
        omegas = [2 * math.pi / used[i % len(used)] for i in range(k)]
        phases = rest.agg(*[F.regr_intercept("r", F.sin(F.col("t") * w)).alias(f"i{i}") for i, w in enumerate(omegas)]).head()
        self.weights_ = [line["w"] or 0.0, *omegas]
        self.phases_ = [line["c"] or 0.0, *((phases[f"i{i}"] or 0.0) for i in range(k))]

    def features(self) -> dict[str, Column]:
        ts = self.ts()
        if self.mode == "cyclic":
            out = {}
            for c in self.cyclic_components:
                out[f"time.{c}_sin"], out[f"time.{c}_cos"] = cycle(component(c, ts), CYCLES[c])
            return out
        t = (seconds(ts) - self.center_) / self.scale_
        periodic = F.sin if self.time2vec_periodic_func == "sin" else F.cos
        return {f"time.t2v_{i}": (t * w + p) if i == 0 else periodic(t * w + p) for i, (w, p) in enumerate(zip(self.weights_, self.phases_, strict=True))}


class Time2VecEncoder(_OfTime):
    """Parts of the date and time, their sines and cosines, business flags and seasons, and the target, scaled if asked."""

    def __init__(self, time_col: str | None = None, target_col: str | None = None, include_trigonometric: bool = True, include_categorical: bool = True, include_business_features: bool = True, include_seasonality: bool = True, normalize_target: bool = False):
        self.time_col, self.target_col = time_col, target_col
        self.include_trigonometric, self.include_categorical = include_trigonometric, include_categorical
        self.include_business_features, self.include_seasonality = include_business_features, include_seasonality
        self.normalize_target = normalize_target

    def _fit(self, df: DataFrame, target: str | None) -> None:
        super()._fit(df, target)
        self.target_col_ = self.target_col or target
        self.range_ = None
        if self.target_col_ and self.normalize_target:
            x = known(col(self.target_col_))
            row = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).head()
            self.range_ = (row["lo"], row["hi"])

    def features(self) -> dict[str, Column]:
        ts, out = self.ts(), {}
        hour, dow, month = F.hour(ts), F.weekday(ts), F.month(ts)
        if self.include_categorical:
            out |= {"year": F.year(ts), "month": month, "day": F.dayofmonth(ts), "week": F.weekofyear(ts), "day_of_week": dow, "hour": hour, "minute": F.minute(ts), "second": F.second(ts)}
        if self.include_trigonometric:
            for name, value, length in (("hour", hour, 24), ("day_of_week", dow, 7), ("week", F.weekofyear(ts), 52), ("month", month, 12)):
                out[f"{name}_sin"], out[f"{name}_cos"] = cycle(value, length)
        if self.include_business_features:
            out |= {"part_of_day": F.floor(hour / 6).cast("int"), "is_night": (hour < 6).cast("int"), "is_weekend": (dow >= 5).cast("int"), "is_working_hours": hour.between(9, 18).cast("int")}
        if self.include_seasonality:
            season, quarter = F.floor((month % 12 + 3) / 3).cast("int"), F.quarter(ts)
            out |= {"season": season, "quarter": quarter}
            for name, value in (("season", season), ("quarter", quarter)):
                out[f"{name}_sin"], out[f"{name}_cos"] = cycle(value, 4)
            out |= {"day_of_year": F.dayofyear(ts), "moon_phase": (F.dayofmonth(ts) % 29.53).cast("int")}
        if self.target_col_:
            x = known(col(self.target_col_))
            if self.range_:
                lo, hi = self.range_
                x = (x - lo) / (hi - lo) if hi != lo else F.lit(0.0)
            out["target"] = x
        return {f"time.{k}": v for k, v in out.items()}


class CalendarFeaturesTransformer(_OfTime):
    """Whole-number calendar features; season 0 is winter; business hours are 9 to 18 on weekdays, 18 not included."""

    def __init__(self, time_col: str | None = None, features: list[str] | None = None):
        self.time_col, self.wanted = time_col, list(features or CALENDAR)
        if unknown := [f for f in self.wanted if f not in CALENDAR]:
            raise TimeSeriesError(f"unknown features {unknown}; known: {CALENDAR}")

    def features(self) -> dict[str, Column]:
        ts = self.ts()
        hour, dow, month = F.hour(ts), F.weekday(ts), F.month(ts)
        of = {
            "hour": hour, "part_of_day": F.floor(hour / 6).cast("int"), "day_of_week": dow, "is_weekend": (dow >= 5).cast("int"), "month": month,
            "season": F.floor((month % 12) / 3).cast("int"), "is_business_hour": ((dow < 5) & (hour >= 9) & (hour < 18)).cast("int"),
        }
        return {f"time.{f}": of[f] for f in self.wanted}


#: Intervals of a calendar that are sent along with an expression, at most.
MOST_INTERVALS = 10_000


def holiday_distances(df: DataFrame, ts: str, intervals: DataFrame, most: int = 30) -> DataFrame:
    """df with in_interval, days_until and days_since the next and last of intervals (start, end: dates), both at most `most`.

    The intervals are a small table of the calendar: some rows a year. They are read at the driver; more than MOST_INTERVALS
    are an error.
    """
    rows = intervals.select(F.col("start").cast("date").alias("s"), F.col("end").cast("date").alias("e")).dropna().orderBy("s").limit(MOST_INTERVALS + 1).collect()
    if len(rows) > MOST_INTERVALS:
        raise TimeSeriesError(f"more than {MOST_INTERVALS} intervals")
    day = F.to_date(col(ts))
    if not rows:
        return df.withColumns({"in_interval": F.lit(0), "days_until": F.lit(most), "days_since": F.lit(most)})
    table = F.array(*[F.struct(F.lit(r["s"]).alias("s"), F.lit(r["e"]).alias("e")) for r in rows])
    until = F.array_min(F.transform(F.filter(table, lambda r: r["s"] > day), lambda r: F.datediff(r["s"], day)))
    since = F.array_min(F.transform(F.filter(table, lambda r: r["e"] < day), lambda r: F.datediff(day, r["e"])))
    inside = F.exists(table, lambda r: (r["s"] <= day) & (day <= r["e"]))
    return df.withColumns({"in_interval": inside.cast("int"), "days_until": F.least(F.coalesce(until, F.lit(most)), F.lit(most)), "days_since": F.least(F.coalesce(since, F.lit(most)), F.lit(most))})
