"""The registered queries over the driver's tables, and the SQL they are held against.

Series here: the events of each user, ordered by time and event_id. Where gaps are wanted, the value of every fifth
event_id counts as missing. Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions import metrics as M
from seriesloom.operators import meta, missing, selection, spectral, validation, window
from seriesloom.operators import time_encoding as TE
from seriesloom.plans import long_series, models
from seriesloom.plans import pipeline as P
from seriesloom.series import Series, col
from seriesloom.session import reachable

EVENTS = Series(("ts", "event_id"), ("user_id",))
HOURS = Series(("ts",))
DAYS = Series(("day",))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL if there is one."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(reachable(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return df.withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value"))) if gaps else df


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: the mean value of each hour."""
    return missing.resample_time_series(table(spark, sf_dir, "events").select("ts", "value"), Series(("ts",)), "value", "1 hour", "mean", "interpolate")


def plain(df: DataFrame, *keys: str) -> DataFrame:
    """Underscores for dots in names, six digits for doubles, keys first."""
    out = []
    for f in df.schema.fields:
        if keys and f.name in ("user_id", "ts", "event_id") and f.name not in keys:
            continue
        e = F.round(col(f.name), 6) if f.dataType.simpleString() == "double" else col(f.name)
        out.append(e.alias(f.name.replace(".", "_")))
    return df.select(*out)


E = "FROM events"
G = "FROM (SELECT user_id, ts, event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events)"
W = "PARTITION BY user_id ORDER BY ts, event_id"
FR = f"({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
FLAT = "1e-10"


def _window(statistics: list[str], transformations: list[str], gaps: bool = False, size: int = 24, min_periods: int = 1):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = window.WindowTransformer(size, transformations, statistics, min_periods)
        return plain(t.fit_transform(events(spark, sf_dir, gaps), EVENTS), "event_id")

    return run


@query(f"SELECT event_id, round(lag(value, 1) OVER ({W}), 6) AS value_lag_1, round(lag(value, 24) OVER ({W}), 6) AS value_lag_24 {E}")
def lag_features(spark, sf_dir):
    return plain(window.LagTransformer([24, 1]).fit_transform(events(spark, sf_dir), EVENTS), "event_id")


@query(f"SELECT event_id, round(avg(value) OVER w, 6) AS value_identity_mean, round(stddev_samp(value) OVER w, 6) AS value_identity_std, round(min(value) OVER w, 6) AS value_identity_min, round(max(value) OVER w, 6) AS value_identity_max, round(lag(value, 3) OVER ({W}), 6) AS value_lag_3 {G} WINDOW w AS {FR}")
def window_mean_std_min_max(spark, sf_dir):
    return _window(["mean", "std", "min", "max", "lag_3"], ["identity"], gaps=True)(spark, sf_dir)


@query(f"SELECT event_id, round(CASE WHEN count(value) OVER w >= 6 THEN avg(value) OVER w END, 6) AS value_identity_mean {G} WINDOW w AS {FR}")
def window_min_periods(spark, sf_dir):
    return _window(["mean"], ["identity"], gaps=True, min_periods=6)(spark, sf_dir)


@query(f"SELECT event_id, round(CASE WHEN count(value) OVER w >= 2 AND stddev_pop(value) OVER w >= {FLAT} THEN regr_slope(value, rn) OVER w END, 4) AS value_identity_slope FROM (SELECT *, row_number() OVER ({W}) AS rn {G}) WINDOW w AS {FR}")
def window_slope(spark, sf_dir):
    out = window.WindowTransformer(24, ["identity"], ["slope"]).fit_transform(events(spark, sf_dir, True), EVENTS)
    return out.select("event_id", F.round(col("value.identity.slope"), 4).alias("value_identity_slope"))


@query(f"""SELECT event_id, round((SELECT CASE WHEN count(*) >= 2 AND stddev_pop(a) >= {FLAT} AND stddev_pop(b) >= {FLAT} THEN corr(a, b) END FROM (SELECT unnest(l[1:len(l) - 1]) AS a, unnest(l[2:]) AS b)), 6) AS value_identity_acf1
FROM (SELECT event_id, list(value) FILTER (value IS NOT NULL) OVER w AS l {G} WINDOW w AS {FR})""")
def window_acf1(spark, sf_dir):
    return _window(["acf1"], ["identity"], gaps=True)(spark, sf_dir)


@query(f"""SELECT event_id, round(CASE WHEN len(l) >= 3 AND v > 1e-20 THEN list_avg(list_transform(l, lambda x: (x - m) * (x - m) * (x - m))) / (v * sqrt(v)) END, 6) AS value_identity_skewness,
round(CASE WHEN len(l) >= 4 AND v > 1e-20 THEN list_avg(list_transform(l, lambda x: (x - m) * (x - m) * (x - m) * (x - m))) / (v * v) - 3 END, 6) AS value_identity_kurtosis
FROM (SELECT *, list_avg(list_transform(l, lambda x: (x - m) * (x - m))) AS v FROM (SELECT event_id, list(value) FILTER (value IS NOT NULL) OVER w AS l, avg(value) OVER w AS m {G} WINDOW w AS {FR}))""")
def window_skewness_kurtosis(spark, sf_dir):
    return _window(["skewness", "kurtosis"], ["identity"], gaps=True)(spark, sf_dir)


@query(f"""SELECT event_id, round(avg(d) OVER w, 6) AS value_diff_mean, round(stddev_samp(d) OVER w, 6) AS value_diff_std, round(avg(s) OVER w, 6) AS value_sma_mean, round(stddev_samp(s) OVER w, 6) AS value_sma_std
FROM (SELECT *, value - lag(value) OVER ({W}) AS d, avg(value) OVER {FR} AS s {G}) WINDOW w AS {FR}""")
def window_diff_sma(spark, sf_dir):
    return _window(["mean", "std"], ["diff", "sma"], gaps=True)(spark, sf_dir)


@query(f"""SELECT event_id, round(max(p) OVER w, 6) AS value_pct_change_max FROM (SELECT *, CASE WHEN lag(f) OVER ({W}) <> 0 THEN f / lag(f) OVER ({W}) - 1 END AS p
FROM (SELECT *, last_value(value IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS f {G})) WINDOW w AS {FR}""")
def window_pct_change(spark, sf_dir):
    return _window(["max"], ["pct_change"], gaps=True)(spark, sf_dir)


@query(f"""SELECT user_id, event_id, len(l) AS n, round(l[1], 6) AS first_value, round(l[len(l)], 6) AS last_value, round(list_sum(l), 6) AS total
FROM (SELECT user_id, event_id, row_number() OVER ({W}) AS rn, list(value) OVER ({W} ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS l {E}) WHERE len(l) = 12 AND (rn - 1) % 4 = 0""")
def sliding_windows(spark, sf_dir):
    w = window.create_sliding_windows(events(spark, sf_dir), EVENTS, "value", 12, 4)
    total = F.aggregate("window", F.lit(0.0), lambda s, x: s + x)
    return w.select("user_id", "event_id", F.size("window").cast("long").alias("n"), F.round(F.get("window", F.lit(0)), 6).alias("first_value"), F.round(F.element_at("window", -1), 6).alias("last_value"), F.round(total, 6).alias("total"))


@query(f"SELECT event_id, round(CASE WHEN count(value) OVER w >= 6 THEN median(value) OVER w END, 6) AS value_median, round(CASE WHEN count(value) OVER w >= 6 THEN sum(value) OVER w END, 6) AS value_sum, round(CASE WHEN count(value) OVER w >= 6 THEN sum(value * value) OVER w END, 4) AS value_energy {G} WINDOW w AS {FR}")
def rolling_median_sum_energy(spark, sf_dir):
    out = window.compute_rolling_statistics(events(spark, sf_dir, True), EVENTS, "value", 24, ["median", "sum", "energy"])
    return out.select("event_id", F.round(col("value.median"), 6).alias("value_median"), F.round(col("value.sum"), 6).alias("value_sum"), F.round(col("value.energy"), 4).alias("value_energy"))


@query(f"""SELECT event_id, round(CASE WHEN len(l) >= 2 THEN -list_sum(list_transform(range(10), lambda i: CASE WHEN len(list_filter(c, lambda x: x = i)) > 0 THEN (len(list_filter(c, lambda x: x = i)) / len(c)) * log2(len(list_filter(c, lambda x: x = i)) / len(c) + 1e-10) ELSE 0 END)) END, 6) + 0.0 AS value_entropy
FROM (SELECT event_id, l, list_transform(l, lambda x: least(floor((x - lo) / (hi - lo + 1e-10) * 10), 9)) AS c FROM (SELECT event_id, list(value) FILTER (value IS NOT NULL) OVER w AS l, min(value) OVER w AS lo, max(value) OVER w AS hi {G} WINDOW w AS {FR}))""")
def rolling_entropy(spark, sf_dir):
    return plain(window.compute_rolling_statistics(events(spark, sf_dir, True), EVENTS, "value", 24, ["entropy"], min_periods=2), "event_id")


@query(f"SELECT event_id, round(avg(value) OVER w, 6) AS value_mean, round(max(value) OVER w, 6) AS value_max {G} WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)")
def rolling_centered(spark, sf_dir):
    return plain(window.compute_rolling_statistics(events(spark, sf_dir, True), EVENTS, "value", 8, ["mean", "max"], center=True, min_periods=1), "event_id")


@query(f"""SELECT event_id, round((SELECT CASE WHEN sum((x - m) * (x - m)) >= {FLAT} THEN sum((x - m) * (p - m)) / sum((x - m) * (x - m)) END FROM (SELECT x, lag(x) OVER (ORDER BY i) AS p FROM (SELECT unnest(l) AS x, unnest(range(len(l))) AS i))), 6) AS value_acf1
FROM (SELECT event_id, l, list_avg(l) AS m FROM (SELECT event_id, list(value) FILTER (value IS NOT NULL) OVER w AS l {G} WINDOW w AS {FR})) WHERE len(l) >= 6 UNION ALL SELECT event_id, NULL FROM (SELECT event_id, count(value) OVER w AS n {G} WINDOW w AS {FR}) WHERE n < 6""")
def rolling_acf1_ratio(spark, sf_dir):
    return plain(window.compute_rolling_statistics(events(spark, sf_dir, True), EVENTS, "value", 24, ["acf1"]), "event_id")


@query(f"SELECT event_id, round(CASE WHEN count(value) OVER w >= 6 AND stddev_pop(value) OVER w >= {FLAT} THEN regr_slope(value, d) OVER w END, 6) AS value_slope FROM (SELECT *, count(value) OVER ({W} ROWS UNBOUNDED PRECEDING) AS d {G}) WINDOW w AS {FR}")
def rolling_compact_slope(spark, sf_dir):
    return plain(window.compute_rolling_statistics(events(spark, sf_dir, True), EVENTS, "value", 24, ["slope"]), "event_id")


@query(f"SELECT event_id, round(value, 6) AS value, round(lag(value, 2) OVER ({W}), 6) AS value_lag_2, round(avg(value) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS value_roll_7_mean, round(stddev_samp(value) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS value_roll_7_std {E}")
def lagged_and_rolling_features(spark, sf_dir):
    df = window.create_rolling_features(events(spark, sf_dir), EVENTS, [7], columns=["value"])
    return plain(window.create_lagged_features(df, EVENTS, [2], ["value"]).select("event_id", "value", "value_lag_2", "value_roll_7_mean", "value_roll_7_std"), "event_id")


@query(f"SELECT event_id, round(t, 6) AS target FROM (SELECT event_id, lead(value, 3) OVER ({W}) AS t {E}) WHERE t IS NOT NULL")
def horizon_target(spark, sf_dir):
    return plain(window.add_target(events(spark, sf_dir), EVENTS, "value", 3).select("event_id", "target"), "event_id")


@query(f"SELECT event_id, round(coalesce(lag(value, 24) OVER ({W}), avg(value) OVER (PARTITION BY user_id)), 6) AS forecast {E}")
def seasonal_naive_forecast(spark, sf_dir):
    return plain(window.naive_forecast(events(spark, sf_dir), EVENTS, "value", 24).select("event_id", "forecast"), "event_id")


def _cycle_sql(name: str, e: str, length: int) -> str:
    return f"round(sin(2 * pi() * {e} / {length}), 6) + 0.0 AS time_{name}_sin, round(cos(2 * pi() * {e} / {length}), 6) + 0.0 AS time_{name}_cos"


DOW = "(isodow(ts) - 1)"


@query(f"SELECT event_id, {_cycle_sql('hour', 'hour(ts)', 24)}, {_cycle_sql('day_of_week', DOW, 7)}, {_cycle_sql('day_of_month', 'day(ts)', 31)}, {_cycle_sql('month', 'month(ts)', 12)}, {_cycle_sql('minute', 'minute(ts)', 60)}, {_cycle_sql('second', 'second(ts)', 60)} {E}")
def cyclic_encoding(spark, sf_dir):
    t = TE.TimeEncodingTransformer("cyclic", "ts", list(TE.CYCLES))
    return plain(t.fit_transform(events(spark, sf_dir), EVENTS), "event_id")


@query(f"SELECT event_id, round(t, 6) AS time_t2v_0, round(sin(t * 2 * pi() / 24), 6) AS time_t2v_1, round(sin(t * 2 * pi() / 168), 6) AS time_t2v_2, round(sin(t * 2 * pi() / 720), 6) AS time_t2v_3 FROM (SELECT event_id, (epoch(date_trunc('second', ts)) - avg(epoch(date_trunc('second', ts))) OVER ()) / stddev_pop(epoch(date_trunc('second', ts))) OVER () AS t {E})")
def time2vec_fixed(spark, sf_dir):
    t = TE.TimeEncodingTransformer("time2vec", "ts", time2vec_dim=4, fit_params=False)
    return plain(t.fit_transform(events(spark, sf_dir), EVENTS), "event_id")


@query(f"""WITH e AS (SELECT event_id, value::DOUBLE AS y, row_number() OVER ({W}) AS p, epoch(date_trunc('second', ts)) AS s {E}),
z AS (SELECT *, (s - avg(s) OVER ()) / stddev_pop(s) OVER () AS t FROM e),
l AS (SELECT regr_slope(y, p) AS b, regr_intercept(y, p) AS a, regr_slope(y, t) AS w, regr_intercept(y, t) AS c FROM z),
q AS (SELECT regr_intercept(y - a - b * p, sin(t * 2 * pi() / 24)) AS i1, regr_intercept(y - a - b * p, sin(t * 2 * pi() / 168)) AS i2, regr_intercept(y - a - b * p, sin(t * 2 * pi() / 720)) AS i3 FROM z, l)
SELECT event_id, round(t * w + c, 6) AS time_t2v_0, round(sin(t * 2 * pi() / 24 + i1), 6) AS time_t2v_1, round(sin(t * 2 * pi() / 168 + i2), 6) AS time_t2v_2, round(sin(t * 2 * pi() / 720 + i3), 6) AS time_t2v_3 FROM z, l, q""")
def time2vec_fitted(spark, sf_dir):
    t = TE.TimeEncodingTransformer("time2vec", "ts", time2vec_dim=4)
    return plain(t.fit_transform(events(spark, sf_dir), EVENTS, "value"), "event_id")


@query(f"""SELECT event_id, year(ts)::INT AS time_year, month(ts)::INT AS time_month, day(ts)::INT AS time_day, weekofyear(ts)::INT AS time_week, {DOW}::INT AS time_day_of_week, hour(ts)::INT AS time_hour, minute(ts)::INT AS time_minute, second(ts)::INT AS time_second,
{_cycle_sql('hour', 'hour(ts)', 24)}, {_cycle_sql('day_of_week', DOW, 7)}, {_cycle_sql('week', 'weekofyear(ts)', 52)}, {_cycle_sql('month', 'month(ts)', 12)},
(hour(ts) // 6)::INT AS time_part_of_day, (hour(ts) < 6)::INT AS time_is_night, ({DOW} >= 5)::INT AS time_is_weekend, (hour(ts) BETWEEN 9 AND 18)::INT AS time_is_working_hours,
((month(ts) % 12 + 3) // 3)::INT AS time_season, quarter(ts)::INT AS time_quarter, {_cycle_sql('season', '((month(ts) % 12 + 3) // 3)', 4)}, {_cycle_sql('quarter', 'quarter(ts)', 4)}, dayofyear(ts)::INT AS time_day_of_year, trunc(day(ts) % 29.53)::INT AS time_moon_phase,
round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS time_target {E}""")
def time_parts_encoder(spark, sf_dir):
    return plain(TE.Time2VecEncoder("ts", "value", normalize_target=True).fit_transform(events(spark, sf_dir), EVENTS), "event_id")


@query(f"SELECT event_id, hour(ts)::INT AS time_hour, (hour(ts) // 6)::INT AS time_part_of_day, {DOW}::INT AS time_day_of_week, ({DOW} >= 5)::INT AS time_is_weekend, month(ts)::INT AS time_month, ((month(ts) % 12) // 3)::INT AS time_season, ({DOW} < 5 AND hour(ts) >= 9 AND hour(ts) < 18)::INT AS time_is_business_hour {E}")
def calendar_features(spark, sf_dir):
    return plain(TE.CalendarFeaturesTransformer("ts").fit_transform(events(spark, sf_dir), EVENTS), "event_id")


@query(f"""WITH h(s, e) AS (VALUES (DATE '2024-01-06', DATE '2024-01-08'), (DATE '2024-01-20', DATE '2024-01-21'))
SELECT event_id, (SELECT count(*) > 0 FROM h WHERE s <= ts::DATE AND ts::DATE <= e)::INT AS in_interval, least(coalesce((SELECT min(s - ts::DATE) FROM h WHERE s > ts::DATE), 30), 30)::INT AS days_until, least(coalesce((SELECT min(ts::DATE - e) FROM h WHERE e < ts::DATE), 30), 30)::INT AS days_since {E}""")
def holiday_distance(spark, sf_dir):
    h = spark.sql("SELECT * FROM VALUES (DATE '2024-01-06', DATE '2024-01-08'), (DATE '2024-01-20', DATE '2024-01-21') AS t(start, end)")
    return TE.holiday_distances(events(spark, sf_dir), "ts", h).select("event_id", "in_interval", "days_until", "days_since")


def _fill(method: str, **options):
    def run(spark, sf_dir):
        return plain(missing.fill_missing_temporal(events(spark, sf_dir, True), EVENTS, "value", method, **options).select("event_id", "value"), "event_id")

    return run


def _between_sql(at: str) -> str:
    b, a = f"({W} ROWS UNBOUNDED PRECEDING)", f"({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    here = f"CASE WHEN value IS NOT NULL THEN {at} END"
    return f"""SELECT *, coalesce(value, v0 + (v1 - v0) * (p - t0) / (t1 - t0), v0, v1) AS f FROM (SELECT *, {at} AS p, last_value(value IGNORE NULLS) OVER {b} AS v0, last_value({here} IGNORE NULLS) OVER {b} AS t0, first_value(value IGNORE NULLS) OVER {a} AS v1, first_value({here} IGNORE NULLS) OVER {a} AS t1 FROM (SELECT *, row_number() OVER ({W})::DOUBLE AS rn, epoch_us(ts) / 1e6 AS sec {G}))"""


@query(f"SELECT event_id, round(f, 6) AS value FROM ({_between_sql('rn')})")
def fill_linear(spark, sf_dir):
    return _fill("linear")(spark, sf_dir)


@query(f"SELECT event_id, round(f, 6) AS value FROM ({_between_sql('sec')})")
def fill_time(spark, sf_dir):
    return _fill("time")(spark, sf_dir)


@query(f"SELECT event_id, round(last_value(value IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 6) AS value {G}")
def fill_forward(spark, sf_dir):
    return _fill("ffill")(spark, sf_dir)


@query(f"SELECT event_id, round(first_value(value IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS value {G}")
def fill_backward(spark, sf_dir):
    return _fill("bfill")(spark, sf_dir)


@query(f"SELECT event_id, round(CASE WHEN value IS NOT NULL OR gap <= 1 THEN f END, 6) AS value FROM (SELECT *, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g) AS gap FROM (SELECT *, count(value) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g FROM ({_between_sql('rn')})))")
def fill_short_gaps(spark, sf_dir):
    return _fill("linear", max_gap=1)(spark, sf_dir)


@query(f"SELECT event_id, round(coalesce(value, list_avg(list_filter([lag(value, 7) OVER ({W}), lag(value, 14) OVER ({W}), lead(value, 7) OVER ({W}), lead(value, 14) OVER ({W})], lambda x: x IS NOT NULL)), f), 6) AS value FROM ({_between_sql('rn')})")
def fill_seasonal(spark, sf_dir):
    return _fill("seasonal", period=7)(spark, sf_dir)


def _norm(method: str, **options):
    def run(spark, sf_dir):
        return plain(missing.normalize_series(events(spark, sf_dir, True), EVENTS, "value", method, **options).select("event_id", "value"), "event_id")

    return run


@query(f"SELECT event_id, round((value - avg(value) OVER u) / (stddev_samp(value) OVER u + 1e-10), 6) AS value {G} WINDOW u AS (PARTITION BY user_id)")
def normalize_zscore(spark, sf_dir):
    return _norm("zscore")(spark, sf_dir)


@query(f"SELECT event_id, round((value - min(value) OVER u) / (max(value) OVER u - min(value) OVER u + 1e-10), 6) AS value {G} WINDOW u AS (PARTITION BY user_id)")
def normalize_minmax(spark, sf_dir):
    return _norm("minmax")(spark, sf_dir)


@query(f"SELECT event_id, round((value - quantile_cont(value, 0.5) OVER u) / (quantile_cont(value, 0.75) OVER u - quantile_cont(value, 0.25) OVER u + 1e-10), 6) AS value {G} WINDOW u AS (PARTITION BY user_id)")
def normalize_robust(spark, sf_dir):
    return _norm("robust")(spark, sf_dir)


@query("SELECT event_id, round(ln(1 + abs(value)), 6) AS value FROM events")
def normalize_log(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("value", F.abs("value"))
    return plain(missing.normalize_series(df, EVENTS, "value", "log").select("event_id", "value"), "event_id")


@query(f"""SELECT event_id, round((value - CASE WHEN rn > 12 THEN avg(value) OVER r ELSE avg(h) OVER u END) / (CASE WHEN rn > 12 THEN stddev_samp(value) OVER r ELSE stddev_samp(h) OVER u END + 1e-10), 6) AS value
FROM (SELECT *, CASE WHEN rn <= 12 THEN value END AS h FROM (SELECT *, row_number() OVER ({W}) AS rn {G})) WINDOW r AS ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), u AS (PARTITION BY user_id)""")
def normalize_rolling_zscore(spark, sf_dir):
    return _norm("zscore", window_size=12)(spark, sf_dir)


SPINE = "spine AS (SELECT user_id, unnest(generate_series(a, b, INTERVAL 6 HOUR)) AS ts FROM (SELECT user_id, min(w) AS a, max(w) AS b FROM bins GROUP BY user_id))"


def _bins(e: str) -> str:
    return f"WITH bins AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS w, {e} AS value FROM events GROUP BY ALL), {SPINE}"


@query(f"{_bins('avg(value)')} SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, round(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS value FROM spine LEFT JOIN bins ON bins.user_id = spine.user_id AND bins.w = spine.ts".replace("SELECT user_id, strftime", "SELECT spine.user_id, strftime").replace("PARTITION BY user_id ORDER BY ts ROWS", "PARTITION BY spine.user_id ORDER BY ts ROWS"))
def resample_mean_ffill(spark, sf_dir):
    out = missing.resample_time_series(events(spark, sf_dir), Series(("ts",), ("user_id",)), "value", "6 hours", "mean", "ffill")
    return out.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.round("value", 6).alias("value"))


@query(f"{_bins('sum(value)')} SELECT spine.user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, round(coalesce(value, 0), 6) AS value FROM spine LEFT JOIN bins ON bins.user_id = spine.user_id AND bins.w = spine.ts")
def resample_sum(spark, sf_dir):
    out = missing.resample_time_series(events(spark, sf_dir), Series(("ts",), ("user_id",)), "value", "6 hours", "sum")
    return out.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.round("value", 6).alias("value"))


@query(f"{_bins('last(value ORDER BY ts, event_id)')} SELECT spine.user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, round(value, 6) AS value FROM spine LEFT JOIN bins ON bins.user_id = spine.user_id AND bins.w = spine.ts")
def resample_last(spark, sf_dir):
    out = missing.resample_time_series(events(spark, sf_dir), Series(("ts", "event_id"), ("user_id",)), "value", "6 hours", "last")
    return out.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.round("value", 6).alias("value"))


@query(f"SELECT event_id, round(value - (regr_intercept(value, rn) OVER u + regr_slope(value, rn) OVER u * rn), 6) AS value FROM (SELECT *, row_number() OVER ({W}) AS rn {G}) WINDOW u AS (PARTITION BY user_id)")
def detrend_linear(spark, sf_dir):
    return plain(spectral.detrend_series(events(spark, sf_dir, True), EVENTS, "value", "linear").select("event_id", "value"), "event_id")


@query(f"SELECT event_id, round(value - coalesce(lag(value) OVER ({W}), value), 6) AS value {E}")
def detrend_diff(spark, sf_dir):
    return plain(spectral.detrend_series(events(spark, sf_dir), EVENTS, "value", "diff").select("event_id", "value"), "event_id")


@query()
def detrend_median_poly(spark, sf_dir):
    df = spectral.detrend_series(events(spark, sf_dir), EVENTS, "value", "median", name="by_median")
    return plain(spectral.detrend_series(df, EVENTS, "value", "poly", 2, name="by_poly").select("event_id", "by_median", "by_poly"), "event_id")


@query(f"SELECT user_id, round(coalesce(sum(d * l1) / sum(d * d), 0), 6) AS acf_1, round(coalesce(sum(d * l7) / sum(d * d), 0), 6) AS acf_7 FROM (SELECT *, lag(d, 1) OVER ({W}) AS l1, lag(d, 7) OVER ({W}) AS l7 FROM (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS d {E})) GROUP BY user_id")
def autocorrelation(spark, sf_dir):
    return plain(spectral.acf(events(spark, sf_dir), EVENTS, "value", [1, 7]))


@query(f"SELECT user_id, k, round((x - y) / sqrt(2), 6) AS detail FROM (SELECT user_id, rn // 2 AS k, arg_min(value, rn) AS x, arg_max(value, rn) AS y FROM (SELECT user_id, value, row_number() OVER ({W}) - 1 AS rn {E}) GROUP BY ALL)")
def haar_detail(spark, sf_dir):
    return plain(spectral.haar_details(events(spark, sf_dir), EVENTS, "value"))


@query(f"SELECT event_id, round(avg(d) OVER u, 6) AS value_dwt_level_1_detail_mean, round(sum(d * d) OVER u, 6) AS value_dwt_level_1_detail_energy FROM (SELECT event_id, user_id, CASE WHEN rn % 2 = 0 THEN (value - coalesce(nx, value)) / sqrt(2) END AS d FROM (SELECT *, row_number() OVER ({W}) - 1 AS rn, lead(value) OVER ({W}) AS nx {E})) WINDOW u AS (PARTITION BY user_id)")
def haar_dwt_statistics(spark, sf_dir):
    t = spectral.DWTTransformer("haar", 1, ["mean", "energy"])
    out = plain(t.fit_transform(events(spark, sf_dir), EVENTS), "event_id")
    return out.select("event_id", "value_dwt_level_1_detail_mean", "value_dwt_level_1_detail_energy")


@query()
def db4_dwt_statistics(spark, sf_dir):
    return plain(spectral.DWTTransformer("db4", 3, list(spectral.DWT_STATISTICS)).fit_transform(events(spark, sf_dir), EVENTS), "event_id")


@query()
def stl_statistics(spark, sf_dir):
    return plain(spectral.STLTransformer(12, statistics=list(spectral.STL_STATISTICS)).fit_transform(events(spark, sf_dir), EVENTS), "event_id")


@query()
def seasonality(spark, sf_dir):
    return plain(spectral.detect_seasonality(events(spark, sf_dir), EVENTS, "value", 20, "fft"))


@query()
def change_point_positions(spark, sf_dir):
    return spectral.change_points(events(spark, sf_dir), EVENTS, "value", "pelt", 5, 5000.0)


# metrics: the last value as a forecast of the next
def _forecast(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).withColumn("p", F.lag("value").over(EVENTS.rows())).where("p is not null")


FC = f"(SELECT * FROM (SELECT *, lag(value) OVER ({W}) AS p, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY user_id) AS n {E}) WHERE p IS NOT NULL)"


@query(f"SELECT user_id, round(avg(abs(value - p)), 6) AS mae, round(sqrt(avg((value - p) ** 2)), 6) AS rmse, round(avg(abs(value - p) / greatest(abs(value), 1e-8)), 4) AS mape, round(avg(abs(value - p) / greatest(abs(value) + abs(p), 1e-8)), 6) AS smape, round(CASE WHEN var_pop(value) < 1e-8 THEN 0 ELSE 1 - sum((value - p) ** 2) / (var_pop(value) * count(*)) END, 6) AS r2, round(100 * avg(abs(value - p)) / max(value), 6) AS peak_error, round(avg(abs(value - p)) / stddev_pop(value), 6) AS nmae FROM {FC} GROUP BY user_id")
def metric_errors(spark, sf_dir):
    y, p = F.col("value"), F.col("p")
    return _forecast(spark, sf_dir).groupBy("user_id").agg(*[F.round(e, d).alias(n) for n, e, d in (("mae", M.mae(y, p), 6), ("rmse", M.rmse(y, p), 6), ("mape", M.mape(y, p), 4), ("smape", M.smape(y, p), 6), ("r2", M.r2(y, p), 6), ("peak_error", M.peak_error(y, p), 6), ("nmae", M.normalized_mae(y, p), 6))])


@query(f"SELECT user_id, round(avg(abs(value - p)) / greatest(avg(abs(value - s)), 1e-8), 6) AS mase FROM (SELECT *, lag(value, 7) OVER ({W}) AS s FROM {FC}) GROUP BY user_id")
def metric_mase(spark, sf_dir):
    return plain(M.mase(_forecast(spark, sf_dir), EVENTS, "value", "p", 7))


@query(f"SELECT user_id, round(avg((sign(a) = sign(b))::INT), 6) AS directional_accuracy FROM (SELECT user_id, value - lag(value) OVER ({W}) AS a, p - lag(p) OVER ({W}) AS b FROM {FC}) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY user_id")
def metric_directional(spark, sf_dir):
    return plain(M.directional_accuracy(_forecast(spark, sf_dir), EVENTS, "value", "p"))


@query(f"SELECT user_id, round(sum(w * abs(value - p)) / sum(w), 6) AS weighted_mae FROM (SELECT *, pow(0.99, n - rn) * CASE WHEN n = rn THEN 2 ELSE 1 END AS w FROM {FC}) GROUP BY user_id")
def metric_weighted(spark, sf_dir):
    df = M.recency_weights(_forecast(spark, sf_dir), EVENTS, 0.99, 2.0)
    return plain(df.groupBy("user_id").agg(M.mae(F.col("value"), F.col("p"), F.col("weight")).alias("weighted_mae")))


H = "(SELECT h, avg(abs(value - p)) AS e FROM (SELECT h, value, CASE h WHEN 1 THEN l1 WHEN 3 THEN l3 ELSE l7 END AS p FROM (SELECT *, " + ", ".join(f"lag(value, {k}) OVER ({W}) AS l{k}" for k in (1, 3, 7)) + f" {E}), (VALUES (1), (3), (7)) t(h)) WHERE p IS NOT NULL GROUP BY h)"


@query(f"SELECT round(sum((x - px) * (e + pe) / 2), 6) AS auc FROM (SELECT h / 7.0 AS x, lag(h / 7.0) OVER (ORDER BY h) AS px, e, lag(e) OVER (ORDER BY h) AS pe FROM {H})")
def metric_horizon_auc(spark, sf_dir):
    w = EVENTS.rows()
    wide = events(spark, sf_dir).withColumns({f"l{k}": F.lag("value", k).over(w) for k in (1, 3, 7)})
    wide = wide.select("value", F.explode(F.array(*[F.struct(F.lit(k).alias("h"), F.col(f"l{k}").alias("p")) for k in (1, 3, 7)])).alias("x")).select("value", "x.h", "x.p")
    errors = wide.where("p is not null").groupBy("h").agg(M.mae(F.col("value"), F.col("p")).alias("e"))
    return plain(M.area_under_curve(errors, "h", "e"))


LI = "l_quantity", "l_extendedprice", "l_discount", "l_tax"


def lines(spark, sf_dir) -> DataFrame:
    """Daily sums of lineitem: one multivariate series."""
    df = table(spark, sf_dir, "lineitem").select("l_shipdate", *LI)
    return df.groupBy(F.to_date("l_shipdate").alias("day")).agg(*[F.sum(F.col(c).cast("double")).alias(c[2:]) for c in LI], F.count("*").cast("double").alias("n"))


DL = "(SELECT l_shipdate::DATE AS day, sum(l_quantity::DOUBLE) AS quantity, sum(l_extendedprice::DOUBLE) AS extendedprice, sum(l_discount::DOUBLE) AS discount, sum(l_tax::DOUBLE) AS tax, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)"


def _selected(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query(f"SELECT feature FROM (SELECT unnest(['quantity', 'extendedprice', 'discount', 'tax', 'n']) AS feature, unnest([var_samp(quantity), var_samp(extendedprice), var_samp(discount), var_samp(tax), var_samp(n)]) AS v FROM {DL}) WHERE v > 1.0")
def variance_selector(spark, sf_dir):
    return _selected(spark, selection.VarianceThresholdSelector(1.0).fit(lines(spark, sf_dir), DAYS).selected_features_)


@query("SELECT feature FROM (SELECT unnest(['value', 'odd']) AS feature, unnest([avg((value IS NULL)::INT), avg((odd IS NULL)::INT)]) AS m FROM (SELECT CASE WHEN event_id % 5 <> 0 THEN value END AS value, CASE WHEN event_id % 2 = 0 THEN value END AS odd FROM events)) WHERE m <= 0.3")
def missing_value_selector(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("odd", F.when(F.col("event_id") % 2 == 0, F.col("value"))).withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return _selected(spark, selection.MissingValueSelector(0.3).fit(df, EVENTS).selected_features_)


@query(f"SELECT feature, round(r, 6) AS score, row_number() OVER (ORDER BY r DESC, feature) AS rank FROM (SELECT unnest(['quantity', 'discount', 'tax', 'n']) AS feature, unnest([abs(corr(quantity, extendedprice)), abs(corr(discount, extendedprice)), abs(corr(tax, extendedprice)), abs(corr(n, extendedprice))]) AS r FROM {DL})")
def pearson_ranking(spark, sf_dir):
    s = selection.association(lines(spark, sf_dir), ["quantity", "discount", "tax", "n"], "extendedprice", "pearson", ["day"])
    return plain(spark.createDataFrame([(c, float(s[c]), i + 1) for i, c in enumerate(selection.ranked(s))], "feature string, score double, rank long"))


@query(f"SELECT unnest(['correlation', 'correlation_top_1', 'variance']) AS method, unnest([round((abs(corr(quantity, extendedprice)) + abs(corr(discount, extendedprice)) + abs(corr(tax, extendedprice))) / 3, 6), round(greatest(abs(corr(quantity, extendedprice)), abs(corr(discount, extendedprice)), abs(corr(tax, extendedprice))), 6), round((var_samp(quantity) + var_samp(discount) + var_samp(tax)) / 3, 4)]) AS score FROM {DL}")
def feature_quality(spark, sf_dir):
    df, names = lines(spark, sf_dir), ["quantity", "discount", "tax"]
    of = lambda method, top_k, digits: round(selection.feature_quality_score(df, names, "extendedprice", ["day"], method, top_k), digits)
    return spark.createDataFrame([("correlation", of("correlation", None, 6)), ("correlation_top_1", of("correlation", 1, 6)), ("variance", of("variance", None, 4))], "method string, score double")


@query(f"SELECT feature, round(r * r / (1 - r * r) * (k - 2), 2) AS score FROM (SELECT unnest(['quantity', 'discount', 'tax']) AS feature, unnest([corr(quantity, n), corr(discount, n), corr(tax, n)]) AS r, count(*) AS k FROM {DL} GROUP BY ALL)".replace("GROUP BY ALL", ""))
def f_regression_scores(spark, sf_dir):
    s = selection.association(lines(spark, sf_dir), ["quantity", "discount", "tax"], "n", "f_regression", ["day"])
    return spark.createDataFrame([(c, round(float(v), 2)) for c, v in s.items()], "feature string, score double")


@query()
def hybrid_selection(spark, sf_dir):
    s = selection.HybridFeatureSelector(list(selection.METHODS), "union", 3).fit(lines(spark, sf_dir), DAYS, "extendedprice")
    return s.get_selection_report(spark)


@query()
def combined_selection(spark, sf_dir):
    s = selection.CombinedFeatureSelector(0.2, 0.01, "shap", n_features=2).fit(lines(spark, sf_dir), DAYS, "extendedprice")
    return s.get_selection_report(spark)


@query()
def linear_shap_importance(spark, sf_dir):
    return selection.SHAPFeatureSelector().fit(lines(spark, sf_dir), DAYS, "extendedprice").get_feature_importance_df(spark)


NAMES = ["quantity", "extendedprice", "discount", "tax", "n"]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM {DL}" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]) + ")")
def correlation_pairs(spark, sf_dir):
    return plain(selection.correlation_matrix(lines(spark, sf_dir), NAMES))


@query(f"SELECT user_id, count(*) AS length, round(avg((value IS NULL)::INT), 6) AS missing_ratio, 1::BIGINT AS num_features, round(median(g), 6) AS freq_hourly FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER ({W}))) / 3.6e9 AS g {G}) GROUP BY user_id")
def meta_simple(spark, sf_dir):
    return plain(meta.simple(events(spark, sf_dir, True), EVENTS, "value"))


@query(f"""SELECT user_id, round(v, 6) AS variance, round(s, 6) AS skewness, round(k, 6) AS kurtosis, round(l, 6) AS linearity, round(exp(-n / 12.0 * (s * s + k * k / 4)), 6) AS normality_jarque, round(n * b, 6) AS bp_statistic
FROM (SELECT user_id, count(*) AS n, var_samp(value) AS v, avg((value - m) ** 3) / pow(avg((value - m) ** 2), 1.5) AS s, avg((value - m) ** 4) / pow(avg((value - m) ** 2), 2) - 3 AS k, regr_r2(value, rn) AS l, regr_r2((value - a - c * rn) ** 2, rn) AS b
FROM (SELECT *, avg(value) OVER u AS m, regr_intercept(value, rn) OVER u AS a, regr_slope(value, rn) OVER u AS c FROM (SELECT *, row_number() OVER ({W}) AS rn {E}) WINDOW u AS (PARTITION BY user_id)) GROUP BY user_id)""")
def meta_statistical(spark, sf_dir):
    return plain(meta.statistical(events(spark, sf_dir), EVENTS, "value"))


@query()
def meta_tests(spark, sf_dir):
    return plain(meta.tests(events(spark, sf_dir), EVENTS, "value"))


@query(f"SELECT user_id, " + ", ".join(f"round(CASE WHEN least(n // 2, 400) >= {k} THEN coalesce(sum(d * l{k}) / ss, 0) END, 6) AS acf_{k}" for k in meta.ACF_LAGS) + f" FROM (SELECT *, count(*) OVER u AS n, sum(d * d) OVER u AS ss FROM (SELECT *, " + ", ".join(f"lag(d, {k}) OVER ({W}) AS l{k}" for k in meta.ACF_LAGS) + f" FROM (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS d {E})) WINDOW u AS (PARTITION BY user_id)) GROUP BY user_id, n, ss")
def meta_autocorrelations(spark, sf_dir):
    return plain(meta.autocorrelations(events(spark, sf_dir), EVENTS, "value"))


@query()
def meta_spectrum(spark, sf_dir):
    return plain(meta.spectrum(events(spark, sf_dir), EVENTS, "value"))


@query(f"SELECT user_id, round(-sum(p * ln(p)) / ln(6), 6) AS permutation_entropy FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM (SELECT user_id, (a <= b)::INT * 4 + (b <= c)::INT * 2 + (a <= c)::INT AS k FROM (SELECT user_id, lag(value, 2) OVER ({W}) AS a, lag(value) OVER ({W}) AS b, value AS c {E}) WHERE a IS NOT NULL) GROUP BY user_id, k) GROUP BY user_id")
def permutation_entropy(spark, sf_dir):
    return plain(meta.permutation_entropy(events(spark, sf_dir), EVENTS, "value"))


@query(f"SELECT user_id, round(2 * regr_slope(s, k), 6) AS hurst_exponent FROM (SELECT user_id, ln(j) AS k, 0.5 * ln(stddev_pop(d)) AS s FROM (" + " UNION ALL ".join(f"SELECT user_id, {k} AS j, value - lag(value, {k}) OVER ({W}) AS d, count(*) OVER (PARTITION BY user_id) AS n {E}" for k in range(2, 12)) + ") WHERE j < least(12, n // 2) GROUP BY user_id, j HAVING stddev_pop(d) > 1e-10) GROUP BY user_id")
def hurst_exponent(spark, sf_dir):
    return plain(meta.hurst(events(spark, sf_dir), EVENTS, "value", 12))


@query(f"""SELECT user_id, round(-sum(d * ln(d)), 6) AS entropy FROM (SELECT user_id, count(*) / n / ((hi - lo) / 10) AS d FROM (SELECT *, min(z) OVER u AS lo, max(z) OVER u AS hi, count(*) OVER u AS n
FROM (SELECT user_id, (value - avg(value) OVER (PARTITION BY user_id)) / stddev_pop(value) OVER (PARTITION BY user_id) AS z {E}) WINDOW u AS (PARTITION BY user_id)) GROUP BY user_id, n, lo, hi, least(floor((z - lo) / (hi - lo) * 10), 9)) GROUP BY user_id""")
def density_entropy(spark, sf_dir):
    return plain(meta.density_entropy(events(spark, sf_dir), EVENTS, "value"))


@query(f"""SELECT user_id, round((avg(abs(value - a - c * rn)) - avg(abs(value - mv))) / avg(abs(value - a - c * rn)), 6) AS nonlinearity FROM (SELECT *, regr_intercept(value, rn) OVER u AS a, regr_slope(value, rn) OVER u AS c,
CASE least(10, greatest(2, count(*) OVER u // 10)) {" ".join(f"WHEN {k} THEN avg(value) OVER ({W} ROWS BETWEEN {k // 2} PRECEDING AND {(k - 1) // 2} FOLLOWING)" for k in range(2, 11))} END AS mv FROM (SELECT *, row_number() OVER ({W}) AS rn {E}) WINDOW u AS (PARTITION BY user_id)) GROUP BY user_id""")
def nonlinearity(spark, sf_dir):
    return plain(meta.nonlinearity(events(spark, sf_dir), EVENTS, "value"))


@query(f"""SELECT user_id, round(avg(abs(value - coalesce(l, value))), 6) AS naive_error, round(avg(abs(value - s)), 6) AS seasonal_naive_error, round(avg(abs(value - r)), 6) AS ar_error, round(avg(abs(value - r)) / avg(abs(value - coalesce(l, value))), 6) AS error_ratio
FROM (SELECT *, pow(a, rn) * y0 + b * (1 - pow(a, rn)) / (1 - a) AS r FROM (SELECT *, regr_slope(value, l) OVER u AS a, regr_intercept(value, l) OVER u AS b, first_value(value) OVER ({W}) AS y0 FROM (SELECT *, row_number() OVER ({W}) - 1 AS rn, lag(value) OVER ({W}) AS l, lag(value, 24) OVER ({W}) AS s {E}) WINDOW u AS (PARTITION BY user_id))) GROUP BY user_id""")
def landmarking(spark, sf_dir):
    return plain(meta.landmarking(events(spark, sf_dir), EVENTS, "value"))


def _profile(by: str):
    return lambda spark, sf_dir: plain(meta.profiles(events(spark, sf_dir), "ts", "value", by))


@query("SELECT hour(ts)::INT AS hour, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM events GROUP BY 1")
def profile_by_hour(spark, sf_dir):
    return _profile("hour")(spark, sf_dir)


@query("SELECT (isodow(ts) - 1)::INT AS weekday, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM events GROUP BY 1")
def profile_by_weekday(spark, sf_dir):
    return _profile("weekday")(spark, sf_dir)


@query("SELECT month(ts)::INT AS month, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM events GROUP BY 1")
def profile_by_month(spark, sf_dir):
    return _profile("month")(spark, sf_dir)


@query('SELECT \'value\' AS "column", count(*) AS rows, count(*) - count(value) AS missing, 0::BIGINT AS infinite, round(min(value), 6) AS least, round(max(value), 6) AS greatest ' + G)
def validation_summary(spark, sf_dir):
    return plain(validation.summary(events(spark, sf_dir, True), EVENTS))


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def validation_duplicates(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    out = validation.duplicate_times(df, Series(("o_orderdate",), ("o_custkey",)))
    return out.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "n")


@query(f"SELECT user_id, round(median(g), 3) AS gap_seconds, stddev_pop(g) <= 0.1 * median(g) AS regular, CASE WHEN median(g) / 3600 < 1.5 THEN 'H' WHEN median(g) / 3600 < 25 THEN 'D' WHEN median(g) / 3600 < 169 THEN 'W' ELSE 'M' END AS freq FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER ({W}))) / 1e6 AS g {E}) WHERE g IS NOT NULL GROUP BY user_id")
def validation_frequency(spark, sf_dir):
    return validation.frequency(events(spark, sf_dir), EVENTS).withColumn("gap_seconds", F.round("gap_seconds", 3))


@query("SELECT user_id, coalesce(sum((ts < p)::INT), 0)::BIGINT AS n_late FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY user_id")
def validation_out_of_order(spark, sf_dir):
    return validation.out_of_order(events(spark, sf_dir), EVENTS, "event_id")


@query(f"SELECT event_id, (ntile(6) OVER ({W}) - 1)::INT AS fold {E}")
def time_series_folds(spark, sf_dir):
    return P.folds(events(spark, sf_dir), EVENTS).select("event_id", "fold")


@query(f"SELECT event_id, (rn <= floor(n * 0.8)) AS train FROM (SELECT event_id, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY user_id) AS n {E})")
def chronological_split(spark, sf_dir):
    train, test = P.chronological_split(events(spark, sf_dir), EVENTS)
    return train.select("event_id", F.lit(True).alias("train")).union(test.select("event_id", F.lit(False).alias("train")))


@query(f"""SELECT event_id, round(lag(value, 1) OVER ({W}), 6) AS core_lags_value_lag_1, round(lag(value, 24) OVER ({W}), 6) AS core_lags_value_lag_24, round(avg(value) OVER w, 6) AS core_window_value_identity_mean, round(stddev_samp(value) OVER w, 6) AS core_window_value_identity_std, round(min(value) OVER w, 6) AS core_window_value_identity_min, round(max(value) OVER w, 6) AS core_window_value_identity_max,
{_cycle_sql('hour', 'hour(ts)', 24).replace('AS time', 'AS time_time')}, ({DOW} >= 5)::INT AS calendar_time_is_weekend, round(lead(value) OVER ({W}), 6) AS target {E} WINDOW w AS {FR}""")
def core_features(spark, sf_dir):
    df = window.add_target(events(spark, sf_dir), EVENTS, "value", 1, keep_tail=True)
    steps = [
        ("core_lags", window.LagTransformer([1, 24]), True), ("core_window", window.WindowTransformer(24, ["identity"], ["mean", "std", "min", "max"]), True),
        ("time", TE.TimeEncodingTransformer("cyclic", "ts", ["hour"]), True), ("calendar", TE.CalendarFeaturesTransformer("ts", ["is_weekend"]), True),
    ]
    return plain(P.FeatureEngineeringPipeline(steps).fit(df, EVENTS, "target").transform(df, ["target"]), "event_id")


@query()
def auto_features(spark, sf_dir):
    df = window.add_target(events(spark, sf_dir), EVENTS, "value", 1)
    return plain(P.AutoFeatureEngineer(optimize=False).fit_transform(df, EVENTS, "target"), "event_id")


@query(f"SELECT name, round(v, 6) AS v FROM (SELECT unnest(['b', 'a']) AS name, unnest([c / (s + 1), my - c / (s + 1) * mx]) AS v FROM (SELECT sum((l - mx) * (value - my)) AS c, sum((l - mx) ** 2) AS s, any_value(mx) AS mx, any_value(my) AS my FROM (SELECT *, avg(l) OVER () AS mx, avg(value) OVER () AS my FROM (SELECT value, lag(value) OVER ({W}) AS l {E}) WHERE l IS NOT NULL)))")
def ridge_model(spark, sf_dir):
    df = window.create_lagged_features(events(spark, sf_dir), EVENTS, [1], ["value"]).where("value_lag_1 is not null")
    b, a = selection.ridge(df, ["value_lag_1"], "value")
    return plain(spark.createDataFrame([("b", b["value_lag_1"]), ("a", a)], "name string, v double"))


HE = f"""(SELECT h AS horizon, m AS model, avg(abs(y - p)) AS error FROM (SELECT h, m, CASE h WHEN 1 THEN y1 ELSE y3 END AS y, CASE m WHEN 'last' THEN value WHEN 'season' THEN s ELSE a END AS p
FROM (SELECT value, lag(value, 6) OVER ({W}) AS s, avg(value) OVER ({W} ROWS UNBOUNDED PRECEDING) AS a, lead(value, 1) OVER ({W}) AS y1, lead(value, 3) OVER ({W}) AS y3 {E}), (VALUES (1), (3)) t(h), (VALUES ('last'), ('season'), ('mean')) u(m)) WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ALL)"""


@query(f"SELECT horizon, model, round(error, 6) AS error FROM {HE}")
def horizon_error_curves(spark, sf_dir):
    return plain(models.horizon_errors(events(spark, sf_dir), EVENTS, "value", [1, 3]))


@query(f"SELECT horizon, arg_min(model, error) AS model, round(min(error), 6) AS error FROM {HE} GROUP BY horizon")
def best_model_by_horizon(spark, sf_dir):
    return plain(models.best_by_horizon(models.horizon_errors(events(spark, sf_dir), EVENTS, "value", [1, 3])))


@query(f"SELECT horizon, round(max(error) FILTER (model = 'last'), 6) AS last, round(max(error) FILTER (model = 'season'), 6) AS season, round(max(error) FILTER (model = 'mean'), 6) AS mean FROM {HE} GROUP BY horizon")
def model_error_pivot(spark, sf_dir):
    errors = models.horizon_errors(events(spark, sf_dir), EVENTS, "value", [1, 3])
    return plain(errors.groupBy("horizon").pivot("model", ["last", "season", "mean"]).agg(F.max("error")))


@query("SELECT * FROM (VALUES ('lags', 3.0::DOUBLE), ('windows', 5.5::DOUBLE), ('time', 0.0::DOUBLE)) t(\"group\", importance)")
def feature_group_importance(spark, sf_dir):
    rows = spark.createDataFrame([("a_lag_1", 1.0), ("a_lag_7", 2.0), ("a_roll_7_mean", 5.0), ("a.sma.std", 0.5)], "feature string, importance double")
    return models.group_importance(rows, {"lags": "lag_", "windows": "roll_|[.]sma[.]", "time": "^time"})


@query("SELECT year(o_orderdate)::INT AS year, round(avg(o_totalprice::DOUBLE), 4) AS mean, count(*) AS n FROM orders GROUP BY 1")
def yearly_mean(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderdate", F.col("o_totalprice").cast("double").alias("v"))
    return df.groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.avg("v"), 4).alias("mean"), F.count("*").alias("n"))


@query()
def random_forest_forecast(spark, sf_dir):
    df = window.create_lagged_features(window.add_target(events(spark, sf_dir), EVENTS, "value", 1), EVENTS, [1, 2, 7], ["value"])
    names = ["value_lag_1", "value_lag_2", "value_lag_7"]
    train, test = P.chronological_split(df, EVENTS)
    made = models.predict(models.fit_model(train, names, "target", "random_forest", 10, 3), test, names, "target")
    return plain(made.select("event_id", "target", "prediction"), "event_id")


@query()
def standardised_components(spark, sf_dir):
    made = models.principal_components(lines(spark, sf_dir), NAMES, 3)
    return made.select(F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.round(F.get("components", F.lit(i)), 6).alias(f"c{i}") for i in range(3)])


@query()
def feature_method_overlap(spark, sf_dir):
    tops = selection.compare_feature_selection_methods(lines(spark, sf_dir), ["quantity", "discount", "tax", "n"], "extendedprice", ["day"], ["pearson", "f_regression", "distance_corr"], 2)
    return spark.createDataFrame(selection.analyze_feature_intersection(tops), "a string, b string, n_both int, jaccard double")


@query("SELECT event_id, round(avg(value) OVER w, 8) AS value_sma_mean, round(max(value) OVER w, 8) AS value_sma_max FROM (SELECT event_id, ts, avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS value FROM events) WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")
def long_series_window(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("ts", "event_id", "value")
    step = window.WindowTransformer(24, ["sma"], ["mean", "max"])
    # a window over windows reaches twice as far back
    out = long_series.transform_long(step, df, Series(("ts", "event_id")), 46, 1000)
    return out.select("event_id", *[F.round(col(f"value.sma.{s}"), 8).alias(f"value_sma_{s}") for s in ("mean", "max")])
