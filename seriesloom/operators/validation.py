"""Checks of data and parameters, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.errors import TimeSeriesError
from seriesloom.operators.time_encoding import TIME_NAMES, detect_time_column  # noqa: F401  part of this module's functions as well
from seriesloom.series import Series, col, known, numeric_columns


def summary(df: DataFrame, series: Series, columns: list[str] | None = None) -> DataFrame:
    """One row for each column: rows, missing (NULL or NaN), infinite, least, greatest."""
    names = series.values(df, columns)
    parts = []
    for c in names:
        x = col(c).cast("double")
        inf = F.coalesce(F.abs(x) == float("inf"), F.lit(False))
        parts.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.sum((x.isNull() | F.isnan(x)).cast("long")).alias("missing"), F.sum(inf.cast("long")).alias("infinite"), F.min(known(col(c))).alias("least"), F.max(known(col(c))).alias("greatest")))
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def duplicate_times(df: DataFrame, series: Series) -> DataFrame:
    """Key and order values that occur more than once, with their number."""
    return df.groupBy(*series.keys(), *map(col, series.order)).agg(F.count("*").alias("n")).where("n > 1")


def out_of_order(df: DataFrame, series: Series, arrival: str) -> DataFrame:
    """The number of rows of each series that come, by the arrival column, after a later time."""
    w = Series((arrival,), series.key).rows()
    late = col(series.order[0]) < F.lag(col(series.order[0])).over(w)
    return df.select(*series.keys(), late.alias("late")).groupBy(*series.keys()).agg(F.coalesce(F.sum(F.col("late").cast("long")), F.lit(0)).alias("n_late"))


def validate_time_series(df: DataFrame, series: Series, columns: list[str] | None = None, require_time: bool = True, allow_missing: bool = True, max_missing_ratio: float = 1.0, allow_constant: bool = True, min_rows: int = 2) -> list[str]:
    """Columns that passed all checks; the first failed one raises TimeSeriesError."""
    if not numeric_columns(df, (*series.key, *series.order)):
        raise TimeSeriesError("no numeric column")
    if require_time and not isinstance(df.schema[series.order[0]].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise TimeSeriesError(f"{series.order[0]} is not a time")
    rows = summary(df, series, columns).collect()
    n = rows[0]["rows"]
    if n < min_rows:
        raise TimeSeriesError(f"{n} rows; at least {min_rows} are needed")
    if not duplicate_times(df, series).isEmpty():
        raise TimeSeriesError("repeated times in a series")
    for r in rows:
        if r["infinite"]:
            raise TimeSeriesError(f"{r['column']} has {r['infinite']} infinite values")
        if r["missing"] and (not allow_missing or r["missing"] / n > max_missing_ratio):
            raise TimeSeriesError(f"{r['column']} has {r['missing']} missing of {n}")
        if not allow_constant and r["least"] == r["greatest"]:
            raise TimeSeriesError(f"{r['column']} is constant")
    return [r["column"] for r in rows]


def validate_target_series(df: DataFrame, target: str, allow_missing: bool = False) -> None:
    if target not in df.columns or target not in numeric_columns(df):
        raise TimeSeriesError(f"{target} is not a numeric column")
    row = df.agg(F.count("*").alias("n"), F.count(known(col(target))).alias("k")).head()
    if not row["n"]:
        raise TimeSeriesError("no rows")
    if not allow_missing and row["k"] < row["n"]:
        raise TimeSeriesError(f"{target} has {row['n'] - row['k']} missing values")


def validate_transformer_params(params: dict, required: list[str] | None = None, ranges: dict[str, tuple] | None = None, allowed: dict[str, list] | None = None) -> dict:
    if missing := [k for k in required or [] if params.get(k) is None]:
        raise TimeSeriesError(f"parameters {missing} are needed")
    for k, (lo, hi) in (ranges or {}).items():
        if k in params and not lo <= params[k] <= hi:
            raise TimeSeriesError(f"{k} must be between {lo} and {hi}")
    for k, values in (allowed or {}).items():
        if k in params and params[k] not in values:
            raise TimeSeriesError(f"{k} must be one of {values}")
    return params


def frequency(df: DataFrame, series: Series) -> DataFrame:
    """For each series the median gap in seconds, whether gaps vary by more than a tenth of it, and the nearest of H, D, W, M."""
    t = F.unix_micros(col(series.order[0]).cast("timestamp")) / 1e6
    gaps = df.select(*series.keys(), (t - F.lag(t).over(series.rows())).alias("g")).where("g is not null")
    out = gaps.groupBy(*series.keys()).agg(F.median("g").alias("gap_seconds"), F.stddev_pop("g").alias("__s"))
    hours = F.col("gap_seconds") / 3600
    name = F.when(hours < 1.5, "H").when(hours < 25, "D").when(hours < 169, "W").otherwise("M")
    return out.select(*series.keys(), "gap_seconds", (F.col("__s") <= 0.1 * F.col("gap_seconds")).alias("regular"), name.alias("freq"))


def validate_frequency(df: DataFrame, series: Series, require_regular: bool = False, least: float | None = None, most: float | None = None) -> DataFrame:
    found = frequency(df, series)
    bad = F.lit(False)
    if require_regular:
        bad = bad | ~F.col("regular")
    if least is not None:
        bad = bad | (F.col("gap_seconds") < least)
    if most is not None:
        bad = bad | (F.col("gap_seconds") > most)
    if not found.where(bad).isEmpty():
        raise TimeSeriesError("a series has another frequency than asked for")
    return found


def validate_window_size(window: int, n: int, least: float = 0.01, most: float = 0.5) -> int:
    if not isinstance(window, int) or window < 1:
        raise TimeSeriesError("a window is a positive integer")
    if not max(1, int(n * least)) <= window <= int(n * most):
        raise TimeSeriesError(f"a window of {window} does not go with {n} rows")
    return window


def validate_no_leakage(train: DataFrame, test: DataFrame, series: Series) -> None:
    """Every test time is after every train time of its series."""
    ts = series.order[0]
    a = train.groupBy(*series.keys()).agg(F.max(ts).alias("__a"))
    b = test.groupBy(*series.keys()).agg(F.min(ts).alias("__b"))
    both = a.join(b, list(series.key)) if series.key else a.join(b, F.col("__a") >= F.col("__b"))
    if not both.where("__a >= __b").isEmpty():
        raise TimeSeriesError("test times do not all follow train times")


def parse_ratio(df: DataFrame, column: str) -> float:
    """The share of a string column's values that read as a time."""
    row = df.agg(F.count(col(column)).alias("n"), F.count(F.try_to_timestamp(col(column))).alias("k")).head()
    return row["k"] / row["n"] if row["n"] else 0.0


def detect_time_column_by_content(df: DataFrame, least: float = 0.9) -> str:
    """As detect_time_column, then string columns of which nearly all values read as times."""
    try:
        return detect_time_column(df)
    except TimeSeriesError:
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StringType) and parse_ratio(df, f.name) > least:
                return f.name
        raise
