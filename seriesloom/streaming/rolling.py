"""Lags and trailing statistics of unbounded series, with a ring of the last values as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seriesloom.errors import TimeSeriesError
from seriesloom.series import Series, col, known


def stream_features(df: DataFrame, series: Series, value: str, lags: list[int], window_size: int) -> DataFrame:
    """Key, order (the first order column), value, {value}_lag_{k}, {value}_roll_{w}_mean and _std for each arriving row.

    Rows of one batch are put in order; a row that comes in a later batch than its successors counts as the newest. The
    state of a key is its last max(lags, window_size) values, whatever the length of the stream.
    """
    if not series.key or not lags or min(lags) < 1 or window_size < 2:
        raise TimeSeriesError("a key, positive lags and a window of two or more are needed")
    ts, size = series.order[0], max(*lags, window_size)
    names = [f"{value}_lag_{k}" for k in lags] + [f"{value}_roll_{window_size}_mean", f"{value}_roll_{window_size}_std"]
    keys = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in series.key)
    schema = f"{keys}, `{ts}` {dict(df.dtypes)[ts]}, `{value}` double, " + ", ".join(f"`{n}` double" for n in names)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(list(series.order))
        out = []
        for t, v in zip(rows[ts], rows[value], strict=True):
            past = [*past, float("nan") if v is None else float(v)][-(size + 1) :]
            last = np.array(past[-window_size:])
            last = last[~np.isnan(last)]
            lagged = [past[-1 - k] if len(past) > k else float("nan") for k in lags]
            out.append((*key, t, v, *lagged, last.mean() if len(last) else float("nan"), last.std(ddof=1) if len(last) > 1 else float("nan")))
        state.update((past,))
        found = pd.DataFrame(out, columns=[*series.key, ts, value, *names])
        yield found.astype(object).where(found.notna(), None)

    rows = df.select(*series.keys(), *map(col, series.order), known(col(value)).alias(value))
    return rows.groupBy(*series.keys()).applyInPandasWithState(run, schema, "past array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_profile(df: DataFrame, ts: str, value: str, width: str = "1 hour", late: str = "10 minutes", key: tuple[str, ...] = ()) -> DataFrame:
    """Mean, standard deviation and number of values of each time window, once no later row can fall into it."""
    rows = df.withColumn(ts, col(ts).cast("timestamp")).withWatermark(ts, late)
    x = known(col(value))
    out = rows.groupBy(*map(col, key), F.window(col(ts), width).alias("w")).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(x).alias("n"))
    return out.select(*map(col, key), F.col("w.start").alias("start"), "mean", "std", "n")
