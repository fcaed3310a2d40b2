"""One long series over many tasks: ranges give positions, and chunks with a halo give windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.errors import TimeSeriesError
from seriesloom.operators.base import TimeSeriesTransformer
from seriesloom.series import Series, col

CHUNK, POSITION, HALO = "__chunk", "__position_in_all", "__halo"


def with_position(df: DataFrame, series: Series, ranges: int = 64) -> DataFrame:
    """df with the position of each row in the whole order, from 1, without a task that holds all rows.

    The first order column is cut at quantiles; rows are numbered within each range and the ranges' sizes added up. Equal
    values of that column stay in one range. At most `ranges` bounds and sizes reach the driver.
    """
    if series.key:
        raise TimeSeriesError("positions over ranges are for a frame that is one series")
    kind = dict(df.dtypes)[series.order[0]]
    x = F.unix_micros(col(series.order[0]).cast("timestamp")) if kind.startswith(("timestamp", "date")) else col(series.order[0]).cast("double")
    steps = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(df.agg(F.percentile_approx(x, F.lit(steps), 10_000).alias("b")).head()["b"] or []))
    cuts = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    wide = df.withColumn("__range", F.size(F.filter(cuts, lambda b: b < x)))
    before, starts = 0, {}
    for r in wide.groupBy("__range").count().orderBy("__range").collect():
        starts[r["__range"]] = before
        before += r["count"]
    offsets = F.create_map(*[F.lit(v).cast(t) for k, s in starts.items() for v, t in ((k, "int"), (s, "long"))]) if starts else F.create_map(F.lit(0), F.lit(0).cast("long"))
    number = F.row_number().over(Window.partitionBy("__range").orderBy(*map(col, series.order)))
    return wide.withColumn(POSITION, F.element_at(offsets, F.col("__range")) + number).drop("__range")


def chunks(df: DataFrame, series: Series, halo: int, rows: int = 100_000, ranges: int = 64) -> DataFrame:
    """Rows with the chunk they belong to, and again, marked, in the next one if they are among a chunk's last `halo` rows."""
    if halo >= rows:
        raise TimeSeriesError("a chunk must be longer than its halo")
    wide = with_position(df, series, ranges)
    own = F.floor((F.col(POSITION) - 1) / rows).cast("int")
    late = (F.col(POSITION) - 1) % rows >= rows - halo
    places = F.when(late, F.array(F.struct(own.alias("c"), F.lit(False).alias("h")), F.struct((own + 1).alias("c"), F.lit(True).alias("h")))).otherwise(F.array(F.struct(own.alias("c"), F.lit(False).alias("h"))))
    return wide.withColumn("__p", F.explode(places)).withColumn(CHUNK, F.col("__p.c")).withColumn(HALO, F.col("__p.h")).drop("__p", POSITION)


def transform_long(step: TimeSeriesTransformer, df: DataFrame, series: Series, reach: int, rows: int = 100_000) -> DataFrame:
    """What step.fit_transform(df, series) gives for features that look at most `reach` rows back, in tasks of about `rows` rows."""
    step.fit(df, series)
    whole, step.series = step.series, Series(series.order, (CHUNK,))
    try:
        made = step.add(chunks(df, series, reach, rows))
    finally:
        step.series = whole
    return made.where(~F.col(HALO)).select(*[col(c) for c in (*series.order, *step.get_feature_names_out())])
