"""Reading series from files and cleaning them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.errors import TimeSeriesError
from seriesloom.series import col, known


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header, whose names are trimmed; all columns are strings unless a schema is given."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def to_number(x: Column) -> Column:
    """A number from text with spaces, decimal commas or junk around; NULL where there is none."""
    text = F.regexp_replace(F.trim(x.cast("string")), ",", ".")
    return known(text.try_cast("double"))


def pick_column(df: DataFrame, *keywords: str) -> str:
    """The first column whose name holds a keyword, in the keywords' order."""
    for k in keywords:
        for c in df.columns:
            if k.lower() in c.lower():
                return c
    raise TimeSeriesError(f"no column named like {keywords}")


def load_series(df: DataFrame, time_column: str, value_column: str, key: tuple[str, ...] = ()) -> DataFrame:
    """key, ts, value: times and numbers read from text, rows without either dropped, the first row of equal times kept."""
    ts = F.try_to_timestamp(col(time_column)) if dict(df.dtypes)[time_column] == "string" else col(time_column)
    rows = df.select(*map(col, key), ts.alias("ts"), to_number(col(value_column)).alias("value")).where("ts is not null and value is not null")
    w = Window.partitionBy(*map(col, key), "ts").orderBy("value")
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
