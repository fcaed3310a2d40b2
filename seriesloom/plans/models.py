"""Models on feature frames, through Spark's own library; and comparisons between them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.errors import TimeSeriesError
from seriesloom.functions.metrics import mae
from seriesloom.series import Series, col, known

MODELS = ("linear", "ridge", "random_forest", "gradient_boosting")


def _plain(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Columns f0, f1, ... and y, since the library's names cannot hold dots."""
    return df.select("*", *[known(col(c)).alias(f"f{i}") for i, c in enumerate(features)], known(col(target)).alias("y"))


def fit_model(df: DataFrame, features: list[str], target: str, kind: str = "ridge", trees: int = 100, depth: int = 5, alpha: float = 1.0, seed: int = 42):
    """A fitted pipeline; missing features count as their mean. For ridge the penalty equals alpha of a sum of squares."""
    if kind not in MODELS:
        raise TimeSeriesError(f"unknown model {kind}; known: {MODELS}")
    rows = _plain(df, features, target).where("y is not null")
    names = [f"f{i}" for i in range(len(features))]
    steps = [Imputer(inputCols=names, outputCols=names), VectorAssembler(inputCols=names, outputCol="x")]
    options = {"featuresCol": "x", "labelCol": "y", "predictionCol": "prediction"}
    if kind in ("linear", "ridge"):
        row = rows.agg(F.count("*").alias("n"), F.stddev_pop("y").alias("s")).head()
        penalty = alpha * (row["s"] or 0.0) / max(row["n"], 1) if kind == "ridge" else 0.0
        steps.append(LinearRegression(regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal", **options))
    elif kind == "random_forest":
        steps.append(RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, **options))
    else:
        steps.append(GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed, **options))
    return Pipeline(stages=steps).fit(rows.select(*names, "y"))


def predict(model, df: DataFrame, features: list[str], target: str) -> DataFrame:
    """df with `prediction`."""
    made = model.transform(_plain(df, features, target))
    return made.select(*map(col, df.columns), "prediction")


def principal_components(df: DataFrame, features: list[str], k: int) -> DataFrame:
    """df with the array `components` of its standardised features."""
    rows = _plain(df, features, features[0])
    names = [f"f{i}" for i in range(len(features))]
    steps = [Imputer(inputCols=names, outputCols=names), VectorAssembler(inputCols=names, outputCol="x"), StandardScaler(inputCol="x", outputCol="z", withMean=True), PCA(k=min(k, len(features)), inputCol="z", outputCol="p")]
    from pyspark.ml.functions import vector_to_array

    made = Pipeline(stages=steps).fit(rows.select(*names)).transform(rows)
    return made.select(*map(col, df.columns), vector_to_array("p").alias("components"))


def horizon_errors(df: DataFrame, series: Series, value: str, horizons: list[int]) -> DataFrame:
    """horizon, model, error: mean absolute errors of the last value, the last season's (7) and the series' mean so far."""
    w, x = series.rows(), known(col(value))
    past = series.before()
    made = df.withColumns({"__last": x, "__season": F.lag(x, 6).over(w), "__mean": F.avg(x).over(past), **{f"__y{h}": F.lead(x, h).over(w) for h in horizons}})
    cells = [F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("model"), F.col(f"__y{h}").alias("y"), F.col(f"__{m}").alias("p")) for h in horizons for m in ("last", "season", "mean")]
    long = made.select(F.inline(F.array(*cells))).where("y is not null and p is not null")
    return long.groupBy("horizon", "model").agg(mae(F.col("y"), F.col("p")).alias("error"))


def best_by_horizon(errors: DataFrame) -> DataFrame:
    return errors.groupBy("horizon").agg(F.min_by("model", F.struct("error", "model")).alias("model"), F.min("error").alias("error"))


def group_importance(importances: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Summed importance of the features whose names match each group's pattern; importances: feature, importance."""
    parts = [F.struct(F.lit(g).alias("group"), F.coalesce(F.sum(F.when(F.col("feature").rlike(p), F.col("importance"))), F.lit(0.0)).alias("importance")) for g, p in groups.items()]
    return importances.agg(F.array(*parts).alias("r")).select(F.inline("r"))
