"""Feature pipelines, their automatic choice, and the search for better ones."""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.errors import TimeSeriesError
from seriesloom.functions.metrics import get_scorer
from seriesloom.operators.base import TimeSeriesTransformer
from seriesloom.operators.meta import MetaFeatureExtractor
from seriesloom.operators.selection import CombinedFeatureSelector, analyze_feature_selection, ridge
from seriesloom.operators.spectral import DWTTransformer, STLTransformer
from seriesloom.operators.time_encoding import CalendarFeaturesTransformer, TimeEncodingTransformer
from seriesloom.operators.validation import frequency
from seriesloom.operators.window import LagTransformer, WindowTransformer
from seriesloom.series import Series, col, known

Step = tuple[str, TimeSeriesTransformer, bool]


class FeatureEngineeringPipeline:
    """Steps side by side: each sees the raw columns, and its features are named {step}.{feature}. One lazy plan."""

    def __init__(self, steps: list[Step]):
        names = [n for n, _, _ in steps]
        if len(set(names)) != len(names):
            raise TimeSeriesError("steps need names of their own")
        self.steps = steps

    def fit(self, df: DataFrame, series: Series, target: str | None = None) -> FeatureEngineeringPipeline:
        self.series = series
        for _, step, active in self.steps:
            if active:
                step.fit(df, series, target)
        return self

    def get_feature_names_out(self) -> list[str]:
        return [f"{n}.{f}" for n, step, active in self.steps if active for f in step.get_feature_names_out()]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Key, order, the columns to keep, and the features."""
        wide = df
        for n, step, active in self.steps:
            if active:
                added = step.add(wide)
                wide = added.withColumnsRenamed({f: f"{n}.{f}" for f in step.get_feature_names_out()})
        columns = [*self.series.key, *self.series.order, *(keep or []), *self.get_feature_names_out()]
        return wide.select(*map(col, dict.fromkeys(columns)))


def core_steps(df: DataFrame, series: Series) -> list[Step]:
    """Lags by frequency and a window one longer than the longest, as far as the series are long enough."""
    longest = df.groupBy(*series.keys()).count().agg(F.max("count")).head()[0] or 0
    row = None
    if dict(df.dtypes)[series.order[0]].startswith(("timestamp", "date")):
        row = frequency(df, series).agg(F.median("gap_seconds").alias("gap")).head()
    gap = row["gap"] if row else None
    if gap is None:
        lags = [1, min(10, longest // 20), min(50, longest // 5)]
    elif gap <= 1800:
        lags = [1, 4, 96, 672]
    elif gap < 1.5 * 3600:
        lags = [1, 24, 168]
    elif 20 * 3600 <= gap < 25 * 3600:
        lags = [1, 7, 30, 365]
    else:
        lags = [1, min(24, longest // 10), min(168, longest // 2)]
    lags = sorted({k for k in lags if 1 <= k < longest}) or [1]
    size = min(max(lags) + 1, max(longest - 1, 2))
    return [("core_lags", LagTransformer(lags), True), ("core_window", WindowTransformer(size, ["identity"], ["mean", "std", "min", "max"]), True)]


def default_steps(df: DataFrame, series: Series) -> list[Step]:
    n = df.groupBy(*series.keys()).count().agg(F.max("count")).head()[0] or 0
    timed = dict(df.dtypes)[series.order[0]].startswith(("timestamp", "date"))
    size = 24 if n >= 48 else max(6, n // 10)
    return [
        ("window", WindowTransformer(size, ["identity", "diff"], ["mean", "std", "min", "max", "slope", "acf1"]), n > size),
        ("dwt", DWTTransformer("db4", 3), n >= 50),
        ("stl", STLTransformer(24), timed and n >= 100),
        ("time", TimeEncodingTransformer("cyclic", series.order[0] if timed else None, ["hour", "day_of_week"]), timed),
        ("calendar", CalendarFeaturesTransformer(series.order[0] if timed else None, ["part_of_day", "is_weekend"]), timed),
    ]


def folds(df: DataFrame, series: Series, n_splits: int = 5) -> DataFrame:
    """df with `fold`, 0 to n_splits by time within each series: fold k is tested on what comes before it."""
    return df.withColumn("fold", F.ntile(n_splits + 1).over(series.rows()) - 1)


def chronological_split(df: DataFrame, series: Series, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    wide = df.withColumn("__p", series.position()).withColumn("__n", F.count("*").over(series.whole()))
    first = F.col("__p") <= F.floor(F.col("__n") * share)
    return wide.where(first).drop("__p", "__n"), wide.where(~first).drop("__p", "__n")


def predicted(df: DataFrame, features: list[str], model: tuple[dict[str, float], float], means: dict[str, float]) -> Column:
    b, a = model
    p = F.lit(float(a))
    for c in features:
        p = p + F.coalesce(known(col(c)), F.lit(float(means[c]))) * float(b[c])
    return p


def cross_validated(df: DataFrame, series: Series, features: list[str], target: str, metric: str | Callable[[Column, Column], Column] = "neg_mean_absolute_error", n_splits: int = 5, alpha: float = 1.0) -> list[float]:
    """Scores of a ridge model on each fold, trained on the folds before it."""
    score = get_scorer(metric)[0] if isinstance(metric, str) else metric
    rows = folds(df.select(*map(col, dict.fromkeys([*series.key, *series.order, *features, target]))), series, n_splits).persist()
    try:
        out = []
        for k in range(1, n_splits + 1):
            train = rows.where(F.col("fold") < k)
            row = train.agg(*[F.avg(known(col(c))).alias(f"m{i}") for i, c in enumerate(features)]).head()
            means = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(features)}
            p = predicted(rows, features, ridge(train, features, target, alpha), means)
            out.append(rows.where(F.col("fold") == k).where(known(col(target)).isNotNull()).agg(score(known(col(target)), p).alias("s")).head()["s"])
        return [s for s in out if s is not None]
    finally:
        rows.unpersist()


def evaluate_block_performance(df: DataFrame, series: Series, blocks: dict[str, list[str]], target: str, cv: int = 3) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation of the mean absolute error for each block of features."""
    out = {}
    for name, features in blocks.items():
        if features:
            s = [-v for v in cross_validated(df, series, features, target, n_splits=cv)]
            out[name] = (float(np.mean(s)), float(np.std(s)))
    return out


@dataclass
class OptimizerConfig:
    # fixed values: weights and limits of the penalties, and the scores of failed trials
    dominance_limit: float = 0.7
    dominance_weight: float = 0.5
    naive_limit: float = 0.95
    naive_weight: float = 0.3
    entropy_weight: float = 0.1
    failed: float = 1e6
    n_calls: int = 30
    n_initial_points: int = 10
    n_splits: int = 5
    seed: int = 42
    mode: str = "full"


#: What is searched: fixed domains.
SPACE: dict[str, list] = {
    "use_window": [True, False], "window_size": [6, 12, 24, 48, 96, 168], "window_identity": [True, False], "window_diff": [True, False], "window_pct_change": [True, False],
    "window_sma": [True, False], "stat_mean": [True, False], "stat_std": [True, False], "stat_min": [True, False], "stat_max": [True, False], "stat_slope": [True, False],
    "use_dwt": [True, False], "wavelet": ["db4", "db8", "sym4", "coif1"], "dwt_level": [1, 2, 3, 4], "use_stl": [True, False], "stl_period": [12, 24, 48, 168],
    "use_time_encoding": [True, False], "time_encoding": ["cyclic", "time2vec"], "use_calendar": [True, False],
}


@dataclass
class FeatureEngineeringOptimizer:
    """Search over pipelines: first points from heuristics and chance, then Gaussian-process expected improvement."""

    config: OptimizerConfig = field(default_factory=OptimizerConfig)
    metric: str = "neg_mean_absolute_error"

    def build(self, params: dict, df: DataFrame, series: Series) -> list[Step]:
        n = df.groupBy(*series.keys()).count().agg(F.max("count")).head()[0] or 0
        timed = dict(df.dtypes)[series.order[0]].startswith(("timestamp", "date"))
        steps = core_steps(df, series)[:1]
        transformations = [t for t in ("identity", "diff", "pct_change", "sma") if params[f"window_{t}"]]
        statistics = [s for s in ("mean", "std", "min", "max", "slope") if params[f"stat_{s}"]]
        if params["use_window"] and transformations and statistics and n > params["window_size"]:
            steps.append(("window", WindowTransformer(params["window_size"], transformations, statistics), True))
        if self.config.mode != "baseline":
            if params["use_dwt"] and n >= 50:
                steps.append(("dwt", DWTTransformer(params["wavelet"], params["dwt_level"]), True))
            if params["use_stl"] and timed and n >= 2 * params["stl_period"]:
                steps.append(("stl", STLTransformer(params["stl_period"]), True))
            if params["use_time_encoding"] and timed:
                steps.append(("time", TimeEncodingTransformer(params["time_encoding"], series.order[0], fit_params=False), True))
        if self.config.mode == "full" and params["use_calendar"] and timed:
            steps.append(("calendar", CalendarFeaturesTransformer(series.order[0]), True))
        return steps

    def suggest_initial_points(self, meta: dict) -> list[dict]:
        seasonal = abs(meta.get("acf_24") or 0.0) > 0.3
        base = {k: v[0] for k, v in SPACE.items()} | {"window_size": 24, "stl_period": 24, "wavelet": "db4", "dwt_level": 3}
        return [base | {"use_stl": seasonal}, base | {"use_dwt": False, "use_stl": False}, base | {"window_diff": False, "window_pct_change": False, "window_sma": False, "use_dwt": False, "use_stl": False}]

    def penalty(self, df: DataFrame, features: list[str], target: str) -> float:
        """What speaks against a feature set: one feature that dominates, one that equals the target, one group only."""
        from seriesloom.operators.selection import association, create_feature_blocks, linear_importance

        c, of = self.config, linear_importance(df, features, target)
        whole = sum(of.values()) or 1.0
        top = max(of.values(), default=0.0) / whole
        p = c.dominance_weight * max(0.0, top - c.dominance_limit)
        if any((r or 0) > c.naive_limit for r in association(df, features, target, "pearson", []).values()):
            p += c.naive_weight
        shares = np.array([sum(of[f] for f in b) / whole for b in create_feature_blocks(features).values() if b])
        shares = shares[shares > 0]
        h = float(-(shares * np.log(shares)).sum() / np.log(len(shares))) if len(shares) > 1 else 0.0
        return p - c.entropy_weight * h

    def objective(self, params: dict, df: DataFrame, series: Series, target: str) -> float:
        pipe = FeatureEngineeringPipeline(self.build(params, df, series))
        try:
            pipe.fit(df, series, target)
            wide = pipe.transform(df, [target]).persist()
        except TimeSeriesError:
            return self.config.failed
        try:
            names = pipe.get_feature_names_out()
            scores = cross_validated(wide, series, names, target, self.metric, self.config.n_splits)
            return self.config.failed if not scores else -float(np.mean(scores)) + self.penalty(wide, names, target)
        finally:
            wide.unpersist()

    def optimize(self, df: DataFrame, series: Series, target: str, meta: dict | None = None) -> dict:
        rng = random.Random(self.config.seed)
        tried: list[tuple[dict, float]] = []
        points = self.suggest_initial_points(meta or {})
        for i in range(self.config.n_calls):
            if i < len(points):
                params = points[i]
            elif i < self.config.n_initial_points or len(tried) < 3:
                params = {k: rng.choice(v) for k, v in SPACE.items()}
            else:
                params = self._improve(tried, rng)
            tried.append((params, self.objective(params, df, series, target)))
        self.history_ = tried
        self.best_params_, self.best_score_ = min(tried, key=lambda t: t[1])
        return self.best_params_

    def _improve(self, tried: list[tuple[dict, float]], rng: random.Random) -> dict:
        code = lambda p: np.array([v.index(p[k]) / max(len(v) - 1, 1) for k, v in SPACE.items()])
        ok = [t for t in tried if t[1] < self.config.failed] or tried
        x, y = np.array([code(p) for p, _ in ok]), np.array([s for _, s in ok])
        y = (y - y.mean()) / (y.std() or 1.0)
        kernel = lambda a, b: np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(2) / 2)
        inverse = np.linalg.inv(kernel(x, x) + 1e-4 * np.eye(len(x)))
        candidates = [{k: rng.choice(v) for k, v in SPACE.items()} for _ in range(256)]
        c = np.array([code(p) for p in candidates])
        k = kernel(c, x)
        mean, sd = k @ inverse @ y, np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", k, inverse, k), 1e-9))
        z = (y.min() - mean) / sd
        from seriesloom.operators.meta import _normal_cdf

        gain = sd * (z * np.array([_normal_cdf(v) for v in z]) + np.exp(-z * z / 2) / np.sqrt(2 * np.pi))
        return candidates[int(gain.argmax())]

    def get_search_history(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, float(s), {k: str(v) for k, v in p.items()}) for i, (p, s) in enumerate(self.history_)], "call int, score double, params map<string,string>")


class AutoFeatureEngineer:
    """Meta-features, core and further steps, then selection; fit learns the names, transform computes only those."""

    def __init__(self, optimize: bool = True, use_meta_features: bool = True, n_calls: int = 30, n_initial_points: int = 10, metric: str = "neg_mean_absolute_error", apply_selection: bool = True, selection_threshold: float = 0.2, variance_threshold: float = 0.01, shap_selection: bool = False, shap_n_features: int | None = None, random_state: int = 42):
        self.optimize, self.use_meta_features, self.metric, self.apply_selection = optimize, use_meta_features, metric, apply_selection
        self.n_calls, self.n_initial_points, self.random_state = n_calls, n_initial_points, random_state
        self.selection_threshold, self.variance_threshold = selection_threshold, variance_threshold
        self.shap_selection, self.shap_n_features = shap_selection, shap_n_features

    def fit(self, df: DataFrame, series: Series, target: str) -> AutoFeatureEngineer:
        values = [c for c in series.values(df) if c != target] or [target]
        self.target_, self.meta_ = target, {}
        if self.use_meta_features:
            rows = MetaFeatureExtractor(["spectral"]).extract(df, series, values[0]).drop(*series.key)
            row = rows.agg(*[F.avg(c).alias(c) for c in rows.columns]).head()
            self.meta_ = row.asDict()
        steps = core_steps(df, series)
        if self.optimize:
            search = FeatureEngineeringOptimizer(OptimizerConfig(n_calls=self.n_calls, n_initial_points=self.n_initial_points, seed=self.random_state), self.metric)
            search.optimize(df, series, target, self.meta_)
            self.optimizer_ = search
            steps += [s for s in search.build(search.best_params_, df, series) if s[0] not in {n for n, _, _ in steps}]
        else:
            steps += [s for s in default_steps(df, series) if s[2]]
        self.pipeline_ = FeatureEngineeringPipeline(steps).fit(df, series, target)
        self.feature_names_ = self.pipeline_.get_feature_names_out()
        if self.apply_selection:
            wide = self.pipeline_.transform(df, [target])
            own = Series(series.order, series.key)
            self.selector_ = CombinedFeatureSelector(self.selection_threshold, self.variance_threshold, "shap", not self.shap_selection, n_features=self.shap_n_features).fit(wide, own, target)
            self.feature_names_ = [c for c in self.feature_names_ if c in set(self.selector_.selected_features_)]
        return self

    def transform(self, df: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Features of df; with history, its rows come before, so that lags and windows reach back, and go again."""
        s = self.pipeline_.series
        if history is None:
            return self.pipeline_.transform(df).select(*map(col, [*s.key, *s.order, *self.feature_names_]))
        both = history.select(*df.columns).withColumn("__own", F.lit(0)).union(df.withColumn("__own", F.lit(1)))
        return self.pipeline_.transform(both, ["__own"]).where("__own = 1").select(*map(col, [*s.key, *s.order, *self.feature_names_]))

    def fit_transform(self, df: DataFrame, series: Series, target: str) -> DataFrame:
        return self.fit(df, series, target).transform(df)

    def get_feature_names(self) -> list[str]:
        return list(self.feature_names_)

    def analyze_feature_selection(self, df: DataFrame, methods: list[str] | None = None, top_k: int = 20) -> dict:
        """As the function of that name, over the features of all steps; errors: the mean absolute error of a ridge model of
        each method's features over three folds in order of time."""
        s, names = self.pipeline_.series, self.pipeline_.get_feature_names_out()
        wide = self.pipeline_.transform(df, [self.target_]).persist()
        out = analyze_feature_selection(wide, names, self.target_, [*s.key, *s.order], methods, top_k)
        out["errors"] = {m: -float(np.mean(cross_validated(wide, s, own, self.target_, n_splits=3))) for m, own in out["tops"].items()}
        wide.unpersist()
        return out

    def save(self, path: str) -> None:
        """What was learned, as JSON."""
        s = self.pipeline_.series
        with open(path, "w") as f:
            json.dump({"features": self.feature_names_, "target": self.target_, "meta": self.meta_, "series": [list(s.order), list(s.key)], "steps": [[n, json.loads(t.state()), a] for n, t, a in self.pipeline_.steps]}, f, default=str)

    @classmethod
    def load(cls, path: str) -> AutoFeatureEngineer:
        """What save() wrote, ready to transform."""
        with open(path) as f:
            found = json.load(f)
        known_, todo = {}, [TimeSeriesTransformer]
        while todo:
            kind = todo.pop()
            known_[kind.__name__] = kind
            todo += kind.__subclasses__()
        series = Series(tuple(found["series"][0]), tuple(found["series"][1]))
        steps = []
        for name, state, active in found["steps"]:
            step = object.__new__(known_[state.pop("class")])
            step.__dict__.update(state, series=series)
            steps.append((name, step, active))
        out = cls()
        out.pipeline_ = FeatureEngineeringPipeline(steps)
        out.pipeline_.series = series
        out.feature_names_, out.target_, out.meta_ = found["features"], found["target"], found["meta"]
        return out
