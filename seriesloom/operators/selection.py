"""Choosing features: by missing values, variance, association with a target, importance in a linear model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.errors import TimeSeriesError
from seriesloom.operators.base import TimeSeriesTransformer
from seriesloom.series import Series, col, known

METHODS = ("pearson", "f_regression", "mutual_info", "distance_corr")
#: Rows on which compare_feature_selection_methods takes the measures that compare rows, as the reference does.
PAIR_ROWS = 1000


def correlation(x: Column, y: Column) -> Column:
    """Pearson over the rows where both are known; NULL where either does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.when(spread > 1e-20, spread))


def by_hash(df: DataFrame, order: list[str], rows: int, seed: int = 42) -> DataFrame:
    """At most so many rows, the same ones each time: those of least hash of their order columns."""
    return df.orderBy(F.xxhash64(*[col(c).cast("string") for c in order], F.lit(seed)), *map(col, order)).limit(rows)


def ranked(scores: dict[str, float | None]) -> list[str]:
    """Names by descending score, ties by name; those without a score are left out."""
    return sorted((k for k, v in scores.items() if v is not None and v == v), key=lambda k: (-scores[k], k))


class _Selector(TimeSeriesTransformer):
    selected_features_: list[str]

    def get_feature_names_out(self) -> list[str]:
        self._ready()
        return list(self.selected_features_)

    def get_support(self) -> list[bool]:
        return [c in set(self.selected_features_) for c in self.feature_names_in_]

    def add(self, df: DataFrame) -> DataFrame:
        return df


class VarianceThresholdSelector(_Selector):
    """Columns whose sample variance is above the threshold; without any, the one that varies most."""

    def __init__(self, threshold: float = 0.0):
        if threshold < 0:
            raise TimeSeriesError("threshold must not be negative")
        self.threshold = threshold

    def _fit(self, df: DataFrame, target: str | None) -> None:
        row = df.agg(*[F.var_samp(known(col(c))).alias(f"v{i}") for i, c in enumerate(self.feature_names_in_)]).head()
        self.variances_ = {c: row[f"v{i}"] for i, c in enumerate(self.feature_names_in_)}
        kept = [c for c in self.feature_names_in_ if (self.variances_[c] or 0.0) > self.threshold]
        self.selected_features_ = kept or ranked({c: v or 0.0 for c, v in self.variances_.items()})[:1]


class MissingValueSelector(_Selector):
    """Columns of which at most the threshold's share is missing; without any, the one that misses least."""

    def __init__(self, threshold: float = 0.2):
        if not 0 <= threshold <= 1:
            raise TimeSeriesError("threshold must be between 0 and 1")
        self.threshold = threshold

    def _fit(self, df: DataFrame, target: str | None) -> None:
        row = df.agg(*[F.avg(known(col(c)).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(self.feature_names_in_)]).head()
        self.ratios_ = {c: row[f"m{i}"] for i, c in enumerate(self.feature_names_in_)}
        kept = [c for c in self.feature_names_in_ if (self.ratios_[c] or 0.0) <= self.threshold]
        self.selected_features_ = kept or ranked({c: -(v or 0.0) for c, v in self.ratios_.items()})[:1]


def _distance_means(v: np.ndarray) -> np.ndarray:
    """For each value its mean distance to all values, by sorting."""
    n, order = len(v), np.argsort(v, kind="stable")
    s = v[order]
    before = np.cumsum(s) - s
    i = np.arange(n)
    out = np.empty(n)
    out[order] = (s * i - before + (before[-1] + s[-1] - before - s) - s * (n - 1 - i)) / n
    return out


def _mean_product_of_distances(x: np.ndarray, y: np.ndarray) -> float:
    """Mean of |x_i - x_j| |y_i - y_j| over all i and j: sums over the rows before a row in x and below it in y, by merging."""
    n, order = len(x), np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    parts = np.stack([np.ones(n), x, y, x * y])
    lower, by_y, width = np.zeros((4, n)), np.argsort(y, kind="stable"), 1
    while width < n:
        rows = by_y[np.argsort(by_y // (2 * width), kind="stable")]
        left = rows // width % 2 == 0
        sums = np.cumsum(np.where(left, parts[:, rows], 0), axis=1)
        start = rows // (2 * width) * (2 * width)
        sums -= np.where(start > 0, sums[:, np.maximum(start - 1, 0)], 0)
        lower[:, rows[~left]] += sums[:, ~left]
        width *= 2
    c, sx, sy, sxy = lower
    agreeing = float((x * y * c - x * sy - y * sx + sxy).sum())
    every = n * float((x * y).sum()) - float(x.sum()) * float(y.sum())
    return 2 * (2 * agreeing - every) / n / n


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Székely and others (2007), 0 where either does not vary; in n log(n)**2 time and memory in proportion to n."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if not len(x) or np.ptp(x) == 0 or np.ptp(y) == 0:
        return 0.0
    x, y = ((v - v.mean()) / v.std() for v in (x, y))
    a, b = _distance_means(x), _distance_means(y)
    va, vb = (2 * v.var() - 2 * (m * m).mean() + m.mean() ** 2 for v, m in ((x, a), (y, b)))
    both = _mean_product_of_distances(x, y) - 2 * (a * b).mean() + a.mean() * b.mean()
    return float(np.sqrt(max(both, 0) / np.sqrt(va * vb))) if va > 0 and vb > 0 else 0.0


def _neighbour_radius(x: np.ndarray, y: np.ndarray, k: int, cell: int = 64) -> np.ndarray:
    """Distance of each row to its k-th nearest other, the larger of both differences.

    Rows lie in strips by x and in cells of a strip by y; the k-th nearest of a row's own cell bounds what is looked at.
    """
    n = len(x)
    strip = max(cell, int(np.ceil(np.sqrt(n * cell))))
    order = np.argsort(x, kind="stable")
    strips = [s[np.argsort(y[s], kind="stable")] for s in (order[a : a + strip] for a in range(0, n, strip))]
    if len(strips) > 1 and len(strips[-1]) <= k:
        last = np.concatenate(strips[-2:])
        strips[-2:] = [last[np.argsort(y[last], kind="stable")]]
    lows, highs, ys = np.array([x[s].min() for s in strips]), np.array([x[s].max() for s in strips]), [y[s] for s in strips]
    out = np.empty(n)

    def kth(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        # the row itself is among the others, at distance 0
        d = np.maximum(np.abs(x[rows][:, None] - x[others]), np.abs(y[rows][:, None] - y[others]))
        return np.partition(d, k, axis=1)[:, k]

    for s in strips:
        for a in range(0, len(s), cell):
            rows = s[a : a + cell]
            near = s[max(0, min(a, len(s) - cell)) : a + cell]
            reach = float(kth(rows, near).max()) * (1 + 1e-9)
            x0, x1, y0, y1 = x[rows].min() - reach, x[rows].max() + reach, y[rows].min() - reach, y[rows].max() + reach
            others = [strips[j][np.searchsorted(ys[j], y0) : np.searchsorted(ys[j], y1, side="right")] for j in np.flatnonzero((lows <= x1) & (highs >= x0))]
            others = np.concatenate(others)
            others = others[(x[others] >= x0) & (x[others] <= x1)]
            step = max(1, (1 << 22) // len(others))
            for at in range(0, len(rows), step):
                out[rows[at : at + step]] = kth(rows[at : at + step], others)
    return out


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """In nats, by nearest neighbours (Kraskov and others, 2004)."""
    n = len(x)
    if n <= k + 1:
        return 0.0
    scale = lambda v: (v - v.mean()) / (v.std() or 1.0) + np.random.default_rng(0).normal(0, 1e-10, n)
    x, y = scale(np.asarray(x, float)), scale(np.asarray(y, float))
    radius = _neighbour_radius(x, y, k)
    digamma = np.concatenate([[0.0], -0.57721566490153286 + np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])])

    def nearer(v: np.ndarray) -> np.ndarray:
        s = np.sort(v)
        r = radius - 4 * np.spacing(np.abs(v) + radius)
        return np.maximum(np.searchsorted(s, v + r, side="right") - np.searchsorted(s, v - r, side="left") - 1, 0)

    return max(0.0, float(digamma[k] + digamma[n] - np.mean(digamma[nearer(x) + 1] + digamma[nearer(y) + 1])))


def association(df: DataFrame, features: list[str], target: str, method: str, order: list[str], sample: int | None = None) -> dict[str, float | None]:
    """A score for each feature, over all rows; mutual_info and distance_corr on a sample of so many rows where one is asked for.

    pearson and f_regression are one aggregation; the other two compare rows, all those of a feature in one task.
    """
    y = known(col(target))
    rows = df.where(y.isNotNull())
    if method in ("pearson", "f_regression"):
        fill = (lambda x: F.coalesce(x, F.lit(0.0))) if method == "f_regression" else (lambda x: x)
        row = rows.agg(F.count("*").alias("n"), *[correlation(fill(known(col(c))), y).alias(f"r{i}") for i, c in enumerate(features)]).head()
        if method == "pearson":
            return {c: abs(r) if (r := row[f"r{i}"]) is not None else None for i, c in enumerate(features)}
        return {c: r * r / max(1 - r * r, 1e-15) * (row["n"] - 2) if (r := row[f"r{i}"]) is not None else 0.0 for i, c in enumerate(features)}
    if method not in METHODS:
        raise TimeSeriesError(f"unknown method {method}; known: {METHODS}")
    f = distance_correlation if method == "distance_corr" else mutual_information

    def score(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        return pd.DataFrame({"i": [keys[0]], "score": [f(pdf["x"].to_numpy(), pdf["y"].to_numpy()) if len(pdf) > 2 else None]})

    chosen = rows if sample is None else by_hash(rows, order, sample)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(known(col(c)), F.lit(0.0)).cast("double").alias("x")) for i, c in enumerate(features)])
    long = chosen.select(F.explode(pairs).alias("p"), y.cast("double").alias("y")).select("p.i", "p.x", "y")
    found = {r["i"]: r["score"] for r in long.groupBy("i").applyInPandas(score, "i int, score double").collect()}
    return {c: found.get(i) for i, c in enumerate(features)}


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> tuple[dict[str, float], float]:
    """Coefficients and intercept of ridge regression, from one aggregation of moments; missing features count as their mean."""
    names = [*features, target]
    y = known(col(target))
    rows = df.where(y.isNotNull())
    means = rows.agg(F.count("*").alias("n"), *[F.avg(known(col(c))).alias(f"m{i}") for i, c in enumerate(names)]).head()
    if not means["n"]:
        raise TimeSeriesError("no row has a target")
    m = np.array([means[f"m{i}"] or 0.0 for i in range(len(names))])
    d = [F.coalesce(known(col(c)) - float(m[i]), F.lit(0.0)) for i, c in enumerate(names)]
    row = rows.agg(*[F.sum(d[i] * d[j]).alias(f"s{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]).head()
    s = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
    k = len(features)
    b = np.linalg.solve(s[:k, :k] + alpha * np.eye(k), s[:k, k])
    return dict(zip(features, b.tolist(), strict=True)), float(m[k] - b @ m[:k])


def linear_importance(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> dict[str, float]:
    """Mean absolute Shapley values of a ridge model, exact for a linear one: mean of |b (x - mean x)|."""
    b, _ = ridge(df, features, target, alpha)
    means = df.agg(*[F.avg(known(col(c))).alias(f"m{i}") for i, c in enumerate(features)]).head()
    row = df.agg(*[F.avg(F.abs(F.coalesce(known(col(c)) - float(means[f"m{i}"] or 0.0), F.lit(0.0)))).alias(f"a{i}") for i, c in enumerate(features)]).head()
    return {c: abs(b[c]) * (row[f"a{i}"] or 0.0) for i, c in enumerate(features)}


def permutation_importance(df: DataFrame, series: Series, features: list[str], target: str, repeats: int = 5, alpha: float = 1.0) -> dict[str, float]:
    """Rise of a ridge model's squared error when a feature's values are dealt anew; expected value, in closed form.

    Dealing a column anew makes it independent of the rest with the same moments, so the rise is 2 b cov(x, residual + b x)
    in expectation; nothing needs to be shuffled, and repeats only document what is averaged over.
    """
    b, a = ridge(df, features, target, alpha)
    y = known(col(target))
    means = df.where(y.isNotNull()).agg(*[F.avg(known(col(c))).alias(f"m{i}") for i, c in enumerate(features)]).head()
    x = [F.coalesce(known(col(c)), F.lit(float(means[f"m{i}"] or 0.0))) for i, c in enumerate(features)]
    fit = F.lit(a)
    for i, c in enumerate(features):
        fit = fit + x[i] * b[c]
    row = df.where(y.isNotNull()).agg(*[F.covar_pop(x[i], y - fit + x[i] * b[c]).alias(f"c{i}") for i, c in enumerate(features)]).head()
    return {c: 2 * b[c] * (row[f"c{i}"] or 0.0) for i, c in enumerate(features)}


class SHAPFeatureSelector(_Selector):
    """Features by importance in a ridge model: a number or share of them, or those at least the median, mean or a given value."""

    def __init__(self, n_features: int | float | None = None, threshold: str | float = "median", alpha: float = 1.0, importance: str = "linear"):
        if importance not in ("linear", "permutation"):
            raise TimeSeriesError("importance is linear or permutation")
        self.n_features, self.threshold, self.alpha, self.importance = n_features, threshold, alpha, importance

    def _fit(self, df: DataFrame, target: str | None) -> None:
        if not target:
            raise TimeSeriesError("a target is needed")
        names = self.feature_names_in_
        of = linear_importance(df, names, target, self.alpha) if self.importance == "linear" else permutation_importance(df, self.series, names, target, alpha=self.alpha)
        self.importances_, order = of, ranked(of)
        if self.n_features is not None:
            n = max(1, int(len(names) * self.n_features)) if isinstance(self.n_features, float) else max(1, self.n_features)
            self.selected_features_ = order[:n]
            return
        values = np.array(list(of.values()))
        cut = float(np.median(values)) if self.threshold == "median" else float(values.mean()) if self.threshold == "mean" else float(self.threshold)
        self.selected_features_ = [c for c in order if of[c] >= cut] or order[:5]

    def get_feature_importance_df(self, spark: SparkSession) -> DataFrame:
        self._ready()
        return spark.createDataFrame([(c, float(self.importances_[c]), i + 1) for i, c in enumerate(ranked(self.importances_))], "feature string, importance double, rank int")


class HybridFeatureSelector(_Selector):
    """Top features by several measures, joined by union, intersection, or in stages."""

    def __init__(self, methods: list[str] | None = None, strategy: str = "union", top_k: int = 20):
        self.methods = list(methods or ["pearson", "f_regression", "mutual_info"])
        if unknown := [m for m in self.methods if m not in METHODS]:
            raise TimeSeriesError(f"unknown methods {unknown}; known: {METHODS}")
        if strategy not in ("union", "intersection", "staged"):
            raise TimeSeriesError(f"unknown strategy {strategy}")
        self.strategy, self.top_k = strategy, top_k

    def _fit(self, df: DataFrame, target: str | None) -> None:
        if not target:
            raise TimeSeriesError("a target is needed")
        order = [*self.series.key, *self.series.order]
        self.scores_ = {m: association(df, self.feature_names_in_, target, m, order) for m in self.methods}
        self.tops_ = {m: ranked(s)[: self.top_k] for m, s in self.scores_.items()}
        first = self.tops_[self.methods[0]]
        every = [set(t) for t in self.tops_.values()]
        if self.strategy == "union":
            kept = set().union(*every)
        elif self.strategy == "intersection":
            kept = set.intersection(*every)
        else:
            base = set(self.tops_.get("pearson") or ranked(association(df, self.feature_names_in_, target, "pearson", order))[: self.top_k])
            other = next((set(self.tops_[m]) for m in self.methods if m != "pearson"), base)
            kept = base & other
        best = {c: max((1 - t.index(c) / max(len(t), 1) for t in self.tops_.values() if c in t), default=0.0) for c in kept}
        self.selected_features_ = ranked(best) or first[:5]

    def get_selection_report(self, spark: SparkSession) -> DataFrame:
        rows = [(m, c, float(self.scores_[m][c]), i + 1, c in set(self.selected_features_)) for m in self.methods for i, c in enumerate(ranked(self.scores_[m]))]
        return spark.createDataFrame(rows, "method string, feature string, score double, rank int, selected boolean")


class CombinedFeatureSelector(_Selector):
    """Missing values, then variance, then importance or the hybrid measures; each stage sees what the one before kept."""

    def __init__(self, missing_threshold: float = 0.2, variance_threshold: float = 0.0, selection_method: str = "shap", skip_selection: bool = False, **options):
        if selection_method not in ("shap", "hybrid"):
            raise TimeSeriesError("selection_method is shap or hybrid")
        self.missing_threshold, self.variance_threshold = missing_threshold, variance_threshold
        self.selection_method, self.skip_selection, self.options = selection_method, skip_selection, options

    def _fit(self, df: DataFrame, target: str | None) -> None:
        names = self.feature_names_in_
        row = df.agg(*[e.alias(f"{k}{i}") for i, c in enumerate(names) for k, e in (("m", F.avg(known(col(c)).isNull().cast("double"))), ("v", F.var_samp(known(col(c)))))]).head()
        missing, variance = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(names)}, {c: row[f"v{i}"] or 0.0 for i, c in enumerate(names)}
        stages = [("missing", [c for c in names if missing[c] <= self.missing_threshold] or ranked({c: -v for c, v in missing.items()})[:1])]
        left = stages[-1][1]
        stages.append(("variance", [c for c in left if variance[c] > self.variance_threshold] or ranked({c: variance[c] for c in left})[:1]))
        left = stages[-1][1]
        if not self.skip_selection and target and len(left) > 1:
            inner = (SHAPFeatureSelector if self.selection_method == "shap" else HybridFeatureSelector)(**self.options)
            inner.fit(df.select(*[col(c) for c in (*self.series.key, *self.series.order, *left, target)]), self.series, target)
            stages.append((self.selection_method, inner.selected_features_))
        self.stages_, self.selected_features_ = stages, stages[-1][1]

    def get_selection_report(self, spark: SparkSession) -> DataFrame:
        rows, before = [], self.feature_names_in_
        for stage, kept in self.stages_:
            rows.append((stage, len(before), len(kept), sorted(set(before) - set(kept))))
            before = kept
        return spark.createDataFrame(rows, "stage string, n_before int, n_after int, removed_features array<string>")


def feature_quality_score(df: DataFrame, features: list[str], target: str, order: list[str], method: str = "correlation", top_k: int | None = None) -> float | None:
    """The mean over the best top_k features (all, if None) of |correlation| with the target, mutual information, or variance.

    Features without a score (constant or without values) are left out; without any there is none.
    """
    if method == "variance":
        scores = df.agg(*[F.var_samp(known(col(c))).alias(c) for c in features]).head().asDict()
    elif method in ("correlation", "mutual_info"):
        scores = association(df, features, target, "pearson" if method == "correlation" else method, order)
    else:
        raise TimeSeriesError(f"unknown method {method}")
    values = sorted((abs(float(v)) for v in scores.values() if v is not None and v == v), reverse=True)[:top_k]
    return sum(values) / len(values) if values else None


def analyze_feature_selection(df: DataFrame, features: list[str], target: str, order: list[str], methods: list[str] | None = None, top_k: int = 20) -> dict:
    """tops: the best top_k features by each method, over all rows; pairs: what each two methods share, and its Jaccard share;
    correlations: of each method's features, a frame each."""
    methods = list(methods or ["shap", "pearson", "f_regression", "mutual_info"])
    scores = {m: linear_importance(df, features, target) if m == "shap" else association(df, features, target, m, order) for m in methods}
    tops = {m: ranked(s)[:top_k] for m, s in scores.items()}
    return {"tops": tops, "pairs": analyze_feature_intersection(tops), "correlations": {m: correlation_matrix(df, names) for m, names in tops.items()}}


def compare_feature_selection_methods(df: DataFrame, features: list[str], target: str, order: list[str], methods: list[str] | None = None, top_k: int = 20) -> dict[str, list[str]]:
    return {m: ranked(association(df, features, target, m, order, PAIR_ROWS))[:top_k] for m in methods or ["pearson", "distance_corr"]}


def analyze_feature_intersection(sets: dict[str, list[str]]) -> list[tuple[str, str, int, float]]:
    """Each pair of sets: names in both, and their share of names in either; and ('all', 'all') for all sets together."""
    names = sorted(sets)
    pair = lambda a, b: (len(set(a) & set(b)), len(set(a) & set(b)) / max(len(set(a) | set(b)), 1))
    rows = [(a, b, *pair(sets[a], sets[b])) for i, a in enumerate(names) for b in names[i + 1 :]]
    both, either = set.intersection(*map(set, sets.values())) if sets else set(), set().union(*sets.values()) if sets else set()
    return [*rows, ("all", "all", len(both), len(both) / max(len(either), 1))]


def create_feature_blocks(names: list[str]) -> dict[str, list[str]]:
    """Names by what made them: Window, Spectral, Time, Other."""
    out: dict[str, list[str]] = {"Window": [], "Spectral": [], "Time": [], "Other": []}
    for n in names:
        kind = "Spectral" if ".dwt." in n or ".stl." in n else "Time" if n.startswith("time.") or ".time." in n else "Window" if "lag_" in n or "_roll_" in n or n.count(".") >= 2 else "Other"
        out[kind].append(n)
    return out


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (a, b, correlation) for each pair of columns, a before b, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(known(col(a)), known(col(b))).alias("correlation")) for a, b in pairs]).alias("r"))
    return row.select(F.inline("r"))
