"""Operators against plain numpy, and what must hold for any data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.errors import TimeSeriesError
from seriesloom.functions.wavelets import decompose, deepest, high_pass, low_pass
from seriesloom.operators import meta, missing, selection, spectral, validation, window
from seriesloom.operators.time_encoding import CalendarFeaturesTransformer
from seriesloom.plans.pipeline import AutoFeatureEngineer, FeatureEngineeringOptimizer, OptimizerConfig, cross_validated
from seriesloom.series import Series
from seriesloom.sources.experiments import ExperimentManager, format_duration
from seriesloom.sources.readers import load_series, pick_column, read_csv

S = Series(("ts",), ("k",))


def frame(spark, values, keys=None):
    ts = pd.date_range("2023-01-01", periods=len(values), freq="h")
    rows = [(k, t.to_pydatetime(), None if v is None or v != v else float(v)) for k in keys or ["a"] for t, v in zip(ts, values, strict=True)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")


def seasonal(n=200, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 10 * np.sin(2 * np.pi * t / 24) + 0.1 * t + rng.normal(0, 1, n)


def test_window_statistics_match_numpy(spark):
    x = seasonal(60)
    x[::7] = np.nan
    out = window.WindowTransformer(10, ["identity"], ["mean", "std", "slope", "acf1", "skewness", "kurtosis"]).fit_transform(frame(spark, x), S).toPandas().sort_values("ts")
    for i in (5, 20, 59):
        w = x[max(0, i - 9) : i + 1]
        p, v = np.flatnonzero(~np.isnan(w)), w[~np.isnan(w)]
        z = (v - v.mean()) / v.std()
        want = [v.mean(), v.std(ddof=1), np.polyfit(p, v, 1)[0], np.corrcoef(v[:-1], v[1:])[0, 1], (z**3).mean(), (z**4).mean() - 3]
        assert np.allclose(out.iloc[i][[f"value.identity.{s}" for s in ("mean", "std", "slope", "acf1", "skewness", "kurtosis")]].to_numpy(float), want)


def test_no_feature_looks_ahead(spark):
    x = seasonal(80)
    y = x.copy()
    y[50:] += 100
    t = window.WindowTransformer(12, ["identity", "diff", "sma", "pct_change"], ["mean", "std", "lag_2"])
    a, b = (t.fit_transform(frame(spark, v), S).toPandas().sort_values("ts").iloc[:50] for v in (x, y))
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("bad", [lambda: window.LagTransformer([]), lambda: window.LagTransformer([0]), lambda: window.WindowTransformer(1), lambda: window.WindowTransformer(5, ["x"]), lambda: window.WindowTransformer(5, statistics=["x"]), lambda: window.WindowTransformer(5, min_periods=6), lambda: selection.MissingValueSelector(2), lambda: spectral.STLTransformer(seasonal=6), lambda: CalendarFeaturesTransformer(features=["x"])])
def test_bad_parameters(bad):
    with pytest.raises(TimeSeriesError):
        bad()


def test_short_series_and_unfitted(spark):
    with pytest.raises(TimeSeriesError):
        window.LagTransformer([5]).fit(frame(spark, [1, 2, 3]), S)
    with pytest.raises(TimeSeriesError):
        window.LagTransformer([1]).transform(frame(spark, [1, 2, 3]))


def test_infinities_and_nan_are_missing(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, float("nan"), float("inf"), 4.0])], "k string, ts int, value double")
    out = window.WindowTransformer(3, statistics=["mean"]).fit_transform(df, S).orderBy("ts").toPandas()
    assert out["value.identity.mean"].tolist() == [1.0, 1.0, 1.0, 4.0]


def test_filling(spark):
    df = frame(spark, [None, 1, None, None, 4, None])
    got = lambda **o: [r["value"] for r in missing.fill_missing_temporal(df, S, "value", **o).orderBy("ts").collect()]
    assert got() == [1, 1, 2, 3, 4, 4]
    assert got(method="ffill") == [None, 1, 1, 1, 4, 4]
    assert got(method="bfill") == [1, 1, 4, 4, 4, None]
    assert got(max_gap=1) == [1, 1, None, None, 4, 4]


def test_resampling_fills_empty_periods(spark):
    df = frame(spark, [1, 2, 3, 4]).where("hour(ts) in (0, 3)")
    out = missing.resample_time_series(df, S, "value", "1 hour", "sum").orderBy("ts").toPandas()
    assert out["value"].tolist() == [1, 0, 0, 4]


@pytest.mark.parametrize("name", ["haar", "db2", "db4", "db8", "sym4", "coif1"])
def test_wavelet_filters(name):
    h, g = np.array(low_pass(name)), np.array(high_pass(name))
    assert math.isclose(h.sum(), math.sqrt(2), abs_tol=1e-6) and math.isclose(h @ h, 1, abs_tol=1e-6) and abs(g.sum()) < 1e-6
    for shift in range(2, len(h), 2):
        assert abs(h[shift:] @ h[:-shift]) < 1e-6


def test_wavelet_levels():
    x = np.arange(9.0)
    a, d = decompose(x, "db2", 1)
    assert len(a) == len(d) == 6 and np.abs(d[1:4]).max() < 1e-8
    assert deepest(500, "db4") == 6
    a, d = decompose(np.array([1.0, 3, 2, 8]), "haar", 1)
    assert np.allclose((a @ a) + (d @ d), 78) and np.allclose(d, [-2 / math.sqrt(2), -6 / math.sqrt(2)])


def test_stl_adds_up_and_finds_the_season():
    x = seasonal(240)
    t, s, r = spectral.stl(x, 24)
    assert np.allclose(t + s + r, x) and r.std() < 2 and np.corrcoef(s, 10 * np.sin(2 * np.pi * np.arange(240) / 24))[0, 1] > 0.98


def test_seasonality_and_change_points(spark):
    df = frame(spark, seasonal(240))
    assert 23 <= spectral.detect_seasonality(df, S, "value", 60).head()["period"] <= 25
    assert 23 <= spectral.estimate_period(df, S, "value") <= 25
    steps = frame(spark, [0.0] * 50 + [10.0] * 50 + [3.0] * 50)
    for method in ("pelt", "binary"):
        assert spectral.change_points(steps, S, "value", method, 10, 10.0).head()["points"] == [49, 99]


def test_hypothesis_tests_tell_noise_from_walks():
    rng = np.random.default_rng(0)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    assert meta.adf(noise) < 0.01 and meta.adf(walk) > 0.05 and meta.kpss(noise) >= 0.05 and meta.kpss(walk) <= 0.01
    assert meta.shapiro(noise) > 0.01 and meta.shapiro(np.exp(noise)) < 1e-6
    assert math.isclose(meta.chi2_upper(3.841458820694124, 1), 0.05, rel_tol=1e-9)


def test_meta_features_give_one_row_a_series(spark):
    out = meta.MetaFeatureExtractor().extract(frame(spark, seasonal(120), ["a", "b"]), S, "value").toPandas()
    assert sorted(out["k"]) == ["a", "b"] and out["acf_24"].gt(0.5).all() and out["hurst_exponent"].notna().all()


def plain_distance_correlation(x, y):
    centred = lambda d: d - d.mean(0) - d.mean(1)[:, None] + d.mean()
    a, b = (centred(np.abs(v[:, None] - v[None, :])) for v in (x, y))
    return np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean()))


def plain_mutual_information(x, y, k=3):
    n = len(x)
    dx, dy = (np.abs(v[:, None] - v[None, :]) for v in ((v - v.mean()) / v.std() + np.random.default_rng(0).normal(0, 1e-10, n) for v in (x, y)))
    both = np.maximum(dx, dy) + np.diag([np.inf] * n)
    radius = np.sort(both, axis=1)[:, k - 1]
    psi = lambda m: np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])[m - 1] - 0.57721566490153286
    return max(0.0, psi(k) + psi(n) - np.mean([psi((d < radius[:, None]).sum(1)) for d in (dx, dy)]) * 2)


def test_measures_of_pairs_use_all_rows(spark):
    rng = np.random.default_rng(8)
    x, e = np.round(rng.normal(size=1500), 1), rng.normal(size=1500)
    y = x * x + 0.3 * e
    rows = [(i, float(x[i]), 0.0 if i % 3 else float(e[i]), float(y[i])) for i in range(1500)]
    df = spark.createDataFrame(rows, "ts int, a double, b double, y double")
    for method, plain in (("distance_corr", plain_distance_correlation), ("mutual_info", plain_mutual_information)):
        got = selection.association(df, ["a", "b"], "y", method, ["ts"])
        for c, i in (("a", 1), ("b", 2)):
            v = np.array(sorted((r[i], r[3]) for r in rows))
            assert got[c] == pytest.approx(plain(v[:, 0], v[:, 1]), abs=1e-8)


def test_selectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    rows = [("a", i, *map(float, x[i]), 1.0, None if i % 2 else 1.0 + i, float(3 * x[i, 0] - x[i, 1] + 0.1 * rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts int, x0 double, x1 double, x2 double, flat double, holes double, y double")
    assert selection.VarianceThresholdSelector(0.0).fit(df, S, "y").selected_features_ == ["x0", "x1", "x2", "holes"]
    assert "holes" not in selection.MissingValueSelector(0.2).fit(df, S, "y").selected_features_
    for importance in ("linear", "permutation"):
        assert selection.SHAPFeatureSelector(2, importance=importance).fit(df.drop("holes", "flat"), S, "y").selected_features_ == ["x0", "x1"]
    hybrid = selection.HybridFeatureSelector(list(selection.METHODS), "intersection", 2).fit(df.drop("holes", "flat"), S, "y")
    assert set(hybrid.selected_features_) == {"x0", "x1"}
    combined = selection.CombinedFeatureSelector(0.2, 0.0, n_features=1).fit(df, S, "y")
    assert combined.selected_features_ == ["x0"] and combined.get_selection_report(spark).count() == 3
    assert abs(selection.distance_correlation(x[:, 0], x[:, 0]) - 1) < 1e-9 and selection.distance_correlation(x[:, 0], np.ones(300)) == 0
    b, _ = selection.ridge(df, ["x0", "x1"], "y", 1e-9)
    assert abs(b["x0"] - 3) < 0.05 and abs(b["x1"] + 1) < 0.05


def test_validation(spark):
    df = frame(spark, seasonal(30))
    assert validation.validate_time_series(df, S) == ["value"]
    with pytest.raises(TimeSeriesError):
        validation.validate_time_series(df.union(df), S)
    with pytest.raises(TimeSeriesError):
        validation.validate_time_series(df.withColumn("value", F.lit(float("inf"))), S)
    a, b = df.where("day(ts) = 1"), df.where("day(ts) > 1")
    validation.validate_no_leakage(a, b, S)
    with pytest.raises(TimeSeriesError):
        validation.validate_no_leakage(b, a, S)
    assert validation.validate_frequency(df, S, True).head()["freq"] == "H"
    with pytest.raises(TimeSeriesError):
        validation.validate_window_size(50, 60)


def test_pipeline_and_search(spark):
    df = window.add_target(frame(spark, seasonal(150)), S, "value", 1)
    auto = AutoFeatureEngineer(optimize=False, use_meta_features=False).fit(df, S, "target")
    out = auto.transform(df)
    assert out.count() == 149 and auto.get_feature_names() and "time.time.hour_sin" in out.columns
    later = auto.transform(df.where("day(ts) > 3"), df.where("day(ts) <= 3"))
    name = next(c for c in later.columns if "lag_1" in c)
    assert later.where(F.col(f"`{name}`").isNull()).count() == 0
    search = FeatureEngineeringOptimizer(OptimizerConfig(n_calls=1, n_splits=2))
    assert search.optimize(df, S, "target") and search.best_score_ < 1e6 and search.get_search_history(spark).count() == 1
    scores = cross_validated(window.create_lagged_features(df, S, [1, 24], ["value"]), S, ["value_lag_1", "value_lag_24"], "target", n_splits=3)
    assert len(scores) == 3 and -np.mean(scores) < df.agg(F.stddev("target")).head()[0]


def test_saved_engineer_transforms_alike(spark, tmp_path):
    df = window.add_target(frame(spark, seasonal(150)), S, "value", 1)
    auto = AutoFeatureEngineer(optimize=False, use_meta_features=False).fit(df, S, "target")
    auto.save(str(tmp_path / "auto.json"))
    again = AutoFeatureEngineer.load(str(tmp_path / "auto.json"))
    assert again.get_feature_names() == auto.get_feature_names() and again.target_ == "target"
    some = auto.get_feature_names()[::4]
    rows = [sorted(map(str, x.transform(df).select(*[f"`{c}`" for c in some]).collect())) for x in (again, auto)]
    assert rows[0] == rows[1] and len(rows[0]) == 149
    found = auto.analyze_feature_selection(df, ["shap", "pearson"], top_k=5)
    assert all(len(t) == 5 for t in found["tops"].values()) and found["pairs"][0][:2] == ("pearson", "shap")
    assert all(0 < e < df.agg(F.stddev("target")).head()[0] for e in found["errors"].values()) and set(found["correlations"]) == set(found["tops"])


def test_quality_and_scorers(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 200))
    df = spark.createDataFrame([(i, float(2 * x + 0.1 * y), float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, value double, a double, b double")
    of = lambda *m: selection.feature_quality_score(df, ["a", "b"], "value", ["i"], *m)
    want = np.abs([np.corrcoef(2 * a + 0.1 * b, v)[0, 1] for v in (a, b)])
    assert abs(of() - want.mean()) < 1e-9 and abs(of("correlation", 1) - want.max()) < 1e-9 and of("mutual_info", 1) > 1 and abs(of("variance") - (a.var(ddof=1) + b.var(ddof=1)) / 2) < 1e-9
    from seriesloom.functions.metrics import get_scorer
    from seriesloom.series import Series

    score, greater = get_scorer("directional_accuracy")
    assert greater and score(df, Series(("i",)), "value", "a").head()[0] > 0.9
    score, greater = get_scorer("mase")
    assert not greater and score(df, Series(("i",)), "value", "a").count() == 1
    with pytest.raises(TimeSeriesError):
        get_scorer("none such")


def test_filled_meta_features_and_too_many_intervals(spark, monkeypatch):
    from seriesloom.operators import time_encoding
    from seriesloom.operators.meta import MetaFeatureExtractor

    df = frame(spark, seasonal(120)).withColumn("value", F.when(F.hour("ts") != 5, F.col("value")))
    row = MetaFeatureExtractor(["simple", "statistical"], "forward").extract(df, S, "value").head().asDict()
    plain = MetaFeatureExtractor(["simple", "statistical"]).extract(df, S, "value").head().asDict()
    assert row["missing_ratio"] == plain["missing_ratio"] > 0 and any(row[k] != plain[k] for k in row)
    monkeypatch.setattr(time_encoding, "MOST_INTERVALS", 1)
    days = spark.createDataFrame([("2024-01-01", "2024-01-02")] * 2, "start string, end string")
    with pytest.raises(TimeSeriesError):
        time_encoding.holiday_distances(df, "ts", days)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date , Daily minimum\n1981-01-01,"20,7"\n1981-01-02,?9\n1981-01-03, 3.5\n1981-01-03,3.5\n')
    df = read_csv(spark, str(tmp_path / "a.csv"))
    out = load_series(df, "Date", pick_column(df, "minimum")).orderBy("ts").toPandas()
    assert out["value"].tolist() == [20.7, 3.5]
    log = ExperimentManager(spark, str(tmp_path / "log"), {"a": 1})
    log.log_metrics({"mae": 2.0})
    log.log_metrics({"mae": 3.0})
    log.log_config()
    log.log_report({"x": [1]})
    assert log.metrics().where("name = 'mae'").count() == 2
    assert [format_duration(s) for s in (0.5, 10.5, 65, 3661, 7325)] == ["0ч 0м 0с", "0ч 0м 10с", "0ч 1м 5с", "1ч 1м 1с", "2ч 2м 5с"]


def test_density_entropy_does_not_depend_on_the_order_of_arrival(spark):
    # multiples of 0.01 on the edges of the bins, where the last bit of the mean decides
    rng, rows = np.random.default_rng(7), []
    for k in range(40):
        x = np.concatenate([[0.0, 10.0 + k], np.round(rng.integers(0, 11, 60) * (10.0 + k) / 10, 2), np.round(rng.random(20) * (10.0 + k), 2)])
        rows += [(k, i, float(v)) for i, v in enumerate(rng.permutation(x))]
    df, s = spark.createDataFrame(rows, "k int, i int, value double").coalesce(1), Series(("i",), ("k",))
    there, back = ({r["k"]: round(r["entropy"], 9) for r in meta.density_entropy(df.sortWithinPartitions(o), s, "value").collect()} for o in (F.asc("i"), F.desc("i")))
    assert len(there) == 40 and there == back
