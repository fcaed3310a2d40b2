"""What operators have in common: fit keeps a small state, transform is lazy."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame

from seriesloom.errors import TimeSeriesError
from seriesloom.series import Series, col


class TimeSeriesTransformer(ABC):
    """fit(df, series) learns from a frame; transform(df) gives key, order and the features, named by get_feature_names_out()."""

    series: Series | None = None
    feature_names_in_: list[str]

    def fit(self, df: DataFrame, series: Series, target: str | None = None) -> TimeSeriesTransformer:
        missing = [c for c in (*series.key, *series.order) if c not in df.columns]
        if missing:
            raise TimeSeriesError(f"no columns {missing}")
        self.series = series
        self.feature_names_in_ = [c for c in series.values(df) if c != target] if self.numeric else []
        self._fit(df, target)
        return self

    numeric = True

    def _fit(self, df: DataFrame, target: str | None) -> None:
        """Learns what transform needs; most operators need nothing."""

    def _ready(self) -> Series:
        if self.series is None:
            raise TimeSeriesError(f"{type(self).__name__} is not fitted")
        return self.series

    def transform(self, df: DataFrame) -> DataFrame:
        series = self._ready()
        if missing := [c for c in self.feature_names_in_ if c not in df.columns]:
            raise TimeSeriesError(f"no columns {missing}")
        wide = self.add(df)
        return wide.select(*[col(c) for c in (*series.key, *series.order, *self.get_feature_names_out())])

    @abstractmethod
    def add(self, df: DataFrame) -> DataFrame:
        """df with the features beside its columns."""

    def fit_transform(self, df: DataFrame, series: Series, target: str | None = None) -> DataFrame:
        return self.fit(df, series, target).transform(df)

    @abstractmethod
    def get_feature_names_out(self) -> list[str]: ...

    def get_params(self) -> dict:
        return {k: v for k, v in vars(self).items() if not k.endswith("_") and k != "series"}

    def set_params(self, **params) -> TimeSeriesTransformer:
        self.__dict__.update(params)
        return self

    def state(self) -> str:
        """Parameters and what was learned, as JSON."""
        return json.dumps({"class": type(self).__name__, **{k: v for k, v in vars(self).items() if k != "series"}}, default=str, sort_keys=True)
