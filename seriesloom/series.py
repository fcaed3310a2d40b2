"""How rows of a DataFrame form series: a key, an order, and value columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.errors import TimeSeriesError

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def col(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def known(x: Column) -> Column:
    """x as a double, with NaN and infinities as NULL: the only kind of missing value inside the library."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in but]


@dataclass(frozen=True)
class Series:
    """order: the columns by which a series' rows are ordered, unique within it. key: one series for each value; none means one series."""

    order: tuple[str, ...]
    key: tuple[str, ...] = ()

    def rows(self) -> WindowSpec:
        return Window.partitionBy(*map(col, self.key)).orderBy(*map(col, self.order))

    def trailing(self, size: int) -> WindowSpec:
        return self.rows().rowsBetween(-(size - 1), 0)

    def centered(self, size: int) -> WindowSpec:
        """An even window has its extra row on the left."""
        return self.rows().rowsBetween(-(size // 2), (size - 1) // 2)

    def before(self) -> WindowSpec:
        return self.rows().rowsBetween(Window.unboundedPreceding, 0)

    def after(self) -> WindowSpec:
        return self.rows().rowsBetween(0, Window.unboundedFollowing)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*map(col, self.key))

    def all_in_order(self) -> WindowSpec:
        """All rows of the series, taken in their order: sums of doubles come out the same however the rows arrive."""
        return self.rows().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def keys(self) -> list[Column]:
        return [col(k) for k in self.key]

    def position(self) -> Column:
        return F.row_number().over(self.rows())

    def values(self, df: DataFrame, columns: list[str] | None = None) -> list[str]:
        found = columns or numeric_columns(df, (*self.key, *self.order))
        if missing := [c for c in found if c not in df.columns]:
            raise TimeSeriesError(f"no columns {missing}")
        if not found:
            raise TimeSeriesError("no numeric column")
        return found
