"""Statistics of a window frame as column expressions. NULL stands for missing and is skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

FLAT = 1e-10


def items(x: Column, frame: WindowSpec) -> Column:
    """The frame's values in order, without NULLs."""
    return F.array_agg(x).over(frame)


def gate(e: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    """e where the frame has at least so many values."""
    return F.when(F.count(x).over(frame) >= least, e)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(x), f), F.lit(0))


def mean_of(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def slope(x: Column, position: Column, frame: WindowSpec) -> Column:
    """Least-squares slope on the position in the frame; gaps keep their place. Two values, not flat."""
    varies = F.stddev_pop(x).over(frame) >= FLAT
    return F.when((F.count(x).over(frame) >= 2) & varies, F.regr_slope(x, position.cast("double")).over(frame))


def pair_correlation(a: Column) -> Column:
    """Pearson correlation of an array's neighbours; three values, neither side flat."""

    def of(v: Column) -> Column:
        n = F.size(v)
        left, right = F.slice(v, 1, n - 1), F.slice(v, 2, n - 1)

        def r(p: Column) -> Column:
            d = F.zip_with(p["l"], p["r"], lambda x, y: F.struct((x - p["ml"]).alias("x"), (y - p["mr"]).alias("y")))
            s = F.aggregate(d, F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy")), lambda t, e: F.struct((t["xy"] + e["x"] * e["y"]).alias("xy"), (t["xx"] + e["x"] * e["x"]).alias("xx"), (t["yy"] + e["y"] * e["y"]).alias("yy")))
            flat = FLAT * FLAT * (n - 1)
            return _let(s, lambda t: F.when((t["xx"] >= flat) & (t["yy"] >= flat), F.try_divide(t["xy"], F.sqrt(t["xx"]) * F.sqrt(t["yy"]))))

        return F.when(n >= 3, _let(F.struct(left.alias("l"), right.alias("r"), mean_of(left).alias("ml"), mean_of(right).alias("mr")), r))

    return _let(a, of)


def lag_ratio(a: Column) -> Column:
    """The other first autocorrelation: products of neighbours over the sum of squares, about the mean of the whole array."""

    def of(v: Column) -> Column:
        def r(m: Column) -> Column:
            d = F.transform(v, lambda x: x - m)
            steps = F.zip_with(F.slice(d, 1, F.size(d) - 1), F.slice(d, 2, F.size(d) - 1), lambda x, y: x * y)
            squares = total(F.transform(d, lambda x: x * x))
            return F.when(squares >= FLAT, F.try_divide(total(steps), squares))

        return F.when(F.size(v) >= 2, _let(mean_of(v), r))

    return _let(a, of)


def middle(a: Column) -> Column:
    """Exact median of an array."""

    def of(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return _let(F.array_sort(a), of)


def binned_entropy(a: Column, bins: int = 10) -> Column:
    """Entropy in bits of the values' histogram between least and greatest; two values or more."""

    def of(v: Column) -> Column:
        lo, hi = F.array_min(v), F.array_max(v)
        at = F.transform(v, lambda x: F.least(F.floor((x - lo) / (hi - lo + FLAT) * bins), F.lit(bins - 1)).cast("int"))

        def h(cells: Column) -> Column:
            p = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter(cells, lambda c: c == i)) / F.size(cells))
            return -F.aggregate(p, F.lit(0.0), lambda s, q: s + F.when(q > 0, q * F.log2(q + FLAT)).otherwise(0.0))

        return F.when(F.size(v) >= 2, _let(at, h))

    return _let(a, of)


def statistic(name: str, x: Column, position: Column, frame: WindowSpec, least: int = 1) -> Column:
    """A statistic by name over a frame of at least `least` values."""
    kinds: dict[str, Callable[[], Column]] = {
        "mean": lambda: F.avg(x).over(frame),
        "std": lambda: F.stddev_samp(x).over(frame),
        "min": lambda: F.min(x).over(frame),
        "max": lambda: F.max(x).over(frame),
        "sum": lambda: F.sum(x).over(frame),
        "energy": lambda: F.sum(x * x).over(frame),
        "slope": lambda: slope(x, position, frame),
        "skewness": lambda: F.when(F.stddev_pop(x).over(frame) >= FLAT, gate(F.skewness(x).over(frame), x, frame, 3)),
        "kurtosis": lambda: F.when(F.stddev_pop(x).over(frame) >= FLAT, gate(F.kurtosis(x).over(frame), x, frame, 4)),
        "acf1": lambda: pair_correlation(items(x, frame)),
        "acf1_ratio": lambda: lag_ratio(items(x, frame)),
        "median": lambda: middle(items(x, frame)),
        "entropy": lambda: binned_entropy(items(x, frame)),
    }
    kinds["skew"], kinds["kurt"] = kinds["skewness"], kinds["kurtosis"]
    if name not in kinds:
        raise ValueError(f"unknown statistic {name}; known: {sorted(kinds)}")
    return gate(kinds[name](), x, frame, least)
