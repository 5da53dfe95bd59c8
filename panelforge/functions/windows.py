"""Window helpers on long panels keyed by (date, ticker)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

EPS = 1e-8
YEAR = 252


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def by_key(key: str = "ticker", date: str = "date") -> WindowSpec:
    """All rows of an entity in date order."""
    return Window.partitionBy(key).orderBy(date)


def trailing(n: int, key: str = "ticker", date: str = "date") -> WindowSpec:
    """The last ``n`` calendar rows of an entity, this one included."""
    return by_key(key, date).rowsBetween(-(n - 1), 0)


def rolling(fn: Callable[[Column], Column], x: Column | str, n: int, least: int | None = None, key: str = "ticker") -> Column:
    """``fn`` over the last ``n`` rows; null unless ``least`` of them (all by default) have a value."""
    w = trailing(n, key)
    return F.when(F.count(_c(x)).over(w) >= (n if least is None else least), fn(_c(x)).over(w))


def lag(x: Column | str, k: int = 1, key: str = "ticker") -> Column:
    return F.lag(_c(x), k).over(by_key(key))


def change(x: Column | str, k: int = 1, key: str = "ticker") -> Column:
    """Relative change over k rows."""
    return F.try_divide(_c(x), lag(x, k, key)) - 1


def rank_pct(x: Column | str, *part: str) -> Column:
    """Percent rank with average ties over non-null values; null stays null."""
    part = part or ("date",)
    x = _c(x)
    up_to = Window.partitionBy(*part).orderBy(x.asc_nulls_last())  # one order serves the rank and the ties
    n = F.count(x).over(Window.partitionBy(*part))
    return F.when(x.isNotNull(), (F.rank().over(up_to) + F.count(x).over(up_to)) / 2 / n)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation; null where one side does not vary."""
    return F.try_divide(F.covar_pop(_c(x), _c(y)), F.stddev_pop(_c(x)) * F.stddev_pop(_c(y)))


def with_medians(df: DataFrame, made: dict[str, str], *part: str) -> DataFrame:
    """Add each name of ``made``: the exact median of its column in the row's part, from row numbers; null if there is none.

    A part is sorted, and spilled where it is large; no buffer holds its values.
    """
    whole = Window.partitionBy(*part)
    placed = {f"__r_{m}": F.row_number().over(whole.orderBy(F.col(x).asc_nulls_last())) for m, x in made.items()}
    placed |= {f"__n_{m}": F.count(x).over(whole) for m, x in made.items()}
    middle = {m: F.abs(2 * F.col(f"__r_{m}") - F.col(f"__n_{m}") - 1) <= 1 for m in made}
    return df.withColumns(placed).withColumns({m: F.avg(F.when(middle[m], F.col(x))).over(whole) for m, x in made.items()}).drop(*placed)


def skew(n: int) -> Callable[[Column], Column]:
    """Bias-corrected skewness of n values, as an aggregate for ``rolling``."""

    class _Over:
        def __init__(self, x: Column):
            self.x = x

        def over(self, w: WindowSpec) -> Column:
            return F.skewness(self.x).over(w) * math.sqrt(n * (n - 1)) / (n - 2)

    return _Over


def kurtosis(n: int) -> Callable[[Column], Column]:
    """Bias-corrected excess kurtosis of n values, as an aggregate for ``rolling``."""

    class _Over:
        def __init__(self, x: Column):
            self.x = x

        def over(self, w: WindowSpec) -> Column:
            return (F.kurtosis(self.x).over(w) * (n + 1) + 6) * (n - 1) / ((n - 2) * (n - 3))

    return _Over


def halflife(h: float) -> float:
    """Smoothing factor of a half life."""
    return 1 - math.exp(-math.log(2) / h)


def span(n: float) -> float:
    """Smoothing factor of a span."""
    return 2 / (n + 1)


def clip(x: Column | str, low: float, high: float) -> Column:
    """x held in [low, high]; null stays null."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def row_mean(*xs: Column | str) -> Column:
    """Mean of the non-null values of a row; null if there are none."""
    xs = [_c(x) for x in xs]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0)))
    n = sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int"))
    return F.try_divide(total, n)
