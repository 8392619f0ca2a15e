"""Rolling windows over ordered bars, null until a window is full."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-10


class Rolling:
    """Window expressions by series. All of one size share a sort and an exchange."""

    def __init__(self, by: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("bucket",)):
        self.by, self.order = by, order

    @property
    def base(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        return self.base.rowsBetween(-(n - 1), 0)

    def full(self, agg: Column, n: int, least: int | None = None) -> Column:
        """agg over the last n rows; null where there are fewer than `least` (n unless given)."""
        w = self.last(n)
        return F.when(F.count(F.lit(1)).over(w) >= (least or n), agg.over(w))

    def complete(self, agg: Column, of: Column, n: int) -> Column:
        """agg over the last n rows; null where fewer than n values of `of` are there."""
        w = self.last(n)
        return F.when(F.count(of).over(w) == n, agg.over(w))

    def lag(self, c: Column | str, k: int = 1) -> Column:
        return F.lag(c, k).over(self.base)

    def mean(self, c, n: int) -> Column:
        return self.complete(F.avg(c), F.col(c) if isinstance(c, str) else c, n)

    def std(self, c, n: int) -> Column:
        return self.complete(F.stddev_samp(c), F.col(c) if isinstance(c, str) else c, n)

    def var(self, c, n: int) -> Column:
        return self.complete(F.var_samp(c), F.col(c) if isinstance(c, str) else c, n)

    def min(self, c, n: int) -> Column:
        return self.complete(F.min(c), F.col(c) if isinstance(c, str) else c, n)

    def max(self, c, n: int) -> Column:
        return self.complete(F.max(c), F.col(c) if isinstance(c, str) else c, n)

    def sum(self, c, n: int) -> Column:
        return self.complete(F.sum(c), F.col(c) if isinstance(c, str) else c, n)

    def quantile(self, c: str, p: float, n: int) -> Column:
        """Linear interpolation between neighbours."""
        return self.complete(F.percentile(c, F.lit(p)), F.col(c), n)

    def quantile_nearest(self, c: str, p: float, n: int) -> Column:
        """The value whose rank is nearest to p * (n - 1)."""
        at = int(p * (n - 1) + 0.5) + 1
        w = self.last(n)
        return F.when(F.count(c).over(w) == n, F.element_at(F.array_sort(F.collect_list(c).over(w)), at))

    def values(self, c: str, n: int) -> Column:
        """The last n values as an array, oldest first; null where there are fewer."""
        w = self.last(n)
        return F.when(F.count(c).over(w) == n, F.collect_list(c).over(w))

    def pct(self, c: str, k: int = 1) -> Column:
        before = self.lag(c, k)
        return F.try_divide(F.col(c) - before, before)


def rounded(df, keep: tuple[str, ...], digits: int = 6):
    """keep as it is, all other columns rounded."""
    return df.select(*keep, *[F.round(F.col(c), digits).alias(c) for c in df.columns if c not in keep])
