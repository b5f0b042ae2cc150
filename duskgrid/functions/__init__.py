"""Column expressions with the null rules that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Makes a median absolute deviation comparable with a standard deviation.
MAD_SCALE = 1.4826


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """True where c is a number: not null, not NaN, not infinite. Never null."""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def number(c: Column | str) -> Column:
    """c, or null where it isn't finite."""
    return F.when(finite(c), col(c))


def divide(a: Column | str, b: Column | str) -> Column:
    """a / b, or null where b isn't above zero."""
    return F.when(col(b) > 0, col(a) / col(b))


def flag(condition: Column) -> Column:
    """1 or 0, or null where the condition is null."""
    return condition.cast("int")


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def safe_sum(c: Column | str) -> Column:
    """Sum of the finite values; 0 of none."""
    return F.coalesce(F.sum(number(c)), F.lit(0.0))


def safe_mean(c: Column | str) -> Column:
    """Mean of the finite values; null of none."""
    return F.avg(number(c))


def safe_max(c: Column | str) -> Column:
    return F.max(number(c))


def quantile(c: Column | str, q: float) -> Column:
    """Exact quantile by linear interpolation of the finite values."""
    return F.percentile(number(c), F.lit(q))


def median(c: Column | str) -> Column:
    return quantile(c, 0.5)


def _weighted(x: Column, w: Column, positive: bool) -> Column:
    return finite(x) & finite(w) & ((w > 0) if positive else F.lit(True))


def weighted_mean(x: Column | str, w: Column | str, positive: bool = True) -> Column:
    """Mean of finite x by finite weights; positive=False lets zero and negative weights count."""
    x, w = col(x), col(w)
    ok = _weighted(x, w, positive)
    total = F.sum(F.when(ok, w))
    return F.when(total != 0, F.sum(F.when(ok, x * w)) / total)


def weighted_sd(x: Column | str, w: Column | str) -> Column:
    """Population form of the weighted standard deviation."""
    x, w = col(x), col(w)
    ok = _weighted(x, w, True)
    total, mean = F.sum(F.when(ok, w)), weighted_mean(x, w)
    return F.when(total > 0, F.sqrt(F.greatest(F.sum(F.when(ok, w * x * x)) / total - mean * mean, F.lit(0.0))))


def weighted_share(condition: Column, w: Column | str, among: Column | None = None) -> Column:
    """Weight where condition holds over the weight of the rows among (all with a positive weight)."""
    w = F.when(col(w) > 0, col(w))
    w = w if among is None else F.when(among, w)
    return F.when(F.sum(w) > 0, F.coalesce(F.sum(F.when(condition, w)), F.lit(0.0)) / F.sum(w))


def sample_sd(c: Column | str) -> Column:
    """Sample standard deviation; null of fewer than two values."""
    return F.when(F.count(number(c)) >= 2, F.stddev_samp(number(c)))


def ladder(c: Column, steps: list[tuple[Column, str]], other: str | None = None) -> Column:
    """The label of the first condition that holds, null where c is null."""
    out = F.when(c.isNull(), None)
    for cond, label in steps:
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(other))
