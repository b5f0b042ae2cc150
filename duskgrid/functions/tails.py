"""Tails of the t, normal and chi-square distributions, for tables of results."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _log_gamma(a: np.ndarray) -> np.ndarray:
    own, at = np.unique(a, return_inverse=True)
    return np.array([math.lgamma(v) for v in own.tolist()])[at]


def beta_regularised(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of arrays, by its continued fraction (modified Lentz), all at once."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    inside = (x > 0) & (x < 1)
    xi = np.where(inside, x, 0.5)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(xi) + b * np.log1p(-xi)) / a
    tiny = 1e-300
    c, d = np.ones_like(xi), 1 / np.maximum(1 - (a + b) * xi / (a + 1), tiny)
    out = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * xi / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * xi / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(d == 0, tiny, d)
            c = 1 + num / c
            c = np.where(c == 0, tiny, c)
            out = out * (c * d)
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    part = np.where(inside, front * out, (x >= 1).astype(float))
    return np.where(turned, 1 - part, part)


def t_two_sided(t, df):
    """Two-sided p of a t, of numbers or arrays."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    p = beta_regularised(df / 2, 0.5, df / (df + t * t))
    return p if p.ndim else float(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_upper(x: float, df: float) -> float:
    """Upper tail, by the series or the continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - lead * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return lead * out


def t_quantile(p: float, df):
    """The t with upper tail 1 - p for p > 0.5, of a number or an array of degrees of freedom (once each): Newton steps, halved where they leave the bracket."""
    own, at = np.unique(np.atleast_1d(np.asarray(df, float)), return_inverse=True)
    low, high = np.zeros(len(own)), np.full(len(own), 2.0)
    while (short := 1 - t_two_sided(high, own) / 2 < p).any():
        high[short] *= 2
    t = (low + high) / 2
    norm = np.exp(_log_gamma((own + 1) / 2) - _log_gamma(own / 2)) / np.sqrt(own * np.pi)
    for _ in range(100):
        over = 1 - t_two_sided(t, own) / 2 - p
        low, high = np.where(over < 0, t, low), np.where(over < 0, high, t)
        step = t - over / (norm * (1 + t * t / own) ** (-(own + 1) / 2))
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        done = np.all(np.abs(new - t) <= 1e-14 * np.maximum(1, t))
        t = new
        if done:
            break
    t = t[at]
    return t if np.ndim(df) else float(t[0])


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is not a number


def _column(values: np.ndarray, ok: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=~ok)


def inferred(results: DataFrame, estimate: str = "slope", se: str = "se", df: str = "df", level: float = 0.95) -> DataFrame:
    """A table of results (a row a fit) with p_value, two-sided, and ci_low, ci_high, by the t distribution.

    All three are null without degrees of freedom or with a standard error that is null; the p value also of one of zero.
    """

    def task(batches):
        for b in batches:
            est, err, dfs = (_numbers(b.column(b.schema.get_field_index(c))) for c in (estimate, se, df))
            ok = ~np.isnan(est) & ~np.isnan(err) & (dfs > 0)
            est, err, dfs = np.where(ok, est, 0), np.where(ok, err, 1), np.where(ok, dfs, 1)
            half = t_quantile((1 + level) / 2, dfs) * err
            p = t_two_sided(est / np.where(err > 0, err, 1), dfs)
            more = [_column(p, ok & (err > 0)), _column(est - half, ok), _column(est + half, ok)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "p_value", "ci_low", "ci_high"])

    fields = ", ".join(f"`{c}` {results.schema[c].dataType.simpleString()}" for c in results.columns)
    return results.mapInArrow(task, f"{fields}, p_value double, ci_low double, ci_high double")


def with_p_values(results: DataFrame, t: str = "t", df: str = "df") -> DataFrame:
    """A table of results (a row a fit) with p_value, two-sided, from columns of t and degrees of freedom."""

    def task(batches):
        for b in batches:
            ts, dfs = (_numbers(b.column(b.schema.get_field_index(c))) for c in (t, df))
            ok = ~np.isnan(ts) & (dfs > 0)
            p = t_two_sided(np.where(ok, ts, 0), np.where(ok, dfs, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, _column(p, ok)], names=[*b.schema.names, "p_value"])

    fields = ", ".join(f"`{c}` {results.schema[c].dataType.simpleString()}" for c in results.columns)
    return results.mapInArrow(task, f"{fields}, p_value double")
