"""Resampling: block bootstraps, permutations, circular shifts, autoregressive errors.

by: columns that part the rows into series, thousands in one call. A series has a row a day at most, so it is held as one
row of ordered arrays. Draws are gathers in these arrays, a chunk of draws of a series at a time, so one long series is
spread over tasks as many short ones are; only slopes leave a task. What a draw takes follows from MD5, so SQL can draw alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskgrid.operators.regress import _clean, newey_west
from duskgrid.operators.states import day_lag

#: Draws of a series that a task makes at a time.
CHUNK = 250
#: A prime below 2 ** 31, so that products fit 64 bits, and its use in mean_bootstrap.
PRIME = 2147483647
#: Rows of a group that mean_bootstrap gathers in one task, and bits of a number below which it looks a draw up in a table.
GATHERED, FOLD = 100_000, 11
#: Steps of phi in which the likelihood is looked at, each around the best of the one before.
STEPS = (0.02, 0.001, 0.00005)


def mixed(*parts: Column | str) -> Column:
    """A 32-bit number that follows from parts as if by chance (the first digits of an MD5)."""
    return F.conv(F.substring(F.md5(F.concat_ws(",", *parts)), 1, 8), 16, 10).cast("long")


class Drawn:
    """mixed(draw, item, seed) of all draws and items asked for so far."""

    def __init__(self, seed: int) -> None:
        self.seed, self.held = seed, {}

    def __call__(self, first: int, last: int, items: int) -> np.ndarray:
        have = self.held.get((first, last), np.zeros((last - first, 0), np.int64))
        if have.shape[1] < items:
            more = [[int(hashlib.md5(f"{d},{b},{self.seed}".encode()).hexdigest()[:8], 16) for b in range(have.shape[1], items)] for d in range(first, last)]
            have = self.held[first, last] = np.concatenate([have, np.array(more, np.int64)], axis=1)
        return have[:, :items]


def series(df: DataFrame, y: str, x: str, order: str, by: list[str] | None = None) -> DataFrame:
    """by, at, y, x: the usable rows of every series as arrays, by order; rows without a key or a place in the order go."""
    rows = _clean(df, y, x).dropna(subset=[*(by or []), order]).groupBy(*(by or [])).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(y).alias("y"), F.col(x).alias("x")))).alias("_s"))
    return rows.where(F.size("_s") > 0).select(*(by or []), F.col("_s.at").alias("at"), F.col("_s.y").alias("y"), F.col("_s.x").alias("x"))


def _fields(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def _slopes(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Slope of each row of y on that of x; not a number where x is constant."""
    y, x = y - y.mean(axis=-1, keepdims=True), x - x.mean(axis=-1, keepdims=True)
    sxx = (x * x).sum(axis=-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(sxx > 0, (x * y).sum(axis=-1) / sxx, np.nan)


def _drawn(of: DataFrame, by: list[str], draws: int, make: Callable[[], Callable]) -> DataFrame:
    """by, draw, slope: make() gives a task its function of (y, x, first draw, end)."""
    spread = of.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(CHUNK)))).repartition(*by, "_first")

    def task(batches):
        kernel = make()
        for b in batches:
            ys, xs = (b.column(b.schema.get_field_index(c)) for c in ("y", "x"))
            for i, first in enumerate(b.column(b.schema.get_field_index("_first")).to_pylist()):
                last = min(first + CHUNK, draws)
                s = kernel(ys[i].values.to_numpy(), xs[i].values.to_numpy(), first, last)
                keys = [b.column(b.schema.get_field_index(c)).take(pa.array(np.full(last - first, i))) for c in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(first, last)), pa.array(s, mask=np.isnan(s))], names=[*by, "draw", "slope"])

    return spread.select(*by, "_first", "y", "x").mapInArrow(task, f"{_fields(of, by)}draw long, slope double")


def block_bootstrap(df: DataFrame, y: str, x: str, order: str, draws: int = 2000, block: int = 14, by: list[str] | None = None, seed: int = 17) -> DataFrame:
    """by, draw, slope of circular moving-block draws; block 1 is the iid bootstrap.

    The b-th block of a draw starts at mixed(draw, b, seed) modulo the length of the series.
    """

    def make():
        numbers = Drawn(seed)

        def kernel(y: np.ndarray, x: np.ndarray, first: int, last: int) -> np.ndarray:
            n = len(y)
            start = numbers(first, last, -(-n // block)) % n
            # a draw's sums are those of its blocks, which are made once for each start
            y, x = y - y.mean(), x - x.mean()
            each = np.stack([y, x, x * x, x * y])
            run = np.cumsum(np.concatenate([np.zeros((4, 1)), each, each[:, np.arange(block) % n]], axis=1), axis=1)
            held, short = run[:, block : n + block] - run[:, :n], n - (start.shape[1] - 1) * block
            sy, sx, sxx, sxy = held[:, start[:, :-1]].sum(axis=2) + (run[:, short : n + short] - run[:, :n])[:, start[:, -1]]
            vary = sxx - sx * sx / n
            slope = np.divide(sxy - sx * sy / n, vary, out=np.full(len(start), np.nan), where=vary > 0)
            near = np.flatnonzero(vary <= 1e-6 * n * np.max(np.abs(x), initial=0.0) ** 2)  # hardly any variation: from the rows themselves
            if len(near):
                at = ((start[near, :, None] + np.arange(block)) % n).reshape(len(near), -1)[:, :n]
                slope[near] = _slopes(y[at], x[at])
            return slope

        return kernel

    return _drawn(series(df, y, x, order, by), by or [], draws, make)


def block_permutation(df: DataFrame, y: str, x: str, order: str, draws: int = 2000, block: int = 14, by: list[str] | None = None, seed: int = 5) -> DataFrame:
    """by, draw, slope of y on x whose blocks are put in order of mixed(draw, b, seed): a placebo."""

    def make():
        numbers = Drawn(seed)

        def kernel(y: np.ndarray, x: np.ndarray, first: int, last: int) -> np.ndarray:
            n = len(y)
            drawn = numbers(first, last, -(-n // block))
            rank = np.argsort(np.argsort(drawn, axis=1, kind="stable"), axis=1, kind="stable")
            at = np.argsort(rank[:, np.arange(n) // block], axis=1, kind="stable")
            return _slopes(np.broadcast_to(y, at.shape), x[at])

        return kernel

    return _drawn(series(df, y, x, order, by), by or [], draws, make)


def bootstrap_summary(draws: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, n, mean, se, percentile interval and two-sided p of bootstrap slopes, (1 + count) / (n + 1) on either side."""
    q = F.percentile("slope", F.array(F.lit(0.025), F.lit(0.975)))
    out = draws.groupBy(*(by or [])).agg(F.count("slope").alias("n"), F.avg("slope").alias("mean"), F.stddev_samp("slope").alias("se"), q.alias("_q"), F.count_if(F.col("slope") <= 0).alias("_l"), F.count_if(F.col("slope") >= 0).alias("_h"))
    return out.select(*(by or []), "n", "mean", "se", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), F.least(F.lit(1.0), 2 * (1 + F.least("_l", "_h")) / (F.col("n") + 1)).alias("p_value"))


def placebo_summary(df: DataFrame, y: str, x: str, draws: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, n, actual slope, mean, sd and percentile interval of placebo slopes, and the share at least as large, (1 + count) / (n + 1)."""
    by = by or []
    actual = _clean(df, y, x).groupBy(*by).agg(F.regr_slope(y, x).alias("actual"))  # a row a series
    rows = draws.join(actual, by) if by else draws.crossJoin(F.broadcast(actual))
    q = F.percentile("slope", F.array(F.lit(0.025), F.lit(0.975)))
    out = rows.groupBy(*by).agg(F.count("slope").alias("n"), F.max("actual").alias("actual"), F.avg("slope").alias("mean"), F.stddev_samp("slope").alias("sd"), q.alias("_q"), F.count_if(F.abs("slope") >= F.abs("actual")).alias("_k"))
    return out.select(*by, "n", "actual", "mean", "sd", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), ((1 + F.col("_k")) / (F.col("n") + 1)).alias("p_value"))


def circular_shifts(df: DataFrame, y: str, x: str, order: str, by: list[str] | None = None) -> DataFrame:
    """by, shift, slope of y on x moved around the circle by each of a series' n - 1 shifts."""
    by = by or []
    of = series(df, y, x, order, by)
    spread = of.withColumn("_first", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("y") - 1), F.lit(CHUNK)))).repartition(*by, "_first")

    def task(batches):
        for b in batches:
            ys, xs = (b.column(b.schema.get_field_index(c)) for c in ("y", "x"))
            for i, first in enumerate(b.column(b.schema.get_field_index("_first")).to_pylist()):
                y, x = ys[i].values.to_numpy(), xs[i].values.to_numpy()
                shifts = np.arange(first, min(first + CHUNK, max(2, len(y))))
                moved = x[(np.arange(len(y)) + shifts[:, None]) % len(y)]
                s = _slopes(np.broadcast_to(y, moved.shape), moved)
                keys = [b.column(b.schema.get_field_index(c)).take(pa.array(np.full(len(s), i))) for c in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(shifts.astype(np.int32)), pa.array(s, mask=np.isnan(s))], names=[*by, "shift", "slope"])

    return spread.select(*by, "_first", "y", "x").mapInArrow(task, f"{_fields(of, by)}shift int, slope double")


def mean_bootstrap(df: DataFrame, value: str, by: str, key: list[str], draws: int = 1000, seed: int = 23, held: int = 2000) -> DataFrame:
    """by, n, mean, low, high: percentile intervals of group means over Poisson draws.

    A row has one number r = mixed(key, seed) modulo PRIME, a draw two, a = 1 + mixed(draw, seed, 1) modulo (PRIME - 1) and
    b = mixed(draw, seed, 2) modulo PRIME. How often the draw takes the row is the Poisson(1) quantile (12 at most) of
    u = (h (h + 7) + 11 modulo PRIME + 0.5) / PRIME, h = a r + b modulo PRIME. No row is multiplied: rows are dealt by group (by
    group and r, so many of GATHERED rows at most about, where it is larger), a task adds all draws of a group up in two arrays,
    for at most so many groups at a time as held, and arrays meet by group. So a group makes an array for each GATHERED rows.
    """
    cuts, p = [], 0.36787944117144233
    for i in range(12):
        cuts.append((cuts[-1] if cuts else 0.0) + p)
        p /= i + 1
    # the number h (h + 7) + 11 modulo PRIME from which on u is above each cut
    least = [next(m for m in range(int(c * PRIME) - 2, PRIME) if (m + 0.5) / PRIME > c) for c in cuts]
    plain = df.groupBy(F.col(by).alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    large = F.broadcast(plain.where((F.col("n") > GATHERED) & F.col("g").isNotNull()).select("g", F.ceil(F.col("n") / GATHERED).alias("_parts")))  # a row each GATHERED rows
    rows = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"), F.pmod(mixed(*key, F.lit(seed)), F.lit(PRIME)).alias("r"))
    rows = rows.join(large, "g", "left").withColumn("_part", F.pmod("r", F.coalesce("_parts", F.lit(1))))
    rows = rows.repartition("g", "_part").sortWithinPartitions("g", "_part").select("g", "v", "r")
    kind = df.schema[by].dataType.simpleString()

    def task(batches):
        number = lambda d, k, m: int(hashlib.md5(f"{d},{seed},{k}".encode()).hexdigest()[:8], 16) % m
        a = np.array([1 + number(d, 1, PRIME - 1) for d in range(draws)])
        b = np.array([number(d, 2, PRIME) for d in range(draws)])
        low = np.searchsorted(least, np.arange((PRIME >> FOLD) + 1) << FOLD, side="right").astype(np.int8)  # Poisson numbers of ranges of m
        low[np.array(least) >> FOLD] = -1  # a cut lies in the range
        sums: dict = {}

        def out():
            groups = list(sums)
            both = np.array([sums[g] for g in groups]).reshape(len(groups), 2, draws)
            off = pa.array(np.arange(0, len(groups) * draws + 1, draws).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(np.ascontiguousarray(both[:, k]).ravel())) for k in (0, 1)]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(groups, kinds), *lists], names=["g", "s", "k"])

        kinds = None
        for batch in batches:
            kinds = batch.schema.field(0).type
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            code, v, r = coded.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            names = coded.dictionary.to_pylist()
            order = np.argsort(code, kind="stable")
            code, v, r = code[order], v[order], r[order]
            for i in range(0, len(r), 200):
                h = (r[i : i + 200, None] * a + b) % PRIME
                m = (h * (h + 7) + 11) % PRIME
                k = low[m >> FOLD]
                near = np.flatnonzero(k < 0)
                k.ravel()[near] = np.searchsorted(least, m.ravel()[near], side="right")
                k, own, x = k.astype(float), code[i : i + 200], v[i : i + 200]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                added = [np.stack([x[f:e] @ k[f:e], k[f:e].sum(axis=0)]) for f, e in zip(first, [*first[1:], len(own)], strict=True)]
                for g, x in zip(own[first].tolist(), added, strict=True):
                    name = names[g]
                    if name in sums:
                        sums[name] += x
                    else:
                        if len(sums) >= held:
                            yield out()
                        sums[name] = x.copy()
        if sums:
            yield out()

    parts = rows.mapInArrow(task, f"g {kind}, s array<double>, k array<double>").repartition("g").select("g", F.posexplode(F.arrays_zip("s", "k")).alias("draw", "z"))
    each = parts.groupBy("g", "draw").agg((F.sum("z.s") / F.sum("z.k")).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return plain.join(each.groupBy("g").agg(q.alias("_q")), "g").select(F.col("g").alias(by), "n", "mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def _gls(gap: np.ndarray, y: np.ndarray, x: np.ndarray, phis: np.ndarray) -> np.ndarray:
    """slope, intercept, se, loglik in columns, for each phi: least squares with errors correlated as phi to the gap in days.

    Each row less phi^gap times the one before, over its own standard deviation, is an independent row.
    """
    r = np.zeros((len(phis), len(y)))
    r[:, 1:] = phis[:, None] ** gap
    s = np.sqrt(1 - r * r)
    before = lambda v: np.concatenate([[0.0], v[:-1]])
    n, ty, tx, c = len(y), (y - r * before(y)) / s, (x - r * before(x)) / s, (1 - r) / s
    dot = lambda a, b: (a * b).sum(axis=1)
    cc, cx, xx, cy, xy, yy = dot(c, c), dot(c, tx), dot(tx, tx), dot(c, ty), dot(tx, ty), dot(ty, ty)
    det = cc * xx - cx**2
    with np.errstate(invalid="ignore", divide="ignore"):
        slope, intercept = (cc * xy - cx * cy) / det, (xx * cy - cx * xy) / det
        s2 = (yy - slope * xy - intercept * cy) / n
        fit = -n / 2 * (np.log(2 * np.pi * s2) + 1) - np.log(s).sum(axis=1)
        return np.stack([slope, intercept, np.sqrt(s2 * n * cc / ((n - 2) * det)), np.nan_to_num(fit, nan=-np.inf)], axis=1)


def _likeliest(gap: np.ndarray, y: np.ndarray, x: np.ndarray) -> float:
    """phi by maximum likelihood: the best of ever finer steps, then the top of the parabola through it and its neighbours."""
    best = max(np.arange(50) * STEPS[0], key=lambda p: _gls(gap, y, x, np.array([p]))[0, 3])
    for wide, step in zip(STEPS[:-1], STEPS[1:], strict=True):
        phis = best - wide + step * np.arange(round(2 * wide / step) + 1)
        phis = phis[(phis >= 0) & (phis < 1)]
        best = phis[np.argmax(_gls(gap, y, x, phis)[:, 3])]
    if best - STEPS[-1] < 0 or best + STEPS[-1] >= 1:
        return float(best)
    low, mid, high = _gls(gap, y, x, best + STEPS[-1] * np.array([-1, 0, 1]))[:, 3]
    bend = low - 2 * mid + high
    return float(best - STEPS[-1] / 2 * (high - low) / bend) if bend < 0 else float(best)


def ar1_fit(df: DataFrame, y: str, x: str, date: str = "date", by: list[str] | None = None, least: int = 6) -> DataFrame:
    """by, phi, n, slope, intercept, se, loglik of every series of at least so many rows with an x that varies; one pass for all."""
    by = by or []
    of = series(df, y, x, date, by).withColumn("at", F.transform("at", lambda d: F.unix_date(d)))
    names = ["phi", "n", "slope", "intercept", "se", "loglik"]

    def task(batches):
        for b in batches:
            at, ys, xs = (b.column(b.schema.get_field_index(c)) for c in ("at", "y", "x"))
            kept, out = [], []
            for i in range(b.num_rows):
                d, yv, xv = (c[i].values.to_numpy() for c in (at, ys, xs))
                if len(yv) < least or np.ptp(xv) == 0 or np.ptp(yv) == 0:
                    continue
                gap = np.diff(d).astype(float)
                phi = _likeliest(gap, yv, xv)
                slope, intercept, se, loglik = _gls(gap, yv, xv, np.array([phi]))[0]
                kept.append(i)
                out.append((phi, len(yv), slope, intercept, se, loglik))
            cols = [pa.array([r[k] for r in out], pa.int64() if n == "n" else pa.float64()) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).take(pa.array(kept, pa.int64())) for c in by), *cols], names=[*by, *names])

    return of.repartition(*by).mapInArrow(task, f"{_fields(of, by)}phi double, n long, slope double, intercept double, se double, loglik double") if by else of.mapInArrow(task, "phi double, n long, slope double, intercept double, se double, loglik double")


def first_difference(df: DataFrame, y: str, x: str, lags: int = 7, by: list[str] | None = None) -> DataFrame:
    """newey_west of the change of y on the change of x between consecutive days."""
    return newey_west(day_lag(day_lag(df, y, by), x, by), f"diff_{y}", f"diff_{x}", "date", lags, by)


def lagged_outcome(df: DataFrame, y: str, x: str, lags: int = 7, by: list[str] | None = None) -> DataFrame:
    """by, n, slope, se_hac, t, df of y on x and the y of the calendar day before, with HAC errors.

    y and x are first freed of the lag (and the mean), which leaves slope, residuals and scores as they are.
    """
    by = by or []
    rows = _clean(day_lag(df, y, by), y, x, f"lag_{y}")
    w = Window.partitionBy(*(by or [F.lit(1)]))
    rows = rows.withColumns({f"_{k}": F.col(c) - F.avg(c).over(w) for k, c in (("y", y), ("x", x), ("l", f"lag_{y}"))})
    free = lambda c: F.col(c) - F.try_divide(F.sum(F.col(c) * F.col("_l")).over(w), F.sum(F.col("_l") ** 2).over(w)) * F.col("_l")
    return newey_west(rows.select(*by, "date", free("_y").alias("_fy"), free("_x").alias("_fx")), "_fy", "_fx", "date", lags, by, terms=3)
