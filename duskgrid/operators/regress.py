"""Regressions over many groups at once: sums in Spark, small solves on rows of results.

by: columns that part the rows into series, each fitted on its own. Rows with a null or non-finite value take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskgrid.functions import finite, weighted_mean
from duskgrid.operators.order import running
from duskgrid.operators.panel import dealt
from duskgrid.operators.series import grid
from duskgrid.sources.io import shared_path

#: Rows that a fit needs.
LEAST_ROWS = 6


def _clean(df: DataFrame, *columns: str) -> DataFrame:
    ok = F.lit(True)
    for c in columns:
        ok = ok & finite(c)
    return df.where(ok).withColumns({c: F.col(c).cast("double") for c in columns})


def ols(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """n, slope, intercept, se, t, df, r2; null where there are too few rows or x is constant."""
    s = _clean(df, y, x).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.regr_sxx(y, x).alias("_sxx"), F.regr_sxy(y, x).alias("_sxy"), F.regr_syy(y, x).alias("_syy"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    ok = (F.col("n") >= LEAST_ROWS) & (F.col("_sxx") > 1e-14)
    s = s.withColumn("slope", F.when(ok, F.col("_sxy") / F.col("_sxx")))
    rss = F.greatest(F.lit(0.0), F.col("_syy") - F.col("slope") * F.col("_sxy"))
    s = s.withColumns({"intercept": F.col("_my") - F.col("slope") * F.col("_mx"), "se": F.when(ok, F.sqrt(F.try_divide(rss, (F.col("n") - 2) * F.col("_sxx")))), "r2": F.when(F.col("_syy") > 0, F.col("slope") * F.col("_sxy") / F.col("_syy")), "df": F.when(ok, F.col("n") - 2)})
    return s.withColumn("t", F.when(F.col("se") > 0, F.col("slope") / F.col("se"))).select(*(by or []), "n", "slope", "intercept", "se", "t", "df", "r2")


def normal_equations(df: DataFrame, y: str, xs: list[str], by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """n, yy and the upper triangle of X'X | X'y of 1 and xs, as one array a group."""
    rows = _clean(df, y, *xs, *([weight] if weight else []))
    w = F.col(weight) if weight else F.lit(1.0)
    cols = [F.lit(1.0), *[F.col(c) for c in xs], F.col(y)]
    sums = [F.sum(w * cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.array(*sums).alias("sums"))


def solve(equations: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """term, estimate, se, t, df, r2, n, rss of each group's normal_equations (a small matrix a row)."""
    k = len(names) + 1
    by = by or []

    def task(batches):
        for b in batches:
            out = {c: [] for c in (*by, "term", "estimate", "se", "df", "n", "r2", "rss")}
            for row in b.to_pylist():
                m = np.zeros((k + 1, k + 1))
                m[np.triu_indices(k + 1)] = row["sums"]
                m = m + m.T - np.diag(np.diag(m))
                xx, xy, yy = m[:k, :k], m[:k, k], m[k, k]
                if row["n"] <= k or np.linalg.matrix_rank(xx) < k:
                    continue
                beta = np.linalg.solve(xx, xy)
                rss = max(0.0, yy - beta @ xy)
                tss = yy - xy[0] ** 2 / xx[0, 0]
                se = np.sqrt(np.diag(np.linalg.inv(xx)) * rss / (row["n"] - k))
                for i, name in enumerate(["(intercept)", *names]):
                    for c, val in (*((c, row[c]) for c in by), ("term", name), ("estimate", beta[i]), ("se", se[i]), ("df", row["n"] - k), ("n", row["n"]), ("r2", 1 - rss / tss if tss > 0 else None), ("rss", rss)):
                        out[c].append(val)
            kinds = {c: b.schema.field(c).type for c in by} | {"term": pa.string(), "df": pa.int64(), "n": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.float64())) for c, v in out.items()], names=list(out))

    fields = "".join(f"`{c}` {equations.schema[c].dataType.simpleString()}, " for c in by)
    return equations.mapInArrow(task, f"{fields}term string, estimate double, se double, df long, n long, r2 double, rss double").withColumn("t", F.when(F.col("se") > 0, F.col("estimate") / F.col("se")))


def with_dummies(df: DataFrame, factor: str, levels: list) -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for every level but the first."""
    names = [f"{factor}_{v}" for v in levels[1:]]
    return df.withColumns({n: (F.col(factor) == v).cast("double") for n, v in zip(names, levels[1:], strict=True)}), names


def multiple(df: DataFrame, y: str, xs: list[str], factors: dict[str, list] | None = None, by: list[str] | None = None) -> DataFrame:
    """OLS on xs and on dummies of factors (name: levels, few and known)."""
    names = list(xs)
    for f, levels in (factors or {}).items():
        df, more = with_dummies(df, f, levels)
        names += more
    return solve(normal_equations(df, y, names, by), names, by)


def residuals(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """df's usable rows with _e, the residual, and _s, what the row adds to the slope."""
    rows = _clean(df, y, x)
    w = Window.partitionBy(*(by or [F.lit(1)]))
    rows = rows.withColumns({"_dx": F.col(x) - F.avg(x).over(w), "_dy": F.col(y) - F.avg(y).over(w)})
    rows = rows.withColumns({"_sxx": F.sum(F.col("_dx") ** 2).over(w), "_sxy": F.sum(F.col("_dx") * F.col("_dy")).over(w)})
    return rows.withColumn("_e", F.col("_dy") - F.try_divide("_sxy", "_sxx") * F.col("_dx")).withColumn("_s", F.try_divide(F.col("_dx") * F.col("_e"), "_sxx"))


def newey_west(df: DataFrame, y: str, x: str, order: str, lags: int, by: list[str] | None = None, terms: int = 2) -> DataFrame:
    """n, slope, se_hac, t, df: Bartlett weights over row order, scaled by n / (n - terms) for a model of so many terms."""
    by = by or []
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order)
    rows = residuals(df, y, x, by)
    rows = rows.withColumns({f"_l{j}": F.lag("_s", j).over(w) for j in range(1, lags + 1)})
    var = F.sum(F.col("_s") ** 2)
    for j in range(1, lags + 1):
        var = var + 2 * (1 - j / (lags + 1)) * F.coalesce(F.sum(F.col("_s") * F.col(f"_l{j}")), F.lit(0.0))
    n = F.count("*")
    out = rows.groupBy(*by).agg(n.alias("n"), F.max(F.try_divide("_sxy", "_sxx")).alias("slope"), F.sqrt(F.try_divide(F.greatest(F.lit(0.0), var) * n, n - terms)).alias("se_hac"), (n - terms).alias("df"))
    return out.where(F.col("n") >= LEAST_ROWS).withColumn("t", F.when(F.col("se_hac") > 0, F.col("slope") / F.col("se_hac")))


def entity_slopes(df: DataFrame, y: str, x: str, lags: int, least: int, entity: str = "entity") -> DataFrame:
    """Of each entity n, slope (0 where y is constant), se_hac, t; entities with too few rows or a constant x go."""
    rows = _clean(df, y, x)
    n = rows.groupBy(entity).agg(F.count("*").alias("_n"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy")).where((F.col("_n") >= least) & (F.col("_sx") > 1e-12))
    nw = newey_west(rows.join(n.select(entity), entity, "left_semi"), y, x, "date", lags, [entity])
    flat = F.col("_sy") <= 1e-12
    return n.join(nw, entity).select(entity, "n", F.when(flat, 0.0).otherwise(F.col("slope")).alias("slope"), F.when(~flat, F.col("se_hac")).alias("se_hac"), F.when(~flat, F.col("t")).alias("t"), "df")


def fixed_effects(df: DataFrame, y: str, x: str, entity: str, cluster: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Within slope by entity, clustered by date: n, n_clusters, slope, se_cluster, t, df, r2_within, partial_r.

    The scale is g/(g-1) * (n-1)/(n-k), k counting the entities and x. A cluster's score is linear in the slope, so its
    two sums are enough: the rows are aggregated once, by cluster, and the rest is arithmetic on a row a cluster.
    """
    by = by or []
    rows = _clean(df, y, x, *([weight] if weight else [])).withColumn("_w", F.col(weight) if weight else F.lit(1.0)).where("_w > 0")
    own = Window.partitionBy(*by, entity)
    mean = lambda c: F.sum(F.col("_w") * F.col(c)).over(own) / F.sum("_w").over(own)
    rows = rows.withColumns({"_dx": F.col(x) - mean(x), "_dy": F.col(y) - mean(y)})
    return _clustered(rows.withColumn("_lost", F.lit(0)), entity, cluster, by)


def _clustered(rows: DataFrame, entity: str, cluster: str, by: list[str]) -> DataFrame:
    """fixed_effects of rows (_w, _dx, _dy freed of all effects; _lost, the effects beyond the entities')."""
    w, dx, dy = F.col("_w"), F.col("_dx"), F.col("_dy")
    first = (F.row_number().over(Window.partitionBy(*by, entity).orderBy(cluster)) == 1).cast("long")  # one row an entity counts it
    sums = rows.withColumn("_e", first).groupBy(*by, cluster).agg(F.count("*").alias("_n"), F.sum("_e").alias("_k"), F.max("_lost").alias("_lost"), F.sum(w * dx * dx).alias("_xx"), F.sum(w * dx * dy).alias("_xy"), F.sum(w * dy * dy).alias("_yy"))
    return _of_clusters(sums, by)


def _of_clusters(sums: DataFrame, by: list[str]) -> DataFrame:
    """fixed_effects from a row a cluster: its rows _n, entities first met there _k, _lost, and sums _xx, _xy, _yy."""
    whole = Window.partitionBy(*(by or [F.lit(1)]))  # a row a cluster
    at = sums.withColumns({"_sxx": F.sum("_xx").over(whole), "_sxy": F.sum("_xy").over(whole)}).withColumn("_u", F.col("_xy") - F.try_divide("_sxy", "_sxx") * F.col("_xx"))
    out = at.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum("_k") + F.max("_lost")).alias("_k"), F.max("_sxx").alias("_sxx"), F.max("_sxy").alias("_sxy"), F.sum("_yy").alias("_syy"), F.count("*").alias("n_clusters"), F.sum(F.col("_u") ** 2).alias("_m"))
    g = F.col("n_clusters")
    scale = F.try_divide(g * (F.col("n") - 1), (g - 1) * (F.col("n") - F.col("_k") - 1))
    out = out.withColumns({"slope": F.try_divide("_sxy", "_sxx"), "se_cluster": F.try_divide(F.sqrt(F.col("_m") * scale), "_sxx"), "r2_within": F.try_divide(F.col("_sxy") ** 2, F.col("_sxx") * F.col("_syy")), "partial_r": F.try_divide(F.col("_sxy"), F.sqrt(F.col("_sxx") * F.col("_syy"))), "df": g - 1})
    return out.withColumn("t", F.when(F.col("se_cluster") > 0, F.col("slope") / F.col("se_cluster"))).select(*by, "n", "n_clusters", "slope", "se_cluster", "t", "df", "r2_within", "partial_r")


def fixed_effects_controlled(df: DataFrame, outcomes: list[str], x: str, entity: str, cluster: str, controls: dict[str, list], weight: str | None = None) -> DataFrame:
    """outcome and fixed_effects of each outcome, with further factors (name: levels, few and known) as dummies."""
    return fe_control_grid(df, outcomes, x, [weight], {"": controls}, entity, cluster).drop("weight", "spec")


def fe_control_grid(df: DataFrame, outcomes: list[str], x: str, weights: list[str | None], specs: dict[str, dict[str, list]], entity: str, cluster: str) -> DataFrame:
    """fixed_effects with controls for every outcome, weight and control specification, stacked, in two passes for all.

    The first pass sums products of dummies, x and outcome freed of the entities' means. Their normal equations give what
    the dummies take from x and outcome: a number a level. The second pass takes these numbers off, then the entities'
    means, and sums by cluster; slope, residuals and scores are those of the whole model. Rows with a null factor take no
    part where it is a control. Tasks stream rows in order of entity; they hold means of entities and sums of clusters.
    """
    factors: dict[tuple, int] = {}
    for spec in specs.values():
        for f, levels in spec.items():
            factors.setdefault((f, tuple(levels)), len(factors))
    number = lambda c: F.when(finite(c), F.col(c).cast("double"))
    rows = df.where(finite(x)).select(
        F.col(entity).alias("_entity"), F.col(cluster).alias("_cluster"), F.col(x).cast("double").alias("_x"), *[number(y).alias(f"_y{i}") for i, y in enumerate(outcomes)],
        *[F.when(finite(w) & (F.col(w) > 0), F.col(w).cast("double")).alias(f"_w{i}") if w else F.lit(1.0).alias(f"_w{i}") for i, w in enumerate(weights)],
        *[_place(F.col(f), levels).alias(f"_f{i}") for (f, levels), i in factors.items()],
    )
    rows = dealt(rows, "_entity").withColumn("_new", F.row_number().over(Window.partitionBy("_entity").orderBy("_cluster")) == 1)
    sizes = [len(levels) - 1 for _, levels in factors]
    arms = [(i, j, [factors[f, tuple(levels)] for f, levels in spec.items()]) for i in range(len(outcomes)) for j in range(len(weights)) for spec in specs.values()]
    labels = [(y, w or "none", label) for y in outcomes for w in weights for label in specs]
    lost, taken = [0] * len(arms), [[np.zeros((2, n + 1)) for n in sizes] for _ in arms]
    for a, (n_entities, m) in _within_products(rows, sizes, arms).items():
        k = len(m) - 2
        beta, _, rank, _ = np.linalg.lstsq(m[:k, :k], m[:k, k:], rcond=1e-10) if k else (np.zeros((0, 2)), None, 0, None)
        lost[a], at = int(n_entities) + int(rank), 0
        for f in arms[a][2]:
            taken[a][f][:, 1:] = beta[at : at + sizes[f]].T
            at += sizes[f]
    at = _cluster_sums(rows, taken, arms)
    named = F.get(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("outcome", "weight", "spec"), names, strict=True)], F.lit(n).alias("_lost")) for names, n in zip(labels, lost, strict=True)]), F.col("arm"))
    out = _of_clusters(at.withColumns({"_l": named, "_k": F.lit(0)}).select("*", "_l.*"), ["outcome", "weight", "spec"])
    return out.select("outcome", *[c for c in out.columns if c not in ("outcome", "weight", "spec")], "weight", "spec")


def _place(factor: Column, levels: list) -> Column:
    """0 at the first level (and any not listed), 1, 2 ... at the others, -1 where there is none."""
    out = F.when(factor.isNull(), -1)
    for i, v in enumerate(levels[1:], 1):
        out = out.when(factor == v, i)
    return out.otherwise(0)


def _numbers(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The batch's columns of numbers, null as NaN."""
    return {c: batch.column(c).to_numpy(zero_copy_only=False) if c[:2] == "_f" else batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in batch.schema.names if c[:2] in ("_x", "_y", "_w", "_f")}


def _takes_part(v: dict[str, np.ndarray], i: int, j: int, fs: list[int]) -> np.ndarray:
    on = ~np.isnan(v[f"_y{i}"]) & ~np.isnan(v[f"_w{j}"])
    for f in fs:
        on &= v[f"_f{f}"] >= 0
    return on


def _within_products(rows: DataFrame, sizes: list[int], arms: list[tuple[int, int, list[int]]]) -> dict[int, tuple[float, np.ndarray]]:
    """Of each arm (outcome, weight, factors): its entities, and products of dummies, x and outcome freed of entities' means.

    rows are in order of entity, _new at the first of each. A batch is freed of its entities' means at once; what of an
    entity lay in the batches before is merged by weight and means. The driver gets a matrix an arm.
    """
    first = np.cumsum([0, *sizes])
    n_outcomes = 1 + max(i for i, _, _ in arms)
    columns = [[c for f in fs for c in range(first[f], first[f + 1])] + [first[-1], first[-1] + 1 + i] for i, _, fs in arms]

    def of_batch(v, on, w, ids):
        """The entities among the rows, their weights and means, and the products freed of these means."""
        starts = np.r_[True, ids[1:] != ids[:-1]]
        g, n = np.cumsum(starts) - 1, int(starts.sum())
        weight = np.bincount(g, w, n)
        values = [v["_x"][on], *[np.nan_to_num(v[f"_y{i}"][on]) for i in range(n_outcomes)]]
        middle = [np.bincount(g, w * c, n) / weight for c in values]
        values = [c - m[g] for c, m in zip(values, middle, strict=True)]
        place = [np.maximum(v[f"_f{f}"][on], 0).astype(np.int64) for f in range(len(sizes))]
        shares = [np.bincount(g * (k + 1) + p, w, n * (k + 1)).reshape(n, k + 1)[:, 1:] / weight[:, None] for k, p in zip(sizes, place, strict=True)]
        means = np.column_stack([*shares, *middle])
        out = np.zeros((means.shape[1], means.shape[1]))
        for f, (k, p) in enumerate(zip(sizes, place, strict=True)):
            own = slice(first[f], first[f + 1])
            out[own, own] = np.diag(np.bincount(p, w, k + 1)[1:])
            for h in range(f):
                both = np.bincount(p * (sizes[h] + 1) + place[h], w, (k + 1) * (sizes[h] + 1)).reshape(k + 1, -1)[1:, 1:]
                out[own, first[h] : first[h + 1]], out[first[h] : first[h + 1], own] = both, both.T
            for c, value in enumerate(values, first[-1]):
                out[own, c] = out[c, own] = np.bincount(p, w * value, k + 1)[1:]
        d = means[:, : first[-1]]
        out[: first[-1], : first[-1]] -= d.T @ (weight[:, None] * d)
        z = np.array(values)
        out[first[-1] :, first[-1] :] = (z * w) @ z.T
        return ids[starts], weight, means, out

    def task(batches):
        total = [np.zeros((len(c), len(c))) for c in columns]
        entities, tail = [0] * len(arms), [None] * len(arms)  # of the last entity so far: weight, means
        for b in batches:
            if not b.num_rows:
                continue
            v, group, done = _numbers(b), np.cumsum(b.column("_new").to_numpy(zero_copy_only=False)), {}  # group 0 goes on from the batch before
            for a, (i, j, fs) in enumerate(arms):
                on = _takes_part(v, i, j, fs)
                key = (j, on.tobytes())
                if key not in done:  # arms of the same rows and weights share the work
                    done[key] = of_batch(v, on, v[f"_w{j}"][on], group[on]) if on.any() else None
                last = tail[a] if group[-1] == 0 else None
                if done[key]:
                    ids, weight, means, products = done[key]
                    means = means[:, columns[a]]
                    total[a] += products[np.ix_(columns[a], columns[a])]
                    ends = {0: (weight[0], means[0])} | {len(ids) - 1: (weight[-1], means[-1])}
                    if ids[0] == 0 and tail[a]:
                        (w0, m0), (w1, m1) = tail[a], ends[0]
                        total[a] += w0 * w1 / (w0 + w1) * np.outer(m1 - m0, m1 - m0)
                        ends[0] = w0 + w1, (w0 * m0 + w1 * m1) / (w0 + w1)
                        entities[a] -= 1
                    entities[a] += len(ids)
                    if ids[-1] == group[-1]:
                        last = ends[len(ids) - 1]
                tail[a] = last
        at = [a for a in range(len(arms)) if entities[a]]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([[float(entities[a]), *total[a].ravel()] for a in at], pa.list_(pa.float64()))], names=["arm", "m"])

    parts = rows.mapInArrow(task, "arm int, m array<double>").select("arm", F.posexplode("m").alias("i", "v")).groupBy("arm", "i").agg(F.sum("v").alias("v"))
    out = {}
    for r in parts.groupBy("arm").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("m")).collect():  # a row an arm
        m = np.array([v for _, v in r["m"]])
        out[r["arm"]] = m[0], m[1:].reshape(len(columns[r["arm"]]), -1)
    return out


def _cluster_sums(rows: DataFrame, taken: list[list[np.ndarray]], arms: list[tuple[int, int, list[int]]]) -> DataFrame:
    """_cluster, arm, _n, _xx, _xy, _yy of x and outcome less what is taken off them a level, freed of the entities' means.

    A first step over rows (in order of entity) puts behind each entity a row of its means, a sort within the part puts
    it in front, and a second step sums by cluster.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    most = 50_000  # clusters that a task sums at once

    def freed(v, a):
        """Rows of an arm, their weights, x and outcome without the controls."""
        i, j, fs = arms[a]
        on = _takes_part(v, i, j, fs)
        out = [v["_x"][on], v[f"_y{i}"][on]]
        for f in fs:
            place = v[f"_f{f}"][on].astype(np.int64)
            out = [c - t[place] for c, t in zip(out, taken[a][f], strict=True)]
        return on, v[f"_w{j}"][on], out

    def with_means(batches):
        at, sums, names = 0, np.zeros((len(arms), 3)), None  # the entity under way
        for b in batches:
            if not b.num_rows:
                continue
            names = b.schema
            group = np.cumsum(b.column("_new").to_numpy(zero_copy_only=False))
            v, n = _numbers(b), int(group[-1]) + 1
            each = np.zeros((n, len(arms), 3))
            for a in range(len(arms)):
                on, w, (x, y) = freed(v, a)
                for c, value in enumerate((w, w * x, w * y)):
                    each[:, a, c] = np.bincount(group[on], value, n)
            each[0] += sums
            ended, sums = each[:-1], each[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(group + at, pa.int64()), pa.nulls(b.num_rows, pa.list_(pa.float64()))], names=[*names.names, "_g", "_m"])
            yield closed(ended, at, names)
            at += n - 1
        if names is not None:
            yield closed(sums[None], at, names)

    def closed(sums, at, names):
        with np.errstate(invalid="ignore", divide="ignore"):
            means = (sums[:, :, 1:] / sums[:, :, :1]).reshape(len(sums), 2 * len(arms))
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(sums), f.type) for f in names], pa.array(np.arange(len(sums)) + at, pa.int64()), pa.array(list(means), pa.list_(pa.float64()))], names=[*names.names, "_g", "_m"])

    def by_cluster(batches):
        index, sums, mean, kind = {}, np.zeros((0, len(arms), 4)), np.full((1, 2 * len(arms)), np.nan), None
        for b in batches:
            if not b.num_rows:
                continue
            head = np.asarray(b.column("_m").is_valid())
            kind = b.schema.field("_cluster").type
            means = np.vstack([mean, np.array(b.column("_m").drop_null().to_pylist()).reshape(-1, 2 * len(arms))])
            mean = means[-1:]
            e, b = np.cumsum(head)[~head], b.filter(pa.array(~head))
            if not b.num_rows:
                continue
            v, seen = _numbers(b), b.column("_cluster").dictionary_encode(null_encoding="encode")
            code = np.array([index.setdefault(c, len(index)) for c in seen.dictionary.to_pylist()])[seen.indices.to_numpy()]
            n = len(index)
            sums = np.concatenate([sums, np.zeros((n - len(sums), len(arms), 4))])
            for a in range(len(arms)):
                on, w, (x, y) = freed(v, a)
                x, y, g = x - means[e[on], 2 * a], y - means[e[on], 2 * a + 1], code[on]
                for c, value in enumerate((np.ones(len(g)), w * x * x, w * x * y, w * y * y)):
                    sums[:, a, c] += np.bincount(g, value, n)
            if n > most:
                yield table(index, sums, kind)
                index, sums = {}, np.zeros((0, len(arms), 4))
        if index:
            yield table(index, sums, kind)

    def table(index, sums, kind):
        c, a = np.nonzero(sums[:, :, 0])
        return pa.RecordBatch.from_arrays([pa.array(list(index), kind).take(pa.array(c)), pa.array(a, pa.int32()), pa.array(sums[c, a, 0].astype(np.int64)), *[pa.array(sums[c, a, k]) for k in (1, 2, 3)]], names=["_cluster", "arm", "_n", "_xx", "_xy", "_yy"])

    both = rows.mapInArrow(with_means, f"{schema}, _g long, _m array<double>").sortWithinPartitions("_g", F.col("_m").isNull())
    parts = both.mapInArrow(by_cluster, f"`_cluster` {rows.schema['_cluster'].dataType.simpleString()}, arm int, _n long, _xx double, _xy double, _yy double")
    return parts.groupBy("_cluster", "arm").agg(*[F.sum(c).alias(c) for c in ("_n", "_xx", "_xy", "_yy")])


def factor_grid(df: DataFrame, y: str, exposures: list[str], specs: dict[str, tuple[str | None, dict[str, list]]]) -> DataFrame:
    """exposure, spec, n, slope, se, t, df, r2: classical OLS for each exposure and specification.

    A specification is a factor that is absorbed by demeaning (the one with many levels, or None) and factors that enter
    as dummies; together they are the effects of all of them. Dummies without variation left are let go.
    """
    out = None
    for label, (absorbed, factors) in specs.items():
        rows = df
        names: list[str] = []
        for factor, levels in factors.items():
            rows, more = with_dummies(rows, factor, levels)
            names += more
        rows = _clean(rows.unpivot([y, *([absorbed] if absorbed else []), *names], exposures, "exposure", "_x"), y, "_x")
        whole = rows.groupBy("exposure").agg((F.var_pop(y) * F.count(y)).alias("tss"), ((F.count_distinct(absorbed) - 1) if absorbed else F.lit(0)).cast("long").alias("lost"))
        if absorbed:
            own = Window.partitionBy("exposure", absorbed)
            rows = rows.withColumns({c: F.col(c) - F.avg(c).over(own) for c in (y, "_x", *names)})
        one = _few_terms(normal_equations(rows, y, ["_x", *names], ["exposure"]).join(whole, "exposure"), len(names) + 1).withColumn("spec", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out.withColumns({"t": F.when(F.col("se") > 0, F.col("slope") / F.col("se")), "r2": 1 - F.try_divide("rss", "tss")}).select("exposure", "spec", "n", "slope", "se", "t", "df", "r2")


def _few_terms(equations: DataFrame, k: int) -> DataFrame:
    """exposure, n, slope (of the first regressor), se, df, rss, tss of normal_equations whose matrices may be singular."""

    def task(batches):
        for b in batches:
            out = {"exposure": [], "n": [], "slope": [], "se": [], "df": [], "rss": [], "tss": []}
            for row in b.to_pylist():
                m = np.zeros((k + 2, k + 2))
                m[np.triu_indices(k + 2)] = [np.nan if v is None else v for v in row["sums"]]
                m = m + m.T - np.diag(np.diag(m))
                if not row["n"] or np.isnan(m).any():
                    continue
                scale = np.sqrt(np.maximum(np.diag(m)[: k + 1], 1e-300))
                unit = m[: k + 1, : k + 1] / np.outer(scale, scale)
                kept = [0]
                for c in [*range(2, k + 1), 1]:  # the exposure last: it must have variation of its own
                    own = unit[np.ix_(kept, kept)]
                    left = unit[c, c] - unit[c, kept] @ np.linalg.lstsq(own, unit[kept, c], rcond=None)[0]
                    if np.diag(m)[c] > 1e-12 * row["n"] and left > 1e-9:
                        kept.append(c)
                df = row["n"] - len(kept) - row["lost"]
                found = kept[-1] == 1 and df > 0
                xx, xy = m[np.ix_(kept, kept)], m[kept, k + 1]
                beta = np.linalg.solve(xx, xy) if np.diag(xx).all() else np.zeros(len(kept))
                rss = max(0.0, m[k + 1, k + 1] - beta @ xy)
                for c, v in (("exposure", row["exposure"]), ("tss", row["tss"]), ("n", row["n"]), ("slope", beta[-1] if found else None), ("se", np.sqrt(np.linalg.inv(xx)[-1, -1] * rss / df) if found else None), ("df", df if found else None), ("rss", rss)):
                    out[c].append(v)
            kinds = {"exposure": pa.string(), "n": pa.int64(), "df": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.float64())) for c, v in out.items()], names=list(out))

    return equations.mapInArrow(task, "exposure string, n long, slope double, se double, df long, rss double, tss double")


def fe_grid(df: DataFrame, outcomes: list[str], x: str, weights: list[str | None], entity: str, cluster: str) -> DataFrame:
    """fixed_effects for every outcome and weight, stacked."""
    out = None
    for y in outcomes:
        for w in weights:
            one = fixed_effects(df, y, x, entity, cluster, w).withColumns({"outcome": F.lit(y), "weight": F.lit(w or "none")})
            out = one if out is None else out.unionByName(one)
    return out


def two_way(df: DataFrame, y: str, x: str, large: str, small: str, levels: list) -> DataFrame:
    """Slope with effects of both factors: the larger absorbed by demeaning, the smaller as dummies (exact)."""
    rows, names = with_dummies(_clean(df, y, x), small, levels)
    own = Window.partitionBy(large)
    rows = rows.withColumns({c: F.col(c) - F.avg(c).over(own) for c in (y, x, *names)})
    n = rows.agg(F.count_distinct(large).alias("k")).first()["k"]
    fit = solve(normal_equations(rows, y, [x, *names]), [x, *names]).where(F.col("term") == x)
    left = F.col("df") - n + 1  # the absorbed effects
    return fit.select("n", F.col("estimate").alias("slope"), (F.col("se") * F.sqrt(F.try_divide("df", left))).alias("se"), left.alias("df"))


def weighted_quantiles(df: DataFrame, x: str, w: str, probs: list[float], by: list[str] | None = None, step: bool = False) -> DataFrame:
    """prob, value. Linear between points at cumulative weight shares, ends clamped; step: first x whose share reaches prob."""
    by = by or []
    rows = running(_clean(df, x, w).where(F.col(w) > 0), [x, w], {"_c": F.col(w)}, by)
    rows = rows.withColumns({"_c": F.col("_c") / F.col("_c_total"), "_pc": F.col("_c_before") / F.col("_c_total")})
    rows = rows.select(*by, x, "_c", F.when(F.col("_last").isNotNull(), F.col("_pc")).alias("_pc"), F.col("_last").alias("_px"), grid([float(p) for p in probs], "prob"))
    if step:
        return rows.where(F.col("_c") >= F.col("prob") - 1e-12).groupBy(*by, "prob").agg(F.min(x).alias("value"))
    hit = rows.where((F.col("_c") >= F.col("prob") - 1e-12) & (F.col("_pc").isNull() | (F.col("_pc") < F.col("prob"))))
    value = F.when(F.col("_pc").isNull(), F.col(x)).otherwise(F.col("_px") + (F.col(x) - F.col("_px")) * (F.col("prob") - F.col("_pc")) / (F.col("_c") - F.col("_pc")))
    return hit.groupBy(*by, "prob").agg(F.min(value).alias("value"))


def slope_summary(slopes: DataFrame, weight: str, by: list[str] | None = None) -> DataFrame:
    """n, weighted mean, quartiles by plain weight, shares positive and significant (p_value < 0.05)."""
    return slopes.groupBy(*(by or [])).agg(F.count("*").alias("n"), weighted_mean("slope", weight).alias("weighted_mean"), F.avg("slope").alias("mean"), F.percentile("slope", F.lit(0.25)).alias("p25"), F.percentile("slope", F.lit(0.5)).alias("p50"), F.percentile("slope", F.lit(0.75)).alias("p75"), F.avg((F.col("slope") > 0).cast("int")).alias("share_positive"), F.avg(F.coalesce((F.col("p_value") < 0.05).cast("int"), F.lit(0))).alias("share_significant"))


def average_rank(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    part = by or [F.lit(1)]
    return df.withColumn(name, F.rank().over(Window.partitionBy(*part).orderBy(value)) + (F.count("*").over(Window.partitionBy(*part, value)) - 1) / 2)


def correlations(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """n, pearson and spearman (by average ranks)."""
    rows = average_rank(average_rank(_clean(df, x, y), x, "_rx", by), y, "_ry", by)
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def auc(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """n, n_positive, auc of a score for a 0/1 column, ties by average ranks; null of one class."""
    rows = average_rank(_clean(df, score, positive), score, "_r", by)
    out = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sum(F.col(positive)).cast("long").alias("n_positive"), F.sum(F.when(F.col(positive) == 1, F.col("_r"))).alias("_s"))
    p = F.col("n_positive").cast("double")
    return out.withColumn("auc", F.when((p > 0) & (p < F.col("n")), (F.col("_s") - p * (p + 1) / 2) / (p * (F.col("n") - p)))).drop("_s")


def fit_metrics(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """OLS with adjusted r2, rmse, mae, ranges of y and x, pearson and spearman, and of y the auc for x above zero."""
    by = by or []
    r = residuals(df, y, x, by).groupBy(*by).agg(F.sqrt(F.avg(F.col("_e") ** 2)).alias("rmse"), F.avg(F.abs("_e")).alias("mae"), (F.max(y) - F.min(y)).alias("range_y"), (F.max(x) - F.min(x)).alias("range_x"))
    sign = auc(_clean(df, y, x).withColumn("_any", (F.col(x) > 0).cast("int")), y, "_any", by).select(*by, "auc")
    fit, c = ols(df, y, x, by).withColumn("adj_r2", 1 - F.try_divide((1 - F.col("r2")) * (F.col("n") - 1), F.col("n") - 2)), correlations(df, x, y, by).drop("n")
    return fit.join(r, by).join(c, by).join(sign, by) if by else fit.crossJoin(r).crossJoin(c).crossJoin(sign)  # a row each


def contrast(df: DataFrame, y: str, side: str, by: list[str] | None = None) -> DataFrame:
    """OLS of y on a 0/1 of side = `high` against `low`, with rows on either side."""
    rows = df.where(F.col(side).isin("low", "high")).withColumn("_h", (F.col(side) == "high").cast("double"))
    return ols(rows, y, "_h", by)


def per_predictor(df: DataFrame, y: str, predictors: list[str]) -> DataFrame:
    """OLS of y on each predictor, a row each: for placebo leads and lags, and for windows."""
    return ols(df.unpivot([y], predictors, "predictor", "_x"), y, "_x", ["predictor"])


def shift_profile(series: DataFrame, exposure: DataFrame, y: str, x: str, shifts: list[int], lags: int) -> DataFrame:
    """newey_west for the exposure moved by each number of days."""
    moved = exposure.select(F.col("date").alias("_d"), F.col(x).alias("_x"), grid(shifts, "shift")).select(F.date_add("_d", F.col("shift")).alias("date"), "shift", "_x")
    return newey_west(series.select("date", y).join(moved, "date"), y, "_x", "date", lags, ["shift"])


def scenario_fits(df: DataFrame, flags: DataFrame, y: str, x: str) -> DataFrame:
    """OLS under each scenario of flags (scenario, date, remove) without the dates it removes; n_removed of them."""
    return with_counts(ols(kept_rows(df, flags), y, x, ["scenario"]), flags)


def kept_rows(df: DataFrame, flags: DataFrame) -> DataFrame:
    """df once for each scenario (a few), without the dates it removes."""
    scenarios = flags.select("scenario").distinct()
    return df.crossJoin(F.broadcast(scenarios)).join(flags.where("remove").select("scenario", "date"), ["scenario", "date"], "left_anti")


def with_counts(fits: DataFrame, flags: DataFrame) -> DataFrame:
    """Fits by scenario, with the number of dates that each scenario removes."""
    return fits.join(flags.groupBy("scenario").agg(F.sum(F.col("remove").cast("int")).cast("long").alias("n_removed")), "scenario")


def threshold_slopes(df: DataFrame, x: str, cuts: list[float], least: int) -> DataFrame:
    """entity, cut, n, slope of 1 (p < cut) on x (0 where the outcome is constant), se, df (null there)."""
    rows = _clean(df, "p", x).select("entity", "p", x, grid(cuts, "cut")).withColumn("_y", (F.col("p") < F.col("cut")).cast("double"))
    out = rows.groupBy("entity", "cut").agg(F.count("*").alias("n"), F.regr_slope("_y", x).alias("_b"), F.stddev_pop("_y").alias("_sy"), F.stddev_pop(x).alias("_sx"), F.regr_sxx("_y", x).alias("_xx"), F.regr_sxy("_y", x).alias("_xy"), F.regr_syy("_y", x).alias("_yy"))
    varied = F.col("_sy") > 1e-12
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("_yy") - F.col("_b") * F.col("_xy")) / (F.col("n") - 2) / F.col("_xx"))
    return out.where((F.col("n") >= least) & (F.col("_sx") > 1e-12)).select("entity", "cut", "n", F.when(varied, F.col("_b")).otherwise(0.0).alias("slope"), F.when(varied, se).alias("se"), F.when(varied, F.col("n") - 2).alias("df"))


def effects(fits: DataFrame, unit: float = 0.1, mw: float = 1000.0, mean_mw: float | None = None, hours: float = 1.0) -> DataFrame:
    """Slopes as percentage points per unit of exposure share, with the 95 % interval.

    With the mean contracted power in MW also per 1000 MW, and per GWh of an exposure that lasts so many hours.
    """
    out = fits.withColumns({"pp": 100 * unit * F.col("slope"), "pp_low": 100 * unit * (F.col("slope") - 1.96 * F.col("se")), "pp_high": 100 * unit * (F.col("slope") + 1.96 * F.col("se"))})
    return out if mean_mw is None else out.withColumns({"pp_per_1000_mw": 100 * F.col("slope") * mw / mean_mw, "pp_per_gwh": 100 * F.col("slope") * 1000 / (mean_mw * hours)})


def mean_interval(df: DataFrame, y: str, by: list[str]) -> DataFrame:
    """n, mean, se and df of each group, to which functions.tails.inferred adds the interval."""
    return _clean(df, y).groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), (F.stddev_samp(y) / F.sqrt(F.count("*"))).alias("se"), (F.count("*") - 1).alias("df"))


def quasi_poisson(df: DataFrame, y: str, x: str, by: list[str] | None = None, rounds: int = 25) -> DataFrame:
    """by, n, intercept, slope, se, dispersion, rounds: log-link fits of all groups together, dispersion from Pearson's chi2.

    Iteratively reweighted least squares: each round joins a table of coefficients to the rows of the groups that still
    move, and one aggregate gives the next table. Groups that have settled drop out. Groups without a positive mean, with a
    constant x or of fewer than three rows have no fit. Rows are written once, a table of coefficients each round.
    """
    by = by or []
    spark = df.sparkSession
    key = F.xxhash64(*by) if by else F.lit(0).cast("long")
    folder = shared_path(spark, "quasi-poisson")
    _clean(df, y, x).dropna(subset=by).select(*by, key.alias("_g"), F.col(y).alias("_y"), F.col(x).alias("_x")).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    keys = ["_g", *by]
    first = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_y").alias("_m"), F.var_pop("_x").alias("_v")).where("n > 2 and _m > 0 and _v > 1e-14")
    state = first.select(*keys, "n", F.log("_m").alias("a"), F.lit(0.0).alias("b"), F.lit(False).alias("done"), F.lit(0).alias("rounds"))
    mu, t = F.exp(F.col("a") + F.col("b") * F.col("_x")), F.col("a") + F.col("b") * F.col("_x")
    for r in range(rounds):
        state.write.parquet(f"{folder}/{r}")
        state = spark.read.parquet(f"{folder}/{r}")
        if not state.where("not done").limit(1).count():
            break
        z = t + (F.col("_y") - mu) / mu
        sums = rows.join(state.where("not done").select(*keys, "a", "b"), keys).groupBy(*keys).agg(F.sum(mu).alias("w"), F.sum(mu * F.col("_x")).alias("wx"), F.sum(mu * F.col("_x") ** 2).alias("wxx"), F.sum(mu * z).alias("wz"), F.sum(mu * F.col("_x") * z).alias("wxz"))
        det = F.col("w") * F.col("wxx") - F.col("wx") ** 2
        fresh = sums.select(*keys, F.try_divide(F.col("wxx") * F.col("wz") - F.col("wx") * F.col("wxz"), det).alias("_a"), F.try_divide(F.col("w") * F.col("wxz") - F.col("wx") * F.col("wz"), det).alias("_b"))
        met = state.join(fresh, keys, "left")
        still = F.greatest(F.abs(F.col("_a") - F.col("a")), F.abs(F.col("_b") - F.col("b"))) < 1e-10
        state = met.select(*keys, "n", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), (F.col("done") | F.coalesce(still, F.lit(True))).alias("done"), (F.col("rounds") + (~F.col("done")).cast("int")).alias("rounds"))
    last = rows.join(state, keys).groupBy(*keys).agg(F.max("n").alias("n"), F.max("a").alias("intercept"), F.max("b").alias("slope"), F.max("rounds").alias("rounds"), F.sum(mu).alias("w"), F.sum(mu * F.col("_x")).alias("wx"), F.sum(mu * F.col("_x") ** 2).alias("wxx"), F.sum((F.col("_y") - mu) ** 2 / mu).alias("chi"))
    dispersion = F.col("chi") / (F.col("n") - 2)
    return last.select(*by, "n", "intercept", "slope", F.sqrt(F.try_divide(F.col("w"), F.col("w") * F.col("wxx") - F.col("wx") ** 2) * dispersion).alias("se"), dispersion.alias("dispersion"), "rounds")


def wald_hac(df: DataFrame, y: str, xs: list[str], tested: list[str], order: str, lags: int, by: list[str] | None = None) -> DataFrame:
    """by, n, statistic, df, p_value: joint test of every group that the tested terms are zero, with the full HAC covariance.

    One job: the fits come from sums by group; a row's scores s and their Bartlett-weighted lags l give s s' + s l' + l s',
    whose sum is the middle of the covariance. Groups with a singular model have no row. The lags' window holds a group: a
    series, a row a day.
    """
    by = by or []
    names = ["_one", *xs]
    k = len(names)
    rows = _clean(df, y, *xs).dropna(subset=by).withColumn("_one", F.lit(1.0))
    terms = solve(normal_equations(rows, y, xs, by), xs, by)
    at = F.map_from_entries(F.collect_list(F.struct("term", "estimate")))
    fits = terms.groupBy(*by).agg(at.alias("_b"), F.max("n").alias("_n"))  # a row a group
    rows = rows.join(fits, by) if by else rows.crossJoin(F.broadcast(fits))
    fitted = F.element_at("_b", F.lit("(intercept)"))
    for c in xs:
        fitted = fitted + F.element_at("_b", F.lit(c)) * F.col(c)
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order)
    rows = rows.withColumn("_e", F.col(y) - fitted).withColumns({f"_s{i}": F.col(c) * F.col("_e") for i, c in enumerate(names)})
    lag = lambda i: sum((F.lit(1 - j / (lags + 1)) * F.coalesce(F.lag(f"_s{i}", j).over(w), F.lit(0.0)) for j in range(1, lags + 1)), F.lit(0.0))
    rows = rows.withColumns({f"_l{i}": lag(i) for i in range(k)})
    s, t = ([F.col(f"_{c}{i}") for i in range(k)] for c in "sl")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.groupBy(*by).agg(F.max("_n").alias("n"), F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("xx"), F.array(*[F.sum(s[i] * s[j] + s[i] * t[j] + s[j] * t[i]) for i, j in pairs]).alias("meat"), F.first("_b").alias("_b"))
    coef = F.array(F.element_at("_b", F.lit("(intercept)")), *[F.element_at("_b", F.lit(c)) for c in xs])
    chosen = [names.index(c) for c in tested]

    def task(batches):
        from duskgrid.functions.tails import chi2_upper

        for b in batches:
            kept, stats = [], []
            for r, row in enumerate(b.select(["n", "xx", "meat", "coef"]).to_pylist()):  # k x k a group
                xx, meat = np.zeros((2, k, k))
                xx[np.triu_indices(k)], meat[np.triu_indices(k)] = row["xx"], row["meat"]
                xx, meat = (m + m.T - np.diag(np.diag(m)) for m in (xx, meat))
                inv = np.linalg.inv(xx)
                vcov = (inv @ meat @ inv * row["n"] / (row["n"] - k))[np.ix_(chosen, chosen)]
                beta = np.array(row["coef"])[chosen]
                if np.linalg.matrix_rank(vcov) == len(chosen):
                    kept.append(r)
                    stats.append(float(beta @ np.linalg.solve(vcov, beta)))
            own = b.take(pa.array(kept, pa.int64()))
            more = [pa.array(stats, pa.float64()), pa.array([len(chosen)] * len(kept), pa.int64()), pa.array([chi2_upper(v, len(chosen)) for v in stats], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in (*by, "n")), *more], names=[*by, "n", "statistic", "df", "p_value"])

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return sums.select(*by, "n", "xx", "meat", coef.alias("coef")).mapInArrow(task, f"{fields}n long, statistic double, df long, p_value double")


def factor_components(pairs: DataFrame, first: str, second: str, by: list[str] | None = None, rounds: int = 200, folder: str | None = None) -> DataFrame:
    """by, n_first, n_second, n_components of the graph that joins the levels of two factors that occur together.

    Labels (the least level of first) spread over the pairs, one factor after the other, until none changes; the pairs are
    written every fourth round.
    """
    by = by or []
    spark = pairs.sparkSession
    folder = folder or shared_path(spark, "components")
    at = pairs.select(*by, first, second).distinct().withColumn("_c", F.col(first))
    for r in range(rounds):
        one = at.withColumn("_p", F.min("_c").over(Window.partitionBy(*by, second)))
        at = one.withColumn("_n", F.min("_p").over(Window.partitionBy(*by, first)))
        if r % 4 == 0:
            at.write.parquet(f"{folder}/labels-{r}")
            at = spark.read.parquet(f"{folder}/labels-{r}")
            moved = at.where(F.col("_n") != F.col("_c")).limit(1).count()
            at = at.select(*by, first, second, F.col("_n").alias("_c"))
            if not moved:
                break
        else:
            at = at.select(*by, first, second, F.col("_n").alias("_c"))
    else:
        raise RuntimeError(f"the factors' components have not settled after {rounds} rounds")
    return at.groupBy(*by).agg(F.count_distinct(first).alias("n_first"), F.count_distinct(second).alias("n_second"), F.count_distinct("_c").alias("n_components"))


def two_way_effects(df: DataFrame, y: str, x: str, first: str, second: str, by: list[str] | None = None, rounds: int = 400, every: int = 4, tolerance: float = 1e-10) -> DataFrame:
    """by, n, slope, se, df: the slope with effects of two factors, both of any number of levels.

    Alternating projections: y and x lose the means of one factor, then of the other, until what the last round took away is
    below tolerance times their spread at the start (root sums of squares, in every group of by). Levels are never collected: rows
    are first added up to one a pair of levels and written once; a round writes the effects alone, a row a level. Degrees of
    freedom: the effects are as many as the levels of both factors less the components of their graph. A level that holds
    much of the rows is one row a level of the other factor.
    """
    by = by or []
    spark = df.sparkSession
    folder = shared_path(spark, "two-way")
    rows = _clean(df, y, x).dropna(subset=[first, second, *by])
    cells = rows.groupBy(*by, first, second).agg(F.count("*").alias("_w"), F.avg(y).alias("_y"), F.avg(x).alias("_x"), F.regr_sxx(y, x).alias("_ixx"), F.regr_sxy(y, x).alias("_ixy"), F.regr_syy(y, x).alias("_iyy"))
    cells.write.parquet(f"{folder}/0")
    size = lambda y, x: [F.sqrt(F.sum(F.col("_w") * c**2)) for c in (y, x)]
    cells = spark.read.parquet(f"{folder}/0")
    whole = cells.withColumns({c: F.col(c) - F.avg(c).over(Window.partitionBy(*by)) for c in ("_y", "_x")} if by else {c: F.col(c) - cells.agg(F.avg(c)).first()[0] for c in ("_y", "_x")})
    start = whole.groupBy(*by).agg(F.sqrt(F.sum(F.col("_w") * F.col("_y") ** 2)).alias("_ty"), F.sqrt(F.sum(F.col("_w") * F.col("_x") ** 2)).alias("_tx"))  # a row a group
    # cells stay as they are: rounds move the levels' effects, which are as many as levels and meet the cells by joins
    kinds = {"_a": first, "_b": second}
    effects: dict[str, DataFrame] = {}

    def freed(kinds_: dict) -> dict:
        return {c: F.col(c) - sum((F.coalesce(f"{k}{c}", F.lit(0.0)) for k in kinds_), F.lit(0.0)) for c in ("_y", "_x")}

    def met(of: DataFrame, which: dict[str, DataFrame]) -> DataFrame:
        for k, e in which.items():
            of = of.join(e, [*by, kinds[k[:2]]], "left")
        return of

    def fitted(k: str, other: str) -> DataFrame:
        """The means by one factor of what the other's effects leave."""
        rest = {other: effects[other]} if other in effects else {}
        rows = met(cells, rest).withColumns(freed(rest))
        return rows.groupBy(*by, kinds[k]).agg(*[(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(f"{k}{c}") for c in ("_y", "_x")])

    before: dict[str, DataFrame] = {}
    for r in range(1, rounds + 1):
        if r % every == 1 or every == 1:
            before = dict(effects)
        for k, other in (("_a", "_b"), ("_b", "_a")):
            fitted(k, other).write.parquet(f"{folder}/{r}{k}")
            effects[k] = spark.read.parquet(f"{folder}/{r}{k}")
        if r % every == 0:
            old = {f"{k}0": e.withColumnsRenamed({f"{k}{c}": f"{k}0{c}" for c in ("_y", "_x")}) for k, e in before.items()}
            moved = met(cells, effects | old)
            gone = {c: sum((F.col(f"{k}{c}") for k in kinds), F.lit(0.0)) - sum((F.col(f"{k}{c}") for k in old), F.lit(0.0)) for c in ("_y", "_x")}
            change = moved.groupBy(*by).agg(F.sqrt(F.sum(F.col("_w") * gone["_y"] ** 2)).alias("_dy"), F.sqrt(F.sum(F.col("_w") * gone["_x"] ** 2)).alias("_dx"))
            both = change.join(start, by) if by else change.crossJoin(start)  # a row each
            if not both.where((F.col("_dy") > tolerance * F.col("_ty")) | (F.col("_dx") > tolerance * F.col("_tx"))).limit(1).count():
                break
    else:
        raise RuntimeError(f"the effects have not settled after {rounds} rounds")
    at = met(cells, effects).withColumns(freed(kinds))
    w = F.col("_w")
    sums = at.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * F.col("_x") ** 2 + F.coalesce("_ixx", F.lit(0.0))).alias("_sxx"), F.sum(w * F.col("_x") * F.col("_y") + F.coalesce("_ixy", F.lit(0.0))).alias("_sxy"), F.sum(w * F.col("_y") ** 2 + F.coalesce("_iyy", F.lit(0.0))).alias("_syy"))
    graph = factor_components(at, first, second, by, folder=folder)
    both = sums.join(graph, by) if by else sums.crossJoin(F.broadcast(graph))
    left = F.col("n") - (F.col("n_first") + F.col("n_second") - F.col("n_components")) - 1
    ok = (F.col("_sxx") > 1e-14 * F.col("n")) & (left > 0)
    rss = F.greatest(F.lit(0.0), F.col("_syy") - F.try_divide(F.col("_sxy") ** 2, F.col("_sxx")))
    return both.select(*by, "n", F.when(ok, F.try_divide("_sxy", "_sxx")).alias("slope"), F.when(ok, F.sqrt(F.try_divide(rss, left * F.col("_sxx")))).alias("se"), F.when(ok, left).alias("df"))
