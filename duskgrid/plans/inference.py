"""Queries of inference by group: resampling, autoregressive errors, Poisson fits, joint tests, effects of two factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskgrid.functions.tails import inferred
from duskgrid.operators import regress as G
from duskgrid.operators import resample as Z
from duskgrid.plans.models import exposed, nw_sql, p_sql, solve3_sql
from duskgrid.plans.series import NA, PEX, PX, national, pe, shed

AREA = "ad AS (SELECT area AS k, pe.date AS date, AVG(p) AS y, ANY_VALUE(mlr / contracted) AS x FROM pe JOIN v_exposure e ON e.date = pe.date GROUP BY 1, 2)"
ENTITY = "ad AS (SELECT entity AS k, pe.date AS date, p AS y, mlr / contracted AS x FROM pe JOIN v_exposure e ON e.date = pe.date)"
#: The series numbered from 0, and their lengths.
NUMBERED = "nn AS (SELECT k, ROW_NUMBER() OVER (PARTITION BY k ORDER BY date) - 1 AS i, y, x FROM ad WHERE y IS NOT NULL AND x IS NOT NULL), z AS (SELECT k, COUNT(*) AS n FROM nn GROUP BY 1)"
QUARTERS = ", ".join(f"CAST(QUARTER(date) = {q} AS DOUBLE) AS d{q - 1}" for q in (2, 3, 4))


def by_area(v):
    """area, date, y (mean share lit), x (share of contracted load shed)."""
    rows = pe(v).groupBy("area", "date").agg(F.avg("p").alias("y"))
    return rows.join(shed(v).withColumnRenamed("shed_share", "x"), "date")


def by_entity(v):
    return exposed(v).select("entity", "date", F.col("p").alias("y"), "x")


def hashed_sql(draws: int, seed: int) -> str:
    """hb: the number h that a draw d and a block b have."""
    return f"""hb AS (SELECT d, b, CAST('0x' || SUBSTR(MD5(d || ',' || b || ',{seed}'), 1, 8) AS BIGINT) AS h
  FROM (SELECT UNNEST(GENERATE_SERIES(0, {draws - 1})) AS d) p, (SELECT UNNEST(GENERATE_SERIES(0, (SELECT (MAX(n) + 13) // 14 - 1 FROM z))) AS b) q)"""


def bootstrap_sql(draws: int, name: str) -> str:
    return f"""dr AS (SELECT k, d, (h % n + o) % n AS i FROM hb, z, (SELECT UNNEST(GENERATE_SERIES(0, 13)) AS o) s WHERE b * 14 + o < n),
sl AS (SELECT dr.k, d, REGR_SLOPE(y, x) AS slope FROM dr JOIN nn ON nn.k = dr.k AND nn.i = dr.i GROUP BY 1, 2)
SELECT k AS {name}, N(COUNT(slope)) AS n, R(AVG(slope)) AS mean, R(STDDEV_SAMP(slope)) AS se, R(QUANTILE_CONT(slope, 0.025)) AS low, R(QUANTILE_CONT(slope, 0.975)) AS high,
  R(LEAST(1, 2 * (1 + LEAST(COUNT(*) FILTER (WHERE slope <= 0), COUNT(*) FILTER (WHERE slope >= 0))) / (COUNT(slope) + 1))) AS p_value FROM sl GROUP BY 1"""


PERMUTED = """bl AS (SELECT DISTINCT k, i // 14 AS b FROM nn),
pl AS (SELECT k, d, bl.b, ROW_NUMBER() OVER (PARTITION BY k, d ORDER BY h, bl.b) AS r FROM bl JOIN hb ON hb.b = bl.b),
mv AS (SELECT pl.k, d, x, ROW_NUMBER() OVER (PARTITION BY pl.k, d ORDER BY r, i) - 1 AS i FROM pl JOIN nn ON nn.k = pl.k AND nn.i // 14 = pl.b),
sl AS (SELECT mv.k, d, REGR_SLOPE(nn.y, mv.x) AS slope FROM mv JOIN nn ON nn.k = mv.k AND nn.i = mv.i GROUP BY 1, 2),
ac AS (SELECT k, REGR_SLOPE(y, x) AS actual FROM nn GROUP BY 1)
SELECT sl.k AS area, N(COUNT(slope)) AS n, R(MAX(actual)) AS actual, R(AVG(slope)) AS mean, R(STDDEV_SAMP(slope)) AS sd, R(QUANTILE_CONT(slope, 0.025)) AS low,
  R(QUANTILE_CONT(slope, 0.975)) AS high, R((1 + COUNT(*) FILTER (WHERE ABS(slope) >= ABS(actual))) / (COUNT(slope) + 1)) AS p_value FROM sl JOIN ac ON ac.k = sl.k GROUP BY 1"""

SHIFTED = """sl AS (SELECT a.k, s, REGR_SLOPE(a.y, b.x) AS slope FROM nn a JOIN z ON z.k = a.k, (SELECT UNNEST(GENERATE_SERIES(1, (SELECT MAX(n) - 1 FROM z))) AS s) t
  JOIN nn b ON b.k = a.k AND b.i = (a.i + s) % n WHERE s < n GROUP BY 1, 2),
ac AS (SELECT k, REGR_SLOPE(y, x) AS actual FROM nn GROUP BY 1)
SELECT sl.k AS area, N(COUNT(slope)) AS n, R(MAX(actual)) AS actual, R(AVG(slope)) AS mean, R(STDDEV_SAMP(slope)) AS sd, R(QUANTILE_CONT(slope, 0.025)) AS low,
  R(QUANTILE_CONT(slope, 0.975)) AS high, R((1 + COUNT(*) FILTER (WHERE ABS(slope) >= ABS(actual))) / (COUNT(slope) + 1)) AS p_value FROM sl JOIN ac ON ac.k = sl.k GROUP BY 1"""


def gls_sql(name: str, phis: str) -> str:
    """Fits of ar for every k and phi of phis, with errors correlated as phi to the gap in days."""
    return f"""{name}_r AS (SELECT ar.k, phi, y, x, COALESCE(py, 0) AS py, COALESCE(px, 0) AS px, CASE WHEN g IS NULL THEN 0 ELSE POWER(phi, g) END AS r FROM ar JOIN {phis} q ON q.k = ar.k),
{name}_t AS (SELECT k, phi, LN(SQRT(1 - r * r)) AS ls, (y - r * py) / SQRT(1 - r * r) AS y, (x - r * px) / SQRT(1 - r * r) AS x, (1 - r) / SQRT(1 - r * r) AS c FROM {name}_r),
{name}_a AS (SELECT k, phi, COUNT(*) AS n, SUM(c * c) AS cc, SUM(c * x) AS cx, SUM(x * x) AS xx, SUM(c * y) AS cy, SUM(x * y) AS xy, SUM(y * y) AS yy, SUM(ls) AS ls FROM {name}_t GROUP BY 1, 2),
{name}_b AS (SELECT *, cc * xx - cx * cx AS det, (cc * xy - cx * cy) / (cc * xx - cx * cx) AS slope, (xx * cy - cx * xy) / (cc * xx - cx * cx) AS intercept FROM {name}_a),
{name} AS (SELECT k, phi, n, slope, intercept, SQRT((yy - slope * xy - intercept * cy) / n * n * cc / ((n - 2) * det)) AS se,
  -n / 2 * (LN(2 * PI() * (yy - slope * xy - intercept * cy) / n) + 1) - ls AS loglik FROM {name}_b)"""


def around_sql(of: str, wide: float, step: float) -> str:
    """Phis around the best of a table of fits."""
    i = f"best - {wide!r}::DOUBLE + {step!r}::DOUBLE * i"
    return f"(SELECT k, {i} AS phi FROM (SELECT k, ARG_MAX(phi, loglik) AS best FROM {of} GROUP BY 1) p, (SELECT UNNEST(GENERATE_SERIES(0, {round(2 * wide / step)})) AS i) s WHERE {i} >= 0 AND {i} < 1)"


def ar1_sql(name: str) -> str:
    """The most likely phi of every series of ad and its fit; see operators.resample."""
    a, b, c = Z.STEPS
    keep = "SELECT k, date, y, x FROM ad WHERE y IS NOT NULL AND x IS NOT NULL QUALIFY COUNT(*) OVER (PARTITION BY k) >= 6 AND MAX(x) OVER (PARTITION BY k) > MIN(x) OVER (PARTITION BY k) AND MAX(y) OVER (PARTITION BY k) > MIN(y) OVER (PARTITION BY k)"
    top = "(SELECT k, ARG_MAX(phi, loglik) AS phi FROM gc GROUP BY 1)"
    return f"""ar AS (SELECT k, date - LAG(date) OVER o AS g, y, x, LAG(y) OVER o AS py, LAG(x) OVER o AS px FROM ({keep}) s WINDOW o AS (PARTITION BY k ORDER BY date)),
{gls_sql('ga', f'(SELECT DISTINCT k, {a!r}::DOUBLE * i AS phi FROM ar, (SELECT UNNEST(GENERATE_SERIES(0, 49)) AS i) s)')},
{gls_sql('gb', around_sql('ga', a, b))}, {gls_sql('gc', around_sql('gb', b, c))},
gd_p AS (SELECT k, phi + i * {c!r}::DOUBLE AS phi, i FROM {top} t, (SELECT UNNEST([-1, 0, 1]) AS i) s WHERE phi - {c!r} >= 0 AND phi + {c!r} < 1), {gls_sql('gd', 'gd_p')},
ge_p AS (SELECT gd.k, SUM(loglik) FILTER (WHERE i = -1) AS lo, SUM(loglik) FILTER (WHERE i = 0) AS mid, SUM(loglik) FILTER (WHERE i = 1) AS hi FROM gd JOIN gd_p ON gd_p.k = gd.k AND gd_p.phi = gd.phi GROUP BY 1),
gf_p AS (SELECT t.k, CASE WHEN lo - 2 * mid + hi < 0 THEN phi - {c!r} / 2 * (hi - lo) / (lo - 2 * mid + hi) ELSE phi END AS phi FROM {top} t LEFT JOIN ge_p ON ge_p.k = t.k), {gls_sql('gf', 'gf_p')}
SELECT {name}R(phi) AS phi, N(n) AS n, R(slope) AS slope, R(intercept) AS intercept, R(se) AS se, R(loglik) AS loglik FROM gf"""


def wald_sql(lags: int) -> str:
    """Joint HAC test of d1 to d3 of w0 (k, date, y, x, d1, d2, d3) for every k."""
    pairs = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    cols, own = ("y", "d1", "d2", "d3"), "OVER (PARTITION BY k)"
    meat = ",\n  ".join(f"SUM(s{i} * s{j})" + "".join(f" + {1 - m / (lags + 1)!r} * COALESCE(SUM(s{i} * l{j}{m} + s{j} * l{i}{m}), 0)" for m in range(1, lags + 1)) + f" AS m{i}{j}" for i, j in pairs)
    b, z = solve3_sql("a", "g"), solve3_sql("m", "g")
    return f"""w1 AS (SELECT k, date, x - AVG(x) {own} AS x, {', '.join(f'{c} - AVG({c}) {own} AS {c}' for c in cols)} FROM w0),
w2 AS (SELECT k, date, {', '.join(f'{c} - SUM({c} * x) {own} / SUM(x * x) {own} * x AS {c}' for c in cols)} FROM w1),
wa AS (SELECT k, COUNT(*) AS n, {', '.join(f'SUM(d{i} * d{j}) AS a{i}{j}' for i, j in pairs)}, {', '.join(f'SUM(d{i} * y) AS g{i}' for i in (1, 2, 3))} FROM w2 GROUP BY 1),
wb AS (SELECT k, {', '.join(f'{e} AS b{i}' for i, e in enumerate(b, 1))} FROM wa),
w3 AS (SELECT w2.k, date, {', '.join(f'd{i} * (y - b1 * d1 - b2 * d2 - b3 * d3) AS s{i}' for i in (1, 2, 3))} FROM w2 JOIN wb ON wb.k = w2.k),
w4 AS (SELECT *, {', '.join(f'LAG(s{i}, {m}) OVER (PARTITION BY k ORDER BY date) AS l{i}{m}' for i in (1, 2, 3) for m in range(1, lags + 1))} FROM w3),
wm AS (SELECT k, {meat} FROM w4 GROUP BY 1),
ws AS (SELECT wa.k, n, (g1 * ({z[0]}) + g2 * ({z[1]}) + g3 * ({z[2]})) * (n - 5) / n AS s FROM wa JOIN wm ON wm.k = wa.k)"""


CHI3 = "R(1 - SQRT(2 / PI()) * SQRT(s) / 1200 * LIST_SUM(LIST_TRANSFORM(RANGE(0, 401), lambda i: (CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * POWER(i * SQRT(s) / 400, 2) * EXP(-POWER(i * SQRT(s) / 400, 2) / 2))))"

POISSON = """pn AS (SELECT area AS k, CASE WHEN population > 3000 THEN 'large' ELSE 'small' END AS size_class, COUNT(*) FILTER (WHERE p < 0.05)::DOUBLE AS y, ANY_VALUE(mlr / contracted) AS x
  FROM pe JOIN v_exposure e ON e.date = pe.date GROUP BY 1, 2, pe.date),
pg AS (SELECT k, size_class FROM pn GROUP BY 1, 2 HAVING COUNT(*) > 2 AND AVG(y) > 0 AND VAR_POP(x) > 1e-14),
it(i, k, size_class, a, b) AS (
  SELECT 0, pn.k, pn.size_class, LN(AVG(y)), 0.0::DOUBLE FROM pn JOIN pg ON pg.k = pn.k AND pg.size_class = pn.size_class GROUP BY 2, 3
  UNION ALL SELECT i + 1, k, size_class, (wxx * wz - wx * wxz) / (w * wxx - wx * wx), (w * wxz - wx * wz) / (w * wxx - wx * wx) FROM (
    SELECT i, it.k, it.size_class, SUM(EXP(a + b * x)) AS w, SUM(EXP(a + b * x) * x) AS wx, SUM(EXP(a + b * x) * x * x) AS wxx,
      SUM(EXP(a + b * x) * (a + b * x) + y - EXP(a + b * x)) AS wz, SUM(x * (EXP(a + b * x) * (a + b * x) + y - EXP(a + b * x))) AS wxz
    FROM it JOIN pn ON pn.k = it.k AND pn.size_class = it.size_class WHERE i < 25 GROUP BY 1, 2, 3) z),
ps AS (SELECT pn.k, pn.size_class, MAX(a) AS a, MAX(b) AS b, COUNT(*) AS n, SUM(EXP(a + b * x)) AS w, SUM(EXP(a + b * x) * x) AS wx, SUM(EXP(a + b * x) * x * x) AS wxx, SUM(POWER(y - EXP(a + b * x), 2) / EXP(a + b * x)) AS chi
  FROM pn JOIN it ON it.k = pn.k AND it.size_class = pn.size_class WHERE i = 25 GROUP BY 1, 2)
SELECT k AS area, size_class, N(n) AS n, R(a) AS intercept, R(b) AS slope, R(SQRT(w / (w * wxx - wx * wx) * chi / (n - 2))) AS se, R(chi / (n - 2)) AS dispersion FROM ps"""


def dark_counts(v):
    """area, size_class, date, y: entities that are dark, and x, the share shed."""
    size_class = F.when(F.col("population") > 3000, "large").otherwise("small").alias("size_class")
    rows = pe(v).groupBy("area", size_class, "date").agg(F.count_if(F.col("p") < 0.05).cast("double").alias("y"))
    return rows.join(shed(v).withColumnRenamed("shed_share", "x"), "date")


def quarters(v):
    rows = by_area(v).withColumn("q", F.quarter("date"))
    return G.with_dummies(rows, "q", [1, 2, 3, 4])[0]


def first_difference_sql() -> str:
    return "dd AS (SELECT a.k, a.date, a.y - b.y AS y, a.x - b.x AS x FROM ad a JOIN ad b ON b.k = a.k AND b.date = a.date - 1)"


LAGGED = """q0 AS (SELECT a.k, a.date, a.y, a.x, b.y AS l FROM ad a JOIN ad b ON b.k = a.k AND b.date = a.date - 1 WHERE a.y IS NOT NULL AND b.y IS NOT NULL AND a.x IS NOT NULL),
q1 AS (SELECT k, date, y - AVG(y) OVER o AS y, x - AVG(x) OVER o AS x, l - AVG(l) OVER o AS l FROM q0 WINDOW o AS (PARTITION BY k)),
q2 AS (SELECT k, date, y - SUM(y * l) OVER o / SUM(l * l) OVER o * l AS y, x - SUM(x * l) OVER o / SUM(l * l) OVER o * l AS x FROM q1 WINDOW o AS (PARTITION BY k))"""


def hac_sql(loss: int) -> str:
    return f"SELECT k AS area, N(n) AS n, R(slope) AS slope, R(se_hac) AS se_hac, R({p_sql('(slope / NULLIF(se_hac, 0))', f'(n - {loss})')}) AS p_value FROM nw"


def mean_bootstrap_sql(draws: int, seed: int) -> str:
    """The Poisson draws of operators.resample.mean_bootstrap over the panel, by entity."""
    cuts, cut, p = [], 0.0, 0.36787944117144233
    for i in range(12):
        cut += p
        p /= i + 1
        cuts.append(f"CAST(u > {cut!r} AS INTEGER)")
    number = lambda text: f"CAST('0x' || SUBSTR(MD5({text}), 1, 8) AS BIGINT)"
    return f"""rw AS (SELECT entity, p, {number(f"entity || ',' || date || ',{seed}'")} % {Z.PRIME} AS r FROM v_panel WHERE p IS NOT NULL),
dw AS (SELECT d, 1 + {number(f"d || ',{seed},1'")} % {Z.PRIME - 1} AS a, {number(f"d || ',{seed},2'")} % {Z.PRIME} AS b FROM (SELECT UNNEST(GENERATE_SERIES(0, {draws - 1})) AS d) q),
h1 AS (SELECT entity, d, p, (a * r + b) % {Z.PRIME} AS h FROM rw, dw),
h2 AS (SELECT entity, d, p, ((h * (h + 7) + 11) % {Z.PRIME} + 0.5) / {Z.PRIME} AS u FROM h1),
ms AS (SELECT entity, d, SUM(k * p) / SUM(k) AS m FROM (SELECT entity, d, p, {' + '.join(cuts)} AS k FROM h2) s GROUP BY 1, 2),
mq AS (SELECT entity, QUANTILE_CONT(m, 0.025) AS low, QUANTILE_CONT(m, 0.975) AS high FROM ms GROUP BY 1),
mp AS (SELECT entity, COUNT(p) AS n, AVG(p) AS mean FROM v_panel GROUP BY 1)
SELECT mp.entity, N(n) AS n, R(mean) AS mean, R(low) AS low, R(high) AS high FROM mp JOIN mq ON mq.entity = mp.entity"""


BALANCED = """bl AS (SELECT region, DATE_TRUNC('quarter', date) AS mo, AVG(p) AS y, AVG(mean_rad) / 1000 AS x FROM pe GROUP BY 1, 2),
bd AS (SELECT y - AVG(y) OVER (PARTITION BY region) - AVG(y) OVER (PARTITION BY mo) + AVG(y) OVER () AS y, x - AVG(x) OVER (PARTITION BY region) - AVG(x) OVER (PARTITION BY mo) + AVG(x) OVER () AS x FROM bl),
bs AS (SELECT COUNT(*) AS n, SUM(x * x) AS xx, SUM(x * y) AS xy, SUM(y * y) AS yy FROM bd), bk AS (SELECT COUNT(DISTINCT region) + COUNT(DISTINCT mo) - 1 AS k FROM bl)
SELECT N(n) AS n, R(xy / xx) AS slope, R(SQRT((yy - xy * xy / xx) / (n - k - 1) / xx)) AS se, N(n - k - 1) AS df FROM bs, bk"""


def two_factor_sql() -> str:
    """p on mean_rad with effects of entity and quarter: freed of the entities' means, then of three dummies."""
    pairs = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    of = lambda c: "OVER (PARTITION BY entity)"
    a, b = solve3_sql("a", "g"), solve3_sql("a", "h")
    return f"""t0 AS (SELECT entity, p AS y, mlr / contracted AS x, {QUARTERS.replace('date', 'v_panel.date')} FROM v_panel JOIN v_exposure e ON e.date = v_panel.date WHERE p IS NOT NULL AND mlr / contracted IS NOT NULL),
t1 AS (SELECT {', '.join(f'{c} - AVG({c}) {of(c)} AS {c}' for c in ('y', 'x', 'd1', 'd2', 'd3'))} FROM t0),
t2 AS (SELECT COUNT(*) AS n, SUM(x * x) AS xx, SUM(x * y) AS xy, SUM(y * y) AS yy, {', '.join(f'SUM(d{i} * d{j}) AS a{i}{j}' for i, j in pairs)}, {', '.join(f'SUM(d{i} * x) AS g{i}, SUM(d{i} * y) AS h{i}' for i in (1, 2, 3))} FROM t1),
t3 AS (SELECT n, xx - ({' + '.join(f'g{i} * {e}' for i, e in enumerate(a, 1))}) AS xx, xy - ({' + '.join(f'h{i} * {e}' for i, e in enumerate(a, 1))}) AS xy, yy - ({' + '.join(f'h{i} * {e}' for i, e in enumerate(b, 1))}) AS yy,
  n - (SELECT COUNT(DISTINCT entity) FROM t0) - 3 - 1 AS df FROM t2)
SELECT N(n) AS n, R(xy / xx) AS slope, R(SQRT((yy - xy * xy / xx) / df / xx)) AS se, N(df) AS df FROM t3"""


def catalog():
    c = {}
    areas, entities = f", {PX}, {AREA}, {NUMBERED}", f", {PX}, {ENTITY}, {NUMBERED}"
    c["res1_by_area"] = (PEX, lambda v: Z.bootstrap_summary(Z.block_bootstrap(by_area(v), "y", "x", "date", 2000, 14, ["area"]), ["area"]), f"{areas}, {hashed_sql(2000, 17)}, {bootstrap_sql(2000, 'area')}")
    c["res1_by_entity"] = (PEX, lambda v: Z.bootstrap_summary(Z.block_bootstrap(by_entity(v), "y", "x", "date", 1000, 14, ["entity"]), ["entity"]), f"{entities}, {hashed_sql(1000, 17)}, {bootstrap_sql(1000, 'entity')}")
    c["res2_by_area"] = (PEX, lambda v: Z.placebo_summary(by_area(v), "y", "x", Z.block_permutation(by_area(v), "y", "x", "date", 1000, 14, ["area"]), ["area"]), f"{areas}, {hashed_sql(1000, 5)}, {PERMUTED}")
    c["res3_by_area"] = (PEX, lambda v: Z.placebo_summary(by_area(v), "y", "x", Z.circular_shifts(by_area(v), "y", "x", "date", ["area"]), ["area"]), f"{areas}, {SHIFTED}")
    c["res4_ar1"] = (PEX, lambda v: Z.ar1_fit(national(v).select("date", F.col("strict_dark").alias("y"), F.col("shed_share").alias("x")), "y", "x"), f", {PX}, {NA}, ad AS (SELECT 1 AS k, date, strict_dark AS y, shed_share AS x FROM na), {ar1_sql('')}")
    c["res4_by_area"] = (PEX, lambda v: Z.ar1_fit(by_area(v), "y", "x", by=["area"]), f", {PX}, {AREA}, {ar1_sql('k AS area, ')}")
    c["res5_difference_by_area"] = (PEX, lambda v: inferred(Z.first_difference(by_area(v), "y", "x", 7, ["area"]), se="se_hac").select("area", "n", "slope", "se_hac", "p_value"), f", {PX}, {AREA}, {first_difference_sql()}, {nw_sql('dd', 'y', 'x', 7, 'k')} {hac_sql(2)}")
    c["res5_lagged_by_area"] = (PEX, lambda v: inferred(Z.lagged_outcome(by_area(v), "y", "x", 7, ["area"]), se="se_hac").select("area", "n", "slope", "se_hac", "p_value"), f", {PX}, {AREA}, {LAGGED}, {nw_sql('q2', 'y', 'x', 7, 'k', 3)} {hac_sql(3)}")
    c["res6_mean_bootstrap"] = (["v_panel"], lambda v: Z.mean_bootstrap(v("v_panel"), "p", "entity", ["entity", "date"], 1000), f", {mean_bootstrap_sql(1000, 23)}")
    c["reg3_by_group"] = (PEX, lambda v: G.quasi_poisson(dark_counts(v), "y", "x", ["area", "size_class"]).drop("rounds"), f"RECURSIVE, {PX}, {POISSON}")
    c["reg7_balanced"] = (PEX[:2], lambda v: G.two_way_effects(pe(v).groupBy("region", F.trunc("date", "quarter").alias("mo")).agg(F.avg("p").alias("y"), (F.avg("mean_rad") / 1000).alias("x")), "y", "x", "region", "mo"), f", {PX}, {BALANCED}")
    c["reg7_two_way"] = (["v_panel", "v_exposure"], lambda v: G.two_way(exposed(v).withColumn("q", F.quarter("date")), "p", "x", "entity", "q", [1, 2, 3, 4]), f", {two_factor_sql()}")
    c["reg7_alternating"] = (["v_panel", "v_exposure"], lambda v: G.two_way_effects(exposed(v).withColumn("q", F.quarter("date")), "p", "x", "entity", "q"), f", {two_factor_sql()}")
    c["reg7_entity_date"] = (["v_panel"], lambda v: G.two_way_effects(v("v_panel").withColumn("rad", F.col("mean_rad") / 1000), "p", "rad", "entity", "date"), None)
    c["reg16_by_area"] = (PEX, lambda v: G.wald_hac(quarters(v), "y", ["x", "q_2", "q_3", "q_4"], ["q_2", "q_3", "q_4"], "date", 7, ["area"]), f", {PX}, {AREA}, w0 AS (SELECT k, date, y, x, {QUARTERS} FROM ad WHERE y IS NOT NULL AND x IS NOT NULL), {wald_sql(7)} SELECT k AS area, N(n) AS n, R(s) AS statistic, N(3) AS df, {CHI3} AS p_value FROM ws")
    return c
