"""Queries of sweeps, regressions, resampling, spatial joins and registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskgrid.operators import calibrate as C
from duskgrid.operators import exposure as E
from duskgrid.operators import regress as G
from duskgrid.operators import resample as Z
from duskgrid.operators import series as N
from duskgrid.operators import spatial as A
from duskgrid.functions.tails import inferred
from duskgrid.operators import panel as P
from duskgrid.operators import states as S
from duskgrid.plans.panels import STATES, states, triggers
from duskgrid.plans.series import NA, OD, PE, PEX, PX, ZP, day, events, national, pe, shed
from duskgrid.sources import io

YR = "yr AS (SELECT v.entity, AVG(p) AS p_year, AVG(coverage) AS c_year FROM v_panel v GROUP BY 1), ye AS (SELECT e.*, p_year, c_year FROM v_entities e JOIN yr ON yr.entity = e.entity)"
CUTS = [round(0.05 + 0.01 * i, 2) for i in range(91)]
SWEEP = "sw AS (SELECT t AS threshold, COUNT(*) FILTER (WHERE p_year >= t) AS n, COALESCE(SUM(population) FILTER (WHERE p_year >= t), 0) / SUM(population) AS share FROM ye, (SELECT UNNEST([" + ", ".join(map(str, CUTS)) + "]) AS t) k GROUP BY 1)"
BT = "bt AS (SELECT threshold FROM sw ORDER BY ABS(share - 0.6), share DESC, threshold LIMIT 1)"
PD = "pd AS (SELECT v.entity, v.date, v.p, v.coverage, mlr / contracted AS x FROM v_panel v JOIN v_exposure e ON e.date = v.date)"


def fit_sql(src: str, y: str, x: str, by: str = "", more: str = "") -> str:
    g = f"{by}, " if by else ""
    group = f" GROUP BY {', '.join(str(i + 1) for i in range(by.count(',') + 1))}" if by else ""
    return f"fs AS (SELECT {g}COUNT(*) AS n, REGR_SXX({y}, {x}) AS sxx, REGR_SXY({y}, {x}) AS sxy, REGR_SYY({y}, {x}) AS syy, AVG({x}) AS mx, AVG({y}) AS my FROM {src} WHERE {y} IS NOT NULL AND {x} IS NOT NULL{more}{group})"


def p_sql(t: str, df: str) -> str:
    """The two-sided p of a t with df degrees of freedom, by Simpson's rule over the angle atan(t / sqrt(df))."""
    angle = f"ATAN(ABS({t}) / SQRT({df}))"
    area = f"{angle} / 1200 * LIST_SUM(LIST_TRANSFORM(RANGE(0, 401), lambda i: (CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * POWER(COS(i * {angle} / 400), {df} - 1)))"
    return f"CASE WHEN {t} IS NOT NULL AND {df} > 0 THEN GREATEST(0, 1 - 2 * EXP(LGAMMA(({df} + 1) / 2.0) - LGAMMA({df} / 2.0)) / SQRT(PI()) * {area}) END"


def q_sql(df: str) -> str:
    """The 97.5 % point of t for df of some dozens and more, by its expansion in 1 / df."""
    z = 1.959963984540054
    terms = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return f"({z!r} + " + " + ".join(f"{c!r} / POWER({df}, {i})" for i, c in enumerate(terms, 1)) + ")"


def interval_sql(estimate: str, se: str, df: str) -> str:
    return f"R({p_sql(f'({estimate} / NULLIF({se}, 0))', df)}) AS p_value, R({estimate} - {q_sql(df)} * {se}) AS ci_low, R({estimate} + {q_sql(df)} * {se}) AS ci_high"


_B = "(CASE WHEN n >= 6 AND sxx > 1e-14 THEN sxy / sxx END)"
_SE = "(CASE WHEN n >= 6 AND sxx > 1e-14 THEN SQRT(GREATEST(0, syy - sxy * sxy / sxx) / (n - 2) / sxx) END)"
FIT = f"N(n) AS n, R({_B}) AS slope, R(CASE WHEN n >= 6 AND sxx > 1e-14 THEN my - sxy / sxx * mx END) AS intercept, R({_SE}) AS se, R(CASE WHEN n >= 6 AND sxx > 1e-14 AND syy > 0 THEN sxy * sxy / sxx / syy END) AS r2, {interval_sql(_B, _SE, '(n - 2)')}"


def row(fits):
    """A regression row: with p value and interval, without their ingredients."""
    return inferred(fits).drop("t", "df")


def years(v):
    return v("v_panel").groupBy("entity").agg(F.avg("p").alias("p_year"), F.avg("coverage").alias("c_year")).join(v("v_entities"), "entity")


def above(column, cut):
    """1 where a mean is above the cut, to twelve places: a mean at the cut does not hang on the order of its sum."""
    return (F.round(column, 12) > cut).cast("int")


def sweep(v):
    return C.threshold_sweep(years(v), CUTS, 0.6)


def exposed(v):
    return v("v_panel").join(v("v_exposure").select("date", (F.col("mlr") / F.col("contracted")).alias("x")), "date")


def nine(df, *columns):
    """df with the columns rounded to nine places, see RANKS."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


def with_exposure(v):
    return nine(national(v), "strict_dark", "shed_share").withColumn("any_shed", (F.col("mlr") > 0).cast("int"))


def gated(v):
    return day(v).join(shed(v), "date")


GD = "gd AS (SELECT od.*, mlr / contracted AS shed_share FROM od JOIN v_exposure x ON x.date = od.date)"


def nw_sql(src: str, y: str, x: str, lags: int, by: str, k: int = 2) -> str:
    part, pick = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    own = f"({part.strip()})" if by else "()"
    terms = " + ".join(f"2 * (1 - {j} / {lags + 1}.0) * COALESCE(SUM(s * l{j}), 0)" for j in range(1, lags + 1))
    return f"""n0 AS (SELECT {pick}date, {y} - AVG({y}) OVER {own} AS dy, {x} - AVG({x}) OVER {own} AS dx FROM {src} WHERE {y} IS NOT NULL AND {x} IS NOT NULL),
n1 AS (SELECT *, SUM(dx * dx) OVER {own} AS sxx, SUM(dx * dy) OVER {own} AS sxy FROM n0), n2 AS (SELECT *, dx * (dy - sxy / sxx * dx) / sxx AS s FROM n1 WHERE sxx > 0),
n3 AS (SELECT *, {', '.join(f'LAG(s, {j}) OVER ({part}ORDER BY date) AS l{j}' for j in range(1, lags + 1))} FROM n2),
nw AS (SELECT {pick}COUNT(*) AS n, MAX(sxy / sxx) AS slope, SQRT(GREATEST(0, SUM(s * s) + {terms}) * COUNT(*) / (COUNT(*) - {k})) AS se_hac FROM n3 {f'GROUP BY {by}' if by else ''} HAVING COUNT(*) >= 6)"""


# Shares are sums in an order of each engine's own: ranks are of nine places, so that equal shares tie in both.
RANKS = "rk AS (SELECT *, RANK() OVER (ORDER BY ROUND(shed_share, 9)) + (COUNT(*) OVER (PARTITION BY ROUND(shed_share, 9)) - 1) / 2.0 AS rx, RANK() OVER (ORDER BY ROUND(strict_dark, 9)) + (COUNT(*) OVER (PARTITION BY ROUND(strict_dark, 9)) - 1) / 2.0 AS ry FROM na WHERE shed_share IS NOT NULL AND strict_dark IS NOT NULL)"
FE = "f0 AS (SELECT pd.entity, date, p - SUM(p * w) OVER q / SUM(w) OVER q AS dy, x - SUM(x * w) OVER q / SUM(w) OVER q AS dx, w FROM (SELECT pd.*, {w} AS w FROM pd JOIN v_entities e ON e.entity = pd.entity) pd WHERE w > 0 WINDOW q AS (PARTITION BY entity)), f1 AS (SELECT COUNT(*) AS n, COUNT(DISTINCT entity) AS k, SUM(w * dx * dx) AS sxx, SUM(w * dx * dy) AS sxy, SUM(w * dy * dy) AS syy FROM f0), f2 AS (SELECT date, SUM(w * dx * (dy - sxy / sxx * dx)) AS u FROM f0, f1 GROUP BY 1), f3 AS (SELECT COUNT(*) AS g, SUM(u * u) AS m FROM f2)"
FEC = "N(n) AS n, N(g) AS n_clusters, R(sxy / sxx) AS slope, R(SQRT(m * g / (g - 1) * (n - 1) / (n - k - 1)) / sxx) AS se_cluster, R(sxy * sxy / sxx / syy) AS r2_within, R(sxy / SQRT(sxx * syy)) AS partial_r"
EDGES = [(f"q{i}{j}", x, y) for i, x in enumerate((-0.5, 0.0)) for j, y in enumerate((-0.5, 0.0))]


def fe_by_sql(src: str, by: str) -> str:
    """f1, f3 of FE for every value of by, unweighted."""
    return f"""f0 AS (SELECT {by}, entity, date, p - AVG(p) OVER q AS dy, x - AVG(x) OVER q AS dx FROM {src} WINDOW q AS (PARTITION BY {by}, entity)),
f1 AS (SELECT {by}, COUNT(*) AS n, COUNT(DISTINCT entity) AS k, SUM(dx * dx) AS sxx, SUM(dx * dy) AS sxy, SUM(dy * dy) AS syy FROM f0 GROUP BY 1),
f2 AS (SELECT f0.{by}, date, SUM(dx * (dy - sxy / sxx * dx)) AS u FROM f0 JOIN f1 ON f1.{by} = f0.{by} GROUP BY 1, 2), f3 AS (SELECT {by}, COUNT(*) AS g, SUM(u * u) AS m FROM f2 GROUP BY 1)"""


def solve3_sql(m: str, v: str) -> list[str]:
    """The solution of a symmetric 3 x 3 system with columns <m>11 .. <m>33 and <v>1 .. <v>3, by Cramer's rule."""
    a = [[f"{m}{min(i, j)}{max(i, j)}" for j in (1, 2, 3)] for i in (1, 2, 3)]

    def det(x: list[list[str]]) -> str:
        return "(" + " + ".join(f"{x[0][i]} * ({x[1][(i + 1) % 3]} * {x[2][(i + 2) % 3]} - {x[1][(i + 2) % 3]} * {x[2][(i + 1) % 3]})" for i in range(3)) + ")"

    return [f"{det([[f'{v}{i + 1}' if j == c else a[i][j] for j in range(3)] for i in range(3)])} / {det(a)}" for c in range(3)]


def wald_sql(lags: int) -> str:
    """ws: n and statistic of the joint HAC test of three columns (d1 to d3 of w0, beside y and x)."""
    pairs = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    cols = ("y", "d1", "d2", "d3")
    meat = ", ".join(f"SUM(s{i} * s{j})" + "".join(f" + {1 - k / (lags + 1)!r} * COALESCE(SUM(s{i} * l{j}{k} + s{j} * l{i}{k}), 0)" for k in range(1, lags + 1)) + f" AS m{i}{j}" for i, j in pairs)
    b, z = solve3_sql("a", "g"), solve3_sql("m", "g")
    return f"""w1 AS (SELECT date, x - AVG(x) OVER () AS x, {', '.join(f'{c} - AVG({c}) OVER () AS {c}' for c in cols)} FROM w0), w2 AS (SELECT date, {', '.join(f'{c} - SUM({c} * x) OVER () / SUM(x * x) OVER () * x AS {c}' for c in cols)} FROM w1),
wa AS (SELECT COUNT(*) AS n, {', '.join(f'SUM(d{i} * d{j}) AS a{i}{j}' for i, j in pairs)}, {', '.join(f'SUM(d{i} * y) AS g{i}' for i in (1, 2, 3))} FROM w2), wb AS (SELECT {', '.join(f'{e} AS b{i}' for i, e in enumerate(b, 1))} FROM wa),
w3 AS (SELECT date, {', '.join(f'd{i} * (y - b1 * d1 - b2 * d2 - b3 * d3) AS s{i}' for i in (1, 2, 3))} FROM w2, wb), w4 AS (SELECT *, {', '.join(f'LAG(s{i}, {k}) OVER (ORDER BY date) AS l{i}{k}' for i in (1, 2, 3) for k in range(1, lags + 1))} FROM w3),
wm AS (SELECT {meat} FROM w4), ws AS (SELECT n, (g1 * ({z[0]}) + g2 * ({z[1]}) + g3 * ({z[2]})) * (n - 5) / n AS s FROM wa, wm)"""


def lit_sql(i: int, lit: float) -> str:
    """Rolling counts rl<i> of the dense panel for one lit threshold."""
    return f"rl{i} AS (SELECT entity, date, CASE WHEN COUNT(*) OVER w = 10 THEN SUM(COALESCE(CAST(p >= {lit} AS INTEGER), 0)) OVER w END AS n_lit, CASE WHEN COUNT(*) OVER w = 10 THEN SUM(CAST(p IS NOT NULL AS INTEGER)) OVER w END AS n_obs FROM dense WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))"


def boxes(v):
    """Four quarters of a square as rows of edges."""
    rows = []
    for name, x, y in EDGES:
        p = [(x, y), (x + 0.5, y), (x + 0.5, y + 0.5), (x, y + 0.5)]
        rows += [(name, *p[k], *p[(k + 1) % 4]) for k in range(4)]
    return v("v_points").sparkSession.createDataFrame(rows, "area string, x1 double, y1 double, x2 double, y2 double")


BOX = "CASE WHEN x >= -0.5 AND x < 0.5 AND y >= -0.5 AND y < 0.5 THEN 'q' || CASE WHEN x < 0 THEN '0' ELSE '1' END || CASE WHEN y < 0 THEN '0' ELSE '1' END END"


def catalog():
    c = {}
    ve = ["v_panel", "v_entities"]
    c["cal1_threshold_sweep"] = (ve, sweep, f", {YR}, {SWEEP} SELECT R(threshold) AS threshold, N(n) AS n, R(share) AS share, R(ABS(share - 0.6)) AS abs_error FROM sw")
    c["cal2_best"] = (ve, lambda v: C.electrified_best(years(v), sweep(v)).select("entity", "electrified_best"), f", {YR}, {SWEEP}, {BT} SELECT entity, I(p_year >= threshold) AS electrified_best FROM ye, bt")
    c["cal3_keep_list"] = (ve, lambda v: C.keep_list(C.electrified_best(years(v), sweep(v)), ["entity", "population", "area"]), f", {YR}, {SWEEP}, {BT} SELECT entity, R(population) AS population, area FROM ye, bt WHERE p_year >= threshold")
    c["cal4_year_targets"] = (["v_exposure"], lambda v: C.year_targets(v("v_exposure").select(F.year("date").alias("year")).distinct(), v("v_exposure").select(F.year("date").alias("year")).distinct().where("year % 2 = 0").withColumn("target", F.col("year") / 2500), v("v_exposure").select(F.year("date").alias("year")).distinct().where("year % 3 = 0").withColumn("target", F.lit(0.9))), ", y AS (SELECT DISTINCT YEAR(date) AS year FROM v_exposure) SELECT I(year) AS year, R(CASE WHEN year % 3 = 0 THEN 0.9 WHEN year % 2 = 0 THEN year / 2500 END) AS target, CASE WHEN year % 3 = 0 THEN 'override' WHEN year % 2 = 0 THEN 'table' ELSE 'missing' END AS provenance FROM y")
    combos = [(o, lit) for o in (3, 4, 5) for lit in (2, 3, 4, 5)]
    ck = ", ".join(f"({o}, {lit})" for o, lit in combos if lit <= o)
    ds = f", {STATES}, k(o, l) AS (VALUES {ck}), d AS (SELECT o, l, s.entity, MIN(date) FILTER (WHERE n_obs >= o AND n_lit >= l) AS doe FROM states s, k GROUP BY 1, 2, 3)"
    c["cal5_doe_sweep"] = (["v_panel"], lambda v: C.doe_sweep(states(v), combos), f"{ds} SELECT I(o) AS least_obs, I(l) AS least_lit, N(COUNT(doe)) AS n_entities, MIN(doe) AS first_doe, MAX(doe) AS last_doe, R(COUNT(doe) / COUNT(*)) AS share FROM d GROUP BY 1, 2")
    c["cal6_doe_population"] = (ve, lambda v: C.doe_sweep(states(v), combos, v("v_entities")).select("least_obs", "least_lit", "share", F.abs(F.col("share") - 0.9).alias("abs_error")), f"{ds} SELECT I(o) AS least_obs, I(l) AS least_lit, R(COALESCE(SUM(population) FILTER (WHERE doe IS NOT NULL), 0) / SUM(population)) AS share, R(ABS(COALESCE(SUM(population) FILTER (WHERE doe IS NOT NULL), 0) / SUM(population) - 0.9)) AS abs_error FROM d JOIN v_entities e ON e.entity = d.entity GROUP BY 1, 2")
    c["cal7_doe_scenarios"] = (ve, lambda v: C.doe_variants(triggers(v), {"all": F.col("doe"), "late": F.when(F.col("doe") > "1995-02-01", F.col("doe"))}, v("v_entities")), f", {STATES}, u AS (SELECT DISTINCT 'all' AS scenario, entity, doe FROM states UNION SELECT 'late', entity, CASE WHEN doe > DATE '1995-02-01' THEN doe END FROM states) SELECT scenario, area, N(COUNT(*)) AS n, N(COUNT(doe)) AS n_doe, R(SUM(population)) AS population, R(SUM(population) FILTER (WHERE doe IS NOT NULL)) AS doe_population FROM u JOIN v_entities e ON e.entity = u.entity GROUP BY 1, 2")
    taus, deltas = [0.55, 0.56, 0.57], [-0.02, -0.01, 0.0, 0.01, 0.02]
    tgt = lambda v: v("v_entities").groupBy("area").agg(F.sum("population").alias("population")).select("area", F.lit(0.6).alias("target"), F.lit(1.0).alias("weight"), "population")
    AD = f"{YR}, a0 AS (SELECT tau, delta, area, COALESCE(SUM(population) FILTER (WHERE p_year >= ROUND(tau + delta, 10)), 0) / SUM(population) AS share FROM ye, (SELECT UNNEST({taus}) AS tau) t, (SELECT UNNEST({deltas}) AS delta) d GROUP BY 1, 2, 3), a1 AS (SELECT *, POWER(share - 0.6, 2) + 0.5 * delta * delta AS loss FROM a0), ad AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tau, area ORDER BY ROUND(loss, 12), ABS(delta), delta) AS r FROM a1) z WHERE r = 1)"
    c["cal8_area_deltas"] = (ve, lambda v: C.area_deltas(years(v), tgt(v).drop("population"), taus, deltas, 0.5), f", {AD} SELECT R(tau) AS tau, area, R(delta) AS delta, R(share) AS share, R(loss) AS loss FROM ad")
    c["cal8_best_tau"] = (ve, lambda v: C.best_tau(C.area_deltas(years(v), tgt(v).drop("population"), taus, deltas, 0.5), tgt(v).select("area", "population"), 0.6, 10.0), f", {AD}, b AS (SELECT tau, SUM(loss) AS al, SUM(share * w) / SUM(w) AS nat FROM ad JOIN (SELECT area AS a, SUM(population) AS w FROM v_entities GROUP BY 1) q ON q.a = ad.area GROUP BY 1) SELECT R(tau) AS tau, R(al) AS area_loss, R(nat) AS national, R(al + 10 * POWER(nat - 0.6, 2)) AS loss FROM b ORDER BY al + 10 * POWER(nat - 0.6, 2), b.tau LIMIT 1")
    c["cal9_compare_keeps"] = (ve, lambda v: C.compare_keeps(years(v).withColumn("electrified_best", above("p_year", 0.56)), years(v).withColumn("p_year", F.col("c_year")).withColumn("electrified_best", above("p_year", 0.55)), v("v_entities").select("entity", "area")).groupBy("area", "status").agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff")), f", {YR} SELECT area, CASE WHEN p_year > 0.56 AND c_year > 0.55 THEN 'both' WHEN p_year > 0.56 THEN 'a_only' WHEN c_year > 0.55 THEN 'b_only' ELSE 'neither' END AS status, N(COUNT(*)) AS n, R(AVG(p_year - c_year)) AS mean_diff FROM ye GROUP BY 1, 2")
    vx = ["v_panel", "v_exposure"]
    c["reg1_ols"] = (PEX, lambda v: row(G.ols(national(v), "strict_dark", "shed_share")), f", {PX}, {NA}, {fit_sql('na', 'strict_dark', 'shed_share')} SELECT {FIT} FROM fs")
    c["reg1_ols_by_entity"] = (vx, lambda v: row(G.ols(exposed(v), "p", "x", ["entity"])), f", {PD}, {fit_sql('pd', 'p', 'x', 'entity')} SELECT entity, {FIT} FROM fs")
    dow = lambda v: G.multiple(national(v).withColumn("dow", F.dayofweek("date")), "strict_dark", ["shed_share"], {"dow": [1, 2, 3, 4, 5, 6, 7]}).where("term = 'shed_share'")
    c["reg2_multiple"] = (PEX, lambda v: dow(v).select("n", F.col("estimate").alias("slope")), f", {PX}, {NA}, q AS (SELECT strict_dark - AVG(strict_dark) OVER w AS dy, shed_share - AVG(shed_share) OVER w AS dx FROM na WHERE strict_dark IS NOT NULL AND shed_share IS NOT NULL WINDOW w AS (PARTITION BY DAYOFWEEK(date))) SELECT N(COUNT(*)) AS n, R(SUM(dx * dy) / SUM(dx * dx)) AS slope FROM q")
    POISSON = "it(i, a, b) AS (SELECT 0, LN(AVG(y)), 0.0::DOUBLE FROM pn WHERE x IS NOT NULL UNION ALL SELECT i + 1, (wxx * wz - wx * wxz) / (w * wxx - wx * wx), (w * wxz - wx * wz) / (w * wxx - wx * wx) FROM (SELECT i, SUM(EXP(a + b * x)) AS w, SUM(EXP(a + b * x) * x) AS wx, SUM(EXP(a + b * x) * x * x) AS wxx, SUM(EXP(a + b * x) * (a + b * x) + y - EXP(a + b * x)) AS wz, SUM(x * (EXP(a + b * x) * (a + b * x) + y - EXP(a + b * x))) AS wxz FROM it, pn WHERE x IS NOT NULL AND i < 25 GROUP BY i) z), ps AS (SELECT a, b, COUNT(*) AS n, SUM(EXP(a + b * x)) AS w, SUM(EXP(a + b * x) * x) AS wx, SUM(EXP(a + b * x) * x * x) AS wxx, SUM(POWER(y - EXP(a + b * x), 2) / EXP(a + b * x)) AS chi FROM pn, (SELECT a, b FROM it WHERE i = 25) f WHERE x IS NOT NULL GROUP BY 1, 2)"
    c["reg3_quasi_poisson"] = (PEX, lambda v: G.quasi_poisson(N.event_table(pe(v), [1000.0]).join(shed(v), "date"), "n_dark", "shed_share").drop("rounds"), f"RECURSIVE, {PX}, pn AS (SELECT COUNT(*) FILTER (WHERE p < 0.05)::DOUBLE AS y, ANY_VALUE(mlr / contracted) AS x FROM pe JOIN v_exposure e ON e.date = pe.date WHERE population >= 1000 GROUP BY pe.date), {POISSON} SELECT N(n) AS n, R(a) AS intercept, R(b) AS slope, R(SQRT(w / (w * wxx - wx * wx) * chi / (n - 2))) AS se, R(chi / (n - 2)) AS dispersion FROM ps")
    c["reg4_newey_west"] = (PEX, lambda v: G.newey_west(national(v), "strict_dark", "shed_share", "date", 7).select("n", "slope", "se_hac"), f", {PX}, {NA}, {nw_sql('na', 'strict_dark', 'shed_share', 7, '')} SELECT N(n) AS n, R(slope) AS slope, R(se_hac) AS se_hac FROM nw")
    c["reg5_fixed_effects"] = (PEX, lambda v: G.fixed_effects(exposed(v).join(v("v_entities").select("entity", "population"), "entity"), "p", "x", "entity", "date", "population").drop("t", "df"), f", {PD}, {FE.format(w='population')} SELECT {FEC} FROM f1, f3")
    c["reg6_fe_grid"] = (PEX, lambda v: G.fe_grid(exposed(v).join(v("v_entities").select("entity", "demand"), "entity"), ["p"], "x", [None, "demand"], "entity", "date").select("outcome", "weight", "n", "slope"), f", {PD}" + "".join(f", {FE.format(w=w).replace('f0', a + '0').replace('f1', a + '1').split(', f2')[0]}" for a, w in (("g", "1.0"), ("h", "demand"))) + " SELECT 'p' AS outcome, 'none' AS weight, N(n) AS n, R(sxy / sxx) AS slope FROM g1 UNION ALL SELECT 'p', 'demand', N(n), R(sxy / sxx) FROM h1")
    c["reg8_entity_slopes"] = (vx, lambda v: inferred(G.entity_slopes(exposed(v), "p", "x", 7, 60), se="se_hac").select("entity", "n", "slope", "se_hac", "p_value"), f", {PD}, {nw_sql('pd', 'p', 'x', 7, 'entity')} SELECT entity, N(n) AS n, R(slope) AS slope, R(se_hac) AS se_hac, R({p_sql('(slope / NULLIF(se_hac, 0))', '(n - 2)')}) AS p_value FROM nw WHERE n >= 60")
    slopes = lambda v: inferred(G.ols(exposed(v), "p", "x", ["entity"])).join(v("v_entities").select("entity", "demand", "population"), "entity")
    SL = f"{PD}, {fit_sql('pd', 'p', 'x', 'entity')}, sl AS (SELECT fs.entity, sxy / sxx AS slope, sxy / sxx / SQRT(GREATEST(0, syy - sxy * sxy / sxx) / (n - 2) / sxx) AS t, n - 2 AS df, demand, population, region FROM fs JOIN v_entities e ON e.entity = fs.entity)"
    c["reg9_slope_summary"] = (PEX, lambda v: G.slope_summary(slopes(v), "demand"), f", {SL} SELECT N(COUNT(*)) AS n, R(SUM(slope * demand) FILTER (WHERE demand > 0) / SUM(demand) FILTER (WHERE demand > 0)) AS weighted_mean, R(AVG(slope)) AS mean, R(QUANTILE_CONT(slope, 0.25)) AS p25, R(QUANTILE_CONT(slope, 0.5)) AS p50, R(QUANTILE_CONT(slope, 0.75)) AS p75, R(AVG(CAST(slope > 0 AS INTEGER))) AS share_positive, R(AVG(CAST({p_sql('t', 'df')} < 0.05 AS INTEGER))) AS share_significant FROM sl")
    WQ = "wq AS (SELECT slope, c, LAG(c) OVER o AS pc, LAG(slope) OVER o AS px FROM (SELECT slope, demand, SUM(demand) OVER (ORDER BY slope, demand ROWS UNBOUNDED PRECEDING) / SUM(demand) OVER () AS c FROM sl WHERE demand > 0) z WINDOW o AS (ORDER BY slope, demand)), k AS (SELECT UNNEST([0.1, 0.25, 0.5, 0.9]) AS prob)"
    c["reg10_weighted_quantiles"] = (PEX, lambda v: G.weighted_quantiles(slopes(v), "slope", "demand", [0.1, 0.25, 0.5, 0.9]), f", {SL}, {WQ} SELECT R(prob) AS prob, R(CASE WHEN pc IS NULL THEN slope ELSE px + (slope - px) * (prob - pc) / (c - pc) END) AS value FROM wq, k WHERE c >= prob AND (pc IS NULL OR pc < prob)")
    ladder = lambda v: G.ols(exposed(v).select("entity", "p", "x", "coverage", N.grid([0.3, 0.5, 0.8], "least")).where("coverage >= least"), "p", "x", ["least"])
    c["reg11_ladder"] = (vx, lambda v: row(ladder(v)), f", {PD}, lp AS (SELECT pd.*, least FROM pd, (SELECT UNNEST([0.3, 0.5, 0.8]) AS least) k WHERE coverage >= least), {fit_sql('lp', 'p', 'x', 'least')} SELECT R(least) AS least, {FIT} FROM fs")
    c["reg12_correlations"] = (PEX, lambda v: G.correlations(nine(national(v), "strict_dark", "shed_share"), "shed_share", "strict_dark"), f", {PX}, {NA}, {RANKS} SELECT N(COUNT(*)) AS n, R(CORR(shed_share, strict_dark)) AS pearson, R(CORR(rx, ry)) AS spearman FROM rk")
    c["reg13_auc"] = (PEX, lambda v: G.auc(with_exposure(v), "strict_dark", "any_shed"), f", {PX}, {NA}, {RANKS} SELECT N(COUNT(*)) AS n, N(COUNT(*) FILTER (WHERE mlr > 0)) AS n_positive, R((SUM(ry) FILTER (WHERE mlr > 0) - COUNT(*) FILTER (WHERE mlr > 0) * (COUNT(*) FILTER (WHERE mlr > 0) + 1) / 2.0) / (COUNT(*) FILTER (WHERE mlr > 0) * COUNT(*) FILTER (WHERE mlr <= 0))) AS auc FROM rk")
    c["reg14_contrast"] = (PEX, lambda v: row(G.contrast(S.outer_quarters(national(v), "shed_share", "date"), "strict_dark", "side")), f", {PX}, {NA}, o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY shed_share, date) AS l, ROW_NUMBER() OVER (ORDER BY shed_share DESC, date) AS h, FLOOR(COUNT(*) OVER () * 0.25) AS q FROM na WHERE shed_share IS NOT NULL), oo AS (SELECT strict_dark, CAST(l > q AS INTEGER) AS hi FROM o WHERE l <= q OR h <= q), {fit_sql('oo', 'strict_dark', 'hi')} SELECT {FIT} FROM fs")
    LL = "ll AS (SELECT na.date, strict_dark, k.predictor, x.mlr / x.contracted AS x FROM na JOIN (SELECT * FROM (VALUES ('lag1', -1), ('same', 0), ('lead1', 1)) t(predictor, o)) k ON TRUE LEFT JOIN v_exposure x ON x.date = na.date + CAST(o AS INTEGER))"

    def placebo(v):
        wide = national(v).select("date", "strict_dark")
        for name, o in (("lag1", -1), ("same", 0), ("lead1", 1)):
            wide = wide.join(shed(v).select(F.date_sub("date", o).alias("date"), F.col("shed_share").alias(name)), "date", "left")
        return row(G.per_predictor(wide, "strict_dark", ["lag1", "same", "lead1"]))

    c["reg15_placebo"] = (PEX, placebo, f", {PX}, {NA}, {LL}, {fit_sql('ll', 'strict_dark', 'x', 'predictor')} SELECT predictor, {FIT} FROM fs")
    c["reg16_wald"] = (PEX, lambda v: G.wald_hac(G.with_dummies(national(v).withColumn("q", F.quarter("date")), "q", [1, 2, 3, 4])[0], "strict_dark", ["shed_share", "q_2", "q_3", "q_4"], ["q_2", "q_3", "q_4"], "date", 7).drop("n"), f", {PX}, {NA}, w0 AS (SELECT date, strict_dark AS y, shed_share AS x, CAST(QUARTER(date) = 2 AS DOUBLE) AS d1, CAST(QUARTER(date) = 3 AS DOUBLE) AS d2, CAST(QUARTER(date) = 4 AS DOUBLE) AS d3 FROM na WHERE strict_dark IS NOT NULL AND shed_share IS NOT NULL), {wald_sql(7)} SELECT R(s) AS statistic, N(3) AS df, R(1 - SQRT(2 / PI()) * SQRT(s) / 1200 * LIST_SUM(LIST_TRANSFORM(RANGE(0, 401), lambda i: (CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * POWER(i * SQRT(s) / 400, 2) * EXP(-POWER(i * SQRT(s) / 400, 2) / 2)))) AS p_value FROM ws")
    c["reg17_effects"] = (PEX, lambda v: G.effects(G.ols(national(v), "strict_dark", "shed_share"), mean_mw=5e5, hours=2.0).select("n", "pp", "pp_low", "pp_high", "pp_per_1000_mw", "pp_per_gwh"), f", {PX}, {NA}, {fit_sql('na', 'strict_dark', 'shed_share')}, b AS (SELECT n, sxy / sxx AS b, SQRT(GREATEST(0, syy - sxy * sxy / sxx) / (n - 2) / sxx) AS s FROM fs) SELECT N(n) AS n, R(10 * b) AS pp, R(10 * (b - 1.96 * s)) AS pp_low, R(10 * (b + 1.96 * s)) AS pp_high, R(100 * b * 1000 / 500000) AS pp_per_1000_mw, R(100 * b * 1000 / (500000 * 2.0)) AS pp_per_gwh FROM b")
    c["reg18_mean_interval"] = (PEX, lambda v: inferred(G.mean_interval(S.quantile_groups(national(v), "shed_share", "date", 4), "strict_dark", ["bin"]), "mean"), f", {PX}, {NA}, b AS (SELECT strict_dark, NTILE(4) OVER (ORDER BY shed_share, date) AS bin FROM na WHERE shed_share IS NOT NULL) SELECT I(bin) AS bin, N(COUNT(strict_dark)) AS n, R(AVG(strict_dark)) AS mean, R(STDDEV_SAMP(strict_dark) / SQRT(COUNT(strict_dark))) AS se, N(COUNT(strict_dark) - 1) AS df, {interval_sql('AVG(strict_dark)', '(STDDEV_SAMP(strict_dark) / SQRT(COUNT(strict_dark)))', '(COUNT(strict_dark) - 1)')} FROM b GROUP BY 1")
    prod = lambda v: N.daily_base(pe(v)).select("date", "strict_dark").withColumn("product", F.lit("a")).unionByName(N.daily_base(pe(v).where("coverage >= 0.5")).select("date", "strict_dark").withColumn("product", F.lit("b"))).join(shed(v), "date")
    c["reg19_products"] = (PEX, lambda v: row(G.ols(prod(v), "strict_dark", "shed_share", ["product"])), f", {PX}, {NA}, {NA.replace('na AS', 'nb AS', 1).replace('FROM pe', 'FROM pe WHERE coverage >= 0.5')}, pr AS (SELECT 'a' AS product, strict_dark, shed_share FROM na UNION ALL SELECT 'b', strict_dark, shed_share FROM nb), {fit_sql('pr', 'strict_dark', 'shed_share', 'product')} SELECT product, {FIT} FROM fs")
    flags = lambda v: N.tukey_flags(v("v_exposure"), "contracted", [0.0, 1.5], []).select(F.col("k").cast("string").alias("scenario"), "date", (F.col("remove") == 1).alias("remove"))
    REMOVED = "rm AS (SELECT s AS scenario, COUNT(*) FILTER (WHERE contracted > b + k * (b - a)) AS n_removed FROM v_exposure, (SELECT QUANTILE_CONT(contracted, 0.25) AS a, QUANTILE_CONT(contracted, 0.75) AS b FROM v_exposure) q, (SELECT * FROM (VALUES ('0.0', 0.0), ('1.5', 1.5)) t(s, k)) z GROUP BY 1)"
    c["reg20_scenarios"] = (PEX, lambda v: row(G.scenario_fits(national(v), flags(v), "strict_dark", "shed_share")), f", {PX}, {NA}, q AS (SELECT QUANTILE_CONT(contracted, 0.25) AS a, QUANTILE_CONT(contracted, 0.75) AS b FROM v_exposure), sf AS (SELECT s AS scenario, strict_dark, shed_share FROM na, q, (SELECT * FROM (VALUES ('0.0', 0.0), ('1.5', 1.5)) t(s, k)) z WHERE contracted <= b + k * (b - a)), {fit_sql('sf', 'strict_dark', 'shed_share', 'scenario')}, {REMOVED} SELECT fs.scenario, N(n_removed) AS n_removed, {FIT} FROM fs JOIN rm ON rm.scenario = fs.scenario")
    c["reg20_fe_scenarios"] = (PEX, lambda v: G.with_counts(G.fixed_effects(G.kept_rows(exposed(v), flags(v)), "p", "x", "entity", "date", by=["scenario"]).drop("t", "df"), flags(v)), f", {PD}, q AS (SELECT QUANTILE_CONT(contracted, 0.25) AS a, QUANTILE_CONT(contracted, 0.75) AS b FROM v_exposure), {REMOVED}, kp AS (SELECT s AS scenario, pd.* FROM pd JOIN v_exposure e ON e.date = pd.date, q, (SELECT * FROM (VALUES ('0.0', 0.0), ('1.5', 1.5)) t(s, k)) z WHERE contracted <= b + k * (b - a)), {fe_by_sql('kp', 'scenario')} SELECT f1.scenario, N(n_removed) AS n_removed, {FEC} FROM f1 JOIN f3 ON f3.scenario = f1.scenario JOIN rm ON rm.scenario = f1.scenario")
    AUC = "R((SUM(ry) FILTER (WHERE shed_share > 0) - COUNT(*) FILTER (WHERE shed_share > 0) * (COUNT(*) FILTER (WHERE shed_share > 0) + 1) / 2.0) / (COUNT(*) FILTER (WHERE shed_share > 0) * COUNT(*) FILTER (WHERE shed_share <= 0)))"
    c["reg21_fit_metrics"] = (PEX, lambda v: G.fit_metrics(nine(national(v), "strict_dark", "shed_share"), "strict_dark", "shed_share").select("n", "slope", "adj_r2", "rmse", "mae", "range_y", "range_x", "pearson", "spearman", "auc"), f", {PX}, {NA}, {RANKS}, {fit_sql('na', 'strict_dark', 'shed_share')} SELECT {AUC} AS auc, N(ANY_VALUE(n)) AS n, R(ANY_VALUE(sxy / sxx)) AS slope, R(ANY_VALUE(1 - (1 - sxy * sxy / sxx / syy) * (n - 1) / (n - 2))) AS adj_r2, R(SQRT(AVG(POWER(strict_dark - my - sxy / sxx * (shed_share - mx), 2)))) AS rmse, R(AVG(ABS(strict_dark - my - sxy / sxx * (shed_share - mx)))) AS mae, R(MAX(strict_dark) - MIN(strict_dark)) AS range_y, R(MAX(shed_share) - MIN(shed_share)) AS range_x, R(CORR(shed_share, strict_dark)) AS pearson, R(CORR(rx, ry)) AS spearman FROM rk, fs".replace("FROM rk, fs", "FROM (SELECT rk.*, fs.n AS n, sxx, sxy, syy, mx, my FROM (SELECT date, strict_dark, shed_share, rx, ry FROM rk) rk, fs) z"))
    c["reg22_shift_profile"] = (PEX, lambda v: G.shift_profile(national(v), shed(v), "strict_dark", "shed_share", list(range(-30, 31)), 7).select("shift", "n", "slope", "se_hac"), f", {PX}, {NA}, sp AS (SELECT na.date, strict_dark, k AS shift, x.mlr / x.contracted AS x FROM na, (SELECT UNNEST(GENERATE_SERIES(-30, 30)) AS k) z JOIN v_exposure x ON x.date = na.date - CAST(k AS INTEGER)), {nw_sql('sp', 'strict_dark', 'x', 7, 'shift')} SELECT I(shift) AS shift, N(n) AS n, R(slope) AS slope, R(se_hac) AS se_hac FROM nw")
    gates = [0.0, 0.1, 0.12, 0.14, 0.16]
    g6 = lambda v: G.ols(N.above_each(gated(v), gates), "strict_demand", "shed_share", ["gate"])
    G6 = f", {PX}, {ZP}, {OD}, {GD}, gs AS (SELECT gate, strict_demand, z_demand, shed_share FROM gd, (SELECT UNNEST({gates}) AS gate) k WHERE observed_share >= gate)"
    c["gat6_gate_sweep"] = (PEX, lambda v: row(g6(v)), f"{G6}, {fit_sql('gs', 'strict_demand', 'shed_share', 'gate')} SELECT R(gate) AS gate, {FIT} FROM fs")
    c["gat8_gate_variants"] = (PEX, lambda v: row(G.ols(gated(v).withColumn("entity_share", F.col("n_observed") / 100).unpivot(["strict_demand", "shed_share"], ["observed_share", "entity_share"], "variant", "gate").where("gate >= 0.14"), "strict_demand", "shed_share", ["variant"])), f", {PX}, {ZP}, {OD}, {GD}, gv AS (SELECT 'observed_share' AS variant, strict_demand, shed_share FROM gd WHERE observed_share >= 0.14 UNION ALL SELECT 'entity_share', strict_demand, shed_share FROM gd WHERE n_observed / 100 >= 0.14), {fit_sql('gv', 'strict_demand', 'shed_share', 'variant')} SELECT variant, {FIT} FROM fs")
    c["reg23_gate_slopes"] = (PEX, lambda v: G.ols(N.above_each(gated(v), gates), "z_demand", "shed_share", ["gate"]).select("gate", "n", "slope"), f"{G6}, {fit_sql('gs', 'z_demand', 'shed_share', 'gate')} SELECT R(gate) AS gate, N(n) AS n, R(CASE WHEN n >= 6 AND sxx > 1e-14 THEN sxy / sxx END) AS slope FROM fs")
    c["reg24_threshold_slopes"] = (vx, lambda v: inferred(G.threshold_slopes(exposed(v), "x", [0.05, 0.5, 0.95], 60)).select("entity", "cut", "n", "slope", "p_value"), f", {PD}, q AS (SELECT entity, t AS cut, CAST(p < t AS INTEGER) AS y, x FROM pd, (SELECT UNNEST([0.05, 0.5, 0.95]) AS t) k) SELECT entity, R(cut) AS cut, N(COUNT(*)) AS n, R(CASE WHEN STDDEV_POP(y) <= 1e-12 THEN 0 ELSE REGR_SLOPE(y, x) END) AS slope, R({p_sql('(CASE WHEN STDDEV_POP(y) > 1e-12 THEN REGR_SLOPE(y, x) / NULLIF(SQRT(GREATEST(0, REGR_SYY(y, x) - REGR_SXY(y, x) * REGR_SLOPE(y, x)) / (COUNT(*) - 2) / REGR_SXX(y, x)), 0) END)', '(COUNT(*) - 2)')}) AS p_value FROM q GROUP BY 1, 2 HAVING COUNT(*) >= 60")
    c["reg25_step_quantiles"] = (PEX, lambda v: G.weighted_quantiles(slopes(v), "slope", "demand", [0.1, 0.25, 0.5, 0.9], step=True), f", {SL}, {WQ} SELECT R(prob) AS prob, R(MIN(slope)) AS value FROM wq, k WHERE c >= prob - 1e-12 GROUP BY 1")
    nat = lambda v: national(v).select("date", "strict_dark", "shed_share")
    c["res1_bootstrap"] = (PEX, lambda v: Z.bootstrap_summary(Z.block_bootstrap(nat(v), "strict_dark", "shed_share", "date", 2000, 14)), f", {PX}, {NA}, nn AS (SELECT ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, strict_dark AS y, shed_share AS x FROM na WHERE strict_dark IS NOT NULL AND shed_share IS NOT NULL), z AS (SELECT COUNT(*) AS n FROM nn), dr AS (SELECT d, ((CAST('0x' || SUBSTR(MD5(d || ',' || b || ',17'), 1, 8) AS BIGINT)) % n + o) % n AS i FROM z, (SELECT UNNEST(GENERATE_SERIES(0, 1999)) AS d) q, (SELECT UNNEST(GENERATE_SERIES(0, 1000)) AS b) r, (SELECT UNNEST(GENERATE_SERIES(0, 13)) AS o) s WHERE b * 14 + o < n), sl AS (SELECT d, REGR_SLOPE(y, x) AS slope FROM dr JOIN nn ON nn.i = dr.i GROUP BY 1) SELECT N(COUNT(*)) AS n, R(AVG(slope)) AS mean, R(STDDEV_SAMP(slope)) AS se, R(QUANTILE_CONT(slope, 0.025)) AS low, R(QUANTILE_CONT(slope, 0.975)) AS high, R(LEAST(1, 2 * (1 + LEAST(COUNT(*) FILTER (WHERE slope <= 0), COUNT(*) FILTER (WHERE slope >= 0))) / (COUNT(*) + 1.0))) AS p_value FROM sl")
    c["res2_permutation"] = (PEX, lambda v: Z.placebo_summary(nat(v), "strict_dark", "shed_share", Z.block_permutation(nat(v), "strict_dark", "shed_share", "date")), f", {PX}, {NA}, nn AS (SELECT ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, strict_dark AS y, shed_share AS x FROM na WHERE strict_dark IS NOT NULL AND shed_share IS NOT NULL), bl AS (SELECT DISTINCT i // 14 AS b FROM nn), pl AS (SELECT d, b, ROW_NUMBER() OVER (PARTITION BY d ORDER BY CAST('0x' || SUBSTR(MD5(d || ',' || b || ',5'), 1, 8) AS BIGINT), b) AS r FROM bl, (SELECT UNNEST(GENERATE_SERIES(0, 1999)) AS d) q), mv AS (SELECT d, x, ROW_NUMBER() OVER (PARTITION BY d ORDER BY r, i) - 1 AS i FROM pl JOIN nn ON nn.i // 14 = pl.b), sl AS (SELECT d, REGR_SLOPE(nn.y, mv.x) AS slope FROM mv JOIN nn ON nn.i = mv.i GROUP BY 1), ac AS (SELECT REGR_SLOPE(y, x) AS actual FROM nn) SELECT N(COUNT(*)) AS n, R(MAX(actual)) AS actual, R(AVG(slope)) AS mean, R(STDDEV_SAMP(slope)) AS sd, R(QUANTILE_CONT(slope, 0.025)) AS low, R(QUANTILE_CONT(slope, 0.975)) AS high, R((1 + COUNT(*) FILTER (WHERE ABS(slope) >= ABS(actual))) / (COUNT(*) + 1.0)) AS p_value FROM sl, ac")
    c["res3_circular_shifts"] = (PEX, lambda v: Z.circular_shifts(nat(v), "strict_dark", "shed_share", "date"), f", {PX}, {NA}, nn AS (SELECT ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, strict_dark AS y, shed_share AS x FROM na WHERE strict_dark IS NOT NULL AND shed_share IS NOT NULL), z AS (SELECT COUNT(*) AS n FROM nn) SELECT I(s) AS shift, R(REGR_SLOPE(a.y, b.x)) AS slope FROM nn a, z, (SELECT UNNEST(GENERATE_SERIES(1, (SELECT n - 1 FROM z))) AS s) k JOIN nn b ON b.i = (a.i + s) % n GROUP BY 1")
    hac = "N(n) AS n, R(slope) AS slope, R(se_hac) AS se_hac, {p} AS p_value FROM nw"
    c["res5_first_difference"] = (PEX, lambda v: inferred(Z.first_difference(nat(v), "strict_dark", "shed_share"), se="se_hac").select("n", "slope", "se_hac", "p_value"), f", {PX}, {NA}, dd AS (SELECT a.date, a.strict_dark - b.strict_dark AS y, a.shed_share - b.shed_share AS x FROM na a JOIN na b ON b.date = a.date - 1), {nw_sql('dd', 'y', 'x', 7, '')} SELECT {hac.format(p='R(' + p_sql('(slope / NULLIF(se_hac, 0))', '(n - 2)') + ')')}")
    LAGGED = "q0 AS (SELECT a.date, a.strict_dark AS y, a.shed_share AS x, b.strict_dark AS l FROM na a JOIN na b ON b.date = a.date - 1 WHERE a.strict_dark IS NOT NULL AND b.strict_dark IS NOT NULL AND a.shed_share IS NOT NULL), q1 AS (SELECT date, y - AVG(y) OVER () AS y, x - AVG(x) OVER () AS x, l - AVG(l) OVER () AS l FROM q0), q2 AS (SELECT date, y - SUM(y * l) OVER () / SUM(l * l) OVER () * l AS y, x - SUM(x * l) OVER () / SUM(l * l) OVER () * l AS x FROM q1)"
    c["res5_lagged_outcome"] = (PEX, lambda v: inferred(Z.lagged_outcome(nat(v), "strict_dark", "shed_share"), se="se_hac").select("n", "slope", "se_hac", "p_value"), f", {PX}, {NA}, {LAGGED}, {nw_sql('q2', 'y', 'x', 7, '', 3)} SELECT {hac.format(p='R(' + p_sql('(slope / NULLIF(se_hac, 0))', '(n - 3)') + ')')}")
    MONTHS, DAYS = list(range(1, 13)), list(range(1, 8))
    dated = lambda v: exposed(v).withColumns({"month": F.month("date"), "dow": F.dayofweek("date"), "strict": (F.col("p") < 0.05).cast("double"), "mostly": (F.col("p") < 0.2).cast("double")}).join(v("v_entities").select("entity", "demand"), "entity")
    controls = {"none": {}, "month": {"month": MONTHS}, "dow": {"dow": DAYS}, "month_dow": {"month": MONTHS, "dow": DAYS}}
    c["reg6_fe_controls"] = (PEX, lambda v: G.fe_control_grid(dated(v), ["strict", "mostly"], "x", [None, "demand"], controls, "entity", "date").drop("t", "df"), None)

    def blocks(v):
        """By circuit and day: share of interruptions over half an hour, and exposures of the whole day and of its first four hours."""
        early = F.hour("start") < 4
        out = v("v_schedule").withColumn("date", F.to_date("start")).groupBy("circuit", "date").agg(F.avg((F.col("minutes") > 30).cast("int")).alias("share"), F.sum("minutes").alias("day_minutes"), F.sum(F.when(early, F.col("minutes")).otherwise(0.0)).alias("early_minutes"))
        return out.withColumns({"any_early": (F.col("early_minutes") > 0).cast("double"), "any_long": (F.col("day_minutes") > 60).cast("double"), "month": F.month("date"), "dow": F.dayofweek("date")})

    def schedule_grid(v, names=None):
        rows = blocks(v)
        circuits = [r.circuit for r in rows.select("circuit").distinct().orderBy("circuit").collect()]  # a handful of circuits
        one, mo, dw = {"circuit": circuits}, {"month": MONTHS}, {"dow": DAYS}
        specs = {"none": (None, {}), "block": (None, one), "date": ("date", {}), "month": (None, mo), "dow": (None, dw), "block_month": (None, one | mo), "block_dow": (None, one | dw), "month_dow": (None, mo | dw), "block_month_dow": (None, one | mo | dw), "block_date": ("date", one)}
        return inferred(G.factor_grid(rows, "share", ["any_early", "early_minutes", "any_long", "day_minutes"], {k: s for k, s in specs.items() if names is None or k in names})).drop("t")

    c["reg7_factor_grid"] = (["v_schedule"], schedule_grid, None)
    BK = "bk AS (SELECT circuit, CAST(start AS DATE) AS date, AVG(CAST(minutes > 30 AS INTEGER)) AS share, SUM(minutes) AS day_minutes, SUM(CASE WHEN HOUR(start) < 4 THEN minutes ELSE 0 END) AS early_minutes FROM v_schedule GROUP BY 1, 2), bw AS (SELECT *, CAST(early_minutes > 0 AS DOUBLE) AS any_early, CAST(day_minutes > 60 AS DOUBLE) AS any_long FROM bk), bx AS (UNPIVOT bw ON any_early, early_minutes, any_long, day_minutes INTO NAME exposure VALUE x), gx AS (" + " UNION ALL ".join(f"SELECT '{n}' AS spec, exposure, share - AVG(share) OVER (PARTITION BY exposure, {k}) AS dy, x - AVG(x) OVER (PARTITION BY exposure, {k}) AS dx FROM bx" for n, k in (("none", "1"), ("block", "circuit"), ("date", "date"), ("month", "MONTH(date)"), ("dow", "DAYOFWEEK(date)"))) + ")"
    c["reg7_single_factors"] = (["v_schedule"], lambda v: schedule_grid(v, ("none", "block", "date", "month", "dow")).select("exposure", "spec", "n", "slope"), f", {BK} SELECT exposure, spec, N(COUNT(*)) AS n, R(CASE WHEN SUM(dx * dx) > 1e-9 * COUNT(*) THEN SUM(dx * dy) / SUM(dx * dx) END) AS slope FROM gx GROUP BY 1, 2")
    LP = "lp AS (SELECT pd.*, least FROM pd, (SELECT UNNEST([0.3, 0.5, 0.8]) AS least) k WHERE coverage >= least)"
    climbed = lambda v: exposed(v).select("entity", "date", "p", "x", "coverage", N.grid([0.3, 0.5, 0.8], "least")).where("coverage >= least")
    c["reg11_fe_ladder"] = (vx, lambda v: G.fixed_effects(climbed(v), "p", "x", "entity", "date", by=["least"]).drop("t", "df"), f", {PD}, {LP}, {fe_by_sql('lp', 'least')} SELECT R(f1.least) AS least, {FEC} FROM f1 JOIN f3 ON f3.least = f1.least")
    c["reg11_slope_ladder"] = (PEX, lambda v: G.slope_summary(inferred(G.ols(climbed(v), "p", "x", ["least", "entity"]).where("n >= 60")).join(v("v_entities").select("entity", "demand", F.when(F.col("population") > 3000, "large").otherwise("small").alias("pop_bin")), "entity"), "demand", ["least", "pop_bin"]), f", {PD}, {LP}, {fit_sql('lp', 'p', 'x', 'least, entity')}, sl AS (SELECT least, CASE WHEN population > 3000 THEN 'large' ELSE 'small' END AS pop_bin, sxy / sxx AS slope, sxy / sxx / NULLIF(SQRT(GREATEST(0, syy - sxy * sxy / sxx) / (n - 2) / sxx), 0) AS t, n - 2 AS df, demand FROM fs JOIN v_entities e ON e.entity = fs.entity WHERE n >= 60) SELECT R(least) AS least, pop_bin, N(COUNT(*)) AS n, R(SUM(slope * demand) FILTER (WHERE demand > 0) / SUM(demand) FILTER (WHERE demand > 0)) AS weighted_mean, R(AVG(slope)) AS mean, R(QUANTILE_CONT(slope, 0.25)) AS p25, R(QUANTILE_CONT(slope, 0.5)) AS p50, R(QUANTILE_CONT(slope, 0.75)) AS p75, R(AVG(CAST(slope > 0 AS INTEGER))) AS share_positive, R(AVG(CAST({p_sql('t', 'df')} < 0.05 AS INTEGER))) AS share_significant FROM sl GROUP BY 1, 2")
    seven = lambda v: S.extremes(national(v), "shed_share", "date", 7)

    def tied(v):
        """Sides at the quartiles, all ties included: days without shedding are all `low` where they make a quarter."""
        q = national(v).agg(F.percentile("shed_share", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
        return national(v).crossJoin(F.broadcast(q)).withColumn("side", F.when(F.col("shed_share") <= F.col("_q")[0], "low").when(F.col("shed_share") >= F.col("_q")[1], "high"))

    ends = lambda v: seven(v).select("strict_dark", "side", F.lit("top7").alias("kind")).unionByName(tied(v).select("strict_dark", "side", F.lit("tied").alias("kind"))).where("side is not null")
    ENDS = "o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY shed_share, date) AS l, ROW_NUMBER() OVER (ORDER BY shed_share DESC, date) AS h, QUANTILE_CONT(shed_share, 0.25) OVER () AS a, QUANTILE_CONT(shed_share, 0.75) OVER () AS b FROM na WHERE shed_share IS NOT NULL), oo AS (SELECT 'top7' AS kind, strict_dark, CAST(l > 7 AS INTEGER) AS hi FROM o WHERE l <= 7 OR h <= 7 UNION ALL SELECT 'tied', strict_dark, CAST(shed_share > a AS INTEGER) FROM o WHERE shed_share <= a OR shed_share >= b)"
    c["reg14_end_contrasts"] = (PEX, lambda v: row(G.contrast(ends(v), "strict_dark", "side", ["kind"])).select("kind", "n", "slope", "se"), f", {PX}, {NA}, {ENDS}, {fit_sql('oo', 'strict_dark', 'hi', 'kind')} SELECT kind, N(n) AS n, R({_B}) AS slope, R({_SE}) AS se FROM fs")
    c["reg14_bin_counts"] = (PEX, lambda v: ends(v).groupBy("kind", "side").agg(F.count("*").alias("n")), f", {PX}, {NA}, {ENDS} SELECT kind, CASE WHEN hi = 1 THEN 'high' ELSE 'low' END AS side, N(COUNT(*)) AS n FROM oo GROUP BY 1, 2")
    c["reg19_product_correlation"] = (PEX, lambda v: G.correlations(prod(v).groupBy("date").agg(*[F.max(F.when(F.col("product") == k, F.col("strict_dark"))).alias(k) for k in "ab"]), "a", "b").select("n", "pearson"), f", {PX}, {NA}, {NA.replace('na AS', 'nb AS', 1).replace('FROM pe', 'FROM pe WHERE coverage >= 0.5')} SELECT N(COUNT(*)) AS n, R(CORR(na.strict_dark, nb.strict_dark)) AS pearson FROM na JOIN nb ON nb.date = na.date WHERE na.strict_dark IS NOT NULL AND nb.strict_dark IS NOT NULL")

    def disagreement(v):
        """The national series over entities that both products keep, and over those that only one does."""
        kept = years(v).select("entity", F.when((F.round("p_year", 9) > 0.56) == (F.round("c_year", 9) > 0.55), "agree").otherwise("disagree").alias("group"))
        rows = pe(v).join(kept, "entity")
        parts = [N.daily_base(rows.where(F.col("group") == g)).withColumn("group", F.lit(g)) for g in ("agree", "disagree")]
        return parts[0].unionByName(parts[1]).join(shed(v), "date")

    DIS = "gp AS (SELECT entity, (ROUND(p_year, 9) > 0.56) = (ROUND(c_year, 9) > 0.55) AS ok FROM ye), " + ", ".join(NA.replace("na AS", f"n{k} AS", 1).replace("FROM pe", f"FROM pe WHERE entity IN (SELECT entity FROM gp WHERE {c_})") for k, c_ in (("x", "ok"), ("y", "NOT ok"))) + ", ds AS (SELECT 'agree' AS \"group\", strict_dark, shed_share FROM nx UNION ALL SELECT 'disagree', strict_dark, shed_share FROM ny)"
    c["reg19_disagreement"] = (PEX, lambda v: row(G.ols(disagreement(v), "strict_dark", "shed_share", ["group"])), f", {PX}, {YR}, {DIS}, {fit_sql('ds', 'strict_dark', 'shed_share', chr(34) + 'group' + chr(34))} SELECT \"group\", {FIT} FROM fs")
    GR = "gr AS (SELECT *, RANK() OVER (PARTITION BY gate ORDER BY ROUND(shed_share, 9)) + (COUNT(*) OVER (PARTITION BY gate, ROUND(shed_share, 9)) - 1) / 2.0 AS rx, RANK() OVER (PARTITION BY gate ORDER BY ROUND(strict_demand, 9)) + (COUNT(*) OVER (PARTITION BY gate, ROUND(strict_demand, 9)) - 1) / 2.0 AS ry FROM gs WHERE strict_demand IS NOT NULL AND shed_share IS NOT NULL)"
    many = [round(0.05 * i, 2) for i in range(21)]

    def gate_metrics(v):
        rows = nine(N.above_each(gated(v), many), "strict_demand", "shed_share").withColumn("any_shed", (F.col("shed_share") > 0).cast("int"))
        return G.correlations(rows, "shed_share", "strict_demand", ["gate"]).join(G.auc(rows, "strict_demand", "any_shed", ["gate"]).select("gate", "auc"), "gate", "left")

    c["gat6_gate_metrics"] = (PEX, gate_metrics, f"{G6.replace(str(gates), str(many))}, {GR} SELECT R(gate) AS gate, N(COUNT(*)) AS n, R(CORR(shed_share, strict_demand)) AS pearson, R(CORR(rx, ry)) AS spearman, R(CASE WHEN COUNT(*) FILTER (WHERE shed_share > 0) > 0 AND COUNT(*) FILTER (WHERE shed_share <= 0) > 0 THEN (SUM(ry) FILTER (WHERE shed_share > 0) - COUNT(*) FILTER (WHERE shed_share > 0) * (COUNT(*) FILTER (WHERE shed_share > 0) + 1) / 2.0) / (COUNT(*) FILTER (WHERE shed_share > 0) * COUNT(*) FILTER (WHERE shed_share <= 0)) END) AS auc FROM gr GROUP BY 1")
    lits = (0.3, 0.4, 0.5)

    lit_sweep = lambda v: C.lit_sweep(P.dense(v("v_panel").select("entity", "date", "p")), list(lits), combos, 10)

    c["cal5_lit_thresholds"] = (["v_panel"], lit_sweep, f", {STATES.split(', ld AS')[0]}" + "".join(f", {lit_sql(i, lit)}" for i, lit in enumerate(lits)) + f", k(o, l) AS (VALUES {ck}) " + " UNION ALL ".join(f"SELECT R({lit}) AS lit_at, I(o) AS least_obs, I(l) AS least_lit, N(COUNT(doe)) AS n_entities, MIN(doe) AS first_doe, MAX(doe) AS last_doe, R(COUNT(doe) / COUNT(*)) AS share FROM (SELECT o, l, entity, MIN(date) FILTER (WHERE n_obs >= o AND n_lit >= l) AS doe FROM rl{i}, k GROUP BY 1, 2, 3) z{i} GROUP BY 2, 3" for i, lit in enumerate(lits)))
    pt = ["v_points"]
    c["spa1_assign_area"] = (pt, lambda v: A.assign_area(v("v_points"), boxes(v), 0.1), f"SELECT entity, R(x) AS x, R(y) AS y, {BOX} AS area FROM v_points")
    c["spa2_renamed"] = (pt, lambda v: A.renamed_areas(A.assign_area(v("v_points"), boxes(v), 0.1), {"Q00": "SOUTH WEST"}).select("entity", "area"), f"SELECT entity, CASE WHEN {BOX} = 'q00' THEN 'SOUTH WEST' ELSE UPPER({BOX}) END AS area FROM v_points")
    c["spa3_area_totals"] = (pt, lambda v: A.area_totals(v("v_points").withColumn("w", F.col("entity") % 10 + F.lit(0.5)), boxes(v), 0.1, "w"), f"SELECT {BOX} AS area, N(COUNT(*)) AS n, R(SUM(entity % 10 + 0.5)) AS total FROM v_points GROUP BY 1")
    c["src2_pruned"] = (["v_panel"], lambda v: v("v_panel").select("entity", "p").groupBy("entity").agg(F.max("p").alias("p")), "SELECT entity, R(MAX(p)) AS p FROM v_panel GROUP BY 1")
    c["src3_hourly_text"] = (["v_schedule"], lambda v: io.hourly_exposure(v("v_schedule").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("ts"), "minutes"), "ts").groupBy("date", "hour").agg(F.sum("minutes").alias("m")), "SELECT CAST(start AS DATE) AS date, I(HOUR(start)) AS hour, R(SUM(minutes)) AS m FROM v_schedule GROUP BY 1, 2")
    def hourly_file(v):
        """Interruptions written as CSV with texts for clocks, some of which can't be read, and amounts, some of which are no numbers."""
        raw = v("v_schedule").select(F.when(F.col("event_id") % 97 == 0, F.lit("at noon")).otherwise(F.date_format("start", "yyyy-MM-dd HH:mm")).alias("ts"), F.when(F.col("event_id") % 89 == 0, F.lit("n/a")).otherwise(F.col("minutes").cast("string")).alias("minutes"))
        rows = io.scan_hourly(raw.sparkSession, io.write_table(raw, io.shared_path(raw.sparkSession, "hourly")), "ts", "ts string, minutes double")
        return rows.groupBy("date", "hour").agg(F.sum("minutes").alias("m"), F.count("*").alias("n"), F.count("refused").alias("n_refused"))

    def entity_file(v):
        """Settlements written as CSV with WKT points and quoted names, one in nine without a point."""
        point = F.concat(F.lit("POINT ("), (F.col("demand") / 1000).cast("string"), F.lit(" "), (F.col("entity") / 8).cast("string"), F.lit(")"))
        raw = v("v_entities").select(F.col("entity").alias("code"), F.concat("area", F.lit(', "'), "region", F.lit('"')).alias("name"), F.when(F.col("entity") % 9 == 0, F.lit("POINT EMPTY")).otherwise(point).alias("wkt"))
        path = io.shared_path(raw.sparkSession, "settlements")
        raw.write.option("escape", '"').csv(path, header=True)
        rows = io.scan_entities(raw.sparkSession, path, "code long, name string, wkt string")
        return io.load_entities(rows, ["name", "code"], ["code", "name", "x", "y", "refused"], {"name": "label"})

    def exclusion_file(v):
        """Dates and classes written as a text list with notes, blank lines and dates that can't be read."""
        day = F.date_format("date", "yyyy-MM-dd")
        line = F.when(F.dayofmonth("date") == 13, F.concat(day, F.lit("?? obvious"))).when(F.dayofmonth("date") == 14, F.concat(F.lit("# "), day)).when(F.dayofmonth("date") == 15, F.lit("  ")).when(F.col("mlr") > 0, F.concat(day, F.lit(", Obvious"))).otherwise(F.concat(day, F.lit(" maybe")))
        raw = v("v_exposure").select(line.alias("value"))
        path = io.shared_path(raw.sparkSession, "exclusions")
        raw.write.text(path)
        rows = io.scan_exclusions(raw.sparkSession, path)
        return rows.groupBy(F.trunc("date", "year").alias("year"), "kind").agg(F.count("*").alias("n"), F.count("refused").alias("n_refused"), F.max("date").alias("last"))

    def scene_files(v):
        """The panel written as a folder of files a month whose name holds the month's first day."""
        raw = v("v_panel").withColumn("scene", F.concat(F.when(F.month("date") == 2, F.lit("tile")).otherwise(F.lit("VJ_h20v11_")), F.when(F.month("date") == 2, F.lit("")).otherwise(F.date_format(F.trunc("date", "month"), "yyyy_MM_dd"))))
        path = io.shared_path(raw.sparkSession, "scenes")
        io.write_scenes(raw.select("scene", "entity", "p"), path)
        return io.scan_scenes(raw.sparkSession, path).groupBy("date").agg(F.count("*").alias("n"), F.sum("p").alias("p"))

    c["src3_hourly_file"] = (["v_schedule"], hourly_file, "SELECT CASE WHEN event_id % 97 <> 0 THEN CAST(start AS DATE) END AS date, I(CASE WHEN event_id % 97 <> 0 THEN HOUR(start) END) AS hour, R(SUM(CASE WHEN event_id % 89 <> 0 THEN minutes END)) AS m, N(COUNT(*)) AS n, N(COUNT(*) FILTER (WHERE event_id % 97 = 0 OR event_id % 89 = 0)) AS n_refused FROM v_schedule GROUP BY 1, 2")
    c["src4_entity_file"] = (["v_entities"], entity_file, "SELECT N(ROW_NUMBER() OVER (ORDER BY area || ', \"' || region || '\"', entity)) AS entity, N(entity) AS code, area || ', \"' || region || '\"' AS label, R(CASE WHEN entity % 9 <> 0 THEN demand / 1000 END) AS x, R(CASE WHEN entity % 9 <> 0 THEN entity / 8 END) AS y, CASE WHEN entity % 9 = 0 THEN 'POINT EMPTY' END AS refused FROM v_entities")
    c["src7_exclusion_file"] = (["v_exposure"], exclusion_file, "SELECT CAST(DATE_TRUNC('year', date) AS DATE) AS year, kind, N(COUNT(*)) AS n, N(COUNT(*) FILTER (WHERE bad)) AS n_refused, MAX(date) AS last FROM (SELECT CASE WHEN DAY(date) <> 13 THEN date END AS date, DAY(date) = 13 AS bad, CASE WHEN DAY(date) = 13 OR mlr > 0 THEN 'obvious' ELSE 'maybe' END AS kind FROM v_exposure WHERE DAY(date) NOT IN (14, 15)) q GROUP BY 1, 2")
    c["src8_scene_files"] = (["v_panel"], scene_files, "SELECT CASE WHEN MONTH(date) <> 2 AND YEAR(date) >= 2000 THEN CAST(DATE_TRUNC('month', date) AS DATE) END AS date, N(COUNT(*)) AS n, R(SUM(p)) AS p FROM v_panel GROUP BY 1")
    c["src4_load_entities"] = (["v_entities"], lambda v: io.load_entities(v("v_entities").select(F.col("entity").alias("code"), "area", "demand"), ["area", "code"], ["code", "demand"], {"demand": "load"}), "SELECT N(ROW_NUMBER() OVER (ORDER BY area, entity)) AS entity, entity AS code, R(demand) AS load FROM v_entities")

    def register(v):
        e = v("v_entities")
        a = e.where("entity % 2 = 0").select(F.concat(F.lit("Plant "), "entity").alias("Plant name"), F.when(F.col("entity") % 3 == 0, "coal thermal").when(F.col("entity") % 3 == 1, "PV park").otherwise("office").alias("Technology"), F.concat(F.lit("1,"), F.lpad((F.col("entity") % 1000).cast("string"), 3, "0"), F.lit(" MW")).alias("Capacity (MW)"), F.lit("20.5").alias("Longitude"), F.lit("-30").alias("Latitude"), F.col("area").alias("Country"))
        b = e.where("entity % 2 = 1").select(F.concat(F.lit("Site "), "entity").alias("name"), F.lit("power station").alias("type"), F.col("entity").cast("string").alias("mw"), F.when(F.col("entity") % 5 == 0, "500").otherwise("21").alias("lon"), F.lit("-29").alias("lat"), F.col("area").alias("country"))
        found = io.harmonise_register({"a": a, "b": b}, {"name": ["plant name", "name"], "type": ["technology", "type"], "capacity": ["capacity (mw)", "mw"], "lon": ["longitude", "lon"], "lat": ["latitude", "lat"], "country": ["country"]}, {"coal|thermal": "coal", "pv|solar": "solar"}, "power")
        return found.select("sheet", "name", "capacity", "fuel", "lon", "lat")

    c["src5_register"] = (["v_entities"], register, "SELECT 'a' AS sheet, 'Plant ' || entity AS name, R(1000 + entity % 1000) AS capacity, CASE WHEN entity % 3 = 0 THEN 'coal' ELSE 'solar' END AS fuel, R(20.5) AS lon, R(-30) AS lat FROM v_entities WHERE entity % 2 = 0 AND entity % 3 <> 2 UNION ALL SELECT 'b', 'Site ' || entity, R(entity), NULL, R(21), R(-29) FROM v_entities WHERE entity % 2 = 1 AND entity % 5 <> 0")
    c["src6_exclusion_dates"] = (["v_exposure"], lambda v: io.exclusion_dates(flags(v), "0.0"), ", q AS (SELECT QUANTILE_CONT(contracted, 0.75) AS b FROM v_exposure) SELECT date FROM v_exposure, q WHERE contracted > b")
    c["src7_exclusion_text"] = (["v_exposure"], lambda v: io.exclusion_dates_text(v("v_exposure").select(F.concat(F.col("date").cast("string"), F.when(F.col("mlr") > 0, F.lit(" obvious")).otherwise(F.lit("; Maybe"))).alias("value")), "obvious"), "SELECT date FROM v_exposure WHERE mlr > 0")
    c["src8_date_in_name"] = (["v_exposure"], lambda v: v("v_exposure").select("date", io.date_in_name(F.concat(F.lit("VJ_h20v11_"), F.date_format("date", "yyyyMMdd"), F.lit("_001.tif"))).alias("found")), "SELECT date, date AS found FROM v_exposure WHERE YEAR(date) >= 2000 UNION ALL SELECT date, NULL FROM v_exposure WHERE YEAR(date) < 2000")
    return c


