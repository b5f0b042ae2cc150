"""Queries of panels, states and reliability, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskgrid.functions import median, quantile, safe_max, safe_mean, safe_sum, sample_sd, weighted_mean, weighted_sd
from duskgrid.operators import panel as P
from duskgrid.operators import reliability as R
from duskgrid.operators import states as S
from duskgrid.sources import io

#: Dense states with a window of 10 days of which 4 must be seen and 3 lit.
STATE = {"n": 10, "least_obs": 4, "least_lit": 3}
CAL = "cal AS (SELECT CAST(unnest(generate_series((SELECT MIN(date) FROM v_panel), (SELECT MAX(date) FROM v_panel), INTERVAL 1 DAY)) AS DATE) AS date)"
DENSE = CAL + ", dense AS (SELECT e.entity, c.date, v.p, v.coverage FROM (SELECT DISTINCT entity FROM v_panel) e CROSS JOIN cal c LEFT JOIN v_panel v ON v.entity = e.entity AND v.date = c.date)"
STATES = (
    DENSE
    + """, ld AS (SELECT *, CAST(p >= 0.4 AS INTEGER) AS lit_day, CAST(p < 0.05 AS INTEGER) AS dark_day, CAST(p IS NOT NULL AS INTEGER) AS observed FROM dense),
rl AS (SELECT *, CASE WHEN COUNT(*) OVER w = 10 THEN SUM(COALESCE(lit_day, 0)) OVER w END AS n_lit, CASE WHEN COUNT(*) OVER w = 10 THEN SUM(observed) OVER w END AS n_obs
  FROM ld WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
el AS (SELECT *, CASE WHEN n_obs >= 4 THEN CAST(n_lit >= 3 AS INTEGER) END AS electrified FROM rl),
doe AS (SELECT *, MIN(CASE WHEN electrified = 1 THEN date END) OVER (PARTITION BY entity) AS doe FROM el),
states AS (SELECT *, CASE WHEN date >= doe THEN 1 ELSE 0 END AS after_doe FROM doe)"""
)


def _metrics(period: str, support: int) -> str:
    return f"""m AS (SELECT entity, period_start, COUNT(*) AS obs_days, SUM(lit_day) AS lit_days, SUM(dark_day) AS dark_days, AVG(lit_day) AS uptime, AVG(dark_day) AS dark_share, AVG(p) AS mean_p,
  CASE WHEN COUNT(*) >= 2 THEN STDDEV_SAMP(p) END AS sd_p, AVG(CAST(lit_day <> prev AS INTEGER)) AS switch_rate, AVG(coverage) AS mean_coverage, CASE WHEN COUNT(*) >= {support} THEN 1 ELSE 0 END AS support_ok
  FROM (SELECT *, CAST(DATE_TRUNC('{period}', date) AS DATE) AS period_start, LAG(lit_day) OVER (PARTITION BY entity, DATE_TRUNC('{period}', date) ORDER BY date) AS prev FROM states WHERE p IS NOT NULL AND after_doe = 1) x
  GROUP BY 1, 2)"""


MONTH = STATES + ", " + _metrics("month", 10)
QUARTER = STATES + ", " + _metrics("quarter", 40)
AREA = (
    ", a AS (SELECT * FROM v_entities WHERE population IS NOT NULL), t AS (SELECT area, SUM(population) AS area_population FROM a GROUP BY 1), g AS (SELECT area, period_start, COUNT(DISTINCT m.entity) AS n_entities, SUM(population) AS kept_population, "
    + ", ".join(f"SUM({x} * population) FILTER (WHERE {x} IS NOT NULL) / SUM(population) FILTER (WHERE {x} IS NOT NULL) AS {x}" for x in ("uptime", "dark_share", "mean_p", "sd_p", "cv_p", "switch_rate"))
    + ", SQRT(GREATEST(SUM(population * uptime * uptime) / SUM(population) - POWER(SUM(population * uptime) / SUM(population), 2), 0)) AS uptime_sd"
    + " FROM (SELECT *, CASE WHEN mean_p > 0 THEN sd_p / mean_p END AS cv_p FROM m WHERE support_ok = 1) m JOIN a ON m.entity = a.entity GROUP BY 1, 2), area AS (SELECT t.area, g.* EXCLUDE (area), COALESCE(kept_population, 0) / area_population AS coverage_share, area_population FROM t LEFT JOIN g ON t.area = g.area)"
)
_M = "entity, period_start, N(obs_days) AS obs_days, N(lit_days) AS lit_days, N(dark_days) AS dark_days, R(uptime) AS uptime, R(dark_share) AS dark_share, R(mean_p) AS mean_p, R(sd_p) AS sd_p, R(switch_rate) AS switch_rate, R(mean_coverage) AS mean_coverage, I(support_ok) AS support_ok, R(CASE WHEN mean_p > 0 THEN sd_p / mean_p END) AS cv_p"
_A = "area, period_start, N(n_entities) AS n_entities, R(kept_population) AS kept_population, R(uptime) AS uptime, R(dark_share) AS dark_share, R(mean_p) AS mean_p, R(sd_p) AS sd_p, R(cv_p) AS cv_p, R(switch_rate) AS switch_rate, R(uptime_sd) AS uptime_sd, R(area_population) AS area_population, R(coverage_share) AS coverage_share"


def seen(v):
    return v("v_panel").select("entity", "date", "p", "coverage")


def states(v):
    return S.panel_states(seen(v), **STATE)


def after(v):
    """The observed days of states from the doe on, which is all that metrics take."""
    return S.observed_after(seen(v), **STATE)


def triggers(v, **rule):
    """A row an entity: its doe in states and the counts there."""
    return S.first_triggers(seen(v).select("entity", "date", "p"), **STATE | rule)


def area_month(v, least=0.0):
    return R.area_metrics(R.entity_metrics(after(v), "month"), v("v_entities").select("entity", "area", "population"), least)


def entity_flags(v):
    """Entities with flags: seen at all, with a doe, supported in some quarter."""
    doe = triggers(v).select("entity", F.col("doe").isNotNull().cast("int").alias("doe_known"))
    sup = R.entity_metrics(after(v), "quarter").groupBy("entity").agg(F.max("support_ok").alias("supported"))
    seen = v("v_panel").select("entity").distinct().withColumn("observed", F.lit(1))
    return v("v_entities").join(seen, "entity", "left").join(doe, "entity", "left").join(sup, "entity", "left")


FLAGS = QUARTER + """, fl AS (SELECT e.*, CASE WHEN EXISTS (SELECT 1 FROM v_panel p WHERE p.entity = e.entity) THEN 1 ELSE 0 END AS observed,
 COALESCE((SELECT MAX(CAST(doe IS NOT NULL AS INTEGER)) FROM states s WHERE s.entity = e.entity), 0) AS doe_known, COALESCE((SELECT MAX(support_ok) FROM m WHERE m.entity = e.entity), 0) AS supported FROM v_entities e)"""


def catalog():
    ent = lambda v: v("v_entities")
    pan = lambda v: v("v_panel")
    month_of = lambda d: F.date_format(d, "yyyy-MM")
    c = {}
    c["pan1_coverage_filter"] = (["v_panel"], lambda v: P.coverage_filter(pan(v), 0.5).select("entity", "date", "p"), "SELECT entity, date, R(p) AS p FROM v_panel WHERE coverage >= 0.5")
    c["pan2_retention"] = (
        ["v_panel"],
        lambda v: P.retention(pan(v), P.coverage_filter(pan(v), 0.95)),
        ", b AS (SELECT entity, COUNT(*) AS n0, COUNT(*) FILTER (WHERE coverage >= 0.95) AS n1 FROM v_panel GROUP BY 1) SELECT N(COUNT(*)) AS n_entities, N(COUNT(*) FILTER (WHERE n1 = 0)) AS n_dropped, N(COUNT(*) FILTER (WHERE n1 > 0 AND n1 < n0)) AS n_partial, N(COUNT(*) FILTER (WHERE n1 = n0)) AS n_full, N(SUM(n0)) AS days_before, N(SUM(n1)) AS days_after FROM b",
    )
    c["pan3_keep_inner"] = (["v_panel", "v_entities"], lambda v: P.keep_inner(pan(v), ent(v).where("demand > 3000")).select("entity", "date", "population"), "SELECT v.entity, date, R(population) AS population FROM v_panel v JOIN v_entities e ON v.entity = e.entity WHERE demand > 3000")
    c["pan4_keep_semi"] = (["v_panel", "v_entities"], lambda v: P.keep_semi(pan(v), ent(v).where("population > 2000")).select("entity", "date", "p"), "SELECT entity, date, R(p) AS p FROM v_panel WHERE entity IN (SELECT entity FROM v_entities WHERE population > 2000)")
    c["pan5_exclude_dates"] = (["v_panel", "v_exposure"], lambda v: P.exclude_dates(pan(v), v("v_exposure").where("mlr > 0").select("date")).select("entity", "date"), "SELECT entity, date FROM v_panel WHERE date NOT IN (SELECT date FROM v_exposure WHERE mlr > 0)")
    c["pan6_enrich"] = (["v_panel", "v_entities"], lambda v: P.enrich(pan(v).withColumn("population", F.when(F.col("p") > 0.5, F.lit(1.0))), ent(v), ["population", "area"]).select("entity", "date", "population", "area"), "SELECT v.entity, date, R(COALESCE(CASE WHEN p > 0.5 THEN 1.0 END, population)) AS population, area FROM v_panel v LEFT JOIN v_entities e ON v.entity = e.entity")
    c["pan7_first_known"] = (["v_panel"], lambda v: P.first_known(pan(v).withColumn("x", F.when(F.col("p") > 0.9, F.col("mean_rad"))), ["x"]), "SELECT entity, R(ARG_MIN(mean_rad, date)) AS x FROM v_panel WHERE p > 0.9 GROUP BY 1 UNION ALL SELECT DISTINCT entity, NULL FROM v_panel WHERE entity NOT IN (SELECT entity FROM v_panel WHERE p > 0.9)")
    c["pan8_duplicate_keys"] = (["v_weights"], lambda v: P.duplicate_keys(v("v_weights"), ["entity"]), "SELECT entity, N(COUNT(*)) AS n FROM v_weights GROUP BY 1 HAVING COUNT(*) > 1")
    c["pan9_daily_summary"] = (
        ["v_panel", "v_entities", "v_exposure"],
        lambda v: P.daily_summary(pan(v).where("coverage >= 0.98").join(ent(v), "entity"), v("v_exposure").where("mlr > 0")),
        f", {CAL.replace('v_panel', 'k')}, d AS (SELECT date, COUNT(*) AS n, AVG(p) AS mean_p, QUANTILE_CONT(p, 0.5) AS median_p, SUM(p * population) / SUM(population) AS weighted_p, COALESCE(SUM(CASE WHEN p < 0.05 THEN population END), 0) / SUM(population) AS weighted_dark FROM k GROUP BY 1) SELECT c.date, N(COALESCE(n, 0)) AS n, R(mean_p) AS mean_p, R(median_p) AS median_p, R(weighted_p) AS weighted_p, R(weighted_dark) AS weighted_dark, CASE WHEN n > 0 THEN 'observed' WHEN c.date IN (SELECT date FROM v_exposure WHERE mlr > 0) THEN 'not_processed' ELSE 'missing_raster' END AS status FROM cal c LEFT JOIN d ON c.date = d.date",
        "k AS (SELECT * FROM v_panel JOIN v_entities USING (entity) WHERE coverage >= 0.98)",
    )
    c["pan10_dense"] = (["v_panel"], lambda v: P.dense(pan(v)).select("entity", "date", "p"), f", {DENSE} SELECT entity, date, R(p) AS p FROM dense")
    c["pan11_fill_static"] = (
        ["v_panel"],
        lambda v: P.fill_static(P.dense(pan(v).withColumn("x", F.when(F.col("p") > 0.5, F.col("mean_rad")))), ["x"]).select("entity", "date", "x"),
        f", {DENSE}, xx AS (SELECT d.entity, d.date, CASE WHEN v.p > 0.5 THEN v.mean_rad END AS x FROM dense d LEFT JOIN v_panel v ON v.entity = d.entity AND v.date = d.date) SELECT entity, date, R(COALESCE(LAST_VALUE(x IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING), FIRST_VALUE(x IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS x FROM xx",
    )
    c["pan12_completion_grid"] = (
        ["v_panel", "v_entities"],
        lambda v: P.completion_grid(pan(v).join(ent(v), "entity").groupBy("area", F.trunc("date", "month").alias("period_start")).agg(F.count("*").alias("n")).where("n > 20"), "area", "period_start"),
        ", g AS (SELECT area, CAST(DATE_TRUNC('month', date) AS DATE) AS period_start, COUNT(*) AS n FROM v_panel JOIN v_entities USING (entity) GROUP BY 1, 2 HAVING COUNT(*) > 20) SELECT a.area, b.period_start, N(g.n) AS n FROM (SELECT DISTINCT area FROM g) a CROSS JOIN (SELECT DISTINCT period_start FROM g) b LEFT JOIN g ON g.area = a.area AND g.period_start = b.period_start",
    )
    c["pan13_attach_baseline"] = (["v_panel"], lambda v: P.attach_baseline(pan(v), 540).select("entity", "date", "obs_days", "median_p", "baseline_ok"), "SELECT v.entity, date, N(obs_days) AS obs_days, R(median_p) AS median_p, I(obs_days >= 540) AS baseline_ok FROM v_panel v JOIN (SELECT entity, COUNT(DISTINCT date) AS obs_days, QUANTILE_CONT(p, 0.5) AS median_p FROM v_panel GROUP BY 1) b ON v.entity = b.entity")
    c["pan14_neighbours"] = (["v_panel"], lambda v: P.neighbours(pan(v), ["p"]).select("entity", "date", "p", "prev_p", "next_p"), "SELECT v.entity, v.date, R(v.p) AS p, R(a.p) AS prev_p, R(b.p) AS next_p FROM v_panel v LEFT JOIN v_panel a ON a.entity = v.entity AND a.date = v.date - 1 LEFT JOIN v_panel b ON b.entity = v.entity AND b.date = v.date + 1")
    c["pan15_melt"] = (["v_panel"], lambda v: P.melt(pan(v), ["entity", "date"], ["p", "coverage"]), "SELECT entity, date, 'p' AS metric, R(p) AS value FROM v_panel UNION ALL SELECT entity, date, 'coverage', R(coverage) FROM v_panel")
    c["pan15_cast_wide"] = (
        ["v_visits"],
        lambda v: P.cast_wide(v("v_visits").withColumn("kind", F.when(F.col("p") > 0.4, "hi").otherwise("lo")).groupBy("entity", "kind").agg(F.sum("n").alias("n")), ["entity"], "kind", "n", ["hi", "lo"]),
        "SELECT entity, N(SUM(CASE WHEN p > 0.4 THEN n END)) AS hi, N(SUM(CASE WHEN p <= 0.4 THEN n END)) AS lo FROM v_visits GROUP BY 1",
    )
    c["pan16_time_keys"] = (["v_exposure"], lambda v: P.time_keys(v("v_exposure")).select("date", "month", "quarter", "year", "dow"), "SELECT date, CAST(DATE_TRUNC('month', date) AS DATE) AS month, CAST(DATE_TRUNC('quarter', date) AS DATE) AS quarter, CAST(DATE_TRUNC('year', date) AS DATE) AS year, I(DAYOFWEEK(date) + 1) AS dow FROM v_exposure")
    c["pan17_population_bin"] = (["v_entities"], lambda v: P.population_bin(ent(v), [0, 2000, 5000, 8000]).select("entity", "bin"), "SELECT entity, CASE WHEN population IS NULL THEN NULL WHEN population <= 0 THEN NULL WHEN population <= 2000 THEN '1:(0,2000]' WHEN population <= 5000 THEN '2:(2000,5000]' WHEN population <= 8000 THEN '3:(5000,8000]' ELSE '4:>8000' END AS bin FROM v_entities")
    c["pan18_block_number"] = (["v_schedule"], lambda v: P.block_number(v("v_schedule").select("event_id", F.concat(F.lit("Block "), (F.col("event_id") % 23).cast("string"), F.lit(" b")).alias("name")), "name").select("event_id", "block_id"), "SELECT event_id, I(event_id % 23) AS block_id FROM v_schedule")
    c["pan18_parse_id_spec"] = (["v_entities"], lambda v: P.parse_id_spec(ent(v).select(F.concat(F.col("entity").cast("string"), F.lit(":"), (F.col("entity") + 2).cast("string"), F.lit(", 500")).alias("s")), "s"), "SELECT DISTINCT I(UNNEST(GENERATE_SERIES(entity, entity + 2))) AS id FROM v_entities UNION SELECT 500 FROM v_entities")
    c["pan19_stack_rows"] = (["v_entities", "v_exposure"], lambda v: P.stack_rows([ent(v).select(F.lit("a").alias("k"), "population"), v("v_exposure").select(F.lit("b").alias("k"), "mlr")]), "SELECT 'a' AS k, R(population) AS population, CAST(NULL AS DOUBLE) AS mlr FROM v_entities UNION ALL SELECT 'b', NULL, R(mlr) FROM v_exposure")
    c["val1_violations"] = (["v_panel"], lambda v: P.violations(pan(v).withColumns({"coverage": F.col("n_valid") / 50, "area_m2": F.col("n_lit")}), ["entity", "date", "p"]), "SELECT N(COUNT(*)) AS n, N(0) AS bad_p, N(COUNT(*) FILTER (WHERE n_valid / 50 > 1)) AS bad_coverage, N(COUNT(*) FILTER (WHERE n_lit <= 0)) AS bad_area FROM v_panel")
    st = ["v_panel"]
    c["win1_rolling_forward"] = (st, lambda v: states(v).select("entity", "date", "n_lit", "n_obs"), f", {STATES} SELECT entity, date, N(n_lit) AS n_lit, N(n_obs) AS n_obs FROM states")
    c["win2_electrified"] = (st, lambda v: states(v).select("entity", "date", "electrified"), f", {STATES} SELECT entity, date, I(electrified) AS electrified FROM states")
    c["win3_first_trigger"] = (st, lambda v: states(v).select("entity", "date", "doe", "after_doe"), f", {STATES} SELECT entity, date, doe, I(after_doe) AS after_doe FROM states")
    c["win4_lit_dark"] = (st, lambda v: states(v).select("entity", "date", "lit_day", "dark_day", "observed"), f", {STATES} SELECT entity, date, I(lit_day) AS lit_day, I(dark_day) AS dark_day, I(observed) AS observed FROM states")
    c["win5_switches"] = (st, lambda v: S.switches(S.lit_dark(pan(v), 0.4, 0.05).withColumn("month", F.trunc("date", "month")), "month").select("entity", "date", "switch"), "SELECT entity, date, I((p >= 0.4) <> LAG(p >= 0.4) OVER (PARTITION BY entity, DATE_TRUNC('month', date) ORDER BY date)) AS switch FROM v_panel")
    c["win6_longest_run"] = (
        st,
        lambda v: S.longest_run(pan(v), F.col("p") < 0.05),
        ", a AS (SELECT entity, date, p < 0.05 AS o, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY date) - ROW_NUMBER() OVER (PARTITION BY entity, p < 0.05 ORDER BY date) AS g FROM v_panel), b AS (SELECT entity, COUNT(*) AS n FROM a WHERE o GROUP BY entity, g) SELECT t.entity, N(COALESCE(MAX(b.n), 0)) AS longest_run, N(ANY_VALUE(t.n)) AS n_days, R(COALESCE(MAX(b.n), 0) / ANY_VALUE(t.n)) AS run_share FROM (SELECT entity, COUNT(*) AS n FROM v_panel GROUP BY 1) t LEFT JOIN b ON t.entity = b.entity GROUP BY 1",
    )
    c["win7_extremes"] = (["v_entities"], lambda v: S.extremes(ent(v), "population", "entity", 7, ["region"]).select("entity", "low_rank", "high_rank", "side"), ", a AS (SELECT entity, ROW_NUMBER() OVER (PARTITION BY region ORDER BY population, entity) AS l, ROW_NUMBER() OVER (PARTITION BY region ORDER BY population DESC, entity) AS h FROM v_entities WHERE population IS NOT NULL) SELECT entity, I(l) AS low_rank, I(h) AS high_rank, CASE WHEN l <= 7 THEN 'low' WHEN h <= 7 THEN 'high' END AS side FROM a")
    c["win8_quantile_groups"] = (["v_panel"], lambda v: S.quantile_groups(pan(v), "mean_rad", "date", 10, ["entity"]).select("entity", "date", "bin"), "SELECT entity, date, I(NTILE(10) OVER (PARTITION BY entity ORDER BY mean_rad, date)) AS bin FROM v_panel")
    c["win9_outer_quarters"] = (["v_entities"], lambda v: S.outer_quarters(ent(v), "population", "entity").select("entity", "side"), ", a AS (SELECT entity, ROW_NUMBER() OVER (ORDER BY population, entity) AS l, ROW_NUMBER() OVER (ORDER BY population DESC, entity) AS h, FLOOR(COUNT(*) OVER () * 0.25) AS n FROM v_entities WHERE population IS NOT NULL) SELECT entity, CASE WHEN l <= n THEN 'low' WHEN h <= n THEN 'high' END AS side FROM a")
    c["win10_lowest_share"] = (["v_exposure"], lambda v: S.lowest_share(v("v_exposure").withColumn("month", F.trunc("date", "month")), "mlr", "date", 0.2).select("date", "mlr"), ", a AS (SELECT date, mlr, ROW_NUMBER() OVER w AS r, COUNT(*) OVER (PARTITION BY DATE_TRUNC('month', date)) AS n FROM v_exposure WINDOW w AS (PARTITION BY DATE_TRUNC('month', date) ORDER BY mlr, date)) SELECT date, R(mlr) AS mlr FROM a WHERE r <= GREATEST(1, CEIL(n * 0.2))")
    c["win11_day_lag"] = (["v_panel"], lambda v: S.day_lag(pan(v), "p", ["entity"]).select("entity", "date", "lag_p", "diff_p"), "SELECT v.entity, v.date, R(a.p) AS lag_p, R(v.p - a.p) AS diff_p FROM v_panel v LEFT JOIN v_panel a ON a.entity = v.entity AND a.date = v.date - 1")
    c["win12_date_runs"] = (["v_panel"], lambda v: S.date_runs(pan(v), ["entity"]).select("entity", "date", "run"), ", a AS (SELECT entity, date, CASE WHEN date - LAG(date) OVER (PARTITION BY entity ORDER BY date) > 1 THEN 1 ELSE 0 END AS g FROM v_panel) SELECT entity, date, N(SUM(g) OVER (PARTITION BY entity ORDER BY date)) AS run FROM a")
    c["win13_autocorrelation"] = (
        ["v_panel"],
        lambda v: S.autocorrelation(pan(v), "p", "date", 30, ["entity"]),
        ", a AS (SELECT entity, p - AVG(p) OVER (PARTITION BY entity) AS d, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY date) AS i FROM v_panel), q AS (SELECT entity, SUM(d * d) AS s FROM a GROUP BY 1) SELECT a.entity, I(k.lag) AS lag, R(SUM(a.d * b.d) / ANY_VALUE(q.s)) AS acf FROM a JOIN (SELECT UNNEST(GENERATE_SERIES(1, 30)) AS lag) k ON TRUE JOIN a b ON b.entity = a.entity AND b.i = a.i - k.lag JOIN q ON q.entity = a.entity GROUP BY 1, 2",
    )
    c["win14_scaled"] = (["v_exposure"], lambda v: S.scaled(v("v_exposure"), "mlr").select("date", "z", "top"), "SELECT date, R((mlr - AVG(mlr) OVER ()) / STDDEV_SAMP(mlr) OVER ()) AS z, R(mlr / MAX(mlr) OVER ()) AS top FROM v_exposure")
    c["win15_diverse_top"] = (["v_panel"], lambda v: S.diverse_top(pan(v), "mean_rad", 12).select("entity", "date", "mean_rad"), ", a AS (SELECT entity, date, mean_rad, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY mean_rad DESC, date) AS r FROM v_panel) SELECT entity, date, R(mean_rad) AS mean_rad FROM a WHERE r = 1 ORDER BY a.mean_rad DESC, entity LIMIT 12")
    c["win16_trigger_margins"] = (st, lambda v: S.trigger_margins(triggers(v).withColumn("date", F.col("doe")), 4, 3, 0), f", {STATES} SELECT entity, doe, N(n_obs - 4) AS obs_margin, N(n_lit - 3) AS lit_margin, I(n_obs - 4 <= 0) AS obs_near, I(n_lit - 3 <= 0) AS lit_near FROM states WHERE date = doe")
    c["rel1_entity_metrics"] = (st, lambda v: R.entity_metrics(after(v), "month"), f", {MONTH} SELECT {_M} FROM m")
    c["rel2_all_periods"] = (st, lambda v: R.all_periods(after(v)), f", {STATES}" + "".join(f", {_metrics(p, n).replace('m AS', f'm_{p} AS', 1)}" for p, n in R.SUPPORT.items()) + " SELECT " + _M + ", period FROM (" + " UNION ALL ".join(f"SELECT *, '{p}' AS period FROM m_{p}" for p in R.SUPPORT) + ") z")
    c["rel3_state_day_counts"] = (
        st,
        lambda v: R.state_day_counts(R.entity_metrics(after(v), "month").select("entity", "period_start", "obs_days"), R.named_state(states(v)), "month"),
        f", {MONTH} SELECT m.entity, m.period_start, N(m.obs_days) AS obs_days, N(COUNT(*) FILTER (WHERE s.lit_day = 1)) AS lit_days, N(COUNT(*) FILTER (WHERE s.lit_day = 0 AND s.dark_day = 1)) AS dark_days, N(COUNT(*) FILTER (WHERE s.lit_day = 0 AND s.dark_day = 0)) AS ambiguous_days FROM m JOIN states s ON s.entity = m.entity AND DATE_TRUNC('month', s.date) = m.period_start GROUP BY 1, 2, 3",
    )
    both = ["v_panel", "v_entities"]
    c["rel4_area_metrics"] = (both, area_month, f", {MONTH}{AREA} SELECT {_A} FROM area")
    c["rel5_drop_reasons"] = (
        both,
        lambda v: R.drop_reasons(area_month(v), 0.5),
        f", {MONTH}{AREA} SELECT a.area, b.period_start, CASE WHEN n_entities IS NULL THEN 'no_entities' WHEN coverage_share < 0.5 THEN 'low_coverage' ELSE 'kept' END AS reason, R(COALESCE(coverage_share, 0)) AS coverage_share FROM (SELECT DISTINCT area FROM area) a CROSS JOIN (SELECT DISTINCT period_start FROM area WHERE period_start IS NOT NULL) b LEFT JOIN area x ON x.area = a.area AND x.period_start = b.period_start",
    )
    c["rel7_electrified_share"] = (["v_entities"], lambda v: R.electrified_share(ent(v).withColumn("electrified", (F.col("demand") > 5000).cast("int"))), ", e AS (SELECT *, demand > 5000 AS x FROM v_entities) SELECT area, N(COUNT(*)) AS n, N(COUNT(*) FILTER (WHERE x)) AS n_electrified, R(SUM(population)) AS population, R(SUM(population) FILTER (WHERE x)) AS electrified_population, R(CASE WHEN SUM(population) > 0 THEN COALESCE(SUM(population) FILTER (WHERE x), 0) / SUM(population) END) AS population_share FROM e GROUP BY GROUPING SETS ((area), ())")
    c["rel8_doe_status"] = (both, lambda v: R.doe_status(triggers(v, least_lit=6), ent(v)), f", {STATES.replace('n_lit >= 3', 'n_lit >= 6')}, e AS (SELECT v.*, d.doe IS NOT NULL AS x FROM (SELECT DISTINCT entity, doe FROM states) d JOIN v_entities v ON v.entity = d.entity) SELECT area, N(COUNT(*)) AS n, N(COUNT(*) FILTER (WHERE x)) AS n_electrified, R(SUM(population)) AS population, R(SUM(population) FILTER (WHERE x)) AS electrified_population, R(CASE WHEN SUM(population) > 0 THEN COALESCE(SUM(population) FILTER (WHERE x), 0) / SUM(population) END) AS population_share FROM e GROUP BY GROUPING SETS ((area), ())")
    q = lambda x: f"N(COUNT(*)) AS n, N(COUNT(*) FILTER (WHERE {x} BETWEEN 0 AND 2)) AS n_near, R(QUANTILE_CONT({x}, 0.1)) AS p10, R(QUANTILE_CONT({x}, 0.5)) AS p50, R(QUANTILE_CONT({x}, 0.9)) AS p90, R(AVG({x})) AS mean"
    c["rel9_support_margin"] = (st, lambda v: R.margin_summary(R.entity_metrics(after(v), "month").withColumn("margin", F.col("obs_days") - 10), "margin", 2, ["period_start"]), f", {MONTH} SELECT period_start, {q('(obs_days - 10)')} FROM m GROUP BY 1")
    c["rel10_coverage_margin"] = (both, lambda v: R.margin_summary(area_month(v).withColumn("margin", F.col("coverage_share") - 0.3), "margin", 2, ["area"]), f", {MONTH}{AREA} SELECT area, {q('(coverage_share - 0.3)')} FROM area GROUP BY 1")
    c["rel11_waterfall"] = (both, lambda v: R.waterfall(entity_flags(v), ["observed", "doe_known", "supported"]), f", {FLAGS}, w AS (SELECT 0 AS step, 'observed' AS stage, observed = 1 AS ok, population FROM fl UNION ALL SELECT 1, 'doe_known', observed = 1 AND doe_known = 1, population FROM fl UNION ALL SELECT 2, 'supported', observed = 1 AND doe_known = 1 AND supported = 1, population FROM fl) SELECT I(step) AS step, stage, N(COUNT(*) FILTER (WHERE ok)) AS n, R(COALESCE(SUM(population) FILTER (WHERE ok), 0)) AS population, R(COUNT(*) FILTER (WHERE ok) / (SELECT COUNT(*) FROM fl WHERE observed = 1)) AS share FROM w GROUP BY 1, 2")
    c["rel12_stage_reasons"] = (both, lambda v: R.stage_reasons(entity_flags(v), ["observed", "doe_known", "supported"]), f", {FLAGS} SELECT CASE WHEN observed <> 1 THEN 'no_observed' WHEN doe_known <> 1 THEN 'no_doe_known' WHEN supported <> 1 THEN 'no_supported' ELSE 'kept' END AS reason, N(COUNT(*)) AS n, R(COUNT(*) / (SELECT COUNT(*) FROM fl)) AS share FROM fl GROUP BY 1")
    DAILY = ", a AS (SELECT * FROM v_entities WHERE population IS NOT NULL), s AS (SELECT area, date, SUM(population) AS seen FROM v_panel JOIN a USING (entity) GROUP BY 1, 2), t AS (SELECT area, SUM(population) AS w FROM a GROUP BY 1), dc AS (SELECT x.area, y.date, COALESCE(seen, 0) / w AS coverage_share FROM (SELECT DISTINCT area FROM s) x CROSS JOIN (SELECT DISTINCT date FROM s) y LEFT JOIN s ON s.area = x.area AND s.date = y.date JOIN t ON t.area = x.area)"
    c["rel13_area_daily_coverage"] = (both, lambda v: R.area_daily_coverage(pan(v), ent(v)), f"{DAILY} SELECT area, date, R(coverage_share) AS coverage_share FROM dc")
    c["rel13_coverage_summary"] = (both, lambda v: R.coverage_summary(R.area_daily_coverage(pan(v), ent(v)), [0.1, 0.25]), f"{DAILY} SELECT area, N(COUNT(*)) AS n_days, R(AVG(coverage_share)) AS mean, R(QUANTILE_CONT(coverage_share, 0.1)) AS p10, R(QUANTILE_CONT(coverage_share, 0.5)) AS p50, N(COUNT(*) FILTER (WHERE coverage_share >= 0.1)) AS days_10, N(COUNT(*) FILTER (WHERE coverage_share >= 0.25)) AS days_25 FROM dc GROUP BY 1")
    c["rel14_area_audit"] = (both, lambda v: R.area_audit(pan(v), ent(v), [0.0, 0.5, 0.8]), ", k AS (SELECT UNNEST([0.0, 0.5, 0.8]) AS scenario) SELECT R(scenario) AS scenario, area, N(COUNT(*)) AS entity_days, N(COUNT(DISTINCT entity)) AS n_entities, N(COUNT(DISTINCT date)) AS n_dates FROM v_panel JOIN v_entities USING (entity) JOIN k ON coverage >= scenario GROUP BY 1, 2")
    c["rel15_threshold_sensitivity"] = (both, lambda v: R.threshold_sensitivity(area_month(v), [0.25, 0.3, 0.4, 0.5]), f", {MONTH}{AREA} SELECT period_start, " + ", ".join(f"N(COUNT(*) FILTER (WHERE coverage_share >= {t / 100})) AS kept_{t}" for t in (25, 30, 40, 50)) + " FROM area WHERE period_start IS NOT NULL GROUP BY 1")
    c["rel16_population_flag"] = (both, lambda v: R.population_flag(area_month(v)).select("area", "period_start", "low", "label"), f", {MONTH}{AREA} SELECT area, period_start, I(coverage_share < 0.5) AS low, area || CASE WHEN coverage_share < 0.5 THEN '*' ELSE '' END AS label FROM area")
    c["rel17_latest_dark_days"] = (st, lambda v: R.latest_period(R.annual_dark_days(S.lit_dark(pan(v), 0.4, 0.05))), "SELECT entity, CAST(DATE_TRUNC('year', date) AS DATE) AS period_start, N(COUNT(*) FILTER (WHERE p < 0.05)) AS dark_days FROM v_panel WHERE DATE_TRUNC('year', date) = (SELECT MAX(DATE_TRUNC('year', date)) FROM v_panel) GROUP BY 1, 2")
    PROFILE = ", f AS (SELECT entity, COUNT(*) AS n, AVG(p) AS mean_p, STDDEV_SAMP(p) AS sd_p, AVG(CAST(p > 0.9 AS INTEGER)) AS full_share, AVG(CAST(p < 0.05 AS INTEGER)) AS zero_share FROM v_panel GROUP BY 1)"
    c["rel18_illumination_profile"] = (st, lambda v: R.illumination_profile(pan(v)), f"{PROFILE} SELECT entity, N(n) AS n, R(mean_p) AS mean_p, R(sd_p) AS sd_p, R(full_share) AS full_share, R(zero_share) AS zero_share, R(CASE WHEN mean_p > 0 THEN sd_p / mean_p END) AS cv_p, CASE WHEN full_share >= 0.5 THEN 'mostly_full' WHEN zero_share >= 0.5 THEN 'mostly_dark' WHEN full_share + zero_share >= 0.8 THEN 'on_off' ELSE 'partial' END AS regime FROM f")
    c["rel19_mostly_lit"] = (st, lambda v: R.mostly_lit(pan(v), 0.4, 0.57).select("entity", "date"), "SELECT entity, date FROM v_panel WHERE entity IN (SELECT entity FROM v_panel GROUP BY 1 HAVING AVG(CAST(p > 0.4 AS INTEGER)) >= 0.57)")

    def written(v):
        panel = pan(v).select("entity", "date", F.col("p").cast("double").alias("p"))
        return panel, io.write_panel(panel, io.shared_path(panel.sparkSession, "panel"))

    def month_range(v):
        panel, path = written(v)
        return io.read_panel(panel.sparkSession, path, "1996-03", "1996-07", columns=["entity", "date", "month"])

    def rewritten(v):
        """The panel after one of its months was written anew with p halved."""
        panel, path = written(v)
        io.write_panel(panel.where("date between '1996-05-01' and '1996-05-31'").withColumn("p", F.col("p") / 2), path)
        return panel.sparkSession.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"), F.sum("p").alias("p"))

    def table(v):
        rows = pan(v).groupBy("entity").agg(F.count("*").alias("n"), F.max("date").alias("last"), F.min(F.when(F.col("p") > 0, F.col("p")).cast("double")).alias("p"))
        path = io.write_table(rows, io.shared_path(rows.sparkSession, "table"))
        return rows.sparkSession.read.schema(rows.schema).csv(path, header=True)

    def cached(v):
        """Monthly metrics from states that are made once and then only read."""
        spark = pan(v).sparkSession
        folder = io.shared_path(spark, "cache")
        io.state_cache(spark, folder, STATE, lambda: states(v))
        return R.entity_metrics(io.state_cache(spark, folder, STATE, lambda: states(v), "metrics_only").where("after_doe = 1"), "month")

    def by_month(v):
        """States kept by month: made without the last month and with another one changed, then brought up to date."""
        whole = pan(v).select("entity", "date", "p", "coverage")
        spark = whole.sparkSession
        path, folder = io.shared_path(spark, "panel"), io.shared_path(spark, "states")
        month, last = F.date_format("date", "yyyy-MM"), whole.agg(F.date_format(F.max("date"), "yyyy-MM")).first()[0]
        halved = F.when(month == "1996-05", F.col("p") / 2).otherwise(F.col("p"))
        io.write_panel(whole.where(month != last).withColumn("p", halved), path)
        io.monthly_states(spark, path, folder, **STATE)
        io.write_panel(whole.where(month.isin(last, "1996-05")), path)
        return io.monthly_states(spark, path, folder, **STATE)[0].select("entity", "date", "n_lit", "n_obs", "electrified", "doe", "after_doe")

    c["snk3_monthly_states"] = (st, by_month, f", {STATES} SELECT entity, date, N(n_lit) AS n_lit, N(n_obs) AS n_obs, I(electrified) AS electrified, doe, I(after_doe) AS after_doe FROM states")
    c["src1_month_range"] = (st, month_range, "SELECT entity, date, STRFTIME(date, '%Y-%m') AS month FROM v_panel WHERE STRFTIME(date, '%Y-%m') BETWEEN '1996-03' AND '1996-07'")
    c["snk1_write_panel"] = (st, rewritten, "SELECT STRFTIME(date, '%Y-%m') AS month, N(COUNT(*)) AS n, R(SUM(p) / CASE WHEN STRFTIME(date, '%Y-%m') = '1996-05' THEN 2 ELSE 1 END) AS p FROM v_panel GROUP BY 1")
    c["snk2_write_table"] = (st, table, "SELECT entity, N(COUNT(*)) AS n, MAX(date) AS last, R(MIN(CASE WHEN p > 0 THEN p END)) AS p FROM v_panel GROUP BY 1")
    c["snk3_state_cache"] = (st, cached, f", {MONTH} SELECT {_M} FROM m")
    c["rel6_summaries"] = (
        both,
        lambda v: pan(v).join(ent(v), "entity").groupBy("area").agg(weighted_mean("p", "population").alias("weighted_mean"), weighted_sd("p", "population").alias("weighted_sd"), safe_mean("p").alias("mean"), safe_sum("n_valid").alias("total"), median("p").alias("median"), safe_max("mean_rad").alias("top"), quantile("mean_rad", 0.9).alias("p90"), sample_sd("p").alias("sd")),
        "SELECT area, R(SUM(p * population) FILTER (WHERE population > 0) / SUM(population) FILTER (WHERE population > 0)) AS weighted_mean, R(SQRT(GREATEST(SUM(population * p * p) FILTER (WHERE population > 0) / SUM(population) FILTER (WHERE population > 0) - POWER(SUM(p * population) FILTER (WHERE population > 0) / SUM(population) FILTER (WHERE population > 0), 2), 0))) AS weighted_sd, R(AVG(p)) AS mean, R(SUM(n_valid)) AS total, R(QUANTILE_CONT(p, 0.5)) AS median, R(MAX(mean_rad)) AS top, R(QUANTILE_CONT(mean_rad, 0.9)) AS p90, R(STDDEV_SAMP(p)) AS sd FROM v_panel JOIN v_entities USING (entity) GROUP BY 1",
    )
    return c
