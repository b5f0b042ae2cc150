"""Queries of exposure, national series, gates, dimming, day quality and area uptime."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskgrid.functions import median
from duskgrid.operators import exposure as E
from duskgrid.operators import panel as P
from duskgrid.operators import series as N
from duskgrid.plans.pixels import MASKED, masked

PE = ["v_panel", "v_entities"]
PX = "pe AS (SELECT v.*, e.population, e.demand, e.area, e.region FROM v_panel v JOIN v_entities e ON v.entity = e.entity)"
SHARE = "CASE WHEN SUM({w}) FILTER (WHERE {w} > 0) > 0 THEN COALESCE(SUM({w}) FILTER (WHERE {w} > 0 AND {c}), 0) / SUM({w}) FILTER (WHERE {w} > 0) END"
WMEAN = "SUM({x} * {w}) FILTER (WHERE {w} > 0 AND {x} IS NOT NULL) / SUM({w}) FILTER (WHERE {w} > 0 AND {x} IS NOT NULL)"
EV = "md AS (SELECT entity, QUANTILE_CONT(p, 0.5) AS median_p FROM v_panel GROUP BY 1), ev AS (SELECT * FROM (SELECT pe.*, md.median_p, median_p - p AS drop, CASE WHEN p < 0.05 THEN 'strict' WHEN p < 0.2 THEN 'mostly' END AS class FROM pe JOIN md ON pe.entity = md.entity) z WHERE class IS NOT NULL AND drop >= 0.4)"
XD = "xd AS (SELECT date, mlr / contracted AS shed_share FROM v_exposure)"
DAYQ = "dq AS (SELECT m.date, COUNT(*) AS n, COUNT(*) FILTER (WHERE m.rad IS NOT NULL AND a.rad IS NOT NULL) AS n_common, AVG(CAST(m.rad IS NOT NULL AS INTEGER)) AS valid_share, COUNT(*) FILTER (WHERE m.rad > 3) AS l, COUNT(*) FILTER (WHERE m.rad > 3 AND a.rad <= 3) AS el, COUNT(*) FILTER (WHERE m.rad <= 3 AND a.rad > 3) AS ed, LIST(LN(1 + m.rad) - LN(1 + a.rad)) FILTER (WHERE m.rad IS NOT NULL) AS rs FROM mk m JOIN v_annual a ON a.cell_id = m.cell_id GROUP BY 1), qd AS (SELECT date, n, n_common, valid_share, CASE WHEN n_common > 0 THEN l / n_common END AS lit_share, CASE WHEN n_common > 0 THEN el / n_common END AS excess_lit, CASE WHEN n_common > 0 THEN ed / n_common END AS excess_dark, rs FROM dq)"
AVAIL = "av AS (SELECT x.*, observed_demand / area_demand AS observed_share, CAST(observed_demand / area_demand >= 0.06 AS INTEGER) AS gate_ok FROM (SELECT area, date, COUNT(*) AS n, SUM(demand) AS observed_demand, " + ", ".join(SHARE.format(w="demand", c=f"p >= {t}") + f" AS avail_{round(100 * t):02d}" for t in (0.05, 0.4)) + " FROM pe WHERE coverage >= 0.3 GROUP BY 1, 2) x JOIN (SELECT area, SUM(demand) AS area_demand FROM v_entities GROUP BY 1) t ON t.area = x.area)"
UT = "ut AS (SELECT pe.area, pe.entity, COUNT(*) AS n_days, AVG(CAST(p >= 0.4 AS INTEGER)) AS uptime FROM pe JOIN av ON av.area = pe.area AND av.date = pe.date AND gate_ok = 1 GROUP BY 1, 2 HAVING COUNT(*) >= 100)"


def pe(v):
    return v("v_panel").join(v("v_entities"), "entity")


def events(v):
    med = v("v_panel").groupBy("entity").agg(median("p").alias("median_p"))
    return N.extract_events(pe(v), med, 0.4, [2000, 5000])


def shed(v):
    return v("v_exposure").select("date", E.shed_share(F.col("mlr"), F.col("contracted")).alias("shed_share"))


def total(v):
    return N.universe_totals(N.demand_universe(v("v_entities"), 100))


def zpanel(v):
    base = N.radiance_baseline(v("v_panel"), 5, 10.0)
    return N.down_z(pe(v), base)


ZP = "mm AS (SELECT entity, CAST(DATE_TRUNC('month', date) AS DATE) AS month, QUANTILE_CONT(mean_rad, 0.5) AS med, COUNT(*) AS n_days, STDDEV_SAMP(mean_rad) AS sd FROM v_panel GROUP BY 1, 2), ma AS (SELECT v.entity, mm.month, QUANTILE_CONT(ABS(mean_rad - med), 0.5) * 1.4826 AS mad FROM v_panel v JOIN mm ON mm.entity = v.entity AND mm.month = DATE_TRUNC('month', v.date) GROUP BY 1, 2), rb AS (SELECT mm.*, mad, CASE WHEN n_days >= 5 THEN GREATEST(COALESCE(CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd END, 0), 10, 0.05 * med) END AS sigma FROM mm JOIN ma ON mm.entity = ma.entity AND mm.month = ma.month), zp AS (SELECT pe.*, CASE WHEN sigma > 0 THEN GREATEST(0, (med - mean_rad) / sigma) END AS z FROM pe JOIN rb ON rb.entity = pe.entity AND rb.month = DATE_TRUNC('month', pe.date))"
OD = "tt AS (SELECT SUM(demand) FILTER (WHERE population > 100 AND demand > 0) AS demand_in FROM v_entities), od AS (SELECT x.*, observed_demand / demand_in AS observed_share, CASE WHEN observed_demand / demand_in >= 0.14 THEN 'pass' WHEN observed_demand / demand_in >= 0.1 THEN 'low_confidence' ELSE 'fail' END AS gate_tier FROM (SELECT date, COUNT(*) AS n_observed, SUM(demand) AS observed_demand, " + ", ".join(SHARE.format(w=w, c=f"p < {t}") + f" AS {n}_{k}" for n, t in (("strict", 0.05), ("mostly", 0.2)) for k, w in (("pop", "population"), ("demand", "demand"))) + ", " + WMEAN.format(x="z", w="demand") + " AS z_demand FROM zp WHERE coverage >= 0.3 GROUP BY 1) x, tt)"


def day(v):
    return N.gate_tier(N.observed_demand(zpanel(v), 0.3, total(v)), 0.14, 0.1)


def quality(v):
    return N.day_quality(masked(v), v("v_annual"), 3.0)


def available(v):
    return N.area_availability(v("v_panel"), v("v_entities").select("entity", "area", "demand"), [0.05, 0.4], 0.3, 0.06)


def uptime(v):
    return N.gated_uptime(v("v_panel"), v("v_entities"), available(v), 0.4, 100)


def quiet(v):
    return N.quiet_baseline(v("v_panel").join(shed(v), "date", "left"), 50)


QB = "qb AS (SELECT entity, COUNT(DISTINCT CASE WHEN shed_share = 0 THEN v.date END) AS n_quiet, COUNT(DISTINCT v.date) AS n_days, QUANTILE_CONT(CASE WHEN shed_share = 0 THEN p END, 0.5) AS q, QUANTILE_CONT(p, 0.5) AS a FROM v_panel v LEFT JOIN xd ON xd.date = v.date GROUP BY 1), qe AS (SELECT entity, n_quiet, n_days, CASE WHEN n_quiet >= 50 THEN q ELSE a END AS expected, CASE WHEN n_quiet >= 50 THEN 'no_exposure' ELSE 'all_days' END AS method, CAST(n_days >= 50 AS INTEGER) AS eligible FROM qb), xs AS (SELECT pe.*, GREATEST(0, expected - p) AS excess FROM pe JOIN qe ON qe.entity = pe.entity AND eligible = 1)"


def excess(v):
    return N.excess_dark(pe(v), quiet(v))


def tiers(v):
    x = v("v_exposure").withColumn("month", F.trunc("date", "month"))
    from duskgrid.operators.states import lowest_share

    return N.tiered_baseline(v("v_panel"), lowest_share(x, "mlr", "date", 0.4).select("date"), lowest_share(x, "mlr", "date", 0.05, None).select("date"), 8)


TB = "l1 AS (SELECT date FROM (SELECT date, ROW_NUMBER() OVER (PARTITION BY DATE_TRUNC('month', date) ORDER BY mlr, date) AS r, COUNT(*) OVER (PARTITION BY DATE_TRUNC('month', date)) AS n FROM v_exposure) x WHERE r <= GREATEST(1, CEIL(n * 0.4))), l2 AS (SELECT date FROM (SELECT date, ROW_NUMBER() OVER (ORDER BY mlr, date) AS r, COUNT(*) OVER () AS n FROM v_exposure) x WHERE r <= GREATEST(1, CEIL(n * 0.05))), b1 AS (SELECT entity, CAST(DATE_TRUNC('month', date) AS DATE) AS month, COUNT(*) AS n1, QUANTILE_CONT(p, 0.5) AS m1 FROM v_panel WHERE date IN (SELECT date FROM l1) GROUP BY 1, 2), b2 AS (SELECT entity, COUNT(*) AS n2, QUANTILE_CONT(p, 0.5) AS m2 FROM v_panel WHERE date IN (SELECT date FROM l2) GROUP BY 1), b3 AS (SELECT entity, COUNT(*) AS n3, QUANTILE_CONT(p, 0.5) AS m3 FROM v_panel GROUP BY 1), tb AS (SELECT k.entity, k.month, CASE WHEN n1 >= 8 THEN m1 WHEN n2 >= 8 THEN m2 WHEN n3 >= 8 THEN m3 END AS expected, CASE WHEN n1 >= 8 THEN 'month_low' WHEN n2 >= 8 THEN 'annual_low' WHEN n3 >= 8 THEN 'annual_all' ELSE 'none' END AS source FROM (SELECT DISTINCT entity, CAST(DATE_TRUNC('month', date) AS DATE) AS month FROM v_panel) k LEFT JOIN b1 ON b1.entity = k.entity AND b1.month = k.month LEFT JOIN b2 ON b2.entity = k.entity LEFT JOIN b3 ON b3.entity = k.entity)"


def national(v):
    """One row a date: outcome (share strictly dark by population), exposure share, shedding."""
    return N.daily_base(pe(v)).join(v("v_exposure"), "date").withColumn("shed_share", E.shed_share(F.col("mlr"), F.col("contracted")))


NA = "na AS (SELECT b.*, mlr, contracted, mlr / contracted AS shed_share FROM (SELECT date, COUNT(*) AS n, AVG(p) AS mean_p, QUANTILE_CONT(p, 0.5) AS median_p, " + WMEAN.format(x="p", w="population") + " AS weighted_p, " + ", ".join(SHARE.format(w="population", c=f"p < {t}") + f" AS {n}" for n, t in (("strict_dark", 0.05), ("mostly_dark", 0.2), ("relaxed_dark", 0.4))) + " FROM pe GROUP BY 1) b JOIN v_exposure x ON x.date = b.date)"
PEX = [*PE, "v_exposure"]


def catalog():
    hr = ["v_hourly"]
    c = {}
    c["exp1_window"] = (hr, lambda v: E.window_exposure(v("v_hourly"), [1, 2]).select("date", "n_hours", "mlr_mean", "mlr_sum", "shed_share"), "SELECT date, N(COUNT(*)) AS n_hours, R(AVG(mlr)) AS mlr_mean, R(SUM(mlr)) AS mlr_sum, R(SUM(mlr) / SUM(contracted)) AS shed_share FROM v_hourly WHERE hour IN (1, 2) GROUP BY 1")
    c["exp2_windows"] = (hr, lambda v: E.windows_exposure(v("v_hourly"), {"_00": [0], "_01": [1], "_02": [2], "_13": [1, 2, 3]}).select("date", "mlr_sum_00", "mlr_sum_01", "mlr_sum_02", "mlr_sum_13", "shed_share_13"), "SELECT date, " + ", ".join(f"R(SUM(mlr) FILTER (WHERE hour IN ({h}))) AS mlr_sum_{n}" for n, h in (("00", "0"), ("01", "1"), ("02", "2"), ("13", "1, 2, 3"))) + ", R(SUM(mlr) FILTER (WHERE hour IN (1, 2, 3)) / SUM(contracted) FILTER (WHERE hour IN (1, 2, 3))) AS shed_share_13 FROM v_hourly WHERE hour IN (0, 1, 2, 3) GROUP BY 1")
    c["exp3_shifted"] = (["v_panel", "v_exposure"], lambda v: E.attach_shifted(v("v_panel"), v("v_exposure")).select("entity", "date", "local_date", "mlr"), "SELECT entity, v.date, v.date + 1 AS local_date, R(mlr) AS mlr FROM v_panel v LEFT JOIN v_exposure x ON x.date = v.date + 1")
    c["exp4_leads_lags"] = (["v_exposure"], lambda v: E.leads_and_lags(v("v_exposure"), "mlr", [-1, 0, 1, 2]), "SELECT a.date, I(o) AS offset, R(b.mlr) AS mlr FROM v_exposure a CROSS JOIN (SELECT UNNEST([-1, 0, 1, 2]) AS o) k LEFT JOIN v_exposure b ON b.date = a.date + CAST(o AS INTEGER)")
    c["exp5_centred"] = (hr, lambda v: E.centred_window(v("v_hourly"), v("v_hourly").select("date").distinct(), 1, -2, 2), ", d AS (SELECT DISTINCT date FROM v_hourly), k AS (SELECT d.date, d.date + CAST(FLOOR((1 + o) / 24.0) AS INTEGER) AS dd, ((1 + o) % 24 + 24) % 24 AS hh FROM d, (SELECT UNNEST([-2, -1, 0, 1, 2]) AS o) q) SELECT k.date, N(COUNT(mlr)) AS n_hours, R(SUM(mlr)) AS mlr_sum, R(SUM(contracted)) AS contracted_sum, R(SUM(mlr) / SUM(contracted)) AS shed_share FROM k LEFT JOIN v_hourly h ON h.date = dd AND h.hour = hh GROUP BY 1")
    c["exp6_stage"] = (["v_exposure"], lambda v: E.implied_stage(v("v_exposure").withColumn("mw", F.col("mlr") / 200), "mw").select("date", "stage"), "SELECT date, I(CASE WHEN mlr <= 0 THEN 0 ELSE LEAST(8, CEIL(mlr / 200 / 1000)) END) AS stage FROM v_exposure")
    c["exp7_schedule_days"] = (["v_schedule"], lambda v: E.schedule_days(v("v_schedule")), "SELECT circuit, CAST(start AS DATE) AS date, R(SUM(minutes)) AS minutes, N(COUNT(*)) AS n_events FROM v_schedule GROUP BY 1, 2")
    OV = "ov AS (SELECT * FROM (SELECT circuit, date, SUM(GREATEST(0, LEAST(b, EPOCH_US(CAST(date AS TIMESTAMP)) / 1e6 + 10800) - GREATEST(a, EPOCH_US(CAST(date AS TIMESTAMP)) / 1e6 + 3600))) AS overlap_s FROM (SELECT circuit, CAST(UNNEST(GENERATE_SERIES(CAST(CAST(start AS DATE) AS TIMESTAMP), CAST(CAST(MAKE_TIMESTAMP(EPOCH_US(start) + CAST(ROUND(minutes * 60 * 1000000) AS BIGINT)) AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date, EPOCH_US(start) / 1e6 AS a, EPOCH_US(start) / 1e6 + minutes * 60 AS b FROM v_schedule WHERE minutes > 0) s GROUP BY 1, 2) z WHERE overlap_s > 1e-9)"
    c["exp8_overlap"] = (["v_schedule"], lambda v: E.window_overlap(v("v_schedule"), 1, 3).select("circuit", "date", F.round("overlap_s", 2).alias("overlap_s")), f", {OV} SELECT circuit, date, ROUND(overlap_s, 2) AS overlap_s FROM ov")
    c["exp9_attach_schedule"] = (
        ["v_schedule"],
        lambda v: E.attach_schedule(v("v_schedule").select("circuit", F.date_sub(F.to_date("start"), 1).alias("date")).distinct(), E.schedule_days(v("v_schedule")), E.window_overlap(v("v_schedule"), 1, 3)).select("circuit", "date", "minutes", F.col("n_events").cast("long").alias("n_events"), "any_day", "any_overpass"),
        f", {OV}, d AS (SELECT circuit, CAST(start AS DATE) AS date, SUM(minutes) AS minutes, COUNT(*) AS n FROM v_schedule GROUP BY 1, 2) SELECT d.circuit, d.date - 1 AS date, R(minutes) AS minutes, N(n) AS n_events, I(minutes > 0) AS any_day, I(COALESCE(overlap_s, 0) > 0) AS any_overpass FROM d LEFT JOIN ov ON ov.circuit = d.circuit AND ov.date = d.date",
    )
    c["exp10_citywide"] = (["v_schedule"], lambda v: E.citywide_schedule(v("v_schedule")), "SELECT CAST(start AS DATE) AS date, R(SUM(minutes)) AS minutes, N(COUNT(*)) AS n_events, N(COUNT(DISTINCT circuit)) AS n_circuits FROM v_schedule GROUP BY 1")
    c["exp11_overpass"] = (hr, lambda v: E.overpass_exposure(v("v_hourly")).select("date", "shed_share"), "SELECT date, R(SUM(mlr) / (SUM(mlr) + SUM(contracted))) AS shed_share FROM v_hourly WHERE hour IN (1, 2) GROUP BY 1")
    c["nat1_daily_base"] = (PEX, lambda v: national(v).drop("mlr", "contracted", "shed_share"), f", {PX}, {NA} SELECT date, N(n) AS n, R(mean_p) AS mean_p, R(median_p) AS median_p, R(weighted_p) AS weighted_p, R(strict_dark) AS strict_dark, R(mostly_dark) AS mostly_dark, R(relaxed_dark) AS relaxed_dark FROM na")
    ET = "et AS (SELECT date, s AS size, COUNT(*) AS n, COUNT(*) FILTER (WHERE p < 0.05) AS n_dark, COALESCE(SUM(population) FILTER (WHERE p < 0.05), 0) AS dark_population FROM pe, (SELECT UNNEST([1000.0, 3000.0, 5000.0]) AS s) k WHERE population >= s GROUP BY 1, 2)"
    c["nat2_event_table"] = (PE, lambda v: N.event_table(pe(v), [1000.0, 3000.0, 5000.0]), f", {PX}, {ET} SELECT date, R(size) AS size, N(n) AS n, N(n_dark) AS n_dark, R(dark_population) AS dark_population FROM et")
    c["nat3_event_totals"] = (PE, lambda v: N.event_totals(N.event_table(pe(v), [1000.0, 3000.0, 5000.0])), f", {PX}, {ET} SELECT R(size) AS size, N(SUM(n_dark)) AS n_dark, N(COUNT(*) FILTER (WHERE n_dark > 0)) AS event_days, N(MAX(n_dark)) AS most FROM et GROUP BY 1")
    c["nat4_events"] = (PE, lambda v: events(v).select("entity", "date", "class", "drop", "over_2000", "over_5000"), f", {PX}, {EV} SELECT entity, date, class, R(drop) AS drop, I(COALESCE(population >= 2000, FALSE)) AS over_2000, I(COALESCE(population >= 5000, FALSE)) AS over_5000 FROM ev")
    CD = "cd AS (SELECT entity, date, type, drop3 AS neighbour_drop, drop3 * mc AS score FROM (SELECT *, CASE WHEN drop3 >= 0.4 THEN 'sharp_dip' WHEN p < 0.2 AND LEAST(pp, np) < 0.2 THEN 'sustained' END AS type FROM (SELECT v.entity, v.date, v.p, a.p AS pp, b.p AS np, LEAST(a.coverage, v.coverage, b.coverage) AS mc, LEAST(a.p, b.p) - v.p AS drop3 FROM v_panel v JOIN v_panel a ON a.entity = v.entity AND a.date = v.date - 1 JOIN v_panel b ON b.entity = v.entity AND b.date = v.date + 1) x WHERE mc >= 0.1) y WHERE type IS NOT NULL)"
    cand = lambda v: N.candidates(P.neighbours(v("v_panel"), ["p", "coverage"]), 0.1, 0.4)
    c["nat5_candidates"] = (["v_panel"], lambda v: cand(v).select("entity", "date", "type", "neighbour_drop", "score"), f", {CD} SELECT entity, date, type, R(neighbour_drop) AS neighbour_drop, R(score) AS score FROM cd")
    c["nat6_top_by_type"] = (["v_panel", "v_entities"], lambda v: N.top_by_type(cand(v), v("v_entities").where("population is null"), 5).select("type", "rank", "entity", "date"), f", {CD}, f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY type, entity ORDER BY score DESC, date) AS r FROM cd WHERE entity NOT IN (SELECT entity FROM v_entities WHERE population IS NULL)), g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY type ORDER BY score DESC, entity) AS k FROM f WHERE r = 1) SELECT type, I(k) AS rank, entity, date FROM g WHERE k <= 5")
    c["nat7_event_windows"] = (PE, lambda v: N.event_windows(events(v), v("v_panel")), f", {PX}, {EV} SELECT ev.entity, ev.date AS event_date, I(o) AS offset, R(v.p) AS p FROM ev CROSS JOIN (SELECT UNNEST([-1, 0, 1]) AS o) k LEFT JOIN v_panel v ON v.entity = ev.entity AND v.date = ev.date + CAST(o AS INTEGER)")
    WINDOWS = "ew AS (SELECT ev.entity, ev.date AS event_date, MAX(v.p) FILTER (WHERE o = -1) AS b, MAX(v.p) FILTER (WHERE o = 0) AS e, MAX(v.p) FILTER (WHERE o = 1) AS a FROM ev CROSS JOIN (SELECT UNNEST([-1, 0, 1]) AS o) k LEFT JOIN v_panel v ON v.entity = ev.entity AND v.date = ev.date + CAST(o AS INTEGER) GROUP BY 1, 2)"
    c["nat7_event_summary"] = (PE, lambda v: N.event_summary(N.event_windows(events(v), v("v_panel"))), f", {PX}, {EV}, {WINDOWS} SELECT entity, N(COUNT(*)) AS n_events, R(AVG(b)) AS mean_before, R(AVG(e)) AS mean_event, R(AVG(a)) AS mean_after, R(AVG(b - e)) AS mean_drop, R(AVG(a - e)) AS mean_recovery, N(COUNT(*) FILTER (WHERE b IS NOT NULL AND a IS NOT NULL)) AS n_whole FROM ew GROUP BY 1")
    c["nat8_headline"] = (PEX, lambda v: N.daily_base(pe(v).where("population > 100")).join(shed(v), "date").select("date", "weighted_p", "strict_dark", "shed_share"), f", {PX}, {NA.replace('FROM pe', 'FROM pe WHERE population > 100')} SELECT date, R(weighted_p) AS weighted_p, R(strict_dark) AS strict_dark, R(shed_share) AS shed_share FROM na")
    c["nat9_top_days"] = (PE, lambda v: N.event_table(pe(v), [1000.0]).orderBy(F.desc("dark_population"), "date").limit(15).select("date", "n_dark", "dark_population"), f", {PX}, {ET} SELECT date, N(n_dark) AS n_dark, R(dark_population) AS dark_population FROM et WHERE size = 1000 ORDER BY et.dark_population DESC, date LIMIT 15")
    c["nat10_threshold_outcomes"] = (PE, lambda v: N.threshold_outcomes(pe(v), [0.05, 0.2, 0.6, 0.9], "demand"), f", {PX} SELECT date, " + ", ".join("R(" + SHARE.format(w="demand", c=f"p < {t}") + f") AS below_{round(100 * t):02d}" for t in (0.05, 0.2, 0.6, 0.9)) + " FROM pe GROUP BY 1")
    c["nat11_recomputed"] = (PEX, lambda v: N.largest_difference(shed(v), v("v_exposure").select("date", E.shed_share(F.col("mlr"), F.col("contracted"), "total").alias("shed_share")), ["date"], "shed_share"), "SELECT N(COUNT(*)) AS n, R(MAX(ABS(mlr / contracted - mlr / (mlr + contracted)))) AS max_abs_diff FROM v_exposure")
    c["nat12_recurrence"] = (PE, lambda v: N.recurrence(events(v), ["class", "entity"]), f", {PX}, {EV} SELECT class, entity, N(COUNT(*)) AS n_events, R(SUM(population)) AS population, N(COUNT(DISTINCT entity)) AS n_entities FROM ev GROUP BY 1, 2")
    c["nat12_top_days"] = (PE, lambda v: N.recurrence(events(v), ["date"], 20), f", {PX}, {EV} SELECT date, N(COUNT(*)) AS n_events, R(SUM(population)) AS population, N(COUNT(DISTINCT entity)) AS n_entities FROM ev GROUP BY 1 ORDER BY COUNT(*) DESC, date LIMIT 20")
    c["nat13_priority"] = (PE, lambda v: N.priority(events(v), "class", 6).select("class", "rank", "entity", "date"), f", {PX}, {EV}, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY drop DESC, date) AS r FROM ev), g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY class ORDER BY drop DESC, entity) AS k FROM o WHERE r = 1) SELECT class, I(k) AS rank, entity, date FROM g WHERE k <= 6")
    c["nat14_edge_bins"] = (["v_panel"], lambda v: N.edge_bins(v("v_panel"), "mean_rad", "p", [0, 0.25, 0.5, 0.75, 1]), ", e AS (SELECT QUANTILE_CONT(mean_rad, [0.25, 0.5, 0.75]) AS q FROM v_panel) SELECT I(1 + CAST(mean_rad > q[1] AS INTEGER) + CAST(mean_rad > q[2] AS INTEGER) + CAST(mean_rad > q[3] AS INTEGER)) AS bin, N(COUNT(*)) AS n, R(AVG(mean_rad)) AS mean_x, R(AVG(p)) AS mean_y FROM v_panel, e GROUP BY 1")
    c["nat15_keep_status"] = (["v_entities"], lambda v: N.keep_status(v("v_entities"), v("v_entities").where("demand > 4000"), v("v_entities").where("population < 6000")).select("entity", "status"), "SELECT entity, CASE WHEN demand > 4000 AND COALESCE(population < 6000, FALSE) THEN 'both' WHEN demand > 4000 THEN 'a_only' WHEN population < 6000 THEN 'b_only' ELSE 'neither' END AS status FROM v_entities")
    c["gat1_universe"] = (["v_entities"], total, "SELECT N(COUNT(*)) AS n, N(COUNT(*) FILTER (WHERE population > 100 AND demand > 0)) AS n_in, R(SUM(demand) FILTER (WHERE population > 100 AND demand > 0)) AS demand_in, R(SUM(demand)) AS demand, R(SUM(population) FILTER (WHERE population > 100 AND demand > 0)) AS population_in FROM v_entities")
    c["gat2_radiance_baseline"] = (PE, lambda v: N.radiance_baseline(v("v_panel"), 5, 10.0), f", {PX}, {ZP} SELECT entity, month, R(med) AS med, N(n_days) AS n_days, R(sd) AS sd, R(mad) AS mad, R(sigma) AS sigma FROM rb")
    c["gat3_down_z"] = (PE, lambda v: zpanel(v).select("entity", "date", "z"), f", {PX}, {ZP} SELECT entity, date, R(z) AS z FROM zp")
    cols = "date, N(n_observed) AS n_observed, R(observed_demand) AS observed_demand, R(strict_pop) AS strict_pop, R(strict_demand) AS strict_demand, R(mostly_pop) AS mostly_pop, R(mostly_demand) AS mostly_demand, R(z_demand) AS z_demand, R(observed_share) AS observed_share"
    c["gat4_observed_demand"] = (PE, lambda v: day(v).drop("gate_tier"), f", {PX}, {ZP}, {OD} SELECT {cols} FROM od")
    c["gat5_gate_tier"] = (PE, lambda v: day(v).select("date", "gate_tier"), f", {PX}, {ZP}, {OD} SELECT date, gate_tier FROM od")
    c["gat7_monthly"] = (PE, lambda v: N.monthly_gate(day(v)), f", {PX}, {ZP}, {OD} SELECT CAST(DATE_TRUNC('month', date) AS DATE) AS month, N(COUNT(*)) AS n, " + ", ".join(f"N(COUNT(*) FILTER (WHERE gate_tier = '{t}')) AS n_{t}" for t in ("pass", "low_confidence", "fail")) + ", R(AVG(observed_share)) AS mean_share FROM od GROUP BY 1")
    c["gat9_summary"] = (["v_entities"], lambda v: N.key_values(total(v)), ", t AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE population > 100 AND demand > 0) AS n_in, SUM(demand) FILTER (WHERE population > 100 AND demand > 0) AS demand_in, SUM(demand) AS demand, SUM(population) FILTER (WHERE population > 100 AND demand > 0) AS population_in FROM v_entities) SELECT 'n' AS metric, R(n) AS value FROM t UNION ALL SELECT 'n_in', R(n_in) FROM t UNION ALL SELECT 'demand_in', R(demand_in) FROM t UNION ALL SELECT 'demand', R(demand) FROM t UNION ALL SELECT 'population_in', R(population_in) FROM t")
    c["dim1_quiet_baseline"] = (PEX, quiet, f", {XD}, {PX}, {QB} SELECT entity, N(n_quiet) AS n_quiet, N(n_days) AS n_days, R(expected) AS expected, method, I(eligible) AS eligible FROM qe")
    c["dim2_excess_dark"] = (PEX, lambda v: excess(v).select("entity", "date", "excess", "shortfall"), f", {XD}, {PX}, {QB} SELECT entity, date, R(excess) AS excess, I(excess > 0.2) AS shortfall FROM xs")
    c["dim3_excess_daily"] = (PEX, lambda v: N.excess_daily(excess(v), v("v_entities").agg(F.sum("population").alias("total"))), f", {XD}, {PX}, {QB} SELECT date, R(SUM(population)) AS observed_weight, R(SUM(population * excess) / SUM(population)) AS excess_observed, R(SUM(population * excess) / (SELECT SUM(population) FROM v_entities)) AS excess_fixed FROM xs GROUP BY 1")
    c["dim4_tiered_baseline"] = (PEX, tiers, f", {TB} SELECT entity, month, R(expected) AS expected, source FROM tb")
    c["dim5_series"] = (PEX, lambda v: N.dimming_series(pe(v), tiers(v)), f", {PX}, {TB}, dd AS (SELECT pe.date, p, population, expected - p AS s, CASE WHEN expected IS NOT NULL THEN GREATEST(0, expected - p) END AS d FROM pe JOIN tb ON tb.entity = pe.entity AND tb.month = DATE_TRUNC('month', pe.date)) SELECT date, " + ", ".join("R(" + WMEAN.format(x=x, w="population") + f") AS {n}" for x, n in (("p", "raw"), ("s", "signed"), ("d", "down_only"))) + " FROM dd GROUP BY 1")
    c["dim6_source_shares"] = (PEX, lambda v: N.source_shares(tiers(v)), f", {TB} SELECT source, N(COUNT(*)) AS n, R(COUNT(*) / SUM(COUNT(*)) OVER ()) AS share FROM tb GROUP BY 1")
    c["dim7_dose_bins"] = (PEX, lambda v: N.dose_bins(national(v), "shed_share", "strict_dark", "date", 10), f", {PX}, {NA}, b AS (SELECT *, NTILE(10) OVER (ORDER BY shed_share, date) AS bin FROM na WHERE strict_dark IS NOT NULL AND shed_share IS NOT NULL), g AS (SELECT bin, COUNT(*) AS n, AVG(shed_share) AS mx, AVG(strict_dark) AS my, STDDEV_SAMP(strict_dark) / SQRT(COUNT(*)) AS se FROM b GROUP BY 1) SELECT I(bin) AS bin, N(n) AS n, R(mx) AS mean_x, R(my) AS mean_y, R(se) AS se, R(my - 1.96 * se) AS low, R(my + 1.96 * se) AS high FROM g")
    c["dim8_relative_bins"] = (PEX, lambda v: N.relative_bins(national(v), "shed_share", "strict_dark", "date", 10), f", {PX}, {NA}, b AS (SELECT strict_dark, shed_share, CASE WHEN shed_share <= 0 THEN 0 ELSE NTILE(10) OVER (PARTITION BY shed_share <= 0 ORDER BY shed_share, date) END AS bin FROM na WHERE strict_dark IS NOT NULL AND shed_share IS NOT NULL), g AS (SELECT bin, COUNT(*) AS n, AVG(shed_share) AS mx, AVG(strict_dark) AS my, VAR_SAMP(strict_dark) / COUNT(*) AS v FROM b GROUP BY 1), z AS (SELECT my AS m0, v AS v0 FROM g WHERE bin = 0) SELECT I(bin) AS bin, N(n) AS n, R(mx) AS mean_x, R(my) AS mean_y, R(my - m0) AS excess, R(SQRT(v + CASE WHEN bin > 0 THEN v0 ELSE 0 END)) AS se FROM g, z")
    c["dim9_stage_summary"] = (PEX, lambda v: N.stage_summary(E.implied_stage(national(v).withColumn("mw", F.col("mlr") / 200), "mw"), "strict_dark", "shed_share"), f", {PX}, {NA}, s AS (SELECT CASE WHEN mlr <= 0 THEN 0 ELSE LEAST(8, CEIL(mlr / 200 / 1000)) END AS stage, strict_dark, shed_share FROM na), g AS (SELECT stage, COUNT(*) AS n, AVG(strict_dark) AS my, AVG(shed_share) AS me FROM s GROUP BY 1), z AS (SELECT my AS m0 FROM g WHERE stage = 0) SELECT I(stage) AS stage, N(n) AS n, R(my) AS mean_y, R(me) AS mean_exposure, R(my - m0) AS excess, R(CASE WHEN me > 0 THEN (my - m0) / me END) AS capture FROM g, z")
    pa = ["v_pixels", "v_annual"]
    qs = ", ".join(f"R(LIST_AGGREGATE(rs, 'quantile_cont', {q})) AS {n}" for q, n in ((0.05, "p05"), (0.5, "p50"), (0.9, "p90"), (0.95, "p95")))
    c["qa1_day_quality"] = (pa, quality, f", {MASKED}, {DAYQ} SELECT date, N(n) AS n, N(n_common) AS n_common, R(valid_share) AS valid_share, R(lit_share) AS lit_share, R(excess_lit) AS excess_lit, R(excess_dark) AS excess_dark, R(LIST_AVG(rs)) AS mean, R(SQRT(LIST_AVG(LIST_TRANSFORM(rs, lambda x: x * x)))) AS rmse, R(LIST_AVG(LIST_TRANSFORM(rs, lambda x: ABS(x)))) AS mae, R(LIST_AVG(LIST_TRANSFORM(rs, lambda x: CAST(ABS(x) > 1 AS INTEGER)))) AS tail, {qs} FROM qd")
    ROB = "m1 AS (SELECT DATE_TRUNC('month', date) AS mo, QUANTILE_CONT(valid_share, 0.5) AS med, COUNT(*) AS k, AVG(valid_share) AS av, STDDEV_SAMP(valid_share) AS sd FROM qd GROUP BY 1), m2 AS (SELECT mo, QUANTILE_CONT(ABS(valid_share - med), 0.5) * 1.4826 AS md FROM qd JOIN m1 ON mo = DATE_TRUNC('month', date) GROUP BY 1), rz AS (SELECT qd.date, valid_share, excess_lit, CASE WHEN k < 3 THEN NULL WHEN md > 0 THEN (valid_share - med) / md WHEN sd > 0 THEN (valid_share - av) / sd END AS z FROM qd JOIN m1 ON m1.mo = DATE_TRUNC('month', qd.date) JOIN m2 ON m2.mo = m1.mo)"
    rob = lambda v: N.robust_z(quality(v).withColumn("month", F.trunc("date", "month")), "valid_share", ["month"])
    c["qa2_robust_z"] = (pa, lambda v: rob(v).select("date", F.col("z_valid_share").alias("z")), f", {MASKED}, {DAYQ}, {ROB} SELECT date, R(z) AS z FROM rz")
    c["qa3_composite"] = (pa, lambda v: N.composite(rob(v), ["z_valid_share", "excess_lit"]).select("date", "score", "tier"), f", {MASKED}, {DAYQ}, {ROB}, sc AS (SELECT date, CASE WHEN z IS NULL AND excess_lit IS NULL THEN NULL ELSE GREATEST(ABS(z), ABS(excess_lit)) END AS score FROM rz), q AS (SELECT QUANTILE_CONT(score, 0.9) AS a, QUANTILE_CONT(score, 0.95) AS b FROM sc) SELECT date, R(score) AS score, CASE WHEN score >= b THEN 'suspect' WHEN score >= a THEN 'review' ELSE 'ok' END AS tier FROM sc, q")
    c["qa4_reasons"] = (pa, lambda v: N.reasons(quality(v), {"few_valid": F.col("valid_share") < 0.3, "excess_lit": F.col("excess_lit") > 0.2}).select("date", "reasons"), f", {MASKED}, {DAYQ} SELECT date, COALESCE(NULLIF(CONCAT_WS(';', CASE WHEN valid_share < 0.3 THEN 'few_valid' END, CASE WHEN excess_lit > 0.2 THEN 'excess_lit' END), ''), 'none') AS reasons FROM qd")
    c["qa5_retained"] = ([*pa, "v_exposure"], lambda v: N.retained(quality(v), {"all": F.lit(True), "seen": F.col("valid_share") > 0.45}, v("v_exposure").where("mlr > 0")), f", {MASKED}, {DAYQ}, s AS (SELECT 'all' AS scenario, date FROM qd UNION ALL SELECT 'seen', date FROM qd WHERE valid_share > 0.45), g AS (SELECT scenario, DATE_TRUNC('month', s.date) AS mo, COUNT(*) AS n, COUNT(x.date) AS m FROM s LEFT JOIN v_exposure x ON x.date = s.date AND mlr > 0 GROUP BY 1, 2) SELECT scenario, N(SUM(n)) AS n_days, N(SUM(m)) AS n_matched, N(MIN(n)) AS min_month, I(MIN(n) < 10) AS warn FROM g GROUP BY 1")
    c["qa6_missing_dates"] = (["v_exposure"], lambda v: N.missing_dates(v("v_exposure").where("mlr > 0")), ", k AS (SELECT date FROM v_exposure WHERE mlr > 0) SELECT CAST(d AS DATE) AS date FROM (SELECT UNNEST(GENERATE_SERIES((SELECT MIN(date) FROM k), (SELECT MAX(date) FROM k), INTERVAL 1 DAY)) AS d) x WHERE CAST(d AS DATE) NOT IN (SELECT date FROM k)")
    c["qa7_tukey"] = (["v_exposure"], lambda v: N.tukey_flags(v("v_exposure").withColumn("month", F.trunc("date", "month")), "mlr", [0.0, 0.5, 1.5], ["month"]), ", q AS (SELECT DATE_TRUNC('month', date) AS mo, QUANTILE_CONT(mlr, 0.25) AS a, QUANTILE_CONT(mlr, 0.75) AS b FROM v_exposure GROUP BY 1) SELECT R(k) AS k, date, I(mlr > b + k * (b - a)) AS remove FROM v_exposure JOIN q ON mo = DATE_TRUNC('month', date), (SELECT UNNEST([0.0, 0.5, 1.5]) AS k) z")
    c["qa8_methods"] = (
        ["v_exposure"],
        lambda v: N.flag_methods(v("v_exposure"), ["mlr", "contracted"], 2.5),
        ", l AS (SELECT date, DATE_TRUNC('month', date) AS mo, 'mlr' AS metric, mlr AS x FROM v_exposure UNION ALL SELECT date, DATE_TRUNC('month', date), 'contracted', contracted FROM v_exposure), sc AS (SELECT 'monthly' AS scope, metric, CAST(mo AS VARCHAR) AS g, date, x FROM l UNION ALL SELECT 'annual', metric, 'all', date, x FROM l), a AS (SELECT scope, metric, g, QUANTILE_CONT(x, 0.5) AS med, COUNT(*) AS n, AVG(x) AS av, STDDEV_SAMP(x) AS sd, QUANTILE_CONT(x, 0.25) AS q1, QUANTILE_CONT(x, 0.75) AS q3 FROM sc GROUP BY 1, 2, 3), b AS (SELECT sc.scope, sc.metric, sc.g, QUANTILE_CONT(ABS(x - med), 0.5) * 1.4826 AS md FROM sc JOIN a USING (scope, metric, g) GROUP BY 1, 2, 3), f AS (SELECT scope, metric, CASE WHEN n < 3 THEN FALSE WHEN md > 0 THEN ABS((x - med) / md) > 2.5 WHEN sd > 0 THEN ABS((x - av) / sd) > 2.5 ELSE FALSE END AS f1, sd > 0 AND ABS((x - av) / sd) > 2.5 AS f2, x > q3 + 1.5 * (q3 - q1) AS f3 FROM sc JOIN a USING (scope, metric, g) JOIN b USING (scope, metric, g)) SELECT 'median_mad' AS method, scope, metric, N(COUNT(*)) AS n_days FROM f WHERE f1 GROUP BY 2, 3 UNION ALL SELECT 'mean_sd', scope, metric, N(COUNT(*)) FROM f WHERE f2 GROUP BY 2, 3 UNION ALL SELECT 'tukey', scope, metric, N(COUNT(*)) FROM f WHERE f3 GROUP BY 2, 3",
    )
    c["qa9_top_dates"] = (["v_exposure"], lambda v: N.top_dates(v("v_exposure"), ["mlr", "contracted"], 12), ", l AS (SELECT date, 'mlr' AS metric, mlr AS value FROM v_exposure UNION ALL SELECT date, 'contracted', contracted FROM v_exposure), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY value DESC, date) AS k FROM l) SELECT date, metric, R(value) AS value, I(k) AS rank FROM r WHERE k <= 12")
    av = f", {PX}, {AVAIL}"
    c["up1_availability"] = (PE, lambda v: available(v).select("area", "date", "n", "observed_share", "avail_05", "avail_40", "gate_ok"), f"{av} SELECT area, date, N(n) AS n, R(observed_share) AS observed_share, R(avail_05) AS avail_05, R(avail_40) AS avail_40, I(gate_ok) AS gate_ok FROM av")
    c["up2_gated_uptime"] = (PE, uptime, f"{av}, {UT} SELECT area, entity, N(n_days) AS n_days, R(uptime) AS uptime FROM ut")
    c["up3_two_ways"] = (PE, lambda v: N.two_ways(uptime(v), available(v), v("v_entities"), "avail_40"), f"{av}, {UT}, a AS (SELECT ut.area, " + WMEAN.format(x="uptime", w="demand") + " AS ef, COUNT(*) AS ne FROM ut JOIN v_entities e ON e.entity = ut.entity GROUP BY 1), b AS (SELECT area, AVG(avail_40) AS df, COUNT(*) AS nd FROM av WHERE gate_ok = 1 GROUP BY 1) SELECT COALESCE(a.area, b.area) AS area, R(ef) AS entity_first, N(ne) AS n_entities, R(df) AS daily_first, N(nd) AS n_days, R(ef - df) AS delta FROM a FULL JOIN b ON a.area = b.area")
    c["up4_support"] = (PE, lambda v: N.support_summary(available(v)), f"{av} SELECT area, N(COUNT(*)) AS n_days, N(SUM(gate_ok)) AS n_gated, R(QUANTILE_CONT(observed_share, 0.1)) AS p10, R(QUANTILE_CONT(observed_share, 0.5)) AS p50, R(QUANTILE_CONT(observed_share, 0.9)) AS p90 FROM av GROUP BY 1")
    c["up5_gate_sensitivity"] = (PE, lambda v: N.gate_sensitivity(available(v), [0.1, 0.3, 0.6], "avail_40"), f"{av} SELECT R(g) AS gate, N(COUNT(*)) AS n_area_days, N(COUNT(DISTINCT area)) AS n_areas, N(COUNT(DISTINCT date)) AS n_dates, R(SUM(avail_40 * observed_demand) / SUM(observed_demand)) AS availability FROM av, (SELECT UNNEST([0.1, 0.3, 0.6]) AS g) k WHERE observed_share >= g GROUP BY 1")
    c["up6_outage_sensitivity"] = (PE, lambda v: N.outage_sensitivity(v("v_panel"), v("v_entities").select("entity", "area", "demand"), [0.05, 0.2, 0.6], available(v)), f"{av} SELECT pe.area, R(t) AS cut, R(COALESCE(SUM(demand) FILTER (WHERE p >= t), 0) / SUM(demand)) AS availability FROM pe JOIN av ON av.area = pe.area AND av.date = pe.date AND gate_ok = 1, (SELECT UNNEST([0.05, 0.2, 0.6]) AS t) k WHERE demand > 0 GROUP BY 1, 2")
    run_ = lambda d: d.groupBy("area", F.year("date").alias("year")).agg(F.avg("avail_40").alias("availability"))
    c["up7_compare_runs"] = (PE, lambda v: N.compare_runs(run_(available(v)), run_(available(v).where("gate_ok = 1")), ["area", "year"], "availability"), f"{av}, a AS (SELECT area, YEAR(date) AS year, AVG(avail_40) AS x, AVG(avail_40) FILTER (WHERE gate_ok = 1) AS y FROM av GROUP BY 1, 2) SELECT area, I(year) AS year, R(x) AS baseline, R(y) AS excluded, R(100 * (y - x)) AS delta_pp FROM a")
    c["up8_coverage_scenarios"] = (
        PEX,
        lambda v: N.coverage_scenarios(available(v).withColumnRenamed("observed_share", "coverage_share"), v("v_exposure").where("mlr = 0")),
        f"{av}, k AS (SELECT av.*, x.date IS NULL AS ok FROM av LEFT JOIN v_exposure x ON x.date = av.date AND mlr = 0) SELECT area, N(COUNT(*)) AS all_n, R(AVG(observed_share)) AS all_mean, R(QUANTILE_CONT(observed_share, 0.5)) AS all_p50, N(COUNT(*) FILTER (WHERE ok)) AS excluded_n, R(AVG(observed_share) FILTER (WHERE ok)) AS excluded_mean, R(QUANTILE_CONT(observed_share, 0.5) FILTER (WHERE ok)) AS excluded_p50 FROM k GROUP BY 1",
    )
    c["up9_gate_wide"] = (PE, lambda v: N.gate_uptime_wide(available(v), [0.0, 0.1, 0.3], "avail_40"), f"{av} SELECT area, R(AVG(avail_40)) AS g00, R(AVG(avail_40) FILTER (WHERE observed_share >= 0.1)) AS g10, R(AVG(avail_40) FILTER (WHERE observed_share >= 0.3)) AS g30, R(AVG(avail_40) FILTER (WHERE observed_share >= 0.3) - AVG(avail_40)) AS delta FROM av GROUP BY 1")
    GATES = "ga AS (SELECT area, gate, COUNT(*) FILTER (WHERE observed_share >= gate) AS n_pass, COUNT(*) AS n_days, AVG(avail_40) FILTER (WHERE observed_share >= gate) AS availability FROM av, (SELECT UNNEST([0.0, 0.1, 0.3]) AS gate) k GROUP BY 1, 2)"
    dates = lambda v: N.gate_uptime_dates(available(v), [0.0, 0.1, 0.3], "avail_40")
    c["up9_gate_dates"] = (PE, dates, f"{av}, {GATES} SELECT area, R(gate) AS gate, N(n_pass) AS n_pass, N(n_days) AS n_days, R(availability) AS availability FROM ga")
    c["up9_gate_national"] = (PE, lambda v: N.gate_uptime_national(dates(v), v("v_entities").groupBy("area").agg(F.sum("demand").alias("weight"))), f"{av}, {GATES}, aw AS (SELECT area, SUM(demand) AS w FROM v_entities GROUP BY 1) SELECT R(gate) AS gate, N(COUNT(availability)) AS n_areas, N(SUM(n_pass)) AS n_pass, N(SUM(n_days)) AS n_days, R(SUM(availability * w) FILTER (WHERE w > 0 AND availability IS NOT NULL) / SUM(w) FILTER (WHERE w > 0 AND availability IS NOT NULL)) AS weighted, R(MIN(availability)) AS lowest, R(MAX(availability)) AS highest FROM ga JOIN aw ON aw.area = ga.area GROUP BY 1")
    c["up10_export_audit"] = (PE, lambda v: N.export_audit(N.support_summary(available(v)).where("area <> 'CHINA'"), v("v_entities").where("population > 3000").select("area"), 1400), f"{av}, r AS (SELECT area, COUNT(*) AS n_days FROM av WHERE area <> 'CHINA' GROUP BY 1), w AS (SELECT DISTINCT area FROM v_entities WHERE population > 3000) SELECT COALESCE(r.area, w.area) AS area, N(n_days) AS n_days, CASE WHEN r.area IS NULL THEN 'blocked:missing' WHEN w.area IS NULL THEN 'blocked:unknown_name' WHEN n_days < 1400 THEN 'blocked:few_days' ELSE 'ready' END AS status FROM r FULL JOIN w ON r.area = w.area")
    c["up11_national"] = (PE, lambda v: N.national_summary(available(v).groupBy("area").agg(F.avg("avail_40").alias("a"), F.sum("observed_demand").alias("w")), "a", "w"), f"{av}, a AS (SELECT area, AVG(avail_40) AS a, SUM(observed_demand) AS w FROM av GROUP BY 1) SELECT N(COUNT(a)) AS n_areas, R(SUM(a * w) / SUM(w)) AS weighted, R(AVG(a)) AS mean, R(MIN(a)) AS lowest, R(MAX(a)) AS highest FROM a")
    return c
