"""Queries of pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskgrid.operators import overlay
from duskgrid.operators import pixels as X
from duskgrid.sources import io

_OK = "mandatory_qf <= 1 AND snow = 0 AND (qf_cloud >> 6) & 3 <= 1 AND (qf_cloud >> 8) & 1 = 0 AND (qf_cloud >> 9) & 1 = 0 AND (qf_cloud >> 10) & 1 = 0 AND (qf_cloud >> 12) & 1 = 0 AND (qf_cloud >> 13) & 1 = 0"
_LOOSE = "mandatory_qf <= 2 AND snow = 0 AND (qf_cloud >> 6) & 3 <= 2"
MASKED = f"mk AS (SELECT cell_id, date, valid, CASE WHEN valid = 1 THEN rad END AS rad, CASE WHEN valid = 1 THEN CAST(rad > 3 AS INTEGER) END AS lit FROM (SELECT *, CASE WHEN {_OK} THEN 1 ELSE 0 END AS valid FROM v_pixels) x)"
LOOSE = MASKED.replace("mk AS", "lo AS").replace(_OK, _LOOSE)
SCENE = "N(COUNT(*)) AS n_total, N(SUM(valid)) AS n_valid, N(COALESCE(SUM(lit), 0)) AS n_lit, R(AVG(rad)) AS mean_rad, R(SUM(valid) / COUNT(*)) AS valid_share, R(CASE WHEN SUM(valid) > 0 THEN COALESCE(SUM(lit), 0) / SUM(valid) END) AS p_lit, R(COALESCE(SUM(lit), 0) / COUNT(*)) AS lit_share_all"
ZON = "zn AS (SELECT entity, date, SUM(CASE WHEN rad IS NOT NULL THEN coverage_fraction ELSE 0 END) AS n_valid, SUM(CASE WHEN lit = 1 THEN coverage_fraction ELSE 0 END) AS n_lit, SUM(coverage_fraction) AS n_total_overlap, SUM(CASE WHEN rad IS NOT NULL THEN coverage_fraction * rad ELSE 0 END) AS rad_sum, SUM(CASE WHEN rad IS NOT NULL THEN coverage_fraction * cell_area_m2 ELSE 0 END) AS valid_area_m2 FROM mk JOIN v_weights USING (cell_id) GROUP BY 1, 2)"
BASE = "bl AS (SELECT *, q_upper - q_lower AS iqr, q_lower - 0.2 * (q_upper - q_lower) AS lower_threshold, q_upper + 0.2 * (q_upper - q_lower) AS upper_threshold FROM (SELECT cell_id, QUANTILE_CONT(rad, 0.25) AS q_lower, QUANTILE_CONT(rad, 0.75) AS q_upper, COUNT(rad) AS n_valid_days FROM v_pixels GROUP BY 1) q)"
STATE = "st AS (SELECT p.cell_id, date, CAST(rad <= upper_threshold AS INTEGER) AS observed, CAST(rad < lower_threshold AS INTEGER) AS dark, CAST(rad > upper_threshold AS INTEGER) AS bright_excluded, CASE WHEN rad <= upper_threshold THEN rad END AS rad_observed FROM v_pixels p JOIN bl ON p.cell_id = bl.cell_id AND n_valid_days >= 8 AND upper_threshold > lower_threshold)"


def masked(v):
    return X.mask_radiance(X.valid_mask(v("v_pixels")), 3.0).select("cell_id", "date", "valid", "rad", "lit")


def loose(v):
    return X.mask_radiance(X.valid_mask(v("v_pixels"), max_qf=2, max_cloud=2, full=False), 3.0).select("cell_id", "date", "valid", "rad", "lit")


def zonal(v, **more):
    return X.zonal_sums(masked(v), v("v_weights"), **more)


def baseline(v, **more):
    return X.pixel_baseline(v("v_pixels"), 0.25, 0.75, 8, k=0.2, **more)


def state(v):
    return X.baseline_state(v("v_pixels").select("cell_id", "date", "rad"), baseline(v))


#: What zone states take of the stored tables.
STORED = {"v_pixels": ["cell_id", "date", "rad"], "v_weights": ["entity", "cell_id", "coverage_fraction", "cell_area_m2"]}


def copartitioned(v, buckets=None):
    """state(v) and weights of tables that are stored by cell: their joins and the cells' baselines need no shuffle.

    Buckets are the blocks of cells that zone sums take, unless given.
    """
    spark = v("v_pixels").sparkSession
    buckets, stored = buckets or overlay.blocks(spark), {}
    for name, columns in STORED.items():
        path = io.write_bucketed(v(name).select(*columns), io.shared_path(spark, name), "cell_id", buckets)
        stored[name] = io.read_bucketed(spark, path, "cell_id", buckets)
    return state(stored.__getitem__), stored["v_weights"]


def catalog():
    px, wt = ["v_pixels"], ["v_pixels", "v_weights"]
    c = {}
    c["pix1_decode_qa_bits"] = (px, lambda v: X.decode_qa_bits(v("v_pixels")).select("cell_id", "date", *X.QA_BITS), "SELECT cell_id, date, " + ", ".join(f"I((qf_cloud >> {a}) & {(1 << w) - 1}) AS {n}" for n, (a, w) in X.QA_BITS.items()) + " FROM v_pixels")
    c["pix2_valid_mask"] = (px, lambda v: masked(v).select("cell_id", "date", "valid"), f", {MASKED} SELECT cell_id, date, I(valid) AS valid FROM mk")
    c["pix3_mask_radiance"] = (px, lambda v: masked(v).select("cell_id", "date", "rad", "lit"), f", {MASKED} SELECT cell_id, date, R(rad) AS rad, I(lit) AS lit FROM mk")
    c["pix4_drop_poor"] = (["v_annual"], lambda v: X.drop_poor(v("v_annual")).select("cell_id", "rad"), "SELECT cell_id, R(CASE WHEN quality NOT IN (1, 2) AND rad <> 65535 THEN rad END) AS rad FROM v_annual")
    c["pix5_mosaic_max"] = (px, lambda v: X.mosaic_max(v("v_pixels")), "SELECT cell_id, R(MAX(rad)) AS rad FROM v_pixels GROUP BY 1")
    c["pix6_scene_summary"] = (px, lambda v: X.scene_summary(masked(v), ["date"]), f", {MASKED} SELECT date, {SCENE} FROM mk GROUP BY 1")
    c["pix7_bit_table"] = (px, lambda v: X.bit_table(v("v_pixels")), ", b AS (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, (qf_cloud >> {a}) & {(1 << w) - 1} AS value FROM v_pixels" for n, (a, w) in X.QA_BITS.items()) + ") SELECT metric, I(value) AS value, N(COUNT(*)) AS n, R(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY metric)) AS share FROM b GROUP BY metric, value")
    c["pix8_flagged_share"] = (px, lambda v: X.flagged_share(v("v_pixels"), [256, 4096], ["date"]), "SELECT date, N(COUNT(*) FILTER (WHERE qf_cloud & 256 <> 0 OR qf_cloud & 4096 <> 0)) AS n_flagged, N(COUNT(*)) AS n, R(COUNT(*) FILTER (WHERE qf_cloud & 256 <> 0 OR qf_cloud & 4096 <> 0) / COUNT(*)) AS share FROM v_pixels GROUP BY 1")
    c["pix9_blend"] = (px, lambda v: X.blend(masked(v), loose(v), 3.0, ["cell_id", "date"]), f", {MASKED}, {LOOSE}, bb AS (SELECT mk.cell_id, mk.date, CASE WHEN mk.valid = 1 THEN mk.rad WHEN lo.valid = 1 THEN lo.rad END AS rad FROM mk JOIN lo ON mk.cell_id = lo.cell_id AND mk.date = lo.date) SELECT cell_id, date, R(rad) AS rad, I(rad IS NOT NULL) AS valid, I(rad > 3) AS lit FROM bb")
    c["pix10_scenarios"] = (px, lambda v: X.scenario_summaries(v("v_pixels"), {"strict": {}, "loose": {"max_qf": 2, "max_cloud": 2, "full": False}}, 3.0, ["date"]), f", {MASKED}, {LOOSE}, u AS (SELECT 'strict' AS scenario, * FROM mk UNION ALL SELECT 'loose', * FROM lo) SELECT scenario, date, {SCENE} FROM u GROUP BY 1, 2")
    c["pix11_crop"] = (px, lambda v: X.crop(v("v_pixels"), v("v_annual").where("quality = 0")).select("cell_id", "date", "rad"), "SELECT cell_id, date, R(rad) AS rad FROM v_pixels WHERE cell_id % 4 = 0")
    c["pix12_thresholds"] = (px, lambda v: X.lit_by_threshold(v("v_pixels"), [1.0, 3.0, 5.0], ["date"]), "SELECT date, R(t) AS threshold, N(COUNT(*) FILTER (WHERE rad > t)) AS n_lit, N(COUNT(*)) AS n_valid, R(COUNT(*) FILTER (WHERE rad > t) / COUNT(*)) AS p FROM v_pixels, (SELECT UNNEST([1.0, 3.0, 5.0]) AS t) k GROUP BY 1, 2")
    c["pix13_difference"] = (["v_pixels", "v_annual"], lambda v: X.product_difference(v("v_pixels"), v("v_pixels").select("cell_id", "date").join(v("v_annual"), "cell_id"), ["cell_id", "date"], ["date"]), "SELECT date, N(COUNT(*)) AS n, R(QUANTILE_CONT(ABS(p.rad - a.rad), 0.99)) AS p99 FROM v_pixels p JOIN v_annual a ON p.cell_id = a.cell_id GROUP BY 1")
    c["pix14_downsample"] = (["v_annual"], lambda v: X.downsample(v("v_annual").withColumns({"row": F.floor(F.col("cell_id") / 50), "col": F.col("cell_id") % 50}), 5), "SELECT N(FLOOR((cell_id // 50) / 5)) AS row, N(FLOOR((cell_id % 50) / 5)) AS col, R(AVG(rad)) AS rad FROM v_annual GROUP BY 1, 2")
    c["zon1_zonal_sums"] = (wt, zonal, f", {MASKED}, {ZON} SELECT entity, date, R(n_valid) AS n_valid, R(n_lit) AS n_lit, R(n_total_overlap) AS n_total_overlap, R(rad_sum) AS rad_sum, R(valid_area_m2) AS valid_area_m2 FROM zn")
    c["zon2_weighted_median"] = (wt, lambda v: X.weighted_median(masked(v).join(v("v_weights"), "cell_id"), "rad", "coverage_fraction", ["entity"]), f", {MASKED}, w AS (SELECT entity, rad, SUM(coverage_fraction) OVER (PARTITION BY entity ORDER BY rad, coverage_fraction ROWS UNBOUNDED PRECEDING) AS c, SUM(coverage_fraction) OVER (PARTITION BY entity) AS t FROM mk JOIN v_weights USING (cell_id) WHERE rad IS NOT NULL) SELECT entity, R(MIN(rad) FILTER (WHERE c >= t * (0.5 - 1e-9))) AS median FROM w GROUP BY 1")
    c["zon3_day_columns"] = (wt, lambda v: X.day_columns(zonal(v, keep={"area_m2": X.entity_sum("cell_area_m2") / 300})).select("entity", "date", "p", "mean_rad", "coverage", "coverage_count"), f", {MASKED}, {ZON}, ar AS (SELECT entity, SUM(cell_area_m2) / 300 AS area_m2 FROM v_weights GROUP BY 1) SELECT zn.entity, date, R(CASE WHEN n_valid > 0 THEN n_lit / n_valid END) AS p, R(CASE WHEN n_valid > 0 THEN rad_sum / n_valid END) AS mean_rad, R(LEAST(1, valid_area_m2 / area_m2)) AS coverage, R(n_valid / n_total_overlap) AS coverage_count FROM zn JOIN ar ON zn.entity = ar.entity")
    c["zon4_centre_counts"] = (wt, lambda v: X.centre_counts(masked(v), v("v_weights")), f", {MASKED}, k AS (SELECT entity, date, COUNT(*) FILTER (WHERE rad IS NOT NULL AND is_centre) AS a, COUNT(*) FILTER (WHERE lit = 1 AND is_centre) AS b, COUNT(rad) AS c, COUNT(*) AS d FROM mk JOIN v_weights USING (cell_id) GROUP BY 1, 2) SELECT entity, date, N(a) AS n_valid_count, N(b) AS n_lit_count, N(c) AS n_valid_overlap, N(d) AS n_overlap, R(CASE WHEN a > 0 THEN b / a END) AS p_lit_count, R(c / d) AS coverage_count FROM k")
    c["zon5_day_state"] = (["v_panel"], lambda v: X.day_state(v("v_panel")).select("entity", "date", "state", "lit_day", "dark_day"), "SELECT entity, date, CASE WHEN p >= 0.4 THEN 'lit' WHEN p < 0.05 THEN 'dark' ELSE 'ambiguous' END AS state, I(p >= 0.4) AS lit_day, I(p < 0.05) AS dark_day FROM v_panel")
    c["zon6_annual_stats"] = (["v_annual", "v_weights"], lambda v: X.annual_stats(X.drop_poor(v("v_annual")), v("v_weights"), 3.0, 0.5), ", a AS (SELECT entity, SUM(CASE WHEN quality NOT IN (1, 2) AND rad >= 3 THEN coverage_fraction ELSE 0 END) AS l, SUM(CASE WHEN quality NOT IN (1, 2) THEN coverage_fraction ELSE 0 END) AS vv, SUM(coverage_fraction) AS t, SUM(CASE WHEN quality NOT IN (1, 2) THEN coverage_fraction * rad END) AS r FROM v_annual JOIN v_weights USING (cell_id) GROUP BY 1) SELECT entity, R(l) AS lit_weight, R(vv) AS valid_weight, R(t) AS total_weight, R(r / vv) AS mean_rad, R(vv / t) AS coverage_share, R(l / vv) AS p_year, I(vv / t >= 0.5) AS support_ok FROM a")
    c["zon7_zonal_states"] = (wt, lambda v: X.zonal_states(X.own_state(v("v_pixels"), 0.25, 0.75, 8, k=0.2), v("v_weights")), f", {BASE}, {STATE}, z AS (SELECT entity, date, SUM(coverage_fraction * observed) AS o, SUM(coverage_fraction * dark) AS d, SUM(coverage_fraction * bright_excluded) AS b, SUM(coverage_fraction) AS t, SUM(coverage_fraction * cell_area_m2 * observed) AS a, COALESCE(SUM(coverage_fraction * rad_observed), 0) AS r FROM st JOIN v_weights USING (cell_id) GROUP BY 1, 2) SELECT entity, date, R(o) AS n_observed, R(d) AS n_dark, R(b) AS n_bright_excluded, R(t) AS n_total_overlap, R(a) AS observed_area_m2, R(r) AS rad_sum, R(CASE WHEN o > 0 THEN d / o END) AS p_dark, R(CASE WHEN o > 0 THEN r / o END) AS mean_rad, R(o / t) AS coverage_count FROM z")
    c["zon7_copartitioned"] = (wt, lambda v: X.zonal_states(*copartitioned(v)), c["zon7_zonal_states"][2])
    acc = ", ".join(f"R(SUM(CASE WHEN {cond} THEN {x} ELSE 0 END)) AS {n}_{u}" for n, cond in (("total", "TRUE"), ("valid", "rad IS NOT NULL"), ("lit", "lit = 1"), ("dark", "lit = 0"), ("missing", "rad IS NULL")) for u, x in (("cells", "coverage_fraction"), ("area", "coverage_fraction * cell_area_m2")))
    c["zon8_pixel_accounting"] = (wt, lambda v: X.pixel_accounting(masked(v), v("v_weights")), f", {MASKED} SELECT entity, date, {acc} FROM mk JOIN v_weights USING (cell_id) GROUP BY 1, 2")
    c["zon9_month_rollup"] = (["v_panel"], lambda v: X.month_rollup(v("v_panel")), "SELECT entity, CAST(DATE_TRUNC('month', date) AS DATE) AS month, N(COUNT(*)) AS n_days, R(AVG(p)) AS mean_p, R(STDDEV_SAMP(p)) AS sd_p, R(AVG(CAST(p < 0.2 AS INTEGER))) AS drop_frac, R(AVG(coverage)) AS mean_coverage FROM v_panel GROUP BY 1, 2")
    c["bas1_quantiles"] = (px, lambda v: baseline(v).select("cell_id", "q_lower", "q_upper", "iqr", "n_valid_days"), f", {BASE} SELECT cell_id, R(q_lower) AS q_lower, R(q_upper) AS q_upper, R(iqr) AS iqr, N(n_valid_days) AS n_valid_days FROM bl")
    c["bas2_modes"] = (px, lambda v: baseline(v, mode="absolute", upper="quantile", absolute=1.0).select("cell_id", "lower_threshold", "upper_threshold").union(baseline(v, upper="none").select("cell_id", "lower_threshold", "upper_threshold")), f", {BASE} SELECT cell_id, R(1.0) AS lower_threshold, R(q_upper) AS upper_threshold FROM bl UNION ALL SELECT cell_id, R(lower_threshold), NULL FROM bl")
    c["bas3_baseline_ok"] = (px, lambda v: X.pixel_baseline(v("v_pixels"), 0.25, 0.75, 30, k=0.2).select("cell_id", "baseline_ok"), f", {BASE} SELECT cell_id, I(n_valid_days >= 30 AND upper_threshold > lower_threshold) AS baseline_ok FROM bl")
    c["bas4_daily_state"] = (px, lambda v: state(v).select("cell_id", "date", "observed", "dark", "bright_excluded", "rad_observed"), f", {BASE}, {STATE} SELECT cell_id, date, I(observed) AS observed, I(dark) AS dark, I(bright_excluded) AS bright_excluded, R(rad_observed) AS rad_observed FROM st")
    c["bas5_daily_signal"] = (px, lambda v: X.daily_signal(state(v)), f", {BASE}, {STATE} SELECT date, N(SUM(observed)) AS n_observed, N(SUM(dark)) AS n_dark, N(SUM(bright_excluded)) AS n_bright, R(CASE WHEN SUM(observed) > 0 THEN SUM(dark) / SUM(observed) END) AS dark_share, R(SUM(bright_excluded) / (SUM(observed) + SUM(bright_excluded))) AS bright_share FROM st GROUP BY 1")
    return c
