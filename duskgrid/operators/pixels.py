"""Pixel tables: quality bits, masks, mosaics, zonal sums, per-pixel baselines and daily states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskgrid.functions import col, count_if, divide, finite, number, sample_sd
from duskgrid.operators import overlay
from duskgrid.operators.order import quantiles

# First bit and width of each field of the cloud-mask band.
QA_BITS = {"day_night": (0, 1), "cloud": (6, 2), "shadow": (8, 1), "cirrus": (9, 1), "snow_ice": (10, 1), "aurora": (12, 1), "eclipse": (13, 1)}
# What an annual composite marks as missing, and the quality flags that disqualify.
FILL, POOR = 65535, (1, 2)


def bits(c: Column | str, first: int, width: int) -> Column:
    return F.shiftright(col(c), first).bitwiseAND((1 << width) - 1)


def decode_qa_bits(df: DataFrame, column: str = "qf_cloud") -> DataFrame:
    return df.withColumns({name: bits(column, *at) for name, at in QA_BITS.items()})


def valid_mask(df: DataFrame, max_qf: int = 1, max_cloud: int = 1, full: bool = True, column: str = "qf_cloud") -> DataFrame:
    """valid: 1 where quality, cloud and snow allow (and with full also shadow, cirrus, aurora, eclipse); null is 0."""
    ok = (F.col("mandatory_qf") <= max_qf) & (F.col("snow") == 0) & (bits(column, *QA_BITS["cloud"]) <= max_cloud)
    if full:
        for name in ("shadow", "cirrus", "snow_ice", "aurora", "eclipse"):
            ok = ok & (bits(column, *QA_BITS[name]) == 0)
    return df.withColumn("valid", F.coalesce(ok.cast("int"), F.lit(0)))


def mask_radiance(df: DataFrame, threshold: float, strict: bool = True) -> DataFrame:
    """rad null where not valid; lit 0/1 by rad > threshold (>= if not strict), null where rad is."""
    rad = F.when(F.col("valid") == 1, number("rad"))
    return df.withColumn("rad", rad).withColumn("lit", (F.col("rad") > threshold if strict else F.col("rad") >= threshold).cast("int"))


def drop_poor(annual: DataFrame, fill: float = FILL) -> DataFrame:
    return annual.withColumn("rad", F.when(~F.col("quality").isin(*POOR) & (F.col("rad") != fill), F.col("rad")))


def once(c: Column) -> Column:
    """1 where c holds, else null."""
    return F.when(c, F.lit(1).cast("byte"))


def weight_and_area() -> dict[str, Column]:
    """What a pixel counts in an entity, by weight and by area."""
    return {"_w": F.col("coverage_fraction"), "_a": F.col("coverage_fraction") * F.col("cell_area_m2")}


def mosaic_max(tiles: DataFrame, cell: str = "cell_id") -> DataFrame:
    return tiles.groupBy(cell).agg(F.max("rad").alias("rad"))


def scene_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """n_total, n_valid, n_lit, valid_share, p_lit, lit_share_all, mean_rad of masked pixels."""
    out = df.groupBy(*by).agg(F.count("*").alias("n_total"), F.sum("valid").alias("n_valid"), F.coalesce(F.sum("lit"), F.lit(0)).alias("n_lit"), F.avg("rad").alias("mean_rad"))
    return out.withColumns({"valid_share": F.col("n_valid") / F.col("n_total"), "p_lit": divide("n_lit", "n_valid"), "lit_share_all": F.col("n_lit") / F.col("n_total")})


def bit_table(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """metric, value, n, share: pixels of every value of every quality field."""
    by = by or []
    long = decode_qa_bits(df).unpivot(by, list(QA_BITS), "metric", "value")
    n = long.groupBy(*by, "metric", "value").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "metric")))


def flagged_share(df: DataFrame, values: list[int], by: list[str], column: str = "qf_cloud") -> DataFrame:
    """Pixels for which any of the bit values is set, and their share."""
    hit = F.lit(False)
    for v in values:
        hit = hit | (F.col(column).bitwiseAND(v) != 0)
    return df.groupBy(*by).agg(count_if(hit).alias("n_flagged"), F.count("*").alias("n")).withColumn("share", F.col("n_flagged") / F.col("n"))


def blend(primary: DataFrame, fallback: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """The primary product where it is valid, else the fallback; valid and lit anew."""
    a, b = (d.select(*keys, F.col("valid").alias(f"v{i}"), F.col("rad").alias(f"r{i}")) for i, d in ((0, primary), (1, fallback)))
    both = a.join(b, keys, "full")
    rad = F.when(F.coalesce("v0", F.lit(0)) == 1, F.col("r0")).when(F.coalesce("v1", F.lit(0)) == 1, F.col("r1"))
    return both.select(*keys, rad.alias("rad")).withColumns({"valid": finite("rad").cast("int"), "lit": (F.col("rad") > threshold).cast("int")})


def scenario_summaries(df: DataFrame, rules: dict[str, dict], threshold: float, by: list[str]) -> DataFrame:
    """scene_summary under each rule (arguments of valid_mask), in one pass over the pixels."""
    arms = [F.struct(F.lit(name).alias("scenario"), _valid_column(rule).alias("valid")) for name, rule in rules.items()]
    each = df.select(*by, "rad", F.explode(F.array(*arms)).alias("s")).select(*by, "rad", "s.scenario", "s.valid")
    return scene_summary(mask_radiance(each, threshold), ["scenario", *by])


def _valid_column(rule: dict) -> Column:
    full = rule.get("full", True)
    ok = (F.col("mandatory_qf") <= rule.get("max_qf", 1)) & (F.col("snow") == 0) & (bits("qf_cloud", *QA_BITS["cloud"]) <= rule.get("max_cloud", 1))
    for name in ("shadow", "cirrus", "snow_ice", "aurora", "eclipse") if full else ():
        ok = ok & (bits("qf_cloud", *QA_BITS[name]) == 0)
    return F.coalesce(ok.cast("int"), F.lit(0))


def crop(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    return pixels.join(mask, "cell_id", "left_semi")


def lit_by_threshold(pixels: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """threshold, n_lit, n_valid, p: one pass of conditional sums, made long afterwards."""
    wide = pixels.groupBy(*by).agg(F.count(number("rad")).alias("n_valid"), *[count_if(F.col("rad") > t).alias(f"_{i}") for i, t in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("n_lit")) for i, t in enumerate(thresholds)])).alias("s")
    return wide.select(*by, "n_valid", rows).select(*by, "s.threshold", "s.n_lit", "n_valid", divide("s.n_lit", "n_valid").alias("p"))


def product_difference(a: DataFrame, b: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """n and 99th percentile of the absolute difference of two products' radiance."""
    d = a.select(*keys, F.col("rad").alias("_a")).join(b.select(*keys, F.col("rad").alias("_b")), keys)
    off = F.abs(F.col("_a") - F.col("_b"))
    n = d.groupBy(*by).agg(F.count("*").alias("n"))
    return n.join(quantiles(d, off, {"p99": 0.99}, by), by, "left")


def downsample(grid: DataFrame, factor: int) -> DataFrame:
    return grid.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg("rad").alias("rad"))


def zonal_sums(pixels: DataFrame, weights: DataFrame, by: list[str] | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """Coverage-weighted sums of pixels (cell_id, rad, valid, lit) by entity and by (date); null pixels weigh nothing.

    keep: further columns, of weights, that are the same in all rows of an entity.
    """
    by = ["date"] if by is None else by
    rad = F.when((F.col("valid") == 1) & finite("rad"), F.col("rad"))
    rows = pixels.select("cell_id", *by, rad.alias("_rad"), (rad.isNotNull() & (F.col("lit") == 1)).alias("_lit"))
    right = {"_ok": once(F.col("_rad").isNotNull()), "_lit": once(F.col("_lit")), "_rad": F.col("_rad")}
    return overlay.sums(rows, weights, by, weight_and_area(), right, {"n_valid": ("_w", "_ok"), "n_lit": ("_w", "_lit"), "n_total_overlap": ("_w", None), "rad_sum": ("_w", "_rad"), "valid_area_m2": ("_a", "_ok")}, keep)


def weighted_median(df: DataFrame, x: str, w: str, keys: list[str]) -> DataFrame:
    """median: the first x, in order of (x, w), at which the cumulative weight reaches half the total (to nine digits)."""
    ok = df.where(finite(x) & finite(w) & (F.col(w) > 0))
    part = Window.partitionBy(*keys)
    run = ok.withColumn("_c", F.sum(w).over(part.orderBy(x, w).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum(w).over(part))
    return run.groupBy(*keys).agg(F.min(F.when(F.col("_c") >= F.col("_t") * (0.5 - 1e-9), F.col(x))).alias("median"))


def entity_sum(c: Column | str) -> Column:
    """Sum of c over all rows of the entity; null of no entity."""
    return F.when(F.col("entity").isNotNull(), F.sum(c).over(Window.partitionBy("entity")))


def day_columns(zonal: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """p, mean_rad, coverage (capped at 1), coverage_count of zonal sums; areas (entity, area_m2), unless zonal has area_m2."""
    z = zonal if areas is None else zonal.join(areas, "entity", "left")
    return z.withColumns({"p": divide("n_lit", "n_valid"), "mean_rad": divide("rad_sum", "n_valid"), "coverage": F.when(F.col("area_m2") > 0, F.least(F.lit(1.0), F.col("valid_area_m2") / F.col("area_m2"))), "coverage_count": divide("n_valid", "n_total_overlap")})


def centre_counts(pixels: DataFrame, weights: DataFrame) -> DataFrame:
    """Counts of pixels whose centre lies inside and of all that touch: n_valid_count, n_lit_count, p_lit_count and so on."""
    good = F.coalesce((F.col("valid") == 1) & finite("rad"), F.lit(False))
    rows = pixels.select("cell_id", "date", good.alias("_ok"), (good & (F.col("lit") == 1)).alias("_lit"))
    left = {"_in": F.coalesce(F.col("is_centre"), F.lit(False)).cast("int"), "_one": F.lit(1)}
    out = overlay.sums(rows, weights, ["date"], left, {"_ok": once(F.col("_ok")), "_lit": once(F.col("_lit"))}, {"n_valid_count": ("_in", "_ok"), "n_lit_count": ("_in", "_lit"), "n_valid_overlap": ("_one", "_ok"), "n_overlap": ("_one", None)})
    out = out.select("entity", "date", *[F.col(c).cast("long").alias(c) for c in out.columns[2:]])
    return out.withColumns({"p_lit_count": divide("n_lit_count", "n_valid_count"), "coverage_count": F.col("n_valid_overlap") / F.col("n_overlap")})


def day_state(df: DataFrame, lit_at: float = 0.4, dark_below: float = 0.05) -> DataFrame:
    """state lit, dark or ambiguous, lit_day, dark_day; all null without p."""
    p = F.col("p")
    return df.withColumns({"lit_day": (p >= lit_at).cast("int"), "dark_day": (p < dark_below).cast("int"), "state": F.when(p.isNull(), None).when(p >= lit_at, "lit").when(p < dark_below, "dark").otherwise("ambiguous")})


def annual_stats(annual: DataFrame, weights: DataFrame, threshold: float, least_coverage: float) -> DataFrame:
    """Of each entity: mean_rad, lit, valid and total weight, coverage share, p_year (rad >= threshold), support_ok.

    Weights are summed to nine places, so that a share at a cut does not hang on the order in which they came.
    """
    ok, w = finite("rad"), F.col("coverage_fraction")
    total = lambda x: F.round(F.sum(x), 9)
    out = annual.join(weights, "cell_id").groupBy("entity").agg(total(F.when(ok & (F.col("rad") >= threshold), w).otherwise(0.0)).alias("lit_weight"), total(F.when(ok, w).otherwise(0.0)).alias("valid_weight"), total(w).alias("total_weight"), F.sum(F.when(ok, w * F.col("rad"))).alias("_r"))
    out = out.withColumns({"mean_rad": divide("_r", "valid_weight"), "coverage_share": F.round(divide("valid_weight", "total_weight"), 12), "p_year": F.round(divide("lit_weight", "valid_weight"), 12)}).drop("_r")
    return out.withColumn("support_ok", (F.coalesce("coverage_share", F.lit(0.0)) >= least_coverage).cast("int"))


def pixel_baseline(pixels: DataFrame, low: float, high: float, least_days: int, k: float = 1.5, mode: str = "tukey_lower", upper: str = "tukey_upper", absolute: float = 0.0, upper_absolute: float = 0.0) -> DataFrame:
    """Of each cell: q_lower, q_upper, iqr, n_valid_days, lower_threshold, upper_threshold (null if none), baseline_ok.

    mode: tukey_lower, quantile or absolute; upper: tukey_upper, quantile, absolute or none.
    """
    q = pixels.groupBy("cell_id").agg(F.percentile(number("rad"), F.array(F.lit(low), F.lit(high))).alias("_q"), F.count(number("rad")).alias("n_valid_days"))
    return _thresholds(q.select("cell_id", "_q", "n_valid_days"), least_days, k, mode, upper, absolute, upper_absolute)


def _thresholds(q: DataFrame, least_days: int, k: float = 1.5, mode: str = "tukey_lower", upper: str = "tukey_upper", absolute: float = 0.0, upper_absolute: float = 0.0) -> DataFrame:
    q = q.select(*[F.col(c) for c in q.columns if c not in ("_q", "n_valid_days")], F.col("_q")[0].alias("q_lower"), F.col("_q")[1].alias("q_upper"), "n_valid_days").withColumn("iqr", F.col("q_upper") - F.col("q_lower"))
    lower = {"tukey_lower": F.col("q_lower") - k * F.col("iqr"), "quantile": F.col("q_lower"), "absolute": F.lit(absolute)}[mode]
    above = {"tukey_upper": F.col("q_upper") + k * F.col("iqr"), "quantile": F.col("q_upper"), "absolute": F.lit(upper_absolute), "none": F.lit(None).cast("double")}[upper]
    q = q.withColumns({"lower_threshold": lower, "upper_threshold": above})
    ok = (F.col("n_valid_days") >= least_days) & finite("lower_threshold") & (F.col("iqr") >= 0) & (F.col("upper_threshold").isNull() | (F.col("upper_threshold") > F.col("lower_threshold")))
    return q.withColumn("baseline_ok", F.coalesce(ok.cast("int"), F.lit(0)))


def baseline_state(pixels: DataFrame, baseline: DataFrame) -> DataFrame:
    """observed, dark, bright_excluded (0/1) and rad_observed of pixels whose baseline is usable."""
    return _states(pixels.join(baseline.where("baseline_ok = 1").select("cell_id", "lower_threshold", "upper_threshold"), "cell_id"))


def own_state(pixels: DataFrame, low: float, high: float, least_days: int, **more) -> DataFrame:
    """baseline_state of pixels (cell_id, date, rad) by their own pixel_baseline: shuffled once, in blocks of cells."""
    cell = Window.partitionBy("cell_id")
    rows = pixels.where(F.col("cell_id").isNotNull()).select("cell_id", "date", "rad").repartition(overlay.blocks(pixels.sparkSession), "cell_id")
    q = rows.withColumns({"_q": F.percentile(number("rad"), F.array(F.lit(low), F.lit(high))).over(cell), "n_valid_days": F.count(number("rad")).over(cell)})
    return _states(_thresholds(q, least_days, **more).where("baseline_ok = 1").select(*rows.columns, "lower_threshold", "upper_threshold"))


def _states(j: DataFrame) -> DataFrame:
    bright = F.coalesce(F.col("rad") > F.col("upper_threshold"), F.lit(False))
    seen = finite("rad") & ~bright
    return j.withColumns({"observed": seen.cast("int"), "dark": (seen & (F.col("rad") < F.col("lower_threshold"))).cast("int"), "bright_excluded": (finite("rad") & bright).cast("int"), "rad_observed": F.when(seen, F.col("rad"))}).drop("lower_threshold", "upper_threshold")


def daily_signal(state: DataFrame) -> DataFrame:
    out = state.groupBy("date").agg(F.sum("observed").alias("n_observed"), F.sum("dark").alias("n_dark"), F.sum("bright_excluded").alias("n_bright"))
    return out.withColumns({"dark_share": divide("n_dark", "n_observed"), "bright_share": divide("n_bright", F.col("n_observed") + F.col("n_bright"))})


def zonal_states(state: DataFrame, weights: DataFrame, dealt: bool = True) -> DataFrame:
    """Weighted observed, dark and bright pixels, observed area and radiance by entity and date, and shares.

    dealt: state lies by cell, as own_state leaves it, or baseline_state of stored buckets.
    """
    kinds = ["observed", "dark", "bright_excluded"]
    slim = state.select("cell_id", "date", "rad_observed", *[F.col(c).cast("byte").alias(c) for c in kinds])
    right = {f"_{c}": F.col(c) for c in [*kinds, "rad_observed"]}
    out = overlay.sums(slim, weights, ["date"], weight_and_area(), right, {**{f"n_{c}": ("_w", f"_{c}") for c in kinds}, "n_total_overlap": ("_w", None), "observed_area_m2": ("_a", "_observed"), "rad_sum": ("_w", "_rad_observed")}, dealt=dealt)
    out = out.withColumn("rad_sum", F.coalesce("rad_sum", F.lit(0.0)))
    return out.withColumns({"p_dark": divide("n_dark", "n_observed"), "mean_rad": divide("rad_sum", "n_observed"), "coverage_count": divide("n_observed", "n_total_overlap")})


def pixel_accounting(pixels: DataFrame, weights: DataFrame) -> DataFrame:
    """By entity and date: weights and areas of all, valid, lit, dark and missing pixels."""
    good = (F.col("valid") == 1) & finite("rad")
    rows = pixels.select("cell_id", "date", F.when(good, F.coalesce("lit", F.lit(2)).cast("byte")).alias("_lit"))
    lit = F.col("_lit")
    right = {"_valid": once(lit.isNotNull()), "_lit_": once(lit == 1), "_dark": once(lit == 0), "_missing": once(lit.isNull())}
    kinds = {"total": None, "valid": "_valid", "lit": "_lit_", "dark": "_dark", "missing": "_missing"}
    return overlay.sums(rows, weights, ["date"], weight_and_area(), right, {f"{n}_{u}": (x, y) for n, y in kinds.items() for u, x in (("cells", "_w"), ("area", "_a"))})


def month_rollup(panel: DataFrame, drop_below: float = 0.2) -> DataFrame:
    return panel.where(F.col("p").isNotNull()).groupBy("entity", F.trunc("date", "month").alias("month")).agg(F.count("*").alias("n_days"), F.avg("p").alias("mean_p"), sample_sd("p").alias("sd_p"), F.avg((F.col("p") < drop_below).cast("int")).alias("drop_frac"), F.avg("coverage").alias("mean_coverage"))
