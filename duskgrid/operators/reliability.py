"""Reliability metrics of entities and areas by period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskgrid.functions import count_if, divide, flag, sample_sd, weighted_mean, weighted_sd
from duskgrid.operators.panel import completion_grid
from duskgrid.operators.states import switches

#: Observed days that a month, a quarter and a year need.
SUPPORT = {"month": 10, "quarter": 40, "year": 85}
METRICS = ("uptime", "dark_share", "mean_p", "sd_p", "cv_p", "switch_rate")


def entity_metrics(states: DataFrame, period: str, support: int | None = None) -> DataFrame:
    """entity, period_start and metrics of the observed days of states (lit_day, dark_day, p, coverage, date)."""
    rows = states.where(F.col("p").isNotNull()).withColumn("period_start", F.trunc("date", period))
    return _period_metrics(switches(rows, "period_start"), ["entity", "period_start"], F.lit(SUPPORT[period] if support is None else support))


def _period_metrics(rows: DataFrame, by: list[str], support: Column) -> DataFrame:
    out = rows.groupBy(*by).agg(
        F.count("*").alias("obs_days"), F.sum("lit_day").alias("lit_days"), F.sum("dark_day").alias("dark_days"), F.avg("lit_day").alias("uptime"), F.avg("dark_day").alias("dark_share"),
        F.avg("p").alias("mean_p"), sample_sd("p").alias("sd_p"), F.avg("switch").alias("switch_rate"), F.avg("coverage").alias("mean_coverage"),
    )
    return out.withColumn("cv_p", F.when(F.col("mean_p") > 0, F.col("sd_p") / F.col("mean_p"))).withColumn("support_ok", (F.col("obs_days") >= support).cast("int"))


def all_periods(states: DataFrame) -> DataFrame:
    """entity_metrics of months, quarters and years, stacked, with period, in one pass.

    A day's switch against the observed day before is the same in every period that holds both days, so one window by
    entity serves all; each day then counts in three groups, which are combined before they are shuffled.
    """
    order = Window.partitionBy("entity").orderBy("date")
    rows = states.where(F.col("p").isNotNull()).select("entity", "date", "p", "lit_day", "dark_day", "coverage", F.lag("date").over(order).alias("_before"), flag(F.col("lit_day") != F.lag("lit_day").over(order)).alias("_switch"))
    kinds = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.trunc("date", p).alias("period_start"), F.when(F.trunc("_before", p) == F.trunc("date", p), F.col("_switch")).alias("switch")) for p in SUPPORT]))
    long = rows.select("entity", "p", "lit_day", "dark_day", "coverage", kinds.alias("_k")).select("*", "_k.*").drop("_k")
    need = F.create_map(*[F.lit(x) for kv in SUPPORT.items() for x in kv])
    return _period_metrics(long, ["entity", "period", "period_start"], need[F.col("period")])


def state_day_counts(metrics: DataFrame, states: DataFrame, period: str) -> DataFrame:
    """metrics with the number of days of each named state in their period, 0 where there is none."""
    n = states.withColumn("period_start", F.trunc("date", period)).groupBy("entity", "period_start").agg(*[count_if(F.col("state") == s).alias(f"{s}_days") for s in ("lit", "dark", "ambiguous")])
    out = metrics.join(n, ["entity", "period_start"], "left")
    return out.withColumns({f"{s}_days": F.coalesce(f"{s}_days", F.lit(0)) for s in ("lit", "dark", "ambiguous")})


def named_state(df: DataFrame) -> DataFrame:
    """state: lit, dark, ambiguous, or null without p."""
    return df.withColumn("state", F.when(F.col("p").isNull(), None).when(F.col("lit_day") == 1, "lit").when(F.col("dark_day") == 1, "dark").otherwise("ambiguous"))


def area_metrics(metrics: DataFrame, areas: DataFrame, least_share: float = 0.0) -> DataFrame:
    """area, period_start: population-weighted metrics of the supported entities, with all areas kept.

    areas (entity, area, population). Entities without a population don't count. coverage_share is the supported
    population over the area's whole; an area nothing is left of has one row without a period, which least_share > 0
    drops again.
    """
    known = areas.where(F.col("population").isNotNull() & F.col("area").isNotNull())
    total = known.groupBy("area").agg(F.sum("population").alias("area_population"))
    kept = metrics.where("support_ok = 1").join(known, "entity")
    out = kept.groupBy("area", "period_start").agg(
        F.count_distinct("entity").alias("n_entities"), F.sum("population").alias("kept_population"), *[weighted_mean(m, "population", positive=False).alias(m) for m in METRICS], weighted_sd("uptime", "population").alias("uptime_sd")
    )
    out = out.join(total, "area", "right").withColumn("coverage_share", F.try_divide(F.coalesce(F.col("kept_population"), F.lit(0.0)), F.col("area_population")))
    return out.where(F.col("coverage_share") >= least_share)


def drop_reasons(area: DataFrame, least_share: float) -> DataFrame:
    """Every area in every period with why it is not reported: kept, no_entities or low_coverage."""
    full = completion_grid(area, "area", "period_start")
    reason = F.when(F.col("n_entities").isNull(), "no_entities").when(F.col("coverage_share") < least_share, "low_coverage").otherwise("kept")
    return full.select("area", "period_start", reason.alias("reason"), F.coalesce("coverage_share", F.lit(0.0)).alias("coverage_share"))


def electrified_share(entities: DataFrame) -> DataFrame:
    """By area, and for the nation (area null): entities and population with electrified = 1, and shares."""
    aggs = [F.count("*").alias("n"), count_if(F.col("electrified") == 1).alias("n_electrified"), F.sum("population").alias("population"), F.sum(F.when(F.col("electrified") == 1, F.col("population"))).alias("electrified_population")]
    areas = entities.groupBy("area").agg(*aggs)
    nation = areas.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_electrified")], *[F.sum(c).alias(c) for c in ("population", "electrified_population")])  # of the areas' sums, not of the rows again
    both = areas.unionByName(nation.withColumn("area", F.lit(None).cast("string")))
    return both.withColumn("population_share", divide(F.coalesce("electrified_population", F.lit(0.0)), "population"))


def doe_status(states: DataFrame, entities: DataFrame) -> DataFrame:
    """By area, and for the nation (area null): entities with and without a confirmed date, and their population."""
    one = states.select("entity", "doe").distinct().join(entities, "entity").withColumn("electrified", F.col("doe").isNotNull().cast("int"))
    return electrified_share(one)


def margin_summary(df: DataFrame, value: str, near: float, by: list[str] | None = None) -> DataFrame:
    """n, how many lie at most near above zero, p10, p50, p90 and mean of a margin."""
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return df.where(F.col(value).isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("n"), count_if(F.col(value).between(0, near)).alias("n_near"), q.alias("_q"), F.avg(value).alias("mean")).select(*(by or []), "n", "n_near", F.col("_q")[0].alias("p10"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p90"), "mean")


def waterfall(entities: DataFrame, stages: list[str]) -> DataFrame:
    """stage, n, population, share of the first: how many entities pass each flag and all before it."""
    first = entities.agg(*[F.struct(count_if(ok).alias("n"), F.coalesce(F.sum(F.when(ok, F.col("population"))), F.lit(0.0)).alias("population")).alias(s) for s, ok in _running(stages)])
    rows = first.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(f"{s}.n").alias("n"), F.col(f"{s}.population").alias("population")) for i, s in enumerate(stages)])).alias("r"), F.col(f"{stages[0]}.n").alias("_n0"))
    return rows.select("r.*", divide(F.col("r.n").cast("double"), "_n0").alias("share"))


def _running(stages: list[str]):
    ok = F.lit(True)
    for s in stages:
        ok = ok & (F.coalesce(F.col(s), F.lit(0)) == 1)
        yield s, ok


def stage_reasons(entities: DataFrame, stages: list[str]) -> DataFrame:
    """reason, n, share: the first stage at which each entity falls out, or kept."""
    why = F.lit("kept")
    for s in reversed(stages):
        why = F.when(F.coalesce(F.col(s), F.lit(0)) != 1, F.lit(f"no_{s}")).otherwise(why)
    n = entities.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(entities.agg(F.count("*").alias("_all")))).select("reason", "n", (F.col("n") / F.col("_all")).alias("share"))


def area_daily_coverage(panel: DataFrame, areas: DataFrame) -> DataFrame:
    """area, date, coverage_share: population observed on each date of the panel over the area's; 0 where none was."""
    known = areas.where(F.col("population").isNotNull())
    total = known.groupBy("area").agg(F.sum("population").alias("area_population"))
    seen = panel.where(F.col("p").isNotNull()).join(known, "entity").groupBy("area", "date").agg(F.sum("population").alias("seen"))
    return completion_grid(seen, "area", "date").join(total, "area").select("area", "date", F.try_divide(F.coalesce("seen", F.lit(0.0)), F.col("area_population")).alias("coverage_share"))


def coverage_summary(daily: DataFrame, levels: list[float]) -> DataFrame:
    """By area: mean, p10, median of daily coverage and days at or above each level."""
    return daily.groupBy("area").agg(F.count("*").alias("n_days"), F.avg("coverage_share").alias("mean"), F.percentile("coverage_share", F.lit(0.1)).alias("p10"), F.percentile("coverage_share", F.lit(0.5)).alias("p50"), *[count_if(F.col("coverage_share") >= t).alias(f"days_{round(100 * t)}") for t in levels])


def threshold_sensitivity(area: DataFrame, levels: list[float]) -> DataFrame:
    """period_start, and how many areas are kept at each least coverage, wide."""
    return area.where(F.col("period_start").isNotNull()).groupBy("period_start").agg(*[count_if(F.col("coverage_share") >= t).alias(f"kept_{round(100 * t)}") for t in levels])


def population_flag(area: DataFrame, least: float = 0.5) -> DataFrame:
    """area rows with low (1 under least) and a label that is starred then."""
    low = F.coalesce(F.col("coverage_share"), F.lit(0.0)) < least
    return area.withColumns({"low": low.cast("int"), "label": F.concat(F.col("area"), F.when(low, "*").otherwise(""))})


def annual_dark_days(states: DataFrame) -> DataFrame:
    return states.groupBy("entity", F.trunc("date", "year").alias("period_start")).agg(F.coalesce(F.sum("dark_day"), F.lit(0)).alias("dark_days"))


def latest_period(df: DataFrame) -> DataFrame:
    last = df.agg(F.max("period_start").alias("period_start"))
    return df.join(F.broadcast(last), "period_start", "left_semi")


def illumination_profile(panel: DataFrame) -> DataFrame:
    """Of each entity mean, sd and cv of p, shares of full (> 0.9) and zero (< 0.05) days, and a regime."""
    out = panel.where(F.col("p").isNotNull()).groupBy("entity").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), sample_sd("p").alias("sd_p"), F.avg((F.col("p") > 0.9).cast("int")).alias("full_share"), F.avg((F.col("p") < 0.05).cast("int")).alias("zero_share"))
    regime = F.when(F.col("full_share") >= 0.5, "mostly_full").when(F.col("zero_share") >= 0.5, "mostly_dark").when((F.col("full_share") + F.col("zero_share")) >= 0.8, "on_off").otherwise("partial")
    return out.withColumn("cv_p", F.when(F.col("mean_p") > 0, F.col("sd_p") / F.col("mean_p"))).withColumn("regime", regime)


def mostly_lit(panel: DataFrame, at: float, least_share: float) -> DataFrame:
    """Rows of entities whose share of days with p > at is at least least_share."""
    keep = panel.where(F.col("p").isNotNull()).groupBy("entity").agg(F.avg((F.col("p") > at).cast("int")).alias("_s")).where(F.col("_s") >= least_share)
    return panel.join(keep, "entity", "left_semi")


def area_audit(panel: DataFrame, areas: DataFrame, least_coverage: list[float]) -> DataFrame:
    """scenario, area: entities, days and entity-days observed at each least coverage."""
    grid = F.explode(F.array(*[F.lit(t) for t in least_coverage])).alias("scenario")
    rows = panel.join(areas.select("entity", "area"), "entity").select("area", "entity", "date", "coverage", grid).where(F.col("coverage") >= F.col("scenario"))
    return rows.groupBy("scenario", "area").agg(F.count("*").alias("entity_days"), F.count_distinct("entity").alias("n_entities"), F.count_distinct("date").alias("n_dates"))
