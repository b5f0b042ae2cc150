"""Load-shedding exposure: hour windows, shifted dates, outage schedules and interval overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskgrid.functions import divide

# Megawatts of a stage, and the highest stage.
STAGE_MW, TOP_STAGE = 1000, 8


def window_exposure(hourly: DataFrame, hours: list[int], suffix: str = "", denominator: str = "contracted") -> DataFrame:
    """By date: n_hours, mean and sum of mlr and of contracted over some hours, and the share shed."""
    return windows_exposure(hourly, {suffix: hours}, denominator)


def windows_exposure(hourly: DataFrame, windows: dict[str, list[int]], denominator: str = "contracted") -> DataFrame:
    """window_exposure of several windows side by side, in one pass over the hours."""
    every = sorted({h for hs in windows.values() for h in hs})
    aggs = []
    for name, hours in windows.items():
        own = F.col("hour").isin(hours)
        for c in ("mlr", "contracted"):
            aggs += [F.avg(F.when(own, F.col(c))).alias(f"{c}_mean{name}"), F.sum(F.when(own, F.col(c))).alias(f"{c}_sum{name}")]
        aggs.append(F.count(F.when(own, 1)).alias(f"n_hours{name}"))
    out = hourly.where(F.col("hour").isin(every)).groupBy("date").agg(*aggs)
    return out.withColumns({f"shed_share{n}": shed_share(F.col(f"mlr_sum{n}"), F.col(f"contracted_sum{n}"), denominator) for n in windows})


def shed_share(mlr, contracted, denominator: str = "contracted"):
    """denominator: `contracted`, or `total` for mlr + contracted."""
    return divide(mlr, contracted if denominator == "contracted" else mlr + contracted)


def attach_shifted(panel: DataFrame, exposure: DataFrame, days: int = 1) -> DataFrame:
    """panel with the exposure of the local date, days after the product's own date (0: a placebo)."""
    return panel.withColumn("local_date", F.date_add("date", days)).join(exposure.withColumnRenamed("date", "local_date"), "local_date", "left")


def leads_and_lags(exposure: DataFrame, value: str, offsets: list[int]) -> DataFrame:
    """date, offset, value on date + offset: by the calendar, so that gaps give null."""
    dates = exposure.select("date", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset")).withColumn("_d", F.date_add("date", F.col("offset")))
    return dates.join(exposure.select(F.col("date").alias("_d"), value), "_d", "left").select("date", "offset", value)


def centred_window(hourly: DataFrame, dates: DataFrame, hour: int, first: int, last: int, denominator: str = "contracted") -> DataFrame:
    """By date: exposure over hour + first .. hour + last, across midnight."""
    at = dates.select("date", F.explode(F.sequence(F.lit(hour + first), F.lit(hour + last))).alias("_o"))
    at = at.select("date", F.date_add("date", F.floor(F.col("_o") / 24).cast("int")).alias("_d"), F.pmod("_o", F.lit(24)).alias("_h"))
    own = hourly.select(F.col("date").alias("_d"), F.col("hour").alias("_h"), "mlr", "contracted")
    out = at.join(own, ["_d", "_h"], "left").groupBy("date").agg(F.count("mlr").alias("n_hours"), F.sum("mlr").alias("mlr_sum"), F.sum("contracted").alias("contracted_sum"))
    return out.withColumn("shed_share", shed_share(F.col("mlr_sum"), F.col("contracted_sum"), denominator))


def implied_stage(df: DataFrame, mlr: str = "mlr") -> DataFrame:
    """stage: 0 without shedding, else the number of started thousands of megawatts, 8 at most."""
    return df.withColumn("stage", F.when(F.col(mlr) <= 0, 0).when(F.col(mlr) > 0, F.least(F.lit(TOP_STAGE), F.ceil(F.col(mlr) / STAGE_MW))).cast("int"))


def stage_reference(df: DataFrame, reference: DataFrame) -> DataFrame:
    """df with the reference table's columns by stage (nine rows)."""
    return df.join(F.broadcast(reference), "stage", "left")


def schedule_days(schedule: DataFrame) -> DataFrame:
    return schedule.groupBy("circuit", F.to_date("start").alias("date")).agg(F.sum("minutes").alias("minutes"), F.count("*").alias("n_events"))


def window_overlap(schedule: DataFrame, start_hour: int, end_hour: int) -> DataFrame:
    """circuit, date, overlap_s: seconds of outages inside the hours of each date they touch.

    Every interval is spread over its own days, so each meets the one window of a day: no range join is needed.
    """
    schedule = schedule.withColumn("start", F.col("start").cast("timestamp"))
    end = F.col("start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("minutes").cast("decimal(18,6)") * 60)
    rows = schedule.where(F.col("minutes") > 0).select("circuit", "start", end.alias("end"))
    days = rows.withColumn("date", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    sec = lambda c: F.unix_micros(c) / 1e6
    midnight = sec(F.col("date").cast("timestamp"))
    over = F.least(sec(F.col("end")), midnight + end_hour * 3600) - F.greatest(sec(F.col("start")), midnight + start_hour * 3600)
    return days.groupBy("circuit", "date").agg(F.sum(F.greatest(F.lit(0.0), over)).alias("overlap_s")).where("overlap_s > 0")


def attach_schedule(blocks: DataFrame, days: DataFrame, overlap: DataFrame, shift: int = 1) -> DataFrame:
    """blocks (circuit, date) with minutes, events and overlap of date + shift, 0 where none, and flags (shift 0: placebo)."""
    on = lambda df: df.withColumn("date", F.date_sub("date", shift))
    out = blocks.join(on(days), ["circuit", "date"], "left").join(on(overlap), ["circuit", "date"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("minutes", "n_events", "overlap_s")})
    return out.withColumns({"any_day": (F.col("minutes") > 0).cast("int"), "any_overpass": (F.col("overlap_s") > 0).cast("int")})


def citywide_schedule(schedule: DataFrame) -> DataFrame:
    return schedule.groupBy(F.to_date("start").alias("date")).agg(F.sum("minutes").alias("minutes"), F.count("*").alias("n_events"), F.count_distinct("circuit").alias("n_circuits"))


def overpass_exposure(hourly: DataFrame, hours: list[int] | None = None) -> DataFrame:
    """Exposure at the overpass hours with the share of what would have been supplied (mlr + contracted)."""
    return window_exposure(hourly, [1, 2] if hours is None else hours, denominator="total")
