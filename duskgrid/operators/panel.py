"""Entity-by-day panels: filters, joins, calendars and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskgrid.functions import count_if, median, safe_mean, weighted_mean, weighted_share

KEYS = ["entity", "date"]


def coverage_filter(panel: DataFrame, least: float, column: str = "coverage") -> DataFrame:
    return panel.where(F.col(column) >= least)


def retention(before: DataFrame, after: DataFrame, entity: str = "entity") -> DataFrame:
    """One row: entities before, dropped, partly and fully kept, and days before and after."""
    a, b = before.groupBy(entity).agg(F.count("*").alias("n0")), after.groupBy(entity).agg(F.count("*").alias("n1"))
    both = a.join(b, entity, "left").withColumn("n1", F.coalesce("n1", F.lit(0)))
    return both.agg(F.count("*").alias("n_entities"), count_if(F.col("n1") == 0).alias("n_dropped"), count_if((F.col("n1") > 0) & (F.col("n1") < F.col("n0"))).alias("n_partial"), count_if(F.col("n1") == F.col("n0")).alias("n_full"), F.sum("n0").alias("days_before"), F.sum("n1").alias("days_after"))


def keep_inner(panel: DataFrame, keep: DataFrame, value: str = "population") -> DataFrame:
    """Rows of kept entities; the panel's value where it has one, else the list's."""
    k = keep.select("entity", F.col(value).alias("_k"))
    own = F.col(value) if value in panel.columns else F.lit(None).cast("double")
    return panel.join(k, "entity").withColumn(value, F.coalesce(own, F.col("_k"))).drop("_k")


def keep_semi(panel: DataFrame, keep: DataFrame) -> DataFrame:
    return panel.join(keep, "entity", "left_semi")


def exclude_dates(panel: DataFrame, dates: DataFrame) -> DataFrame:
    return panel.join(dates, "date", "left_anti")


def enrich(panel: DataFrame, static: DataFrame, columns: list[str]) -> DataFrame:
    """panel with columns filled, where null or absent, from static by entity."""
    more = static.select("entity", *[F.col(c).alias(f"_s_{c}") for c in columns])
    out = panel.join(more, "entity", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_s_{c}")) if c in panel.columns else F.col(f"_s_{c}") for c in columns}).drop(*[f"_s_{c}" for c in columns])


def first_known(panel: DataFrame, columns: list[str]) -> DataFrame:
    """For each entity the first value by date that isn't null, of each column."""
    return panel.groupBy("entity").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in columns])


def duplicate_keys(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dates_between(panel: DataFrame) -> DataFrame:
    """All dates from the first to the last of the panel."""
    return panel.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("date"))


def daily_summary(panel: DataFrame, processed: DataFrame, weight: str = "population") -> DataFrame:
    """Every calendar date with its status and the day's summary.

    processed (date): dates for which an input was there; a date without rows is `not_processed` if it is one of
    these and `missing_raster` if not.
    """
    day = panel.groupBy("date").agg(F.count("*").alias("n"), safe_mean("p").alias("mean_p"), median("p").alias("median_p"), weighted_mean("p", weight).alias("weighted_p"), weighted_share(F.col("p") < 0.05, weight, F.col("p").isNotNull()).alias("weighted_dark"))
    seen = processed.select("date").distinct().withColumn("_in", F.lit(True))
    out = dates_between(panel).join(day, "date", "left").join(seen, "date", "left")
    status = F.when(F.col("n") > 0, "observed").when(F.col("_in"), "not_processed").otherwise("missing_raster")
    return out.withColumn("status", status).withColumn("n", F.coalesce("n", F.lit(0))).drop("_in")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df by key in as many parts as shuffles have: what grows manyfold behind it is not to be merged by the size before."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def by_day():
    """Placed rows of an entity by _on; frames by range are of calendar days."""
    return Window.partitionBy("entity").orderBy("_on")


def placed(panel: DataFrame) -> DataFrame:
    """The panel dealt by entity, with _on, its date in days since 1970, and _a and _b, the first and the last _on of all of it."""
    ends = panel.agg(F.unix_date(F.min("date")).alias("_a"), F.unix_date(F.max("date")).alias("_b")).where("_a is not null")
    return dealt(panel, "entity").withColumn("_on", F.unix_date("date")).crossJoin(F.broadcast(ends))  # one row


def over_days(rows: DataFrame) -> DataFrame:
    """Placed rows once for each day (_day, as _on) that they stand for.

    A row stands for its own day and those since the entity's row before, an entity's last row also for those behind it.
    """
    lone = F.col("entity").isNull()  # has a calendar, but no rows of its own; so has an entity without dates
    rows = rows.withColumns({"_before": F.lag("_on").over(by_day()), "_last": F.lead(F.lit(True)).over(by_day()).isNull()})
    rows = rows.where(F.col("_last") | (F.col("_on").isNotNull() & ~lone))
    start = F.when(lone, F.col("_a")).otherwise(F.least(F.coalesce(F.col("_before") + 1, "_a"), "_on"))
    return rows.withColumn("_day", F.explode(F.sequence(start, F.when(F.col("_last"), F.col("_b")).otherwise(F.col("_on"))))).drop("_before", "_last")


def on_own_day(c: str) -> Column:
    """c on the day of its row, null on the other days that over_days() gives the row."""
    return F.when(F.col("entity").isNotNull() & (F.col("_day") == F.col("_on")), F.col(c))


def dense(panel: DataFrame) -> DataFrame:
    """Every entity on every calendar date of the panel, null where there was no row.

    Only the panel is shuffled, by entity: its rows are spread over the days there. Windows by entity need no further shuffle.
    """
    values = [c for c in panel.columns if c not in KEYS]
    return over_days(placed(panel)).select("entity", F.date_from_unix_date("_day").alias("date"), *[on_own_day(c).alias(c) for c in values])


def fill_static(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns filled forward and then backward along dates, within entities."""
    ahead = Window.partitionBy("entity").orderBy("date")
    back = ahead.rowsBetween(Window.unboundedPreceding, 0)
    # where nothing lies behind, the next value is the entity's first; a frame from each row on would be summed anew for each row
    whole = ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(whole)) for c in columns})


def completion_grid(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair of values of a and b, with df's rows where it has them; null values are no values."""
    values = lambda c: df.where(F.col(c).isNotNull()).select(c).distinct()
    return values(a).crossJoin(values(b)).join(df, [a, b], "left")


def attach_baseline(panel: DataFrame, least_days: int) -> DataFrame:
    """panel with each entity's observed days and median p, and whether the days suffice."""
    base = panel.where("p is not null").groupBy("entity").agg(F.count_distinct("date").alias("obs_days"), median("p").alias("median_p"))
    return panel.join(base, "entity", "left").withColumn("baseline_ok", (F.coalesce("obs_days", F.lit(0)) >= least_days).cast("int"))


def neighbours(panel: DataFrame, columns: list[str]) -> DataFrame:
    """panel with the columns of the calendar day before (prev_) and after (next_); null across gaps."""
    out = panel
    for name, shift in (("prev", 1), ("next", -1)):
        out = out.join(panel.select("entity", F.date_add("date", shift).alias("date"), *[F.col(c).alias(f"{name}_{c}") for c in columns]), KEYS, "left")
    return out


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def cast_wide(df: DataFrame, ids: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    return df.groupBy(*ids).pivot(name, names).agg(F.first(value))


def time_keys(df: DataFrame, date: str = "date") -> DataFrame:
    """month, quarter, year (as first dates) and dow (1 Sunday to 7 Saturday)."""
    return df.withColumns({"month": F.trunc(date, "month"), "quarter": F.trunc(date, "quarter"), "year": F.trunc(date, "year"), "dow": F.dayofweek(date)})


def population_bin(df: DataFrame, edges: list[float], column: str = "population") -> DataFrame:
    """bin: label of the right-closed interval of edges; null where the value is null or not above the first edge."""
    c = F.col(column)
    out = F.when(c <= edges[0], None)
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = out.when(c <= b, F.lit(f"{i + 1}:({a:g},{b:g}]"))
    return df.withColumn("bin", F.when(c.isNotNull(), out.otherwise(F.lit(f"{len(edges)}:>{edges[-1]:g}"))))


def block_number(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("block_id", F.regexp_replace(column, r"[^0-9]", "").try_cast("int"))


def parse_id_spec(df: DataFrame, spec: str) -> DataFrame:
    """id: the integers that a text like `1:16,20` names."""
    part = F.explode(F.split(F.regexp_replace(spec, r"\s", ""), ","))
    ends = df.select(part.alias("_p")).where("_p <> ''").select(F.split("_p", ":").alias("_e"))
    return ends.select(F.explode(F.sequence(F.element_at("_e", 1).cast("int"), F.element_at("_e", -1).cast("int"))).alias("id")).distinct()


def stack_rows(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def violations(panel: DataFrame, required: list[str], states: list[str] | None = None, thresholds: list[float] | None = None) -> DataFrame:
    """One row of counts: shares outside [0, 1], states and thresholds not allowed, areas not positive."""
    missing = [c for c in required if c not in panel.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    have = set(panel.columns)
    checks = {f"bad_{c}": ~F.col(c).between(0, 1) for c in ("p", "coverage") if c in have}
    if states and "state" in have:
        checks["bad_state"] = ~F.col("state").isin(states)
    if thresholds and "threshold" in have:
        checks["bad_threshold"] = ~F.col("threshold").isin(thresholds)
    if "area_m2" in have:
        checks["bad_area"] = F.col("area_m2") <= 0
    return panel.agg(F.count("*").alias("n"), *[count_if(c).alias(n) for n, c in checks.items()])


def validate(panel: DataFrame, required: list[str], states: list[str] | None = None, thresholds: list[float] | None = None) -> DataFrame:
    """panel, if it breaks no rule; else ValueError."""
    row = violations(panel, required, states, thresholds).first().asDict()
    bad = {k: v for k, v in row.items() if k != "n" and v}
    if bad:
        raise ValueError(f"rules broken: {bad}")
    return panel
