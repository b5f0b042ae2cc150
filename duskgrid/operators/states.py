"""Windows over entity calendars: rolling electrification, first triggers, switches, runs, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskgrid.functions import finite, flag, sample_sd
from duskgrid.operators.order import running
from duskgrid.operators.panel import by_day, dealt, dense, on_own_day, over_days, placed


def by_date():
    return Window.partitionBy("entity").orderBy("date")


def lit_dark(df: DataFrame, lit_at: float, dark_below: float) -> DataFrame:
    """lit_day, dark_day (0/1, null without p) and observed (0/1)."""
    return df.withColumns({"lit_day": flag(F.col("p") >= lit_at), "dark_day": flag(F.col("p") < dark_below), "observed": F.col("p").isNotNull().cast("int")})


def rolling_forward(df: DataFrame, n: int, least_obs: int, least_lit: int, keys: list[str] | None = None) -> DataFrame:
    """n_lit, n_obs over the n calendar rows from each one on, null where fewer remain, and electrified (null if unsure).

    df must be dense: rows are days of the entity, or of other keys.
    """
    ahead = (Window.partitionBy(*keys).orderBy("date") if keys else by_date()).rowsBetween(0, n - 1)
    full = F.count(F.lit(1)).over(ahead) == n
    df = df.withColumns({"n_lit": F.when(full, F.sum(F.coalesce("lit_day", F.lit(0))).over(ahead)), "n_obs": F.when(full, F.sum("observed").over(ahead))})
    return df.withColumn("electrified", F.when(F.col("n_obs") >= least_obs, flag(F.col("n_lit") >= least_lit)))


def first_trigger(df: DataFrame) -> DataFrame:
    """doe: the first date with electrified = 1; after_doe: 1 from then on, 0 before or without one."""
    doe = F.min(F.when(F.col("electrified") == 1, F.col("date"))).over(Window.partitionBy("entity"))
    return df.withColumn("doe", doe).withColumn("after_doe", F.when(F.col("date") >= F.col("doe"), 1).otherwise(0))


def daily_states(dense: DataFrame, lit_at: float = 0.4, dark_below: float = 0.05, n: int = 30, least_obs: int = 8, least_lit: int = 15) -> DataFrame:
    return first_trigger(rolling_forward(lit_dark(dense, lit_at, dark_below), n, least_obs, least_lit))


def _calendar_ends(rows: DataFrame) -> DataFrame:
    """_a, _b: the first and the last date of a dealt panel, in days since 1970, one row. All columns are named, so that its shuffle serves again."""
    whole = F.when(F.col("date").isNotNull(), F.struct("date", *[c for c in rows.columns if c != "date"]))
    return F.broadcast(rows.agg(F.unix_date(F.min(whole)["date"]).alias("_a"), F.unix_date(F.max(whole)["date"]).alias("_b")).where("_a is not null"))


def _counts_upto(lit_at: float, n: int) -> dict:
    """n_obs, n_lit of the n days up to each row of a panel."""
    upto = by_day().rangeBetween(1 - n, 0)
    return {"n_obs": F.count("p").over(upto), "n_lit": F.coalesce(F.sum((F.col("p") >= lit_at).cast("int")).over(upto), F.lit(0))}


def _start(n: int, least_obs: int, least_lit: int):
    """The first day of the window of n days of the calendar (_a to _b) that ends with the row (or of the calendar's first window,
    which may end later) where it passes by n_obs and n_lit up to the row, else null.

    Both counts only fall as days leave a window, so a window that passes when none before did ends with a row or is the
    first one; of that, its last row has the whole counts.
    """
    start = F.greatest(F.col("_on") - (n - 1), F.col("_a"))
    passes = F.col("entity").isNotNull() & (start + (n - 1) <= F.col("_b")) & (F.col("n_obs") >= least_obs) & (F.col("n_lit") >= least_lit)
    return F.date_from_unix_date(F.when(F.col("_on").isNotNull() & passes, start))


def _trailing(panel: DataFrame, lit_at: float, n: int, least_obs: int, least_lit: int) -> DataFrame:
    """The panel, dealt by entity, with counts n_obs and n_lit of the n days up to each row, and _start."""
    rows = dealt(panel, "entity")
    ends = _calendar_ends(rows)
    rows = rows.withColumn("_on", F.unix_date("date")).withColumns(_counts_upto(lit_at, n)).crossJoin(ends)
    return rows.withColumn("_start", _start(n, least_obs, least_lit)).drop("_on", "_a", "_b")


def _low_bits(n):
    """A long of which the n lowest bits are set; n is 1 to 63."""
    return F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - n)


def panel_states(panel: DataFrame, lit_at: float = 0.4, dark_below: float = 0.05, n: int = 30, least_obs: int = 8, least_lit: int = 15) -> DataFrame:
    """daily_states of the dense panel; windows run over the panel's own rows, and days are made last and not sorted.

    Each row has the n days from its own on as bits of a long; the window of a day before it holds the lower ones of them.
    An entity has at most a row a date. Windows of more than 63 days are those of daily_states.
    """
    if n > 63:
        return daily_states(dense(panel), lit_at, dark_below, n, least_obs, least_lit)
    place, ahead = F.pmod(F.col("_on"), F.lit(64)), by_day().rangeBetween(0, n - 1)
    bit = lambda condition: F.when(F.col("entity").isNotNull() & condition, F.call_function("shiftleft", F.lit(1).cast("long"), place))
    rows = placed(panel).withColumns({"_seen": F.bit_or(bit(F.col("p").isNotNull())).over(ahead), "_lit": F.bit_or(bit(F.col("p") >= lit_at)).over(ahead), **_counts_upto(lit_at, n)})
    rows = rows.withColumn("_start", _start(n, least_obs, least_lit)).withColumn("doe", F.min("_start").over(Window.partitionBy("entity")))
    days = over_days(rows.select(*panel.columns, "_seen", "_lit", "doe", "_on", "_a", "_b"))
    wait = F.col("_on") - F.col("_day")  # days until the row
    inside = F.when(wait.between(0, n - 1), _low_bits(n - wait)).otherwise(F.lit(0).cast("long"))
    # bits lie by date, modulo 64; they are turned to the row's own day
    count = lambda c: F.coalesce(F.bit_count(F.call_function("shiftrightunsigned", F.col(c), place).bitwiseOR(F.call_function("shiftleft", F.col(c), 64 - place)).bitwiseAND(inside)), F.lit(0)).cast("long")
    full = F.col("_day") + (n - 1) <= F.col("_b")
    values = [on_own_day(c).alias(c) for c in panel.columns if c not in ("entity", "date")]
    days = days.select("entity", F.date_from_unix_date("_day").alias("date"), *values, "doe", F.when(full, count("_lit")).alias("n_lit"), F.when(full, count("_seen")).alias("n_obs"))
    days = lit_dark(days, lit_at, dark_below).withColumn("electrified", F.when(F.col("n_obs") >= least_obs, flag(F.col("n_lit") >= least_lit)))
    return days.select(*panel.columns, "lit_day", "dark_day", "observed", "n_lit", "n_obs", "electrified", "doe", F.when(F.col("date") >= F.col("doe"), 1).otherwise(0).alias("after_doe"))


def first_triggers(panel: DataFrame, lit_at: float = 0.4, n: int = 30, least_obs: int = 8, least_lit: int = 15) -> DataFrame:
    """entity, doe, n_obs, n_lit: of each entity the doe of its daily_states and the counts there, null without one.

    Only the panel's own rows are read, no calendar is made. An entity has at most a row a date.
    """
    best = F.min(F.when(F.col("_start").isNotNull(), F.struct("_start", -F.col("n_obs"), -F.col("n_lit")).cast("struct<doe: date, o: long, l: long>")))
    return _trailing(panel, lit_at, n, least_obs, least_lit).groupBy("entity").agg(best.alias("_s")).select("entity", "_s.doe", (-F.col("_s.o")).alias("n_obs"), (-F.col("_s.l")).alias("n_lit"))


def observed_after(panel: DataFrame, lit_at: float = 0.4, dark_below: float = 0.05, n: int = 30, least_obs: int = 8, least_lit: int = 15) -> DataFrame:
    """The rows of daily_states that have a p, from each entity's doe on, without counts; the panel's own rows alone are read."""
    rows = _trailing(panel, lit_at, n, least_obs, least_lit).withColumn("doe", F.min("_start").over(Window.partitionBy("entity")))
    kept = rows.where(F.col("p").isNotNull() & (F.col("date") >= F.col("doe")))
    return lit_dark(kept.select(*panel.columns, "doe"), lit_at, dark_below).withColumn("after_doe", F.lit(1))


def switches(df: DataFrame, period: str) -> DataFrame:
    """switch: 1 where the lit state differs from the observed day before within entity and period, null on the first."""
    before = F.lag("lit_day").over(Window.partitionBy("entity", period).orderBy("date"))
    return df.withColumn("switch", flag(F.col("lit_day") != before))


def longest_run(df: DataFrame, condition) -> DataFrame:
    """Of each entity the longest run of rows, in order of date, for which condition holds, and its share of all rows."""
    on = F.coalesce(condition, F.lit(False))
    change = df.withColumn("_on", on).withColumn("_c", F.coalesce((F.col("_on") != F.lag("_on").over(by_date())).cast("int"), F.lit(0)))
    runs = change.withColumn("_run", F.sum("_c").over(by_date().rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy("entity", "_run").agg(F.count("*").alias("_n"), F.sum(F.col("_on").cast("int")).alias("_d"))
    return each.groupBy("entity").agg(F.max("_d").alias("longest_run"), F.sum("_n").alias("n_days")).withColumn("run_share", F.col("longest_run") / F.col("n_days"))


def extremes(df: DataFrame, value: str, tie: str, n: int, by: list[str] | None = None) -> DataFrame:
    """side: `low` for the n smallest, `high` for the n largest of value (low wins), else null. Nulls have no side."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    known = df.where(F.col(value).isNotNull())
    return known.withColumns({"low_rank": F.row_number().over(w.orderBy(F.asc(value), F.asc(tie))), "high_rank": F.row_number().over(w.orderBy(F.desc(value), F.asc(tie)))}).withColumn("side", F.when(F.col("low_rank") <= n, "low").when(F.col("high_rank") <= n, "high"))


def quantile_groups(df: DataFrame, value: str, tie: str, n: int, by: list[str] | None = None) -> DataFrame:
    """bin 1 to n of equal size by value; rows without a value have none and are left out."""
    return df.where(F.col(value).isNotNull()).withColumn("bin", F.ntile(n).over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(value, tie)))


def outer_quarters(df: DataFrame, value: str, tie: str, share: float = 0.25) -> DataFrame:
    """side: `low` or `high` for the floor(n * share) finite rows at either end; ties go to the smaller tie at both ends."""
    rows = df.where(finite(value))
    low = running(rows, [value, tie], {"low_rank": F.lit(1)}).withColumnRenamed("low_rank_total", "_all").drop("low_rank_before", "_last")
    both = running(low.withColumn("_minus", -F.col(value)), ["_minus", tie], {"high_rank": F.lit(1)}).drop("high_rank_before", "high_rank_total", "_last", "_minus")
    n = F.floor(F.col("_all") * share)
    return both.withColumn("side", F.when(F.col("low_rank") <= n, "low").when(F.col("high_rank") <= n, "high")).drop("_all")


def lowest_share(df: DataFrame, value: str, tie: str, share: float, by: str | None = "month") -> DataFrame:
    """Rows among the lowest max(1, ceil(n * share)) by value, within by."""
    w = Window.partitionBy(by if by else F.lit(1))
    return df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value, tie))).withColumn("_n", F.count("*").over(w)).where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share))).drop("_r", "_n")


def day_lag(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """lag_ and diff_ of value against the calendar day before; null across gaps."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("date")
    before = F.when(F.lag("date").over(w) == F.date_sub("date", 1), F.lag(value).over(w))
    return df.withColumn(f"lag_{value}", before).withColumn(f"diff_{value}", F.col(value) - F.col(f"lag_{value}"))


def date_runs(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """run: number of the stretch of consecutive dates that a row lies in, from 0."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("date")
    gap = F.when(F.datediff("date", F.lag("date").over(w)) > 1, 1).otherwise(0)
    return df.withColumn("_gap", gap).withColumn("run", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def autocorrelation(df: DataFrame, value: str, order: str, lags: int, by: list[str] | None = None) -> DataFrame:
    """lag, acf: by row order, with the mean and the sum of squares of the whole series below the line."""
    by = by or []
    w = Window.partitionBy(*(by or [F.lit(1)]))
    x = df.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(w))
    pairs = x.withColumn("_s", F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("_d", k).over(w.orderBy(order)).alias("b")) for k in range(1, lags + 1)]))
    prods = pairs.select(*by, "_d", F.explode("_s").alias("s"))
    return prods.groupBy(*by, "s.lag").agg(F.try_divide(F.sum(F.col("_d") * F.col("s.b")), F.sum(F.col("_d") * F.col("_d"))).alias("acf"))


def scaled(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """z: standardised; top: over the largest value."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    sd, top = F.stddev_samp(value).over(w), F.max(value).over(w)
    return df.withColumns({"z": F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd), "top": F.when(top > 0, F.col(value) / top)})


def diverse_top(df: DataFrame, score: str, n: int, group: str = "entity", tie: str = "date") -> DataFrame:
    """The best row of each group by score (ties to the earliest), and of these the n best."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return df.where(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy(F.desc(score), F.asc(group)).limit(n)


def trigger_margins(states: DataFrame, least_obs: int, least_lit: int, near: int = 1) -> DataFrame:
    """At each entity's doe: how far counts lie above their minimum, and whether that is near."""
    at = states.where(F.col("date") == F.col("doe")).select("entity", "doe", (F.col("n_obs") - least_obs).alias("obs_margin"), (F.col("n_lit") - least_lit).alias("lit_margin"))
    return at.withColumns({"obs_near": flag(F.col("obs_margin") <= near), "lit_near": flag(F.col("lit_margin") <= near)})


def spread(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), sample_sd(value).alias("sd"))
