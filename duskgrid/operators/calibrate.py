"""Calibration sweeps of electrification thresholds and dates against targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskgrid.functions import count_if


def threshold_sweep(entities: DataFrame, cuts: list[float], target: float, value: str = "p_year") -> DataFrame:
    """threshold, n, share of population at or above it, absolute error: one pass, the grid as conditional sums."""
    pop = F.col("population")
    one = entities.agg(F.sum(pop).alias("_all"), *[F.struct(count_if(F.col(value) >= t).alias("n"), F.coalesce(F.sum(F.when(F.col(value) >= t, pop)), F.lit(0.0)).alias("w")).alias(f"_{i}") for i, t in enumerate(cuts)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}.n").alias("n"), F.col(f"_{i}.w").alias("w")) for i, t in enumerate(cuts)])).alias("s")
    out = one.select("_all", rows).select("s.threshold", "s.n", F.try_divide("s.w", "_all").alias("share"))
    return out.withColumn("abs_error", F.abs(F.col("share") - target))


def best(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy("abs_error", F.desc("share"), "threshold").limit(1)


def electrified_best(entities: DataFrame, sweep: DataFrame, value: str = "p_year") -> DataFrame:
    top = F.broadcast(best(sweep).select(F.col("threshold").alias("_t")))  # one row
    return entities.crossJoin(top).withColumn("electrified_best", F.coalesce((F.col(value) >= F.col("_t")).cast("int"), F.lit(0))).drop("_t")


def keep_list(entities: DataFrame, columns: list[str]) -> DataFrame:
    return entities.where("electrified_best = 1").select(*columns)


def year_targets(years: DataFrame, targets: DataFrame, overrides: DataFrame) -> DataFrame:
    """year, target, provenance: an override where there is one, else the table's target, else none."""
    j = years.join(targets.select("year", F.col("target").alias("_t")), "year", "left").join(overrides.select("year", F.col("target").alias("_o")), "year", "left")
    return j.select("year", F.coalesce("_o", "_t").alias("target"), F.when(F.col("_o").isNotNull(), "override").when(F.col("_t").isNotNull(), "table").otherwise("missing").alias("provenance"))


def doe_sweep(states: DataFrame, grid_: list[tuple[int, int]], areas: DataFrame | None = None) -> DataFrame:
    """least_obs, least_lit, n_entities with a date, first and last date, from cached rolling counts n_obs and n_lit.

    Every (least_obs, least_lit) with least_lit <= least_obs is one conditional minimum a entity, all in one pass.
    With areas (entity, population) also the population share with a date.
    """
    combos = [(o, lit) for o, lit in grid_ if lit <= o]
    firsts = states.groupBy("entity").agg(*[F.min(F.when((F.col("n_obs") >= o) & (F.col("n_lit") >= lit), F.col("date"))).alias(f"_{i}") for i, (o, lit) in enumerate(combos)])
    if areas is not None:
        firsts = firsts.join(areas.select("entity", "population"), "entity")
    else:
        firsts = firsts.withColumn("population", F.lit(1.0))
    rows = F.explode(F.array(*[F.struct(F.lit(o).alias("least_obs"), F.lit(lit).alias("least_lit"), F.col(f"_{i}").alias("doe")) for i, (o, lit) in enumerate(combos)])).alias("s")
    long = firsts.select("entity", "population", rows).select("population", "s.*")
    return long.groupBy("least_obs", "least_lit").agg(F.count("doe").alias("n_entities"), F.min("doe").alias("first_doe"), F.max("doe").alias("last_doe"), F.try_divide(F.coalesce(F.sum(F.when(F.col("doe").isNotNull(), F.col("population"))), F.lit(0.0)), F.sum("population")).alias("share"))


def lit_sweep(dense: DataFrame, lits: list[float], grid_: list[tuple[int, int]], n: int) -> DataFrame:
    """doe_sweep under each lit threshold (lit_at), all in one pass over a dense panel; counts are of n calendar rows."""
    ahead = Window.partitionBy("entity").orderBy("date").rowsBetween(0, n - 1)
    full = F.count(F.lit(1)).over(ahead) == n
    rows = dense.select("entity", "date", F.when(full, F.sum(F.col("p").isNotNull().cast("int")).over(ahead)).alias("n_obs"), *[F.when(full, F.sum(F.coalesce((F.col("p") >= t).cast("int"), F.lit(0))).over(ahead)).alias(f"n_lit_{i}") for i, t in enumerate(lits)])
    arms = [(i, o, lit) for i in range(len(lits)) for o, lit in grid_ if lit <= o]
    firsts = rows.groupBy("entity").agg(*[F.min(F.when((F.col("n_obs") >= o) & (F.col(f"n_lit_{i}") >= lit), F.col("date"))).alias(f"_{k}") for k, (i, o, lit) in enumerate(arms)])
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("least_obs"), F.lit(lit).alias("least_lit"), F.lit(float(lits[i])).alias("lit_at"), F.col(f"_{k}").alias("doe")) for k, (i, o, lit) in enumerate(arms)])).alias("s")
    out = firsts.select(each).select("s.*").groupBy("least_obs", "least_lit", "lit_at")
    return out.agg(F.count("doe").alias("n_entities"), F.min("doe").alias("first_doe"), F.max("doe").alias("last_doe"), (F.count("doe") / F.count("*")).alias("share"))


def doe_scenarios(named: dict[str, DataFrame], areas: DataFrame) -> DataFrame:
    """scenario, area: entities and population with and without a date, of several state tables."""
    parts = [s.select("entity", "doe").distinct().join(areas, "entity").groupBy("area").agg(F.count("*").alias("n"), F.count("doe").alias("n_doe"), F.sum("population").alias("population"), F.sum(F.when(F.col("doe").isNotNull(), F.col("population"))).alias("doe_population")).withColumn("scenario", F.lit(k)) for k, s in named.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def doe_variants(does: DataFrame, named: dict[str, Column], areas: DataFrame) -> DataFrame:
    """doe_scenarios of one table (a row an entity) under several rules of its date, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), c.alias("doe")) for k, c in named.items()])).alias("_s")
    rows = does.join(areas, "entity").select("area", "population", each).select("area", "population", "_s.*")
    return rows.groupBy("scenario", "area").agg(F.count("*").alias("n"), F.count("doe").alias("n_doe"), F.sum("population").alias("population"), F.sum(F.when(F.col("doe").isNotNull(), F.col("population"))).alias("doe_population"))


def area_deltas(entities: DataFrame, targets: DataFrame, taus: list[float], deltas: list[float], lam: float, value: str = "p_year") -> DataFrame:
    """tau, area, delta, share, loss: for each global tau the best shift of each area's threshold.

    loss = weight * (share - target)^2 + lam * delta^2; ties to the smaller shift. targets (area, target, weight).
    """
    cuts = sorted({round(t + d, 10) for t in taus for d in deltas})
    wide = entities.groupBy("area").agg(F.sum("population").alias("_all"), F.array(*[F.coalesce(F.sum(F.when(F.col(value) >= c, F.col("population"))), F.lit(0.0)) for c in cuts]).alias("_w")).join(targets, "area")
    arms = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.lit(float(d)).alias("delta"), F.lit(cuts.index(round(t + d, 10))).alias("k")) for t in taus for d in deltas])).alias("s")
    rows = wide.select("area", "target", "weight", "_all", "_w", arms).select("area", "target", "weight", "s.tau", "s.delta", F.try_divide(F.element_at("_w", F.col("s.k") + 1), F.col("_all")).alias("share"))
    rows = rows.withColumn("loss", F.col("weight") * (F.col("share") - F.col("target")) ** 2 + lam * F.col("delta") ** 2)
    pick = F.min_by(F.struct("delta", "share", "loss"), F.struct(F.round("loss", 12), F.abs("delta"), F.col("delta"))).alias("b")
    return rows.groupBy("tau", "area").agg(pick).select("tau", "area", "b.*")


def best_tau(chosen: DataFrame, weights: DataFrame, target: float, penalty: float) -> DataFrame:
    """The tau with the least summed loss plus penalty on the national share; weights (area, population)."""
    j = chosen.join(weights, "area").groupBy("tau").agg(F.sum("loss").alias("area_loss"), F.try_divide(F.sum(F.col("share") * F.col("population")), F.sum("population")).alias("national"))
    return j.withColumn("loss", F.col("area_loss") + penalty * (F.col("national") - target) ** 2).orderBy("loss", "tau").limit(1)


def compare_keeps(a: DataFrame, b: DataFrame, static: DataFrame, value: str = "p_year") -> DataFrame:
    """entity, status (both, a_only, b_only, neither), difference of value; a, b (entity, electrified_best, value)."""
    x, y = (d.select("entity", F.col("electrified_best").alias(f"_{n}"), F.col(value).alias(f"{value}_{n}")) for d, n in ((a, "a"), (b, "b")))
    j = x.join(y, "entity", "full").join(static, "entity", "left")
    one, two = F.coalesce(F.col("_a"), F.lit(0)) == 1, F.coalesce(F.col("_b"), F.lit(0)) == 1
    return j.withColumn("status", F.when(one & two, "both").when(one, "a_only").when(two, "b_only").otherwise("neither")).withColumn("diff", F.col(f"{value}_a") - F.col(f"{value}_b")).drop("_a", "_b")


