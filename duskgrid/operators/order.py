"""Ranks, running sums and exact quantiles over whole tables without one task that holds all rows.

A number's bucket is a function of the number alone that never falls as the number rises. Counts and sums by bucket make
a small table (some thousands of rows, whatever the input), whose running sums place every bucket; inside a bucket the
rows are ordered by a window of their own. quantiles() orders distinct values with their counts, so values that repeat are no
burden; in running() values that repeat very often share a bucket, whose window may spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskgrid.functions import finite

#: Buckets in which the numbers between a power of two and the next one fall.
FINE = 64


def bucket(value: Column) -> Column:
    """The bucket of a finite number: by sign, and by the logarithm of its absolute value."""
    x = value.cast("double")
    size = F.floor((F.log2(F.abs(x)) + 1100) * FINE).cast("long")
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("long"))


def running(df: DataFrame, order: list[str], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """df with, for every name of sums, the sum up to and with each row in the given order, that before it (_before) and
    the total (_total), and _last, the value of order[0] in the row before. order[0] is a finite number."""
    by = by or []
    rows = df.withColumns({"_b": bucket(F.col(order[0])), **{f"{n}_own": c for n, c in sums.items()}})
    small = rows.groupBy(*by, "_b").agg(*[F.sum(f"{n}_own").alias(f"{n}_in") for n in sums], F.max(order[0]).alias("_top"))
    part = Window.partitionBy(*(by or [F.lit(1)]))
    ahead = part.orderBy("_b")
    earlier = ahead.rowsBetween(Window.unboundedPreceding, -1)
    placed = small.select(*by, "_b", *[F.coalesce(F.sum(f"{n}_in").over(earlier), F.lit(0)).alias(f"{n}_from") for n in sums], *[F.sum(f"{n}_in").over(part).alias(f"{n}_total") for n in sums], F.lag("_top").over(ahead).alias("_prior"))
    inside = Window.partitionBy(*by, "_b").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({**{n: F.sum(f"{n}_own").over(upto) for n in sums}, "_last": F.lag(order[0]).over(inside)}).join(placed, [*by, "_b"])
    out = out.withColumns({n: F.col(n) + F.col(f"{n}_from") for n in sums}).withColumns({**{f"{n}_before": F.col(n) - F.col(f"{n}_own") for n in sums}, "_last": F.coalesce("_last", "_prior")})
    return out.drop("_b", "_prior", *[f"{n}_own" for n in sums], *[f"{n}_from" for n in sums])


def quantiles(df: DataFrame, value: Column, probs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by and, for every name of probs, the exact quantile (linear interpolation) of the finite values.

    Of the values only those in the buckets that hold a wanted rank are ordered, each once with its count.
    """
    by = by or []
    # a value is one row from here on, with its count, however often it repeats
    rows = df.select(*by, value.cast("double").alias("_v")).where(finite("_v")).groupBy(*by, "_v").agg(F.count("*").alias("_k")).withColumn("_b", bucket(F.col("_v")))
    small = rows.groupBy(*by, "_b").agg(F.sum("_k").alias("_n"))
    part = Window.partitionBy(*(by or [F.lit(1)]))
    placed = small.select(*by, "_b", (F.sum("_n").over(part.orderBy("_b")) - F.col("_n")).alias("_from"), (F.sum("_n").over(part.orderBy("_b")) - 1).alias("_to"), F.sum("_n").over(part).alias("_total"))
    at = {n: (F.col("_total") - 1) * F.lit(float(p)) for n, p in probs.items()}
    wanted = F.array_distinct(F.array(*[f(h).cast("long") for h in at.values() for f in (F.floor, F.ceil)]))
    placed = placed.withColumn("_ranks", F.filter(wanted, lambda r: (r >= F.col("_from")) & (r <= F.col("_to")))).where(F.size("_ranks") > 0)
    upto = F.sum("_k").over(Window.partitionBy(*by, "_b").orderBy("_v")) + F.col("_from")
    ranked = rows.join(placed, [*by, "_b"]).withColumn("_end", upto).where(F.exists("_ranks", lambda r: (r >= F.col("_end") - F.col("_k")) & (r < F.col("_end"))))
    holds = lambda h: (h >= F.col("_end") - F.col("_k")) & (h < F.col("_end"))
    aggs = []
    for n, h in at.items():
        low, high = (F.max(F.when(holds(f(h).cast("long")), F.col("_v"))) for f in (F.floor, F.ceil))
        share = F.max(h - F.floor(h))
        aggs.append((low + share * (high - low)).alias(n))
    return ranked.groupBy(*by).agg(*aggs)
