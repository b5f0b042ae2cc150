"""Connected components of a link table by alternating stars.

Each turn is joins and aggregates on a node. The aggregates combine before they shuffle; in the joins a root of very many
members is one key, whose rows adaptive execution splits over tasks (spark.sql.adaptive.skewJoin).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskgrid.llm.common import deleted, new_path, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or the smaller and itself) tied to the smallest of node and neighbours."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        tied = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return tied.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) to (node, root): the smallest node that can be reached, for every node that isn't a root itself.

    Rows with a null end, loops and repeats mean nothing. Large-star and small-star take turns until the links are
    stars around roots; the number of turns grows with the logarithm of the longest path.
    """
    now = stored(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark, path = None, None
    while True:
        last, path = path, new_path(links.sparkSession, "stars")
        now = stored(_star(_star(now, True), False), "stars", path=path)
        deleted(links.sparkSession, [last] if last else [])
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
