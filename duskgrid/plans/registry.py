"""All queries of the reliability library and the SQL that says the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duskgrid.plans import inference, models, panels, pixels, series
from duskgrid.sources.views import expand, rounded, view, with_views

MODULES = [panels, pixels, series, models, inference]


@functools.cache
def catalog() -> dict:
    """name: (views, function of a view getter, SQL after the views, further CTEs that come right after the views)."""
    return {k: v for m in MODULES for k, v in m.catalog().items()}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalog()[name][1](functools.partial(view, spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: functools.partial(run, n) for n in catalog()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (views, _, body, *more) in catalog().items():
        if body:
            lead = with_views(*views) + "".join(f", {m}" for m in more)
            if body.startswith("RECURSIVE"):  # some CTE refers to itself
                lead, body = lead.replace("WITH ", "WITH RECURSIVE ", 1), body.removeprefix("RECURSIVE")
            out[name] = expand(f"{lead}\n{body}")
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run("rel4_area_metrics", spark, sf_dir)
