"""The driver's tables in the roles of the library's inputs, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "v_panel": """SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS n_valid,
        SUM(CASE WHEN l_discount >= 0.05 THEN l_quantity ELSE 0 END) AS n_lit,
        SUM(CASE WHEN l_discount >= 0.05 THEN l_quantity ELSE 0 END) / SUM(l_quantity) AS p,
        LEAST(1.0, SUM(l_quantity) / 50) AS coverage, SUM(l_extendedprice) / SUM(l_quantity) AS mean_rad
        FROM lineitem GROUP BY 1, 2""",
    "v_entities": """SELECT s_suppkey AS entity, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS population, s_acctbal + 1000 AS demand,
        n_name AS area, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_exposure": """SELECT CAST(o_orderdate AS DATE) AS date, SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END) AS mlr,
        SUM(o_totalprice) AS contracted FROM orders GROUP BY 1""",
    "v_hourly": """SELECT CAST(ts AS DATE) AS date, CAST(EXTRACT(HOUR FROM ts) AS INTEGER) AS hour,
        SUM(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS mlr, SUM(value) AS contracted FROM events GROUP BY 1, 2""",
    "v_visits": """SELECT user_id AS entity, CAST(ts AS DATE) AS date, AVG(CASE WHEN event_type IN ('error', 'click') THEN 1.0 ELSE 0.0 END) AS p,
        CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""",
    "v_pixels": """SELECT cell_id, date, rad,
        CAST(CASE WHEN h % 41 <> 11 THEN h % 2 + CASE WHEN h % 10 < 6 THEN 0 WHEN h % 10 < 8 THEN 64 WHEN h % 10 < 9 THEN 128 ELSE 192 END
          + CASE WHEN h % 11 = 3 THEN 256 ELSE 0 END + CASE WHEN h % 13 = 5 THEN 512 ELSE 0 END + CASE WHEN h % 17 = 7 THEN 1024 ELSE 0 END
          + CASE WHEN h % 19 = 2 THEN 4096 ELSE 0 END + CASE WHEN h % 23 = 4 THEN 8192 ELSE 0 END END AS INTEGER) AS qf_cloud,
        CAST(CASE WHEN h % 29 < 15 THEN 0 WHEN h % 29 < 24 THEN 1 WHEN h % 29 < 28 THEN 2 END AS INTEGER) AS mandatory_qf,
        CAST(CASE WHEN h % 31 = 6 THEN 1 WHEN h % 37 <> 9 THEN 0 END AS INTEGER) AS snow
        FROM (SELECT l_partkey AS cell_id, CAST(l_shipdate AS DATE) AS date, AVG(l_extendedprice) / 9973 AS rad,
          (CAST(l_partkey AS BIGINT) * 7919 + DAYOFYEAR(CAST(l_shipdate AS DATE)) * 104729 + YEAR(CAST(l_shipdate AS DATE)) * 6607) % 10007 AS h FROM lineitem GROUP BY 1, 2, 4) x""",
    "v_annual": """SELECT l_partkey AS cell_id, AVG(l_extendedprice) * (2 + l_partkey % 7) / 5 / 9973 AS rad, CAST(l_partkey % 4 AS INTEGER) AS quality FROM lineitem GROUP BY l_partkey""",
    "v_weights": """SELECT DISTINCT l_suppkey AS entity, l_partkey AS cell_id, (1 + (l_suppkey + l_partkey) % 10) / 10.0 AS coverage_fraction,
        CAST(200000 + l_partkey AS DOUBLE) AS cell_area_m2, (l_suppkey + l_partkey) % 10 >= 4 AS is_centre FROM lineitem""",
    "v_schedule": """SELECT event_id, event_type AS circuit, ts AS start, value AS minutes FROM events""",
    "v_points": """SELECT vec_id AS entity, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM embeddings""",
}
TABLES = ("region", "nation", "supplier", "orders", "lineitem", "events", "embeddings", "part", "customer")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet files of sf_dir; only the columns it names are read."""
    body = VIEWS[name].format(x="element_at(embedding, 1)", y="element_at(embedding, 2)")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in body}
    for t in used:  # named for this statement alone
        body = body.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(body.replace("10.0", "10.0D").replace("1.0 ELSE 0.0", "1.0D ELSE 0.0D").replace("LEAST(1.0,", "LEAST(1.0D,"), **used)


def with_views(*names: str) -> str:
    """`WITH ...` that defines the views for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(x='embedding[1]', y='embedding[2]')})" for n in names)


def expand(sql: str) -> str:
    """R(x) stands for x as a double rounded to six places, N(x) for x as BIGINT, I(x) for x as INTEGER."""
    for mark, made in (("R", "ROUND(CAST({} AS DOUBLE), 6)"), ("N", "CAST({} AS BIGINT)"), ("I", "CAST({} AS INTEGER)")):
        at = 0
        while (at := _found(sql, mark, at)) >= 0:
            end, depth = at + 2, 1
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            sql = sql[:at] + made.format(sql[at + 2 : end - 1]) + sql[end:]
            at += 1
    return sql


def _found(sql: str, mark: str, at: int) -> int:
    while (at := sql.find(f"{mark}(", at)) >= 0:
        if at == 0 or not (sql[at - 1].isalnum() or sql[at - 1] == "_"):
            return at
        at += 1
    return -1


def rounded(df: DataFrame) -> DataFrame:
    """df with doubles (and decimals) rounded to six places, as R() does in SQL."""
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if t == "double" or t.startswith(("decimal", "float")) else F.col(c) for c, t in df.dtypes])
