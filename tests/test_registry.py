"""Every query against the SQL that says the same, on the smallest tables, and invariants of what SQL can't say."""

import datetime
import decimal
import functools
import math

import duckdb
import pytest

from duskgrid.plans import registry
from duskgrid.plans.series import national
from duskgrid.sources.views import view

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "orders", "lineitem", "events", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v)[:10] if isinstance(v, (datetime.date, datetime.datetime)) else v


def ordered(rows, columns):
    made = [tuple(plain(r[c]) for c in columns) for r in rows]
    return sorted(made, key=lambda t: [(v is None, str(type(v)) if not isinstance(v, (int, float)) else "", v if isinstance(v, (int, float)) else str(v)) for v in t])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    mine = registry.queries()[name](spark, SF)
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    theirs = [dict(zip(columns, r, strict=True)) for r in cur.fetchall()]
    assert sorted(mine.columns) == sorted(columns)
    a, b = ordered([r.asDict() for r in mine.collect()], sorted(columns)), ordered(theirs, sorted(columns))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) <= 1e-9 * abs(p)) for p, q in zip(x, y, strict=True)), (x, y)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_iterative_fits(spark):
    run = lambda n: registry.queries()[n](spark, "/root/testdata/sf0.01")
    ar = run("res4_ar1").first()
    assert 0 <= ar.phi < 1 and ar.se > 0
    boot, hac = run("res1_bootstrap").first(), run("reg4_newey_west").first()
    assert 0.5 < boot.se / hac.se_hac < 2 and abs(boot.mean - hac.slope) < 3 * hac.se_hac
    placebo = run("res2_permutation").first()
    assert placebo.n == 2000 and abs(placebo["mean"]) < 3 * placebo.sd and 0 < placebo.p_value <= 1
    w = run("reg16_wald").first()
    assert w.df == 3 and 0 <= w.p_value <= 1
    q = run("reg3_quasi_poisson").first()
    assert q.dispersion > 0 and q.se > 0
    ci = run("res6_mean_bootstrap").toPandas()
    assert (ci.low <= ci["mean"]).mean() > 0.95 and (ci.high >= ci["mean"]).mean() > 0.95


def test_whole_tables(spark):
    run = lambda n: registry.queries()[n](spark, SF)
    n = national(functools.partial(view, spark, SF)).where("strict_dark is not null and shed_share is not null").count()
    assert sorted(r.shift for r in run("res3_circular_shifts").collect()) == list(range(1, n)) and n > 366
    kept = run("cal9_compare_keeps").agg({"n": "sum"}).first()[0]
    assert kept == view(spark, SF, "v_panel").join(view(spark, SF, "v_entities"), "entity").select("entity").distinct().count()


#: Columns that are the same in every row by what they mean: bits that a value table counts, both scenarios' warning.
ALIKE = {"qa5_retained": {"warn"}}
PATH = [n for n in registry.queries() if n.startswith(("pix", "zon", "bas", "qa1", "qa2", "qa3", "qa4", "qa5"))]


@pytest.mark.parametrize("name", PATH)
def test_no_column_is_constant(spark, name):
    """The way from pixels to daily quality runs over data in which every flag has both outcomes."""
    rows = registry.queries()[name](spark, "/root/testdata/sf0.01").toPandas()
    assert len(rows) > 1
    assert {c for c in rows.columns if rows[c].nunique(dropna=True) < 2} - ALIKE.get(name, set()) == set()
