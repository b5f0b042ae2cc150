"""Nearest neighbours against brute force: recall, exact distances, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskgrid.llm import nearest


def test_hadamard_is_orthogonal():
    h = nearest.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))
    r = nearest.rotated(np.eye(5), 0, 0)
    assert np.allclose(r @ r.T, np.eye(5))


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[1500:1540] = x[10]  # one vector very often
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank int").repartition(5)
    got = {}
    for r in nearest.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(d[m[1]] - m[2]) < 1e-12 for m in mine)
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hit += len({m[1] for m in mine} & set(want.tolist()))
        if q == 1500:
            assert [m[1] for m in mine] == [10, *range(1501, 1510)]
    assert hit >= 0.9 * 300


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, None), (200, [0.0, 0.0]), (300, [float("nan"), 1.0]), (400, [None, 1.0]), (500, [1.0]), (600, [3.0]), (500, [7.0]), (3, [0.0, -2.0]), (3, [0.0, -2.0]), (4, [1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    got = [r for r in got if r.query_id != 600]
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 4), (0, 2, 3), (500, 1, 600)]  # of one length
    assert abs(got[1].score - 5**0.5) < 1e-12 and got[2].score == 2
    assert nearest.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_pairs_of_axes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.search(df, F.col("vec_id") % 100 == 0, k=5, hashes=2, probes=80).collect()
    hit = 0
    for q in range(0, 800, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(d)[:5].tolist()))
    assert hit >= 0.9 * 40


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_and_work_on_the_table(spark, sf):
    """Recall on the given vectors, and the share of all rows that a query is compared with."""
    import pyarrow.parquet as pq

    where = f"/root/testdata/{sf}/embeddings.parquet"
    t = pq.read_table(where, columns=["vec_id", "embedding"])
    ids, x = t["vec_id"].to_numpy(), nearest.matrix(t["embedding"].combine_chunks())
    got = {}
    for r in nearest.search(spark.read.parquet(where), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit, seen, queries = 0, [], np.flatnonzero(ids % 100 == 0)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    met = np.zeros((len(queries), len(x)), int)
    single = nearest.usable(spark.read.parquet(where))
    axes = nearest.axes(len(x), x.shape[1])
    probes = nearest.probes_wanted(single, single.where("vec_id % 100 = 0"), 10, nearest.TABLES, {x.shape[1]: axes})[x.shape[1]]
    for table in range(nearest.TABLES):
        own, asked = nearest.buckets(unit, table, axes, 1)[:, 0], nearest.buckets(unit[queries], table, axes, probes)
        met += (own[None, :, None] == asked[:, None, :]).any(axis=2)
    for i in queries:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        hit += len(got[ids[i]] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hit >= 0.95 * 10 * len(queries)
    assert (met > 0).mean() < (0.25 if sf == "sf0.1" else 0.5)
