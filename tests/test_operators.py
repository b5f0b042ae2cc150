"""Hand-computed cases, each of a trap that null rules and ties set."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskgrid import functions as fn
from duskgrid.functions import tails
from duskgrid.operators import exposure, order, panel, pixels, regress, reliability, resample, series, spatial, states
from duskgrid.sources import io

D = dt.date
DAY = lambda i: D(2023, 1, 1) + dt.timedelta(days=i)


def one(df):
    return df.first().asDict()


def test_short_entity_has_no_window(spark):
    rows = [("a", DAY(i), 0.9, 1.0) for i in range(29)]
    df = spark.createDataFrame(rows, "entity string, date date, p double, coverage double")
    st = states.daily_states(panel.dense(df), n=30, least_obs=8, least_lit=15)
    assert st.where("n_lit is not null or n_obs is not null or electrified is not null or doe is not null or after_doe <> 0").count() == 0


def test_gap_is_neither_lit_nor_seen(spark):
    df = spark.createDataFrame([("a", DAY(0), 0.9), ("a", DAY(2), 0.01), ("b", DAY(1), 0.3)], "entity string, date date, p double")
    st = states.lit_dark(panel.dense(df), 0.4, 0.05)
    gap = one(st.where("entity = 'a'").where(F.col("date") == DAY(1)))
    assert gap["lit_day"] is None and gap["dark_day"] is None and gap["observed"] == 0 and st.count() == 6
    near = panel.neighbours(df, ["p"]).where("entity = 'a'").collect()
    assert all(r.prev_p is None and r.next_p is None for r in near)


def test_weighted_median_takes_half(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0), (1, 3.0, 2.0), (1, None, 9.0), (1, 9.0, -1.0)], "k int, x double, w double")
    assert one(pixels.weighted_median(df, "x", "w", ["k"]))["median"] == 2.0


def test_weights_zero_and_negative(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0), (5.0, -1.0), (float("nan"), 4.0), (None, 1.0), (7.0, None)], "x double, w double")
    got = df.agg(fn.weighted_mean("x", "w").alias("a"), fn.weighted_mean("x", "w", positive=False).alias("b"), fn.safe_sum("x").alias("s"), fn.safe_mean("w").alias("m")).first()
    assert (got.a, got.b, got.s) == (1.0, (2.0 - 5.0) / 1.0, 16.0)
    none = df.limit(0).agg(fn.safe_sum("x").alias("s"), fn.safe_mean("x").alias("m")).first()
    assert none.s == 0 and none.m is None


def test_area_without_entity_drops_with_share(spark):
    m = spark.createDataFrame([("e", D(2023, 1, 1), 1, 0.5, 0.1, 0.4, 0.1, 0.2, 0.3)], "entity string, period_start date, support_ok int, uptime double, dark_share double, mean_p double, sd_p double, cv_p double, switch_rate double")
    areas = spark.createDataFrame([("e", "x", 10.0), ("f", "x", 30.0), ("g", "y", 5.0), ("h", "z", None)], "entity string, area string, population double")
    got = {r.area: (r.period_start, r.coverage_share) for r in reliability.area_metrics(m, areas).collect()}
    assert got == {"x": (D(2023, 1, 1), 0.25), "y": (None, 0.0)}
    assert [r.area for r in reliability.area_metrics(m, areas, 0.2).collect()] == ["x"]


def test_radiance_at_the_threshold(spark):
    df = spark.createDataFrame([(1.0, 1), (1.1, 1), (5.0, 0), (None, 1)], "rad double, valid int")
    assert [r.lit for r in pixels.mask_radiance(df, 1.0).collect()] == [0, 1, None, None]
    assert [r.lit for r in pixels.mask_radiance(df, 1.0, strict=False).collect()] == [1, 1, None, None]


def test_constant_outcome(spark):
    df = spark.createDataFrame([("c", DAY(i), 0.5, float(i)) for i in range(20)] + [("d", DAY(i), 0.1 * i, float(i)) for i in range(20)], "entity string, date date, y double, x double")
    got = {r.entity: r for r in regress.entity_slopes(df, "y", "x", 3, 10).collect()}
    assert got["c"].slope == 0 and got["c"].t is None and abs(got["d"].slope - 0.1) < 1e-9
    assert one(regress.ols(df.where("entity = 'c'").limit(5), "y", "x"))["slope"] is None


def test_interval_across_midnight(spark):
    df = spark.createDataFrame([("c", dt.datetime(2023, 5, 1, 23, 0), 150.0)], "circuit string, start timestamp, minutes double")
    got = exposure.window_overlap(df, 1, 2).collect()
    assert [(r.circuit, r.date, r.overlap_s) for r in got] == [("c", D(2023, 5, 2), 1800.0)]


def test_centred_window_across_midnight(spark):
    rows = [(DAY(d), h, float(100 * d + h), 1000.0) for d in range(3) for h in range(24)]
    df = spark.createDataFrame(rows, "date date, hour int, mlr double, contracted double")
    got = one(exposure.centred_window(df, df.where(F.col("date") == DAY(1)).select("date").distinct(), 0, -1, 2))
    assert got["mlr_sum"] == 23 + 100 + 101 + 102 and got["n_hours"] == 4 and abs(got["shed_share"] - 326 / 4000) < 1e-12
    assert abs(one(exposure.window_exposure(df.where("mlr = 23"), [23], denominator="total"))["shed_share"] - 23 / 1023) < 1e-12


def test_robust_z_falls_back(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 5.0), ("b", 1.0), ("b", 2.0), ("c", 3.0), ("c", 3.0), ("c", 3.0)], "g string, v double")
    got = {(r.g, r.v): r.z_v for r in series.robust_z(df, "v", ["g"]).collect()}
    assert abs(got["a", 5.0] - 1.5) < 1e-9 and got["b", 1.0] is None and got["c", 3.0] is None


def test_missing_neighbour_is_not_skipped(spark):
    df = spark.createDataFrame([(0.0, 0.9, None, 1.0, 1.0, None), (0.0, 0.9, 0.8, 1.0, 0.5, 0.9)], "p double, prev_p double, next_p double, coverage double, prev_coverage double, next_coverage double")
    got = series.candidates(df, 0.1, 0.3).collect()
    assert len(got) == 1 and abs(got[0].neighbour_drop - 0.8) < 1e-12 and got[0].min_coverage == 0.5


def test_tails():
    assert abs(tails.t_two_sided(2.228138852, 10) - 0.05) < 1e-8
    assert abs(tails.normal_two_sided(1.959963985) - 0.05) < 1e-8
    assert abs(tails.chi2_upper(7.814727903, 3) - 0.05) < 1e-8 and abs(tails.chi2_upper(0.35184632, 3) - 0.95) < 1e-7
    assert abs(tails.t_quantile(0.975, 5) - 2.570581836) < 1e-6


def test_p_values_and_auc(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), int(i > 10)) for i in range(20)], "y double, x double, c int")
    r = tails.with_p_values(regress.ols(df, "y", "x")).first()
    assert abs(r.p_value - tails.t_two_sided(r.t, r.df)) < 1e-12
    assert one(regress.auc(df, "y", "c"))["auc"] == 1.0


def test_two_way_is_exact(spark):
    rng = __import__("random").Random(1)
    rows = [(e, q, x := rng.random(), 2 * x + e + 5 * q + 0.01 * rng.random()) for e in range(12) for q in (1, 2, 3) for _ in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "e int, q int, x double, y double")
    assert abs(one(regress.two_way(df, "y", "x", "e", "q", [1, 2, 3]))["slope"] - 2) < 0.02


def test_two_large_factors_by_alternation(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for g, halves in (("a", 1), ("b", 2)):  # the graph of b has two components
        own = []
        for e in range(18):
            for d in rng.choice(30 // halves, 9, replace=False) + (e % halves) * 15:
                for _ in range(rng.integers(1, 3)):
                    x = rng.normal() + 0.3 * e - 0.1 * d
                    own.append((g, f"e{e}", int(d), float(x), float(1.5 * x + e - 0.2 * d + rng.normal())))
        rows += own
        x, y = np.array([[r[3], r[4]] for r in own]).T
        dummies = [[float(r[1] == f"e{e}") for e in range(18)] + [float(r[2] == d) for d in range(30)] for r in own]
        full = np.column_stack([x, np.array(dummies)])
        rank = np.linalg.matrix_rank(full)
        beta, *_ = np.linalg.lstsq(full, y, rcond=None)
        rest = x - np.array(dummies) @ np.linalg.lstsq(np.array(dummies), x, rcond=None)[0]
        s2 = ((y - full @ beta) ** 2).sum() / (len(y) - rank)
        want[g] = (len(y), beta[0], (s2 / (rest**2).sum()) ** 0.5, len(y) - rank)
    df = spark.createDataFrame([*rows, ("a", None, 1, 1.0, 1.0), ("a", "e1", 1, None, 1.0)], "g string, e string, d int, x double, y double")
    for r in regress.two_way_effects(df, "y", "x", "e", "d", ["g"]).collect():
        assert (r.n, r.df) == (want[r.g][0], want[r.g][3]) and abs(r.slope - want[r.g][1]) < 1e-8 and abs(r.se - want[r.g][2]) < 1e-8
    alone = one(regress.two_way_effects(df.where("g = 'b'"), "y", "x", "e", "d"))
    assert abs(alone["slope"] - want["b"][1]) < 1e-8
    flat = one(regress.two_way_effects(df.withColumn("x", F.col("d").cast("double")), "y", "x", "e", "d"))
    assert flat["slope"] is None and flat["n"] == len(rows) + 1


def test_grouped_poisson_and_wald(spark):
    rng = np.random.default_rng(2)
    rows = [(g, DAY(i), float(x := rng.normal()), float(z := rng.normal()), float(rng.poisson(np.exp(0.4 + 0.3 * k * x)))) for k, g in enumerate("abc") for i in range(80 + 20 * k) for _ in [0]]
    df = spark.createDataFrame([*rows, ("d", DAY(0), 1.0, 1.0, 0.0), ("d", DAY(1), 2.0, 1.0, 0.0), ("d", DAY(2), 3.0, 0.0, 0.0), (None, DAY(1), 1.0, 1.0, 1.0)], "g string, date date, x double, z double, y double")
    got = {r.g: r for r in regress.quasi_poisson(df, "y", "x", ["g"]).collect()}
    assert set(got) == set("abc")
    wald = {r.g: r for r in regress.wald_hac(df, "y", ["x", "z"], ["x", "z"], "date", 3, ["g"]).collect()}
    for g in "abc":
        x, z, y = np.array([r[2:] for r in rows if r[0] == g]).T
        m = np.column_stack([np.ones(len(x)), x])
        b = np.array([np.log(y.mean()), 0.0])
        for _ in range(50):
            mu = np.exp(m @ b)
            b = b + np.linalg.solve((m * mu[:, None]).T @ m, m.T @ (y - mu))
        phi = ((y - mu) ** 2 / mu).sum() / (len(y) - 2)
        se = np.sqrt(np.linalg.inv((m * mu[:, None]).T @ m)[1, 1] * phi)
        assert got[g].n == len(y) and np.allclose([got[g].intercept, got[g].slope, got[g].se, got[g].dispersion], [*b, se, phi], atol=1e-8)
        m = np.column_stack([np.ones(len(x)), x, z])
        b = np.linalg.lstsq(m, y, rcond=None)[0]
        s = m * (y - m @ b)[:, None]
        meat = s.T @ s
        for j in range(1, 4):
            c = s[j:].T @ s[:-j]
            meat += (1 - j / 4) * (c + c.T)
        inv = np.linalg.inv(m.T @ m)
        v = (inv @ meat @ inv * len(y) / (len(y) - 3))[1:, 1:]
        assert abs(wald[g].statistic - b[1:] @ np.linalg.solve(v, b[1:])) < 1e-8 and wald[g].n == len(y)
    alone = one(regress.quasi_poisson(df.where("g = 'b'"), "y", "x"))
    assert abs(alone["slope"] - got["b"].slope) < 1e-9 and alone["rounds"] < 15


def test_grouped_resampling(spark):
    import hashlib

    rng = np.random.default_rng(5)
    md5 = lambda *p: int(hashlib.md5(",".join(map(str, p)).encode()).hexdigest()[:8], 16)
    data = {g: rng.normal(size=(2, n)) for g, n in (("a", 40), ("b", 55), ("c", 9))}
    rows = [(g, DAY(i), float(y), float(x)) for g, (ys, xs) in data.items() for i, (y, x) in enumerate(zip(ys, xs))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(g, d, float(y), float(x)) for g, d, y, x in rows], "g string, date date, y double, x double")
    slope = lambda y, x: np.polyfit(x, y, 1)[0]
    boot = {(r.g, r.draw): r.slope for r in resample.block_bootstrap(df, "y", "x", "date", 300, 7, ["g"]).collect()}
    perm = {(r.g, r.draw): r.slope for r in resample.block_permutation(df, "y", "x", "date", 300, 7, ["g"]).collect()}
    turn = {(r.g, r["shift"]): r.slope for r in resample.circular_shifts(df, "y", "x", "date", ["g"]).collect()}
    assert len(boot) == len(perm) == 900 and len(turn) == 39 + 54 + 8
    for g, (y, x) in data.items():
        n, k = len(y), -(-len(y) // 7)
        for d in (0, 17, 249, 250, 299):
            at = np.array([(md5(d, b, 17) % n + o) % n for b in range(k) for o in range(7)][:n])
            assert abs(boot[g, d] - slope(y[at], x[at])) < 1e-9
            at = [i for b in sorted(range(k), key=lambda b: (md5(d, b, 5), b)) for i in range(7 * b, min(n, 7 * b + 7))]
            assert abs(perm[g, d] - slope(y, x[at])) < 1e-9
        assert abs(turn[g, 3] - slope(y, np.roll(x, -3))) < 1e-9
    s = {r.g: r for r in resample.bootstrap_summary(resample.block_bootstrap(df, "y", "x", "date", 300, 7, ["g"]), ["g"]).collect()}
    assert abs(s["a"].mean - np.mean([boot["a", d] for d in range(300)])) < 1e-9 and s["a"].n == 300
    p = {r.g: r for r in resample.placebo_summary(df, "y", "x", resample.block_permutation(df, "y", "x", "date", 300, 7, ["g"]), ["g"]).collect()}
    assert abs(p["b"].actual - slope(*data["b"])) < 1e-9
    flat = df.withColumn("x", F.lit(1.0))
    assert {r.slope for r in resample.block_bootstrap(flat, "y", "x", "date", 3, 7, ["g"]).collect()} == {None}


def test_grouped_ar1_is_the_maximum(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g, phi in (("a", 0.7), ("b", 0.0), ("c", 0.35)):
        e = 0.0
        for i in range(300):
            e = phi * e + rng.normal()
            if rng.random() < 0.8:  # gaps
                x = rng.normal()
                rows.append((g, DAY(i), 2 * x + e, x))
    df = spark.createDataFrame([(g, d, float(y), float(x)) for g, d, y, x in rows] + [("z", DAY(1), 1.0, 1.0)], "g string, date date, y double, x double")
    got = {r.g: r for r in resample.ar1_fit(df, "y", "x", by=["g"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, r in got.items():
        own = [x for x in rows if x[0] == g]
        gap, y, x = np.diff([d.toordinal() for _, d, *_ in own]).astype(float), np.array([v[2] for v in own]), np.array([v[3] for v in own])
        loglik = lambda p: resample._gls(gap, y, x, np.array([p]))[0, 3]  # noqa: E731, B023
        if r.phi > 1e-4:
            slope = (loglik(r.phi + 1e-5) - loglik(r.phi - 1e-5)) / 2e-5
            bend = (loglik(r.phi + 1e-3) - 2 * loglik(r.phi) + loglik(r.phi - 1e-3)) / 1e-6
            assert abs(slope / bend) < 1e-6
        p = r.phi
        cov = p ** np.abs(np.subtract.outer(*[[d.toordinal() for _, d, *_ in own]] * 2)) if p > 0 else np.eye(len(own))
        m, inv = np.column_stack([x, np.ones(len(x))]), np.linalg.inv(cov)
        assert np.allclose([r.slope, r.intercept], np.linalg.solve(m.T @ inv @ m, m.T @ inv @ y), atol=1e-8)
    assert abs(got["a"].phi - 0.7) < 0.12


def test_mean_bootstrap_merges_and_agrees_with_resampling(spark):
    rng = np.random.default_rng(4)
    rows = [(("a", "b", None)[i % 3], i, float(rng.gamma(2))) for i in range(900)]
    df = spark.createDataFrame([*rows, ("c", -1, None)], "g string, i int, v double").repartition(5)
    got = {r.g: r for r in resample.mean_bootstrap(df, "v", "g", ["g", "i"], 600).collect()}
    few = {r.g: r for r in resample.mean_bootstrap(df.repartition(2), "v", "g", ["g", "i"], 600, held=1).collect()}
    for g in "ab":
        v = np.array([r[2] for r in rows if r[0] == g])
        means = np.array([rng.choice(v, len(v)).mean() for _ in range(3000)])
        low, high = np.quantile(means, [0.025, 0.975])
        assert got[g].n == 300 and abs(got[g]["mean"] - v.mean()) < 1e-12
        assert abs(got[g].low - low) < 0.25 * (high - low) and abs(got[g].high - high) < 0.25 * (high - low)
        assert abs(few[g].low - got[g].low) < 1e-12 and abs(few[g].high - got[g].high) < 1e-12


def test_tails_of_arrays():
    t, df = np.array([0.0, 0.5, 2.0, 8.0, 50.0] * 40), np.repeat([1, 2, 3, 7, 30, 200, 3000, 100000], 25)
    p = tails.t_two_sided(t, df)
    assert np.allclose(p[:3], [1, 2 / np.pi * np.arctan(2), 2 / np.pi * np.arctan(0.5)]) and (np.diff(p.reshape(-1, 5), axis=1) <= 0).all()
    for v in (1, 2, 5, 60, 12345):
        assert abs(1 - tails.t_two_sided(tails.t_quantile(0.975, v), v) / 2 - 0.975) < 1e-12
    assert np.allclose(tails.t_quantile(0.975, np.array([5, 1, 5])), [2.5705818356, 12.7062047362, 2.5705818356])


def test_ar1_finds_phi(spark):
    rng = __import__("random").Random(3)
    e, rows = 0.0, []
    for i in range(600):
        e = 0.6 * e + rng.gauss(0, 1)
        x = rng.random()
        rows.append((DAY(i), 3 * x + e, x))
    got = one(resample.ar1_fit(spark.createDataFrame(rows, "date date, y double, x double"), "y", "x"))
    assert abs(got["phi"] - 0.6) < 0.1 and abs(got["slope"] - 3) < 0.4


def test_area_edges_and_overlap(spark):
    sq = lambda a, x: [(a, x, 0.0, x + 1, 0.0), (a, x + 1, 0.0, x + 1, 1.0), (a, x + 1, 1.0, x, 1.0), (a, x, 1.0, x, 0.0)]
    edges = spark.createDataFrame(sq("b", 0.0) + sq("a", 0.5), "area string, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 0.2, 0.5), (2, 0.7, 0.5), (3, 2.0, 0.5), (4, 0.2, 1.0), (5, None, 0.1)], "entity int, x double, y double")
    assert {r.entity: r.area for r in spatial.assign_area(pts, edges, 0.3).collect()} == {1: "b", 2: "a", 3: None, 4: None, 5: None}


def test_monthly_panel_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", D(2023, 1, 5), 0.1), ("a", D(2023, 3, 5), 0.2)], "entity string, date date, p double")
    path = io.write_panel(df, f"{tmp_path}/panel")
    io.write_panel(df.where("p = 0.2").withColumn("p", F.lit(0.3)), path)
    assert {r.p for r in io.read_panel(spark, path, "2023-01", "2023-03", allow_partial=True).collect()} == {0.1, 0.3}
    with pytest.raises(io.MissingMonths, match="2023-02"):
        io.read_panel(spark, path, "2023-01", "2023-03")
    assert io.read_panel(spark, path, "2023-03", "2023-03", columns=["p"]).columns == ["p"]


def test_hourly_csv_and_tables(spark, tmp_path):
    (tmp_path / "h.csv").write_text("ts,mlr\n2023-03-26 02:30,1\n2023-03-26T03:00,2\n")
    got = io.read_hourly_exposure(spark, str(tmp_path / "h.csv"), "ts", "ts string, mlr double").orderBy("hour").collect()
    assert [(r.date, r.hour) for r in got] == [(D(2023, 3, 26), 2), (D(2023, 3, 26), 3)]
    (tmp_path / "bad.csv").write_text("ts,mlr\nyesterday,1\n")
    with pytest.raises(ValueError, match="timestamps"):
        io.read_hourly_exposure(spark, str(tmp_path / "bad.csv"), "ts", "ts string, mlr double")
    path = io.write_table(spark.createDataFrame([(1, "x")], "a int, b string"), f"{tmp_path}/t")
    assert spark.read.csv(path, header=True).first().b == "x"


def test_state_cache(spark, tmp_path):
    calls = []
    build = lambda: (calls.append(1), spark.range(3))[1]
    with pytest.raises(FileNotFoundError):
        io.state_cache(spark, str(tmp_path), {"n": 30}, build, "metrics_only")
    for _ in range(2):
        assert io.state_cache(spark, str(tmp_path), {"n": 30}, build).count() == 3
    io.state_cache(spark, str(tmp_path), {"n": 31}, build)
    io.state_cache(spark, str(tmp_path), {"n": 30}, build, "full")
    assert len(calls) == 3


def test_validators(spark):
    df = spark.createDataFrame([("a", 1.2, "lit"), ("b", 0.5, "odd"), ("c", None, None)], "entity string, p double, state string")
    assert one(panel.violations(df, ["entity"], ["lit", "dark"])) == {"n": 3, "bad_p": 1, "bad_state": 1}
    with pytest.raises(ValueError, match="missing: q"):
        panel.validate(df, ["q"])
    with pytest.raises(ValueError, match="bad_p"):
        panel.validate(df, ["p"])


def test_date_in_name(spark):
    names = ["VJ_2023-10-04.tif", "x_20231005_b", "y_2023_10_06", "none", "2023-99-99"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(io.date_in_name(F.col("n")).alias("d")).collect()
    assert [r.d for r in got] == [D(2023, 10, 4), D(2023, 10, 5), D(2023, 10, 6), None, None]
    assert math.isfinite(1.0)


@pytest.mark.parametrize("cell", [0.25, 1.0, 7.0])
def test_cells_equal_rays(spark, cell):
    """Random, grid-aligned and star-shaped areas, with points on grid lines and corners, against rays over all sides."""
    rng = np.random.default_rng(int(cell * 8))
    rings = {}
    for k in range(12):
        n = int(rng.integers(3, 9))
        turn = np.sort(rng.uniform(0, 2 * np.pi, n))
        r = rng.uniform(0.3, 3, n)
        ring = np.column_stack([r * np.cos(turn), r * np.sin(turn)]) + rng.uniform(-3, 3, 2)
        rings[f"a{k:02d}"] = [np.round(ring * 4) / 4 if k % 2 else ring]
    rings["b"] = [np.array([[-2.0, -2], [2, -2], [2, 2], [-2, 2]]), np.array([[-1.0, -1], [-1, 1], [1, 1], [1, -1]])]  # with a hole
    sides = [(a, *map(float, (*p, *q))) for a, parts in rings.items() for ring in parts for p, q in zip(ring, np.roll(ring, -1, axis=0))]
    pts = np.concatenate([rng.uniform(-6, 6, (400, 2)), rng.integers(-20, 21, (300, 2)) / 4, np.column_stack([rng.integers(-20, 21, 100) / 4, rng.uniform(-6, 6, 100)])])
    want = {}
    for i, (x, y) in enumerate(pts.tolist()):
        found = [a for a in rings if sum(min(s[2], s[4]) <= y < max(s[2], s[4]) and x < s[1] + (y - s[2]) / (s[4] - s[2]) * (s[3] - s[1]) for s in sides if s[0] == a and s[2] != s[4]) % 2]
        want[i] = min(found, default=None)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "entity int, x double, y double")
    edges = spark.createDataFrame(sides, "area string, x1 double, y1 double, x2 double, y2 double")
    got = {r.entity: r.area for r in spatial.assign_area(df, edges, cell).collect()}
    assert got == want


def test_cells_know_their_own_areas_only(spark):
    """However many areas there are, a point meets those of its cell."""
    sq = lambda k: [(f"a{k}", k, 0.0, k + 1.0, 0.0), (f"a{k}", k + 1.0, 0.0, k + 1.0, 1.0), (f"a{k}", k + 1.0, 1.0, k, 1.0), (f"a{k}", k, 1.0, k, 0.0)]
    edges = spark.createDataFrame([s for k in range(300) for s in sq(float(k))], "area string, x1 double, y1 double, x2 double, y2 double")
    index = spatial.area_index(edges, 0.25)
    assert index.groupBy("cx", "cy").count().agg(F.max("count")).first()[0] <= 2
    assert index.where("sides is null").count() > 0


def test_block_bootstrap_agrees_with_random_starts(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    n, block, draws = 1500, 14, 400
    e, x = np.zeros((2, n))
    for i in range(1, n):
        e[i], x[i] = 0.7 * e[i - 1] + rng.normal(), 0.7 * x[i - 1] + rng.normal()
    y = 0.3 * x + e
    slopes = []
    for _ in range(2000):
        i = ((rng.integers(0, n, -(-n // block))[:, None] + np.arange(block)) % n).ravel()[:n]
        slopes.append(np.polyfit(x[i], y[i], 1)[0])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))], "day int, y double, x double")
    se = resample.bootstrap_summary(resample.block_bootstrap(df, "y", "x", "day", draws, block)).first().se
    assert abs(se / np.std(slopes, ddof=1) - 1) < 0.2


def test_factor_grids_equal_least_squares(spark):
    rng = np.random.default_rng(3)
    rows = [(f"b{rng.integers(4)}", int(rng.integers(30)), float(rng.normal()), float(rng.random() + 0.5)) for _ in range(400)]
    table = [(b, d, d % 5, 0.3 * x + 0.2 * int(b[1]) + 0.1 * d + float(rng.normal()), x, w, 7.0) for b, d, x, w in rows]
    df = spark.createDataFrame(table, "b string, d int, m int, y double, x double, w double, flat double")
    y, x, w = (np.array([r[i] for r in table]) for i in (3, 4, 5))
    hot = lambda i, drop=True: np.array([[r[i] == v for v in sorted({r[i] for r in table})[drop:]] for r in table], float)
    one = np.ones((len(y), 1))
    specs = {"none": (None, {}), "date": ("d", {}), "b_m": (None, {"b": ["b0", "b1", "b2", "b3"], "m": [0, 1, 2, 3, 4]}), "date_b": ("d", {"b": ["b0", "b1", "b2", "b3"]})}
    designs = {"none": [], "date": [hot(1)], "b_m": [hot(0), hot(2)], "date_b": [hot(1), hot(0)]}
    got = {(r.exposure, r.spec): r for r in regress.factor_grid(df, "y", ["x", "flat"], specs).collect()}
    for name, more in designs.items():
        z = np.hstack([x[:, None], one, *more])
        beta, _, rank, _ = np.linalg.lstsq(z, y, rcond=None)
        rss = ((y - z @ beta) ** 2).sum()
        r = got["x", name]
        assert r.df == len(y) - rank and abs(r.slope - beta[0]) < 1e-9
        assert abs(r.se - np.sqrt(np.linalg.pinv(z.T @ z)[0, 0] * rss / r.df)) < 1e-9 and abs(r.r2 - (1 - rss / ((y - y.mean()) ** 2).sum())) < 1e-9
        assert got["flat", name].slope is None
    grid = {(r.outcome, r.weight, r.spec): r for r in regress.fe_control_grid(df.withColumn("z", F.col("y") * 2), ["y", "z"], "x", [None, "w"], {"none": {}, "m": {"m": [0, 1, 2, 3, 4]}}, "b", "d").collect()}
    date = np.array([r[1] for r in table])
    for weight in ("none", "w"):
        for spec, more in (("none", []), ("m", [hot(2)])):
            k = np.sqrt(w if weight == "w" else np.ones(len(y)))
            z = np.hstack([x[:, None], hot(0, False), *more])
            beta, _, rank, _ = np.linalg.lstsq(z * k[:, None], y * k, rcond=None)
            bread = np.linalg.pinv((z * k[:, None]).T @ (z * k[:, None]))
            score = np.array([(z * (k**2 * (y - z @ beta))[:, None])[date == d].sum(axis=0) for d in np.unique(date)])
            g = len(score)
            se = np.sqrt((bread @ score.T @ score @ bread)[0, 0] * g / (g - 1) * (len(y) - 1) / (len(y) - rank))
            r = grid["y", weight, spec]
            assert abs(r.slope - beta[0]) < 1e-9 and abs(r.se_cluster - se) < 1e-9 and abs(grid["z", weight, spec].slope - 2 * beta[0]) < 1e-9


def test_order_in_two_levels(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 3, 400), np.zeros(80), np.repeat(2.5, 60), rng.normal(0, 1e6, 60)])
    df = spark.createDataFrame([(int(i % 3), float(v), int(i), float(i % 7)) for i, v in enumerate(x)] + [(0, None, -1, 1.0), (1, float("nan"), -2, 1.0)], "g int, x double, i int, w double")
    got = order.quantiles(df, F.col("x"), {"a": 0.0, "b": 0.31, "c": 0.5, "d": 1.0}, ["g"]).collect()
    for r in got:
        assert np.allclose([r.a, r.b, r.c, r.d], np.quantile(x[np.arange(len(x)) % 3 == r.g], [0, 0.31, 0.5, 1.0]))
    rows = order.running(df.where("x is not null and not isnan(x)"), ["x", "i"], {"k": F.lit(1), "s": F.col("w")}).orderBy("k").collect()
    want = sorted((float(v), i) for i, v in enumerate(x))
    assert [(r.x, r.i) for r in rows] == want and [r.k for r in rows] == list(range(1, len(x) + 1))
    assert np.allclose([r.s for r in rows], np.cumsum([i % 7 for _, i in want])) and [r["_last"] for r in rows[1:]] == [v for v, _ in want[:-1]] and rows[0]["_last"] is None
    assert order.quantiles(df.limit(0), F.col("x"), {"a": 0.5}).first().a is None and order.quantiles(df.limit(0), F.col("x"), {"a": 0.5}, ["g"]).count() == 0


def test_bootstrap_error_is_that_of_random_draws(spark):
    rng = np.random.default_rng(1)
    n = 700
    x = rng.normal(size=n)
    e = np.zeros(n)
    for t in range(1, n):
        e[t] = 0.6 * e[t - 1] + rng.normal()
    y = 0.5 * x + e
    import datetime

    df = spark.createDataFrame([(datetime.date(2000, 1, 1) + datetime.timedelta(i), float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))], "date date, y double, x double")
    s = resample.bootstrap_summary(resample.block_bootstrap(df, "y", "x", "date", 1000, 14)).first()
    slopes = []
    for _ in range(1000):
        i = (rng.integers(n, size=n // 14)[:, None] + np.arange(14)).ravel() % n
        slopes.append(np.polyfit(x[i], y[i], 1)[0])
    assert 0.9 < s.se / np.std(slopes) < 1.1 and s.p_value == 2 / 1001


def panel_rows(spark, months, scale=1.0, entities=4):
    rows = [(e, d, None if (e + i) % 5 == 0 else scale * ((i * (e + 3)) % 7) / 6, 1.0) for e in range(entities) for i in range(400) if (d := DAY(i)).strftime("%Y-%m") in months and (e * 7 + i) % 6]
    return spark.createDataFrame(rows, "entity long, date date, p double, coverage double")


def test_states_by_month_follow_their_files(spark, tmp_path):
    import os

    path, folder, rule = f"file://{tmp_path}/panel", f"file://{tmp_path}/states", {"n": 10, "least_obs": 4, "least_lit": 2}
    all_months = [f"2023-{m:02d}" for m in range(1, 9)]

    def same():
        got, made = io.monthly_states(spark, path, folder, **rule)
        cols = ["entity", "date", "n_lit", "n_obs", "electrified", "doe", "after_doe"]
        whole = states.daily_states(panel.dense(spark.read.parquet(path).select("entity", "date", "p", "coverage")), **rule)
        rows = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=str)
        assert rows(got) == rows(whole)
        return made

    io.write_panel(panel_rows(spark, all_months[:6]), path)
    assert same() == all_months[:6]
    assert same() == []
    io.write_panel(panel_rows(spark, all_months[6:7]), path)
    assert same() == ["2023-06", "2023-07"]  # June's last days look into July
    io.write_panel(panel_rows(spark, ["2023-03"], 0.1), path)
    assert same() == ["2023-02", "2023-03"]
    # files of months out of reach are not read: here they hold rubbish of the same size and time
    saved = {}
    for m in all_months[:5]:
        for name in os.listdir(tmp_path / "panel" / f"month={m}"):
            f = tmp_path / "panel" / f"month={m}" / name
            at = f.stat()
            saved[f] = f.read_bytes(), at
            f.write_bytes(b"x" * at.st_size)
            os.utime(f, ns=(at.st_atime_ns, at.st_mtime_ns))
    io.write_panel(panel_rows(spark, all_months[7:8]), path)
    got, made = io.monthly_states(spark, path, folder, **rule)
    assert made == ["2023-07", "2023-08"] and got.count() > 0
    for f, (data, at) in saved.items():
        f.write_bytes(data)
        os.utime(f, ns=(at.st_atime_ns, at.st_mtime_ns))
    assert same() == []
    io.write_panel(panel_rows(spark, ["2023-08"], entities=6), path)  # new entities have rows in every month
    assert same() == all_months
    rule["least_lit"] = 3
    assert same() == all_months


def test_file_scans_tell_what_they_refuse(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.csv").write_text("ts,mw\n2023-01-01 05:10,1.5\n2023-01-01 25:10,2\nnoon,3\n2023-01-02 00:00,x\n,4\n")
    rows = {r.mw: r for r in io.scan_hourly(spark, f"file://{tmp_path}/h", "ts", "ts string, mw double").collect()}
    assert (rows[1.5].date, rows[1.5].hour, rows[1.5].refused, rows[1.5].file) == (D(2023, 1, 1), 5, None, "a.csv")
    assert rows[2.0].refused == "2023-01-01 25:10" and rows[3.0].refused == "noon" and rows[None].refused == "2023-01-02 00:00,x" and rows[4.0].refused == ""
    (tmp_path / "s.csv").write_text('code,wkt,name\n1,"POINT (1.5 -2e1)","a, ""b"""\n2,LINESTRING (0 0),c\nx,POINT(1 2),d\n')
    got = io.scan_entities(spark, f"file://{tmp_path}/s.csv", "code long, wkt string, name string").orderBy("name").collect()
    assert [(r.code, r.x, r.y, r.name, r.refused) for r in got] == [(1, 1.5, -20.0, 'a, "b"', None), (2, None, None, "c", "LINESTRING (0 0)"), (None, 1.0, 2.0, "d", "x,POINT(1 2),d")]
    (tmp_path / "x.txt").write_text("# note\n\n2023-01-05; Obvious\n2023-02-30 maybe\n2023-01-06 perhaps\n2023-01-07\n")
    got = io.scan_exclusions(spark, f"file://{tmp_path}/x.txt").collect()
    assert sorted(((str(r.date), r.kind, r.refused) for r in got), key=str) == [("2023-01-05", "obvious", None), ("2023-01-06", "perhaps", "2023-01-06 perhaps"), ("2023-01-07", None, "2023-01-07"), ("None", "maybe", "2023-02-30 maybe")]
    assert [r.refused is None for r in sorted(got, key=lambda r: str(r.kind))].count(True) == 1


def test_copartitioned_pixels_join_without_a_shuffle(spark, tmp_path):
    import functools

    from duskgrid.plans import pixels as plan
    from duskgrid.sources.views import view

    states_, weights = plan.copartitioned(functools.partial(view, spark, "/root/testdata/sf0.001"), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = states_.join(weights, "cell_id")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and text.count("Join") >= 2
        text = pixels.zonal_states(states_, weights)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1  # by entity and date
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows = spark.createDataFrame([(i % 7, float(i)) for i in range(40)], "k int, v double")
    path = io.write_bucketed(rows, f"file://{tmp_path}/b", "k", 3)
    spark.sql(f"DROP TABLE {io._bucketed_name(path)}")  # as in a new session
    again = io.read_bucketed(spark, path, "k", 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
    assert "Exchange" not in again.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()


def test_quantiles_of_values_that_repeat(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.zeros(4000), np.round(rng.normal(size=600), 1), [1e9, -1e9]])
    g = rng.integers(0, 3, len(v))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double")
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.93, "e": 0.987, "f": 1.0}
    for r in order.quantiles(df, F.col("v"), probs, ["g"]).collect():
        assert np.allclose([r[n] for n in probs], np.quantile(v[g == r.g], list(probs.values())))
    assert np.allclose(list(one(order.quantiles(df, F.col("v"), probs)).values()), np.quantile(v, list(probs.values())))
    text = order.quantiles(df, F.col("v"), probs)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in text


def test_shared_folder_where_none_is_named():
    class Session:  # a session that, like Spark's, can't be given the setting any more
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            applicationId, master = "app-1", "local[2]"

    from duskgrid.sources import io

    a, b = io.shared_path(Session, "x"), io.shared_path(Session, "x")
    assert a.startswith("file:///") and a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    Session.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        io.shared_path(Session, "x")


def test_backward_fill_reads_its_frame_once(spark):
    rows = [("a", DAY(i), {1: 5.0, 3: 7.0}.get(i)) for i in range(5)] + [("b", DAY(i), None) for i in range(3)]
    out = panel.fill_static(spark.createDataFrame(rows, "entity string, date date, x double"), ["x"])
    assert [r.x for r in out.orderBy("entity", "date").collect()] == [5.0, 5.0, 5.0, 7.0, 7.0, None, None, None]
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().executedPlan().toString()  # anew for each row


def test_zone_sums_deal_cells_not_pixels(spark):
    rng = np.random.default_rng(8)
    cells = [(c, DAY(d), [1.5, 4.0, None, float("nan")][rng.integers(4)], int(rng.integers(2)), [0, 1, None][rng.integers(3)]) for c in [*range(12), None] for d in range(6)]
    weights = [(int(e), c, (1 + (int(e) + c) % 10) / 10, 100.0 + c, (int(e) + c) % 3 == 0) for c in range(1, 14) for e in rng.choice(5, 3, replace=False)]
    px = spark.createDataFrame(cells, "cell_id int, date date, rad double, valid int, lit int")
    wt = spark.createDataFrame(weights, "entity int, cell_id int, coverage_fraction double, cell_area_m2 double, is_centre boolean")
    sums, centre, told = pixels.zonal_sums(px, wt), pixels.centre_counts(px, wt), pixels.pixel_accounting(px, wt)
    pairs = {}
    for c, d, rad, valid, lit in cells:
        for e, c2, w, area, inside in weights:
            if c == c2:
                ok = valid == 1 and rad is not None and not math.isnan(rad)
                pairs.setdefault((e, d), []).append((w, area, inside, ok, ok and lit == 1, ok and lit == 0, rad if ok else 0.0))
    every = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (sums, centre, told):
            text = df.select("*")._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(entity" in text and not [x for x in text.splitlines() if "hashpartitioning(entity" in x and "date" in x.split("hashpartitioning(")[1].split(")")[0]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", every)
    for df in (sums, centre, told):
        assert df.count() == len(pairs)
    total = lambda p, f: pytest.approx(sum(f(*x) for x in p), abs=1e-9)
    for r in sums.collect():
        p = pairs[r.entity, r.date]
        assert r.n_valid == total(p, lambda w, a, i, ok, *_: w * ok) and r.n_lit == total(p, lambda w, a, i, ok, lit, *_: w * lit)
        assert r.n_total_overlap == total(p, lambda w, *_: w) and r.rad_sum == total(p, lambda w, a, i, ok, lit, dark, rad: w * rad) and r.valid_area_m2 == total(p, lambda w, a, i, ok, *_: w * a * ok)
    for r in centre.collect():
        p = pairs[r.entity, r.date]
        assert (r.n_valid_count, r.n_lit_count, r.n_valid_overlap, r.n_overlap) == (sum(x[3] and x[2] for x in p), sum(x[4] and x[2] for x in p), sum(x[3] for x in p), len(p))
    for r in told.collect():
        p = pairs[r.entity, r.date]
        assert r.lit_cells == total(p, lambda w, a, i, ok, lit, *_: w * lit) and r.dark_area == total(p, lambda w, a, i, ok, lit, dark, rad: w * a * dark) and r.missing_cells == total(p, lambda w, a, i, ok, *_: w * (not ok))


def test_no_bins_without_a_bin_of_none(spark):
    rows = [(DAY(i), 0.1 + i / 50, 0.5) for i in range(20)]
    df = spark.createDataFrame(rows, "date date, x double, y double")
    assert series.relative_bins(df, "x", "y", "date", 4).count() == 0
    assert series.relative_bins(df.union(spark.createDataFrame([(DAY(30), 0.0, 0.4)], df.schema)), "x", "y", "date", 4).count() == 5


def test_shares_at_a_cut_do_not_hang_on_the_order_of_sums(spark):
    import itertools

    from duskgrid.plans import registry

    orders = list(itertools.permutations([0.1, 0.2, 0.3, 0.4, 0.5]))
    annual = spark.createDataFrame([(i, 5.0, 0) for i in range(5)] + [(9, 5.0, 1)], "cell_id int, rad double, quality int")
    weights = [(e, i, w, 1.0) for e, o in enumerate(orders) for i, w in enumerate(o)] + [(e, 9, 1.5, 1.0) for e in range(len(orders))]
    out = pixels.annual_stats(pixels.drop_poor(annual), spark.createDataFrame(weights, "entity int, cell_id int, coverage_fraction double, cell_area_m2 double"), 3.0, 0.5)
    assert {(r.valid_weight, r.coverage_share, r.support_ok) for r in out.collect()} == {(1.5, 0.5, 1)}
    lists = [(e, DAY(i), 0.9, c) for e, o in enumerate(itertools.permutations([0.68, 0.94, 0.2, 0.34, 0.24, 0.9])) for i, c in enumerate(o)]
    views = {
        "v_panel": spark.createDataFrame(lists, "entity int, date date, p double, coverage double").coalesce(1),
        "v_entities": spark.createDataFrame([(e, "x") for e in range(720)], "entity int, area string"),
    }
    assert [r.status for r in registry.catalog()["cal9_compare_keeps"][1](views.__getitem__).collect()] == ["a_only"]


def test_mean_bootstrap_gathers_groups(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i % 3, i, float(rng.gamma(2))) for i in range(3000)], "g int, i int, v double").repartition(7)
    whole = {r.g: r for r in resample.mean_bootstrap(df, "v", "g", ["g", "i"], 100).collect()}
    frame = resample.mean_bootstrap(df, "v", "g", ["g", "i"], 100)
    assert frame._jdf.queryExecution().executedPlan().toString().split("MapInArrow", 1)[1].count("hashpartitioning(g") >= 1  # not an array a group and task
    monkeypatch.setattr(resample, "GATHERED", 300)
    parted = {r.g: r for r in resample.mean_bootstrap(df, "v", "g", ["g", "i"], 100).collect()}
    assert all(abs(parted[g].low - whole[g].low) < 1e-12 and abs(parted[g].high - whole[g].high) < 1e-12 for g in range(3))


def test_dense_shuffles_the_panel_only(spark):
    rows = [("a", DAY(2), 0.1), ("a", DAY(2), 0.2), ("a", DAY(5), None), ("b", DAY(0), 0.3), ("b", DAY(7), 0.4), ("b", None, 0.5), ("c", None, 0.6), ("d", DAY(3), 0.7), ("d", None, 0.1), ("d", None, 0.2), (None, DAY(4), 0.8), (None, DAY(4), 0.9)]
    df = spark.createDataFrame(rows, "entity string, date date, p double")
    calendar = spark.createDataFrame([(DAY(i),) for i in range(8)], "date date")
    plain = df.select("entity").distinct().crossJoin(calendar).join(df, ["entity", "date"], "left").select("entity", "date", "p")
    out = panel.dense(df)
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key) and out.columns == plain.columns
    assert panel.dense(df.where("date is null")).count() == 0
    st = states.daily_states(panel.dense(df.withColumn("coverage", F.lit(1.0))))
    assert st._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_lit_sweep_is_one_pass(spark):
    from duskgrid.operators import calibrate

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(e, DAY(d), float(rng.random())) for e in range(6) for d in range(40) if rng.random() < 0.6], "entity int, date date, p double")
    grid = [(2, 2), (4, 3), (3, 5)]
    out = calibrate.lit_sweep(panel.dense(df), [0.4, 0.6], grid, 8)
    plain = [calibrate.doe_sweep(states.daily_states(panel.dense(df.withColumn("coverage", F.lit(1.0))), lit_at=t, n=8), grid).withColumn("lit_at", F.lit(t)) for t in (0.4, 0.6)]
    columns = ["lit_at", "least_obs", "least_lit", "n_entities", "first_doe", "last_doe", "share"]
    assert sorted(map(tuple, out.select(columns).collect())) == sorted(map(tuple, plain[0].unionByName(plain[1]).select(columns).collect()))
    assert out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(entity") == 1


def test_scene_files_follow_the_rows(spark, tmp_path):
    df = spark.range(200).repartition(8).selectExpr("concat('s', id % 3) AS scene", "id")
    io.write_scenes(df, f"file://{tmp_path}/a")
    assert len(list((tmp_path / "a").rglob("*.parquet"))) == 3
    io.write_scenes(df, f"file://{tmp_path}/b", rows=20)
    assert 3 <= len(list((tmp_path / "b").rglob("*.parquet"))) <= 12 and spark.read.parquet(f"file://{tmp_path}/b").count() == 200


def test_bootstrap_sums_of_blocks_equal_the_rows(spark):
    rng = np.random.default_rng(2)
    for n, block in ((40, 7), (14, 14), (9, 14), (30, 1)):
        y, x = rng.random(n), np.where(np.arange(n) < n - 3, 5.0, rng.random(n) * 9)
        df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))], "i int, y double, x double")
        got = {r.draw: r.slope for r in resample.block_bootstrap(df, "y", "x", "i", 60, block).collect()}
        start = resample.Drawn(17)(0, 60, -(-n // block)) % n
        at = ((start[:, :, None] + np.arange(block)) % n).reshape(60, -1)[:, :n]
        want = resample._slopes(y[at], x[at])
        assert all((got[d] is None) == bool(np.isnan(s)) and (got[d] is None or abs(got[d] - s) < 1e-9) for d, s in enumerate(want))


def test_effects_of_two_factors_write_levels_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(regress, "shared_path", lambda s, name: f"file://{tmp_path}/{name}")
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(int(a), int(b), float(rng.random()), float(rng.random())) for a in range(20) for b in rng.choice(15, 9, replace=False)], "a int, b int, y double, x double")
    assert regress.two_way_effects(df, "y", "x", "a", "b").first().n == 180
    rows = {f.name: spark.read.parquet(f"file://{f}").count() for f in (tmp_path / "two-way").iterdir() if f.name[0].isdigit()}
    assert rows.pop("0") == 180 and rows and max(rows.values()) <= 20


def test_fe_controls_in_two_passes(spark):
    rng = np.random.default_rng(11)
    rows = [(f"e{e}" if e else None, DAY(d), float(rng.random()), float(rng.random()) if d % 11 else None, float(rng.random() < 0.4), 0.5 + float(rng.random()) if d % 7 else -1.0, d % 3 if d % 13 else None, "ab"[int(rng.random() < 0.5)]) for e in range(5) for d in range(40) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "b string, d date, x double, y double, z double, w double, m int, c string")
    specs = {"none": {}, "m": {"m": [0, 1, 2]}, "mc": {"m": [0, 1, 2], "c": ["a", "b"]}}
    small = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(small, "7")  # entities go over several batches
    try:
        out = regress.fe_control_grid(df, ["y", "z"], "x", [None, "w"], specs, "b", "d")
        got = {(r.outcome, r.weight, r.spec): r for r in out.collect()}
    finally:
        spark.conf.unset(small)
    assert len(got) == 12
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning(_entity") == 1
    for (outcome, weight, spec), r in got.items():
        y, w = {"y": 3, "z": 4}[outcome], 5 if weight == "w" else None
        kept = [t for t in rows if t[y] is not None and (w is None or t[w] > 0) and (spec == "none" or t[6] is not None)]  # no level, no part
        hot = lambda i, of: np.array([[t[i] == v for v in sorted({t[i] for t in of}, key=str)] for t in of], float)
        k = np.sqrt([t[w] if w else 1.0 for t in kept])[:, None]
        parts = [np.array([[t[2]] for t in kept]), hot(0, kept), *([hot(6, kept)] if "m" in spec else []), *([hot(7, kept)] if "c" in spec else [])]
        z, v = np.hstack(parts) * k, np.array([t[y] for t in kept]) * k[:, 0]
        beta, _, rank, _ = np.linalg.lstsq(z, v, rcond=None)
        days = sorted({t[1] for t in kept})
        score = np.array([(z * (v - z @ beta)[:, None])[[t[1] == d for t in kept]].sum(axis=0) for d in days])
        bread, g, n = np.linalg.pinv(z.T @ z), len(days), len(kept)
        se = np.sqrt((bread @ score.T @ score @ bread)[0, 0] * g / (g - 1) * (n - 1) / (n - rank))
        assert (r.n, r.n_clusters) == (n, g) and abs(r.slope - beta[0]) < 1e-9 and abs(r.se_cluster - se) < 1e-9, (outcome, weight, spec)


def test_triggers_without_a_calendar(spark):
    rng = np.random.default_rng(12)
    rows = [(e, DAY(d), float(rng.random()) if rng.random() < 0.9 else None, 1.0) for e in range(40) for d in range(int(rng.integers(0, 20)), 45) if rng.random() < 0.35]
    rows += [(90, DAY(d), 0.9, 1.0) for d in range(4)] + [(91, DAY(d), 0.9, 1.0) for d in range(41, 45)] + [(92, DAY(20), None, 1.0), (93, None, 0.9, 1.0), (94, DAY(0), 0.9, 1.0), (94, DAY(9), float("nan"), 1.0), (94, DAY(8), 0.9, 1.0)] + [(None, DAY(i), 0.9, 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "entity int, date date, p double, coverage double")
    for rule in ({"n": 10, "least_obs": 4, "least_lit": 3}, {"n": 10, "least_obs": 2, "least_lit": 3}, {"n": 60, "least_obs": 1, "least_lit": 1}):
        plain = states.daily_states(panel.dense(df), **rule).cache()
        margins = {(r.entity, r.doe, r.n_obs, r.n_lit) for r in plain.where("date = doe").collect()}
        out = states.first_triggers(df, **rule)
        assert {tuple(r) for r in out.where("doe is not null").collect()} == margins
        assert sorted(map(str, plain.select("entity", "doe").distinct().collect())) == sorted(map(str, out.select("entity", "doe").collect()))
        columns = ["entity", "date", "p", "coverage", "doe", "lit_day", "dark_day", "observed", "after_doe"]
        after = states.observed_after(df, **rule).select(columns).collect()
        assert sorted(map(str, after)) == sorted(map(str, plain.where("after_doe = 1 and p is not null").select(columns).collect()))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan  # no day is made that has no row


def test_states_of_days_without_their_windows(spark):
    rng = np.random.default_rng(13)
    rows = [(e, DAY(d), float(rng.random()) if rng.random() < 0.9 else None, float(rng.random())) for e in range(40) for d in range(int(rng.integers(0, 60)), 150) if rng.random() < 0.35]
    rows += [(90, DAY(d), 0.9, 1.0) for d in range(4)] + [(91, DAY(d), 0.9, 1.0) for d in range(141, 150)] + [(92, DAY(20), None, 1.0), (93, None, 0.9, 1.0), (94, DAY(0), 0.9, 1.0), (94, DAY(9), float("nan"), 1.0), (94, DAY(8), 0.9, 1.0), (94, None, 0.9, 1.0)] + [(None, DAY(i), 0.9, 1.0) for i in range(9)]
    rows += [(95, DAY(d), 0.9, 1.0) for d in range(150)]
    df = spark.createDataFrame(rows, "entity int, date date, p double, coverage double")
    for rule in ({"n": 10, "least_obs": 4, "least_lit": 3}, {"n": 1, "least_obs": 0, "least_lit": 1}, {"n": 63, "least_obs": 20, "least_lit": 15}, {"n": 64, "least_obs": 20, "least_lit": 15}, {}):
        plain, out = states.daily_states(panel.dense(df), **rule), states.panel_states(df, **rule)
        assert sorted(out.dtypes) == sorted(plain.dtypes)
        assert sorted(map(str, out.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    plan = states.panel_states(df, n=10).select("entity", "date", "electrified")._jdf.queryExecution().executedPlan().toString().split("\n")
    made = next(i for i, line in enumerate(plan) if "Generate" in line)
    assert not any(w in line for line in plan[:made] for w in ("Window", "Sort", "Exchange"))  # days are neither sorted nor windowed


def test_pairs_of_pixels_and_entities_are_not_shuffled(spark, monkeypatch):
    from duskgrid.operators import overlay

    for most in ("HELD", "PAIRS", "GIVEN"):
        monkeypatch.setattr(overlay, most, 5)  # many parts of a block, and of a product
    rng = np.random.default_rng(21)
    pick = lambda *x: x[rng.integers(len(x))]
    px = [(pick(*range(9), None), pick(DAY(0), DAY(1), DAY(2), None), pick("a", "b", None), pick(1.5, -4.0, None, 0.0)) for _ in range(150)]
    wt = [(pick("x", "y", "z", None), pick(*range(10), None), pick(0.5, 0.25, None, float("nan")), pick(1.0, 3.0)) for _ in range(60)] + [("n", c, None, 2.0) for c in range(9)]
    pixels_ = spark.createDataFrame(px, "cell_id int, date date, kind string, r double")
    weights = spark.createDataFrame(wt, "entity string, cell_id long, w double, a double")
    size = {e: sum(t[3] for t in wt if t[0] == e) for e in ("x", "y", "z", "n")} | {None: None}
    for by in ([], ["date"], ["kind", "date"]):
        out = overlay.sums(pixels_, weights, by, {"_w": F.col("w"), "_a": F.col("a")}, {"_r": F.col("r")}, {"s": ("_w", "_r"), "t": ("_w", None), "u": ("_a", "_r")}, {"size": pixels.entity_sum("a")})
        groups = {}
        for c, d, k, r in px:
            for e, c2, w, a in wt:
                if c is not None and c == c2:
                    groups.setdefault((e, *[{"date": d, "kind": k}[b] for b in by]), []).append((0.0 if r is None else None if w is None else w * r, w, 0.0 if r is None else a * r))
        total = lambda x: sum(v) if (v := [y for y in x if y is not None]) else None
        plain = {k: (size[k[0]], *map(total, zip(*v, strict=True))) for k, v in groups.items()}
        got = {tuple(r[: 1 + len(by)]): tuple(r[1 + len(by) :]) for r in out.collect()}
        assert got.keys() == plain.keys() and out.count() == len(plain)
        for k, v in plain.items():
            assert all(a is b or (math.isnan(a) and math.isnan(b)) or abs(a - b) < 1e-9 for a, b in zip(got[k], v, strict=True)), (k, got[k], v)
    assert any(v[1] is None for v in plain.values()) and any(v[2] is None for v in plain.values())
    sums = pixels.zonal_sums(pixels_.selectExpr("cell_id", "date", "r AS rad", "1 AS valid", "1 AS lit"), weights.selectExpr("entity", "cell_id", "w AS coverage_fraction", "a AS cell_area_m2"))
    plan = sums._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    made = plan.index("CartesianProduct")
    assert "Exchange" not in plan[:made] and "Join" not in plan  # pairs are made where their sums are, and not moved before


def test_own_state_shuffles_pixels_once(spark):
    rng = np.random.default_rng(22)
    rows = [(c, DAY(d), [float(rng.gamma(2)), None, float("nan"), 1.0][rng.choice(4, p=[0.7, 0.1, 0.1, 0.1])]) for c in [*range(9), None] for d in range(int(rng.integers(2, 30)))]
    px = spark.createDataFrame([*rows, *rows[:20]], "cell_id int, date date, rad double")
    plain = pixels.baseline_state(px, pixels.pixel_baseline(px, 0.25, 0.75, 8, k=0.2))
    own = pixels.own_state(px, 0.25, 0.75, 8, k=0.2)
    columns = ["cell_id", "date", "rad", "observed", "dark", "bright_excluded", "rad_observed"]
    assert sorted(map(str, own.select(columns).collect())) == sorted(map(str, plain.select(columns).collect())) and own.count() > 0
    every = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from duskgrid.plans import registry

        views = {"v_pixels": px, "v_weights": spark.createDataFrame([(1, 2, 0.5, 9.0)], "entity int, cell_id int, coverage_fraction double, cell_area_m2 double")}
        plan = registry.catalog()["zon7_zonal_states"][1](views.__getitem__)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("hashpartitioning(cell_id") == 1 and plan.count("hashpartitioning(") == 2  # pixels by cell, weights by entity
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", every)


def test_stored_buckets_are_the_blocks_of_zone_sums(spark):
    import functools

    from duskgrid.operators import overlay
    from duskgrid.plans import pixels as plan
    from duskgrid.sources.views import view

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "96")
    try:
        states_, weights = plan.copartitioned(functools.partial(view, spark, "/root/testdata/sf0.001"))
        text = states_.join(weights, "cell_id")._jdf.queryExecution().executedPlan().toString()
        assert overlay.blocks(spark) == 12 and text.count("Bucketed: true") + text.count("SelectedBucketsCount: 12 out of 12") >= 2
        assert not {"qf_cloud", "is_centre"} & {*states_.columns, *weights.columns}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
