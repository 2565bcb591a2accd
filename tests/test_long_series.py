"""Operators over series of any length against the kernels of one window and plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import kernels as K
from spindrift.operators import autoregression, quantiles, shocks, sinusoids, statistics, trend, wavelet
from spindrift.operators import windows as W
from spindrift.plans import backtest, decompose, native, table_function, workers
from spindrift.sources import csv_files
from spindrift.streaming import observe

T = np.arange


def frame(spark, **series):
    rows = [(name, i, float(v)) for name, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, t int, y double")


def test_quantiles_of_skewed_groups(spark, monkeypatch):
    """One group of nearly all rows, heavy tails, ties, a single value; ranges are narrowed several times."""
    monkeypatch.setattr(quantiles, "GATHERED", 40)
    rng = np.random.default_rng(1)
    groups = {
        "large": np.concatenate([rng.normal(0, 1, 4000), np.full(1500, 0.25), 10.0 ** rng.uniform(-200, 200, 300), -(10.0 ** rng.uniform(-9, 9, 200))]),
        "ties": np.repeat([1.0, 2.0, 3.0], 100),
        "one": np.array([7.0]),
        "wide": np.array([-1.7e308, 1.7e308, 0.0]),
    }
    rows = [(k, float(v)) for k, y in groups.items() for v in y] + [("one", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"low": 0.1, "middle": 0.5, "high": 0.937, "least": 0.0, "most": 1.0}
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "v", shares).collect()}
    assert set(got) == set(groups)
    for k, y in groups.items():
        for name, p in shares.items():
            assert np.isclose(got[k][name], np.quantile(y, p), rtol=1e-9, atol=0), (k, name)


def test_robust_noise_of_a_long_series(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "GATHERED", 100)
    y = np.random.default_rng(2).standard_t(3, 3000)
    got = statistics.robust_noise(frame(spark, a=y, b=y[:5]), ["series_id"], "y").where("series_id = 'a'").first()
    middle = np.median(y)
    assert np.isclose(got.middle, middle) and np.isclose(got.mad, np.median(np.abs(y - middle)))


def test_exponential_trend_is_the_kernels(spark):
    rng, n = np.random.default_rng(3), 200
    t = T(n)
    ys = {"up": 2 * np.exp(0.02 * t) + 1 + rng.normal(0, 0.3, n), "down": 5 * np.exp(-0.03 * t) + rng.normal(0, 0.05, n), "flat": rng.normal(3, 1, n)}
    df = frame(spark, **ys).withColumn("i", F.col("t"))
    both = {r.series_id: r for r in trend.exponential_trend(df, ["series_id"], n).collect()}
    best = {r.series_id: r for r in trend.best_trend(trend.weighted_trends(df, ["series_id"], n).unionByName(trend.exponential_trend(df, ["series_id"], n)), ["series_id"]).collect()}
    for k, y in ys.items():
        a, b, c, rss = K.fit_exponential(y, K.recency(n, n / 2))
        assert np.isclose(both[k].rss, rss, rtol=1e-6)
        assert np.allclose(both[k].a * np.exp(both[k].b * t) + both[k].c, a * np.exp(b * t) + c, atol=1e-2 * np.ptp(y))
        kind, _, bic, _ = K.trend(y)
        assert best[k].trend_type == kind and np.isclose(best[k].bic, bic, rtol=1e-6)
    assert best["down"].trend_type == "exponential"


def test_shock_passes_are_the_kernels(spark):
    rng, n = np.random.default_rng(4), 300
    base = rng.normal(0, 0.3, n)
    ys = {"steps": base.copy(), "spike": base.copy(), "none": np.zeros(n)}
    ys["steps"][200:] += 5
    ys["steps"][250:] -= 3
    ys["spike"][240:] += 8 * np.exp(-0.1 * T(60))
    df = frame(spark, **ys).withColumn("noise", F.lit(0.3))
    found, left = shocks.shock_passes(df, ["series_id"], "noise", lookback=120, delta="y")
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.series_id, []).append((r.onset, r["shape"], r.magnitude, r.rate))
    rest = {}
    for r in left.collect():
        rest.setdefault(r.series_id, {})[r.t] = r.y
    for k, y in ys.items():
        want = K.shocks(y, 0.3, lookback=120)
        assert [x[:2] for x in got.get(k, [])] == [x[:2] for x in want]
        assert np.allclose([x[2:] for x in got.get(k, [])], [x[2:4] for x in want])
        gone = sum((K.shock_at(s, at, m, r, T(float(n))) for at, s, m, r, _ in want), np.zeros(n))
        assert np.allclose([rest[k][i] for i in range(n)], y - gone)


@pytest.mark.parametrize("n", [600, 599])  # many strands, and one
def test_sinusoids_are_the_kernels(spark, n):
    rng = np.random.default_rng(5)
    t = T(n)
    ys = {"two": 3 * np.cos(2 * np.pi * 0.0513 * t + 0.7) + 2 * np.cos(2 * np.pi * 0.12 * t) + rng.normal(0, 0.5, n), "noise": rng.normal(0, 1, n), "short": np.ones(5)}
    df = frame(spark, **ys).withColumnRenamed("y", "rest")
    found, left = sinusoids.extract(df, ["series_id"])
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.series_id, []).append((r.frequency, r.amplitude, r.phase, r.snr))
    want = {k: K.waves(y)[0] for k, y in ys.items() if k != "short"}
    assert len(got["two"]) == 2 and "short" not in got
    for k, waves in want.items():
        assert len(got.get(k, [])) == len(waves)
        for mine, other in zip(got.get(k, []), waves, strict=True):
            assert np.allclose(mine, other, rtol=2e-3, atol=1e-2)
    rows = left.where("series_id = 'two'").collect()
    assert len(rows) == n and np.isclose(np.std([r.rest for r in rows]), K.waves(ys["two"])[1].std(), rtol=1e-3)


def test_power_is_the_transform(spark):
    y = np.random.default_rng(6).normal(0, 1, 84)
    df = frame(spark, a=y).withColumn("n", F.lit(84)).withColumnRenamed("y", "rest")
    got = {r.k: r.power for r in sinusoids.power(df, ["series_id"]).collect()}
    assert np.allclose([got[k] for k in range(43)], np.abs(np.fft.rfft(y)) ** 2)


def test_least_squares_of_any_length(spark):
    rng = np.random.default_rng(7)
    y = np.zeros(500)
    for i in range(2, 500):
        y[i] = 3 + 0.6 * y[i - 1] - 0.2 * y[i - 2] + rng.normal()
    df = frame(spark, long=y + 1000, short=y[:10], least=y[:12], constant=np.full(60, 4.0))
    got = {r.series_id: r for r in autoregression.least_squares(df, ["series_id"], 6, block=50).collect()}
    assert set(got) == {"long", "least", "constant"} and got["long"].n == 500
    assert np.allclose(got["long"].coef, K.least_squares_ar(y + 1000, 6), atol=1e-8)
    # twelve values leave six equations for seven unknowns: any solution of least norm for the deviations fits them exactly
    c = np.array(got["least"].coef)
    assert np.allclose([c[0] + c[1:] @ y[i - 6 : i][::-1] for i in range(6, 12)], y[6:12], atol=1e-6)
    assert np.isclose(got["constant"].coef[0] + sum(got["constant"].coef[1:]) * 4, 4)


def test_wavelet_of_any_length(spark):
    ys = {"a": np.random.default_rng(8).normal(0, 1, 317), "b": np.arange(64.0)}
    rows = wavelet.scales(frame(spark, **ys), ["series_id"], 3).collect()
    for k, y in ys.items():
        for scale, part in enumerate(K.analyse(y, 3)):
            mine = {r.i: r.v for r in rows if r.series_id == k and r.scale == scale}
            assert np.allclose([mine[i] for i in range(len(part))], part) and len(mine) == len(part)


def test_replay_in_blocks_is_the_model(spark):
    rng = np.random.default_rng(9)
    ys = {"a": np.cumsum(rng.normal(0, 1, 200)), "b": rng.normal(5, 1, 49), "tiny": np.ones(10)}
    got = {}
    for r in observe.replay(frame(spark, **ys), block=37).collect():
        got.setdefault(r.series_id, {})[r.t] = r
    for k, y in ys.items():
        m = observe.Model()
        want = [m.observe(v) for v in y.tolist()]
        assert np.allclose([got[k][i].predicted for i in range(len(y))], want, equal_nan=True)
        assert all(np.isclose(r.confidence, m.confidence() if m.coef else 0.0) and r.n == len(y) for r in got[k].values())


def passes(df):
    """Python passes in the plan that ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def packed(spark, **series):
    rows = [(k, 0, [float(v) for v in y]) for k, y in series.items()]
    return spark.createDataFrame(rows, "series_id string, window_start int, y array<double>")


def seasonal(n, seed=10):
    return 5 * np.sin(2 * np.pi * T(n) / 12) + 0.05 * T(n) + np.random.default_rng(seed).normal(0, 0.5, n)


def test_one_pass_for_all_workers(spark):
    df = packed(spark, a=seasonal(200), b=seasonal(70, 11))
    out = workers.ensemble_forecast(df, W.KEY, 12, workers.ALL)
    assert passes(out) == 2  # initial and final plan text name the one pass each


def test_forecast_of_one_series_is_that_of_columns(spark):
    y = np.exp(0.01 * T(300)) + seasonal(300)
    y[260:] += 6
    df = packed(spark, a=y, b=seasonal(90), c=np.full(64, 2.0))
    for o in (decompose.Options(), decompose.Options(amplitude_damping=False, trend_damping_halflife=5.0)):
        want = {}
        for r in decompose.forecast(decompose.fit(df, 40, o), W.KEY, o).collect():
            want.setdefault(r.series_id, {})[r.h] = r.point
        for r in df.collect():
            mine = decompose.ahead(decompose.fit_window(np.array(r.y), 0, o), 40, o)
            assert np.allclose(mine, [want[r.series_id][h] for h in range(40)])


def test_backtest_fits_each_start_once(spark):
    series = frame(spark, a=seasonal(260), short=seasonal(80))
    got = backtest.run(series, [12, 24, 48], 100)
    assert passes(got) <= 2
    rows = {(r.series_id, r.horizon): r for r in got.collect()}
    y = seasonal(260)
    for h in (12, 24, 48):
        starts = range(0, 260 - 100 - h + 1, h)
        errors = []
        for s in starts:
            o = decompose.Options()
            errors.append(y[s + 100 : s + 100 + h] - decompose.ahead(decompose.fit_window(y[s : s + 100], 0, o), h, o))
        e = np.concatenate(errors)
        assert rows["a", h].n_windows == len(starts)
        assert np.isclose(rows["a", h].mse, np.mean(e**2)) and np.isclose(rows["a", h].mae, np.mean(np.abs(e)))
        assert rows["short", h].n_windows == 0 and np.isnan(rows["short", h].mse)


def test_table_function(spark):
    table_function.register(spark)
    y = seasonal(120)
    frame(spark, a=y, b=y[:80] * 2).createOrReplaceTempView("some_rows")
    got = {}
    for r in spark.sql("SELECT * FROM fit_forecast(7, TABLE(some_rows) PARTITION BY series_id ORDER BY t)").collect():
        got.setdefault(r.series_id, {})[r.h] = r
    want = {}
    for r in decompose.forecast(decompose.fit(packed(spark, a=y, b=y[:80] * 2), 7), W.KEY).collect():
        want.setdefault(r.series_id, {})[r.h] = r
    for k in "ab":
        for c in ("point", "lower", "upper"):
            assert np.allclose([got[k][h][c] for h in range(7)], [want[k][h][c] for h in range(7)])


def test_rows_of_files_are_numbered_in_order(spark, tmp_path):
    y = np.random.default_rng(12).permutation(500)
    (tmp_path / "x.csv").write_text("OT\n" + "\n".join("" if v % 7 == 0 else str(v) for v in y))
    got = {r.t: r.y for r in csv_files.read_column(spark, str(tmp_path / "x.csv")).collect()}
    kept = [float(v) for v in y if v % 7]
    assert [got[i] for i in range(len(kept))] == kept and len(got) == len(kept)


def test_numbers_of_a_column_with_one_large_group(spark):
    rows = [("large", i) for i in range(3000)] + [("small", 5), ("small", 1)]
    got = {(r.g, r.x): r.t for r in W.numbered(spark.createDataFrame(rows, "g string, x int").repartition(7), "g", "x").collect()}
    assert all(got["large", i] == i for i in range(3000)) and got["small", 1] == 0 and got["small", 5] == 1


def test_chain_of_operators_is_the_kernel_fit(spark):
    """Windows with a cycle and a line, and with a shock: the native fit gives what one pass over arrays gives."""
    n, rng = 128, np.random.default_rng(13)
    t = T(n)
    ys = {"cycle": 4 * np.cos(2 * np.pi * t / 13) + 0.1 * t + rng.normal(0, 0.3, n), "shock": rng.normal(0, 0.5, n) + np.where(t > 110, 3.0, 0.0)}
    rows = frame(spark, **ys).select("series_id", F.lit(0).alias("window_start"), F.col("t").alias("i"), "y")
    o = decompose.Options(max_components=1)
    mine = native.fit(rows, W.KEY, n, 24, o)
    want = decompose.fit(packed(spark, **ys), 24, o)
    a, b = ({r.series_id: r for r in x.collect()} for x in (mine, want))
    assert set(mine.columns) <= set(want.columns)
    for k in ys:
        assert len(a[k].components) == len(b[k].components) and a[k].trend.trend_type == b[k].trend.trend_type
        assert [(s.onset_idx, s["shape"]) for s in a[k].shocks] == [(s.onset_idx, s["shape"]) for s in b[k].shocks]
        assert a[k].local.order == b[k].local.order and a[k].residual_mode == b[k].residual_mode
        scale = np.std(ys[k])
        assert np.allclose(a[k].residual, b[k].residual, atol=0.01 * scale) and np.isclose(a[k].noise_std, b[k].noise_std, rtol=0.01)
        assert np.allclose(a[k].layer_variance, b[k].layer_variance, rtol=0.02, atol=1e-3 * scale**2)
    points = [{(r.series_id, r.h): r for r in decompose.forecast(x, W.KEY, o).collect()} for x in (mine, want)]
    assert points[0].keys() == points[1].keys() and len(points[0]) == 24 * len(ys)
    for key, r in points[1].items():
        assert abs(points[0][key].point - r.point) < 0.05 * np.std(ys[key[0]])
