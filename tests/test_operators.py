"""Operators and plans on small frames: edges, errors and cross-checks between native columns and kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift import cli
from spindrift.functions import expressions as E
from spindrift.functions import kernels as K
from spindrift.operators import ensemble, seasonal, shocks, spectrum, statistics, trend
from spindrift.operators import windows as W
from spindrift.plans import backtest, decompose, workers
from spindrift.sources import csv_files, series
from spindrift.streaming import buckets

SERIES = "series_id string, t int, y double"


def frame(spark, **named):
    return spark.createDataFrame([(k, t, float(v)) for k, x in named.items() for t, v in enumerate(x)], SERIES)


def noisy(n=300, seed=42):
    r = np.random.default_rng(seed)
    return 3 * np.sin(2 * np.pi * 0.05 * np.arange(n)) + 0.1 * np.arange(n) + 5 + r.normal(0, 0.5, n)


def test_split_ends_are_in_double_precision():
    assert W.split_ends(10, 0.7, 0.1) == (7, 7)
    assert W.split_ends(52695, 0.7, 0.1) == (36886, 42156)
    assert W.split_ends(17420, 8640, 2880) == (8640, 11520)


@pytest.mark.parametrize(("n", "context", "horizon", "stride", "first"), [(40, 10, 5, None, 0), (40, 10, 5, 3, 2), (15, 10, 5, None, 0), (14, 10, 5, None, 0), (40, 10, 5, 0, 0)])
def test_rolling_windows(spark, n, context, horizon, stride, first):
    got = W.packed(W.rolling(frame(spark, a=range(n)), context, horizon, stride, first), context).collect()
    want, s = {}, first
    while s + context + horizon <= n:
        want[s] = (list(map(float, range(s, s + context))), list(map(float, range(s + context, s + context + horizon))))
        s += stride or horizon
    assert {r.window_start: (r.y, r.actual) for r in got} == want


def test_tail_and_finite(spark):
    df = frame(spark, a=range(10))
    assert [r.y for r in W.tail(df, 3).orderBy("t").collect()] == [7.0, 8.0, 9.0]
    assert W.tail(df, 0).count() == 10 and W.tail(df, 99).count() == 10
    with pytest.raises(Exception, match="NaN or Inf"):
        W.check_finite(frame(spark, a=[1.0, math.nan])).collect()


def test_events_to_series(spark):
    rows = [("a", 0, 1.0), ("a", 0, 2.0), ("a", 3, 5.0), (None, 1, 1.0), ("b", 7, 2.0), ("b", None, 1.0), ("b", 8, None)]
    df = spark.createDataFrame(rows, "s string, b long, v double")
    get = lambda fill: sorted((r.series_id, r.t, r.y) for r in series.from_events(df, F.col("s"), F.col("b"), F.col("v"), fill=fill).collect())
    assert get("zero") == [("a", 0, 3.0), ("a", 1, 0.0), ("a", 2, 0.0), ("a", 3, 5.0), ("b", 0, 2.0)]
    assert [y for s, _, y in get("forward") if s == "a"] == [3.0, 3.0, 3.0, 5.0]
    assert [y for s, _, y in get("none") if s == "a"] == [3.0, None, None, 5.0]
    assert series.from_events(df.limit(0), F.col("s"), F.col("b"), F.col("v")).count() == 0
    with pytest.raises(ValueError):
        get("other")


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("date,OT,HUFL\n2020,1.5,a\n2021, 2.5 ,b\n2022,bad,c\n2023,,d\n2024,1e2,e\n2025,1.5d,f\n2026\n")
    got = [(r.t, r.y) for r in csv_files.read_column(spark, str(path), order_by="date").orderBy("t").collect()]
    assert got == [(0, 1.5), (1, 2.5), (2, 100.0)]
    with pytest.raises(ValueError, match="available: date, OT, HUFL"):
        csv_files.read_column(spark, str(path), "XX")
    with pytest.raises(ValueError, match="No valid"):
        csv_files.read_column(spark, str(path), "HUFL")
    assert csv_files.read_column(spark, str(path), "XX", mode="tolerant").count() == 0
    with pytest.raises(Exception, match="not a number"):
        csv_files.read_column(spark, str(path), mode="strict").collect()
    two = spark.createDataFrame([("b", 0, 1.0), ("a", 0, 2.0), ("a", 1, 3.0)], SERIES)
    assert sorted(r.y for r in csv_files.first_series(two).collect()) == [2.0, 3.0]


def test_spectrum_is_the_fft(spark):
    y = noisy(60)
    df = W.packed(W.rolling(frame(spark, a=y), 60, 0, 1), 60)
    power = np.abs(np.fft.rfft(y)) ** 2
    got = spectrum.power_array(df).first().power
    assert np.allclose(got, power)
    native = df.select(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: spectrum.power_column(F.col("y"), k)).alias("p")).first().p
    assert np.allclose(native, power, atol=1e-6)


def test_native_trend_is_least_squares(spark):
    y = noisy(120)
    rows = frame(spark, a=y).withColumnRenamed("t", "i")
    got = {r.trend_type: r for r in trend.weighted_trends(rows, ["series_id"], 120).collect()}
    w = np.sqrt(K.recency(120, 60))
    for name, degree in (("linear", 1), ("quadratic", 2)):
        basis = np.vander(np.arange(120.0), degree + 1)
        coef = np.linalg.lstsq(basis * w[:, None], y * w, rcond=None)[0]
        assert np.allclose([got[name].a, got[name].b, got[name].c][: degree + 1], coef, rtol=1e-6)
        assert np.isclose(got[name].rss, ((w * (y - basis @ coef)) ** 2).sum())
    kind, _, bic, _ = K.trend(y)
    best = trend.best_trend(trend.weighted_trends(rows, ["series_id"], 120), ["series_id"]).first()
    if kind != "exponential":
        assert (best.trend_type, round(best.bic, 6)) == (kind, round(bic, 6))


def test_native_levinson_is_the_kernel(spark):
    r = noisy(200)
    rows = frame(spark, a=r).withColumnRenamed("t", "i")
    orders = {x.p: x for x in statistics.levinson(statistics.weighted_autocovariance(rows, ["series_id"], 200, 12, 200 / 3), ["series_id"]).collect()}
    coef, _, aic, sd, _ = K.autoregression(r)
    assert np.allclose(orders[len(coef)].coef, coef) and np.isclose(math.sqrt(orders[len(coef)].variance), sd)
    scored = {p: 200 * math.log(x.variance) + 2 * (p + 1) for p, x in orders.items()}
    assert np.isclose(min(scored.values()), aic)


def test_native_shock_is_the_kernel(spark):
    d = np.random.default_rng(1).normal(0, 0.3, 200)
    d[150:] += 8 * np.exp(-0.05 * np.arange(50))
    rows = frame(spark, a=d, b=np.zeros(200)).withColumnRenamed("y", "delta").withColumn("noise", F.lit(0.3))
    got = shocks.first_shock(rows, ["series_id"], "noise", lookback=60).collect()
    onset, shape, magnitude, rate, aic = K.shocks(d, 0.3, lookback=60)[0]
    assert [(r.series_id, r.onset, r.shape) for r in got] == [("a", onset, shape)]
    assert np.allclose([got[0].magnitude, got[0].rate, got[0].aic], [magnitude, rate, aic])


def test_native_level_shifts_are_the_kernel(spark):
    y = np.random.default_rng(2).normal(0, 0.2, 300)
    y[100:] += 5
    y[220:] -= 9
    df = frame(spark, a=y, short=y[:30], flat=np.zeros(100))
    found = shocks.level_shifts(df)
    got = shocks.without_shifts(df, found).where("series_id = 'a'").orderBy("t").collect()
    assert np.allclose([r.shift for r in got], K.level_shift(y))
    assert sorted(r["index"] for r in found.collect()) == (np.flatnonzero(np.diff(K.level_shift(y))) + 1).tolist() == [220] and {r.series_id for r in found.collect()} == {"a"}


def test_native_classical_is_the_kernel(spark):
    y = noisy(100)
    got = seasonal.classical(frame(spark, a=y), ["series_id"], 12).orderBy("t").collect()
    _, pattern, rest = K.classical(y, 12)
    assert np.allclose([r.rest for r in got], rest) and np.allclose([r.seasonal for r in got], pattern[np.arange(100) % 12])


def test_expressions(spark):
    row = spark.range(1).select(
        E.ar_ahead(F.array(F.lit(2.0), F.lit(1.0)), F.array(F.lit(0.5), F.lit(-0.25)), F.lit(1.0), F.lit(3)).alias("ar"),
        E.bic(F.lit(10.0), 2, F.lit(0.0)).alias("perfect"), E.aic(F.lit(10.0), 2, F.lit(5.0)).alias("aic"),
        E.damped_trend(F.lit("exponential"), F.lit(2.0), F.lit(0.01), F.lit(1.0), F.lit(120.0), F.lit(99.0), F.lit(25.0)).alias("damped"),
        E.confidence(F.lit(1.0), F.lit(2.0), F.lit(2)).alias("prior"), E.ewma(F.array(F.lit(1.0), F.lit(-2.0)), F.lit(0.0)).alias("ewma"),
    ).first()
    assert np.allclose(row.ar, [1 + 1 - 0.25, 1 + 0.875 - 0.5, 1 + 0.6875 - 0.4375])
    assert row.perfect < -9e14 and np.isclose(row.aic, 10 * math.log(0.5) + 4) and row.prior == 0.25 and np.isclose(row.ewma, 0.29)
    f = lambda t: 2 * math.exp(0.01 * t) + 1
    fade = 2 ** (-21 / 25)
    assert np.isclose(row.damped, fade * f(120) + (1 - fade) * (f(99) + (f(99.5) - f(98.5)) * 21))


def test_metrics_of_zeros(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 2.0), ("b", 2.0, 1.0), ("b", 0.0, 1.0)], "series_id string, actual double, predicted double")
    got = {r.series_id: r for r in statistics.metrics(df, ["series_id"]).collect()}
    assert got["a"].mape == math.inf and got["b"].mape == 0.5 and got["a"].mse == 2.5


def plain_forecast(fit, horizon):
    """The layers once more, step by step."""
    n, out = fit["n"], []
    local = list(reversed(fit["recent"]))[::-1]
    coef, c = fit["local"]["coefficients"], fit["local"]["intercept"]
    for h in range(horizon):
        t = float(n + h)
        periodic = 0.0
        for x in fit["components"]:
            s = 2 * (h + 1) / (n * math.sqrt(max(2 * x["snr"] / 3, 1e-10)))
            periodic += x["amplitude"] * math.cos(2 * math.pi * x["frequency"] * t + x["phase"]) * math.exp(-s * s / 2)
        g = fit["trend"]
        at = lambda u, g=g: float(K.trend_at(g["trend_type"], (g["a"], g["b"], g["c"]), np.array([u]))[0])
        level = at(t)
        if g["trend_type"] in ("quadratic", "exponential"):
            fade = 2 ** (-(t - n + 1) / (n / 4))
            level = fade * level + (1 - fade) * (at(n - 1.0) + (at(n - 0.5) - at(n - 1.5)) * (t - n + 1))
        shock = sum(float(K.shock_at(s["shape"], s["onset_idx"], s["magnitude"], s["decay_rate"], np.array([t]))[0]) for s in fit["shocks"])
        step = c + sum(a * local[-1 - j] for j, a in enumerate(coef))
        local.append(step)
        wave = fit["wavelet_ahead"][h] * 2 ** (-h / max(n / 8, 16)) if fit["wavelet_ahead"] else 0.0
        total = min(max(periodic, fit["periodic_lo"]), fit["periodic_hi"]) + level + shock + step * 2 ** (-h / max(2 * len(coef), 4)) + wave
        point = min(max(total, fit["range_lo"]), fit["range_hi"])
        grow = math.sqrt(1 + h / n)
        out.append((point, point + fit["q_lo"] * grow, point + fit["q_hi"] * grow))
    return out


def one_window(spark, **named):
    return spark.createDataFrame([(k, 0, [float(v) for v in x]) for k, x in named.items()], "series_id string, window_start int, y array<double>")


def test_native_forecast_is_the_sum_of_the_layers(spark):
    jump = noisy(400, 3)
    jump[300:] += 10
    cases = {"a": noisy(), "b": jump, "c": np.random.default_rng(5).normal(size=128), "d": 100 * 1.01 ** np.arange(200.0)}
    df = one_window(spark, **cases)
    got = decompose.forecast(decompose.fit(df, 30), W.KEY).orderBy("series_id", "h").collect()
    for name, y in cases.items():
        want = plain_forecast(decompose.fit_window(np.array(y), 30, decompose.Options()), 30)
        assert np.allclose([(r.point, r.lower, r.upper) for r in got if r.series_id == name], want, rtol=1e-9, atol=1e-7), name


def test_forecast_quality(spark):
    t = np.arange(550.0)
    y = 3 * np.cos(2 * np.pi * 0.05 * t) + 0.1 * t + 10
    r = np.random.default_rng(42)
    wide = 5 * np.cos(2 * np.pi * 0.03 * np.arange(1030)) + 0.05 * np.arange(1030) + r.normal(0, 1, 1030)
    clean = np.sin(2 * np.pi * 0.1 * np.arange(300)) + 5
    df = one_window(spark, a=y[:500], b=wide[:1000], c=clean)
    out = decompose.forecast(decompose.fit(df, 50, decompose.Options(confidence_level=0.9)), W.KEY).orderBy("h").collect()
    a, b = ([x for x in out if x.series_id == k] for k in "ab")
    assert np.mean([abs(x.point - y[500 + x.h]) for x in a]) < 2
    assert np.mean([x.lower <= wide[1000 + x.h] <= x.upper for x in b if x.h < 30]) > 0.5
    short = decompose.forecast(decompose.fit(df.where("series_id = 'c'"), 10), W.KEY).orderBy("h").collect()
    long = decompose.forecast(decompose.fit(df.where("series_id = 'c'"), 20), W.KEY).orderBy("h").collect()
    assert np.allclose([x.point for x in short], [x.point for x in long][:10])
    text = decompose.describe(decompose.fit(df, 5), W.KEY).first().description
    assert all(h in text for h in ("Periodic components", "Trend", "Shocks", "Local", "Wavelet", "Bounds: 80%"))


def test_workers_and_blend(spark):
    df = one_window(spark, a=noisy(), short=noisy(50), tiny=[1.0, 2.0, 3.0])
    each = workers.worker_forecasts(df, W.KEY, 12, workers.ALL)
    seen = {(r.series_id, r.worker) for r in each.select("series_id", "worker").distinct().collect()}
    assert {w for s, w in seen if s == "a"} == set(workers.ALL) and {w for s, w in seen if s == "short"} == {"AR", "SR"}
    rows = each.collect()
    assert all(0 < r.confidence <= 1 and math.isfinite(r.value) for r in rows)
    out = ensemble.blend(each, workers.signal_of(df, W.KEY), W.KEY).collect()
    assert all(r.lower <= r.value <= r.upper for r in out if r.series_id != "tiny")
    tiny = [r for r in out if r.series_id == "tiny"]
    assert len(tiny) == 1 and math.isnan(tiny[0].value) and tiny[0].confidence == 0 == tiny[0].agreement
    values = {(r.worker, r.h): r.value for r in rows if r.series_id == "a"}
    y = noisy()
    assert np.allclose([values["AR", h] for h in range(12)], K.ar_ahead(y, K.least_squares_ar(y), 12))
    assert np.allclose([values["SR", h] for h in range(12)], K.resonance_fixed(y, 12))
    assert np.allclose([values["Iterative", h] for h in range(12)], K.iterative(y, 12)[0])


def test_blend_collapses_and_skips_nan(spark):
    rows = [("k", "good", 0, h, 1.0 + h, 0.9) for h in range(3)] + [("k", "bad", 1, h, 5.0, 0.3) for h in range(3)] + [("k", "nan", 2, h, math.nan if h == 1 else 9.0, 0.8) for h in range(3)]
    rows += [("m", "x", 0, 0, 1.0, 0.5), ("m", "y", 1, 0, 3.0, 0.5)]
    df = spark.createDataFrame(rows, "key string, worker string, ord int, h int, value double, confidence double")
    signal = spark.createDataFrame([("k", 100, 2.0), ("m", 100, 2.0)], "key string, n int, signal_std double")
    got = {(r.key, r.h): r for r in ensemble.blend(df, signal, ["key"]).collect()}
    assert [got["k", h].value for h in range(3)] == [1.0, 2.0, 3.0] and got["k", 0].agreement == 1 and got["k", 0].confidence == 0.9
    assert got["m", 0].value == 2.0 and np.isclose(got["m", 0].agreement, 1 / 1.5)


def test_backtest_of_short_series(spark):
    df = frame(spark, long=noisy(200), short=noisy(30))
    got = {r.series_id: r for r in backtest.run(df, [24], 100).collect()}
    assert got["long"].n_windows == 4 and got["short"].n_windows == 0 and math.isnan(got["short"].mse)


def test_cli(spark, tmp_path, capsys):
    path = tmp_path / "x.csv"
    path.write_text("OT\n" + "\n".join(f"{v:.4f}" for v in noisy(150)))
    assert cli.main([]) == 1
    assert cli.main(["forecast", str(path), "--horizon", "5", "--describe"]) == 0
    out = capsys.readouterr().out
    assert "t+  1:" in out and "t+  5:" in out and "Trend" in out
    assert cli.main(["decompose", str(path)]) == 0
    assert cli.main(["benchmark", str(path), "--context", "64", "--horizons", "12", "--name", "test"]) == 0
    assert "test" in capsys.readouterr().out


def test_bucket_stream(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [("a", base + dt.timedelta(minutes=10 * i), 1.0) for i in range(60)]
    spark.createDataFrame(rows, "s string, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    query = buckets.bucketed(stream, "s", "ts", "v").writeStream.format("memory").queryName("bucketed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("bucketed").collect()
    assert got and all(r.y == 6.0 for r in got)


def test_ewma_without_order(spark):
    y = noisy(120)
    rows = W.with_previous(frame(spark, a=y, b=[5.0], c=[1.0, 3.0]))
    assert rows.groupBy("series_id").count().collect() and rows.where("series_id = 'b'").count() == 0
    got = {r.series_id: r.ewma for r in statistics.ewma_last(rows.withColumn("error", F.col("y") - F.col("before")), ["series_id"], "error").collect()}
    want = 0.0
    for x in np.abs(np.diff(y)):
        want = 0.1 * x + 0.9 * want
    assert abs(got["a"] - want) < 1e-9 and abs(got["c"] - 0.2) < 1e-12
