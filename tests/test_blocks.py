"""Operators that put long series in order block by block, with small blocks, against one array for each series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import seasonal, shocks, windows


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(11)
    y = {"a": rng.normal(0, 1, 97).cumsum(), "b": rng.normal(5, 2, 40), "c": rng.normal(0, 1, 3)}
    y["a"][30:] += 40
    y["a"][[60, 62, 63, 64, 66]] += [25, -30, 35, -20, 30]
    rows = [(s, i, float(v)) for s, values in y.items() for i, v in enumerate(values)]
    rng.shuffle(rows)
    return spark.createDataFrame([(str(s), int(i), float(v)) for s, i, v in rows], "series_id string, t int, y double").cache(), y


def column(df, name):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.series_id, r.t)):
        out.setdefault(r.series_id, []).append(np.nan if r[name] is None else r[name])
    return out


@pytest.mark.parametrize("block", [4, 10, 1000])
def test_moving_average(long, block):
    df, y = long
    got = column(seasonal.moving_average(df, ["series_id"], 7, block=block), "trend")
    for s, v in y.items():
        want = [v[i - 3 : i + 4].mean() if 3 <= i < len(v) - 3 else np.nan for i in range(len(v))]
        np.testing.assert_allclose(got[s], want)


def test_frame_looks_back(long):
    df, y = long
    got = column(windows.framed(df, ["series_id"], 9, 0, lambda f: {"m": F.avg("y").over(f)}, block=5), "m")
    for s, v in y.items():
        np.testing.assert_allclose(got[s], [v[max(0, i - 9) : i + 1].mean() for i in range(len(v))])


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_running(long, block):
    df, y = long
    some = df.withColumn("x", F.when(F.pmod(F.col("t"), F.lit(11)) == 5, F.col("y")))
    total = column(windows.running(some, ["series_id"], "x", "r", block=block), "r")
    last = column(windows.running(some, ["series_id"], "x", "r", "last", block=block), "r")
    for s, v in y.items():
        x = [v[i] if i % 11 == 5 else np.nan for i in range(len(v))]
        np.testing.assert_allclose(total[s], np.nancumsum(x))
        np.testing.assert_allclose(last[s], [next((x[k] for k in range(i, -1, -1) if not np.isnan(x[k])), np.nan) for i in range(len(v))])


def test_ends(long):
    df, y = long
    holes = df.withColumn("x", F.when(F.col("t").between(4, 30) & (F.col("t") != 10), F.col("y")))
    got = column(seasonal.fill_ends(holes, ["series_id"], "x"), "x")
    for s in ("a", "b"):
        v = y[s]
        want = [v[4]] * 4 + [v[i] if i != 10 else np.nan for i in range(4, 31)] + [v[30]] * (len(v) - 31)
        np.testing.assert_allclose(got[s], want)
    assert np.isnan(got["c"]).all()


def candidates(y, window, min_sigma):
    """(index, magnitude) by one pass over an array."""
    window += window % 2 == 0
    step, n, gap = np.diff(y), len(y), max(window // 2, 3)
    if n < 2 * window:
        return []
    mad = np.median(np.abs(step - np.median(step)))
    over, last, out = np.flatnonzero(np.abs(step) > min_sigma * mad / 0.6745), -gap - 1, []
    for i in over.tolist():
        if i - last >= gap:
            last, side = i, min(window, i, n - i - 1)
            if side >= 3:
                out.append((i + 1, np.median(y[i + 1 : i + 1 + side]) - np.median(y[i - side : i])))
    return out


@pytest.mark.parametrize("block", [5, 16, 1000])
@pytest.mark.parametrize("sigma", [1.0, 3.0])
def test_shift_candidates(long, block, sigma):
    df, y = long
    got = sorted((r.series_id, r["index"], r.magnitude) for r in shocks.shift_candidates(df, 9, sigma, block).collect())
    want = sorted((s, i, m) for s, v in y.items() for i, m in candidates(v, 9, sigma))
    assert len(want) >= 3 and [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want])


def test_without_shifts(spark, long):
    df, y = long
    at = spark.createDataFrame([("a", 30, 40.0), ("a", 60, -2.0), ("b", 0, 1.0)], "series_id string, index int, magnitude double")
    got = column(shocks.without_shifts(df, at, block=8), "shift")
    np.testing.assert_allclose(got["a"], 40.0 * (np.arange(97) >= 30) - 2.0 * (np.arange(97) >= 60))
    np.testing.assert_allclose(got["b"], np.ones(40))
    np.testing.assert_allclose(got["c"], np.zeros(3))
