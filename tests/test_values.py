"""Values of registered queries that have no SQL, by their definitions over the windows of the given tables."""

import math

import numpy as np
import pytest

from spindrift.functions import kernels as K
from spindrift.plans import workers
from spindrift.plans.queries import C, KEY, QUERIES, H, kept
from spindrift.sources import series as S

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def cut(spark):
    """(series_id, window_start) -> context, what follows."""
    out = {}
    for name, rows in S.hourly_events(spark, SF).toPandas().groupby("series_id"):
        y = rows.sort_values("t")["y"].to_numpy()
        for s in range(0, len(y) - C - H + 1, H):
            out[name, s] = y[s : s + C], y[s + C : s + C + H]
    assert len(out) == 10
    return out


def by_window(rows, *columns):
    out = {}
    for r in sorted(rows, key=lambda r: (r.series_id, r.window_start, r.h)):
        out.setdefault((r.series_id, r.window_start), []).append([r[c] for c in columns])
    return {k: np.array(v).T for k, v in out.items()}


def test_linear_ar(spark, cut):
    got = by_window(QUERIES["ar24_forecast"](spark, SF).collect(), "value", "confidence")
    assert set(got) == set(cut)

    def ahead(y, horizon):
        lagged = np.array([[1, *y[i - 24 : i][::-1]] for i in range(24, len(y))])
        coef, values = np.linalg.lstsq(lagged, y[24:], rcond=None)[0], list(y)
        for _ in range(horizon):
            values.append(coef[0] + coef[1:] @ np.array(values[-24:])[::-1])
        return np.array(values[len(y) :])

    for k, (y, _) in cut.items():
        np.testing.assert_allclose(got[k][0], ahead(y, H), rtol=1e-6)
        part = y[: int(C * 0.75)]
        trust = math.exp(-np.mean((y[len(part) : len(part) + 24] - ahead(part, 24)) ** 2) / y.var()) ** 2
        np.testing.assert_allclose(got[k][1], trust, rtol=1e-6)


def test_ablation(spark, cut):
    got = {(r.model, r.series_id, r.window_start): r.mse for r in QUERIES["fourier_ablation"](spark, SF).collect()}
    point = by_window(QUERIES["spectral_forecast"](spark, SF).collect(), "point")
    assert len(got) == 30
    for k, (y, after) in cut.items():
        assert np.isclose(got["naive", *k], np.mean((after - y[-1]) ** 2))
        assert np.isclose(got["full", *k], np.mean((after - point[k][0]) ** 2))
        t = np.arange(C)
        line = np.polyfit(t, y, 1)
        found = K.waves(y - np.polyval(line, t))[0]
        ahead = np.polyval(line, t[-1] + 1 + np.arange(H)) + sum((a * np.cos(2 * math.pi * f * (C + np.arange(H)) + p) for f, a, p, _ in found), np.zeros(H))
        assert np.isclose(got["fourier_only", *k], np.mean((after - ahead) ** 2))


def test_exponential_trend_is_the_best_of_a_grid(spark, cut):
    rows = {(r.series_id, r.window_start): r for r in QUERIES["trend_exponential"](spark, SF).collect()}
    assert set(rows) == set(cut)
    t = np.arange(C, dtype=float)
    w = np.exp(-math.log(2) / (C / 2) * (C - 1 - t))
    for k, (y, _) in cut.items():
        r = rows[k]
        scale = r.rss / float((K.recency(C, C / 2) * (y - r.a * np.exp(r.b * t) - r.c) ** 2).sum())
        assert np.isclose(scale, 1, rtol=1e-6)
        mine, least = float((w * (y - r.a * np.exp(r.b * t) - r.c) ** 2).sum()), math.inf
        # rates of up to 10 over the whole window are allowed
        for b in np.linspace(-10, 10, 400) / (C - 1):
            basis = np.column_stack([np.exp(b * (t - (C if b > 0 else 0))), np.ones(C)]) * np.sqrt(w)[:, None]
            left = np.sqrt(w) * y - basis @ np.linalg.lstsq(basis, np.sqrt(w) * y, rcond=None)[0]
            least = min(least, float(left @ left))
        assert mine <= least * (1 + 1e-4), k


def test_blend_of_all_workers(spark, cut):
    each = {}
    for r in workers.worker_forecasts(kept(spark, SF), KEY, H).collect():
        each.setdefault((r.series_id, r.window_start), {}).setdefault((r.ord, r.confidence), np.zeros(H))[r.h] = r.value
    got = by_window(QUERIES["ensemble_forecast"](spark, SF).collect(), "value", "lower", "upper", "confidence", "agreement")
    assert set(each) == set(got) == set(cut)
    for k, (y, _) in cut.items():
        trust = np.array([c for _, c in sorted(each[k])])
        values = np.array([each[k][o] for o in sorted(each[k])])
        assert len(trust) == 4
        best, second = sorted(trust)[::-1][:2]
        weight = (np.arange(4) == trust.argmax()).astype(float) if best / second > 2 else trust / trust.sum()
        value = weight @ values
        spread = np.sqrt(weight @ (values - value) ** 2)
        growth = np.sqrt(1 + np.arange(H) / C)
        width = np.maximum((spread + 0.5 * spread.mean()) * growth * 1.28, 0.05 * y.std() * growth)
        agreement = 1 / (1 + spread.mean() / y.std())
        want = [value, value - width, value + width, np.full(H, best * agreement), np.full(H, agreement)]
        np.testing.assert_allclose(got[k], want, rtol=1e-6, atol=1e-6)
