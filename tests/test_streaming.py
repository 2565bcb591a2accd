"""Streaming operators against plain Python over the same micro-batches."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.plans import workers
from spindrift.streaming import ensemble, observe

H = 5


def noisy(n, seed, period=12):
    t = np.arange(n)
    return 5 * np.sin(2 * np.pi * t / period) + 0.02 * t + np.random.default_rng(seed).normal(0, 0.4, n)


def write(spark, path, batches):
    """One file for each micro-batch, in the order of their times."""
    for k, rows in enumerate(batches):
        frame = pd.DataFrame(rows, columns=["series_id", "t", "y"]).astype({"t": "int32", "y": "float64"})
        frame.to_parquet(f"{path}/{k}.parquet")
        os.utime(f"{path}/{k}.parquet", (1_600_000_000 + k, 1_600_000_000 + k))


def run(spark, tmp_path, batches, chosen, **options):
    source = tmp_path / "in"
    source.mkdir()
    write(spark, source, batches)
    stream = ensemble.stateful_session(spark).readStream.schema("series_id string, t int, y double").option("maxFilesPerTrigger", 1).parquet(str(source))
    ensemble.start(stream, str(tmp_path / "out"), H, chosen, **options).awaitTermination()
    return ensemble.forecasts(spark, str(tmp_path / "out"))


def ahead_ar(y, h, p=24):
    rows = np.array([[1, *y[i - p : i][::-1]] for i in range(p, len(y))])
    coef, values = np.linalg.lstsq(rows, y[p:], rcond=None)[0], list(y)
    for _ in range(h):
        values.append(coef[0] + coef[1:] @ np.array(values[-p:])[::-1])
    return np.array(values[len(y) :])


AHEAD = {
    "AR": ahead_ar,
    "Naive": lambda y, h: np.full(h, y[-1]),
    "Seasonal": lambda y, h: np.array([y[len(y) - 24 + k % 24] for k in range(h)]),
    "Mean": lambda y, h: np.full(h, y.mean()),
}
CHOSEN = {"AR": workers.DEFAULT["AR"], **workers.PLAIN}


class Plain:
    """Workers and blend by their definitions; every call of observe is one batch."""

    def __init__(self, most):
        self.y, self.n, self.most, self.errors = np.zeros(0), 0, most, {w: [] for w in AHEAD}

    def observe(self, values):
        self.y, self.n, self.std = np.concatenate([self.y, values])[-self.most :], self.n + len(values), max(np.std(values), 1e-10)
        if len(self.y) >= 48:
            cut = max(48, int(len(self.y) * 0.75))
            held = self.y[cut : cut + 24]
            for w, f in AHEAD.items():
                self.errors[w] = [*self.errors[w], *((held - f(self.y[:cut], len(held))) ** 2)][-50:]

    def predict(self):
        if len(self.y) < 48:
            return None
        trust = np.array([np.exp(-np.mean(e) / max(self.y.var(), 1e-10)) ** 2 if len(e) >= 3 else 0.25 for e in self.errors.values()])
        top = np.sort(trust)[::-1]
        weights = trust / trust.sum() if top[0] / top[1] <= 2 else (np.arange(len(trust)) == trust.argmax()).astype(float)
        each = np.array([f(self.y, H) for f in AHEAD.values()])
        value = weights @ each
        spread = np.sqrt(weights @ (each - value) ** 2)
        growth = np.sqrt(1 + np.arange(H) / self.n)
        width = np.maximum((spread + 0.5 * spread.mean()) * growth * 1.28, 0.05 * self.std * growth)
        agreement = 1 / (1 + spread.mean() / self.std)
        return value, value - width, value + width, trust.max() * agreement, agreement


def test_ensemble_is_the_plain_one(spark, tmp_path):
    """Series of unlike lengths, one that is absent from a micro-batch, one that is never ready, rows with nulls."""
    a, b, c = noisy(200, 1), noisy(150, 2), noisy(30, 3)
    most = 120
    parts = [
        [("a", a[:100]), ("b", b[:48]), ("c", c[:10])],
        [("a", a[100:110])],
        [("a", a[110:200]), ("b", b[48:150]), ("c", c[10:])],
    ]
    at, plain, batches, want = {}, {}, [], {}
    for k, part in enumerate(parts):
        rows = []
        for s, values in part:
            first = at.get(s, 0)
            rows += [(s, first + i, y) for i, y in enumerate(values)]
            at[s] = first + len(values)
            plain.setdefault(s, Plain(most)).observe(values)
            want[k, s] = (at[s] - 1, plain[s].predict())
        batches.append([*rows[::-1], (None, 0, 1.0), ("a", at["a"] - 1, None)])
    got = run(spark, tmp_path, batches, CHOSEN, max_history=most).toPandas()
    assert set(zip(got.batch, got.series_id, strict=True)) == set(want)
    for (k, s), (t, expected) in want.items():
        mine = got[(got.batch == k) & (got.series_id == s)].sort_values("h")
        assert set(mine.t) == {t}
        if expected is None:
            assert len(mine) == 1 and mine.value.isna().all() and (mine.confidence == 0).all()
            continue
        assert mine.h.tolist() == list(range(H))
        for column, x in zip(("value", "lower", "upper", "confidence", "agreement"), expected, strict=True):
            np.testing.assert_allclose(mine[column], np.broadcast_to(x, H), rtol=1e-6, atol=1e-8)


def test_one_micro_batch_is_the_batch_forecast(spark, tmp_path):
    """With all the default workers."""
    rows = [(s, i, float(y)) for s, seed in (("a", 4), ("b", 5)) for i, y in enumerate(noisy(160, seed))]
    got = run(spark, tmp_path, [rows], None).toPandas().sort_values(["series_id", "h"])
    windows = spark.createDataFrame(rows, "series_id string, t int, y double").groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("y"))
    want = workers.ensemble_forecast(windows, ["series_id"], H).toPandas().sort_values(["series_id", "h"])
    for c in ("value", "lower", "upper", "confidence", "agreement"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9)


def test_own_session(spark):
    before = spark.conf.get(ensemble.PROVIDER)
    own = ensemble.stateful_session(spark)
    assert "RocksDB" in own.conf.get(ensemble.PROVIDER) and spark.conf.get(ensemble.PROVIDER) == before
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


@pytest.mark.parametrize("noise", [False, True])
def test_state_of_a_fitted_worker_is_bounded(noise):
    """Fitted once, a worker needs the values its lags reach and predicts as if it had kept all."""
    y = noisy(300, 6)
    short, whole = observe.Model(noise), observe.Model(noise)
    whole.refit = "never forgets"
    a, b = ([m.observe(v) for v in y.tolist()] for m in (short, whole))
    np.testing.assert_allclose(a, b)
    assert short.seen == whole.seen == 300 and len(short.history) == observe.LAGS and len(whole.history) == 300
