"""Commands, event-time buckets and the way from events to forecasts, against plain Python and batch plans."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import kernels as K
from spindrift.operators import windows as W
from spindrift.plans import decompose, queries, workers
from spindrift.sources import series as S
from spindrift.streaming import buckets, engine, ensemble

SF = "/root/testdata/sf0.001"


def seasonal(n, seed):
    return 5 * np.sin(2 * np.pi * np.arange(n) / 12) + np.random.default_rng(seed).normal(0, 0.5, n)


class Plain:
    """The workers by their definitions: no state store, no JSON, everything fitted where it is needed."""

    def __init__(self):
        self.y, self.std = [], 1.0
        self.w = {k: {"fit": None, "last": None, "errors": [], "var": 1.0} for k in ("AR", "Fourier", "Iterative", "SR")}
        self.least = {"AR": 48, "Fourier": 64, "Iterative": 100, "SR": 48}

    def fit(self, k):
        y = np.array(self.y)
        s = self.w[k]
        s["var"] = y.var()
        if k in ("AR", "SR"):
            s["fit"] = K.least_squares_ar(y)
            s["ewma"], s["cap"] = K.resonance_error(y, s["fit"]), 0.4 * y.std()
        elif k == "Fourier":
            s["fit"] = decompose.fit_window(y, 200, decompose.Options())
        else:
            s["fit"] = K.dominant_period(y)

    def ahead(self, k, h):
        y, s = np.array(self.y), self.w[k]
        if k == "AR":
            return K.ar_ahead(y, s["fit"], h)
        if k == "Fourier":
            return decompose.ahead(s["fit"], h, decompose.Options())
        if k == "Iterative":
            return K.iterative(y, h, s["fit"])[0]
        return K.resonance_fixed(y, h, error=s["ewma"], coef=s["fit"], sigma_max=s["cap"])

    def rehearse(self, k, y, h):
        if k == "AR":
            return K.ar_ahead(y, K.least_squares_ar(y), h)
        if k == "Fourier":
            return decompose.ahead(decompose.fit_window(y, h, decompose.Options()), h, decompose.Options())
        return K.iterative(y, h)[0] if k == "Iterative" else K.resonance_adaptive(y, h)[0]

    def observe(self, v):
        for k, s in self.w.items():
            if s["last"] is not None:
                s["errors"] = [*s["errors"], (v - s["last"]) ** 2][-50:]
                if k == "SR":
                    s["ewma"] = 0.1 * abs(v - s["last"]) + 0.9 * s["ewma"]
        self.y.append(v)
        for k, s in self.w.items():
            s["last"] = None
            if len(self.y) >= self.least[k]:
                if s["fit"] is None:
                    self.fit(k)
                s["last"] = self.ahead(k, 1)[0]

    def observe_batch(self, values):
        self.y += list(values)
        self.std = max(np.std(values), 1e-10)
        for k, s in self.w.items():
            if len(self.y) >= self.least[k]:
                y = np.array(self.y)
                cut = max(self.least[k], int(len(y) * 0.75))
                held = y[cut : cut + 24]
                if len(held):
                    s["errors"] = [*s["errors"], *((held - self.rehearse(k, y[:cut], len(held))) ** 2)][-50:]
                self.fit(k)  # the last one-step prediction stays

    def predict(self, h):
        ready = [k for k, s in self.w.items() if s["fit"] is not None]
        if not ready:
            return None
        c = np.array([0.25 if len(self.w[k]["errors"]) < 3 else np.exp(-np.mean(self.w[k]["errors"]) / max(self.w[k]["var"], 1e-10)) ** 2 for k in ready])
        each, ranked = np.array([self.ahead(k, h) for k in ready]), np.sort(c)[::-1]
        p = (np.arange(len(c)) == c.argmax()).astype(float) if len(c) == 1 or ranked[0] / ranked[1] > 2 else c / c.sum()
        value = p @ each
        spread = np.sqrt(p @ (each - value) ** 2)
        growth = np.sqrt(1 + np.arange(h) / len(self.y))
        width = np.maximum((spread + 0.5 * spread.mean()) * growth * 1.28, 0.05 * self.std * growth)
        agreement = 1 / (1 + spread.mean() / self.std)
        return value, value - width, value + width, np.full(h, c.max() * agreement), np.full(h, agreement)


def files(spark, path, batches, schema, first=0):
    os.makedirs(path, exist_ok=True)
    for k, rows in enumerate(batches, first):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}-{k}")
        (name,) = [f for f in os.listdir(f"{path}-{k}") if f.endswith(".parquet")]
        os.rename(f"{path}-{k}/{name}", f"{path}/{k}.parquet")
        os.utime(f"{path}/{k}.parquet", (1_600_000_000 + k, 1_600_000_000 + k))


def written(df, spark, tmp_path, name, schema):
    df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(str(tmp_path / name))


def test_mixed_commands_are_plain_python(spark, tmp_path):
    """Values and batches in turns, over micro-batches with a restart between; stale predictions, one series absent, one never ready."""
    a, b = seasonal(170, 1).tolist(), seasonal(130, 2).tolist()
    plan = {
        "a": [("value", a[:40], 0), ("value", a[40:70], 0), ("predict", None, 6), ("batch", a[70:120], 0), ("value", a[120:121], 0), ("predict", None, 9), ("batch", a[121:150], 0), ("value", a[150:160], 0), ("predict", None, 6), ("value", a[160:], 0), ("predict", None, 3)],
        "b": [("batch", b[:60], 0), ("value", b[60:62], 0), ("batch", b[62:100], 0), ("batch", [], 0), ("value", b[100:], 0), ("predict", None, 5), ("other", [1.0], 3), ("predict", None, 0)],
        "c": [("value", [1.0, 2.0], 0), ("predict", None, 4)],
    }
    want, rows = {}, []
    for s, commands in plan.items():
        p = Plain()
        for seq, (command, values, horizon) in enumerate(commands):
            rows.append((s, seq, command, values, horizon))
            if command == "value":
                for v in values:
                    p.observe(v)
            elif command == "batch" and values:
                p.observe_batch(values)
            elif command == "predict" and horizon:
                want[s, seq] = p.predict(horizon)
    batches = [[r for r in rows if r[1] in seqs] for seqs in ((0, 1, 2), (3, 4, 5), (6, 7, 8, 9, 10))]
    source, session = str(tmp_path / "in"), ensemble.stateful_session(spark)
    got = None
    for upto in (2, 3):  # stopped after two micro-batches and started again
        files(spark, source, batches[:2] if upto == 2 else batches[2:], engine.INPUT, 0 if upto == 2 else 2)
        stream = session.readStream.schema(engine.INPUT).option("maxFilesPerTrigger", 1).parquet(source)
        got = written(engine.ensembles(stream), spark, tmp_path, "out", engine.FORECASTS)
    got = got.toPandas()
    assert set(zip(got.series_id, got.t, strict=True)) == set(want)
    for (s, seq), expected in want.items():
        mine = got[(got.series_id == s) & (got.t == seq)].sort_values("h")
        if expected is None:
            assert len(mine) == 1 and mine.value.isna().all() and mine.confidence.eq(0).all()
            continue
        for column, x in zip(("value", "lower", "upper", "confidence", "agreement"), expected, strict=True):
            np.testing.assert_allclose(mine[column], x, rtol=1e-7, atol=1e-9)


def test_stale_prediction_is_scored():
    """A batch leaves the one-step prediction; the next single value is held against it."""
    e = engine.Engine({"Naive": workers.PLAIN["Naive"]})
    for v in [0.0] * 49:
        e.observe(v)
    e.observe_batch([10.0] * 20)
    before = len(e.states["Naive"]["errors"])
    e.observe(10.0)
    assert e.states["Naive"]["errors"][-1] == 100.0 and len(e.states["Naive"]["errors"]) == before + 1


def test_bounded_history_and_workers_without_a_kernel(spark):
    e = engine.Engine({"Mean": workers.PLAIN["Mean"]}, max_history=60)
    e.observe_batch(list(range(100)))
    assert e.history == list(range(40, 100)) and e.seen == 100
    with pytest.raises(ValueError, match="kernel"):
        engine.ensembles(spark.createDataFrame([], "series_id string, t int, y double"), {"Plan": workers.Worker(1, None, workers.naive)}, 3)


EVENTS = "kind string, ts timestamp, v double"
BASE = dt.datetime(2024, 1, 1)


def at(minutes):
    return BASE + dt.timedelta(minutes=minutes)


def end(minutes):
    return (None, at(minutes), None)


@pytest.mark.parametrize(("agg", "fill"), [("sum", "zero"), ("avg", "forward"), ("count", "none"), ("max", "zero")])
def test_grid_is_the_batch_series(spark, tmp_path, agg, fill):
    """Gaps, rows out of order within the delay, rows that are too late, nulls, and a restart."""
    rng = np.random.default_rng(3)
    rows = [("a", at(float(m)), float(v)) for m, v in zip(rng.uniform(0, 900, 120), rng.normal(0, 1, 120), strict=True)]
    rows += [("b", at(30.0), 1.0), ("b", at(31.0), 2.0), ("b", at(700.0), 5.0), ("b", None, 1.0), ("b", at(100.0), None)]
    rows.sort(key=lambda r: r[1] or BASE)
    early, later = [r for r in rows if (r[1] or BASE) < at(400)], [r for r in rows if (r[1] or BASE) >= at(400)]
    # the second file ends an hour's delay behind 900 minutes, so this row of the third is dropped, and this one is not
    late, fine = ("a", at(100.0), 1000.0), ("b", at(890.0), 3.0)
    batches = [early[::-1], later, [late, fine, end(899)], [end(3000)]]
    source, session = str(tmp_path / "in"), ensemble.stateful_session(spark)
    for k, rows_in in enumerate(batches):
        files(spark, source, [rows_in], EVENTS, k)
        stream = session.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        got = written(buckets.dense(stream, "kind", "ts", "v", agg=agg, fill=fill), spark, tmp_path, "out", buckets.DENSE)
    df = spark.createDataFrame([*rows, fine], EVENTS)
    want = S.from_events(df, F.col("kind"), F.floor(F.unix_seconds("ts") / 3600), F.col("v"), agg, fill)
    mine, other = ({(r.series_id, r.t): r.y for r in x.collect()} for x in (got, want))
    assert mine.keys() == other.keys() and len(mine) == got.count()
    assert all(mine[k] == other[k] or np.isclose(mine[k], other[k]) for k in other)
    starts = {r.bucket_start for r in got.where("t = 0").collect()}
    assert starts == {BASE}


def test_options_of_the_grid(spark):
    with pytest.raises(ValueError, match="agg"):
        buckets.dense(spark.createDataFrame([], EVENTS), "kind", "ts", "v", agg="median")


def test_events_to_forecasts(spark):
    """One stream from raw events gives what the batch plans give for the same series."""
    got = queries.QUERIES["streaming_events_ensemble"](spark, SF).toPandas()
    series = S.hourly_events(spark, SF)
    whole = series.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("y"))
    want = workers.ensemble_forecast(whole, ["series_id"], queries.H).toPandas()
    ends = {r.series_id: r.n - 1 for r in W.lengths(series).collect()}
    assert len(got) == len(want) > 0
    both = got.merge(want, on=["series_id", "h"], suffixes=("", "_w"))
    assert len(both) == len(want) and all(both.t == both.series_id.map(ends))
    for c in ("value", "lower", "upper", "confidence", "agreement"):
        np.testing.assert_allclose(both[c], both[f"{c}_w"], rtol=1e-6, atol=1e-9)


def test_series_from_a_stopped_stream(spark):
    mine, other = (x.toPandas().sort_values(["series_id", "t"]).reset_index(drop=True) for x in (queries.QUERIES["streaming_series"](spark, SF), queries.QUERIES["hourly_series"](spark, SF)))
    assert mine.series_id.tolist() == other.series_id.tolist() and mine.t.tolist() == other.t.tolist()
    np.testing.assert_allclose(mine.y, other.y, atol=1e-6)
