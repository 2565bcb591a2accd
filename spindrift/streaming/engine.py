"""Ensembles with state by series in Structured Streaming: single values, batches and predictions in one stream of commands.

The state store keeps the values of a series as a list that is only added to, and what each worker is fitted to, its
last one-step prediction and its latest errors as one entry of a map for each worker. A micro-batch touches the
state of its own series alone, and a time to live can let go of series that have fallen silent.

A single value first scores the last one-step prediction of each worker; a worker is fitted when it first has enough values,
and predicts one step ahead. A batch is remembered as a whole: every worker is fitted anew to all values, and the errors of a rehearsal
of what follows the first three quarters are added. A batch leaves the last one-step prediction as it was, so the next single value
scores a prediction that was made before the batch. Both kinds may be mixed in any order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ensemble import COLLAPSE
from ..plans import workers as W

#: Errors that a worker's confidence is made of.
LAST = 50
COMMANDS = ("value", "batch", "predict")
INPUT = "series_id string, seq long, command string, values array<double>, horizon int"
FORECASTS = "series_id string, t long, h int, value double, lower double, upper double, confidence double, agreement double"


class Engine:
    """The workers of one series."""

    def __init__(self, workers: dict[str, W.Worker], history: list[float] | None = None, seen: int = 0, deviation: float = 1.0, states: dict[str, dict] | None = None, max_history: int | None = None):
        self.workers, self.history, self.seen, self.deviation, self.max_history = workers, list(history or []), seen, deviation, max_history
        self.states = states or {name: {"fit": None, "last": None, "variance": 1.0, "errors": []} for name in workers}

    def remember(self, values: list[float]) -> np.ndarray:
        self.history.extend(values)
        self.seen += len(values)
        if self.max_history:
            self.history = self.history[-self.max_history :]
        return np.array(self.history)

    def fit(self, name: str, y: np.ndarray) -> None:
        s = self.states[name]
        s["fit"], s["variance"] = self.workers[name].kernel.fit(y), float(y.var())

    def observe(self, value: float) -> None:
        y = self.remember([value])
        for name, w in self.workers.items():
            s = self.states[name]
            if s["last"] is not None:
                miss = value - s["last"]
                s["errors"] = [*s["errors"], miss * miss][-LAST:]
                s["fit"] = w.kernel.learn(s["fit"], miss)
            s["last"] = None
            if len(y) >= w.least or s["fit"] is not None:
                if s["fit"] is None:
                    self.fit(name, y)
                s["last"] = float(w.kernel.ahead(s["fit"], y, 1)[0])

    def observe_batch(self, values: list[float]) -> None:
        if not values:
            return
        self.deviation = max(float(np.std(values)), 1e-10)
        y = self.remember(values)
        for name, w in self.workers.items():
            if len(y) >= w.least:
                s = self.states[name]
                s["errors"] = [*s["errors"], *W.rehearsal_errors(y, w)][-LAST:]
                self.fit(name, y)

    def confidence(self, name: str) -> float:
        s = self.states[name]
        if s["fit"] is None:
            return 0.0
        trust = 0.25 if len(s["errors"]) < 3 else float(np.exp(-np.mean(s["errors"]) / max(s["variance"], 1e-10))) ** 2
        return trust * self.workers[name].kernel.weight(s["fit"])

    def predict(self, horizon: int, level: float = 0.8) -> pd.DataFrame:
        """(h, value, lower, upper, confidence, agreement), as operators.ensemble.blend gives for a window; one row of NaN if no worker is ready."""
        y, each, trust = np.array(self.history), [], []
        for name, w in self.workers.items():
            if (c := self.confidence(name)) > 0:
                values = np.asarray(w.kernel.ahead(self.states[name]["fit"], y, horizon), float)
                if not np.isnan(values).any():
                    each.append(values)
                    trust.append(c)
        if not each or not horizon:
            nan = float("nan")
            return pd.DataFrame({"h": [0], "value": [nan], "lower": [nan], "upper": [nan], "confidence": [0.0], "agreement": [0.0]})
        values, c = np.array(each), np.array(trust)
        ranked = np.sort(c)[::-1]
        alone = len(c) == 1 or ranked[0] / ranked[1] > COLLAPSE
        weights = (np.arange(len(c)) == c.argmax()).astype(float) if alone else c / c.sum()
        value = weights @ values
        spread = np.sqrt(weights @ (values - value) ** 2)
        growth = np.sqrt(1 + np.arange(horizon) / max(self.seen, 1))
        width = np.maximum((spread + 0.5 * spread.mean()) * growth * (1.96 if level >= 0.95 else 1.28), 0.05 * self.deviation * growth)
        agreement = 1 / (1 + spread.mean() / self.deviation)
        return pd.DataFrame({"h": np.arange(horizon), "value": value, "lower": value - width, "upper": value + width, "confidence": ranked[0] * agreement, "agreement": agreement})


class Ensemble(StatefulProcessor):
    """An Engine whose parts live in the state store.

    With a horizon, the rows are values (t, y), those of a micro-batch make one batch and a prediction follows it; without
    one they are commands (seq, command, values, horizon).
    """

    def __init__(self, workers: dict[str, W.Worker], horizon: int | None, max_history: int | None, level: float, forget_after_ms: int | None):
        self.workers, self.horizon, self.max_history, self.level, self.ttl = workers, horizon, max_history, level, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getListState("values", "y double", self.ttl)
        self.counts = handle.getValueState("counts", "seen long, deviation double", self.ttl)
        self.models = handle.getMapState("models", "worker string", "state string", self.ttl)

    def loaded(self) -> Engine:
        self.stored = 0
        if not self.counts.exists():
            return Engine(self.workers, max_history=self.max_history)
        seen, deviation = self.counts.get()
        known = {k[0]: json.loads(v[0]) for k, v in self.models.iterator()}
        y = [v[0] for v in self.values.get()]
        self.stored = len(y)
        return Engine(self.workers, y[-self.max_history :] if self.max_history else y, seen, deviation, known, self.max_history)

    def save(self, e: Engine, before: int) -> None:
        new = e.seen - before
        # values are added to the list; one that has a bound is written anew when it would be over twice as long
        if self.max_history and self.stored + new > 2 * self.max_history:
            self.values.put([(float(v),) for v in e.history])
        elif new:
            self.values.appendList([(float(v),) for v in e.history[-new:]])
        self.counts.update((e.seen, e.deviation))
        for name, s in e.states.items():
            self.models.updateValue((name,), (json.dumps(s),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, e = pd.concat(list(rows)), self.loaded()
        before, out = e.seen, []
        if self.horizon is not None:
            new = new.sort_values("t", kind="stable")
            e.observe_batch(new["y"].astype(float).tolist())
            out.append(e.predict(self.horizon, self.level).assign(t=int(new["t"].iloc[-1])))
        else:
            new = new.sort_values("seq", kind="stable")
            for seq, command, values, horizon in zip(new["seq"], new["command"], new["values"], new["horizon"], strict=True):
                if command == "value":
                    for v in [] if values is None else values:
                        e.observe(float(v))
                elif command == "batch":
                    e.observe_batch([] if values is None else [float(v) for v in values])
                elif command == "predict" and horizon > 0:
                    out.append(e.predict(int(horizon), self.level).assign(t=int(seq)))
        if e.seen > before or not self.counts.exists():
            self.save(e, before)
        if out:
            yield pd.concat(out).assign(series_id=key[0])[["series_id", "t", "h", "value", "lower", "upper", "confidence", "agreement"]].astype({"h": "int32"})

    def close(self) -> None:
        pass


def ensembles(stream: DataFrame, workers: dict[str, W.Worker] | None = None, horizon: int | None = None, max_history: int | None = None, level: float = 0.8, forget_after_ms: int | None = None) -> DataFrame:
    """A stream of forecasts (series_id, t, h, value, lower, upper, confidence, agreement); workers must have kernels.

    Without a horizon the stream is one of commands (see INPUT): `value` observes its values one at a time, `batch` as one,
    `predict` asks for a forecast of `horizon` steps, whose t is the command's seq; other commands are left out. With
    one it is (series_id, t, y), and every micro-batch is one batch and one forecast of its series. All values of a series count, or the last
    `max_history`. A series without rows for forget_after_ms begins anew. Needs the RocksDB state store.
    """
    chosen = W.DEFAULT if workers is None else workers
    if none := [name for name, w in chosen.items() if not w.kernel]:
        raise ValueError(f"workers without a kernel cannot follow a stream: {', '.join(none)}")
    one = Ensemble(chosen, horizon, max_history, level, forget_after_ms)
    mode = "None" if forget_after_ms is None else "ProcessingTime"
    return stream.groupBy("series_id").transformWithStateInPandas(one, outputStructType=FORECASTS, outputMode="Append", timeMode=mode)
