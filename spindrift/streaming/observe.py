"""One value at a time: workers with state by series in Structured Streaming.

Every micro-batch hands a series its new rows in order of t. As long as a worker has too few values it only
remembers them; when it has enough it is fitted once, and from then on each value first scores the last
one-step prediction and then makes the next (refit="batch" fits again with every micro-batch instead and
renews its confidence on held-out values). State is arrays and numbers in the state store, so a restart or a
lost executor goes on from the last checkpoint. A worker that is fitted once keeps only the values its lags
reach, so its state and the work for each value do not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import kernels as K
from ..functions.expressions import confidence
from ..operators.autoregression import one_step, with_latest
from ..operators.windows import BLOCK, lengths
from ..plans.decompose import per_window

OUTPUT = "series_id string, t int, y double, predicted double, confidence double, n long"
ERRORS = 50
LAGS, LEAST = 24, 48
STATE = "seen long, history array<double>, coef array<double>, errors array<double>, last double, variance double, ewma double, sigma_max double"


class Model:
    """An autoregressive worker, with the resonance worker's noise if `noisy`."""

    def __init__(self, noisy: bool = False, refit: str = "once", max_history: int | None = None):
        self.noisy, self.refit, self.max_history = noisy, refit, max_history
        self.seen, self.history = 0, []
        self.coef: list[float] = []
        self.errors: list[float] = []
        self.last, self.variance, self.ewma, self.sigma_max = float("nan"), 1.0, 0.0, 1.0

    def fit(self) -> None:
        y = np.array(self.history)
        coef = K.least_squares_ar(y, LAGS)
        self.coef, self.variance = coef.tolist(), float(y.var())
        self.ewma, self.sigma_max = K.resonance_error(y, coef), 0.4 * float(y.std())

    def step(self) -> float:
        coef, y = np.array(self.coef), np.array(self.history[-LAGS:])
        if self.noisy:
            return K.noisy_step(y, coef, min(self.sigma_max, 0.5 * self.ewma), np.random.default_rng(42))
        return float(coef[0] + coef[1:] @ y[::-1])

    def observe(self, value: float) -> float:
        """Score the last prediction, remember the value, and return the prediction of the next (NaN: not ready)."""
        if not np.isnan(self.last):
            self.errors = [*self.errors[-ERRORS + 1 :], (value - self.last) ** 2]
            self.ewma = 0.1 * abs(value - self.last) + 0.9 * self.ewma
        self.remember([value])
        if len(self.history) >= LEAST or self.coef:
            if not self.coef:
                self.fit()
            self.last = self.step()
            if self.refit == "once":
                self.history = self.history[-LAGS:]
        return self.last

    def remember(self, values: list[float]) -> None:
        self.seen += len(values)
        self.history.extend(values)
        if self.max_history:
            self.history = self.history[-max(self.max_history, LEAST) :]

    def observe_batch(self, values: list[float]) -> None:
        """Remember the values, fit on all, and add the errors of a forecast of what follows the first three quarters."""
        self.remember(values)
        if len(self.history) < LEAST:
            return
        y = np.array(self.history)
        cut = max(LEAST, int(len(y) * 0.75))
        held = y[cut : cut + LAGS]
        if len(held):
            ahead = K.resonance_adaptive(y[:cut], len(held))[0] if self.noisy else K.ar_ahead(y[:cut], K.least_squares_ar(y[:cut], LAGS), len(held))
            self.errors = [*self.errors, *((held - ahead) ** 2).tolist()][-ERRORS:]
        self.fit()

    def confidence(self) -> float:
        if len(self.errors) < 3:
            return 0.25
        return float(np.exp(-np.mean(self.errors) / max(self.variance, 1e-10))) ** 2


class Observer(StatefulProcessor):
    def __init__(self, noisy: bool = False, refit: str = "once", max_history: int | None = None):
        self.options = (noisy, refit, max_history)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("model", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        m = Model(*self.options)
        if self.state.exists():
            m.seen, history, coef, errors, m.last, m.variance, m.ewma, m.sigma_max = self.state.get()
            m.history, m.coef, m.errors = list(history), list(coef), list(errors)
        new = pd.concat(list(rows)).sort_values("t", kind="stable")
        if m.refit == "batch":
            m.observe_batch(new["y"].tolist())
            predicted = [float("nan")] * len(new)
            if m.coef:
                predicted[-1] = m.step()
        else:
            predicted = [m.observe(v) for v in new["y"].tolist()]
        self.state.update((m.seen, m.history, m.coef, m.errors, m.last, m.variance, m.ewma, m.sigma_max))
        yield pd.DataFrame({"series_id": key[0], "t": new["t"].astype("int32"), "y": new["y"], "predicted": predicted, "confidence": m.confidence() if m.coef else 0.0, "n": m.seen})

    def close(self) -> None:
        pass


def observe(stream: DataFrame, noisy: bool = False, refit: str = "once", max_history: int | None = None) -> DataFrame:
    """A streaming frame (series_id, t, y) with one-step predictions of each next value. Needs the RocksDB state store."""
    if refit not in ("once", "batch"):
        raise ValueError("refit is 'once' or 'batch'")
    return stream.groupBy("series_id").transformWithStateInPandas(Observer(noisy, refit, max_history), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def replay(series: DataFrame, block: int = BLOCK) -> DataFrame:
    """What observe() gives for whole series read at once, for history: every series is put in order in blocks only.

    The model is fitted to the first LEAST values; a prediction is a sum over the latest values of its row, and the confidence comes from the
    last ERRORS rows of a series.
    """
    n = lengths(series)
    first = series.where(F.col("t") < LEAST).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("first"))
    known = per_window(first.where(F.size("first") == LEAST), ["first"], "coef array<double>, variance double", lambda y: {"coef": K.least_squares_ar(np.array(y), LAGS).tolist(), "variance": float(np.var(y))})
    rows = with_latest(series.select("series_id", "t", "y"), ["series_id"], LAGS, block=block).join(n, "series_id").join(known.drop("first"), "series_id", "left")
    ready = F.col("t") >= LEAST - 1
    rows = rows.withColumn("predicted", F.when(ready, one_step(F.col("coef"), F.col("latest"))))
    before = F.when(F.col("t") >= LEAST, one_step(F.col("coef"), F.slice("latest", F.lit(2), F.lit(LAGS))))
    last = rows.where(F.col("t") >= F.col("n") - ERRORS).withColumn("error", F.pow(F.col("y") - before, F.lit(2)))
    mean = last.groupBy("series_id", "variance").agg(F.avg("error").alias("mse"), F.count("error").alias("errors"))
    trust = mean.where("variance is not null").select("series_id", confidence(F.col("mse"), F.col("variance"), F.col("errors")).alias("confidence"))
    out = rows.join(trust, "series_id", "left")
    return out.select("series_id", F.col("t").cast("int").alias("t"), "y", F.coalesce("predicted", F.lit(float("nan"))).alias("predicted"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("n").cast("long").alias("n"))
