"""Forecasting workers over packed windows, their hold-out confidence and the ensemble.

A worker is either a kernel over one array or a plan over windows. All kernels of a run go over a window in one Arrow
pass, which gives the forecast of each and the errors of its rehearsal; a plan is a function of a DataFrame (keys, y array, horizon int) that
gives (keys, h, value, weight). The registries map names to workers; further ones can be passed in. Confidence comes
from a second forecast, of what follows the first three quarters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import kernels as K
from ..operators import ensemble
from ..sources.scratch import stored
from . import decompose
from .decompose import Options, per_window

HOLD_OUT, SHARE = 24, 0.75


@dataclass(frozen=True)
class Kernel:
    """fit() of a whole array gives what a forecast needs, in plain numbers, lists and dicts that can be stored as JSON."""

    fit: Callable[[np.ndarray], dict]
    #: Forecast of so many steps behind an array by what was fitted to it, or to an earlier part of it.
    ahead: Callable[[dict, np.ndarray, int], np.ndarray]
    #: What forecasts the held-out part, where that is another algorithm.
    rehearse: Callable[[np.ndarray, int], np.ndarray] | None = None
    #: A factor of the confidence.
    weight: Callable[[dict], float] = lambda _: 1.0
    #: Takes the last one-step error into what was fitted.
    learn: Callable[[dict, float], dict] = lambda state, _: state

    def rehearsal(self, y: np.ndarray, horizon: int) -> np.ndarray:
        return self.rehearse(y, horizon) if self.rehearse else self.ahead(self.fit(y), y, horizon)


@dataclass(frozen=True)
class Worker:
    least: int
    kernel: Kernel | None = None
    #: The plan; where a worker has both, batches use the plan.
    predict: Callable[[DataFrame, list[str]], DataFrame] | None = None


def held_part(y: np.ndarray, least: int) -> tuple[int, np.ndarray]:
    """Where the held-out part begins, and its first values."""
    cut = max(least, int(len(y) * SHARE))
    return cut, y[cut : cut + HOLD_OUT]


def rehearsal_errors(y: np.ndarray, w: Worker) -> list[float]:
    cut, held = held_part(y, w.least)
    return ((held - w.kernel.rehearsal(y[:cut], len(held))) ** 2).tolist() if len(held) else []


def unfolded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode("values").alias("h", "value"), F.lit(1.0).alias("weight"))


def autoregressive(p: int = 24) -> Kernel:
    return Kernel(lambda y: {"coef": K.least_squares_ar(y, p).tolist()}, lambda s, y, h: K.ar_ahead(y, np.array(s["coef"]), h))


def small_fit(y: np.ndarray, o: Options) -> dict:
    """A fit less what no forecast needs."""
    return {k: v for k, v in decompose.fit_window(y, 0, o).items() if k not in ("residual", "layer_variance", "wavelet_ahead")}


def fourier(options: Options | None = None) -> Kernel:
    """Forecasts start where the fit ends, however many values have come in since."""
    o = options or Options()
    return Kernel(lambda y: small_fit(y, o), lambda s, _, h: decompose.ahead(s, h, o))


def shock_fourier() -> Kernel:
    """The decomposition of the window less its level shifts, whose last level is added to the forecast."""
    o = Options()

    def fit(y: np.ndarray) -> dict:
        shift = K.level_shift(y)
        return {"fit": small_fit(y - shift, o), "last_shift": float(shift[-1])}

    return Kernel(fit, lambda s, _, h: decompose.ahead(s["fit"], h, o) + s["last_shift"])


def norm_fourier() -> Kernel:
    """The decomposition; trusted half as much if its residual is not normal (p of 0.01 or less)."""
    o = Options()

    def fit(y: np.ndarray) -> dict:
        whole = decompose.fit_window(y, 0, o)
        r = np.array(whole["residual"][:5000])
        return {"fit": {k: v for k, v in whole.items() if k not in ("residual", "layer_variance")}, "weight": 1.0 if len(r) < 20 or K.shapiro_p(r) > 0.01 else 0.5}

    return Kernel(fit, lambda s, _, h: decompose.ahead(s["fit"], h, o), weight=lambda s: s["weight"])


def aggressive_fourier() -> Kernel:
    """Faster trend damping, and a forecast that shrinks towards zero with the horizon."""
    o = Options(trend_damping_share=0.125)

    def ahead(s: dict, _: np.ndarray, horizon: int) -> np.ndarray:
        h = np.arange(1.0, horizon + 1) / s["n"]
        keep = np.exp(-4 * h)
        return decompose.ahead(s, horizon, o) * (keep + (1 - keep) * np.exp(-0.5 * np.sqrt(h)))

    return Kernel(lambda y: small_fit(y, o), ahead)


def iterative() -> Kernel:
    """The period is that of the fit; every forecast decomposes all values again."""
    return Kernel(lambda y: {"period": K.dominant_period(y)}, lambda s, y, h: K.iterative(y, h, s["period"])[0])


def resonance() -> Kernel:
    def fit(y: np.ndarray) -> dict:
        coef = K.least_squares_ar(y)
        return {"coef": coef.tolist(), "error": K.resonance_error(y, coef), "sigma_max": 0.4 * float(y.std())}

    return Kernel(
        fit,
        lambda s, y, h: K.resonance_fixed(y, h, error=s["error"], coef=np.array(s["coef"]), sigma_max=s["sigma_max"]),
        rehearse=lambda y, h: K.resonance_adaptive(y, h)[0],
        learn=lambda s, miss: s | {"error": 0.1 * abs(miss) + 0.9 * s["error"]},
    )


DEFAULT = {"AR": Worker(48, autoregressive()), "Fourier": Worker(64, fourier()), "Iterative": Worker(100, iterative()), "SR": Worker(48, resonance())}
EXTRA = {"ShockFourier": Worker(64, shock_fourier()), "NormFourier": Worker(64, norm_fourier()), "AggrFourier": Worker(64, aggressive_fourier())}
ALL = DEFAULT | EXTRA


def naive(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last value."""
    return unfolded(df.where("horizon > 0").withColumn("values", F.array_repeat(F.element_at("y", -1), F.col("horizon"))), keys)


def seasonal_naive(period: int) -> Callable[[DataFrame, list[str]], DataFrame]:
    """The last period again and again."""

    def predict(df: DataFrame, keys: list[str]) -> DataFrame:
        values = F.transform(F.sequence(F.lit(0), F.col("horizon") - 1), lambda h: F.element_at("y", F.size("y") - period + 1 + F.pmod(h, F.lit(period))))
        return unfolded(df.where("horizon > 0").withColumn("values", values), keys)

    return predict


def mean_level(df: DataFrame, keys: list[str]) -> DataFrame:
    mean = F.aggregate("y", F.lit(0.0), lambda s, x: s + x) / F.size("y")
    return unfolded(df.where("horizon > 0").withColumn("values", F.array_repeat(mean, F.col("horizon"))), keys)


#: Workers that need no kernel in batches; streams use one.
PLAIN = {
    "Naive": Worker(48, Kernel(lambda _: {}, lambda _, y, h: np.full(h, y[-1])), naive),
    "Seasonal": Worker(48, Kernel(lambda _: {}, lambda _, y, h: y[len(y) - 24 + np.arange(h) % 24]), seasonal_naive(24)),
    "Mean": Worker(48, Kernel(lambda _: {}, lambda _, y, h: np.full(h, y.mean())), mean_level),
}


def with_variance(df: DataFrame) -> DataFrame:
    mean = F.aggregate("y", F.lit(0.0), lambda s, x: s + x) / F.size("y")
    centred = df.withColumn("mean", mean)
    return centred.withColumn("variance", F.aggregate("y", F.lit(0.0), lambda s, x: s + F.pow(x - F.col("mean"), F.lit(2))) / F.size("y")).drop("mean")


def held_out(windows: DataFrame, keys: list[str], workers: dict[str, Worker]) -> DataFrame:
    """(keys, worker, variance, h, error) of plans: squared errors of forecasts of what follows the first three quarters.

    A window with nothing held out has one row without an error; one that is too short for a worker has none.
    """
    out = None
    base = with_variance(windows.select(*keys, "y"))
    for name, w in workers.items():
        cut = F.greatest(F.lit(w.least), F.floor(F.size("y") * SHARE).cast("int"))
        ready = base.where(F.size("y") >= w.least).withColumn("cut", cut)
        held = ready.select(*keys, "variance", F.slice("y", 1, F.col("cut")).alias("y"), F.least(F.lit(HOLD_OUT), F.size("y") - F.col("cut")).alias("horizon"), F.slice("y", F.col("cut") + 1, F.lit(HOLD_OUT)).alias("after"))
        predicted = w.predict(held.where("horizon > 0"), [*keys, "variance", "after"])
        scored = predicted.select(*keys, "variance", F.col("h").cast("int").alias("h"), F.pow(F.get("after", F.col("h")) - F.col("value"), F.lit(2)).alias("error"))
        none = held.where("horizon = 0").select(*keys, "variance", F.lit(0).alias("h"), F.lit(None).cast("double").alias("error"))
        part = scored.unionByName(none).withColumn("worker", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select(*keys, "worker", "variance", "h", "error")


def split_kinds(workers: dict[str, Worker]) -> tuple[dict[str, Worker], dict[str, Worker]]:
    """Workers that go through the one kernel pass, and those that are plans."""
    plans = {name: w for name, w in workers.items() if w.predict}
    return {name: w for name, w in workers.items() if not w.predict}, plans


def kernel_pass(windows: DataFrame, keys: list[str], horizon: int, workers: dict[str, Worker], order: list[str]) -> DataFrame:
    """(keys, worker, ord, values, mse, errors, confidence) of every kernel that a window is long enough for."""

    def each(y: list[float]) -> dict:
        x, out = np.asarray(y, float), []
        for name, w in workers.items():
            if len(x) >= w.least:
                state = w.kernel.fit(x) if horizon else None
                values, weight = (np.asarray(w.kernel.ahead(state, x, horizon)).tolist(), w.kernel.weight(state)) if horizon else ([], 1.0)
                out.append({"worker": name, "ord": order.index(name), "values": values, "weight": weight, "squares": rehearsal_errors(x, w)})
        return {"found": out}

    kind = "found array<struct<worker:string,ord:int,values:array<double>,weight:double,squares:array<double>>>"
    done = per_window(with_variance(windows.select(*keys, "y")), ["y"], kind, each).select(*keys, "variance", F.inline("found"))
    errors = F.size("squares")
    mse = F.when(errors > 0, F.aggregate("squares", F.lit(0.0), lambda s, x: s + x) / errors).otherwise(0.0)
    known = done.withColumn("mse", mse).withColumn("errors", errors.cast("long"))
    return known.select(*keys, "worker", "ord", "values", "mse", "errors", "weight", E.confidence(F.col("mse"), F.col("variance"), F.col("errors")).alias("confidence"))


def confidences(windows: DataFrame, keys: list[str], workers: dict[str, Worker]) -> DataFrame:
    """(keys, worker, mse, errors, confidence) from held-out errors; a window with none keeps the prior."""
    kernels, plans = split_kinds(workers)
    out = kernel_pass(windows, keys, 0, kernels, list(workers)).select(*keys, "worker", "mse", "errors", "confidence") if kernels else None
    if plans:
        scored = held_out(windows, keys, plans).groupBy(*keys, "worker", "variance").agg(F.coalesce(F.avg("error"), F.lit(0.0)).alias("mse"), F.count("error").alias("errors"))
        part = scored.select(*keys, "worker", "mse", "errors", E.confidence(F.col("mse"), F.col("variance"), F.col("errors")).alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out


def plan_forecasts(windows: DataFrame, keys: list[str], horizon: int, workers: dict[str, Worker], order: list[str]) -> DataFrame:
    """(keys, worker, ord, h, value, confidence) of plans."""
    out = None
    for name, w in workers.items():
        ready = windows.select(*keys, "y").where(F.size("y") >= w.least).withColumn("horizon", F.lit(horizon))
        part = w.predict(ready, keys).select(*keys, F.lit(name).alias("worker"), F.lit(order.index(name)).alias("ord"), "h", "value", "weight")
        out = part if out is None else out.unionByName(part)
    found = confidences(windows, keys, workers).select(*keys, "worker", "confidence")
    return out.join(found, [*keys, "worker"]).select(*keys, "worker", "ord", "h", "value", (F.col("confidence") * F.col("weight")).alias("confidence"))


def worker_forecasts(windows: DataFrame, keys: list[str], horizon: int, workers: dict[str, Worker] | None = None) -> DataFrame:
    """(keys, worker, ord, h, value, confidence) of every worker that has enough values."""
    workers = DEFAULT if workers is None else workers
    kernels, plans = split_kinds(workers)
    out = None
    if kernels:
        done = kernel_pass(windows, keys, horizon, kernels, list(workers))
        out = done.select(*keys, "worker", "ord", F.posexplode("values").alias("h", "value"), (F.col("confidence") * F.col("weight")).alias("confidence"))
    if plans:
        part = plan_forecasts(windows, keys, horizon, plans, list(workers))
        out = part if out is None else out.unionByName(part)
    return out


def stored_forecasts(windows: DataFrame, keys: list[str], horizon: int, workers: dict[str, Worker]) -> DataFrame:
    """The forecasts as a table, for callers that read them more than once."""
    return stored(worker_forecasts(windows, keys, horizon, workers), "worker-forecasts")


def signal_of(windows: DataFrame, keys: list[str]) -> DataFrame:
    return with_variance(windows.select(*keys, "y")).select(*keys, F.size("y").alias("n"), F.sqrt("variance").alias("signal_std"))


def ensemble_forecast(windows: DataFrame, keys: list[str], horizon: int, workers: dict[str, Worker] | None = None, level: float = 0.8) -> DataFrame:
    return ensemble.blend(worker_forecasts(windows, keys, horizon, workers), signal_of(windows, keys), keys, level)
