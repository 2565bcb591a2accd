"""Decomposition of packed windows and forecasts from it.

fit() runs the iterative numerics of one window at a time inside Arrow batches and gives one row per window;
forecast() is columns only: it unfolds the horizon and adds the layers up in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as E
from ..functions import kernels as K


@dataclass(frozen=True)
class Options:
    max_components: int = 50
    min_snr: float = 2.0
    noise_threshold_ratio: float = 0.5
    recency_halflife: float | None = None
    shock_lookback: int | None = None
    shock_min_sigma: float = 2.0
    confidence_level: float = 0.8
    trend_damping_halflife: float | None = None
    amplitude_damping: bool = True
    #: The trend halflife as a share of the window, if no fixed one is given.
    trend_damping_share: float = 0.25


FIT_FIELDS = """
    n int, range_lo double, range_hi double,
    components array<struct<frequency:double,amplitude:double,phase:double,snr:double>>, periodic_lo double, periodic_hi double,
    trend struct<trend_type:string,a:double,b:double,c:double,bic:double,residual_std:double>,
    shocks array<struct<onset_idx:int,shape:string,magnitude:double,decay_rate:double,aic:double>>,
    local struct<order:int,coefficients:array<double>,intercept:double,aic:double,residual_std:double,window_size:int>,
    recent array<double>, residual_ac1 double, residual_mode string,
    wavelet struct<wavelet_name:string,n_levels:int,original_length:int,residual_std:double,components:array<struct<level:int,kind:string,energy_fraction:double,coefficients:array<double>>>>,
    wavelet_ahead array<double>, layer_variance array<double>, residual array<double>, noise_std double, q_lo double, q_hi double
"""
AC1_GATE = 0.1


def fit_window(y: np.ndarray, horizon: int, o: Options) -> dict:
    """All layers of one window; the wavelet layer is continued for `horizon` steps."""
    if not np.isfinite(y).all():
        raise ValueError("a window holds NaN or Inf values, and a fit takes finite ones only")
    n, t, deviation = len(y), np.arange(len(y), dtype=float), float(y.std())
    line = np.polyval(np.polyfit(t, y, 1), t)
    found, rest = K.waves(y - line, o.max_components, o.min_snr, o.noise_threshold_ratio)
    noise = float(rest.std())
    periodic = sum((a * np.cos(2 * np.pi * f * t + p) for f, a, p, _ in found), np.zeros(n))
    kind, params, bic, trend_std = K.trend(rest + line, o.recency_halflife)
    layer_trend = K.trend_at(kind, params, t)
    jolts = K.shocks(y - periodic - layer_trend, max(noise, trend_std), o.shock_min_sigma, o.shock_lookback or max(n // 4, 20))
    layer_shock = sum((K.shock_at(s, at, m, r, t) for at, s, m, r, _ in jolts), np.zeros(n))
    r = y - periodic - layer_trend - layer_shock
    ac1 = float(np.corrcoef(r[:-1], r[1:])[0, 1]) if r.std() > 1e-10 else 0.0
    coef, intercept, aic, innovation, used = K.autoregression(r)
    last = r - K.autoregression_fitted(r, coef, intercept)
    model, ahead, mode, layer_wave = None, [], "ar", np.zeros(n)
    if abs(ac1) >= AC1_GATE:
        parts, shares, layer_wave = K.wavelet(last)
        ahead, mode = K.wavelet_ahead(parts, n, horizon).tolist(), "wavelet+ar"
        levels = len(parts) - 1
        scales = [{"level": levels - max(i - 1, 0), "kind": "detail" if i else "approximation", "energy_fraction": s, "coefficients": p.tolist()} for i, (p, s) in enumerate(zip(parts, shares, strict=True))]
        last = last - layer_wave
        model = {"wavelet_name": "db4", "n_levels": levels, "original_length": n, "residual_std": float(last.std()), "components": scales}
    alpha = (1 - o.confidence_level) / 2
    layers = (y, periodic, layer_trend, layer_shock, r - last - layer_wave, layer_wave, last)
    return {
        "n": n, "range_lo": float(y.min()) - deviation, "range_hi": float(y.max()) + deviation,
        "components": [dict(zip(("frequency", "amplitude", "phase", "snr"), c, strict=True)) for c in found],
        "periodic_lo": float(periodic.min()) - noise, "periodic_hi": float(periodic.max()) + noise,
        "trend": {"trend_type": kind, **dict(zip("abc", map(float, params), strict=True)), "bic": bic, "residual_std": trend_std},
        "shocks": [dict(zip(("onset_idx", "shape", "magnitude", "decay_rate", "aic"), s, strict=True)) for s in jolts],
        "local": {"order": len(coef), "coefficients": coef, "intercept": intercept, "aic": aic, "residual_std": innovation, "window_size": used},
        "recent": r[-max(len(coef), 1) :].tolist(), "residual_ac1": ac1, "residual_mode": mode, "wavelet": model, "wavelet_ahead": ahead,
        "layer_variance": [float(x.var()) for x in layers], "residual": last.tolist(), "noise_std": float(last.std()), "q_lo": float(np.quantile(last, alpha)), "q_hi": float(np.quantile(last, 1 - alpha)),
    }


def ahead(fit: dict, horizon: int, o: Options) -> np.ndarray:
    """The point forecast of one fit: what forecast() unfolds in columns, for callers that hold a single series."""
    n, h = fit["n"], np.arange(float(horizon))
    t = n + h
    periodic = np.zeros(horizon)
    for c in fit["components"]:
        sigma = 2 * (h + 1) / (n * np.sqrt(max(2 * c["snr"] / 3, 1e-10)))
        keep = np.exp(-0.5 * sigma**2) if o.amplitude_damping and c["snr"] > 0 else 1.0
        periodic += keep * c["amplitude"] * np.cos(2 * np.pi * c["frequency"] * t + c["phase"])
    g, end = fit["trend"], n - 1.0
    at = lambda x: K.trend_at(g["trend_type"], (g["a"], g["b"], g["c"]), x)
    trend = at(t)
    if g["trend_type"] in ("quadratic", "exponential"):
        halflife = o.trend_damping_halflife if o.trend_damping_halflife is not None else n * o.trend_damping_share
        fade = np.exp2(-(t - end) / max(halflife, 1.0))
        edge = at(np.array([end, end + 0.5, end - 0.5]))
        trend = fade * trend + (1 - fade) * (edge[0] + (edge[1] - edge[2]) * (t - end))
    shock = sum((K.shock_at(x["shape"], x["onset_idx"], x["magnitude"], x["decay_rate"], t) for x in fit["shocks"]), np.zeros(horizon))
    local, wave = fit["local"], np.zeros(horizon)
    rest = K.ar_ahead(np.array(fit["recent"]), np.array([local["intercept"], *local["coefficients"]]), horizon) * np.exp2(-h / max(2.0 * local["order"], 4.0))
    if fit["wavelet"]:
        parts = [np.array(c["coefficients"]) for c in fit["wavelet"]["components"]]
        wave = K.wavelet_ahead(parts, n, horizon) * np.exp2(-h / max(n / 8, 16.0))
    total = np.clip(periodic, fit["periodic_lo"], fit["periodic_hi"]) + trend + shock + rest + wave
    return np.clip(total, fit["range_lo"], fit["range_hi"])


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind.simpleString()]


def per_window(df: DataFrame, columns: list[str], added: str, make) -> DataFrame:
    """df with the fields `added` that make(*values of columns) gives as a dict for each row."""
    new = T.StructType.fromDDL(added) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(added)
    schema = T.StructType([*df.schema.fields, *new.fields])
    at = [df.columns.index(c) for c in columns]
    kinds = [(f.name, arrow_type(f.dataType)) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [make(*values) for values in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[name] for r in rows], kind) for name, kind in kinds)], schema.names)

    return df.mapInArrow(run, schema)


def fit(windows: DataFrame, horizon: int | str, options: Options | None = None) -> DataFrame:
    """Windows (with an array `y`) and their fit; horizon is a number or the name of a column."""
    o = options or Options()
    df = windows if isinstance(horizon, str) else windows.withColumn("horizon", F.lit(horizon))
    return per_window(df, ["y", horizon if isinstance(horizon, str) else "horizon"], FIT_FIELDS, lambda y, h: fit_window(np.asarray(y, float), h, o))


def layers(fits: DataFrame, keys: list[str], options: Options | None = None) -> DataFrame:
    """(keys, h, periodic, trend, shock, local, wavelet, ...) for each step ahead, h from 0."""
    o = options or Options()
    n = F.col("n")
    order = F.col("local")["order"]
    flat = F.array_repeat(F.col("local")["intercept"], F.col("horizon"))
    folded = E.ar_ahead(F.reverse("recent"), F.col("local")["coefficients"], F.col("local")["intercept"], F.col("horizon"))
    ready = fits.where("horizon > 0").withColumn("local_ahead", F.when(order == 0, flat).otherwise(folded))
    rows = ready.select("*", F.explode(F.sequence(F.lit(0), F.col("horizon") - 1)).alias("h"))
    t = (n + F.col("h")).cast("double")

    def component(s: Column, c: Column) -> Column:
        value = c["amplitude"] * F.cos(2.0 * np.pi * c["frequency"] * t + c["phase"])
        return s + (value * E.amplitude_damping(F.col("h") + 1.0, n, c["snr"]) if o.amplitude_damping else value)

    periodic = F.aggregate("components", F.lit(0.0), component)
    halflife = F.lit(float(o.trend_damping_halflife)) if o.trend_damping_halflife is not None else n * o.trend_damping_share
    g = F.col("trend")
    shock = F.aggregate("shocks", F.lit(0.0), lambda s, x: s + E.shock_value(x["shape"], x["onset_idx"], x["magnitude"], x["decay_rate"], t))
    return rows.select(
        *keys, "h", "n", "range_lo", "range_hi", "q_lo", "q_hi",
        F.least(F.greatest(periodic, F.col("periodic_lo")), F.col("periodic_hi")).alias("periodic"),
        E.damped_trend(g["trend_type"], g["a"], g["b"], g["c"], t, (n - 1).cast("double"), halflife).alias("trend"),
        shock.alias("shock"),
        (F.get("local_ahead", F.col("h")) * E.horizon_decay(F.col("h"), F.greatest(order * 2.0, F.lit(4.0)))).alias("local"),
        (F.coalesce(F.get("wavelet_ahead", F.col("h")), F.lit(0.0)) * E.horizon_decay(F.col("h"), F.greatest(n / 8.0, F.lit(16.0)))).alias("wavelet"),
    )


def forecast(fits: DataFrame, keys: list[str], options: Options | None = None) -> DataFrame:
    """(keys, h, point, lower, upper)."""
    parts = layers(fits, keys, options)
    total = F.col("periodic") + F.col("trend") + F.col("shock") + F.col("local") + F.col("wavelet")
    point = F.least(F.greatest(total, F.col("range_lo")), F.col("range_hi"))
    growth = F.sqrt(1 + F.col("h") / F.col("n"))
    return parts.withColumn("point", point).select(*keys, "h", "point", (F.col("point") + F.col("q_lo") * growth).alias("lower"), (F.col("point") + F.col("q_hi") * growth).alias("upper"))


def describe(fits: DataFrame, keys: list[str], options: Options | None = None) -> DataFrame:
    """(keys, description): each fit as text."""
    g, local = F.col("trend"), F.col("local")
    mean = F.aggregate("residual", F.lit(0.0), lambda s, x: s + x) / F.size("residual")
    each = F.transform("components", lambda c: F.format_string("  freq=%.6f amp=%.4f phase=%.4f snr=%.1f", c["frequency"], c["amplitude"], c["phase"], c["snr"]))
    shocks = F.transform("shocks", lambda s: F.format_string("  %s at t=%d mag=%.4f", s["shape"], s["onset_idx"], s["magnitude"]))
    w = F.col("wavelet")
    scales = F.transform(w["components"], lambda c: F.format_string("  level %d %s: %.2f%% of the energy", c["level"], c["kind"], 100 * c["energy_fraction"]))
    wavelet = F.when(w.isNull(), F.array(F.lit("Wavelet: none"))).otherwise(F.concat(F.array(F.format_string("Wavelet: %s, %d levels", w["wavelet_name"], w["n_levels"])), scales))
    lines = F.concat(
        F.array(F.format_string("Periodic components: %d", F.size("components"))), each,
        F.array(F.format_string("Trend: %s a=%.6g b=%.6g c=%.6g", g["trend_type"], g["a"], g["b"], g["c"]), F.format_string("Shocks: %d", F.size("shocks"))), shocks,
        F.array(F.format_string("Local: AR(%d) intercept=%.6g", local["order"], local["intercept"]), F.format_string("Residual: mode=%s AC(1)=%.4f mean=%.6g std=%.6g", "residual_mode", "residual_ac1", mean, "noise_std")),
        wavelet, F.array(F.format_string("Bounds: %.0f%% of the residuals lie in [%.4g, %.4g]; range [%.6g, %.6g]", 100 * F.lit((options or Options()).confidence_level), "q_lo", "q_hi", "range_lo", "range_hi")),
    )
    return fits.select(*keys, F.concat_ws("\n", lines).alias("description"))
