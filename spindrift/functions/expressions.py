"""Column expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)


def bic(n: Column, k: int, rss: Column) -> Column:
    """Bayesian information criterion; a perfect fit is far below any other."""
    return F.when(rss > 0, n * F.log(rss / n) + k * F.log(n)).otherwise(-1e15 + k * F.log(F.greatest(n, F.lit(2))))


def aic(n: Column, k: int, rss: Column) -> Column:
    return F.when(rss > 0, n * F.log(rss / n) + 2.0 * k).otherwise(F.lit(-1e15 + 2.0 * k))


def ar_aic(n: Column, p: Column | int, variance: Column) -> Column:
    p = F.lit(p) if isinstance(p, int) else p
    return F.when((variance > 0) & (n > 0), n * F.log(variance) + 2.0 * (p + 1)).otherwise(F.lit(float("inf")))


def recency_weight(n: Column, t: Column, halflife: Column) -> Column:
    """Not yet normalised: 1 at the end of n rows, half of it `halflife` rows before."""
    return F.exp(-LN2 / F.greatest(halflife, F.lit(1.0)) * (n - 1 - t))


def horizon_decay(h: Column, halflife: Column) -> Column:
    return F.pow(F.lit(2.0), -h / halflife)


def amplitude_damping(h: Column, n: Column, snr: Column) -> Column:
    """What phase uncertainty leaves of a component h steps ahead, h from 1."""
    sigma = 2.0 * h / (n * F.sqrt(F.greatest(2.0 * snr / 3.0, F.lit(1e-10))))
    return F.when(snr > 0, F.exp(-0.5 * sigma * sigma)).otherwise(F.lit(1.0))


def trend_value(kind: Column, a: Column, b: Column, c: Column, t: Column) -> Column:
    return F.when(kind == "linear", a * t + b).when(kind == "quadratic", a * t * t + b * t + c).when(kind == "exponential", a * F.exp(b * t) + c).otherwise(F.lit(0.0))


def damped_trend(kind: Column, a: Column, b: Column, c: Column, t: Column, end: Column, halflife: Column) -> Column:
    """The trend beyond `end`: curved ones fade into their tangent there."""

    def at(x: Column) -> Column:
        return trend_value(kind, a, b, c, x)

    tangent = at(end) + (at(end + 0.5) - at(end - 0.5)) * (t - end)
    fade = F.exp(-LN2 / F.greatest(halflife, F.lit(1.0)) * F.greatest(t - end, F.lit(0.0)))
    return F.when(kind.isin("quadratic", "exponential"), fade * at(t) + (1 - fade) * tangent).otherwise(at(t))


def shock_value(shape: Column, onset: Column, magnitude: Column, rate: Column, t: Column) -> Column:
    dt = t - onset
    body = F.when(shape == "spike_decay", magnitude * F.exp(-rate * dt)).when(shape == "ramp", magnitude + rate * dt).otherwise(magnitude)
    return F.when(dt >= 0, body).otherwise(F.lit(0.0))


def ar_ahead(latest_first: Column, coef: Column, intercept: Column, horizon: Column) -> Column:
    """Array of `horizon` recursive AR values after the given ones, by a fold over the horizon."""

    def step(values: Column, _: Column) -> Column:
        lagged = F.zip_with(coef, F.slice(values, 1, F.size(coef)), lambda a, x: a * F.coalesce(x, F.lit(0.0)))
        return F.concat(F.array(intercept + F.aggregate(lagged, F.lit(0.0), lambda s, x: s + x)), values)

    folded = F.aggregate(F.sequence(F.lit(1), horizon), latest_first.cast("array<double>"), step)
    return F.reverse(F.slice(folded, 1, horizon))


def confidence(mse: Column, variance: Column, errors: Column) -> Column:
    """Squared exp(-mse/variance); a low prior where fewer than three errors are known."""
    raw = F.exp(-mse / F.greatest(variance, F.lit(1e-10)))
    return F.when(errors < 3, F.lit(0.25)).otherwise(raw * raw)


def ewma(values: Column, start: Column, alpha: float = 0.1) -> Column:
    """Exponentially weighted mean of the absolute values of an ordered array."""
    return F.aggregate(values, start, lambda e, x: alpha * F.abs(x) + (1 - alpha) * e)
