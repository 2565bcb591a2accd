"""Weighted trends over long windows by moments, and their choice by BIC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import bic, recency_weight
from ..sources.scratch import stored


def weighted_trends(rows: DataFrame, keys: Sequence[str], n: int, halflife: float | None = None, at: str = "i", value: str = "y") -> DataFrame:
    """(keys, trend_type, ord, a, b, c, rss, bic) for none, linear and quadratic.

    Recency weights add up to n. The moments are taken over the place scaled to [-1, 1], which keeps the
    3x3 system well conditioned; residuals come from a second pass, not from differences of moments.
    """
    norm = sum(2.0 ** (-(n - 1 - t) / max(halflife or n / 2, 1.0)) for t in range(n)) / n
    half = max((n - 1) / 2.0, 0.5)
    u = F.col(at) / half - 1.0
    w = recency_weight(F.lit(n), F.col(at), F.lit(float(halflife or n / 2))) / norm
    rows = rows.select(*keys, u.alias("u"), w.alias("w"), F.col(value).alias("y"))
    moments = [F.sum(F.col("w") * F.pow("u", F.lit(k))).alias(f"s{k}") for k in range(1, 5)]
    m = rows.groupBy(*keys).agg(F.sum("w").alias("s0"), *moments, *[F.sum(F.col("w") * F.pow("u", F.lit(k)) * F.col("y")).alias(f"m{k}") for k in range(3)])
    s, v = [F.col(f"s{k}") for k in range(5)], [F.col(f"m{k}") for k in range(3)]

    def det(x: list[list[Column]]) -> Column:
        return x[0][0] * (x[1][1] * x[2][2] - x[1][2] * x[2][1]) - x[0][1] * (x[1][0] * x[2][2] - x[1][2] * x[2][0]) + x[0][2] * (x[1][0] * x[2][1] - x[1][1] * x[2][0])

    cube = [[s[0], s[1], s[2]], [s[1], s[2], s[3]], [s[2], s[3], s[4]]]
    flat = s[0] * s[2] - s[1] * s[1]
    fits = m.select(
        *keys, (v[0] / s[0]).alias("level"), ((s[0] * v[1] - s[1] * v[0]) / flat).alias("l1"), ((s[2] * v[0] - s[1] * v[1]) / flat).alias("l0"),
        *[(det([[v[r] if c == k else cube[r][c] for c in range(3)] for r in range(3)]) / det(cube)).alias(f"q{k}") for k in range(3)],
    )
    joined = rows.join(fits, list(keys))
    y, w, u = F.col("y"), F.col("w"), F.col("u")
    rss = joined.groupBy(*keys, "level", "l0", "l1", "q0", "q1", "q2").agg(
        F.sum(w * F.pow(y - F.col("level"), F.lit(2))).alias("r0"), F.sum(w * F.pow(y - F.col("l0") - F.col("l1") * u, F.lit(2))).alias("r1"), F.sum(w * F.pow(y - F.col("q0") - F.col("q1") * u - F.col("q2") * u * u, F.lit(2))).alias("r2")
    )
    q0, q1, q2, size, zero = F.col("q0"), F.col("q1"), F.col("q2"), F.lit(float(n)), F.lit(0.0)
    options = F.array(
        F.struct(F.lit("none").alias("trend_type"), F.lit(0).alias("ord"), zero.alias("a"), zero.alias("b"), zero.alias("c"), F.col("r0").alias("rss"), bic(size, 1, F.col("r0")).alias("bic")),
        F.struct(F.lit("linear").alias("trend_type"), F.lit(1).alias("ord"), (F.col("l1") / half).alias("a"), (F.col("l0") - F.col("l1")).alias("b"), zero.alias("c"), F.col("r1").alias("rss"), bic(size, 2, F.col("r1")).alias("bic")),
        F.struct(F.lit("quadratic").alias("trend_type"), F.lit(2).alias("ord"), (q2 / half**2).alias("a"), ((q1 - 2 * q2) / half).alias("b"), (q0 - q1 + q2).alias("c"), F.col("r2").alias("rss"), bic(size, 3, F.col("r2")).alias("bic")),
    )
    return rss.select(*keys, F.inline(options))


#: Rates of the exponential over the whole of a series: the first grid, the places of each later one, and rounds.
RATES, FIRST_STEP, LATER, ROUNDS = 41, 0.5, 101, 3


def rates_beside(step: float) -> Column:
    places = F.sequence(F.lit(-(LATER // 2)), F.lit(LATER // 2))
    return F.transform(places, lambda k: F.least(F.greatest(F.col("rate") + k * F.lit(step), F.lit(-10.0)), F.lit(10.0)))


def exponential_trend(rows: DataFrame, keys: Sequence[str], n: int, halflife: float | None = None, at: str = "i", value: str = "y") -> DataFrame:
    """(keys, trend_type, ord, a, b, c, rss, bic) of the weighted exponential a * exp(b * t) + c.

    For a given rate the rest is a line in (exp(b * x) - 1) / b, so a grid of rates needs one pass of weighted sums; each round
    lays a finer grid around the best rate, of equally good ones the one nearest to zero. Rates are within 10 over the whole series.
    """
    keys, scale = list(keys), max(n - 1.0, 1.0)
    norm = sum(2.0 ** (-(n - 1 - t) / max(halflife or n / 2, 1.0)) for t in range(n)) / n
    w = recency_weight(F.lit(n), F.col(at), F.lit(float(halflife or n / 2))) / norm
    x = rows.select(*keys, (F.col(at) / scale).alias("x"), w.alias("w"), F.col(value).cast("double").alias("y"))
    middle = x.groupBy(*keys).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("middle"))
    x = stored(x.join(middle, keys).withColumn("d", F.col("y") - F.col("middle")), "trend-rows")
    rate, step = F.col("rate"), FIRST_STEP
    curve = F.when(F.abs(rate) > 1e-9, F.expm1(rate * F.col("x")) / F.when(F.abs(rate) > 1e-9, rate)).otherwise(F.col("x"))

    def sums(rated: DataFrame) -> DataFrame:
        g, u, d = F.col("g"), F.col("w"), F.col("d")
        each = rated.withColumn("g", curve).groupBy(*keys, "rate").agg(F.sum(u).alias("s"), F.sum(u * g).alias("g1"), F.sum(u * g * g).alias("g2"), F.sum(u * d).alias("d1"), F.sum(u * d * d).alias("d2"), F.sum(u * g * d).alias("gd"))
        var, cov = F.col("g2") - F.col("g1") * F.col("g1") / F.col("s"), F.col("gd") - F.col("g1") * F.col("d1") / F.col("s")
        slope = F.when(var > 0, cov / F.when(var > 0, var)).otherwise(0.0)
        left = F.col("d2") - F.col("d1") * F.col("d1") / F.col("s") - slope * cov
        return each.select(*keys, "rate", slope.alias("slope"), ((F.col("d1") - slope * F.col("g1")) / F.col("s")).alias("level"), left.alias("left"))

    def least(found: DataFrame) -> DataFrame:
        best = found.groupBy(*keys).agg(F.min(F.struct("left", F.abs("rate").alias("size"), "rate", "slope", "level")).alias("x"))
        return stored(best.select(*keys, "x.rate", "x.slope", "x.level"), "trend-rates")

    first = F.transform(F.sequence(F.lit(0), F.lit(RATES - 1)), lambda k: k * FIRST_STEP - (RATES // 2) * FIRST_STEP)
    best = least(sums(x.withColumn("rate", F.explode(first))))
    for _ in range(ROUNDS - 1):
        step = step / (LATER // 2)
        near = rates_beside(step)
        best = least(sums(x.join(best.select(*keys, F.array_distinct(near).alias("rates")), keys).withColumn("rate", F.explode("rates"))))
    # the residual comes from a second pass, not from differences of sums
    fitted = x.join(best, keys)
    miss = F.col("d") - F.col("level") - F.col("slope") * curve
    rss = fitted.groupBy(*keys, "middle", "rate", "slope", "level").agg(F.sum(F.col("w") * miss * miss).alias("rss"))
    b = F.when(F.abs(rate) > 1e-9, rate).otherwise(1e-9)
    a, size = F.col("slope") / b, F.lit(float(n))
    return rss.select(*keys, F.lit("exponential").alias("trend_type"), F.lit(3).alias("ord"), a.alias("a"), (b / scale).alias("b"), (F.col("middle") + F.col("level") - a).alias("c"), "rss", bic(size, 3, F.col("rss")).alias("bic"))


def best_trend(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The candidate with the least BIC, of equals the simplest."""
    best = candidates.groupBy(*keys).agg(F.min(F.struct("bic", "ord", "trend_type", "a", "b", "c", "rss")).alias("best"))
    return best.select(*keys, "best.trend_type", "best.a", "best.b", "best.c", "best.bic", "best.rss")
