"""Aggregates over long windows or series; every one combines on the map side before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import recency_weight
from ..sources.scratch import stored
from .quantiles import exact_quantiles


def detrend(rows: DataFrame, keys: Sequence[str], at: str = "t", value: str = "y") -> DataFrame:
    """Rows with slope, intercept and `rest`, the value less its least-squares line over `at`."""
    line = rows.groupBy(*keys).agg(F.regr_slope(value, at).alias("slope"), F.regr_intercept(value, at).alias("intercept"))
    joined = rows.join(line, list(keys))
    return joined.withColumn("rest", F.col(value) - (F.col("slope") * F.col(at) + F.col("intercept")))


def lag1(rows: DataFrame, keys: Sequence[str], at: str = "t", value: str = "y") -> DataFrame:
    """Correlation of neighbours; 0 where there are none or they do not vary."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(at))
    stats = rows.withColumn("before", before).groupBy(*keys).agg(F.corr(value, "before").alias("r"), F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).alias("n"))
    return stats.select(*keys, F.when((F.col("n") > 1) & (F.col("sd") > 1e-10), F.col("r")).otherwise(F.lit(0.0)).alias("ac1"))


def quantile_bounds(rows: DataFrame, keys: Sequence[str], value: str, level: float = 0.8) -> DataFrame:
    """Exact interpolated quantiles that hold the middle `level` of the values, and their deviation."""
    alpha = (1 - level) / 2
    return rows.groupBy(*keys).agg(F.percentile(value, alpha).alias("q_lo"), F.percentile(value, 1 - alpha).alias("q_hi"), F.stddev_pop(value).alias("noise_std"))


def ewma_last(rows: DataFrame, keys: Sequence[str], value: str, at: str = "t", alpha: float = 0.1) -> DataFrame:
    """(keys, ewma): the exponentially weighted mean of absolute values, from 0, at the end of rows without gaps in `at`.

    Unrolled, each row weighs by how far it is from the end, so the sum combines on the map side.
    """
    end = rows.groupBy(*keys).agg(F.max(at).alias("end"))
    weight = F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("end") - F.col(at))
    return rows.join(end, list(keys)).groupBy(*keys).agg(F.sum(weight * F.abs(F.col(value))).alias("ewma"))


def robust_noise(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, median absolute deviation (or 0.6745 deviations where that vanishes), excess kurtosis floored at 0.

    The medians are exact and need no group in one task; `rows` is stored for that.
    """
    x = stored(rows.select(*keys, F.col(value).cast("double").alias("x")), "noise")
    spread = x.groupBy(*keys).agg(F.stddev_pop("x").alias("sd"), F.kurtosis("x").alias("kurt"))
    middle = stored(exact_quantiles(x, keys, "x", {"middle": 0.5}), "medians")
    away = x.join(middle, list(keys)).select(*keys, F.abs(F.col("x") - F.col("middle")).alias("away"))
    mad = spread.join(middle, list(keys)).join(exact_quantiles(away, keys, "away", {"mad": 0.5}), list(keys))
    return mad.select(*keys, "middle", F.when(F.col("mad") < 1e-10, F.col("sd") * 0.6745).otherwise(F.col("mad")).alias("mad"), F.greatest(F.coalesce("kurt", F.lit(0.0)), F.lit(0.0)).alias("excess_kurtosis"))


def weighted_autocovariance(rows: DataFrame, keys: Sequence[str], n: int, max_lag: int, halflife: float, at: str = "i", value: str = "y") -> DataFrame:
    """(keys, lag, cov): each product weighs as its later member."""
    w = rows.withColumn("w", recency_weight(F.lit(n), F.col(at), F.lit(halflife)))
    mean = w.groupBy(*keys).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("wmean"))
    in_order = Window.partitionBy(*keys).orderBy(at)
    c = w.join(mean, list(keys)).withColumn("c", F.col(value) - F.col("wmean"))
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("c") * F.lag("c", k).over(in_order)).alias("p")) for k in range(max_lag + 1)])
    each = c.withColumn("lags", lags).select(*keys, "w", F.explode("lags").alias("x")).where("x.p is not null")
    return each.groupBy(*keys, F.col("x.lag").alias("lag")).agg((F.sum(F.col("w") * F.col("x.p")) / F.sum("w")).alias("cov"))


def autocovariance(rows: DataFrame, keys: Sequence[str], max_lag: int, at: str = "i", value: str = "y") -> DataFrame:
    """(keys, lag, cov): sums of products of centred values over all n, so that long lags shrink."""
    by = Window.partitionBy(*keys)
    c = rows.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("c", F.col(value) - F.avg(value).over(by))
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("c") * F.lag("c", k).over(by.orderBy(at))).alias("p")) for k in range(max_lag + 1)])
    each = c.withColumn("lags", lags).select(*keys, "n", F.explode("lags").alias("x")).where("x.p is not null")
    return each.groupBy(*keys, "n", F.col("x.lag").alias("lag")).agg(F.sum("x.p").alias("s")).select(*keys, "lag", (F.col("s") / F.col("n")).alias("cov"))


def levinson(autocovariance: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, p, coef, variance) of the AR model of each order, by the Levinson-Durbin recursion as a fold."""
    r = autocovariance.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "cov"))), lambda x: x["cov"]).alias("r"))
    start = F.struct(F.array().cast("array<double>").alias("a"), F.element_at("r", 1).alias("v"), F.array().cast("array<struct<p:int,coef:array<double>,variance:double>>").alias("out"))

    def step(s, p):
        matched = F.zip_with(s["a"], F.reverse(F.slice(F.col("r"), 2, F.size(s["a"]))), lambda a, c: a * c)
        k = (F.element_at(F.col("r"), p + 1) - F.aggregate(matched, F.lit(0.0), lambda t, x: t + x)) / s["v"]
        a = F.concat(F.zip_with(s["a"], F.reverse(s["a"]), lambda x, y: x - k * y), F.array(k))
        v = s["v"] * (1 - k * k)
        return F.struct(a.alias("a"), v.alias("v"), F.concat(s["out"], F.array(F.struct(p.alias("p"), a.alias("coef"), F.greatest(v, F.lit(1e-30)).alias("variance")))).alias("out"))

    folded = F.aggregate(F.sequence(F.lit(1), F.size("r") - 1), start, step)
    return r.where((F.size("r") > 1) & (F.element_at("r", 1) > 0)).select(*keys, F.inline(folded["out"]))


def metrics(rows: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Pooled mse, mae, mape (a fraction, over actual values that are not 0; infinity if none), rmse, n."""
    e = F.col(actual) - F.col(predicted)
    share = F.when(F.abs(F.col(actual)) > 1e-10, F.abs(e / F.when(F.abs(F.col(actual)) > 1e-10, F.col(actual))))
    out = rows.groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.coalesce(F.avg(share), F.lit(float("inf"))).alias("mape"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("rmse", F.sqrt("mse"))
