"""The decomposition as a chain of operators over long rows: sums, joins and folds in the JVM, one written table a layer.

Gives the columns of decompose.fit(), so decompose.forecast() and describe() follow it. It makes many rounds, so it pays for
windows too long or too many-layered for one Arrow batch; decompose.fit() is quicker for short ones. Only the wavelet of
the last residual, a short filter bank, goes through a kernel, window by window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import kernels as K
from ..operators import autoregression, shocks, sinusoids, statistics, trend
from ..sources.scratch import stored
from .decompose import AC1_GATE, Options, per_window

LOCAL, ORDERS = 256, 12


def in_order(rows: DataFrame, keys: Sequence[str], at: str, value: Column, out: str) -> DataFrame:
    """One array of a value for each group, by place."""
    each = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), value.alias("x"))))
    return rows.groupBy(*keys).agg(F.transform(each, lambda r: r["x"]).alias(out))


def local_model(rest: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, local): the autoregression of least AIC over the last LOCAL residuals, recent ones weighing more."""
    size = min(LOCAL, n)
    rows = rest.where(F.col("i") >= n - size).withColumn("i", F.col("i") - (n - size))
    cov = stored(statistics.weighted_autocovariance(rows, keys, size, min(ORDERS, size // 4), size / 3, value="r"), "local-covariances")
    w = E.recency_weight(F.lit(size), F.col("i"), F.lit(size / 3))
    mean = rows.groupBy(*keys).agg((F.sum(w * F.col("r")) / F.sum(w)).alias("mean"))
    zero = cov.where("lag = 0").select(*keys, F.lit(0).alias("p"), F.array().cast("array<double>").alias("coef"), F.col("cov").alias("variance"))
    orders = statistics.levinson(cov, keys).unionByName(zero).withColumn("aic", E.ar_aic(F.lit(float(size)), F.col("p"), F.col("variance")))
    best = orders.groupBy(*keys).agg(F.min(F.struct("aic", "p", "coef", "variance")).alias("b")).join(mean, list(keys))
    total = F.aggregate(F.col("b.coef"), F.lit(0.0), lambda s, a: s + a)
    local = F.struct(F.col("b.p").alias("order"), F.col("b.coef").alias("coefficients"), (F.col("mean") * (1 - total)).alias("intercept"), F.col("b.aic").alias("aic"), F.sqrt(F.greatest("b.variance", F.lit(0.0))).alias("residual_std"), F.lit(size).alias("window_size"))
    return best.select(*keys, local.alias("local"))


def fit(rows: DataFrame, keys: Sequence[str], n: int, horizon: int, options: Options | None = None) -> DataFrame:
    """rows: (keys, i, y), n places from 0 in every group. One row for each group, as decompose.fit() gives."""
    o, keys = options or Options(), list(keys)
    lined = stored(statistics.detrend(rows.select(*keys, "i", "y"), keys, "i"), "native-line")
    found, left = sinusoids.extract(lined, keys, "i", "rest", o.max_components, o.min_snr, o.noise_threshold_ratio)
    components = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "frequency", "amplitude", "phase", "snr"))), lambda c: F.struct(*[c[x].alias(x) for x in ("frequency", "amplitude", "phase", "snr")])).alias("components"))
    # what the sinusoids leave, and they themselves, at every place
    parts = stored(lined.join(left.withColumnRenamed("t", "i").withColumnRenamed("rest", "left"), [*keys, "i"]).withColumn("periodic", F.col("rest") - F.col("left")).withColumn("z", F.col("left") + F.col("y") - F.col("rest")), "native-periodic")
    four = trend.weighted_trends(parts, keys, n, o.recency_halflife, "i", "z").unionByName(trend.exponential_trend(parts, keys, n, o.recency_halflife, "i", "z"))
    best = stored(trend.best_trend(four, keys).withColumn("trend_std", F.sqrt(F.greatest("rss", F.lit(0.0)) / n)), "native-trend")
    stats = parts.groupBy(*keys).agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.stddev_pop("y").alias("sd"), F.stddev_pop("left").alias("noise"), F.min("periodic").alias("p_lo"), F.max("periodic").alias("p_hi"), F.var_pop("periodic").alias("v1"))
    # sums of sinusoids that cancel to rounding error are none
    level = E.trend_value(F.col("trend_type"), F.col("a"), F.col("b"), F.col("c"), F.col("i").cast("double"))
    bare = parts.join(best, keys).join(stats.select(*keys, "noise"), keys).withColumn("trend_at", level).withColumn("scale", F.greatest("noise", "trend_std"))
    bare = stored(bare.select(*keys, "i", "y", "periodic", "trend_at", "scale", (F.col("y") - F.col("periodic") - F.col("trend_at")).alias("delta")), "native-delta")
    jolts, rest = shocks.shock_passes(bare, keys, "scale", o.shock_min_sigma, o.shock_lookback or max(n // 4, 20), "i", "delta")
    each = F.transform(F.array_sort(F.collect_list(F.struct("rank", "onset", "shape", "magnitude", "rate", "aic"))), lambda s: F.struct(s["onset"].cast("int").alias("onset_idx"), s["shape"].alias("shape"), s["magnitude"].alias("magnitude"), s["rate"].alias("decay_rate"), s["aic"].alias("aic")))
    shocked = jolts.groupBy(*keys).agg(each.alias("shocks"))
    rest = stored(rest.select(*keys, "i", F.col("delta").alias("r")), "native-rest")
    ac1 = statistics.lag1(rest, keys, "i", "r").withColumnRenamed("ac1", "residual_ac1")
    local = stored(local_model(rest, keys, n), "native-local")
    latest = autoregression.with_latest(rest, keys, ORDERS, "i", "r").join(local, keys)
    model = F.concat(F.array(F.col("local.intercept")), F.col("local.coefficients"))
    one_step = F.coalesce(autoregression.one_step(model, F.slice("latest", F.lit(2), F.lit(ORDERS))), F.lit(0.0))
    arrays = in_order(latest.select(*keys, "i", "r", (F.col("r") - one_step).alias("last")), keys, "i", F.struct("r", "last"), "rows")
    arrays = arrays.select(*keys, F.transform("rows", lambda x: x["r"]).alias("r"), F.transform("rows", lambda x: x["last"]).alias("last"))

    def waves(last: list[float], ac: float) -> dict:
        x = np.array(last)
        if abs(ac) < AC1_GATE:
            return {"residual": last, "wavelet_ahead": [], "wavelet": None, "wave_variance": 0.0}
        scales, shares, layer = K.wavelet(x)
        levels = len(scales) - 1
        parts = [{"level": levels - max(i - 1, 0), "kind": "detail" if i else "approximation", "energy_fraction": s, "coefficients": p.tolist()} for i, (p, s) in enumerate(zip(scales, shares, strict=True))]
        whole = {"wavelet_name": "db4", "n_levels": levels, "original_length": len(x), "residual_std": float((x - layer).std()), "components": parts}
        return {"residual": (x - layer).tolist(), "wavelet_ahead": K.wavelet_ahead(scales, len(x), horizon).tolist(), "wavelet": whole, "wave_variance": float(layer.var())}

    kind = "residual array<double>, wavelet_ahead array<double>, wave_variance double, wavelet struct<wavelet_name:string,n_levels:int,original_length:int,residual_std:double,components:array<struct<level:int,kind:string,energy_fraction:double,coefficients:array<double>>>>"
    done = stored(per_window(arrays.join(ac1, keys), ["last", "residual_ac1"], kind, waves), "native-waves")
    alpha = (1 - o.confidence_level) / 2
    bounds = done.select(*keys, F.explode("residual").alias("x")).groupBy(*keys).agg(F.stddev_pop("x").alias("noise_std"), F.percentile("x", alpha).alias("q_lo"), F.percentile("x", 1 - alpha).alias("q_hi"), F.var_pop("x").alias("v6"))
    variances = bare.join(rest, [*keys, "i"]).groupBy(*keys).agg(F.var_pop("trend_at").alias("v2"), F.var_pop(F.col("delta") - F.col("r")).alias("v3"))
    fitted = done.select(*keys, F.explode(F.zip_with("r", "last", lambda a, b: a - b)).alias("x")).groupBy(*keys).agg(F.var_pop("x").alias("v4"))
    out = stats.join(best, keys).join(components, keys, "left").join(shocked, keys, "left").join(local, keys).join(done, keys).join(bounds, keys).join(variances, keys).join(fitted, keys)
    some = F.array().cast(f"array<{components.schema['components'].dataType.elementType.simpleString()}>")
    none = F.array().cast(f"array<{shocked.schema['shocks'].dataType.elementType.simpleString()}>")
    recent = F.greatest(F.col("local.order"), F.lit(1))
    return out.select(
        *keys, F.lit(horizon).alias("horizon"), F.lit(n).alias("n"), (F.col("lo") - F.col("sd")).alias("range_lo"), (F.col("hi") + F.col("sd")).alias("range_hi"), F.coalesce("components", some).alias("components"),
        (F.col("p_lo") - F.col("noise")).alias("periodic_lo"), (F.col("p_hi") + F.col("noise")).alias("periodic_hi"),
        F.struct("trend_type", "a", "b", "c", "bic", F.col("trend_std").alias("residual_std")).alias("trend"), F.coalesce("shocks", none).alias("shocks"), "local", F.slice("r", n + 1 - recent, recent).alias("recent"), "residual_ac1",
        F.when(F.col("wavelet").isNull(), "ar").otherwise("wavelet+ar").alias("residual_mode"), "wavelet", "wavelet_ahead", F.array(F.pow("sd", F.lit(2)), "v1", "v2", "v3", "v4", "wave_variance", "v6").alias("layer_variance"), "residual", "noise_std", "q_lo", "q_hi",
    )
