"""Registered queries: each reads the given tables and applies one operator or plan to all of its series."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import kernels as K
from ..operators import autoregression, seasonal, shocks, sinusoids, spectrum, statistics, trend, wavelet
from ..operators import windows as W
from ..sources import csv_files
from ..sources import series as S
from ..sources.scratch import new_path, stored
from ..streaming import buckets, engine, observe
from ..streaming import ensemble as streaming
from . import backtest, decompose, native, table_function, workers

C, H = 512, 96
KEY = W.KEY
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """The named columns rounded, with negative zeros as zeros."""
    return df.select(*[(F.round(c, places[c]) + F.lit(0.0)).alias(c) if c in places else F.col(c) for c in df.columns])


def windows(series: DataFrame) -> DataFrame:
    return W.rolling(series, C, H)


def context(series: DataFrame) -> DataFrame:
    return windows(series).where(F.col("i") < C)


def detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.detrend(context(S.hourly_events(spark, sf_dir)), KEY, "i")


def packed(spark: SparkSession, sf_dir: str, source: Callable = S.hourly_events) -> DataFrame:
    return W.packed(windows(source(spark, sf_dir)), C)


def kept(spark: SparkSession, sf_dir: str, source: Callable = S.hourly_events) -> DataFrame:
    """Packed windows as a table, for plans that read them once for each worker."""
    return stored(packed(spark, sf_dir, source), "windows")


def naive(p: DataFrame) -> DataFrame:
    return backtest.against_actual(workers.naive(p.select(*KEY, "y", F.lit(H).alias("horizon")), KEY), p)


def power_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = detrended(spark, sf_dir).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "rest"))), lambda x: x["rest"]).alias("y"))
    return spectrum.bins(rest, KEY)


def local_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 256 values of each context, numbered from 0."""
    return context(S.hourly_events(spark, sf_dir)).where(F.col("i") >= C - 256).withColumn("i", F.col("i") - (C - 256))


def ar1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keys, coef, intercept) of AR(1) by weighted Yule-Walker equations."""
    rows = local_rows(spark, sf_dir)
    cov = statistics.weighted_autocovariance(rows, KEY, 256, 1, 256 / 3)
    first = statistics.levinson(cov, KEY).where("p = 1").select(*KEY, F.element_at("coef", 1).alias("coef"))
    w = E.recency_weight(F.lit(256), F.col("i"), F.lit(256 / 3))
    mean = rows.groupBy(*KEY).agg((F.sum(w * F.col("y")) / F.sum(w)).alias("mean"))
    return first.join(mean, KEY).select(*KEY, "coef", (F.col("mean") * (1 - F.col("coef"))).alias("intercept"))


@registered
def hourly_series(spark, sf_dir):
    return rounded(S.hourly_events(spark, sf_dir), y=6)


@registered
def daily_series(spark, sf_dir):
    return rounded(S.daily_orders(spark, sf_dir), y=4)


@registered
def nation_series(spark, sf_dir):
    return rounded(S.daily_nation_orders(spark, sf_dir), y=4)


@registered
def forward_filled_series(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(S.from_events(events, F.col("event_type"), S.bucket_number(events, "ts", S.HOUR), F.col("value"), fill="forward"), y=6)


@registered
def embedding_series(spark, sf_dir):
    return S.embedding_series(spark, sf_dir)


@registered
def csv_round_trip(spark, sf_dir):
    path = new_path(spark, "series-csv")
    csv_files.write_series(S.daily_orders(spark, sf_dir), path)
    back = csv_files.read_column(spark, path, "y", order_by="ds", series="unique_id")
    return rounded(back.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.max("t").alias("last_t")), total=4)


@registered
def csv_modes(spark, sf_dir):
    """What each mode of reading makes of a column with every tenth cell not a number, of a clean one and of one that is not there."""
    path = new_path(spark, "modes-csv")
    daily = S.daily_orders(spark, sf_dir)
    cells = daily.select(F.col("series_id").alias("unique_id"), F.col("t").alias("ds"), F.col("t").alias("clean"), F.when(F.col("t") % 10 == 3, "n/a").otherwise(F.col("t").cast("string")).alias("mixed"))
    cells.write.option("header", True).csv(path)
    read = lambda column, mode: csv_files.read_column(spark, path, column, order_by="ds", series="unique_id", mode=mode)
    parts = {"checked mixed": read("mixed", "checked"), "tolerant mixed": read("mixed", "tolerant"), "tolerant missing": read("missing", "tolerant"), "strict clean": read("clean", "strict")}
    out = None
    for name, rows in parts.items():
        part = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("total"), F.coalesce(F.max("t"), F.lit(-1)).alias("last_t")).withColumn("part", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@registered
def first_series(spark, sf_dir):
    return rounded(csv_files.first_series(S.daily_orders(spark, sf_dir)), y=4)


@registered
def tail_context(spark, sf_dir):
    return rounded(W.tail(S.hourly_events(spark, sf_dir), 168), y=6)


@registered
def rolling_windows(spark, sf_dir):
    out = windows(S.hourly_events(spark, sf_dir)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.min("y").alias("low"), F.max("y").alias("high"))
    return rounded(out, total=4, low=6, high=6)


@registered
def split_counts(spark, sf_dir):
    series = S.daily_orders(spark, sf_dir)
    n = W.lengths(series)
    # the sum of the shares is taken in double precision, as split_ends() does
    part = F.when(F.col("t") < F.floor(F.col("n") * 0.6), "train").when(F.col("t") < F.floor(F.col("n") * (0.6 + 0.2)), "val").otherwise("test")
    return rounded(series.join(n, "series_id").groupBy("series_id", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")), mean=4)


@registered
def train_zscore(spark, sf_dir):
    return rounded(W.zscore(S.hourly_events(spark, sf_dir)), y=6)


@registered
def finite_counts(spark, sf_dir):
    return S.hourly_events(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(W.finite(F.col("y"))).alias("n_finite"), (F.count(F.lit(1)) >= 64).alias("long_enough"))


@registered
def range_clamp(spark, sf_dir):
    rows = windows(S.hourly_events(spark, sf_dir))
    seen = F.col("i") < C
    limits = rows.where(seen).groupBy(*KEY).agg((F.min("y") - F.stddev_pop("y")).alias("lo"), (F.max("y") + F.stddev_pop("y")).alias("hi"))
    after = rows.where(~seen).join(limits, KEY)
    held = W.clamp(F.col("y"), F.col("lo"), F.col("hi"))
    return rounded(after.groupBy(*KEY).agg(F.min(held).alias("low"), F.max(held).alias("high"), F.count_if((F.col("y") < F.col("lo")) | (F.col("y") > F.col("hi"))).alias("n_clamped")), low=6, high=6)


@registered
def ols_detrend(spark, sf_dir):
    rows = detrended(spark, sf_dir)
    return rounded(rows.groupBy(*KEY, "slope", "intercept").agg(F.sum(F.col("rest") * F.col("rest")).alias("rss")), slope=8, intercept=6, rss=3)


@registered
def lag1_autocorr(spark, sf_dir):
    return rounded(statistics.lag1(detrended(spark, sf_dir), KEY, "i", "rest"), ac1=8)


@registered
def residual_quantiles(spark, sf_dir):
    return rounded(statistics.quantile_bounds(detrended(spark, sf_dir), KEY, "rest"), q_lo=6, q_hi=6, noise_std=6)


@registered
def robust_noise(spark, sf_dir):
    steps = W.with_previous(S.hourly_events(spark, sf_dir)).withColumn("step", F.col("y") - F.col("before"))
    return rounded(statistics.robust_noise(steps, ["series_id"], "step"), middle=6, mad=6, excess_kurtosis=6)


@registered
def naive_backtest(spark, sf_dir):
    out = statistics.metrics(naive(packed(spark, sf_dir)), KEY).select(*KEY, "mse", "mae", "n")
    return rounded(out, mse=4, mae=6)


@registered
def forecast_metrics(spark, sf_dir):
    return rounded(statistics.metrics(naive(packed(spark, sf_dir)), ["series_id"]), mse=4, mae=6, mape=5, rmse=6)


@registered
def bounded_forecast(spark, sf_dir):
    """The line of each window continued, clamped to its range, with residual quantiles that widen with the horizon."""
    rest = detrended(spark, sf_dir)
    bounds = statistics.quantile_bounds(rest, KEY, "rest")
    line = rest.groupBy(*KEY, "slope", "intercept").agg((F.min("y") - F.stddev_pop("y")).alias("lo"), (F.max("y") + F.stddev_pop("y")).alias("hi"))
    rows = line.join(bounds, KEY).select("*", F.explode(F.sequence(F.lit(0), F.lit(H - 1))).alias("h"))
    point = W.clamp(F.col("slope") * (F.col("h") + C) + F.col("intercept"), F.col("lo"), F.col("hi"))
    growth = F.sqrt(1 + F.col("h") / C)
    return rounded(rows.select(*KEY, "h", point.alias("point"), (point + F.col("q_lo") * growth).alias("lower"), (point + F.col("q_hi") * growth).alias("upper")), point=5, lower=5, upper=5)


@registered
def evenly_spaced_windows(spark, sf_dir):
    """Errors of the last value in the windows at the start, a third and two thirds of each series' windows."""
    errors = backtest.window_errors(naive(packed(spark, sf_dir, S.daily_orders)))
    by = Window.partitionBy("series_id")
    numbered = errors.withColumn("place", F.row_number().over(by.orderBy("window_start")) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    chosen = numbered.where(F.col("place").isin(0) | (F.col("place") == F.floor(F.col("n") / 3)) | (F.col("place") == F.floor(2 * F.col("n") / 3)))
    return rounded(chosen.select(*KEY, (F.col("mse") / 1e6).alias("mse")), mse=1)


@registered
def first_windows(spark, sf_dir):
    """Errors of the last value in the first three windows of each series."""
    errors = backtest.window_errors(naive(packed(spark, sf_dir, S.daily_orders)))
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy("window_start"))
    return rounded(errors.withColumn("rank", rank).where("rank <= 3").select(*KEY, (F.col("mse") / 1e6).alias("mse")), mse=1)


@registered
def window_mse_spread(spark, sf_dir):
    errors = backtest.window_errors(naive(packed(spark, sf_dir, S.daily_orders)))
    p95 = errors.groupBy("series_id").agg(F.percentile("mse", 0.95).alias("p95"))
    out = errors.join(p95, "series_id").groupBy("series_id", "p95").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("mse").alias("mean_mse"), F.stddev_pop("mse").alias("std_mse"), F.avg(F.least("mse", "p95")).alias("clipped_mean"))
    return rounded(out.select("series_id", "n_windows", *[(F.col(c) / 1e6).alias(c) for c in ("mean_mse", "std_mse", "clipped_mean", "p95")]), p95=1, mean_mse=1, std_mse=1, clipped_mean=1)


@registered
def worst_windows(spark, sf_dir):
    return rounded(backtest.worst_windows(backtest.window_errors(naive(packed(spark, sf_dir, S.daily_orders)))).withColumn("mse", F.col("mse") / 1e6), mse=1)


@registered
def periodogram(spark, sf_dir):
    return rounded(power_bins(spark, sf_dir).select(*KEY, "k", "power"), power=2)


@registered
def peak_significance(spark, sf_dir):
    return rounded(spectrum.strongest(power_bins(spark, sf_dir), KEY).drop("frequency"), peak=2, noise_floor=2, snr=6)


@registered
def dominant_period(spark, sf_dir):
    return spectrum.dominant_period(power_bins(spark, sf_dir), KEY)


@registered
def amplitude_damping(spark, sf_dir):
    """What phase uncertainty leaves of the strongest component of each window, step by step."""
    top = spectrum.strongest(power_bins(spark, sf_dir), KEY).select(*KEY, "snr", F.explode(F.sequence(F.lit(1), F.lit(H))).alias("h"))
    return rounded(top.select(*KEY, "h", E.amplitude_damping(F.col("h"), F.lit(C), F.col("snr")).alias("damping")), damping=7)


@registered
def spectral_profile(spark, sf_dir):
    return rounded(spectrum.profile(power_bins(spark, sf_dir), KEY), top5_share=6, top10_share=6, top20_share=6, entropy=6, peak_ratio=5)


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.weighted_trends(context(S.hourly_events(spark, sf_dir)), KEY, C)


@registered
def trend_candidates(spark, sf_dir):
    return rounded(trends(spark, sf_dir).drop("ord"), a=8, b=6, c=5, rss=2, bic=5)


@registered
def weighted_trend_bic(spark, sf_dir):
    """The best of all four trends of each window."""
    rows = stored(context(S.hourly_events(spark, sf_dir)), "trend-windows")
    four = trend.weighted_trends(rows, KEY, C).unionByName(trend.exponential_trend(rows, KEY, C))
    return rounded(trend.best_trend(four, KEY).select(*KEY, "trend_type", "bic"), bic=5)


@registered
def curved_trend_bic(spark, sf_dir):
    """The same for series that grow and shrink, so that most windows are curved."""
    rows = stored(grown(spark, sf_dir), "trend-windows")
    four = trend.weighted_trends(rows, KEY, C).unionByName(trend.exponential_trend(rows, KEY, C))
    return rounded(trend.best_trend(four, KEY).select(*KEY, "trend_type", "bic"), bic=4)


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the exponential of the running sum of each hourly series' z-scores, a day's worth of them counting as one."""
    z = W.running(W.zscore(S.hourly_events(spark, sf_dir)).withColumn("y", F.col("y") / 24), ["series_id"], "y", "level").select("series_id", "t", F.exp("level").alias("y"))
    return context(z)


@registered
def trend_exponential(spark, sf_dir):
    """The exponential candidate of each window."""
    found = trend.exponential_trend(context(S.hourly_events(spark, sf_dir)), KEY, C)
    return rounded(found.select(*KEY, "a", "b", "c", "rss"), a=6, b=8, c=5, rss=2)


@registered
def damped_trend(spark, sf_dir):
    curved = trends(spark, sf_dir).where("trend_type = 'quadratic'").select("*", F.explode(F.sequence(F.lit(0), F.lit(H - 1))).alias("h"))
    value = E.damped_trend(F.col("trend_type"), F.col("a"), F.col("b"), F.col("c"), (F.col("h") + C).cast("double"), F.lit(C - 1.0), F.lit(C / 4))
    return rounded(curved.select(*KEY, "h", value.alias("trend")), trend=4)


@registered
def moving_average(spark, sf_dir):
    return rounded(seasonal.moving_average(S.hourly_events(spark, sf_dir), ["series_id"], 24).drop("y"), trend=6)


@registered
def seasonal_profile(spark, sf_dir):
    return rounded(seasonal.seasonal_profile(S.hourly_events(spark, sf_dir), ["series_id"], 24), seasonal=6)


@registered
def classical_decomposition(spark, sf_dir):
    return rounded(seasonal.classical(S.hourly_events(spark, sf_dir), ["series_id"], 24).select("series_id", "t", "filled", "seasonal", "rest"), filled=6, seasonal=6, rest=6)


@registered
def trend_tail(spark, sf_dir):
    rows = seasonal.moving_average(S.hourly_events(spark, sf_dir), ["series_id"], 24).where("trend is not null")
    ends = rows.groupBy("series_id").agg(F.max("t").alias("end"), F.count(F.lit(1)).alias("m"))
    tail = rows.join(ends, "series_id").where(F.col("t") > F.col("end") - F.greatest(F.lit(20), F.floor(F.col("m") / 4)))
    return rounded(tail.groupBy("series_id").agg(F.regr_slope("trend", "t").alias("slope"), F.regr_intercept("trend", "t").alias("intercept"), F.count(F.lit(1)).alias("n")), slope=6, intercept=3)


@registered
def level_shift_candidates(spark, sf_dir):
    return rounded(shocks.shift_candidates(S.daily_nation_orders(spark, sf_dir)), magnitude=4, threshold=4, iqr=4)


@registered
def level_shifts(spark, sf_dir):
    """Shifts of each priority's monthly total, held from day to day until the next month's."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("month", F.date_trunc("month", "o_orderdate"))
    held = S.from_events(orders, F.col("o_orderpriority"), S.bucket_number(orders, "month", S.DAY), F.col("o_totalprice"), fill="forward")
    return rounded(shocks.level_shifts(held), magnitude=2)


def small_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts of the hourly series by a narrow window and a low threshold."""
    return shocks.level_shifts(S.hourly_events(spark, sf_dir), window=7, min_sigma=1.0)


@registered
def narrow_level_shifts(spark, sf_dir):
    return rounded(small_shifts(spark, sf_dir), magnitude=4)


@registered
def shift_free_series(spark, sf_dir):
    """The hourly series less the running sum of their shifts."""
    return rounded(shocks.without_shifts(S.hourly_events(spark, sf_dir), small_shifts(spark, sf_dir)), y=4, shift=4, cleaned=4)


@registered
def shock_select(spark, sf_dir):
    rest = detrended(spark, sf_dir)
    noise = rest.groupBy(*KEY).agg(F.stddev_pop("rest").alias("noise"))
    return rounded(shocks.first_shock(stored(rest.join(noise, KEY), "shock-rows"), KEY, "noise", lookback=C // 4, at="i", delta="rest"), magnitude=5, rate=7, aic=5)


@registered
def shock_passes(spark, sf_dir):
    """Up to three shocks of each window, each taken out of what the ones before it left."""
    rest = detrended(spark, sf_dir)
    noise = rest.groupBy(*KEY).agg(F.stddev_pop("rest").alias("noise"))
    found = shocks.shock_passes(rest.join(noise, KEY), KEY, "noise", lookback=C // 4, at="i", delta="rest")[0]
    return rounded(found, magnitude=5, rate=7, aic=5)


@registered
def strongest_sinusoids(spark, sf_dir):
    """The four strongest sinusoids of the running sum of each whole hourly series less its mean and line."""
    found = sinusoids.extract(wandering(spark, sf_dir), ["series_id"], most=4)[0]
    return rounded(found, frequency=6, amplitude=3, phase=2, snr=2)


def wandering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running sums of the z-scores of each hourly series less their line: a series with slow cycles."""
    walk = W.running(W.zscore(S.hourly_events(spark, sf_dir)), ["series_id"], "y", "level").select("series_id", "t", F.col("level").alias("y"))
    return statistics.detrend(walk, ["series_id"])


@registered
def nation_ar24(spark, sf_dir):
    """Least-squares AR(24) of each nation's whole daily series."""
    fitted = autoregression.least_squares(S.daily_nation_orders(spark, sf_dir), ["series_id"], 24)
    return rounded(fitted.select("series_id", F.posexplode("coef").alias("lag", "coef")).withColumn("coef", F.when(F.col("lag") == 0, F.col("coef") / 1e6).otherwise(F.col("coef"))), coef=6)


@registered
def series_wavelet_energy(spark, sf_dir):
    """Energy of eight scales of each whole daily series."""
    return rounded(wavelet.energies(S.daily_orders(spark, sf_dir), ["series_id"], 8), energy_fraction=7)


@registered
def weighted_autocov(spark, sf_dir):
    return rounded(statistics.weighted_autocovariance(local_rows(spark, sf_dir), KEY, 256, 12, 256 / 3), cov=4)


@registered
def unweighted_autocov(spark, sf_dir):
    return rounded(statistics.autocovariance(local_rows(spark, sf_dir), KEY, 12), cov=4)


@registered
def ar1_yule_walker(spark, sf_dir):
    return rounded(ar1(spark, sf_dir), coef=8, intercept=6)


@registered
def ar_order_histogram(spark, sf_dir):
    """How often each AR order has the least AIC among orders up to 12."""
    cov = statistics.weighted_autocovariance(local_rows(spark, sf_dir), KEY, 256, 12, 256 / 3)
    zero = cov.where("lag = 0").select(*KEY, F.lit(0).alias("p"), E.ar_aic(F.lit(256.0), 0, F.col("cov")).alias("aic"))
    orders = statistics.levinson(cov, KEY).select(*KEY, "p", E.ar_aic(F.lit(256.0), F.col("p"), F.col("variance")).alias("aic")).unionByName(zero)
    best = orders.groupBy(*KEY).agg(F.min(F.struct("aic", "p")).alias("best")).groupBy(F.col("best.p").alias("p")).count()
    return best.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(1))))


@registered
def ar_fitted(spark, sf_dir):
    rows = local_rows(spark, sf_dir).withColumn("before", F.lag("y").over(Window.partitionBy(*KEY).orderBy("i")))
    return rounded(rows.join(ar1(spark, sf_dir), KEY).select(*KEY, "i", F.coalesce(F.col("intercept") + F.col("coef") * F.col("before"), F.lit(0.0)).alias("fitted")), fitted=5)


@registered
def ar_recursive_forecast(spark, sf_dir):
    last = context(S.hourly_events(spark, sf_dir)).where(F.col("i") == C - 1).select(*KEY, "y")
    values = E.ar_ahead(F.array("y"), F.array("coef"), F.col("intercept"), F.lit(H))
    return rounded(ar1(spark, sf_dir).join(last, KEY).select(*KEY, F.posexplode(values).alias("h", "value")), value=5)


def one_step_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.with_previous(S.hourly_events(spark, sf_dir)).withColumn("error", F.col("y") - F.col("before"))


@registered
def ewma_error(spark, sf_dir):
    return rounded(statistics.ewma_last(one_step_errors(spark, sf_dir), ["series_id"], "error"), ewma=6)


@registered
def recent_errors(spark, sf_dir):
    mean = lambda frame: {"rmse50": F.sqrt(F.avg(F.col("error") * F.col("error")).over(frame))}
    return rounded(W.framed(one_step_errors(spark, sf_dir), ["series_id"], 49, 0, mean).select("series_id", "t", "rmse50"), rmse50=5)


@registered
def confidence_weights(spark, sf_dir):
    found = workers.confidences(kept(spark, sf_dir), KEY, workers.PLAIN)
    by = Window.partitionBy(*KEY)
    order = F.when(F.col("worker") == "Naive", 0).when(F.col("worker") == "Seasonal", 1).otherwise(2)
    ranked = found.withColumn("rk", F.row_number().over(by.orderBy(F.desc("confidence"), order)))
    second = F.max(F.when((F.col("rk") == 2) & (F.col("confidence") > 0), F.col("confidence"))).over(by)
    alone = F.coalesce(F.max("confidence").over(by) / second > workers.ensemble.COLLAPSE, F.lit(True))
    weight = F.when(alone, F.when(F.col("rk") == 1, 1.0).otherwise(0.0)).otherwise(F.col("confidence") / F.sum("confidence").over(by))
    return rounded(ranked.select(*KEY, "worker", "mse", "errors", "confidence", weight.alias("weight")), mse=3, confidence=8, weight=8)


@registered
def ensemble_blend(spark, sf_dir):
    return rounded(workers.ensemble_forecast(kept(spark, sf_dir), KEY, H, workers.PLAIN), value=5, lower=5, upper=5, confidence=8, agreement=8)


@registered
def collapse_rate(spark, sf_dir):
    return rounded(backtest.collapse_rate(workers.confidences(kept(spark, sf_dir, S.daily_orders), KEY, workers.PLAIN)), collapse_rate=6)


@registered
def forecast_report(spark, sf_dir):
    p = packed(spark, sf_dir)
    spread = workers.signal_of(p, KEY)
    rows = naive(p).where("h < 24").join(spread, KEY)
    y, s = F.round("predicted", 6), F.col("signal_std")
    return rows.select(*KEY, F.format_string("t+%3d: %.2f [%.2f, %.2f]", "h", y, F.round(F.col("predicted") - s, 6), F.round(F.col("predicted") + s, 6)).alias("line"))


@registered
def wavelet_energy(spark, sf_dir):
    """Energy of each scale of the embedding vectors."""
    vectors = S.embedding_series(spark, sf_dir).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("y"))
    done = decompose.per_window(vectors, ["y"], "shares array<double>", lambda y: {"shares": K.wavelet(np.asarray(y, float))[1]})
    return rounded(done.select("series_id", F.posexplode("shares").alias("scale", "energy_fraction")), energy_fraction=7)


# What SQL cannot express: iterative fits, filter banks, seeded noise. Tests hold these against their definitions.


@registered
def fourier_extract(spark, sf_dir):
    """Sinusoids of each detrended window of the running sums of hourly series."""

    def found(y: list[float]) -> dict:
        y = np.asarray(y, float)
        t = np.arange(len(y))
        return {"components": [dict(zip(("frequency", "amplitude", "phase", "snr"), c, strict=True)) for c in K.waves(y - np.polyval(np.polyfit(t, y, 1), t))[0]]}

    p = decompose.per_window(W.packed(windows(wandering(spark, sf_dir).select("series_id", "t", "y")), C), ["y"], "components array<struct<frequency:double,amplitude:double,phase:double,snr:double>>", found)
    return p.select(*KEY, F.posexplode("components").alias("rank", "c")).select(*KEY, "rank", "c.*")


@registered
def local_ar(spark, sf_dir):
    """The AR model of least AIC of each window."""

    def fitted(y: list[float]) -> dict:
        coef, intercept, aic, sd, used = K.autoregression(np.asarray(y, float))
        return {"order": len(coef), "coefficients": coef, "intercept": intercept, "aic": aic, "residual_std": sd, "window_size": used}

    return decompose.per_window(packed(spark, sf_dir), ["y"], "order int, coefficients array<double>, intercept double, aic double, residual_std double, window_size int", fitted).drop("y", "actual")


@registered
def spectral_decompose(spark, sf_dir):
    """The whole decomposition of each window, summed up."""
    fits = decompose.fit(packed(spark, sf_dir).select(*KEY, "y"), H)
    return fits.select(*KEY, "n", F.size("components").alias("n_components"), "trend.trend_type", F.size("shocks").alias("n_shocks"), F.col("local.order").alias("ar_order"), "residual_mode", "residual_ac1", "noise_std", "q_lo", "q_hi")


@registered
def variance_explained(spark, sf_dir):
    """Share of each window's variance in each layer, and what is left."""
    fits = decompose.fit(packed(spark, sf_dir).select(*KEY, "y"), H)
    v = F.col("layer_variance")
    names = ("periodic", "trend", "shock", "local", "wavelet")
    return fits.select(*KEY, *[(v[i + 1] / v[0]).alias(f"{name}_share") for i, name in enumerate(names)], (1 - v[6] / v[0]).alias("explained"))


@registered
def decomposition_report(spark, sf_dir):
    return decompose.describe(decompose.fit(packed(spark, sf_dir).select(*KEY, "y"), H), KEY)


@registered
def spectral_forecast(spark, sf_dir):
    return decompose.forecast(decompose.fit(packed(spark, sf_dir).select(*KEY, "y"), H), KEY)


@registered
def native_forecast(spark, sf_dir):
    """spectral_forecast by the chain of operators over long rows."""
    return decompose.forecast(native.fit(context(S.hourly_events(spark, sf_dir)), KEY, C, H), KEY)


@registered
def sql_forecast(spark, sf_dir):
    """spectral_forecast by the table function."""
    table_function.register(spark)
    context(S.hourly_events(spark, sf_dir)).createOrReplaceTempView("spindrift_rows")
    return spark.sql(f"SELECT * FROM fit_forecast({H}, TABLE(spindrift_rows) PARTITION BY (series_id, window_start) ORDER BY i)")


@registered
def forecast_layers(spark, sf_dir):
    return decompose.layers(decompose.fit(packed(spark, sf_dir).select(*KEY, "y"), H), KEY)


def worker_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return workers.worker_forecasts(kept(spark, sf_dir), KEY, H, {name: workers.ALL[name]}).drop("ord")

    return run


for _name, _worker in (("ar24_forecast", "AR"), ("iterative_forecast", "Iterative"), ("sr_forecast", "SR"), ("shock_fourier_forecast", "ShockFourier"), ("norm_fourier_forecast", "NormFourier"), ("aggr_fourier_forecast", "AggrFourier")):
    QUERIES[_name] = worker_query(_worker)


@registered
def sr_online(spark, sf_dir):
    """One-step noisy predictions of the values behind each context as they are revealed."""
    done = decompose.per_window(packed(spark, sf_dir), ["y", "actual"], "predicted array<double>", lambda y, a: {"predicted": K.resonance_online(np.asarray(y, float), np.asarray(a, float)).tolist()})
    return done.select(*KEY, F.posexplode("predicted").alias("h", "predicted"))


@registered
def sr_equilibrium(spark, sf_dir):
    """Noise and error that the adaptive loop settles at: the means of the last fifth of the horizon."""

    def settled(y: list[float]) -> dict:
        _, sigmas, errors = K.resonance_adaptive(np.asarray(y, float), H)
        tail = max(1, len(sigmas) // 5)
        return {"equilibrium_noise": float(np.mean(sigmas[-tail:])), "equilibrium_error": float(np.mean(errors[-tail:]))}

    return decompose.per_window(packed(spark, sf_dir), ["y"], "equilibrium_noise double, equilibrium_error double", settled).drop("y", "actual")


@registered
def ensemble_forecast(spark, sf_dir):
    return workers.ensemble_forecast(kept(spark, sf_dir), KEY, H)


@registered
def ensemble_v2_forecast(spark, sf_dir):
    return workers.ensemble_forecast(kept(spark, sf_dir), KEY, H, workers.ALL)


@registered
def ensemble_backtest(spark, sf_dir):
    return backtest.ensemble_metrics(kept(spark, sf_dir), H, workers.DEFAULT)


@registered
def ensemble_v2_backtest(spark, sf_dir):
    """The same with every worker, to be held against ensemble_backtest."""
    return backtest.ensemble_metrics(kept(spark, sf_dir), H, workers.ALL)


@registered
def spectral_backtest(spark, sf_dir):
    return backtest.run(S.hourly_events(spark, sf_dir).unionByName(S.daily_orders(spark, sf_dir)), [96, 192, 336, 720], C)


@registered
def fourier_ablation(spark, sf_dir):
    """Window errors of the whole decomposition, of line and sinusoids alone, and of the last value."""
    p = kept(spark, sf_dir)
    fits = decompose.fit(p.select(*KEY, "y"), H)

    def bare(y: list[float]) -> dict:
        y = np.asarray(y, float)
        t = np.arange(len(y))
        slope, level = np.polyfit(t, y, 1)
        ahead = np.arange(len(y), len(y) + H)
        waves = K.waves(y - slope * t - level)[0]
        return {"values": (slope * ahead + level + sum((a * np.cos(2 * math.pi * f * ahead + ph) for f, a, ph, _ in waves), np.zeros(H))).tolist()}

    options = {
        "full": decompose.forecast(fits, KEY).select(*KEY, "h", F.col("point").alias("value")),
        "fourier_only": workers.unfolded(decompose.per_window(p, ["y"], "values array<double>", bare), KEY).drop("weight"),
        "naive": workers.naive(p.select(*KEY, "y", F.lit(H).alias("horizon")), KEY).drop("weight"),
    }
    out = None
    for name, rows in options.items():
        part = backtest.window_errors(backtest.against_actual(rows, p)).select(F.lit(name).alias("model"), *KEY, "mse")
        out = part if out is None else out.unionByName(part)
    return out


@registered
def clamping_engagement(spark, sf_dir):
    """How many steps of each forecast the signal's range holds back."""
    rows = decompose.layers(decompose.fit(packed(spark, sf_dir).select(*KEY, "y"), H), KEY)
    total = F.col("periodic") + F.col("trend") + F.col("shock") + F.col("local") + F.col("wavelet")
    return rows.groupBy(*KEY).agg(F.count_if((total < F.col("range_lo")) | (total > F.col("range_hi"))).alias("n_clamped"), F.max(F.abs("trend")).alias("largest_trend"), F.avg("periodic").alias("mean_periodic"))


@registered
def online_observation(spark, sf_dir):
    """One-step predictions as the values of each hourly series come in, as the streaming operator gives them."""
    return observe.replay(S.hourly_events(spark, sf_dir))


@registered
def streaming_observation(spark, sf_dir):
    """The streaming operator itself over the stored hourly series, run until it has read them all."""
    source, out, state = (new_path(spark, f"observe-{x}") for x in ("in", "out", "state"))
    S.hourly_events(spark, sf_dir).write.parquet(source)
    stream = observe.observe(streaming.stateful_session(spark).readStream.schema("series_id string, t int, y double").parquet(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(observe.OUTPUT).parquet(out)


@registered
def streaming_ensemble(spark, sf_dir):
    """The blend of all workers behind each of two micro-batches, which hold the halves of every hourly series."""
    source, out = (new_path(spark, f"ensemble-{x}") for x in ("in", "out"))
    series = S.hourly_events(spark, sf_dir)
    half = series.join(W.lengths(series), "series_id").withColumn("first", F.col("t") < F.col("n") / 2)
    session = streaming.stateful_session(spark)
    for first in (True, False):
        half.where(F.col("first") == first).select("series_id", "t", "y").write.mode("append").parquet(source)
        # started again, the stream goes on from its checkpoint with the files that are new
        stream = session.readStream.schema("series_id string, t int, y double").parquet(source)
        streaming.start(stream, out, H).awaitTermination()
    return streaming.forecasts(spark, out)


def event_stream(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """The stored events as a stream, of a session with the state store that the streaming operators need."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return streaming.stateful_session(spark).readStream.schema(kind).parquet(source)


def clock(events: DataFrame) -> DataFrame:
    """A row of no series far behind the last event, which closes all buckets."""
    last = events.agg(F.max("ts").alias("last"))
    return last.select(*[(F.col("last") + F.expr("INTERVAL 30 DAYS")).alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes])


@registered
def streaming_series(spark, sf_dir):
    """The hourly series of events, as they leave a stream that is stopped in between and started again."""
    source, out, state = (new_path(spark, f"grid-{x}") for x in ("in", "out", "state"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ends = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    early = F.col("ts") < F.lit(ends.low + (ends.high - ends.low) / 2)
    for part in (events.where(early), events.where(~early), clock(events)):
        part.write.mode("append").parquet(source)
        series = buckets.dense(event_stream(spark, sf_dir, source), "event_type", "ts", "value")
        series.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(buckets.DENSE).parquet(out).select("series_id", "t", "y"), y=6)


@registered
def streaming_events_ensemble(spark, sf_dir):
    """From raw events to blended forecasts in one stream: buckets, the gaps between them, all workers, the blend."""
    source, out = (new_path(spark, f"events-{x}") for x in ("in", "out"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.unionByName(clock(events)).write.parquet(source)
    series = buckets.dense(event_stream(spark, sf_dir, source), "event_type", "ts", "value")
    streaming.start(series, out, H).awaitTermination()
    return streaming.forecasts(spark, out).where("value is not null and not isnan(value)").drop("batch")


@registered
def streaming_commands(spark, sf_dir):
    """A batch of half of each hourly series, its next values one at a time, a forecast, another batch, one more value and a forecast."""
    source, out, state = (new_path(spark, f"commands-{x}") for x in ("in", "out", "state"))
    series = S.hourly_events(spark, sf_dir)
    n = F.col("n")
    kind = F.when(F.col("t") < F.floor(n / 2), 0).when(F.col("t") < F.floor(n / 2) + 24, 1).when(F.col("t") < n - 1, 3).otherwise(4)
    rows = series.join(W.lengths(series), "series_id").groupBy("series_id", kind.alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("values"))
    command = F.when(F.col("seq").isin(0, 3), "batch").otherwise("value")
    given = rows.select("series_id", F.col("seq").cast("long").alias("seq"), command.alias("command"), "values", F.lit(0).alias("horizon"))
    asked = given.select("series_id").distinct().select("series_id", F.explode(F.array(F.lit(2), F.lit(5)).cast("array<long>")).alias("seq"), F.lit("predict").alias("command"), F.lit(None).cast("array<double>").alias("values"), F.lit(H).alias("horizon"))
    given.unionByName(asked).write.parquet(source)
    stream = streaming.stateful_session(spark).readStream.schema(engine.INPUT).parquet(source)
    engine.ensembles(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(engine.FORECASTS).parquet(out)


@registered
def nation_ensemble(spark, sf_dir):
    """Blended forecasts of every rolling window of every nation's daily orders, by AR, decomposition and resonance."""
    three = {name: workers.DEFAULT[name] for name in ("AR", "Fourier", "SR")}
    return workers.ensemble_forecast(kept(spark, sf_dir, S.daily_nation_orders), KEY, H, three)


@registered
def confidence_profile(spark, sf_dir):
    """Confidence of every worker in every window, with the share of windows in which it is the best."""
    found = workers.confidences(kept(spark, sf_dir), KEY, workers.DEFAULT)
    best = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("confidence"), "worker")) == 1
    return found.withColumn("best", best).groupBy("series_id", "worker").agg(F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.avg(F.col("best").cast("double")).alias("best_share"))


@registered
def trend_divergence(spark, sf_dir):
    """How far each window's trend has moved away at the end of the horizon, in deviations of the window."""
    fits = decompose.fit(packed(spark, sf_dir).select(*KEY, "y"), H).withColumn("deviation", F.sqrt(F.element_at("layer_variance", 1))).withColumn("trend_type", F.col("trend")["trend_type"])
    end = decompose.layers(fits, [*KEY, "trend_type", "deviation"]).where(F.col("h") == H - 1)
    return end.select(*KEY, "trend_type", "deviation", F.col("trend").alias("trend_end"), (F.abs("trend") / F.col("deviation")).alias("divergence"))
