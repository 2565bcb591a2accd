"""Level shifts and single shocks over long rows, in window functions and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import aic, shock_value
from ..sources.scratch import stored
from .quantiles import exact_quantiles
from .statistics import robust_noise
from .windows import BLOCK, framed, lengths, running, with_previous


def shift_candidates(series: DataFrame, window: int = 21, min_sigma: float | None = None, block: int = BLOCK) -> DataFrame:
    """(series_id, index, magnitude, threshold, iqr) of steps that may be lasting jumps.

    A step counts if it exceeds a multiple of the robust noise of steps that grows with their kurtosis, if the
    last step that counted is at least half a window back; its magnitude is the difference of the medians
    beside it. Series shorter than two windows have none. Which of two near steps counts is settled within
    a run of excesses closer than that; a step with none so close before it always counts and starts a run.
    """
    window += window % 2 == 0
    series = stored(series.select("series_id", "t", "y"), "shift-series")
    gap = max(window // 2, 3)
    steps = with_previous(series).select("series_id", (F.col("t") - 1).alias("t"), (F.col("y") - F.col("before")).alias("step"))
    steps = steps.join(lengths(series), "series_id").where(F.col("n") >= 2 * window)
    noise = robust_noise(steps, ["series_id"], "step").where(F.col("mad") >= 1e-10)
    sigma = F.lit(float(min_sigma)) if min_sigma is not None else F.least(3.0 + F.sqrt("excess_kurtosis"), F.lit(10.0))
    steps = steps.join(noise.select("series_id", (sigma * F.col("mad") / 0.6745).alias("threshold")), "series_id")
    steps = steps.withColumn("over", F.when(F.abs("step") > F.col("threshold"), F.col("t")))
    steps = framed(steps, ["series_id"], gap, 0, lambda frame: {"near": F.count("over").over(frame.rowsBetween(1 - gap, -1))}, block=block)
    starts = steps.withColumn("start", F.when(F.col("over").isNotNull() & (F.col("near") == 0), F.col("t")))
    over = running(starts, ["series_id"], "start", "run", "last", block=block).where("over is not null")
    last = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(-gap - 1).alias("last"))
    kept = F.aggregate("places", last, lambda s, p: F.when(p - s["last"] >= gap, F.struct(F.concat(s["kept"], F.array(p)).alias("kept"), p.alias("last"))).otherwise(s))["kept"]
    candidates = over.groupBy("series_id", "n", "threshold", "run").agg(F.array_sort(F.collect_list("t")).alias("places")).select("series_id", "n", "threshold", F.explode(kept).alias("cp"))
    candidates = candidates.withColumn("win", F.least(F.lit(window), F.col("cp"), F.col("n") - F.col("cp") - 1).cast("int")).where("win >= 3")
    # each candidate meets the rows beside it by equality on the series and place, not by range
    beside = candidates.select("series_id", "cp", "threshold", F.explode(F.sequence(F.col("cp") - F.col("win"), F.col("cp") + F.col("win"))).alias("t")).where("t <> cp")
    medians = (
        beside.join(series, ["series_id", "t"])
        .groupBy("series_id", "cp", "threshold")
        .agg(F.median(F.when(F.col("t") < F.col("cp"), F.col("y"))).alias("before"), F.median(F.when(F.col("t") > F.col("cp"), F.col("y"))).alias("after"))
    )
    spread = exact_quantiles(series, ["series_id"], "y", {"q1": 0.25, "q3": 0.75}).select("series_id", (F.col("q3") - F.col("q1")).alias("iqr"))
    return medians.join(spread, "series_id").select("series_id", (F.col("cp") + 1).alias("index"), (F.col("after") - F.col("before")).alias("magnitude"), "threshold", "iqr")


def level_shifts(series: DataFrame, window: int = 21, min_sigma: float | None = None) -> DataFrame:
    """(series_id, index, magnitude) of lasting jumps: candidates as large as the threshold and the interquartile range."""
    found = shift_candidates(series, window, min_sigma)
    return found.where(F.abs("magnitude") >= F.greatest("threshold", "iqr")).select("series_id", "index", "magnitude")


def without_shifts(series: DataFrame, shifts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows with the running sum of shifts as `shift` and y less it as `cleaned`."""
    at = shifts.select("series_id", F.col("index").alias("t"), "magnitude")
    joined = running(series.join(at, ["series_id", "t"], "left"), ["series_id"], "magnitude", "shift", block=block)
    return joined.withColumn("cleaned", F.col("y") - F.col("shift")).drop("magnitude")


def first_shock(rows: DataFrame, keys: Sequence[str], noise: str, min_sigma: float = 2.0, lookback: int | None = None, at: str = "t", delta: str = "delta") -> DataFrame:
    """(keys, onset, shape, magnitude, rate, aic): the shape of least AIC from the first excess on, if there is one.

    Sums and joins by key only, so a long series is neither gathered nor put in order.
    """
    x = rows.select(*keys, F.col(at).alias("t"), F.col(delta).alias("d"), (min_sigma * F.greatest(F.col(noise), F.lit(1e-10))).alias("threshold"))
    x = x.join(x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), list(keys))
    inside = F.col("t") >= F.col("n") - lookback if lookback is not None else F.lit(True)
    size = F.when(inside, F.abs("d"))
    onset = x.groupBy(*keys, "n", "threshold").agg(F.min(F.when(size > F.col("threshold"), F.col("t"))).alias("over"), F.max(size).alias("most"), F.max(F.struct(size.alias("s"), (-F.col("t")).alias("t"))).alias("top"))
    onset = onset.where(F.col("most") >= F.col("threshold")).select(*keys, "n", F.coalesce("over", -F.col("top.t")).alias("onset"))
    started = x.select(*keys, "t", "d").join(onset, list(keys)).where(F.col("t") == F.col("onset")).select(*keys, "n", "onset", F.col("d").alias("first"))
    x = x.drop("n", "threshold").join(started, list(keys)).withColumn("dt", (F.col("t") - F.col("onset")).cast("double"))
    active = F.col("dt") >= 0
    same = active & (F.signum("first") * F.col("d") > F.abs("first") * 0.01)
    log_d = F.when(same, F.log(F.greatest(F.abs("d"), F.lit(1e-30))))
    fits = x.groupBy(*keys, "n", "onset", "first").agg(
        F.avg(F.when(active, F.col("d"))).alias("step"), F.count_if(active).alias("n_active"), F.count_if(same).alias("n_same"),
        F.regr_slope(F.when(active, F.col("d")), "dt").alias("slope"), F.regr_intercept(F.when(active, F.col("d")), "dt").alias("level"),
        F.regr_slope(log_d, F.col("dt")).alias("log_slope"), F.regr_intercept(log_d, F.col("dt")).alias("log_level"),
    )
    spike = F.signum("first") * F.exp("log_level")
    fits = fits.withColumn("spike", F.when((F.abs("first") >= 1e-10) & (F.col("n_same") >= 3) & (F.col("log_slope") < 0), spike))
    y = x.select(*keys, "dt", "d").join(fits, list(keys))
    active = F.col("dt") >= 0
    err = lambda e: F.sum(F.pow(F.col("d") - F.when(active, e).otherwise(0.0), F.lit(2)))
    scored = y.groupBy(*keys, "n", "onset", "step", "slope", "level", "spike", "log_slope", "n_active").agg(
        err(F.col("step")).alias("r0"), err(F.col("spike") * F.exp(F.col("log_slope") * F.col("dt"))).alias("r1"), err(F.col("level") + F.col("slope") * F.col("dt")).alias("r2")
    )
    size, zero = F.col("n").cast("double"), F.lit(0.0)
    options = F.array(
        F.struct(aic(size, 2, F.col("r0")).alias("aic"), F.lit(0).alias("ord"), F.lit("step").alias("shape"), F.col("step").alias("magnitude"), zero.alias("rate")),
        F.struct(F.when(F.col("spike").isNotNull() & (F.col("n_active") >= 3), aic(size, 3, F.col("r1"))).otherwise(float("inf")).alias("aic"), F.lit(1).alias("ord"), F.lit("spike_decay").alias("shape"), F.col("spike").alias("magnitude"), (-F.col("log_slope")).alias("rate")),
        F.struct(F.when(F.col("n_active") >= 3, aic(size, 3, F.col("r2"))).otherwise(float("inf")).alias("aic"), F.lit(2).alias("ord"), F.lit("ramp").alias("shape"), F.col("level").alias("magnitude"), F.col("slope").alias("rate")),
    )
    best = F.array_min(options)
    return scored.select(*keys, "onset", best["shape"].alias("shape"), best["magnitude"].alias("magnitude"), best["rate"].alias("rate"), best["aic"].alias("aic"))


def shock_passes(rows: DataFrame, keys: Sequence[str], noise: str, min_sigma: float = 2.0, lookback: int | None = None, at: str = "t", delta: str = "delta", most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(keys, rank, onset, shape, magnitude, rate, aic) of up to `most` shocks, and the rows less them.

    Each pass takes the shock of least AIC out of what the passes before it left, whose noise stays that of the first; series without
    one drop out. What is left is a written table for each pass.
    """
    keys = list(keys)
    left = stored(rows.select(*keys, F.col(at).alias(at), F.col(delta).alias(delta), F.col(noise).alias(noise)), "shock-rows")
    out = None
    for rank in range(most):
        found = stored(first_shock(left, keys, noise, min_sigma, lookback, at, delta), "shocks")
        if out is not None and found.isEmpty():
            break
        part = found.select(*keys, F.lit(rank).alias("rank"), "onset", "shape", "magnitude", "rate", "aic")
        out = part if out is None else out.unionByName(part)
        gone = F.coalesce(shock_value(F.col("shape"), F.col("onset"), F.col("magnitude"), F.col("rate"), F.col(at).cast("double")), F.lit(0.0))
        left = stored(left.join(found.select(*keys, "onset", "shape", "magnitude", "rate"), keys, "left").select(*keys, at, (F.col(delta) - gone).alias(delta), noise), "shock-rows")
    return out, left
