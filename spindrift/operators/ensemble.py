"""Blending of worker forecasts (keys, worker, ord, h, value, confidence) by confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLLAPSE = 2.0


def usable(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Forecasts of workers with a positive confidence and no NaN at any step."""
    bad = F.max(F.isnan("value") | F.col("value").isNull()).over(Window.partitionBy(*keys, "worker"))
    return forecasts.withColumn("bad", bad).where((F.col("confidence") > 0) & ~F.col("bad")).drop("bad")


def blend(forecasts: DataFrame, signal: DataFrame, keys: Sequence[str], level: float = 0.8) -> DataFrame:
    """(keys, h, value, lower, upper, confidence, agreement).

    signal: one row for each key with `n` and `signal_std`; keys without a usable worker get NaN and 0. The
    workers weigh as their confidences, unless the best has more than COLLAPSE times the next: then it stands alone.
    All steps share the partitions by key, so the forecasts are shuffled once.
    """
    by_key = Window.partitionBy(*keys)
    rows = usable(forecasts, keys)
    # the confidences of a step are those of every step
    each = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("low"), "ord", "value")))
    steps = rows.groupBy(*keys, "h").agg(each.alias("w"))
    best, second = -F.element_at("w", 1)["low"], -F.try_element_at("w", F.lit(2))["low"]
    sums = F.aggregate("w", F.lit(0.0), lambda s, x: s - x["low"])
    weights = F.transform("w", lambda x, i: F.struct(F.when(F.col("alone"), F.when(i == 0, 1.0).otherwise(0.0)).otherwise(-x["low"] / F.col("total")).alias("p"), x["value"].alias("v")))
    steps = steps.withColumn("alone", F.coalesce(best / second > COLLAPSE, F.lit(True))).withColumn("total", sums).withColumn("best", best)
    steps = steps.select(*keys, "h", "best", weights.alias("w"))
    steps = steps.withColumn("value", F.aggregate("w", F.lit(0.0), lambda s, x: s + x["p"] * x["v"]))
    steps = steps.withColumn("spread", F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x["p"] * F.pow(x["v"] - F.col("value"), F.lit(2)))))
    steps = steps.withColumn("mean_spread", F.avg("spread").over(by_key)).drop("w")
    out = signal.join(steps, list(keys), "left")
    z = 1.96 if level >= 0.95 else 1.28
    growth = F.sqrt(1 + F.col("h") / F.greatest("n", F.lit(1)))
    width = F.greatest((F.col("spread") + 0.5 * F.col("mean_spread")) * growth * z, 0.05 * F.col("signal_std") * growth)
    agreement = 1 / (1 + F.col("mean_spread") / F.col("signal_std"))
    nan, known = F.lit(float("nan")), F.col("value").isNotNull()
    return out.select(
        *keys, F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("value", nan).alias("value"), F.when(known, F.col("value") - width).otherwise(nan).alias("lower"), F.when(known, F.col("value") + width).otherwise(nan).alias("upper"),
        F.when(known, F.col("best") * agreement).otherwise(0.0).alias("confidence"), F.when(known, agreement).otherwise(0.0).alias("agreement"),
    )
