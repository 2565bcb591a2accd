"""Rolling-origin backtests and what is read off them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.statistics import metrics
from . import decompose, workers

KEY = W.KEY


def windows_of(series: DataFrame, context: int, horizon: int, stride: int | None = None, first: int = 0) -> DataFrame:
    """Packed windows (series_id, window_start, y, actual)."""
    return W.packed(W.rolling(series, context, horizon, stride, first), context)


def against_actual(predicted: DataFrame, packed: DataFrame) -> DataFrame:
    """(series_id, window_start, h, predicted, actual) for predictions (series_id, window_start, h, value)."""
    actual = packed.select(*KEY, F.posexplode("actual").alias("h", "actual"))
    return predicted.select(*KEY, "h", F.col("value").alias("predicted")).join(actual, [*KEY, "h"])


def decomposition(packed: DataFrame, options: decompose.Options | None = None) -> DataFrame:
    return decompose.forecast(decompose.fit(packed.select(*KEY, "y", "horizon"), "horizon", options), KEY, options).select(*KEY, "h", F.col("point").alias("value"))


def windows_of_all(series: DataFrame, horizons: list[int], context: int, stride: int | None = None) -> DataFrame:
    """(series_id, window_start, y, actual, horizon): every start that some horizon has, with the longest horizon that fits there."""
    out = None
    for h in sorted(set(horizons)):
        part = W.rolling(series, context, h, stride)
        out = part if out is None else out.unionByName(part)
    # a place of a window that several horizons share is sent once for each of them and meets itself here
    once = out.groupBy(*KEY, "i").agg(F.first("y").alias("y"))
    return W.packed(once, context).withColumn("horizon", F.size("actual"))


def run(series: DataFrame, horizons: list[int], context: int = 512, stride: int | None = None, predict: Callable[[DataFrame], DataFrame] = decomposition) -> DataFrame:
    """(series_id, horizon, mse, mae, mape, rmse, n_windows) for each horizon; windows of different horizons differ.

    Windows that start at the same place are fitted once, for the longest horizon that they have, and their forecast
    counts for every horizon whose windows start there. predict: packed windows with a column `horizon` to (keys, h, value).
    """
    packed = windows_of_all(series, horizons, context, stride)
    ends = packed.select(*KEY, F.col("horizon").alias("longest"), F.posexplode("actual").alias("h", "actual"))
    rows = predict(packed.drop("actual")).select(*KEY, "h", F.col("value").alias("predicted")).join(ends, [*KEY, "h"])
    counts = [F.when((F.col("window_start") % (stride or h) == 0) & (F.col("longest") >= h) & (F.col("h") < h), F.lit(h)) for h in sorted(set(horizons))]
    rows = rows.withColumn("horizon", F.explode(F.array_compact(F.array(*counts))))
    found = metrics(rows, ["series_id", "horizon"]).withColumn("n_windows", (F.col("n") / F.col("horizon")).cast("int")).drop("n")
    # a series too short for any window has no metrics
    every = series.select("series_id").distinct().withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    nan = F.lit(float("nan"))
    measures = [F.coalesce(m, nan).alias(m) for m in ("mse", "mae", "mape", "rmse")]
    return every.join(found, ["series_id", "horizon"], "left").select("series_id", "horizon", *measures, F.coalesce("n_windows", F.lit(0)).alias("n_windows"))


def window_errors(rows: DataFrame) -> DataFrame:
    """(series_id, window_start, mse) of each window."""
    e = F.col("actual") - F.col("predicted")
    return rows.groupBy(*KEY).agg(F.avg(e * e).alias("mse"))


def worst_windows(errors: DataFrame, top: int = 5) -> DataFrame:
    """The windows with the greatest errors of each series, ranked."""
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("mse"), "window_start"))
    return errors.withColumn("rank", rank).where(F.col("rank") <= top)


def ensemble_metrics(packed: DataFrame, horizon: int, chosen: dict[str, workers.Worker]) -> DataFrame:
    """(series_id, worker, mse, collapse_rate) of each worker and of the blend, with the share of windows that collapse to one."""
    each = workers.stored_forecasts(packed, KEY, horizon, chosen)
    actual = packed.select(*KEY, F.posexplode("actual").alias("h", "actual"))
    blended = workers.ensemble.blend(each, workers.signal_of(packed, KEY), KEY).select(*KEY, F.lit("ensemble").alias("worker"), "h", "value")
    rows = each.select(*KEY, "worker", "h", "value").unionByName(blended).join(actual, [*KEY, "h"])
    e = F.col("actual") - F.col("value")
    rates = collapse_rate(each.where("h = 0")).select("series_id", "collapse_rate")
    return rows.groupBy("series_id", "worker").agg(F.avg(e * e).alias("mse")).join(rates, "series_id", "left")


def collapse_rate(confidences: DataFrame) -> DataFrame:
    """(series_id, n_windows, collapse_rate): windows whose best worker has over twice the next one's confidence."""
    c = F.reverse(F.array_sort(F.collect_list("confidence")))
    sorted_ = confidences.where("confidence > 0").groupBy(*KEY).agg(c.alias("c"))
    alone = F.coalesce(F.element_at("c", 1) / F.try_element_at("c", F.lit(2)) > workers.ensemble.COLLAPSE, F.lit(True))
    return sorted_.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_windows"), F.avg(alone.cast("double")).alias("collapse_rate"))
