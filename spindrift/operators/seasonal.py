"""Moving averages, seasonal profiles and classical decomposition of long series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import BLOCK, framed


def moving_average(rows: DataFrame, keys: Sequence[str], window: int, at: str = "t", value: str = "y", out: str = "trend", block: int = BLOCK) -> DataFrame:
    """Centred mean over 2*(window//2)+1 rows without gaps in `at`; null where the frame does not fit."""
    half = window // 2
    return framed(rows, keys, half, half, lambda frame: {out: F.when(F.count(F.lit(1)).over(frame) == 2 * half + 1, F.avg(value).over(frame))}, at, block)


def fill_ends(rows: DataFrame, keys: Sequence[str], column: str, at: str = "t", out: str | None = None) -> DataFrame:
    """Leading nulls take the first value, trailing ones the last; nulls between values stay."""
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(at).alias("at"), F.col(column).alias("value")))
    ends = rows.groupBy(*keys).agg(F.min(known).alias("__first"), F.max(known).alias("__last"))
    filled = F.when(F.col(at) < F.col("__first.at"), F.col("__first.value")).when(F.col(at) > F.col("__last.at"), F.col("__last.value")).otherwise(F.col(column))
    return rows.join(ends, list(keys)).withColumn(out or column, filled).drop("__first", "__last")


def seasonal_profile(rows: DataFrame, keys: Sequence[str], period: int, at: str = "t", value: str = "y") -> DataFrame:
    """(keys, phase, seasonal): the mean at each phase."""
    return rows.groupBy(*keys, F.pmod(F.col(at), F.lit(period)).cast("int").alias("phase")).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("seasonal"))


def classical(rows: DataFrame, keys: Sequence[str], period: int, at: str = "t", value: str = "y") -> DataFrame:
    """Rows with trend (null at the ends), filled trend, seasonal and rest."""
    parts = fill_ends(moving_average(rows, keys, period, at, value), keys, "trend", at, "filled").withColumn("phase", F.pmod(F.col(at), F.lit(period)).cast("int"))
    parts = parts.withColumn("detrended", F.col(value) - F.col("filled"))
    profile = parts.groupBy(*keys, "phase").agg(F.avg("detrended").alias("seasonal"))
    return parts.join(profile, [*keys, "phase"]).withColumn("rest", F.col("detrended") - F.col("seasonal")).drop("detrended", "phase")
