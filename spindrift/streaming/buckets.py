"""Event streams as buckets with a watermark: windowed sums, and dense series that forecasts can follow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.series import FILLS

DENSE = "series_id string, t int, y double, bucket_start timestamp"
AGGREGATES = ("sum", "avg", "count", "min", "max")


def bucketed(events: DataFrame, series: str, ts: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(series_id, bucket_start, y): each bucket once, when no row for it can come any more; later rows are dropped."""
    rows = events.select(F.col(series).alias("series_id"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).alias("v")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "series_id").agg(F.sum("v").alias("y")).select("series_id", F.col("window.start").alias("bucket_start"), "y")


class Grid(StatefulProcessor):
    """The open buckets of a series; those that the watermark has passed go out in order, with the gaps between them.

    State: a map of the open buckets, whose size is that of the watermark's delay, and where the grid stands.
    """

    def __init__(self, width: int, agg: str, fill: str):
        self.width, self.agg, self.fill = width, agg, fill

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "bucket long", "total double, n long, low double, high double")
        self.grid = handle.getValueState("grid", "first long, next long, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).dropna(subset=["bucket", "v"])
        after = self.grid.get()[1] if self.grid.exists() else None
        # rows of a null series only move the clock
        if key[0] is not None and len(new):
            for bucket, v in new.groupby("bucket")["v"]:
                bucket = int(bucket)
                if after is not None and bucket < after:
                    continue  # it has gone out
                total, n, low, high = float(v.sum()), len(v), float(v.min()), float(v.max())
                if self.open.containsKey((bucket,)):
                    s, k, a, b = self.open.getValue((bucket,))
                    total, n, low, high = s + total, k + n, min(a, low), max(b, high)
                else:
                    self.handle.registerTimer((bucket + 1) * self.width * 1000)
                self.open.updateValue((bucket,), (total, n, low, high))
        yield self.closed(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.closed(key, timerValues.getCurrentWatermarkInMs())

    def closed(self, key, watermark: int) -> pd.DataFrame:
        """The buckets that end by the watermark, and the gaps before them."""
        out = {"series_id": [], "t": [], "y": [], "bucket_start": []}
        done = sorted(k[0] for k in self.open.keys() if (k[0] + 1) * self.width * 1000 <= watermark) if key[0] is not None else []
        if done:
            first, after, last = self.grid.get() if self.grid.exists() else (done[0], done[0], None)
            for bucket in done:
                total, n, low, high = self.open.getValue((bucket,))
                y = {"sum": total, "avg": total / n, "count": float(n), "min": low, "max": high}[self.agg]
                gap = {"zero": 0.0, "forward": last, "none": None}[self.fill]
                for k in range(after, bucket + 1):
                    for name, x in zip(out, (key[0], k - first, y if k == bucket else gap, pd.Timestamp(k * self.width, unit="s")), strict=True):
                        out[name].append(x)
                after, last = bucket + 1, y
                self.open.removeKey((bucket,))
            self.grid.update((first, after, last))
        return pd.DataFrame(out).astype({"series_id": "object", "t": "int32", "y": "float64", "bucket_start": "datetime64[ns]"})

    def close(self) -> None:
        pass


def dense(events: DataFrame, series: str, ts: str, value: str, width: int = 3600, late: str = "1 hour", agg: str = "sum", fill: str = "zero") -> DataFrame:
    """(series_id, t, y, bucket_start): a stream of events as the series that sources.series.from_events gives for all of them.

    A bucket of `width` seconds since 1970 goes out, after the gaps before it, when the watermark has passed its end;
    rows that are more than `late` behind the latest event, or whose bucket has gone out, are dropped. Rows with a null series move the watermark and
    are in no series, so a row of that kind can close a stream; rows with a null time or value are left out. Needs the RocksDB state store.
    """
    if agg not in AGGREGATES or fill not in FILLS:
        raise ValueError(f"agg is one of {AGGREGATES}, fill one of {FILLS}")
    rows = events.select(F.col(series).cast("string").alias("series_id"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("v")).withWatermark("ts", late)
    rows = rows.withColumn("bucket", F.floor(F.unix_seconds("ts") / width))
    return rows.groupBy("series_id").transformWithStateInPandas(Grid(width, agg, fill), outputStructType=DENSE, outputMode="Append", timeMode="EventTime")
