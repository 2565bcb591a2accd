"""Blended forecasts of a stream of values (series_id, t, y), written behind every micro-batch.

Every micro-batch is one batch of observations for each series in it: the workers are fitted anew to what the
series has had so far, forecast the horizon, and are trusted by their latest held-out errors, those of earlier
micro-batches included (see engine.py, which keeps all of it in the state store). A micro-batch that is run again after a
failure starts from the state that it started from before and writes the same folder anew. Rows without a series, time or value are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..plans import workers as W
from . import engine

FORECASTS = engine.FORECASTS + ", batch long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the settings of `spark` and the RocksDB state store, so that `spark` stays as it is."""
    own = spark.newSession()
    for row in spark.sql("SET").collect():
        if own.conf.isModifiable(row.key):
            own.conf.set(row.key, row.value)
    own.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def start(stream: DataFrame, path: str, horizon: int, workers: dict[str, W.Worker] | None = None, max_history: int | None = None, level: float = 0.8, forget_after_ms: int | None = None, **trigger) -> StreamingQuery:
    """Start writing the forecasts behind every micro-batch to `path`, a folder that all executors share.

    The stream belongs to a session with the RocksDB state store (see stateful_session). All values of a series
    count, unless `max_history` bounds them.
    """
    whole = stream.dropna(subset=["series_id", "t", "y"]).select("series_id", "t", "y")
    found = engine.ensembles(whole, workers, horizon, max_history, level, forget_after_ms)

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/forecasts/batch={number}")

    return found.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def forecasts(spark: SparkSession, path: str) -> DataFrame:
    """What start() has written so far, with the number of the micro-batch."""
    return spark.read.schema(FORECASTS).parquet(f"{path}/forecasts")
