"""Event tables as regular series: (series_id, t, y) with t = 0, 1, ... on a grid without gaps.

Each series has its own grid from its first bucket to its last. The only shuffles are those of the bucket
aggregate, which combines on the map side first, and of the join to the grid; no step orders a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import running

HOUR, DAY = 3600, 86400
FILLS = ("zero", "forward", "none")


def bucket_number(df: DataFrame, ts: str, seconds: int) -> Column:
    """Whole buckets since 1970 for a timestamp with or without time zone (the latter read as UTC), whatever the session's zone."""
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        return F.floor(F.unix_seconds(ts) / seconds)
    return F.floor(F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{ts}` as timestamp_ntz))") / seconds)


def from_events(df: DataFrame, series: Column, bucket: Column, value: Column, agg: str = "sum", fill: str = "zero") -> DataFrame:
    """Aggregate values into buckets and lay each series on its grid.

    agg: sum, avg, count, min or max. fill: `zero` for buckets without events, `forward` for the last value
    before them, `none` for null. Rows with a null series, bucket or value are left out.
    """
    if fill not in FILLS:
        raise ValueError(f"fill {fill!r} is none of {FILLS}")
    rows = df.select(series.cast("string").alias("series_id"), bucket.cast("long").alias("bucket"), value.cast("double").alias("v")).dropna()
    # the exchange on series and bucket also serves the join to the grid
    filled = rows.groupBy("series_id", "bucket").agg(getattr(F, agg)("v").cast("double").alias("y"))
    ends = filled.groupBy("series_id").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    grid = ends.select("series_id", "lo", F.explode(F.sequence("lo", "hi")).alias("bucket"))
    out = grid.join(filled, ["series_id", "bucket"], "left").select("series_id", (F.col("bucket") - F.col("lo")).cast("int").alias("t"), "y")
    if fill == "zero":
        return out.withColumn("y", F.coalesce("y", F.lit(0.0)))
    if fill == "forward":
        return running(out, ["series_id"], "y", "filled", "last").select("series_id", "t", F.col("filled").alias("y"))
    return out


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sum of `events.value` for each event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return from_events(events, F.col("event_type"), bucket_number(events, "ts", HOUR), F.col("value"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sum of `orders.o_totalprice` for each order priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return from_events(orders, F.col("o_orderpriority"), bucket_number(orders, "o_orderdate", DAY), F.col("o_totalprice"))


def daily_nation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sum of `orders.o_totalprice` for each customer's nation."""
    orders, customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation"))
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return from_events(placed, F.col("n_name"), bucket_number(orders, "o_orderdate", DAY), F.col("o_totalprice"))


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding vector as a short series."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select(F.col("vec_id").cast("string").alias("series_id"), F.posexplode("embedding").alias("t", "y")).withColumn("y", F.col("y").cast("double"))
