"""CSV files as series, and series as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import numbered

MODES = ("checked", "tolerant", "strict")


def read_column(spark: SparkSession, path: str, column: str = "OT", order_by: str | None = None, series: str | None = None, mode: str = "checked") -> DataFrame:
    """(series_id, t, y) from one column of CSV files with a header.

    Cells that are not numbers are left out and the places behind them move up. `checked`: a missing column
    or one without any number is an error. `tolerant`: either gives an empty series. `strict`: the first
    cell that is not a number is an error when the rows are read. A number is what Python's float() reads,
    but for digits parted by underscores.

    The order of rows is that of `order_by`; without it, the place in the file, which holds for a single
    file only. `series` names a column that parts the rows into several series (else there is one, `0`).
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    rows = spark.read.option("header", True).csv(path)
    if column not in rows.columns:
        if mode == "tolerant":
            return spark.createDataFrame([], "series_id string, t int, y double")
        raise ValueError(f"Column {column!r} not found; available: {', '.join(rows.columns)}")
    cell = F.trim(F.col(f"`{column}`"))
    # try_cast also reads a type suffix (1.5d), which is no number here
    number = F.when(~cell.rlike("(?i)[0-9.][df]$"), F.expr(f"try_cast(trim(`{column}`) as double)"))
    if mode == "strict":
        number = F.when(number.isNull(), F.raise_error(F.concat(F.lit(f"not a number in {column}: "), F.coalesce(cell, F.lit("nothing")))).cast("double")).otherwise(number)
    place = F.col(f"`{order_by}`") if order_by else F.monotonically_increasing_id()
    key = F.col(f"`{series}`").cast("string") if series else F.lit("0")
    kept = rows.select(key.alias("series_id"), place.alias("place"), number.alias("y")).where("y is not null")
    if mode == "checked" and kept.isEmpty():
        raise ValueError(f"No valid numeric data in column {column!r}")
    return numbered(kept, "series_id", "place").select("series_id", "t", "y")


def first_series(df: DataFrame, by: str = "series_id") -> DataFrame:
    """The rows of the least series id."""
    return df.join(F.broadcast(df.agg(F.min(by).alias(by))), by, "left_semi")


def write_series(df: DataFrame, path: str) -> None:
    """(unique_id, ds, y) as CSV with a header."""
    df.select(F.col("series_id").alias("unique_id"), F.col("t").alias("ds"), "y").write.mode("overwrite").option("header", True).csv(path)
