"""Command line: python -m spindrift.cli forecast | benchmark | decompose FILE."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import windows as W
from .plans import backtest, decompose
from .session import session
from .sources import csv_files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spindrift", description="Decompose and forecast the series of a CSV file.")
    commands = p.add_subparsers(dest="command")
    for name, text in (("forecast", "forecast the values behind the file"), ("benchmark", "rolling-origin errors"), ("decompose", "the decomposition as text")):
        c = commands.add_parser(name, help=text)
        c.add_argument("file")
        c.add_argument("--column", default="OT")
        c.add_argument("--series", help="a column that parts the rows into several series")
        c.add_argument("--order-by", help="a column that orders the rows of each series")
        if name == "forecast":
            c.add_argument("--horizon", type=int, default=96)
            c.add_argument("--context", type=int, default=0)
            c.add_argument("--describe", action="store_true")
        if name == "benchmark":
            c.add_argument("--context", type=int, default=512)
            c.add_argument("--horizons", type=int, nargs="+", default=[96, 192, 336, 720])
            c.add_argument("--name", default="unknown")
    return p


def whole(series: DataFrame) -> DataFrame:
    """Each series as one window."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"])
    return series.groupBy("series_id").agg(values.alias("y"))


def main(args: Sequence[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(args)
    if not a.command:
        p.print_help()
        return 1
    series = csv_files.read_column(session(), a.file, a.column, order_by=a.order_by, series=a.series)
    if a.command == "benchmark":
        backtest.run(series, a.horizons, a.context).withColumn("dataset", F.lit(a.name)).orderBy("series_id", "horizon").show(1000, truncate=False)
        return 0
    horizon = a.horizon if a.command == "forecast" else 1
    fits = decompose.fit(whole(W.tail(series, getattr(a, "context", 0))), horizon)
    if a.command == "decompose" or a.describe:
        for row in decompose.describe(fits, ["series_id"]).orderBy("series_id").toLocalIterator():
            print(f"[{row.series_id}]\n{row.description}")
    if a.command == "forecast":
        out = decompose.forecast(fits, ["series_id"])
        lines = out.select("series_id", "h", F.format_string("t+%3d: %.4f [%.4f, %.4f]", F.col("h") + 1, "point", "lower", "upper").alias("line"))
        for row in lines.orderBy("series_id", "h").toLocalIterator():
            print(row.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
