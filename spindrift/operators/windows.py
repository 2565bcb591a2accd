"""Rolling windows, splits, guards and clamps over long series (series_id, t, y)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.scratch import stored

KEY = ["series_id", "window_start"]
#: Places of a long series that one task puts in order.
BLOCK = 65_536


def split_ends(n: int, train: float | int, val: float | int) -> tuple[int, int]:
    """Ends of the training and validation parts: fractions of n, or numbers of rows.

    Fractions are added before they are multiplied and truncated, in double precision: 0.7 and 0.1 of 10 end at 7, not 8.
    """
    if isinstance(train, int) and isinstance(val, int):
        return min(train, n), min(train + val, n)
    return int(n * train), int(n * (train + val))


def lengths(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg((F.max("t") + 1).alias("n"))


def rolling(series: DataFrame, context: int, horizon: int, stride: int | None = None, first: int = 0) -> DataFrame:
    """Long windows (series_id, window_start, i, y): i counts from 0 to context+horizon-1.

    Every row is sent to the windows that hold it, a fixed number, so one long series is spread over as many
    groups as it has windows and nothing is joined by range. A stride of 0 or None is the horizon. Windows
    start at `first` and must end within the series.
    """
    stride = stride or horizon
    size = context + horizon
    t = F.col("t")
    # starts s = first + k * stride with t - size < s <= t and s + size <= n
    low = F.greatest(F.lit(0), F.ceil((t - size + 1 - first) / stride)).cast("int")
    high = F.least(F.floor((t - first) / stride), F.floor((F.col("n") - size - first) / stride)).cast("int")
    fits = series.join(lengths(series), "series_id").where((F.col("n") >= size + first) & (t >= first)).where(low <= high)
    sent = fits.select("series_id", F.explode(F.sequence(low, high)).alias("k"), "t", "y").withColumn("window_start", F.col("k") * stride + first)
    return sent.select("series_id", "window_start", (F.col("t") - F.col("window_start")).alias("i"), "y")


def packed(windows: DataFrame, context: int) -> DataFrame:
    """One row per window: arrays `y` of the context and `actual` of what follows it.

    The windows are dealt to a fixed number of partitions: they are small, but what is fitted to them is not,
    so adaptive execution must not gather them into few tasks.
    """
    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = windows.repartition(parts, *KEY).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("rows"))
    values = F.transform("rows", lambda r: r["y"])
    return rows.select(*KEY, F.slice(values, 1, context).alias("y"), F.slice(values, F.lit(context + 1), F.greatest(F.size("rows") - context, F.lit(0))).alias("actual"))


def tail(series: DataFrame, context: int) -> DataFrame:
    """The last `context` rows of each series, numbered anew; 0 means all."""
    if not context:
        return series
    ends = series.join(lengths(series), "series_id")
    start = F.greatest(F.col("n") - context, F.lit(0))
    return ends.where(F.col("t") >= start).select("series_id", (F.col("t") - start).cast("int").alias("t"), "y")


def zscore(series: DataFrame, train_share: float = 0.7, floor: float | None = 1e-10) -> DataFrame:
    """y less the mean over the training part, over its population deviation (1 where that is below the floor)."""
    n = lengths(series).withColumn("train_end", F.floor(F.col("n") * train_share))
    stats = series.join(n, "series_id").where(F.col("t") < F.col("train_end")).groupBy("series_id").agg(F.avg("y").alias("mu"), F.stddev_pop("y").alias("sd"))
    sd = F.when(F.col("sd") < floor, 1.0).otherwise(F.col("sd")) if floor is not None else F.col("sd")
    return series.join(stats, "series_id").select("series_id", "t", ((F.col("y") - F.col("mu")) / sd).alias("y"))


def with_previous(rows: DataFrame, at: str = "t", value: str = "y") -> DataFrame:
    """(series_id, at, value, before) for the rows that have a row one step before them.

    Each row also sends its value to the next place, and places meet by series and place, so that a long series
    is not put in order in one task.
    """
    own = F.struct(F.col(at).alias("at"), F.col(value).alias("now"), F.lit(None).cast("double").alias("before"))
    ahead = F.struct((F.col(at) + 1).alias("at"), F.lit(None).cast("double").alias("now"), F.col(value).alias("before"))
    sent = rows.select("series_id", F.explode(F.array(own, ahead)).alias("x"))
    met = sent.groupBy("series_id", F.col("x.at").alias(at)).agg(F.max("x.now").alias(value), F.max("x.before").alias("before"))
    return met.where(F.col(value).isNotNull() & F.col("before").isNotNull())


def framed(rows: DataFrame, keys: Sequence[str], before: int, after: int, make: Callable[[WindowSpec], dict[str, Column]], at: str = "t", block: int = BLOCK) -> DataFrame:
    """Rows with the columns that make(frame) gives, the frame being `before` rows back to `after` rows ahead.

    For rows without gaps in `at`. A series is put in order block by block: a row also goes to the neighbouring
    blocks whose frames reach it.
    """
    place = F.floor(F.col(at) / block)
    blocks = F.sequence(F.floor((F.col(at) - after) / block), F.floor((F.col(at) + before) / block))
    sent = rows.withColumn("__block", F.explode(blocks))
    frame = Window.partitionBy(*keys, "__block").orderBy(at).rowsBetween(-before, after)
    return sent.withColumns(make(frame)).where(F.col("__block") == place).drop("__block")


def running(rows: DataFrame, keys: Sequence[str], column: str, out: str, how: str = "sum", at: str = "t", block: int = BLOCK) -> DataFrame:
    """Rows with the sum (0 where there is nothing) or the last value (`how` is `last`) of a column up to each row, nulls left out.

    Blocks are put in order apart, and what is before a block comes from one row for each block.
    """
    place = F.floor(F.col(at) / block)
    sums = how == "sum"
    inside = (F.sum(column) if sums else F.last(column, ignorenulls=True)).over(Window.partitionBy(*keys, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    end = F.sum(column) if sums else F.max_by(column, F.when(F.col(column).isNotNull(), F.col(at)))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, place.alias("__block")).agg(end.alias("__end"))
    carried = ends.select(*keys, "__block", (F.sum("__end") if sums else F.last("__end", ignorenulls=True)).over(earlier).alias("__before"))
    zero = F.lit(0.0)
    value = F.coalesce("__inside", zero) + F.coalesce("__before", zero) if sums else F.coalesce("__inside", "__before")
    parts = rows.withColumn("__block", place).withColumn("__inside", inside).join(carried, [*keys, "__block"], "left")
    return parts.withColumn(out, value).drop("__block", "__inside", "__before")


def numbered(rows: DataFrame, group: str, order: str, out: str = "t") -> DataFrame:
    """Rows with their place in their group, from 0, in the order of a column.

    Rows are range partitioned by group and order and numbered where they lie; what is before a partition comes from one row
    for each group and partition, so a long group is never put in order in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, group, order).sortWithinPartitions(group, order)
    # the upper bits of a row's number are its partition, the lower ones its place there
    table = stored(dealt.withColumns({"__row": F.monotonically_increasing_id(), "__part": F.spark_partition_id()}), "numbered")
    ends = table.groupBy(group, "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__size"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).drop("__size")
    place = F.col("__row") - F.col("__first") + F.col("__before")
    return table.join(ends, [group, "__part"]).withColumn(out, place.cast("int")).drop("__row", "__part", "__first", "__before")


def finite(y: Column) -> Column:
    return y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))


def check_finite(series: DataFrame) -> DataFrame:
    """The series; reading a NaN or an infinity is an error."""
    bad = F.raise_error(F.lit("the series holds NaN or Inf values")).cast("double")
    return series.withColumn("y", F.when(finite(F.col("y")), F.col("y")).otherwise(bad))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)
