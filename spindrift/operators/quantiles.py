"""Exact quantiles of groups of any size, by counting in ranges that narrow.

A rank of a group is looked for between two values. Each round counts the rows there in parts, on the map side first,
and goes on between the least and the greatest value of the part that holds the rank. Parts end wherever one of BUCKETS parts of equal
width does, or of equal width of the logarithm, so that long tails take no more rounds than even spreads. When a range holds no more
than GATHERED rows these are put in order; a range of one value needs none. No task sees a group, only counts or a bounded
range of it. Both ends of a range are values of rows and fall into different parts, so every round narrows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

BUCKETS, GATHERED = 256, 65_536
#: Rows of ranges that are sent to every task; more of them are joined by a shuffle.
FEW = 100_000


def near(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Rows with the ranges of their group that hold them."""
    met = rows.join(F.broadcast(ranges) if small else ranges, list(keys))
    return met.where((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))


def logarithm(x: Column) -> Column:
    """Rises with x over all numbers, zero at zero."""
    return F.signum(x) * F.greatest(F.log(F.abs(x) + 1e-300) - math.log(1e-300), F.lit(0.0))


def narrowed(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """One round: for each range the part of it that holds its rank."""
    # halves, so that the width of a range is finite
    share = (F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2)
    low, high = logarithm(F.col("__lo")), logarithm(F.col("__hi"))
    tail = F.when(high > low, (logarithm(F.col("__v")) - low) / (high - low)).otherwise(0.0)
    # both shares rise with the value, and so does the sum of their parts
    bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)) + F.floor(tail * BUCKETS)
    of_range = [*keys, "__rank"]
    counts = near(rows, ranges, keys, small).groupBy(*of_range, "__below", bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__inside"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    up_to = F.col("__below") + F.sum("__inside").over(Window.partitionBy(*of_range).orderBy("__bucket"))
    found = counts.withColumn("__end", up_to).withColumn("__below", F.col("__end") - F.col("__inside"))
    return found.where((F.col("__below") <= F.col("__rank")) & (F.col("__rank") < F.col("__end"))).select(*of_range, "__lo", "__hi", "__below", "__inside")


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str | Column, shares: Mapping[str, float]) -> DataFrame:
    """(keys, a column for each name): interpolated quantiles of each group's values, as F.percentile gives them.

    Nulls and NaN are left out, and a group without other values has no row. `rows` is read in every round: give a table.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    values = rows.select(*keys, v.alias("__v")).where("__v is not null and not isnan(__v)")
    values = values.withColumn("__v", F.greatest(F.least("__v", F.lit(1.7976931348623157e308)), F.lit(-1.7976931348623157e308)))
    most = values.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= GATHERED:
        # no range needs narrowing: every group is one that a task puts in order
        return values.groupBy(*keys).agg(*[F.percentile("__v", float(p)).alias(name) for name, p in shares.items()])
    ends = stored(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")), "quantile-ends")
    place = {name: F.lit(float(p)) * (F.col("__n") - 1) for name, p in shares.items()}
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in place.values() for f in (F.floor, F.ceil)]))
    ranges = ends.select(*keys, F.explode(ranks).alias("__rank"), "__lo", "__hi", F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__inside"))
    small = 2 * len(shares) * ends.count() <= FEW
    wide = (F.col("__inside") > GATHERED) & (F.col("__lo") < F.col("__hi"))
    while not ranges.where(wide).isEmpty():
        ranges = stored(ranges.where(~wide).unionByName(narrowed(values, ranges.where(wide), keys, small)), "quantile-ranges")
    one = F.col("__lo") == F.col("__hi")
    rest = near(values, ranges.where(~one), keys, small).groupBy(*keys, "__rank", "__below").agg(F.array_sort(F.collect_list("__v")).alias("__run"))
    found = ranges.where(one).select(*keys, "__rank", F.col("__lo").alias("__x")).unionByName(rest.select(*keys, "__rank", F.get("__run", (F.col("__rank") - F.col("__below")).cast("int")).alias("__x")))
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__x"))).alias("__at"))
    known = ends.select(*keys, "__n").join(by_rank, list(keys))

    def between(x: Column) -> Column:
        low, high = F.floor(x).cast("long"), F.ceil(x).cast("long")
        a, b = F.element_at("__at", low), F.element_at("__at", high)
        return F.when(low == high, a).otherwise((high - x) * a + (x - low) * b)

    return known.select(*keys, *[between(x).alias(name) for name, x in place.items()])
