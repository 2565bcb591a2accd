"""The multi-level wavelet transform of series of any length: every value is sent to the coefficients that its taps reach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import DB4, DB4_HIGH
from ..sources.scratch import stored

TAPS = len(DB4)


def level(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, i, approximation, detail) of rows (keys, n, i, v), n being the length of the series; n is the new length.

    Ends are mirrored. A value meets up to TAPS/2 coefficients for each of its images, sums combine on the map side.
    """
    n, i = F.col("n"), F.col("i")
    size = F.floor((n + TAPS - 1) / 2).cast("int")
    images = F.array_compact(F.array(i, F.when(i < TAPS - 1, -1 - i), F.when(i >= n - TAPS + 1, 2 * n - 1 - i)))
    placed = rows.select(*keys, "n", "v", F.explode(images).alias("p"))
    # output o takes the extended place 2 * o + j - (TAPS - 2) by tap j
    lowest, highest = F.ceil((F.col("p") - 1) / 2), F.floor((F.col("p") + TAPS - 2) / 2)
    reach = F.sequence(F.greatest(lowest, F.lit(0)).cast("int"), F.greatest(F.least(highest, size - 1), F.greatest(lowest, F.lit(0))).cast("int"))
    sent = placed.select(*keys, size.alias("n"), "v", "p", F.explode(reach).alias("o")).withColumn("j", (F.col("p") - 2 * F.col("o") + TAPS - 2).cast("int"))
    sent = sent.where((F.col("j") >= 0) & (F.col("j") < TAPS) & (F.col("o") < F.col("n")))
    taps = lambda f: F.get(F.array(*[F.lit(float(x)) for x in f]), F.col("j"))
    return sent.groupBy(*keys, "n", F.col("o").alias("i")).agg(F.sum(F.col("v") * taps(DB4)).alias("approximation"), F.sum(F.col("v") * taps(DB4_HIGH)).alias("detail"))


def scales(rows: DataFrame, keys: Sequence[str], levels: int, at: str = "t", value: str = "y") -> DataFrame:
    """(keys, scale, i, v): the coefficients of each scale, 0 being the approximation and then the details, coarsest first."""
    keys = list(keys)
    lengths = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"))
    x = rows.join(lengths, keys).select(*keys, "n", F.col(at).alias("i"), F.col(value).cast("double").alias("v"))
    out = None
    for k in range(levels):
        # each level is read for its details and by the next one
        done = stored(level(x, keys), "wavelet-level")
        part = done.select(*keys, F.lit(levels - k).alias("scale"), "i", F.col("detail").alias("v"))
        out = part if out is None else out.unionByName(part)
        x = done.select(*keys, "n", "i", F.col("approximation").alias("v"))
    return out.unionByName(x.select(*keys, F.lit(0).alias("scale"), "i", "v"))


def energies(rows: DataFrame, keys: Sequence[str], levels: int, at: str = "t", value: str = "y") -> DataFrame:
    """(keys, scale, energy_fraction) of the energy of all values."""
    keys = list(keys)
    total = rows.groupBy(*keys).agg(F.sum(F.pow(value, F.lit(2))).alias("total"))
    parts = scales(rows, keys, levels, at, value).groupBy(*keys, "scale").agg(F.sum(F.col("v") * F.col("v")).alias("energy"))
    return parts.join(total, keys).select(*keys, "scale", (F.col("energy") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))).alias("energy_fraction"))
