"""Power spectra of packed windows and what is read off them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def power_array(df: DataFrame, value: str = "y", out: str = "power") -> DataFrame:
    """df with the squared magnitudes of the real FFT of an array column."""
    at = df.columns.index(value)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            power = [(np.abs(np.fft.rfft(np.asarray(x, float))) ** 2).tolist() for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(power, pa.list_(pa.float64()))], schema.names)

    return df.mapInArrow(run, schema)


def power_column(values: Column, k: Column) -> Column:
    """Power of bin k by the defining sum, in columns alone; for a few bins of short arrays."""

    def part(f) -> Column:
        terms = F.transform(values, lambda x, i: x * f(2.0 * np.pi * k * i / F.size(values)))
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)

    re, im = part(F.cos), part(F.sin)
    return re * re + im * im


def bins(df: DataFrame, keys: Sequence[str], value: str = "y", first: int = 2) -> DataFrame:
    """(keys, n, k, frequency, power) of the bins from `first` on: the lower ones belong to the trend."""
    rows = power_array(df.select(*keys, value), value).select(*keys, F.size(value).alias("n"), F.posexplode("power").alias("k", "power"))
    return rows.where(F.col("k") >= first).select(*keys, "n", "k", (F.col("k") / F.col("n")).alias("frequency"), "power")


def strongest(spectrum: DataFrame, keys: Sequence[str], min_snr: float = 2.0) -> DataFrame:
    """The strongest bin (of equals the lowest), the median noise floor, and whether the peak is beyond chance.

    A peak must exceed min_snr times what the greatest of as many noise bins would reach.
    """
    stats = spectrum.groupBy(*keys).agg(
        F.median("power").alias("noise_floor"), F.count(F.lit(1)).alias("n_bins"), F.max(F.struct(F.col("power").alias("power"), (-F.col("k")).alias("k"), "frequency", "n")).alias("top")
    )
    snr = F.col("top.power") / F.greatest("noise_floor", F.lit(1e-30))
    threshold = F.col("noise_floor") * (1 + F.log(F.greatest("n_bins", F.lit(2))))
    width = F.least(2 + F.greatest(F.lit(1), F.ceil(2.0 / F.sqrt(F.greatest(snr, F.lit(0.01))))), F.floor((F.floor(F.col("top.n") / 2) + 1) / 4))
    return stats.select(
        *keys, (-F.col("top.k")).alias("k"), F.col("top.frequency").alias("frequency"), F.col("top.power").alias("peak"), "noise_floor", snr.alias("snr"), (F.col("top.power") >= min_snr * threshold).alias("significant"), width.cast("int").alias("footprint")
    )


def dominant_period(spectrum: DataFrame, keys: Sequence[str], least: int = 4) -> DataFrame:
    """Period of the strongest bin with a frequency under 1/least, from `least` up to a quarter of the window."""
    top = spectrum.where(F.col("frequency") < 1.0 / least).groupBy(*keys, "n").agg(F.max(F.struct("power", (-F.col("k")).alias("k"))).alias("top"))
    period = F.least(F.greatest(F.lit(least), F.bround(F.col("n") / -F.col("top.k")).cast("int")), F.floor(F.col("n") / 4).cast("int"))
    return top.select(*keys, period.alias("period"))


def profile(spectrum: DataFrame, keys: Sequence[str], ranks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Shares of the strongest bins, entropy over the logarithm of the number of bins, peak over median."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("power"), "k"))
    p = F.col("power") / F.sum("power").over(Window.partitionBy(*keys))
    rows = spectrum.withColumn("p", p).withColumn("rank", rank)
    return rows.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("rank") <= r, F.col("p")).otherwise(0.0)).alias(f"top{r}_share") for r in ranks],
        (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)) / F.log(F.count(F.lit(1)))).alias("entropy"),
        (F.max("power") / F.median("power")).alias("peak_ratio"),
    )
