"""Sinusoids of long series, one after the other: the strongest bin, its frequency between the bins, and what it leaves.

The power of all bins comes from two shuffles of a series: it is cut into n1 strands of n2 places, where n1 times n2 is its
length, so that no task transforms more than max(n1, n2) values at once. The frequency is looked for in rounds: Goertzel sums at a grid
of frequencies are aggregates that combine on the map side, and each round looks closer around the best. Rows, errors and
frequencies of a round are written tables. Series whose peak is no longer beyond chance take no part in further rounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Frequencies of the first round over four bins, of each later round, and rounds: a step is a 30,000th of a bin in the end.
FIRST, LATER, ROUNDS = 33, 17, 5
STRANDS = "array<struct<re:double,im:double>>"


def least_strand(n: Column) -> Column:
    """The greatest divisor of n up to its root: 1 where n is prime, so that its one strand is the whole series."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("int")
    return F.array_max(F.filter(F.sequence(F.lit(1), root), lambda k: n % k == 0))


def transformed(df: DataFrame, column: str) -> DataFrame:
    """df with the discrete Fourier transform of an array of complex numbers in its place."""
    names = df.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for values in b.column(at):
                part = values.values
                z = np.fft.fft(part.field("re").to_numpy() + 1j * part.field("im").to_numpy())
                out.append([{"re": x, "im": y} for x, y in zip(z.real.tolist(), z.imag.tolist(), strict=True)])
            columns = list(b.columns)
            columns[at] = pa.array(out, pa.list_(pa.struct([("re", pa.float64()), ("im", pa.float64())])))
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)


def gathered(rows: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """One array of complex numbers for each group, in the order of `at`."""
    each = F.array_sort(F.collect_list(F.struct(at, "re", "im")))
    return rows.groupBy(*by).agg(F.transform(each, lambda x: F.struct(x["re"].alias("re"), x["im"].alias("im"))).cast(STRANDS).alias("z"))


def power(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, k, power) of the bins up to n/2 of rows (keys, n, t, rest), t from 0 without gaps."""
    place = rows.withColumn("n1", least_strand(F.col("n"))).withColumn("n2", (F.col("n") / F.col("n1")).cast("int"))
    # t = n2 * t1 + t2 and k = k1 + n1 * k2
    first = place.select(*keys, "n", "n1", "n2", F.floor(F.col("t") / F.col("n2")).cast("int").alias("t1"), (F.col("t") % F.col("n2")).alias("t2"), F.col("rest").alias("re"), F.lit(0.0).alias("im"))
    strands = transformed(gathered(first, [*keys, "n", "n1", "n2", "t2"], "t1"), "z")
    each = strands.select(*keys, "n", "n1", "n2", "t2", F.posexplode("z").alias("k1", "x"))
    angle = -2.0 * np.pi * ((F.col("t2") * F.col("k1")) % F.col("n")) / F.col("n")
    re, im = F.col("x")["re"], F.col("x")["im"]
    turned = each.select(*keys, "n", "n1", "k1", "t2", (re * F.cos(angle) - im * F.sin(angle)).alias("re"), (re * F.sin(angle) + im * F.cos(angle)).alias("im"))
    whole = transformed(gathered(turned, [*keys, "n", "n1", "k1"], "t2"), "z").select(*keys, "n", "n1", "k1", F.posexplode("z").alias("k2", "x"))
    k = F.col("k1") + F.col("n1") * F.col("k2")
    return whole.select(*keys, "n", k.cast("int").alias("k"), (re * re + im * im).alias("power")).where(F.col("k") <= F.floor(F.col("n") / 2))


def candidates(spectrum: DataFrame, keys: Sequence[str], errors: DataFrame | None, min_snr: float, error_ratio: float, first_bin: int) -> DataFrame:
    """(keys, n, k, snr, width) of the strongest bin of each series, where it is beyond chance and beyond the error of earlier subtractions."""
    usable = spectrum.where(F.col("k") >= first_bin)
    floor = usable.groupBy(*keys, "n").agg(F.median("power").alias("floor"), F.count(F.lit(1)).alias("bins"), F.max(F.struct("power", (-F.col("k")).alias("k"))).alias("top"))
    enough = F.col("top.power") >= min_snr * F.col("floor") * (1 + F.log(F.greatest("bins", F.lit(2))))
    if errors is not None:
        floor = floor.join(errors, list(keys))
        enough &= F.col("top.power") >= error_ratio * F.col("error")
    snr = F.col("top.power") / F.greatest("floor", F.lit(1e-30))
    half = F.floor(F.col("n") / 2) + 1
    width = F.when(F.col("top.power") > 0, F.least(2 + F.greatest(F.lit(1), F.ceil(2.0 / F.sqrt(F.greatest(snr, F.lit(0.01))))), F.floor(half / 4))).otherwise(1)
    return floor.where(enough).select(*keys, "n", (-F.col("top.k")).alias("k"), snr.alias("snr"), width.cast("int").alias("width"))


def best_frequency(rows: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, f, a, b): the frequency of each series' grid (keys, fs) whose cosine and sine leave the least of it, and their coefficients."""
    each = rows.join(grid, list(keys)).select(*keys, "rest", "t", F.explode("fs").alias("f"))
    angle = 2.0 * np.pi * F.col("f") * F.col("t")
    c, s, y = F.cos(angle), F.sin(angle), F.col("rest")
    sums = each.groupBy(*keys, "f").agg(F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.sum(c * s).alias("cs"), F.sum(c * y).alias("cy"), F.sum(s * y).alias("sy"))
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    # at half a cycle a step the sine vanishes, and the cosine alone is left
    regular = det > 1e-9 * F.col("cc") * F.col("ss")
    a = F.when(regular, (F.col("cy") * F.col("ss") - F.col("sy") * F.col("cs")) / det).otherwise(F.col("cy") / F.greatest("cc", F.lit(1e-30)))
    b = F.when(regular, (F.col("sy") * F.col("cc") - F.col("cy") * F.col("cs")) / det).otherwise(0.0)
    fitted = sums.withColumn("a", a).withColumn("b", b).withColumn("gain", F.col("a") * F.col("cy") + F.col("b") * F.col("sy"))
    best = fitted.groupBy(*keys).agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), "a", "b")).alias("x"))
    return best.select(*keys, (-F.col("x.f")).alias("f"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))


def refined(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """found (keys, n, k, snr, width) with f, a and b: four bins around k, then ever closer around the best."""
    low, high = F.greatest((F.col("k") - 2) / F.col("n"), 0.5 / F.col("n")), (F.col("k") + 2) / F.col("n")
    step = (high - low) / (FIRST - 1)
    around = found.withColumn("low", low).withColumn("high", high).withColumn("step", step)
    grid = around.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(FIRST - 1)), lambda i: F.col("low") + i * F.col("step")).alias("fs"))
    for _ in range(ROUNDS - 1):
        best = best_frequency(rows, grid, keys)
        around = stored(around.drop("f", "a", "b").join(best, list(keys)).withColumn("step", F.col("step") * (2.0 / (LATER - 1))), "sinusoid-grid")
        near = F.transform(F.sequence(F.lit(-(LATER // 2)), F.lit(LATER // 2)), lambda i: F.least(F.greatest(F.col("f") + i * F.col("step"), F.col("low")), F.col("high")))
        grid = around.select(*keys, F.array_distinct(near).alias("fs"))
    return around.drop("f", "a", "b").join(best_frequency(rows, grid, keys), list(keys)).drop("low", "high", "step")


def extract(rows: DataFrame, keys: Sequence[str], at: str = "t", value: str = "rest", most: int = 50, min_snr: float = 2.0, error_ratio: float = 0.5, min_cycles: int = 2) -> tuple[DataFrame, DataFrame]:
    """(keys, rank, frequency, amplitude, phase, snr), strongest first, and the rows with what they leave as `rest`.

    rows: detrended values, their place `at` from 0 without gaps. Series of less than eight values have no sinusoids. A peak must
    exceed min_snr times what the greatest of as many exponential noise bins would reach, and error_ratio times the error that earlier
    subtractions left around their peaks.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n")).where("n >= 8")
    left = stored(rows.select(*keys, F.col(at).cast("int").alias("t"), F.col(value).cast("double").alias("rest")).join(sizes, keys), "sinusoid-rows")
    done, out, errors = None, None, None
    spectrum = stored(power(left, keys), "sinusoid-power")
    for rank in range(most):
        found = stored(candidates(spectrum, keys, errors, min_snr, error_ratio, min_cycles), "sinusoid-peaks")
        quiet = left.join(found, keys, "left_anti").select(*keys, "t", "rest")
        done = quiet if done is None else done.unionByName(quiet)
        if found.isEmpty():
            return out if out is not None else with_rank(found.limit(0).withColumns({"f": F.lit(0.0), "a": F.lit(0.0), "b": F.lit(0.0)}), keys, 0), done
        active = left.join(found.select(*keys), keys, "left_semi")
        best = stored(refined(active, found, keys), "sinusoid-found")
        part = with_rank(best, keys, rank)
        out = part if out is None else out.unionByName(part)
        angle = 2.0 * np.pi * F.col("f") * F.col("t")
        left = stored(active.join(best.select(*keys, "f", "a", "b"), keys).select(*keys, "n", "t", (F.col("rest") - F.col("a") * F.cos(angle) - F.col("b") * F.sin(angle)).alias("rest")), "sinusoid-rows")
        after = stored(power(left, keys), "sinusoid-power")
        # what went from the bins around the peak beyond the energy of the sinusoid itself is error
        around = spectrum.join(best.select(*keys, "width", F.col("k").alias("peak"), "a", "b"), keys).where((F.col("k") >= F.greatest(F.lit(1), F.col("peak") - F.col("width"))) & (F.col("k") <= F.col("peak") + F.col("width")))
        change = around.join(after.withColumnRenamed("power", "after"), [*keys, "n", "k"]).groupBy(*keys, "n", "a", "b").agg(F.sum(F.col("power") - F.col("after")).alias("gone"))
        new = change.select(*keys, F.greatest(F.lit(0.0), F.col("gone") - (F.col("a") * F.col("a") + F.col("b") * F.col("b")) * F.col("n") * F.col("n") / 4).alias("new"))
        if errors is not None:
            new = new.join(errors, keys).select(*keys, (F.col("new") + F.col("error")).alias("new"))
        errors, spectrum = stored(new.withColumnRenamed("new", "error"), "sinusoid-errors"), after
    return out, done.unionByName(left.select(*keys, "t", "rest"))


def with_rank(best: DataFrame, keys: Sequence[str], rank: int) -> DataFrame:
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    return best.select(*keys, F.lit(rank).alias("rank"), F.col("f").alias("frequency"), size.alias("amplitude"), F.atan2(-F.col("b"), F.col("a")).alias("phase"), "snr")
