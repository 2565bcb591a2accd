"""Least-squares autoregression of series of any length, and what it predicts one step ahead.

The matrix of the normal equations holds sums of products of values that are i and j places back; each is the sum of
products of all values so many places apart, less the few at the ends of the series. So p+1 sums that combine on the map side and
the first and last p values of a series are all that is needed. The equations themselves are a few numbers, solved row by row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import BLOCK, framed


def with_latest(rows: DataFrame, keys: Sequence[str], places: int, at: str = "t", value: str = "y", block: int = BLOCK) -> DataFrame:
    """Rows with `latest`: the value and up to `places` before it, latest first."""
    return framed(rows, keys, places, 0, lambda frame: {"latest": F.reverse(F.collect_list(value).over(frame))}, at=at, block=block)


def normal_equations(products: np.ndarray, sums: np.ndarray, head: np.ndarray, tail: np.ndarray, n: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y for rows (1, y[t-1], ..., y[t-p]) and y[t], t from p on, by lag products and the values at the ends.

    products: sums of y[t] * y[t-k]; sums: the sum of all values; head and tail: the first and last p values in order.
    """
    both = np.zeros((p + 1, p + 1))
    total = np.zeros(p + 1)
    for j in range(p + 1):
        # y[t-j] for t from p on: the places p-j to n-1-j
        total[j] = sums - head[: p - j].sum() - tail[p - j :].sum()
        for i in range(j + 1):
            k = j - i
            before = float(head[: p - j] @ head[k : p - j + k]) if p > j else 0.0
            # pairs whose earlier place is beyond n-1-j
            behind = float(tail[p - j : p - k] @ tail[p - j + k :]) if j > k else 0.0
            both[i, j] = both[j, i] = products[k] - before - behind
    gram = np.zeros((p + 1, p + 1))
    gram[0, 0], gram[0, 1:], gram[1:, 0], gram[1:, 1:] = n - p, total[1:], total[1:], both[1:, 1:]
    return gram, np.concatenate([[total[0]], both[0, 1:]])


def solved(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """By Cholesky factors; where the matrix is singular, the solution of least norm."""
    try:
        low = np.linalg.cholesky(gram)
        if np.diag(low).min() > 1e-7 * np.diag(low).max():
            return np.linalg.solve(low.T, np.linalg.solve(low, rhs))
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(gram, rhs, rcond=1e-12)[0]


def least_squares(rows: DataFrame, keys: Sequence[str], p: int = 24, at: str = "t", value: str = "y", block: int = BLOCK) -> DataFrame:
    """(keys, n, coef): intercept and p coefficients, latest lag first, of series of 2p values or more, at from 0 without gaps.

    A series whose lags depend on each other, such as a constant one, has the solution of least norm for its deviations from the mean.
    """
    keys = list(keys)
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= 2 * p)
    centred = rows.join(stats, keys).select(*keys, "n", "mean", F.col(at).alias("t"), (F.col(value) - F.col("mean")).alias("y"))
    latest = with_latest(centred, keys, p, value="y", block=block)
    products = F.array(*[F.coalesce(F.sum(F.col("y") * F.get("latest", F.lit(k))), F.lit(0.0)) for k in range(p + 1)])
    end = lambda some: F.transform(F.array_sort(F.collect_list(F.when(some, F.struct("t", "y")))), lambda x: x["y"])
    sums = latest.groupBy(*keys, "n", "mean").agg(products.alias("products"), F.sum("y").alias("total"), end(F.col("t") < p).alias("head"), end(F.col("t") >= F.col("n") - p).alias("tail"))
    names = [*keys, "n", "coef"]
    schema = T.StructType([*sums.select(*keys, "n").schema.fields, T.StructField("coef", T.ArrayType(T.DoubleType()))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, mean, products, total, head, tail in zip(*(b.column(c).to_pylist() for c in ("n", "mean", "products", "total", "head", "tail")), strict=True):
                coef = solved(*normal_equations(np.array(products), total, np.array(head), np.array(tail), n, p))
                # back from deviations to values
                coef[0] += mean * (1 - coef[1:].sum())
                out.append(coef.tolist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array(out, pa.list_(pa.float64()))], names)

    return sums.mapInArrow(solve, schema)


def one_step(coef: Column, latest: Column) -> Column:
    """The value behind `latest` (latest first); null where there are fewer values than coefficients."""
    p = F.size(coef) - 1
    products = F.zip_with(F.slice(coef, F.lit(2), p), F.slice(latest, F.lit(1), p), lambda a, y: a * y)
    return F.when(F.size(latest) >= p, F.element_at(coef, 1) + F.aggregate(products, F.lit(0.0), lambda s, x: s + x))
