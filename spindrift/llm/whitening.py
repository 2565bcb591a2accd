"""Whitening of vectors by their principal components.

Sums, blocks of rows and errors are gathered in passes over the vectors, each of which leaves one small row a task: the
vectors themselves never move. Each task reduces its centred rows block by block to a triangular matrix (QR); those meet in a tree of
FAN at a time, and the last one, as large as the dimension squared, is taken apart on the driver (bidiagonal.py). The
covariance is never formed, so small components keep their accuracy.

Defined cases: vectors that are null, empty or hold null or non-finite entries are left out, as are those of another length
than the commonest (of equally common ones the greatest); no vector gives an empty table; a component
without variance is whitened as zero and explains zero; such components are left out of identity_error, which is 0 where
nothing else is left; repeated rows are rows; other columns are never looked at. Entries beyond LARGEST are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bidiagonal
from .common import slices, stored

#: Triangular matrices that one task puts together.
FAN = 16
SCALE, OFFSET, LARGEST = 64.0, 1_000_000, 2.0**46


def integers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows with `size` finite entries, and floor(64 * entry) + 1,000,000 of each."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == size)
    c = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    fine = np.isfinite(c).all(axis=1)
    c = c[fine]
    if len(c) and np.abs(c).max() > LARGEST:
        raise ValueError(f"an entry of a vector is beyond {LARGEST:g}")
    return at[fine], np.floor(SCALE * c).astype(np.int64) + OFFSET


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: in Python's integers where 64 bits might not hold it."""
    if len(x) and n * int(np.abs(x).max()) >= 2**62:
        x, sums = x.astype(object), sums.astype(object)
    return n * x - sums


def per_task(df: DataFrame, schema: str, make: Callable[[Iterator[pa.Array]], Iterator[tuple]]) -> DataFrame:
    """Rows that make() gives for the vectors of a task."""
    kind = T.StructType.fromDDL(schema)
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    kinds = [arrow[f.dataType.simpleString()] for f in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(make(b.column(0) for b in slices(batches, 4096)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], kind.names)

    return df.mapInArrow(run, kind)


def length_sums(columns: Iterator[pa.Array]) -> Iterator[tuple]:
    """(size, n, sums) of the vectors of each length."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    for column in columns:
        for size in pc.unique(pc.list_value_length(column)).to_pylist():
            if size:
                _, x = integers(column, size)
                n, sums = found.get(size, (0, np.zeros(size, np.int64)))
                found[size] = (n + len(x), sums + x.sum(axis=0))
    for size, (n, sums) in found.items():
        yield size, n, sums.tolist()


def entry_sums(rows: DataFrame, column: str) -> np.ndarray:
    """The sums of an array column by place: as many numbers as an array has."""
    each = rows.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    return np.array([r.x for r in each.orderBy("at").collect()])


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def stacked(columns: Iterator[pa.Array], size: int, n: int, sums: np.ndarray) -> Iterator[tuple]:
    """(part, r): the triangular factor of the centred rows of a task."""
    r = np.zeros((0, size))
    for column in columns:
        _, x = integers(column, size)
        r = triangle(np.concatenate([r, (deviations(x, n, sums) / n).astype(float)]))
    if len(r):
        yield TaskContext.get().partitionId(), r.tobytes()


def joined_triangles(parts: DataFrame, size: int) -> np.ndarray:
    """One triangular factor of all: FAN at a time, as often as it takes."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(r, float).reshape(-1, size) for r in rows.sort_values("part")["r"]]
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN], "r": [triangle(np.concatenate(each)).tobytes()]})

    parts = stored(parts, "triangles")
    most = parts.agg(F.max("part")).first()[0] or 0
    while most >= FAN:
        parts = parts.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(meet, "part int, r binary")
        most //= FAN
    return triangle(np.concatenate([np.frombuffer(bytes(r.r), float).reshape(-1, size) for r in parts.orderBy("part").collect()]))


def moments(columns: Iterator[pa.Array], size: int, project: Callable[[np.ndarray], np.ndarray], mean: np.ndarray | None, k: int) -> Iterator[tuple]:
    """The sums of whitened rows, or, given their mean, of the products of their centred entries."""
    total = np.zeros(k if mean is None else (k, k))
    for column in columns:
        w = project(integers(column, size)[1])
        total += w.sum(axis=0) if mean is None else (w - mean).T @ (w - mean)
    yield (total.ravel().tolist(),)


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for each vector and component."""
    vectors = df.select(vector_col)
    by_size = stored(per_task(vectors, "size int, n bigint, sums array<bigint>", length_sums), "vector-sums")
    best = by_size.groupBy("size").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), F.desc("size")).first()
    size, n = (best.size, best.n) if best else (1, 0)
    sums = entry_sums(by_size.where(F.col("size") == size), "sums") if n else np.zeros(size, np.int64)
    if n:
        squares, directions = bidiagonal.singular(joined_triangles(per_task(vectors, "part int, r binary", lambda c: stacked(c, size, n, sums)), size))
    else:
        squares, directions = np.zeros(size), np.eye(size)
    k = min(components, size)
    total = float(squares.sum())
    real = squares[:k] > (16 * size * bidiagonal.EPS) ** 2 * max(float(squares[0]), 0.0)
    scale = np.where(real, np.sqrt(n / np.where(real, squares[:k], 1.0)), 0.0) if n else np.zeros(k)
    base = directions[:, :k] * scale

    def project(x: np.ndarray) -> np.ndarray:
        return (deviations(x, n, sums) / n).astype(float) @ base

    error = 0.0
    if real.any():
        mean = entry_sums(per_task(vectors, "s array<double>", lambda c: moments(c, size, project, None, k)), "s") / n
        cov = entry_sums(per_task(vectors, "s array<double>", lambda c: moments(c, size, project, mean, k)), "s").reshape(k, k) / n
        error = float(np.abs(cov - np.eye(k))[np.ix_(real, real)].max())
    kind = T.StructType([df.select(id_col).schema[0], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            at, x = integers(b.column(1), size)
            d = deviations(x, n, sums)
            if d.dtype != object and len(d) and size * float(np.abs(d).max()) ** 2 >= 2.0**62:
                d = d.astype(object)
            squared = [Decimal(int(v)) for v in (d * d).sum(axis=1)]
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(project(x).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(squared, pa.decimal128(38, 0)), values], kind.names)

    rows = df.select(id_col, vector_col).mapInArrow(run, kind).select(id_col, "deviation", F.posexplode("values").alias("at", "whitened"))
    share = F.array(*[F.lit(float(s) / total if total > 0 and r else 0.0) for s, r in zip(squares[:k], real, strict=True)])
    return rows.select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
