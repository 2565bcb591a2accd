"""Helpers that the text operators share: work folders, tables and joins with hot keys."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

#: Rows of an Arrow batch: texts are thousands of characters, and each task holds some batches outside the heap.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in batches of BATCH_ROWS rows, if its own are larger (10,000 by default)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts; see small_batches()."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spindrift/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows of a batch that are taken out of Arrow at a time, so that a worker holds few texts twice.
SOME_ROWS = 250


def slices(batches: Iterator[pa.RecordBatch], rows: int = SOME_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    # a worker also serves other stages: what Arrow no longer uses goes back at the end of a task
    pa.default_memory_pool().release_unused()


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for new columns that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def crc_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


#: Keys that join_hot() sends to every executor: rows of a few dozen bytes, so a few MB at most.
HOT_KEYS = 2048


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join on `key` where `right` has one row for each key and `weight` says how many rows of `left` have it.

    The HOT_KEYS heaviest rows of `right` are broadcast, so that no hot key of `left` is shuffled;
    the other keys are joined by an ordinary shuffle. `left` is read twice: give it as a table.
    """
    right_cols = [c for c in right.columns if c != key]
    hot = F.broadcast(right.orderBy(F.desc(weight), key).limit(HOT_KEYS).withColumn("__sd_hot", F.lit(True)))
    marked = left.join(hot, key, "left")
    done = marked.where("__sd_hot").drop("__sd_hot")
    rest = marked.where("__sd_hot is null").drop("__sd_hot", *right_cols).join(right, key, "left")
    return done.unionByName(rest)


#: Parts that join_salted() deals a hot key of its left side to, at most.
SALTS = 256


def join_salted(left: DataFrame, right: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Left join on `key` where `right` has one row for each key; `counts` has (key, n) with the rows of `left`.

    The rows of the HOT_KEYS commonest keys are dealt to up to SALTS parts, to each of which the one row of
    `right` is sent as well. Both sides are read once, and what is broadcast is HOT_KEYS keys.
    """
    salts = min(SALTS, shuffle_partitions(left.sparkSession))
    hot = F.broadcast(counts.where("n > 1").orderBy(F.desc("n"), key).limit(HOT_KEYS).select(key, F.lit(True).alias("__sd_hot")))
    some = left.join(hot, key, "left")
    # the place within a salt follows from the row itself, so that a task that runs again deals alike
    some = some.withColumn("__sd_salt", F.when(F.col("__sd_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    each = F.when(F.col("__sd_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = right.join(hot, key, "left").withColumn("__sd_salt", F.explode(each)).drop("__sd_hot")
    return some.drop("__sd_hot").join(dealt, [key, "__sd_salt"], "left").drop("__sd_salt")


#: Rows of a few numbers that few() lets be sent to every executor: a few MB.
FEW_ROWS = 200_000


def few(rows: DataFrame) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if it is counted as small; else joins shuffle as usual."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows
