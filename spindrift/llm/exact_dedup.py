"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries, one for each task, find the digests that may be frequent. An exact count verifies
them, and the verified ones (at most `capacity` rows) are broadcast: their copies are settled where they
are read. All other digests go through an ordinary shuffle by digest: one of these has at most 1/capacity of the
rows of each task, or one row of a task with fewer rows than that, and so few in all.

Defined cases: a null text counts as empty; null ids sort below all others; of rows with equal text and
equal id exactly one is kept; an empty table gives an empty table; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_names, shuffle_partitions, stored


def text_digest(text_col: str) -> Column:
    """SHA-256 of the UTF-8 text as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def misra_gries(counts: dict, items: list, capacity: int) -> None:
    """Add items to a Misra-Gries summary of at most `capacity` counters, in place."""
    for x in items:
        n = counts.get(x)
        if n is not None:
            counts[x] = n + 1
        elif len(counts) < capacity:
            counts[x] = 1
        else:
            gone = []
            for k in counts:
                counts[k] -= 1
                if not counts[k]:
                    gone.append(k)
            for k in gone:
                del counts[k]


def default_capacity(df: DataFrame) -> int:
    """Counters of a summary: grows with the number of shuffle partitions, so that what is left is even among them."""
    return max(1024, 4 * shuffle_partitions(df.sparkSession))


def heavy_digests(digests: DataFrame, capacity: int) -> DataFrame:
    """(digest, estimate): at most `capacity` digests, those whose summaries count most; seen twice in some task."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for b in batches:
            misra_gries(counts, b.column(0).to_pylist(), capacity)
        # a digest seen once cannot be told from noise; its group meets in the ordinary shuffle
        kept = {k: n for k, n in counts.items() if n > 1}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "estimate"])

    found = digests.select("digest").mapInArrow(summarise, "digest binary, estimate long")
    merged = found.groupBy("digest").agg(F.sum("estimate").alias("estimate"))
    return merged.orderBy(F.desc("estimate"), "digest").limit(capacity)


def verified_winners(digests: DataFrame, capacity: int) -> DataFrame:
    """(digest, keep_id, group_size) of the heavy digests, counted exactly; stored, at most `capacity` rows."""
    exact = digests.join(F.broadcast(heavy_digests(digests, capacity)), "digest", "left_semi").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return stored(exact.where("group_size > 1"), "dedup-winners")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256."""
    capacity = capacity or default_capacity(df)
    digests = stored(df.select(F.col(id_col).alias("id"), text_digest(text_col).alias("digest")), "dedup-digests")
    winners = F.broadcast(verified_winners(digests, capacity))
    marked = digests.join(winners, "digest", "left")
    dropped = marked.where("keep_id > id or (keep_id is not null and id is null)").select("id", "keep_id", "group_size", F.lit(False).alias("kept"), "digest")
    # rows that have the id of their group's winner: one, but for repeated rows, which are counted before they are shuffled
    tops = marked.where("group_size is not null and (id = keep_id or keep_id is null)").groupBy("digest", "id", "keep_id", "group_size").agg(F.count(F.lit(1)).alias("n"))
    tops = tops.select("id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"), "digest")
    by_digest = Window.partitionBy("digest")
    rest = marked.where("group_size is null").select(
        "id", F.max("id").over(by_digest).alias("keep_id"), F.count(F.lit(1)).over(by_digest).alias("group_size"), F.row_number().over(by_digest.orderBy(F.desc_nulls_last("id"))).alias("i"), "digest"
    )
    out = dropped.unionByName(tops.unionByName(rest).select("id", "keep_id", "group_size", (F.col("i") == 1).alias("kept"), "digest"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """df without the rows whose text another row with a larger id has; all columns stay.

    Copies of heavy texts are dropped where they are read; of the rest, whole rows are shuffled once by digest.
    """
    capacity = capacity or default_capacity(df)
    digest, keep, heavy, row, i = fresh_names(df, "digest", "keep", "heavy", "row", "i")
    keyed = df.withColumn(digest, text_digest(text_col))
    digests = stored(keyed.select(F.col(id_col).alias("id"), F.col(digest).alias("digest")), "dedup-digests")
    winners = F.broadcast(verified_winners(digests, capacity).select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.lit(True).alias(heavy)))
    marked = keyed.join(winners, digest, "left")
    hot = marked.where(F.col(heavy) & (F.col(id_col).eqNullSafe(F.col(keep))))
    # repeated rows may share the winner's id: one row for each digest remains within each task before any shuffle
    hot = hot.groupBy(digest).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(row)).select(f"{row}.*")
    first = F.row_number().over(Window.partitionBy(digest).orderBy(F.desc_nulls_last(id_col)))
    rest = marked.where(F.col(heavy).isNull()).withColumn(i, first).where(F.col(i) == 1).select(*[F.col(f"`{c}`") for c in df.columns])
    return hot.unionByName(rest)
