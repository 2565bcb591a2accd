"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def chosen(df: DataFrame, label_col: str, per_label: int, id_col: str, seed: int) -> tuple[DataFrame, int]:
    """About per_label rows of each label, or all of a rarer one, chosen by a hash of the row, and the number of labels.

    One pass counts the labels; the choice itself is a filter, so that nothing is sorted, and only the sample moves.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label_col).count().collect() if r[0] is not None}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col(label_col) == F.lit(label), F.lit(min(1.0, per_label / n))).otherwise(share)
    row = F.xxhash64(F.lit(seed), *[F.col(c) for c in dict.fromkeys([id_col, *df.columns])])
    return df.where(F.pmod(row, F.lit(1 << 30)) < share * float(1 << 30)), len(counts)


def balanced_sample(df: DataFrame, label_col: str, per_label: int, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """About per_label rows of each label, or all of a rarer one, chosen by a hash of the row; never over twice as many."""
    some, labels = chosen(df, label_col, per_label, id_col, seed)
    # twice as many as asked for come by chance never; rows that are repeated very often would
    return some.limit(2 * per_label * max(1, labels))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_label: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """(text, label) of about per_label documents of each label 0 and 1, stored, and the numbers of rows by label.

    Labels are sampled before they meet the texts: the sample of ids is bounded, so it is broadcast and no
    text but the sample's is written anywhere. Of documents that share a sampled id the least text counts, so that every run
    learns from the same texts, and a sample has no more of them than ids.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.min("label").alias("label"))  # a repeated id has one label
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    picked, _ = chosen(known, "label", per_label, "id", 11)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return stored(found.select("text", "label"), "labelled-sample"), counts
