"""One query for each operator, over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, html_text, language_id, merkle, packing, quality, simhash, token_counts, token_store, toxicity, url_filters, whitening
from .common import crc_bucket, lowered, new_path, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(crc_bucket("doc_id", 4) != 2))
    return language_id.predict(docs, model).select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 4) != 2)
    net = quality.train(docs, labels, "quality")
    scored = quality.predict(docs, net)
    return scored.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model | float:
    """Learned from the labelled rows of `documents` outside the fold that is held out."""
    labels = table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 5) != 0)
    return toxicity.train(table(spark, sf_dir, "documents"), labels, "toxic")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.predict(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.read_store(spark, path)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document a leaf, trees by language; every third id is verified with its text's A-Z in lower case."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    forged = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered(text)).otherwise(text)
    return merkle.manifest(table(spark, sf_dir, "documents"), "doc_id", "lang", [*fields, text], [*fields, forged])


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations are 64 bits wide in the contract: null where one is beyond them."""
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


#: Rules of op13: (host, beginning of the path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("host", "path", "verdict"), r, strict=True)]) for r in URL_RULES])))
    return url_filters.judge(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_token_store": op6_token_store,
    "op7_decontamination": op7_decontamination,
    "op8_packing": op8_packing,
    "op9_html_text": op9_html_text,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle": op11_merkle,
    "op12_whitening": op12_whitening,
    "op13_url_filters": op13_url_filters,
}
