"""The registered digest queries of the corpus operators; each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, compression_quality, decontamination, licenses, near_dedup, pii, pivot_index, sentencepiece_codec, source_divergence, substring_dedup, suffix_dedup, toxicity, warc
from .common import table

BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def model_path() -> str:
    """The public vocabulary that the codec query encodes with."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pii_key(spark: SparkSession) -> bytes:
    """The secret key of the pseudonyms, from spark.docscreen.pii.key; the registered queries run with a placeholder where it is unset."""
    return spark.conf.get("spark.docscreen.pii.key", "placeholder of the registered queries").encode()


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), model_path()))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymize(table(spark, sf_dir, "documents"), pii_key(spark))
    counts = [F.col(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", "text", sum(counts[1:], counts[0]).alias("n_replaced"), *counts)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs.withColumn("path", F.concat_ws("/", F.lit(""), "source", "lang", F.col("doc_id").cast("string"))))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.quality(table(spark, sf_dir, "documents")).select(*BASE, F.round("ratio", 6).alias("ratio"))


def op11_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
