"""Accuracy against labelled truth: long tables joined by document and field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, distance


def cer(predicted: Column, truth: Column) -> Column:
    """Character error rate in percent, at most 100; without truth 0, or 100 if something was predicted."""
    gt = F.trim(F.coalesce(truth, F.lit("")))
    empty = F.when(predicted.isNull() | (predicted == ""), 0.0).otherwise(100.0)
    return F.when(gt == "", empty).otherwise(F.least(F.lit(100.0), F.round(distance(predicted, gt) / F.length(gt) * 100.0, 2)))


def compare(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """truth and predicted: (filename, field, value). Each true field with its prediction, match and error rate."""
    p = predicted.where("value is not null and value <> ''").select("filename", "field", F.col("value").alias("predicted"))
    same = F.upper(F.trim(F.coalesce("predicted", F.lit("NONE")))) == F.upper(F.trim(F.coalesce("value", F.lit("NONE"))))
    joined = truth.where("field <> 'document_type'").join(p, ["filename", "field"], "left")
    return joined.select("filename", "field", "value", "predicted", same.alias("is_match"), cer(F.col("predicted"), F.col("value")).alias("cer"))


def fields(records: DataFrame, sections: tuple[str, ...] = ("identity", "document", "additional_information")) -> DataFrame:
    """(filename, field, value) of output records (final_record): the fields of their sections, a later section's where names repeat."""
    named = [F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("field"), F.col(s)[f.name].cast("string").alias("value")) for i, s in enumerate(sections) if s in records.columns for f in records.schema[s].dataType.fields]
    long = records.select(base_name("input_file").alias("filename"), F.inline(F.array(*named))).where("value is not null")
    return long.groupBy("filename", "field").agg(F.max_by("value", "i").alias("value"))


def labelled(truth: DataFrame, records: DataFrame) -> DataFrame:
    """The documents of ``per_document``: each labelled file with its true type and, if there is a record, what it was taken for. truth: (filename, field, value)."""
    types = truth.groupBy("filename").agg(F.max(F.when(F.col("field") == "document_type", F.col("value"))).alias("true_type"))
    elapsed = F.col("elapsed_ms") if "elapsed_ms" in records.columns else F.lit(None).cast("double")
    seen = records.groupBy(base_name("input_file").alias("filename")).agg(F.max("document_type").alias("document_type"), F.max(elapsed).alias("elapsed_ms"), F.max("manual_review_required").alias("review"))
    return types.join(seen, "filename", "left")


def evaluate(truth: DataFrame, records: DataFrame) -> DataFrame:
    """``per_document`` of output records against truth (filename, field, value)."""
    return per_document(compare(truth, fields(records)), labelled(truth, records))


def report(documents: DataFrame, at: Column, most: int = 100_000) -> DataFrame:
    """One row: the corpus metrics and all documents' results, ordered by file. For at most so many documents; more are an error, for those write_report has folders."""
    if (n := documents.count()) > most:
        raise ValueError(f"{n} documents don't go into one report; the limit is {most}")
    names = [c for c in documents.columns if c != "cer_sum"]
    each = documents.agg(F.array_sort(F.collect_list(F.struct(*names))).alias("per_document_results"), F.lit(1).alias("one"))
    whole = corpus(documents).select("*", F.lit(1).alias("one")).join(each, "one").drop("one")
    return whole.select(at.alias("evaluation_timestamp"), "*")


def per_document(compared: DataFrame, documents: DataFrame) -> DataFrame:
    """documents: (filename, true_type, document_type, elapsed_ms, review), one for each labelled file; type null if it wasn't processed."""
    sums = compared.groupBy("filename").agg(F.count("*").alias("n"), F.sum(F.col("is_match").cast("int")).alias("good"), F.sum("cer").alias("cer_sum"))
    out = documents.join(sums, "filename", "left").fillna(0, ["n", "good", "cer_sum"])
    n = F.greatest(F.lit(1), F.col("n"))
    return out.select(
        "filename",
        "document_type",
        F.coalesce(F.col("document_type") == F.col("true_type"), F.lit(False)).alias("classification_correct"),
        F.col("n").alias("fields_evaluated"),
        F.col("good").alias("fields_correct"),
        "cer_sum",
        F.round(F.col("good") / n * 100.0, 2).alias("field_accuracy_pct"),
        F.round(F.col("cer_sum") / n, 2).alias("average_cer_pct"),
        F.round("elapsed_ms", 2).alias("processing_time_ms"),
        F.coalesce("review", F.lit(False)).alias("manual_review_required"),
    )


def corpus(documents: DataFrame) -> DataFrame:
    """One row of corpus metrics; the denominators are all labelled documents, and evaluated_* those that were processed."""
    done = F.col("document_type").isNotNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    n, fields = F.greatest(F.lit(1), F.count("*")), F.greatest(F.lit(1), F.sum("fields_evaluated"))
    return documents.agg(
        F.count("*").alias("total_documents_tested"),
        F.round(count(F.col("classification_correct")) / n * 100.0, 2).alias("classification_accuracy_pct"),
        F.round(F.sum("fields_correct") / fields * 100.0, 2).alias("field_accuracy_pct"),
        F.round(F.sum("cer_sum") / fields, 2).alias("average_cer_pct"),
        F.round(F.sum(F.coalesce("processing_time_ms", F.lit(0.0))) / n, 2).alias("average_latency_ms"),
        F.round(count(F.col("manual_review_required")) / n * 100.0, 2).alias("manual_review_rate_pct"),
        count(done).alias("evaluated_documents"),
        F.round(count(F.col("classification_correct")) / F.greatest(F.lit(1), count(done)) * 100.0, 2).alias("evaluated_accuracy_pct"),
    )
