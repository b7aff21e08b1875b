"""Sinks: records, audit log, reports and a printed summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.validate import mask_columns
from .shared import remove


def write_records(records: DataFrame, path: str, masked: bool = False, form: str = "json", mode: str = "overwrite") -> None:
    """One record for each document; with masked, identity numbers aren't stored whole. Null fields are left out of JSON."""
    out = mask_columns(records) if masked else records
    out.write.mode(mode).format(form).save(path)


def append_audit(events: DataFrame, path: str) -> None:
    """Append audit events as JSON lines, a folder for each day."""
    mask_columns(events).write.mode("append").partitionBy("audit_date").json(path)


def write_run(rows: DataFrame, path: str, run: str, by: tuple[str, ...] = (), masked: bool = True, form: str = "json") -> None:
    """Write a run's rows into folders of their own, by the run's name and then ``by`` (such as the audit's day): written again, they replace themselves and nothing else.

    What the run wrote before is removed first, so folders that it has no rows for any more go too.
    """
    remove(rows.sparkSession, f"{path}/run={run}")
    out = mask_columns(rows) if masked else rows
    out.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("run", *by).format(form).save(path)


def write_single_report(report: DataFrame, path: str) -> None:
    """The report of ``evaluate.report``, one row, as one JSON file in a folder."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_report(corpus: DataFrame, documents: DataFrame, path: str) -> None:
    """The evaluation report: corpus metrics and the list of documents' results."""
    corpus.write.mode("overwrite").json(f"{path}/corpus")
    documents.write.mode("overwrite").json(f"{path}/documents")


def record_json(record: Column) -> Column:
    return F.to_json(record, {"ignoreNullFields": "false"})


def summary(screened: DataFrame) -> DataFrame:
    """What a person reads of each record: type, name, number, score, a bar and whether to review it."""
    score = F.col("verification.confidence_score")
    bar = F.when(score >= 80, "good").when(score >= 50, "fair").otherwise("poor")
    return screened.select("document_type", "status", F.col("identity.full_name").alias("full_name"), F.col("document.document_number").alias("document_number"), score.alias("confidence_score"), bar.alias("bar"), F.when(F.col("manual_review_required"), "review").otherwise("ok").alias("decision"), F.array_join("manual_review_reasons", "; ").alias("reasons"))


def schema_json(records: DataFrame) -> str:
    return records.schema.json()
