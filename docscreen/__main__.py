"""Command line: screen recognized texts, check a directory of files, or evaluate records against labelled truth."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluate
from .plans import pipeline
from .sources import files, sinks


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="docscreen", description=__doc__)
    actions = parser.add_subparsers(dest="action", required=True)
    one = actions.add_parser("screen", help="JSON or Parquet rows with doc_id and raw_text to records")
    one.add_argument("texts")
    one.add_argument("out")
    one.add_argument("--masked", action="store_true", help="don't store identity numbers whole")
    two = actions.add_parser("check", help="a directory of images to their errors, as records")
    two.add_argument("directory")
    two.add_argument("out")
    three = actions.add_parser("evaluate", help="records (JSON lines of final records) against a JSON object of files and their true fields, to one report")
    three.add_argument("records")
    three.add_argument("truth")
    three.add_argument("out")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("docscreen").getOrCreate()
    if given.action == "screen":
        texts = spark.read.parquet(given.texts) if given.texts.rstrip("/").endswith(".parquet") else spark.read.json(given.texts)
        screened = pipeline.screen(texts)
        sinks.write_records(screened.drop("raw_text", "normalized_text"), given.out, masked=given.masked)
        sinks.summary(screened).show(50, truncate=False)
    elif given.action == "evaluate":
        done = evaluate.evaluate(files.read_truth(spark, given.truth), spark.read.json(given.records)).cache()
        sinks.write_single_report(evaluate.report(done, F.current_timestamp()), given.out)
        done.select("filename", "document_type", "field_accuracy_pct", "average_cer_pct", "manual_review_required").orderBy("filename").show(50, truncate=False)
        evaluate.corpus(done).show(vertical=True, truncate=False)
    else:
        found = files.scan(spark, given.directory)
        sinks.write_records(pipeline.error_record(found, F.sha2("path", 256), F.current_timestamp()), given.out)


if __name__ == "__main__":
    main()
