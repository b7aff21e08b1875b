"""Files in, records out: a landing directory, or any stream of files, screened as it comes.

Each micro-batch is checked, stripped of copies, read by the recognition model and written three ways: records of what
was screened, ERROR records of what failed, and an audit event for every file. What a batch writes lies in folders named by its
number and is overwritten when the batch is run again, so a stop at any point, also after the writing and before the
commit, leaves each file's record once. A record's identifier and time come from the file alone, so a repeated batch writes the same rows.

Copies are files of equal content (SHA-256) that arrive within ``copies_within`` of one another; the first that is seen is kept, and
the state holds only digests. The time that counts is the batch's, so a file with an old date is never late. Files that failed their check are never copies of one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import union_passes
from ..operators import slots
from ..operators.validate import EXTENSIONS, audit_events, error_code, mask_columns, validate_files
from ..plans import pipeline
from ..sources.shared import remove, save, shared_path


def checked(files: DataFrame, strict: bool = False, extensions: tuple[str, ...] = EXTENSIONS, copies_within: str | None = "1 hour") -> DataFrame:
    """Validated files of a stream (path, modificationTime, length, content) without copies."""
    found = validate_files(files, strict, extensions)
    if copies_within is None:
        return found
    timed = found.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", copies_within)
    return timed.withColumn("once", F.coalesce("file_hash", "path")).dropDuplicatesWithinWatermark(["once"]).drop("once", "arrived")


def recognized(files: DataFrame, model: slots.Model | None) -> DataFrame:
    """(path, modificationTime, length, error, message, file_hash, raw_text): the model's passes joined to one text; a file that the model failed on has an error as well."""
    # Files that failed their check don't reach the model.
    read = slots.fill(files.withColumn("content", F.when(F.col("error").isNull(), F.col("content"))), "ocr", model, keep_content=False)
    text = F.array_join(F.filter(F.transform("ocr", lambda p: union_passes(p)), lambda p: p != ""), "\n\n")
    failed = F.col("error").isNull() & F.col("ocr_error").isNotNull()
    return read.select(
        "path", "modificationTime", "length", F.when(failed, "ERR_OCR_ENGINE_FAILURE").otherwise(F.col("error")).alias("error"),
        F.when(failed, F.col("ocr_error")).otherwise(F.col("message")).alias("message"), F.when(failed, None).otherwise(F.col("file_hash")).alias("file_hash"), F.coalesce(text, F.lit("")).alias("raw_text"),
    )


def _request() -> tuple[Column, Column]:
    """A record's identifier and time, from its file alone."""
    return F.sha2(F.concat_ws("|", "path", F.col("modificationTime").cast("string")), 256), F.col("modificationTime")


def events(records: DataFrame, operator_id: str = "OPERATOR_SYSTEM") -> DataFrame:
    """The audit event of each record, or ERROR record, of these columns."""
    failed = "verification" not in records.columns
    score, level = (F.lit(0.0), F.lit("LOW")) if failed else (F.col("verification")["confidence_score"], F.col("verification")["confidence_level"])
    error = F.col("error_codes")[0] if failed else F.lit(None).cast("string")
    of = records.select("request_id", F.col("timestamp").alias("at"), F.col("input_file").alias("path"), F.col("file_hash_sha256").alias("file_hash"), "document_type", "status", score.alias("confidence_score"), level.alias("confidence_level"), F.col("manual_review_reasons").alias("reasons"), error.alias("error"))
    return mask_columns(audit_events(of, operator_id))


def write_batch(files: DataFrame, number: int, out: str, model: slots.Model | None, operator_id: str = "OPERATOR_SYSTEM", masked: bool = True) -> None:
    """Write a batch's folders, each whole. files: see ``checked``."""
    spark, stage = files.sparkSession, f"{out}/staged/batch={number}"

    def put(part: str, rows: DataFrame) -> DataFrame:
        """Written rows, read back."""
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{out}/{part}/batch={number}")
        return spark.read.schema(rows.schema).json(f"{out}/{part}/batch={number}")

    # Each is written before it is used again: the model, the classification and the screening run once.
    typed = recognized(files, model).transform(pipeline.with_text).transform(pipeline.with_type)
    remove(spark, stage)  # of a run that was stopped
    staged = save(typed, stage, ("processor",))
    request, at = _request()
    screened = staged.where("error is null").transform(pipeline.with_record).transform(pipeline.with_review)
    records = pipeline.final_record(screened, request, at, F.col("path"), F.col("file_hash"))
    records = put("records", mask_columns(records) if masked else records)
    errors = pipeline.error_record(staged, request, at)
    errors = put("errors", errors.withColumn("error_code", error_code(F.col("error_codes")[0])))
    put("audit", events(records, operator_id).unionByName(events(errors, operator_id)))
    remove(spark, stage)


def ingest(files: DataFrame, out: str, checkpoint: str, model: slots.Model | None = None, *, strict: bool = False, extensions: tuple[str, ...] = EXTENSIONS, copies_within: str | None = "1 hour", operator_id: str = "OPERATOR_SYSTEM", masked: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Start screening a stream of files into out/records, out/errors and out/audit (JSON lines, a folder for each batch).

    trigger: how often, as for ``DataStreamWriter.trigger``; by default all that is there, then an end.
    """
    found = checked(files, strict, extensions, copies_within)
    return found.writeStream.foreachBatch(lambda df, number: write_batch(df, number, out, model, operator_id, masked)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def written(spark: SparkSession, out: str, part: str) -> DataFrame:
    """What has been written of records, errors or audit."""
    return spark.read.json(f"{out}/{part}")


def run_table(spark: SparkSession, files: DataFrame, model: slots.Model | None = None, batches: int = 2) -> str:
    """Run a table of files (path, modificationTime, length, content) through the stream to its end, in about so many micro-batches; the folder of what was written."""
    base = shared_path(spark, "ingest")
    for k in range(batches):
        files.where(F.pmod(F.xxhash64("path"), F.lit(batches)) == k).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", max(1, files.rdd.getNumPartitions())).parquet(f"{base}/in")
    ingest(stream, f"{base}/out", f"{base}/state", model).awaitTermination()
    return f"{base}/out"
