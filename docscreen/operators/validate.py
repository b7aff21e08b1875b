"""Input file checks, error codes, audit records and masking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import any_of, base_name, col, mask_id

#: Fixed values.
MAX_BYTES = 25 * 1024 * 1024
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff", ".tif")
BATCH_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
UPLOAD_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
MAGIC = {"FFD8FF": "JPEG", "89504E470D0A1A0A": "PNG", "424D": "BMP", "52494646": "WEBP", "49492A00": "TIFF_LE", "4D4D002A": "TIFF_BE"}
FORMAT_EXTENSIONS = {"JPEG": (".jpg", ".jpeg"), "PNG": (".png",), "BMP": (".bmp",), "WEBP": (".webp",), "TIFF_LE": (".tif", ".tiff"), "TIFF_BE": (".tif", ".tiff")}
ERROR_CODES = {
    "ERR_NONE": ("E000", "Processing completed successfully with no errors"),
    "ERR_FILE_NOT_FOUND": ("E001", "Input image file could not be located"),
    "ERR_CORRUPT_PAYLOAD": ("E002", "Image file header is corrupt or unsupported format"),
    "ERR_QUALITY_REJECTED": ("E003", "Image quality is critically low (unreadable blur/darkness)"),
    "ERR_OCR_ENGINE_FAILURE": ("E004", "Tesseract OCR engine encountered an execution error"),
    "ERR_FACE_DETECTOR_FAILED": ("E005", "Face detection model failed or could not process frame"),
    "ERR_MRZ_CHECKSUM_MISMATCH": ("E006", "MRZ check digits failed mathematical verification"),
    "ERR_UNKNOWN_DOCUMENT_TYPE": ("E007", "Document layout does not match any known template"),
    "ERR_DATA_NORMALIZATION": ("E008", "Date or identity field normalization failed"),
    "ERR_MANUAL_REVIEW_FLAGGED": ("E009", "Document flagged for mandatory human operator review"),
    "ERR_INTERNAL_EXCEPTION": ("E010", "Unhandled internal pipeline exception"),
}


def extension(path: Column | str) -> Column:
    return F.regexp_extract(F.lower(base_name(path)), r"[^.](\.[^.]*)$", 1)


def image_format(content: Column | str) -> Column:
    """Format by the first bytes; null if unknown."""
    out = F
    for magic, name in MAGIC.items():
        out = out.when(F.startswith(col(content), F.unhex(F.lit(magic))), name)
    return out.otherwise(None)


def file_error(path: Column | str, length: Column | str, content: Column | str, strict: bool = False, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """Code of the first check that fails; null if none does. A null length is a missing, a null content an unreadable file.

    strict: a RIFF file must say WEBP, and extension and format must agree.
    """
    length, content, kind = col(length), col(content), image_format(content)
    bad = kind.isNull()
    if strict:
        webp = F.coalesce(F.position(F.unhex(F.lit("57454250")).cast("string"), F.substring(content, 1, 16).cast("string")) > 0, F.lit(False))
        bad = bad | ((kind == "WEBP") & ~webp) | ~any_of(*[(kind == k) & extension(path).isin(*e) for k, e in FORMAT_EXTENSIONS.items()])
    return (
        F.when(length.isNull(), "ERR_FILE_NOT_FOUND")
        .when(length == 0, "ERR_EMPTY_FILE")
        .when(length > MAX_BYTES, "ERR_FILE_TOO_LARGE")
        .when(~extension(path).isin(*extensions), "ERR_INVALID_EXTENSION")
        .when(content.isNull(), "ERR_FILE_READ")
        .when(bad, "ERR_MALICIOUS_PAYLOAD")
    )


def error_message(error: Column, path: Column | str, length: Column | str) -> Column:
    return (
        F.when(error == "ERR_FILE_NOT_FOUND", F.concat(F.lit("File does not exist: "), col(path)))
        .when(error == "ERR_EMPTY_FILE", "Uploaded file is 0 bytes (empty)")
        .when(error == "ERR_FILE_TOO_LARGE", F.concat(F.lit("File exceeds maximum allowed size of 25MB ("), col(length).cast("string"), F.lit(" bytes)")))
        .when(error == "ERR_INVALID_EXTENSION", F.concat(F.lit("Unsupported file extension: "), extension(path)))
        .when(error == "ERR_FILE_READ", "Could not read file header")
        .when(error == "ERR_MALICIOUS_PAYLOAD", "File header does not match any allowed image format signature")
    )


def validate_files(files: DataFrame, strict: bool = False, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, length, content) with is_valid, error, message, error_code and, for valid files, the SHA-256 digest."""
    error = file_error("path", "length", "content", strict, extensions)
    out = files.withColumn("error", error).withColumn("is_valid", F.col("error").isNull()).withColumn("message", error_message(F.col("error"), "path", "length"))
    return out.withColumn("file_hash", F.when(F.col("is_valid"), F.sha2("content", 256))).withColumn("error_code", error_code(F.col("error")))


def error_code(error: Column) -> Column:
    """E0xx of a code's name; null for names that have none."""
    return reduce(lambda out, kv: out.when(error == kv[0], kv[1][0]), ERROR_CODES.items(), F).otherwise(None)


def error_table(spark: SparkSession) -> DataFrame:
    """(error, code, description): to join with; of fixed size."""
    rows = ", ".join(f"('{k}', '{c}', '{d}')" for k, (c, d) in ERROR_CODES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(error, code, description)")


#: What is masked in audit records.
MASKED = ("id_number", "aadhaar_number", "vid")


def mask_columns(df: DataFrame, names: tuple[str, ...] = MASKED) -> DataFrame:
    """The identity numbers of a table masked: fields of these names at the top level and within structs, arrays and maps."""

    def masked(c: Column, kind: T.DataType, name: str = "") -> Column:
        if name in names and isinstance(kind, T.StringType):
            return mask_id(c)
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[masked(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: masked(x, kind.elementType, name))
        if isinstance(kind, T.MapType):
            if isinstance(kind.keyType, T.StringType) and isinstance(kind.valueType, T.StringType):
                return F.transform_values(c, lambda k, v: F.when(k.isin(*names), mask_id(v)).otherwise(v))
            return F.transform_values(c, lambda k, v: masked(v, kind.valueType))
        return c

    return df.select(*[masked(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def audit_events(records: DataFrame, operator_id: str = "OPERATOR_SYSTEM") -> DataFrame:
    """One audit event for each record (request_id, at, path, file_hash, document_type, status, confidence_score, confidence_level, reasons, error)."""
    return records.select(
        F.lit("DOCUMENT_SCREENING_OCR").alias("event_type"),
        F.col("at").alias("timestamp"),
        F.date_format("at", "yyyyMMdd").alias("audit_date"),
        "request_id",
        F.lit(operator_id).alias("operator_id"),
        base_name("path").alias("input_file_name"),
        F.coalesce("file_hash", F.lit("UNKNOWN")).alias("file_hash_sha256"),
        "document_type",
        "status",
        "confidence_score",
        "confidence_level",
        (F.size("reasons") > 0).alias("manual_review_required"),
        F.col("reasons").alias("manual_review_reasons"),
        F.col("error").alias("error_code"),
    )
