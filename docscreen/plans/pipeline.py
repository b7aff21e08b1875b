"""The screening plan: one chain from text to record, without a shuffle.

Each type's rows pass only their own extractor (a filter and a projection), and the branches
are united again, so generated methods stay small and no row is tried by other types' rules.
The source is read and classified once: classified rows are written to the shared folder by
processor, and each branch reads its own. A stream is screened without that.

The columns of the branches are built once for each process (``Recipe``): to build them takes
thousands of calls to the JVM.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import gender
from ..functions.mrz import best_lines, parse
from ..functions.text import first_present, full_name, normalize_ocr, once, snippet, tokens
from ..operators import extract, score
from ..operators.classify import classify, route
from ..operators.reconcile import COMPARED, compare_all
from ..sources.shared import save, shared_path

IDENTITY = ("full_name", "surname", "given_name", "nationality", "date_of_birth", "gender")
DOCUMENT = ("document_number", "date_of_issue", "date_of_expiry", "place_of_birth", "place_of_issue", "issuing_authority", "passport_number", "visa_type", "permit_type", "valid_from", "valid_until", "number_of_entries", "duration_of_stay", "authorization_status")
ADDITIONAL = ("issuing_country", "document_code", "raw_line1", "raw_line2", "visa_number", "issuing_post", "id_number", "id_type", "guardian_name", "address", "vid", "license_number", "blood_group", "permit_number", "authorization_number", "associated_passport", "raw_text_snippet")
#: The number field and the other fields of each type's record, by name in the extractor's struct.
NUMBER = {"visa": "visa_number", "national_id": "id_number", "licence": "license_number", "permit": "permit_number", "travel": "authorization_number"}
LABEL = {"visa": "VISA", "national_id": "NATIONAL_ID", "licence": "DRIVING_LICENSE", "permit": "PERMIT", "travel": "TRAVEL_AUTHORIZATION"}
#: Fields of the document section that each type's record has; others are absent from it.
SECTION = {
    "passport": ("document_number", "date_of_issue", "date_of_expiry", "place_of_birth", "place_of_issue"),
    "visa": ("document_number", "passport_number", "visa_type", "date_of_issue", "date_of_expiry", "valid_from", "valid_until", "number_of_entries", "duration_of_stay", "place_of_birth", "place_of_issue", "issuing_authority"),
    "national_id": ("document_number", "date_of_issue", "date_of_expiry", "place_of_birth", "issuing_authority"),
    "licence": ("document_number", "date_of_issue", "date_of_expiry", "place_of_birth", "issuing_authority"),
    "permit": ("document_number", "permit_type", "date_of_issue", "date_of_expiry", "valid_from", "valid_until", "place_of_birth", "issuing_authority"),
    "travel": ("document_number", "passport_number", "authorization_status", "date_of_issue", "date_of_expiry", "place_of_birth", "issuing_authority"),
    "unknown": ("document_number", "date_of_issue", "date_of_expiry", "place_of_birth", "issuing_authority"),
}


class Recipe:
    """Stands in for a DataFrame while steps are recorded, to be taken on any DataFrame later. ``columns`` are those added so far."""

    def __init__(self):
        self.steps: list[tuple[str, dict[str, Column] | list[Column]]] = []
        self.columns: list[str] = []

    def withColumns(self, columns: dict[str, Column]) -> Recipe:
        self.steps.append(("add", columns))
        self.columns += [c for c in columns if c not in self.columns]
        return self

    def withColumn(self, name: str, column: Column) -> Recipe:
        return self.withColumns({name: column})

    def select(self, *columns: Column) -> Recipe:
        """These columns beside those of the DataFrame itself."""
        self.steps.append(("select", list(columns)))
        return self

    def apply(self, docs: DataFrame) -> DataFrame:
        own = docs.columns
        for kind, columns in self.steps:
            docs = docs.withColumns(columns) if kind == "add" else docs.select(*own, *columns)
        return docs


def _section(names: tuple[str, ...], values: dict[str, Column]) -> Column:
    return F.struct(*[F.coalesce(values.get(n, F.lit(None)), F.lit(None)).cast("string").alias(n) for n in names])


def _verification(**v: Column) -> Column:
    return F.struct(
        v.get("available", F.lit(False)).alias("mrz_available"),
        v.get("valid", F.lit(False)).alias("mrz_valid"),
        v.get("mrz_score", F.lit(0.0)).cast("double").alias("mrz_validation_score"),
        v.get("composite", F.lit(None)).cast("boolean").alias("composite_check_valid"),
        v["complete"].cast("double").alias("completeness_score"),
        v.get("consistent", F.lit(None)).cast("double").alias("consistency_score"),
        v["confidence"].cast("double").alias("confidence_score"),
        v["level"].alias("confidence_level"),
        v.get("comparisons", F.lit(None)).cast("map<string,string>").alias("field_comparisons"),
    )


def with_text(docs: DataFrame, raw_col: str = "raw_text") -> DataFrame:
    return docs.withColumn("normalized_text", normalize_ocr(raw_col))


def with_type(docs: DataFrame) -> DataFrame:
    return docs.withColumn("detected_type", classify("normalized_text")).withColumn("processor", route(F.col("detected_type")))


def _passport(docs: Recipe, with_quality: bool) -> Recipe:
    docs = extract.passport_visual(docs.withColumn("x_zone", best_lines("raw_text")).withColumn("m", once(F.col("x_zone"), lambda z: parse(z))))
    m, has = F.col("m"), F.col("m").isNotNull()
    visual = {k: F.col(f"v_{k}") for k in COMPARED}
    docs = docs.withColumns({f"r_{k}": first_present(m[k], visual[k]) for k in COMPARED} | {"x_tokens": tokens("normalized_text")})
    docs = docs.withColumn("x_comparisons", F.when(has, _compared(m, visual, F.col("x_tokens"))))
    r, c = {k: F.col(f"r_{k}") for k in COMPARED}, F.col("x_comparisons")
    docs = docs.withColumns({"x_complete": score.completeness("passport", score.count_present(*r.values())), "x_consistent": score.consistency_live(c)})
    docs = docs.withColumn("x_confidence", score.confidence_live(has, m["mrz_validation_score"], F.col("x_complete"), F.col("x_consistent")))
    docs = docs.withColumn("x_iso", extract.iso_all(r["date_of_birth"], F.col("v_date_of_issue"), r["date_of_expiry"]))
    born, issued, ends = (F.col("x_iso")[k] for k in range(3))
    identity = {"full_name": full_name(r["given_name"], r["surname"]), "surname": r["surname"], "given_name": r["given_name"], "nationality": r["nationality"], "date_of_birth": born, "gender": gender(r["gender"])}
    document = {"document_number": r["passport_number"], "date_of_issue": issued, "date_of_expiry": ends, "place_of_birth": F.col("v_place_of_birth"), "place_of_issue": F.col("v_place_of_issue")}
    additional = {"issuing_country": m["issuing_country"], "document_code": F.when(has, m["document_code"]).otherwise("P"), "raw_line1": m["raw_line1"], "raw_line2": m["raw_line2"]}
    verification = _verification(available=has, valid=F.coalesce(m["mrz_valid"], F.lit(False)), mrz_score=F.coalesce(m["mrz_validation_score"], F.lit(0.0)), composite=m["valid_composite_check"], complete=F.col("x_complete"), consistent=F.col("x_consistent"), confidence=F.col("x_confidence"), level=score.level(F.col("x_confidence"), "passport"), comparisons=c)
    return _record(docs, with_quality, "passport", "PASSPORT", F.when(m["mrz_valid"], "VERIFIED").otherwise("PROCESSED"), identity, document, additional, verification)


def _compared(m: Column, visual: dict[str, Column], stream: Column) -> Column:
    both = F.struct(F.struct(*[m[k].alias(k) for k in COMPARED]).alias("m"), F.struct(*[v.alias(k) for k, v in visual.items()]).alias("v"), stream.alias("s"))
    return once(both, lambda b: compare_all(b["m"], {k: b["v"][k] for k in COMPARED}, b["s"]))


def _plain(docs: Recipe, with_quality: bool, kind: str) -> Recipe:
    docs = getattr(extract, kind)(docs)
    names = set(docs.columns)
    get = lambda *keys: {k: F.col(f"f_{k}") for k in keys if f"f_{k}" in names}
    docs = docs.withColumn("x_complete", score.completeness(kind, F.col("f_n_present")))
    identity = get(*IDENTITY) | ({"nationality": F.lit("IND")} if kind == "licence" else {})
    document = get(*DOCUMENT) | {"document_number": F.col(f"f_{NUMBER[kind]}")}
    if kind in ("visa", "permit"):
        document |= {"valid_from": F.col("f_date_of_issue"), "valid_until": F.col("f_date_of_expiry")}
    if kind == "visa":
        document |= {"place_of_issue": F.col("f_issuing_post"), "issuing_authority": F.col("f_issuing_post")}
    additional = get(*ADDITIONAL) | ({"associated_passport": F.col("f_passport_number")} if kind == "travel" else {})
    verification = _verification(complete=F.col("x_complete"), confidence=F.col("x_complete"), level=score.level(F.col("x_complete"), kind))
    return _record(docs, with_quality, kind, LABEL[kind], F.lit("PROCESSED"), identity, document, additional, verification)


def _unknown(docs: Recipe, with_quality: bool) -> Recipe:
    verification = _verification(complete=F.lit(0.0), confidence=F.lit(20.0), level=F.lit("LOW"))
    return _record(docs, with_quality, "unknown", "UNKNOWN", F.lit("UNRECOGNIZED_TYPE"), {}, {}, {"raw_text_snippet": snippet("normalized_text", 300)}, verification)


def _record(docs: Recipe, with_quality: bool, kind: str, label: str, status: Column, identity: dict, document: dict, additional: dict, verification: Column) -> Recipe:
    docs = docs.select(
        F.lit(label).alias("document_type"),
        status.alias("status"),
        _section(IDENTITY, identity).alias("identity"),
        _section(DOCUMENT, document).alias("document"),
        _section(ADDITIONAL, additional).alias("additional_information"),
        verification.alias("verification"),
    )
    i, d, v = F.col("identity"), F.col("document"), F.col("verification")
    quality = F.col("quality")["quality_score"] if with_quality else F.lit(100.0)
    parts = F.struct(i.alias("i"), d.alias("d"), v["field_comparisons"].alias("c"), v["mrz_valid"].alias("ok"), quality.alias("q"))
    scores = once(parts, lambda p: score.field_confidence({k: p["i"][k] for k in IDENTITY}, {k: p["d"][k] for k in SECTION[kind]}, p["c"], p["ok"], p["q"]))
    return docs.withColumn("field_confidence", scores)


@cache
def _branch(processor: str, with_quality: bool) -> Recipe:
    """What a processor does to its rows."""
    if processor in NUMBER:
        return _plain(Recipe(), with_quality, processor)
    return (_passport if processor == "passport" else _unknown)(Recipe(), with_quality)


PROCESSORS = ("passport", "unknown", *NUMBER)


def with_record(docs: DataFrame) -> DataFrame:
    """Each row through its type's processor."""
    done = [_branch(k, "quality" in docs.columns).apply(docs.where(F.col("processor") == k)) for k in PROCESSORS]
    return reduce(DataFrame.unionByName, done)


def with_review(records: DataFrame) -> DataFrame:
    """Review reasons and error codes."""
    v, i, d = F.col("verification"), F.col("identity"), F.col("document")
    q, blur = (F.col("quality")["quality_score"], F.col("quality")["blur_status"]) if "quality" in records.columns else (None, None)
    reasons = score.review_reasons(v["confidence_score"], v["field_comparisons"], COMPARED, v["mrz_available"], v["mrz_valid"], i["full_name"], d["document_number"], blur, q)
    out = records.withColumn("manual_review_reasons", reasons)
    out = out.withColumn("manual_review_required", F.size("manual_review_reasons") > 0)
    return out.withColumn("error_codes", F.when(F.col("manual_review_required"), F.array(F.lit("E009"))).otherwise(F.array().cast("array<string>")))


def screen(docs: DataFrame) -> DataFrame:
    """docs: any columns with raw_text, and if known a ``quality`` report. Each row with its record, scores and review decision."""
    typed = docs.transform(with_text).transform(with_type)
    if not docs.isStreaming:
        typed = save(typed, shared_path(docs.sparkSession, "classified"), ("processor",))
    return typed.transform(with_record).transform(with_review)


#: Fixed values.
MODULE, MODULE_VERSION, SCHEMA_VERSION = "MODULE_1_OCR_EXTRACTION", "1.0.0", "2026.1"


def final_record(screened: DataFrame, request_id: Column, at: Column, input_file: Column, file_hash: Column) -> DataFrame:
    """The output record of each screened row; identifiers and time are given, so that a rerun gives the same rows."""
    return screened.select(
        F.lit(MODULE).alias("module"),
        F.lit(MODULE_VERSION).alias("module_version"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        request_id.alias("request_id"),
        at.alias("timestamp"),
        input_file.alias("input_file"),
        file_hash.alias("file_hash_sha256"),
        *["document_type", "status", "manual_review_required", "manual_review_reasons", "identity", "document", "additional_information", "verification", "field_confidence"],
        snippet("normalized_text", 1000).alias("raw_ocr_text"),
        "error_codes",
    )


def template(document_type: Column | str = "UNKNOWN", request_id: Column | None = None) -> Column:
    """Struct of the empty record: every section with its default values."""
    kind = F.lit(document_type) if isinstance(document_type, str) else document_type
    nothing, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    empty = lambda *names: F.struct(*[nothing.alias(n) for n in names])
    no_map = lambda of: F.from_json(F.lit("{}"), f"map<string,{of}>")
    face = F.struct(F.lit(False).alias("face_detected"), nothing.alias("face_image_path"), F.lit(0.0).alias("confidence"), F.lit(None).cast("struct<x:int,y:int,w:int,h:int>").alias("bounding_box"))
    quality = F.struct(F.lit(100.0).alias("quality_score"), F.lit("SHARP").alias("blur_status"), F.lit(0.0).alias("laplacian_variance"), F.lit(0.0).alias("glare_percentage"), F.lit("0x0").alias("resolution"), F.lit(0.0).alias("deskew_angle_corrected"), none.alias("warnings"))
    verification = _verification(complete=F.lit(0.0), consistent=F.lit(0.0), confidence=F.lit(0.0), level=F.lit("LOW"), comparisons=no_map("string"))
    return F.struct(
        F.lit(MODULE).alias("module"),
        F.lit(MODULE_VERSION).alias("module_version"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        (nothing if request_id is None else request_id).alias("request_id"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        nothing.alias("input_file"),
        nothing.alias("file_hash_sha256"),
        kind.alias("document_type"),
        F.lit("PROCESSED").alias("status"),
        F.lit(False).alias("manual_review_required"),
        none.alias("manual_review_reasons"),
        empty(*IDENTITY).alias("identity"),
        empty("document_number", "date_of_issue", "date_of_expiry", "place_of_birth", "place_of_issue", "issuing_authority").alias("document"),
        no_map("string").alias("additional_information"),
        face.alias("face_extraction"),
        quality.alias("image_quality"),
        verification.alias("verification"),
        no_map("double").alias("field_confidence"),
        none.alias("error_codes"),
    )


def error_record(files: DataFrame, request_id: Column, at: Column) -> DataFrame:
    """The output record of each file that failed its check (``validate_files``): status ERROR, its reason and code; sections are absent."""
    return files.where(F.col("error").isNotNull()).select(
        F.lit(MODULE).alias("module"),
        F.lit(MODULE_VERSION).alias("module_version"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        request_id.alias("request_id"),
        at.alias("timestamp"),
        F.col("path").alias("input_file"),
        F.col("file_hash").alias("file_hash_sha256"),
        F.lit("UNKNOWN").alias("document_type"),
        F.lit("ERROR").alias("status"),
        F.lit(True).alias("manual_review_required"),
        F.array("message").alias("manual_review_reasons"),
        F.array("error").alias("error_codes"),
    )


def with_zone_text(docs: DataFrame, zone: Column | str = "zone_text", raw: str = "raw_text") -> DataFrame:
    """What an image reader read of the zone, appended to the raw text alone; null adds nothing."""
    zone = F.col(zone) if isinstance(zone, str) else zone
    return docs.withColumn(raw, F.when(zone.isNotNull() & (zone != ""), F.concat_ws("\n", raw, zone)).otherwise(F.col(raw)))
