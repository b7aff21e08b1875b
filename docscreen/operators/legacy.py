"""The older extractors: labelled fields by document type, and their scores.

``PATTERNS`` is the rule table, as in ``extract``; a field's value is group 1 of its first
pattern that matches, whatever the case. Each document's fields are a map from field to
value, in which what wasn't found is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_date, slashes
from ..functions.text import blank_to_null, clean_engine_text, col, find_first, once, present, snippet
from .classify import classify

#: Parts of the patterns below.
_NAME = r"Name\s*[:\-]?\s*([A-Z][A-Z ]+)"
_SURNAME = r"Surname\s*[:\-]?\s*([A-Z][A-Z ]+)"
_GIVEN = r"Given\s*Name[s]?\s*[:\-]?\s*([A-Z][A-Z ]+)"
_NATION = r"Nationality\s*[:\-]?\s*([A-Z]{3,})"
_SEX = r"Sex\s*[:\-]?\s*([MF])"
_DAY = r"\s*[:\-]?\s*(\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4})"

#: Fixed values, in order of trial.
PATTERNS: dict[str, dict[str, list[str]]] = {
    "Passport": {
        "passport_number": [r"Passport\s*(?:No|Number)\s*[:\-]?\s*([A-Z0-9]{6,12})", r"Passport\s*[:\-]?\s*([A-Z0-9]{6,12})"],
        "surname": [_SURNAME],
        "given_name": [_GIVEN],
        "nationality": [_NATION],
        "date_of_birth": [r"Date\s*of\s*Birth" + _DAY],
        "gender": [_SEX],
        "date_of_issue": [r"Date\s*of\s*Issue" + _DAY],
        "date_of_expiry": [r"Date\s*of\s*Expiry" + _DAY],
        "place_of_birth": [r"Place\s*of\s*Birth\s*[:\-]?\s*([A-Z][A-Z ]+)"],
        "place_of_issue": [r"Place\s*of\s*Issue\s*[:\-]?\s*([A-Z][A-Z ]+)"],
    },
    "Visa": {
        "issuing_post": [r"Issuing\s*Post\s*Name\s*[:\-]?\s*([A-Z][A-Z ]+)"],
        "surname": [_SURNAME],
        "given_name": [_GIVEN],
        "passport_number": [r"Passport\s*Number\s*[:\-]?\s*([A-Z0-9]+)", r"Passport\s*No\s*[:\-]?\s*([A-Z0-9]+)"],
        "visa_type": [r"Visa\s*Type\s*[/]?\s*Class\s*[:\-]?\s*([A-Z0-9]+)", r"Visa\s*Type\s*[:\-]?\s*([A-Z0-9]+)"],
        "nationality": [_NATION],
        "sex": [_SEX],
        "birth_date": [r"Birth\s*Date\s*[:\-]?\s*([0-9A-Z]+)"],
        "issue_date": [r"Issue\s*Date\s*[:\-]?\s*([0-9A-Z]+)"],
        "expiration_date": [r"Expiration\s*Date\s*[:\-]?\s*([0-9A-Z]+)", r"Expiry\s*Date\s*[:\-]?\s*([0-9A-Z]+)"],
    },
    "National ID": {"id_number": [r"\b(\d{4}\s?\d{4}\s?\d{4})\b"], "full_name": [_NAME]},
    "Driving Licence": {
        "licence_number": [r"(?:DL|Licence|License)\s*(?:No|Number)?\s*[:\-]?\s*([A-Z0-9\-]+)"],
        "name": [_NAME],
        "date_of_birth": [r"Date\s*of\s*Birth" + _DAY],
        "expiry_date": [r"Validity" + _DAY],
    },
    "Permit": {"permit_number": [r"Permit\s*(?:No|Number)?\s*[:\-]?\s*([A-Z0-9\-]+)"], "name": [_NAME]},
}
#: Fields whose dates are written with slashes; those of visas stay as they are.
SLASHED = {"Passport": ("date_of_birth", "date_of_issue", "date_of_expiry"), "Driving Licence": ("date_of_birth", "expiry_date")}
UNKNOWN_MESSAGE = "Document type could not be detected"
#: The fields that count for completeness, by type. The licence's number is looked for by another name than the engine gives it.
COMPLETE = {
    "PASSPORT": ("passport_number", "surname", "given_name", "nationality", "date_of_birth", "gender", "date_of_expiry"),
    "VISA": ("passport_number", "surname", "given_name", "visa_number", "visa_type", "date_of_expiry"),
    "NATIONAL ID": ("id_number", "full_name", "date_of_birth", "gender"),
    "DRIVING LICENCE": ("license_number", "full_name", "date_of_birth"),
    "PERMIT": ("permit_number",),
}


def engine_fields(text: Column, label: str) -> Column:
    """Map of a type's fields, from an engine's cleaned text."""
    if label not in PATTERNS:
        return F.create_map(F.lit("message"), F.lit(UNKNOWN_MESSAGE), F.lit("raw_detected_text"), snippet(text, 1000))
    values = {}
    for name, patterns in PATTERNS[label].items():
        found = find_first(text, patterns)
        values[name] = slashes(found) if name in SLASHED.get(label, ()) else found
    if label == "National ID":
        upper = F.upper(text)
        values["gender"] = F.when(upper.rlike(r"\bMALE\b"), "M").when(upper.rlike(r"\bFEMALE\b"), "F")
    return F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value)])


def extract_engine(docs: DataFrame, raw: str = "raw_text") -> DataFrame:
    """docs with engine_type and extracted (map), by the engine's own classifier and rules."""
    docs = docs.withColumn("engine_text", F.coalesce(clean_engine_text(raw), F.lit("")))
    docs = docs.withColumn("engine_type", classify("engine_text", "legacy_engine"))
    of = lambda label: once(F.col("engine_text"), lambda t: engine_fields(t, label))
    out = F
    for label in PATTERNS:
        out = out.when(F.col("engine_type") == label, of(label))
    return docs.withColumn("extracted", out.otherwise(engine_fields(F.col("engine_text"), "Unknown"))).drop("engine_text")


#: Fixed values of the engine's record.
ENGINE, ENGINE_STATUS, ENGINE_PASSES = "Tesseract", "OCR_COMPLETED", 4
PREPROCESSING = ("Grayscale", "2x Resize", "Gaussian Blur", "Otsu Threshold", "Adaptive Threshold", "Morphological Processing")


def engine_record(docs: DataFrame, at: Column, raw: str = "raw_text") -> DataFrame:
    """docs with record: what the engine writes of a document. input_file, image_width and image_height are taken from docs if they are there."""
    docs = extract_engine(docs, raw)
    own = lambda name, kind: (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)
    metadata = F.struct(
        at.alias("processed_at"),
        own("input_file", "string"),
        own("image_width", "int"),
        own("image_height", "int"),
        F.lit(ENGINE).alias("ocr_engine"),
        F.array(*map(F.lit, PREPROCESSING)).alias("preprocessing"),
        F.lit(ENGINE_PASSES).alias("ocr_passes"),
        engine_confidence("extracted").alias("confidence"),
    )
    record = F.struct(
        F.col("engine_type").alias("document_type"),
        F.lit(ENGINE_STATUS).alias("status"),
        metadata.alias("metadata"),
        F.col(raw).alias("raw_text"),
        clean_engine_text(raw).alias("normalized_text"),
        F.col("extracted").alias("extracted_data"),
    )
    return docs.withColumn("record", record)


def engine_confidence(extracted: Column | str) -> Column:
    """Percentage of fields with a value; 0 without any field. The message of an unknown type and its text count as fields."""
    values = F.map_values(col(extracted))
    found = F.size(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.round(found / F.size(values) * 100.0, 2)).otherwise(0.0)


def engine_completeness(extracted: Column | str, document_type: Column | str) -> Column:
    """Percentage of a type's fields that hold more than blanks; 0 for other types."""
    fields, kind, out = col(extracted), F.upper(col(document_type)), F
    for label, names in COMPLETE.items():
        found = sum((F.when(blank_to_null(F.try_element_at(fields, F.lit(n))).isNotNull(), 1).otherwise(0) for n in names[1:]), F.when(blank_to_null(F.try_element_at(fields, F.lit(names[0]))).isNotNull(), 1).otherwise(0))
        out = out.when(kind == label, F.round(found / len(names) * 100.0, 2))
    return out.otherwise(0.0)


#: Labels and patterns of the one-line passport text.
LINE_NUMBER = [r"Passport number.*?\b([A-Z]{1,3}\d{6,9})\b", r"\b([A-Z]\d{7,9})\b", r"\b(\d{8,9})\b"]
LINE_SURNAME = [r"Surname.*?\b([A-ZÆØÅÖÄÜÉÑ\-]{3,})\b"]
LINE_GIVEN = [r"(?:First and middle names|Given names).*?\b([A-ZÆØÅÖÄÜÉÑ\-]{3,}(?:\s+[A-ZÆØÅÖÄÜÉÑ\-]{2,})*)\b"]
LINE_NATIONS = (("NORSK|NORWEGIAN", "NORWEGIAN"), ("INDIAN|INOIAN|IND1AN|INDlAN", "INDIAN"))
LINE_SEX = [r"\bSex\b.*?\b([MF])\b"]
LINE_BIRTH = [r"(?:Date of birth).*?(\d{1,2}\s+[A-Z]{3}(?:\s*/?[A-Z]{3})?\s+\d{2,4})"]
LINE_EXPIRY = [r"(?:Date of expiry).*?(\d{1,2}\s+[A-Z]{3}\s+\d{2,4})"]
LINE_BIRTHPLACE = [r"(?:Place of birth).*?\b([A-Z]{2,})\b"]
LINE_CITY = "HYDERABAD"


def passport_line(text: Column | str) -> Column:
    """Struct of the fields of a passport's text, read as one line."""

    def fields(t: Column) -> Column:
        nation = F
        for pattern, name in LINE_NATIONS:
            nation = nation.when(t.rlike(f"(?i){pattern}"), name)
        first = lambda patterns: find_first(t, patterns)
        day = F.nullif(F.regexp_extract(t, r"\b(\d{2}/\d{2}/\d{4})\b", 1), F.lit(""))
        return F.struct(
            F.upper(first(LINE_NUMBER)).alias("passport_number"),
            F.upper(first(LINE_SURNAME)).alias("surname"),
            F.upper(first(LINE_GIVEN)).alias("given_name"),
            nation.otherwise(None).alias("nationality"),
            F.when(first(LINE_BIRTH).isNotNull(), month_date(first(LINE_BIRTH))).otherwise(day).alias("date_of_birth"),
            F.upper(first(LINE_SEX)).alias("gender"),
            F.upper(first(LINE_BIRTHPLACE)).alias("place_of_birth"),
            F.when(t.rlike(f"(?i){LINE_CITY}"), LINE_CITY).alias("place_of_issue"),
            F.lit(None).cast("string").alias("date_of_issue"),
            month_date(first(LINE_EXPIRY)).alias("date_of_expiry"),
        )

    return once(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "), fields)


def nested_or_flat(json: Column | str) -> Column:
    """Map of the fields of a JSON object: those of its extracted_data if that is an object, else its own; empty without an object."""
    json = col(json)
    inner = F.get_json_object(json, "$.extracted_data")
    chosen = F.when(F.startswith(F.trim(inner), F.lit("{")), inner).otherwise(json)
    return F.coalesce(F.from_json(chosen, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def flatten(*sections: Column | str) -> Column:
    """Map of the values of structs, later ones first where names repeat; missing values are left out."""
    out = None
    for s in reversed(sections):
        fields = F.from_json(F.to_json(col(s)), "map<string,string>")
        out = _beside(out, F.map_filter(fields, lambda k, v: present(v)))
    return out


def _beside(have: Column | None, more: Column) -> Column:
    """A map and the entries of another whose keys it lacks."""
    return more if have is None else F.map_concat(have, F.map_filter(more, lambda k, v: ~F.map_contains_key(have, k)))
