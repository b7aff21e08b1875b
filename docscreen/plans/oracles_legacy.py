"""DuckDB SQL for the older extractors, the output records, readers and rules that no other query checks."""

from __future__ import annotations

from ..operators import legacy
from .oracles import _TITLED, _TYPED, _VALID, BOXES, MRZ, ORACLES, STATS, TEXT, classified, first, iso, look_up, normalized, q
from .oracles_screening import SCREENED

_CLEANED = r"trim(regexp_replace(regexp_replace(raw_text, '[ \t]+', ' ', 'g'), '\n+', chr(10), 'g'), ' ' || chr(10))"
_ENGINE = f"{TEXT}, cleaned AS (SELECT doc_id, {_CLEANED} AS t FROM texts), engine AS (SELECT doc_id, t, {classified('upper(t)', 'legacy_engine')} AS engine_type FROM cleaned)"


def _field(label: str, name: str, patterns: list[str]) -> str:
    value = first("t", patterns)
    return f"translate({value}, '.-', '//')" if name in legacy.SLASHED.get(label, ()) else value


def _fields(label: str) -> str:
    """[field, value] of each field of a type."""
    values = {n: _field(label, n, p) for n, p in legacy.PATTERNS[label].items()}
    if label == "National ID":
        values["gender"] = r"CASE WHEN regexp_matches(upper(t), '\bMALE\b') THEN 'M' WHEN regexp_matches(upper(t), '\bFEMALE\b') THEN 'F' END"
    return "[" + ", ".join(f"{{'field': {q(n)}, 'value': {v}}}" for n, v in values.items()) + "]"


_LABELS = " ".join(f"WHEN {q(k)} THEN {_fields(k)}" for k in legacy.PATTERNS)
_EXTRACTED = f"{_ENGINE}, found AS (SELECT doc_id, engine_type, CASE engine_type {_LABELS} ELSE [{{'field': 'message', 'value': {q(legacy.UNKNOWN_MESSAGE)}}}, {{'field': 'raw_detected_text', 'value': substr(t, 1, 1000)}}] END AS x FROM engine)"
_SHARES = " ".join(f"WHEN {q(k)} THEN round(len(list_filter(x, lambda f: f.field IN ({', '.join(map(q, names))}) AND trim(coalesce(f.value, '')) <> '')) / {len(names)}.0 * 100.0, 2)" for k, names in legacy.COMPLETE.items())


def _month(e: str) -> str:
    part = lambda k: f"regexp_extract(upper({e}), '(\\d{{1,2}})\\s+([A-Z]{{3}})\\s+(\\d{{2,4}})', {k})"
    year = f"CASE WHEN length({part(3)}) = 2 THEN CASE WHEN CAST({part(3)} AS INT) >= 30 THEN '19' ELSE '20' END || {part(3)} ELSE {part(3)} END"
    return f"CASE WHEN regexp_matches(upper({e}), '(\\d{{1,2}})\\s+([A-Z]{{3}})\\s+(\\d{{2,4}})') THEN lpad({part(1)}, 2, '0') || '/' || {look_up('month', part(2))} || '/' || ({year}) END"


_LINE = f"{TEXT}, line AS (SELECT doc_id, regexp_replace(raw_text, '\\s+', ' ', 'g') AS t FROM texts)"
_NATION = " ".join(f"WHEN regexp_matches(t, {q('(?i)' + p)}) THEN {q(n)}" for p, n in legacy.LINE_NATIONS)
_NUMBER = "lpad(doc_id::VARCHAR, 12, '7')"


LEGACY: dict[str, str] = {
    "legacy_engine_fields": f"{_EXTRACTED}, long AS (SELECT doc_id, engine_type, unnest(x) AS f FROM found) SELECT doc_id, engine_type, f.field AS field, f.value AS value FROM long",
    "legacy_engine_scores": f"{_EXTRACTED} SELECT doc_id, round(len(list_filter(x, lambda f: coalesce(f.value, '') <> '')) / len(x) * 100.0, 2) AS confidence, CASE upper(engine_type) {_SHARES} ELSE 0.0 END::DOUBLE AS completeness FROM found",
    "legacy_engine_records": f"{_ENGINE} SELECT doc_id, engine_type AS document_type, 'OCR_COMPLETED' AS status, '/in/' || truth_type AS input_file, CAST(NULL AS VARCHAR) AS image_width, 'Tesseract' AS ocr_engine, 'Morphological Processing' AS last_step, '4' AS passes, md5(t) AS text FROM engine JOIN texts USING (doc_id)",
    "record_template": f"{_TYPED} SELECT DISTINCT detected AS detected_type, detected AS document_type, 'PROCESSED' AS status, false AS manual_review_required, 0 AS n_reasons, CAST(NULL AS VARCHAR) AS full_name, CAST(NULL AS VARCHAR) AS document_number, false AS face_detected, 100.0::DOUBLE AS quality_score, 'SHARP' AS blur_status, '0x0' AS resolution, 'LOW' AS confidence_level, 0 AS n_comparisons, 0 AS n_fields FROM kinds",
    "legacy_passport_line": f"""{_LINE} SELECT doc_id, upper({first("t", legacy.LINE_NUMBER)}) AS passport_number, upper({first("t", legacy.LINE_SURNAME)}) AS surname, upper({first("t", legacy.LINE_GIVEN)}) AS given_name, CASE {_NATION} END AS nationality,
        CASE WHEN {first("t", legacy.LINE_BIRTH)} IS NOT NULL THEN {_month("(" + first("t", legacy.LINE_BIRTH) + ")")} ELSE nullif(regexp_extract(t, '\\b(\\d{{2}}/\\d{{2}}/\\d{{4}})\\b', 1), '') END AS date_of_birth, upper({first("t", legacy.LINE_SEX)}) AS gender,
        upper({first("t", legacy.LINE_BIRTHPLACE)}) AS place_of_birth, CASE WHEN regexp_matches(t, '(?i){legacy.LINE_CITY}') THEN {q(legacy.LINE_CITY)} END AS place_of_issue, CAST(NULL AS VARCHAR) AS date_of_issue, {_month("(" + first("t", legacy.LINE_EXPIRY) + ")")} AS date_of_expiry FROM line""",
    "legacy_text": f"""{TEXT}, c AS (SELECT doc_id, given1, family, CASE WHEN corruption % 2 = 0 THEN '  ' ELSE given2 END AS middle, replace(raw_text, chr(10), ' ' || chr(10) || chr(10) || chr(9)) AS crlf, raw_text FROM texts)
        SELECT doc_id, array_to_string(list_filter([given1, middle, family], lambda x: trim(x) <> ''), ' ') AS name, nullif(trim(middle), '') AS safe, md5(trim(regexp_replace(regexp_replace(crlf, '[ \\t]+', ' ', 'g'), '\\n+', chr(10), 'g'), ' ' || chr(10))) AS cleaned, substr(raw_text, 1, 30) AS snippet FROM c""",
    "consistency_checks": f"""{TEXT}, o AS (SELECT *, CASE WHEN corruption < 3 THEN 1 WHEN corruption < 5 THEN 0 ELSE CAST(given1 = family AS INT) END + CAST(corruption < 4 OR issue_iso = birth_iso AS INT) AS good, CASE WHEN corruption IN (3, 4) THEN 1 ELSE 2 END AS known FROM texts)
        SELECT doc_id, CASE WHEN corruption < 6 THEN true END AS passport_number_match, {look_up('consistency_code', 'nation', 'nation')} = {look_up('consistency_code', 'code', 'code')} AS nationality_match, CASE WHEN sex <> '<' THEN true END AS gender_match,
            round(good / known * 100.0, 2) AS consistency, CASE corruption % 4 WHEN 0 THEN 'TD3' WHEN 1 THEN 'TD3' WHEN 2 THEN 'TD2' ELSE 'V' END AS mrz_type FROM o""",
    "json_variants": f"""{TEXT} SELECT doc_id, x.k AS key, x.f AS field, CASE WHEN corruption < 3 THEN 2024.0::DOUBLE WHEN corruption < 5 THEN 1.5::DOUBLE END AS year FROM (SELECT doc_id, corruption, unnest(CASE
        WHEN corruption < 3 THEN [{{'k': 'surname', 'f': '"' || family || '"'}}, {{'k': 'year', 'f': '2024'}}, {{'k': 'tags', 'f': '["a",1]'}}]
        WHEN corruption < 5 THEN [{{'k': 'surname', 'f': '"' || family || '"'}}, {{'k': 'year', 'f': '1.5'}}]
        WHEN corruption = 5 THEN [{{'k': 'extracted_data', 'f': '"none"'}}, {{'k': 'year', 'f': '"n/a"'}}] END) AS x FROM texts)""",
    "json_access": f"{TEXT} SELECT doc_id, CASE WHEN corruption < 6 THEN family END AS surname, CASE WHEN corruption < 5 THEN 1 WHEN corruption = 5 THEN 2 ELSE 0 END AS n_fields, 'n=2,' || CASE WHEN corruption % 2 = 0 THEN 'place=' || city || ',' ELSE '' END || 'surname=' || family AS flat FROM texts",
    "final_records": f"""{SCREENED}, raw AS ({TEXT} SELECT doc_id, truth_type, raw_text, {normalized()} AS t FROM texts)
        SELECT 'MODULE_1_OCR_EXTRACTION' AS module, '1.0.0' AS module_version, '2026.1' AS schema_version, doc_id::VARCHAR AS request_id, '/in/' || raw.truth_type AS input_file, sha256(raw_text) AS file_hash_sha256, document_type, status, len(reasons) > 0 AS manual_review_required,
            full_name, document_number, md5(substr(raw.t, 1, 1000)) AS snippet, CASE WHEN len(reasons) > 0 THEN 'E009' ELSE '' END AS codes FROM reviewed JOIN raw USING (doc_id)""",
    "error_records": f"""WITH v AS ({ORACLES['validate_files']}), f AS ({_VALID} SELECT id, path FROM e) SELECT id::VARCHAR AS request_id, path AS input_file, 'UNKNOWN' AS document_type, 'ERROR' AS status, true AS manual_review_required, message AS reasons, error AS codes FROM v JOIN f USING (id) WHERE error IS NOT NULL""",
    "summary_view": f"""{SCREENED} SELECT document_type, status, CASE WHEN confidence >= 80 THEN 'good' WHEN confidence >= 50 THEN 'fair' ELSE 'poor' END AS bar, CASE WHEN len(reasons) > 0 THEN 'review' ELSE 'ok' END AS decision, count(*) AS n, max(document_number) AS last_number FROM reviewed GROUP BY ALL""",
    "mask_nested": f"{TEXT} SELECT doc_id, 'XXXX-XXXX-' || right({_NUMBER}, 4) || ':' || family || ',XXXX-XXXX-XXXX-1234:x' AS holders, 'XXXX-XXXX-XXXX-1234' AS vid, city FROM texts",
    "mrz_reader_records": f"""{MRZ}, r AS (SELECT *, CASE WHEN corruption <> 2 THEN birth ELSE 'x' END AS b FROM mrz), d AS (SELECT *, corruption <> 7 AS has FROM r)
        SELECT doc_id, CASE WHEN has THEN 'Passport' END AS document_type, CASE WHEN has THEN CASE WHEN corruption < 4 THEN 'TD3' ELSE 'TD2' END END AS mrz_type, CASE WHEN has THEN rtrim(number, '<') END AS passport_number, CASE WHEN has THEN family END AS surname, CASE WHEN has THEN given1 || ' ' || given2 END AS given_name,
            CASE WHEN has THEN CASE code WHEN 'IND' THEN 'INDIAN' ELSE code END END AS nationality, CASE WHEN has THEN code END AS nationality_code, CASE WHEN has THEN b END AS date_of_birth, CASE WHEN has AND b <> 'x' THEN bd || '/' || bm || '/19' || yb END AS date_of_birth_formatted, CASE WHEN has THEN nullif(sex, '<') END AS gender,
            CASE WHEN has THEN expiry END AS date_of_expiry, CASE WHEN has THEN ed || '/' || em || '/' || CASE WHEN CAST(substr(expiry, 1, 2) AS INT) >= 50 THEN '19' ELSE '20' END || substr(expiry, 1, 2) END AS date_of_expiry_formatted,
            CASE WHEN has THEN 90.0::DOUBLE END AS mrz_valid_score, CASE WHEN has THEN corruption <> 3 END AS valid_passport_number, CASE WHEN has THEN true END AS valid_date_of_birth, CASE WHEN has THEN true END AS valid_date_of_expiry FROM d""",
    "national_id_fallbacks": rf"""{_TYPED}, ls AS (SELECT doc_id, corruption, list_filter(string_split(t, chr(10)), lambda s: NOT starts_with(s, 'S/O')) AS ls FROM kinds WHERE truth_type = 'NATIONAL_ID' AND corruption < 4),
        b AS (SELECT *, list_position(list_transform(ls, lambda s: starts_with(s, 'DOB')), true) AS dob FROM ls)
        SELECT doc_id, CASE WHEN corruption % 2 = 1 THEN list_filter(list_reverse(ls[greatest(dob - 3, 1):dob - 1]), lambda s: {_TITLED})[1] ELSE list_filter(ls, lambda s: {_TITLED} AND length(s) > 5 AND NOT regexp_matches(s, '\b(India|Aadhaar|Authority|Identification|Government|Verification|citizenship|scanning)\b'))[1] END AS full_name,
            CASE WHEN corruption % 2 = 1 THEN {iso("replace(ls[dob], 'DOB: ', '')")} END AS date_of_birth FROM b""",
    "face_backends": f"""{BOXES}, b AS (SELECT *, CASE WHEN pos % 3 = 0 THEN 'mtcnn' WHEN pos % 2 = 0 THEN 'retinaface' ELSE 'fallback_full_image' END AS backend FROM boxes), c AS (SELECT *, backend = 'fallback_full_image' OR w <= 0 OR h <= 0 AS whole FROM b)
        SELECT image_id, pos, CASE WHEN whole THEN 0 ELSE x END AS x, CASE WHEN whole THEN 0 ELSE y END AS y, CASE WHEN whole THEN img_w ELSE w END AS w, CASE WHEN whole THEN img_h ELSE h END AS h, backend, w >= 60 AND h >= 60 AS large FROM c""",
    "skew_rules": f"""{STATS}, a AS (SELECT id, laplacian, brightness * 0.7::DOUBLE - 90.0 AS r FROM stats), n AS (SELECT id, laplacian, CASE WHEN r < -45 THEN -(r + 90) WHEN r > 45 THEN -(r - 90) ELSE -r END AS angle FROM a)
        SELECT id, CASE WHEN laplacian < 100 OR abs(angle) < 0.5 OR abs(angle) > 30 THEN 0.0 ELSE round(angle, 2) END AS angle FROM n""",
}
