"""DuckDB SQL for the queries over whole screened records: the record rules written apart from the Spark plan they check."""

from __future__ import annotations

from ..operators import extract, score
from .oracles import _TYPED, ORACLES, TEXT, collapse, iso, look_up, q

#: Columns of a record's sections.
IDENTITY = ("full_name", "surname", "given_name", "nationality", "date_of_birth", "gender")
SECTIONS = {
    "PASSPORT": ("document_number", "date_of_issue", "date_of_expiry", "place_of_birth", "place_of_issue"),
    "VISA": ("document_number", "passport_number", "visa_type", "date_of_issue", "date_of_expiry", "valid_from", "valid_until", "number_of_entries", "duration_of_stay", "place_of_birth", "place_of_issue", "issuing_authority"),
    "PERMIT": ("document_number", "permit_type", "date_of_issue", "date_of_expiry", "valid_from", "valid_until", "place_of_birth", "issuing_authority"),
    "TRAVEL_AUTHORIZATION": ("document_number", "passport_number", "authorization_status", "date_of_issue", "date_of_expiry", "place_of_birth", "issuing_authority"),
} | dict.fromkeys(("NATIONAL_ID", "DRIVING_LICENSE", "UNKNOWN"), ("document_number", "date_of_issue", "date_of_expiry", "place_of_birth", "issuing_authority"))
COMPARED = ("passport_number", "surname", "given_name", "nationality", "gender", "date_of_birth", "date_of_expiry")
DOCUMENT = tuple(dict.fromkeys(c for s in SECTIONS.values() for c in s))
FULL_DATE = r"\d{2}[/.\-]\d{2}[/.\-]\d{4}"


def _plain(pattern: str) -> str:
    return q(pattern.replace("(?iu)", "(?i)"))


def _places(pattern: str) -> str:
    """Places (from 1) of the lines that match."""
    return f"list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], {_plain(pattern)}))"


def _caps(line: str, without: tuple[str, ...]) -> str:
    return rf"list_filter(regexp_extract_all({line}, '\b([A-Z]{{3,}})\b', 1), lambda w: w NOT IN ({', '.join(map(q, without))}))"


def _window(i: str, without: tuple[str, ...]) -> str:
    return f"list_filter(list_transform(ls[{i}:{i} + 2], lambda s: {_caps('s', without)}), lambda w: len(w) > 0)[1]"


def _beside(label: str, name: str) -> str:
    """The value after a label, by its English name, else of the line below it."""
    at = f"({_places(label)})[1]"
    after, marks = rf"(?i)(?:{name})[\s/:\-'|]*([A-Z][A-Z\s,.]+?)\s*$", r"^[\"'`|\-\s]+"
    value = f"trim(regexp_extract(ls[{at}], {q(after)}, 1))"
    below = f"list_filter(list_transform(ls[{at} + 1:{at} + 3], lambda s: trim(regexp_replace(s, {q(marks)}, ''))), lambda s: s <> '')[1]"
    return rf"CASE WHEN {at} IS NOT NULL THEN CASE WHEN length({value}) > 2 THEN {collapse(value)} WHEN regexp_matches({below}, '^[A-Z][A-Z\s,.]{{2,}}$') THEN {collapse(below)} END END"


_SEX = r"(?i)\b(?:Sex|Gender|fert)[\s/:\-]*([MFX])\b"
_DAY = "coalesce(try_strptime(regexp_replace({d}, '[.\\-]', '/', 'g'), '%d/%m/%Y'), TIMESTAMP '2099-01-01')"
_SORTED = rf"list_sort(list_transform(regexp_extract_all(t, '\b({FULL_DATE})\b', 1), lambda d, i: {{'day': {_DAY.format(d='d')}, 'at': i, 'raw': d}}))"
_LABELLED = rf"list_filter(list_transform({_places(extract.ISSUE_LABEL)}, lambda i: list_filter(list_transform(ls[i:i + 2], lambda s: regexp_extract(s, '({FULL_DATE})', 1)), lambda d: d <> '')[1]), lambda d: d IS NOT NULL)[1]"

#: The visual zone of passports.
VISUAL = rf"""{_TYPED}, vl AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ls FROM kinds WHERE detected = 'PASSPORT'),
    vd AS (SELECT *, {_SORTED} AS days, {_LABELLED} AS labelled FROM vl),
    visual AS (SELECT doc_id, nullif(regexp_extract(t, '\b([A-Z]\d{{7,8}})\b', 1), '') AS passport_number,
        list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN regexp_matches(ls[i], {_plain(extract.SURNAME_LABEL)}) THEN coalesce(({_window('i', extract.NOT_SURNAME)})[1], CASE WHEN regexp_matches(ls[i], {_plain(extract.GIVEN_LABEL)}) AND i > 1 THEN {_caps('ls[i - 1]', extract.NOT_SURNAME)}[1] END)
            WHEN regexp_matches(ls[i], {_plain(extract.GIVEN_LABEL)}) AND i > 1 THEN {_caps('ls[i - 1]', extract.NOT_SURNAME)}[1] END), lambda s: s IS NOT NULL)[1] AS surname,
        array_to_string(list_filter(list_transform({_places(extract.GIVEN_LABEL)}, lambda i: {_window('i', extract.NOT_GIVEN)}), lambda w: w IS NOT NULL)[1], ' ') AS given_name,
        upper(nullif(regexp_extract(t, {_plain(extract.NATIONALITIES)}, 1), '')) AS nationality,
        CASE WHEN regexp_matches(t, '{_SEX}') THEN upper(regexp_extract(t, '{_SEX}', 1)) WHEN regexp_matches(t, '\b(?:Sex|fert)\b[^\n]*?\bM\b') THEN 'M' WHEN regexp_matches(t, '\b(?:Sex|fert)\b[^\n]*?\bF\b') THEN 'F'
            WHEN regexp_matches(t, '\bF\b') THEN 'F' WHEN regexp_matches(t, '\bM\b') AND NOT regexp_matches(t, '\b(AM|PM|MERA)\b') THEN 'M' END AS gender,
        days[1].raw AS date_of_birth, CASE WHEN labelled IS NOT NULL AND labelled IS DISTINCT FROM days[1].raw THEN labelled WHEN len(days) > 2 THEN days[2].raw END AS date_of_issue,
        CASE WHEN len(days) > 1 THEN days[-1].raw END AS date_of_expiry, {_beside(extract.BIRTHPLACE_LABEL, r"Place\s*of\s*Birth")} AS place_of_birth, {_beside(extract.ISSUEPLACE_LABEL, r"Place\s*of\s*Issue")} AS place_of_issue, t FROM vd)"""


def _four(e: str) -> str:
    return f"CASE WHEN trim({e}) <> '' THEN coalesce(strftime(coalesce(try_strptime(trim({e}), '%Y-%m-%d'), try_strptime(trim({e}), '%d/%m/%Y'), try_strptime(trim({e}), '%d-%m-%Y'), try_strptime(trim({e}), '%d.%m.%Y')), '%Y-%m-%d'), trim({e})) END"


def _gone(e: str) -> str:
    return f"coalesce({e}, '') = ''"


def _long(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda w: length(w) >= 3)"


def _comparison(field: str) -> str:
    """MATCH and the like of the zone's value m_ and the visual zone's v_ with the token stream."""
    m, v = f"m_{field}", f"v_{field}"
    both = f"WHEN {_gone(m)} AND {_gone(v)} THEN 'BOTH_MISSING'"
    if field == "nationality":
        code = lambda e: look_up("compare_code", f"trim(upper({e}))", f"trim(upper({e}))")
        return f"CASE {both} WHEN (NOT {_gone(v)} AND {code(m)} = {code(v)}) OR (NOT {_gone(m)} AND (contains(stream, upper({m})) OR contains(stream, 'INDIAN') OR contains(stream, 'IND'))) THEN 'MATCH' ELSE 'DIFFERENT' END"
    if field.startswith("date"):
        return f"CASE {both} WHEN coalesce({_four(m)} = {_four(v)}, false) OR coalesce(contains(stream, substr({_four(m)}, 1, 4)), false) OR coalesce(trim({m}), 'None') = coalesce(trim({v}), 'None') THEN 'MATCH' WHEN {_gone(v)} THEN 'MISSING_OCR' ELSE 'DIFFERENT' END"
    if field == "gender":
        return f"CASE {both} WHEN (NOT {_gone(v)} AND upper(trim(coalesce({m}, 'None'))) = upper(trim({v}))) OR (NOT {_gone(m)} AND contains(stream, upper({m}))) THEN 'MATCH' WHEN {_gone(v)} THEN 'MISSING_OCR' ELSE 'DIFFERENT' END"
    flat = lambda e: collapse(f"replace(upper(coalesce({e}, '')), '<', ' ')")
    a, b = flat(m), flat(v)
    some = f"(contains({a}, ' ') AND len(list_filter({_long(a)}, lambda w: contains(stream, w))) > 0)"
    return f"""CASE {both} WHEN {_gone(v)} THEN CASE WHEN ({a} <> '' AND contains(stream, {a})) OR {some} THEN 'MATCH' ELSE 'MISSING_OCR' END WHEN {_gone(m)} THEN 'MISSING_MRZ'
        WHEN contains({a}, {b}) OR contains({b}, {a}) OR list_has_any({_long(a)}, {_long(b)}) THEN 'MATCH' ELSE 'DIFFERENT' END"""


def _level(e: str, kind: str) -> str:
    return f"CASE {' '.join(f'WHEN {e} >= {least} THEN {q(name)}' for least, name in score.LEVELS[kind])} ELSE 'LOW' END"


def _record(kind: str, label: str, table: str, fields: dict[str, str]) -> str:
    """Rows of a type other than passport."""
    complete = f"round(n_present / {score.TOTALS[kind]}.0 * 100.0, 2)"
    columns = ", ".join(f"CAST({fields.get(c, 'NULL')} AS VARCHAR) AS {c}" for c in (*IDENTITY, *DOCUMENT))
    nothing = ", ".join(f"CAST(NULL AS VARCHAR) AS c_{c}" for c in COMPARED)
    return f"SELECT doc_id, {q(label)} AS document_type, 'PROCESSED' AS status, {columns}, {nothing}, false AS mrz_available, false AS mrz_valid, {complete} AS complete, {complete} AS confidence, {_level(complete, kind)} AS level FROM {table}"


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_NAMES = _same("full_name", "surname", "given_name", "nationality", "date_of_birth", "date_of_issue", "date_of_expiry", "issuing_authority")
_RESULTS = [f"c_{k}" for k in COMPARED]
_PRESENT = " + ".join(f"CASE WHEN {_gone('r_' + k)} THEN 0 ELSE 1 END" for k in COMPARED)
_MATCHES = " + ".join(f"CAST({c} = 'MATCH' AS INT)" for c in _RESULTS)
_P_FIELDS = _same("surname", "given_name", "nationality") | {
    "full_name": "CASE WHEN r_given_name <> '' AND r_surname <> '' THEN r_given_name || ' ' || r_surname ELSE coalesce(nullif(r_surname, ''), nullif(r_given_name, '')) END",
    "surname": "r_surname", "given_name": "r_given_name", "nationality": "r_nationality", "date_of_birth": iso("r_date_of_birth"), "gender": look_up("gender", "trim(upper(r_gender))", "upper(r_gender)"),
    "document_number": "r_passport_number", "date_of_issue": iso("v_date_of_issue"), "date_of_expiry": iso("r_date_of_expiry"), "place_of_birth": "v_place_of_birth", "place_of_issue": "v_place_of_issue",
}

_KINDS = {"visa": "e_visa", "permit": "e_permit", "travel": "e_travel", "licence": "e_licence", "national_id": "e_national_id"}
_UNKNOWN = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in (*IDENTITY, *DOCUMENT, *_RESULTS))

SCREENED = f"""WITH {', '.join(f"{t} AS ({ORACLES['extract_' + k]})" for k, t in _KINDS.items())}, zone AS ({ORACLES['mrz_full_parse']}),
    truth AS ({TEXT} SELECT doc_id, truth_type, family, birth_iso, number FROM texts), unknown AS ({_TYPED} SELECT doc_id FROM kinds WHERE detected = 'UNKNOWN'),
    eye AS ({VISUAL} SELECT * FROM visual),
    pair AS (SELECT e.doc_id, z.mrz_valid, z.mrz_validation_score AS s, {', '.join(f'z.{k} AS m_{k}, e.{k} AS v_{k}, coalesce(nullif(z.{k}, {q("")}), nullif(e.{k}, {q("")})) AS r_{k}' for k in COMPARED)},
        e.date_of_issue AS v_date_of_issue, e.place_of_birth AS v_place_of_birth, e.place_of_issue AS v_place_of_issue, array_to_string(regexp_extract_all(upper(e.t), '[A-Z0-9]+'), ' ') AS stream FROM eye e JOIN zone z USING (doc_id)),
    compared AS (SELECT *, {', '.join(f'{_comparison(k)} AS c_{k}' for k in COMPARED)} FROM pair),
    scores AS (SELECT *, round(({_PRESENT}) / 7.0 * 100.0, 2) AS complete, round(({_MATCHES}) / 7.0 * 100.0, 2) AS consistent FROM compared),
    summed AS (SELECT *, round(s * 0.5 + complete * 0.25 + consistent * 0.25, 2) AS confidence FROM scores),
    records AS (SELECT doc_id, 'PASSPORT' AS document_type, CASE WHEN mrz_valid THEN 'VERIFIED' ELSE 'PROCESSED' END AS status, {', '.join(f"CAST({_P_FIELDS.get(c, 'NULL')} AS VARCHAR) AS {c}" for c in (*IDENTITY, *DOCUMENT))},
            {', '.join(_RESULTS)}, true AS mrz_available, mrz_valid, complete, confidence, {_level('confidence', 'passport')} AS level FROM summed
        UNION ALL BY NAME {_record('visa', 'VISA', 'e_visa', _NAMES | _same('gender', 'passport_number', 'visa_type', 'number_of_entries', 'duration_of_stay') | {'document_number': 'visa_number', 'valid_from': 'date_of_issue', 'valid_until': 'date_of_expiry', 'place_of_issue': 'issuing_post', 'issuing_authority': 'issuing_post'})}
        UNION ALL BY NAME {_record('permit', 'PERMIT', 'e_permit', _NAMES | _same('permit_type') | {'document_number': 'permit_number', 'valid_from': 'date_of_issue', 'valid_until': 'date_of_expiry'})}
        UNION ALL BY NAME {_record('travel', 'TRAVEL_AUTHORIZATION', 'e_travel', _NAMES | _same('passport_number', 'authorization_status') | {'document_number': 'authorization_number'})}
        UNION ALL BY NAME {_record('licence', 'DRIVING_LICENSE', 'e_licence', _NAMES | _same('gender') | {'document_number': 'license_number', 'nationality': q('IND')})}
        UNION ALL BY NAME {_record('national_id', 'NATIONAL_ID', 'e_national_id', {k: k for k in ('full_name', 'surname', 'given_name', 'nationality', 'date_of_birth', 'gender', 'issuing_authority')} | {'document_number': 'id_number'})}
        UNION ALL BY NAME SELECT doc_id, 'UNKNOWN' AS document_type, 'UNRECOGNIZED_TYPE' AS status, {_UNKNOWN}, false AS mrz_available, false AS mrz_valid, 0.0::DOUBLE AS complete, 20.0::DOUBLE AS confidence, 'LOW' AS level FROM unknown),
    reviewed AS (SELECT *, list_filter([CASE WHEN confidence < 75 THEN 'Overall confidence score is low (' || CAST(CAST(confidence AS DOUBLE) AS VARCHAR) || '%)' END, {', '.join(f"CASE WHEN c_{k} = 'DIFFERENT' THEN 'Cross-check mismatch on field: {k}' END" for k in COMPARED)},
        CASE WHEN mrz_available AND NOT coalesce(mrz_valid, false) THEN 'MRZ check digit checksum validation failed' END, CASE WHEN {_gone('full_name')} THEN 'Primary identity full_name could not be extracted' END,
        CASE WHEN {_gone('document_number')} THEN 'Primary document_number could not be extracted' END], lambda r: r IS NOT NULL) AS reasons FROM records)"""


def _confidence(label: str) -> str:
    """[field, confidence] of each field of a type's record."""
    out = []
    for k in IDENTITY:
        base = "85.0" if k not in COMPARED else f"CASE c_{k} WHEN 'MATCH' THEN 100.0 WHEN 'DIFFERENT' THEN 40.0 WHEN 'MISSING_OCR' THEN CASE WHEN mrz_valid THEN 75.0 ELSE 50.0 END ELSE 85.0 END"
        out.append((k, base))
    for k in SECTIONS[label]:
        base = "80.0"
        if k in ("document_number", "passport_number"):
            base = "CASE WHEN coalesce(mrz_valid, false) THEN 100.0 WHEN c_passport_number = 'MATCH' THEN 95.0 WHEN c_passport_number = 'DIFFERENT' THEN 40.0 ELSE 80.0 END"
        elif k == "date_of_expiry":
            base = "CASE c_date_of_expiry WHEN 'MATCH' THEN 95.0 WHEN 'DIFFERENT' THEN 45.0 ELSE 80.0 END"
        out.append((k, base))
    return "[" + ", ".join(f"{{'field': {q(k)}, 'confidence': CAST(CASE WHEN {k} IS NULL OR trim({k}) IN ('N/A', 'None', '') THEN 0.0 ELSE {base} END AS DOUBLE)}}" for k, base in out) + "]"


_FIELDS = "CASE document_type " + " ".join(f"WHEN {q(k)} THEN {_confidence(k)}" for k in SECTIONS) + " END"

#: Documents with their true fields: surname, date of birth and number.
_EVAL = f"""{SCREENED}, joined AS (SELECT t.*, r.* EXCLUDE (doc_id), len(r.reasons) > 0 AS review FROM truth t JOIN reviewed r USING (doc_id) WHERE truth_type <> 'UNKNOWN'),
    fields AS (SELECT doc_id, unnest([{{'p': nullif(surname, ''), 'g': family}}, {{'p': nullif(date_of_birth, ''), 'g': birth_iso}}, {{'p': nullif(document_number, ''), 'g': replace(number, '<', '')}}]) AS f FROM joined),
    errors AS (SELECT doc_id, upper(trim(coalesce(f.p, 'NONE'))) = upper(trim(f.g)) AS good, least(100.0, round(levenshtein(trim(upper(coalesce(f.p, ''))), trim(upper(f.g))) / length(trim(f.g)) * 100.0, 2)) AS cer FROM fields),
    sums AS (SELECT doc_id, count(*) AS n, sum(CAST(good AS INT)) AS good, sum(cer) AS cer FROM errors GROUP BY 1),
    done AS (SELECT j.doc_id AS filename, CASE WHEN j.doc_id % 50 <> 0 THEN document_type END AS document_type, replace(truth_type, 'TRAVEL_AUTH', 'TRAVEL_AUTHORIZATION') AS true_type, n, good, cer, review, (j.doc_id % 100)::DOUBLE AS ms FROM joined j JOIN sums USING (doc_id)),
    named AS (SELECT *, coalesce(document_type = true_type, false) AS correct FROM done)"""

SCREENING: dict[str, str] = {
    "extract_passport_visual": f"{VISUAL} SELECT * EXCLUDE (t) FROM visual",
    "line_state_machine": rf"""{TEXT}, ls AS (SELECT doc_id, list_filter(list_transform(string_split(raw_text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ls FROM texts),
        marks AS (SELECT *, list_transform(ls, lambda s: starts_with(s, 'VTC') OR starts_with(s, 'Sex')) AS starts, list_transform(ls, lambda s: regexp_matches(s, 'PIN|Birth')) AS stops FROM ls),
        each AS (SELECT doc_id, list_filter(range(1, len(ls) + 1), lambda i: NOT starts_with(ls[i], 'Mobile') AND len(list_filter(range(1, i + 1), lambda a: starts[a] AND NOT list_contains(stops[a:i - 1], true))) > 0) AS held, ls FROM marks)
        SELECT doc_id, CASE WHEN len(held) > 0 THEN array_to_string(list_transform(held[1:5], lambda i: ls[i]), ', ') END AS stretch FROM each""",
    "compare_live": f"{SCREENED}, long AS (SELECT unnest([{', '.join(f'{{{q("field")}: {q(k)}, {q("result")}: c_{k}}}' for k in COMPARED)}]) AS x FROM reviewed WHERE mrz_available) SELECT x.field AS field, x.result AS result, count(*) AS n FROM long GROUP BY ALL",
    "completeness_by_type": f"{SCREENED} SELECT document_type, complete AS score, level, count(*) AS n FROM reviewed GROUP BY ALL",
    "field_confidence_long": f"{SCREENED}, long AS (SELECT document_type, unnest({_FIELDS}) AS x FROM reviewed) SELECT document_type, x.field AS field, count(*) AS n, round(avg(x.confidence), 2) AS avg_confidence FROM long GROUP BY ALL",
    "manual_review_reasons": f"{SCREENED}, long AS (SELECT document_type, unnest(reasons) AS reason FROM reviewed) SELECT document_type, reason, count(*) AS n FROM long GROUP BY ALL",
    "review_rate_by_type": f"{SCREENED} SELECT truth_type, count(*) AS n, sum(CAST(len(reasons) > 0 AS INT))::BIGINT AS reviews FROM reviewed JOIN truth USING (doc_id) GROUP BY ALL",
    "ingest_records": f"""{SCREENED}, raws AS ({TEXT} SELECT doc_id, raw_text FROM texts), files AS (SELECT doc_id, raw_text, unnest(CASE WHEN doc_id % 10 = 9 THEN ['.png', '_again.png'] ELSE ['.png'] END) AS ending FROM raws)
        SELECT DISTINCT sha256(unhex('89504E470D0A1A0A') || encode(files.raw_text)) AS name, document_type, status, len(reasons) > 0 AS manual_review_required, '' AS code FROM files JOIN reviewed USING (doc_id) WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0
        UNION ALL SELECT '/inbox/' || doc_id || ending, 'UNKNOWN', 'ERROR', true, CASE WHEN doc_id % 17 = 0 THEN 'ERR_EMPTY_FILE' ELSE 'ERR_MALICIOUS_PAYLOAD' END FROM files WHERE doc_id % 13 = 0 OR doc_id % 17 = 0""",
    "eval_report": f"""{_EVAL}, corpus AS (SELECT count(*) AS total_documents_tested, round(sum(CAST(correct AS INT)) / count(*) * 100.0, 2) AS classification_accuracy_pct, round(sum(good) / sum(n) * 100.0, 2) AS field_accuracy_pct, round(sum(cer) / sum(n), 2) AS average_cer_pct, CAST(count(*) AS INT) AS n_documents,
            md5(string_agg(concat_ws(':', CAST(filename AS VARCHAR), document_type, CAST(good AS VARCHAR), CAST(n AS VARCHAR)), ',' ORDER BY filename)) AS documents FROM named) SELECT * FROM corpus""",
    "screening_summary": f"{SCREENED} SELECT document_type, level AS confidence_level, count(*) AS n, round(avg(confidence), 4) AS avg_confidence, round(avg(CAST(len(reasons) > 0 AS INT)), 4) AS review_rate, sum(CAST(status = 'VERIFIED' AS INT))::BIGINT AS verified FROM reviewed GROUP BY ALL",
    "eval_document": f"{_EVAL} SELECT filename, document_type, correct AS classification_correct, n AS fields_evaluated, good::BIGINT AS fields_correct, round(good / n * 100.0, 2) AS field_accuracy_pct, round(cer / n, 2) AS average_cer_pct FROM named",
    "eval_corpus": f"""{_EVAL} SELECT count(*) AS total_documents_tested, round(sum(CAST(correct AS INT)) / count(*) * 100.0, 2) AS classification_accuracy_pct, round(sum(good) / sum(n) * 100.0, 2) AS field_accuracy_pct, round(sum(cer) / sum(n), 2) AS average_cer_pct,
        round(sum(ms) / count(*), 2) AS average_latency_ms, round(sum(CAST(review AS INT)) / count(*) * 100.0, 2) AS manual_review_rate_pct, count(document_type) AS evaluated_documents, round(sum(CAST(correct AS INT)) / greatest(1, count(document_type)) * 100.0, 2) AS evaluated_accuracy_pct FROM named""",
}
