"""DuckDB SQL for the catalogue, written apart from the Spark plans it checks.

Only the fixtures' definitions and the fixed rule tables (patterns, dictionaries) are shared.
"""

from __future__ import annotations


from ..functions.lookup import DICTIONARIES
from ..operators import classify, extract, validate
from . import fixtures
from .fixtures import duck

TEXT, MRZ, DATES, FILES, BOXES, FRAMES, STATS = (duck(s) for s in (fixtures.TEXT, fixtures.MRZ, fixtures.DATES, fixtures.FILES, fixtures.BOXES, fixtures.FRAMES, fixtures.STATS))
V = fixtures.VALUES

EXTRACTED = {
    "visa": ("visa_number", "visa_type", "issuing_post", "passport_number", "surname", "given_name", "full_name", "nationality", "gender", "date_of_birth", "date_of_issue", "date_of_expiry", "number_of_entries", "duration_of_stay", "n_present"),
    "permit": ("permit_number", "permit_type", "full_name", "surname", "given_name", "nationality", "date_of_birth", "date_of_issue", "date_of_expiry", "issuing_authority", "n_present"),
    "travel": ("authorization_number", "authorization_status", "full_name", "surname", "given_name", "passport_number", "nationality", "date_of_birth", "date_of_issue", "date_of_expiry", "issuing_authority", "n_present"),
    "licence": ("license_number", "full_name", "surname", "given_name", "date_of_birth", "date_of_issue", "date_of_expiry", "blood_group", "guardian_name", "address", "issuing_authority", "gender", "n_present"),
    "national_id": ("id_number", "full_name", "surname", "given_name", "nationality", "date_of_birth", "gender", "guardian_name", "address", "vid", "id_type", "issuing_authority", "n_present"),
}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def collapse(e: str) -> str:
    return rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))"


def normalized(e: str = "raw_text") -> str:
    return f"array_to_string(list_filter(list_transform(string_split({e}, chr(10)), lambda s: {collapse('s')}), lambda s: s <> ''), chr(10))"


def first(t: str, patterns: list[str]) -> str:
    """Group 1 of the first pattern that matches. A lookahead at a pattern's end may as well be matched."""
    cases = []
    for p in patterns:
        p = p.replace("(?=", "(?:")
        cases.append(f"WHEN regexp_matches({t}, {q('(?i)' + p)}) THEN {collapse(f'regexp_extract({t}, {q("(?i)" + p)}, 1)')}")
    return f"CASE {' '.join(cases)} END"


def look_up(name: str, key: str, other: str = "NULL") -> str:
    return f"CASE {key} {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in DICTIONARIES[name].items())} ELSE {other} END"


def iso(e: str, pivot: int = 50) -> str:
    """ISO date by the cascade of layouts."""
    v = f"trim(upper({e}))"
    day = lambda y, m, d: f"strftime(TRY_CAST(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE), '%Y-%m-%d')"
    g = lambda p, k: f"regexp_extract({v}, {q(p)}, {k})"
    dmy, ymd, mon = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$", r"^(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})$", r"(\d{1,2})[\s.\-]*([A-Z]{3})[\s.\-]*(\d{2,4})"
    yy = lambda c: f"CASE WHEN CAST({c} AS INT) >= {pivot} THEN '19' ELSE '20' END || {c}"
    year = f"CASE WHEN length({g(mon, 3)}) = 2 THEN {yy(g(mon, 3))} ELSE {g(mon, 3)} END"
    six = f"({day('(' + yy(f'substr({v}, 1, 2)') + ')', f'substr({v}, 3, 2)', f'substr({v}, 5, 2)')})"
    return f"""CASE WHEN {e} IS NULL OR {v} IN ('', 'N/A', 'NONE', 'NULL') THEN NULL
        WHEN regexp_matches({v}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {v}
        WHEN regexp_matches({v}, '{dmy}') AND {day(g(dmy, 3), g(dmy, 2), g(dmy, 1))} IS NOT NULL THEN {day(g(dmy, 3), g(dmy, 2), g(dmy, 1))}
        WHEN regexp_matches({v}, '{ymd}') AND {day(g(ymd, 1), g(ymd, 2), g(ymd, 3))} IS NOT NULL THEN {day(g(ymd, 1), g(ymd, 2), g(ymd, 3))}
        WHEN regexp_matches({v}, '{mon}') AND {day('(' + year + ')', look_up('month', g(mon, 2)), g(mon, 1))} IS NOT NULL THEN {day('(' + year + ')', look_up('month', g(mon, 2)), g(mon, 1))}
        WHEN regexp_matches({v}, '^[0-9]{{6}}$') THEN {six} ELSE {v} END"""


def digit(e: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, length({e}) + 1), lambda i: greatest(instr('{V}', substr({e}, i, 1)) - 1, 0) * [7, 3, 1][CAST((i - 1) % 3 + 1 AS INT)])) % 10, 0)"


def classified(t: str, name: str) -> str:
    rules, other = classify.CLASSIFIERS[name]
    out = []
    for r in rules:
        tests = [" AND ".join(f"contains({t}, {q(x)})" for x in ((c,) if isinstance(c, str) else c)) for c in r.contains]
        tests += [f"regexp_matches({t}, '\\b{w}\\b')" for w in r.words] + [f"regexp_matches({t}, {q(p)})" for p in r.patterns]
        out.append(f"WHEN {' OR '.join(f'({x})' for x in tests)} THEN {q(r.label)}")
    return f"CASE {' '.join(out)} ELSE '{other}' END"


_LABELS = f"{TEXT}, labels AS (SELECT doc_id, {normalized()} AS t FROM texts UNION ALL SELECT -doc_id - 1, text FROM documents)"
_TYPED = f"{TEXT}, typed AS (SELECT *, {normalized()} AS t FROM texts), kinds AS (SELECT *, {classified('upper(t)', 'live')} AS detected FROM typed)"

#: The repaired, padded second line of each zone.
_LINES = f"""{MRZ}, cleaned AS (SELECT *, CASE WHEN regexp_matches(line2, '^[A-Z0-9<]{{9}}[0-9][1I][A-Z]{{3}}') THEN substr(line2, 1, 10) || substr(line2, 12) ELSE line2 END AS c FROM mrz),
    lines AS (SELECT *, rpad(CASE WHEN length(c) >= 13 THEN substr(c, 1, 10) || replace(substr(c, 11, 3), '1', 'I') || substr(c, 14) ELSE c END, 44, '<') AS line FROM cleaned)"""


def valid(value: str, expected: str) -> str:
    return f"(regexp_matches({expected}, '^[0-9]$') AND {digit(value)} = TRY_CAST({expected} AS INT))"


def part(a: int, b: int, line: str = "line") -> str:
    return f"substr({line}, {a + 1}, {b - a})"


_COMPOSITE = f"({part(0, 10)} || {part(13, 20)} || {part(21, 43)})"
_PARSED = f"""{_LINES}, checks AS (SELECT *, {valid(part(0, 9), part(9, 10))} AS c1, {valid(part(13, 19), part(19, 20))} AS c2, {valid(part(21, 27), part(27, 28))} AS c3,
        CASE WHEN regexp_matches({part(43, 44)}, '^[0-9]$') THEN {valid(_COMPOSITE, part(43, 44))} END AS c4 FROM lines WHERE length(c) >= 20),
    scored AS (SELECT *, round((CAST(c1 AS INT) + CAST(c2 AS INT) + CAST(c3 AS INT) + coalesce(CAST(c4 AS INT), 0)) * 1.0 / CASE WHEN c4 IS NULL THEN 3 ELSE 4 END * 100.0, 2) AS score, c1 AND c2 AND c3 AND coalesce(c4, true) AS ok FROM checks)"""


def zone_date(a: int, pivot: int, dmy: bool = False, checked: bool = True) -> str:
    y = f"CASE WHEN CAST({part(a, a + 2)} AS INT) >= {pivot} THEN '19' ELSE '20' END || {part(a, a + 2)}"
    text = f"({y}) || '-' || {part(a + 2, a + 4)} || '-' || {part(a + 4, a + 6)}"
    text = f"({part(a + 4, a + 6)} || '/' || {part(a + 2, a + 4)} || '/' || {y})" if dmy else f"strftime(TRY_CAST({text} AS DATE), '%Y-%m-%d')" if checked else text
    return f"CASE WHEN regexp_matches({part(a, a + 6)}, '^[0-9]{{6}}$') THEN {text} END"


def denoised(words: str) -> str:
    kept = f"list_filter({words}, lambda w: w <> '' AND NOT (regexp_matches(w, '^[KkCcEeXx]+$') OR (length(w) > 4 AND len(list_distinct(string_split(w, ''))) <= 2)))"
    return f"array_to_string(list_filter(list_transform({kept}, lambda w: regexp_replace(w, '[KkCcEeXx]{{2,}}$', '')), lambda w: w <> ''), ' ')"


_NAME_PART = "substr(line1, 6, 39)"
_GIVEN = f"string_split(replace(substr({_NAME_PART}, instr({_NAME_PART}, '<<') + 2), '<', ' '), ' ')"
_DENOISE = "(given1 || '<' || given2 || '<KEX' || given1 || '<KKKC<AABAB<' || family || 'XK')"


def score1(line: str) -> str:
    return f"(20 + CASE WHEN length({line}) = 44 THEN 10 ELSE 0 END + CASE WHEN substr({line}, 3, 3) IN ('IND','USA','GBR','CAN','AUS','NOR') THEN 20 ELSE 0 END + CASE WHEN contains(substr({line}, 6), '<<') THEN 20 ELSE 0 END + length(regexp_replace(substr({line}, 6), '[^A-Z]', '', 'g')))"


_SCORE2 = " + ".join(
    f"CASE WHEN {c} THEN {n} ELSE 0 END"
    for n, c in (
        (10, "length(line) = 44"), (10, f"regexp_matches({part(0, 9)}, '^[A-Z0-9<]{{9}}$')"), (10, f"regexp_matches({part(9, 10)}, '^[0-9]$')"),
        (15, f"regexp_matches({part(10, 13)}, '^[A-Z]{{3}}$')"), (15, f"regexp_matches({part(13, 19)}, '^[0-9]{{6}}$')"), (10, f"{part(20, 21)} IN ('M','F','X','<')"),
        (15, f"regexp_matches({part(21, 27)}, '^[0-9]{{6}}$')"), (30, valid(part(0, 9), part(9, 10))), (30, valid(part(13, 19), part(19, 20))), (30, valid(part(21, 27), part(27, 28))),
    )
)


def _extract(kind: str, label: str, columns: dict[str, str], t: str = "t") -> str:
    raw = ", ".join(f"{first(t, p)} AS x_{n}" for n, p in extract.PATTERNS[kind].items())
    return f"{_TYPED}, x AS (SELECT *, {raw} FROM kinds WHERE detected = '{label}') SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in columns.items())} FROM x"


def _surname(n: str) -> str:
    return f"CASE WHEN contains({n}, ' ') THEN string_split({n}, ' ')[-1] END"


def _given(n: str) -> str:
    return f"CASE WHEN contains({n}, ' ') THEN array_to_string(string_split({n}, ' ')[:-2], ' ') ELSE nullif({n}, '') END"


def _count(*e: str) -> str:
    return " + ".join(f"CASE WHEN coalesce({x}, '') <> '' THEN 1 ELSE 0 END" for x in e)


def _alpha3(c: str) -> str:
    k = f"trim(upper(nullif({c}, '')))"
    return look_up("alpha3", k, f"substr({k}, 1, 3)")


def _demonym(c: str) -> str:
    k = f"trim(upper(nullif({c}, '')))"
    return look_up("demonym", k, k)


_BOTH = "(coalesce(x_surname, '') = '' AND coalesce(x_given_name, '') = '')"
_V_SUR = f"CASE WHEN {_BOTH} THEN string_split(x_name, ' ')[-1] ELSE x_surname END"
_V_GIV = f"CASE WHEN {_BOTH} THEN CASE WHEN contains(x_name, ' ') THEN array_to_string(string_split(x_name, ' ')[:-2], ' ') ELSE x_name END ELSE x_given_name END"
_L_NAME = collapse(rf"regexp_replace(replace(x_full_name, '!', ''), '(?i)\s+({extract.NAME_JUNK})\s*$', '')")
_L_GUARD = collapse(rf"regexp_replace(replace(x_guardian_name, '!', ''), '(?i)\s+({extract.GUARDIAN_JUNK})\s*$', '')")
_L_TEXT = "(raw_text || chr(10) || t)"
_L_DATES = rf"list_transform(regexp_extract_all({_L_TEXT}, '\b(\d{{1,2}}[/.:''°\-]\d{{1,2}}[/.:''°\-]\d{{4}})\b', 1), lambda d: regexp_replace(d, '[.:''°\-]', '/', 'g'))"
_L_YEAR = "CAST(string_split(d, '/')[-1] AS INT)"
_L_ISSUE = f"coalesce(nullif(replace(x_date_of_issue, ':', '/'), ''), list_filter({_L_DATES}, lambda d: {_L_YEAR} BETWEEN 2020 AND 2030)[1])"
_L_EXPIRY = f"list_filter({_L_DATES}, lambda d: {_L_YEAR} > 2030 AND d IS DISTINCT FROM x_date_of_birth)[1]"

_VALID = f"""{FILES}, v AS (SELECT *, lower(regexp_extract(path, '\\.[^./]*$')) AS ext FROM files),
    e AS (SELECT *, CASE WHEN length IS NULL THEN 'ERR_FILE_NOT_FOUND' WHEN length = 0 THEN 'ERR_EMPTY_FILE' WHEN length > 26214400 THEN 'ERR_FILE_TOO_LARGE'
        WHEN ext NOT IN ('.jpg','.jpeg','.png','.bmp','.webp','.tiff','.tif') THEN 'ERR_INVALID_EXTENSION'
        WHEN NOT ({' OR '.join(f"starts_with(header, '{m}')" for m in validate.MAGIC)}) THEN 'ERR_MALICIOUS_PAYLOAD' END AS error FROM v)"""
_CODES = " ".join(f"WHEN '{k}' THEN '{c}'" for k, (c, _) in validate.ERROR_CODES.items())
_DESCRIPTIONS = " ".join(f"WHEN '{k}' THEN {q(t)}" for k, (_, t) in validate.ERROR_CODES.items())

_PAIRS = """WITH pairs AS (SELECT a.vec_id, a.label = b.label AS same, 1 - list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))
    / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS d
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""
_BLINKS = f"""{FRAMES}, seen AS (SELECT *, ear < 0.22 AS shut FROM frames WHERE has_face),
    isl AS (SELECT *, coalesce(sum(CASE WHEN shut THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM seen),
    runs AS (SELECT *, sum(CASE WHEN shut THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, island) AS run FROM isl),
    blink AS (SELECT session_id, ts FROM runs WHERE NOT shut AND run >= 2)"""


def _pad(r: float) -> dict[str, str]:
    return {"x1": f"greatest(0, x - CAST(trunc(w * {r}) AS INT))", "y1": f"greatest(0, y - CAST(trunc(h * {r}) AS INT))", "x2": f"least(img_w, x + w + CAST(trunc(w * {r}) AS INT))", "y2": f"least(img_h, y + h + CAST(trunc(h * {r}) AS INT))"}


_P = _pad(0.25)


def _eye() -> str:
    point = lambda k: (f"CAST(trunc(((event_id * {7 + k}) % 100) / 100.0 * 640) AS INT)", f"CAST(trunc(((event_id * {11 + 3 * k}) % 100) / 100.0 * 480) AS INT)")
    length = lambda i, j: f"sqrt(CAST(pow({point(i)[0]} - {point(j)[0]}, 2) + pow({point(i)[1]} - {point(j)[1]}, 2) AS DOUBLE))"
    return f"SELECT event_id, round(CASE WHEN {length(0, 3)} = 0 THEN 0.0 ELSE ({length(1, 5)} + {length(2, 4)}) / (2.0 * {length(0, 3)}) END, 6) AS ear FROM events"


_FORMULAS = f"""{TEXT}, f AS (SELECT doc_id, corruption AS c, 25.0::DOUBLE * (corruption % 5) AS m, 100.0::DOUBLE - 10.0 * (corruption % 4) AS k, 12.5::DOUBLE * corruption AS s, corruption % 2 = 0 AS ok FROM texts),
    n AS (SELECT *, CAST(c % 3 <> 0 AS INT) + CAST(c % 5 <> 0 AS INT) + CAST(c <> 0 AS INT) AS known, CAST(c % 3 <> 0 AND c % 2 = 0 AS INT) + CAST(c % 5 <> 0 AND c < 4 AS INT) + CAST(c <> 0 AS INT) AS good FROM f),
    r AS (SELECT doc_id, CASE WHEN c < 6 THEN round(m * 0.5 + k * 0.25 + s * 0.25, 2) ELSE round(k * 0.7, 2) END AS live,
        round(CASE WHEN ok THEN m * 0.5 + s * 0.3 + k * 0.2 ELSE k * 0.7 + s * 0.3 END, 2) AS legacy,
        CASE WHEN known = 0 THEN 0 ELSE CAST(least(round(good / known::DOUBLE * 100 * 0.6 + m * 0.4), 100) AS INT) END AS combiner,
        least(CASE WHEN m >= 80 THEN 40 WHEN m >= 60 THEN 30 WHEN m >= 40 THEN 20 ELSE 10 END + CASE WHEN ok THEN 20 ELSE 0 END + CASE WHEN c < 3 THEN 15 ELSE 0 END + CASE WHEN c < 5 THEN 15 ELSE 0 END + 5 + CASE WHEN c = 1 THEN 5 ELSE 0 END, 100) AS points FROM n)"""

_PIVOT = "(SELECT doc_id, line2 AS line FROM mrz)"
_CER_GUESS = "CASE WHEN corruption = 0 THEN NULL WHEN corruption < 4 THEN translate(family, 'AEI', '41') ELSE given1 || family END"
_DATE_LIST = r"list_sort(list_transform(regexp_extract_all(raw_text, '\b(\d{2}[/.\-]\d{2}[/.\-]\d{4})\b', 1), lambda d, i: {'day': coalesce(try_strptime(regexp_replace(d, '[.\-]', '/', 'g'), '%d/%m/%Y'), TIMESTAMP '2099-01-01'), 'at': i, 'raw': d}))"
_OTHER = "CASE WHEN corruption < 3 THEN lower(family) WHEN corruption < 5 THEN ' ' ELSE given1 END"

_TRIMMED = "list_transform(string_split({t}, chr(10)), lambda s: trim(s))"
_TITLED = "regexp_matches(s, '^[A-Z][a-z]+(?:[ ]+[A-Z][a-z]+){1,4}$') AND length(s) > 4"
_NID = (
    _extract("national_id", "NATIONAL_ID", {"doc_id2": "doc_id"}).rpartition(" SELECT ")[0]
    + rf""", ls AS (SELECT *, {_TRIMMED.format(t="t")} AS ls FROM x),
    marks AS (SELECT *, list_position(list_transform(ls, lambda s: regexp_matches(s, '^(?:[SsDdWwFf][/\\][OoDdWwFf]\s+|(?:Son|Daughter|Wife|Father|Mother)\s*[/\\]?[Oo])')), true) AS rel,
        list_position(list_transform(ls, lambda s: lower(s) = 'to'), true) AS too,
        list_position(list_transform(ls, lambda s: regexp_matches(s, '(?i)^\d+-\d+') OR regexp_matches(s, '(?i)\b(VTC|District|State|PIN)\b')), true) AS a0,
        list_position(list_transform(ls, lambda s: regexp_matches(s, '(?i)PIN\s*Code')), true) AS a1 FROM ls),
    named AS (SELECT *, coalesce(CASE WHEN rel > 0 THEN list_filter(list_reverse(ls[greatest(rel - 3, 1):rel - 1]), lambda s: {_TITLED})[1] END, CASE WHEN too > 0 THEN list_filter(ls[too + 1:], lambda s: {_TITLED})[1] END) AS full_name,
        CASE WHEN a0 > 0 THEN array_to_string(list_filter(ls[a0:a1], lambda s: s <> '' AND NOT regexp_matches(s, '(?i)\b(Aadhaar|UIDAI|Your|Mobile|VID|Signature)\b'))[1:5], ', ') END AS address,
        replace(x_id_number, ' ', '') AS n, replace(x_vid, ' ', '') AS v, CASE WHEN regexp_matches(t, '(?i)\b(?:FEMALE|WOMAN)\b') THEN 'F' WHEN regexp_matches(t, '(?i)\b(?:MALE|MAN)\b') THEN 'M' END AS gender FROM marks)"""
)

ORACLES: dict[str, str] = {
    "extract_national_id": f"""{_NID} SELECT doc_id, CASE WHEN length(n) = 12 THEN substr(n, 1, 4) || ' ' || substr(n, 5, 4) || ' ' || substr(n, 9, 4) ELSE x_id_number END AS id_number, full_name, {_surname("full_name")} AS surname, {_given("full_name")} AS given_name, CASE WHEN contains(upper(t), 'AADHAAR') OR contains(upper(t), 'INDIA') THEN 'INDIAN' END AS nationality,
        CASE WHEN contains(upper(t), 'AADHAAR') THEN 'Unique Identification Authority of India (UIDAI)' ELSE 'National ID Authority' END AS issuing_authority, {iso("x_date_of_birth")} AS date_of_birth, gender, x_guardian_name AS guardian_name, address,
        CASE WHEN length(v) = 16 THEN substr(v, 1, 4) || ' ' || substr(v, 5, 4) || ' ' || substr(v, 9, 4) || ' ' || substr(v, 13, 4) ELSE v END AS vid, CASE WHEN contains(upper(t), 'AADHAAR') THEN 'Aadhaar Card' ELSE 'National ID' END AS id_type,
        {_count("x_id_number", "full_name", "x_date_of_birth", "gender")} AS n_present FROM named""",
    "line_window_above": f"""{TEXT}, ls AS (SELECT doc_id, list_filter({_TRIMMED.format(t="raw_text")}, lambda s: s <> '') AS ls FROM texts), i AS (SELECT *, list_position(list_transform(ls, lambda s: regexp_matches(s, 'DOB|Date of Birth')), true) AS i FROM ls)
        SELECT doc_id, CASE WHEN i > 0 THEN list_filter(list_reverse(ls[greatest(i - 3, 1):i - 1]), lambda s: regexp_matches(s, '[A-Z]'))[1] END AS nearest FROM i""",
    "audit_events": f"""{_TYPED} SELECT 'DOCUMENT_SCREENING_OCR' AS event_type, '20240102' AS audit_date, truth_type || '.jpg' AS input_file_name, CASE detected WHEN 'TRAVEL_AUTH' THEN 'TRAVEL_AUTHORIZATION' ELSE detected END AS document_type, 'UNKNOWN' AS file_hash_sha256, count(*) AS n FROM kinds GROUP BY ALL""",
    "mrz_check_digits": f"{MRZ} SELECT doc_id, substr(line2, 1, 9) AS number, {digit('substr(line2, 1, 9)')} AS by_fold, {digit('substr(line2, 1, 9)')} AS by_sum, {digit('substr(line2, 14, 6)')} AS birth_digit FROM mrz",
    "mrz_composite": f"{_LINES} SELECT doc_id, {digit(_COMPOSITE)} AS composite, substr(line, 44, 1) AS given FROM lines",
    "mrz_line2_repair": f"{_LINES} SELECT doc_id, line, line1 AS first FROM lines",
    "mrz_validity_by_nation": f"{_PARSED} SELECT replace({part(10, 13)}, '<', '') AS nationality, ok AS mrz_valid, count(*) AS n, round(avg(score), 4) AS avg_score FROM scored GROUP BY ALL",
    "mrz_best_candidate": f"{_LINES} SELECT doc_id, line1, line AS line2, {score1('line1')} AS score1, {_SCORE2} AS score2 FROM lines",
    "mrz_full_parse": f"""{_PARSED} SELECT doc_id, trim(replace(substr({_NAME_PART}, 1, instr({_NAME_PART}, '<<') - 1), '<', ' ')) AS surname, {denoised(_GIVEN)} AS given_name,
        replace({part(0, 9)}, '<', '') AS passport_number, replace({part(10, 13)}, '<', '') AS nationality, {zone_date(13, 40)} AS date_of_birth, CASE WHEN {part(20, 21)} IN ('M','F','X') THEN {part(20, 21)} END AS gender,
        {zone_date(21, 40)} AS date_of_expiry, c1 AS valid_passport_number, c2 AS valid_date_of_birth, c3 AS valid_date_of_expiry, c4 AS valid_composite_check, ok AS mrz_valid, score AS mrz_validation_score FROM scored""",
    "mrz_name_denoise": f"""{MRZ} SELECT doc_id, {denoised(f"string_split(replace({_DENOISE}, '<', ' '), ' ')")} AS live,
        array_to_string(list_filter(string_split(replace({_DENOISE}, '<', ' '), ' '), lambda w: length(w) <= 12 AND length(regexp_replace(w, '[^K]', '', 'g')) <= 5), ' ') AS legacy FROM mrz""",
    "mrz_legacy_variant": f"""{_PARSED} SELECT doc_id, {zone_date(13, 30, checked=False)} AS birth, round((CAST(c1 AS INT) + CAST(c2 AS INT) + CAST(c3 AS INT) + coalesce(CAST(c4 AS INT), 0)) / 4.0 * 100.0, 2) AS confidence,
        (c1 AND c2 AND c3 AND coalesce(c4, false) AND regexp_matches(replace({part(0, 9)}, '<', ''), '^[A-Z0-9]{{6,9}}$') AND regexp_matches(replace({part(10, 13)}, '<', ''), '^[A-Z]{{3}}$') AND regexp_matches({part(21, 27)}, '^[0-9]{{6}}$')) AS mrz_valid,
        true AS ok_document_code, true AS ok_issuing_country, regexp_matches(replace({part(0, 9)}, '<', ''), '^[A-Z0-9]{{6,9}}$') AS ok_passport_number, regexp_matches(replace({part(10, 13)}, '<', ''), '^[A-Z]{{3}}$') AS ok_nationality,
        regexp_matches({part(13, 19)}, '^[0-9]{{6}}$') AS ok_birth_digits, {part(20, 21)} IN ('M','F','X','<') AS ok_sex, regexp_matches({part(21, 27)}, '^[0-9]{{6}}$') AS ok_expiry_digits FROM scored WHERE length(c) >= 25""",
    "classify_live": f"{_LABELS} SELECT doc_id, {classified('upper(t)', 'live')} AS label FROM labels",
    "classify_legacy_engine": f"{_LABELS} SELECT doc_id, {classified('upper(t)', 'legacy_engine')} AS label FROM labels",
    "classify_legacy_detector": f"{_LABELS} SELECT doc_id, {classified('upper(t)', 'legacy_detector')} AS label FROM labels",
    "route_types": f"{_TYPED} SELECT truth_type, CASE detected WHEN 'PASSPORT' THEN 'passport' WHEN 'VISA' THEN 'visa' WHEN 'NATIONAL_ID' THEN 'national_id' WHEN 'DRIVING_LICENSE' THEN 'licence' WHEN 'TRAVEL_AUTH' THEN 'travel' WHEN 'PERMIT' THEN 'permit' ELSE 'unknown' END AS processor, count(*) AS n FROM kinds GROUP BY ALL",
    "extract_visa": _extract("visa", "VISA", {
        **{k: f"x_{k}" for k in ("visa_number", "visa_type", "issuing_post", "passport_number", "number_of_entries", "duration_of_stay")},
        "surname": _V_SUR, "given_name": _V_GIV, "full_name": f"({_V_GIV}) || ' ' || ({_V_SUR})", "nationality": _alpha3("x_nationality"), "gender": "upper(x_gender)",
        **{k: iso(f"x_{k}") for k in ("date_of_birth", "date_of_issue", "date_of_expiry")},
        "n_present": _count("x_visa_number", "x_visa_type", "x_passport_number", f"({_V_SUR})", "x_date_of_issue", "x_date_of_expiry"),
    }),
    "extract_permit": _extract("permit", "PERMIT", {
        "permit_number": "x_permit_number", "permit_type": "coalesce(nullif(x_permit_type, ''), 'Residence Permit')", "full_name": "x_full_name", "surname": _surname("x_full_name"), "given_name": _given("x_full_name"),
        "nationality": _demonym("x_nationality"), "date_of_birth": iso("x_date_of_birth"), "date_of_issue": iso("x_valid_from"), "date_of_expiry": iso("x_valid_until"),
        "issuing_authority": "coalesce(nullif(x_issuing_authority, ''), 'Immigration / Home Affairs Department')", "n_present": _count("x_permit_number", "x_full_name", "x_valid_until"),
    }),
    "extract_travel": _extract("travel", "TRAVEL_AUTH", {
        "authorization_number": "x_authorization_number", "authorization_status": "coalesce(nullif(x_authorization_status, ''), 'APPROVED')", "full_name": "x_full_name", "surname": _surname("x_full_name"), "given_name": _given("x_full_name"),
        "passport_number": "x_passport_number", "nationality": _demonym("x_nationality"), "date_of_birth": iso("x_date_of_birth"), "date_of_issue": iso("x_date_of_issue"), "date_of_expiry": iso("x_date_of_expiry"),
        "issuing_authority": "coalesce(nullif(x_issuing_authority, ''), 'Border & Travel Authorization Agency')", "n_present": _count("x_authorization_number", "x_full_name", "x_passport_number", "(" + iso("x_date_of_expiry") + ")"),
    }),
    "extract_licence": _extract("licence", "DRIVING_LICENSE", {
        "license_number": "x_license_number", "full_name": _L_NAME, "surname": _surname(_L_NAME), "given_name": _given(_L_NAME), "date_of_birth": iso("x_date_of_birth"), "date_of_issue": iso(f"({_L_ISSUE})"), "date_of_expiry": iso(f"({_L_EXPIRY})"),
        "blood_group": "x_blood_group", "guardian_name": _L_GUARD, "address": "x_address", "issuing_authority": "coalesce(nullif(x_issuing_authority, ''), 'Transport Department / Licensing Authority')", "gender": "upper(x_gender)",
        "n_present": _count("x_license_number", _L_NAME, "x_date_of_birth", f"({_L_ISSUE})", f"({_L_EXPIRY})", _L_GUARD),
    }, _L_TEXT),
    "ocr_normalize": f"{TEXT} SELECT doc_id, {normalized()} AS normalized FROM texts",
    "multi_pass_union": rf"{TEXT} SELECT doc_id, md5(regexp_replace(raw_text, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || family) AS digest FROM texts",
    "viz_tokens": f"{TEXT} SELECT doc_id, array_to_string(regexp_extract_all(upper(raw_text), '[A-Z0-9]+'), ' ') AS stream FROM texts",
    "compare_keys": f"{TEXT} SELECT doc_id, trim(family || '< ' || number) AS a, replace(family || number, '<', '') AS b, replace(family || number, '<', '') AS c, rtrim(number, '<') AS filler FROM texts",
    "mask_pii": f"""{TEXT}, ids AS (SELECT doc_id, unnest(['1234 5678 ' || lpad(doc_id::VARCHAR, 4, '0'), '123456789012' || lpad(doc_id::VARCHAR, 4, '0'), family, 'abc']) AS id FROM texts)
        SELECT doc_id, id, CASE WHEN length(replace(id, ' ', '')) = 12 THEN 'XXXX-XXXX-' || right(id, 4) WHEN length(replace(id, ' ', '')) = 16 THEN 'XXXX-XXXX-XXXX-' || right(id, 4)
            WHEN length(id) > 4 THEN substr(id, 1, 2) || repeat('X', length(id) - 4) || right(id, 2) ELSE 'XXXX' END AS masked FROM ids""",
    "regroup_ids": f"{TEXT}, n AS (SELECT doc_id, lpad(doc_id::VARCHAR, 12, '7') AS n FROM texts) SELECT doc_id, substr(n, 1, 4) || ' ' || substr(n, 5, 4) || ' ' || substr(n, 9, 4) AS id, substr(n, 1, 4) || ' ' || substr(n, 5, 4) || ' ' || substr(n, 9, 4) || ' 1234' AS vid FROM n",
    "date_normalize_iso": rf"""{DATES} SELECT id, {iso('raw')} AS iso, CASE WHEN trim(raw) = '' THEN NULL ELSE coalesce(strftime(coalesce(try_strptime(trim(raw), '%Y-%m-%d'), try_strptime(trim(raw), '%d/%m/%Y'), try_strptime(trim(raw), '%d-%m-%Y'), try_strptime(trim(raw), '%d.%m.%Y')), '%Y-%m-%d'), trim(raw)) END AS four FROM dates""",
    "mrz_date_pivots": f"{MRZ} SELECT doc_id, {zone_date(13, 50)} AS p50, {zone_date(13, 40)} AS p40, {zone_date(13, 30, checked=False)} AS p30, {zone_date(13, 50, dmy=True)} AS p50_dmy FROM {_PIVOT}",
    "month_dates": rf"""{DATES} SELECT id, CASE WHEN regexp_matches(upper(raw), '(\d{{1,2}})\s+([A-Z]{{3}})\s+(\d{{2,4}})') THEN lpad(regexp_extract(upper(raw), '(\d{{1,2}})\s+([A-Z]{{3}})\s+(\d{{2,4}})', 1), 2, '0') || '/' || {look_up('month', r"regexp_extract(upper(raw), '(\d{1,2})\s+([A-Z]{3})\s+(\d{2,4})', 2)")} || '/' || regexp_extract(upper(raw), '(\d{{1,2}})\s+([A-Z]{{3}})\s+(\d{{2,4}})', 3) END AS dmy, translate(raw, '.-', '//') AS slashed FROM dates""",
    "date_sort_assign": f"{TEXT}, s AS (SELECT doc_id, {_DATE_LIST} AS s FROM texts) SELECT doc_id, s[1].raw AS birth, CASE WHEN len(s) > 2 THEN s[2].raw END AS issue, CASE WHEN len(s) > 1 THEN s[-1].raw END AS expiry FROM s",
    "country_codes": f"""{TEXT} SELECT doc_id, {_alpha3('nation')} AS alpha3, {_demonym('code')} AS demonym, {look_up('compare_code', 'nation', 'nation')} AS compare, {look_up('consistency_code', 'nation', 'nation')} AS consistency,
        nation = code OR coalesce({look_up('combiner_code', 'nation')} = code, false) AS same, {look_up('gender', 'sex', 'sex')} AS gender FROM texts""",
    "dictionary_join": f"{TEXT} SELECT doc_id, {_alpha3('nation')} AS by_join, {_alpha3('nation')} AS by_map FROM texts",
    "compare_legacy": f"""{TEXT}, o AS (SELECT *, {_OTHER} AS other, CASE WHEN corruption < 4 THEN birth_iso ELSE issue_iso END AS day FROM texts)
        SELECT doc_id, CASE WHEN trim(other) = '' THEN 'MISSING_OCR' WHEN upper(other) = family THEN 'MATCH' ELSE 'DIFFERENT' END AS name, CASE WHEN day = birth_iso THEN 'MATCH' ELSE 'DIFFERENT' END AS birth, replace(upper(other), ' ', '') = family AS tristate, true AS engine FROM o""",
    "merge_priority": f"""{TEXT}, o AS (SELECT doc_id, CASE WHEN corruption < 4 THEN family END AS m, CASE WHEN corruption % 2 = 0 THEN given1 ELSE '' END AS v, corruption < 2 AS ok FROM texts)
        SELECT doc_id, coalesce(m, nullif(v, '')) AS live, CASE WHEN ok THEN coalesce(m, nullif(v, '')) ELSE nullif(v, '') END AS if_valid, coalesce(m, nullif(v, '')) AS value, CASE WHEN m IS NOT NULL THEN 'MRZ' ELSE 'OCR' END AS source, ok AS mrz_verified, CASE WHEN m IS NOT NULL AND v <> '' THEN m = v END AS sources_match FROM o""",
    "confidence_formulas": f"""{_FORMULAS} SELECT doc_id, live, legacy, combiner, points, CASE WHEN live >= 80 THEN 'HIGH' WHEN live >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS live_level, CASE WHEN legacy >= 90 THEN 'VERY HIGH' WHEN legacy >= 75 THEN 'HIGH' WHEN legacy >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS legacy_level,
        CASE WHEN points >= 80 THEN 'HIGH' WHEN points >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS points_level, CASE WHEN combiner > 80 THEN 'VERIFIED' WHEN legacy >= 70 THEN 'PROCESSED' ELSE 'REVIEW_REQUIRED' END AS status FROM r""",
    "eval_cer": f"{TEXT}, g AS (SELECT doc_id, {_CER_GUESS} AS g, family FROM texts) SELECT doc_id, least(100.0, round(levenshtein(coalesce(g, ''), family) / length(family) * 100.0, 2)) AS cer, levenshtein(coalesce(g, ''), family) AS distance FROM g",
    "validate_files": f"""{_VALID} SELECT id, error IS NULL AS is_valid, error, CASE error {_CODES} END AS error_code, CASE error WHEN 'ERR_FILE_NOT_FOUND' THEN 'File does not exist: ' || path WHEN 'ERR_EMPTY_FILE' THEN 'Uploaded file is 0 bytes (empty)'
        WHEN 'ERR_FILE_TOO_LARGE' THEN 'File exceeds maximum allowed size of 25MB (' || length || ' bytes)' WHEN 'ERR_INVALID_EXTENSION' THEN 'Unsupported file extension: ' || ext WHEN 'ERR_MALICIOUS_PAYLOAD' THEN 'File header does not match any allowed image format signature' END AS message,
        CASE WHEN error IS NULL THEN sha256(unhex(header)) END AS file_hash FROM e""",
    "file_hash_dedupe": "SELECT sha256(text) AS file_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "error_code_lookup": f"{_VALID} SELECT error, CASE error {_CODES} END AS error_code, CASE error {_DESCRIPTIONS} END AS description, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY ALL",
    "face_prominent": f"{BOXES} SELECT image_id, pos, x, y, w, h FROM boxes WHERE conf >= 0.6 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, pos) = 1",
    "face_box_pad": f"{BOXES} SELECT image_id, pos, {', '.join(f'{e} AS {k}' for k, e in _P.items())}, {_pad(0.15)['x1']} AS lx1, {_pad(0.15)['y2']} AS ly2, {_P['x2']} > {_P['x1']} AND {_P['y2']} > {_P['y1']} AS has_area FROM boxes",
    "face_similarity": f"{_PAIRS} SELECT vec_id, same, 'SUCCESS' AS status, d <= 0.6 AS is_match, greatest(0.0, least(100.0, round((1 - d) * 100, 2))) AS similarity_percentage, round(d, 4) AS cosine_distance, CASE WHEN d <= 0.6 THEN 0 ELSE 40 END AS risk_score FROM pairs",
    "face_risk": f"""{_PAIRS}, r AS (SELECT CASE WHEN vec_id % 7 = 0 THEN 'FAIL' WHEN vec_id % 3 = 0 AND vec_id % 2 <> 0 THEN 'FAIL' WHEN vec_id % 3 <> 0 AND vec_id % 5 = 0 THEN 'FAIL' WHEN d <= 0.6 THEN 'SUCCESS' ELSE 'FLAGGED' END AS status,
        CASE WHEN vec_id % 7 = 0 THEN 50 WHEN vec_id % 3 = 0 AND vec_id % 2 <> 0 THEN 45 WHEN vec_id % 3 <> 0 AND vec_id % 5 = 0 THEN 50 WHEN d <= 0.6 THEN 0 ELSE 40 END AS risk_score FROM pairs) SELECT status, risk_score, count(*) AS n FROM r GROUP BY ALL""",
    "eye_aspect": _eye(),
    "blink_runs": f"{_BLINKS} SELECT session_id, ts FROM blink",
    "blink_stream": f"{_BLINKS} SELECT session_id, ts FROM blink",
    "liveness": f"{_BLINKS} SELECT f.session_id, min(b.ts) IS NOT NULL AS liveness_verified, min(b.ts) AS captured_at FROM (SELECT DISTINCT session_id FROM frames) f LEFT JOIN blink b USING (session_id) GROUP BY f.session_id",
    "auto_capture": f"""{FRAMES}, n AS (SELECT *, row_number() OVER w AS n, epoch_us(ts) - epoch_us(first(ts) OVER w) AS us FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
        e AS (SELECT session_id, n, CASE WHEN us > 1728000000000 THEN 'timeout' WHEN "key" = ' ' THEN 'key' WHEN "key" = 'q' THEN 'cancelled' WHEN n > 12 THEN 'auto' END AS ended FROM n),
        f AS (SELECT * FROM e WHERE ended IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n) = 1)
        SELECT s.session_id, coalesce(ended, 'stream_end') AS ended_by, coalesce(ended IN ('key', 'auto'), false) AS captured, n AS frame FROM (SELECT DISTINCT session_id FROM frames) s LEFT JOIN f USING (session_id)""",
    "deskew_pages": "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(CASE WHEN abs(p_partkey % 83 - 41) <= 30 THEN p_partkey % 83 - 41 ELSE 0 END AS INT) AS degrees, true AS straight FROM part",
    "liveness_stream": f"{_BLINKS} SELECT f.session_id, min(b.ts) IS NOT NULL AS liveness_verified, min(b.ts) AS captured_at FROM (SELECT DISTINCT session_id FROM frames) f LEFT JOIN blink b USING (session_id) GROUP BY f.session_id",
    "auto_capture_stream": f"""{FRAMES}, n AS (SELECT *, row_number() OVER w AS n, epoch_us(ts) - epoch_us(first(ts) OVER w) AS us FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
        e AS (SELECT session_id, n, us, CASE WHEN us > 1728000000000 THEN 'timeout' WHEN "key" = ' ' THEN 'key' WHEN "key" = 'q' THEN 'cancelled' WHEN n > 12 THEN 'auto' END AS ended FROM n),
        f AS (SELECT session_id, arg_min(ended, n) FILTER (ended IS NOT NULL) AS ended, min(n) FILTER (ended IS NOT NULL) AS n, count(*) FILTER (us <= 1728000000000) AS looked FROM e GROUP BY session_id)
        SELECT session_id, coalesce(ended, 'timeout') AS ended_by, coalesce(ended IN ('key', 'auto'), false) AS captured, CASE WHEN coalesce(ended, 'timeout') = 'timeout' THEN looked ELSE n END AS frame FROM f""",
    "quality_rules": f"""{STATS}, r AS (SELECT *, CASE WHEN laplacian < 80 THEN 'BLURRY' WHEN laplacian < 200 THEN 'MODERATE' ELSE 'SHARP' END AS blur, CASE WHEN brightness < 50 THEN 'Image is very dark / underexposed.' WHEN brightness > 220 OR glare > 15 THEN 'Image is washed out / glare detected (' || round(glare, 1) || '% saturated).' END AS light FROM stats),
        s AS (SELECT *, greatest(10.0, 100.0 - CASE blur WHEN 'BLURRY' THEN 35.0 WHEN 'MODERATE' THEN 10.0 ELSE 0.0 END - CASE WHEN light IS NOT NULL THEN 20.0 ELSE 0.0 END - CASE WHEN width >= 400 AND height >= 300 THEN 0.0 ELSE 25.0 END)::DOUBLE AS score FROM r)
        SELECT id, score AS quality_score, blur AS blur_status, round(glare, 2) AS glare_percentage, width || 'x' || height AS resolution, score >= 50 AS is_acceptable,
            array_to_string(list_filter([CASE WHEN blur = 'BLURRY' THEN 'Image is noticeably blurry; OCR accuracy may be reduced.' END, light], lambda x: x IS NOT NULL), '; ') AS warnings FROM s""",
}
