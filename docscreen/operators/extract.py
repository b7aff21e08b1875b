"""Field extraction by ordered pattern lists: one row in, one record out.

``PATTERNS`` is the rule table. A field's value is group 1 of its first pattern that
matches. Each type's function adds that type's fields to a DataFrame, under the names in the
record with the prefix ``f_``. It works in steps, each a projection of plain columns, so that
no pattern is tried twice for the values derived from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import assign_dates, first_in_years, iso_or_null
from ..functions.lookup import country_code, gender, nationality
from ..functions.text import all_but_last, clean_noise, collapse, find_first, full_name, given_of, group_id, group_vid, last_word, lines, missing, once, present, surname_of

_DATE = r"\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}"
_DATE_COLON = r"\d{1,2}[\/\-\.:]\d{1,2}[\/\-\.:]\d{2,4}"
_DAY_MON = r"[0-9]{1,2}[A-Z]{3}[0-9]{2,4}"
_TITLE = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"

#: Fixed values, in order of trial.
PATTERNS: dict[str, dict[str, list[str]]] = {
    "visa": {
        "visa_number": [r"Visa\s*(?:No|Number)\s*[:\-]?\s*([A-Z0-9]{8,14})", r"Control\s*Number\s*[:\-]?\s*([A-Z0-9]{8,14})", r"\b([A-Z]\d{7,9})\b", r"\b(\d{9,14})\b"],
        "visa_type": [r"Visa\s*(?:Type|Class|Category)\s*[/:]?\s*([A-Z0-9\/\-]+)", r"(?:Type\s*de\s*visa|Type\s*of\s*Visa|Type)\s*[/:]?\s*([A-Z0-9\/\-]+)", r"\bType\s*[:\-]?\s*([A-Z0-9]+)\b"],
        "issuing_post": [r"(?:Issuing\s*Post|Place\s*of\s*Issue|Delivre\s*a|Délivré\s*à|Authority)\s*[:\-]?\s*([A-Z\s]+?)(?=\n|Surname|Given|Du|From|$)", r"\b(PARIS|LONDON|NEW YORK|BERLIN|DELHI|MUMBAI|WASHINGTON)\b"],
        "passport_number": [r"(?:Passport\s*(?:No|Number)|PPT\s*(?:No)?|Numéro\s*de\s*passeport)\s*[:\-]?\s*([A-Z0-9]{7,12})", r"\b([A-Z]\d{7,8})\b"],
        "surname": [r"(?:Surname|Nom|Last\s*Name)\s*[:\-]?\s*([A-Z\s]+?)(?=\n|Given|First|Prénom|$)"],
        "given_name": [r"(?:Given\s*Name[s]?|Prénom[s]?|First\s*Name)\s*[:\-]?\s*([A-Z\s]+?)(?=\n|Sex|Sexe|Date|$)"],
        "name": [r"(?:Name|Nom\s*et\s*prénom)\s*[:\-]?\s*([A-Z\s]+?)(?=\n|Passport|DOB|$)", r"\b([A-Z]{3,}\s+[A-Z]{3,})\b"],
        "nationality": [r"(?:Nationality|Nationalité)\s*[:\-]?\s*([A-Z]+)"],
        "gender": [r"\b(?:Sex|Gender|Sexe)\s*[:\-]?\s*([MFX])\b"],
        "date_of_birth": [rf"(?:Birth\s*Date|Date\s*of\s*Birth|DOB|Date\s*de\s*naissance)\s*[:\-]?\s*({_DATE}|[0-9A-Z]{{7,11}})"],
        "date_of_issue": [rf"(?:Issue\s*Date|Date\s*of\s*Issue|Délivré\s*le|Delivre\s*le|Valid\s*From|Du|From)\s*[:\-]?\s*({_DATE}|{_DAY_MON})"],
        "date_of_expiry": [rf"(?:Expiration\s*Date|Expiry\s*Date|Valid\s*Until|Au|Until|Jusqu['\s]*au)\s*[:\-]?\s*({_DATE}|{_DAY_MON})"],
        "number_of_entries": [r"(?:Number\s*of\s*Entries|Nombre\s*d['\s]*entrées|Entries)\s*[:\-]?\s*([MULT0-9]+|MULTIPLE|SINGLE|01|02|M|S)", r"\b(MULT|MULTIPLE|SINGLE|01|02)\b"],
        "duration_of_stay": [r"(?:Duration\s*of\s*Stay|Durée\s*de\s*séjour|Stay\s*Duration|Duration)\s*[:\-]?\s*(\d+\s*(?:DAYS|JOURS|MONTHS|MOIS|WEEKS)?)", r"\b(\d{1,3}\s*DAYS)\b"],
    },
    "permit": {
        "permit_number": [r"(?:Permit|Authorization|Card|Registration)\s*(?:No|Number)?\s*[:\-]?\s*([A-Z0-9\-\/]{6,18})", r"\b([A-Z0-9]{8,14})\b"],
        "permit_type": [r"(?:Permit|Pass|Card)\s*Type\s*[:\-]?\s*([A-Z\s]+?)(?=\n|$)", r"(Residence|Work|Student|Entry|Travel|Permanent\s*Resident)\s*(?:Permit|Card|Authorization)", r"\b(RESIDENCE\s*PERMIT|WORK\s*PERMIT|STUDENT\s*PERMIT|TRAVEL\s*DOCUMENT)\b"],
        "full_name": [r"(?:Name|Nom|Holder|Bearer|Applicant)\s*[:\-]?\s*([A-Z\s]+?)(?=\n|DOB|Date|Validity|Valid|$)", rf"\b{_TITLE}\b"],
        "nationality": [r"(?:Nationality|Country\s*of\s*Citizenship)\s*[:\-]?\s*([A-Z]+)"],
        "date_of_birth": [rf"(?:DOB|Date\s*of\s*Birth|Birth\s*Date)\s*[:\-]?\s*({_DATE})"],
        "valid_from": [rf"(?:Valid\s*From|Date\s*of\s*Issue|Issue\s*Date|From)\s*[:\-]?\s*({_DATE})"],
        "valid_until": [rf"(?:Validity|Valid\s*Until|Expiry\s*Date|Date\s*of\s*Expiry|Until)\s*[:\-]?\s*({_DATE})"],
        "issuing_authority": [r"(?:Issuing\s*Authority|Authority|Issued\s*By)\s*[:\-]?\s*([A-Z\s]+?)(?=\n|$)", r"(Immigration\s*(?:Department|Office|Bureau|Authority)|Home\s*Affairs|Ministry\s*of\s*Interior)"],
    },
    "travel": {
        "authorization_number": [r"(?:Authorization|Application|Reference|Confirmation|eTA)\s*(?:No|Number)?\s*[:\-]?\s*([A-Z0-9\-\/]{7,18})", r"\b([A-Z]\d{8,14})\b", r"\b(\d{10,16})\b"],
        "authorization_status": [r"(?:Authorization\s*Status|Status)\s*[:\-]?\s*(AUTHORIZATION\s*APPROVED|APPROVED|VALID|ISSUED)", r"\b(AUTHORIZATION\s*APPROVED|APPROVED)\b"],
        "full_name": [r"(?:Applicant\s*Name|Full\s*Name|Name|Nom)\s*[:\-]?\s*([A-Z\s]+?)(?=\n|DOB|Date|Passport|Nationality|$)", rf"\b{_TITLE}\b"],
        "passport_number": [r"(?:Passport\s*(?:No|Number)|Document\s*Number)\s*[:\-]?\s*([A-Z0-9]{7,12})"],
        "nationality": [r"(?:Country\s*of\s*Citizenship|Nationality|Country)\s*[:\-]?\s*([A-Z\s]+?)(?=\n|$)"],
        "date_of_birth": [rf"(?:DOB|Date\s*of\s*Birth|Birth\s*Date)\s*[:\-]?\s*({_DATE})"],
        "date_of_issue": [rf"(?:Date\s*of\s*Issue|Authorization\s*Date|Issued|Issue\s*Date)\s*[:\-]?\s*({_DATE})"],
        "date_of_expiry": [rf"(?:Expiration\s*Date|Expiry\s*Date|Valid\s*Until|Expires)\s*[:\-]?\s*({_DATE})"],
        "issuing_authority": [r"(?:Issuing\s*Authority|Department|Agency)\s*[:\-]?\s*([A-Z\s]+?)(?=\n|$)", r"(Customs\s*and\s*Border\s*Protection|Department\s*of\s*Home\s*Affairs|Immigration\s*Authority)"],
    },
    "licence": {
        "license_number": [r"\b([A-Z]{2}\d{13,16})\b", r"(?:DL|License|Licence)\s*(?:No|Number)?\s*[:\-]?\s*([A-Z]{2}\d{13,16})", r"\b([A-Z]{2}[-\s]?\d{2}[-\s]?\d{11,14})\b", r"(?:DL|License|Licence)\s*(?:No|Number)?\s*[:\-]?\s*([A-Z0-9\-\/]{8,20})"],
        "full_name": [r"Name\s*[:\-\._;]?\s*([A-Z][A-Z!\s]{3,40}?)(?=\s*(?:Date|DOB|Holder|aides|alae|ae|sur|\"|\n|$))", r"Name\s*[:\-\._;]?\s*([A-Z][A-Z!\s]+?)(?=\n|$)", r"(?:Holder|Driver)\s*[:\-]?\s*([A-Z][A-Z!\s]+?)(?=\n|$)"],
        "date_of_birth": [rf"(?:DOB|Date\s*[Oo][f!]\s*Birth)\s*[:\-\.;]?\s*({_DATE})"],
        "date_of_issue": [rf"(?:Issue\s*Date|DOI|Date\s*of\s*Issue|Issued)\s*[:\-]?\s*(?:Validity[^\n]*\n\s*)?({_DATE_COLON})", rf"(?:Issue\s*Date|DOI|Date\s*of\s*Issue)\s*[:\-]?\s*({_DATE_COLON})"],
        "blood_group": [r"Blood\s*Group\s*[:\-\.;]?\s*([ABO]{1,2}[+-]?)"],
        "guardian_name": [r"(?:Son|Daughter|Wife|Wite|Wile|S/O|D/O|W/O|Son/Daughter['\s]*(?:Wife|Wite|Wile)\s*(?:of|ot))\s*[:\-]?\s*([A-Z!][A-Z!\s]{3,40}?)(?=\s*[:\d]|\n|$|Address)"],
        "address": [r"Address\s*[:\-]?\s*\n?\s*(.+(?:\n.+){0,3}?)(?=\n\s*$|\nDate of|$)"],
        "issuing_authority": [r"(?:Issued\s*by|Issuing\s*Authority)\s*[:\-]?\s*([A-Za-z\s]+?)(?=\n|$)"],
        "gender": [r"\b(?:Sex|Gender)\s*[:\-]?\s*([MF])\b"],
    },
    "national_id": {
        "id_number": [r"\b(\d{4}\s\d{4}\s\d{4})\b", r"\b(\d{12})\b", r"(?:ID|Aadhaar|Card)\s*(?:No|Number)?\s*[:\-]?\s*([A-Z0-9\s]{8,16})"],
        "date_of_birth": [rf"(?:SA/DOB|DOB|Date\s*of\s*Birth|/DOB)\s*[:\-]?\s*({_DATE})", r"(?:Year\s*of\s*Birth|YOB)\s*[:\-]?\s*(\d{4})"],
        "guardian_name": [r"(?:S/O|D/O|W/O|Son/Daughter[^\n]*of)\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})"],
        "vid": [r"VID\s*[:\-]?\s*([\d\s]{19,23})"],
    },
}
#: Fixed values.
NAME_JUNK = "ae|aides|Sigratze|SS|SJ|wer|var|sur|Ave|alae|Sppase"
GUARDIAN_JUNK = r"ae|aides|SS|SJ|wer|var|\d"
TITLE_LINE = r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4}$"
RELATION_LINE = r"^(?:(?iu:[SDWF][/\\][ODWF]\s+)|(?:Son|Daughter|Wife|Father|Mother)\s*[/\\]?[Oo])"
ADDRESS_STOP = r"(?iu)\b(S/O|D/O|W/O|Address|VTC|PIN|Mobile|District|State)\b"
NOT_A_NAME = r"\b(India|Aadhaar|Authority|Identification|Government|Verification|citizenship|scanning)\b"
ADDRESS_START = r"(?iu)^\d+-\d+"
ADDRESS_WORDS = ("VTC", "District", "State", "PIN")
NOT_ADDRESS = r"(?iu)\b(Aadhaar|UIDAI|Your|Mobile|VID|Signature)\b"


def iso_all(*dates: Column) -> Column:
    """The ISO dates of several columns, as an array."""
    return F.transform(F.array(*dates), lambda d: iso_or_null(d))


def tried(docs: DataFrame, kind: str, text: Column) -> DataFrame:
    """The raw values of a type's patterns, as the struct x."""
    return docs.withColumn("x", once(text, lambda t: F.struct(*[find_first(t, p).alias(n) for n, p in PATTERNS[kind].items()])))


def x(name: str) -> Column:
    return F.col("x")[name]


def _add(docs: DataFrame, **values: Column) -> DataFrame:
    return docs.withColumns({f"f_{k}": v for k, v in values.items()})


def _dates() -> dict[str, Column]:
    return {k: F.col("f_iso")[i] for i, k in enumerate(("date_of_birth", "date_of_issue", "date_of_expiry"))}


def _same(*names: str) -> dict[str, Column]:
    return {n: x(n) for n in names}


def _count(*values: Column) -> Column:
    return sum((F.when(present(v), 1).otherwise(0) for v in values[1:]), F.when(present(values[0]), 1).otherwise(0))


def visa(docs: DataFrame, text: str = "normalized_text") -> DataFrame:
    docs = tried(docs, "visa", F.col(text))
    both = missing(x("surname")) & missing(x("given_name"))
    name = x("name")
    docs = _add(
        docs,
        surname=F.when(both, last_word(name)).otherwise(x("surname")),
        given_name=F.when(both, F.when(~name.contains(" "), name).otherwise(all_but_last(name))).otherwise(x("given_name")),
        iso=iso_all(x("date_of_birth"), x("date_of_issue"), x("date_of_expiry")),
    )
    return _add(
        docs,
        **_dates(),
        **_same("visa_number", "visa_type", "issuing_post", "passport_number", "number_of_entries", "duration_of_stay"),
        full_name=full_name("f_given_name", "f_surname"),
        nationality=country_code(x("nationality")),
        gender=gender(x("gender")),
        n_present=_count(x("visa_number"), x("visa_type"), x("passport_number"), F.col("f_surname"), x("date_of_issue"), x("date_of_expiry")),
    )


def permit(docs: DataFrame, text: str = "normalized_text") -> DataFrame:
    docs = _add(tried(docs, "permit", F.col(text)), iso=iso_all(x("date_of_birth"), x("valid_from"), x("valid_until")))
    return _add(
        docs,
        **_dates(),
        **_same("permit_number", "full_name"),
        permit_type=F.coalesce(F.nullif(x("permit_type"), F.lit("")), F.lit("Residence Permit")),
        surname=surname_of(x("full_name")),
        given_name=given_of(x("full_name")),
        nationality=nationality(x("nationality")),
        issuing_authority=F.coalesce(F.nullif(x("issuing_authority"), F.lit("")), F.lit("Immigration / Home Affairs Department")),
        n_present=_count(x("permit_number"), x("full_name"), x("valid_until")),
    )


def travel(docs: DataFrame, text: str = "normalized_text") -> DataFrame:
    docs = _add(tried(docs, "travel", F.col(text)), iso=iso_all(x("date_of_birth"), x("date_of_issue"), x("date_of_expiry")))
    return _add(
        docs,
        **_dates(),
        **_same("authorization_number", "full_name", "passport_number"),
        authorization_status=F.coalesce(F.nullif(x("authorization_status"), F.lit("")), F.lit("APPROVED")),
        surname=surname_of(x("full_name")),
        given_name=given_of(x("full_name")),
        nationality=nationality(x("nationality")),
        issuing_authority=F.coalesce(F.nullif(x("issuing_authority"), F.lit("")), F.lit("Border & Travel Authorization Agency")),
        n_present=_count(x("authorization_number"), x("full_name"), x("passport_number"), F.col("f_iso")[2]),
    )


def licence(docs: DataFrame, raw: str = "raw_text", normalized: str = "normalized_text") -> DataFrame:
    docs = docs.withColumn("y_text", F.concat_ws("\n", F.col(raw), F.col(normalized)))
    docs = tried(docs, "licence", F.col("y_text"))
    # Each date is written again with slashes.
    found = F.regexp_extract_all(F.col("y_text"), F.lit(r"\b(\d{1,2}[\/\-\.:'°]\d{1,2}[\/\-\.:'°]\d{4})\b"))
    docs = docs.withColumn("y_dates", F.transform(found, lambda d: F.regexp_replace(d, r"[\-\.:'°]", "/")))
    dates = F.col("y_dates")
    docs = _add(docs, full_name=clean_noise(x("full_name"), NAME_JUNK), guardian_name=clean_noise(x("guardian_name"), GUARDIAN_JUNK))
    docs = docs.withColumns({
        "y_issue": F.coalesce(F.nullif(F.replace(x("date_of_issue"), F.lit(":"), F.lit("/")), F.lit("")), first_in_years(dates, 2020, 2030)),
        "y_expiry": first_in_years(dates, 2031, other_than=x("date_of_birth")),
    })
    docs = _add(docs, iso=iso_all(x("date_of_birth"), F.col("y_issue"), F.col("y_expiry")))
    return _add(
        docs,
        **_dates(),
        **_same("license_number", "blood_group", "address"),
        surname=surname_of("f_full_name"),
        given_name=given_of("f_full_name"),
        issuing_authority=F.coalesce(F.nullif(x("issuing_authority"), F.lit("")), F.lit("Transport Department / Licensing Authority")),
        gender=gender(x("gender")),
        n_present=_count(x("license_number"), F.col("f_full_name"), x("date_of_birth"), F.col("y_issue"), F.col("y_expiry"), F.col("f_guardian_name")),
    )


def above(ls: Column, anchor: Column, n: int, want) -> Column:
    """Nearest of the n lines above each anchor index that is wanted; of the first anchor that has one."""
    each = F.transform(anchor, lambda i: F.get(F.filter(F.reverse(F.slice(ls, F.greatest(i - n + 1, F.lit(1)), F.least(i, F.lit(n)))), want), F.lit(0)))
    return F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))


def indices(ls: Column, want) -> Column:
    """Places (from 0) of the lines that are wanted."""
    return F.transform(F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), want(x).alias("ok"))), lambda s: s["ok"]), lambda s: s["i"])


def after_marker(ls: Column, marker, want, stop) -> Column:
    """First wanted line after a marker line, unless a stopping line comes before it."""
    marks = indices(ls, marker)
    rest = F.when(F.size(marks) > 0, F.slice(ls, F.get(marks, F.lit(0)) + 2, F.size(ls)))
    # Further marker lines are passed over; a wanted line is taken before it is tried as a stop.
    seen = F.filter(rest, lambda x: ~marker(x) & (want(x) | stop(x)))
    first = F.get(seen, F.lit(0))
    return F.when(want(first), first)


def between(ls: Column, start, stop, skip, most: int) -> Column:
    """Lines from a starting line to a stopping one, without those to skip; the first ``most`` joined by commas."""
    state = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        on = acc["on"] | start(line)
        take = on & (line != "") & ~skip(line)
        return F.struct((on & ~stop(line)).alias("on"), F.when(take, F.array_append(acc["out"], line)).otherwise(acc["out"]).alias("out"))

    out = F.aggregate(ls, state, step)["out"]
    return F.when(F.size(out) > 0, F.array_join(F.slice(out, 1, most), ", "))


def national_id(docs: DataFrame, text: str = "normalized_text", address_words: tuple[str, ...] = ADDRESS_WORDS) -> DataFrame:
    """address_words: what begins an address besides a house number; places of a region may be added."""
    body = F.col(text)
    docs = tried(docs, "national_id", body).withColumns({"y_lines": lines(body, keep_blank=True), "y_upper": F.upper(body)})
    ls, upper = F.col("y_lines"), F.col("y_upper")
    title = lambda s: s.rlike(TITLE_LINE) & (F.length(s) > 4)
    docs = docs.withColumns({"y_relations": indices(ls, lambda s: s.rlike(RELATION_LINE)), "y_births": F.slice(indices(ls, lambda s: s.rlike(r"(?iu)DOB|Date\s*of\s*Birth")), 1, 1)})
    name = F.coalesce(
        above(ls, F.col("y_relations"), 3, title),
        after_marker(ls, lambda s: F.lower(s) == "to", title, lambda s: s.rlike(ADDRESS_STOP)),
        above(ls, F.col("y_births"), 3, title),
        F.get(F.filter(ls, lambda s: s.rlike(TITLE_LINE) & ~s.rlike(NOT_A_NAME) & (F.length(s) > 5)), F.lit(0)),
    )
    words = rf"(?iu)\b({'|'.join(address_words)})\b"
    docs = _add(
        docs,
        id_number=group_id(x("id_number")),
        full_name=name,
        gender=F.when(body.rlike(r"(?iu)\b(?:FEMALE|WOMAN)\b"), "F").when(body.rlike(r"(?iu)\b(?:MALE|MAN)\b"), "M"),
        address=between(ls, lambda s: s.rlike(ADDRESS_START) | s.rlike(words), lambda s: s.rlike(r"(?iu)PIN\s*Code"), lambda s: s.rlike(NOT_ADDRESS), 5),
    )
    return _add(
        docs,
        surname=surname_of("f_full_name"),
        given_name=given_of("f_full_name"),
        nationality=F.when(upper.contains("AADHAAR") | upper.contains("INDIA"), "INDIAN"),
        date_of_birth=iso_or_null(x("date_of_birth")),
        guardian_name=x("guardian_name"),
        vid=group_vid(x("vid")),
        id_type=F.when(upper.contains("AADHAAR"), "Aadhaar Card").otherwise("National ID"),
        issuing_authority=F.when(upper.contains("AADHAAR"), "Unique Identification Authority of India (UIDAI)").otherwise("National ID Authority"),
        n_present=_count(F.col("f_id_number"), F.col("f_full_name"), x("date_of_birth"), F.col("f_gender")),
    )


#: Fixed values.
SURNAME_LABEL = r"(?iu)\b(?:Surname|wae|waa|Suaia)\b"
GIVEN_LABEL = r"(?iu)\b(?:Given\s*Name|Given\s*Names|frat|fear)\b"
NOT_SURNAME = ("SURNAME", "TYPE", "CODE", "COUNTRY", "PASSPORT", "INDIA", "REPUBLIC", "INDIAN", "IND", "GIVEN", "NAME")
NOT_GIVEN = ("GIVEN", "NAME", "NAMES", "GIVENNAMES", "SEX", "NATIONALITY", "INDIA", "REPUBLIC", "INDIAN", "IND", "SURNAME", "NEMES")
NATIONALITIES = r"(?iu)\b(INDIAN|IND|AMERICAN|BRITISH|CANADIAN|NORWEGIAN|GERMAN|FRENCH|AUSTRALIAN)\b"
CITIES = ("HYDERABAD", "MUMBAI", "DELHI", "CHENNAI", "BANGALORE", "PUNE", "KOLKATA", "AHMEDABAD", "JAIPUR", "LUCKNOW")
ISSUE_LABEL = "(?iu)Date\\s*of\\s*Issue|जारी[^\\n]*तिथि"
BIRTHPLACE_LABEL = "(?iu)Place\\s*of\\s*Birth|जन्म\\s*स्थान"
ISSUEPLACE_LABEL = "(?iu)Place\\s*of\\s*Issue|जारी[^\\n]*स्थान"
LEADING_MARKS = r"^[\"'\x91\x92`|\-\s]+"
_FULL_DATE = r"\d{2}[/\-.]\d{2}[/\-.]\d{4}"


def _caps(line: Column, without: tuple[str, ...]) -> Column:
    words = F.regexp_extract_all(line, F.lit(r"\b([A-Z]{3,})\b"))
    return F.filter(words, lambda w: ~w.isin(*without))


def _window_words(ls: Column, i: Column, without: tuple[str, ...]) -> Column:
    """Wanted words of the first of lines i, i + 1, i + 2 that has any; null if none."""
    found = F.filter(F.transform(F.slice(ls, i + 1, 3), lambda s: _caps(s, without)), lambda w: F.size(w) > 0)
    return F.get(found, F.lit(0))


def _value_at(ls: Column, i: Column, pattern: str) -> Column:
    """What follows a label on line i, else the next line that isn't empty (of three), if it is all capitals."""
    value = F.trim(F.regexp_extract(F.get(ls, i), rf"(?iu)(?:{pattern})[\s/:\-'|]*([A-Z][A-Z\s,\.]+?)\s*$", 1))
    following = F.filter(F.transform(F.slice(ls, i + 2, 3), lambda s: F.trim(F.regexp_replace(s, LEADING_MARKS, ""))), lambda s: s != "")
    below = F.filter(F.slice(following, 1, 1), lambda s: s.rlike(r"^[A-Z][A-Z\s,\.]{2,}$"))
    return F.when(i.isNotNull(), F.when(F.length(value) > 2, collapse(value)).otherwise(collapse(F.get(below, F.lit(0)))))


def _day(d: Column) -> Column:
    return F.try_to_date(F.translate(d, "-.", "//"), "dd/MM/yyyy")


def _pairs(ls: Column) -> Column:
    """The earlier date of each line that has exactly two real ones."""
    found = F.filter(F.transform(ls, lambda s: F.regexp_extract_all(s, F.lit(f"({_FULL_DATE})"))), lambda d: F.size(d) == 2)
    days = F.transform(found, lambda d: F.transform(d, lambda t: F.struct(_day(t).alias("day"), t.alias("raw"))))
    real = F.filter(days, lambda d: F.forall(d, lambda t: t["day"].isNotNull()))
    return F.transform(real, lambda d: F.when(d[0]["day"] < d[1]["day"], d[0]["raw"]).otherwise(d[1]["raw"]))


def passport_visual(docs: DataFrame, text: str = "normalized_text", towns: str | None = None, cities: tuple[str, ...] = CITIES) -> DataFrame:
    """The visual zone's fields, as v_ columns. towns: pattern of birthplaces to look for as a last resort (none by default)."""
    body, ls = F.col(text), F.col("y_lines")
    docs = docs.withColumn("y_lines", lines(body))
    one = lambda label: F.get(indices(ls, lambda s: s.rlike(label)), F.lit(0))
    docs = docs.withColumns({
        "y_givens": indices(ls, lambda s: s.rlike(GIVEN_LABEL)),
        "y_issues": indices(ls, lambda s: s.rlike(ISSUE_LABEL)),
        "y_issue_line": F.slice(indices(ls, lambda s: s.rlike(r"(?iu)Date\s*of\s*Issue")), 1, 1),
        "y_born_at": one(BIRTHPLACE_LABEL),
        "y_issued_at": one(ISSUEPLACE_LABEL),
        "y_pairs": _pairs(ls),
        "y_dates": F.regexp_extract_all(body, F.lit(rf"\b({_FULL_DATE})\b")),
    })
    # A surname label opens a window of three lines; a given-name label names the line before it.
    steps = F.transform(
        ls,
        lambda s, i: F.coalesce(
            F.when(s.rlike(SURNAME_LABEL), F.get(_window_words(ls, i, NOT_SURNAME), F.lit(0))),
            F.when(s.rlike(GIVEN_LABEL) & (i > 0), F.get(_caps(F.get(ls, i - 1), NOT_SURNAME), F.lit(0))),
        ),
    )
    first = lambda a: F.get(F.filter(a, lambda v: v.isNotNull()), F.lit(0))
    labelled_sex = r"(?iu)\b(?:Sex|Gender|fert)[\s/:\-]*([MFX])\b"
    sex = (
        F.when(body.rlike(labelled_sex), F.upper(F.regexp_extract(body, labelled_sex, 1)))
        .when(body.rlike(r"\b(?:Sex|fert)\b.*?\bM\b"), "M")
        .when(body.rlike(r"\b(?:Sex|fert)\b.*?\bF\b"), "F")
        .when(body.rlike(r"\bF\b"), "F")
        .when(body.rlike(r"\bM\b") & ~body.rlike(r"\b(AM|PM|MERA)\b"), "M")
    )
    issue = first(F.transform(F.col("y_issues"), lambda i: F.get(F.filter(F.transform(F.slice(ls, i + 1, 3), lambda s: F.regexp_extract(s, f"({_FULL_DATE})", 1)), lambda d: d != ""), F.lit(0))))
    capitals = lambda s: s.rlike("^[A-Z]{4,}$") | s.rlike(r"^[A-Z][A-Z\s]{3,}$")
    bare = F.transform(ls, lambda s: F.trim(F.regexp_replace(s, LEADING_MARKS, "")))
    known = lambda pattern: F.upper(collapse(F.nullif(F.regexp_extract(body, rf"(?iu)\b({pattern})\b", 1), F.lit(""))))
    docs = docs.withColumns({
        "v_passport_number": F.nullif(F.regexp_extract(body, r"\b([A-Z]\d{7,8})\b", 1), F.lit("")),
        "v_surname": first(steps),
        "v_given_name": F.array_join(first(F.transform(F.col("y_givens"), lambda i: _window_words(ls, i, NOT_GIVEN))), " "),
        "v_nationality": F.upper(F.nullif(F.regexp_extract(body, NATIONALITIES, 1), F.lit(""))),
        "v_gender": sex,
        "y_labelled": issue,
        "y_assigned": assign_dates(F.col("y_dates")),
        "v_place_of_birth": F.coalesce(_value_at(ls, F.col("y_born_at"), r"Place\s*of\s*Birth"), known(towns) if towns else F.lit(None)),
        "v_place_of_issue": F.coalesce(_value_at(ls, F.col("y_issued_at"), r"Place\s*of\s*Issue"), above(bare, F.col("y_issue_line"), 3, capitals), known("|".join(cities))),
    })
    docs = docs.withColumns({"v_date_of_birth": F.col("y_assigned.birth"), "v_date_of_expiry": F.col("y_assigned.expiry"), "y_second": F.col("y_assigned.issue")})
    differs = lambda d: F.coalesce(d != F.col("v_date_of_birth"), F.lit(True))
    # The label's date, else the earlier of a line's two that isn't the birth date; not if it is the birth date.
    docs = docs.withColumn("y_override", F.coalesce(F.col("y_labelled"), F.get(F.filter(F.col("y_pairs"), differs), F.lit(0))))
    return docs.withColumn("v_date_of_issue", F.when(F.col("y_override").isNotNull() & differs(F.col("y_override")), F.col("y_override")).otherwise(F.col("y_second")))
