"""Machine-readable zone (TD3) arithmetic, repair, scoring and parsing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import century, mrz_date
from .lookup import gender
from .text import LINE, clean_mrz_line, col, collapse, once, pad_line, sl

#: Value of a character is its place here; others count 0.
VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Countries whose code speaks for a first line.
LIVE_COUNTRIES = ("IND", "USA", "GBR", "CAN", "AUS", "NOR")


def check_digit(c: Column | str, length: int | None = None) -> Column:
    """Weights 7, 3, 1 in turn, modulo 10; '' gives 0. With a known length the sum is unrolled, so it stays in generated code."""
    c = col(c)
    if length is not None:
        value = lambda i: F.greatest(F.instr(F.lit(VALUES), F.substring(c, i + 1, 1)) - 1, F.lit(0))
        # instr finds '' at 1, whose value is that of '0'
        return F.coalesce(sum(((7, 3, 1)[i % 3] * value(i) for i in range(1, length)), 7 * value(0)) % 10, F.lit(0))
    places = F.transform(F.split(c, ""), lambda ch, i: F.greatest(F.instr(F.lit(VALUES), ch) - 1, F.lit(0)) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int")))
    return F.when(c == "", F.lit(0)).otherwise(F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10)


def check_valid(value: Column, expected: Column, length: int | None = None, icao: bool = False) -> Column:
    """The digit agrees. A filler is wrong, or with icao stands for 0."""
    if icao:
        expected = F.when(expected == "<", F.lit("0")).otherwise(expected)
    return F.coalesce(F.when(expected.rlike("^[0-9]$"), check_digit(value, length) == expected.cast("int")), F.lit(False))


def normalize_line1(c: Column | str) -> Column:
    return pad_line(clean_mrz_line(c))


def normalize_line2(c: Column | str) -> Column:
    """Cleaned, repaired and padded."""
    return once(clean_mrz_line(c), _repair)


def _repair(line: Column) -> Column:
    line = F.when(line.rlike("^[A-Z0-9<]{9}[0-9][1I][A-Z]{3}"), F.concat(sl(line, 0, 10), F.substring(line, F.lit(12), F.length(line)))).otherwise(line)
    line = F.when(F.length(line) >= 13, F.concat(sl(line, 0, 10), F.translate(sl(line, 10, 13), "1", "I"), F.substring(line, F.lit(14), F.length(line)))).otherwise(line)
    return pad_line(line)


def _points(*pairs: tuple[int, Column]) -> Column:
    return sum((F.when(ok, points).otherwise(0) for points, ok in pairs[1:]), F.when(pairs[0][1], pairs[0][0]).otherwise(0))


@dataclass(frozen=True)
class Variant:
    """How candidates are found and scored."""

    least_length: int = 20
    countries: tuple[str, ...] = LIVE_COUNTRIES
    per_letter: bool = True
    composite_points: int = 0
    line2_digits: int = 0
    line2_above: int = 20
    pivot: int = 40
    checked_dates: bool = True
    repair_separator: bool = False


LIVE = Variant()
LEGACY = Variant(least_length=25, countries=("IND",), per_letter=False, composite_points=40, line2_digits=5, line2_above=-1, pivot=30, checked_dates=False, repair_separator=True)


def score_line1(c: Column | str, v: Variant = LIVE) -> Column:
    """Of a cleaned, unpadded line."""
    c = col(c)
    rest = F.substring(c, F.lit(6), F.length(c))
    letters = F.length(F.regexp_replace(rest, "[^A-Z]", ""))
    score = _points((20, c.startswith("P<")), (10, F.length(c) == 44), (20, sl(c, 2, 5).isin(*v.countries)), (20, rest.contains("<<")))
    return score + (letters if v.per_letter else F.when(letters >= 3, 10).otherwise(0))


def score_line2(line: Column | str, v: Variant = LIVE) -> Column:
    """Of a repaired line of 44 characters."""
    line = col(line)
    number, birth, expiry = sl(line, 0, 9), sl(line, 13, 19), sl(line, 21, 27)
    pairs = [
        (10, F.length(line) == 44),
        (10, number.rlike("^[A-Z0-9<]{9}$")),
        (10, sl(line, 9, 10).rlike("^[0-9]$")),
        (15, sl(line, 10, 13).rlike("^[A-Z]{3}$")),
        (15, birth.rlike("^[0-9]{6}$")),
        (10, sl(line, 20, 21).isin("M", "F", "X", "<")),
        (15, expiry.rlike("^[0-9]{6}$")),
        (30, check_valid(number, sl(line, 9, 10), 9)),
        (30, check_valid(birth, sl(line, 19, 20), 6)),
        (30, check_valid(expiry, sl(line, 27, 28), 6)),
    ]
    if v.composite_points:
        pairs.append((v.composite_points, check_valid(composite_data(line), sl(line, 43, 44), 39)))
    return _points(*pairs)


def composite_data(line: Column) -> Column:
    return F.concat(sl(line, 0, 10), sl(line, 13, 20), sl(line, 21, 43))


def candidates(text: Column | str, v: Variant = LIVE) -> tuple[Column, Column]:
    """Arrays of (score, -position, line) of possible first and second lines of a text."""
    cleaned = F.filter(F.transform(F.split(col(text), LINE), clean_mrz_line), lambda s: s != "")
    placed = F.transform(cleaned, lambda s, i: F.struct((-i).alias("at"), s.alias("s")))
    one = F.filter(placed, lambda p: p["s"].startswith("P<") & (F.length(p["s"]) >= v.least_length))
    two = F.filter(placed, lambda p: ~p["s"].startswith("P<") & (F.length(p["s"]) >= v.least_length))
    if v.line2_digits:
        two = F.filter(two, lambda p: F.length(F.regexp_replace(p["s"], "[^0-9]", "")) >= v.line2_digits)
    one = F.transform(one, lambda p: F.struct(score_line1(p["s"], v).alias("score"), p["at"].alias("at"), normalize_line1(p["s"]).alias("line")))
    two = F.transform(F.transform(two, lambda p: F.struct(p["at"].alias("at"), normalize_line2(p["s"]).alias("line"))), lambda p: F.struct(score_line2(p["line"], v).alias("score"), p["at"].alias("at"), p["line"].alias("line")))
    return one, F.filter(two, lambda p: p["score"] > v.line2_above)


def best_lines(text: Column | str, v: Variant = LIVE) -> Column:
    """Struct (line1, line2) of the highest scores, the earlier line of equals; null unless there are both."""
    one, two = candidates(text, v)
    a, b = F.array_max(one), F.array_max(two)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a["line"].alias("line1"), b["line"].alias("line2")))


def denoise_given(c: Column | str, strict: bool = False) -> Column:
    """Words without filler misreadings: none of K, C, E, X alone, none over four letters with two different ones at most, no run of K, C, E, X at the end.

    strict: drop words only if they are of one repeated filler letter, and leave the others whole.
    """
    words = F.filter(F.split(F.regexp_replace(col(c), "<", " "), " +"), lambda w: w != "")
    if strict:
        kept = F.filter(words, lambda w: ~w.rlike(r"^([KCEX])\1{2,}$"))
    else:
        kept = F.filter(words, lambda w: ~(w.rlike("^[KkCcEeXx]+$") | ((F.length(w) > 4) & (F.size(F.array_distinct(F.split(w, ""))) <= 2))))
        kept = F.filter(F.transform(kept, lambda w: F.regexp_replace(w, "[KkCcEeXx]{2,}$", "")), lambda w: w != "")
    return F.array_join(kept, " ")


def denoise_given_legacy(c: Column | str) -> Column:
    """Words of at most 12 letters with at most five K; the value itself if none is left."""
    value = F.nullif(F.trim(F.regexp_replace(F.upper(col(c)), r"\s+", " ")), F.lit(""))
    kept = F.array_join(F.filter(F.split(value, " "), lambda w: (F.length(w) <= 12) & (F.length(F.regexp_replace(w, "[^K]", "")) <= 5)), " ")
    return F.coalesce(F.nullif(kept, F.lit("")), value)


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<", " "), " +", " "))


def parse(lines: Column, v: Variant = LIVE, strict_names: bool = False, icao: bool = False) -> Column:
    """The record of a struct (line1, line2); null if that is null."""
    return once(lines, lambda z: _parse(z, v, strict_names, icao))


def _parse(lines: Column, v: Variant, strict_names: bool, icao: bool) -> Column:
    one, two = lines["line1"], lines["line2"]
    names = F.substring(one, F.lit(6), F.lit(39))
    if v.repair_separator:
        names = F.regexp_replace(names, "<[XI]<", "<<")
    halves = F.split(names, "<<", 2)
    apart = names.contains("<<")
    sex = sl(two, 20, 21)
    number_ok = check_valid(sl(two, 0, 9), sl(two, 9, 10), 9, icao)
    birth_ok = check_valid(sl(two, 13, 19), sl(two, 19, 20), 6, icao)
    expiry_ok = check_valid(sl(two, 21, 27), sl(two, 27, 28), 6, icao)
    digit = sl(two, 43, 44)
    composite_ok = F.when(digit.rlike("^[0-9]$"), check_valid(composite_data(two), digit, 39, icao))
    good = sum((F.when(x, 1).otherwise(0) for x in (birth_ok, expiry_ok, composite_ok)), F.when(number_ok, 1).otherwise(0))
    total = F.when(composite_ok.isNull(), 3).otherwise(4)
    return F.when(
        lines.isNotNull(),
        F.struct(
            one.alias("raw_line1"),
            two.alias("raw_line2"),
            F.regexp_replace(sl(one, 0, 2), "<", "").alias("document_code"),
            F.regexp_replace(sl(one, 2, 5), "<", "").alias("issuing_country"),
            _spaced(F.when(apart, halves[0]).otherwise(names)).alias("surname"),
            F.when(apart, denoise_given(F.get(halves, F.lit(1)), strict_names)).alias("given_name"),
            F.regexp_replace(sl(two, 0, 9), "<", "").alias("passport_number"),
            F.regexp_replace(sl(two, 10, 13), "<", "").alias("nationality"),
            mrz_date(sl(two, 13, 19), v.pivot, checked=v.checked_dates).alias("date_of_birth"),
            gender(F.when(sex.isin("M", "F", "X"), sex)).alias("gender"),
            mrz_date(sl(two, 21, 27), v.pivot, checked=v.checked_dates).alias("date_of_expiry"),
            F.regexp_replace(sl(two, 28, 42), "<", "").alias("optional_data"),
            number_ok.alias("valid_passport_number"),
            birth_ok.alias("valid_date_of_birth"),
            expiry_ok.alias("valid_date_of_expiry"),
            composite_ok.alias("valid_composite_check"),
            (good == total).alias("mrz_valid"),
            F.round(good / total * 100.0, 2).alias("mrz_validation_score"),
        ),
    )


def reader_record(r: Column) -> Column:
    """The record of an image reader's result: a struct with type, number, surname, names, nationality, date_of_birth, sex, expiration_date and valid_* (null if it read nothing)."""
    value = lambda k: F.nullif(collapse(F.regexp_replace(F.trim(r[k].cast("string")), "<+$", "")), F.lit(""))
    code = value("nationality")
    day = lambda k: once(F.trim(value(k)), lambda v: F.when(v.rlike("^[0-9]{6}$"), F.concat_ws("/", sl(v, 4, 6), sl(v, 2, 4), century(sl(v, 0, 2), 50))))
    return F.when(
        r.isNotNull(),
        F.struct(
            F.lit("Passport").alias("document_type"),
            F.when(r["type"].isin("P", "P<", "TD3"), "TD3").otherwise(r["type"]).alias("mrz_type"),
            value("number").alias("passport_number"),
            value("surname").alias("surname"),
            value("names").alias("given_name"),
            F.when(code == "IND", "INDIAN").otherwise(code).alias("nationality"),
            code.alias("nationality_code"),
            value("date_of_birth").alias("date_of_birth"),
            day("date_of_birth").alias("date_of_birth_formatted"),
            value("sex").alias("gender"),
            value("expiration_date").alias("date_of_expiry"),
            day("expiration_date").alias("date_of_expiry_formatted"),
            r["valid_score"].alias("mrz_valid_score"),
            r["valid_number"].alias("valid_passport_number"),
            r["valid_date_of_birth"].alias("valid_date_of_birth"),
            r["valid_expiration_date"].alias("valid_date_of_expiry"),
        ),
    )


#: Format predicates of the second line's fields.
FORMATS = {
    "document_code": "^P<$",
    "issuing_country": "^[A-Z]{3}$",
    "passport_number": "^[A-Z0-9]{6,9}$",
    "nationality": "^[A-Z]{3}$",
    "birth_digits": "^[0-9]{6}$",
    "sex": "^[MFX<]$",
    "expiry_digits": "^[0-9]{6}$",
}


def format_checks(lines: Column) -> Column:
    """Struct of the seven format predicates."""
    one, two = lines["line1"], lines["line2"]
    bare = lambda c: F.regexp_replace(c, "<", "")
    values = {"document_code": sl(one, 0, 2), "issuing_country": bare(sl(one, 2, 5)), "passport_number": bare(sl(two, 0, 9)), "nationality": bare(sl(two, 10, 13)), "birth_digits": sl(two, 13, 19), "sex": sl(two, 20, 21), "expiry_digits": sl(two, 21, 27)}
    return F.struct(*[F.coalesce(values[k].rlike(p), F.lit(False)).alias(k) for k, p in FORMATS.items()])


def legacy_validity(formats: Column, parsed: Column) -> Column:
    """Struct (confidence, mrz_valid): share of the four checks, a missing composite digit counting as failed, and all formats and checks."""
    checks = [F.coalesce(parsed[k], F.lit(False)) for k in ("valid_passport_number", "valid_date_of_birth", "valid_date_of_expiry", "valid_composite_check")]
    good = sum((F.when(x, 1).otherwise(0) for x in checks[1:]), F.when(checks[0], 1).otherwise(0))
    fine = F.lit(True)
    for k in FORMATS:
        fine = fine & formats[k]
    return F.struct(F.round(good / 4 * 100.0, 2).alias("confidence"), (fine & (good == 4)).alias("mrz_valid"))
