"""Compare and merge the machine-readable and the visual reading of one document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import four_layouts
from ..functions.lookup import compare_code, consistency_code, same_nationality
from ..functions.text import blank_to_null, col, compare_key_alnum, compare_key_compact, compare_key_text, first_present, missing, once, present

#: The fields compared, in order.
COMPARED = ("passport_number", "surname", "given_name", "nationality", "gender", "date_of_birth", "date_of_expiry")


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "<", " "), r"\s+", " "))


def _long_words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: F.length(w) >= 3)


def compare_live(field: str, mrz: Column | str, visual: Column | str, stream: Column) -> Column:
    """MATCH, DIFFERENT, MISSING_OCR, MISSING_MRZ or BOTH_MISSING. stream: the visual zone's ``tokens``."""
    both = F.struct(col(mrz).alias("m"), col(visual).alias("v"), stream.alias("s"))
    return once(both, lambda b: _compare(field, b["m"], b["v"], b["s"]))


def _compare(field: str, m: Column, v: Column, stream: Column) -> Column:
    within = lambda c: stream.contains(c)
    out = F.when(missing(m) & missing(v), "BOTH_MISSING")
    if field == "nationality":
        same = present(v) & (compare_code(m) == compare_code(v))
        return out.when(same | (present(m) & (within(F.upper(m)) | within(F.lit("INDIAN")) | within(F.lit("IND")))), "MATCH").otherwise("DIFFERENT")
    if field in ("date_of_birth", "date_of_expiry"):
        a, b = four_layouts(m), four_layouts(v)
        return (
            out.when(F.coalesce(a == b, F.lit(False)) | F.coalesce(within(F.substring(a, 1, 4)), F.lit(False)), "MATCH")
            .when(F.coalesce(F.trim(m), F.lit("None")) == F.coalesce(F.trim(v), F.lit("None")), "MATCH")
            .when(missing(v), "MISSING_OCR")
            .otherwise("DIFFERENT")
        )
    if field == "gender":
        same = present(v) & (F.trim(F.upper(F.coalesce(m, F.lit("None")))) == F.trim(F.upper(v)))
        return out.when(same | (present(m) & within(F.upper(m))), "MATCH").when(missing(v), "MISSING_OCR").otherwise("DIFFERENT")
    a, b = _flat(m), _flat(v)
    parts = F.split(a, " ")
    some = (F.size(parts) > 1) & F.exists(_long_words(a), within)
    return (
        out.when(missing(v), F.when(((a != "") & within(a)) | some, "MATCH").otherwise("MISSING_OCR"))
        .when(missing(m), "MISSING_MRZ")
        .when((a == b) | b.contains(a) | a.contains(b), "MATCH")
        .when(F.arrays_overlap(_long_words(a), _long_words(b)), "MATCH")
        .otherwise("DIFFERENT")
    )


def compare_all(mrz: Column, visual: dict[str, Column], stream: Column) -> Column:
    """Map of field to comparison. stream: the visual zone's ``tokens``."""
    pairs = [x for f in COMPARED for x in (F.lit(f), compare_live(f, mrz[f], visual[f], stream))]
    return F.create_map(*pairs)


def compare_legacy(ocr: Column | str, mrz: Column | str, is_date: bool = False) -> Column:
    """The strict comparison: equal after trimming, upper case and collapsing, or as dates."""
    a, b = blank_to_null(ocr), blank_to_null(mrz)
    key = four_layouts if is_date else compare_key_text
    return F.when(a.isNull() & b.isNull(), "BOTH_MISSING").when(a.isNull(), "MISSING_OCR").when(b.isNull(), "MISSING_MRZ").when(key(a) == key(b), "MATCH").otherwise("DIFFERENT")


def compare_tristate(ocr: Column | str, mrz: Column | str) -> Column:
    """Equal without spaces and fillers; null if either is missing."""
    return F.when(present(ocr) & present(mrz), compare_key_compact(ocr) == compare_key_compact(mrz))


def compare_engine(ocr: Column | str, mrz: Column | str) -> Column:
    """Equal by letters and digits; false if the visual reading is missing."""
    return F.coalesce(F.when(present(ocr), compare_key_alnum(ocr) == compare_key_alnum(F.coalesce(col(mrz), F.lit("")))), F.lit(False))


def consistency(ocr: dict[str, Column], mrz: dict[str, Column]) -> Column:
    """Struct of number, nationality and gender agreement, each null if either is missing."""
    both = lambda k, f: F.when(present(ocr[k]) & present(mrz[k]), f(ocr[k]) == f(mrz[k]))
    upper = lambda c: F.trim(F.upper(c))
    return F.struct(both("passport_number", upper).alias("passport_number_match"), both("nationality", consistency_code).alias("nationality_match"), both("gender", upper).alias("gender_match"))


def merge_live(mrz: Column | str, visual: Column | str) -> Column:
    """The machine-readable value if there is one."""
    return first_present(mrz, visual)


def merge_if_valid(mrz_valid: Column, mrz: Column | str, ocr: Column | str) -> Column:
    """The machine-readable value first, but only of a valid zone."""
    return F.when(F.coalesce(mrz_valid, F.lit(False)), first_present(mrz, ocr)).otherwise(first_present(ocr))


def merge_provenance(mrz: Column | str, ocr: Column | str, verified: Column) -> Column:
    """Struct of value, source, whether it was verified, the visual value and whether they match."""
    return F.struct(
        first_present(mrz, ocr).alias("value"),
        F.when(present(mrz), "MRZ").otherwise("OCR").alias("source"),
        F.coalesce(verified, F.lit(False)).alias("mrz_verified"),
        col(ocr).alias("ocr_value"),
        compare_tristate(ocr, mrz).alias("sources_match"),
    )


__all__ = ["COMPARED", "compare_all", "compare_engine", "compare_legacy", "compare_live", "compare_tristate", "consistency", "merge_if_valid", "merge_live", "merge_provenance", "same_nationality"]
