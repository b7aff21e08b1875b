"""Scores, levels, field confidences and manual-review reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col, missing

#: How many fields count, and the least scores of levels.
TOTALS = {"passport": 7, "visa": 6, "national_id": 4, "licence": 6, "permit": 3, "travel": 4}
LEGACY_TOTALS = {"passport": 7, "visa": 6, "national_id": 4, "licence": 3, "permit": 1}
LEVELS: dict[str, tuple[tuple[float, str], ...]] = {
    "passport": ((80, "HIGH"), (55, "MEDIUM")),
    "visa": ((80, "HIGH"), (50, "MEDIUM")),
    "national_id": ((75, "HIGH"), (50, "MEDIUM")),
    "licence": ((75, "HIGH"), (50, "MEDIUM")),
    "travel": ((75, "HIGH"), (50, "MEDIUM")),
    "permit": ((70, "HIGH"), (40, "MEDIUM")),
    "legacy": ((90, "VERY HIGH"), (75, "HIGH"), (50, "MEDIUM")),
    "combiner": ((85, "HIGH"), (65, "MEDIUM")),
    "points": ((80, "HIGH"), (55, "MEDIUM")),
}


def count_present(*values: Column | str) -> Column:
    return F.size(F.filter(F.array(*[col(v).cast("string") for v in values]), lambda x: x.isNotNull() & (x != "")))


def share(part: Column, total: Column | int) -> Column:
    """Percentage, two places."""
    total = F.lit(total) if isinstance(total, int) else total
    return F.round(part / total * 100.0, 2)


def completeness(kind: str, n_present: Column, legacy: bool = False) -> Column:
    return share(n_present, (LEGACY_TOTALS if legacy else TOTALS)[kind])


def level(score: Column, kind: str) -> Column:
    out = F
    for least, name in LEVELS[kind]:
        out = out.when(score >= least, name)
    return out.otherwise("LOW")


def consistency_live(comparisons: Column) -> Column:
    """Share of MATCH among all comparisons; 0 without any."""
    n = F.size(F.map_values(comparisons))
    hits = F.size(F.filter(F.map_values(comparisons), lambda v: v == "MATCH"))
    return F.when(comparisons.isNull() | (n == 0), F.lit(0.0)).otherwise(share(hits, n))


def consistency_legacy(comparisons: Column) -> Column:
    """Share of MATCH among those that are MATCH or DIFFERENT; 0 without any."""
    of = lambda *k: F.size(F.filter(F.map_values(comparisons), lambda v: v.isin(*k)))
    return F.when(of("MATCH", "DIFFERENT") > 0, share(of("MATCH"), of("MATCH", "DIFFERENT"))).otherwise(F.lit(0.0))


def confidence_live(has_mrz: Column, mrz_score: Column, complete: Column, consistent: Column) -> Column:
    return F.when(has_mrz, F.round(mrz_score * 0.5 + complete * 0.25 + consistent * 0.25, 2)).otherwise(F.round(complete * 0.7, 2))


def confidence_legacy(mrz_valid: Column, complete: Column, consistent: Column, mrz_confidence: Column | None = None) -> Column:
    """mrz_confidence is 0 where the engine that feeds it doesn't write it."""
    mrz = F.lit(0.0) if mrz_confidence is None else F.coalesce(mrz_confidence, F.lit(0.0))
    return F.round(F.when(mrz_valid, mrz * 0.5 + consistent * 0.3 + complete * 0.2).otherwise(complete * 0.7 + consistent * 0.3), 2)


def confidence_combiner(checks: list[Column], mrz_score: Column) -> Column:
    """60 % share of true checks among those known, 40 % score of the zone; whole number, at most 100; 0 without checks."""
    known = F.filter(F.array(*checks), lambda x: x.isNotNull())
    part = F.size(F.filter(known, lambda x: x)) / F.size(known) * 100
    return F.when(F.size(known) == 0, F.lit(0)).otherwise(F.least(F.round(part * 0.6 + mrz_score.cast("double") * 0.4), F.lit(100.0)).cast("int"))


def confidence_points(mrz_score: Column, number_ok: Column, birth_ok: Column, expiry_ok: Column, nationality_match: Column, gender_match: Column) -> Column:
    bonus = [(20, number_ok), (15, birth_ok), (15, expiry_ok), (5, nationality_match), (5, gender_match)]
    base = F.when(mrz_score >= 80, 40).when(mrz_score >= 60, 30).when(mrz_score >= 40, 20).otherwise(10)
    return F.least(sum((F.when(F.coalesce(ok, F.lit(False)), n).otherwise(0) for n, ok in bonus), base), F.lit(100))


def status_legacy(mrz_valid: Column, score: Column) -> Column:
    return F.when(F.coalesce(mrz_valid, F.lit(False)), "VERIFIED").when(score >= 70, "PROCESSED").otherwise("REVIEW_REQUIRED")


def _confidence(value: Column, base: Column, quality: Column | None) -> Column:
    penalty = F.lit(1.0) if quality is None else F.when(quality >= 70.0, 1.0).otherwise(quality / 100.0)
    gone = value.isNull() | F.trim(value).isin("N/A", "None", "")
    return F.when(gone, 0.0).otherwise(F.greatest(F.lit(10.0), F.least(F.lit(100.0), F.round(base * penalty, 2))))


def field_confidence(identity: dict[str, Column], document: dict[str, Column], comparisons: Column, mrz_valid: Column, quality: Column | None = None) -> Column:
    """Map of field to confidence from presence, cross-checks, the zone's validity and image quality."""
    result = lambda k: F.try_element_at(comparisons, F.lit(k))
    valid = F.coalesce(mrz_valid, F.lit(False))
    pairs: list[Column] = []
    for k, v in identity.items():
        base = F.when(result(k) == "MATCH", 100.0).when(result(k) == "DIFFERENT", 40.0).when(result(k) == "MISSING_OCR", F.when(valid, 75.0).otherwise(50.0)).otherwise(85.0)
        pairs += [F.lit(k), _confidence(v, base, quality)]
    for k, v in document.items():
        base = F.lit(80.0)
        if k in ("document_number", "passport_number"):
            base = F.when(valid, 100.0).when(result("passport_number") == "MATCH", 95.0).when(result("passport_number") == "DIFFERENT", 40.0).otherwise(80.0)
        elif k in ("date_of_expiry", "date_of_issue"):
            base = F.when(result(k) == "MATCH", 95.0).when(result(k) == "DIFFERENT", 45.0).otherwise(80.0)
        pairs += [F.lit(k), _confidence(v, base, quality)]
    return F.create_map(*pairs)


def review_reasons(confidence: Column, comparisons: Column | None, fields: tuple[str, ...], mrz_available: Column, mrz_valid: Column, full_name: Column, number: Column, blur: Column | None = None, quality: Column | None = None) -> Column:
    """Why a person must look at the document, in order; empty if no one need."""
    reasons = [F.when(confidence < 75.0, F.concat(F.lit("Overall confidence score is low ("), confidence.cast("string"), F.lit("%)")))]
    if comparisons is not None:
        reasons += [F.when(F.try_element_at(comparisons, F.lit(f)) == "DIFFERENT", f"Cross-check mismatch on field: {f}") for f in fields]
    if blur is not None:
        reasons.append(F.when(blur == "BLURRY", "Image is noticeably blurry"))
    if quality is not None:
        reasons.append(F.when(quality < 50.0, "Image quality score is below acceptable threshold"))
    reasons += [
        F.when(mrz_available & ~F.coalesce(mrz_valid, F.lit(False)), "MRZ check digit checksum validation failed"),
        F.when(missing(full_name), "Primary identity full_name could not be extracted"),
        F.when(missing(number), "Primary document_number could not be extracted"),
    ]
    return F.array_compact(F.array(*reasons))


