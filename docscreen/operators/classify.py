"""Rule-table classifiers, compiled to one CASE expression each, and the router."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_of, col


@dataclass(frozen=True)
class Rule:
    """A label and its triggers: strings are contained; tuples hold strings that all are; words are bounded by non-word characters."""

    label: str
    contains: tuple[str | tuple[str, ...], ...] = ()
    words: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


#: Fixed values, in order of priority.
LIVE = (
    Rule("DRIVING_LICENSE", ("DRIVING LICENCE", "DRIVING LICENSE", "DRIVER LICENSE", "DL NO", "UNION OF INDIA DRIVING")),
    Rule("NATIONAL_ID", ("AADHAAR", "UNIQUE IDENTIFICATION", "IDENTITY CARD", "NATIONAL ID", ("GOVERNMENT OF INDIA", "ENROLMENT"), ("GOVERNMENT OF INDIA", "MERA AADHAAR"))),
    Rule("VISA", ("VISA TYPE", "VISA/CLASS", "ISSUING POST", "CONTROL NUMBER", ("BEARER", "VISA")), ("VISA", "VISUM")),
    Rule("TRAVEL_AUTH", ("ELECTRONIC TRAVEL AUTHORIZATION", "ESTA APPLICATION", "AUTHORIZATION APPROVED", "TRAVEL AUTHORIZATION", "ETA APPLICATION")),
    Rule("PERMIT", ("RESIDENCE PERMIT", "WORK PERMIT", "ENTRY PERMIT", "STAY PERMIT"), ("PERMIT",)),
    Rule("PASSPORT", ("PASSPORT", "REPUBLIC OF", "TRAVEL DOCUMENT", "P<")),
)
LEGACY_ENGINE = (
    Rule("National ID", ("AADHAAR", "UNIQUE IDENTIFICATION AUTHORITY OF INDIA")),
    Rule("Driving Licence", ("DRIVING LICENCE", "DRIVING LICENSE")),
    Rule("Visa", ("VISA TYPE", "VISA/CLASS", "ISSUING POST NAME")),
    Rule("Permit", ("PERMIT",)),
    Rule("Passport", ("PASSPORT", "REPUBLIC OF INDIA"), patterns=(r"\bP<[A-Z]{3}",)),
)
LEGACY_DETECTOR = (
    Rule("PASSPORT", ("PASSPORT", "REPUBLIC OF INDIA", "P<")),
    Rule("VISA", ("VISA", "ENTRY PERMIT")),
    Rule("DRIVING_LICENCE", ("DRIVING LICENCE", "DRIVING LICENSE", "DL NO")),
    Rule("NATIONAL_ID", ("AADHAAR", "IDENTITY CARD", "NATIONAL ID")),
    Rule("PERMIT", ("PERMIT",)),
)
CLASSIFIERS = {"live": (LIVE, "UNKNOWN"), "legacy_engine": (LEGACY_ENGINE, "Unknown"), "legacy_detector": (LEGACY_DETECTOR, "UNKNOWN")}


def classify(text: Column | str, classifier: str = "live") -> Column:
    """The label of the first rule that a text triggers."""
    rules, other = CLASSIFIERS[classifier]
    upper = F.upper(F.coalesce(col(text), F.lit("")))

    def hit(rule: Rule) -> Column:
        contains = [reduce(lambda a, b: a & b, [upper.contains(s) for s in ((t,) if isinstance(t, str) else t)]) for t in rule.contains]
        return any_of(*contains, *[upper.rlike(rf"\b{w}\b") for w in rule.words], *[upper.rlike(p) for p in rule.patterns])

    out = F.when(hit(rules[0]), rules[0].label)
    for rule in rules[1:]:
        out = out.when(hit(rule), rule.label)
    return out.otherwise(other)


#: What a type's name must contain for a processor, in this order.
ROUTES = (
    ("passport", ("PASSPORT",)),
    ("visa", ("VISA",)),
    ("national_id", ("NATIONAL_ID", "AADHAAR")),
    ("licence", ("DRIVING", "LICENSE", "LICENCE")),
    ("travel", ("TRAVEL_AUTH", "ESTA", "ETA")),
    ("permit", ("PERMIT", "RESIDENCE")),
)


def route(document_type: Column | str) -> Column:
    """Name of the processor for a document type; 'unknown' if there is none."""
    name = F.replace(F.upper(F.coalesce(col(document_type), F.lit(""))), F.lit(" "), F.lit("_"))
    out = F
    for processor, keys in ROUTES:
        out = out.when(any_of(*[name.contains(k) for k in keys]), processor)
    return out.otherwise("unknown")
