"""Dictionaries: one long table (dictionary, key, value), as map expressions and as a DataFrame to join."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import blank_to_null, col

#: Fixed values.
DICTIONARIES: dict[str, dict[str, str]] = {
    "gender": {
        **dict.fromkeys(("M", "MALE", "MAN", "MASCULINE", "HOMME", "VARÓN"), "M"),
        **dict.fromkeys(("F", "FEMALE", "WOMAN", "FEMININE", "FEMME", "MUJER"), "F"),
        **dict.fromkeys(("X", "OTHER", "NON-BINARY", "UNSPECIFIED", "<"), "X"),
    },
    "demonym": {
        **dict.fromkeys(("IND", "INDIAN", "INDIA"), "INDIAN"),
        **dict.fromkeys(("USA", "UNITED STATES", "AMERICAN"), "AMERICAN"),
        **dict.fromkeys(("GBR", "UNITED KINGDOM", "BRITISH"), "BRITISH"),
        **dict.fromkeys(("CAN", "CANADA", "CANADIAN"), "CANADIAN"),
        **dict.fromkeys(("AUS", "AUSTRALIA", "AUSTRALIAN"), "AUSTRALIAN"),
        **dict.fromkeys(("DEU", "GERMANY", "GERMAN"), "GERMAN"),
        **dict.fromkeys(("FRA", "FRANCE", "FRENCH"), "FRENCH"),
        **dict.fromkeys(("JPN", "JAPAN", "JAPANESE"), "JAPANESE"),
    },
    "alpha3": {
        **dict.fromkeys(("IND", "INDIAN", "INDIA"), "IND"),
        **dict.fromkeys(("USA", "UNITED STATES", "AMERICAN", "US"), "USA"),
        **dict.fromkeys(("GBR", "UNITED KINGDOM", "BRITISH", "UK"), "GBR"),
        **dict.fromkeys(("CAN", "CANADA", "CANADIAN"), "CAN"),
        **dict.fromkeys(("AUS", "AUSTRALIA", "AUSTRALIAN"), "AUS"),
        **dict.fromkeys(("DEU", "GERMANY", "GERMAN"), "DEU"),
        **dict.fromkeys(("FRA", "FRANCE", "FRENCH"), "FRA"),
        **dict.fromkeys(("JPN", "JAPAN", "JAPANESE"), "JPN"),
    },
    "compare_code": {"INDIAN": "IND", "IND": "IND", "USA": "USA", "AMERICAN": "USA", "GBR": "GBR", "BRITISH": "GBR", "CAN": "CAN", "CANADIAN": "CAN", "AUS": "AUS", "AUSTRALIAN": "AUS", "NOR": "NOR", "NORWEGIAN": "NOR", "DEU": "DEU", "GERMAN": "DEU", "FRA": "FRA", "FRENCH": "FRA"},
    "consistency_code": {"INDIAN": "IND", "NORWEGIAN": "NOR", "AMERICAN": "USA", "BRITISH": "GBR", "CANADIAN": "CAN", "AUSTRALIAN": "AUS"},
    "combiner_code": {"INDIAN": "IND", "NORWEGIAN": "NOR", "AMERICAN": "USA", "BRITISH": "GBR", "CANADIAN": "CAN", "AUSTRALIAN": "AUS", "GERMAN": "DEU", "FRENCH": "FRA", "SPANISH": "ESP", "ITALIAN": "ITA", "JAPANESE": "JPN", "CHINESE": "CHN"},
    "month": {m: f"{i:02d}" for i, m in enumerate(("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"), 1)},
    "mrz_type": {"P": "TD3", "P<": "TD3", "TD3": "TD3", "TD2": "TD2", "TD1": "TD1"},
}


def look_up(dictionary: str, key: Column) -> Column:
    """The value, null if the key is not there. A literal map, so it folds and needs no join."""
    pairs = [F.lit(x) for x in chain.from_iterable(DICTIONARIES[dictionary].items())]
    return F.try_element_at(F.create_map(*pairs), key)


def _key(c: Column | str) -> Column:
    return blank_to_null(F.upper(col(c)))


def gender(c: Column | str) -> Column:
    """M, F or X; another single character stays, others are null."""
    k = _key(c)
    return F.coalesce(look_up("gender", k), F.when(F.length(k) == 1, k))


def nationality(c: Column | str) -> Column:
    """Demonym; unknown ones stay."""
    k = F.when(col(c) != "", F.trim(F.upper(col(c))))
    return F.coalesce(look_up("demonym", k), k)


def country_code(c: Column | str) -> Column:
    """Three letters; of unknown ones the first three."""
    k = F.when(col(c) != "", F.trim(F.upper(col(c))))
    return F.coalesce(look_up("alpha3", k), F.substring(k, 1, 3))


def compare_code(c: Column | str) -> Column:
    """Code for comparing readings; null is ''."""
    k = F.trim(F.upper(F.coalesce(col(c), F.lit(""))))
    return F.coalesce(look_up("compare_code", k), k)


def consistency_code(c: Column | str) -> Column:
    k = _key(c)
    return F.coalesce(look_up("consistency_code", k), k)


def same_nationality(ocr: Column | str, mrz: Column | str) -> Column:
    """Demonym and code agree; null if either is missing."""
    a, b = _key(ocr), _key(mrz)
    return F.when(a.isNotNull() & b.isNotNull(), (a == b) | F.coalesce(look_up("combiner_code", a) == b, F.lit(False)))


def mrz_type(c: Column | str) -> Column:
    k = _key(c)
    return F.coalesce(look_up("mrz_type", k), k)


def table(spark: SparkSession) -> DataFrame:
    """(dictionary, key, value): the same dictionaries to join with; of fixed size."""
    rows = ", ".join(f"('{d}', '{k}', '{v}')" for d, m in DICTIONARIES.items() for k, v in m.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(dictionary, key, value)")
