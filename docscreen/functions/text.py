"""String functions: column in, column out. None and '' both mean missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a text breaks into lines.
LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sl(c: Column | str, a: int, b: int) -> Column:
    """Characters a (from 0) up to b, exclusive."""
    return F.substring(col(c), a + 1, b - a)


def present(c: Column | str) -> Column:
    """Neither null nor empty."""
    c = col(c)
    return c.isNotNull() & (c != "")


def missing(c: Column | str) -> Column:
    return ~present(c)


def blank_to_null(c: Column | str) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def first_present(*cols: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(present(c), col(c)) for c in cols])


def collapse(c: Column | str) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def lines(c: Column | str, keep_blank: bool = False) -> Column:
    """Trimmed lines of a text, as an array."""
    out = F.transform(F.split(col(c), LINE), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return out if keep_blank else F.filter(out, lambda s: s != "")


def normalize_ocr(c: Column | str) -> Column:
    """Each line trimmed and collapsed, empty lines dropped."""
    return F.array_join(F.filter(F.transform(F.split(col(c), LINE), collapse), lambda s: s != ""), "\n")


def union_passes(*passes: Column | str) -> Column:
    """The texts of several readings, stripped, empty ones skipped, joined by a blank line."""
    stripped = [F.regexp_replace(F.coalesce(col(p), F.lit("")), r"^\s+|\s+$", "") for p in passes]
    return F.array_join(F.filter(F.array(*stripped), lambda s: s != ""), "\n\n")


def clean_mrz_line(c: Column | str) -> Column:
    """Upper case, quotation marks and bars to fillers, only A-Z, 0-9 and '<' kept."""
    return F.regexp_replace(F.translate(F.upper(col(c)), "«‹›|", "<<<<"), "[^A-Z0-9<]", "")


def pad_line(c: Column | str, width: int = 44) -> Column:
    """Filled with '<' or cut to width."""
    return F.rpad(col(c), width, "<")


def find_first(text: Column | str, patterns: list[str], ignore_case: bool = True) -> Column:
    """Group 1, collapsed, of the first pattern that matches; '' if its group is empty, null if none matches."""
    text = col(text)
    flag = "(?iu)" if ignore_case else ""
    return F.coalesce(*[F.when(text.rlike(flag + p), collapse(F.regexp_extract(text, flag + p, 1))) for p in patterns])


def once(c: Column, f) -> Column:
    """f of a column, evaluated once per row in a lambda, which keeps long rule lists out of the generated method."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def last_word(c: Column | str) -> Column:
    return F.element_at(F.split(col(c), " "), -1)


def all_but_last(c: Column | str) -> Column:
    parts = F.split(col(c), " ")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")


def surname_of(full: Column | str) -> Column:
    """Last word of a name of several words."""
    return F.when(col(full).contains(" "), last_word(full))


def given_of(full: Column | str) -> Column:
    """All but the last word, or the only word."""
    return F.when(col(full).contains(" "), all_but_last(full)).otherwise(F.when(present(full), col(full)))


def full_name(given: Column | str, surname: Column | str) -> Column:
    """Given name and surname, or the one there is."""
    return F.when(present(given) & present(surname), F.concat_ws(" ", col(given), col(surname))).otherwise(first_present(surname, given))


def full_name_skipping(*parts: Column | str) -> Column:
    """Present parts in order, joined by spaces; null if there is none."""
    return F.nullif(F.concat_ws(" ", *[blank_to_null(p) for p in parts]), F.lit(""))


def compare_key_text(c: Column | str) -> Column:
    """Upper case, collapsed."""
    return collapse(F.upper(col(c)))


def compare_key_compact(c: Column | str) -> Column:
    """Upper case without spaces and fillers."""
    return F.regexp_replace(F.upper(F.trim(col(c))), "[ <]", "")


def compare_key_alnum(c: Column | str) -> Column:
    """Upper case, only A-Z and 0-9."""
    return F.regexp_replace(F.upper(col(c)), "[^A-Z0-9]", "")


def clean_engine_text(c: Column | str) -> Column:
    """Line ends to one newline, blanks to one space, stripped."""
    out = F.regexp_replace(F.regexp_replace(col(c), "\r", "\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, "\n+", "\n"), r"^\s+|\s+$", "")


def strip_filler(c: Column | str) -> Column:
    """Without trailing fillers, the others as spaces, collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(col(c), "<+$", ""), "<", " "))


def group_id(c: Column | str) -> Column:
    """Twelve digits as 4 4 4; others unchanged."""
    bare = F.regexp_replace(col(c), " ", "")
    return F.when(F.length(bare) == 12, F.concat_ws(" ", sl(bare, 0, 4), sl(bare, 4, 8), sl(bare, 8, 12))).otherwise(col(c))


def group_vid(c: Column | str) -> Column:
    """Sixteen digits as 4 4 4 4; others without spaces."""
    bare = F.regexp_replace(col(c), " ", "")
    return F.when(F.length(bare) == 16, F.concat_ws(" ", *[sl(bare, i, i + 4) for i in (0, 4, 8, 12)])).otherwise(bare)


def clean_noise(c: Column | str, junk: str) -> Column:
    """Without exclamation marks and a junk word (alternatives) at the end."""
    return collapse(F.regexp_replace(F.regexp_replace(col(c), "!", ""), rf"(?iu)\s+({junk})\s*$", ""))


def snippet(c: Column | str, n: int) -> Column:
    return F.coalesce(F.substring(col(c), 1, n), F.lit(""))


def tokens(c: Column | str) -> Column:
    """Runs of A-Z and 0-9 of the upper-cased text, joined by one space."""
    return F.array_join(F.regexp_extract_all(F.upper(F.coalesce(col(c), F.lit(""))), F.lit("([A-Z0-9]+)")), " ")


def distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance of upper-cased, trimmed values; null is ''."""
    clean = lambda c: F.trim(F.upper(F.coalesce(col(c), F.lit(""))))
    return F.levenshtein(clean(a), clean(b))


def base_name(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "[^/]*$", 0)


def mask_id(c: Column | str) -> Column:
    """An identity number with its last four digits at most (12 and 16 digits), or two characters at either end."""
    c = col(c)
    bare = F.regexp_replace(c, r"\s+", "")
    n = F.length(c)
    short = F.when(n > 4, F.concat(sl(c, 0, 2), F.repeat(F.lit("X"), n - 4), F.right(c, F.lit(2)))).otherwise(F.lit("XXXX"))
    masked = F.when(F.length(bare) == 12, F.concat(F.lit("XXXX-XXXX-"), F.right(bare, F.lit(4)))).when(F.length(bare) == 16, F.concat(F.lit("XXXX-XXXX-XXXX-"), F.right(bare, F.lit(4)))).otherwise(short)
    return F.when(c.isNotNull(), masked)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
