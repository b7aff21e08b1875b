"""Date functions on strings. The century pivot, calendar check and layout are parameters of one rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lookup import look_up
from .text import col, once, sl

ISO = "yyyy-MM-dd"


def _iso(year: Column, month: Column, day: Column) -> Column:
    """ISO date of numbers in strings; null if the calendar has no such day."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(F.try_to_date(text, ISO).isNotNull(), text)


def century(yy: Column, pivot: int) -> Column:
    """Four digits of a two-digit year: from the pivot on 19xx."""
    return F.concat(F.when(yy.try_cast("int") >= pivot, F.lit("19")).otherwise(F.lit("20")), yy)


def mrz_date(c: Column | str, pivot: int = 50, iso: bool = True, checked: bool = True) -> Column:
    """YYMMDD as ISO or DD/MM/YYYY; null unless six digits (and, if checked, a day of the calendar)."""
    return once(F.trim(col(c)), lambda v: _six_digits(v, pivot, iso, checked))


def _six_digits(v: Column, pivot: int, iso: bool, checked: bool) -> Column:
    year, month, day = century(sl(v, 0, 2), pivot), sl(v, 2, 4), sl(v, 4, 6)
    known = _iso(year, month, day) if checked else F.concat_ws("-", year, month, day)
    out = known if iso else F.when(known.isNotNull(), F.concat_ws("/", day, month, year))
    return F.when(v.rlike("^[0-9]{6}$"), out)


_DMY = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$"
_YMD = r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"
_MON = r"(\d{1,2})[\s\-.]*([A-Z]{3})[\s\-.]*(\d{2,4})"


def normalize_date(c: Column | str, pivot: int = 50) -> Column:
    """ISO date by the first rule that gives a day: ISO as it is, D/M/Y, Y/M/D, D MON Y, six digits; else the upper-cased text."""
    return once(F.trim(F.upper(col(c))), lambda v: _normalize(v, pivot))


def _normalize(v: Column, pivot: int) -> Column:
    bare = F.regexp_replace(v, r"[^\w/\-.]", "")
    part = lambda text, pattern, k: F.regexp_extract(text, pattern, k)
    year = part(v, _MON, 3)
    year = F.when(year.try_cast("int") < 100, century(F.lpad(year.try_cast("int").cast("string"), 2, "0"), pivot)).otherwise(year)
    named = F.when(v.rlike(_MON), _iso(year, look_up("month", part(v, _MON, 2)), part(v, _MON, 1)))
    return F.when(v.isin("", "N/A", "NONE", "NULL"), None).otherwise(
        F.coalesce(
            F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v),
            F.when(bare.rlike(_DMY), _iso(part(bare, _DMY, 3), part(bare, _DMY, 2), part(bare, _DMY, 1))),
            F.when(bare.rlike(_YMD), _iso(part(bare, _YMD, 1), part(bare, _YMD, 2), part(bare, _YMD, 3))),
            named,
            F.when(v.rlike("^[0-9]{6}$"), F.coalesce(mrz_date(v, pivot), F.lit(""))),
            v,
        )
    )


def iso_or_null(c: Column | str, pivot: int = 50) -> Column:
    """normalize_date, where six digits that are no day are null."""
    return F.nullif(normalize_date(c, pivot), F.lit(""))


def four_layouts(c: Column | str) -> Column:
    """ISO date of Y-M-D, D/M/Y, D-M-Y or D.M.Y; else the trimmed text."""
    return once(F.trim(col(c)), _four)


def _four(v: Column) -> Column:
    tries = []
    for pattern, (y, m, d) in ((r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (1, 2, 3)), *((rf"^(\d{{1,2}}){s}(\d{{1,2}}){s}(\d{{4}})$", (3, 2, 1)) for s in ("/", "-", r"\."))):
        tries.append(F.when(v.rlike(pattern), _iso(*[F.regexp_extract(v, pattern, k) for k in (y, m, d)])))
    return F.when(v != "", F.coalesce(*tries, v))


def slashes(c: Column | str) -> Column:
    return F.translate(col(c), ".-", "//")


def month_date(c: Column | str, pivot: int = 30) -> Column:
    """DD/MM/YYYY of D MON Y with white space between; no calendar check; null if there is none."""
    v = F.upper(col(c))
    pattern = r"(\d{1,2})\s+([A-Z]{3})\s+(\d{2,4})"
    year = F.regexp_extract(v, pattern, 3)
    year = F.when(F.length(year) == 2, century(year, pivot)).otherwise(year)
    month = look_up("month", F.regexp_extract(v, pattern, 2))
    return F.when(v.rlike(pattern) & month.isNotNull(), F.concat(F.lpad(F.regexp_extract(v, pattern, 1), 2, "0"), F.lit("/"), month, F.lit("/"), year))


def sorted_dates(dates: Column) -> Column:
    """Day-first dates by day; what is no day counts as 2099-01-01; equal days keep their order."""
    keyed = F.transform(dates, lambda d, i: F.struct(F.coalesce(F.try_to_date(F.translate(d, "-.", "//"), "dd/MM/yyyy"), F.lit("2099-01-01").cast("date")).alias("day"), i.alias("at"), d.alias("raw")))
    return F.transform(F.array_sort(keyed), lambda s: s["raw"])


def assign_dates(dates: Column) -> Column:
    """Struct of birth (earliest), issue (second of three or more) and expiry (latest of two or more)."""
    s = sorted_dates(dates)
    n = F.size(dates)
    return F.struct(
        F.get(s, F.lit(0)).alias("birth"),
        F.when(n > 2, F.get(s, F.lit(1))).alias("issue"),
        F.when(n > 1, F.get(s, n - 1)).alias("expiry"),
    )


def first_in_years(dates: Column, low: int, high: int | None = None, other_than: Column | None = None) -> Column:
    """First D/M/Y string with low <= year <= high that differs from another string."""
    year = lambda d: F.substring_index(d, "/", -1).cast("int")
    ok = lambda d: (year(d) >= low) & (year(d) <= high if high else F.lit(True)) & (F.coalesce(d != other_than, F.lit(True)) if other_than is not None else F.lit(True))
    return F.get(F.filter(dates, ok), F.lit(0))


def day_stamp(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyyMMdd")
