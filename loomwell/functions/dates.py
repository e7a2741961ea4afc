"""Date functions over text, as column expressions. Dates stay text: 0000-00-00 and 9999-99-99 are values here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An unknown beginning and end.
NO_START, NO_END = "0000-00-00", "9999-99-99"
YMD = r"(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})"
KOREAN = r"(\d{4})[.\-년]\s*(\d{1,2})[.\-월]\s*(\d{1,2})"
RANGE_FULL = r"(\d{4}[년.\-]\s*\d{1,2}[월.\-]\s*\d{1,2}일?)\s*[~\-–]\s*(\d{4}[년.\-]?\s*\d{1,2}[월.\-]\s*\d{1,2}일?)"
RANGE_SHORT = r"(\d{4}[년.\-]\s*\d{1,2}[월.\-]\s*\d{1,2}일?)\s*[~\-–]\s*(\d{1,2}[월.\-]\s*\d{1,2}일?)"


def _ymd(text: Column, pattern: str) -> Column:
    g = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    return F.when(g[0] == "", "").otherwise(F.concat_ws("-", g[0], F.lpad(g[1], 2, "0"), F.lpad(g[2], 2, "0")))


def hyphen_date(text: Column) -> Column:
    """The first Y.M.D, Y-M-D or Y/M/D as YYYY-MM-DD; '' for none."""
    return _ymd(F.coalesce(text, F.lit("")), YMD)


def period(text: Column) -> tuple[Column, Column]:
    """Start and end of 'a ~ b'. A hyphen parts too, so that hyphenated dates aren't found."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "~|–|-|to"), lambda x: F.trim(x)), lambda x: x != "")
    pick = lambda i, none: F.coalesce(F.nullif(hyphen_date(F.get(parts, F.lit(i))), F.lit("")), F.lit(none))
    return pick(0, NO_START), pick(1, NO_END)


def category_and_date(text: Column) -> tuple[Column, Column]:
    """'category2024.01.02': both; a date elsewhere has no category; no date: both empty."""
    t = F.coalesce(text, F.lit(""))
    whole = r"^(.+?)(\d{4}\.\d{2}\.\d{2})$"
    at_end = F.regexp_extract(t, whole, 2)
    return F.trim(F.regexp_extract(t, whole, 1)), F.when(at_end != "", at_end).otherwise(F.regexp_extract(t, r"(\d{4}\.\d{2}\.\d{2})", 1))


def date_range(text: Column) -> tuple[Column, Column]:
    """Start and end of a range in free text; an end without a year takes the start's."""
    t = F.coalesce(text, F.lit(""))
    full, short = F.regexp_extract(t, RANGE_FULL, 1), F.regexp_extract(t, RANGE_SHORT, 1)
    left = F.when(full != "", full).otherwise(short)
    start = _ymd(left, KOREAN)
    right = F.regexp_extract(t, RANGE_SHORT, 2)
    inherited = F.concat_ws("-", F.substring(start, 1, 4), F.lpad(F.regexp_extract(right, r"(\d{1,2})[월.\-]\s*(\d{1,2})", 1), 2, "0"), F.lpad(F.regexp_extract(right, r"(\d{1,2})[월.\-]\s*(\d{1,2})", 2), 2, "0"))
    end = F.when(full != "", _ymd(F.regexp_extract(t, RANGE_FULL, 2), KOREAN)).when(short != "", inherited).otherwise("")
    known = lambda c, none: F.coalesce(F.nullif(c, F.lit("")), F.lit(none))
    return known(start, NO_START), known(end, NO_END)


def full_year(two_digits: Column) -> Column:
    """70 and above: 1900s."""
    return F.when(two_digits < 70, two_digits + 2000).otherwise(two_digits + 1900)


def folder_label(date: Column, title: Column) -> Column:
    """'2024.1.2', title: (24-01-02)title."""
    d = hyphen_date(date)
    return F.when(d == "", title).otherwise(F.concat(F.lit("("), F.substring(d, 3, 8), F.lit(")"), title))


def show_date(text: Column) -> Column:
    """The first form that occurs is rewritten, without padding."""
    out = F.coalesce(text, F.lit(""))
    d = F.when(out.rlike(r"\d{4}\.\d{1,2}\.\d{1,2}"), F.regexp_replace(out, r"(\d{4})\.(\d{1,2})\.(\d{1,2})", "$1-$2-$3"))
    d = d.when(out.rlike(r"\d{4}-\d{1,2}-\d{1,2}"), out)
    return d.when(out.rlike(r"\d{1,2}/\d{1,2}/\d{4}"), F.regexp_replace(out, r"(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")).otherwise(out)


def month_start(year: Column, month: Column) -> Column:
    """First day of a month; 1900-01-01 if either is null."""
    return F.coalesce(F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-01")), F.lit("1900-01-01"))


def recent_date(text: Column) -> Column:
    """The first date of this century, parted by stops or hyphens, as YYYY-MM-DD; '' for none."""
    return _ymd(F.coalesce(text, F.lit("")), r"(20\d{2})[.-]\s*(\d{1,2})[.-]\s*(\d{1,2})")


def exact_period(text: Column) -> tuple[Column, Column]:
    """Start and end of 'YYYY.MM.DD ~ YYYY.MM.DD'; both '' where the text has no such period."""
    t, day = F.coalesce(text, F.lit("")), r"(\d{4})\.(\d{2})\.(\d{2})"
    g = [F.regexp_extract(t, rf"{day}\s*~\s*{day}", i) for i in range(1, 7)]
    return tuple(F.when(g[i] == "", "").otherwise(F.concat_ws("-", *g[i : i + 3])) for i in (0, 3))


def iso(at: Column) -> Column:
    """A timestamp as ISO 8601 with microseconds where it has any, without zone."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(at, "SSSSSS")
    return F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part))
