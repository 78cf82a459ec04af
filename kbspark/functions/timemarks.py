"""Year, month and day markers in text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns and names that decide results (fixed values).
YEAR = r"\b(?:19|20)\d{2}\b"
MONTH_NAMES = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6,
    "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11,
    "november": 11, "dec": 12, "december": 12,
}
NAMES = "|".join(sorted(MONTH_NAMES, key=lambda n: (-len(n), n)))
MONTH_NAMED = rf"(?i)\b(?:{NAMES})\s+(?:19|20)\d{{2}}\b"
MONTH_NUMERIC = r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])\b"
DAY = r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b"
COVER_YEAR = [
    r"(?i)\bfiscal\s+(?:year\s+)?((?:19|20)\d{2})\b",
    r"(?i)\byear\s+ended[^,]*,?\s+(?:[A-Za-z]+\s+\d{1,2},?\s+)?((?:19|20)\d{2})\b",
    r"(?i)\bfor\s+the\s+(?:fiscal\s+)?year\s+(?:ending|ended)[^,]*,?\s+(?:[A-Za-z]+\s+\d{1,2},?\s+)?((?:19|20)\d{2})\b",
    r"(?i)\bannual\s+report\s+(?:for\s+)?(?:fiscal\s+)?((?:19|20)\d{2})\b",
]
COVER_LENGTH = 3000
UNITS = ("day", "month", "year")


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for n, m in MONTH_NAMES.items() for x in (n, m)])
    return F.element_at(table, F.lower(name))


def named_month(marker: Column) -> Column:
    """``March 2026`` as ``2026-03``."""
    number = month_number(F.regexp_extract(marker, r"^([A-Za-z]+)", 1))
    return F.concat(F.regexp_extract(marker, r"(\d{4})$", 1), F.lit("-"), F.lpad(number.cast("string"), 2, "0"))


def markers(text: Column, unit: str) -> Column:
    """All markers of a unit in canonical form. Months are also found inside days and years inside both."""
    if unit == "year":
        return found(text, YEAR)
    if unit == "day":
        return found(text, DAY)
    return F.concat(F.transform(found(text, MONTH_NAMED), named_month), found(text, MONTH_NUMERIC))


def cover_markers(cover: Column, unit: str) -> Column:
    """Markers of the cover: years only in phrases that name a reporting year, months and days anywhere."""
    if unit == "year":
        return F.concat(*[F.regexp_extract_all(cover, F.lit(p), F.lit(1)) for p in COVER_YEAR])
    return markers(cover, unit)


def segments(path: Column) -> Column:
    """Parts of a heading path without space and emphasis marks at their ends, empty ones dropped."""
    parts = F.transform(F.split(path, r"\s*[>/]\s*"), lambda s: F.trim(F.regexp_replace(F.trim(s), r"^[*_#` ]+|[*_#` ]+$", "")))
    return F.filter(parts, lambda s: s != "")


def segment_unit(segment: Column) -> Column:
    """Finest unit with a marker in the segment."""
    return (
        F.when(segment.rlike(DAY), "day")
        .when(segment.rlike(MONTH_NAMED) | segment.rlike(MONTH_NUMERIC), "month")
        .when(segment.rlike(YEAR), "year")
    )


def path_unit(path: Column) -> Column:
    """Unit of the first segment that has a marker."""
    return F.get(F.filter(F.transform(segments(path), segment_unit), lambda u: u.isNotNull()), F.lit(0))


def path_marker(path: Column, unit: str) -> Column:
    """Marker of the unit in the first segment that has one; numeric months before named ones."""

    def first(segment: Column) -> Column:
        if unit == "year":
            value = F.regexp_extract(segment, YEAR, 0)
        elif unit == "day":
            value = F.regexp_extract(segment, DAY, 0)
        else:
            numeric = F.regexp_extract(segment, MONTH_NUMERIC, 0)
            named = F.regexp_extract(segment, MONTH_NAMED, 0)
            value = F.when(numeric != "", numeric).when(named != "", named_month(named)).otherwise("")
        return F.nullif(value, F.lit(""))

    return F.get(F.filter(F.transform(segments(path), first), lambda m: m.isNotNull()), F.lit(0))
