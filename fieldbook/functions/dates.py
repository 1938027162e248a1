"""Date columns: strict and loose parsing, month arithmetic, clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(text: Column) -> Column:
    """A date from YYYY-MM-DD only; null for other shapes and impossible days."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


#: a year, then either a month with marks of its own and maybe a day, or both as two digits each
_LOOSE = r"^(\d{4})(?:[.\-/년]\s*(\d{1,2})(?:[.\-/월]\s*(\d{1,2})\s*일?|\s*월?)\.?|(\d{2})(\d{2}))$"


def parse_loose(text: Column) -> Column:
    """A date from y-m-d with ``.-/`` or 년월일 between, y-m (its first day), or yyyymmdd; impossible days give null."""
    t = F.trim(text)
    parts = F.regexp_replace(F.regexp_replace(t, _LOOSE, "$1-$2$4-$3$5"), "-$", "-1")
    return F.when(t.rlike(_LOOSE), F.try_to_timestamp(parts, F.lit("yyyy-M-d")).cast("date"))


def excel_serial(n: Column) -> Column:
    """The date of a spreadsheet serial from 20000 to 80000, else null."""
    return F.when(n.between(20000, 80000), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(n).cast("int") - 25569))


def month_span(start: Column, end: Column) -> Column:
    """Calendar months touched by [start, end]; null if end comes first."""
    return F.when(end >= start, (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1)


def clamp_date(day: Column, start: Column, end: Column) -> Column:
    return F.greatest(F.least(day, end), start)


def month_number(day: Column, start: Column, months: Column | int) -> Column:
    """The 1-based month of a project in which a day lies, clamped to its months."""
    n = (F.year(day) - F.year(start)) * 12 + F.month(day) - F.month(start) + 1
    return F.greatest(F.least(n, F.lit(months) if isinstance(months, int) else months), F.lit(1))


def generalized_time(text: Column) -> Column:
    """A timestamp from YYYYMMDDHHMMSS[.f]Z."""
    head = F.regexp_extract(text, r"^(\d{14})(?:\.\d+)?Z$", 1)
    return F.try_to_timestamp(F.nullif(head, F.lit("")), F.lit("yyyyMMddHHmmss"))


def cell_date(cell: Column) -> Column:
    """The date in a table's cell: a written date, else a spreadsheet serial."""
    return F.coalesce(parse_loose(cell), excel_serial(F.regexp_extract(F.trim(cell), r"^(-?\d+(?:\.\d+)?)", 1).try_cast("double")))
