"""Number columns: guarded coercion, Korean amounts, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of Korean amounts; the first that occurs decides.
UNITS = [("조", 1e12), ("억", 1e8), ("천만", 1e7), ("백만", 1e6), ("십만", 1e5), ("만", 1e4), ("천", 1e3)]


def to_number(text: Column) -> Column:
    """A double from a plain decimal or exponent form with blanks around; null for all else, also for empty text."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def korean_number(text: Column) -> Column:
    """A double from ``1,234``, ``3억 5천만원``, ``120백만원``, ``45%`` and the like, else null."""
    t = F.replace(F.trim(text), F.lit(","), F.lit(""))
    pair = r"^(\d+(?:\.\d+)?)\s*억\s*(\d+(?:\.\d+)?)\s*천만\s*원?$"
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "(?i)원|won|krw", ""), "%$", ""))
    value = lambda x: F.when(plain(x).rlike(r"^-?\d+(\.\d+)?$"), plain(x).try_cast("double"))
    out = F.when(t.rlike(pair), F.regexp_extract(t, pair, 1).try_cast("double") * 1e8 + F.regexp_extract(t, pair, 2).try_cast("double") * 1e7)
    for unit, times in UNITS:
        out = out.when(F.contains(t, F.lit(unit)), value(F.regexp_replace(t, f"^(.*?){unit}", "$1")) * times)
    return out.otherwise(value(t))


def round_half_up(n: Column, digits: int = 2) -> Column:
    p = float(10**digits)
    return F.floor(n * p + 0.5) / p
