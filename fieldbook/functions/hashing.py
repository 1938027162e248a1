"""Hashes over records: canonical JSON with sorted keys, content and chain hashes."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(x: float) -> str:
    """A number as a canonical record writes it: no ``.0``, exponents from 1e21 and below 1e-6."""
    if isinstance(x, bool) or x is None:
        return json.dumps(x)
    if isinstance(x, int) and abs(x) < 10**21:
        return str(x)
    if not math.isfinite(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits = repr(float(x))
    if "e" in digits:
        head, power = digits.split("e")
        n = int(power)
        if -7 < n < 0:
            return f"{float(x):.{-n + len(head.replace('-', '').replace('.', '')) - 1}f}"
        return f"{head.removesuffix('.0')}e{'+' if n > 0 else '-'}{abs(n)}"
    return digits


def canonical(value) -> str:
    """JSON with keys in UTF-16 order, no blanks, and canonical numbers."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str) else number_text(value)


def canonical_json(text: Column | str) -> Column:
    """JSON text in its canonical form; null for what is no JSON."""

    def one(t):
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def convert(series: pd.Series) -> pd.Series:
        return series.map(one)

    return convert(text)


def fields_hash(*fields: Column) -> Column:
    """SHA-256 over fields, each with its length before it and null as ``-``, so no two lists of fields read alike."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def seal_hash(content: Column, signatures: Column, previous: Column) -> Column:
    """The seal over a record's content hash, its signatures' hash and the seal before it."""
    return F.sha2(F.concat(content, signatures, F.coalesce(previous, F.lit(""))), 256)
