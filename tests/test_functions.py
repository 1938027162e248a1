"""Scalar columns: dates, numbers, texts, canonical records."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldbook.functions import dates, hashing, numbers
from fieldbook.functions import text as tx


def each(spark, values, function, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[1] for r in df.select("k", function(F.col("x"))).orderBy("k").collect()]


def test_strict_and_loose_dates(spark):
    day = dt.date
    assert each(spark, ["2026-02-28", "2026-02-31", "2026-2-3", None, "x"], dates.parse_iso) == [day(2026, 2, 28), None, None, None, None]
    loose = ["2026.7.1", "2026년 7월 3일", "2026/12/31", "2026년 7월", "2026-07", "20260703", "2026-13-01", ""]
    assert each(spark, loose, dates.parse_loose) == [day(2026, 7, 1), day(2026, 7, 3), day(2026, 12, 31), day(2026, 7, 1), day(2026, 7, 1), day(2026, 7, 3), None, None]
    assert each(spark, [45292.0, 19999.0, 80001.0, None], dates.excel_serial, "double") == [day(2024, 1, 1), None, None, None]


def test_month_arithmetic(spark):
    rows = spark.createDataFrame([(dt.date(2026, 1, 31), dt.date(2026, 3, 1)), (dt.date(2026, 3, 1), dt.date(2026, 1, 31))], "a date, b date")
    assert [r[0] for r in rows.select(dates.month_span(F.col("a"), F.col("b"))).collect()] == [3, None]
    assert [r[0] for r in rows.select(dates.month_number(F.col("b"), F.col("a"), 2)).collect()] == [2, 1]


def test_numbers(spark):
    texts = ["1,234", "3억 5천만원", "3억 5천만", "120백만원", "45%", "2만", "7천", "abc", "", None, "-3", "1.5억"]
    assert each(spark, texts, numbers.korean_number) == [1234.0, 3.5e8, 3.5e8, 1.2e8, 45.0, 2e4, 7e3, None, None, None, -3.0, 1.5e8]
    assert each(spark, [" 12 ", "1d", "0x10", "NaN", "", "1e3", ".5"], numbers.to_number) == [12.0, None, None, None, None, 1000.0, 0.5]


def test_texts(spark):
    assert each(spark, ["A b. C d! e\nf 1.5 g. (h)"], tx.split_sentences) == [["A b.", "C d!", "e", "f 1.5 g.", "(h)"]]
    assert each(spark, ["x [E007] y [E7] [E12]"], tx.citations) == [["E7", "E12"]]
    assert each(spark, ["a　 b \n c "], tx.norm_space) == ["a b c"]
    assert each(spark, [".hidden", "a (1).txt", "~$x.docx", "b.tmp", "ok.txt"], tx.is_junk_name) == [True, True, True, True, False]


@pytest.mark.parametrize(
    ("text", "expected"),
    [('{"b": 88.0, "a": [1, 1e21, 1e-7, 0.000001]}', '{"a":[1,1e+21,1e-7,0.000001],"b":88}'), ('{"가": null, "a": "x\\n"}', '{"a":"x\\n","가":null}'), ("nope", None)],
)
def test_canonical_json(spark, text, expected):
    assert each(spark, [text], hashing.canonical_json) == [expected]


def test_replies_keys_and_cells(spark):
    from pyspark.sql import functions as F

    from fieldbook.functions import dates
    from fieldbook.functions import text as tx

    rows = [(1, 'here: [{"a": 1}, {"a": 2}] done', b"\xfb\xff\x00"), (2, "no list", b""), (3, "[broken", b"ab"), (4, None, None)]
    df = spark.createDataFrame(rows, "k int, t string, b binary")
    out = df.select("k", tx.reply_array(F.col("t"), "array<struct<a:int>>").alias("r"), tx.base64url(F.col("b")).alias("u"), (tx.from_base64url(tx.base64url(F.col("b"))) == F.col("b")).alias("same")).collect()
    assert [[x.a for x in r.r] if r.r else None for r in out] == [[1, 2], None, None, None]
    assert [r.u for r in out] == ["-_8A", "", "YWI", None] and [r.same for r in out] == [True, True, True, None]
    import hashlib

    want = hashlib.sha256(b"EC|P-256|x|y").hexdigest()[:16]
    got = df.limit(1).select(tx.key_fingerprint(F.lit("EC"), F.lit("P-256"), F.lit("x"), F.lit("y"))).first()[0]
    assert got == ":".join(want[k : k + 2] for k in range(0, 16, 2))
    cells = ["2026. 3. 1", "2026년 3월", "20260301", "46082", "46082.75", "2026.13.1", "12", "", None, "2026-3"]
    found = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string").select(dates.cell_date(F.col("c")).cast("string")).collect()
    assert [r[0] for r in found] == ["2026-03-01", "2026-03-01", "2026-03-01", "2026-03-01", "2026-03-01", None, None, None, None, "2026-03-01"]
