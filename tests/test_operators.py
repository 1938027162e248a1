"""Seals, grids, sources, sinks and the stream, with planted defects and round trips."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldbook.operators import planner, seal
from fieldbook.sources import export, parse
from fieldbook.streaming import sprints

FIELDS = ["note_id", "body"]


@pytest.fixture
def sealed(spark):
    notes = spark.createDataFrame([(p, n, f"text {n}", f"u{n % 3}") for p in (1, 2) for n in range(1, 6)], "project int, note_id int, body string, author string")
    return seal.seal_chain(notes, FIELDS, "project", ["note_id"])


@pytest.mark.parametrize(
    ("column", "value"), [("body", "changed"), ("author", "someone"), ("seal", "0" * 64), ("prev_seal", "1" * 64), ("content_sha256", "2" * 64)]
)
def test_tampered_chains_are_found(sealed, column, value):
    clean = {r.project: (r.notes, r.checked, r.first_bad) for r in seal.verify_chain(sealed, FIELDS, "project").collect()}
    assert clean == {1: (5, 5, None), 2: (5, 5, None)}
    touched = (F.col("project") == 2) & (F.col("note_id") == 3)
    broken = sealed.withColumn(column, F.when(touched, F.lit(value)).otherwise(F.col(column)))
    found = {r.project: (r.checked, r.first_bad) for r in seal.verify_chain(broken, FIELDS, "project").collect()}
    assert found == {1: (5, None), 2: (2, 3)}


@pytest.mark.parametrize("start", ["2023-01-31", "2024-02-28", "2024-02-29", "2025-03-31", "2025-11-30", "2025-12-01", "2024-12-31"])
@pytest.mark.parametrize("months", [1, 2, 13, 36])
def test_grids_tile_the_period(spark, start, months):
    projects = spark.sql(f"SELECT 1 AS project, DATE '{start}' AS start, date_sub(add_months(DATE '{start}', {months}), 1) AS end")
    (p,) = projects.collect()
    for grid in (planner.sprint_grid(projects), planner.month_blocks(projects)):
        rows = sorted((r.start, r.end) for r in grid.select("start", "end").collect())
        assert rows[0][0] == p.start and rows[-1][1] == p.end
        assert all(b[0] - a[1] == dt.timedelta(1) for a, b in zip(rows, rows[1:]))
        assert sum((b - a).days + 1 for a, b in rows) == (p.end - p.start).days + 1


def test_files_round_trip(spark, tmp_path):
    table = [["name", "unit"], ["a, \"b\"", "% & <"]]
    files = {
        "plan.docx": export.docx_bytes([{"kind": "h1", "text": "과제명: 시험"}, {"kind": "p", "text": "둘째 & <줄>"}, {"kind": "table", "rows": table}]),
        "kpi.xlsx": export.xlsx_bytes([("성능지표", [["평가항목", "목표"], ["정확도", 95]])]),
        "log.txt": "첫 줄\n\n 둘째   줄 ".encode("euc-kr"),
        "m.csv": "date,value\r\n2026-01-02,\"1,5\"\r\n".encode(),
        "broken.docx": b"PK\x03\x04 nothing",
        "fake.pdf": b"%PDF-",
        "note (1).txt": b"junk",
        "empty.txt": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    parsed = parse.parse_files(spark, f"file://{tmp_path}")
    out = {r.name.rpartition("/")[2]: r for r in parsed.collect()}
    assert set(out) == set(files) - {"note (1).txt", "empty.txt"}
    assert out["plan.docx"].paragraphs[:2] == ["과제명: 시험", "둘째 & <줄>"] and out["plan.docx"].tables == [table]
    assert out["kpi.xlsx"].sheets[0].name == "성능지표" and [r[0] for r in out["kpi.xlsx"].sheets[0].rows] == ["평가항목", "정확도"]
    assert out["log.txt"].paragraphs == ["첫 줄", "둘째 줄"] and out["m.csv"].tables == [[["date", "value"], ["2026-01-02", "1,5"]]]
    assert not out["broken.docx"].ok and out["broken.docx"].warnings
    assert parse.parse_bytes("empty.txt", b"")["ok"]
    assert ("m.csv", 1, 1, "1,5") in {(r.name.rpartition("/")[2], r.r, r.c, r.v) for r in parse.cells(parsed).collect()}


def test_backups_are_verified_before_they_are_returned():
    files = {"a.json": b"{}", "notes/1.json": b"[1]"}
    data = export.backup_zip(files)
    assert data == export.backup_zip(dict(reversed(files.items()))) and export.restore_zip(data) == files
    bad = data.replace(b"[1]", b"[2]")
    with pytest.raises(Exception):  # noqa: B017, PT011
        export.restore_zip(bad)


def test_stream_counts_equal_the_batch(spark, tmp_path):
    from conftest import SF_DIR

    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    stream = sprints.sprint_counts(sprints.event_stream(spark, SF_DIR, events.schema))
    run = stream.writeStream.format("memory").queryName("sprint_counts").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    got = {(r.start, r.event_type): (r.events, r.total) for r in spark.table("sprint_counts").collect()}
    assert got == {(r.start, r.event_type): (r.events, r.total) for r in sprints.sprint_counts(events).collect()}
