"""Drafts from evidence: catalogue names in texts, the rules for rows and sentences, and records of other periods."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fieldbook.operators import autodraft, draft, planner

CATALOG = [(1, "k_yield", "공정 수율", "%"), (2, "k_defects", "불량", "건"), (3, "k_heat", "발열", ""), (4, "k_y", "수율", "%")]
NOTE = "RN-20260301-20260314"


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, "pos int, key string, name string, unit string")


def entries(spark, contents: list, kind: str = "measurement", note: str = NOTE):
    rows = [("p", note, date(2026, 3, 1), date(2026, 3, 14), k, f"E{k}", *(c if isinstance(c, tuple) else (kind, c))) for k, c in enumerate(contents, 1)]
    return spark.createDataFrame(rows, "project string, note_id string, start date, end date, n long, id string, kind string, content string")


def by_place(df) -> dict:
    return {(r.section, r.n): r for r in df.collect()}


def test_names_in_texts_match_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abä東😀 ") for _ in range(n))
    names = ["", "a", "ab", "東", "aba b", "😀😀", *{word(rng.randrange(1, 7)) for _ in range(60)}]
    texts = [None, "", "a", *[word(rng.randrange(60)) for _ in range(80)]]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    n = spark.createDataFrame(list(enumerate(names)), "pos long, name string")
    want = {(i, k) for i, x in enumerate(texts) for k, y in enumerate(names) if x is not None and y and y in x}
    assert {tuple(r) for r in draft.contained(t, n).collect()} == want
    both = {i: min([k for k, y in enumerate(names) if y and x and (y in x or x in y)], default=None) for i, x in enumerate(texts)}
    assert {tuple(r) for r in draft.first_name(t, n, both_ways=True).collect()} == {x for x in both.items() if x[1] is not None}
    assert draft.contained(t, n.limit(0)).count() == 0 and draft.contained(t.limit(0), n).count() == 0


def test_no_text_meets_every_name(spark):
    """The plan has neither a nested loop nor a cross join, and the names are not brought to the driver."""
    names = spark.range(20_000).select(F.col("id").alias("pos"), F.concat(F.lit("name "), F.col("id")).alias("name"), F.col("id").cast("string").alias("key"))
    texts = spark.range(3000).select("id", F.concat(F.lit("of name "), F.col("id") * 5, F.lit(" and more")).alias("content"))
    out = draft.match_catalog(texts, names)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # 'name 1' comes before 'name 10' in the list, so the first name of a text is its shortest beginning
    assert {r.metric_key for r in out.where("id = 200").collect()} == {"1"} and out.where("metric_key is null").count() == 0


def test_measured_rows(spark, catalog):
    rows = by_place(autodraft.draft(entries(spark, [
        "2026-03-02,공정 수율,91.5,%,표준", "2026-03-02, 수율 ,7,%,", "2026-03-03,없는 지표,1,%,x", "2026-03-20,불량,3,건,x", "2026-03-04,불량,많음,건,x", "2026-03-02,공정 수율,91.5,%,again",
        "2026-03-05 — 불량 12건 을 확인하였다.", "불량 이 공정 수율 88.5 % 에서 나왔다", "발열 40 도를 측정하였다", ("record", "2026-03-06 - 불량 4건 을 기록하였다"),
    ]), catalog))
    metric = {n: (r.metric_key, r.value, r.condition, r.evidence) for (section, n), r in rows.items() if section == "metrics"}
    assert metric == {
        1: ("k_yield", 91.5, "표준", "E1"), 2: ("k_yield", 7.0, "Measured 2026-03-02", "E2"), 7: ("k_defects", 12.0, "Measured 2026-03-05", "E7"), 8: ("k_yield", 88.5, "", "E8"), 9: ("k_heat", 40.0, "", "E9"),
    }
    assert rows["off_period", 4].text is None and ("metrics", 6) not in rows and ("metrics", 10) not in rows
    # a row of an unknown name, or without number, is read as a sentence and is none
    assert {n for section, n in rows if section == "non_sentence"} == {3, 5}


def test_work_texts(spark, catalog):
    rows = by_place(autodraft.draft(entries(spark, [
        "2026-03-02 — 시편을 세 개 제작하였다.", "2026-03-02 — 시편을  세 개 제작하였다.", "2026-03-03: 시편을 세 개 제작하였다.", "짧다.", "[시험] 시편을 세 개 제작하였다", "The specimen was made today.",
        "시편이 깨진 것으로 추정된다 하였다.", "2026-02-27 — 시편을 세 개 제작하였다.", "시편을 여러 번 제작하였음 (세 개).", None, "2026-02-31 — 시편을 네 개 제작하였다.",
    ], "record"), catalog))
    work = {n: r.text for (section, n), r in rows.items() if section == "work"}
    assert work == {1: "2026-03-02 시편을 세 개 제작하였다 [E1].", 3: "2026-03-03 시편을 세 개 제작하였다 [E3].", 9: "시편을 여러 번 제작하였음 (세 개) [E9].", 11: "2026-02-31 시편을 네 개 제작하였다 [E11]."}
    assert {n for section, n in rows if section == "non_sentence"} == {4, 5, 6, 10} and ("forbidden", 7) in rows and ("off_period", 8) in rows
    assert autodraft.draft(entries(spark, []), catalog).count() == 0


def test_redirected_rows_go_to_their_sprints_once(spark, catalog):
    start = date(2026, 3, 1)
    sprints = planner.sprint_grid(spark.createDataFrame([("p", start, start + timedelta(days=59))], "project string, start date, end date"))
    notes = spark.createDataFrame([("p", NOTE, 0, "draft"), ("p", "RN-20260315-20260328", 0, "sealed"), ("p", "RN-20260329-20260411", 0, "sealed"), ("p", "RN-20260329-20260411-R1", 1, "draft")], "project string, note_id string, revision int, state string")
    off = ["2026-03-02 — 이 노트의 기록을 작성하였다.", "2026-03-20 — 확정된 기간에 시험하였다.", "2026-04-01 — 개정판의 기간에 시험하였다.", "2026-04-01,공정 수율,90,%,표준", "2026-04-15 — 아직 없는 노트에 시험하였다.", "2027-01-01 — 과제 밖에서 시험하였다.", "날짜 없이 시험을 수행하였다.", "2026-04-29 — 마지막 기간에 시험하였다."]
    e = entries(spark, off)
    rows = spark.createDataFrame([], "project string, note_id string, section string, key string")
    first = autodraft.redirect(e, notes, sprints, rows, catalog).collect()
    assert {(r.note_id, r.section, r.n, r.created) for r in first} == {("RN-20260329-20260411-R1", "work", 3, False), ("RN-20260329-20260411-R1", "metrics", 4, False), ("RN-20260412-20260425", "work", 5, True), ("RN-20260426-20260429", "work", 8, True)}
    held = spark.createDataFrame([(r.project, r.note_id, r.section, r.key) for r in first], rows.schema)
    made = spark.createDataFrame([("p", n, 0, "draft") for n in ("RN-20260412-20260425", "RN-20260426-20260429")], notes.schema)
    assert autodraft.redirect(e, notes.union(made), sprints, held, catalog).count() == 0


def test_redirect_takes_what_was_looked_up_and_passes_over_notes_without_id(spark, catalog):
    start = date(2026, 3, 1)
    sprints = planner.sprint_grid(spark.createDataFrame([("p", start, start + timedelta(days=59)), ("q", start, start)], "project string, start date, end date"))
    notes = spark.createDataFrame([("p", None, 3, "sealed"), ("p", "RN-20260315-20260328", 0, None), ("p", "RN-20260329-20260411", 0, "draft")], "project string, note_id string, revision int, state string")
    e = entries(spark, ["2026-03-20 — 상태가 없는 노트에 시험하였다.", "2026-04-01,공정 수율,90,%,표준", "2026-04-01,공정 수율,90,%,표준", "2026-04-15 — 아직 없는 노트에 시험하였다.", "2026-04-15 — 아직 없는 노트에 시험하였다"])
    rows = spark.createDataFrame([], "project string, note_id string, section string, key string")
    more = autodraft.look_up(e.union(entries(spark, ["2026-04-02,불량,3,건,x"])), catalog)
    for found in (None, more):
        out = autodraft.redirect(e, notes, sprints, rows, catalog, found)
        assert out.columns == [*autodraft.ROW, "created"]
        assert {(r.note_id, r.section, r.n, r.created) for r in out.collect()} == {("RN-20260329-20260411", "metrics", 2, False), ("RN-20260412-20260425", "work", 4, True)}
