"""Whole notes: read from JSON, run through all gates, with planted defects."""

from __future__ import annotations

import copy
import json

import pytest
from pyspark.sql import functions as F

from fieldbook.operators import notes as nt

LEDGER = [(f"E{k}", "statement", "upload", f"file{k}.pdf") for k in range(1, 5)] + [("E5", "researcher_statement", "upload", "(direct)")]
CATALOG = [("yield", "%", 85.0, "higher", False), ("total", "건", None, "higher", True)]


def clean(name: str = "RN-20260301-20260314", project: str = "p") -> dict:
    """A note without any fault, as its file holds it."""
    said = lambda text, *ids: {"text": text, "wp": "WP1", "evidence": list(ids)}
    return {
        "project": project, "note_id": name, "revision": 0, "supersedes": None, "_state": "draft", "검증모드": "advisory", "period": {"start": "2026-03-01", "end": "2026-03-14", "cadence": "biweekly"}, "wp_refs": ["WP1"],
        "header": {"과제번호": "TS-2026-001", "과제명": "a project", "작성자": "kim", "점검자": "lee", "작성일": "2026-03-15", "점검일": ""},
        "sections": {
            "goal": [], "work": [said("첫 시험을 수행하였다 [E1].", "E1"), said("The device was calibrated [E2].", "E2"), said("a note of our own [E5].", "E5")], "results": [said("결과를 기록하였다 [E3].", "E3")],
            "metrics": [{"metric": "공정 수율", "metric_key": "yield", "value": 88, "unit": "%", "condition": "standard", "evidence": ["E4"]}], "interpretation": [], "next_plan": [],
        },
        "attachments": [{"file_id": f"F{k}", "name": f"file{k}.pdf", "sha256": "a" * 64, "size": 100, "contributor": "kim"} for k in range(1, 5)],
        "수정이력": [{"at": "2026-03-15", "by": "kim", "what": "made"}], "content_sha256": "",
    }


def sealed(name: str, start: str, end: str, *metrics: dict, project: str = "p", supersedes: str | None = None) -> dict:
    note = clean(name, project)
    note |= {"_state": "sealed", "period": {"start": start, "end": end}, "supersedes": supersedes}
    note["sections"] = {"metrics": [{"metric": "m", "unit": "%", "evidence": ["E1"]} | m for m in metrics]}
    return note


def gated(spark, notes: list[dict], mode=None) -> dict:
    """By position in the list: the note's row, its content hash made first unless it has one."""
    texts = spark.createDataFrame([(json.dumps(n, ensure_ascii=False),) for n in notes], "value string")
    read = nt.parse_notes(texts)
    assert read.where("corrupt is not null").count() == 0
    rows = read.select("note.*").withColumn("content_sha256", F.when(F.col("content_sha256") == "", nt.content_hash()).otherwise(F.col("content_sha256")))
    ledger = spark.createDataFrame(LEDGER, "id string, kind string, source_type string, source_file string")
    catalog = spark.createDataFrame(CATALOG, "key string, unit string, target double, direction string, monotonic boolean")
    return {(r.project, r.note_id): r for r in nt.run_gates(rows, ledger, catalog, mode).collect()}


def checks(row) -> list[str]:
    return [f"{g.gate} {v.check}" for g in row.gates for v in g.violations]


def _work(text: str):
    return lambda n: n["sections"]["work"].append({"text": text, "wp": "WP1", "evidence": []})


def _metric(**fields):
    return lambda n: n["sections"]["metrics"].append({"metric": "x", "metric_key": "x", "value": 1, "unit": "", "evidence": ["E1"]} | fields)


PLANTED = {
    "missing_citation": (_work("증거 없는 주장을 기재하였다."), "G1 unmapped"),
    "ghost_evidence": (_work("존재하지 않는 근거를 인용하였다 [E999]."), "G1 ghost"),
    "forbidden_word": (_work("수율이 개선된 것으로 판단된다 [E1]."), "G1 forbidden"),
    "metric_no_evidence": (_metric(evidence=[]), "G1 no_evidence"),
    "percent_range": (_metric(value=130, unit="%"), "G3 range"),
    "bad_value": (_metric(value="높음"), "G3 value_form"),
    "count_fraction": (_metric(value=2.5, unit="건"), "G3 count_form"),
    "unit_mismatch": (lambda n: n["sections"]["metrics"][0].update(unit="ms"), "G3 unit_mismatch"),
    "false_achieved": (lambda n: n["sections"]["metrics"][0].update(value=80, achieved=True), "G3 false_achieved"),
    "self_review": (lambda n: n["header"].update(점검자=n["header"]["작성자"]), "G4 self_review"),
    "missing_author": (lambda n: n["header"].update(작성자=""), "G4 author"),
    "bad_period": (lambda n: n.update(period={"start": "2026-03-14", "end": "2026-03-01"}), "G4 period"),
    "att_no_hash": (lambda n: n["attachments"].append({"file_id": "F9", "name": "none.pdf", "sha256": "", "size": 5}), "G4 attachment_hash"),
    "period_overlap": (sealed("RN-20260222-20260304", "2026-02-22", "2026-03-04"), "G2 overlap"),
    "metric_contradict": (sealed("RN-OLD", "2026-02-15", "2026-03-14", {"metric_key": "yield", "value": 91}), "G2 contradiction"),
}


def test_every_planted_defect_is_found(spark):
    """Each of fifteen defects alone, each in a project of its own, and a note without any."""
    notes = [clean(project="clean")]
    for name, (defect, _) in PLANTED.items():
        note = clean(project=name)
        notes.append(note)
        if callable(defect):
            defect(note)
        else:
            notes.append(copy.deepcopy(defect) | {"project": name})
    out = gated(spark, notes)
    fine = out["clean", clean()["note_id"]]
    assert checks(fine) == [] and fine.all_pass and fine.decision == "pass" and [g.gate for g in fine.gates] == ["G1", "G2", "G3", "G4"]
    for name, (_, check) in PLANTED.items():
        row = out[name, clean()["note_id"]]
        # a sealed note that ends the same day overlaps too
        extra = {"metric_contradict": {"G2 overlap"}}.get(name, set())
        assert set(checks(row)) == {check} | extra and not row.all_pass and row.decision == "advisory", name
        assert row.violations == len(checks(row))


@pytest.mark.parametrize("mode,decision", [("strict", "rejected"), ("advisory", "advisory")])
def test_the_mode_decides(spark, mode, decision):
    bad = clean()
    _work("no evidence")(bad)
    assert {r.decision for r in gated(spark, [bad], mode).values()} == {decision}
    assert {r.decision for r in gated(spark, [clean()], mode).values()} == {"pass"}
    bad["검증모드"] = mode
    assert {r.decision for r in gated(spark, [bad]).values()} == {decision}


def test_several_defects_at_once_and_their_places(spark):
    note = clean()
    for name in ("missing_citation", "ghost_evidence", "percent_range", "self_review", "att_no_hash"):
        PLANTED[name][0](note)
    note["sections"]["work"].append({"text": "두 문장이다 [E1]. 근거가 없다.\n해당 기간 관련 증거 없음."})
    note["sections"]["metrics"].append({"metric": "", "value": "skipped"})
    row = gated(spark, [note])["p", note["note_id"]]
    places = {(v.check, v.location) for g in row.gates for v in g.violations}
    assert places == {("unmapped", "work 4"), ("ghost", "work 5"), ("unmapped", "work 6"), ("range", "metrics 2"), ("self_review", "reviewer"), ("attachment_hash", "attachment 5")}
    assert [v.quote for v in row.gates[0].violations] == ["증거 없는 주장을 기재하였다.", "존재하지 않는 근거를 인용하였다 [E999].", "근거가 없다."]


def test_revisions_sealed_values_and_projects(spark):
    old = sealed("RN-A", "2026-02-01", "2026-02-14", {"metric_key": "total", "value": 10}, {"metric_key": "total", "value": 7})
    first = sealed("RN-20260301-20260314", "2026-03-01", "2026-03-14")
    revision = clean("RN-20260301-20260314-R1") | {"supersedes": "RN-20260301-20260314"}
    revision["sections"]["metrics"] += [{"metric": "t", "metric_key": "total", "value": 9, "unit": "건", "evidence": ["E1"]}, {"metric": "t", "metric_key": "total", "value": 8, "unit": "건", "evidence": ["E1"], "change_reason": "recount"}]
    other = clean("RN-20260301-20260314-R1", "q")
    out = gated(spark, [old, first, revision, other])
    assert checks(out["p", revision["note_id"]]) == ["G2 regression"] and out["p", revision["note_id"]].gates[1].violations[0].location == "metrics 2"
    assert checks(out["q", other["note_id"]]) == []


def test_missing_attachments_and_stale_hashes(spark):
    note = clean() | {"attachments": [], "수정이력": None, "content_sha256": "0" * 64}
    row = gated(spark, [note])["p", note["note_id"]]
    assert checks(row) == ["G4 attachment_missing"] * 4 + ["G4 history", "G4 content_hash"]
    assert [v.quote for v in row.gates[3].violations[:4]] == [f"file{k}.pdf" for k in range(1, 5)]


def test_bare_notes_and_repeated_rows(spark):
    """Null sections, header and period are faults, not errors; equal rows are checked alike; an empty table gives none."""
    bare = {"note_id": "RN-X", "project": "p"}
    out = gated(spark, [bare, bare, clean()])
    assert len(out) == 2 and checks(out["p", "RN-X"]) == ["G4 project_code", "G4 title", "G4 period", "G4 author", "G4 reviewer", "G4 written_on", "G4 history", "G4 content_hash"]
    assert gated(spark, [clean()]).keys() == {("p", clean()["note_id"])}
    none = nt.parse_notes(spark.createDataFrame([], "value string")).select("note.*")
    ledger = spark.createDataFrame([], "id string, kind string, source_type string, source_file string")
    catalog = spark.createDataFrame([], "key string, unit string, target double, direction string, monotonic boolean")
    assert nt.run_gates(none, ledger, catalog).count() == 0


def test_texts_that_are_no_notes_are_kept_apart(spark):
    good = json.dumps(clean(), ensure_ascii=False)
    texts = [good, "{", "[1, 2]", '"text"', '{"note_id": null}', '{"note_id": "x", "sections": 5}', None, ""]
    out = nt.parse_notes(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, value string")).collect()
    by = {r.k: r for r in out}
    assert by[0].corrupt is None and by[0].note.header.author == "kim" and by[0].note.sections.metrics[0].value == "88"
    assert [by[k].corrupt for k in range(1, 6)] == texts[1:6] and all(by[k].note is None for k in range(1, 8)) and by[6].corrupt is None


def test_the_content_hash_covers_content_alone(spark):
    def hashed(change=lambda n: None):
        note = clean()
        change(note)
        read = nt.parse_notes(spark.createDataFrame([(json.dumps(note),)], "value string")).select("note.*")
        return read.select(nt.content_hash()).first()[0]

    base = hashed()
    assert base == hashed(lambda n: n.update(_state="sealed", attachments=[], content_sha256="x"))
    for change in (lambda n: n["period"].update(end="2026-03-15"), lambda n: n["wp_refs"].append("WP2"), lambda n: n["sections"]["work"][0].update(text="other"), lambda n: n["sections"]["metrics"][0].update(value=89)):
        assert hashed(change) != base


def test_blocks_of_a_bare_and_of_a_full_note(spark):
    full = clean()
    full["sections"]["goal"] = [{"text": "목표", "wp": "WP1"}, {"text": " "}]
    full["수정이력"] = [{"at": str(k), "by": "kim", "what": f"edit {k}"} for k in range(60)]
    texts = spark.createDataFrame([(json.dumps(n, ensure_ascii=False),) for n in (full, {"note_id": "RN-X", "project": "q"})], "value string")
    rows = nt.parse_notes(texts).select("note.*")
    ledger = spark.createDataFrame([("p", k, f"E{k}", "statement", "f.pdf", f"p.{k}", f"text {k}") for k in range(600, 0, -1)], "project string, n long, id string, kind string, source_file string, locator string, content string")
    out = {(r.project, r.n): r for r in nt.note_blocks(rows, ledger).collect()}
    mine = [out["p", k] for k in range(1, sum(p == "p" for p, _ in out) + 1)]
    assert [r.text for r in mine if r.kind == "h2"] == [nt.FORM[k] for k in ("goal", "work", "results", "metrics", "interpretation", "next_plan", "attachments", "ledger", "history")]
    assert [r.text for r in mine if r.kind == "p"] == ["· 목표 (WP1)", "· 첫 시험을 수행하였다 [E1].", "· The device was calibrated [E2].", "· a note of our own [E5].", "· 결과를 기록하였다 [E3].", nt.FORM["nothing"], nt.FORM["nothing"]]
    tables = [r.rows for r in mine if r.kind == "table"]
    assert [len(t) for t in tables] == [5, 2, 5, 501, 51] and [r[0] for r in tables[3][1:]] == [f"E{k}" for k in range(1, 501)] and tables[4][1] == ["10", "kim", "edit 10"]
    bare = [out["q", k] for k in range(1, sum(p == "q" for p, _ in out) + 1)]
    assert [r.kind for r in bare] == ["h1", "table"] + ["h2", "p"] * 7 + ["h2", "table", "small"] and bare[-1].text == "본문 해시: -"
    sheets = {(r.project, r.sheet): 0 for r in nt.note_sheets(rows, ledger).collect()}
    assert len(sheets) == 8 and nt.note_sheets(rows, ledger).where("project = 'p' and sheet = 'ledger'").count() == 601
    assert nt.note_blocks(rows.limit(0), ledger).count() == 0
