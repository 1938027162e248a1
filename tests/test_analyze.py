"""Whole projects analysed in one pass: planted plans with noise, tables, several documents, defaults and flags."""

from __future__ import annotations

import random

import pytest

from fieldbook.operators import analyze

NOISE = ["본 자료의 무단 배포를 금한다.", "별첨 문서를 참조하라.", "내부 검토용 초안임을 밝힌다.", "관련 회의록은 별도 보관한다.", "이하 여백.", "문의처는 행정 담당 부서이다."]


def plan(rng: random.Random) -> tuple[dict, str, list]:
    """A plan's truth, its lines among noise, and its table of indicators."""
    y = rng.randrange(2024, 2028)
    truth = {
        "title": rng.choice(["장내 미생물 기반 신약 개발", "고효율 배터리 소재 연구", "자율 로봇 공정 제어"]), "code": f"RS-{y}-{rng.randrange(10**7, 10**8)}", "org": rng.choice(["(주)한빛연구소", "대한기술원"]), "start": f"{y}-{rng.randrange(1, 10):02}-01", "end": f"{y + 2}-12-31",
        "pi": rng.choice(["김민수", "박서준", "이지은"]), "packages": [f"{k}차 과업 수행" for k in range(1, rng.randrange(2, 6))], "kpis": [("공정 수율", "%", rng.randrange(80, 99), "higher"), ("응답 지연", "ms", rng.randrange(10, 200), "lower")],
    }
    sep, dash = rng.choice([": ", " : ", " - ", " "]), rng.choice([" ~ ", "~", " ∼ ", " – "])
    day = rng.choice([lambda d: d, lambda d: "{}.{}.{}".format(*(int(x) for x in d.split("-"))), lambda d: "{}년 {}월 {}일".format(*(int(x) for x in d.split("-")))])
    wp = rng.choice(["WP{}: {}", "WP {}. {}", "WP-{} {}"])
    core = [f"{rng.choice(['과제명', '연구개발과제명', '사업명'])}{sep}{truth['title']}", f"{rng.choice(['과제번호', '공고번호', '과제 번호'])}{sep}{truth['code']}", f"{rng.choice(['주관연구개발기관', '주관기관', '수행기관'])}{sep}{truth['org']}", f"{rng.choice(['연구개발기간', '수행기간', '연구 기간'])}{sep}{day(truth['start'])}{dash}{day(truth['end'])}", f"연구책임자{sep}{truth['pi']}"]
    core += [wp.format(k, name) for k, name in enumerate(truth["packages"], 1)]
    lines = ["연구개발계획서"]
    for line in core:
        lines += [rng.choice(NOISE)] * (rng.random() < 0.4) + [line]
    units, style = rng.random() < 0.6, rng.randrange(3)
    head = [rng.choice(["성능지표", "평가지표", "지표명", "평가 항목"]), *(["단위"] if units else []), rng.choice(["목표치", "최종 목표", "목표값"])]
    word = {"lower": "이하", "higher": "이상"}
    rows = [[n, *([u] if units else []), [str(t), f"{t} {word[d]}", f"{t}{u} {word[d]}"][style]] for n, u, t, d in truth["kpis"]]
    return truth | {"units": units or style == 2}, "\n".join(lines), [head, *rows]


def fields(row) -> dict[str, list]:
    out = {}
    for x in row.fields:
        out.setdefault(x.field, []).append(x)
    return out


def analysed(spark, docs: list, tables: list = ()) -> dict:
    cells = spark.createDataFrame([(p, d, t, r, c, v) for p, d, t, rows in tables for r, row in enumerate(rows) for c, v in enumerate(row)], "project string, di int, t int, r int, c int, v string")
    return {r.project: r for r in analyze.analyse(spark.createDataFrame(docs, "project string, di int, text string"), cells).collect()}


def test_plans_among_noise(spark):
    rng = random.Random(11)
    plans = [plan(rng) for _ in range(60)]
    out = analysed(spark, [(f"p{k}", 0, text) for k, (_, text, _) in enumerate(plans)], [(f"p{k}", 0, 0, rows) for k, (_, _, rows) in enumerate(plans)])
    for k, (truth, text, _) in enumerate(plans):
        f = fields(out[f"p{k}"])
        assert [f[x][0].value for x in ("title", "code", "org", "period")] == [truth["title"], truth["code"], truth["org"], f"{truth['start']}~{truth['end']}"], text
        assert [x.value for x in f["people"]] == [f"{truth['pi']}|연구책임자"] and [(x.key, x.value) for x in f["packages"]] == [(f"{i:02}", n) for i, n in enumerate(truth["packages"], 1)]
        got = [x.value.split("|") for x in f["kpis"]]
        assert [(n, float(t)) for n, _, t, _ in got] == [(n, t) for n, _, t, _ in truth["kpis"]] and [d for *_, d in got] == ["higher", "lower"]
        if truth["units"]:
            assert [u for _, u, _, _ in got] == ["%", "ms"]
        assert out[f"p{k}"].flags == [] and out[f"p{k}"].evidence == 7 + len(truth["packages"])
        numbers = [int(x.evidence[1:]) for x in out[f"p{k}"].fields]
        assert numbers == list(range(1, len(numbers) + 1))


def test_documents_of_a_project_count_together(spark):
    docs = [("p", 0, "처음 문서의 첫 문단이다.\n예산은 없다"), ("p", 1, "과제명: 두 번째 문서의 과제\nWP2: 둘째 과업\n2026.1.1 ~ 2026.6.30"), ("p", 2, "WP1: 첫째 과업\nWP2: 다시 둘째\n연구기간: 2026년 3월 ~ 2027년 2월\n총 연구개발비 : 350백만원\n과학기술정보통신부 공고\nM12 평가: 중간 점검\n1단계 평가 완료\n불량률 목표 3% 이하"), ("q", 0, None), ("q", 1, "")]
    out = analysed(spark, docs)
    f = fields(out["p"])
    assert f["title"][0].value == "두 번째 문서의 과제" and f["title"][0].di == 1 and f["period"][0].value == "2026-03-01~2027-02-28" and f["period"][0].confidence == "high"
    assert [(x.value, x.di) for x in f["packages"]] == [("첫째 과업", 2), ("둘째 과업", 1)] and [x.evidence for x in f["packages"]] == ["E6", "E5"]
    assert f["agency"][0].value == "과학기술정보통신부" and f["agency"][0].confidence == "medium" and f["budget"][0].value == "350000000"
    assert [x.value for x in f["milestones"]] == ["12|중간 점검", "|1단계 평가 완료"] and f["kpis"][0].value == "불량률|%|3.0|lower"
    assert (out["p"].docs, out["p"].lines, out["p"].flags) == (3, 13, ["no_code", "no_org", "no_people"])
    g = fields(out["q"])
    assert (g["title"][0].value, g["title"][0].evidence, g["period"][0].value, g["period"][0].evidence, [x.evidence for x in g["packages"]]) == ("신규 연구 프로젝트", "E1", "24 months", "E2", [None] * 3)
    assert out["q"].flags == ["title_default", "no_code", "no_org", "no_period", "no_people", "no_packages", "no_kpis", "no_text"] and (out["q"].docs, out["q"].lines, out["q"].evidence) == (2, 0, 2)


def test_tables_name_fields_periods_people_and_indicators(spark):
    tables = [
        ("p", 0, 0, [["과제명", "표에 적은 과제", "과제번호", "TS-2026-0001"], ["연구 기간", "2026.01.01 ~ 2027.12.31", "", ""], ["주관기관", "", "", ""], ["가나연구소", "", "", ""]]),
        ("p", 0, 1, [["구분", "성명", "소속"], ["책임", "홍길동", "가나"], ["", "성춘향", "다라"], ["", "Smith", "x"], ["합계", "합계", ""]]),
    ]
    f = fields(analysed(spark, [("p", 0, "과제명: 줄에 적은 과제\n연구책임자: Dr. 홍길동")], tables)["p"])
    assert (f["title"][0].value, f["code"][0].value, f["org"][0].value) == ("표에 적은 과제", "TS-2026-0001", "가나연구소")
    assert (f["period"][0].value, f["period"][0].confidence) == ("2026-01-01~2027-12-31", "medium")
    assert [x.value for x in f["people"]] == ["홍길동|연구책임자", "홍길동|책임", "성춘향|참여연구원"]


@pytest.mark.parametrize("text,flag", [("이 과제의 총 기간은 30개월이다", "months_only"), ("짧다", "title_default"), ("여덟 글자보다 긴 첫 줄", "title_guessed")])
def test_flags_of_what_is_guessed(spark, text, flag):
    assert flag in analysed(spark, [("p", 0, text)])["p"].flags


@pytest.mark.parametrize("line,field,value", [
    ("pRoJecttiTle: An Odd Study", "title", "An Odd Study"), ("연구\u3000제목 - 긴 이름의 연구", "title", "긴 이름의 연구"), ("PROJECT  code AB-2024-001", "code", "AB-2024-001"),
    ("x ABC-2024-12345", "code", "ABC-2024-12345"), ("FUNDINGAGENCY: Some Office", "agency", "Some Office"), ("the 정보통신기획평가원 pays", "agency", "정보통신기획평가원"), ("oRGANIZATION\tOne", "org", "One"),
    ("COMPANY: Two", "org", "Two"), ("Total\xa0BUDGET 1,200 원", "budget", "1200"), ("2023.1.5 ~ 2024년 2월", "period", "2023-01-05~2024-02-29"), ("총 6 개월", "period", "6 months"),
    ("PI: 홍길동", "people", "홍길동|PI"), ("wP-3: Parts", "packages", "Parts"), ("제2세부: 분석과 시험", "packages", "분석과 시험"), ("정확도 목표 92", "kpis", "정확도||92.0|higher"),
    ("MILEstone M4: End", "milestones", "4|End"), ("M7점검: 중간", "milestones", "7|중간"), ("2 단계 완료: 끝", "milestones", "|2단계 완료 끝"),
])
def test_words_of_any_case_and_script_are_found(spark, line, field, value):
    """What is asked before a pattern runs holds for each of its forms."""
    found = analyze.line_candidates(spark.createDataFrame([("p", 0, line)], "project string, di int, text string")).where("tier < 9 or field <> 'title'").collect()
    assert value in {r.value for r in found if r.field == field}


def test_one_scan_of_the_documents(spark, tmp_path):
    spark.createDataFrame([("p", 0, "과제명: 하나의 과제")], "project string, di int, text string").write.parquet(f"{tmp_path}/d")
    out = analyze.analyse(spark.read.parquet(f"{tmp_path}/d"))
    out.collect()
    plan_ = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan_.count("FileScan") == 1 and out.limit(1).count() == 1
    assert analyze.analyse(spark.read.parquet(f"{tmp_path}/d").limit(0)).count() == 0


def test_systems_of_drawn_plans_break_no_rule(spark):
    """From documents to sprints and metrics; a project without any document text gets the defaults."""
    from datetime import date

    from fieldbook.operators import planner, system

    rng = random.Random(5)
    plans = [plan(rng) for _ in range(12)]
    docs = spark.createDataFrame([(f"p{k}", 0, text) for k, (_, text, _) in enumerate(plans)] + [("bare", 0, None)], "project string, di int, text string")
    cells = spark.createDataFrame([(f"p{k}", 0, 0, r, c, v) for k, (_, _, rows) in enumerate(plans) for r, row in enumerate(rows) for c, v in enumerate(row)], "project string, di int, t int, r int, c int, v string")
    made = system.generate(spark.createDataFrame(analyze.analyse(docs, cells).collect(), analyze.analyse(docs, cells).schema), "2026-08-12")
    assert system.breaches(made).count() == 0
    projects = {r.project: r for r in made["projects"].collect()}
    for k, (truth, _, _) in enumerate(plans):
        p = projects[f"p{k}"]
        assert (p.title, p.code, p.org, str(p.start), str(p.end), p.source) == (truth["title"], truth["code"], truth["org"], truth["start"], truth["end"], "extracted")
    assert made["packages"].where("project = 'p0'").count() == len(plans[0][0]["packages"])
    metrics = {(r.project, r.key): (r.target, r.direction) for r in made["metrics"].collect()}
    assert metrics["p0", "공정_수율"] == (float(plans[0][0]["kpis"][0][2]), "higher") and len(metrics) == 24
    bare = projects["bare"]
    assert (bare.title, bare.code, bare.start, bare.end, bare.months, bare.source) == (system.NO_TITLE, "PRJ-2026-0812", date(2026, 9, 1), date(2028, 8, 31), 24, "months" if bare.source == "months" else "default")
    days = (bare.end - bare.start).days + 1
    assert made["sprints"].where("project = 'bare'").count() == -(-days // 14) and made["months"].where("project = 'bare'").count() == 24 and made["packages"].where("project = 'bare'").count() == 3
    weekly = planner.sprint_grid(made["projects"].where("project = 'bare'").select("project", "start", "end"), 7)
    assert weekly.count() == -(-days // 7)
