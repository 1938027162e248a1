"""All of a project's documents analysed in one pass: fields with their evidence, flags for what is missing, defaults, statistics.

Each document is read once: it explodes into its lines, each line into its candidates (field, key, tier, place, value, quote), and
everything after that works on candidates only. A line is searched for a field's pattern only if it holds one of the words without
which the pattern cannot match, and for Korean words only if it has Hangul, which is found once a line. A field takes the best
candidate of each key, lowest tier first, then document and line; the ledger numbers what was taken, by field and place,
across all documents of a project. No project's documents meet in one task: best candidates are partial aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import text as tx
from fieldbook.functions.dates import month_span, parse_loose
from fieldbook.functions.numbers import korean_number
from fieldbook.operators.extract import CODE, MILESTONE, MONTH_MARK, MONTHS, NO_NAMES, RANGE, ROLES, STAGE, SUBTASK, WP_LINE, ascii_bounds

# The labels of fields and what their values look like.
TITLE = r"연구개발\s*과제명|과제명|사업명|프로젝트명|연구\s*제목|Project\s*Title"
CODE_LABEL = r"과제\s*번호|공고\s*번호|협약\s*번호|과제코드|Project\s*(?:No|Number|Code)"
CODE_VALUE = r"([A-Z]{1,6}[-_]?\d{2,4}[-_]?\d{2,}[-_A-Z0-9]*|\d{4}[-_]\d{3,}[-_A-Z0-9]*)"
AGENCY = r"전문기관|부처|주관\s*부처|발주처|지원기관|Funding\s*Agency"
ORG = r"주관연구개발기관|주관기관|수행기관|주관\s*연구기관|기관명|회사명|Organization|Company"
PERIOD = r"연구개발\s*기간|수행\s*기간|사업\s*기간|연구\s*기간|총\s*기간|과제\s*기간"
BUDGET = r"총\s*연구개발비|총\s*사업비|정부지원\s*연구개발비|총\s*예산|연구개발비|Total\s*Budget"
BUDGET_VALUE = r"([\d,.]+\s*(?:조|억|천만|백만|십만|만|천)?\s*원|[\d,]+(?:\.\d+)?)"
KPI = r"([가-힣A-Za-z0-9()\s]{2,40}?)\s*(?:목표|달성치|기준)\s*[:：]?\s*([\d,.]+)\s*(%|점|건|회|초|ms|[가-힣]{0,3})\s*(?:이상|이하)?"
LOWER_BETTER = r"(?i)오류|에러|error|손실|loss|지연|latency|시간|비용|cost|결함|불량|brier|rmse|mae|편차|소비|전력"
NAME_COLUMN, ROLE_COLUMN, MEMBER = r"(?i)성명|이름|Name", r"(?i)역할|구분|직위|담당|Role", "참여연구원"
KPI_COLUMN, TARGET_COLUMN, UNIT_COLUMN = r"(?i)성능\s*지표|평가\s*지표|지표명?|평가\s*항목|항목명?|KPI", r"(?i)목표치?|목표값|달성\s*목표|최종\s*목표|Target", r"(?i)^단위$|Unit"
# Names of funding bodies.
AGENCIES = (
    "산업통상자원부|과학기술정보통신부|중소벤처기업부|보건복지부|교육부|환경부|해양수산부|농림축산식품부|국토교통부|방위사업청|식품의약품안전처|"
    "한국연구재단|한국산업기술기획평가원|한국산업기술진흥원|정보통신기획평가원"
)
_CODE, _MARK, _WP = (ascii_bounds(p) for p in (CODE, MONTH_MARK, WP_LINE))
#: Hangul, and a year with the sign behind it that dates and codes have
HANGUL, DATED = "[가-힣]", r"\d{4}[.\-/년]"
SEPARATORS = r"[\s:：·\-–|]*"
#: fields in the order in which the ledger numbers them, and the most values each keeps
FIELDS = {"title": 1, "code": 1, "agency": 1, "org": 1, "period": 1, "budget": 1, "people": 100, "packages": 40, "kpis": 60, "milestones": 20}
CANDIDATE = "struct<field:string,key:string,tier:int,rank:int,place:string,value:string,confidence:string,quote:string>"
QUOTE = 300


def _candidate(field: str, tier: int | Column, confidence: str | Column, place: Column, value: Column, quote: Column, key: Column | None = None, rank: Column | None = None) -> Column:
    """rank orders candidates of one tier before their places do."""
    return F.struct(
        F.lit(field).alias("field"), (F.lit("") if key is None else key).alias("key"), F.lit(tier).alias("tier"), (F.lit(0) if rank is None else rank).cast("int").alias("rank"),
        place.alias("place"), value.alias("value"), F.lit(confidence).alias("confidence"), F.left(quote, F.lit(QUOTE)).alias("quote"),
    ).cast(CANDIDATE)


def _after(label: str, line: Column) -> Column:
    """What follows the first label of a line, separators left out; empty without."""
    return F.trim(F.regexp_extract(line, rf"(?i)(?:{label}){SEPARATORS}(.*)$", 1))


def _has(line: Column, *words: str) -> Column:
    """Whether a line holds one of the words; patterns of any case ask its lower-case form. Of English words, a part that begins with a rare letter is asked."""
    return reduce(Column.__or__, [F.contains(line, F.lit(w)) for w in words])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being found once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _gated(line: Column, cheap: Column, gate: str, condition: Column, candidate: Column) -> Column:
    """The candidate, or null: most lines hold nothing of most fields, and what every match of the gate holds tells before dear patterns run."""
    return F.when(cheap, F.when(line.rlike(gate), F.when(condition, candidate)))


def _clean(raw: Column) -> Column:
    """norm_space of a line, which most lines need no pattern for."""
    return F.when(_has(raw, "  ", *tx.ODD_SPACES), tx.norm_space(raw)).otherwise(F.trim(raw))


def _labelled(line: Column, low: Column, at: Column, tier: int, hangul: Column | None = None) -> list[Column]:
    """Candidates of the fields that are a label's value; a label that stands for itself gives none. low: the line in lower case.

    hangul: whether the line has any, without which it has no Korean word; None if that is not known.
    """
    korean = lambda *words: _has(line, *words) if hangul is None else hangul & _has(line, *words)
    some = lambda x, low, high: F.length(x).between(low, high)
    title, agency, org, money = (_after(p, line) for p in (TITLE, AGENCY, ORG, BUDGET))
    code = F.coalesce(F.nullif(F.regexp_extract(_after(CODE_LABEL, line), CODE_VALUE, 1), F.lit("")), F.nullif(F.regexp_extract(line, CODE_VALUE, 1), F.lit("")))
    sum_ = F.regexp_extract(money, BUDGET_VALUE, 1)
    amount = korean_number(F.regexp_replace(sum_, r"\s", ""))
    return [
        _gated(line, _has(low, "ject") | korean("과제명", "사업명", "프로젝트명", "제목"), f"(?i){TITLE}", some(title, 4, 200) & ~title.rlike(r"^[\d.\-\s]+$"), _candidate("title", tier, "high", at, title, line)),
        _gated(line, _has(low, "ject") | korean("번호", "과제코드"), f"(?i){CODE_LABEL}", code.isNotNull(), _candidate("code", tier, "high", at, code, line)),
        _gated(line, _has(low, "gency") | korean("전문기관", "부처", "발주처", "지원기관"), f"(?i){AGENCY}", some(agency, 2, 60), _candidate("agency", tier, "high", at, agency, line)),
        _gated(line, _has(low, "zation", "mpany") | korean("기관", "회사명"), f"(?i){ORG}", some(org, 2, 60) & ~org.rlike("기관명|회사명"), _candidate("org", tier, "high", at, org, line)),
        _gated(line, _has(low, "budget") | korean("개발비", "사업비", "예산"), f"(?i){BUDGET}", amount > 0, _candidate("budget", tier, "medium", at, amount.cast("decimal(20,0)").cast("string"), line)),
    ]


def _range(line: Column, dated: Column, at: Column, tier: int | Column, confidence: str | Column) -> Column:
    """The date range of a text, if it is dated (see DATED); of equal tiers the one of most months comes first."""
    a, b = F.regexp_extract(line, RANGE, 1), F.regexp_extract(line, RANGE, 2)
    last = parse_loose(b)
    end = F.when(b.rlike(r"^\d{4}\s*[.\-/년]\s*\d{1,2}\s*월?\.?$"), F.last_day(last)).otherwise(last)

    def found(x: Column) -> Column:
        value = F.concat_ws("~", x["start"].cast("string"), x["end"].cast("string"))
        return F.when(x["end"] > x["start"], _candidate("period", tier, confidence, at, value, line, rank=-month_span(x["start"], x["end"])))

    return _gated(line, dated, RANGE, F.lit(True), _once(F.struct(parse_loose(a).alias("start"), end.alias("end")), found))


def _of_line(line: Column, low: Column, hangul: Column, dated: Column, at: Column) -> Column:
    """A line's candidates; low is the line in lower case, hangul whether it has any, dated whether it matches DATED."""
    korean = lambda *words: hangul & _has(line, *words)
    part = lambda p, k: F.regexp_extract(line, p, k)
    label = line.rlike(PERIOD)
    text = lambda c: c.cast("string")
    role = F.regexp_replace(part(rf"({ROLES})", 1), r"\s+", " ")
    # the first Hangul after the role, whatever stands between
    name = part(rf"(?:{ROLES})[^가-힣]*([가-힣]{{2,4}})", 1)

    def person(x: Column) -> Column:
        both = F.concat_ws("|", x, role)
        return F.when((F.length(x) >= 2) & ~x.isin(NO_NAMES), _candidate("people", 1, "medium", at, both, line, both))

    def package(pattern: str, most: int, tier: int, confidence: str) -> Column:
        name = F.left(F.trim(part(pattern, 2)), F.lit(160))
        use = lambda x: F.when(x["n"].between(1, most) & (F.length(x["name"]) >= 2), _candidate("packages", tier, confidence, at, x["name"], line, F.lpad(text(x["n"]), 2, "0")))
        return _once(F.struct(part(pattern, 1).try_cast("int").alias("n"), name.alias("name")), use)

    months = lambda n: F.when(n.between(1, 120), _candidate("period", 9, "low", at, F.concat(text(n), F.lit(" months")), line))
    goal, kpi = korean_number(part(KPI, 2)), F.left(tx.norm_space(part(KPI, 1)), F.lit(120))

    def stone(x: Column) -> Column:
        key = F.concat(F.lit("M"), text(x["month"]))
        value = F.concat_ws("|", text(x["month"]), F.coalesce(F.nullif(x["title"], F.lit("")), F.concat(key, F.lit(" 마일스톤"))))
        return F.when(x["month"].between(1, 120), _candidate("milestones", 1, "medium", at, value, line, key))

    by_word = _has(low, "마일스톤", "milestone") & line.rlike(MILESTONE)
    marked = lambda k: F.when(by_word, part(MILESTONE, k)).otherwise(part(_MARK, k))
    mark = F.struct(marked(1).try_cast("int").alias("month"), F.trim(marked(2)).alias("title"))
    stage = F.concat(F.lit("S"), part(STAGE, 1))
    found = [
        *_labelled(line, low, at, 2, hangul),
        # a code has a year with a sign behind it, as dates have
        _gated(line, dated & line.rlike(r"[A-Z]-\d{4}-\d{4}"), _CODE, F.lit(True), _candidate("code", 3, "medium", at, part(_CODE, 1), line)),
        F.when(korean(*AGENCIES.split("|")), _candidate("agency", 3, "medium", at, part(f"({AGENCIES})", 1), line)),
        _range(line, dated, at, F.when(label, 1).otherwise(3), F.when(label, "high").otherwise("medium")),
        F.when(korean("개월"), _once(part(MONTHS, 1).try_cast("int"), months)),
        # names are Hangul, whatever their role is written in
        F.when(korean("책임자", "연구원", "PI", "Investigator"), _once(name, person)),
        F.when(_has(low, "wp"), package(_WP, 40, 1, "high")),
        F.when(korean("세부"), package(SUBTASK, 99, 3, "medium")),
        F.when(korean("목표", "달성치", "기준"), F.when(goal.isNotNull() & (F.length(kpi) >= 2), _candidate("kpis", 2, "medium", at, F.concat_ws("|", kpi, part(KPI, 3), text(goal), F.when(kpi.rlike(LOWER_BETTER), "lower").otherwise("higher")), line, F.lower(kpi)))),
        F.when(_has(low, "milestone") | korean("마일스톤", "평가", "점검"), _once(mark, stone)),
        _gated(line, korean("단계"), STAGE, ~(by_word | line.rlike(_MARK)), _candidate("milestones", 1, "medium", at, F.concat(F.lit("|"), F.trim(F.concat_ws(" ", F.concat(part(STAGE, 1), F.lit("단계")), part(STAGE, 2), part(STAGE, 3)))), line, stage)),
    ]
    return F.array_compact(F.array(*found))


def line_candidates(docs: DataFrame) -> DataFrame:
    """(project, di, CANDIDATE…) of documents (project, di, text); field # counts a document's lines in its value.

    A document's first line of 8 to 120 characters is its title where nothing names one.
    """
    raw = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), _clean)
    lines = docs.select("project", "di", F.filter(F.transform(raw, lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda x: x["line"] != "").alias("lines"))
    # before its lines, each document has a row with the line that may be its title, and their number
    head = F.transform(F.array(F.try_element_at(F.filter("lines", lambda x: F.length(F.left(x["line"], F.lit(121))).between(8, 120)), F.lit(1))), lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"), F.size("lines").alias("n")))
    body = F.transform("lines", lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"), F.lit(None).cast("int").alias("n")))
    rows = lines.select("project", "di", F.explode(F.concat(head, body)).alias("x")).select("project", "di", "x.line", "x.n", F.lpad((F.col("x.i") + 1).cast("string"), 9, "0").alias("place"))
    line, at = F.col("line"), F.col("place")
    rows = rows.withColumns({"low": F.lower(line), "hangul": line.rlike(HANGUL), "dated": line.rlike(DATED)})
    guess = F.when(line.isNotNull(), _candidate("title", 9, "low", at, line, line))
    size = _candidate("#", 0, "", F.lit(""), F.col("n").cast("string"), F.lit(""))
    each = F.when(F.col("n").isNull(), _of_line(line, F.col("low"), F.col("hangul"), F.col("dated"), at)).otherwise(F.array_compact(F.array(guess, size)))
    return rows.select("project", "di", F.explode(each).alias("x")).select("project", "di", "x.*")


def cell_candidates(cells: DataFrame) -> DataFrame:
    """Candidates from tables, cells (project, di, t, r, c, v): values beside or below a label, ranges, people and indicators by columns."""
    v = cells.select("project", "di", "t", "r", "c", tx.norm_space(F.col("v")).alias("v"))
    at = F.concat(F.lit("t"), F.lpad(F.col("t").cast("string"), 4, "0"), F.lit("r"), F.lpad(F.col("r").cast("string"), 6, "0"), F.lit("c"), F.lpad(F.col("c").cast("string"), 4, "0"))
    right = F.lead("v").over(Window.partitionBy("project", "di", "t", "r").orderBy("c"))
    below = F.lead("v").over(Window.partitionBy("project", "di", "t", "c").orderBy("r"))
    near = v.withColumns({"at": at, "right": right, "below": below})
    # a label and its neighbour are read as one line; the neighbour to the right comes first
    pair = lambda c, k: F.when(F.col(c) != "", F.struct(F.concat_ws(": ", "v", c).alias("line"), F.concat("at", F.lit(k)).alias("at")))
    is_label = F.col("v").rlike(rf"(?i)^\s*(?:{TITLE}|{CODE_LABEL}|{AGENCY}|{ORG}|{BUDGET})\s*$")
    pairs = F.filter(F.array(F.when(is_label, pair("right", "a")), F.when(is_label, pair("below", "b"))), lambda x: x.isNotNull())
    labelled = F.flatten(F.transform(pairs, lambda x: F.filter(F.array(*_labelled(x["line"], F.lower(x["line"]), x["at"], 1)), lambda y: y.isNotNull())))
    ranges = F.filter(F.array(_range(F.col("v"), F.col("v").rlike(DATED), F.col("at"), 2, "medium")), lambda x: x.isNotNull())
    single = near.select("project", "di", F.explode(F.concat(labelled, ranges)).alias("x"))

    rows = v.groupBy("project", "di", "t", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("v"))
    find = lambda p: F.array_position(F.transform("v", lambda x: x.rlike(p)), True).cast("int")
    kinds = {"name": NAME_COLUMN, "role": ROLE_COLUMN, "kpi": KPI_COLUMN, "target": TARGET_COLUMN, "unit": UNIT_COLUMN}
    heads = rows.where("r < 3").select("project", "di", "t", F.col("r").alias("hr"), *[find(p).alias(k) for k, p in kinds.items()])
    people = heads.where("hr = 0 and name > 0").select("project", "di", "t", "hr", F.lit("people").alias("kind"), *kinds)
    goals = heads.where("kpi > 0 and target > 0").groupBy("project", "di", "t").agg(F.min(F.struct("hr", *kinds)).alias("h")).select("project", "di", "t", "h.hr", F.lit("kpis").alias("kind"), *[f"h.{k}" for k in kinds])
    body = rows.where("r between 1 and 199").join(people.unionByName(goals), ["project", "di", "t"]).where("r > hr")
    cell = lambda k: F.coalesce(F.when(F.col(k) > 0, F.get("v", F.col(k) - 1)), F.lit(""))
    row_at = F.concat(F.lit("t"), F.lpad(F.col("t").cast("string"), 4, "0"), F.lit("r"), F.lpad(F.col("r").cast("string"), 6, "0"))
    member = F.when(F.col("role") > 0, F.coalesce(F.nullif(cell("role"), F.lit("")), F.lit(MEMBER))).otherwise(MEMBER)
    person = F.concat_ws("|", cell("name"), member)
    goal = cell("target")
    cleaned = F.trim(F.regexp_replace(goal, "이상|이하|초과|미만|↑|↓", ""))
    number = F.coalesce(korean_number(cleaned), F.replace(F.regexp_extract(cleaned, r"(-?\d[\d,]*(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double"))
    inline = F.when(korean_number(cleaned).isNotNull(), F.when(cleaned.rlike(r"%\s*$"), "%").otherwise("")).otherwise(F.left(F.trim(F.regexp_replace(cleaned, r"^.*?-?\d[\d,]*(?:\.\d+)?", "")), F.lit(10)))
    direction = F.when(goal.rlike("이하|미만"), "lower").when(goal.rlike("이상|초과"), "higher").when(cell("kpi").rlike(LOWER_BETTER), "lower").otherwise("higher")
    indicator = F.concat_ws("|", F.left(cell("kpi"), F.lit(120)), F.left(F.when(F.col("unit") > 0, cell("unit")).otherwise(inline), F.lit(20)), F.coalesce(number.cast("string"), goal), direction)
    found = (
        F.when((F.col("kind") == "people") & cell("name").rlike(r"^[가-힣]{2,4}$") & ~cell("name").isin(NO_NAMES), _candidate("people", 2, "high", row_at, person, F.concat_ws(" / ", cell("name"), member), person))
        .when((F.col("kind") == "kpis") & (F.length(cell("kpi")) >= 2) & (goal != "") & ~cell("kpi").rlike("합계|소계|비고"), _candidate("kpis", 1, "high", row_at, indicator, F.concat(cell("kpi"), F.lit(" / "), goal), F.lower(cell("kpi"))))
    )
    return single.unionByName(body.select("project", "di", found.alias("x")).where("x is not null")).select("project", "di", "x.*")


def analyse(docs: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(project, fields, flags, docs, lines, evidence): one row a project of documents (project, di, text), tables beside them.

    fields: array of (field, nth, key, value, confidence, evidence, di, place, quote), by field and number. Single fields take their best
    candidate; people, packages, kpis and milestones the best of each key, packages of the lowest tier only, in order of place
    (packages by number, milestones by month). evidence numbers E1, E2, … what was taken, by field and place, before it is sorted.
    Defaults without evidence in a document have confidence none: a title, 24 months from a start to be set, three packages.
    flags tell what was guessed or is missing. A null text has no lines; di must differ between documents of a project.
    """
    found = line_candidates(docs)
    if cells is not None:
        found = found.unionByName(cell_candidates(cells))
    order = F.struct("tier", "rank", "di", "place", "value", "confidence", "quote")
    # every document adds a candidate of field #, so each project has a row of it, which comes last and numbers nothing
    is_size = F.col("field") == "#"
    one = found.groupBy("project", "field", "key").agg(F.min(order).alias("x"), F.count_if(is_size).alias("docs"), F.sum(F.when(is_size, F.col("value").cast("long"))).alias("lines"))
    one = one.select("project", "field", "key", "x.*", "docs", "lines")
    number = F.create_map(*[F.lit(x) for k, f in enumerate([*FIELDS, "#"]) for x in (f, k)])
    most = F.create_map(*[F.lit(x) for f, n in FIELDS.items() for x in (f, n)])
    of_field = Window.partitionBy("project", "field")
    taken = one.withColumns({"low": F.min("tier").over(of_field), "no": F.element_at(number, F.col("field"))})
    taken = taken.where("field <> 'packages' or tier = low or (tier <= 2 and low <= 2)")
    ledger = F.row_number().over(Window.partitionBy("project").orderBy("no", "tier", "rank", "di", "place", "key"))
    shown = F.when(F.col("field") == "packages", F.col("key")).when(F.col("field") == "milestones", F.lpad(F.coalesce(F.nullif(F.substring_index("value", "|", 1), F.lit("")), F.lit("999")), 3, "0")).otherwise("")
    nth = F.row_number().over(of_field.orderBy(shown, "ledger"))
    items = taken.withColumn("ledger", ledger).withColumn("nth", nth).where((F.col("field") == "#") | (F.col("nth") <= F.element_at(most, F.col("field"))))
    item = F.struct("no", "nth", "field", "key", "value", "confidence", F.concat(F.lit("E"), F.col("ledger").cast("string")).alias("evidence"), "di", "place", "quote", "ledger")
    # a project keeps at most as many items as FIELDS allow
    is_item = F.col("field") != "#"
    whole = items.groupBy("project").agg(
        F.array_sort(F.collect_list(F.when(is_item, item))).alias("items"), F.max(F.when(is_item, F.col("ledger"))).alias("last"),
        F.max("docs").alias("docs"), F.max("lines").alias("lines"),
    )
    kind = f"array<{item_type(docs)}>"
    whole = whole.withColumns({"items": F.col("items").cast(kind), "last": F.coalesce("last", F.lit(0))})

    has = lambda f: F.exists("items", lambda x: x["field"] == f)
    sure = lambda f, c: F.exists("items", lambda x: (x["field"] == f) & (x["confidence"] == c))
    flags = [
        F.when(~has("title"), "title_default").when(sure("title", "low"), "title_guessed"), F.when(~has("code"), "no_code"), F.when(~has("org"), "no_org"),
        F.when(~has("period"), "no_period").when(sure("period", "low"), "months_only"), F.when(~has("people"), "no_people"), F.when(~has("packages"), "no_packages"), F.when(~has("kpis"), "no_kpis"),
        F.when(F.col("lines") == 0, "no_text"),
    ]

    def default(field: str, values: list[str], numbered: bool) -> Column:
        n = (F.col("last") + 1 + (F.when(~has("title"), 1).otherwise(0) if field == "period" else 0)).cast("int")
        made = [
            F.struct(F.lit(list(FIELDS).index(field)).alias("no"), F.lit(k + 1).alias("nth"), F.lit(field).alias("field"), F.lit(f"{k + 1:02}" if len(values) > 1 else "").alias("key"), F.lit(v).alias("value"), F.lit("none").alias("confidence"),
                     (F.concat(F.lit("E"), n.cast("string")) if numbered else F.lit(None).cast("string")).alias("evidence"), F.lit(None).alias("di"), F.lit("").alias("place"), F.lit("").alias("quote"), (n if numbered else F.lit(None)).alias("ledger"))
            for k, v in enumerate(values)
        ]
        return F.when(has(field), F.array().cast(kind)).otherwise(F.array(*made).cast(kind))

    # What a project without title or packages gets.
    filled = F.concat("items", default("title", ["신규 연구 프로젝트"], True), default("period", ["24 months"], True), default("packages", ["연구 기획 및 설계", "연구 수행 및 데이터 확보", "결과 분석 및 정리"], False))
    count = F.size(F.filter(filled, lambda x: x["evidence"].isNotNull()))
    clean = F.transform(F.array_sort(filled), lambda x: F.struct(*[x[c].alias(c) for c in ("field", "nth", "key", "value", "confidence", "evidence", "di", "place", "quote")]))
    return whole.select("project", clean.alias("fields"), F.array_compact(F.array(*flags)).alias("flags"), "docs", "lines", count.cast("long").alias("evidence"))


def item_type(docs: DataFrame) -> str:
    di = docs.schema["di"].dataType.simpleString()
    return f"struct<no:int,nth:int,field:string,key:string,value:string,confidence:string,evidence:string,di:{di},place:string,quote:string,ledger:int>"
