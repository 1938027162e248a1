"""Registered queries of the note life cycle, month and package views, and further ways of extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions import text as tx
from fieldbook.functions.hashing import fields_hash
from fieldbook.operators import draft, extract, gates, lifecycle, planner, seal, views
from fieldbook.plans import mapping as m
from fieldbook.plans.queries import _LEDGER, _NOTES, _PACKAGES, _PROJECTS, _SPRINTS, SEALED_FIELDS, TODAY, _packages, _projects, query

_SLOT = "'RN-' || strftime({0}start, '%Y%m%d') || '-' || strftime({0}\"end\", '%Y%m%d')"


def _in_slots(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """rows (project, row_id, day) with the sprint of their day in the project's own grid, its start and end, and the note of its slot; every fourth is a revision."""
    period = projects.select("project", F.col("start").alias("p0"), F.col("end").alias("p1"))
    o = rows.join(period, "project").withColumn("sprint", planner.assign_sprint(F.col("day"), F.col("p0")))
    start = F.expr("date_add(p0, 14 * (sprint - 1))")
    o = o.withColumns({"start": start, "end": F.least(F.date_add(start, 13), F.col("p1")), "revision": (F.col("row_id") % 4 == 0).cast("int")})
    return o.withColumn("note_id", seal.note_id(F.col("start"), F.col("end"), F.col("revision")))


def _slot_notes(spark: SparkSession, sf: str) -> DataFrame:
    """A note an order in the project's own sprint of its date; every fourth is a revision."""
    orders = m.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("project"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    state = F.when(F.col("o_orderstatus") == "F", "sealed").when(F.col("o_orderstatus") == "O", "draft").otherwise("awaiting_sign")
    return _in_slots(orders, _projects(spark, sf)).select("project", "row_id", "sprint", "start", "end", "revision", "note_id", state.alias("state"))


_STATE = "CASE o_orderstatus WHEN 'F' THEN 'sealed' WHEN 'O' THEN 'draft' ELSE 'awaiting_sign' END"
#: the SQL finds a note's sprint by its date within the sprint's bounds, not by number or id
_HELD = f"""held AS (SELECT s.*, o_orderkey AS row_id, {_STATE} AS state, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS revision
  FROM sprints AS s JOIN orders ON o_custkey = s.project AND CAST(o_orderdate AS DATE) BETWEEN s.start AND s."end")"""


@query("slot_states", f"""WITH {_PROJECTS}, {_SPRINTS}, {_HELD} SELECT s.project, s.seq, {_SLOT.format('s.')} AS slot, count(h.row_id) AS notes, coalesce(max((h.revision, h.state)) FILTER (h.row_id IS NOT NULL)[2], 'empty') AS state
FROM sprints AS s LEFT JOIN held AS h ON h.project = s.project AND h.seq = s.seq GROUP BY s.project, s.seq, s.start, s."end" """)
def slot_states(spark, sf):
    return lifecycle.slot_states(planner.sprint_grid(_projects(spark, sf)), _slot_notes(spark, sf))


@query("note_create", f"""WITH {_PROJECTS}, {_SPRINTS} SELECT project, seq, {_SLOT.format('s.')} AS note_id, start, "end", 0 AS revision, NULL::VARCHAR AS supersedes, 'draft' AS state, 'advisory' AS mode
FROM sprints AS s WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = s.project AND CAST(o_orderdate AS DATE) BETWEEN s.start AND s."end")""")
def note_create(spark, sf):
    """A draft for each sprint of a project in which it has no note."""
    return lifecycle.create_notes(_projects(spark, sf), _slot_notes(spark, sf))


@query("gate_apply", f"""WITH {_NOTES} SELECT note_id, CASE WHEN trim(author) = '' OR trim(reviewer) = '' OR trim(author) = trim(reviewer) OR written_on IS NULL OR "end" < start THEN 'rejected' ELSE 'awaiting_sign' END AS state FROM notes""")
def gate_apply(spark, sf):
    """The state of each note after the gate of required fields."""
    notes = m.notes(m.table(spark, sf, "orders"))
    decisions = gates.decide(gates.g4_required(notes), notes.select(F.col("note_id").alias("location")), mode="strict")
    return lifecycle.apply_gates(notes, decisions).select("note_id", "state")


@query("note_signatures", """SELECT l_orderkey AS note_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY signed_at, signer) AS INTEGER) AS nth, signer, signed_at
FROM (SELECT l_orderkey, 's' || (l_suppkey % 3) AS signer, min(CAST(l_shipdate AS DATE)) AS signed_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' AND l_linenumber <> 3 GROUP BY 1, 2)""")
def note_signatures(spark, sf):
    """A request for a signature a line item; third lines sign an older content."""
    notes = seal.content_hash(m.notes(m.table(spark, sf, "orders")), SEALED_FIELDS).select("note_id", "state", "content_sha256")
    item = m.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("signer"), F.to_date("l_shipdate").alias("signed_at"), "l_linenumber")
    seen = notes.select("note_id", F.col("content_sha256").alias("seen"))
    requests = item.join(seen, "note_id").select("note_id", "signer", "signed_at", F.when(F.col("l_linenumber") == 3, F.sha2("seen", 256)).otherwise(F.col("seen")).alias("content_sha256"))
    return lifecycle.add_signatures(notes, requests)


@query("signature_status", """SELECT l_orderkey * 10 + l_linenumber AS note_id, 's' || l_suppkey AS signer, CASE WHEN l_linenumber = 4 THEN 'unsigned' WHEN s_suppkey IS NULL THEN 'unknown' WHEN l_linenumber = 5 THEN 'changed' ELSE 'ok' END AS status
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) ON s_suppkey = l_suppkey""")
def signature_status(spark, sf):
    """Signatures of line items against a registry of the suppliers that owe nothing."""
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    line = F.col("l_linenumber")
    made = m.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + line).alias("note_id"), name("l_suppkey").alias("signer"), F.when(line != 4, F.concat(F.sha2(name("l_suppkey"), 256), F.when(line == 5, "0").otherwise(""))).alias("key"))
    registry = m.table(spark, sf, "supplier").where("s_acctbal >= 0").select(name("s_suppkey").alias("signer"), F.sha2(name("s_suppkey"), 256).alias("key"))
    return lifecycle.signature_status(made, registry)


@query("seal_blockers", f"""WITH {_NOTES}, n AS (SELECT *, CASE WHEN state <> 'draft' THEN state WHEN note_id % 5 = 0 THEN 'rejected' WHEN note_id % 5 = 1 THEN 'draft' ELSE 'advisory' END AS now FROM notes)
SELECT note_id, CASE WHEN now = 'sealed' THEN 'already_sealed' WHEN trim(reviewer) = '' OR note_id % 43 = 0 THEN 'no_approver' WHEN note_id % 59 = 0 THEN 'stale_hash' WHEN now = 'rejected' THEN 'rejected' WHEN now = 'draft' THEN 'not_checked' WHEN author <> '' AND author = trim(reviewer) THEN 'self_approval' END AS blocker FROM n""")
def seal_blockers(spark, sf):
    """Why each note cannot be sealed by its reviewer; every 59th has changed since it was hashed."""
    n = F.col("note_id")
    notes = seal.content_hash(m.notes(m.table(spark, sf, "orders")), SEALED_FIELDS)
    state = F.when(F.col("state") != "draft", F.col("state")).when(n % 5 == 0, "rejected").when(n % 5 == 1, "draft").otherwise("advisory")
    notes = notes.withColumns({"state": state, "approver": F.when(n % 43 != 0, F.trim("reviewer")), "value": F.when(n % 59 == 0, F.col("value") + 1).otherwise(F.col("value"))})
    return notes.select("note_id", lifecycle.seal_blocker(fields_hash(*[F.col(f) for f in SEALED_FIELDS])).alias("blocker"))


def _key():
    return F.concat(F.lit("k"), (F.col("l_partkey") % 7).cast("string"))


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    """A metric row a line item of its order's note; returned ones have no number, and sixth lines no key."""
    line = F.col("l_linenumber")
    value = F.when(F.col("l_returnflag") == "R", "n/a").otherwise(F.format_string("%.2f", F.col("l_quantity").cast("double")))
    rows = m.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("note_id"), (F.col("l_orderkey") * 10 + line).alias("row_id"), F.when(line != 6, _key()).otherwise("").alias("metric_key"), value.alias("value"))
    return rows.join(m.notes(m.table(spark, sf, "orders")).select("note_id", "project", "state", F.col("written_on").alias("end")), "note_id")


_ACTUALS = """actuals AS (SELECT o_custkey AS project, 'k' || (l_partkey % 7) AS key, CAST(printf('%.2f', CAST(l_quantity AS DOUBLE)) AS DOUBLE) AS value, CAST(o_orderdate AS DATE) AS date,
  CAST(date_diff('month', p.start, CAST(o_orderdate AS DATE)) + 1 AS INTEGER) AS m, o_orderkey AS note_id, l_orderkey * 10 + l_linenumber AS row_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN projects AS p ON p.project = o_custkey WHERE o_orderstatus = 'F' AND l_returnflag <> 'R' AND l_linenumber <> 6)"""


@query("seal_actuals", f"WITH {_PROJECTS}, {_ACTUALS} SELECT * FROM actuals")
def seal_actuals(spark, sf):
    return lifecycle.sealed_actuals(_measured(spark, sf), _projects(spark, sf))


@query("latest_actuals", f"WITH {_PROJECTS}, {_ACTUALS} SELECT project, key, value, m FROM (SELECT *, row_number() OVER (PARTITION BY project, key ORDER BY m DESC, row_id DESC, value DESC) AS k FROM actuals) WHERE k = 1")
def latest_actuals(spark, sf):
    return lifecycle.latest_actuals(lifecycle.sealed_actuals(_measured(spark, sf), _projects(spark, sf)))


@query("narrative_entries", r"""SELECT doc_id, CASE WHEN i <= 3 THEN 'work' WHEN i <= 6 THEN 'results' WHEN i <= 8 THEN 'interpretation' ELSE 'next_plan' END AS section,
  CAST(i - CASE WHEN i <= 3 THEN 1 WHEN i <= 6 THEN 4 WHEN i <= 8 THEN 7 ELSE 9 END AS INTEGER) AS "index", l[i] AS text
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(l[i], '\S')""")
def narrative_entries(spark, sf):
    """A document's lines as a note: three of work, three of results, two of interpretation, the rest plans."""
    lines = m.table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    notes = lines.select("doc_id", F.slice("l", 1, 3).alias("work"), F.slice("l", 4, 3).alias("results"), F.slice("l", 7, 2).alias("interpretation"), F.expr("slice(l, 9, greatest(size(l), 1))").alias("next_plan"))
    return lifecycle.narrative_entries(notes, "doc_id")


@query("note_metric_rows", """SELECT l_orderkey AS note_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'k' || (l_partkey % 7), l_quantity) - 1 AS INTEGER) AS "index", 'k' || (l_partkey % 7) AS metric, CAST(l_quantity AS DOUBLE) AS value FROM lineitem WHERE l_returnflag <> 'R'""")
def note_metric_rows(spark, sf):
    """A note an order with its line items as metric rows, unnamed where returned."""
    row = F.struct("l_linenumber", F.when(F.col("l_returnflag") != "R", _key()).alias("metric"), F.col("l_quantity").cast("double").alias("value"))
    notes = m.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("note_id")).agg(F.array_sort(F.collect_list(row)).alias("metrics"))
    return lifecycle.note_metric_rows(notes).drop("l_linenumber")


@query("revision_links", f"""WITH {_NOTES}, r AS (SELECT *, CASE WHEN note_id % 6 = 0 THEN note_id - 1 END AS supersedes FROM notes) SELECT a.project, a.note_id, a.supersedes, coalesce(b.state, 'missing') AS original FROM r AS a LEFT JOIN r AS b ON b.note_id = a.supersedes AND b.project = a.project WHERE a.supersedes IS NOT NULL""")
def revision_links(spark, sf):
    notes = m.notes(m.table(spark, sf, "orders"))
    return lifecycle.revision_links(notes.withColumn("supersedes", F.when(F.col("note_id") % 6 == 0, F.col("note_id") - 1)))


@query("change_rollback", f"""WITH {_NOTES}, n AS (SELECT note_id, CAST(trim(author) = '' AS BIGINT) AS a, CAST(trim(author) <> '' AND trim(author) = trim(reviewer) AS BIGINT) AS s, CAST(note_id % 3 = 0 AS BIGINT) AS g FROM notes),
c AS (SELECT note_id, a + s AS before, CASE WHEN g = 1 THEN a + 1 ELSE a + s END AS after FROM n) SELECT CAST(note_id AS VARCHAR) AS location, before, after, after <= before AS kept FROM c WHERE before + after > 0""")
def change_rollback(spark, sf):
    """Notes before and after a change that takes away the reviewer of every third: kept unless violations grew."""
    notes = m.notes(m.table(spark, sf, "orders"))
    after = notes.withColumn("reviewer", F.when(F.col("note_id") % 3 == 0, "").otherwise(F.col("reviewer")))
    return lifecycle.keep_if_no_worse(gates.g4_required(notes), gates.g4_required(after))


@query("metric_keys", r"""WITH RECURSIVE s AS (SELECT p_brand AS project, p_partkey AS pos, name, coalesce(nullif(left(trim(regexp_replace(lower(name), '[^a-z0-9가-힣]+', '_', 'g'), '_'), 40), ''), 'kpi') AS slug
  FROM (SELECT *, CASE WHEN p_size > 25 THEN p_name ELSE p_name || ' ' || (p_size % 4) END AS name FROM part)),
n AS (SELECT *, regexp_replace(slug, '(_\d+)+$', '') AS stem, row_number() OVER (PARTITION BY project, regexp_replace(slug, '(_\d+)+$', '') ORDER BY pos) AS i FROM s),
r(project, stem, i, pos, name, key, seen) AS (
  SELECT project, stem, i, pos, name, slug, [slug] FROM n WHERE i = 1
  UNION ALL SELECT project, stem, i, pos, name, key, list_append(seen, key) FROM (
    SELECT n.project, n.stem, n.i, n.pos, n.name, seen, list_filter([slug] || list_transform(range(2, len(seen) + 3), lambda k: slug || '_' || k), lambda k: NOT list_contains(seen, k))[1] AS key
    FROM r JOIN n ON n.project = r.project AND n.stem = r.stem AND n.i = r.i + 1))
SELECT project, pos, name, key FROM r""")
def metric_keys(spark, sf):
    """Keys of the parts of each brand, some of whose names end in a number."""
    name = F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", F.col("p_size") % 4))
    names = m.table(spark, sf, "part").select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("pos"), name.alias("name"))
    return lifecycle.metric_keys(names, tx.slug(F.col("name")), ["project"])


_MILESTONES = """milestones AS (SELECT project, k AS pos, CAST(k * 7 AS INTEGER) AS month, 'stage ' || k AS name, CAST(start + to_months(CAST(k * 7 AS INTEGER)) AS DATE) AS date FROM (SELECT project, start, unnest(range(1, 10)) AS k FROM projects))"""
_BLOCKS = """blocks AS (SELECT project, n + 1 AS month, CAST(start + to_months(n) AS DATE) AS b0, least(CAST(start + to_months(n + 1) AS DATE) - 1, "end") AS b1
  FROM (SELECT project, start, "end", unnest(range(0, 120))::INTEGER AS n FROM projects) WHERE CAST(start + to_months(n) AS DATE) <= "end")"""


def _milestones(projects: DataFrame) -> DataFrame:
    """A milestone every seven months of a project."""
    k = projects.select("project", "start", F.explode(F.expr("sequence(1, 9)")).alias("pos"))
    return k.select("project", "pos", (F.col("pos") * 7).alias("month"), F.concat(F.lit("stage "), F.col("pos").cast("string")).alias("name"), F.add_months("start", F.col("pos") * 7).alias("date"))


@query("month_detail", f"""WITH {_PROJECTS}, {_SPRINTS}, {_NOTES}, {_MILESTONES}, {_BLOCKS} SELECT project, CAST(month AS INTEGER) AS month,
  (SELECT count(*) FROM sprints AS s WHERE s.project = b.project AND s."end" >= b0 AND s.start <= b1) AS sprints, (SELECT count(*) FROM notes AS n WHERE n.project = b.project AND n.start BETWEEN b0 AND b1) AS notes,
  (SELECT count(*) FROM notes AS n WHERE n.project = b.project AND n.start BETWEEN b0 AND b1 AND state = 'sealed') AS sealed, (SELECT count(*) FROM milestones AS x WHERE x.project = b.project AND x.month = b.month) AS milestones FROM blocks AS b""")
def month_detail(spark, sf):
    projects = _projects(spark, sf)
    return views.month_detail(projects, m.notes(m.table(spark, sf, "orders")), _milestones(projects))


@query("upcoming_milestones", f"WITH {_PROJECTS}, {_MILESTONES} SELECT project, CAST(k AS INTEGER) AS nth, name, date FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY pos) AS k FROM milestones WHERE date >= DATE '{TODAY}') WHERE k <= 4")
def upcoming_milestones(spark, sf):
    return views.upcoming_milestones(_milestones(_projects(spark, sf)), TODAY)


@query("package_progress", f"""WITH {_PROJECTS}, {_SPRINTS}, {_PACKAGES}, {_HELD}, per AS (SELECT project, seq, count(*) AS n, count(*) FILTER (state = 'sealed') AS k FROM held GROUP BY ALL)
SELECT s.project, 'WP' || num AS package, count(*) AS sprints, count(*) FILTER (k > 0) AS sealed_sprints, CAST(coalesce(sum(n), 0) AS BIGINT) AS notes
FROM sprints AS s JOIN packages AS p ON p.project = s.project AND p."end" >= s.start AND p.start <= s."end" LEFT JOIN per ON per.project = s.project AND per.seq = s.seq GROUP BY ALL""")
def package_progress(spark, sf):
    projects = _projects(spark, sf)
    return views.package_progress(planner.package_spans(projects, _packages(projects)), _slot_notes(spark, sf))


@query("ledger_newest", f"WITH {_LEDGER} SELECT id, day, content FROM ledger ORDER BY day DESC, CAST(substr(id, 2) AS BIGINT) DESC LIMIT 300")
def ledger_newest(spark, sf):
    """The pick list of the 300 newest entries."""
    ledger = m.ledger(m.table(spark, sf, "events")).withColumn("number", F.substring("id", 2, 20).cast("long"))
    return views.newest_evidence(ledger, ["day", "number"]).select("id", "day", "content")


@query("dashboard", f"""WITH {_PROJECTS}, {_NOTES}, {_LEDGER}, {_ACTUALS} SELECT 'notes' AS measure, count(*) AS value FROM notes UNION ALL SELECT 'notes_' || state, count(*) FROM notes GROUP BY state
UNION ALL SELECT 'measured_keys', count(DISTINCT key) FROM actuals UNION ALL SELECT 'evidence_' || kind, count(*) FROM ledger GROUP BY kind""")
def dashboard(spark, sf):
    actuals = lifecycle.sealed_actuals(_measured(spark, sf), _projects(spark, sf))
    return views.dashboard(m.notes(m.table(spark, sf, "orders")), actuals, m.ledger(m.table(spark, sf, "events")))


_DOMAINS = " ".join(f"WHEN h[{k}] = top AND top >= 2 THEN '{name}'" for k, (name, _) in enumerate(extract.DOMAINS, 1))
_HITS = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}'))" for _, p in extract.DOMAINS)


@query("guess_domain", f"SELECT doc_id, CASE {_DOMAINS} ELSE 'general' END AS domain, top AS hits FROM (SELECT doc_id, h, CAST(list_max(h) AS BIGINT) AS top FROM (SELECT doc_id, [{_HITS}] AS h FROM documents))")
def guess_domain(spark, sf):
    return extract.guess_domain(m.table(spark, sf, "documents"))


@query("months_only", """WITH l AS (SELECT c_custkey, c_custkey % 130 AS n FROM customer) SELECT c_custkey AS doc_id, CAST(n AS INTEGER) AS months FROM l WHERE c_custkey % 3 <> 0 AND n BETWEEN 1 AND 120""")
def months_only(spark, sf):
    """Plans that state a length in months; every third has dates as well, which come first."""
    k = F.col("c_custkey")
    lines = F.array(F.concat(F.lit("총 연구기간 : "), (k % 130).cast("string"), F.lit(" 개월")), F.when(k % 3 == 0, "연구기간: 2024.01 ~ 2025.12").otherwise("연구기간 12년"))
    return extract.months_only(m.table(spark, sf, "customer").select(k.alias("doc_id"), F.posexplode(lines).alias("li", "line")))


@query("extract_package_ways", """SELECT c_custkey AS doc_id, CAST(num AS INTEGER) AS num, name || ' ' || c_custkey AS name FROM customer JOIN (VALUES (0, 1, '표 설계'), (0, 3, '본문 시험'), (1, 1, '세부 설계'), (1, 2, '세부 제작'), (2, 1, '목록 설계'), (2, 2, '목록 제작'), (2, 3, '목록 시험')) AS v(way, num, name) ON way = c_custkey % 4""")
def extract_package_ways(spark, sf):
    """Plans that name their packages in a table, as sub-tasks, in a numbered list, or nowhere."""
    k, c = F.col("c_custkey"), m.table(spark, sf, "customer")
    line = lambda *texts: F.array(*[F.concat(F.lit(t), F.lit(" "), F.col("c_custkey").cast("string")) for t in texts])
    texts = (
        F.when(k % 4 == 0, line("WP-3: 본문 시험", "제1세부과제: 뒤에 온다", "WP41: 너무 큰 번호"))
        .when(k % 4 == 1, line("제1세부과제: 세부 설계", "2세부: 세부 제작", "제1세부: 두 번째", "연구내용", "1. 목록은 뒤에 온다"))
        .when(k % 4 == 2, line("1. 앞에 온다", "주요 연구 내용", "1. 목록 설계", "3. 건너뛴 번호", "2) 목록 제작", "- 3. 목록 시험", "목록이 끝난다", "4. 목록 밖"))
        .otherwise(line("없음", "4. 번호만 있다"))
    )
    lines = c.select(k.alias("doc_id"), F.posexplode(texts).alias("li", "line"))
    cells = c.where("c_custkey % 4 = 0").select(k.alias("doc_id"), F.lit(0).alias("t"), F.posexplode(F.array(line("비고", "워크패키지", "내용"), line("-", "WP 1 /", "표 설계"))).alias("r", "row"))
    return extract.work_packages(lines, cells.select("doc_id", "t", "r", F.posexplode("row").alias("c", "v")))


@query("resolve_period", """SELECT o_orderkey AS project, CASE WHEN o_orderkey % 3 = 2 THEN DATE '1998-07-01' ELSE CAST(o_orderdate AS DATE) END AS start,
  CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) + 99 WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_custkey % 100 + 1 AS INTEGER)) AS DATE) - 1 ELSE CAST(DATE '1998-07-01' + to_months(CAST(o_custkey % 100 + 1 AS INTEGER)) AS DATE) - 1 END AS "end",
  CASE o_orderkey % 3 WHEN 0 THEN 'extracted' WHEN 1 THEN 'months' ELSE 'default' END AS source FROM orders""")
def resolve_period(spark, sf):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    plans = m.table(spark, sf, "orders").select(k.alias("project"), F.when(k % 3 != 2, day).alias("start"), F.when(k % 3 == 0, F.date_add(day, 99)).alias("end"), (F.col("o_custkey") % 100 + 1).cast("int").alias("months"))
    return planner.resolve_period(plans, TODAY)


@query("polish_acceptance", r"""SELECT doc_id, li, len(after) >= 5 AND li % 3 <> 0 AND li % 5 <> 0 AS accepted FROM (SELECT doc_id, CAST(i - 1 AS INTEGER) AS li, 'x' || (i - 1) || repeat('y', CAST((i - 1) % 6 AS INTEGER)) AS after FROM (SELECT doc_id, unnest(range(1, 21)) AS i FROM documents))""")
def polish_acceptance(spark, sf):
    """Rewritten texts: every third loses its citation, every fifth uncertain, some too short."""
    li = F.col("li")
    rows = m.table(spark, sf, "documents").select("doc_id", F.explode(F.expr("sequence(0, 19)")).alias("li"))
    body = F.concat(F.lit("x"), li.cast("string"), F.expr("repeat('y', li % 6)"))
    cite, soft = F.when(li % 3 == 0, " [E2]").otherwise(""), F.when(li % 5 == 0, " 약 30%").otherwise("")
    pairs = rows.select("doc_id", "li", F.lit("x").alias("before"), F.concat(body, soft, cite).alias("after"))
    return draft.accept_polish(pairs).select("doc_id", "li", "accepted")
