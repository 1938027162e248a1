"""Registered queries: each operator over whole tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions import dates, numbers
from fieldbook.functions import text as tx
from fieldbook.functions.hashing import canonical_json, fields_hash
from fieldbook.operators import draft, extract, gates, planner, seal, views
from fieldbook.operators.joins import broadcast_if_small
from fieldbook.plans import mapping as m
from fieldbook.sources import export, parse
from fieldbook.streaming import sprints

START, STEP, TODAY = "1995-01-01", 14, "1998-06-15"
EVENT_START = "2024-01-01"
SEALED_FIELDS = ["note_id", "start", "end", "value", "priority"]

# --- SQL twins of the mapping layer -------------------------------------------------------------

_NARRATIVE = """narrative AS (
  SELECT event_id, CAST(ts AS DATE) AS day, event_type, value,
    CASE WHEN event_id % 29 = 0 THEN '해당 기간 관련 증거 없음.' ELSE
      CASE WHEN event_id % 17 = 0 THEN 'It appears to be ' WHEN event_id % 23 = 0 THEN 'おそらく ' ELSE '' END
      || CAST(CAST(ts AS DATE) AS VARCHAR) || ' — ' || event_type || ' measured ' || printf('%.2f', value) || '%'
      || CASE WHEN event_id % 19 = 0 THEN ' 약 30%' ELSE '' END
      || CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN ' [E' || (event_id - event_id % 97) || ']' ELSE ' [E' || event_id || ']' END || '.' END AS text
  FROM events)"""
_LEDGER = """ledger AS (
  SELECT 'E' || event_id AS id, 'measurement' AS kind, CAST(ts AS DATE) AS day, event_type || ' ' || printf('%.2f', value) AS content, value
  FROM events WHERE event_id % 97 <> 0)"""
_ROWS = """metric_rows AS (
  SELECT event_id AS row_id, CAST(ts AS DATE) AS day, event_type AS metric_key,
    CASE WHEN event_id % 31 = 0 THEN 'n/a' WHEN event_id % 37 = 0 THEN '' ELSE printf('%.2f', value) END AS value,
    CASE WHEN event_id % 2 = 0 THEN '%' ELSE '건' END AS unit,
    CASE WHEN event_id % 7 = 0 THEN 'target met' WHEN event_id % 41 = 0 THEN 'not achieved' ELSE '' END AS achieved,
    CASE WHEN event_id % 43 = 0 THEN NULL ELSE 'E' || event_id END AS evidence
  FROM events)"""
_CATALOG = """catalog AS (
  SELECT * FROM (VALUES (0, 'click', '%', 60.0::DOUBLE, 'higher', true), (1, 'view', '건', NULL, 'higher', false), (2, 'purchase', '%', 25.0, 'lower', false),
    (3, 'signup', '%', 80.0, 'higher', true), (4, 'login', '건', 100.0, 'lower', false)) AS v(pos, key, unit, target, direction, monotonic))"""
_NOTES = """notes AS (
  SELECT o_orderkey AS note_id, o_custkey AS project, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 14) AS INTEGER) + 1 AS sprint,
    DATE '1995-01-01' + 14 * CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 14) AS INTEGER) AS start,
    DATE '1995-01-01' + 14 * CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 14) AS INTEGER) + 13 AS "end",
    CASE o_orderstatus WHEN 'F' THEN 'sealed' WHEN 'O' THEN 'draft' ELSE 'awaiting_sign' END AS state,
    CASE WHEN o_orderkey % 47 = 0 THEN '' ELSE 'u' || (o_custkey % 50) END AS author,
    CASE WHEN o_orderkey % 53 = 0 THEN ' u' || (o_custkey % 50) || ' ' ELSE 'r' || (o_orderkey % 20) END AS reviewer,
    CAST(o_orderdate AS DATE) AS written_on, round(o_totalprice, 2) AS value, o_orderpriority AS priority FROM orders)"""
_SENTENCES = r"""sent AS (
  SELECT event_id, trim(s) AS s FROM (
    SELECT event_id, unnest(string_split_regex(regexp_replace(text, '([.!?])([\s"'')\]])', '\1' || chr(30) || '\2', 'g'), '[' || chr(30) || '\n]')) AS s FROM narrative)
  WHERE trim(s) <> ''),
cite AS (
  SELECT event_id, s, list_distinct(list_transform(regexp_extract_all(s, '\[E(\d{1,5})\]', 1), lambda x: 'E' || CAST(x AS INTEGER))) AS c,
    regexp_matches(s, '해당\s*기간\s*(관련\s*)?증거(\s*자료)?\s*없음') AS exempt FROM sent)"""


def _rule_sql(column: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}') THEN {k}" for k, (_, _, p) in enumerate(tx.FORBIDDEN))
    return f"CASE {cases} END"


_G1 = """v1 AS (
  SELECT event_id AS location, 'G1' AS gate, 'unmapped' AS "check", 'high' AS severity FROM cite WHERE len(c) = 0 AND NOT exempt
  UNION ALL SELECT event_id, 'G1', 'ghost', 'high' FROM (SELECT event_id, unnest(c) AS id FROM cite) AS x WHERE id NOT IN (SELECT id FROM ledger)
  UNION ALL SELECT event_id, 'G1', 'forbidden', 'normal' FROM cite WHERE len(c) > 0 AND (__RULE__) IS NOT NULL
  UNION ALL SELECT row_id, 'G1', 'no_evidence', 'high' FROM metric_rows WHERE evidence IS NULL
  UNION ALL SELECT row_id, 'G1', 'ghost', 'high' FROM metric_rows WHERE evidence NOT IN (SELECT id FROM ledger))""".replace("__RULE__", _rule_sql("s"))
_G3 = r"""w AS (
  SELECT r.*, c.unit AS cat_unit, target, direction, CASE WHEN regexp_matches(trim(r.value), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN CAST(trim(r.value) AS DOUBLE) END AS v
  FROM metric_rows AS r LEFT JOIN catalog AS c ON c.key = r.metric_key),
v3 AS (
  SELECT row_id AS location, 'G3' AS gate, 'value_form' AS "check", 'high' AS severity FROM w WHERE v IS NULL
  UNION ALL SELECT row_id, 'G3', 'range', 'high' FROM w WHERE unit = '%' AND NOT v BETWEEN 0 AND 100
  UNION ALL SELECT row_id, 'G3', 'count_form', 'normal' FROM w WHERE regexp_matches(unit, '^[건회명개편차번]$') AND (v < 0 OR v <> floor(v))
  UNION ALL SELECT row_id, 'G3', 'unit_mismatch', 'normal' FROM w WHERE v IS NOT NULL AND unit <> '' AND cat_unit <> '' AND unit <> cat_unit
  UNION ALL SELECT row_id, 'G3', 'false_achieved', 'high' FROM w WHERE regexp_matches(achieved, '__ACHIEVED__') AND NOT regexp_matches(achieved, '__NOT__') AND CASE WHEN direction = 'lower' THEN v > target ELSE v < target END)""".replace("__ACHIEVED__", tx.ACHIEVED).replace("__NOT__", tx.NOT_ACHIEVED)


def _inputs(spark: SparkSession, sf: str):
    events = m.table(spark, sf, "events")
    return m.narrative(events), m.ledger(events), m.metric_rows(events)


def _metric_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows by sprint: even events are sealed; the value is rounded to tens so that equal ones occur."""
    e = m.table(spark, sf, "events")
    day = F.datediff(F.to_date("ts"), F.lit(EVENT_START).cast("date"))
    end = F.date_add(F.lit(EVENT_START).cast("date"), (F.floor(day / 3) * 3 + 2).cast("int"))
    cat = m.catalog(spark).select("key", "direction", "monotonic")
    rows = e.select(F.col("event_id").alias("note_id"), F.concat("event_type", F.lit("-"), (F.col("user_id") % 5).cast("string")).alias("key"), F.col("event_type").alias("k2"), end.alias("end"), (F.floor(F.col("value") / 10) * 10).cast("double").alias("value"), F.when(F.col("event_id") % 2 == 0, "sealed").otherwise("draft").alias("state"))
    rows = rows.withColumns({"start": F.date_sub("end", 2), "change_reason": F.when(F.col("note_id") % 3 == 0, "recalibrated").when(F.col("note_id") % 3 == 1, "")})
    return rows.join(broadcast_if_small(cat.withColumnRenamed("key", "k2")), "k2").drop("k2")


_METRIC_NOTES = """mn AS (
  SELECT event_id AS note_id, event_type || '-' || (user_id % 5) AS key, DATE '2024-01-01' + CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 3) * 3 + 2 AS INTEGER) AS "end",
    CAST(floor(e.value / 10) * 10 AS DOUBLE) AS value, CASE WHEN event_id % 3 = 0 THEN 'recalibrated' WHEN event_id % 3 = 1 THEN '' END AS change_reason, CASE WHEN event_id % 2 = 0 THEN 'sealed' ELSE 'draft' END AS state, direction, monotonic
  FROM events AS e JOIN catalog AS c ON c.key = e.event_type)"""


def _projects(spark: SparkSession, sf: str) -> DataFrame:
    o = m.table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("project")).agg(F.min(F.to_date("o_orderdate")).alias("start"), F.max(F.to_date("o_orderdate")).alias("end"))


_PROJECTS = "projects AS (SELECT o_custkey AS project, min(CAST(o_orderdate AS DATE)) AS start, max(CAST(o_orderdate AS DATE)) AS \"end\" FROM orders GROUP BY 1)"
_SPRINTS = 'sprints AS (SELECT project, CAST((d - start) / 14 AS INTEGER) + 1 AS seq, d AS start, least(d + 13, "end") AS "end" FROM (SELECT project, start, "end", start + 14 * unnest(range(0, CAST(floor(("end" - start) / 14) AS BIGINT) + 1))::INTEGER AS d FROM projects))'


def _packages(projects: DataFrame) -> DataFrame:
    """Three work packages a project: thirds of its days, each reaching a sprint into the next."""
    n = projects.select("project", "start", "end", F.explode(F.expr("sequence(1, 3)")).alias("num"))
    third = F.floor(F.datediff("end", "start") / 3).cast("int")
    begin = F.date_add("start", third * (F.col("num") - 1))
    return n.select("project", "num", begin.alias("start"), F.least(F.date_add(begin, third + STEP), F.col("end")).alias("end"))


_PACKAGES = 'packages AS (SELECT project, num, start + third * (num - 1) AS start, least(start + third * (num - 1) + third + 14, "end") AS "end" FROM (SELECT project, start, "end", CAST(floor(("end" - start) / 3) AS INTEGER) AS third, unnest([1, 2, 3]) AS num FROM projects))'

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("gate_g1_violations", f'WITH {_NARRATIVE}, {_LEDGER}, {_ROWS}, {_SENTENCES}, {_G1} SELECT CAST(location AS VARCHAR) AS location, gate, "check", severity FROM v1')
def gate_g1_violations(spark, sf):
    entries, ledger, rows = _inputs(spark, sf)
    return gates.g1_evidence(entries, ledger, rows)


@query("gate_summary", f'WITH {_NARRATIVE}, {_LEDGER}, {_ROWS}, {_CATALOG}, {_SENTENCES}, {_G1}, {_G3} SELECT gate, "check", severity, count(*) AS violations, count(DISTINCT location) AS locations FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v3) GROUP BY ALL')
def gate_summary(spark, sf):
    entries, ledger, rows = _inputs(spark, sf)
    return gates.per_gate(gates.g1_evidence(entries, ledger, rows).unionByName(gates.g3_numeric(rows, m.catalog(spark))))


@query("gate_decision", f"WITH {_NARRATIVE}, {_LEDGER}, {_ROWS}, {_CATALOG}, {_SENTENCES}, {_G1}, {_G3} SELECT CAST(location AS VARCHAR) AS location, count(*) AS violations, count(*) FILTER (severity = 'high') AS high, CASE WHEN location % 2 = 1 THEN 'rejected' ELSE 'advisory' END AS decision FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v3) GROUP BY location")
def gate_decision(spark, sf):
    """Decisions where every second note is checked strictly."""
    entries, ledger, rows = _inputs(spark, sf)
    mode = F.when(F.col("location").cast("long") % 2 == 1, "strict").otherwise("advisory")
    return gates.decide(gates.g1_evidence(entries, ledger, rows).unionByName(gates.g3_numeric(rows, m.catalog(spark))), mode=mode)


@query("gate_g3_numeric", f'WITH {_ROWS}, {_CATALOG}, {_G3} SELECT CAST(location AS VARCHAR) AS location, gate, "check", severity FROM v3')
def gate_g3_numeric(spark, sf):
    return gates.g3_numeric(_inputs(spark, sf)[2], m.catalog(spark))


@query("gate_g3_percentages", rf"""WITH {_NARRATIVE} SELECT CAST(event_id AS VARCHAR) AS location, 'G3' AS gate, 'odd_percentage' AS "check", 'normal' AS severity FROM narrative WHERE TRY_CAST(regexp_extract(text, '(\d{{3,}})(\.\d+)?%', 1) AS BIGINT) > 200""")
def gate_g3_percentages(spark, sf):
    return gates.g3_percentages(_inputs(spark, sf)[0])


@query("gate_g2_overlap", f"""WITH {_NOTES} SELECT CAST(a.note_id AS VARCHAR) AS location, 'G2' AS gate, 'overlap' AS "check", 'high' AS severity FROM notes AS a JOIN notes AS b ON a.project = b.project AND b.state = 'sealed' AND a.note_id <> b.note_id AND a."end" >= b.start AND a.start <= b."end" """)
def gate_g2_overlap(spark, sf):
    return gates.g2_overlap(m.notes(m.table(spark, sf, "orders")))


@query("gate_g2_contradiction", f"""WITH {_CATALOG}, {_METRIC_NOTES} SELECT CAST(note_id AS VARCHAR) AS location, 'G2' AS gate, 'contradiction' AS "check", 'high' AS severity FROM mn AS a WHERE EXISTS (SELECT 1 FROM mn AS b WHERE b.state = 'sealed' AND b.key = a.key AND b."end" = a."end" AND b.value <> a.value)""")
def gate_g2_contradiction(spark, sf):
    return gates.g2_contradiction(_metric_notes(spark, sf))


@query("gate_g2_regression", f"""WITH {_CATALOG}, {_METRIC_NOTES} SELECT CAST(note_id AS VARCHAR) AS location, 'G2' AS gate, 'regression' AS "check", 'normal' AS severity FROM mn AS a WHERE monotonic AND coalesce(change_reason, '') = '' AND EXISTS (SELECT 1 FROM mn AS b WHERE b.state = 'sealed' AND b.key = a.key AND b."end" < a."end" - 2 AND CASE WHEN a.direction = 'lower' THEN a.value > b.value ELSE a.value < b.value END)""")
def gate_g2_regression(spark, sf):
    return gates.g2_regression(_metric_notes(spark, sf))


_REVISED = """revised AS (SELECT *, CASE WHEN note_id % 6 = 0 THEN note_id - 1 END AS supersedes FROM notes)"""


@query("gate_g2_revisions", f"""WITH {_NOTES}, {_REVISED} SELECT CAST(a.note_id AS VARCHAR) AS location, 'G2' AS gate, 'overlap' AS "check", 'high' AS severity FROM revised AS a JOIN revised AS b ON a.project = b.project AND b.state = 'sealed' AND a.note_id <> b.note_id AND a."end" >= b.start AND a.start <= b."end" AND a.supersedes IS DISTINCT FROM b.note_id AND b.supersedes IS DISTINCT FROM a.note_id""")
def gate_g2_revisions(spark, sf):
    """Overlaps where every sixth note revises the one before: a revision and its original do not count."""
    notes = m.notes(m.table(spark, sf, "orders"))
    return gates.g2_overlap(notes.withColumn("supersedes", F.when(F.col("note_id") % 6 == 0, F.col("note_id") - 1)))


@query("gate_g2_duplicate", f"""WITH {_NOTES}, d AS (SELECT note_id AS row_id, project || ' RN-' || strftime(start, '%Y%m%d') || '-' || strftime("end", '%Y%m%d') AS id, state FROM notes) SELECT CAST(a.row_id AS VARCHAR) AS location, 'G2' AS gate, 'duplicate_id' AS "check", 'high' AS severity FROM d AS a WHERE EXISTS (SELECT 1 FROM d AS b WHERE b.state = 'sealed' AND b.id = a.id AND b.row_id <> a.row_id)""")
def gate_g2_duplicate(spark, sf):
    notes = m.notes(m.table(spark, sf, "orders"))
    name = F.concat(F.col("project").cast("string"), F.lit(" "), seal.note_id(F.col("start"), F.col("end"), F.lit(0)))
    return gates.g2_duplicate(notes.select(F.col("note_id").alias("row_id"), name.alias("note_id"), "state"))


@query("gate_g4_fields", f"""WITH {_NOTES} SELECT CAST(note_id AS VARCHAR) AS location, 'G4' AS gate, c AS "check", 'high' AS severity FROM (SELECT note_id, unnest([CASE WHEN note_id % 61 = 0 THEN 'project_code' END, CASE WHEN note_id % 67 = 0 THEN 'title' END, CASE WHEN trim(author) = '' THEN 'author' END, CASE WHEN trim(reviewer) = '' THEN 'reviewer' END, CASE WHEN note_id % 71 = 0 THEN 'written_on' END, CASE WHEN "end" < start OR note_id % 73 = 0 THEN 'period' END, CASE WHEN trim(author) <> '' AND trim(author) = trim(reviewer) THEN 'self_review' END]) AS c FROM notes) WHERE c IS NOT NULL""")
def gate_g4_fields(spark, sf):
    """All required fields of the header, each missing for some notes."""
    n, gone = F.col("note_id"), F.lit(None)
    notes = m.notes(m.table(spark, sf, "orders")).withColumns(
        {
            "project_code": F.when(n % 61 == 0, "  ").otherwise(F.col("project").cast("string")),
            "title": F.when(n % 67 == 0, gone).otherwise("a project"),
            "written_on": F.when(n % 71 == 0, gone).otherwise(F.col("written_on")),
            "end": F.when(n % 73 == 0, gone).otherwise(F.col("end")),
        }
    )
    return gates.g4_required(notes)


@query("gate_g4_history", f"""WITH {_NOTES} SELECT CAST(note_id AS VARCHAR) AS location, 'G4' AS gate, 'history' AS "check", 'high' AS severity FROM notes WHERE note_id % 79 = 0""")
def gate_g4_history(spark, sf):
    notes = m.notes(m.table(spark, sf, "orders"))
    return gates.g4_history(notes.withColumn("history", F.when(F.col("note_id") % 79 != 0, F.array().cast("array<string>"))))


@query("gate_g4_hash", f"""WITH {_NOTES} SELECT CAST(note_id AS VARCHAR) AS location, 'G4' AS gate, 'content_hash' AS "check", 'high' AS severity FROM notes WHERE note_id % 59 = 0 OR note_id % 83 = 0""")
def gate_g4_hash(spark, sf):
    """Notes hashed when written; some changed afterwards, some lost their hash."""
    n = F.col("note_id")
    notes = seal.content_hash(m.notes(m.table(spark, sf, "orders")), SEALED_FIELDS)
    notes = notes.withColumns({"value": F.when(n % 59 == 0, F.col("value") + 1).otherwise(F.col("value")), "content_sha256": F.when(n % 83 != 0, F.col("content_sha256"))})
    return gates.g4_hash(notes, fields_hash(*[F.col(f) for f in SEALED_FIELDS]))


@query("gate_run", f"WITH {_NARRATIVE}, {_LEDGER}, {_ROWS}, {_CATALOG}, {_SENTENCES}, {_G1}, {_G3}, v AS (SELECT location, severity FROM v1 UNION ALL SELECT location, severity FROM v3) SELECT CAST(e.event_id AS VARCHAR) AS location, count(v.location) AS violations, count(*) FILTER (v.severity = 'high') AS high, CASE WHEN count(v.location) > 0 THEN 'advisory' ELSE 'pass' END AS decision FROM events AS e LEFT JOIN v ON v.location = e.event_id GROUP BY e.event_id")
def gate_run(spark, sf):
    """The decision for every note, those that pass too."""
    entries, ledger, rows = _inputs(spark, sf)
    found = gates.g1_evidence(entries, ledger, rows).unionByName(gates.g3_numeric(rows, m.catalog(spark)))
    return gates.decide(found, entries.select(F.col("event_id").alias("location")))


@query("gate_g4_required", f"""WITH {_NOTES} SELECT CAST(note_id AS VARCHAR) AS location, 'G4' AS gate, c AS "check", 'high' AS severity FROM (SELECT note_id, unnest([CASE WHEN trim(author) = '' THEN 'author' END, CASE WHEN trim(reviewer) = '' THEN 'reviewer' END, CASE WHEN written_on IS NULL THEN 'written_on' END, CASE WHEN "end" < start THEN 'period' END, CASE WHEN trim(author) <> '' AND trim(author) = trim(reviewer) THEN 'self_review' END]) AS c FROM notes) WHERE c IS NOT NULL""")
def gate_g4_required(spark, sf):
    return gates.g4_required(m.notes(m.table(spark, sf, "orders")))


_FILES = "files AS (SELECT doc_id, source || '-' || doc_id || '.txt' AS name, sha256(coalesce(text, '')) AS actual, CASE WHEN doc_id % 23 = 0 THEN upper(sha256(coalesce(text, ''))) WHEN doc_id % 29 = 0 THEN left(sha256(coalesce(text, '')), 40) ELSE sha256(coalesce(text, '')) END AS sha256 FROM documents)"


@query("gate_g4_attachments", f"""WITH {_FILES} SELECT CAST(doc_id AS VARCHAR) AS location, 'G4' AS gate, 'attachment_hash' AS "check", 'high' AS severity FROM files WHERE NOT regexp_full_match(sha256, '[0-9a-f]{{64}}')""")
def gate_g4_attachments(spark, sf):
    return gates.g4_attachments(m.attachments(m.table(spark, sf, "documents")))


@query("gate_g4_missing", f"""WITH {_LEDGER}, {_FILES} SELECT id AS location, 'G4' AS gate, 'attachment_missing' AS "check", 'normal' AS severity FROM ledger WHERE CAST(substr(id, 2) AS BIGINT) % 5 <> 0 AND 'src' || (CAST(substr(id, 2) AS BIGINT) % 20) || '-' || substr(id, 2) || '.txt' NOT IN (SELECT name FROM files)""")
def gate_g4_missing(spark, sf):
    number = F.substring("id", 2, 20).cast("long")
    ledger = _inputs(spark, sf)[1].withColumns({"source_file": F.concat(F.lit("src"), (number % 20).cast("string"), F.lit("-"), number.cast("string"), F.lit(".txt")), "kind": F.when(number % 5 == 0, "researcher_statement").otherwise("measurement")})
    return gates.missing_attachments(ledger, m.attachments(m.table(spark, sf, "documents")))


@query("manifest_verify", f"WITH {_FILES} SELECT name, CASE WHEN sha256 = actual THEN 'ok' WHEN doc_id % 31 = 0 THEN 'missing' ELSE 'changed' END AS status FROM files WHERE doc_id % 31 <> 0 UNION ALL SELECT name, 'missing' FROM files WHERE doc_id % 31 = 0")
def manifest_verify(spark, sf):
    files = m.attachments(m.table(spark, sf, "documents"))
    return seal.verify_manifest(files.select("name", "sha256"), files.where("doc_id % 31 <> 0").select("name", "actual"))


@query("defect_signatures", rf"WITH {_NARRATIVE} SELECT regexp_replace(text, '\d+', '#', 'g') AS signature, count(*) AS times, min(text) AS example FROM narrative GROUP BY 1")
def defect_signatures(spark, sf):
    return gates.defect_signatures(_inputs(spark, sf)[0])


@query("sentence_split", f"WITH {_NARRATIVE}, {_SENTENCES} SELECT event_id, s AS sentence FROM sent")
def sentence_split(spark, sf):
    return gates.sentences(_inputs(spark, sf)[0]).select("event_id", "sentence")


@query("citation_extract", f"WITH {_NARRATIVE}, {_SENTENCES} SELECT event_id, array_to_string(c, ',') AS cites, exempt FROM cite")
def citation_extract(spark, sf):
    return gates.sentences(_inputs(spark, sf)[0]).select("event_id", F.array_join("cites", ",").alias("cites"), "exempt")


@query("forbidden_wording", f"WITH {_NARRATIVE} SELECT event_id, CAST(r AS INTEGER) AS rule FROM (SELECT event_id, {_rule_sql('text')} AS r FROM narrative) WHERE r IS NOT NULL")
def forbidden_wording(spark, sf):
    entries = _inputs(spark, sf)[0]
    # as a generator, the composed text is made once and not copied into every rule
    once = entries.select("event_id", F.explode(F.array("text")).alias("text"))
    return once.select("event_id", F.explode(F.array(tx.forbidden_rule(F.col("text")).cast("int"))).alias("rule")).where("rule is not null")


@query("lines_view", r"SELECT doc_id, CAST(i - 1 AS INTEGER) AS li, line FROM (SELECT doc_id, i, trim(regexp_replace(l[i], '[\s\x{00A0}\x{3000}]+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)) WHERE line <> ''")
def lines_view(spark, sf):
    return draft.lines_view(m.table(spark, sf, "documents").select("doc_id", "text"))


_LINES = r"lines AS (SELECT doc_id, i - 1 AS li, line FROM (SELECT doc_id, i, trim(regexp_replace(l[i], '[\s\x{00A0}\x{3000}]+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)) WHERE line <> '')"
_CANDIDATES = rf"""candidates AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY kind = 'measurement' DESC, k) AS n, kind, content FROM (
    SELECT doc_id, k, CASE WHEN regexp_matches(line, '{tx.MEASUREMENT}') THEN 'measurement' ELSE 'record' END AS kind, substr(line, 1, 200) AS content FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY li) AS k FROM lines WHERE length(line) >= 6) WHERE k <= 80))"""


@query("evidence_candidates", f"WITH {_LINES}, {_CANDIDATES} SELECT doc_id, CAST(n AS INTEGER) AS n, kind, content FROM candidates")
def evidence_candidates(spark, sf):
    return draft.evidence_candidates(draft.lines_view(m.table(spark, sf, "documents")))


@query("evidence_register", f"WITH {_LINES}, {_CANDIDATES} SELECT doc_id, 'E' || n AS id, kind, content, sha256(content) AS sha256 FROM candidates WHERE n <= 60")
def evidence_register(spark, sf):
    return draft.register_evidence(draft.evidence_candidates(draft.lines_view(m.table(spark, sf, "documents"))))


@query("sprint_grid", f"WITH {_PROJECTS}, {_SPRINTS} SELECT project, seq, start, \"end\" FROM sprints")
def sprint_grid(spark, sf):
    return planner.sprint_grid(_projects(spark, sf))


@query("month_blocks", f"""WITH {_PROJECTS}, n AS (SELECT project, start, "end", unnest(range(0, (year("end") - year(start)) * 12 + month("end") - month(start) + 1))::INTEGER AS n FROM projects),
b AS (SELECT project, n + 1 AS seq, CAST(start + to_months(n) AS DATE) AS s, CAST(start + to_months(n + 1) AS DATE) - 1 AS e, "end" FROM n)
SELECT project, CAST(seq AS INTEGER) AS seq, s AS start, least(e, "end") AS "end" FROM b WHERE s <= "end" """)
def month_blocks(spark, sf):
    return planner.month_blocks(_projects(spark, sf))


@query("planner_validate", f"""WITH {_PROJECTS}, {_SPRINTS}, bad AS (SELECT * FROM sprints WHERE NOT (project % 7 = 0 AND seq = 2) ),
g AS (SELECT project, count(*) AS n FROM (SELECT *, lag("end") OVER (PARTITION BY project ORDER BY seq) AS b FROM bad) WHERE b IS NOT NULL AND b + 1 <> start GROUP BY project),
t AS (SELECT project, min(start) AS a, max("end") AS b, sum("end" - start + 1) AS days FROM bad GROUP BY project)
SELECT project, 'gap' AS issue, n FROM g
UNION ALL SELECT p.project, 'start', 1 FROM projects AS p LEFT JOIN t USING (project) WHERE a IS NULL OR a <> p.start
UNION ALL SELECT p.project, 'end', 1 FROM projects AS p LEFT JOIN t USING (project) WHERE b IS NULL OR b <> p."end"
UNION ALL SELECT p.project, 'days', 1 FROM projects AS p LEFT JOIN t USING (project) WHERE days IS NULL OR days <> p."end" - p.start + 1""")
def planner_validate(spark, sf):
    """The grid with the second sprint of every seventh project taken out: the planted defect to be found."""
    projects = _projects(spark, sf)
    grid = planner.sprint_list(F.col("start"), F.col("end"))
    return planner.validate_grid(projects.withColumn("sprints", F.filter(grid, lambda s: ~((F.col("project") % 7 == 0) & (s["seq"] == 2)))))


@query("active_packages", f"""WITH {_PROJECTS}, {_SPRINTS}, {_PACKAGES} SELECT s.project, s.seq, string_agg('WP' || num, ',' ORDER BY num) AS packages FROM sprints AS s JOIN packages AS p ON p.project = s.project AND p."end" >= s.start AND p.start <= s."end" GROUP BY ALL""")
def active_packages(spark, sf):
    projects = _projects(spark, sf)
    return planner.active_work_packages(projects, _packages(projects))


@query("sprint_evidence", f"WITH {_LEDGER} SELECT CAST(floor((day - DATE '2024-01-01') / 14) AS INTEGER) + 1 AS sprint, count(*) AS evidence, count(DISTINCT kind) AS kinds FROM ledger GROUP BY 1")
def sprint_evidence(spark, sf):
    return views.sprint_evidence(_inputs(spark, sf)[1], EVENT_START)


@query("state_counts", f"WITH {_NOTES} SELECT state, count(*) AS notes, count(DISTINCT project) AS projects FROM notes GROUP BY state")
def state_counts(spark, sf):
    return views.state_counts(m.notes(m.table(spark, sf, "orders")))


@query("month_rollup", f"WITH {_NOTES} SELECT CAST(date_trunc('month', start) AS DATE) AS month, count(*) AS notes, count(*) FILTER (state = 'sealed') AS sealed FROM notes GROUP BY 1")
def month_rollup(spark, sf):
    return views.month_rollup(m.notes(m.table(spark, sf, "orders")))


@query("elapsed_percent", f"""WITH {_PROJECTS} SELECT project, CAST(floor(CAST(greatest(least(DATE '{TODAY}' - start + 1, "end" - start + 1), 0) AS DOUBLE) / ("end" - start + 1) * 100 + 0.5) AS BIGINT) AS elapsed FROM projects""")
def elapsed_percent(spark, sf):
    return views.elapsed_percent(_projects(spark, sf), TODAY)


@query("metric_status", f"""WITH {_CATALOG}, l AS (SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1)
SELECT key, round(value, 4) AS value, CASE WHEN value IS NULL THEN 'no_data' WHEN target IS NULL THEN 'measuring' WHEN CASE WHEN direction = 'lower' THEN value <= target ELSE value >= target END THEN 'achieved' ELSE 'in_progress' END AS status FROM catalog LEFT JOIN l ON l.event_type = key""")
def metric_status(spark, sf):
    events = m.table(spark, sf, "events").select(F.col("event_type").alias("metric_key"), "ts", "event_id", "value")
    return views.metric_status(draft.latest_by(events, ["metric_key"], ["ts", "event_id"]), m.catalog(spark))


@query("interpretation", f"""WITH {_CATALOG}, l AS (SELECT event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1), r AS (SELECT *, floor(v / target * 1000 + 0.5) / 10 AS ratio FROM catalog JOIN l ON l.event_type = key)
SELECT key AS metric_key, key || ': ' || printf('%.2f', v) || unit || CASE WHEN target IS NULL THEN ' recorded.' WHEN direction = 'lower' THEN ' against a limit of ' || printf('%.2f', target) || unit || '.' WHEN ratio <= 200 THEN ', ' || printf('%.1f', ratio) || '% of the target ' || printf('%.2f', target) || unit || '.' ELSE ' against a target of ' || printf('%.2f', target) || unit || '.' END AS sentence FROM r""")
def interpretation(spark, sf):
    events = m.table(spark, sf, "events").select(F.col("event_type").alias("metric_key"), "ts", "event_id", "value")
    return draft.interpretation(draft.latest_by(events, ["metric_key"], ["ts", "event_id"]), m.catalog(spark))


@query("chart_axis", "SELECT event_type AS metric_key, round(min(value) - (max(value) - min(value)) * 0.12::DOUBLE, 4) AS low, round(max(value) + (max(value) - min(value)) * 0.12::DOUBLE, 4) AS high FROM events GROUP BY 1")
def chart_axis(spark, sf):
    return views.chart_axis(m.table(spark, sf, "events").withColumnRenamed("event_type", "metric_key"))


@query("latest_revision", f"WITH {_NOTES} SELECT project, arg_max(note_id, (written_on, note_id)) AS note_id, arg_max(state, (written_on, note_id)) AS state FROM notes GROUP BY project")
def latest_revision(spark, sf):
    notes = m.notes(m.table(spark, sf, "orders")).select("project", "note_id", "state", "written_on")
    return draft.latest_by(notes, ["project"], ["written_on", "note_id"]).select("project", "note_id", "state")


@query("draft_rows", f"""WITH {_NARRATIVE}, x AS (SELECT *, CASE WHEN contains(text, 'click') THEN 'click' WHEN contains(text, 'view') THEN 'view' WHEN contains(text, 'purchase') THEN 'purchase' WHEN contains(text, 'signup') THEN 'signup' WHEN contains(text, 'login') THEN 'login' END AS metric_key,
  TRY_CAST(nullif(regexp_extract(text, 'measured (-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS number, {_rule_sql("text")} AS rule FROM narrative)
SELECT event_id, day, CASE WHEN NOT day BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' THEN 'off_period' WHEN regexp_matches(text, '{tx.NO_EVIDENCE}') THEN 'no_evidence' WHEN rule IS NOT NULL THEN 'forbidden' WHEN metric_key IS NOT NULL AND number IS NOT NULL THEN 'metric' ELSE 'work' END AS status, metric_key, number AS value FROM x""")
def draft_rows(spark, sf):
    return draft.draft_rows(_inputs(spark, sf)[0], m.catalog(spark), "2024-01-08", "2024-01-21")


@query("draft_merge", rf"""WITH {_NARRATIVE}, k AS (SELECT event_id, text, regexp_replace(regexp_replace(text, '\[E\d{{1,5}}\]', '', 'g'), '\s+', '', 'g') AS key FROM narrative),
o AS (SELECT * FROM k WHERE event_id % 3 = 0), n AS (SELECT key, min(event_id) AS event_id, arg_min(text, event_id) AS text FROM k WHERE event_id % 2 = 0 GROUP BY key)
SELECT event_id, text FROM o UNION ALL SELECT event_id, text FROM n WHERE key NOT IN (SELECT key FROM o)""")
def draft_merge(spark, sf):
    """A note that holds every third entry, and a draft of every second one."""
    entries = _inputs(spark, sf)[0].select("event_id", "text")
    return draft.merge_draft(entries.where("event_id % 3 = 0"), entries.where("event_id % 2 = 0"))


@query("first_wins", "SELECT source, lang, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY ALL")
def first_wins(spark, sf):
    return draft.first_wins(m.table(spark, sf, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], ["doc_id"])


@query("citation_set_diff", f"WITH {_NARRATIVE} SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 29 = 0 THEN true ELSE event_id % 4 <> 0 END AS same FROM narrative")
def citation_set_diff(spark, sf):
    """Each entry against a copy that loses its citations for every fourth."""
    after = F.when(F.col("event_id") % 4 == 0, tx.strip_citations(F.col("text"), "+")).otherwise(F.col("text"))
    return _inputs(spark, sf)[0].select("event_id", draft.same_citations(F.col("text"), after).alias("same"))


@query("content_hash", f"""WITH {_NOTES} SELECT note_id, sha256(list_aggregate(list_transform([CAST(note_id AS VARCHAR), CAST(start AS VARCHAR), CAST("end" AS VARCHAR), printf('%.2f', value), priority], lambda x: coalesce(length(x) || ':' || x, '-')), 'string_agg', '')) AS content_sha256 FROM notes""")
def content_hash(spark, sf):
    notes = m.notes(m.table(spark, sf, "orders")).withColumn("value", F.format_string("%.2f", "value"))
    return seal.content_hash(notes, SEALED_FIELDS).select("note_id", "content_sha256")


@query("seal_chain_verify", f"""WITH {_NOTES}, c AS (SELECT project, note_id, row_number() OVER (PARTITION BY project ORDER BY written_on, note_id) AS p FROM notes WHERE state = 'sealed')
SELECT project, count(*) AS notes, coalesce(min(p) FILTER (note_id % 59 = 0) - 1, count(*)) AS checked, min(p) FILTER (note_id % 59 = 0) AS first_bad FROM c GROUP BY project""")
def seal_chain_verify(spark, sf):
    """Sealed notes of each project as a chain, with the body of every 59th changed after sealing."""
    notes = m.notes(m.table(spark, sf, "orders")).where("state = 'sealed'")
    chain = seal.seal_chain(notes, SEALED_FIELDS, "project", ["written_on", "note_id"])
    return seal.verify_chain(chain.withColumn("value", F.when(F.col("note_id") % 59 == 0, F.col("value") + 1).otherwise(F.col("value"))), SEALED_FIELDS, "project")


@query("note_ids", f"""WITH {_NOTES} SELECT note_id, 'RN-' || strftime(start, '%Y%m%d') || '-' || strftime("end", '%Y%m%d') || CASE WHEN note_id % 3 > 0 THEN '-R' || (note_id % 3) ELSE '' END AS id, start, "end", CAST(note_id % 3 AS INTEGER) AS revision FROM notes""")
def note_ids(spark, sf):
    notes = m.notes(m.table(spark, sf, "orders")).select("note_id", seal.note_id(F.col("start"), F.col("end"), (F.col("note_id") % 3).cast("int")).alias("id"))
    return notes.withColumn("p", seal.parse_note_id(F.col("id"))).select("note_id", "id", "p.start", "p.end", "p.revision")


@query("korean_numbers", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 1e8 + 5e7 WHEN 1 THEN p_size * 1e6 WHEN 2 THEN p_partkey::DOUBLE WHEN 3 THEN p_size::DOUBLE ELSE NULL END::DOUBLE AS value FROM part")
def korean_numbers(spark, sf):
    p, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(p % 5 == 0, F.concat(size, F.lit("억 5천만원"))).when(p % 5 == 1, F.concat(size, F.lit("백만원"))).when(p % 5 == 2, F.format_number(p, 0)).when(p % 5 == 3, F.concat(size, F.lit("%"))).otherwise(F.concat(size, F.lit(" 대")))
    return m.table(spark, sf, "part").select("p_partkey", numbers.korean_number(text).alias("value"))


@query("loose_dates", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def loose_dates(spark, sf):
    o, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(o % 4 == 0, F.date_format(d, "yyyy년 M월 d일")).when(o % 4 == 1, F.date_format(d, "yyyy.M")).when(o % 4 == 2, F.date_format(d, "yyyyMMdd")).otherwise(F.date_format(d, "yyyy-13-dd"))
    return m.table(spark, sf, "orders").select("o_orderkey", dates.parse_loose(text).alias("day"))


_WORDS = "(SELECT doc_id, regexp_replace(regexp_replace(text, '^Th', 'Keywords: ab, Th'), '^E', '키워드 E') AS text FROM documents)"


@query("keyword_top10", rf"""WITH {_LINES.replace('FROM documents', f'FROM {_WORDS} AS documents')},
named AS (SELECT doc_id, arg_min(items, li) AS items FROM (SELECT doc_id, li, list_filter(list_transform(string_split_regex(own, '[,、;·]'), lambda x: trim(x)), lambda x: length(x) >= 2)[: 12] AS items FROM (
  SELECT doc_id, li, trim(regexp_extract(line, '(?i)(?:{extract.KEYWORDS})[\s:：·\-–|]*(.*)$', 1)) AS own FROM lines WHERE regexp_matches(line, '(?i){extract.KEYWORDS}')) WHERE length(own) >= 2) GROUP BY doc_id HAVING len(arg_min(items, li)) >= 2),
wd AS (SELECT doc_id, li, unnest(range(1, len(w) + 1)) AS wi, w FROM (SELECT doc_id, li, regexp_extract_all(line, '{extract.WORD}') AS w FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM named))),
c AS (SELECT doc_id, w[wi] AS word, count(*) AS n, min((li, wi)) AS first FROM wd WHERE lower(w[wi]) NOT IN {tuple(extract.STOP)!r} GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT doc_id, k AS nth, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM c) WHERE k <= 10
UNION ALL SELECT doc_id, unnest(range(1, len(items) + 1)), unnest(items), NULL FROM named""")
def keyword_top10(spark, sf):
    """Keywords of the documents, some of which begin with a list of their own."""
    marked = F.regexp_replace(F.regexp_replace("text", "^Th", "Keywords: ab, Th"), "^E", "키워드 E")
    found = extract.keywords(draft.lines_view(m.table(spark, sf, "documents").select("doc_id", marked.alias("text"))))
    return found.withColumn("nth", F.col("nth").cast("long"))


@query("html_cells", r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS r, trim(regexp_replace(l[i], '<[^>]*>', '', 'g')) AS v FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?s)<(?:li|td|th|h1)[^>]*>(.*?)</(?:li|td|th|h1)>', 1) AS l FROM pages))""")
def html_cells(spark, sf):
    return extract.html_cells(m.table(spark, sf, "pages").select("page_id", "html"))


def _plans(spark: SparkSession, sf: str) -> DataFrame:
    """A plan document a customer, as its lines: the input the extraction is made for."""
    c = m.table(spark, sf, "customer")
    k = F.col("c_custkey")
    code = F.concat(F.lit("RS-2024-"), F.lpad(k.cast("string"), 6, "0"))
    begin = F.add_months(F.lit("2024-01-01").cast("date"), (k % 12).cast("int"))
    lines = F.array(
        F.concat(F.lit("과제명: "), "c_name", F.lit(" study")), F.concat(F.lit("과제번호: "), code), F.concat(F.lit("연구책임자: u"), k.cast("string")),
        F.concat(F.lit("연구개발기간: "), F.date_format(begin, "yyyy년 M월"), F.lit(" ~ "), F.date_format(F.add_months(begin, 23), "yyyy년 M월")),
        F.concat(F.lit("총연구비: "), (k % 9 + 1).cast("string"), F.lit("억 5천만원")), F.lit("WP1: 설계"), F.lit("WP2: 제작"), F.concat(F.lit("WP2: 중복 "), k.cast("string")),
    )
    return c.select(k.alias("doc_id"), F.posexplode(lines).alias("li", "line"))


@query("extract_fields", """SELECT c_custkey AS doc_id, f AS field, CASE f WHEN 'title' THEN c_name || ' study' WHEN 'code' THEN 'RS-2024-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') WHEN 'pi' THEN 'u' || c_custkey WHEN 'budget' THEN (c_custkey % 9 + 1) || '억 5천만원'
  ELSE strftime(DATE '2024-01-01' + to_months(CAST(c_custkey % 12 AS INTEGER)), '%Y년 %-m월') || ' ~ ' || strftime(DATE '2024-01-01' + to_months(CAST(c_custkey % 12 + 23 AS INTEGER)), '%Y년 %-m월') END AS value, 2 AS score
FROM (SELECT *, unnest(['title', 'code', 'pi', 'budget', 'period']) AS f FROM customer)""")
def extract_fields(spark, sf):
    return extract.best(extract.labelled_lines(_plans(spark, sf)))


@query("extract_period", "SELECT c_custkey AS doc_id, CAST(DATE '2024-01-01' + to_months(CAST(c_custkey % 12 AS INTEGER)) AS DATE) AS start, last_day(CAST(DATE '2024-01-01' + to_months(CAST(c_custkey % 12 + 23 AS INTEGER)) AS DATE)) AS \"end\" FROM customer")
def extract_period(spark, sf):
    return extract.periods(_plans(spark, sf))


@query("extract_budget", "SELECT c_custkey AS doc_id, ((c_custkey % 9 + 1) * 1e8 + 5e7)::DOUBLE AS budget FROM customer")
def extract_budget(spark, sf):
    return extract.budgets(extract.labelled_lines(_plans(spark, sf)))


@query("extract_packages", "SELECT c_custkey AS doc_id, n AS num, CASE n WHEN 1 THEN '설계' ELSE '제작' END AS name FROM (SELECT c_custkey, unnest([1, 2]) AS n FROM customer)")
def extract_packages(spark, sf):
    return extract.work_packages(_plans(spark, sf))


@query("canonical_records", "SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') AS digest FROM events")
def canonical_records(spark, sf):
    return m.table(spark, sf, "events").select("event_id", F.sha2(canonical_json("props"), 256).alias("digest"))


@query("docx_roundtrip", f"WITH {_PROJECTS} SELECT project || '.docx' AS name, true AS ok, 3 AS paragraphs FROM projects")
def docx_roundtrip(spark, sf):
    """A Word document a project, written and parsed again inside tasks."""
    lines = _projects(spark, sf).select("project", F.array(F.col("start").cast("string"), F.col("end").cast("string")).alias("lines"))
    parsed = parse.parse_frame(export.note_documents(lines, "project", "lines"), "name", "content")
    return parsed.select("name", "ok", F.size("paragraphs").alias("paragraphs"))


@query(
    "sprint_windows",
    """SELECT time_bucket(INTERVAL 14 DAY, ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, round(sum(value), 2) AS total
    FROM events GROUP BY ALL""",
)
def sprint_windows(spark, sf):
    """The windows of the event stream, over the whole table."""
    counts = sprints.sprint_counts(m.table(spark, sf, "events"))
    return counts.withColumn("start", F.col("start").cast("timestamp_ntz"))


def _rosters(spark: SparkSession, sf: str) -> DataFrame:
    """A plan a customer with people, milestones and results, some of them twice."""
    k = F.col("c_custkey").cast("string")
    pick = F.element_at(F.array(*[F.lit(x) for x in ("김하나", "이두리", "박세찬")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    lines = F.array(
        F.concat(F.lit("연구책임자: "), pick), F.lit("참여연구원 - 최네모"), F.concat(F.lit("연구책임자 "), pick, F.lit(" 교수")),
        F.concat(F.lit("Milestone M12: 시제품 "), k), F.lit("M6 평가"), F.lit("2단계 평가: 현장"), F.lit("M12 점검: 중복"), F.lit("M130 점검: 너무 늦음"),
        F.lit("산출물: 보고서, 소프트웨어"), F.lit("결과물 목록:"), F.concat(F.lit("- 시제품 "), k, F.lit("대")), F.lit("1) 보고서"), F.lit("a"), F.lit("- 밖의 줄"),
    )
    return m.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(lines).alias("li", "line"))


@query("extract_people", """SELECT c_custkey AS doc_id, n AS nth, CASE n WHEN 1 THEN ['김하나', '이두리', '박세찬'][c_custkey % 3 + 1] ELSE '최네모' END AS name, CASE n WHEN 1 THEN '연구책임자' ELSE '참여연구원' END AS role
FROM (SELECT c_custkey, unnest([1, 2]) AS n FROM customer)""")
def extract_people(spark, sf):
    return extract.people(_rosters(spark, sf))


@query("extract_milestones", """SELECT c_custkey AS doc_id, id, month, CASE id WHEN 'M12' THEN '시제품 ' || c_custkey ELSE name END AS name
FROM customer, (VALUES ('M6', 6, 'M6 마일스톤'), ('M12', 12, ''), ('S2', NULL, '2단계 평가 현장')) AS v(id, month, name)""")
def extract_milestones(spark, sf):
    return extract.milestones(_rosters(spark, sf))


@query("extract_deliverables", """SELECT c_custkey AS doc_id, nth, CASE nth WHEN 3 THEN '시제품 ' || c_custkey || '대' ELSE name END AS name
FROM customer, (VALUES (1, '보고서'), (2, '소프트웨어'), (3, '')) AS v(nth, name)""")
def extract_deliverables(spark, sf):
    return extract.deliverables(_rosters(spark, sf))
