"""Whole notes as nested rows: read from JSON, hashed, and run through all four gates.

A note is one row (see NOTE): its period, header, sections (arrays of entries and of metric rows), attachments and
history. What a gate must look up outside the note, cited evidence and catalogue entries, is joined to the note once, by
what the note names; the checks are then higher-order functions over the nested row. What compares notes with each other
(periods, sealed values) goes by equi-joins of few columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import dates
from fieldbook.functions import text as tx
from fieldbook.functions.numbers import to_number
from fieldbook.operators import gates
from fieldbook.operators.joins import kept

# Fields of nested structs are in order of name, so that to_json gives one form of equal content.
ENTRY = "struct<evidence:array<string>,text:string,wp:string>"
METRIC = "struct<achieved:string,change_reason:string,condition:string,evidence:array<string>,metric:string,metric_key:string,unit:string,value:string>"
HEADER = ["project_code", "title", "author", "reviewer", "written_on", "reviewed_on"]
#: the columns of a note and their types
NOTE = {
    "project": "string", "note_id": "string", "revision": "int", "supersedes": "string", "state": "string", "mode": "string",
    "period": "struct<cadence:string,end:string,start:string>", "wp_refs": "array<string>",
    "header": f"struct<{','.join(f'{c}:string' for c in HEADER)}>",
    "sections": f"struct<goal:array<{ENTRY}>,interpretation:array<{ENTRY}>,metrics:array<{METRIC}>,next_plan:array<{ENTRY}>,results:array<{ENTRY}>,work:array<{ENTRY}>>",
    "attachments": "array<struct<contributor:string,file_id:string,name:string,sha256:string,size:bigint>>",
    "history": "array<struct<at:string,by:string,what:string>>", "content_sha256": "string",
}
# What a stored note's file calls its state, mode, history and the fields of its header.
STORED = {"state": "_state", "mode": "검증모드", "history": "수정이력", "project_code": "과제번호", "title": "과제명", "author": "작성자", "reviewer": "점검자", "written_on": "작성일", "reviewed_on": "점검일"}

NARRATIVE = ["work", "results", "interpretation", "next_plan"]
VIOLATION = "struct<check:string,severity:string,location:string,quote:string>"
KNOWN = "struct<id:string,kind:string,source_type:string,source_file:string>"


def parse_notes(rows: DataFrame, column: str = "value") -> DataFrame:
    """rows with note, a struct of the fields of NOTE read from JSON, and corrupt, the text where it is no note.

    A text that is no JSON object, has no note_id, or has parts of other kinds than NOTE says is corrupt, its note null; a null
    text leaves both null. The file's names of fields are those of STORED.
    """
    inside = "struct<" + ",".join(f"`{STORED[c]}`:string" for c in HEADER) + ">"
    schema = ", ".join(f"`{STORED.get(c, c)}` {inside if c == 'header' else kind}" for c, kind in NOTE.items())
    read = rows.withColumn("_fb_n", F.from_json(column, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    n = F.col("_fb_n")
    header = F.when(n["header"].isNotNull(), F.struct(*[n["header"][STORED[c]].alias(c) for c in HEADER]))
    note = F.struct(*[(header if c == "header" else n[STORED.get(c, c)]).alias(c) for c in NOTE])
    whole = F.coalesce(n["_corrupt"].isNull() & n["note_id"].isNotNull(), F.lit(False))
    return read.select(*[F.col(c) for c in rows.columns], F.when(whole, note).alias("note"), F.when(~whole, F.col(column)).alias("corrupt"))


def content_hash(sections: Column | None = None, period: Column | None = None, wp_refs: Column | None = None) -> Column:
    """SHA-256 of a note's content: JSON of its period, sections and work packages, names in order, absent fields left out."""
    parts = {"period": period, "sections": sections, "wp_refs": wp_refs}
    return F.sha2(F.to_json(F.struct(*[(F.col(c) if x is None else x).alias(c) for c, x in parts.items()])), 256)


def _violation(check: str, severity: str, location: Column, quote: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), location.alias("location"), F.left(F.coalesce(quote, F.lit("")), F.lit(200)).alias("quote"))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _those(*flagged: tuple[Column, Column]) -> Column:
    """The violations whose condition holds; null is no."""
    return F.filter(F.array(*[F.when(cond, v) for cond, v in flagged]), lambda x: x.isNotNull())


def _all(arrays: Column) -> Column:
    return F.coalesce(F.flatten(arrays), _none(VIOLATION))


def entries() -> Column:
    """The note's narrative entries that are not blank: (section, at, text)."""

    def of(section: str) -> Column:
        rows = F.transform(F.col(f"sections.{section}"), lambda e, i: F.struct(F.lit(section).alias("section"), i.alias("at"), e["text"].alias("text")))
        return F.coalesce(rows, _none("struct<section:string,at:int,text:string>"))

    return F.filter(F.concat(*[of(s) for s in NARRATIVE]), lambda e: e["text"].rlike(r"\S"))


def metrics() -> Column:
    """The note's metric rows that name a metric."""
    return F.filter(F.coalesce(F.col("sections.metrics"), _none(METRIC)), lambda r: F.coalesce(r["metric"], F.lit("")) != "")


def metric_key(row: Column) -> Column:
    return F.coalesce(F.nullif(row["metric_key"], F.lit("")), row["metric"])


def _evidence(row: Column) -> Column:
    return F.coalesce(row["evidence"], _none("string"))


def cited() -> Column:
    """The evidence that a note cites, each id once."""
    in_text = F.flatten(F.transform(entries(), lambda e: tx.citations(e["text"])))
    return F.array_distinct(F.concat(in_text, F.flatten(F.transform(metrics(), _evidence))))


def _row_at(i: Column) -> Column:
    return F.concat(F.lit("metrics "), (i + 1).cast("string"))


def _g1() -> Column:
    ids = F.transform("_fb_known", lambda k: k["id"])

    def sentence(e: Column, s: Column) -> Column:
        where = F.concat(e["section"], F.lit(" "), (e["at"] + 1).cast("string"))

        def checked(cites: Column) -> Column:
            ghosts = F.transform(F.filter(cites, lambda c: ~F.array_contains(ids, c)), lambda c: _violation("ghost", "high", where, s))
            own = _those((F.size(cites) == 0, _violation("unmapped", "high", where, s)), ((F.size(cites) > 0) & tx.forbidden_rule(s).isNotNull(), _violation("forbidden", "normal", where, s)))
            return F.concat(ghosts, own)

        # the citations are found once, as the value of a lambda
        return F.element_at(F.transform(F.array(tx.citations(s)), checked), 1)

    def entry(e: Column) -> Column:
        return _all(F.transform(F.filter(tx.split_sentences(e["text"]), lambda s: ~tx.states_no_evidence(s)), lambda s: sentence(e, s)))

    def row(r: Column, i: Column) -> Column:
        quote = F.concat_ws("=", r["metric"], r["value"])
        ghosts = F.transform(F.filter(_evidence(r), lambda c: ~F.array_contains(ids, c)), lambda c: _violation("ghost", "high", _row_at(i), quote))
        return F.concat(_those((F.size(_evidence(r)) == 0, _violation("no_evidence", "high", _row_at(i), quote))), ghosts)

    return F.concat(_all(F.transform("_fb_entries", entry)), _all(F.transform("_fb_metrics", row)))


def _g3() -> Column:
    def row(r: Column, i: Column) -> Column:
        quote = F.concat_ws("=", r["metric"], F.concat(r["value"], F.coalesce(r["unit"], F.lit(""))))

        def checked(x: Column) -> Column:
            v, cat, unit = x["v"], x["cat"], F.coalesce(r["unit"], F.lit(""))
            flag = lambda cond, check, severity: (v.isNotNull() & cond, _violation(check, severity, _row_at(i), quote))
            claims = F.coalesce(r["achieved"] == "true", F.lit(False)) | tx.claims_achieved(F.coalesce(r["condition"], F.lit("")))
            missed = F.when(cat["direction"] == "lower", v > cat["target"]).otherwise(v < cat["target"])
            return _those(
                (v.isNull(), _violation("value_form", "high", _row_at(i), r["value"])),
                flag((unit == "%") & ((v < 0) | (v > 100)), "range", "high"),
                flag(unit.rlike(gates.COUNT_UNITS) & ((v < 0) | (v != F.floor(v))), "count_form", "normal"),
                flag((cat["unit"] != "") & (unit != "") & (cat["unit"] != unit), "unit_mismatch", "normal"),
                flag(claims & missed, "false_achieved", "high"),
            )

        number = to_number(r["value"])
        number = F.when(F.abs(number) < float("inf"), number)
        return F.element_at(F.transform(F.array(F.struct(number.alias("v"), F.try_element_at("_fb_catalog", metric_key(r)).alias("cat"))), checked), 1)

    def share(e: Column) -> Column:
        first = F.regexp_extract(e["text"], r"(\d{3,})(?:\.\d+)?\s*%", 1).try_cast("double")
        return _those((first > 200, _violation("odd_percentage", "normal", e["section"], e["text"])))

    return F.concat(_all(F.transform("_fb_metrics", row)), _all(F.transform("_fb_entries", share)))


def _g4() -> Column:
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    start, end = dates.parse_iso(F.col("period.start")), dates.parse_iso(F.col("period.end"))
    author, reviewer = F.col("header.author"), F.col("header.reviewer")
    need = lambda missing, check: (missing, _violation(check, "high", F.lit(check), F.lit("")))
    header = _those(
        *[need(blank(F.col(f"header.{c}")), c) for c in ("project_code", "title")],
        need(blank(F.col("note_id")), "note_id"),
        need(F.coalesce(start > end, F.lit(True)), "period"),
        *[need(blank(F.col(f"header.{c}")), c) for c in ("author", "reviewer")],
        need(dates.parse_iso(F.col("header.written_on")).isNull(), "written_on"),
        (~blank(author) & (F.trim(author) == F.trim(reviewer)), _violation("self_review", "high", F.lit("reviewer"), author)),
    )
    files = F.coalesce(F.col("attachments"), F.array().cast(NOTE["attachments"]))
    hashes = F.transform(files, lambda a, i: _those((~F.coalesce(a["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False)), _violation("attachment_hash", "high", F.concat(F.lit("attachment "), (i + 1).cast("string")), a["name"]))))
    names = F.transform(files, lambda a: F.coalesce(a["name"], F.lit("")))
    needed = F.filter("_fb_known", lambda k: F.coalesce((k["kind"].isNull() | (k["kind"] != "researcher_statement")) & (k["source_type"] == "upload") & (k["source_file"] != "") & ~F.array_contains(names, k["source_file"]), F.lit(False)))
    # known evidence is in order of its id, whatever order the join gave
    missing = F.transform(F.array_sort(needed), lambda k: _violation("attachment_missing", "normal", F.lit("attachments"), k["source_file"]))
    kept = _those(need(F.col("history").isNull(), "history"), need(F.coalesce(F.col("content_sha256") != content_hash(), F.lit(True)), "content_hash"))
    return F.concat(header, _all(hashes), missing, kept)


def _id(note: str = "note_id") -> Column:
    """A note's id within all projects."""
    return F.when(F.coalesce(F.col(note), F.lit("")) != "", F.concat(F.coalesce(F.col("project"), F.lit("")), F.lit("\x1f"), F.col(note)))


def _against_sealed(notes: DataFrame, catalog: DataFrame) -> DataFrame:
    """(_fb_id, check, severity, location, quote): G2 of notes (with _fb_id and _fb_metrics), by the sealed ones among them.

    Rows that share project and id are one note here.
    """
    start, end = dates.parse_iso(F.col("period.start")), dates.parse_iso(F.col("period.end"))
    flat = notes.where("_fb_id is not null").select("project", F.col("_fb_id").alias("note_id"), F.when(F.col("supersedes").isNotNull(), _id("supersedes")).alias("supersedes"), "state", start.alias("start"), end.alias("end"), "_fb_metrics")
    periods = flat.where("start <= end").select("project", "note_id", "supersedes", "state", "start", "end").distinct()
    pairs = gates.overlapping(periods, periods.where("state = 'sealed'"), ["project"]).where("note_id <> other").distinct()
    linked = periods.where("supersedes is not null").select("note_id", F.col("supersedes").alias("other"))
    linked = linked.unionByName(linked.select(F.col("other").alias("note_id"), F.col("note_id").alias("other")))
    overlaps = pairs.join(linked, ["note_id", "other"], "left_anti").select("note_id", F.lit("overlap").alias("check"), F.lit("high").alias("severity"), F.lit("period").alias("location"), F.substring_index("other", "\x1f", -1).alias("quote"))

    rows = flat.select("project", "note_id", "state", "start", "end", F.posexplode("_fb_metrics").alias("at", "r"))
    rows = rows.select("project", "state", "start", "end", F.struct("note_id", F.col("at").alias("at"), F.concat_ws("=", "r.metric", "r.value").alias("quote")).alias("row"), metric_key(F.col("r")).alias("metric_key"), to_number(F.col("r.value")).alias("value"), F.col("r.change_reason").alias("change_reason")).distinct()
    kinds = catalog.select(*[c for c in ("project",) if c in catalog.columns], F.col("key").alias("metric_key"), "direction", "monotonic")
    by = [c for c in ("project", "metric_key") if c in kinds.columns]
    rows = rows.join(kinds, by, "left").withColumn("monotonic", F.coalesce("monotonic", F.lit(False)))
    # gates name a place by one text
    rows = rows.select(F.to_json("row").alias("note_id"), F.to_json(F.struct("project", "metric_key")).alias("key"), "state", "start", "end", "value", "change_reason", "direction", "monotonic").where("value is not null")
    found = gates.g2_contradiction(rows).unionByName(gates.g2_regression(rows))
    place = F.from_json("location", "note_id string, at int, quote string")
    found = found.withColumn("p", place).select("p.note_id", "check", "severity", _row_at(F.col("p.at")).alias("location"), "p.quote")
    return overlaps.unionByName(found).withColumnRenamed("note_id", "_fb_id")


def run_gates(notes: DataFrame, ledger: DataFrame, catalog: DataFrame, mode: Column | str | None = None) -> DataFrame:
    """notes (columns of NOTE) with gates, all_pass, violations (how many), mode and decision.

    gates has one struct for each of G1 to G4: (gate, pass, violations), and a violation is (check, severity, location,
    quote). decision is pass, or by mode rejected (strict) or advisory (all else); mode is a column, one of the two words, or that of
    the note. G2 compares with the sealed notes among notes of the same project, a revision not with what it replaces. ledger: id, kind,
    source_type, source_file; catalog: key, unit, target, direction, monotonic; both may have project, which then must be equal.
    A ledger's ids and a catalogue's keys are taken to be unique.
    """
    # read by each of the look-ups and comparisons below, so what the notes are made of is computed once
    own = kept(notes.select(*NOTE).withColumns({"_fb_id": _id(), "_fb_key": F.sha2(F.to_json(F.struct(*NOTE)), 256)})).withColumns({"_fb_entries": entries(), "_fb_metrics": metrics()})
    # equal notes name the same things, so they share one row of what is found for them
    names = own.select("_fb_key", "project", "_fb_id", cited().alias("ids"), F.array_distinct(F.transform("_fb_metrics", metric_key)).alias("keys")).distinct()
    at = lambda other: [c for c in ("project",) if c in other.columns]
    none = lambda kind: F.lit(None).cast(kind)
    entry = F.struct("unit", "target", "direction", "monotonic")
    kind = f"struct<key:string,entry:{catalog.select(entry.alias('e')).schema['e'].dataType.simpleString()}>"
    known = names.select("_fb_key", "project", F.explode("ids").alias("id")).join(ledger.select(*at(ledger), "id", "kind", "source_type", "source_file"), [*at(ledger), "id"])
    priced = names.select("_fb_key", "project", F.explode("keys").alias("key")).join(catalog.select(*at(catalog), "key", entry.alias("entry")), [*at(catalog), "key"])
    against = _against_sealed(own, catalog).join(names.select("_fb_key", "_fb_id"), "_fb_id")
    looked_up = (
        known.select("_fb_key", F.struct("id", "kind", "source_type", "source_file").alias("known"), none(kind).alias("cat"), none(VIOLATION).alias("g2"))
        .unionByName(priced.select("_fb_key", none(KNOWN).alias("known"), F.struct("key", "entry").alias("cat"), none(VIOLATION).alias("g2")))
        .unionByName(against.select("_fb_key", none(KNOWN).alias("known"), none(kind).alias("cat"), F.struct("check", "severity", "location", "quote").alias("g2")))
    )
    # a note's own citations, metrics and rows bound these arrays
    found = looked_up.groupBy("_fb_key").agg(F.collect_list("known").alias("_fb_known"), F.map_from_entries(F.collect_list("cat")).alias("_fb_catalog"), F.array_sort(F.collect_list("g2")).alias("_fb_g2"))
    wide = own.join(found, "_fb_key", "left").withColumns({"_fb_known": F.coalesce("_fb_known", _none(KNOWN)), "_fb_g2": F.coalesce("_fb_g2", _none(VIOLATION))})
    checked = {"G1": _g1(), "G2": F.col("_fb_g2"), "G3": _g3(), "G4": _g4()}
    wide = wide.withColumns({f"_fb_{g.lower()}": v.cast(f"array<{VIOLATION}>") for g, v in checked.items()})
    each = F.array(*[F.struct(F.lit(g).alias("gate"), (F.size(f"_fb_{g.lower()}") == 0).alias("pass"), F.col(f"_fb_{g.lower()}").alias("violations")) for g in checked])
    asked = F.col("mode") if mode is None else mode if isinstance(mode, Column) else F.lit(mode)
    strict = F.when(asked == "strict", "strict").otherwise("advisory")
    total = sum((F.size(f"_fb_{g.lower()}") for g in checked), F.lit(0))
    out = wide.select(*[c for c in NOTE if c != "mode"], each.alias("gates"), total.alias("violations"), strict.alias("mode"))
    return out.withColumn("all_pass", F.col("violations") == 0).withColumn("decision", gates.decision(F.col("violations"), F.col("mode")))


# The headings of a note's official form, and what stands where a section is empty.
FORM = {
    "title": "연 구 노 트", "goal": "1. 기간 목표", "work": "2. 수행 내용", "results": "3. 결과 데이터 (서술)", "metrics": "4. 결과 데이터 (측정)", "interpretation": "5. 해석", "next_plan": "6. 차기 계획",
    "attachments": "7. 첨부 원본 목록", "ledger": "8. 증거원장", "gates": "9. 게이트 판정", "history": "10. 수정 이력", "nothing": "해당 기간 관련 증거 자료 없음", "no_files": "첨부 없음",
}
BLOCK = "struct<kind:string,text:string,rows:array<array<string>>>"
LEDGER_ROWS, HISTORY_ROWS = 500, 50


def _ledgers(ledger: DataFrame, most: int | None) -> DataFrame:
    """(project, _fb_ledger): each project's entries (n, id, kind, source_file, locator, content) as cells in order of n, the first ``most``."""
    rows = ledger
    if most is not None:
        rows = ledger.withColumn("_fb_k", F.row_number().over(Window.partitionBy("project").orderBy("n"))).where(F.col("_fb_k") <= most)
    cells = F.transform(F.array("id", "kind", "source_file", "locator", "content"), lambda x: F.coalesce(x, F.lit("")))
    return rows.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", cells.alias("cells")))), lambda x: x["cells"]).alias("_fb_ledger"))


def note_blocks(notes: DataFrame, ledger: DataFrame) -> DataFrame:
    """(project, note_id, n, kind, text, rows): the blocks of each note's official form, in order.

    kind is h1, h2, p, table or small; a table has rows of cells. Sections without text say so; of the project's ledger the first 500
    entries are listed, of the note's history the last 50. notes have the columns of NOTE, and those of
    run_gates if the gates are to be shown. Blocks are put together inside each note's row, so nothing is sorted but a
    project's ledger.
    """
    text = lambda c: F.coalesce(c.cast("string") if isinstance(c, Column) else F.col(c).cast("string"), F.lit(""))
    block = lambda kind, t=None, rows=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if t is None else t).alias("text"), (F.lit(None).cast("array<array<string>>") if rows is None else rows).alias("rows")).cast(BLOCK)
    table = lambda head, rows: block("table", rows=F.concat(F.array(F.array(*[F.lit(x) for x in head])), rows))
    heading = lambda k: F.array(block("h2", F.lit(FORM[k])))
    nothing = lambda k="nothing": F.array(block("p", F.lit(FORM[k])))
    line = lambda *cells: F.array(*cells)

    def section(k: str) -> Column:
        items = F.filter(F.coalesce(F.col(f"sections.{k}"), _none(ENTRY)), lambda e: e["text"].rlike(r"\S"))
        wp = lambda e: F.when(F.coalesce(e["wp"], F.lit("")) != "", F.concat(F.lit(" ("), e["wp"], F.lit(")"))).otherwise("") if k == "goal" else F.lit("")
        shown = F.transform(items, lambda e: block("p", F.concat(F.lit("· "), e["text"], wp(e))))
        return F.concat(heading(k), F.when(F.size(items) == 0, nothing()).otherwise(shown))

    h = F.col("header")
    head = F.array(
        line(F.lit("과제번호"), text(h["project_code"]), F.lit("연구노트번호"), text("note_id")), line(F.lit("과제명"), text(h["title"]), F.lit("작성기간"), F.concat(text("period.start"), F.lit(" ~ "), text("period.end"))),
        line(F.lit("작성자"), text(h["author"]), F.lit("점검자"), text(h["reviewer"])), line(F.lit("작성일"), text(h["written_on"]), F.lit("점검일"), F.coalesce(F.nullif(h["reviewed_on"], F.lit("")), F.lit("(미점검)"))),
        line(F.lit("WP 연계"), F.coalesce(F.nullif(F.array_join("wp_refs", ", "), F.lit("")), F.lit("-")), F.lit("상태"), text("state")),
    )
    got = F.coalesce(F.col("sections.metrics"), _none(METRIC))
    measured = F.transform(got, lambda r: line(text(r["metric"]), text(r["value"]), text(r["unit"]), text(r["condition"]), F.when(r["achieved"] == "true", "달성").when(r["achieved"] == "false", "미달").otherwise("-"), F.array_join(_evidence(r), ", ")))
    files = F.coalesce(F.col("attachments"), F.array().cast(NOTE["attachments"]))
    attached = F.transform(files, lambda a: line(text(a["name"]), text(a["size"]), F.concat(F.left(text(a["sha256"]), F.lit(16)), F.lit("…"))))
    done = F.coalesce(F.col("history"), F.array().cast(NOTE["history"]))
    last = F.slice(done, F.greatest(F.size(done) - HISTORY_ROWS + 1, F.lit(1)), HISTORY_ROWS)
    told = F.transform(last, lambda x: line(text(x["at"]), text(x["by"]), text(x["what"])))
    seal_ = F.when(F.coalesce(F.col("seal"), F.lit("")) != "", F.concat(F.lit(" · 확정 해시: "), F.col("seal"))).otherwise("") if "seal" in notes.columns else F.lit("")
    entries_ = F.coalesce("_fb_ledger", F.array().cast("array<array<string>>"))
    empty = F.array().cast(f"array<{BLOCK}>")
    parts = [
        F.array(block("h1", F.lit(FORM["title"])), block("table", rows=head)), section("goal"), section("work"), section("results"),
        heading("metrics"), F.when(F.size(got) == 0, nothing()).otherwise(F.array(table(["지표", "값", "단위", "조건", "달성", "증거"], measured))), section("interpretation"), section("next_plan"),
        heading("attachments"), F.when(F.size(files) == 0, nothing("no_files")).otherwise(F.array(table(["파일명", "크기", "SHA-256"], attached))),
        F.when(F.size(entries_) == 0, empty).otherwise(F.concat(heading("ledger"), F.array(table(["ID", "종류", "출처", "위치", "내용"], entries_)))),
    ]
    if "gates" in notes.columns:
        judged = F.transform("gates", lambda g: line(g["gate"], F.when(g["pass"], "PASS").otherwise("지적"), F.size(g["violations"]).cast("string")))
        parts.append(F.concat(heading("gates"), F.array(table(["게이트", "판정", "지적 수"], judged))))
    parts += [heading("history"), F.array(table(["시각", "작업자", "내용"], told)), F.array(block("small", F.concat(F.lit("본문 해시: "), F.coalesce(F.nullif("content_sha256", F.lit("")), F.lit("-")), seal_)))]
    wide = notes.join(_ledgers(ledger, LEDGER_ROWS), "project", "left")
    out = wide.select("project", "note_id", F.posexplode(F.concat(*parts)).alias("n", "b"))
    return out.select("project", "note_id", (F.col("n") + 1).alias("n"), "b.kind", "b.text", "b.rows")


def note_sheets(notes: DataFrame, ledger: DataFrame) -> DataFrame:
    """(project, note_id, sheet, n, cells): the four sheets of a note's workbook: summary, metrics, narrative and ledger, rows in order."""
    text = lambda c: F.coalesce(c.cast("string") if isinstance(c, Column) else F.col(c).cast("string"), F.lit(""))
    summary = {"과제번호": "header.project_code", "과제명": "header.title", "연구노트번호": "note_id", "작성자": "header.author", "점검자": "header.reviewer", "상태": "state", "본문 해시": "content_sha256"}
    first = [F.array(F.lit(k), text(c)) for k, c in summary.items()]
    first.insert(3, F.array(F.lit("작성기간"), F.concat(text("period.start"), F.lit(" ~ "), text("period.end"))))
    measured = F.transform(F.coalesce(F.col("sections.metrics"), _none(METRIC)), lambda r: F.array(text(r["metric"]), text(r["value"]), text(r["unit"]), text(r["condition"]), F.array_join(_evidence(r), ", ")))

    def told(k: str) -> Column:
        return F.transform(F.coalesce(F.col(f"sections.{k}"), _none(ENTRY)), lambda e: F.array(F.lit(k), text(e["text"])))

    narrative = F.concat(*[told(k) for k in ("goal", *NARRATIVE)])
    listed = F.coalesce("_fb_ledger", F.array().cast("array<array<string>>"))
    heads = {"measured": ["지표", "값", "단위", "조건", "증거"], "narrative": ["섹션", "내용"], "ledger": ["ID", "종류", "출처", "위치", "내용"]}
    top = lambda k, rows: F.concat(F.array(F.array(*[F.lit(x) for x in heads[k]])), rows)
    sheets = {"summary": F.array(*first), "metrics": top("measured", measured), "narrative": top("narrative", narrative), "ledger": top("ledger", listed)}
    wide = notes.join(_ledgers(ledger, None), "project", "left")
    each = wide.select("project", "note_id", F.explode(F.array(*[F.struct(F.lit(k).alias("sheet"), v.alias("rows")) for k, v in sheets.items()])).alias("s"))
    return each.select("project", "note_id", "s.sheet", F.posexplode("s.rows").alias("n", "cells")).withColumn("n", F.col("n") + 1)
