"""The four gates: rule queries that yield one row a violation (location, gate, check, severity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import text as tx
from fieldbook.functions.numbers import to_number
from fieldbook.operators.joins import broadcast_if_small

# Fixed value: units of counts.
COUNT_UNITS = "^[건회명개편차번]$"


def _violation(where: Column, gate: str, check: str, severity: str) -> list[Column]:
    return [where.cast("string").alias("location"), F.lit(gate).alias("gate"), F.lit(check).alias("check"), F.lit(severity).alias("severity")]


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def sentences(entries: DataFrame, key: str = "event_id", text: str = "text") -> DataFrame:
    """(key, n, sentence, cites, exempt): the sentences of narrative entries with what they cite."""
    parts = entries.select(key, F.posexplode(tx.split_sentences(F.col(text))).alias("n", "sentence"))
    return parts.withColumns({"cites": tx.citations(F.col("sentence")), "exempt": tx.states_no_evidence(F.col("sentence"))})


def g1_evidence(entries: DataFrame, ledger: DataFrame, rows: DataFrame | None = None, key: str = "event_id") -> DataFrame:
    """Unmapped sentences, citations that are not in the ledger, forbidden wording, metric rows without evidence.

    A sentence without citation gets no other check. Each input is read once: its checks and its citations are one
    array, and what is cited is looked up in one anti join.
    """
    s = sentences(entries, key)
    none = F.size("cites") == 0
    check = lambda name, severity, cite=None: F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), (F.lit(None).cast("string") if cite is None else cite).alias("cite"))
    own = F.array(F.when(none & ~F.col("exempt"), check("unmapped", "high")), F.when(~none & tx.forbidden_rule(F.col("sentence")).isNotNull(), check("forbidden", "normal")))
    cited = F.transform("cites", lambda c: check("ghost", "high", c))
    found = s.select(F.col(key).cast("string").alias("location"), F.explode(F.concat(F.filter(own, lambda x: x.isNotNull()), cited)).alias("x"))
    if rows is not None:
        evidence = F.when(F.col("evidence").isNull(), check("no_evidence", "high")).otherwise(check("ghost", "high", F.col("evidence")))
        found = found.unionByName(rows.select(F.col("row_id").cast("string").alias("location"), evidence.alias("x")))
    known = ledger.select(F.col("id").alias("cite"), F.lit(True).alias("known")).distinct()
    # what cites nothing gets a key of its own that no evidence has: null keys would all meet in one task
    found = found.select("location", F.lit("G1").alias("gate"), "x.check", "x.severity", F.coalesce("x.cite", F.concat(F.lit(" "), "location")).alias("cite")).join(known, "cite", "left")
    return found.where("check <> 'ghost' or known is null").select("location", "gate", "check", "severity")


def month_buckets(start: Column, end: Column) -> Column:
    """The months an interval touches, as join keys that turn an overlap join into an equi-join."""
    return F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], id_col: str = "note_id") -> DataFrame:
    """Pairs (id, other) of rows with equal keys whose [start, end] overlap: joined by month, each pair in its first common month."""
    a = left.select(*keys, id_col, "start", "end", F.explode(month_buckets(F.col("start"), F.col("end"))).alias("m"))
    b = right.select(*keys, F.col(id_col).alias("other"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(month_buckets(F.col("start"), F.col("end"))).alias("m"))
    both = a.join(b, [*keys, "m"]).where("end >= s2 and start <= e2")
    return both.where(F.col("m") == F.trunc(F.greatest("start", "s2"), "month")).select(*keys, id_col, "other")


def g2_overlap(notes: DataFrame) -> DataFrame:
    """Notes whose period overlaps a sealed note of the same project, other than itself and what it revises or is revised by.

    supersedes, where notes have it, names the note that one revises.
    """
    sealed = notes.where("state = 'sealed'")
    pairs = overlapping(notes, sealed, ["project"]).where("note_id <> other")
    if "supersedes" in notes.columns:
        chains = notes.where("supersedes is not null").select("project", F.col("note_id").alias("x"), F.col("supersedes").alias("y"))
        both = chains.union(chains.select("project", "y", "x")).distinct().select("project", F.col("x").alias("note_id"), F.col("y").alias("other"))
        pairs = pairs.join(both, ["project", "note_id", "other"], "left_anti")
    return pairs.select(_violation(F.col("note_id"), "G2", "overlap", "high"))


def g2_duplicate(notes: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose note_id another, sealed row has too: ids are counted, no pairs are made."""
    n = notes.groupBy("note_id").agg(F.count_if(F.col("state") == "sealed").alias("sealed"))
    own = (F.col("state") == "sealed").cast("long")
    return notes.join(n.where("sealed > 0"), "note_id").where(F.col("sealed") > own).select(_violation(F.col(key), "G2", "duplicate_id", "high"))


def g2_contradiction(rows: DataFrame) -> DataFrame:
    """Rows (note_id, key, end, value, state) that differ from a sealed row of the same key and period end.

    A key and end has one low and one high sealed value; only rows that miss both can differ from none,
    so the sealed side is aggregated before the join and no pairs are made.
    """
    sealed = rows.where("state = 'sealed' and value is not null").groupBy("key", "end").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return rows.join(sealed, ["key", "end"]).where("value <> low or value <> high").select(_violation(F.col("note_id"), "G2", "contradiction", "high"))


def g2_regression(rows: DataFrame) -> DataFrame:
    """Rows of monotonic metrics worse than a sealed row whose period ended before theirs started, without a change_reason.

    Sealed rows are first reduced to one best of each kind a key and end, and the rows' starts to one a key and day; only
    these few meet in a window, whose running best then goes back to the rows by an equi-join.
    """
    mine = rows.where("monotonic and trim(coalesce(change_reason, '')) = ''") if "change_reason" in rows.columns else rows.where("monotonic")
    best = rows.where("state = 'sealed' and value is not null").groupBy("key", F.col("end").alias("day")).agg(F.max("value").alias("most"), F.min("value").alias("least"))
    asked = mine.groupBy("key", F.col("start").alias("day")).agg(F.lit(None).cast("double").alias("most"), F.lit(None).cast("double").alias("least"))
    w = Window.partitionBy("key").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    days = best.unionByName(asked).withColumn("day", F.datediff("day", F.lit("1970-01-01").cast("date")))
    so_far = days.withColumns({"most": F.max("most").over(w), "least": F.min("least").over(w)}).groupBy("key", "day").agg(F.max("most").alias("most"), F.min("least").alias("least"))
    worse = F.when(F.col("direction") == "lower", F.col("value") > F.col("least")).otherwise(F.col("value") < F.col("most"))
    found = mine.withColumn("day", F.datediff("start", F.lit("1970-01-01").cast("date"))).join(so_far, ["key", "day"])
    return found.where(worse).select(_violation(F.col("note_id"), "G2", "regression", "normal"))


def _flagged(rows: DataFrame, where: Column, gate: str, checks: list[tuple[Column, str, str]]) -> DataFrame:
    """One row for each check (condition, name, severity) that holds, in one pass over rows."""
    each = F.array(*[F.when(cond, F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"))) for cond, name, severity in checks])
    found = rows.select(where.cast("string").alias("location"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x"))
    return found.select("location", F.lit(gate).alias("gate"), "x.check", "x.severity")


def g3_numeric(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Value form, percentage range, whole counts, unit mismatch and false claims of a met target."""
    wide = rows.join(broadcast_if_small(catalog.select(F.col("key").alias("metric_key"), F.col("unit").alias("cat_unit"), "target", "direction")), "metric_key", "left")
    wide = wide.withColumn("v", to_number(F.col("value")))
    missed = F.when(F.col("direction") == "lower", F.col("v") > F.col("target")).otherwise(F.col("v") < F.col("target"))
    # comparisons with a value that is no number are null, so none of the others holds for it
    checks = [
        (F.col("v").isNull(), "value_form", "high"),
        (F.expr("unit = '%' and not v between 0 and 100"), "range", "high"),
        (F.col("unit").rlike(COUNT_UNITS) & ((F.col("v") < 0) | (F.col("v") != F.floor("v"))), "count_form", "normal"),
        (F.expr("v is not null and unit <> '' and cat_unit <> '' and unit <> cat_unit"), "unit_mismatch", "normal"),
        (tx.claims_achieved(F.col("achieved")) & missed, "false_achieved", "high"),
    ]
    return _flagged(wide, F.col("row_id"), "G3", checks)


def g3_percentages(entries: DataFrame, key: str = "event_id", text: str = "text") -> DataFrame:
    """Entries whose first percentage of three or more digits is above 200."""
    first = F.regexp_extract(F.col(text), r"(\d{3,})(\.\d+)?%", 1)
    return entries.where(first.try_cast("long") > 200).select(_violation(F.col(key), "G3", "odd_percentage", "normal"))


def g4_required(notes: DataFrame) -> DataFrame:
    """Missing fields, periods that do not run forward, and notes reviewed by their author.

    project_code, title, note_id and written_on count only where notes have such a column.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    fields = [c for c in ("project_code", "title", "note_id", "author", "reviewer", "written_on") if c in notes.columns]
    checks = [(blank(c), c, "high") for c in fields]
    checks.append((F.coalesce(F.col("end") < F.col("start"), F.lit(True)), "period", "high"))
    checks.append((~blank("author") & (F.trim("author") == F.trim("reviewer")), "self_review", "high"))
    return _flagged(notes, F.col("note_id"), "G4", checks)


def g4_history(notes: DataFrame, history: str = "history") -> DataFrame:
    """Notes that have no list of changes; an empty list is one."""
    return notes.where(F.col(history).isNull()).select(_violation(F.col("note_id"), "G4", "history", "high"))


def g4_hash(notes: DataFrame, expected: Column) -> DataFrame:
    """Notes without content hash, or whose hash is not the one of their present content."""
    bad = F.coalesce(F.col("content_sha256") != expected, F.lit(True))
    return notes.where(bad).select(_violation(F.col("note_id"), "G4", "content_hash", "high"))


def g4_attachments(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Attachments whose hash is not 64 lower-case hex digits."""
    bad = ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    return files.where(bad).select(_violation(F.col(key), "G4", "attachment_hash", "high"))


def missing_attachments(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Cited evidence whose source file is not attached, researcher statements aside."""
    need = evidence.where("source_file is not null and kind <> 'researcher_statement'")
    return need.join(files.select(F.col("name").alias("source_file")), "source_file", "left_anti").select(_violation(F.col("id"), "G4", "attachment_missing", "normal"))


def decision(violations: Column, mode: Column | str = "advisory") -> Column:
    """pass without violations; else rejected in strict mode and advisory in any other."""
    strict = mode == "strict" if isinstance(mode, Column) else F.lit(mode == "strict")
    return F.when(violations == 0, "pass").when(strict, "rejected").otherwise("advisory")


def decide(violations: DataFrame, locations: DataFrame | None = None, mode: Column | str = "advisory") -> DataFrame:
    """(location, violations, high, decision): pass, or by mode (a word, or a column of location) rejected or advisory.

    With locations (location), those without any violation are listed too: they pass.
    """
    n = violations.groupBy("location").agg(F.count("*").alias("violations"), F.count_if(F.col("severity") == "high").alias("high"))
    if locations is not None:
        n = locations.select(F.col("location").cast("string")).distinct().join(n, "location", "left").na.fill(0, ["violations", "high"])
    return n.withColumn("decision", decision(F.col("violations"), mode))


def per_gate(violations: DataFrame) -> DataFrame:
    return violations.groupBy("gate", "check", "severity").agg(F.count("*").alias("violations"), F.countDistinct("location").alias("locations"))


def defect_signatures(messages: DataFrame, text: str = "text") -> DataFrame:
    """Messages with their digits masked: how often each form occurs, and its first example."""
    form = F.regexp_replace(F.col(text), r"\d+", "#")
    return messages.groupBy(form.alias("signature")).agg(F.count("*").alias("times"), F.min(text).alias("example"))
