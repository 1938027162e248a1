"""The life of a note: slots, creation, gate results, signatures, what keeps it from being sealed, measured values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.dates import month_number
from fieldbook.functions.numbers import to_number
from fieldbook.operators.planner import sprint_list
from fieldbook.operators.seal import can_move, note_id

#: length of a note id without its revision: all revisions of a slot share it
SLOT = 20
SECTIONS = ["work", "results", "interpretation", "next_plan"]


def slot_states(sprints: DataFrame, notes: DataFrame) -> DataFrame:
    """(project, seq, slot, notes, state): how many notes a sprint's slot holds, and the state of the last revision.

    A note belongs to the slot its id begins with; as a slot has a fixed length this is an equi-join. notes: project,
    note_id, revision, state. A slot without notes is ``empty``; equal revisions count as the one of greater state.
    """
    filled = notes.groupBy("project", F.left("note_id", F.lit(SLOT)).alias("slot")).agg(F.count("*").alias("notes"), F.max(F.struct("revision", "state")).alias("last"))
    slots = sprints.select("project", "seq", note_id(F.col("start"), F.col("end"), F.lit(0)).alias("slot"))
    wide = slots.join(filled, ["project", "slot"], "left")
    return wide.select("project", "seq", "slot", F.coalesce("notes", F.lit(0)).cast("long").alias("notes"), F.coalesce("last.state", F.lit("empty")).alias("state"))


def create_notes(projects: DataFrame, notes: DataFrame, step: int = 14) -> DataFrame:
    """(project, seq, note_id, start, end, revision, supersedes, state, mode): a draft for every slot that holds no note.

    The slots are those of the sprint grids of projects (project, start, end). What a project's notes take is one set of slots, which meets the
    project before that is spread to its sprints: notes and projects are shuffled, sprints are not.
    """
    taken = notes.groupBy("project").agg(F.collect_set(F.left("note_id", F.lit(SLOT))).alias("taken"))
    wide = projects.select("project", "start", "end").join(taken, "project", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<string>")))
    slots = F.transform(sprint_list(F.col("start"), F.col("end"), step), lambda s: F.struct(s["seq"].alias("seq"), note_id(s["start"], s["end"], F.lit(0)).alias("note_id"), s["start"].alias("start"), s["end"].alias("end")))
    free = wide.select("project", F.explode(F.filter(slots, lambda s: ~F.array_contains("taken", s["note_id"]))).alias("x")).select("project", "x.*")
    return free.select("project", "seq", "note_id", "start", "end", F.lit(0).alias("revision"), F.lit(None).cast("string").alias("supersedes"), F.lit("draft").alias("state"), F.lit("advisory").alias("mode"))


def apply_gates(notes: DataFrame, decisions: DataFrame, key: str = "note_id") -> DataFrame:
    """notes with the state their decision (location, decision) leads to; notes without a decision keep theirs."""
    to = F.when(F.col("decision") == "pass", "awaiting_sign").when(F.col("decision").isNotNull(), F.col("decision")).otherwise(F.col("state"))
    found = decisions.select(F.col("location").alias("_fb_at"), "decision")
    wide = notes.join(found, F.col(key).cast("string") == F.col("_fb_at"), "left").withColumn("state", to)
    return wide.select(*notes.columns)


def add_signatures(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """(note_id, nth, signer, signed_at): the contributors of each note, each once, in the order of their first request.

    Requests (note_id, signer, signed_at, content_sha256) count only for notes not yet sealed, and only if they sign the
    present content. Equal times go by signer. Requests are joined by their note alone, by which all later steps go too, and contents are compared in the
    aggregate: as a key of the join they would move all requests once more.
    """
    now = notes.where("state <> 'sealed'").select("note_id", F.col("content_sha256").alias("_fb_now"))
    same = F.col("content_sha256") == F.col("_fb_now")
    first = requests.join(now, "note_id").groupBy("note_id", "signer").agg(F.min(F.when(same, F.col("signed_at"))).alias("signed_at"), F.max(same).alias("counts")).where("counts")
    nth = F.row_number().over(Window.partitionBy("note_id").orderBy("signed_at", "signer"))
    return first.select("note_id", nth.alias("nth"), "signer", "signed_at")


def signature_status(signatures: DataFrame, registry: DataFrame) -> DataFrame:
    """signatures (note_id, signer, key) with status: unsigned (no key), unknown (signer not registered), changed or ok."""
    known = registry.select("signer", F.col("key").alias("_fb_known"))
    status = F.when(F.col("key").isNull(), "unsigned").when(F.col("_fb_known").isNull(), "unknown").when(F.col("key") != F.col("_fb_known"), "changed").otherwise("ok")
    return signatures.join(known, "signer", "left").select("note_id", "signer", status.alias("status"))


def seal_blocker(expected: Column, allow_advisory: bool = True, allow_self: bool = False) -> Column:
    """The first reason why a note (state, approver, author, content_sha256) cannot be sealed; null if it can."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    state = F.col("state")
    out = (
        F.when(state == "sealed", "already_sealed").when(blank("approver"), "no_approver")
        .when(~F.col("content_sha256").eqNullSafe(expected), "stale_hash").when(state == "rejected", "rejected")
    )
    if not allow_advisory:
        out = out.when(state == "advisory", "advisory")
    out = out.when(state == "draft", "not_checked")
    return out if allow_self else out.when(~blank("author") & (F.col("author") == F.col("approver")), "self_approval")


def sealed_actuals(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, key, value, date, m, note_id, row_id): what sealed notes measured; m is the project's month of the date.

    rows: project, note_id, row_id, state, end, metric_key, value (text). Only finite numbers of rows with a key count.
    """
    number = to_number(F.col("value"))
    kept = rows.where("state = 'sealed' and metric_key <> ''").withColumn("value", number).where("value is not null and not isnan(value) and abs(value) < double('inf')")
    period = projects.select("project", F.col("start").alias("p0"), F.col("end").alias("p1"))
    m = month_number(F.col("end"), F.col("p0"), (F.year("p1") - F.year("p0")) * 12 + F.month("p1") - F.month("p0") + 1)
    return kept.join(period, "project").select("project", F.col("metric_key").alias("key"), "value", F.col("end").alias("date"), m.alias("m"), "note_id", "row_id")


def latest_actuals(actuals: DataFrame) -> DataFrame:
    """(project, key, value, m): the value of the latest month, of several the one of the last row, of equal rows the greatest."""
    last = actuals.groupBy("project", "key").agg(F.max_by(F.struct("value", "m"), F.struct("m", "row_id", "value")).alias("x"))
    return last.select("project", "key", "x.value", "x.m")


def narrative_entries(notes: DataFrame, key: str = "note_id") -> DataFrame:
    """(key, section, index, text): the entries of a note's four narrative sections (arrays of text) that are not blank.

    Goals are no narrative. Positions count blank entries; a null section has none.
    """
    def entries(section: str) -> Column:
        return F.transform(section, lambda x, i: F.struct(F.lit(section).alias("section"), i.alias("index"), x.alias("text")))

    parts = F.flatten(F.filter(F.array(*[entries(s) for s in SECTIONS]), lambda a: a.isNotNull()))
    return notes.select(key, F.explode(parts).alias("x")).select(key, "x.section", "x.index", "x.text").where(F.col("text").rlike(r"\S"))


def note_metric_rows(notes: DataFrame, key: str = "note_id", rows: str = "metrics") -> DataFrame:
    """(key, index, …): the metric rows (array of structs) that name a metric, numbered after the others are left out."""
    named = F.filter(rows, lambda r: F.coalesce(r["metric"], F.lit("")) != "")
    return notes.select(key, F.posexplode(named).alias("index", "x")).select(key, "index", "x.*")


def revision_links(notes: DataFrame) -> DataFrame:
    """(project, note_id, supersedes, original): the state of the note that each revision replaces, or ``missing``."""
    old = notes.select("project", F.col("note_id").alias("supersedes"), F.col("state").alias("original"))
    found = notes.where("supersedes is not null").select("project", "note_id", "supersedes").join(old, ["project", "supersedes"], "left")
    return found.select("project", "note_id", "supersedes", F.coalesce("original", F.lit("missing")).alias("original"))


def keep_if_no_worse(before: DataFrame, after: DataFrame) -> DataFrame:
    """(location, before, after, kept): violations of each note before and after a change, which stays unless they grew."""
    n = lambda df, name: df.groupBy("location").agg(F.count("*").alias(name))
    both = n(before, "before").join(n(after, "after"), "location", "full").na.fill(0, ["before", "after"])
    return both.select("location", "before", "after", (F.col("after") <= F.col("before")).alias("kept"))


def metric_keys(names: DataFrame, slug: Column, by: list[str] | None = None) -> DataFrame:
    """(by…, pos, name, key): a key for each metric, in order of pos; one that is taken gets the first free of _2, _3, …

    An empty slug is kpi. A key can only be taken by one of the same stem, which is the slug without numbers at its end. Where all
    of a stem have one slug, they are just counted; where slugs differ (a, a 2), a fold in order of pos finds the first free number.
    """
    by = by or []
    keyed = names.select(*by, "pos", "name", F.coalesce(F.nullif(slug, F.lit("")), F.lit("kpi")).alias("slug"))
    keyed = keyed.withColumn("stem", F.regexp_replace("slug", r"(_\d+)+$", ""))
    mixed = keyed.groupBy(*by, "stem").agg((F.min("slug") != F.max("slug")).alias("mixed"))
    keyed = keyed.join(mixed, [*by, "stem"])
    nth = F.row_number().over(Window.partitionBy(*by, "slug").orderBy("pos"))
    plain = keyed.where("not mixed").withColumn("nth", nth)
    plain = plain.select(*by, "pos", "name", F.when(F.col("nth") > 1, F.concat_ws("_", "slug", F.col("nth").cast("string"))).otherwise(F.col("slug")).alias("key"))

    def step(taken: Column, row: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda i: F.concat_ws("_", row["slug"], i.cast("string")))
        return F.concat(taken, F.array(F.element_at(F.array_except(F.concat(F.array(row["slug"]), numbered), taken), 1)))

    rows = keyed.where("mixed").groupBy(*by, "stem").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "slug"))).alias("rows"))
    found = rows.withColumn("keys", F.aggregate("rows", F.array().cast("array<string>"), step))
    folded = found.select(*by, F.explode(F.arrays_zip("rows", "keys")).alias("x")).select(*by, "x.rows.pos", "x.rows.name", F.col("x.keys").alias("key"))
    return plain.unionByName(folded)


def illegal_moves(states: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, place, state, to): where the states of a note, in order, take a step that no note may take; place counts from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = states.select(key, F.row_number().over(w).alias("place"), F.lag("state").over(w).alias("state"), F.col("state").alias("to"))
    return steps.where(F.col("state").isNotNull() & ~can_move(F.col("state"), F.col("to")))
