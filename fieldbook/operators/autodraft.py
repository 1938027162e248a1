"""Drafting notes from evidence: catalogue names found in texts, measured rows and work texts, and records of other periods.

An entry of evidence is (project, note_id, start, end, n, id, kind, content): the note it is drafted for, that note's period, its
place among the note's entries, and the evidence itself. What is drafted are rows (project, note_id, section, n, evidence, key,
text, metric_key, value, unit, condition): section is work or metrics, and key makes two rows of a note the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions import text as tx
from fieldbook.functions.dates import parse_iso
from fieldbook.functions.numbers import to_number
from fieldbook.operators.draft import contained, first_name, first_wins, merge_key
from fieldbook.operators.joins import broadcast_if_small, kept
from fieldbook.operators.lifecycle import SLOT
from fieldbook.operators.seal import note_id

# A record's leading date, the endings of a sentence, and a remark in brackets at its end.
DATE_PREFIX = r"^(\d{4}-\d{2}-\d{2})\s*[—–\-:,.]?\s*"
SENTENCE_END = r"(다|료|음|됨)\.?$"
REMARK = r"\s*\([^)]*\)\.?$"
ROW = ["project", "note_id", "section", "n", "evidence", "key", "text", "metric_key", "value", "unit", "condition"]


def entry_date(content: Column) -> Column:
    """The date a record begins with: the first field of ``date,name,value,unit`` rows, or a leading date; else null."""
    return parse_iso(F.regexp_extract(F.trim(content), r"^(\d{4}-\d{2}-\d{2})", 1))


def _read(entries: DataFrame) -> DataFrame:
    """entries with what their content says: fields, csv, day, stamp, body, number, and the keys cname and text_id of what is to be looked up."""
    raw = F.regexp_replace(F.coalesce("content", F.lit("")), rf"^{tx.SPACE}+|{tx.SPACE}+$", "")
    field = lambda k: F.trim(F.get("fields", F.lit(k)))
    e = entries.withColumn("raw", raw).withColumns({"fields": F.split("raw", ","), "stamp": F.regexp_extract("raw", DATE_PREFIX, 1)})
    e = e.withColumns({"day": parse_iso(field(0)), "body": F.trim(F.regexp_replace("raw", DATE_PREFIX, ""))})
    e = e.withColumn("csv", (F.size("fields") >= 4) & F.col("day").isNotNull())
    day = F.when(F.col("csv"), F.col("day")).otherwise(parse_iso(F.col("stamp")))
    e = e.withColumns({"day": day, "number": F.when(F.col("csv"), to_number(field(2)))})
    # null for what is not looked up
    return e.withColumns({"cname": F.when(F.col("number").isNotNull(), F.nullif(field(1), F.lit(""))), "text_id": F.when(F.col("kind") == "measurement", F.sha2("body", 256))})


def look_up(entries: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the catalogue knows of entries: (cname, ckey, cunit) of names in rows, (text_id, tkey, tunit, v) of names with a number in texts."""
    names, unit = catalog.select("pos", "name"), F.coalesce("unit", F.lit(""))
    # one pass over the entries: what is asked is few names and bodies, which each of the joins below would otherwise read all entries for
    each = F.array(*[F.when(F.col(i).isNotNull(), F.struct(F.lit(i).alias("what"), F.col(i).alias("id"), F.col(t).alias("text"))) for i, t in (("cname", "cname"), ("text_id", "body"))])
    told = kept(_read(entries).select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("x.*").distinct())
    asked = told.where("what = 'cname'").select(F.col("id").alias("cname"), "text")
    by_name = first_name(asked, names, "cname", "text", both_ways=True).join(catalog.select("pos", F.col("key").alias("ckey"), unit.alias("cunit")), "pos").drop("pos")
    bodies = told.where("what = 'text_id'").select(F.col("id").alias("text_id"), F.col("text").alias("body"))
    pattern = F.concat(F.lit(r"(\d+(?:\.\d+)?)"), F.when(unit != "", F.concat(F.lit(r"\s*\Q"), unit, F.lit(r"\E"))).otherwise(""))
    in_text = contained(bodies, names, "text_id", "body").join(bodies, "text_id").join(catalog.select("pos", "key", "unit"), "pos")
    in_text = in_text.withColumn("v", to_number(F.call_function("regexp_extract", F.col("body"), pattern, F.lit(1)))).where("v is not null")
    in_text = in_text.groupBy("text_id").agg(F.min_by(F.struct(F.col("key").alias("tkey"), unit.alias("tunit"), "v"), "pos").alias("x")).select("text_id", "x.*")
    return kept(by_name), kept(in_text)


def draft(entries: DataFrame, catalog: DataFrame, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """ROW for all that a draft takes from the entries, and for what adds no text, with the reason as its section.

    * ``date,name,value,unit,condition`` of a catalogue name (equal, or one within the other) is a row of metrics.
    * Other measurements that contain a catalogue name and a number with its unit are one too, the first such name winning.
    * A sentence of ten characters or more is a text of work, its date before it and its evidence after it.

    Records dated outside the note's period (if it has one) are off_period, wording that is not allowed is forbidden, and
    what is no sentence non_sentence. Of equal rows of a note the first stays. Texts are compared without
    white space, metrics by key, value and date. catalog: pos, key, name, unit. Equal names and bodies are looked up once; found is
    what look_up gave for these entries or for more.
    """
    return _first(_drafted(entries, found or look_up(entries, catalog))).select(ROW)


def _first(rows: DataFrame) -> DataFrame:
    """The first of what a note's draft counts as the same."""
    return first_wins(rows, ["project", "note_id", "section", "same"], ["n"])


def _drafted(entries: DataFrame, found: tuple[DataFrame, DataFrame], *more: str) -> DataFrame:
    """ROW, same and more (columns that all entries of a note share) for everything that a draft takes or passes over, equal rows too."""
    by_name, in_text = map(broadcast_if_small, found)
    field = lambda k: F.trim(F.get("fields", F.lit(k)))
    off = F.coalesce((F.col("day") < F.col("start")) | (F.col("day") > F.col("end")), F.lit(False))
    e = _read(entries).withColumn("off", off)
    e = e.withColumns({c: F.when(~F.col("off"), F.col(c)) for c in ("cname", "text_id")})
    # keys of their own where there is nothing to look up: nulls would meet in one task
    own = F.concat(F.lit("\n"), F.col("project").cast("string"), F.lit(" "), F.col("n").cast("string"))
    wide = e.withColumns({"cname": F.coalesce("cname", own), "text_id": F.coalesce("text_id", own)}).join(by_name, "cname", "left").join(in_text, "text_id", "left")

    is_row = F.col("ckey").isNotNull()
    core = F.regexp_replace("body", REMARK, "")
    is_sentence = (F.length(core) >= 10) & ~F.startswith("body", F.lit("[")) & core.rlike(SENTENCE_END)
    date = F.when(is_row, field(0)).otherwise(F.nullif("stamp", F.lit("")))
    said = F.when(is_row & (F.coalesce(field(4), F.lit("")) != ""), field(4)).when(date.isNotNull(), F.concat(F.lit("Measured "), date)).otherwise("")
    value, key = F.when(is_row, F.col("number")).otherwise(F.col("v")), F.when(is_row, F.col("ckey")).otherwise(F.col("tkey"))
    none = lambda t: F.lit(None).cast(t)
    measured = F.struct(
        F.lit("metrics").alias("section"), F.concat_ws("|", key, value.cast("string"), F.coalesce(date, F.lit(""))).alias("same"), F.concat_ws("|", key, value.cast("string"), said).alias("key"),
        none("string").alias("text"), key.alias("metric_key"), value.alias("value"), F.when(is_row, F.col("cunit")).otherwise(F.col("tunit")).alias("unit"), said.alias("condition"),
    )
    line = F.concat(F.when(F.col("stamp") != "", F.concat("stamp", F.lit(" "))).otherwise(""), F.regexp_replace("body", r"\.$", ""), F.lit(" ["), F.col("id"), F.lit("]."))
    rest = [none("string").alias("metric_key"), none("double").alias("value"), none("string").alias("unit"), none("string").alias("condition")]
    work = F.struct(F.lit("work").alias("section"), F.concat("stamp", F.lit("|"), F.regexp_replace("body", r"\s+", "")).alias("same"), merge_key(line).alias("key"), line.alias("text"), *rest)
    passed = lambda why: F.struct(F.lit(why).alias("section"), F.concat("id", F.lit(" "), F.col("n").cast("string")).alias("same"), none("string").alias("key"), none("string").alias("text"), *rest)
    text = F.when(F.col("off"), passed("off_period")).when(is_row, F.lit(None)).when(~is_sentence, passed("non_sentence")).when(tx.forbidden_rule(F.col("body")).isNotNull(), passed("forbidden")).otherwise(work)
    each = wide.select("project", "note_id", "n", F.col("id").alias("evidence"), *more, F.explode(F.filter(F.array(F.when(key.isNotNull(), measured), text), lambda x: x.isNotNull())).alias("x"))
    return each.select("project", "note_id", "n", "evidence", *more, "x.*")


def add_rows(rows: DataFrame, drafted: DataFrame) -> DataFrame:
    """The drafted rows that their notes lack, one of each key: adding them a second time adds nothing."""
    at = ["project", "note_id", "section", "key"]
    there = broadcast_if_small(rows.select(at).distinct())
    return first_wins(drafted, at, ["n", "evidence"]).join(there, at, "left_anti").select(drafted.columns)


def redirect(entries: DataFrame, notes: DataFrame, sprints: DataFrame, rows: DataFrame, catalog: DataFrame, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows to add (ROW, and created) for entries dated outside their note's period, in the notes of the sprints they belong to.

    A sprint's note is the last revision in its slot; sealed notes take nothing, and where there is none one is
    created, which created says. Records whose date lies in no sprint of the project are left out. Rows that the target notes have already
    (rows: project, note_id, section, key) are not added again, so a second run adds nothing. notes: project, note_id,
    revision, state; sprints: project, seq, start, end, of equal length but the last; found: see draft.

    Entries meet their project alone, with its slots as one map, and stay where they have met it: whatever comes after goes by project too.
    """
    step = F.max(F.datediff("end", "start") + 1)
    grid = sprints.groupBy("project").agg(F.min("start").alias("zero"), step.alias("step"), F.max("end").alias("last"))
    held = notes.where("note_id is not null").groupBy("project", F.left("note_id", F.lit(SLOT)).alias("slot")).agg(F.max(F.struct("revision", "state", "note_id")).alias("x"))
    held = held.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("held"))
    # day and slot are exploded from one element: as columns they would be made anew in every condition and below every join
    off = F.filter(F.array(entry_date(F.col("content"))), lambda d: ((d < F.col("start")) | (d > F.col("end"))) & d.between(F.col("zero"), F.col("last")))
    entry = ["project", "n", "id", "kind", "content", "held"]
    placed = entries.join(grid.join(held, "project", "left"), "project").select(*entry, "zero", "step", "last", F.explode(off).alias("day"))
    # a record's sprint, and so its slot, is arithmetic: sprints are never joined
    start = F.date_add("zero", F.floor(F.datediff("day", "zero") / F.col("step")).cast("int") * F.col("step"))
    end = F.least(F.date_add(start, F.col("step") - 1), F.col("last"))
    slot = F.struct(start.alias("start"), end.alias("end"), note_id(start, end, F.lit(0)).alias("slot"))
    moved = placed.select(*entry, F.explode(F.array(slot)).alias("at")).select(*entry, "at.*")
    moved = moved.withColumn("x", F.try_element_at("held", F.col("slot"))).where("x is null or x.state <> 'sealed'")
    moved = moved.withColumns({"note_id": F.coalesce("x.note_id", "slot"), "created": F.col("x").isNull()})
    drafted = _drafted(moved.select("project", "note_id", "start", "end", "n", "id", "kind", "content", "created"), found or look_up(entries, catalog), "created")
    return add_rows(rows, _first(drafted.where("key is not null")).select(*ROW, "created"))
