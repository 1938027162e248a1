"""Read-side roll-ups over notes, sprints, work packages and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.dates import clamp_date
from fieldbook.operators.planner import assign_block, block_list


def state_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("state").agg(F.count("*").alias("notes"), F.countDistinct("project").alias("projects"))


def month_rollup(notes: DataFrame) -> DataFrame:
    """(month, notes, sealed): notes by the month their period starts in."""
    return notes.groupBy(F.trunc("start", "month").alias("month")).agg(F.count("*").alias("notes"), F.count_if(F.col("state") == "sealed").alias("sealed"))


def package_progress(spans: DataFrame, notes: DataFrame) -> DataFrame:
    """(project, package, sprints, sealed_sprints, notes): how many of a package's sprints have a sealed note.

    spans: project, num, low, high, the sprints of each package (planner.package_spans); notes: project, sprint, state. A project's notes are counted by
    sprint and meet its packages as one list, so the sprints of a package are never rows.
    """
    per = notes.where("sprint is not null").groupBy("project", F.col("sprint").alias("seq")).agg(F.count("*").alias("n"), F.max(F.when(F.col("state") == "sealed", 1).otherwise(0)).alias("s"))
    held = per.groupBy("project").agg(F.collect_list(F.struct("seq", "n", "s")).alias("held"))
    # a number may be given twice: its sprints count once
    each = spans.groupBy("project", "num").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("low", "high")))).alias("seqs"))
    wide = each.join(held, "project", "left").withColumn("held", F.filter(F.coalesce("held", F.array().cast("array<struct<seq:int,n:bigint,s:int>>")), lambda h: F.array_contains("seqs", h["seq"])))
    zero = F.lit(0).cast("long")
    total = lambda c: F.aggregate("held", zero, lambda acc, h: acc + h[c])
    return wide.select("project", F.concat(F.lit("WP"), F.col("num").cast("string")).alias("package"), F.size("seqs").cast("long").alias("sprints"), total("s").alias("sealed_sprints"), total("n").alias("notes"))


def month_detail(projects: DataFrame, notes: DataFrame, milestones: DataFrame, step: int = 14) -> DataFrame:
    """(project, month, sprints, notes, sealed, milestones) for every month block of a project (project, start, end).

    Sprints count in each block they overlap, notes in the block their period starts in, milestones (project, month,
    name) by number. Sprints tile a project in equal steps but the last, so those of a block, and the block of a note, are arithmetic. Counts
    go to their project as one map; only then is a project spread to its blocks, so no block is shuffled or broadcast.
    """
    period = projects.where("end >= start").select("project", "start", "end")
    starts = notes.select("project", F.col("start").alias("day"), (F.col("state") == "sealed").cast("long").alias("s")).join(period, "project").where("day between start and end")
    written = starts.groupBy("project", assign_block(F.col("day"), F.col("start")).alias("month")).agg(F.count("*").alias("n"), F.sum(F.coalesce("s", F.lit(0).cast("long"))).alias("s"))
    stones = milestones.where("month is not null").groupBy("project", "month").agg(F.count("*").alias("n"))
    mapped = lambda df, value, name: df.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct(F.col("month").cast("int"), value))).alias(name))
    wide = period.join(mapped(written, F.struct("n", "s"), "written"), "project", "left").join(mapped(stones, F.col("n"), "stones"), "project", "left")
    nth = lambda d: F.floor(F.datediff(d, "start") / step)
    zero = F.lit(0).cast("long")

    def counts(b: Column) -> Column:
        of = F.try_element_at("written", b["seq"])
        return F.struct(
            b["seq"].alias("month"), (nth(b["end"]) - nth(b["start"]) + 1).alias("sprints"), F.coalesce(of["n"], zero).alias("notes"), F.coalesce(of["s"], zero).alias("sealed"),
            F.coalesce(F.try_element_at("stones", b["seq"]), zero).alias("milestones"),
        )

    return wide.select("project", F.explode(F.transform(block_list(F.col("start"), F.col("end")), counts)).alias("x")).select("project", "x.*")


def upcoming_milestones(milestones: DataFrame, today: str, most: int = 4) -> DataFrame:
    """(project, nth, name, date): of each project the first milestones in stored order (pos) that are not past."""
    nth = F.row_number().over(Window.partitionBy("project").orderBy("pos"))
    ahead = milestones.where(F.col("date") >= F.lit(today).cast("date")).withColumn("nth", nth)
    return ahead.where(F.col("nth") <= most).select("project", "nth", "name", "date")


def newest_evidence(ledger: DataFrame, order: list[str], most: int = 300) -> DataFrame:
    """The newest entries of a ledger for a pick list, as many as the list shows; sorted and cut in each task first."""
    return ledger.orderBy(*[F.desc(c) for c in order]).limit(most)


def dashboard(notes: DataFrame, actuals: DataFrame, ledger: DataFrame) -> DataFrame:
    """(measure, value): notes in all and by state, metric keys with values, evidence by kind."""
    named = lambda df, col, prefix: df.groupBy(F.concat(F.lit(prefix), F.col(col)).alias("measure")).agg(F.count("*").alias("value"))
    total = notes.agg(F.count("*").alias("value")).select(F.lit("notes").alias("measure"), "value")
    keys = actuals.agg(F.countDistinct("key").alias("value")).select(F.lit("measured_keys").alias("measure"), "value")
    return total.unionByName(named(notes, "state", "notes_")).unionByName(keys).unionByName(named(ledger, "kind", "evidence_"))


def project_dashboard(projects: DataFrame, sprints: DataFrame, notes: DataFrame, milestones: DataFrame, flags: DataFrame, today: str, most: int = 6) -> DataFrame:
    """(project, elapsed, sprints, sealed, awaiting, current, next, flags): what each project's first page shows.

    current is the sprint of the day, null outside the project; next the first milestone (date, name) that is not past; flags the first
    ``most`` in order of their text. sprints: project, seq, start, end; notes: project, state; milestones: project, name, date; flags:
    project, flag. All parts come together in one union and one aggregate.
    """
    day = F.lit(today).cast("date")
    none = {"sprint": "int", "seq": "int", "state": "string", "date": "date", "name": "string", "flag": "string"}
    row = lambda **c: [F.col("project"), *[(c[k] if k in c else F.lit(None)).cast(t).alias(k) for k, t in none.items()]]
    parts = sprints.select(row(sprint=F.col("seq"), seq=F.when(day.between(F.col("start"), F.col("end")), F.col("seq")))).unionByName(notes.select(row(state=F.col("state"))))
    ahead = milestones.where(F.col("date") >= day)
    parts = parts.unionByName(ahead.select(row(date=F.col("date"), name=F.col("name")))).unionByName(flags.select(row(flag=F.col("flag"))))
    found = parts.groupBy("project").agg(
        F.count("sprint").alias("sprints"), F.count_if(F.col("state") == "sealed").alias("sealed"), F.count_if(F.col("state") == "awaiting_sign").alias("awaiting"), F.max("seq").alias("current"),
        F.min(F.when(F.col("date").isNotNull(), F.struct("date", "name"))).alias("next"), F.slice(F.array_sort(F.collect_set("flag")), 1, most).alias("flags"),
    )
    out = elapsed_percent(projects, today).join(found, "project", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("sprints", "sealed", "awaiting")]
    return out.select("project", "elapsed", *counts, "current", "next", F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))


def elapsed_percent(projects: DataFrame, today: str) -> DataFrame:
    day = F.lit(today).cast("date")
    total = F.datediff("end", "start") + 1
    done = F.greatest(F.least(F.datediff(day, "start") + 1, total), F.lit(0))
    return projects.select("project", F.floor(done / total * 100 + 0.5).cast("long").alias("elapsed"))


def metric_status(latest: DataFrame, catalog: DataFrame) -> DataFrame:
    """(key, value, status): achieved, in_progress, measuring (no target) or no_data, for every catalogue row."""
    wide = catalog.select("key", "target", "direction").join(latest.select(F.col("metric_key").alias("key"), "value"), "key", "left")
    met = F.when(F.col("direction") == "lower", F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    status = F.when(F.col("value").isNull(), "no_data").when(F.col("target").isNull(), "measuring").when(met, "achieved").otherwise("in_progress")
    return wide.select("key", F.round("value", 4).alias("value"), status.alias("status"))


def sprint_evidence(ledger: DataFrame, start: str, step: int = 14) -> DataFrame:
    """(sprint, evidence, kinds): evidence a sprint, by arithmetic on its day."""
    seq = F.floor(F.datediff("day", F.lit(start).cast("date")) / step).cast("int") + 1
    return ledger.where(F.col("day") >= F.lit(start).cast("date")).groupBy(seq.alias("sprint")).agg(F.count("*").alias("evidence"), F.countDistinct("kind").alias("kinds"))


def chart_axis(actuals: DataFrame, key: str = "metric_key", value: str = "value", pad: float = 0.12) -> DataFrame:
    """(key, low, high): value ranges with padding for a chart's axis."""
    ends = actuals.groupBy(key).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    gap = (F.col("b") - F.col("a")) * pad
    return ends.select(key, F.round(F.col("a") - gap, 4).alias("low"), F.round(F.col("b") + gap, 4).alias("high"))


def backup_due(days: DataFrame, today: str, after: int = 30) -> DataFrame:
    since = F.datediff(F.lit(today).cast("date"), "last_backup")
    return days.select("project", since.alias("days"), F.coalesce(since >= after, F.lit(True)).alias("due"))


def view_range(start: Column, end: Column, today: Column, preset: str) -> Column:
    """(start, end) of a view of a period: all, year (this one), past12 months or next6, clamped into the period."""
    year = F.trunc(today, "year")
    wanted = {"all": (start, end), "year": (year, F.date_add(F.add_months(year, 12), -1)), "past12": (F.date_sub(today, 365), today), "next6": (today, F.date_add(today, 183))}[preset]
    return F.struct(*[clamp_date(d, start, end).alias(name) for d, name in zip(wanted, ("start", "end"))])


def axis_ticks(start: Column, end: Column, most: int = 430) -> Column:
    """The days inside a view that an axis marks: firsts of months up to ``most`` days, else firsts of years; the view's first day is none."""
    unit = lambda u: F.filter(F.sequence(F.trunc(start, u), F.trunc(end, u), F.expr(f"interval 1 {u}")), lambda d: (d > start) & (d <= end if u == "month" else d < end))
    return F.when(F.datediff(end, start) + 1 <= most, unit("month")).otherwise(unit("year"))


def notes_list(notes: DataFrame) -> DataFrame:
    """(project, place, note_id, start, end, revised, state): each project's notes, the greatest id first; revised is the number of a revision."""
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("note_id"), "state"))
    return notes.select("project", place.alias("place"), "note_id", "start", "end", F.when(F.col("revision") > 0, F.col("revision")).alias("revised"), "state")


def new_uploads(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (name, size, at, …) that are not known yet by name and size, the first of equal ones."""
    nth = F.row_number().over(Window.partitionBy("name", "size").orderBy("at"))
    return files.withColumn("_fb_n", nth).where("_fb_n = 1").drop("_fb_n").join(known.select("name", "size"), ["name", "size"], "left_anti")


def file_references(files: DataFrame) -> DataFrame:
    """(name, kind, content): one entry of evidence for each file that gave no text, for the file as a whole."""
    bare = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == ""
    return files.where(bare).select("name", F.lit("reference").alias("kind"), F.concat(F.lit("file as a whole: "), "name").alias("content"))


def evidence_of_notes(evidence: DataFrame, attached: DataFrame) -> DataFrame:
    """Uploaded evidence (project, source_type, source_file, kind, …) whose file is attached (project, name) to a note; references aside."""
    names = attached.select("project", F.col("name").alias("source_file")).distinct()
    return evidence.where("source_type = 'upload' and kind <> 'reference'").join(names, ["project", "source_file"], "left_semi")


def oversized(files: DataFrame, group: str, most: int) -> DataFrame:
    """(group, bytes, files): groups of files whose declared sizes add up to more than allowed."""
    return files.groupBy(group).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files")).where(F.col("bytes") > most)
