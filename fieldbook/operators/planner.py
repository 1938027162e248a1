"""The calendar of a project: sprints, month blocks, work packages on them, and validity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.dates import clamp_date, month_span


def sprint_grid(projects: DataFrame, step: int = 14) -> DataFrame:
    """(project, seq, start, end): [start, end] tiled by steps of whole days, the last one clipped."""
    days = F.sequence("start", "end", F.expr(f"interval {step} day"))
    tiles = projects.where("end >= start").select("project", F.col("end").alias("last"), F.posexplode(days).alias("n", "start"))
    return tiles.select("project", (F.col("n") + 1).alias("seq"), "start", F.least(F.date_add("start", step - 1), F.col("last")).alias("end"))


def sprint_list(start: Column, end: Column, step: int = 14) -> Column:
    """A project's sprint grid as one array of (seq, start, end); null if end comes first.

    What is computed for each sprint of a project is best computed in this array and exploded last: a grid is some hundred
    times as large as its projects, and it is then neither shuffled nor sorted nor broadcast.
    """
    tiles = F.transform(F.sequence(start, end, F.expr(f"interval {step} day")), lambda d, n: F.struct((n + 1).alias("seq"), d.alias("start"), F.least(F.date_add(d, step - 1), end).alias("end")))
    return F.when(end >= start, tiles)


def month_blocks(projects: DataFrame) -> DataFrame:
    """(project, seq, start, end): months counted from the start day, month ends clamped, the last one clipped."""
    n = projects.where("end >= start").select("project", F.col("start").alias("first"), F.col("end").alias("last"), F.explode(F.sequence(F.lit(0), month_span(F.col("start"), F.col("end")) - 1)).alias("n"))
    begin, next_ = F.add_months("first", F.col("n")), F.date_add(F.add_months("first", F.col("n") + 1), -1)
    out = n.select("project", (F.col("n") + 1).alias("seq"), begin.alias("start"), F.least(next_, F.col("last")).alias("end"), "last")
    return out.where("start <= last").drop("last")


def block_list(start: Column, end: Column) -> Column:
    """A project's month blocks as one array of (seq, start, end); null if end comes first."""
    tiles = F.transform(F.sequence(F.lit(0), month_span(start, end) - 1), lambda n: F.struct((n + 1).alias("seq"), F.add_months(start, n).alias("start"), F.least(F.date_add(F.add_months(start, n + 1), -1), end).alias("end")))
    return F.filter(tiles, lambda b: b["start"] <= end)


def assign_block(day: Column, start: Column) -> Column:
    """The 1-based month block of a day by arithmetic: no range join."""
    n = (F.year(day) - F.year(start)) * 12 + F.month(day) - F.month(start)
    return F.when(day >= start, n + F.when(day < F.add_months(start, n), 0).otherwise(1))


def resolve_period(plans: DataFrame, today: str, months: int = 24) -> DataFrame:
    """(project, start, end, source): the extracted period, else start and months, else from next month on.

    plans: project, start, end (dates or null), months (int or null).
    """
    next_month = F.add_months(F.trunc(F.lit(today).cast("date"), "month"), 1)
    span = F.when(F.col("months").between(1, 120), F.col("months")).otherwise(months)
    both = F.col("start").isNotNull() & (F.col("end") >= F.col("start"))
    half = F.col("start").isNotNull() & F.col("months").between(1, 120)
    begin = F.when(both | half, F.col("start")).otherwise(next_month)
    end = F.when(both, F.col("end")).otherwise(F.date_add(F.add_months(begin, span), -1))
    source = F.when(both, "extracted").when(half, "months").otherwise("default")
    return plans.select("project", begin.alias("start"), end.alias("end"), source.alias("source"))


def assign_sprint(day: Column, start: Column, step: int = 14) -> Column:
    """The 1-based sprint of a day by arithmetic: no range join."""
    return F.when(day >= start, F.floor(F.datediff(day, start) / step).cast("int") + 1)


def package_spans(projects: DataFrame, packages: DataFrame, step: int = 14) -> DataFrame:
    """(project, num, low, high): the first and last sprint that each package (project, num, start, end) overlaps, by arithmetic.

    Packages outside their project's sprints are left out.
    """
    period = projects.where("end >= start").select("project", F.col("start").alias("zero"), (F.floor(F.datediff("end", "start") / step) + 1).cast("int").alias("n"))
    spans = packages.where("end >= start").join(period, "project").where(f"end >= zero and start < date_add(zero, n * {step})")
    nth = lambda d: F.floor(F.datediff(d, "zero") / step).cast("int") + 1
    return spans.select("project", "num", F.greatest(nth("start"), F.lit(1)).alias("low"), F.least(nth("end"), F.col("n")).alias("high"))


def active_work_packages(projects: DataFrame, packages: DataFrame, step: int = 14) -> DataFrame:
    """(project, seq, packages): the packages that overlap each sprint of a project, by number, as one text; sprints without any are left out.

    A project's packages are one list of spans, from which the text of each of its sprints follows; sprints are exploded last.
    """
    spans = package_spans(projects, packages, step).groupBy("project").agg(F.collect_list(F.struct("num", "low", "high")).alias("spans"), F.min("low").alias("low"), F.max("high").alias("high"))
    names = lambda s: F.transform(F.array_sort(F.array_distinct(F.transform(F.filter("spans", lambda p: s.between(p["low"], p["high"])), lambda p: p["num"]))), lambda n: F.concat(F.lit("WP"), n.cast("string")))
    each = F.transform(F.sequence("low", "high"), lambda s: F.struct(s.alias("seq"), F.array_join(names(s), ",").alias("packages")))
    return spans.select("project", F.explode(each).alias("x")).select("project", "x.*").where("packages <> ''")


def normalise_packages(packages: DataFrame, projects: DataFrame) -> DataFrame:
    """Packages clamped to their project's period, the first of each number kept (by pos)."""
    w = Window.partitionBy("project", "num").orderBy("pos")
    one = packages.withColumn("_fb_n", F.row_number().over(w)).where("_fb_n = 1").drop("_fb_n")
    period = projects.select("project", F.col("start").alias("p0"), F.col("end").alias("p1"))
    start, end = F.coalesce("start", "p0"), F.coalesce("end", "p1")
    return one.join(period, "project").withColumns({"start": clamp_date(start, F.col("p0"), F.col("p1")), "end": clamp_date(end, F.col("p0"), F.col("p1"))}).drop("p0", "p1")


def validate_grid(plans: DataFrame) -> DataFrame:
    """(project, issue, n): gaps between neighbours, a first or last day that misses the period, days that do not add up.

    plans: project, start, end, sprints, the project's grid as an array of (seq, start, end). A project is checked in its own row, without sort or shuffle.
    """
    s = F.col("s")
    gap = F.size(F.filter(F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.size(s)), lambda a, b: F.date_add(a["end"], 1) != b["start"]), lambda x: x)).cast("long")
    days = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.datediff(x["end"], x["start"]) + 1)
    none = F.array().cast("array<struct<seq:int,start:date,end:date>>")
    ends = lambda c, how: how(F.transform("s", lambda x: x[c]))
    once = F.lit(1).cast("long")
    forward = F.col("end") >= F.col("start")
    missing = lambda bad: F.when(forward & F.coalesce(bad, F.lit(True)), once)
    found = F.array(*[
        F.struct(F.lit(name).alias("issue"), n.alias("n"))
        for name, n in (
            ("gap", F.when(gap > 0, gap)), ("start", missing(ends("start", F.array_min) != F.col("start"))), ("end", missing(ends("end", F.array_max) != F.col("end"))),
            ("days", missing(days != F.datediff("end", "start") + 1)), ("order", F.when(F.col("end") < F.col("start"), once)),
        )
    ])
    sorted_ = plans.select("project", "start", "end", F.array_sort(F.coalesce("sprints", none)).alias("s"))
    return sorted_.select("project", F.explode(F.filter(found, lambda x: x["n"].isNotNull())).alias("x")).select("project", "x.*")


def normalise_milestones(milestones: DataFrame, projects: DataFrame, most: int = 24) -> DataFrame:
    """(project, id, name, month, date, moved): the first of each id (by pos), dated to the end of its project month.

    A month beyond the project's is moved to its last day, which moved says; one that is null or below 1 has no date. A
    project keeps its first ``most`` milestones.
    """
    one = milestones.groupBy("project", "id").agg(F.min_by(F.struct("pos", "name", "month"), "pos").alias("x")).select("project", "id", "x.*")
    nth = F.row_number().over(Window.partitionBy("project").orderBy("pos"))
    period = projects.select("project", "start", "end", month_span(F.col("start"), F.col("end")).alias("months"))
    wide = one.withColumn("nth", nth).where(F.col("nth") <= most).join(period, "project")
    beyond = F.col("month") > F.col("months")
    day = F.when(beyond, F.col("end")).when(F.col("month") >= 1, F.least(F.date_add(F.add_months("start", F.col("month")), -1), F.col("end")))
    return wide.select("project", "id", F.left(F.coalesce("name", "id"), F.lit(120)).alias("name"), "month", day.alias("date"), F.coalesce(beyond, F.lit(False)).alias("moved"))


def normalise_kpis(kpis: DataFrame, keys: DataFrame, most: int = 60) -> DataFrame:
    """(project, pos, key, name, unit, target, direction) of kpis (project, pos, name, unit, target as text, direction) with their keys.

    A target is the number in its text, if there is one; any direction but lower is higher. A project keeps its first ``most``.
    """
    nth = F.row_number().over(Window.partitionBy("project").orderBy("pos"))
    digits = F.regexp_extract(F.regexp_replace(F.coalesce("target", F.lit("")), r"[^\d.\-]", ""), r"^-?(\d+\.?\d*|\.\d+)", 0)
    one = kpis.withColumn("nth", nth).where(F.col("nth") <= most).join(keys.select("project", "pos", "key"), ["project", "pos"])
    cut = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n)).alias(c)
    return one.select("project", "pos", "key", cut("name", 120), cut("unit", 20), F.nullif(digits, F.lit("")).try_cast("double").alias("target"), F.when(F.col("direction") == "lower", "lower").otherwise("higher").alias("direction"))


def validate_system(projects: DataFrame, sprints: DataFrame, months: DataFrame, milestones: DataFrame, packages: DataFrame, metrics: DataFrame) -> DataFrame:
    """(project, rule, place): every rule that a project's plan breaks; all parts of a plan are brought to one row (see validate_plans).

    projects: project, start, end, months. sprints: project, seq, start, end, slot. months: project, seq, start, end. milestones:
    project, id, date. packages: project, num, start, end. metrics: project, key. The rules:

    * period: the dates run forward; months: their number is that of the period;
    * no_sprint, first_day, last_day, gap (or overlap) after a sprint, sprint_order, sprint_outside;
    * slot: two sprints with one note slot; sprint_id: two with one number; blocks: as many month blocks as months;
    * milestone_outside, package_outside, package_order; metric_key: two metrics with one key.
    """
    none = lambda t: F.lit(None).cast(t)
    kinds = {
        "plan": (projects, "struct<start:date,end:date,months:int>", F.struct(F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"), F.col("months").cast("int").alias("months"))),
        "sprint": (sprints, "struct<seq:int,start:date,end:date,slot:string>", F.struct(F.col("seq").cast("int").alias("seq"), "start", "end", F.col("slot").cast("string").alias("slot"))),
        "month": (months, "int", F.lit(1)),
        "milestone": (milestones, "struct<id:string,date:date>", F.struct(F.col("id").cast("string").alias("id"), "date")),
        "package": (packages, "struct<num:string,start:date,end:date>", F.struct(F.col("num").cast("string").alias("num"), "start", "end")),
        "metric": (metrics, "struct<key:string>", F.struct(F.col("key").cast("string").alias("key"))),
    }
    rows = None
    for kind, (df, _, value) in kinds.items():
        part = df.select("project", *[(value if k == kind else none(t)).cast(t).alias(k) for k, (_, t, _) in kinds.items()])
        rows = part if rows is None else rows.unionByName(part)
    lists = {"sprints": "sprint", "milestones": "milestone", "packages": "package", "metrics": "metric"}
    whole = rows.groupBy("project").agg(F.max("plan").alias("plan"), F.count("month").alias("blocks"), *[F.collect_list(k).alias(c) for c, k in lists.items()]).where("plan is not null")
    return validate_plans(whole.select("project", "plan.*", "blocks", *lists))


def _twice(values: Column) -> Column:
    """Each value that is there twice or more, once; null is a value."""
    v = F.sort_array(values)
    return F.when(F.size(F.array_distinct(v)) < F.size(v), F.array_distinct(F.filter(v, lambda x, i: (i > 0) & x.eqNullSafe(F.get(v, i - 1))))).otherwise(F.array().cast("array<string>"))


def validate_plans(plans: DataFrame) -> DataFrame:
    """(project, rule, place): the rules of validate_system, each plan checked in its own row, without sort or shuffle.

    plans: project, start, end, months, blocks (how many month blocks), and arrays, null if empty: sprints (seq, start, end, slot),
    milestones (id, date), packages (num as text, start, end), metrics (key).
    """
    rule = lambda name, place: F.struct(F.lit(name).alias("rule"), place.alias("place"))
    broken = lambda cond, name, place: F.when(cond, rule(name, place))
    those = lambda items, check: F.array_compact(F.flatten(F.transform(items, lambda x, i: F.array(*check(x, i)))))
    start, end, at = F.col("start"), F.col("end"), F.lit("")
    outside = lambda a, b: (a < start) | (b > end)
    sid = lambda seq: F.concat(F.lit("S"), F.lpad(seq.cast("string"), 2, "0"))
    wp = lambda p: F.concat(F.lit("WP"), p["num"])
    span = month_span(start, end)
    numbered = F.filter("s", lambda x: x["seq"].isNotNull())
    first, last = F.try_element_at(numbered, F.lit(1))["start"], F.try_element_at(numbered, F.lit(-1))["end"]

    def sprint(x: Column, i: Column) -> list[Column]:
        before = F.get("s", i - 1)
        return [broken((i > 0) & (F.date_add(before["end"], 1) != x["start"]), "gap", sid(before["seq"])), broken(x["start"] > x["end"], "sprint_order", sid(x["seq"])), broken(outside(x["start"], x["end"]), "sprint_outside", sid(x["seq"]))]

    of_plan = F.array_compact(F.array(
        broken(F.coalesce(start > end, F.lit(True)), "period", at), broken(~F.col("months").eqNullSafe(span) & (start <= end), "months", at),
        broken(F.size("s") == 0, "no_sprint", at), broken(first != start, "first_day", at), broken(last != end, "last_day", at), broken(F.col("blocks") != span, "blocks", at),
    ))
    twice = lambda c, field, name, place=lambda x: x: F.transform(_twice(F.transform(c, lambda x: x[field].cast("string"))), lambda x: rule(name, place(x)))
    found = F.concat(
        of_plan, those("s", sprint), twice("s", "slot", "slot"), twice("s", "seq", "sprint_id", sid),
        those("milestones", lambda x, i: [broken(outside(x["date"], x["date"]), "milestone_outside", x["id"])]),
        those("packages", lambda x, i: [broken(outside(x["start"], x["end"]), "package_outside", wp(x)), broken(x["start"] > x["end"], "package_order", wp(x))]),
        twice("metrics", "key", "metric_key"),
    )
    empty = {"sprints": "seq:int,start:date,end:date,slot:string", "milestones": "id:string,date:date", "packages": "num:string,start:date,end:date", "metrics": "key:string"}
    full = plans.select("project", "start", "end", "months", "blocks", *[F.coalesce(c, F.array().cast(f"array<struct<{t}>>")).cast(f"array<struct<{t}>>").alias(c) for c, t in empty.items()])
    return full.withColumn("s", F.sort_array("sprints")).select("project", F.explode(found).alias("x")).select("project", "x.rule", "x.place")
