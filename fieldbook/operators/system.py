"""From an analysis to a project's whole system: settled period, packages, milestones, metrics, sprints, months and note slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.dates import month_span, parse_iso
from fieldbook.functions.text import auto_code, slug
from fieldbook.operators import lifecycle, planner
from fieldbook.operators.seal import note_id

# What stands for a name that no document gave.
NO_TITLE, NO_ORG = "신규 연구 프로젝트", "(기관명 미입력)"


def _single(field: str) -> Column:
    """The value of a field that a project has once, or null."""
    return F.try_element_at(F.transform(F.filter("fields", lambda x: x["field"] == field), lambda x: x["value"]), F.lit(1))


def generate(analysis: DataFrame, today: str, step: int = 14) -> dict[str, DataFrame]:
    """Tables of the systems of all analysed projects (see analyze.analyse), by name.

    projects: project, title, code, agency, org, budget, start, end, months, source; sprints and months: project, seq, start, end, sprints with
    slot; packages: project, num, name, start, end; milestones: project, id, name, month, date, moved; metrics: project, pos, key, name,
    unit, target, direction. A period that was not found, or by its months alone, starts on the first of the month after today. Nothing is
    brought together: each table is a plan of its own over the analysis, which is best written out first.
    """
    day = F.lit(today).cast("date")
    period = _single("period")
    plans = analysis.select(
        "project", parse_iso(F.split_part(period, F.lit("~"), F.lit(1))).alias("start"), parse_iso(F.split_part(period, F.lit("~"), F.lit(2))).alias("end"),
        F.nullif(F.regexp_extract(period, r"^(\d+) months$", 1), F.lit("")).cast("int").alias("months"),
    )
    settled = planner.resolve_period(plans, today).withColumn("months", month_span(F.col("start"), F.col("end")))
    facts = analysis.select("project", F.coalesce(_single("title"), F.lit(NO_TITLE)).alias("title"), F.coalesce(_single("code"), auto_code(day)).alias("code"), F.coalesce(_single("agency"), F.lit("")).alias("agency"), F.coalesce(_single("org"), F.lit(NO_ORG)).alias("org"), _single("budget").cast("double").alias("budget"))
    projects = facts.join(settled, "project")
    periods = settled.select("project", "start", "end")

    items = analysis.select("project", F.explode("fields").alias("x")).select("project", "x.field", "x.nth", "x.key", "x.value")
    of = lambda f: items.where(F.col("field") == f)
    part = lambda k: F.split_part("value", F.lit("|"), F.lit(k))
    none = F.lit(None).cast("date")
    packages = of("packages").select("project", F.col("key").cast("int").alias("num"), F.col("nth").alias("pos"), F.col("value").alias("name"), none.alias("start"), none.alias("end"))
    stones = of("milestones").select("project", F.col("nth").alias("pos"), F.col("key").alias("id"), part(2).alias("name"), F.nullif(part(1), F.lit("")).cast("int").alias("month"))
    # an indicator's name may hold the sign that parts its fields, the other three do not
    size = F.size(F.split("value", r"\|"))
    kpis = of("kpis").select("project", F.col("nth").alias("pos"), F.array_join(F.slice(F.split("value", r"\|"), F.lit(1), size - 3), "|").alias("name"), part(-3).alias("unit"), part(-2).alias("target"), part(-1).alias("direction"))
    keys = lifecycle.metric_keys(kpis.select("project", "pos", "name"), slug(F.col("name")), ["project"])
    sprints = planner.sprint_grid(periods, step)
    return {
        "projects": projects,
        "sprints": sprints.withColumn("slot", note_id(F.col("start"), F.col("end"), F.lit(0))),
        "months": planner.month_blocks(periods),
        "packages": planner.normalise_packages(packages, periods).select("project", "num", "name", "start", "end"),
        "milestones": planner.normalise_milestones(stones, periods),
        "metrics": planner.normalise_kpis(kpis, keys),
    }


def breaches(system: dict[str, DataFrame]) -> DataFrame:
    """(project, rule, place): what a generated system breaks; nothing, if all is well."""
    return planner.validate_system(system["projects"], system["sprints"], system["months"], system["milestones"], system["packages"], system["metrics"])
