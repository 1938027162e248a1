"""Chains sealed in steps, revisions, keys, plans, and tables kept with revisions."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from fieldbook.functions.hashing import fields_hash
from fieldbook.functions.text import slug
from fieldbook.operators import lifecycle, planner, sealing, store

NOTE = f"project string, note_id string, start date, end date, revision int, supersedes string, state string, author string, body string, content_sha256 string, signatures {sealing.SIGNATURES}, history {sealing.HISTORY}, prev_seal string, seal string, chain_pos long"


def expected():
    return fields_hash(F.col("note_id"), F.col("body"))


def notes(spark, n: int = 12, projects: str = "pq"):
    rows = [(p, f"N{k:02}", date(2026, 1, 1), date(2026, 1, 14), 0, None, "awaiting_sign", "kim", f"text {k}", None, [("kim", "contributor", f"2026-01-{k + 1:02}")], [], None, None, None) for p in projects for k in range(n)]
    return spark.createDataFrame(rows, NOTE).withColumn("content_sha256", expected())


def approvals(df, keep="true"):
    return df.where(keep).select("project", "note_id", F.lit("lee").alias("approver"), F.concat(F.lit("2026-02-"), F.substring("note_id", 2, 2)).alias("at"))


def seals(df) -> dict:
    return {(r.project, r.note_id): (r.seal, r.prev_seal, r.chain_pos) for r in df.where("state = 'sealed'").collect()}


def test_sealing_in_steps_equals_sealing_at_once(spark):
    df = notes(spark)
    once = sealing.seal_notes(df, approvals(df), expected())
    steps = df
    for low, high in ((0, 3), (3, 4), (4, 12)):
        steps = sealing.seal_notes(steps, approvals(df, f"int(substring(note_id, 2, 2)) >= {low} and int(substring(note_id, 2, 2)) < {high}"), expected()).drop("blocker")
        steps = spark.createDataFrame(steps.collect(), steps.schema)
    assert seals(once) == seals(steps) and len(seals(once)) == 24
    assert {tuple(r) for r in sealing.verify_seals(steps, expected()).collect()} == {("p", 12, 12, None, None), ("q", 12, 12, None, None)}
    row = steps.where("project = 'p' and note_id = 'N05'").first()
    assert row.signatures[-1].stage == "final_approval" and row.signatures[-1].signer == "lee" and row.history[-1].what == "approved and sealed" and row.chain_pos == 6
    # nothing is sealed twice
    again = sealing.seal_notes(steps, approvals(df), expected())
    assert seals(again) == seals(steps) and {r.blocker for r in again.collect()} == {"already_sealed"}


def test_blocked_notes_stay_as_they_are(spark):
    df = notes(spark, 6, "p").withColumns({"state": F.when(F.col("note_id") == "N01", "draft").when(F.col("note_id") == "N02", "rejected").otherwise(F.col("state")), "body": F.when(F.col("note_id") == "N03", "changed").otherwise(F.col("body")), "author": F.when(F.col("note_id") == "N04", "lee").otherwise(F.col("author"))})
    out = sealing.seal_notes(df, approvals(df, "note_id <> 'N05'"), expected())
    assert {r.note_id: (r.state, r.blocker) for r in out.collect()} == {"N00": ("sealed", None), "N01": ("draft", "not_checked"), "N02": ("rejected", "rejected"), "N03": ("awaiting_sign", "stale_hash"), "N04": ("awaiting_sign", "self_approval"), "N05": ("awaiting_sign", None)}
    kept = out.where("state <> 'sealed'").select(df.columns).collect()
    assert sorted(map(tuple, kept)) == sorted(map(tuple, df.where("note_id <> 'N00'").collect()))
    assert sealing.seal_notes(df.limit(0), approvals(df), expected()).count() == 0


@pytest.mark.parametrize("change,want", [("body", (4, 5, "content")), ("signatures", (4, 5, "seal")), ("prev_seal", (4, 5, "link")), ("chain_pos", (4, 5, "link"))])
def test_changes_after_sealing_are_found(spark, change, want):
    df = notes(spark, 8, "p")
    sealed = sealing.seal_notes(df, approvals(df), expected()).drop("blocker")
    eve = F.transform("signatures", lambda s: F.struct(F.lit("eve").alias("signer"), s["stage"], s["signed_at"]))
    to = {"body": F.lit("tampered"), "signatures": eve, "prev_seal": F.lit("0" * 64), "chain_pos": F.lit(40).cast("long")}[change]
    bad = sealed.withColumn(change, F.when(F.col("note_id") == "N04", to).otherwise(F.col(change)).cast(sealed.schema[change].dataType))
    out = sealing.verify_seals(bad, expected()).first()
    assert (out.checked, out.first_bad, out.fault) == want


def test_revisions_supersede(spark):
    df = notes(spark, 2, "p")
    sealed = sealing.seal_notes(df, approvals(df, "note_id = 'N00'"), expected()).drop("blocker")
    asked = spark.createDataFrame([("p", "N00", "2026-03-01", "kim"), ("p", "N00", "2026-03-02", "lee"), ("p", "N01", "2026-03-01", "kim")], "project string, note_id string, at string, by string")
    new = sealing.revise(sealed, asked).collect()
    assert [(r.note_id, r.supersedes, r.revision, r.state, r.seal, r.signatures, r.history[-1].by, r.body) for r in new] == [("RN-20260101-20260114-R1", "N00", 1, "draft", None, [], "kim", "text 0")]
    both = sealed.unionByName(spark.createDataFrame(new, sealed.schema).withColumn("content_sha256", expected()).withColumn("state", F.lit("awaiting_sign")))
    again = sealing.seal_notes(both, approvals(both.withColumn("note_id", F.col("note_id")), "note_id like 'RN%'").withColumn("at", F.lit("2026-04-01")), expected())
    assert sealing.verify_seals(again, expected()).first().checked == 2


def plain_keys(names: list[str]) -> list[str]:
    import re

    seen, out = set(), []
    for name in names:
        base = re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9가-힣]+", "_", name.lower()))[:40] or "kpi"
        key, i = base, 2
        while key in seen:
            key, i = f"{base}_{i}", i + 1
        seen.add(key)
        out.append(key)
    return out


def test_metric_keys_are_unique(spark):
    import random

    rng = random.Random(2)
    lists = [["a", "a", "a 2"], ["a 2", "a", "a"], ["!!", "", "kpi", "kpi_2"], ["x"], *[[rng.choice(["a", "A", "a 2", "a_2_2", "a 3", "수율", "b", "2"]) for _ in range(rng.randrange(12))] for _ in range(30)]]
    df = spark.createDataFrame([(p, k, n) for p, names in enumerate(lists) for k, n in enumerate(names)], "project long, pos long, name string")
    out = {(r.project, r.pos): r.key for r in lifecycle.metric_keys(df, slug(F.col("name")), ["project"]).collect()}
    for p, names in enumerate(lists):
        mine = [out[p, k] for k in range(len(names))]
        assert mine == plain_keys(names) and len(set(mine)) == len(mine)


def test_moves_that_no_note_may_take(spark):
    steps = ["draft", "advisory", "awaiting_sign", "sealed", "draft", "rejected", "sealed", None, "draft"]
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate(steps)], "note long, at long, state string")
    assert [(r.place, r.state, r.to) for r in lifecycle.illegal_moves(df, "note", ["at"]).collect()] == [(5, "sealed", "draft"), (7, "rejected", "sealed"), (8, "sealed", None)]


def system(spark):
    projects = spark.createDataFrame([(k, date(2026, 1, 10), date(2026, 4, 20), 4) for k in range(14)], "project int, start date, end date, months int")
    sprints = planner.sprint_grid(projects).withColumn("slot", F.concat(F.lit("RN-"), F.col("start").cast("string")))
    packages = projects.selectExpr("project", "1 as num", "start", "end")
    stones = projects.selectExpr("project", "'MS1' as id", "start as date")
    metrics = projects.selectExpr("project", "explode(array('a', 'b')) as key")
    return projects, sprints, planner.month_blocks(projects), stones, packages, metrics


def test_every_breach_of_a_plan_is_found_once(spark):
    projects, sprints, months, stones, packages, metrics = system(spark)
    assert planner.validate_system(projects, sprints, months, stones, packages, metrics).count() == 0
    p = F.col("project")
    projects = projects.withColumns({"months": F.when(p == 1, 5).otherwise(F.col("months"))})
    sprints = sprints.where("not (project = 2 and seq = 3) and project <> 3 and not (project = 4 and seq = 1) and not (project = 5 and seq = 8)")
    sprints = sprints.withColumns({"slot": F.when((p == 6) & (F.col("seq") == 2), "RN-2026-01-10").otherwise(F.col("slot")), "seq": F.when((p == 7) & (F.col("seq") == 8), 7).otherwise(F.col("seq"))})
    months = months.where("not (project = 8 and seq = 2)")
    stones = stones.withColumn("date", F.when(p == 9, date(2026, 4, 21)).otherwise(F.col("date")))
    packages = packages.withColumns({"start": F.when(p == 10, date(2025, 1, 1)).when(p == 11, date(2026, 4, 2)).otherwise(F.col("start")), "end": F.when(p == 11, date(2026, 4, 1)).otherwise(F.col("end"))})
    metrics = metrics.unionByName(spark.createDataFrame([(12, "a"), (12, "a")], "project int, key string"))
    sprints = sprints.withColumn("end", F.when((p == 13) & (F.col("seq") == 8), date(2026, 4, 25)).otherwise(F.col("end")))
    found = {(r.project, r.rule, r.place) for r in planner.validate_system(projects, sprints, months, stones, packages, metrics).collect()}
    assert found == {
        (1, "months", ""), (2, "gap", "S02"), (3, "no_sprint", ""), (4, "first_day", ""), (5, "last_day", ""), (6, "slot", "RN-2026-01-10"), (7, "sprint_id", "S07"), (8, "blocks", ""), (9, "milestone_outside", "MS1"),
        (10, "package_outside", "WP1"), (11, "package_order", "WP1"), (12, "metric_key", "a"), (13, "sprint_outside", "S08"), (13, "last_day", ""),
    }


def test_milestones_and_kpis_are_normalised(spark):
    projects = spark.createDataFrame([("p", date(2026, 1, 31), date(2026, 12, 31))], "project string, start date, end date")
    stones = spark.createDataFrame([("p", 0, "MS1", "first", 1), ("p", 1, "MS1", "again", 2), ("p", 2, "MS2", None, 99), ("p", 3, "MS3", "none", None), ("p", 4, "MS4", "zero", 0), ("p", 5, "MS5", "last", 12)], "project string, pos int, id string, name string, month int")
    out = {r.id: (r.name, r.date, r.moved) for r in planner.normalise_milestones(stones, projects).collect()}
    assert out == {"MS1": ("first", date(2026, 2, 27), False), "MS2": ("MS2", date(2026, 12, 31), True), "MS3": ("none", None, False), "MS4": ("zero", None, False), "MS5": ("last", date(2026, 12, 31), False)}
    kpis = spark.createDataFrame([("p", 0, "수율", "%", "≥ 95.5 %", "up"), ("p", 1, "불량", None, "none", "lower"), ("p", 2, "수율", "%", "-3", None)], "project string, pos int, name string, unit string, target string, direction string")
    keys = lifecycle.metric_keys(kpis.select("project", "pos", "name"), slug(F.col("name")), ["project"])
    assert sorted((r.pos, r.key, r.unit, r.target, r.direction) for r in planner.normalise_kpis(kpis, keys).collect()) == [(0, "수율", "%", 95.5, "higher"), (1, "불량", "", None, "lower"), (2, "수율_2", "%", -3.0, "higher")]


def test_of_two_writers_with_one_base_one_wins(spark, tmp_path):
    stored = spark.createDataFrame([("a", 3, "old"), ("b", 1, "old")], "path string, rev long, body string")
    writes = spark.createDataFrame(
        [("a", 3, "2", "x", "late"), ("a", 3, "1", "y", "first"), ("b", 0, "1", "x", "stale"), ("c", 0, "1", "x", "new"), ("c", 0, "1", "z", "too"), ("d", 2, "1", "x", "gone"), ("b", None, "9", "x", "forced")],
        "path string, base long, at string, writer string, body string",
    )
    after, outcome = store.compare_and_set(stored, writes)
    assert {tuple(r) for r in after.collect()} == {("a", 4, "first"), ("b", 2, "forced"), ("c", 1, "new")}
    assert {(r.path, r.writer, r.base, r.applied, r.found) for r in outcome.collect()} == {("a", "x", 3, False, 3), ("a", "y", 3, True, 3), ("b", "x", 0, False, 1), ("c", "x", 0, True, 0), ("c", "z", 0, False, 0), ("d", "x", 2, False, 0), ("b", "x", None, True, 1)}
    root = f"file://{tmp_path}/t"
    assert store.last_commit(spark, root) == 0 and store.publish(stored, root, 0) == 1 and store.publish(after, root, 1) == 2
    with pytest.raises(store.ConflictError):
        store.publish(stored, root, 1)
    assert {r.body for r in store.read_table(spark, root).collect()} == {"first", "forced", "new"} and store.read_table(spark, root, 1).count() == 2
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2


def test_a_restore_is_all_or_nothing(spark, tmp_path):
    files = spark.createDataFrame([("a.json", bytearray(b"one")), ("b.json", bytearray(b"two"))], "name string, content binary")
    manifest = files.select("name", F.sha2("content", 256).alias("sha256"))
    root = f"file://{tmp_path}/r"
    assert store.restore(manifest, files, root, 0) == 1
    more = files.withColumn("content", F.when(F.col("name") == "a.json", F.lit(b"changed")).otherwise(F.col("content")))
    extra = files.union(spark.createDataFrame([("c.json", bytearray(b"x"))], files.schema))
    for bad, fault in ((more, "a.json changed"), (files.limit(1), "missing"), (extra, "c.json unlisted"), (files.union(files), "a.json twice")):
        with pytest.raises(ValueError, match=fault):
            store.restore(manifest, bad, root, 1)
    assert store.last_commit(spark, root) == 1 and {bytes(r.content) for r in store.read_table(spark, root).collect()} == {b"one", b"two"}
    assert store.restore(manifest.limit(0), files.limit(0), root, 1) == 2


def test_a_replayed_batch_of_the_audit_adds_nothing(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "log")
    rows = [(f"2026-01-0{k}", "kim", "note.create" if k % 2 else "note.seal", "x" * 300) for k in range(1, 7)]
    schema = "at string, user string, action string, detail string"
    for k in range(0, 6, 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    store.append_audit(stream, root, str(tmp_path / "check")).awaitTermination()
    log = store.read_audit(spark, root)
    assert {(r.action, r.n, r.longest) for r in log.groupBy("action").agg(F.count("*").alias("n"), F.max(F.length("detail")).alias("longest")).collect()} == {("note.create", 3, 200), ("note.seal", 3, 200)}
    one = log.where("batch = 1").select("at", "user", "action", "detail").collect()
    store.audit_batch(spark.createDataFrame(one, schema), 1, root)
    assert store.read_audit(spark, root).count() == 6
    # a lost checkpoint replays all batches under their old numbers
    store.append_audit(stream, root, str(tmp_path / "check2")).awaitTermination()
    assert store.read_audit(spark, root).count() == 6


def test_sealed_notes_are_archived_by_year(spark, tmp_path):
    from fieldbook.sources import export

    df = spark.createDataFrame([("a", "sealed", date(2025, 3, 1)), ("b", "draft", date(2025, 3, 1)), ("c", "sealed", date(2026, 3, 1))], "note_id string, state string, end date")
    export.archive(df, f"file://{tmp_path}/archive")
    assert {(r.note_id, r.year) for r in spark.read.json(f"{tmp_path}/archive").collect()} == {("a", 2025), ("c", 2026)}
