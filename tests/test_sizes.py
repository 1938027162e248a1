"""What shows only on large tables: long numbers, and plans that must not broadcast or shuffle what a project is spread to."""

from __future__ import annotations

from conftest import SF_DIR
from pyspark.sql import functions as F

from fieldbook import catalog
from fieldbook.functions import text as tx
from fieldbook.operators import analyze, draft, joins, store


def test_citations_of_long_numbers(spark):
    pairs = spark.createDataFrame([("a [E100001].", "a."), ("a [E100001] [E7].", "a [E007] [E0100001]."), ("a [E12345678901].", "b [E12345678901].")], "a string, b string")
    assert [r[0] for r in pairs.select(draft.same_citations(F.col("a"), F.col("b"))).collect()] == [False, True, True]
    assert [r[0] for r in pairs.select(tx.strip_citations(F.col("a"), "+")).collect()] == ["a .", "a .", "a ."]


def plan(spark, name):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return catalog.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def spread_last(lines):
    """Whether the first explode from the top has neither shuffle nor sort nor join above it."""
    top = next(k for k, line in enumerate(lines) if "Generate explode" in line)
    return not any(word in line for line in lines[:top] for word in ("Exchange", "Sort", "Join", "Aggregate"))


def test_month_blocks_are_spread_last(spark):
    assert spread_last(plan(spark, "month_detail"))


def test_free_slots_are_spread_last(spark):
    assert spread_last(plan(spark, "note_create"))


def test_sprints_of_packages_are_no_rows(spark):
    lines = plan(spark, "package_progress")
    assert not any("posexplode" in line for line in lines) and sum("Generate" in line for line in lines) == 1


def test_grids_are_checked_in_their_row(spark):
    lines = plan(spark, "planner_validate")
    assert sum("Exchange" in line for line in lines) == 1 and not any("Sort" in line or "Window" in line for line in lines)


def test_sprints_with_packages_are_spread_last(spark):
    assert spread_last(plan(spark, "active_packages"))


def test_requests_move_once(spark):
    assert sum("Exchange" in line for line in plan(spark, "note_signatures")) == 3


def test_line_items_are_drafted_in_one_scan(spark):
    """What the catalogue knows of them is looked up once before and kept; sprints are not joined."""
    for name in ("draft_redirect", "draft_notes"):
        assert sum("FileScan" in line and "l_shipdate" in line for line in plan(spark, name)) == 1


def test_texts_of_line_items_do_not_move(spark):
    """An item moves to its part, its order and its project before its texts are made; whatever is drafted from them stays where it is."""
    for name in ("draft_redirect", "draft_notes"):
        lines = plan(spark, name)
        top = next(k for k, line in enumerate(lines) if "Generate explode" in line)
        assert not any("Exchange" in line for line in lines[:top])


def test_lines_of_documents_are_rows(spark):
    """A line's candidates are found in a row of its own, behind words that every match holds, not in a lambda over a document's lines."""
    lines = plan(spark, "analyze_documents")
    assert sum("Generate explode" in line for line in lines) == 3
    assert not any("transform(lines" in line and "연구원" in line for line in lines)


def test_names_within_words_are_looked_for_in_distinct_words(spark):
    texts = spark.createDataFrame([("a", "the red ring, redder rings"), ("b", "ring-fence"), ("c", "RING 7x"), ("d", None)], "id string, text string")
    names = spark.createDataFrame([(1, "ring"), (2, "red ring"), (3, "7x"), (4, "g, r"), (5, "redd")], "pos int, name string")
    found = draft.contained(texts, names)
    assert sorted(map(tuple, found.collect())) == [("a", 1), ("a", 2), ("a", 4), ("a", 5), ("b", 1), ("c", 3)]
    assert sorted(map(tuple, draft.first_name(texts, names).collect())) == [("a", 1), ("b", 1), ("c", 3)]
    assert "_fb_word" in found._jdf.queryExecution().optimizedPlan().toString()


def test_plans_are_checked_in_their_row(spark):
    lines = plan(spark, "system_validate")
    assert not any("Window" in line for line in lines) and not any("posexplode" in line for line in lines)


def test_lines_of_keywords_meet_once(spark):
    assert sum("Exchange hashpartitioning" in line for line in plan(spark, "keyword_top10")) == 2


def test_writes_are_sorted_once(spark):
    assert sum("Sort [" in line for line in plan(spark, "writes_applied")) == 2


def test_equal_writes_apply_once(spark):
    stored = spark.createDataFrame([("a", 3, "x")], "path string, rev long, body string")
    writes = spark.createDataFrame([("a", 3, "1", "w", "y")] * 3 + [("a", None, None, "w", "z"), ("b", 1, "0", "v", "q")], "path string, base long, at string, writer string, body string")
    after, tried = store.compare_and_set(stored, writes)
    assert sorted((r.path, r.base is None, r.applied) for r in tried.collect()) == [("a", False, False)] * 3 + [("a", True, True), ("b", False, False)]
    assert [tuple(r) for r in store.compare_and_set(stored, writes.where("base = 3"))[0].collect()] == [("a", 4, "y")] and after.count() == 1


def test_dates_of_a_range_are_read_once(spark):
    found = catalog.QUERIES["extract_period"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("gettimestamp(") == 3


def test_notes_are_made_once_for_all_gates(spark):
    """The gates read the kept notes; the table of events is scanned for the ledger alone."""
    assert sum("FileScan" in line for line in plan(spark, "gate_run_notes")) == 1


def test_lines_are_searched_for_hangul_and_years_once(spark):
    """Every Korean pattern asks a column of the line, and names of agencies are looked for as words, not by a pattern over each line."""
    lines = plan(spark, "analyze_documents")
    found = next(line for line in lines if "Generate explode" in line and "연구원" in line)
    assert ", [가-힣])" not in found and r", \d{4}[.\-/년])" not in found and ", 산업통상자원부|" not in found
    assert sum(", [가-힣])" in line and r", \d{4}[.\-/년])" in line for line in lines) == 1


def test_a_small_analysis_is_stored_in_few_parts(spark):
    """Six tables read it: with one part for each of the shuffle's, their tasks would grow with the shuffle and not with the projects."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        lines = plan(spark, "system_generate")
        assert not any("InMemory" in line for line in lines)
        docs = spark.createDataFrame([(f"p{i}", 0, "과제명: 하나의 과제") for i in range(100)], "project string, di int, text string")
        assert joins.kept(analyze.analyse(docs)).rdd.getNumPartitions() < 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
