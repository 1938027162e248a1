"""Line dedup by overlapping windows of three consecutive lines.

Lines are what newline characters separate, compared exactly. Every window of ``n`` consecutive
lines that is not blank throughout is hashed to 128 bits; windows that occur more than once anywhere
are found globally; the lines of every occurrence but the first, in order of (id, text hash,
position), are covered, covered positions are merged, and covered lines are removed.

The repeated windows are written out before they are joined back, so a window that stands in a third
of all documents is pre-aggregated on the map side and its join partition can be split.

Defined cases: a null text stays null with 0 lines; a text of fewer than n lines has no window and
stays; rows that repeat id and text (a null id too) are one document and all get the same lines; a null id comes
last in the order; an empty table gives an empty one. Columns of the input named n_lines, n_removed or removed in any
case are replaced, others kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.scratch import quoted, without, written

N = 3
_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with _fb_id and _fb_th: a non-null key of (id, text)."""
    return docs.withColumns(
        {
            "_fb_id": F.coalesce(quoted(id_col).cast("long"), F.lit(_LAST)),
            "_fb_th": F.xxhash64(quoted(id_col), quoted(text_col)),
        }
    )


def _windows(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each window: its document's key, the position of its first line, and its hashes."""
    lines = F.split(quoted(text_col), "\n")
    count = F.greatest(F.size(lines) - (n - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice(lines, k + 1, count).alias(f"l{k}") for k in range(n)])
    parts = _keyed(docs.select(quoted(id_col), quoted(text_col)), id_col, text_col).select("_fb_id", "_fb_th", F.posexplode(runs).alias("pos", "win"))
    text = F.concat(*[F.col(f"win.l{k}") for k in range(n)])
    return parts.where(text.rlike(r"\S")).select("_fb_id", "_fb_th", "pos", F.xxhash64("win").alias("h1"), F.xxhash64(F.lit(7), "win").alias("h2"))


def covered_lines(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_fb_id, _fb_th, removed): for documents that lose lines, their 0-based positions, ascending."""
    found = _windows(docs, n, id_col, text_col)
    place = F.struct("_fb_id", "_fb_th", "pos")
    repeated = written(found.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1"))
    later = found.join(repeated, ["h1", "h2"]).where(place > F.col("first"))
    lines = later.select("_fb_id", "_fb_th", F.explode(F.sequence("pos", F.col("pos") + (n - 1))).alias("line"))
    return lines.groupBy("_fb_id", "_fb_th").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text left, n_lines (before), n_removed and removed (0-based line positions)."""
    covered = covered_lines(docs, n, id_col, text_col)
    base = without(docs, "n_lines n_removed removed")
    # how many documents lose lines grows with the corpus: a merge join at every size
    lines = _keyed(base, id_col, text_col).withColumn("_fb_lines", F.split(quoted(text_col), "\n")).drop(quoted(text_col))
    out = lines.join(written(covered).hint("merge"), ["_fb_id", "_fb_th"], "left")
    size = F.coalesce(F.size("_fb_lines"), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_fb_lines") - 1), "removed")
    left = F.when(F.col("removed").isNull(), F.col("_fb_lines")).otherwise(F.transform(kept, lambda i: F.element_at("_fb_lines", i + 1)))
    return out.select(
        *[(F.array_join(left, "\n").alias(c) if c == text_col else quoted(c)) for c in base.columns],
        F.when(F.col("_fb_lines").isNull(), 0).otherwise(size).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.col("removed"), F.array().cast("array<int>")).alias("removed"),
    )


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the lines it loses; a null text has no lines and loses none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed_lines"), F.sha2("text", 256).alias("text_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, i, l[i : i + 2] AS win FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)
  WHERE regexp_matches(array_to_string(l[i : i + 2], ''), '\S')),
f AS (SELECT win, min((doc_id, i)) AS first FROM w GROUP BY win HAVING count(*) > 1),
c AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list(range(w.i - 1, w.i + 2))))) AS removed
  FROM w JOIN f USING (win) WHERE (w.doc_id, w.i) > f.first GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed,
       coalesce(array_to_string(removed, ','), '') AS removed_lines,
       sha256(CASE WHEN removed IS NULL THEN text
              ELSE coalesce(array_to_string(list_transform(list_filter(range(len(l)), lambda x: NOT list_contains(removed, x)), lambda x: l[x + 1]), chr(10)), '') END) AS text_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
