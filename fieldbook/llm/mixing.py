"""Mixing sources to target weights: token totals per source, repetition rates, seeded copies.

Targets are shared by weight out of ``share`` times all tokens; a target stops at ``max_rate`` times
its source's tokens and the excess is shared again by weight until no target is above. That level is
found by a loop whose only driver data are two sums a round; it ends when no further source stops.

Each document is emitted floor(rate) times, and once more with a probability of exactly the rate's fraction f, whatever its
size. Draws that do not depend on each other would let a source of few or long documents miss its target by much. So
the further copies are drawn systematically: with a source's documents in order of size, and one seeded offset o in
[0, 1) a source, floor(f * n + o) of the first n get one. Of documents of one size, those of the smallest seeded draws do. The
offset and the draws are uniform, so each document has the chance f, and since every prefix of the order is right to
within one document, a source misses its target by less than its longest document (more only by rows that share an id).
Sizes are counted on the executors, the cut among the draws of each size is found by a distributed rank; no group is
gathered.

Defined cases: a null text has size 0; the null source is a source, last in order; a source without
tokens has target 0 and its documents are not emitted; rows that repeat an id share its draw (for a null id, rows that
repeat the text); an empty table gives an empty mix. plan_mix replaces columns of the input named like those it adds, in
any case; mix keeps all columns of the input and their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.llm.scratch import packed, quoted, ranked, unpacked, without, written

#: a table of sources or of their sizes is broadcast only if it is smaller than this
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 4 << 20
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def text_size(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(quoted(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_key(source_col: str) -> Column:
    """A join key that never is null."""
    return F.coalesce(F.concat(F.lit("="), quoted(source_col).cast("string")), F.lit("null"))


#: bits of a draw
DRAW = 52


def _number(key: Column) -> Column:
    """A whole number below 2 ** DRAW from a SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, DRAW // 4), 16, 10).cast("long")


def draw(seed: str, id_col: str, text_col: str) -> Column:
    """A document's draw."""
    key = F.coalesce(quoted(id_col).cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(quoted(text_col), F.lit("")))))
    return _number(F.concat(F.lit(seed), key))


def source_targets(docs: DataFrame, size: Column, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """One row a source: _fb_key, source_size and target. Weights repeat over the sources in code-point order, null last."""
    sums = docs.select(quoted(source_col).cast("string").alias("s"), source_key(source_col).alias("_fb_key"), size.alias("n")).groupBy("_fb_key", "s").agg(F.sum("n").alias("source_size"))
    order = ranked(sums, [F.col("s").asc_nulls_last()], "_fb_rank")
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("_fb_rank") - 1) % len(weights) + 1).cast("int"))
    sources = written(order.select("_fb_key", "source_size", pick.cast("long").alias("w")))

    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while total:
        # above the level, w * level exceeds the cap, and stays so as the level only rises
        full = F.col("w") * F.lit(level) >= F.lit(max_rate) * F.col("source_size")
        row = sources.agg(F.sum(F.when(full, F.col("source_size"))).alias("s"), F.sum(F.when(~full, F.col("w"))).alias("w"), F.count(F.when(full, 1)).alias("n")).first()
        if row.n == stopped or row.w is None:
            break
        stopped, level = row.n, (share * total - max_rate * (row.s or 0)) / row.w
    return sources.select("_fb_key", "source_size", F.least(F.col("w") * F.lit(level), F.lit(max_rate) * F.col("source_size")).alias("target"))


def _small(table: DataFrame) -> DataFrame:
    """A table of sources or sizes, broadcast if it is within the bounds."""
    bounds = table.agg(F.count("*").alias("n"), F.sum(F.octet_length("_fb_key")).alias("b")).first()
    return F.broadcast(table) if bounds.n <= BROADCAST_ROWS and (bounds.b or 0) <= BROADCAST_BYTES else table


def cuts(slim: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """(_fb_key, size, source_size, target, times, below): documents whose draw is less than below get one more copy."""
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    offset = _number(F.concat(F.lit(f"{seed}source "), "_fb_key")) / F.lit(float(1 << DRAW))
    sources = targets.withColumns({"times": F.floor(rate), "f": rate - F.floor(rate), "o": offset})
    # one row for each size of a source, so a window over its sizes holds no documents
    upto = F.sum("n").over(Window.partitionBy("_fb_key").orderBy("size"))
    sizes = slim.groupBy("_fb_key", "size").agg(F.count("*").alias("n")).withColumn("upto", upto).join(_small(sources), "_fb_key")
    more = F.floor(F.col("f") * F.col("upto") + F.col("o")) - F.floor(F.col("f") * (F.col("upto") - F.col("n")) + F.col("o"))
    sizes = written(sizes.withColumn("more", more).drop("f", "o", "upto"))
    # the last draw that gets a copy, where some do and some do not
    part = sizes.where("more > 0 and more < n").select("_fb_key", "size", "more")
    places = ranked(slim.join(_small(part.select("_fb_key", "size")), ["_fb_key", "size"]), [F.col("_fb_key"), F.col("size"), F.col("d")], "_fb_rank")
    places = written(places)
    first = places.groupBy("_fb_key", "size").agg(F.min("_fb_rank").alias("first")).join(part, ["_fb_key", "size"])
    at = first.select("_fb_key", "size", (F.col("first") + F.col("more") - 1).alias("_fb_rank"))
    last = places.join(_small(at), ["_fb_key", "size", "_fb_rank"]).select("_fb_key", "size", "d")
    below = F.when(F.col("more") == 0, 0).when(F.col("more") == F.col("n"), 1 << DRAW).otherwise(F.col("d") + 1)
    return written(sizes.join(last, ["_fb_key", "size"], "left").select("_fb_key", "size", "source_size", "target", "times", below.alias("below")))


def plan_mix(docs: DataFrame, seed: str = "mix-1:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document)."""
    slim = written(docs.select(quoted(source_col), source_key(source_col).alias("_fb_key"), text_size(text_col).alias("size"), draw(seed, id_col, text_col).alias("d")))
    found = _small(cuts(slim.select("_fb_key", "size", "d"), source_targets(slim, F.col("size"), source_col, **options), seed))
    names = {"size": text_size(text_col), "_fb_key": source_key(source_col), "_fb_d": draw(seed, id_col, text_col)}
    rows = docs.select([quoted(c) for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")] + [c.alias(n) for n, c in names.items()])
    out = rows.join(found, ["_fb_key", "size"]).withColumn("copies", F.col("times") + (F.col("_fb_d") < F.col("below")).cast("long"))
    return out.select(*[quoted(c) for c in rows.columns if c not in names], "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as planned, with its own columns."""
    roles = {"doc_id": id_col, "text": text_col, "source": source_col}
    plan = plan_mix(packed(docs, **roles), **options)
    copies = plan.where("copies > 0").withColumn("_fb_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return unpacked(copies, docs.columns, roles)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it; a null text has none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    plan = plan_mix(docs)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 2.0 * source_size / w AS stop FROM s),
levels AS (
  SELECT stop, (1.5 * (SELECT sum(source_size) FROM s)::DOUBLE - 2.0::DOUBLE * coalesce((SELECT sum(source_size) FROM r AS b WHERE b.stop < r.stop), 0)::DOUBLE)
               / (SELECT sum(w) FROM r AS a WHERE a.stop >= r.stop)::DOUBLE AS level FROM r),
pick AS (SELECT arg_min(level, stop) AS level FROM levels WHERE level <= stop),
t AS (
  SELECT source, source_size, least(w * level, 2.0::DOUBLE * source_size) AS target FROM r, pick),
c AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size END AS rate,
         CAST(('0x' || substr(sha256('mix-1:source ' || coalesce('=' || t.source, 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS o,
         CAST(('0x' || substr(sha256('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null ' || md5(coalesce(d.text, '')))), 1, 13)) AS BIGINT) AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (
  SELECT *, rate - floor(rate) AS f, count(*) OVER (PARTITION BY source ORDER BY size) AS upto, count(*) OVER (PARTITION BY source, size) AS n,
         rank() OVER (PARTITION BY source, size ORDER BY u) AS place FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((floor(rate) + CASE WHEN place <= floor(f * upto + o) - floor(f * (upto - n) + o) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM m
"""
