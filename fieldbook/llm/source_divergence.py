"""Source divergence audit: how the words of each source differ from those of the other sources of its language.

Each language keeps the terms that stand in at least MIN_DOCS of its documents. A source gives a kept term the share
p = 1 + floor(10**9 * (count + 1) / (N + V)), N being its occurrences of kept terms and V how many terms are kept; the
language as a whole gives it the share of all its documents. A share p diverges from a share q by
floor((p - q)**2 / q), for two sources summed over all kept terms.

Texts are counted where they are read, in numpy, and counts are grouped by term. A language's kept terms are dealt by hash
to blocks, so that a block is a dense int64 matrix (tile) of about CELLS counts, its sources by its terms. Each tile is
broadcast against each of its rows in turn, which gives a partial matrix of all pairs; Spark sums these. For the terms of
a source, each tile sends its best ``top`` of them, and Spark merges those lists. Where a language has so many sources
that the matrix of pairs would outgrow PAIRS, strips of its rows are computed by different tasks.

All arithmetic is on whole numbers and exact while a source's N + V is below 9 * 10**15.

Defined cases: null text, language and source are ''; every (language, source) pair that occurs is a group, even
without terms; where no term is kept all pairs have the value 0; repeated rows are documents of their own; an empty table
gives none. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.llm.scratch import quoted, written
from fieldbook.llm.textarrays import byte_class, exact, pieces, split_words

MIN_DOCS, TOP = 3, 200
#: counts in a tile; sources by sources in a matrix of pairs
CELLS, PAIRS = 1 << 18, 1 << 22
#: the fewest terms of a tile, however many sources there are
NARROW = 64
#: rows a task holds before it sends its counts on
HELD = 1 << 18
#: letters and everything beyond ASCII
LETTERS = byte_class(lambda b: 97 <= b <= 122 or b >= 128)


def _count_batches(batches):
    """(lang, source, term, c occurrences, d documents), summed as far as HELD rows go."""
    groups: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []

    def out():
        names = [pa.array(x, pa.string()) for x in zip(*groups)]
        for batch in pa.concat_tables(held).to_batches():
            yield pa.RecordBatch.from_arrays([*(x.take(batch.column(0)) for x in names), *batch.columns[1:]], names=["lang", "source", "term", "c", "d"])
        groups.clear()
        held.clear()

    for batch in batches:
        codes = np.array([groups.setdefault(k, len(groups)) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
        for row, raw, offsets in pieces(batch.column(2)):
            words = split_words(raw, offsets, LETTERS)
            if not len(words.start):
                continue
            terms = exact(words, LETTERS)
            n = len(terms.dictionary)
            in_doc, times = np.unique(words.row * n + terms.indices.to_numpy(), return_counts=True)
            both, at = np.unique(codes[row + in_doc // n] * n + in_doc % n, return_inverse=True)
            c = np.bincount(at, weights=times).astype(np.int64)
            held.append(pa.table({"g": both // n, "term": terms.dictionary.take(pa.array(both % n)), "c": c, "d": np.bincount(at)}))
            if sum(len(x) for x in held) > HELD:
                one = pa.concat_tables(held).group_by(["g", "term"]).aggregate([("c", "sum"), ("d", "sum")])
                held[:] = [one.select(["g", "term", "c_sum", "d_sum"]).rename_columns(["g", "term", "c", "d"])]
                if len(one) > HELD // 2:
                    yield from out()
                    codes = np.array([groups.setdefault(k, len(groups)) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
    if held:
        yield from out()


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total), by long division in steps of a thousand."""
    out, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _tile(top: int):
    """From the rows of a tile to its partial sums of pairs (term null) and the best terms of its sources (item null)."""

    def run(table: pa.Table) -> pa.Table:
        head = table.filter(pc.is_null(table["term"])).combine_chunks()
        body = table.filter(pc.is_valid(table["term"])).sort_by("term").combine_chunks()
        lang, strip, v = table["lang"][0].as_py(), table["strip"][0].as_py(), table["v"][0].as_py()
        sources = head["source"].combine_chunks()
        own, n = head["own"].to_numpy(), head["n"].to_numpy()
        count = np.zeros((len(sources), len(body)), np.int64)
        if len(body):
            cells = body["cells"].combine_chunks()
            at = pc.index_in(cells.flatten().field("source"), value_set=sources).to_numpy()
            column = np.repeat(np.arange(len(body)), np.diff(cells.offsets.to_numpy()))
            count[at, column] = cells.flatten().field("c").to_numpy()
        share = shares(count, (n + v)[:, None])
        whole = shares(count.sum(axis=0), n.sum() + v)
        out = {k: [] for k in ("source", "item", "term", "value")}

        def add(i: int, values: np.ndarray, item=None, term=None) -> None:
            out["source"].append(pa.array([sources[i].as_py()] * len(values), pa.string()))
            out["item"].append(item if item is not None else pa.nulls(len(values), pa.string()))
            out["term"].append(term if term is not None else pa.nulls(len(values), pa.string()))
            out["value"].append(pa.array(values, pa.int64()))

        for i in np.flatnonzero(own == strip):
            others = np.flatnonzero(np.arange(len(sources)) != i)
            # all pairs of this row at once; whole tiles without terms give zeros
            add(i, divergence(share[i], share).sum(axis=1)[others], item=sources.take(pa.array(others)))
            more = np.flatnonzero((count[i] > 0) & (share[i] > whole))
            value = divergence(share[i, more], whole[more])
            best = np.argsort(-value, kind="stable")[:top]  # terms are sorted, so ties stay in their order
            if len(best):
                add(i, value[best], term=body["term"].combine_chunks().take(pa.array(more[best])))
        columns = {k: pa.concat_arrays(x) if x else pa.nulls(0, pa.int64() if k == "value" else pa.string()) for k, x in out.items()}
        return pa.table({"lang": pa.array([lang] * len(columns["value"]), pa.string())} | columns)

    return run


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair ranks the other sources, part term the ``top`` terms."""
    text = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    found = rows.mapInArrow(_count_batches, "lang string, source string, term string, c long, d long")
    # dealt by term once, which serves both groupings
    each = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    terms = each.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.collect_list(F.struct("source", "c")).alias("cells"))
    kept = written(terms.where(F.col("d") >= min_docs).drop("d"))

    sums = kept.select("lang", F.explode("cells").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.c").alias("n"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    groups = written(groups)
    langs = groups.groupBy("lang").agg(F.count("*").alias("g")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    width = F.greatest(F.floor(F.lit(CELLS) / F.col("g")), F.lit(NARROW))
    langs = langs.withColumn("v", F.coalesce("v", F.lit(0).cast("long"))).withColumns(
        {"blocks": F.greatest(F.ceil(F.col("v") / width), F.lit(1)), "strips": F.ceil(F.col("g") / F.greatest(F.floor(F.lit(PAIRS) / F.col("g")), F.lit(1)))}
    )
    langs = written(langs)  # one row a language

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    head = groups.join(langs, "lang").withColumns({"block": every("blocks"), "own": dealt("source", "strips")}).withColumn("strip", every("strips"))
    body = kept.join(langs, "lang").withColumn("block", dealt("term", "blocks")).withColumn("strip", every("strips"))
    none = lambda t: F.lit(None).cast(t)
    cells = kept.schema["cells"].dataType
    key = [F.col(c) for c in ("lang", "block", "strip", "v")]
    tiles = head.select(*key, "source", "n", "own", none("string").alias("term"), none(cells).alias("cells")).unionByName(body.select(*key, none("string").alias("source"), none("long").alias("n"), none("long").alias("own"), "term", "cells"))
    partial = written(tiles.groupBy("lang", "block", "strip").applyInArrow(_tile(top), "lang string, source string, item string, term string, value long"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = partial.where("term is null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", rank)
    best = partial.where("term is not null").select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", rank).where(F.col("rank") <= top)
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(pairs, "pair").unionByName(shown(best, "term"))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit of the documents table; null texts, languages and sources are ''."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
g AS (SELECT g.lang, g.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) AS g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source) AS s ON g.lang = s.lang AND g.source = s.source),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + v.v)::HUGEINT AS p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT s.lang, s.term, 1 + (1000000000::HUGEINT * (s.c + 1)) // (n.n + v.v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM c GROUP BY lang, term) AS s JOIN (SELECT lang, sum(c) AS n FROM c GROUP BY lang) AS n ON s.lang = n.lang JOIN v ON s.lang = v.lang),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p AS x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p AS y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // q AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""
