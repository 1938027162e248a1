"""Near-duplicate documents: min-max hashing over word shingles, banding, exact confirmation, components.

Words are maximal runs of anything but space and the controls from tab to carriage return, after
lower-casing A-Z. A document's set holds its distinct n-word shingles; a document of fewer words has
one shingle of all of them; one without words has none and is linked with nothing.

1. Each permutation gives two signature values, its minimum and its maximum over the set, so 80
   permutations fill 32 bands of 5 values. A pair of similarity 0.8 shares no band with probability
   3e-6, one of 0.85 with 1e-8.
2. Equal sets are one vertex; only its smallest document goes on.
3. Vertices that share a band bucket are linked without emitting all pairs of a bucket (see linking):
   by pivots first, then across what still are different components.
4. A pair is confirmed on full sets, rebuilt from the texts. Before that, 512 more min-max values,
   two bits of each, rule out pairs far below the threshold (a pair at it passes but for 3e-6).

Defined cases: rows that share an id are one vertex of the graph, whatever their texts; rows with a
null id are compared with nothing, keep their size, and have a null component and kept = true.
near_duplicates reads the id and the text alone; drop_near_duplicates keeps all columns of the input and their values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.linking import components, link_in_buckets
from fieldbook.llm.scratch import quoted, written
from fieldbook.llm.textarrays import SOLID, mix, pieces, shingle_hashes, split_words

SHINGLE, BANDS, ROWS = 5, 32, 5
SKETCH = 512
_SIG = "doc_id long, th long, n_shingles long, f1 long, f2 long, bands array<long>"


def _constants(count: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = rng.integers(0, 1 << 63, (2, count), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw[0], draw[1]


def distinct_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and the rows' bounds."""
    hashes, bounds = shingle_hashes(split_words(raw, offsets, SOLID), n)
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return (np.concatenate(sets) if sets else hashes), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def minmax_bands(values: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (row, band) of non-empty sets that begin at starts in values."""
    perms = -(-bands * rows // 2)
    times, plus = _constants(perms)
    sig = np.empty((len(starts), 2 * perms), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(perms):
            y = values * times[k]
            y ^= plus[k]
            sig[:, k] = np.minimum.reduceat(y, starts)
            sig[:, perms + k] = np.maximum.reduceat(y, starts)
        out = np.zeros((len(starts), bands), np.uint64)
        for j in range(rows):
            out = mix(out * np.uint64(31) + sig[:, j * bands : (j + 1) * bands])
        return mix(out + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signature_batches(n: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for row, raw, offsets in pieces(batch.column(2)):
                size = len(offsets) - 1
                values, bounds = distinct_sets(raw, offsets, n)
                counts = np.diff(bounds)
                full = np.flatnonzero(counts)
                prints, made = np.zeros((2, size), np.uint64), np.zeros((0, bands), np.uint64)
                if len(full):
                    starts = bounds[:-1][full]
                    with np.errstate(over="ignore"):
                        prints[0, full] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), starts)
                        prints[1, full] = np.add.reduceat(mix(values ^ np.uint64(0x14057B7EF767814F)), starts)
                    made = minmax_bands(values, starts, bands, rows)
                at = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, size),
                        batch.column(1).slice(row, size),
                        pa.array(counts, pa.int64()),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(made.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "th", "n_shingles", "f1", "f2", "bands"],
                )

    return run


def _confirm_batches(n: int, percent: int):
    """Keeps the pairs (a, b) whose texts' sets are similar enough."""

    def sets(column):
        out = []
        for _, raw, offsets in pieces(column):
            values, bounds = distinct_sets(raw, offsets, n)
            out += [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        return out

    def run(batches):
        for batch in batches:
            keep, coded = [], batch.column(3).dictionary_encode()
            codes, pivots = coded.indices.to_numpy(), sets(coded.dictionary)
            for x, code in zip(sets(batch.column(2)), codes):
                y = pivots[code]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _sketch_batches(n: int):
    """Adds f: 2 bits of each of 512 min-max values of a text's set, for an estimate of similarity."""

    def run(batches):
        times, plus = _constants(SKETCH // 2, seed=21)
        for batch in batches:
            for row, raw, offsets in pieces(batch.column(2)):
                values, bounds = distinct_sets(raw, offsets, n)
                bits = np.empty((len(offsets) - 1, SKETCH, 2), np.uint8)
                with np.errstate(over="ignore"):
                    for k in range(SKETCH // 2):
                        y = (values * times[k]) ^ plus[k]
                        for half, pick in enumerate((np.minimum, np.maximum)):
                            v = mix(pick.reduceat(y, bounds[:-1]))
                            bits[:, 2 * k + half, 0], bits[:, 2 * k + half, 1] = v & np.uint64(1), (v >> np.uint64(1)) & np.uint64(1)
                words = np.packbits(bits.reshape(len(bits), -1), axis=1).view(np.int64)
                part = batch.slice(row, len(offsets) - 1)
                at = np.arange(len(bits) + 1, dtype=np.int32) * words.shape[1]
                f = pa.ListArray.from_arrays(pa.array(at), pa.array(words.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, f], names=["v", "tv", "text", "f"])

    return run


def sketch_bound(percent: int) -> int:
    """Sketches of a pair at the threshold differ in more bits than this with probability 3e-6."""
    q = 1 - percent / 100
    return int(SKETCH * q + 4.5 * (SKETCH * q * (1 - q) + SKETCH * q / 2) ** 0.5) + 1


def _differ(f: str, g: str) -> str:
    return " + ".join(f"bit_count({f}[{k}] ^ {g}[{k}])" for k in range(SKETCH // 32))


def near_duplicates(docs: DataFrame, percent: int = 80, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs."""
    texts = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(quoted(text_col)).alias("th"), quoted(text_col).alias("text"))
    sig = written(texts.mapInArrow(_signature_batches(n, bands, rows), _SIG))

    # a vertex for each distinct set: its smallest document
    live = sig.where("n_shingles > 0 and doc_id is not null")
    key = ["f1", "f2", "n_shingles"]
    same = written(live.groupBy(key).agg(F.count("*").alias("times"), F.min("doc_id").alias("a"), F.min_by("th", "doc_id").alias("ta")).where("times > 1").drop("times"))
    tied = live.join(same, key, "left")
    first = tied.where("a is null or (a = doc_id and ta = th)")
    vertices = first.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("v"), F.col("th").alias("tv"), F.col("n_shingles").alias("s"))
    bound = sketch_bound(percent)

    def prepare(needed: DataFrame):
        # the one exchange of all texts; a merge join at every size
        mine = texts.where("text is not null").select(F.col("doc_id").alias("v"), F.col("th").alias("tv"), "text")
        known = mine.join(written(needed).hint("merge"), ["v", "tv"], "left_semi")
        known = written(known.mapInArrow(_sketch_batches(n), "v long, tv long, text string, f array<long>"))

        def confirm(pairs: DataFrame) -> DataFrame:
            x = known.select(F.col("v").alias("a"), F.col("tv").alias("ta"), F.col("text").alias("x"), F.col("f").alias("fx"))
            y = known.select(F.col("v").alias("b"), F.col("tv").alias("tb"), F.col("text").alias("y"), F.col("f").alias("fy"))
            both = pairs.join(x, ["a", "ta"]).join(y, ["b", "tb"]).where(f"{_differ('fx', 'fy')} <= {bound}")
            return both.select("a", "b", "x", "y").mapInArrow(_confirm_batches(n, percent), "a long, b long")

        return known.select("v", "tv", "f"), confirm

    alike = f"100 * least(s, sb) >= {percent} * greatest(s, sb)"
    edges, labels = link_in_buckets(vertices, prepare, alike, f"{_differ('f', 'fb')} <= {bound}")

    # ids with several sets tie components together
    tie = written(tied.groupBy("doc_id").agg(F.min(F.coalesce("a", "doc_id")).alias("low"), F.max(F.coalesce("a", "doc_id")).alias("high")).where("low <> high"))
    if tie.limit(1).count():
        equal = tied.where("a is not null and a <> doc_id").select(F.col("doc_id").alias("a"), F.col("a").alias("b"))
        labels = components(edges.union(equal))
    out = sig.join(same, key, "left").withColumn("vertex", F.coalesce("a", "doc_id")).drop("a", "ta")
    out = out.join(labels.withColumnRenamed("v", "vertex"), "vertex", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("c", "vertex")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "th", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are not the smallest id of their group, with their own columns."""
    found = near_duplicates(docs, percent, n, id_col, text_col)
    gone = written(found.where("not kept").select(F.col("doc_id").alias("_fb_gone")).distinct())
    # how many go grows with the corpus: a merge join at every size
    return docs.join(gone.hint("merge"), quoted(id_col).cast("long") == F.col("_fb_gone"), "left_anti")


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its component at 85 %; a document without words is alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) AS g
  FROM d WHERE len(w) > 0),
u AS (SELECT min(doc_id) AS v, g, len(g) AS n FROM s GROUP BY g),
-- links need a common shingle among the rarest: the first n - ceil(0.85 n) + 1 in order of (frequency, shingle)
e AS (SELECT v, n, unnest(g) AS x FROM u),
f AS (SELECT x, count(*) AS df FROM e GROUP BY x),
o AS (SELECT v, n, e.x, row_number() OVER (PARTITION BY v ORDER BY df, e.x) AS k FROM e JOIN f USING (x)),
p AS (SELECT v, n, x FROM o WHERE k <= n - ceil(0.85 * n) + 1),
pairs AS (SELECT DISTINCT a.v AS a, b.v AS b FROM p AS a JOIN p AS b ON a.x = b.x AND a.v < b.v AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM (SELECT a, b, len(list_intersect(x.g, y.g)) AS c, x.n AS xn, y.n AS yn FROM pairs JOIN u AS x ON x.v = a JOIN u AS y ON y.v = b)
  WHERE 100 * c >= 85 * (xn + yn - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(v, r) AS (
  SELECT v, v FROM u UNION SELECT reach.v, sym.b FROM reach JOIN sym ON reach.r = sym.a),
c AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT d.doc_id, CAST(coalesce(len(s.g), 0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id,
       coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN u ON u.g = s.g LEFT JOIN c ON c.v = u.v
"""
