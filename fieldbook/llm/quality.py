"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A token is a run of word bytes or a run of punctuation, lower-cased; features are hashed token
unigrams and bigrams, and a token that repeats the one before it counts as one shared feature
besides. Two smoothed bag-of-n-grams models are fitted: the raw one on all documents, the target
one on the labelled good documents. A document's log weight is the sum over its features of
log p_target - log p_raw. Adding a Gumbel draw seeded by its id and keeping the top k keys samples k
documents without replacement in proportion to their weights.

k is the share of good rows among the labels times the documents with any token. The labelled rows
used are the ``max_labelled`` of smallest id hash: a bounded sample, so the labels can be broadcast.

Defined cases: a null or token-free text has weight 0, a null key and is not kept; with no good
label at all every document with a token is kept; labels with a null id or quality are not used; an
id labelled several times counts as good only if all its labels say so; rows that repeat an id share
its draw; an empty table gives none. scored_keys and score replace columns named like those they add, in any case;
keep_quality keeps all columns of the input and their values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm.scratch import packed, quoted, ranked, unpacked, without, written
from fieldbook.llm.textarrays import LOWER, Words, byte_class, mix, pieces

BUCKETS = 1 << 15
MAX_LABELLED = 50_000
_WORD = byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
_SPACE = byte_class(lambda b: b <= 32)
#: 0 space, 1 word, 2 punctuation, by byte
_KIND = np.where(_SPACE, 0, np.where(_WORD, 1, 2)).astype(np.uint8)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of word bytes and runs of punctuation, never across rows."""
    low, rows = LOWER[raw], len(offsets) - 1
    kind = _KIND[low]
    turn = np.ones(len(low) + 1, bool)
    turn[1:-1] = kind[1:] != kind[:-1]
    turn[offsets] = True
    at = np.flatnonzero(turn)
    start, end = at[:-1], at[1:]
    solid = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[solid], end[solid]
    bounds = np.searchsorted(start, offsets)
    return Words(low, start, end, np.repeat(np.arange(rows), np.diff(bounds)), bounds)


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each row's features, end to end, and the rows' bounds."""
    words = tokens(raw, offsets)
    h, shift = words.hashes(), np.uint64(64 - buckets.bit_length() + 1)
    inside = np.zeros(len(h), bool)
    inside[1:] = words.row[1:] == words.row[:-1]
    pair = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        pair[1:] = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    pair[again] = np.uint64(0x1234567890ABCDEF)
    out = np.empty((len(h), 2), np.uint64)
    out[:, 0], out[:, 1] = h >> shift, pair >> shift
    use = np.ones((len(h), 2), bool)
    use[:, 1] = inside
    count = np.concatenate([[0], np.cumsum(use.sum(axis=1))])
    return out[use].astype(np.int64), count[words.bounds]


def _count_batches(buckets: int):
    """Sums over a partition: for raw and target text, how often each bucket occurs."""

    def run(batches):
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for row, raw, offsets in pieces(batch.column(0)):
                found, bounds = features(raw, offsets, buckets)
                sums[0] += np.bincount(found, minlength=buckets)
                mine = np.repeat(good[row : row + len(offsets) - 1], np.diff(bounds))
                sums[1] += np.bincount(found[mine], minlength=buckets)
        for model in (0, 1):
            at = np.flatnonzero(sums[model])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), model), pa.int32()), pa.array(at, pa.int32()), pa.array(sums[model][at], pa.int64())], names=["model", "bucket", "n"])

    return run


def labelled(labels: DataFrame, id_col: str = "doc_id", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(_fb_id, good) for at most max_labelled labelled ids."""
    one = labels.select(quoted(id_col).alias("_fb_id"), "quality").where("_fb_id is not null and quality is not null")
    one = one.groupBy("_fb_id").agg((F.min("quality") > 0).alias("good"))
    return one.orderBy(F.xxhash64("_fb_id"), "_fb_id").limit(max_labelled)


def fit(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The log ratio of target to raw probability of each bucket; zeros if there is no target text."""
    # known has at most MAX_LABELLED rows of an id and a flag
    text = docs.select(quoted(text_col).alias("text"), quoted(id_col).alias("_fb_id")).join(F.broadcast(known), "_fb_id", "left").select("text", "good")
    counts = text.mapInArrow(_count_batches(buckets), "model int, bucket int, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n"))
    sums = np.zeros((2, buckets))
    for row in counts.toLocalIterator():  # at most two rows a bucket
        sums[row.model, row.bucket] = row.n
    if not sums[1].sum():
        return np.zeros(buckets)
    p = (sums + 1.0) / (sums.sum(axis=1, keepdims=True) + buckets)
    return np.log(p[1]) - np.log(p[0])


def _score_batches(ratio, text_at: int):
    def run(batches):
        weight = ratio.value
        for batch in batches:
            total, counts = [], []
            for _, raw, offsets in pieces(batch.column(text_at)):
                found, bounds = features(raw, offsets, len(weight))
                each = np.concatenate([weight[found], [0.0]])
                sums = np.add.reduceat(each, bounds[:-1])
                counts.append(np.diff(bounds))
                total.append(np.where(counts[-1] > 0, sums, 0.0))
            made = {"log_weight": pa.array(np.concatenate(total) if total else [], pa.float64()), "n_features": pa.array(np.concatenate(counts) if counts else [], pa.int64())}
            columns = dict(zip(batch.schema.names, batch.columns)) | made
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def score(docs: DataFrame, ratio: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with log_weight and n_features."""
    base, roles = without(docs, "log_weight n_features"), {"text": text_col}
    rows = packed(base, **roles)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("log_weight double, n_features long").fields])
    out = rows.mapInArrow(_score_batches(docs.sparkSession.sparkContext.broadcast(ratio), 1), schema)
    return unpacked(out, base.columns, roles, "log_weight n_features")


def gumbel(seed: int, id_col: str):
    """A standard Gumbel draw by id."""
    u = (F.pmod(F.xxhash64(F.lit(seed), quoted(id_col)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def scored_keys(docs: DataFrame, labels: DataFrame, seed: int, id_col: str, text_col: str, buckets: int, max_labelled: int, keep_share: float | None, label_id: str = "doc_id") -> DataFrame:
    """docs with log_weight, n_features, key and kept."""
    known = written(labelled(labels, label_id, max_labelled))
    ratio = fit(docs, known, id_col, text_col, buckets)
    key = F.when(F.col("n_features") > 0, F.col("log_weight") + gumbel(seed, id_col))
    base = without(docs, "key kept")
    keys = written(score(base.select(quoted(id_col), quoted(text_col)), ratio, text_col).select(quoted(id_col).alias("i"), key.alias("key")).where("key is not null"))
    if keep_share is None:
        row = known.agg(F.count("*").alias("n"), F.count_if("good").alias("g")).first()
        keep_share = row.g / row.n if row.g else 1.0
    k = round(keep_share * keys.count())
    # the k-th key is the only row that comes to the driver
    cut = ranked(keys, [F.col("key").desc(), F.col("i").asc_nulls_last()], "_fb_rank").where(F.col("_fb_rank") == k).first()
    if cut is None:
        kept = F.lit(False)
    else:
        no_later = F.lit(True) if cut.i is None else F.coalesce(quoted(id_col) <= F.lit(cut.i), F.lit(False))
        kept = F.coalesce((F.col("key") > cut.key) | ((F.col("key") == cut.key) & no_later), F.lit(False))
    return score(base, ratio, text_col).withColumn("key", key).withColumn("kept", kept)


def select_quality(docs: DataFrame, labels: DataFrame, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED, keep_share: float | None = None) -> DataFrame:
    """(doc_id, log_weight, n_features, key, kept), a row for each row of docs.

    keep_share replaces the share of good labels if given; the labels' id column is named id_col too.
    """
    slim = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    found = scored_keys(slim, labels, seed, "doc_id", "text", buckets, max_labelled, keep_share, id_col)
    return found.select("doc_id", "log_weight", "n_features", "key", "kept")


def keep_quality(docs: DataFrame, labels: DataFrame, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED, keep_share: float | None = None) -> DataFrame:
    """The kept documents, with their own columns; no exchange of texts."""
    roles = {"doc_id": id_col, "text": text_col}
    found = scored_keys(packed(docs, **roles), labels, seed, "doc_id", "text", buckets, max_labelled, keep_share, id_col)
    return unpacked(found.where("kept"), docs.columns, roles)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Every document with its weight, key and whether it is kept; null and token-free texts are not kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
