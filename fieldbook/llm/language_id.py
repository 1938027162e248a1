"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text becomes code points; letters are lower-cased, everything else is a space, and runs of spaces
are one space. The features are the n-grams of 1 to 3 of these characters that are not all space,
hashed into ``buckets``. Training counts every n-gram of every training document, grouped on the
executors; the smoothed log-probability matrix (languages times buckets) is broadcast and applied to
whole texts in numpy.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows with a null text or
language are not trained on; equal scores go to the language first in code-point order; without any
training row every text is ``und`` with score 0. The score is the predicted language's posterior.
More than ``max_languages`` languages raise an error rather than grow the broadcast.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm.scratch import packed, quoted, unpacked, without
from fieldbook.llm.textarrays import code_points, mix, pieces

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
MAX_LANGUAGES = 512
_SEEDS = {n: np.uint64(0x9E3779B97F4A7C15 * n & (1 << 64) - 1) for n in range(1, 9)}
_table: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point its lower-case letter, or a space; made once in each worker."""
    if not _table:
        out = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low[0])
        _table.append(out)
    return _table[0]


def normalised(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of the rows, end to end, and the rows' bounds."""
    text = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = code_points(raw)[offsets]
    out = letters()[text]
    keep = np.ones(len(out), bool)
    if len(out):
        keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
        keep[at[:-1][at[:-1] < at[1:]]] = True
    return out[keep].astype(np.uint64), np.concatenate([[0], np.cumsum(keep)])[at]


def ngrams(chars: np.ndarray, bounds: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the rows' n-grams, end to end, and the rows' bounds."""
    count = len(chars) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    with np.errstate(over="ignore"):
        h = np.full(count, _SEEDS[n])
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + chars[j : j + count]
        h = mix(h)
    use = row[:count] == row[n - 1 :]
    if n == 1:
        use &= chars != 32
    total = np.concatenate([[0], np.cumsum(use)])
    return (h[use] >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64), total[np.minimum(bounds, count)]


def _count_batches(buckets: int, sizes: tuple[int, ...]):
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for row, raw, offsets in pieces(batch.column(0)):
                chars, bounds = normalised(raw, offsets)
                mine = langs[row : row + len(offsets) - 1]
                for lang in set(mine):
                    seen[lang] = seen.get(lang, 0) + mine.count(lang)
                    sums.setdefault(lang, np.zeros(buckets, np.int64))
                for n in sizes:
                    found, at = ngrams(chars, bounds, n, buckets)
                    for lang in set(mine):
                        pick = np.repeat(np.array([x == lang for x in mine]), np.diff(at))
                        sums[lang] += np.bincount(found[pick], minlength=buckets)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            ids = np.concatenate([[-1], at])  # -1: documents
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids)), pa.array(ids, pa.int32()), pa.array(np.concatenate([[seen[lang]], total[at]]), pa.int64())], names=["lang", "bucket", "n"])

    return run


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES, max_languages: int = MAX_LANGUAGES):
    """(languages in code-point order, log prior, log-probability matrix of buckets by language)."""
    rows = docs.select(quoted(text_col).alias("t"), quoted(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    counts = rows.mapInArrow(_count_batches(buckets, sizes), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for row in counts.toLocalIterator():  # at most buckets + 1 rows a language
        if row.lang not in found and len(found) == max_languages:
            raise ValueError(f"more than {max_languages} languages")
        found.setdefault(row.lang, np.zeros(buckets + 1))[row.bucket + 1] = row.n
    langs = sorted(found)
    if not langs:
        return [], np.zeros(0), np.zeros((buckets, 0))
    table = np.stack([found[x] for x in langs], axis=1)
    prior = np.log(table[0] / table[0].sum())
    smooth = table[1:] + 0.5
    return langs, prior, np.log(smooth / smooth.sum(axis=0))


def _predict_batches(model, sizes: tuple[int, ...], text_at: int):
    def run(batches):
        langs, prior, matrix = model.value
        columns = [np.ascontiguousarray(matrix[:, k]) for k in range(len(langs))]
        for batch in batches:
            preds, scores = [], []
            for _, raw, offsets in pieces(batch.column(text_at)):
                chars, bounds = normalised(raw, offsets)
                rows = len(offsets) - 1
                total = np.tile(prior, (rows, 1))
                seen = np.diff(np.concatenate([[0], np.cumsum(chars != 32)])[bounds])
                for n in sizes:
                    found, at = ngrams(chars, bounds, n, len(matrix))
                    full = np.diff(at) > 0
                    for k, column in enumerate(columns):
                        each = np.concatenate([column[found], [0.0]])
                        total[full, k] += np.add.reduceat(each, at[:-1])[full]
                if not langs:
                    preds += ["und"] * rows
                    scores += [0.0] * rows
                    continue
                best = total.argmax(axis=1)
                post = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                preds += [langs[b] if s else "und" for b, s in zip(best, seen)]
                scores += np.where(seen > 0, post, 0.0).tolist()
            made = {"lang_pred": pa.array(preds, pa.string()), "score": pa.array(scores, pa.float64())}
            out = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if i != text_at} | made
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def predict(docs: DataFrame, model, text_col: str = "text", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """docs without its text, with lang_pred and score (replacing columns of these names in any case)."""
    base = without(docs, "lang_pred score")
    rows = packed(base, text=text_col)
    schema = T.StructType([rows.schema["_fb_row"], *T.StructType.fromDDL("lang_pred string, score double").fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_predict_batches(shared, sizes, 1), schema)
    return unpacked(out, [c for c in base.columns if c != text_col], {}, "lang_pred score")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document with its predicted language; null and letterless texts are und, a null id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out_of = F.coalesce(held_out(), F.lit(False))
    model = train(docs.where(~out_of))
    return predict(docs.select("doc_id", out_of.alias("held_out"), "text"), model)
