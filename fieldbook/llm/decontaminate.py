"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over documents.

A word is a maximal run of letters, digits and bytes beyond ASCII after lower-casing A-Z. A window
is n consecutive words of an item; an item of fewer words, but not none, is one window. Windows are
compared by 64-bit hash first and every hit is then verified word by word.

The benchmark is split into windows by a Spark job. The windows reach the executors in blocks of at most
``max_windows`` windows, as sorted hashes and one flat buffer of words (about 30 bytes a window and its item's text), so
what is broadcast and what a worker holds has a fixed bound whatever the benchmark's size. Each further block is
one more scan that adds its hits to the rows of the one before, written out in between.

Defined cases: a null text has no words and no hits; an empty benchmark hits nothing; an empty table gives an empty
one; items with a null id still hit but are never listed; an item id that occurs twice is one item with both texts'
windows; repeated documents are separate rows. find_contamination replaces columns of the input named like those it adds
(n_words, n_hit, hits, items) in any case; remove_contaminated and remove_spans keep all columns and their values.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm.scratch import packed, quoted, unpacked, without, written
from fieldbook.llm.textarrays import ALNUM, Words, pieces, split_words, windows

N = 10
MAX_WINDOWS = 1_000_000
_OUT = "n_words long, n_hit long, hits array<struct<start:long,end:long>>, items array<string>"


class Block(NamedTuple):
    """Windows in ascending order of hash: their lengths in words, where their words stand, and their items."""

    hashes: np.ndarray
    size: np.ndarray
    start: np.ndarray
    end: np.ndarray
    item: np.ndarray
    words: bytes  # items' lower-cased words, single spaces between
    items: list[str | None]


def _window_batches(n: int, max_windows: int):
    """(i, words, size, hashes, start, end) for each item: its windows, and an item of very many in several rows."""

    def run(batches):
        for batch in batches:
            out = []
            for row, raw, offsets in pieces(batch.column(1)):
                split = split_words(raw, offsets, ALNUM)
                h, low = split.hashes(), split.lower.tobytes()
                for r in range(len(offsets) - 1):
                    first, last = int(split.bounds[r]), int(split.bounds[r + 1])
                    size = min(n, last - first)
                    for a in range(first, max(last - size + 1, first) if size else first, max_windows):
                        b = min(a + max_windows + size - 1, last)
                        mine = [low[x:y] for x, y in zip(split.start[a:b].tolist(), split.end[a:b].tolist())]
                        ends = np.cumsum([len(w) + 1 for w in mine]) - 1
                        starts = np.concatenate([[0], ends[:-1] + 1])
                        out.append((batch.column(0)[row + r].as_py(), b" ".join(mine), size, windows(h[a:b], size).view(np.int64).tolist(), starts[: b - a - size + 1].tolist(), ends[size - 1 :].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.string(), pa.binary(), pa.int32(), *[pa.list_(pa.int64())] * 3))], names=["i", "words", "size", "hashes", "start", "end"])

    return run


def benchmark_blocks(benchmark: DataFrame, n: int, max_windows: int, id_col: str = "item_id", text_col: str = "text"):
    """The windows of the benchmark's distinct (item, text) rows in blocks of at most max_windows windows each.

    Items stream to the driver one partition at a time; a block is the driver's whole footprint.
    """
    rows = benchmark.select(quoted(id_col).cast("string").alias("i"), quoted(text_col).alias("t")).where("t is not null").distinct()
    made = rows.mapInArrow(_window_batches(n, max_windows), "i string, words binary, size int, hashes array<long>, start array<long>, end array<long>")
    parts, total, at, text, items = [], 0, 0, [], []
    for row in made.toLocalIterator():
        if parts and total + len(row.hashes) > max_windows:
            yield _block(parts, text, items)
            parts, total, at, text, items = [], 0, 0, [], []
        count = len(row.hashes)
        parts.append((np.array(row.hashes, np.int64).view(np.uint64), np.full(count, row["size"], np.int32), np.array(row.start) + at, np.array(row.end) + at, np.full(count, len(items), np.int32)))
        items.append(row.i)
        text.append(bytes(row.words))
        total, at = total + count, at + len(row.words) + 1
    if parts:
        yield _block(parts, text, items)


def _block(parts: list[tuple], text: list[bytes], items: list[str | None]) -> Block:
    columns = [np.concatenate(c) for c in zip(*parts)]
    order = np.argsort(columns[0], kind="stable")
    return Block(*[c[order] for c in columns], b" ".join(text), items)


class WindowSet:
    """A block ready for look-ups: for each window length a bitmap of hashes and where its windows stand in the block."""

    def __init__(self, block: Block):
        self.block, self.lengths = block, {}
        for size in np.unique(block.size).tolist():
            at = np.flatnonzero(block.size == size)
            hashes = block.hashes[at]
            bits = np.zeros(1 << 20, bool)
            bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.lengths[size] = (bits, hashes, at)

    def hits(self, words: Words):
        """(first word, window length, items) of every verified occurrence."""
        b, h, low = self.block, words.hashes(), None
        for size, (bits, known, place) in self.lengths.items():
            made = windows(h, size)
            at = np.flatnonzero(bits[(made >> np.uint64(44)).astype(np.int64)])
            at = at[words.row[at] == words.row[at + size - 1]]
            left, right = np.searchsorted(known, made[at]), np.searchsorted(known, made[at], side="right")
            some = left < right
            if some.any() and low is None:
                low = words.lower.tobytes()
            for k, x, y in zip(at[some].tolist(), left[some].tolist(), right[some].tolist()):
                text = b" ".join(low[s:e] for s, e in zip(words.start[k : k + size].tolist(), words.end[k : k + size].tolist()))
                items = {b.items[b.item[w]] for w in place[x:y].tolist() if b.words[b.start[w] : b.end[w]] == text}
                if items:
                    yield k, size, items


def scan_batches(block, text_at: int):
    def scan(batches):
        known = WindowSet(block.value)
        for batch in batches:
            names = batch.schema.names
            earlier = {c: batch.column(names.index(c)).to_pylist() for c in ("hits", "items") if c in names}
            n_words, n_hit, hits, items = [], [], [], []
            for row, raw, offsets in pieces(batch.column(text_at)):
                words = split_words(raw, offsets, ALNUM)
                rows = len(offsets) - 1
                # a slot for each word and one more for each row's end, so that no hit reaches into the next row
                edge = np.zeros(len(words.start) + rows, np.int64)
                found = defaultdict(set)
                for k, size, ids in known.hits(words):
                    r = int(words.row[k])
                    edge[k + r] += 1
                    edge[k + size + r] -= 1
                    found[r] |= ids
                spans = defaultdict(list)
                for r in found:
                    first, last = int(words.bounds[r]), int(words.bounds[r + 1])
                    hit = np.cumsum(edge[first + r : last + r + 1])[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
                    spans[r] = [(int(a), int(b)) for a, b in zip(turn[::2], turn[1::2])]
                n_words += np.diff(words.bounds).tolist()
                for r in range(rows):
                    old = merge(earlier["hits"][row + r] if earlier else [], spans[r])
                    hits.append(old)
                    n_hit.append(sum(s["end"] - s["start"] for s in old))
                    items.append(sorted({x for x in found[r] if x is not None} | set(earlier["items"][row + r] if earlier else [])))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            made = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hits": pa.array(hits, span), "items": pa.array(items, pa.list_(pa.string()))}
            columns = {c: batch.column(i) for i, c in enumerate(names) if c not in made} | made
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return scan


def merge(old: list[dict], new: list[tuple[int, int]]) -> list[dict]:
    """The union of word spans, as disjoint ascending spans."""
    out: list[dict] = []
    for a, b in sorted([(s["start"], s["end"]) for s in old] + new):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with n_words, n_hit (words inside any hit), hits (disjoint word spans) and items (sorted ids)."""
    spark = docs.sparkSession
    base, roles = without(docs, "n_words n_hit hits items"), {"text": text_col}
    out = packed(base, **roles)
    schema = T.StructType(out.schema.fields + T.StructType.fromDDL(_OUT).fields)
    for k, block in enumerate(chain(benchmark_blocks(benchmark, n, max_windows), [None])):
        if block is None and k:
            break
        # one block's windows at a time: what the block before has found is written out
        block = block or Block(*[np.zeros(0, t) for t in (np.uint64, np.int32, np.int64, np.int64, np.int32)], b"", [])
        out = (written(out) if k else out).mapInArrow(scan_batches(spark.sparkContext.broadcast(block), 1), schema)
    return unpacked(out, base.columns, roles, "n_words n_hit hits items")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark window, with their own columns."""
    roles = {"text": text_col}
    found = find_contamination(packed(docs, **roles), benchmark, n)
    return unpacked(found.where("n_hit = 0"), docs.columns, roles)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text") -> DataFrame:
    """All documents, with the words of hit spans (and what stands between them) cut from the text."""

    @F.pandas_udf("string")
    def cut(text, hits):
        out = []
        for t, spans in zip(text, hits):
            if t is None or len(spans) == 0:
                out.append(t)
                continue
            raw = np.frombuffer(t.encode(), np.uint8)
            w = split_words(raw, np.array([0, len(raw)]), ALNUM)
            data, at, kept = raw.tobytes(), 0, []
            for s in spans:
                kept.append(data[at : w.start[s["start"]]])
                at = int(w.end[s["end"] - 1])
            out.append(b"".join([*kept, data[at:]]).decode())
        return pd.Series(out, dtype=object)

    roles = {"text": text_col}
    found = find_contamination(packed(docs, **roles), benchmark, n)
    return unpacked(found, docs.columns, roles, **{text_col: cut("text", "hits")})


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document with its hits; a null text has no words and none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w,
         row_number() OVER () AS k FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.k, dw.i, bw.n, bw.item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT k, item FROM hit WHERE item IS NOT NULL) GROUP BY k)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""
