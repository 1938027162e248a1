"""Substring dedup by sliding spans of sentences.

A sentence ends at a newline, or after ``.``, ``!`` or ``?`` before white space or the text's end. Its
words are lower-cased runs of letters, digits and bytes beyond ASCII; a sentence without words
belongs to no span. A sentence of more than 10 words is broken into parts of 4 to 10 words before words of
locally smallest hash, so breaks depend on the words nearby and not on where the sentence began; the parts
count as sentences. Every two consecutive sentences are a span. A repeated run of any number of
sentences is covered by its spans from its first sentence to its last, however few words it has; what is
only part of a sentence is not covered at a run's edges. Inside a long sentence two parts have at least 8
words. Of passages of 50 words without any sentence end, none of 20,000 drawn ones had no common span
in other surroundings.

Spans are hashed to 128 bits and joined globally; sentences that any repeated span covers, other than
in its first document (smallest id), are removed; so are those of a span's later occurrences inside
one document.

The repeated spans are written out before they are joined back: a span that stands in a third of all
documents is pre-aggregated on the map side and its join partition can be split.

Defined cases: a null text stays null with 0 sentences; rows that share an id count as one document,
whose rows remove nothing from each other; rows with a null id come last, in order of their texts' hashes, and only
equal texts among them are one document; texts are processed whole; an empty table gives an empty one. Columns of the
input named n_sentences, n_removed or removed in any case are replaced, others kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm.scratch import packed, quoted, unpacked, without, written
from fieldbook.llm.textarrays import ALNUM, SOLID, byte_class, mix, pieces, powers, split_words

RUN, MIN_WORDS = 2, 2
LONG, NEAR = 10, 3
_LAST = (1 << 63) - 1
_STOP = byte_class(lambda b: b in b".!?")
_SPAN = "doc long, th long, first long, last long, again boolean, h1 long, h2 long"


def breaks(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where to break sentences [first, end) of more than LONG words, ascending: every part keeps over NEAR words.

    First before each word of smallest hash among NEAR words to either side (the first of equals), then parts that
    are still long at their smallest inner hash (of equals, the one nearest to the middle).
    """
    found = np.zeros(len(h), bool)
    if len(h) > 2 * NEAR:
        before = np.lib.stride_tricks.sliding_window_view(h, NEAR).min(axis=1)
        at = np.arange(NEAR, len(h) - NEAR)
        low = at[(h[at] < before[at - NEAR]) & (h[at] <= before[at + 1])]
        mine = np.searchsorted(first, low, side="right") - 1
        found[low[(end[mine] - first[mine] > LONG) & (low - first[mine] > NEAR) & (end[mine] - low > NEAR)]] = True
    starts = np.unique(np.concatenate([first, np.flatnonzero(found)]))
    ends = np.append(starts[1:], len(h))
    while len(long := np.flatnonzero(ends - starts > LONG)):
        a, n = starts[long] + NEAR + 1, (ends - starts)[long] - 2 * NEAR - 1
        part = np.repeat(np.arange(len(long)), n)
        heads = np.cumsum(n) - n
        inner = np.arange(len(part)) - heads[part] + a[part]
        worse = h[inner] != np.minimum.reduceat(h[inner], heads)[part]
        order = np.lexsort((inner, np.abs(2 * inner - (starts + ends)[long][part]), worse, part))
        cut = inner[order[heads]]
        found[cut] = True
        starts, ends = np.concatenate([starts[long], cut]), np.concatenate([cut, ends[long]])
    return np.flatnonzero(found)


class Sentences:
    """The sentences with words of a piece: word bounds, byte bounds and rows."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.words = w = split_words(raw, offsets, ALNUM)
        size = len(raw)
        # a sentence ends before byte e if a stop precedes e and no solid byte follows at once, or at a newline
        end = np.zeros(size + 1, bool)
        if size:
            end[1:size] = _STOP[raw[:-1]] & ~SOLID[raw[1:]]
            end[1:] |= raw == 10
        end[offsets] = True
        edges = np.flatnonzero(end)
        counts = np.diff(np.searchsorted(w.start, edges))
        # word index where each sentence begins; sentences without words vanish
        first = np.searchsorted(w.start, edges[:-1])[counts > 0]
        counts = counts[counts > 0]
        starts = np.zeros(len(w.start), bool)
        starts[first] = True
        self.hashes = w.hashes()
        starts[breaks(self.hashes, first, first + counts)] = True
        self.first = np.flatnonzero(starts)
        self.end = np.append(self.first[1:], len(w.start))
        self.row = w.row[self.first] if len(self.first) else np.zeros(0, np.int64)
        rows = len(offsets) - 1
        self.bounds = np.searchsorted(self.row, np.arange(rows + 1))
        # bytes: from the first word of a sentence to the first word of the next, or the row's end
        self.byte_end = np.append(w.start[self.first[1:]] if len(self.first) else [], size).astype(np.int64)[: len(self.first)]
        self.byte_start = w.start[self.first] if len(self.first) else np.zeros(0, np.int64)
        last = self.bounds[1:][self.bounds[1:] > self.bounds[:-1]] - 1
        self.byte_end[last] = offsets[1:][self.bounds[1:] > self.bounds[:-1]]
        if len(last):
            self.end[last] = w.bounds[1:][self.bounds[1:] > self.bounds[:-1]]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first sentence, last sentence, hash, hash) of the span that starts at each sentence, where there is one."""
        n = len(self.first)
        at = np.arange(n)
        need = np.searchsorted(self.end, self.first + MIN_WORDS)
        last = np.maximum(at + RUN - 1, need)
        ok = last < n
        at, last = at[ok], last[ok]
        ok = self.row[at] == self.row[last]
        at, last = at[ok], last[ok]
        h = self.hashes
        up, down = powers(len(h) + 1)
        out = []
        for salt in (0x8E95C4A1B7D3F265, 0x3C6EF372FE94F82B):
            total = np.zeros(len(h) + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(mix(h ^ np.uint64(salt)) * up[: len(h)], out=total[1:])
                out.append(mix((total[self.end[last]] - total[self.first[at]]) * down[self.first[at]] + (self.end[last] - self.first[at]).astype(np.uint64)))
        return at, last, out[0], out[1]


def _span_batches(batches):
    for batch in batches:
        for row, raw, offsets in pieces(batch.column(2)):
            s = Sentences(raw, offsets)
            at, last, h1, h2 = s.spans()
            rows = s.row[at]
            order = np.lexsort((at, h2, h1, rows))
            again = np.zeros(len(at), bool)
            again[order[1:]] = (rows[order[1:]] == rows[order[:-1]]) & (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
            take = pa.array(rows + row)
            base = s.bounds[rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(at - base), pa.array(last - base), pa.array(again), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                names=["doc", "th", "first", "last", "again", "h1", "h2"],
            )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"_fb_id": F.coalesce(quoted(id_col).cast("long"), F.lit(_LAST)), "_fb_th": F.xxhash64(quoted(id_col), quoted(text_col))})


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_fb_id, _fb_th, cover): the ranges [first, last] of sentences to remove, for documents that have any."""
    texts = _keyed(docs.select(quoted(id_col), quoted(text_col)), id_col, text_col).where(quoted(text_col).isNotNull()).select("_fb_id", "_fb_th", quoted(text_col).alias("text"))
    # rows without id are told apart by their texts
    doc = F.struct("doc", F.when(F.col("doc") == _LAST, F.col("th")).otherwise(F.lit(0)).alias("th"))
    spans = texts.mapInArrow(_span_batches, _SPAN)
    found = spans.where("not again").groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(doc).alias("home")).where("times > 1")
    repeated = written(found.drop("times"))
    mine = spans.where("again").select("doc", "th", "first", "last")
    later = spans.where("not again").join(repeated, ["h1", "h2"]).where(doc > F.col("home")).select("doc", "th", "first", "last")
    cover = mine.union(later).groupBy("doc", "th").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("cover"))
    return written(cover.select(F.col("doc").alias("_fb_id"), F.col("th").alias("_fb_th"), "cover"))


def _cut_batches(text_at: int, cover_at: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            cover = batch.column(cover_at).to_pylist()
            texts, counts, gone, cuts = [], [], [], []
            for row, raw, offsets in pieces(batch.column(text_at)):
                s = Sentences(raw, offsets)
                counts += np.diff(s.bounds).tolist()
                data = raw.tobytes()
                for r in range(len(offsets) - 1):
                    a, b = int(offsets[r]), int(offsets[r + 1])
                    if not batch.column(text_at)[row + r].is_valid:
                        texts.append(None)
                        gone.append(0)
                        cuts.append([])
                        continue
                    ranges = cover[row + r]
                    if not ranges:
                        texts.append(data[a:b])
                        gone.append(0)
                        cuts.append([])
                        continue
                    edge = np.zeros(int(s.bounds[r + 1] - s.bounds[r]) + 1, np.int64)
                    for c in ranges:
                        edge[c["first"]] += 1
                        edge[c["last"] + 1] -= 1
                    covered = np.cumsum(edge)[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
                    out, at, spans = [], a, []
                    for x, y in zip(turn[::2], turn[1::2]):
                        x0, y0 = int(s.byte_start[s.bounds[r] + x]), int(s.byte_end[s.bounds[r] + y - 1])
                        out.append(data[at:x0])
                        spans.append({"start": len(data[a:x0].decode()), "end": len(data[a:y0].decode())})
                        at = y0
                    texts.append(b"".join([*out, data[at:b]]))
                    gone.append(int(covered.sum()))
                    cuts.append(spans)
            made = {"n_sentences": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "removed": pa.array(cuts, span)}
            names = batch.schema.names
            out = {c: batch.column(i) for i, c in enumerate(names) if i != cover_at}
            out[names[text_at]] = pa.array([t if t is None else t.decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*out.values(), *made.values()], names=[*out, *made])

    return run


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text left, n_sentences (before), n_removed and removed (code point spans cut out)."""
    base = without(docs, "n_sentences n_removed removed")
    roles = {"text": text_col, "_fb_id": "_fb_id", "_fb_th": "_fb_th"}
    joined = packed(_keyed(base, id_col, text_col), **roles).join(repeated_sentences(base, id_col, text_col), ["_fb_id", "_fb_th"], "left")
    rows = joined.select("_fb_row", "text", "cover")
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL("n_sentences long, n_removed long, removed array<struct<start:long,end:long>>").fields])
    return unpacked(rows.mapInArrow(_cut_batches(1, 2), schema), base.columns, {"text": text_col}, "n_sentences n_removed removed")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the spans it loses; a null text has no sentences and loses none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return dedup_spans(docs).select("doc_id", "n_sentences", "n_removed", F.array_join(spans, ",").alias("removed_spans"), F.sha2("text", 256).alias("text_sha256"))
