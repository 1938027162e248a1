"""Sealed notes as a hash chain: content hashes, seals, verification, revisions, state changes."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.functions.hashing import fields_hash, seal_hash

# The states of a note and where each may go; a sealed note goes nowhere.
TRANSITIONS = {
    "empty": ["queued", "draft"], "queued": ["draft", "empty"], "draft": ["advisory", "rejected", "awaiting_sign", "draft"], "advisory": ["awaiting_sign", "draft"],
    "rejected": ["draft"], "awaiting_sign": ["sealed", "draft"], "sealed": [],
}


def content_hash(notes: DataFrame, fields: list[str]) -> DataFrame:
    return notes.withColumn("content_sha256", fields_hash(*[F.col(f) for f in fields]))


def seal_chain(notes: DataFrame, fields: list[str], chain: str, order: list[str], signer: str = "author") -> DataFrame:
    """notes with content_sha256, prev_seal, seal and chain_pos: each chain is folded in its order, one seal over the last.

    Sealing is sequential within a chain: a chain's notes lie in one partition, sorted, and stream through it with
    only the last seal kept; chains are a project's notes, spread over all tasks. Ties in the order are sealed in order
    of their content hashes.
    """
    hashed = content_hash(notes, fields).withColumn("_fb_sig", F.sha2(F.coalesce(F.col(signer).cast("string"), F.lit("")), 256))
    sorted_ = hashed.repartition(F.col(chain)).sortWithinPartitions(chain, *order, "content_sha256")
    names = [f for f in hashed.columns if f not in ("_fb_sig", "prev_seal", "seal", "chain_pos")]
    schema = T.StructType([hashed.schema[c] for c in names] + T.StructType.fromDDL("prev_seal string, seal string, chain_pos long").fields)

    def fold(batches):
        at, last, pos = object(), "", 0
        for batch in batches:
            rows = zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in (chain, "content_sha256", "_fb_sig")))
            before, seals, places = [], [], []
            for mine, content, signature in rows:
                if mine != at:
                    at, last, pos = mine, "", 0
                before.append(last)
                last, pos = hashlib.sha256(f"{content}{signature}{last}".encode()).hexdigest(), pos + 1
                seals.append(last)
                places.append(pos)
            kept = [batch.column(batch.schema.names.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(before, pa.string()), pa.array(seals, pa.string()), pa.array(places, pa.int64())], names=[*names, "prev_seal", "seal", "chain_pos"])

    return sorted_.mapInArrow(fold, schema)


def verify_chain(sealed: DataFrame, fields: list[str], chain: str, signer: str = "author") -> DataFrame:
    """(chain, notes, checked, first_bad): both the links and the bodies are recomputed; checked counts the good prefix."""
    w = Window.partitionBy(chain).orderBy("chain_pos")
    before = F.lag("seal", 1, "").over(w)
    again = seal_hash(F.col("content_sha256"), F.sha2(F.coalesce(F.col(signer).cast("string"), F.lit("")), 256), F.col("prev_seal"))
    bad = (F.col("prev_seal") != before) | (F.col("seal") != again) | (F.col("content_sha256") != fields_hash(*[F.col(f) for f in fields]))
    marked = sealed.withColumn("bad", bad)
    out = marked.groupBy(chain).agg(F.count("*").alias("notes"), F.min(F.when(F.col("bad"), F.col("chain_pos"))).cast("long").alias("first_bad"))
    return out.select(chain, "notes", F.coalesce(F.col("first_bad") - 1, F.col("notes")).alias("checked"), "first_bad")


def can_move(state: Column, to: Column) -> Column:
    """Whether a note in one state may go to another; null is no state."""
    return F.coalesce(F.concat_ws(">", state, to).isin([f"{a}>{b}" for a, to_ in TRANSITIONS.items() for b in to_]), F.lit(False))


def note_id(start: Column, end: Column, revision: Column) -> Column:
    """RN-yyyymmdd-yyyymmdd, with -Rn for a revision."""
    day = lambda d: F.date_format(d, "yyyyMMdd")
    return F.concat(F.lit("RN-"), day(start), F.lit("-"), day(end), F.when(revision > 0, F.concat(F.lit("-R"), revision.cast("string"))).otherwise(""))


def parse_note_id(text: Column) -> Column:
    """start, end and revision of a note id; null for what is none."""
    p = r"^RN-(\d{8})-(\d{8})(?:-R(\d+))?$"
    day = lambda k: F.try_to_timestamp(F.nullif(F.regexp_extract(text, p, k), F.lit("")), F.lit("yyyyMMdd")).cast("date")
    ok = text.rlike(p) & day(1).isNotNull() & day(2).isNotNull()
    revision = F.coalesce(F.nullif(F.regexp_extract(text, p, 3), F.lit("")).cast("int"), F.lit(0))
    return F.when(ok, F.struct(day(1).alias("start"), day(2).alias("end"), revision.alias("revision")))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(name, status): ok, missing or changed, by hash, for every file a manifest lists."""
    found = files.select("name", F.col("actual").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed").otherwise("ok")
    return manifest.join(found, "name", "left").select("name", status.alias("status"))
