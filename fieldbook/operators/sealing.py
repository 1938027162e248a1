"""Sealing notes onto chains that exist already, in any number of steps, and verifying what the seals cover.

A chain is a project's sealed notes. Each seal covers the note's content hash, the digest of all its signatures with
signer, stage and time, and the seal before it, so neither content nor signers nor order can change unseen. A step
reads only the last seal of each chain, not the chain, and folds the newly approved notes onto it.

Notes here have project, note_id, state, author, content_sha256, signatures (array of signer, stage, signed_at), history (array of at,
by, what), and prev_seal, seal and chain_pos, null until they are sealed. project and note_id name one note.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.hashing import seal_hash
from fieldbook.operators.lifecycle import seal_blocker
from fieldbook.operators.seal import note_id

SIGNATURES = "array<struct<signer:string,stage:string,signed_at:string>>"
HISTORY = "array<struct<at:string,by:string,what:string>>"
_SEALS = "project {project}, note_id {note_id}, prev_seal string, seal string, chain_pos long"


def signatures_hash(signatures: Column | str = "signatures") -> Column:
    """SHA-256 over all signatures in their order, each field with its length before it."""
    column = F.col(signatures) if isinstance(signatures, str) else signatures
    field = lambda x: F.coalesce(F.concat(F.char_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    each = F.transform(F.coalesce(column, F.array().cast(SIGNATURES)), lambda s: F.concat(field(s["signer"]), field(s["stage"]), field(s["signed_at"])))
    return F.sha2(F.array_join(each, ";"), 256)


def _fold(batches):
    """Seals of rows (project, note_id, content, digest, tail, tail_pos) in order, a chain beginning at its tail."""
    at, last, pos = object(), "", 0
    for batch in batches:
        before, seals, places = [], [], []
        for project, _, content, digest, tail, tail_pos in zip(*(c.to_pylist() for c in batch.columns)):
            if project != at:
                at, last, pos = project, tail or "", tail_pos or 0
            before.append(last)
            last, pos = hashlib.sha256(f"{content}{digest}{last}".encode()).hexdigest(), pos + 1
            seals.append(last)
            places.append(pos)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.string()), pa.array(seals, pa.string()), pa.array(places, pa.int64())], names=["project", "note_id", "prev_seal", "seal", "chain_pos"])


def seal_notes(notes: DataFrame, approvals: DataFrame, expected: Column, allow_advisory: bool = True, allow_self: bool = False) -> DataFrame:
    """notes with those approved sealed, and blocker: why an approved note was not (see seal_blocker), else null.

    approvals: project, note_id, approver, at (text that sorts by time); the first approval of a note counts. expected is the
    content hash the note should have. Approved notes that nothing blocks get the approver's final signature, an entry
    in their history and the state sealed; their seals go on from the last one of the project's chain, in order
    of approval, equal times by note_id. All other notes stay as they are. Sealing is sequential within a chain: its new
    notes stream through one task with only the last seal kept, all chains at once.
    """
    first = approvals.groupBy("project", "note_id").agg(F.min(F.struct(F.col("at").cast("string").alias("at"), "approver")).alias("_fb_a"))
    wide = notes.join(first, ["project", "note_id"], "left").withColumns({"approver": F.col("_fb_a.approver"), "_fb_at": F.col("_fb_a.at")})
    wide = wide.withColumn("blocker", F.when(F.col("_fb_at").isNotNull(), seal_blocker(expected, allow_advisory, allow_self)))
    ready = F.col("_fb_at").isNotNull() & F.col("blocker").isNull()
    signed = F.concat(F.coalesce("signatures", F.array().cast(SIGNATURES)), F.array(F.struct(F.col("approver").alias("signer"), F.lit("final_approval").alias("stage"), F.col("_fb_at").alias("signed_at"))))
    told = F.concat(F.coalesce("history", F.array().cast(HISTORY)), F.array(F.struct(F.col("_fb_at").alias("at"), F.col("approver").alias("by"), F.lit("approved and sealed").alias("what"))))

    tails = notes.where("state = 'sealed'").groupBy("project").agg(F.max_by(F.struct("seal", "chain_pos"), "chain_pos").alias("t")).select("project", F.col("t.seal").alias("tail"), F.col("t.chain_pos").alias("tail_pos"))
    new = wide.where(ready).select("project", "note_id", F.col("content_sha256").alias("content"), signatures_hash(signed).alias("digest"), F.col("_fb_at"))
    ordered = new.join(tails, "project", "left").repartition("project").sortWithinPartitions("project", "_fb_at", "note_id").select("project", "note_id", "content", "digest", "tail", F.col("tail_pos").cast("long"))
    kinds = {c: notes.schema[c].dataType.simpleString() for c in ("project", "note_id")}
    seals = ordered.mapInArrow(_fold, _SEALS.format(**kinds)).select("project", "note_id", F.struct("prev_seal", "seal", "chain_pos").alias("_fb_s"))
    done = wide.join(seals, ["project", "note_id"], "left")
    now = F.col("_fb_s").isNotNull()
    changed = {"state": F.lit("sealed"), "signatures": signed, "history": told, "prev_seal": F.col("_fb_s.prev_seal"), "seal": F.col("_fb_s.seal"), "chain_pos": F.col("_fb_s.chain_pos")}
    return done.select(*[(F.when(now, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)) for c in notes.columns], "blocker")


def verify_seals(notes: DataFrame, expected: Column) -> DataFrame:
    """(project, notes, checked, first_bad, fault) of the sealed notes: how many of a chain are sound from its beginning.

    fault is what the first bad note fails: content (its hash is not the one expected), link (not the seal before it), or seal
    (content, signatures or link are not those that were sealed).
    """
    w = Window.partitionBy("project").orderBy("chain_pos", "note_id")
    fault = (
        F.when(~F.col("content_sha256").eqNullSafe(expected), "content")
        .when(~F.col("prev_seal").eqNullSafe(F.lag("seal", 1, "").over(w)) | (F.col("chain_pos") != F.row_number().over(w)), "link")
        .when(~F.col("seal").eqNullSafe(seal_hash(F.col("content_sha256"), signatures_hash(), F.col("prev_seal"))), "seal")
    )
    marked = notes.where("state = 'sealed'").withColumns({"fault": fault, "at": F.row_number().over(w)})
    out = marked.groupBy("project").agg(F.count("*").alias("notes"), F.min(F.when(F.col("fault").isNotNull(), F.struct(F.col("at").cast("long").alias("at"), "fault"))).alias("bad"))
    return out.select("project", "notes", F.coalesce(F.col("bad.at") - 1, F.col("notes")).alias("checked"), F.col("bad.at").alias("first_bad"), "bad.fault")


def revise(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """New drafts for the sealed notes that are asked for (project, note_id, at, by), with one more entry of history.

    notes also have start, end, revision and supersedes. A draft has the content of the note it supersedes, the next number
    of that note's slot not yet taken, no signatures and no seal. Requests for notes that are not sealed give none;
    of several requests for one note the first counts.
    """
    asked = requests.groupBy("project", "note_id").agg(F.min(F.struct(F.col("at").cast("string").alias("at"), "by")).alias("_fb_r"))
    last = notes.groupBy("project", "start", "end").agg(F.max("revision").alias("_fb_last"))
    found = notes.where("state = 'sealed'").join(asked, ["project", "note_id"]).join(last, ["project", "start", "end"])
    # notes of one slot that are asked for at once get numbers of their own
    nth = F.row_number().over(Window.partitionBy("project", "start", "end").orderBy("revision", "note_id"))
    found = found.withColumns({"_fb_n": (F.col("_fb_last") + nth).cast(notes.schema["revision"].dataType)})
    made = note_id(F.col("start"), F.col("end"), F.col("_fb_n"))
    what = F.concat(F.lit("revised: "), F.col("note_id"), F.lit(" to "), made)
    told = F.concat(F.coalesce("history", F.array().cast(HISTORY)), F.array(F.struct(F.col("_fb_r.at").alias("at"), F.col("_fb_r.by").alias("by"), what.alias("what"))))
    new = {"note_id": made, "revision": F.col("_fb_n"), "supersedes": F.col("note_id"), "state": F.lit("draft"), "signatures": F.array().cast(SIGNATURES), "history": told, "prev_seal": F.lit(None).cast("string"), "seal": F.lit(None).cast("string"), "chain_pos": F.lit(None).cast("long")}
    return found.select(*[(new[c].alias(c) if c in new else F.col(c)) for c in notes.columns])
