"""Conversation structure repair: window flags, sorted turn structs, and a fold over the cheapest edits.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. Reading turn by turn, that is an automaton of
four states: nothing yet, after a system turn, after a user turn, after an assistant turn. Windows number the turns
and flag their faults; the sorted turns are folded by aggregate(), which carries for each state the least
(cost, audit) that leads there. Edits and their letters: Keep 0, Rerole to user or assistant 2, Delete 3 (required for
blank and duplicate turns), Insert an empty user or assistant turn 2; a truncated turn that stays costs 1 more. Of
audits of equal cost the least in ASCII order wins. Audits that reach a state after the same turns with the same cost
never begin with one another, as they differ in more than inserts, so the least prefix stays the least.

A conversation of any length is folded in blocks of BLOCK turns, from each of the four states, on different tasks; a
second fold puts the blocks' paths together. So no row holds the turns of a whole conversation, and the strings that
grow turn by turn stay short. Only its audit, a letter or so a turn, is one value. Texts are never collected: the edits
join the turns, and the SHA-256 of a repaired conversation is updated turn by turn in a sorted stream.

Defined cases: a null role or text is one space; a null turn comes first and counts for no gap; rows of one turn are
in order of role and text; all rows without an id are one conversation; an empty table gives none. Other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm.scratch import quoted, written

BLOCK = 64
STATES = range(4)
#: the cost of a state that nothing leads to
NEVER = 1 << 40
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"


def flagged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, turn, role, text, initial, fault, illegal, new_turn): the rows in order, from 0, with their flags.

    fault is blank, duplicate, truncated or empty; illegal says that the initials of the row before and of this one may
    not follow each other; new_turn that no row before has its turn.
    """
    space = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(" "))
    rows = turns.select(quoted(conv_col).alias("conv_id"), quoted(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("initial", F.substring("role", 1, 1))
    pair = F.concat(F.lag("initial").over(order), "initial")
    rows = rows.withColumns(
        {
            "pos": F.row_number().over(order).cast("long") - 1,
            "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)),
            "new_turn": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)),
        }
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", "blank").when(seen, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return rows.select("conv_id", "pos", "turn", "role", "text", "initial", fault.alias("fault"), "illegal", "new_turn")


def _more(path: Column, cost, letter: str) -> Column:
    return F.struct((path["cost"] + cost).alias("cost"), F.concat(path["audit"], F.lit(letter)).alias("audit"))


def _inserted(s: list[Column]) -> list[Column]:
    """The least paths where turns may be inserted next; two are enough, as a third leads back."""
    user = F.least(s[2], *[_more(s[k], INSERT, "I") for k in (0, 1, 3)])
    return [s[0], s[1], user, F.least(s[3], _more(user, INSERT, "I"))]


def _step(acc: Column, turn: Column) -> Column:
    """The least paths after one more turn."""
    s = _inserted([acc[f"s{k}"] for k in STATES])
    gone = turn["fault"].isin("blank", "duplicate")
    extra = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    before_user = F.least(s[0], s[1], s[3])

    def stay(path: Column, role: str) -> Column:
        return F.when(~gone, F.when(turn["initial"] == role, _more(path, extra, "K")).otherwise(_more(path, extra + REROLE, "R")))

    system = F.when(~gone & (turn["initial"] == "s"), _more(s[0], extra, "K"))
    # least() passes over what is null, an edit that this turn does not allow
    ways = [[], [system], [stay(before_user, "u")], [stay(s[2], "a")]]
    return F.struct(*[(F.least(_more(s[k], DELETE, "D"), *ways[k]) if ways[k] else _more(s[k], DELETE, "D")).alias(f"s{k}") for k in STATES])


def _start(state: int) -> Column:
    return F.struct(*[F.struct(F.lit(0 if k == state else NEVER).cast("long").alias("cost"), F.lit("").alias("audit")).alias(f"s{k}") for k in STATES])


def _joined(acc: Column, block: Column) -> Column:
    """The least paths through a further block."""
    out = []
    for y in STATES:
        ways = []
        for x in STATES:
            a, b = acc[f"s{x}"], block[f"p{x}"][f"s{y}"]
            ways.append(F.when(block[f"p{x}"].isNotNull(), F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"))))
        out.append(F.least(*ways).alias(f"s{y}"))
    return F.struct(*out)


def plan_repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of flagged rows."""
    faults = {k: F.col("fault") == k for k in ("blank", "duplicate", "truncated")} | {"illegal": F.col("illegal"), "turns": F.col("new_turn")}
    blocks = rows.groupBy("conv_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "initial", "fault"))).alias("rows"),
        F.min("turn").alias("lowest"),
        F.max("turn").alias("highest"),
        *[F.count_if(c).alias(k) for k, c in faults.items()],
    )
    paths = [F.aggregate("rows", _start(k), _step) for k in STATES]
    # the first block begins in state 0
    paths = F.struct(*[(p if k == 0 else F.when(F.col("block") > 0, p)).alias(f"p{k}") for k, p in enumerate(paths)])
    found = blocks.withColumn("paths", paths).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "paths"))).alias("blocks"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        *[F.sum(k).alias(k) for k in faults],
    )

    def finish(acc: Column) -> Column:
        s = _inserted([acc[f"s{k}"] for k in STATES])
        return F.least(s[0], s[3])

    best = F.aggregate(F.col("blocks.paths"), _start(0), _joined, finish)
    gaps = F.coalesce(F.col("highest") - F.col("lowest") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return found.withColumn("best", best).select("conv_id", gaps.alias("gaps"), *list(faults)[:4], "best.cost", "best.audit")


def _walk(batches):
    """The repaired turns of rows in order: what is kept, reroled or inserted."""
    at, last = object(), ""
    for batch in batches:
        out = []
        for conv, role, text, edits in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != at:
                at, last = conv, ""
            for edit in edits:
                if edit == "D":
                    continue
                mine = role if edit == "K" else "assistant" if last == "u" else "user"
                out.append((conv, edit, mine, "" if edit == "I" else text))
                last = mine[:1]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_walked(batch.schema))], schema=_walked(batch.schema))


def _walked(schema: pa.Schema) -> pa.Schema:
    return pa.schema([pa.field("conv_id", schema.field(0).type), pa.field("edit", pa.string()), pa.field("role", pa.string()), pa.field("text", pa.string())])


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, edit, role, text): the turns of the repaired conversations; each lies in one partition, in order."""
    # what stands before each turn and its own letter; the last has the inserts at the end too
    each = F.posexplode(F.regexp_extract_all("audit", F.lit(r"I*[DKR](?:I+\z)?"), F.lit(0)))
    edits = plans.select(F.col("conv_id").alias("c"), each.alias("p", "edits"))
    both = rows.join(edits, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "role", "text", "edits")
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL("edit string, role string, text string").fields])
    return ordered.mapInArrow(_walk, schema)


def _digest(batches):
    """The SHA-256 of each conversation's lines, in a stream."""
    at, digest, schema = None, None, None
    for batch in batches:
        schema, done = pa.schema([pa.field("conv_id", batch.schema.field(0).type), pa.field("repaired_sha256", pa.string())]), []
        for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if digest is None or conv != at:
                if digest is not None:
                    done.append((at, digest.hexdigest()))
                at, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(schema)], schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], schema.field(0).type), pa.array([digest.hexdigest()])], schema=schema)


def repair(turns: DataFrame, conv_col: str = "conv_id", **columns: str) -> DataFrame:
    """A row a conversation: conv_id, gaps, the counts of faults, cost, audit and repaired_sha256."""
    rows = written(flagged(turns, conv_col, **columns))
    plans = written(plan_repair(rows))
    schema = T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    hashes = repaired_turns(rows, plans).mapInArrow(_digest, schema).withColumnRenamed("conv_id", "c")
    out = plans.join(hashes, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def damaged(turns: DataFrame) -> DataFrame:
    """turns with faults put in by the CRC of `conv_id:turn`, a null being one space: 1 in 20 each of five kinds."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), k.alias("k")).where("k != 0")
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged and repaired; one whose rows all went has zeros and an empty audit."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair(damaged(turns))
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations, crc),
hurt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM hurt),
rows_ AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || substr(role, 1, 1) AS pair,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
              WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN '' ELSE 't' END AS fault
  FROM placed),
heads AS (
  SELECT c.conv_id, count(r.pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN rows_ AS r ON c.conv_id IS NOT DISTINCT FROM r.conv_id GROUP BY c.conv_id),
-- of each conversation and place, the paths (cost, audit, repaired lines) that end in each state
p(conv_id, pos, state, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '', []::VARCHAR[] FROM heads
  UNION ALL
  SELECT conv_id, pos, state, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, pos, state ORDER BY cost, audit) AS best FROM (
      SELECT w.conv_id, r.pos, e.state, w.cost + e.cost AS cost, w.audit || e.letter AS audit, w.lines || e.line AS lines
      FROM (
        SELECT conv_id, pos, state, cost, audit, lines FROM p
        UNION ALL
        SELECT conv_id, pos, CASE state WHEN 2 THEN 3 ELSE 2 END, cost + 2, audit || 'I', lines || [CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END] FROM p
        UNION ALL
        SELECT conv_id, pos, 3, cost + 4, audit || 'II', lines || ['user:', 'assistant:'] FROM p WHERE state < 2) AS w
      JOIN rows_ AS r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = w.pos + 1,
      LATERAL (
        SELECT w.state AS state, 3 AS cost, 'D' AS letter, []::VARCHAR[] AS line
        UNION ALL
        SELECT CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE fault WHEN 't' THEN 1 ELSE 0 END, 'K', [role || ':' || text]
        WHERE fault IN ('', 't') AND (initial = 's' AND w.state = 0 OR initial = 'u' AND w.state <> 2 OR initial = 'a' AND w.state = 2)
        UNION ALL
        SELECT CASE w.state WHEN 2 THEN 3 ELSE 2 END, CASE fault WHEN 't' THEN 3 ELSE 2 END, 'R', [CASE w.state WHEN 2 THEN 'assistant:' ELSE 'user:' END || text]
        WHERE fault IN ('', 't')) AS e))
  WHERE best = 1),
ends AS (
  SELECT conv_id, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS best FROM (
      SELECT p.conv_id, p.cost + x.cost AS cost, p.audit || x.letters AS audit, p.lines || x.line AS lines
      FROM p JOIN heads AS h ON p.conv_id IS NOT DISTINCT FROM h.conv_id AND p.pos = h.n,
      LATERAL (
        SELECT 0 AS cost, '' AS letters, []::VARCHAR[] AS line WHERE state IN (0, 3)
        UNION ALL SELECT 2, 'I', ['assistant:'] WHERE state = 2
        UNION ALL SELECT 4, 'II', ['user:', 'assistant:'] WHERE state < 2) AS x))
  WHERE best = 1)
SELECT h.conv_id, h.gaps, h.blank, h.duplicate, h.truncated, h.illegal, e.cost, e.audit, sha256(array_to_string(e.lines, chr(10))) AS repaired_sha256
FROM heads AS h JOIN ends AS e ON h.conv_id IS NOT DISTINCT FROM e.conv_id
"""
