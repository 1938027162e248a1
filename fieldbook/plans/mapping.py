"""Notebook entities as views over the test tables.

The tables hold commerce rows, so entities are composed from them by fixed rules (see each function).
Defects that the gates must find are set by fixed moduli of the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 14

#: metric key, name, unit, target, direction, monotonic
CATALOG = [
    ("click", "click", "%", 60.0, "higher", True),
    ("view", "view", "건", None, "higher", False),
    ("purchase", "purchase", "%", 25.0, "lower", False),
    ("signup", "signup", "%", 80.0, "higher", True),
    ("login", "login", "건", 100.0, "lower", False),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *row) for k, row in enumerate(CATALOG)], "pos int, key string, name string, unit string, target double, direction string, monotonic boolean")


def narrative(events: DataFrame, *more: Column | str) -> DataFrame:
    """(event_id, day, event_type, text, more…): a sentence an event, with defects by modulus of the id."""
    e, day = F.col("event_id"), F.to_date("ts")
    cite = (
        F.when(e % 11 == 0, "")
        .when(e % 13 == 0, F.concat(F.lit(" [E"), (e - e % 97).cast("string"), F.lit("]")))
        .otherwise(F.concat(F.lit(" [E"), e.cast("string"), F.lit("]")))
    )
    text = F.concat(
        F.when(e % 17 == 0, "It appears to be ").when(e % 23 == 0, "おそらく ").otherwise(""),
        day.cast("string"), F.lit(" — "), "event_type", F.lit(" measured "), F.format_string("%.2f", "value"), F.lit("%"),
        F.when(e % 19 == 0, " 약 30%").otherwise(""), cite, F.lit("."),
    )
    text = F.when(e % 29 == 0, "해당 기간 관련 증거 없음.").otherwise(text)
    return events.select("event_id", day.alias("day"), "event_type", "value", text.alias("text"), *more)


def ledger(events: DataFrame) -> DataFrame:
    """(id, kind, day, content, value, unit): evidence an event; every 97th is left out."""
    content = F.concat("event_type", F.lit(" "), F.format_string("%.2f", "value"))
    return events.where("event_id % 97 <> 0").select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("id"),
        F.lit("measurement").alias("kind"),
        F.to_date("ts").alias("day"),
        content.alias("content"),
        "value",
        F.when(F.col("event_id") % 2 == 0, "%").otherwise("건").alias("unit"),
        F.sha2(content, 256).alias("sha256"),
    )


def metric_rows(events: DataFrame, *more: Column | str) -> DataFrame:
    """Metric rows of notes: raw value text, unit by parity, some not numeric, some without evidence."""
    e = F.col("event_id")
    return events.select(
        e.alias("row_id"),
        F.to_date("ts").alias("day"),
        F.col("event_type").alias("metric_key"),
        F.when(e % 31 == 0, "n/a").when(e % 37 == 0, "").otherwise(F.format_string("%.2f", "value")).alias("value"),
        F.when(e % 2 == 0, "%").otherwise("건").alias("unit"),
        F.when(e % 7 == 0, "target met").when(e % 41 == 0, "not achieved").otherwise("").alias("achieved"),
        F.when(e % 43 == 0, F.lit(None)).otherwise(F.concat(F.lit("E"), e.cast("string"))).alias("evidence"),
        *more,
    )


def notes(orders: DataFrame, start: str = "1995-01-01") -> DataFrame:
    """A note an order: project = customer, period = the 14-day sprint of its date, state by status."""
    day, first = F.to_date("o_orderdate"), F.lit(start).cast("date")
    seq = F.floor(F.datediff(day, first) / STEP).cast("int")
    begin = F.date_add(first, seq * STEP)
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        o.alias("note_id"),
        c.alias("project"),
        (seq + 1).alias("sprint"),
        begin.alias("start"),
        F.date_add(begin, STEP - 1).alias("end"),
        F.when(F.col("o_orderstatus") == "F", "sealed").when(F.col("o_orderstatus") == "O", "draft").otherwise("awaiting_sign").alias("state"),
        F.when(o % 47 == 0, "").otherwise(F.concat(F.lit("u"), (c % 50).cast("string"))).alias("author"),
        F.when(o % 53 == 0, F.concat(F.lit(" u"), (c % 50).cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("r"), (o % 20).cast("string"))).alias("reviewer"),
        day.alias("written_on"),
        F.round("o_totalprice", 2).alias("value"),
        F.col("o_orderpriority").alias("priority"),
    )


def attachments(documents: DataFrame) -> DataFrame:
    """A file a document, with its declared hash; every 23rd is upper-cased, every 29th cut."""
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    declared = F.when(F.col("doc_id") % 23 == 0, F.upper(h)).when(F.col("doc_id") % 29 == 0, F.left(h, F.lit(40))).otherwise(h)
    name = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select("doc_id", name.alias("name"), declared.alias("sha256"), h.alias("actual"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
