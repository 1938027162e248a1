"""From evidence to draft rows: candidates, registration, catalogue matching, latest values, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import text as tx
from fieldbook.functions.numbers import to_number
from fieldbook.operators.joins import broadcast_if_small

#: letters of the runs by which names are found in texts
GRAM = 4
#: what stands between words
_BETWEEN = r"[^\p{L}\p{N}]+"


def lines_view(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, li, line): normalised non-empty lines with their position."""
    # normalised before they are rows, so that no condition does so again
    lines = F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda x: tx.norm_space(x))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines).alias("li", "line")).where("line <> ''")


def evidence_candidates(lines: DataFrame, most: int = 80, shortest: int = 6, cut: int = 200) -> DataFrame:
    """(doc_id, n, kind, content): a document's first lines worth citing, measurements first.

    The number of lines a document may register is a feature of the note, applied to each document.
    """
    w = Window.partitionBy("doc_id").orderBy("li")
    first = lines.where(F.length("line") >= shortest).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    kind = F.when(tx.is_measurement(F.col("line")), "measurement").otherwise("record")
    marked = first.select("doc_id", "k", kind.alias("kind"), F.substring("line", 1, cut).alias("content"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy((F.col("kind") == "measurement").desc(), "k"))
    return marked.select("doc_id", n.alias("n"), "kind", "content")


def register_evidence(candidates: DataFrame, most: int = 60) -> DataFrame:
    """Ledger entries (doc_id, id, kind, content, sha256), numbered E1, E2, … within each document's notebook."""
    return candidates.where(F.col("n") <= most).select("doc_id", F.concat(F.lit("E"), F.col("n").cast("string")).alias("id"), "kind", "content", F.sha2("content", 256).alias("sha256"))


def _grams(text: Column, size: int) -> Column:
    """All runs of size characters; found by a pattern that takes none of them away."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _words(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, word): the words of texts, each once."""
    return texts.select(id_col, F.explode(F.array_distinct(F.split(text_col, _BETWEEN))).alias("_fb_word"))


def _in_words(texts: DataFrame, names: DataFrame, text_col: str, size: int) -> DataFrame:
    """(word, pos): which names, each a part of one word, the words of texts contain. A word is compared once, in however many texts it stands."""
    words = _words(texts, text_col, text_col).select("_fb_word").distinct()
    return _in_texts(words.select("_fb_word", F.col("_fb_word").alias("_fb_w")), names, "_fb_word", "_fb_w", size)


def contained(texts: DataFrame, names: DataFrame, id_col: str = "id", text_col: str = "text", size: int = GRAM) -> DataFrame:
    """(id, pos): which names (pos, name) each text contains, letter by letter; empty names are in none.

    A name of letters and digits alone can only stand within a word, so it is looked for in the distinct words of all texts; other
    names are looked for in whole texts. An id must name one text.
    """
    whole, plain = _split_names(names)
    found = _in_texts(texts, whole, id_col, text_col, size)
    if plain is None:
        return found
    return found.unionByName(_words(texts, id_col, text_col).join(_in_words(texts, plain, text_col, size), "_fb_word").select(id_col, "pos").distinct())


def _split_names(names: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Names that may reach over several words, and those that cannot, if there are any."""
    is_plain = F.col("name").rlike(r"^[\p{L}\p{N}]+$")
    plain = names.where(is_plain)
    return names.where(~is_plain), plain if plain.head(1) else None


def _in_texts(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, pos) of names in whole texts.

    Every name is found by one run of ``size`` characters (all of it, if it is shorter), the one that fewest names have. Only
    ids and runs meet in the join, and what shares a run is compared in full, so the work is that of the texts and not
    texts times names.
    """
    named = names.where("name <> ''").select(F.col("pos").alias("_fb_pos"), F.col("name").alias("_fb_name"), F.least(F.lit(size), F.length("name")).alias("g"))
    sizes = [r.g for r in named.select("g").distinct().collect()]  # at most size numbers
    if not sizes:
        return texts.select(id_col, F.lit(0).cast(names.schema["pos"].dataType).alias("pos")).where("false")
    runs = F.coalesce(*[F.when(F.col("g") == g, _grams(F.col("_fb_name"), g)) for g in sizes])
    each = named.select("_fb_pos", "_fb_name", F.explode(runs).alias("gram"))
    common = each.groupBy("gram").agg(F.count("*").alias("times"))
    rare = each.join(common, "gram").groupBy("_fb_pos", "_fb_name").agg(F.min_by("gram", F.struct("times", "gram")).alias("gram"))
    seen = texts.select(F.col(id_col).alias("_fb_id"), F.explode(F.array_distinct(F.concat(*[_grams(F.col(text_col), g) for g in sizes]))).alias("gram"))
    both = seen.join(rare, "gram").select("_fb_id", "_fb_pos", "_fb_name")
    full = both.join(texts.select(F.col(id_col).alias("_fb_id"), F.col(text_col).alias("_fb_text")), "_fb_id")
    return full.where(F.contains("_fb_text", F.col("_fb_name"))).select(F.col("_fb_id").alias(id_col), F.col("_fb_pos").alias("pos")).distinct()


def first_name(texts: DataFrame, names: DataFrame, id_col: str = "id", text_col: str = "text", both_ways: bool = False) -> DataFrame:
    """(id, pos): the first name that a text contains, or with both_ways also one that contains the text; texts without are left out."""
    whole, plain = _split_names(names)
    found = _in_texts(texts, whole, id_col, text_col, GRAM)
    if plain is not None:
        # of a word's names only the first can be a text's first
        first = _in_words(texts, plain, text_col, GRAM).groupBy("_fb_word").agg(F.min("pos").alias("pos"))
        found = found.unionByName(_words(texts, id_col, text_col).join(first, "_fb_word").groupBy(id_col).agg(F.min("pos").alias("pos")))
    if both_ways:
        # the two sides change places: texts are looked for in names
        asked = texts.select(F.col(id_col).alias("pos"), F.col(text_col).alias("name"))
        turned = contained(names.select(F.col("pos").alias("_fb_at"), "name"), asked, "_fb_at", "name")
        found = found.unionByName(turned.select(F.col("pos").alias(id_col), F.col("_fb_at").alias("pos")))
    return found.groupBy(id_col).agg(F.min("pos").alias("pos"))


def match_catalog(evidence: DataFrame, catalog: DataFrame, text: str = "content") -> DataFrame:
    """evidence with metric_key, the key of the first catalogue row (pos, key, name) whose name its text contains in any case.

    Equal texts are looked up once; the catalogue may have any length.
    """
    texts = evidence.select(F.lower(text).alias("text")).where("text is not null").distinct().withColumn("id", F.sha2("text", 256))
    names = catalog.select("pos", F.lower("name").alias("name"))
    found = first_name(texts, names).join(catalog.select("pos", F.col("key").alias("metric_key")), "pos").select("id", "metric_key")
    return evidence.withColumn("id_", F.sha2(F.lower(text), 256)).join(found.withColumnRenamed("id", "id_"), "id_", "left").drop("id_")


def draft_rows(entries: DataFrame, catalog: DataFrame, start: str, end: str) -> DataFrame:
    """(event_id, day, status, metric_key, value): each narrative entry as a metric row, work text, or skipped with a reason."""
    matched = match_catalog(entries, catalog, "text")
    number = to_number(F.regexp_extract("text", r"measured (-?\d+(?:\.\d+)?)", 1))
    off = ~F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    status = (
        F.when(off, "off_period").when(tx.states_no_evidence(F.col("text")), "no_evidence").when(tx.forbidden_rule(F.col("text")).isNotNull(), "forbidden")
        .when(F.col("metric_key").isNotNull() & number.isNotNull(), "metric").otherwise("work")
    )
    return matched.select("event_id", "day", status.alias("status"), "metric_key", number.alias("value"))


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in the given order: a partial aggregate, not a sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def interpretation(latest: DataFrame, catalog: DataFrame) -> DataFrame:
    """(metric_key, sentence): one line for each latest value against its target."""
    wide = latest.join(broadcast_if_small(catalog.select(F.col("key").alias("metric_key"), "target", "direction", F.col("unit").alias("u"))), "metric_key")
    ratio = F.floor(F.col("value") / F.col("target") * 1000 + 0.5) / 10
    v, t = F.format_string("%.2f", "value"), F.format_string("%.2f", "target")
    head = F.concat("metric_key", F.lit(": "), v, "u")
    sentence = (
        F.when(F.col("target").isNull(), F.concat(head, F.lit(" recorded.")))
        .when(F.col("direction") == "lower", F.concat(head, F.lit(" against a limit of "), t, "u", F.lit(".")))
        .when(ratio <= 200, F.concat(head, F.lit(", "), F.format_string("%.1f", ratio), F.lit("% of the target "), t, "u", F.lit(".")))
        .otherwise(F.concat(head, F.lit(" against a target of "), t, "u", F.lit(".")))
    )
    return wide.select("metric_key", sentence.alias("sentence"))


def merge_key(text: Column) -> Column:
    """What makes two draft texts the same: the text without citations and white space."""
    return F.regexp_replace(tx.strip_citations(text), r"\s+", "")


def merge_draft(note: DataFrame, draft: DataFrame, key: str = "event_id", text: str = "text") -> DataFrame:
    """The note's rows and those of the draft whose text the note lacks; the first of equal drafts stays. Idempotent."""
    old = note.select(merge_key(F.col(text)).alias("_fb_key")).distinct()
    first = latest_by(draft.select(merge_key(F.col(text)).alias("_fb_key"), key, text, (-F.col(key)).alias("_fb_o")), ["_fb_key"], ["_fb_o"])
    new = first.join(old, "_fb_key", "left_anti").select(key, text)
    return note.select(key, text).unionByName(new)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is first in the given order."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def same_citations(before: Column, after: Column) -> Column:
    """Whether two texts cite the same evidence, in any order, whatever the length of its numbers."""
    return F.array_sort(tx.citations(before, "+")) == F.array_sort(tx.citations(after, "+"))


def accept_polish(pairs: DataFrame) -> DataFrame:
    """(before, after) with accepted: same citations, no forbidden wording, at least five characters."""
    ok = same_citations(F.col("before"), F.col("after")) & tx.forbidden_rule(F.col("after")).isNull() & (F.length(F.trim("after")) >= 5)
    return pairs.withColumn("accepted", F.coalesce(ok, F.lit(False)))
