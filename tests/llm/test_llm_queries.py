"""Registered queries of the training-data operators against their SQL or a brute-force version."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_DIR, duck_rows, spark_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from fieldbook.llm import licenses, media, mixing, pii, quality, substring_dedup
from fieldbook.llm.decontaminate import OP1_SQL
from fieldbook.llm.line_dedup import OP9_SQL
from fieldbook.llm.near_dedup import OP10_SQL
from fieldbook.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == duck_rows(duck, ORACLE_SQL[name])


# --- substring dedup: the same spans, found with tuples of words and dictionaries


def word_hash(word: str) -> int:
    return word_hash_bytes(word.encode())


def word_hash_bytes(word: bytes) -> int:
    """The hash of a word, from its definition."""
    x = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(word)) % (1 << 64)
    for times in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> 33)) * times % (1 << 64)
    return x ^ (x >> 33)


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_sentences(text: str) -> list[tuple[str, ...]]:
    out = []
    for part in re.split(r"(?<=\n)|(?<=[.!?])(?=[\x20\x09-\x0D])", text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(part))
        if not words:
            continue
        h, n = [word_hash(w) for w in words], len(words)
        cuts = [k for k in range(4, n - 3) if n > 10 and h[k] < min(h[k - 3 : k]) and h[k] <= min(h[k + 1 : k + 4])]
        parts = list(zip([0, *cuts], [*cuts, n]))
        while parts:
            x, y = parts.pop()
            if y - x > 10:
                k = min(range(x + 4, y - 3), key=lambda k: (h[k], abs(2 * k - x - y), k))
                parts += [(x, k), (k, y)]
            else:
                cuts.append(x)
        cuts = sorted(set(cuts))
        out += [tuple(words[x:y]) for x, y in zip(cuts, [*cuts[1:], n])]
    return out


def brute_spans(rows: list[tuple[int, str]]) -> dict[int, int]:
    """How many sentences each document loses."""
    cut = {i: plain_sentences(text or "") for i, text in rows}
    home, spans = {}, defaultdict(list)
    for i in sorted(cut):
        seen = set()
        for a in range(len(cut[i]) - 1):
            span = cut[i][a] + cut[i][a + 1]
            spans[i].append((a, a + 2, span in seen or home.get(span, i) != i))
            seen.add(span)
        for span in seen:
            home.setdefault(span, i)
    return {i: len({k for a, b, again in spans[i] if again for k in range(a, b)}) for i in cut}


def test_substring_dedup_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    expected = brute_spans([(r.doc_id, r.text) for r in docs.collect()])
    found = {r.doc_id: r.n_removed for r in QUERIES["op2_substring_dedup"](spark, SF_DIR).collect()}
    assert found == expected and sum(v > 0 for v in found.values()) > 5


@pytest.mark.parametrize("mark", ["", ".", ",\n"])
def test_shared_passages_of_fifty_words_are_found_in_any_surroundings(spark, mark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passages = [[word() for _ in range(52)] for _ in range(6)]
    rows = []
    for p, passage in enumerate(passages):
        for k in range(4):
            before, after = ([word() for _ in range(rng.integers(1, 90))] for _ in range(2))
            rows.append((10 * p + k, " ".join([*before, *passage[:30], passage[30] + mark, *passage[31:], *after])))
    clean = [(900 + k, " ".join(word() + "." * (i % 9 == 0) for i in range(200))) for k in range(5)]
    out = {r.doc_id: r for r in substring_dedup.dedup_spans(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    for i, text in rows + clean:
        assert (out[i].n_removed > 0) == (i < 900 and i % 10 > 0), i
        if out[i].n_removed == 0:
            assert out[i].text == text
        else:
            (span,) = out[i].removed
            assert out[i].text == text[: span.start] + text[span.end :] and 20 <= len(text[span.start : span.end].split()) <= 52


def test_repeated_runs_are_removed_whole(spark):
    """Copies with their tails, short boilerplate, and planted passages up to their partial edge sentences."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    words = lambda n: " ".join(word() for _ in range(n))
    copy, foot, long = f"{words(10)}. {words(10)}. {words(5)}.", "All rights reserved. Do not copy.", words(95) + "."
    passages = [" ".join(words(n) + "." for n in (9, 14, 6, 3, 18)) for _ in range(20)]
    rows = [(1, copy), (2, copy), (3, f"{words(7)}.\n{foot}"), (4, f"{foot}\n{words(4)}. {words(6)}."), (5, long), (6, long)]
    rows += [(10 + 2 * p + k, f"{words(int(rng.integers(1, 40)))}. {passage} {words(int(rng.integers(1, 40)))}.") for p, passage in enumerate(passages) for k in (0, 1)]
    bare = [words(50) for _ in range(20)]
    rows += [(100 + 2 * p + k, f"{words(int(rng.integers(1, 40)))} {passage} {words(int(rng.integers(1, 40)))}.") for p, passage in enumerate(bare) for k in (0, 1)]
    out = {r.doc_id: r for r in substring_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].n_removed == 0 for i, _ in rows if i in (1, 3, 5) or i >= 10 and i % 2 == 0)
    assert out[2].text == "" and out[6].text == "" and foot.split()[0] not in out[4].text and out[4].n_removed == 2
    for p, passage in enumerate(passages):
        assert not set(passage.replace(".", "").split()) & set(out[11 + 2 * p].text.replace(".", "").split())
    left = [len(set(passage.split()) & set(out[101 + 2 * p].text.replace(".", "").split())) for p, passage in enumerate(bare)]
    assert max(left) <= 2 * 13 and out[101].n_removed > 1


# --- personal data: the plain patterns over whole texts

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), kind) for kind, pattern, ok in PATTERNS for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_matches_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    total = Counter()
    for r in QUERIES["op3_pii"](spark, SF_DIR).collect():
        spans = base_spans(texts[r.doc_id] or "")
        total.update(k for _, _, k in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in spans) for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
    assert all(total[k] for k in ("email", "card", "phone"))


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.one_of(st.text(alphabet="0123456789 .-+@()aZ_é\n", max_size=60), st.lists(st.sampled_from(["1.2.3.4", "256.1.1.1", "a@b.c", "+1 (555) 010-0199", "4111 1111 1111 1111", "@", ".", "-", " ", "5", "x"]), max_size=14).map("".join)))
def test_pii_parsers_match_patterns(text):
    assert [s for s in pii.find_spans(text, pii.automaton()) if s[2] in pii.BASE] == base_spans(text)


@pytest.mark.parametrize("unit", ["account" + " " * 100_000, " ", "7", "@", "account ", "+1 ", "www.", "a@b", "IBAN DE", "1.2."])
def test_pii_takes_linear_time(unit):
    """A megabyte of what could make a parser read on and on."""
    anchors, took = pii.automaton(), []
    for size in (250_000, 1_000_000):
        text = unit * (size // len(unit))
        began = time.process_time()
        pii.find_spans(text, anchors)
        took.append(time.process_time() - began)
    assert took[1] < 30 and took[1] < 12 * took[0] + 0.5


def test_mix_meets_its_targets(spark):
    """Every source of the larger table within one document's size."""
    rows = QUERIES["op5_mixing"](spark, SF_DIR.replace("sf0.001", "sf0.01")).join(spark.read.parquet(f"{SF_DIR.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("longest")).collect():
        assert abs(r.taken - r.target) <= r.longest, r


def test_each_document_has_the_chance_of_the_fraction(spark):
    """Over many seeds, a document of any size gets its further copy as often as its source's rate says."""
    sizes = {"long": [1000] + [10] * 9, "one": [50], "two": [7, 300], "even": [20] * 12, "mixed": list(range(1, 24))}
    docs = [(100 * k + j, "w " * n, s) for k, (s, each) in enumerate(sizes.items()) for j, n in enumerate(each)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1)
    slim = df.select("doc_id", "source", mixing.source_key("source").alias("_fb_key"), mixing.text_size().alias("size"))
    # the cuts of many seeds at once: the seed is part of the source
    seeds, rates = 300, {"long": 0.3, "one": 0.6, "two": 1.25, "even": 0.45, "mixed": 0.1}
    many = slim.crossJoin(spark.range(seeds).withColumnRenamed("id", "seed")).withColumns({"_fb_key": F.concat("_fb_key", F.lit(" "), "seed"), "d": mixing._number(F.concat(F.col("seed").cast("string"), F.lit(":"), "doc_id"))})
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col("source"))
    targets = many.groupBy("_fb_key", "source").agg(F.sum("size").alias("source_size")).select("_fb_key", "source_size", (rate * F.col("source_size")).alias("target"))
    cut = mixing.cuts(many.select("_fb_key", "size", "d"), targets, "s:")
    out = many.join(cut, ["_fb_key", "size"]).withColumn("copies", F.col("times") + (F.col("d") < F.col("below")).cast("long")).toPandas()
    for (source, _), mine in out.groupby(["source", "doc_id"]):
        f = rates[source] % 1
        assert abs((mine.copies - int(rates[source])).mean() - f) <= 4 * (f * (1 - f) / seeds) ** 0.5, (source, mine.size)
    out["taken"] = out["copies"] * out["size"]
    for _, mine in out.groupby("_fb_key"):
        assert abs(mine.taken.sum() - mine.target.iloc[0]) <= mine["size"].max()


def test_pii_added_kinds_and_redaction(spark):
    rows = [(1, "see https://a.example/x?y=1 or mail me@site.org"), (2, "IBAN DE89 3704 0044 0532 0130 00 ok"), (3, "account no. 12345678"), (4, "IBAN DE00 3704 0044 0532 0130 00"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: [s.kind for s in r.spans] for r in pii.find_pii(docs).collect()} == {1: ["url", "email"], 2: ["account"], 3: ["account"], 4: [], 5: []}
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[1] == "see [URL] or mail [EMAIL]" and out[3] == "account no. [ACCOUNT]" and out[5] is None


# --- copied images: the same confirmation over all pairs


def test_image_copies_match_brute_force(spark, tmp_path):
    """The query over a small table of vectors, with equal, near, repeated and null ones."""
    rng = np.random.default_rng(8)
    vectors = [rng.normal(0, 1, 64).tolist() for _ in range(36)]
    vectors += [vectors[0], (np.array(vectors[1]) + rng.normal(0, 0.02, 64)).tolist(), (np.array(vectors[1]) + rng.normal(0, 0.02, 64)).tolist(), None]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    pictures = {r.image_id: bytes(r.content) for r in media.drawn_images(spark.read.parquet(f"{tmp_path}/embeddings.parquet")).collect()}
    found = {i: media.describe_stack(media.decode(c)[None])[0] for i, c in pictures.items()}
    name = {i: i for i in found}

    def root(i):
        return i if name[i] == i else root(name[i])

    for a in found:
        for b in found:
            if a < b and root(a) != root(b) and (pictures[a] == pictures[b] or media.agree(*found[a], *found[b]) or media.agree(*found[b], *found[a])):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    out = {r.image_id: r for r in QUERIES["op4_image_copies"](spark, str(tmp_path)).collect()}
    assert {i: r.class_id for i, r in out.items()} == {i: root(i) for i in found}
    assert all(out[i].n_corners == len(found[i][0]) for i in found) and len({root(i) for i in found}) == 38  # 36 pictures, and a flat one whose crop has no corners either


# --- the rest


def test_license_cues_lose_nothing(spark):
    """Units with a share of a template's words, with and without the cue filter."""
    rng = np.random.default_rng(3)
    rows = []
    for k, (_, text) in enumerate(licenses.TEMPLATES * 12):
        words = text.split()
        keep = [w for w in words if rng.random() < 0.93] + ["more"] * int(rng.integers(0, 3))
        rows.append((k, " ".join(keep)))
    docs, templates = spark.createDataFrame(rows, "doc_id long, text string"), licenses.template_table(spark)
    with_cues = spark_rows(licenses.scan_licenses(docs, templates))
    known, licenses.CUE_BIGRAMS = licenses.CUE_BIGRAMS, 0
    try:
        assert with_cues == spark_rows(licenses.scan_licenses(docs, templates)) and 50 < len(with_cues[1]) < len(rows)
    finally:
        licenses.CUE_BIGRAMS = known


def test_language_id_held_out(spark):
    sf = SF_DIR.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = QUERIES["op7_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.97 and n > 100
    assert found.where("score < 0 or score > 1").count() == 0


def plain_ngrams(text: str) -> list[int]:
    """Buckets of the 1- to 3-grams of a text's letters."""
    chars = re.sub(" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in text))
    out = []
    for n in (1, 2, 3):
        for k in range(len(chars) - n + 1):
            if chars[k : k + n] == " ":
                continue
            h = 0x9E3779B97F4A7C15 * n % (1 << 64)
            for c in chars[k : k + n]:
                h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
            for times in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                h = (h ^ (h >> 33)) * times % (1 << 64)
            out.append((h ^ (h >> 33)) >> 49)
    return out


def test_language_id_matches_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    grams = {i: Counter(plain_ngrams(r.text or "")) for i, r in docs.items()}
    fitted = [i for i, r in docs.items() if not out[i] and r.text is not None and r.lang is not None]
    langs = sorted({docs[i].lang for i in fitted})
    prior, log_p = {}, {}
    for lang in langs:
        mine = [i for i in fitted if docs[i].lang == lang]
        total = sum((grams[i] for i in mine), Counter())
        all_ = sum(total.values()) + 0.5 * (1 << 15)
        prior[lang] = np.log(len(mine) / len(fitted))
        log_p[lang] = lambda g, total=total, all_=all_: np.log((total[g] + 0.5) / all_)
    for r in QUERIES["op7_language_id"](spark, SF_DIR).collect():
        assert r.held_out == out[r.doc_id]
        if not any(c.isalpha() for c in docs[r.doc_id].text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sums = {lang: prior[lang] + sum(n * log_p[lang](g) for g, n in grams[r.doc_id].items()) for lang in langs}
        best = max(sums.values())
        assert sums[r.lang_pred] >= best - 1e-6 * abs(best)
        assert abs(r.score - 1 / sum(np.exp(v - best) for v in sums.values())) < 1e-6


def brute_weights(texts: dict[int, str], good: set[int]) -> dict[int, float]:
    """Log weights from dictionaries, one document at a time."""
    buckets, shift = quality.BUCKETS, 64 - quality.BUCKETS.bit_length() + 1
    found, known = {}, {}
    for i, text in texts.items():
        tokens = re.findall(rb"[0-9a-z\x80-\xff]+|[^\x00-\x200-9a-z\x80-\xff]+", ascii_lower(text or "").encode())
        h, spot = [known[t] if t in known else known.setdefault(t, word_hash_bytes(t)) for t in tokens], []
        for k, x in enumerate(h):
            spot.append(x >> shift)
            if k:
                y = (h[k - 1] * 0xD6E8FEB86659FD93 + x) % (1 << 64)
                for _ in (1, 2):
                    y = ((y ^ (y >> 33)) * (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)[_ - 1]) % (1 << 64)
                y ^= y >> 33
                spot.append((0x1234567890ABCDEF if x == h[k - 1] else y) >> shift)
        found[i] = spot
    raw_n, target_n = Counter(b for s in found.values() for b in s), Counter(b for i in good if i in found for b in found[i])
    a, b = sum(raw_n.values()) + buckets, sum(target_n.values()) + buckets
    return {i: sum(np.log((target_n[x] + 1) / b) - np.log((raw_n[x] + 1) / a) for x in s) for i, s in found.items()}


def test_quality_weights_and_selection(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality > 0}
    rows = QUERIES["op8_quality"](spark, SF_DIR).collect()
    expected = brute_weights(texts, good)
    assert all(abs(r.log_weight - expected[r.doc_id]) <= 1e-6 * max(1, abs(r.log_weight)) for r in rows)
    keyed = sorted((r for r in rows if r.key is not None), key=lambda r: (-r.key, r.doc_id))
    k = round(len(good) / len({r.doc_id for r in labels}) * len(keyed))
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in keyed[:k]}
    assert spark_rows(QUERIES["op8_quality"](spark, SF_DIR)) == spark_rows(QUERIES["op8_quality"](spark, SF_DIR))


def test_quality_on_labels_not_fitted(spark):
    """Fitted on half of the labels of the largest table, the selection agrees with the other half."""
    sf = SF_DIR.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fitted = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = quality.select_quality(docs, labels.where(fitted)).join(labels.where(~fitted), "doc_id")
    bad, good = found.agg(F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))), F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int")))).first()
    assert bad <= 0.03 and good >= 0.97


def test_pipeline_stages(spark, tmp_path):
    """Each stage against SQL over its own input."""
    import duckdb

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        con = duckdb.connect()
        con.register("documents", before.toPandas())
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF_DIR}/benchmark.parquet')")
        kept[name] = ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
        ask = lambda sql: con.execute(sql).fetchall()  # noqa: E731, B023
        if name == "quality":
            assert ids == Counter(r.doc_id for r in QUERIES["op8_quality"](spark, SF_DIR).where("kept").collect())
        elif name == "line_dedup":
            sums = dict(ask(f"SELECT doc_id, text_sha256 FROM ({OP9_SQL})"))
            assert all(hashlib.sha256(r.text.encode()).hexdigest() == sums[r.doc_id] and r.n_chars == len(r.text) for r in docs.collect())
            assert set(ids) >= {i for i, n in ask(f"SELECT doc_id, n_removed FROM ({OP9_SQL})") if n == 0}
        elif name == "near_dedup":
            sql = OP10_SQL.replace("0.85", "0.80").replace(">= 85 *", ">= 80 *")
            assert set(ids) == {i for i, yes in ask(f"SELECT doc_id, kept FROM ({sql})") if yes}
        elif name == "decontamination":
            assert set(ids) == {i for i, hit in ask(f"SELECT doc_id, contaminated FROM ({OP1_SQL})") if not hit}
        else:
            plan = ask(f"SELECT doc_id, size, taken FROM ({ORACLE_SQL['op5_mixing']})")
            assert all(ids[i] * size == taken for i, size, taken in plan)
    assert list(kept) == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id").collect()) == kept["mixing"]
