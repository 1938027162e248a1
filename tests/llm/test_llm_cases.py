"""The defined cases: nulls, empty and long texts, repeated rows, empty tables, clashing columns, hot groups."""

from __future__ import annotations

import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldbook.llm import decontaminate, language_id, licenses, line_dedup, linking, media, mixing, near_dedup, pii, quality, substring_dedup

CLASH = "n_words long, n_hit long, hits string, items string, spans string, size string, source_size string, target long, copies string, key string, kept string, bucket string, v string, c string, removed string, n_removed string, n_sentences string, n_lines string, th string, h1 string, log_weight string, n_features string, lang_pred string, score string"
LONG = "\n".join(f"word{k} is here number {k} of a long text." for k in range(20_000))
ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, "  \n\n ", "en", "a"), (None, "some words without any id", None, None), (4, LONG, "en", "b"), (4, LONG, "en", "b"), (5, LONG, None, "b"), (6, "... !!! ???", "de", None), (7, "einzelwort", "de", "c"), (8, "ein kurzer satz auf deutsch über nichts", "de", "c"), (8, "ein kurzer satz auf deutsch über nichts", "de", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    extra = [x.split(" ") for x in CLASH.split(", ")]
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").select("*", *[F.lit(None).cast(t).alias(n) for n, t in extra])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "word5 is here number 5 of a long text word6 is here"), (2, None), (None, "einzelwort"), (3, ""), (1, "satz auf")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (8, 0, 0), (None, 1, 0), (7, None, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")


def operators(bench, labels):
    """Per name: from documents to a table with one row for each."""
    return {
        "decontaminate": lambda d: decontaminate.find_contamination(d, bench),
        "spans": substring_dedup.dedup_spans,
        "pii": pii.find_pii,
        "mixing": mixing.plan_mix,
        "language": lambda d: language_id.predict(d, language_id.train(d)),
        "quality": lambda d: quality.scored_keys(d, labels, 8, "doc_id", "text", quality.BUCKETS, 100, None),
        "lines": line_dedup.dedup_lines,
        "near": near_dedup.near_duplicates,
    }


NAMES = ["decontaminate", "spans", "pii", "mixing", "language", "quality", "lines", "near"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_and_empty_tables(odd, bench, labels, name):
    f = operators(bench, labels)[name]
    assert Counter(r.doc_id for r in f(odd).select("doc_id").collect()) == Counter(r[0] for r in ROWS)
    assert f(odd.limit(0)).count() == 0
    assert f(odd).count() == len(ROWS)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_decontaminate_cases(spark, odd, bench, monkeypatch):
    out = {r.doc_id: r for r in decontaminate.find_contamination(odd, bench).collect()}
    assert out[1].n_words == 0 and out[1].n_hit == 0 and out[2].n_hit == 0
    assert out[4].items == ["1"] and out[4].n_hit == 12
    assert out[7].n_hit == 1 and out[7].items == []
    assert out[8].n_hit == 2 and out[8].items == ["1"]
    assert {r.doc_id for r in decontaminate.remove_contaminated(odd, bench).collect()} == {1, 2, 3, 6, None}
    assert decontaminate.find_contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(odd, bench).collect()}
    assert cut[8] == "ein kurzer  deutsch über nichts" and cut[1] is None and cut[7] == ""
    # blocks of two windows give the same rows
    small = decontaminate.find_contamination(odd, bench, max_windows=2)
    big = decontaminate.find_contamination(odd, bench)
    assert rows(small, "doc_id", "n_hit", "items") == rows(big, "doc_id", "n_hit", "items")


def test_decontaminate_rows_next_to_each_other(spark):
    """Neighbours that are one window each, or end in a passage, or begin with one."""
    passage = [f"p{k}" for k in range(14)]
    bench = spark.createDataFrame([("a", " ".join(passage)), ("b", "p4 p5 p6 p7 p8 p9 p10 p11 p12 p13 z"), ("c", "short item")], "item_id string, text string")
    one, short = " ".join(passage[:10]), "short item"
    texts = [one, one, one, "x y " + " ".join(passage), " ".join(passage), "x " + " ".join(passage[4:]), " ".join(passage[4:]) + " y", short, short, one, "nothing", "q short item", short]
    n_hit = [10, 10, 10, 14, 14, 10, 10, 2, 2, 10, 0, 2, 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for max_windows in (2, 1000):
        out = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench, max_windows=max_windows).collect()}
        assert [out[k].n_hit for k in range(len(texts))] == n_hit
        assert [out[k].n_hit > 0 for k in out] == [bool(out[k].items) for k in out]
    assert [r.doc_id for r in decontaminate.remove_contaminated(docs, bench).collect()] == [10]


def test_near_duplicate_cases(odd):
    out = rows(near_dedup.near_duplicates(odd), "doc_id", "component_id", "kept")
    assert out.count((4, 4, True)) == 2 and (5, 4, False) in out and (None, None, True) in out and (1, 1, True) in out and (2, 2, True) in out
    assert sorted({r.doc_id for r in near_dedup.drop_near_duplicates(odd).collect()}, key=str) == [1, 2, 3, 4, 6, 7, 8, None]


def test_near_duplicates_of_large_groups(spark):
    """A third of all rows in one group of exact and near copies, and chains whose ends are unlike."""
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join(base)) for k in range(0, 200)]
    for k in range(200, 400):
        words = base.copy()
        words[int(rng.integers(0, 200))] = f"x{k}"
        docs.append((k, " ".join(words)))
    chain = [f"c{k}" for k in range(100)]
    docs += [(1000 + k, " ".join([f"d{j}" for j in range(4 * k)] + chain[4 * k :])) for k in range(8)]
    docs += [(2000 + k, " ".join(f"r{k}q{j}" for j in range(50))) for k in range(400)]
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in docs}
    name = {i: i for i, _ in docs}

    def root(i):
        return i if name[i] == i else root(name[i])

    for group in (range(400), range(1000, 1008)):
        for a in group:
            for b in group:
                if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and root(a) != root(b):
                    x, y = sorted((root(a), root(b)))
                    name[y] = x
    assert out == {i: root(i) for i, _ in docs}
    assert len({out[i] for i in range(400)}) == 1


def test_line_dedup_cases(spark, odd):
    out = {(r.doc_id, r.n_removed) for r in line_dedup.dedup_lines(odd).collect()}
    assert {(1, 0), (4, 0), (5, 20_000), (None, 0)} <= out
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\nx"), (2, "q\na\nb\nc\nd"), (3, "a\nb\nc\na\nb\nc"), (4, "\n\n\n\n"), (5, "\n\n\n\n")], "doc_id long, text string")
    assert rows(line_dedup.dedup_lines(docs), "doc_id", "text", "removed") == [(1, "a\nb\nc\nd\nx", []), (2, "q", [1, 2, 3, 4]), (3, "", [0, 1, 2, 3, 4, 5]), (4, "\n\n\n\n", []), (5, "\n\n\n\n", [])]


def test_mixing_cases(spark, odd):
    out = {(r.doc_id, r.source): r for r in mixing.plan_mix(odd).collect()}
    assert out[(1, None)].size == 0 and all(r.copies <= 2 for r in out.values())
    assert mixing.mix(odd).columns == odd.columns
    many = spark.createDataFrame([(k, "w " * (k % 7 + 1), None if k % 3 == 0 else "s" if k % 3 == 1 else "big") for k in range(6000)], "doc_id long, text string, source string")
    plan = mixing.plan_mix(many).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.05 * r.target for r in plan)
    assert rows(mixing.mix(many), "doc_id") == rows(mixing.mix(many.repartition(5)), "doc_id")


def test_language_cases(spark, odd):
    model = language_id.train(odd)
    out = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0.0 for i in (1, 2, 3, 6))
    assert out[8].lang_pred == "de" and out[4].lang_pred == "en"
    assert {r.lang_pred for r in language_id.predict(odd, language_id.train(odd.limit(0))).collect()} == {"und"}
    with pytest.raises(ValueError):
        language_id.train(odd, max_languages=1)


def test_quality_cases(odd, labels):
    out = {r.doc_id: r for r in quality.select_quality(odd, labels).collect()}
    assert all(out[i].key is None and not out[i].kept for i in (1, 2, 3))
    assert all(r.kept == (r.n_features > 0) for r in quality.select_quality(odd, labels.limit(0)).collect())
    assert quality.keep_quality(odd, labels).columns == odd.columns


def test_license_cases(spark, odd):
    templates = licenses.template_table(spark)
    assert licenses.scan_licenses(odd, templates).count() == 0
    docs = spark.createDataFrame([(1, "x\nLICENSED under CC-BY 4.0!\ny"), (1, "x\nLICENSED under CC-BY 4.0!\ny"), (None, "Released under the MIT License"), (2, None)], "doc_id long, text string").withColumn("line", F.lit("clash"))
    assert rows(licenses.scan_licenses(docs, templates), "doc_id", "line", "license") == [(1, 1, "CC-BY-4.0"), (None, 0, "MIT")]
    assert licenses.scan_licenses(docs, templates.limit(0)).count() == 0


def test_licenses_inside_longer_texts(spark):
    """Whole texts wrapped and in a paragraph, headers, titles, SPDX lines, and notices wrapped or inside a paragraph."""
    mit, gpl = (next(t for lic, t in licenses.TEXTS if lic == x and len(t) > 200) for x in ("MIT", "GPL-3.0"))
    wrap = lambda t: "\n".join(textwrap.wrap(t, 60))
    prose = "\n".join(f"The river number {k} runs to the sea and back again in the spring." for k in range(40))
    texts = [
        (f"{prose}\n{wrap(mit)}\n{prose}", 40, "MIT"),
        (mit, 0, "MIT"),
        (f"{prose}\n# " + wrap(gpl).replace("\n", "\n# ") + f"\n{prose}", 40, "GPL-3.0"),
        (f"MIT License\n{prose}", 0, "MIT"),
        (f"# SPDX-License-Identifier: GPL-3.0-or-later\n{prose}", 0, "GPL-3.0"),
        (f"{prose}\nThis work is licensed under a Creative Commons\nAttribution 4.0 International License.\n{prose}", 40, "CC-BY-4.0"),
        (f"{prose}\nWe wrote it long ago. Released under the MIT License. It is about rivers and the sea.\n{prose}", 40, "MIT"),
    ]
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(texts)] + [(90, prose), (None, texts[5][0])], "doc_id long, text string")
    out = rows(licenses.scan_licenses(docs, licenses.template_table(spark, licenses.TEMPLATES + licenses.TEXTS)), "doc_id", "line", "license")
    assert out == sorted([(k, line, lic) for k, (_, line, lic) in enumerate(texts)] + [(None, 40, "CC-BY-4.0")], key=repr)


def names_that_clash(spark):
    """Every column an operator adds, in another case, and names that need quotes; the values must come back."""
    made = "N_Words N_HIT Hits items Spans Size SOURCE_size Target copies Key kept Bucket V c Removed n_removed N_Lines TH h1 Log_Weight n_features a.b c`d _fb_copy"
    rows = [(1, "the cat sat on the mat and looked at the dog for a while", "en", "a"), (2, "mail me@site.org now or never, said the dog to the old cat", "en", "b"), (3, None, "en", "b"), (4, "a\nb\nc\nd", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in made.split()])


def test_a_long_file_of_notices_takes_linear_time(spark):
    """Half a megabyte of repeated licence text and prose: every notice is found, in time."""
    import time

    text = next(t for lic, t in licenses.TEXTS if lic == "MIT")
    words = " ".join(text.split())
    one = spark.createDataFrame([(1, (words + " and some words of prose that no licence has ") * (500_000 // len(words)))], "doc_id long, text string")
    began = time.time()
    found = licenses.scan_licenses(one, licenses.template_table(spark, licenses.TEMPLATES + licenses.TEXTS)).collect()
    assert {r.license for r in found} == {"MIT"} and time.time() - began < 120


def test_callers_columns_keep_their_values(spark, bench, labels, tmp_path):
    docs = names_that_clash(spark)
    extra = docs.columns[5:]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    outputs = {
        "mix": mixing.mix(docs),
        "remove_contaminated": decontaminate.remove_contaminated(docs, bench),
        "remove_spans": decontaminate.remove_spans(docs, bench),
        "keep_quality": quality.keep_quality(docs, labels, keep_share=1.0),
        "redact": pii.redact(docs),
        "drop_near_duplicates": near_dedup.drop_near_duplicates(docs),
        **{name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES},
    }
    for name, out in outputs.items():
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found, name
        for r in found:
            assert list(r)[5:] == [f"{n} {r.doc_id}" for n in extra], name
    # those that add columns replace only what has their names
    for name, f in operators(bench, labels).items():
        if name in ("near", "quality"):
            continue
        out = f(docs)
        kept = [n for n in extra if n in out.columns]
        assert {"a.b", "c`d"} <= set(kept), name
        at = [out.columns.index(n) for n in kept]
        ids = out.columns.index("doc_id")
        if name != "mixing":
            assert all([r[k] for k in at if out.schema[k].dataType.simpleString() == "string" and kept[at.index(k)] not in ("kept", "items")] == [f"{n} {r[ids]}" for n in kept if out.schema[out.columns.index(n)].dataType.simpleString() == "string" and n not in ("kept", "items")] for r in out.collect()), name


def test_stages_on_odd_rows(spark, odd, bench, labels, tmp_path):
    """Every stage takes nulls, long texts, repeated rows and an empty table."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        left[name] = Counter(r.doc_id for r in out.select("doc_id").collect())
        assert set(left[name]) <= {r[0] for r in ROWS}
    assert left["line_dedup"] == Counter([1, 2, 3, None, 4, 4, 6, 7, 8, 8]) and left["near_dedup"] == Counter([1, 2, 3, None, 4, 4, 6, 7, 8, 8])


def test_label_ids_by_another_name(spark, odd, labels):
    docs, known = odd.select(F.col("doc_id").alias("key id"), "text"), labels.withColumnRenamed("doc_id", "key id")
    out = quality.keep_quality(docs, known, id_col="key id")
    assert out.columns == ["key id", "text"] and rows(out, "`key id`") == rows(quality.keep_quality(odd.select("doc_id", "text"), labels), "doc_id")


def test_null_ids_of_different_texts(spark):
    shared = " ".join(f"Sentence {w} stands here twice." for w in "one two three four five six".split())
    docs = spark.createDataFrame([(None, "First words alone. " + shared), (None, shared + " Last words alone."), (None, "nothing of it")], "doc_id long, text string")
    out = sorted(r.n_removed for r in substring_dedup.dedup_spans(docs).collect())
    assert out[:2] == [0, 0] and out[2] >= 6


def test_block_of_windows_stays_small():
    """A block of 200,000 windows: what is broadcast, by its definition about 30 bytes a window and the words."""
    import pyarrow as pa

    words = [f"w{k:06d}" for k in range(200_009)]
    made = [b.to_pylist() for b in decontaminate._window_batches(10, 1_000_000)([pa.record_batch([pa.array(["i"]), pa.array([" ".join(words)])], names=["i", "t"])])]
    row = made[0][0]
    block = decontaminate._block([(np.array(row["hashes"], np.int64).view(np.uint64), np.full(len(row["hashes"]), 10, np.int32), np.array(row["start"]), np.array(row["end"]), np.zeros(len(row["hashes"]), np.int32))], [row["words"]], ["i"])
    assert len(block.hashes) == 200_000 and sum(x.nbytes for x in block[:5]) + len(block.words) <= 42 * 200_000


def picture(seed: int, side: int = 96) -> np.ndarray:
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, 255, (side // 6, side // 6)).astype(float)
    return np.kron(coarse, np.ones((6, 6))) * 0.8 + 20


def pgm(a: np.ndarray) -> bytearray:
    return bytearray(f"P5 {a.shape[1]} {a.shape[0]} 255\n".encode() + np.clip(a, 0, 255).astype(np.uint8).tobytes())


def test_image_copies(spark):
    images = []
    for k in range(12):
        a = picture(k)
        images += [(10 * k, pgm(a)), (10 * k + 1, pgm(a[8:-4, 4:-10])), (10 * k + 2, pgm(a * 0.85 + 12)), (10 * k + 3, pgm(a))]
    images += [(900, None), (901, bytearray()), (902, bytearray(b"no image")), (903, bytearray(b"no image")), (904, pgm(np.full((64, 64), 9.0))), (None, pgm(picture(1))), (0, pgm(picture(0)))]
    df = spark.createDataFrame(images, "image_id long, content binary").withColumn("v", F.lit("clash"))
    out = media.find_copies(df).collect()
    assert Counter(r.image_id for r in out) == Counter(i for i, _ in images)
    found = {r.image_id: r.class_id for r in out}
    assert all(found[10 * k + j] == 10 * k for k in range(12) for j in range(4))
    assert [found[i] for i in (900, 901, 902, 903, 904, None)] == [900, 901, 902, 902, 904, None]
    assert media.find_copies(df.limit(0)).count() == 0


# --- recall of edited copies


def _bilinear(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    h, w = a.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), h - 2), np.minimum(x.astype(int), w - 2)
    fy, fx = y - y0, x - x0
    top, low = a[y0, x0] * (1 - fx) + a[y0, x0 + 1] * fx, a[y0 + 1, x0] * (1 - fx) + a[y0 + 1, x0 + 1] * fx
    return top * (1 - fy) + low * fy


def turned(a: np.ndarray, degrees: float) -> np.ndarray:
    h, w = a.shape
    t, (yy, xx) = np.deg2rad(degrees), np.mgrid[0:h, 0:w].astype(float)
    y, x = yy - (h - 1) / 2, xx - (w - 1) / 2
    return _bilinear(a, (h - 1) / 2 + np.cos(t) * y + np.sin(t) * x, (w - 1) / 2 - np.sin(t) * y + np.cos(t) * x)


def resized(a: np.ndarray, factor: float) -> np.ndarray:
    h, w = (round(n * factor) for n in a.shape)
    wide = np.pad(a, 1, mode="edge")
    soft = sum(wide[i : i + a.shape[0], j : j + a.shape[1]] * (2 - abs(i - 1)) * (2 - abs(j - 1)) for i in range(3) for j in range(3)) / 16
    yy, xx = np.mgrid[0:h, 0:w].astype(float)
    return _bilinear(soft if factor < 0.8 else a, (yy + 0.5) / factor - 0.5, (xx + 0.5) / factor - 0.5)


def drawn(kind: str, seed: int, side: int = 192) -> np.ndarray:
    rng = np.random.default_rng(seed)
    if kind == "blocks":
        return np.kron(rng.integers(0, 255, (side // 8, side // 8)).astype(float), np.ones((8, 8))) * 0.8 + 20
    out, (yy, xx) = np.full((side, side), float(rng.integers(60, 200))), np.mgrid[0:side, 0:side]
    for _ in range(side // 2):
        (cy, cx), s, tall = rng.integers(0, side, 2), rng.integers(4, 24), rng.uniform(0.4, 1.5)
        shape = (yy - cy) ** 2 + (xx - cx) ** 2 < s * s if rng.random() < 0.5 else (abs(yy - cy) < s) & (abs(xx - cx) < s * tall)
        out[shape] = rng.integers(0, 255)
    return out


EDITS = {
    "crop": lambda a: a[20:-10, 8:-30], "quarter": lambda a: a[24:-24, 24:-24], "bright": lambda a: a * 0.85 + 12, "noise": lambda a: a + np.random.default_rng(1).normal(0, 6, a.shape),
    "turn 15": lambda a: turned(a, 15), "turn 40": lambda a: turned(a, 40), "turn 90": np.rot90, **{f"size {f}": (lambda a, f=f: resized(a, f)) for f in (0.9, 0.8, 0.7, 0.6)},
}


@pytest.mark.parametrize("kind", ["blocks", "shapes"])
def test_edited_copies_are_found(spark, kind):
    """Recall of at least 0.9 an edit, and unrelated pictures apart (pictures of 192 pixels)."""
    n, step = 4, len(EDITS) + 1
    images = []
    for k in range(n):
        a = drawn(kind, k)
        images += [(step * k, pgm(a)), *[(step * k + 1 + j, pgm(edit(a))) for j, edit in enumerate(EDITS.values())]]
    out = {r.image_id: r.class_id for r in media.find_copies(spark.createDataFrame(images, "image_id long, content binary")).collect()}
    for j, name in enumerate(EDITS):
        assert sum(out[step * k + 1 + j] == out[step * k] for k in range(n)) >= 0.9 * n, name
    assert len({out[step * k] for k in range(n)}) == n


def test_pairs_grow_with_a_group(spark, monkeypatch):
    """Twice as many near copies make about twice as many pairs to confirm."""
    base = drawn("blocks", 3, 96)

    def count(size: int) -> int:
        rng = np.random.default_rng(size)
        images = [(k, pgm(base + rng.normal(0, 6, base.shape))) for k in range(size)]
        pairs = []
        known = linking.written
        monkeypatch.setattr(linking, "written", lambda df: pairs.append(known(df)) or pairs[-1])
        out = media.find_copies(spark.createDataFrame(images, "image_id long, content binary").repartition(8))
        monkeypatch.setattr(linking, "written", known)
        assert {r.class_id for r in out.collect()} == {0}
        return sum(df.count() for df in pairs if df.columns == ["a", "ta", "b", "tb"])

    assert count(160) <= 2.2 * count(80)


def gradients(seed: int, side: int = 192) -> np.ndarray:
    """Soft light and dark waves with sharp strokes: a third kind of picture."""
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[0:side, 0:side]
    out = sum(rng.uniform(10, 30) * np.sin(rng.uniform(0.02, 0.2) * xx + rng.uniform(0.02, 0.2) * yy + rng.uniform(0, 6)) for _ in range(6)) + 128
    for _ in range(side):
        (cy, cx), t, n, wide = rng.integers(0, side, 2), rng.uniform(0, np.pi), rng.integers(6, 30), rng.uniform(0.7, 2)
        along, across = (xx - cx) * np.cos(t) + (yy - cy) * np.sin(t), (yy - cy) * np.cos(t) - (xx - cx) * np.sin(t)
        out[(abs(along) < n) & (abs(across) < wide)] += rng.uniform(-80, 80)
    return np.clip(out, 0, 255)


def test_unlike_pictures_stay_apart():
    """No two of twelve unlike pictures of three kinds agree, nor their quarters and small copies."""
    made = [f(k) for k in range(4) for f in (gradients, lambda k: drawn("shapes", 40 + k), lambda k: drawn("blocks", 60 + k))]
    found = [[media.describe_stack(np.clip(x, 0, 255).astype(np.float32)[None])[0] for x in (a, a[24:-24, 24:-24], resized(a, 0.6), turned(a, 15))] for a in made]
    for i, mine in enumerate(found):
        assert all(media.agree(*mine[0], *x) or media.agree(*x, *mine[0]) for x in mine)
        assert not any(media.agree(*x, *y) for other in found[:i] + found[i + 1 :] for x in mine for y in other)


def test_small_crops_of_large_pictures(spark):
    """A sixteenth of a large picture, and a quarter-size copy, are found; another picture is not."""
    side, cut = 1024, 256
    a = drawn("shapes", 5, side)
    images = [(1, pgm(a)), (2, pgm(a[side // 3 : side // 3 + cut, side // 5 : side // 5 + cut])), (3, pgm(resized(resized(a, 0.5), 0.5))), (4, pgm(drawn("shapes", 6, side)))]
    out = media.find_copies(spark.createDataFrame(images, "image_id long, content binary")).collect()
    assert {r.image_id: r.class_id for r in out} == {1: 1, 2: 1, 3: 1, 4: 4}


@pytest.mark.parametrize("side", [2048, 4096])
def test_crops_of_very_large_pictures(side):
    a = resized(drawn("blocks", 7, side // 2), 2.0)
    whole, crop = (media.describe_stack(x.astype(np.float32)[None])[0] for x in (a, a[700:1212, 300:812]))
    assert media.agree(*crop, *whole)


def png(pixels: np.ndarray, kind: int, filters: list[int], palette: bytes = b"") -> bytes:
    """A PNG of these pixels (height, width, channels), its rows by the filters in turn."""
    import struct
    import zlib

    h, w, depth = pixels.shape
    full = np.zeros((h + 1, w + 1, depth), int)
    full[1:, 1:] = pixels
    left, up, corner = full[1:, :-1], full[:-1, 1:], full[:-1, :-1]
    p = left + up - corner
    near = np.stack([abs(p - left), abs(p - up), abs(p - corner)]).argmin(axis=0)  # ties: left, then above
    guesses = [0 * left, left, up, (left + up) // 2, np.choose(near, [left, up, corner])]
    rows = b"".join(bytes([filters[y % len(filters)]]) + ((full[1 + y, 1:] - guesses[filters[y % len(filters)]][y]) % 256).astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    body = zlib.compress(rows)
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", body[:9]) + chunk(b"IDAT", body[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [4, 3, 2, 1, 0]])
@pytest.mark.parametrize("kind,depth", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_filters(filters, kind, depth):
    pixels = np.random.default_rng(depth).integers(0, 256, (9, 7, depth))
    grey = pixels[:, :, : 3 if depth > 2 else 1].mean(axis=2)
    assert np.allclose(media.decode(png(pixels, kind, filters)), grey, atol=1e-3)


def test_png_palettes_and_bad_files():
    index = np.random.default_rng(2).integers(0, 4, (5, 6, 1))
    colours = bytes([0, 0, 0, 30, 60, 90, 255, 255, 255, 3, 6, 9])
    assert np.allclose(media.decode(png(index, 3, [0], colours)), np.array([0, 60, 255, 6])[index[:, :, 0]])
    good = png(np.zeros((2, 2, 1), int), 0, [0])
    bomb = good.replace(b"\x00\x00\x00\x02\x00\x00\x00\x02", b"\x00\x00\xff\xff\x00\x00\xff\xff")
    assert media.decode(bomb) is None and media.decode(good[:40]) is None and media.decode(png(np.zeros((2, 2, 1), int), 3, [0])) is None
    import zlib

    # a stream of a gigabyte behind a header of four pixels: only those are unpacked
    stream = zlib.compressobj()
    long = b"".join(stream.compress(bytes(1 << 20)) for _ in range(64)) + stream.flush()
    at = good.index(b"IDAT")
    assert media.decode(good[: at - 4] + len(long).to_bytes(4, "big") + b"IDAT" + long + bytes(4)).shape == (2, 2)
