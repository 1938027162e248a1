"""Quality rules, conversation repair and source divergence against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldbook.llm import conversation_repair, quality_rules, source_divergence
from fieldbook.llm.queries import QUERIES
from fieldbook.llm.textarrays import pieces

# --- quality rules


def plain_counts(text: str | None) -> dict[str, int]:
    """The counts by their definitions, with lists and dictionaries."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = defaultdict(list)
    for k in range(len(words) - 4):
        places[tuple(words[k : k + 5])].append(k)
    inside = {k + j for found in places.values() if len(found) > 1 for k in found for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = [c for w in words for c in w if c.isascii() and c.isalpha() or ord(c) > 127]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "n_lines": len(lines),
        "n_letters": len(letters),
        "n_upper": sum("A" <= c <= "Z" for c in letters),
        "n_marks": sum(c in "!?" for c in text),
        "n_top": max(Counter(words).values(), default=0),
        "n_odd": sum(not re.search(r"[A-Za-z0-9\x80-\U0010ffff][.,;:!?)\"']?\Z", w) for w in words),
    }


def counted(texts: list[str | None]) -> list[dict[str, int]]:
    out = []
    for _, raw, offsets in pieces(pa.array(texts, pa.string())):
        found = quality_rules.text_counts(raw, offsets)
        out += [{c: int(found[c][k]) for c in quality_rules.COUNTS} for k in range(len(offsets) - 1)]
    return out


words_ = st.lists(st.sampled_from(["a", "a", "b", "the", "ä", "A!", "x#", "\n", "\n", "\t", "\x0b", "|", " ", " ", "!!", ""]), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), words_.map(" ".join), words_.map("".join), st.text(max_size=40)), max_size=8))
def test_counts_match_brute_force(texts):
    assert counted(texts) == [plain_counts(t) for t in texts]


def test_counts_hold_when_all_hashes_collide(monkeypatch):
    monkeypatch.setattr(quality_rules, "windows", lambda h, n: np.zeros(max(len(h) - n + 1, 0), np.uint64))
    monkeypatch.setattr(quality_rules, "mix", lambda x: x * np.uint64(0))
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(50)]
    assert counted(texts) == [plain_counts(t) for t in texts]


def plain_verdicts(counts: list[dict]) -> list[tuple[bool, float]]:
    """Votes and EM one document at a time, as their definitions say."""

    def vote(x: dict) -> list[int]:
        n, long = x["n_words"], x["n_words"] >= 20
        part = lambda a, b, ok=True: x[a] / x[b] if ok and x[b] else None
        neg = lambda v: None if v is None else -v
        length = part("word_chars", "n_words")
        seen = [
            (-n, -50, -5), (part("n_symbols", "n_words"), 0.02, 0.15), (part("n_repeat_words", "n_words", long), 0.1, 0.2), (part("n_dup_lines", "n_lines", x["n_lines"] >= 5), 0.2, 0.5),
            (part("n_upper", "n_letters"), 0.15, 0.4), (part("n_marks", "n_words"), 0.05, 0.3), (part("n_top", "n_words", long), 0.12, 0.25),
            (None if length is None else abs(length - 6), 3.5, 6), (neg(part("n_letters", "word_chars")), -0.85, -0.75), (part("n_odd", "n_words"), 0.05, 0.25),
        ]
        return [0 if v is None else 1 if v <= good else -1 if v > bad else 0 for v, good, bad in seen]

    cast = [vote(x) for x in counts]
    good = [0.1 if -1 in v else 0.9 for v in cast]
    for _ in range(500):
        share = (sum(good) + 1) / (len(good) + 2)
        odds = [math.log(share / (1 - share))] * len(cast)
        for j in range(len(cast[0]) if cast else 0):
            for_, against = [g for g, v in zip(good, cast) if v[j] == 1], [g for g, v in zip(good, cast) if v[j] == -1]
            on_good = (sum(for_) + 2) / (sum(for_) + sum(against) + 3)
            on_bad = (len(against) - sum(against) + 2) / (len(for_) + len(against) - sum(for_) - sum(against) + 3)
            step = {0: 0.0, 1: math.log(on_good / (1 - on_bad)), -1: math.log((1 - on_good) / on_bad)}
            odds = [o + step[v[j]] for o, v in zip(odds, cast)]
        new = [1 / (1 + math.exp(-o)) for o in odds]
        done = max((abs(a - b) for a, b in zip(new, good)), default=0) < 1e-10
        good = new
        if done:
            break
    failed = [x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"] for x in counts]
    return [(not f and g >= 0.5, g) for f, g in zip(failed, good)]


def test_quality_rules_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    counts = [plain_counts(d.text) for d in docs]
    out = {r.doc_id: r for r in QUERIES["op11_quality_rules"](spark, SF_DIR).collect()}
    assert len(out) == len(docs)
    for d, c, (kept, p) in zip(docs, counts, plain_verdicts(counts)):
        row = out[d.doc_id]
        assert all(row[k] == c[k] for k in quality_rules.COUNTS[:5]) and row.kept == kept and row.posterior == pytest.approx(p, abs=1e-6)


def test_quality_rules_agree_with_labels(spark):
    """No label is used, and of those with ten words or more nearly all good documents stay and nearly all bad ones go."""
    sf_dir = SF_DIR.replace("sf0.001", "sf0.01")
    out = QUERIES["op11_quality_rules"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("n_words >= 10").toPandas()
    assert out[(out.quality == 1) & ~out.base_failed].kept.mean() >= 0.99
    assert (~out[out.quality == 0].kept).mean() >= 0.9


def test_rules_find_accuracies():
    """Votes drawn with known accuracies: EM finds them without labels."""
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    right_good, right_bad = [0.99, 0.97, 0.995, 0.98, 0.96], [0.7, 0.8, 0.65, 0.9, 0.75]
    cast = np.stack([np.where(rng.random(len(good)) < 0.1, 0, np.where(rng.random(len(good)) < np.where(good, a, 1 - b), 1, -1)) for a, b in zip(right_good, right_bad)], axis=1)
    patterns, times = np.unique(cast, axis=0, return_counts=True)
    share, on_good, on_bad = quality_rules.fit(patterns, times)
    assert share == pytest.approx(0.8, abs=0.02) and on_good == pytest.approx(right_good, abs=0.02) and on_bad == pytest.approx(right_bad, abs=0.04)


def test_quality_rules_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "two words"), (None, "clean text of ten words and of a few more words here"), (5, "x " * 50_000), (5, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as N_Words", "'b' as kept", "'c' as `odd.name`")
    out = quality_rules.judge(docs).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and not any(by[k].kept for k in (1, 2, 3, 4, 5)) and by[None].kept
    assert by[1].n_words == 0 and by[3].n_lines == 0 and by[5].n_repeat_words == 50_000 and by[1]["odd.name"] == "c"
    assert quality_rules.judge(docs.limit(0)).count() == 0


# --- conversation repair


def plain_plan(rows: list[tuple[str, str]]) -> tuple[int, str, str]:
    """(cost, audit, repaired lines) of the best of all edits with up to two inserts in a row, tried one by one."""
    faults, seen = [], set()
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("gone" if not solid or (role, text) in seen else "cut" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    gaps = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    ways = [[("D", 3, None)] if f == "gone" else [("D", 3, None), ("K", f == "cut", r), ("R", 2 + (f == "cut"), "user"), ("R", 2 + (f == "cut"), "assistant")] for (r, _), f in zip(rows, faults)]
    best = None
    for edits in itertools.product(*ways):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 2 * sum(map(len, put))
            if best and cost > best[0]:
                continue
            roles, audit, lines = [], "", []
            for k in range(len(rows) + 1):
                audit += "I" * len(put[k])
                lines += [f"{r}:" for r in put[k]]
                roles += put[k]
                if k < len(rows):
                    audit += edits[k][0]
                    if edits[k][2] is not None:
                        roles.append(edits[k][2])
                        lines.append(f"{edits[k][2]}:{rows[k][1]}")
            if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r in roles)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(lines)
    return best


def repaired(spark, conversations: dict, **options) -> dict:
    turns = [(c, t, role, text) for c, rows in conversations.items() for t, (role, text) in enumerate(rows)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    return {r.conv_id: r for r in conversation_repair.repair(df, **options).collect()}


def test_repair_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 2)  # paths of several blocks are put together
    rng = random.Random(7)
    pick = lambda: (rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "SYS"]), rng.choice(["one.", "two!", "cut", "", " \n", "three?\t", "one."]))
    conversations = {k: [pick() for _ in range(rng.randrange(1, 5))] for k in range(40)}
    out = repaired(spark, conversations)
    for k, rows in conversations.items():
        cost, audit, text = plain_plan(rows)
        assert (out[k].cost, out[k].audit, out[k].repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows


def test_blocks_do_not_change_a_plan(spark, monkeypatch):
    turns = conversation_repair.damaged(spark.read.parquet(f"{SF_DIR}/conversations.parquet").withColumn("conv_id", F.col("conv_id") % 3))
    whole = sorted(map(tuple, conversation_repair.repair(turns).collect()))
    assert len(whole) == 3 and max(len(r[-2]) for r in whole) > 20
    for block in (1, 3, 5):
        monkeypatch.setattr(conversation_repair, "BLOCK", block)
        assert sorted(map(tuple, conversation_repair.repair(turns).collect())) == whole


def test_a_conversation_of_very_many_turns(spark):
    """A third of all rows in one conversation: its fold is dealt out by blocks and takes linear time."""
    n = 60_000
    hot = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 7 = 3, 'tool', if(id % 2 = 0, 'user', 'assistant')) as role", "concat('text ', id, '.') as text")
    rest = spark.range(2 * n).selectExpr("2 + id div 4 as conv_id", "id % 4 as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text ', id, '.') as text")
    began = time.time()
    out = {r.conv_id: r for r in conversation_repair.repair(hot.union(rest)).where("conv_id < 4").collect()}
    assert time.time() - began < 90
    audit = out[1].audit
    assert len(re.findall("[KRD]", audit)) == n and out[1].cost == 2 * audit.count("R") + 3 * audit.count("D") + 2 * audit.count("I") == 2 * len(range(3, n, 7))
    assert out[2].audit == "KKKK" and out[2].cost == 0
    rows = hot.limit(0)
    assert conversation_repair.repair(rows).count() == 0


def test_repair_cases(spark):
    rows = [(1, None, "user", "first."), (1, 5, None, "second."), (1, 9, "assistant", None), (None, 1, "user", "hello."), (None, None, "system", "be kind."), (2, 1, "assistant", "b."), (2, 1, "assistant", "a."), (2, 1, "assistant", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as POS", "'x' as fault", "'y' as `edits.x`")
    found = conversation_repair.repair(df)
    out = {r.conv_id: r for r in found.collect()}
    assert (out[1].audit, out[1].cost, out[1].gaps, out[1].blank, out[1].illegal) == ("KRD", 5, 3, 1, 2)
    assert (out[None].audit, out[None].gaps, out[None].illegal) == ("KKI", 0, 0)
    assert (out[2].duplicate, out[2].gaps, out[2].illegal) == (1, 0, 2)
    flagged = conversation_repair.flagged(df)
    turns = [(r.edit, r.role, r.text) for r in conversation_repair.repaired_turns(flagged, conversation_repair.plan_repair(flagged)).where("conv_id is null").collect()]
    assert turns == [("K", "system", "be kind."), ("K", "user", "hello."), ("I", "assistant", "")]


def test_conversations_that_lose_all_rows(spark, tmp_path):
    """Every conversation of the table has a row; a CRC that drops its only turn leaves zeros."""
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    kept = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 > 4)
    spark.createDataFrame([(dropped, 0, "user", "x."), (kept, 0, "user", "x.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    assert (out[dropped].cost, out[dropped].audit, out[dropped].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest()) and out[kept].audit == "KI"


# --- source divergence


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**15), st.integers(1, 8 * 10**15))
def test_shares_are_exact(count, more):
    total = count + more
    assert int(source_divergence.shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 1) // total


def plain_audit(docs: list[tuple], top: int) -> set[tuple]:
    """The audit with dictionaries and Python's own whole numbers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for a, b, t in docs]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, terms in mine for t in set(terms))
        kept = {t for t, n in seen.items() if n >= 3}
        counts = {s: Counter(t for _, x, terms in mine if x == s for t in terms if t in kept) for s in {d[1] for d in mine}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pairs = {o: sum(f(p[s][t], p[o][t]) for t in kept) for o in counts if o != s}
            terms = {t: f(p[s][t], q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]}
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out |= {(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:most])}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence_matches_brute_force(spark, monkeypatch, small):
    """Also with tiles of two terms, strips of one source, and counts that are sent on early."""
    if small:
        for name, value in {"CELLS": 6, "NARROW": 2, "PAIRS": 12, "HELD": 8}.items():
            monkeypatch.setattr(source_divergence, name, value)
    rng = random.Random(3)
    words = ["the", "The", "of", "ünder", "über", "z", "aa", "ab", "東京", "\U0001f600x", "rare", "x1y", "don't"]
    docs = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", "ä", None, ""]), " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for _ in range(150)]
    docs += [("fr", "a", "seul"), ("fr", "b", None), ("fr", "c", ""), ("it", "only", "uno uno"), ("en", "empty", " 123 "), ("en", "hot", "the " * 30_000)]
    out = source_divergence.audit(spark.createDataFrame(docs, "lang string, source string, text string"), top=5)
    assert out.count() == len(want := plain_audit(docs, 5)) and set(map(tuple, out.collect())) == want


def test_divergence_cases(spark):
    docs = spark.createDataFrame([("en", "a", "x"), ("en", "b", "x y")], "lang string, source string, text string").selectExpr("*", "1 as V", "2 as block", "3 as term", "4 as cells")
    assert sorted(map(tuple, source_divergence.audit(docs).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert source_divergence.audit(docs.limit(0)).count() == 0
