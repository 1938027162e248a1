"""Quality rules under weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each rule reads the counts of a text and votes good (1), bad (-1) or abstains (0). Nothing is labelled: from how the rules
agree and differ over all documents, expectation-maximisation estimates the share of good documents and two accuracies
a rule, how often it is right about good and about bad documents when it votes. Rules are taken to err independently,
an abstention says nothing. A document's posterior probability of being good replaces a filter that all rules must pass:
one rule that errs is outvoted by others.

The counts are made where texts are read, in numpy on whole texts, and written out; what comes to the driver is how often
each pattern of votes occurs, at most 3 ** len(RULES) rows however many documents there are, summed on the executors.
The posterior is a sum of the rules' log odds, so no join brings it back.

Words are runs of anything but space and tab to carriage return. n_repeat_words are the words inside five-word windows that
a text holds twice or more; n_dup_lines the lines with a word that are equal to an earlier line. Both are exact: words
and lines are compared as such, hashes only sort them.

Defined cases: a null text has no words; a text without words gets no votes but that of its length, and like all texts below
MIN_WORDS it fails the base rules; repeated rows count and are judged one by one; an empty table gives none. Columns of
the input that are named like those added, in any case, are replaced, others kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm.scratch import packed, unpacked, without, written
from fieldbook.llm.textarrays import SOLID, byte_class, exact, mix, pieces, split_words, windows

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
THRESHOLD = 0.5
SYMBOLS = byte_class(lambda b: chr(b) in "#*$%&|<>")
MARKS = byte_class(lambda b: chr(b) in "!?")
UPPER = byte_class(lambda b: 65 <= b <= 90)
#: ASCII letters, and the first bytes of what lies beyond
LETTERS = byte_class(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 192)
PLAIN = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
CLOSERS = byte_class(lambda b: chr(b) in ".,;:!?)\"'")
FIRST = byte_class(lambda b: b & 0xC0 != 0x80)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks", "n_top", "n_odd"]


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.nullif(F.col(b), F.lit(0))


#: name: (what is measured, good if up to, bad if above); in between, and where nothing can be measured, a rule abstains
RULES: dict[str, tuple[Column, float, float]] = {}


def _rules() -> dict[str, tuple[Column, float, float]]:
    if not RULES:
        long = F.col("n_words") >= 2 * MIN_WORDS
        RULES.update(
            {
                "short": (-F.col("n_words"), -5.0 * MIN_WORDS, -0.5 * MIN_WORDS),
                "symbols": (_ratio("n_symbols", "n_words"), 0.02, 0.15),
                "repeats": (F.when(long, _ratio("n_repeat_words", "n_words")), 0.1, 0.2),
                "lines": (F.when(F.col("n_lines") >= 5, _ratio("n_dup_lines", "n_lines")), 0.2, 0.5),
                "capitals": (_ratio("n_upper", "n_letters"), 0.15, 0.4),
                "marks": (_ratio("n_marks", "n_words"), 0.05, 0.3),
                "top_word": (F.when(long, _ratio("n_top", "n_words")), 0.12, 0.25),
                "word_length": (F.abs(_ratio("word_chars", "n_words") - 6.0), 3.5, 6.0),
                "letters": (-_ratio("n_letters", "word_chars"), -0.85, -0.75),
                "endings": (_ratio("n_odd", "n_words"), 0.05, 0.25),
            }
        )
    return RULES


def repeated_words(codes: np.ndarray, rows: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of n words that occurs twice or more in their row."""
    out = np.zeros(len(codes), bool)
    count = len(codes) - n + 1
    if count <= 0:
        return out
    start = np.flatnonzero(rows[:count] == rows[n - 1 :])
    if len(start) < 2:
        return out

    def neighbours(order: np.ndarray, near: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = start[order[:-1]][near], start[order[1:]][near]
        same = rows[a] == rows[b]
        for j in range(n):
            same &= codes[a + j] == codes[b + j]
        return a, b, same

    key = windows(mix(codes.astype(np.uint64) + np.uint64(1)), n)[start] + mix(rows[start].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    a, b, same = neighbours(order, key[order[1:]] == key[order[:-1]])
    if not same.all():  # unlike windows of one hash: sort by the words themselves
        a, b, same = neighbours(np.lexsort([codes[start + j] for j in range(n)] + [rows[start]]), slice(None))
    turn = np.zeros(len(codes) + 1, np.int64)
    found = np.unique(np.concatenate([a[same], b[same]]))
    np.add.at(turn, found, 1)
    np.add.at(turn, found + n, -1)
    return np.cumsum(turn[:-1]) > 0


def line_counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, its lines with a word, and those of them equal to an earlier one."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    start = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort([start, row])
    start, row = start[order], row[order]
    end = np.append(start[1:] - 1, 0)
    last = np.append(row[1:] != row[:-1], True)
    end[last] = offsets[1:][row[last]]
    solid = np.concatenate([[0], np.cumsum(SOLID[raw])])
    worded = solid[end] > solid[start]
    at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    lines = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw[raw != 10]))]).dictionary_encode()
    n = len(lines.dictionary)
    each = np.bincount(row[worded], minlength=rows)
    distinct = np.unique(row[worded] * n + lines.indices.to_numpy()[worded]) // n
    return each, each - np.bincount(distinct, minlength=rows)


def text_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All COUNTS of each row."""
    rows = len(offsets) - 1

    def sums(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    words = split_words(raw, offsets, SOLID, lower=False)
    terms = exact(words, SOLID)
    codes, n = terms.indices.to_numpy().astype(np.int64), max(len(terms.dictionary), 1)
    each, times = np.unique(words.row * n + codes, return_counts=True)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, each // n, times)
    n_lines, n_dup = line_counts(raw, offsets)
    # a word ends oddly unless in a letter, digit or one closing mark after one
    last = words.lower[words.end - 1] if len(codes) else words.lower[:0]
    before = words.lower[np.maximum(words.end - 2, words.start)] if len(codes) else last
    odd = ~(PLAIN[last] | (CLOSERS[last] & PLAIN[before]))
    return {
        "n_words": np.diff(words.bounds),
        "word_chars": sums(SOLID[raw] & FIRST[raw]),
        "n_symbols": sums(SYMBOLS[raw]),
        "n_dup_lines": n_dup,
        "n_repeat_words": np.bincount(words.row[repeated_words(codes, words.row)], minlength=rows),
        "n_lines": n_lines,
        "n_letters": sums(LETTERS[raw]),
        "n_upper": sums(UPPER[raw]),
        "n_marks": sums(MARKS[raw]),
        "n_top": top,
        "n_odd": np.bincount(words.row[odd], minlength=rows),
    }


def _batches(batches):
    for batch in batches:
        found = [text_counts(raw, offsets) for _, raw, offsets in pieces(batch.column(1))]
        columns = [pa.array(np.concatenate([x[c] for x in found]) if found else [], pa.int64()) for c in COUNTS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_fb_row", *COUNTS])


def signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with the COUNTS."""
    base = without(docs, " ".join(COUNTS))
    rows = packed(base, text=text_col)
    schema = T.StructType([rows.schema["_fb_row"], *[T.StructField(c, T.LongType()) for c in COUNTS]])
    return unpacked(rows.mapInArrow(_batches, schema), [c for c in base.columns if c != text_col], {}, " ".join(COUNTS))


def votes() -> dict[str, Column]:
    """Each rule's vote from the COUNTS, as v_<rule>."""
    return {f"v_{name}": F.when(x <= good, 1).when(x > bad, -1).otherwise(0) for name, (x, good, bad) in _rules().items()}


def fit(patterns: np.ndarray, weights: np.ndarray, rounds: int = 500, tolerance: float = 1e-10) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good documents, each rule's accuracy on good and on bad ones) by EM over patterns of votes.

    It starts at the verdict of a filter that all rules must pass, held for nine parts in ten, since bad texts of one kind are seen by few
    rules; from there, rules that also vote against texts which all others like lose weight. Each accuracy is smoothed by
    two right votes and a wrong one, the share by a document on each side, so neither reaches 0 or 1.
    """
    w = weights.astype(np.float64)
    up, down = patterns == 1, patterns == -1
    good = np.where(down.any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        g, b = w * good, w * (1 - good)
        share = (g.sum() + 1) / (w.sum() + 2)
        right_good = (g @ up + 2) / (g @ up + g @ down + 3)
        right_bad = (b @ down + 2) / (b @ up + b @ down + 3)
        odds = np.log(share / (1 - share)) + up @ np.log(right_good / (1 - right_bad)) + down @ np.log((1 - right_good) / right_bad)
        before, good = good, 1 / (1 + np.exp(-odds))
        if len(good) == 0 or np.abs(good - before).max() < tolerance:
            break
    return share, right_good, right_bad


def posterior(model: tuple[float, np.ndarray, np.ndarray]) -> Column:
    """The probability that a document with these votes is good."""
    share, right_good, right_bad = model
    odds = F.lit(float(np.log(share / (1 - share))))
    for k, name in enumerate(_rules()):
        v, up, down = F.col(f"v_{name}"), float(np.log(right_good[k] / (1 - right_bad[k]))), float(np.log((1 - right_good[k]) / right_bad[k]))
        odds = odds + F.when(v == 1, up).when(v == -1, down).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without its text, with COUNTS, the votes, base_failed, posterior and kept."""
    names = list(votes())
    base = without(docs, " ".join([*names, "base_failed", "posterior", "kept"]))
    cast = written(signals(base, text_col).withColumns(votes()))
    seen = sorted(tuple(r) for r in cast.groupBy(*names).count().collect())  # at most 3 ** len(RULES) rows
    table = np.array(seen, np.int64).reshape(len(seen), len(names) + 1)
    model = fit(table[:, :-1], table[:, -1])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return cast.withColumns({"base_failed": failed, "posterior": posterior(model)}).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict; a null text has no words and is not kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", *COUNTS[:5], "base_failed", "kept", "posterior", *votes())
