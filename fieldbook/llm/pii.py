"""Personal data: an Aho-Corasick pass finds anchors, local parsers expand and validate around them.

Anchors are at-signs, plus signs, digits, schemes and account cues. From an anchor the parser takes
the run of characters that its kind can hold; every match of the kind's pattern that touches the
anchor lies inside that run, so parsing the run gives exactly the leftmost non-overlapping matches
of the whole text, in time linear in its length. Kinds and their checks:

* email  local part, at-sign, dotted domain
* ip     four dotted numbers, each at most 255
* card   14 to 19 digits with single blanks or hyphens between, Luhn check
* phone  a plus sign and 10 to 15 digits with separators
* url    (added by the method) a scheme or "www." and its host
* account (added) an IBAN with a valid checksum, or the digits after an account cue

A match that fails its check is dropped and not retried. Spans are [start, end) in code points.

Defined cases: a null or empty text has no spans; an id may be null or repeated, each row stands
alone; texts of any length are handled whole; an empty table gives an empty one. find_pii keeps the columns of the
input, but replaces one named spans in any case; redact keeps all, with the text changed.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm.scratch import packed, unpacked, without

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*://|www\.)[^\s<>\"'`{}|\\^]*[A-Za-z0-9/]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
_NUMBER = re.compile(r"number|no\.?|nr\.?|#", re.I)
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9]){5,17}(?![0-9])")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP_CHARS = frozenset("0123456789.")
_CARD_CHARS = frozenset("0123456789 -")
#: lower- and upper-case cues of an account identifier
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "routing")
SCHEMES = ("http://", "https://", "ftp://", "www.")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", "email")
    found.add_word("+", "phone")
    for d in "0123456789":
        found.add_word(d, "digit")
    for s in SCHEMES:
        for form in (s, s.upper(), s.capitalize()):
            found.add_word(form, ("url", len(s)))
    for c in CUES:
        for form in (c, c.upper(), c.capitalize()):
            found.add_word(form, ("account", len(c)))
    found.make_automaton()
    return found


def run_around(text: str, at: int, chars: frozenset) -> tuple[int, int]:
    """The maximal run of chars around position at."""
    a = b = at
    while a and text[a - 1] in chars:
        a -= 1
    while b < len(text) and text[b] in chars:
        b += 1
    return a, b


def ip_spans(text: str, a: int, b: int):
    """Groups of four dotted numbers, taken from the left, in a run of digits and dots."""
    group, at = [], a
    for part in text[a:b].split("."):
        group = [*group, (at, part)] if part else []
        at += len(part) + 1
        if len(group) == 4:
            if all(int(p.lstrip("0")[:4] or 0) <= 255 for _, p in group):
                yield group[0][0], at - 1
            group = []


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def after_cue(text: str, at: int) -> re.Match | None:
    """The digits after an account cue: blanks, a word for number, a separator; each blank is read once."""

    def blanks(at: int) -> int:
        while at < len(text) and text[at].isspace():
            at += 1
        return at

    at = blanks(at)
    if m := _NUMBER.match(text, at):
        at = blanks(m.end())
    if at < len(text) and text[at] in ":#=":
        at = blanks(at + 1)
    return _DIGITS.match(text, at)


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all valid spans, by start and then kind as listed."""
    out = []
    done = dict.fromkeys(("email", "ip", "card", "url", "account"), 0)  # each kind's text before this is settled
    for last, what in anchors.iter(text):
        if what == "digit":
            if last >= done["card"]:
                a, b = run_around(text, last, _CARD_CHARS)
                done["card"] = b
                if b - a >= 14:
                    for m in _CARD.finditer(text, a, b):
                        digits = only_digits(m[0])
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            out.append((*m.span(), "card"))
            if last >= done["ip"]:
                a, b = run_around(text, last, _IP_CHARS)
                done["ip"] = b
                if b - a >= 7:
                    out += [(*s, "ip") for s in ip_spans(text, a, b)]
        elif what == "email":
            if m := _DOMAIN.match(text, last + 1):
                a = last
                while a > done["email"] and text[a - 1] in _LOCAL_CHARS:
                    a -= 1
                if a < last:
                    done["email"] = m.end()
                    out.append((a, m.end(), "email"))
        elif what == "phone":
            if (m := _PHONE.match(text, last)) and 10 <= len(only_digits(m[0])) <= 15:
                out.append((*m.span(), "phone"))
        elif what[0] == "url":
            if (start := last - what[1] + 1) >= done["url"] and (m := _URL.match(text, start)):
                done["url"] = m.end()
                out.append((*m.span(), "url"))
        elif (start := last - what[1] + 1) >= done["account"] and not (start and text[start - 1].isalnum()):
            rest = last + 1
            while rest < len(text) and text[rest] in " \t:#=":
                rest += 1
            if (m := _IBAN.match(text, rest)) and iban_ok(m[0]):
                span = m.span()
            elif m := after_cue(text, last + 1):
                span = m.span()
            else:
                continue
            done["account"] = span[1]
            out.append((*span, "account"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def _batches(text_at: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        anchors = automaton()
        for batch in batches:
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in find_spans(x.as_py() or "", anchors)] for x in batch.column(text_at)]
            out = {c: batch.column(i) for i, c in enumerate(batch.schema.names)} | {"spans": pa.array(spans, kind)}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with spans: array<struct<start, end, kind>> by start and then kind as listed."""
    base, roles = without(docs, "spans"), {"text": text_col}
    rows = packed(base, **roles)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("spans array<struct<start:long,end:long,kind:string>>").fields])
    return unpacked(rows.mapInArrow(_batches(1), schema), base.columns, roles, "spans")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by [KIND]; overlapping spans are replaced as one, named after the first."""

    @F.pandas_udf("string")
    def cut(text, spans):
        def one(t, found):
            out, at = [], 0
            for s in found:
                if s["start"] >= at:
                    out += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                at = max(at, s["end"])
            return "".join([*out, t[at:]])

        return text.combine(spans, lambda t, found: t if t is None else one(t, found))

    roles = {"text": text_col}
    return unpacked(find_pii(packed(docs, **roles)), docs.columns, roles, **{text_col: cut("text", "spans")})


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Every document with its counts and spans; a null text has none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    found = find_pii(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
