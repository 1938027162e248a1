"""Text columns of a notebook: white space, sentences, citations, wording rules, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space in the ASCII sense plus no-break and ideographic space, alike in every regex engine
SPACE = r"[\s\x{00A0}\x{3000}]"
#: what SPACE matches in a line, other than the blank
ODD_SPACES = ("\t", "\x0b", "\f", "\r", "\u00a0", "\u3000")
#: white space other than single blanks, which are most of it and need no change
_UNEVEN = rf"[\t\n\x0B\f\r\x{{00A0}}\x{{3000}}]{SPACE}*| {SPACE}+"
#: separates sentences while they are being split; occurs in no text
_MARK = "\x1e"

# Wording that a record must not use, by language, and what is wrong with it.
FORBIDDEN = [
    ("ko", "estimate", r"보인다|보였다"),
    ("ko", "forecast", r"예상된다|예상됨|전망된다"),
    ("ko", "praise", r"성공적으로|괄목할|현저히|획기적"),
    ("ko", "vague quantity", r"대략|대충|어림잡아"),
    ("ko", "approximate number", r"(?:^|[^가-힣])약\s*\d"),
    ("ko", "estimate", r"추정된다|추정됨|짐작"),
    ("ko", "uncertain", r"아마도?|어쩌면"),
    ("ko", "opinion", r"것으로\s*판단(?:된다|됨)"),
    ("en", "estimate", r"(?i)\b(?:appears?|seems?|looks?\s+like)\b"),
    ("en", "forecast", r"(?i)\b(?:expected|anticipated|projected)\s+to\b|\bwill\s+likely\b"),
    ("en", "praise", r"(?i)\b(?:successfully|remarkabl\w+|dramatic\w*|impressive\w*)\b"),
    ("en", "vague quantity", r"(?i)\b(?:roughly|approximately|about|around)\s+\d"),
    ("en", "estimate", r"(?i)\b(?:presumabl\w+|we\s+estimate|estimated\s+to\s+be)\b"),
    ("en", "uncertain", r"(?i)\b(?:maybe|perhaps|possibly|probably)\b"),
    ("en", "opinion", r"(?i)\bit\s+(?:is|was)\s+(?:judged|considered|believed)\b"),
    ("ja", "estimate", r"と思われる|ように見える|模様である"),
    ("ja", "forecast", r"と予想され|見込まれ|であろう"),
    ("ja", "praise", r"成功裏に|著しく|飛躍的|画期的"),
    ("ja", "vague quantity", r"(?:およそ|約|ほぼ)\s*\d"),
    ("ja", "estimate", r"推定される|と推察"),
    ("ja", "uncertain", r"おそらく|もしかすると"),
    ("ja", "opinion", r"と判断される|と考えられる"),
]
# Claims that a target was met, their negations, and the statement that there is no evidence.
ACHIEVED = r"(?i)달성|목표\s*충족|achiev|target\s*met|goal\s*met|達成"
NOT_ACHIEVED = r"(?i)미달성|미\s*달성|않음|못함|not\s*achiev|un-?achiev|未達成|未達"
NO_EVIDENCE = r"해당\s*기간\s*(관련\s*)?증거(\s*자료)?\s*없음"
# Fixed value: a number with a unit of measurement.
MEASUREMENT = r"\d+(\.\d+)?\s*(%|점|건|회|초|ms|kg|mg|℃|°C|mm|명|개)"


def norm_space(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN, " "))


def split_sentences(text: Column) -> Column:
    """Sentences of a text: they end at a newline, or at ``.!?`` before white space, a quote, a bracket or the end."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"""([.!?])([\s"')\]])""", "$1" + _MARK + "$2")
    parts = F.transform(F.split(marked, f"[{_MARK}\n]"), lambda s: F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", ""))
    return F.filter(parts, lambda s: s != "")


def citations(text: Column, digits: str = "{1,5}") -> Column:
    """Evidence ids cited as [E12], without leading zeros, each once, in the order of first mention.

    A gate reads numbers of up to five digits, as a notebook gives them; digits widens that.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\[E(\d{digits})\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("E"), F.regexp_replace(x, r"^0+(?=\d)", ""))))


def strip_citations(text: Column, digits: str = "{1,5}") -> Column:
    """The text without citations (see citations) and with single blanks."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\[E\d{digits}\]", "")
    return F.trim(F.regexp_replace(bare, r"\s{2,}", " "))


def states_no_evidence(sentence: Column) -> Column:
    return F.coalesce(sentence.rlike(NO_EVIDENCE), F.lit(False))


def forbidden_rule(sentence: Column) -> Column:
    """The number of the first forbidden wording in a sentence, or null."""
    # most sentences hold none, which one pattern over all tells
    some = sentence.rlike("|".join(f"(?:{pattern})" for _, _, pattern in FORBIDDEN))
    rules = F.when(sentence.rlike(FORBIDDEN[0][2]), 0)
    for k, (_, _, pattern) in enumerate(FORBIDDEN[1:], 1):
        rules = rules.when(sentence.rlike(pattern), k)
    return F.when(some, rules)


def forbidden_reason(rule: Column) -> Column:
    """language/reason of a rule number."""
    return F.when(rule.isNotNull(), F.element_at(F.array(*[F.lit(f"{lang}/{why}") for lang, why, _ in FORBIDDEN]), rule + 1))


def claims_achieved(text: Column) -> Column:
    """Whether a text claims a met target; a negation wins."""
    return F.coalesce(text.rlike(ACHIEVED) & ~text.rlike(NOT_ACHIEVED), F.lit(False))


def is_measurement(text: Column) -> Column:
    return F.coalesce(text.rlike(MEASUREMENT), F.lit(False))


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def extension(name: Column) -> Column:
    """The lower-cased file extension, or empty."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.]+)$", 1))


# Characters that a file name may not have, and names of files that are no documents.
NO_NAME = r'[/\\:*?"<>|\x00-\x1F]'
JUNK = r"^\.|^~\$| \(\d+\)\.[^.]+$|(?i)\.(tmp|crdownload|partial)$"


def safe_name(name: Column) -> Column:
    """A file name without separators, wildcards and controls, of at most 180 characters."""
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), NO_NAME, "_")
    return F.coalesce(F.nullif(F.substring(clean, 1, 180), F.lit("")), F.lit("_"))


def is_junk_name(name: Column) -> Column:
    """Hidden files, browser copies like ``x (1).pdf``, lock files and unfinished downloads."""
    return F.coalesce(name.rlike(JUNK), F.lit(False))


def format_bytes(n: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n < kb, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < mb, F.format_string("%.1f KB", n / kb))
        .when(n < gb, F.format_string("%.1f MB", n / mb))
        .otherwise(F.format_string("%.2f GB", n / gb))
    )


def slug(name: Column, size: int = 40) -> Column:
    """A key for a metric's name: lower case, other than letters and digits as underscores."""
    dashed = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9가-힣]+", "_")
    return F.substring(F.regexp_replace(dashed, "^_+|_+$", ""), 1, size)


def reply_array(text: Column, schema: str) -> Column:
    """The JSON array inside a reply, from its first bracket to its last, as schema says; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit("")), schema)


def base64url(data: Column) -> Column:
    """Bytes as URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    """The bytes of URL-safe base64, padded or not."""
    plain = F.translate(F.rtrim(text, F.lit("=")), "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "="))


def key_fingerprint(kind: Column, curve: Column, x: Column, y: Column) -> Column:
    """The first eight bytes of the SHA-256 of a public key's parts, as hex pairs with colons."""
    digest = F.left(F.sha2(F.concat_ws("|", kind, curve, x, y), 256), F.lit(16))
    return F.array_join(F.regexp_extract_all(digest, F.lit("(..)"), F.lit(1)), ":")


def auto_code(day: Column) -> Column:
    """A code for a project that has none, by the day it began."""
    return F.concat(F.lit("PRJ-"), F.date_format(day, "yyyy-MMdd"))
