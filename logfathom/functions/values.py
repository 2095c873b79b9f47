"""Scalar functions over log text: levels, timestamps, numbers, folding, templates, tokens. All are JVM expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from logfathom.functions.dialect import bind, match_groups, rewrite

# The spellings of each level.
LEVELS = {
    "TRACE": ["trace", "trc", "verbose", "vrb", "finest"],
    "DEBUG": ["debug", "dbg", "fine", "finer"],
    "INFO": ["info", "information", "informational", "notice", "inf"],
    "WARN": ["warn", "warning", "wrn"],
    "ERROR": ["error", "err", "severe", "failure"],
    "FATAL": ["fatal", "critical", "crit", "emerg", "emergency", "alert", "panic"],
}
LEVEL_NAMES = list(LEVELS)
# Timestamp shapes and the words that an unstructured line is searched for.
YMD = r"^(\d{4})[-/](\d{2})[-/](\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:[.,](\d{1,9}))?\s*(Z|[+-]\d{2}:?\d{2})?\z"
CLF = r"^(\d{2})/([A-Za-z]{3})/(\d{4}):(\d{2}):(\d{2}):(\d{2})\s*([+-]\d{4})?\z"
SYSLOG = r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})\z"
SNIFF_TS = r"\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?"
SNIFF_LEVEL = r"\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|ERR|FATAL|CRITICAL|SEVERE|NOTICE)\b"
NUMBER = r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\z"
CONTINUATION = r"^(Caused by:|\.{3}\s*\d+\s+more\b|at\s)"
GENERIC_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm[X]", "yyyy-MM-dd HH:mm", "MMM d HH:mm:ss yyyy", "d MMM yyyy HH:mm:ss[ z]", "MMM d, yyyy HH:mm:ss"]
TEMPLATE_CHARS, TEMPLATE_TOKENS, PLACEHOLDER = 4096, 80, "<*>"
LEVEL_WORD = "(?i)" + rewrite(SNIFF_LEVEL).java
#: White space but the blank, as patterns see it, and a token (from a blank on) that varies or is a mask.
_SPACES = "\t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_VARYING = r"(?:[^ 0-9]*+[0-9][^ ]*+|(?:[a-fA-F]{12,}+|<\*>)(?![^ ]))"
#: Blank, indented, or one of the above.
_CONTINUES = rewrite(rf"^$|^\s|{CONTINUATION}").java
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    """Case-folded in ASCII only: the equality of field values."""
    return F.translate(c, _UPPER, _LOWER)


def normalize_level(c: Column) -> Column:
    """The canonical level of a spelling, else null."""
    known = F.create_map(*[F.lit(x) for name, words in LEVELS.items() for w in words for x in (w, name)])
    return F.element_at(known, F.lower(F.trim(c)))


def to_num(c: Column) -> Column:
    """A field value as a number if all of it is one, else null (so not ``5d`` or ``NaN``)."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def is_continuation(c: Column) -> Column:
    """Blank, indented, or a line of a JVM trace."""
    return c.rlike(_CONTINUES)


def _int(c: Column) -> Column:
    return c.try_cast("long")


def _zone_ms(zone: Column) -> Column:
    """Milliseconds that a zone (Z, +hh:mm, +hhmm, empty) is ahead of UTC."""
    bare = F.replace(zone, F.lit(":"), F.lit(""))
    size = (_int(F.substring(bare, 2, 2)) * 60 + _int(F.substring(bare, 4, 2))) * 60000
    return F.when(zone.isin("", "Z"), F.lit(0)).when(zone.startswith("-"), -size).otherwise(size)


def _utc_ms(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Epoch milliseconds; months and days beyond their range roll over."""
    first = F.add_months(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (month - 1).cast("int"))
    return ((F.unix_date(first).cast("long") + day - 1) * 24 + hour) * 3600000 + minute * 60000 + second * 1000


def ymd_ms(s: Column) -> Column:
    """Epoch milliseconds of an ISO-like timestamp, else null. Date and time stand at fixed places, so one search and
    substrings will do; name a column, or a bound variable, since s is used for each part."""
    part = lambda at, n: _int(F.substring(s, at, n))
    rest = F.substring(s, 20, 64)
    digits = F.regexp_extract(rest, r"^[.,](\d+)", 1)
    frac = F.when(rest.rlike(r"^[.,]"), F.round(F.concat(F.lit("0."), digits).try_cast("double") * 1000).cast("long")).otherwise(F.lit(0))
    zone = F.when(rest.rlike(r"[Z+-]"), _zone_ms(F.regexp_extract(rest, r"(?:Z|[+-].*)\z", 0))).otherwise(F.lit(0))
    ms = _utc_ms(part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), part(18, 2))
    return F.when(s.rlike(YMD), F.when(rest == "", ms).otherwise(ms + frac - zone))


def parse_timestamp(c: Column, year: int | Column = 1970) -> Column:
    """A timestamp in milliseconds UTC: ISO-like with zone, access-log, syslog (in the given year), epoch seconds (10
    digits, decimals allowed) or milliseconds (13 digits), or one of GENERIC_FORMATS; else null."""
    return F.timestamp_millis(bind(F.trim(c), lambda s: timestamp_ms(s, year)))


def timestamp_ms(s: Column, year: int | Column = 1970) -> Column:
    """Epoch milliseconds of a trimmed timestamp, as parse_timestamp(); a column, since it is used for each shape."""
    months = F.create_map(*[x for i in range(12) for x in (F.lit(_MONTHS[3 * i : 3 * i + 3]), F.lit(i + 1))])
    month = lambda x: F.element_at(months, F.lower(x)).cast("long")
    year = F.lit(year) if isinstance(year, int) else year
    clf = bind(match_groups(s, CLF, 7), lambda a: _utc_ms(_int(a[2]), month(a[1]), _int(a[0]), _int(a[3]), _int(a[4]), _int(a[5])) - _zone_ms(a[6]))
    syslog = bind(match_groups(s, SYSLOG, 5), lambda g: _utc_ms(year, month(g[0]), _int(g[1]), _int(g[2]), _int(g[3]), _int(g[4])))
    seconds = F.when(s.rlike(r"^\d{10}(\.\d+)?\z"), F.round(s.try_cast("double") * 1000).cast("long"))
    millis = F.when(s.rlike(r"^\d{13}\z"), s.try_cast("long"))
    bare = F.regexp_replace(s, r"^[A-Za-z]{3},?\s+(?=[A-Za-z]{3}\s|\d)", "")
    generic = F.coalesce(*[F.unix_millis(F.try_to_timestamp(bare, F.lit(f))) for f in GENERIC_FORMATS])
    return F.coalesce(ymd_ms(s), clf, syslog, seconds, millis, generic)


def sniff_level(c: Column) -> Column:
    """The level of the first level word of a line, else null."""
    return normalize_level(F.regexp_extract(c, LEVEL_WORD, 1))


def sniff_timestamp(c: Column) -> Column:
    """The first ISO-like timestamp of a line, else null."""
    return F.timestamp_millis(bind(F.regexp_extract(c, SNIFF_TS, 0), ymd_ms))


def template_of(c: Column) -> Column:
    """A line with its varying tokens (any with a digit, or 12 and more hex digits) masked and runs of them merged; of
    the first 4,096 characters at most 80 tokens, then an ellipsis. Each step is one pass over the line, and none goes back
    over a token."""
    spaced = F.trim(F.regexp_replace(F.translate(F.substring(c, 1, TEMPLATE_CHARS), _SPACES, " " * len(_SPACES)), "  ++", " "))
    # A token that is "<*>" itself looks like a mask; it has no digit, so such a line merges it with masks next to it.
    masked = F.regexp_replace(spaced, rf"(?<![^ ]){_VARYING}(?: {_VARYING})*+", PLACEHOLDER)
    return F.regexp_replace(masked, rf"^((?:[^ ]*+ ){{{TEMPLATE_TOKENS - 1}}}[^ ]*+) [\s\S]*+", "$1 …")


def _accents() -> tuple[str, str]:
    """Letters that are an ASCII letter with one mark, and these letters in lower case; then the marks themselves, which go.
    Letters with two marks, and those of other scripts, are letters of their own."""
    parts = {chr(i): unicodedata.decomposition(chr(i)).split() for i in range(0xC0, 0x1F00)}
    marked = {c: [chr(int(x, 16)) for x in p] for c, p in parts.items() if len(p) == 2 and not p[0].startswith("<")}
    kept = {c: p for c, p in marked.items() if p[0].isascii() and p[0].isalpha()}
    return "".join(kept) + "".join(sorted({mark for _, mark in kept.values()})), "".join(p[0].lower() for p in kept.values())


def tokens_of(c: Column) -> Column:
    """`` t1 t2 ... `` : the tokens (runs of letters and digits) of a line, case-folded, Latin letters without their accents."""
    accented, plain = _accents()
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.translate(c, accented, plain)), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def folded_tokens(value: str) -> str:
    """The tokens of a Python string, folded as tokens_of() does, with single spaces between."""
    import regex

    accented, plain = _accents()
    folded = value.translate(str.maketrans(accented[: len(plain)], plain, accented[len(plain) :])).lower()
    return " ".join(regex.findall(r"[\p{L}\p{N}]+", folded))
