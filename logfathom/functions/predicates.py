"""Predicates over log lines: boolean columns for ``DataFrame.filter``, composed with ``&``, ``|`` and ``~``.

Predicates on level and ts are comparisons of columns, null where those are null, so that their negation drops such
lines as well; predicates on fields and text are false there, so that their negation keeps them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logfathom.functions.dialect import BadPattern, bind, match_groups, rewrite
from logfathom.functions.values import LEVELS, ascii_fold, folded_tokens, to_num, tokens_of

# Names under which the level and the timestamp are asked for (any case).
LEVEL_ALIASES = ["level", "lvl", "severity", "loglevel"]
TS_ALIASES = ["timestamp", "ts", "time", "@timestamp", "date", "datetime"]
_OPS = {"eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
_SPELLINGS = {w: name for name, words in LEVELS.items() for w in words}


def _kind(field: str) -> str:
    low = field.lower()
    return "level" if low in LEVEL_ALIASES else "ts" if low in TS_ALIASES else "field"


def _value(field: str) -> Column:
    return F.col("fields")[field]


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def match_all() -> Column:
    return F.lit(True)


def all_of(*preds: Column) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def any_of(*preds: Column) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def negate(pred: Column) -> Column:
    return ~pred


def term(value: str, column: str = "text") -> Column:
    """Consecutive tokens of which the last is a prefix; case- and accent-folded. No token: matches nothing."""
    tokens = folded_tokens(value)
    return _sure(F.contains(tokens_of(F.col(column)), F.lit(f" {tokens}"))) if tokens else F.lit(False)


def phrase(value: str, column: str = "text") -> Column:
    """Consecutive whole tokens."""
    tokens = folded_tokens(value)
    return _sure(F.contains(tokens_of(F.col(column)), F.lit(f" {tokens} "))) if tokens else F.lit(False)


def field_eq(field: str, value: str) -> Column:
    """Text equality, ASCII case aside; never numeric."""
    if _kind(field) == "level":
        return level_cmp("eq", value)
    if _kind(field) == "ts":
        return ts_cmp("eq", value)
    return _sure(ascii_fold(_value(field)) == ascii_fold(F.lit(value)))


def field_cmp(field: str, op: str, value: float | str) -> Column:
    """Order: numeric for a number (values that aren't numbers never match), else by text, ASCII case aside."""
    if _kind(field) == "level":
        return level_cmp(op, str(value))
    if _kind(field) == "ts":
        return ts_cmp(op, str(value))
    if isinstance(value, str):
        return _sure(_OPS[op](ascii_fold(_value(field)), ascii_fold(F.lit(value))))
    return _sure(_OPS[op](to_num(_value(field)), F.lit(float(value))))


def level_cmp(op: str, value: str) -> Column:
    """By name (text order, not severity); spellings are normalized, others upper-cased."""
    return _OPS[op](F.col("level"), F.lit(_SPELLINGS.get(value.strip().lower(), value.upper())))


_TS = re.compile(r"(\d{4})-(\d{2})(?:-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,3}))?)?)?)?(Z|[+-]\d{2}:?\d{2})?")


def ts_range(value: str) -> tuple[int, int]:
    """[start, end) in epoch milliseconds that a month, day, minute, second or millisecond covers."""
    m = _TS.fullmatch(value.strip())
    if not m:
        raise ValueError(f"not a timestamp: {value}")
    y, mo, d, h, mi, s, frac, zone = m.groups()
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    start = datetime(int(y), 1, 1, tzinfo=timezone.utc)
    month = lambda n: start.replace(year=int(y) + (n - 1) // 12, month=(n - 1) % 12 + 1)  # noqa: E731  months beyond 12 roll over
    begin = month(int(mo)) + timedelta(days=int(d or 1) - 1, hours=int(h or 0), minutes=int(mi or 0), seconds=int(s or 0))
    if not d:
        end = month(int(mo) + 1)
    elif not h:
        end = begin + timedelta(days=1)
    elif not s:
        end = begin + timedelta(minutes=1)
    elif not frac:
        end = begin + timedelta(seconds=1)
    else:
        begin += timedelta(milliseconds=round(float(f"0.{frac}") * 1000))
        end = begin + timedelta(milliseconds=1)
    ahead = 0
    if zone and zone != "Z":
        bare = zone[1:].replace(":", "")
        ahead = (int(bare[:2]) * 60 + int(bare[2:])) * 60000 * (-1 if zone[0] == "-" else 1)
    ms = lambda t: (t - epoch) // timedelta(milliseconds=1) - ahead
    return ms(begin), ms(end)


def ts_cmp(op: str, value: str) -> Column:
    """A comparison as wide as the value is precise: eq is in the range, gt from its end on, lte before its end."""
    start, end = ts_range(value)
    at = lambda ms: F.timestamp_millis(F.lit(ms))
    ts = F.col("ts")
    return {"eq": (ts >= at(start)) & (ts < at(end)), "gt": ts >= at(end), "gte": ts >= at(start), "lt": ts < at(start), "lte": ts < at(end)}[op]


def _like(glob: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", glob).replace("*", "%")


def field_like(field: str, glob: str) -> Column:
    """``*`` for any run of characters, over the whole value, ASCII case aside; also on level, not on ts."""
    kind = _kind(field)
    if kind == "ts":
        raise ValueError("wildcards do not apply to timestamps")
    c = F.col("level") if kind == "level" else _value(field)
    hit = ascii_fold(c).like(_like(glob).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return hit if kind == "level" else _sure(hit)


def field_exists(field: str) -> Column:
    """The key is there, be its value empty; for level and ts: not null."""
    kind = _kind(field)
    return F.col(kind).isNotNull() if kind != "field" else _sure(F.map_contains_key("fields", F.lit(field)))


def field_regex(field: str, pattern: str) -> Column:
    """A case-insensitive search in the value; also on level, not on ts. A bad pattern raises BadPattern."""
    kind = _kind(field)
    if kind == "ts":
        raise ValueError("regular expressions do not apply to timestamps")
    hit = (F.col("level") if kind == "level" else _value(field)).rlike(rewrite(pattern, ignore_case=True).java)
    return hit if kind == "level" else _sure(hit)


def line_regex(pattern: str) -> Column:
    """A case-insensitive search in the whole line."""
    return _sure(F.col("text").rlike(rewrite(pattern, ignore_case=True).java))


@dataclass(frozen=True)
class Capture:
    """An ad-hoc field taken out of the text: the group of its own name, else the first group, else the whole match."""

    name: str
    pattern: str

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z_][\w.]*", self.name):
            raise BadPattern(f"not a field name: {self.name}")
        rewrite(self.pattern)

    def column(self) -> Column:
        """The value, or null without a match; case-sensitive."""
        p = rewrite(self.pattern)
        named = {name: number for name, number, _ in p.groups}
        if not p.count:
            return match_groups(F.col("text"), f"({p.java})", 1)[0]
        return match_groups(F.col("text"), p.java, p.count)[named.get(self.name, 1) - 1]


def capture(name: str, pattern: str) -> Column:
    return Capture(name, pattern).column()


def js_number(c: Column) -> Column:
    """A text as JavaScript's Number() takes it: blanks around, a sign, ``.5``, ``5.``, hexadecimal, octal and binary with
    their prefixes, and an empty text as 0; else null."""

    def number(s: Column) -> Column:
        of_base = [F.when(s.rlike(rf"(?i)^0{mark}[{digits}]{{1,15}}\z"), F.conv(F.substring(s, 3, 15), base, 10).try_cast("double")) for mark, digits, base in (("x", "0-9a-f", 16), ("o", "0-7", 8), ("b", "01", 2))]
        decimal = F.when(s.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), s.try_cast("double"))
        found = F.coalesce(*of_base, decimal)
        return F.when(s == "", F.lit(0.0)).when(F.abs(found) < float("inf"), found)

    return bind(F.trim(F.regexp_replace(c, r"^[\s\x0B\u00a0\ufeff]+|[\s\x0B\u00a0\ufeff]+\z", "")), number)


def capture_eq(c: Capture, value: str) -> Column:
    return _sure(F.lower(c.column()) == value.lower())


def capture_cmp(c: Capture, op: str, value: float | str) -> Column:
    if isinstance(value, str):
        return _sure(_OPS[op](F.lower(c.column()), F.lit(value.lower())))
    return _sure(_OPS[op](js_number(c.column()), F.lit(float(value))))


def capture_like(c: Capture, glob: str) -> Column:
    return _sure(F.lower(c.column()).like(_like(glob).lower()))


def capture_regex(c: Capture, pattern: str) -> Column:
    return _sure(c.column().rlike(rewrite(pattern, ignore_case=True).java))


def capture_exists(c: Capture) -> Column:
    return c.column().isNotNull()


def in_template(pattern: str) -> Column:
    """Lines whose template is the given one."""
    return _sure(F.col("template") == pattern)
