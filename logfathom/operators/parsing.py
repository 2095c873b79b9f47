"""Parsing jobs: from raw lines (stream, line_no, text) to ts, level, message, fields, starts_record.

A line that its format does not match falls back to the raw parser: level and timestamp sniffed, the line as message,
no fields. A format's pattern runs once for each line; its groups are kept as an array.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfathom.functions.dialect import bind, match_groups, rewrite
from logfathom.functions.values import LEVEL_WORD, SNIFF_TS, is_continuation, normalize_level, timestamp_ms, ymd_ms
from logfathom.sources.ordered import staged

# Keys that hold the timestamp, level and message of JSON and logfmt lines, in order.
TS_KEYS = ["timestamp", "@timestamp", "time", "ts", "date", "datetime", "eventtime"]
LEVEL_KEYS = ["level", "log.level", "severity", "loglevel", "lvl", "event.severity", "labels.severity"]
MESSAGE_KEYS = ["message", "msg", "text", "event.message", "log.message"]
# The text formats (JavaScript dialect), in the order in which ties go.
TIMESTAMPED = r"^(?<timestamp>\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?)\s+(?:\[(?<level>[A-Za-z]+)\]|(?<level2>[A-Z]{3,12}):?)\s+(?:\[?(?<logger>[\w.$/-]+)\]?\s*[-:]\s+)?(?<message>.*)$"
BRACKETED = r"^\[(?<timestamp>[^\]]{8,40})\]\s*\[?(?<level>[A-Za-z]+)\]?:?\s+(?<message>.*)$"
ACCESS = r'^(?<ip>\S+)\s+\S+\s+(?<user>\S+)\s+\[(?<timestamp>[^\]]+)\]\s+"(?<method>\S+)\s+(?<path>\S+)(?:\s+(?<protocol>[^"]*))?"\s+(?<status>\d{3})\s+(?<bytes>\d+|-)(?:\s+"(?<referer>[^"]*)"\s+"(?<agent>[^"]*)")?'
SYSLOG = r"^(?<timestamp>[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(?<host>\S+)\s+(?<proc>[\w\-./]+)(?:\[(?<pid>\d+)\])?:\s*(?<message>.*)$"
PYTHON = r"^(?<level>[A-Z]{4,12}):(?<logger>[\w.]+):(?<message>.*)$"
TEXT_FORMATS = {"timestamped": TIMESTAMPED, "bracketed": BRACKETED, "access": ACCESS, "syslog": SYSLOG, "python": PYTHON}
LOGFMT_PAIR = r'([A-Za-z_][\w.@-]*)=(?:"((?:[^"\\]|\\.)*)"|(\S*))'
FORMATS = ["json", *TEXT_FORMATS, "logfmt", "raw"]
_META = {"timestamp", "level", "level2", "message"}
_FIELDS = "map<string,string>"
FEW_STREAMS = 1000


@dataclass(frozen=True)
class NamedPattern:
    """A user format: a regular expression with one named group or more. A bad one raises BadPattern."""

    name: str
    pattern: str

    def __post_init__(self):
        if not rewrite(self.pattern).groups:
            raise ValueError(f"{self.name}: the pattern has no named group")


def _bound(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """keep and new columns of df, the new ones computed once a row: no later filter or projection is merged with a
    generator, which would repeat what they are made of."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _finished(rows: DataFrame, keep: Sequence[str], matched: Column, ts: Column, level: Column, message: Column, fields: Column, starts: Column, starts_else: Column, year: int) -> DataFrame:
    """keep and the parsed columns: from the texts given where matched, else sniffed as parse_raw() does. They are plain
    projections, so that those nobody asks for are not computed; the text of a timestamp is one of its own, which the many
    shapes of a timestamp then share."""
    text, none = F.col("text"), F.lit(None)
    parts = rows.select(
        *keep, matched.alias("__ok"), F.when(matched, F.trim(ts)).otherwise(F.regexp_extract(text, SNIFF_TS, 0)).alias("__ts"), F.when(matched, level).otherwise(F.regexp_extract(text, LEVEL_WORD, 1)).alias("__level"),
        F.when(matched, message).otherwise(text).alias("message"), F.when(matched, fields).otherwise(none.cast(_FIELDS)).alias("fields"), F.when(matched, starts).otherwise(starts_else).alias("starts_record"),
    )
    ms = F.when(F.col("__ok"), timestamp_ms(F.col("__ts"), year)).otherwise(ymd_ms(F.col("__ts")))
    return parts.select(*keep, F.timestamp_millis(ms).alias("ts"), normalize_level(F.col("__level")).alias("level"), "message", "fields", "starts_record")


def _map(pairs: Column) -> Column:
    """A map of (key, value) structs, null values left out, null if none is left."""
    full = F.filter(pairs, lambda p: p["value"].isNotNull())
    return F.when(F.size(full) > 0, F.map_from_entries(full))


def parse_pattern(raw: DataFrame, name: str, pattern: str, year: int = 1970) -> DataFrame:
    """Lines by a regular expression: groups timestamp, level, level2, message are metadata, the others fields, and
    message is a field too. An optional group that took no part is absent. A line starts a record if it matches."""
    p = rewrite(pattern, sentinels=True)
    if not p.groups:
        raise ValueError(f"{name}: the pattern has no named group")
    rows = _bound(raw, raw.columns, __g=match_groups(F.col("text"), p.java, p.count))
    group = lambda i: F.col("__g")[i - 1]
    value = {n: F.when(group(s) != "", group(v)) if s else group(v) for n, v, s in p.groups}
    none = F.lit(None).cast("string")
    pairs = [F.struct(F.lit(n).alias("key"), value[n].alias("value")) for n, _, _ in p.groups if n not in _META or n == "message"]
    fields = _map(F.array(*pairs)) if pairs else none.cast(_FIELDS)
    level = F.coalesce(value.get("level", none), value.get("level2", none))
    return _finished(rows, raw.columns, F.col("__g").isNotNull(), value.get("timestamp", none), level, value.get("message", none), fields, F.lit(True), F.lit(False), year)


def parse_timestamped(raw: DataFrame) -> DataFrame:
    return parse_pattern(raw, "timestamped", TIMESTAMPED)


def parse_bracketed(raw: DataFrame) -> DataFrame:
    return parse_pattern(raw, "bracketed", BRACKETED)


def parse_access(raw: DataFrame) -> DataFrame:
    return parse_pattern(raw, "access", ACCESS)


def parse_syslog(raw: DataFrame, year: int) -> DataFrame:
    return parse_pattern(raw, "syslog", SYSLOG, year)


def parse_python(raw: DataFrame) -> DataFrame:
    return parse_pattern(raw, "python", PYTHON)


def _last_of(entries: Column, key: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def pick_key(fields: Column, keys: Sequence[str]) -> Column:
    """The value of the first key that is there by its exact name, else of the first that is there in any case."""
    exact = F.coalesce(*[fields[k] for k in keys])
    wanted = F.filter(F.map_entries(fields), lambda e: F.lower(e["key"]).isin(list(keys)))
    folded = F.transform(wanted, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.coalesce(exact, bind(folded, lambda f: F.when(F.size(f) > 0, F.coalesce(*[_last_of(f, k) for k in keys]))))


def _by_keys(raw: DataFrame, starts: Column, year: int) -> DataFrame:
    """Metadata of rows with a map ``__f`` (null: not parsed)."""
    f = F.col("__f")
    keep = [c for c in raw.columns if c != "__f"]
    return _finished(raw, keep, f.isNotNull(), pick_key(f, TS_KEYS), pick_key(f, LEVEL_KEYS), pick_key(f, MESSAGE_KEYS), f, starts, starts, year)


def _number(x: float) -> str:
    """A JSON number as JavaScript prints it."""
    if x == 0:
        return "0"
    if x == math.floor(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exponent = f"{x!r}".partition("e")
    if not exponent:
        return digits
    e = int(exponent)
    if -7 < e < 0:
        sign, bare = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
        return f"{sign}0.{'0' * (-e - 1)}{bare.replace('.', '')}"
    return f"{digits.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def flatten_json(line: str) -> list[tuple[str, str]] | None:
    """The flat fields of a JSON object: ``a.b``, ``a[0]``, null as the empty string; None if the line isn't one. A
    repeated key keeps its last value; empty objects and arrays leave nothing."""
    line = line.strip(" \t\n\r\f\v ﻿")
    if not line.startswith("{"):
        return None
    try:
        top = json.loads(line, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    out: dict[str, str] = {}
    stack = [("", top)]
    while stack:
        at, x = stack.pop()
        if isinstance(x, dict):
            stack += [(f"{at}.{k}" if at else k, v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            stack += [(f"{at}[{i}]", v) for i, v in reversed(list(enumerate(x)))]
        elif x is None:
            if at:
                out[at] = ""
        else:
            out[at] = ("true" if x else "false") if isinstance(x, bool) else _number(float(x)) if isinstance(x, (int, float)) else x
    return list(out.items())


def parse_json(raw: DataFrame, keys: Sequence[str] | None = None, year: int = 1970) -> DataFrame:
    """One object a line. Without keys, every field by an Arrow-batched function; with keys (dotted paths), only those,
    by JVM expressions (JSON null and missing are then the same, and numbers print as they stand): a line is searched once
    for all keys of its object, and once for each path that leads on from one of them."""
    starts = F.ltrim("text").startswith("{")
    if keys is not None:
        wanted = list(dict.fromkeys([*keys, *TS_KEYS, *LEVEL_KEYS, *MESSAGE_KEYS]))
        tops = list(dict.fromkeys(k.split(".")[0] for k in wanted))
        ok = starts & F.try_parse_json(F.col("text")).isNotNull()
        found = raw.withColumn("__json", F.when(ok, F.col("text"))).select(*raw.columns, "__json", F.json_tuple("__json", *tops).alias(*[f"__k{i}" for i in range(len(tops))]))

        def value(k: str) -> Column:
            """A key of the object itself, or a path below one whose value is an object, which alone is searched."""
            top, _, below = k.partition(".")
            at = F.col(f"__k{tops.index(top)}")
            path = "$" + "".join(f"['{p}']" for p in k.split("."))
            return F.when(at.startswith("{"), F.get_json_object("__json", path)) if below else at

        pairs = F.array(*[F.struct(F.lit(k).alias("key"), value(k).alias("value")) for k in wanted])
        return _by_keys(_bound(found, raw.columns, __f=F.when(F.col("__json").isNotNull(), F.coalesce(bind(pairs, _map), F.create_map().cast(_FIELDS)))), starts, year)

    @F.arrow_udf(_FIELDS)
    def flat(lines: pa.Array) -> pa.Array:
        ends, keys, values = [], [], []
        for line in lines.to_pylist():
            got = flatten_json(line or "")
            ends.append(None if got is None else len(keys))
            for k, v in got or ():
                keys.append(k)
                values.append(v)
        offsets = pa.array([*ends, len(keys)], pa.int32())
        return pa.MapArray.from_arrays(offsets, pa.array(keys, pa.string()), pa.array(values, pa.string()))

    return _by_keys(raw.withColumn("__f", flat("text")), starts, year)


def parse_logfmt(raw: DataFrame, year: int = 1970) -> DataFrame:
    """All key=value and key="quoted \\" value" pairs of a line; the last of a repeated key counts."""
    found = F.regexp_extract_all("text", F.lit(rewrite(LOGFMT_PAIR).java), F.lit(0))

    def pair(w: Column) -> Column:
        """Key and value of one match; a quoted value is one from its first quote to its last."""
        key = F.substring_index(w, "=", 1)
        value = F.substr(w, F.length(key) + 2)
        quoted = w.endswith('"') & value.rlike(r'^"(?:[^"\\]|\\.)*"\z')
        bare = F.substr(value, F.lit(2), F.length(value) - 2)
        return F.struct(key.alias("key"), F.when(quoted, F.when(bare.contains("\\"), F.regexp_replace(bare, r"\\(.)", "$1")).otherwise(bare)).otherwise(value).alias("value"))

    rows = _bound(raw, raw.columns, __p=F.transform(found, pair))
    pairs, keys = F.col("__p"), F.col("__p.key")
    last = F.aggregate(pairs, F.create_map().cast(_FIELDS), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.map_from_arrays(F.array(p["key"]), F.array(p["value"]))))
    once = F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(pairs)).otherwise(last)
    rows = _bound(rows, raw.columns, __f=F.when(F.size(pairs) > 0, once))
    return _by_keys(rows, ~is_continuation(F.col("text")), year)


def parse_raw(raw: DataFrame) -> DataFrame:
    """Level and timestamp as far as a line shows them; the line is the message."""
    no, none = F.lit(False), F.lit(None).cast("string")
    return _finished(raw, raw.columns, no, none, none, none, F.lit(None).cast(_FIELDS), no, ~is_continuation(F.col("text")), 1970)


def _score_columns(patterns: Sequence[NamedPattern]) -> dict[str, Column]:
    """For each format, whether a line parses structurally (two fields or more for JSON and logfmt)."""
    c = F.col("text")
    out = {p.name: c.rlike(rewrite(p.pattern).java) for p in patterns}

    @F.pandas_udf("int")
    def json_fields(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: len(flatten_json(x or "") or ()))

    out["json"] = json_fields(c) >= 2
    out |= {name: c.rlike(rewrite(p).java) for name, p in TEXT_FORMATS.items()}
    out["logfmt"] = F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(rewrite(LOGFMT_PAIR).java), F.lit(1)))) >= 2
    return out


def detect_format(raw: DataFrame, patterns: Sequence[NamedPattern] = ()) -> DataFrame:
    """stream, format, score: of the first 100 lines of each stream (blank ones aside) the format that parses the largest
    share. User patterns win outright from 0.5 on; then built-in ones, ties to the earlier; else raw."""
    scores = _score_columns(patterns)
    head = raw.filter((F.col("line_no") < 100) & F.trim("text").rlike(r"\S"))
    shares = head.select("stream", *[c.cast("double").alias(n) for n, c in scores.items()]).groupBy("stream").agg(*[F.avg(n).alias(n) for n in scores])
    users = [p.name for p in patterns]

    def best(names: list[str]) -> Column:
        ranked = F.array(*[F.struct(F.col(n).alias("score"), F.lit(-i).alias("rank"), F.lit(n).alias("format")) for i, n in enumerate(names)])
        return F.filter(F.array(F.array_max(ranked)), lambda x: x["score"] >= 0.5)

    options = F.concat(*([best(users)] if users else []), best([n for n in scores if n not in users]))
    found = shares.withColumn("o", F.try_element_at(options, F.lit(1)))
    seen = found.select("stream", F.coalesce("o.format", F.lit("raw")).alias("format"), F.coalesce("o.score", F.lit(0.0)).alias("score"))
    return raw.select("stream").distinct().join(seen, "stream", "left").select("stream", F.coalesce("format", F.lit("raw")).alias("format"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _by_name(rows: DataFrame, name: str, patterns: Sequence[NamedPattern], year: int) -> DataFrame:
    users = {p.name: p.pattern for p in patterns}
    if name in users:
        return parse_pattern(rows, name, users[name], year)
    if name in TEXT_FORMATS:
        return parse_pattern(rows, name, TEXT_FORMATS[name], year)
    return {"json": lambda: parse_json(rows, year=year), "logfmt": lambda: parse_logfmt(rows, year), "raw": lambda: parse_raw(rows)}[name]()


def parse_logs(raw: DataFrame, format: str = "auto", patterns: Sequence[NamedPattern] = (), year: int = 1970) -> DataFrame:
    """raw with format and the parsed columns: by the named format, or by each stream's detected one. To detect, the lines
    are written to the shared folder once; detection and each format's parser read them there. Up to FEW_STREAMS streams are
    named in a filter, which skips other streams' parts of the files; more are joined. Lines of each format are parsed by it
    alone, so no line runs another's pattern."""
    if format != "auto":
        return _by_name(raw.withColumn("format", F.lit(format)), format, patterns, year)
    rows = staged(raw, "raw-lines")
    found = detect_format(rows, patterns).select("stream", "format")
    few = found.limit(FEW_STREAMS + 1).collect()
    columns = ["stream", *[c for c in rows.columns if c != "stream"]]
    if len(few) <= FEW_STREAMS:
        streams: dict[str, list[str]] = {}
        for r in few:
            if r["stream"] is not None:
                streams.setdefault(r["format"], []).append(r["stream"])
        of = lambda n: rows.filter(F.col("stream").isin(streams[n])).select(*columns, F.lit(n).alias("format"))
    else:
        found = staged(found, "formats")
        streams = {r["format"]: [] for r in found.select("format").distinct().collect()}  # at most one row for each known format
        of = lambda n: rows.join(found.filter(F.col("format") == n), "stream").select(*columns, "format")
    parts = [_by_name(of(n), n, patterns, year) for n in sorted(streams)]
    return reduce(DataFrame.unionByName, parts) if parts else parse_raw(rows.select(*columns, F.lit(None).cast("string").alias("format")))


def pattern_coverage(raw: DataFrame, patterns: Iterable[NamedPattern], samples: int = 5, year: int = 1970) -> DataFrame:
    """stream, pattern, matched, total, sample (the first line that matches) and samples: of the first ``samples`` lines that
    match, what the pattern would take out of them (line_no, ts, level, message, fields)."""
    patterns, total = list(patterns), F.col("total")
    each = F.array(*[F.struct(F.lit(p.name).alias("pattern"), F.col("text").rlike(rewrite(p.pattern).java).alias("hit")) for p in patterns])
    rows = raw.select("stream", "line_no", "text", F.explode(each).alias("p"))
    first = F.min(F.when(F.col("p.hit"), F.struct("line_no", "text")))
    got = rows.groupBy("stream", F.col("p.pattern").alias("pattern")).agg(F.count_if("p.hit").alias("matched"), F.count("*").alias("total"), first.alias("first"))
    hits = rows.filter("p.hit").withColumn("r", F.row_number().over(Window.partitionBy("stream", F.col("p.pattern")).orderBy("line_no"))).filter(F.col("r") <= samples)
    parsed = [parse_pattern(hits.filter(F.col("p.pattern") == p.name).select("stream", "line_no", "text"), p.name, p.pattern, year).withColumn("pattern", F.lit(p.name)) for p in patterns]
    taken = reduce(DataFrame.unionByName, parsed).groupBy("stream", "pattern").agg(F.array_sort(F.collect_list(F.struct("line_no", "ts", "level", "message", F.map_entries("fields").alias("fields")))).alias("samples"))
    return got.join(taken, ["stream", "pattern"], "left").select("stream", "pattern", "matched", total, F.col("first.text").alias("sample"), "samples")
