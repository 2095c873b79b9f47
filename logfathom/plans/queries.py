"""The registered queries of the log operators, each with the SQL that gives the same rows from the original columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.functions import predicates as P
from logfathom.functions.redaction import find_sensitive, mask, redact
from logfathom.functions.values import normalize_level, parse_timestamp, template_of, to_num
from logfathom.operators import aggregates as A
from logfathom.operators import diagnostics as D
from logfathom.operators import parsing as X
from logfathom.operators import patterns as T
from logfathom.operators import records as R
from logfathom.operators import timeline as M
from logfathom.operators import views as V
from logfathom.plans import rendering as L
from logfathom.sources import files as S
from logfathom.sources import index as I
from logfathom.streaming import tail as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EVENTS = """e AS (SELECT 's' || (event_id % 4) AS stream, event_id // 4 AS line_no, event_id, epoch_us(ts) // 1000 AS ms,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'INFO' WHEN 'click' THEN 'DEBUG' ELSE 'TRACE' END AS level,
  event_type AS event, user_id, 'u' || user_id AS usr, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value,
  event_type || ' k=' || CAST(json_extract(props, '$.k') AS BIGINT) || ' by u' || user_id AS text FROM events)"""
LINES = """d0 AS (SELECT CAST(doc_id AS VARCHAR) AS stream, doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
d AS (SELECT stream, doc_id, line_no, regexp_replace(t, '\\r$', '') AS text FROM d0)"""
#: Heads and records of document lines.
RECORDS = LINES + r""",
h AS (SELECT *, max(CASE WHEN line_no = 0 OR NOT regexp_matches(text, '^($|\s|Caused by:|\.{3}\s*\d+\s+more\b|at\s)') THEN line_no END) OVER (PARTITION BY stream ORDER BY line_no) AS head FROM d)"""
#: The template of a head line: digits and long hexadecimal tokens masked, runs merged.
TEMPLATES = RECORDS + r""",
tk AS (SELECT stream, line_no, list_transform(list_filter(regexp_split_to_array(substr(text, 1, 4096), '\s+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '\d') OR regexp_matches(x, '^(?i)[0-9a-f]{12,}$') THEN '<*>' ELSE x END) AS m FROM h WHERE head = line_no),
tm AS (SELECT stream, line_no, list_filter(m, lambda x, i: NOT (x = '<*>' AND i > 1 AND m[i - 1] = '<*>')) AS m FROM tk),
t AS (SELECT stream, line_no, CASE WHEN len(m) > 80 THEN array_to_string(m[1:80], ' ') || ' …' ELSE array_to_string(m, ' ') END AS pattern FROM tm)"""
LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "NONE"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _ms(c: str = "ts"):
    return F.unix_millis(c)


def _hist_sql(width: str, floor: bool = True, source: str = "e") -> str:
    sums = ", ".join(f"CAST(count(*) FILTER (WHERE level {'IS NULL' if x == 'NONE' else f'= {x!r}'}) AS BIGINT) AS {x}" for x in LEVELS)
    return f"""b AS (SELECT min(ms) AS lo, {width} AS w FROM {source}),
hist AS (SELECT (ms - lo) // w AS bucket, lo + (ms - lo) // w * w AS start_ms, w AS bucket_ms, {sums}, count(*) AS total FROM {source}, b GROUP BY ALL)"""


FLOOR_100 = "CAST(greatest(greatest(max(ms) - min(ms), 1) // 100 + 1, 1) AS BIGINT)"
CEIL_100 = "CAST(greatest(ceil(greatest(max(ms) - min(ms), 1) / 100.0), 1) AS BIGINT)"


# ---------------------------------------------------------------- sources and sinks


def _whole(lines: DataFrame) -> DataFrame:
    """The text of all lines, and how many numbers their stream leaves out."""
    holes = lines.groupBy("stream").agg((F.max("line_no") + 1 - F.count_distinct("line_no")).alias("holes"))
    return lines.join(holes, "stream").select("text", "holes")


_WHOLE = f"WITH {EVENTS} SELECT text, CAST(0 AS BIGINT) AS holes FROM e"


@query("s01_read_lines", _WHOLE)
def read_lines(spark, sf):
    path = S.scratch(spark, "logs")
    L.typed_lines(spark, sf).select("text").write.text(path)
    return _whole(S.read_lines(spark, path))


@query("s02_line_numbers", "SELECT event_type AS stream, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS line_no, CAST(event_id AS VARCHAR) AS text FROM events")
def line_numbers(spark, sf):
    return S.from_table(L.table(spark, sf, "events").withColumn("text", F.col("event_id").cast("string")), "text", ["ts", "event_id"], ["event_type"])


def _rotate(spark, folder: str, to: str) -> None:
    """The part files of a folder under the names and times that a rotated app.log has, the first part the oldest."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((s.getPath() for s in files.listStatus(path(folder)) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    files.mkdirs(path(to))
    for i, part in enumerate(parts):
        older, packed = len(parts) - 1 - i, ".gz" if part.getName().endswith(".gz") else ""
        name = path(f"{to}/app.log" + (f".{older}" if older else "") + packed)
        files.rename(part, name)
        files.setTimes(name, 1_700_000_000_000 + 60_000 * i, -1)


@query("s03_rotation_group", f"WITH {EVENTS} SELECT 'app.log' AS stream, row_number() OVER (ORDER BY event_id) - 1 AS line_no, text FROM e")
def rotation_group(spark, sf):
    base, e = S.scratch(spark, "rotated"), L.events(spark, sf)
    text = e.select("event_id", F.format_string("%s k=%s by %s", e.event, e.k, e.user).alias("text"))
    text.repartitionByRange("event_id").sortWithinPartitions("event_id").select("text").write.option("compression", "gzip").text(f"{base}/parts")
    _rotate(spark, f"{base}/parts", f"{base}/logs")
    return S.read_rotation_group(spark, f"{base}/logs").withColumn("stream", F.regexp_extract("stream", r"[^/]+\z", 0))


@query("s04_gzip_lines", _WHOLE)
def gzip_lines(spark, sf):
    path = S.scratch(spark, "gz")
    L.typed_lines(spark, sf).select("text").write.option("compression", "gzip").text(path)
    return _whole(S.read_lines(spark, path))


@query("s04_gzip_by_content", _WHOLE)
def gzip_by_content(spark, sf):
    """gzip files under names that no codec knows."""
    base = S.scratch(spark, "gz")
    L.typed_lines(spark, sf).select("text").write.option("compression", "gzip").text(f"{base}/parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{base}/logs"))
    for i, one in enumerate(files.listStatus(path(f"{base}/parts"))):
        if one.getPath().getName().startswith("part-"):
            files.rename(one.getPath(), path(f"{base}/logs/app{i}.gzip"))
    return _whole(S.read_packed_lines(spark, f"{base}/logs"))


@query("s05_from_table", "SELECT lang AS stream, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS line_no, md5(text) AS text FROM documents")
def from_table(spark, sf):
    got = S.from_table(L.table(spark, sf, "documents"), "text", ["doc_id"], ["lang"])
    return got.withColumn("text", F.md5("text"))


@query("s06_from_columns", f"WITH {EVENTS} SELECT stream, line_no, ms, level, event, usr AS \"user\", CAST(k AS VARCHAR) AS k FROM e")
def from_columns(spark, sf):
    return L.typed_lines(spark, sf).select("stream", "line_no", _ms().alias("ms"), "level", *[F.col("fields")[c].alias(c) for c in ("event", "user", "k")])


_EXPORT = f"WITH {EVENTS} SELECT CAST(line_no + 1 AS BIGINT) AS line, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp, level, text AS content FROM e"


@query("s07_write_csv", _EXPORT)
def write_csv(spark, sf):
    S.write_csv(L.typed_lines(spark, sf), path := S.scratch(spark, "csv"))
    return spark.read.schema("line long, timestamp string, level string, content string").csv(path, header=True, quote='"', escape='"')


@query("s08_write_json", _EXPORT)
def write_json(spark, sf):
    S.write_json(L.typed_lines(spark, sf), path := S.scratch(spark, "json"))
    return spark.read.schema("line long, timestamp string, level string, content string").json(path)


@query("s09_ingest_incremental", f"WITH {EVENTS} SELECT text, CASE WHEN stream IN ('s0', 's1') THEN 1 ELSE 2 END AS round FROM e")
def ingest(spark, sf):
    """Two rounds: the lines of the first come from the generation that the first call parsed."""
    logs, store = S.scratch(spark, "incoming"), S.scratch(spark, "store")
    text = L.typed_lines(spark, sf).select("stream", "text")
    for part in (["s0", "s1"], ["s2", "s3"]):
        text.filter(F.col("stream").isin(part)).select("text").write.mode("append").text(logs)
        got = S.ingest_incremental(spark, f"{logs}/part-*", store, X.parse_raw, "raw")
        if part[0] == "s0":
            first = got.select("generation").first()[0]
    return got.select("text", F.when(F.col("generation") == first, 1).otherwise(2).alias("round"))


# ---------------------------------------------------------------- parsing


def _parsed(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select("line_no", _ms().alias("ms"), "level", "message", *[F.col("fields")[c].alias(c.replace(".", "_").replace("[", "_").replace("]", "")) for c in fields], "starts_record")


@query("p01_parse_json", f"WITH {EVENTS} SELECT event_id AS line_no, ms, level, CAST(NULL AS VARCHAR) AS message, event, CAST(user_id AS VARCHAR) AS user_id, usr AS user_name, CAST(k AS VARCHAR) AS props_k, 'a' AS tags_0, event AS tags_1, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS value, true AS starts_record FROM e")
def parse_json(spark, sf):
    return _parsed(X.parse_json(L.json_log(spark, sf)), ["event", "user.id", "user.name", "props.k", "tags[0]", "tags[1]", "value"])


@query("p01_parse_json_keys", f"WITH {EVENTS} SELECT event_id AS line_no, ms, level, CAST(NULL AS VARCHAR) AS message, event, CAST(user_id AS VARCHAR) AS user_id, CAST(k AS VARCHAR) AS props_k, true AS starts_record FROM e")
def parse_json_keys(spark, sf):
    keys = ["event", "user.id", "props.k"]
    return _parsed(X.parse_json(L.json_log(spark, sf), keys), keys)


@query("p02_parse_timestamped", f"WITH {EVENTS} SELECT event_id AS line_no, ms, level, event || ' k=' || k || ' took ' || value || 'ms' AS message, 'user.' || usr AS logger, true AS starts_record FROM e")
def parse_timestamped(spark, sf):
    return _parsed(X.parse_timestamped(L.app_log(spark, sf)), ["logger"])


@query("p03_parse_bracketed", f"WITH {EVENTS} SELECT event_id AS line_no, ms, level, event || ' by ' || usr AS message, true AS starts_record FROM e")
def parse_bracketed(spark, sf):
    return _parsed(X.parse_bracketed(L.bracketed_log(spark, sf)), [])


@query("p04_parse_access", f"""WITH {EVENTS} SELECT event_id AS line_no, ms // 1000 * 1000 AS ms, CAST(NULL AS VARCHAR) AS level, CAST(NULL AS VARCHAR) AS message, '10.0.0.1' AS ip, usr AS "user", 'GET' AS method,
 '/' || event || '/' || k AS path, CASE WHEN user_id % 3 <> 0 THEN 'HTTP/1.1' END AS protocol, CASE WHEN event = 'error' THEN '500' ELSE '200' END AS status, CAST(k AS VARCHAR) AS bytes,
 CASE WHEN user_id % 2 = 0 THEN 'http://ref/' || k END AS referer, CASE WHEN user_id % 2 = 0 THEN 'agent ' || usr END AS agent, true AS starts_record FROM e""")
def parse_access(spark, sf):
    return _parsed(X.parse_access(L.access_log(spark, sf)), ["ip", "user", "method", "path", "protocol", "status", "bytes", "referer", "agent"])


@query("p05_parse_syslog", f"""WITH {EVENTS} SELECT event_id AS line_no, ms // 1000 * 1000 AS ms, CAST(NULL AS VARCHAR) AS level, 'k is ' || k AS message, 'host' || (user_id % 5) AS host, event || 'd' AS proc,
 CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS pid, true AS starts_record FROM e""")
def parse_syslog(spark, sf):
    return _parsed(X.parse_syslog(L.syslog(spark, sf), L.YEAR), ["host", "proc", "pid"])


@query("p06_parse_python", f"WITH {EVENTS} SELECT event_id AS line_no, CAST(NULL AS BIGINT) AS ms, level, 'took ' || value AS message, 'app.' || event AS logger, true AS starts_record FROM e")
def parse_python(spark, sf):
    return _parsed(X.parse_python(L.python_log(spark, sf)), ["logger"])


@query("p07_parse_logfmt", f"WITH {EVENTS} SELECT event_id AS line_no, ms, level, event || ' of \"' || usr || '\"' AS message, CAST(k AS VARCHAR) AS k, CAST(value AS VARCHAR) AS value, true AS starts_record FROM e")
def parse_logfmt(spark, sf):
    return _parsed(X.parse_logfmt(L.logfmt_log(spark, sf)), ["k", "value"])


@query("p08_parse_raw", f"WITH {EVENTS} SELECT event_id AS line_no, ms, level, true AS is_message, true AS starts_record FROM e")
def parse_raw(spark, sf):
    return X.parse_raw(L.json_log(spark, sf)).select("line_no", _ms().alias("ms"), "level", (F.col("message") == F.col("text")).alias("is_message"), "starts_record")


_PATTERN = r"^(?<event_type>\w+) k=(?<k>\d+) by (?<user>u\d+)(?<rest> .*)?$"


@query("p09_parse_pattern", f"WITH {EVENTS} SELECT stream, line_no, event AS event_type, CAST(k AS VARCHAR) AS k, usr AS \"user\", CAST(NULL AS VARCHAR) AS rest FROM e")
def parse_pattern(spark, sf):
    got = X.parse_pattern(L.typed_lines(spark, sf).select("stream", "line_no", "text"), "own", _PATTERN)
    return got.select("stream", "line_no", *[F.col("fields")[c].alias(c) for c in ("event_type", "k", "user", "rest")])


@query("p10_pattern_coverage", f"""WITH {EVENTS}, p AS (SELECT * FROM (VALUES ('errors', 'error'), ('clicks', 'click')) v(pattern, ev))
SELECT stream, pattern, count(*) FILTER (WHERE event = ev) AS matched, count(*) AS total, min_by(text, CASE WHEN event = ev THEN line_no END) AS sample,
 array_to_string((list(line_no || ' k=' || k ORDER BY line_no) FILTER (WHERE event = ev))[1:5], ', ') AS samples FROM e, p GROUP BY ALL""")
def pattern_coverage(spark, sf):
    wanted = [X.NamedPattern("errors", r"^error k=(?<k>\d+)"), X.NamedPattern("clicks", r"^click k=(?<k>\d+)")]
    got = X.pattern_coverage(L.typed_lines(spark, sf).select("stream", "line_no", "text"), wanted)
    shown = F.transform("samples", lambda x: F.concat(x["line_no"], F.lit(" "), F.array_join(F.transform(x["fields"], lambda f: F.concat(f["key"], F.lit("="), f["value"])), " ")))
    return got.withColumn("samples", F.array_join(shown, ", "))


def _many_formats(spark, sf) -> DataFrame:
    logs = {"app": L.app_log, "bracketed": L.bracketed_log, "access": L.access_log, "syslog": L.syslog, "python": L.python_log, "json": L.json_log, "logfmt": L.logfmt_log}
    out = None
    for name, log in logs.items():
        rows = log(spark, sf).withColumn("stream", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("p11_parse_logs", f"""WITH {EVENTS}, f AS (SELECT * FROM (VALUES ('app','timestamped'), ('bracketed','bracketed'), ('access','access'), ('syslog','syslog'), ('python','python'), ('json','json'), ('logfmt','logfmt')) v(stream, format))
SELECT f.stream, format, event_id AS line_no, CASE WHEN f.stream IN ('access', 'syslog') THEN NULL ELSE level END AS level, CASE WHEN f.stream = 'python' THEN NULL WHEN f.stream IN ('access', 'syslog') THEN ms // 1000 * 1000 ELSE ms END AS ms FROM e, f""")
def parse_logs(spark, sf):
    return X.parse_logs(_many_formats(spark, sf), year=L.YEAR).select("stream", "format", "line_no", "level", _ms().alias("ms"))


@query("p12_detect_format", "SELECT * FROM (VALUES ('app','timestamped',1.0::DOUBLE), ('bracketed','bracketed',1.0), ('access','access',1.0), ('syslog','syslog',1.0), ('python','python',1.0), ('json','json',1.0), ('logfmt','logfmt',1.0)) v(stream, format, score)")
def detect_format(spark, sf):
    return X.detect_format(_many_formats(spark, sf))


_SPELLED = [
    ("trc", "TRACE"), ("Verbose", "TRACE"), ("FINEST", "TRACE"), ("dbg", "DEBUG"), (" fine ", "DEBUG"), ("info", "INFO"), ("Informational", "INFO"), ("notice", "INFO"), ("wrn", "WARN"), ("WARNING", "WARN"),
    ("err", "ERROR"), ("Severe", "ERROR"), ("failure", "ERROR"), ("crit", "FATAL"), ("emerg", "FATAL"), ("panic", "FATAL"), ("Alert", "FATAL"), ("warned", None), ("", None), ("E", None), (None, None),
]
_QUOTED = lambda x: "NULL" if x is None else f"'{x}'"


@query("p13_normalize_level", f"SELECT event_id, spelled, level FROM events JOIN (VALUES {', '.join(f'({i}, {_QUOTED(a)}, {_QUOTED(b)})' for i, (a, b) in enumerate(_SPELLED))}) v(i, spelled, level) ON event_id % {len(_SPELLED)} = i")
def levels(spark, sf):
    spelled = F.array(*[F.lit(a) for a, _ in _SPELLED])[(F.col("event_id") % len(_SPELLED)).cast("int")]
    return L.table(spark, sf, "events").select("event_id", spelled.alias("spelled"), normalize_level(spelled).alias("level"))


@query("p14_parse_timestamp", f"WITH {EVENTS} SELECT event_id, ms AS iso, ms AS zoned, ms // 1000 * 1000 AS clf, ms // 1000 * 1000 AS seconds, ms AS millis, ms // 1000 * 1000 AS syslog FROM e")
def timestamps(spark, sf):
    e = L.events(spark, sf)
    at = lambda c: F.unix_millis(parse_timestamp(c, L.YEAR))
    ahead = F.timestamp_millis(_ms() + 5400000)
    return e.select(
        "event_id", at(F.date_format("ts", "yyyy/MM/dd'T'HH:mm:ss,SSS")).alias("iso"), at(F.concat(F.date_format(ahead, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+01:30"))).alias("zoned"),
        at(F.concat(F.date_format(ahead, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0130"))).alias("clf"), at(F.floor(_ms() / 1000).cast("string")).alias("seconds"), at(_ms().cast("string")).alias("millis"), at(F.date_format("ts", "MMM d HH:mm:ss")).alias("syslog"),
    )


@query("p15_is_continuation", RECORDS.join(["WITH ", " SELECT stream, count(*) FILTER (WHERE head <> line_no) AS continuations, count(*) AS n FROM h GROUP BY ALL"]))
def continuations(spark, sf):
    return L.document_lines(spark, sf).groupBy("stream").agg(F.count_if(~F.col("is_head")).alias("continuations"), F.count("*").alias("n"))


@query("p16_to_num", """SELECT event_id, CASE event_id % 9 WHEN 0 THEN value WHEN 1 THEN -value WHEN 2 THEN CAST(value || 'e2' AS DOUBLE) WHEN 3 THEN CAST(user_id AS DOUBLE) WHEN 4 THEN CAST(user_id || 'E-3' AS DOUBLE) END AS num FROM events""")
def numbers(spark, sf):
    e = L.events(spark, sf)
    forms = [e.value, F.concat(F.lit("-"), e.value), F.concat(e.value, F.lit("e2")), F.col("user_id").cast("string"), F.concat(F.col("user_id"), F.lit("E-3")), F.concat(F.lit(" "), e.value), F.concat(e.value, F.lit("ms")), F.concat(F.lit("+"), e.value), F.lit("NaN")]
    return e.select("event_id", to_num(F.array(*forms)[(F.col("event_id") % len(forms)).cast("int")]).alias("num"))


# ---------------------------------------------------------------- records


@query("r01_assign_records", f"WITH {RECORDS} SELECT stream, line_no, head, head = line_no AS is_head FROM h")
def assign_records(spark, sf):
    return L.document_lines(spark, sf).select("stream", "line_no", "head", "is_head")


@query("r02_records", f"WITH {RECORDS} SELECT stream, head, CAST(count(*) AS INTEGER) AS span, md5(string_agg(text, chr(10) ORDER BY line_no)) AS text FROM h GROUP BY stream, head")
def records(spark, sf):
    return R.records(L.document_lines(spark, sf)).select("stream", "head", "span", F.md5("text").alias("text"))


_LEVEL_OF_LINE = r"""CASE upper(regexp_extract(h.text, '(?i)\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|ERR|FATAL|CRITICAL|SEVERE|NOTICE)\b', 1)) WHEN 'TRACE' THEN 'TRACE' WHEN 'DEBUG' THEN 'DEBUG' WHEN 'INFO' THEN 'INFO' WHEN 'NOTICE' THEN 'INFO'
  WHEN 'WARN' THEN 'WARN' WHEN 'WARNING' THEN 'WARN' WHEN 'ERROR' THEN 'ERROR' WHEN 'ERR' THEN 'ERROR' WHEN 'SEVERE' THEN 'ERROR' WHEN 'FATAL' THEN 'FATAL' WHEN 'CRITICAL' THEN 'FATAL' END"""


@query("r03_record_detail", f"""WITH {RECORDS}, rec AS (SELECT stream, head, count(*) AS span, string_agg(text, chr(10) ORDER BY line_no) AS record FROM h GROUP BY ALL)
SELECT h.stream, h.line_no, {_LEVEL_OF_LINE} AS level, CAST(NULL AS BIGINT) AS n_fields, h.text AS raw, CASE WHEN h.head = h.line_no AND span > 1 THEN record END AS record FROM h JOIN rec USING (stream, head) WHERE h.line_no IN (0, 2)""")
def record_detail(spark, sf):
    lines = L.document_lines(spark, sf)
    return R.record_detail(lines, lines.filter(F.col("line_no").isin(0, 2))).select("stream", "line_no", "level", F.when(F.col("fields").isNotNull(), F.size("fields")).cast("long").alias("n_fields"), "raw", "record")


@query("r04_grouped", f"WITH {RECORDS} SELECT stream, head, CAST(count(*) AS INTEGER) AS span FROM h GROUP BY ALL HAVING bool_or(regexp_matches(text, '(?i)license'))")
def grouped(spark, sf):
    return R.grouped(L.document_lines(spark, sf), P.line_regex("LICENSE")).select("stream", "head", "span")


# ---------------------------------------------------------------- predicates


def _pred(name: str, pred, where: str, log=None) -> None:
    """A query that keeps the matching lines of the typed log."""

    def run(spark, sf):
        return (log or L.typed_lines)(spark, sf).filter(pred()).select("stream", "line_no")

    query(name, f"WITH {EVENTS} SELECT stream, line_no FROM e WHERE {where}")(run)


def _doc_pred(name: str, pred, where: str) -> None:
    def run(spark, sf):
        return L.table(spark, sf, "documents").filter(pred()).select("doc_id")

    query(name, f"SELECT doc_id FROM documents WHERE {where}")(run)


_DUR = P.Capture("k", r"k=(?<k>\d+)")
_pred("f01_match_all", P.match_all, "true")
_pred("f02_boolean", lambda: P.any_of(P.all_of(P.field_eq("event", "click"), P.field_cmp("k", "lt", 10)), P.negate(P.level_cmp("lte", "TRACE"))), "(event = 'click' AND k < 10) OR NOT (level <= 'TRACE')")
_doc_pred("f03_term", lambda: P.term("Licens"), "regexp_matches(strip_accents(lower(text)), '(^|[^\\p{L}\\p{N}])licens')")
_doc_pred("f04_phrase", lambda: P.phrase("apache license"), "regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])apache[^\\p{L}\\p{N}]+license($|[^\\p{L}\\p{N}])')")


def _indexed(spark, sf) -> str:
    """The typed lines as log files by range of event_id, in an incremental table with its index."""
    logs, store = S.scratch(spark, "incoming"), S.scratch(spark, "store")
    e = L.events(spark, sf)
    text = e.select("event_id", F.format_string("%s k=%s by %s", e.event, e.k, e.user).alias("text"))
    text.repartitionByRange(64, "event_id").select("text").write.text(logs)
    S.ingest_incremental(spark, f"{logs}/part-*", store, lambda raw: raw, "none", index=True)
    return store


@query("f03_term_indexed", f"WITH {EVENTS} SELECT text FROM e WHERE usr LIKE 'u12%'")
def term_indexed(spark, sf):
    return I.indexed_search(spark, _indexed(spark, sf), "by U12").select("text")


@query("f04_phrase_indexed", f"WITH {EVENTS} SELECT text FROM e WHERE usr = 'u7'")
def phrase_indexed(spark, sf):
    return I.indexed_search(spark, _indexed(spark, sf), "by u7", whole=True).select("text")

_pred("f05_field_eq", lambda: P.field_eq("event", "ERROR"), "event = 'error'")
_pred("f06_field_cmp_number", lambda: P.field_cmp("duration_ms", "gte", 20.5), "value >= 20.5")
_pred("f07_field_cmp_text", lambda: P.field_cmp("event", "gt", "ERROR"), "event > 'error'")
_pred("f08_level_cmp", lambda: P.level_cmp("gte", "warning"), "level >= 'WARN'")
_pred("f09_ts_cmp", lambda: P.ts_cmp("gte", "2024-01-10T12:00Z") & P.ts_cmp("lte", "2024-01-20") & ~P.ts_cmp("eq", "2024-01-15"), "ms >= epoch_ms(TIMESTAMP '2024-01-10 12:00:00') AND ms < epoch_ms(TIMESTAMP '2024-01-21') AND NOT (ms >= epoch_ms(TIMESTAMP '2024-01-15') AND ms < epoch_ms(TIMESTAMP '2024-01-16'))")
_pred("f10_field_like", lambda: P.field_like("user", "U1*5"), "usr LIKE 'u1%5'")
_pred("f11_field_exists", lambda: P.field_exists("k") & P.field_exists("timestamp") & ~P.field_exists("nothing"), "true")
_pred("f12_field_regex", lambda: P.field_regex("user", r"U[12]\b|9$"), "regexp_matches(usr, '^u[12]$|9$')")
_pred("f13_line_regex", lambda: P.line_regex(r"K=\d\sBY"), "k < 10")
_pred("f14_capture", lambda: P.capture("k", r"k=(?<k>\d+)") == "7", "k = 7")
_pred("f15_capture_predicates", lambda: P.capture_cmp(_DUR, "gt", 50) & (P.capture_like(_DUR, "9*") | P.capture_regex(_DUR, "^[67]")) & P.capture_exists(_DUR) & ~P.capture_eq(_DUR, "66"), "k > 50 AND (CAST(k AS VARCHAR) LIKE '9%' OR regexp_matches(CAST(k AS VARCHAR), '^[67]')) AND k <> 66")
_pred("f16_in_template", lambda: P.in_template("error <*> by <*>"), "event = 'error'")

# ---------------------------------------------------------------- views


@query("v01_search", f"WITH {EVENTS} SELECT stream, line_no, ms, text FROM e WHERE level = 'ERROR' AND k > 90")
def search(spark, sf):
    return V.search(L.typed_lines(spark, sf), P.level_cmp("eq", "err") & P.field_cmp("k", "gt", 90)).select("stream", "line_no", _ms().alias("ms"), "text")


@query("v02_mark_matches", f"WITH {EVENTS} SELECT stream, line_no, k > 90 AS match FROM e")
def mark_matches(spark, sf):
    return V.mark_matches(L.typed_lines(spark, sf), P.field_cmp("k", "gt", 90)).select("stream", "line_no", "match")


@query("v03_page", f"WITH {EVENTS} SELECT stream, line_no, text, false AS truncated FROM e ORDER BY stream DESC, line_no DESC LIMIT 100 OFFSET 300")
def page(spark, sf):
    return V.page(L.typed_lines(spark, sf), 300, 100, newest_first=True).select("stream", "line_no", "text", "truncated")


@query("v03_result_page", f"WITH {EVENTS} SELECT stream, line_no, text, false AS truncated FROM e ORDER BY stream DESC, line_no DESC LIMIT 100 OFFSET (SELECT count(*) // 2 FROM events)")
def result_page(spark, sf):
    """A page from the middle of a materialized result."""
    result = V.materialize(L.typed_lines(spark, sf).select("stream", "line_no", "text"))
    return V.result_page(result, result.total // 2, 100, newest_first=True).select("stream", "line_no", "text", "truncated")


@query("v04_table", f"WITH {EVENTS} SELECT stream, line_no, ms, level, event, CAST(NULL AS VARCHAR) AS missing FROM e")
def fields_table(spark, sf):
    return V.table(L.typed_lines(spark, sf), ["event", "missing"]).select("stream", "line_no", _ms().alias("ms"), "level", "event", "missing")


@query("v05_line_range", f"WITH {EVENTS} SELECT stream, line_no, text FROM e WHERE line_no BETWEEN 40 AND 59")
def line_range(spark, sf):
    return V.line_range(L.typed_lines(spark, sf), 40, 20)


@query("v06_context", f"""WITH {EVENTS}, hit AS (SELECT stream, line_no FROM e WHERE k = 7)
SELECT e.stream, e.line_no, max(CASE WHEN e.line_no = hit.line_no THEN 1 ELSE 0 END) = 1 AS match FROM e JOIN hit ON e.stream = hit.stream AND e.line_no BETWEEN hit.line_no - 2 AND hit.line_no + 3 GROUP BY ALL""")
def context(spark, sf):
    return V.context(L.typed_lines(spark, sf), P.field_eq("k", "7"), 2, 3).select("stream", "line_no", "match")


@query("v07_adjacent_hits", f"""WITH {EVENTS}, m AS (SELECT stream, line_no, CASE WHEN k = 7 THEN line_no END AS hit FROM e)
SELECT stream, line_no, coalesce(min(hit) OVER (PARTITION BY stream ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(hit) OVER (PARTITION BY stream)) AS next_hit,
 coalesce(max(hit) OVER (PARTITION BY stream ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), max(hit) OVER (PARTITION BY stream)) AS prev_hit FROM m""")
def adjacent(spark, sf):
    return V.adjacent_hits(L.typed_lines(spark, sf), P.field_eq("k", "7")).select("stream", "line_no", "next_hit", "prev_hit")


@query("v08_count_matches", f"WITH {EVENTS} SELECT count(*) AS n FROM e WHERE level = 'WARN'")
def count_matches(spark, sf):
    return V.count_matches(L.typed_lines(spark, sf), P.level_cmp("eq", "WARN"))


@query("v09_funnel", f"WITH {EVENTS}, c AS (SELECT count(*) a, count(*) FILTER (WHERE level = 'ERROR') b, count(*) FILTER (WHERE level = 'ERROR' AND k > 50) c, count(*) FILTER (WHERE level = 'ERROR' AND k > 50 AND usr LIKE 'u1%') d FROM e) SELECT 0 AS step, a AS n FROM c UNION ALL SELECT 1, b FROM c UNION ALL SELECT 2, c FROM c UNION ALL SELECT 3, d FROM c")
def funnel(spark, sf):
    return V.funnel(L.typed_lines(spark, sf), [P.level_cmp("eq", "ERROR"), P.field_cmp("k", "gt", 50), P.field_like("user", "u1*")])


@query("v10_delta", f"""WITH {EVENTS}, x AS (SELECT stream, line_no, ms - lag(ms) OVER (PARTITION BY stream ORDER BY line_no) AS delta_ms FROM e WHERE level = 'ERROR')
SELECT *, CASE WHEN delta_ms >= 60000 THEN '60s' WHEN delta_ms >= 5000 THEN '5s' WHEN delta_ms >= 1000 THEN '1s' END AS band FROM x""")
def delta(spark, sf):
    return V.delta(L.typed_lines(spark, sf).filter(P.level_cmp("eq", "ERROR"))).select("stream", "line_no", "delta_ms", "band")


@query("v11_evidence", f"""WITH {EVENTS}, r AS (SELECT 'sec' || (event_id % 3) AS section, event_id AS position, 's' || (event_id % 4) AS stream, event_id // 4 AS a, event_id // 4 + 2 AS b FROM events),
u AS (SELECT section, position, stream, unnest(range(a, b + 1)) AS line_no FROM r), c AS (SELECT section, stream, line_no, min(position) AS position FROM u JOIN e USING (stream, line_no) GROUP BY ALL)
SELECT section, position, stream, line_no, level, text FROM c JOIN e USING (stream, line_no) ORDER BY section, position, stream, line_no LIMIT 1000""")
def evidence(spark, sf):
    e = L.events(spark, sf)
    refs = e.select(F.concat(F.lit("sec"), e.event_id % 3).alias("section"), e.event_id.alias("position"), F.concat(F.lit("s"), e.event_id % 4).alias("stream"), F.floor(e.event_id / 4).alias("start"), (F.floor(e.event_id / 4) + 2).alias("end"))
    return V.evidence(L.typed_lines(spark, sf), refs).select("section", "position", "stream", "line_no", "level", "text")


@query("v12_annotate", f"WITH {EVENTS} SELECT stream, line_no, text, 'see ' || event AS note FROM e WHERE k = 42")
def annotate(spark, sf):
    lines = L.typed_lines(spark, sf)
    notes = lines.filter(P.field_eq("k", "42")).select("stream", "line_no", F.concat(F.lit("see "), F.col("fields")["event"]).alias("note"))
    return V.annotate(lines, notes).select("stream", "line_no", "text", "note")


# ---------------------------------------------------------------- aggregates


@query("a01_level_counts", f"WITH {EVENTS} SELECT level, count(*) AS n FROM e GROUP BY level")
def level_counts(spark, sf):
    return A.level_counts(L.typed_lines(spark, sf))


@query("a02_stats", f"WITH {EVENTS} SELECT count(*) AS total, count(ms) AS with_ts, min(ms) AS min_ms, max(ms) AS max_ms, (SELECT string_agg(level || '=' || n, ',' ORDER BY n DESC, level) FROM (SELECT level, count(*) AS n FROM e GROUP BY level)) AS levels FROM e")
def stats(spark, sf):
    return A.stats(L.typed_lines(spark, sf)).select("total", "with_ts", _ms("min_ts").alias("min_ms"), _ms("max_ts").alias("max_ms"), F.array_join(F.transform("levels", lambda x: F.concat(x["level"], F.lit("="), x["n"])), ",").alias("levels"))


@query("a03_peak_per_min", f"WITH {EVENTS}, {_hist_sql(FLOOR_100)} SELECT CAST(floor(max(total / bucket_ms * 60000) + 0.5) AS BIGINT) AS peak_per_min FROM hist")
def peak(spark, sf):
    return A.peak_per_min(L.typed_lines(spark, sf))


@query("a04_field_catalog", "SELECT key, (SELECT count(*) FROM events) AS n FROM (VALUES ('event'), ('user'), ('k'), ('duration_ms')) v(key)")
def field_catalog(spark, sf):
    return A.field_catalog(L.typed_lines(spark, sf))


_LONG = EVENTS + """, f AS (SELECT level, 'event' AS key, event AS value FROM e UNION ALL SELECT level, 'user', usr FROM e UNION ALL SELECT level, 'k', CAST(k AS VARCHAR) FROM e UNION ALL SELECT level, 'duration_ms', CAST(value AS VARCHAR) FROM e)"""


@query("a05_top_fields_summary", f"""WITH {_LONG}, c AS (SELECT key, value, count(*) AS n FROM f WHERE level = 'ERROR' GROUP BY ALL), w AS (SELECT key, count(*) AS distinct_, CAST(sum(n) AS BIGINT) AS covered FROM c GROUP BY key),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS rank FROM c) SELECT key, rank, value, n, distinct_ AS "distinct", covered FROM r JOIN w USING (key) WHERE rank <= 4""")
def top_fields(spark, sf):
    got = A.top_fields_summary(L.typed_lines(spark, sf), P.level_cmp("eq", "ERROR"))
    return got.withColumn("rank", F.col("rank").cast("long"))


@query("a06_facet", f"WITH {EVENTS}, c AS (SELECT usr AS value, count(*) AS n FROM e GROUP BY ALL) SELECT value, n, (SELECT count(*) FROM c) AS distinct_count, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS covered, CAST(0 AS BIGINT) AS numeric_count FROM c ORDER BY n DESC, value LIMIT 25")
def facet(spark, sf):
    return A.facet(L.typed_lines(spark, sf), "user")


@query("a07_time_histogram", f"WITH {EVENTS}, {_hist_sql(FLOOR_100)} SELECT * FROM hist")
def time_histogram(spark, sf):
    parsed = X.parse_timestamped(L.app_log(spark, sf))
    return A.time_histogram(parsed, 100)


@query("a08_numeric_facet", f"""WITH {EVENTS}, n AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS c FROM e), w AS (SELECT count(*) AS count, min(v) AS min, max(v) AS max, (max(v) - min(v)) / 24 AS width, max(CASE WHEN r = floor(0.5 * (c - 1) + 0.5) THEN v END) AS p50, max(CASE WHEN r = floor(0.95 * (c - 1) + 0.5) THEN v END) AS p95 FROM n),
b AS (SELECT CAST(least(floor((v - min) / width), 23) AS INTEGER) AS bin, count(*) AS n FROM n, w GROUP BY ALL)
SELECT CAST(g.bin AS INTEGER) AS bin, round(min + width * g.bin, 6) AS lo, round(CASE WHEN g.bin = 23 THEN max ELSE min + width * g.bin + width END, 6) AS hi, coalesce(b.n, 0) AS n, count, min, max, (SELECT round(avg(value), 6) FROM e) AS avg, p50, p95 FROM range(24) g(bin) LEFT JOIN b ON b.bin = g.bin, w""")
def numeric_facet(spark, sf):
    return A.numeric_facet(L.typed_lines(spark, sf), "duration_ms").withColumns({c: F.round(c, 6) for c in ("lo", "hi", "avg")})


@query("a09_capture_facet", f"WITH {EVENTS}, c AS (SELECT CAST(k AS VARCHAR) AS value, count(*) AS n FROM e GROUP BY ALL) SELECT value, n, (SELECT count(*) FROM c) AS distinct_count, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS covered, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS numeric_count FROM c ORDER BY n DESC, value LIMIT 10")
def capture_facet(spark, sf):
    return A.capture_facet(L.typed_lines(spark, sf), _DUR, 10)


@query("a10_nearest_rank", f"""WITH {EVENTS}, r AS (SELECT usr AS "user", value, row_number() OVER (PARTITION BY usr ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY usr) AS c FROM e), q AS (SELECT unnest([0.0, 0.5, 0.95]::DOUBLE[]) AS q)
SELECT "user", q, value FROM r, q WHERE r = floor(q * (c - 1) + 0.5)""")
def nearest_rank(spark, sf):
    nums = L.typed_lines(spark, sf).select(F.col("fields")["user"].alias("user"), to_num(F.col("fields")["duration_ms"]).alias("v0"))
    return A.nearest_rank(nums, ["user"], "v0", [0.0, 0.5, 0.95])


def _agg(name: str, spec, sql: str) -> None:
    def run(spark, sf):
        got = A.aggregate(L.typed_lines(spark, sf), *spec)
        return got.withColumn("value", F.round("value", 6))

    query(name, f"WITH {EVENTS} {sql}")(run)


_TOP = ", t AS (SELECT event AS g, {m} AS value FROM e GROUP BY ALL) SELECT g AS \"group\", 'all' AS series, round(CAST(value AS DOUBLE), 6) AS value, false AS truncated FROM t"
_agg("a11_aggregate_none", (A.Group("none"), None, A.Metric("count")), "SELECT 'all' AS \"group\", 'all' AS series, CAST(count(*) AS DOUBLE) AS value, false AS truncated FROM e")
_agg("a12_aggregate_time", (A.Group("time", buckets=50), None, A.Metric("count")), f", {_hist_sql(FLOOR_100.replace('100', '50'))} SELECT CAST(start_ms AS VARCHAR) AS \"group\", 'all' AS series, CAST(total AS DOUBLE) AS value, false AS truncated FROM hist")
_agg("a13_aggregate_field", (A.Group("field", "user", limit=10), None, A.Metric("avg", "duration_ms")), ", t AS (SELECT usr, avg(value) AS v FROM e GROUP BY ALL) SELECT usr AS \"group\", 'all' AS series, round(v, 6) AS value, (SELECT count(*) > 10 FROM t) AS truncated FROM t ORDER BY v DESC, usr LIMIT 10")
_agg("a14_aggregate_split", (A.Group("field", "event"), A.Split("level"), A.Metric("count")), "SELECT event AS \"group\", level AS series, CAST(count(*) AS DOUBLE) AS value, false AS truncated FROM e GROUP BY ALL")
_agg("a15_metric_count", (A.Group("field", "event"), None, A.Metric("count")), _TOP.format(m="count(*)"))
_agg("a16_metric_unique", (A.Group("field", "event"), None, A.Metric("unique", "user")), _TOP.format(m="count(DISTINCT usr)"))
for _m in ("sum", "avg", "min", "max"):
    _agg(f"a17_metric_{_m}", (A.Group("field", "event"), None, A.Metric(_m, "duration_ms")), _TOP.format(m=f"{_m}(value)"))
for _q in ("50", "95"):
    _agg(f"a18_metric_p{_q}", (A.Group("field", "event"), A.Split("field", "missing"), A.Metric(f"p{_q}", "duration_ms")), f", r AS (SELECT event, value, row_number() OVER (PARTITION BY event ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event) AS c FROM e) SELECT event AS \"group\", '(none)' AS series, round(value, 6) AS value, false AS truncated FROM r WHERE r = floor(0.{_q} * (c - 1) + 0.5)")


@query("a19_run_panels", f"""WITH {EVENTS} SELECT 'errors' AS panel, event AS "group", CAST(count(*) AS DOUBLE) AS value FROM e WHERE level = 'ERROR' GROUP BY ALL
UNION ALL SELECT 'slow', event, max(value) FROM e WHERE value > 20 GROUP BY ALL
UNION ALL SELECT 'users', event, count(DISTINCT usr) FROM e GROUP BY ALL
UNION ALL SELECT 'median', event, value FROM (SELECT event, value, row_number() OVER (PARTITION BY event ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event) AS c FROM e) WHERE r = floor(0.5 * (c - 1) + 0.5)
UNION ALL SELECT 'by time', CAST(lo + (ms - lo) // w * w AS VARCHAR), count(*) FROM e, (SELECT min(ms) AS lo, CAST(greatest(greatest(max(ms) - min(ms), 1) // 20 + 1, 1) AS BIGINT) AS w FROM e) GROUP BY ALL""")
def run_panels(spark, sf):
    lines = L.typed_lines(spark, sf)
    got = A.run_panels(lines, {"errors": (P.level_cmp("eq", "ERROR"), A.Group("field", "event"), None, A.Metric()), "slow": (P.field_cmp("duration_ms", "gt", 20), A.Group("field", "event"), None, A.Metric("max", "duration_ms")),
        "users": (None, A.Group("field", "event"), None, A.Metric("unique", "user")), "median": (None, A.Group("field", "event"), None, A.Metric("p50", "duration_ms")), "by time": (None, A.Group("time", buckets=20), None, A.Metric())})
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("panel"), "group", "value") for n, df in got.items()])


# ---------------------------------------------------------------- templates and diagnostics


@query("t01_template_of", f"WITH {TEMPLATES} SELECT stream, line_no, md5(pattern) AS pattern FROM t")
def template(spark, sf):
    return L.document_lines(spark, sf).filter("is_head").select("stream", "line_no", F.md5(template_of(F.col("text"))).alias("pattern"))


@query("t02_templates", f"WITH {TEMPLATES}, c AS (SELECT pattern, count(*) AS count, min(struct_pack(a := stream, b := line_no)) AS f FROM t GROUP BY ALL) SELECT row_number() OVER (ORDER BY f) - 1 AS id, md5(pattern) AS pattern, count FROM c")
def templates(spark, sf):
    return T.templates(L.document_lines(spark, sf)).select("id", F.md5("pattern").alias("pattern"), "count")


@query("t03_clusters", f"WITH {EVENTS}, c AS (SELECT event || ' <*> by <*>' AS pattern, count(*) AS count, min(struct_pack(a := stream, b := line_no)) AS f FROM e GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY f) - 1 AS id FROM c) SELECT id, pattern, count, (SELECT count(*) FROM c) AS distinct_count, (SELECT CAST(sum(count) AS BIGINT) FROM c) AS covered FROM n")
def clusters(spark, sf):
    return T.clusters(L.typed_lines(spark, sf)).withColumn("id", F.col("id").cast("long"))


@query("t04_clusters_by_level", f"WITH {EVENTS}, c AS (SELECT event || ' <*> by <*>' AS pattern, count(*) FILTER (WHERE level IN ('ERROR', 'FATAL')) AS count, min(struct_pack(a := stream, b := line_no)) AS f FROM e GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY f) - 1 AS id FROM c) SELECT id, pattern, count, (SELECT count(*) FROM c WHERE count > 0) AS distinct_count, (SELECT CAST(sum(count) AS BIGINT) FROM c) AS covered FROM n WHERE count > 0")
def clusters_by_level(spark, sf):
    return T.clusters_by_level(L.typed_lines(spark, sf), ["ERROR", "FATAL"]).withColumn("id", F.col("id").cast("long"))


@query("d01_correlate", f"""WITH {EVENTS}, f AS (SELECT k > 90 AND event IN ('error', 'click') AS hit, 'event' AS field, event AS value FROM e UNION ALL SELECT k > 90 AND event IN ('error', 'click'), 'user', usr FROM e UNION ALL SELECT k > 90 AND event IN ('error', 'click'), 'k', CAST(k AS VARCHAR) FROM e UNION ALL SELECT k > 90 AND event IN ('error', 'click'), 'duration_ms', CAST(value AS VARCHAR) FROM e),
c AS (SELECT field, value, count(*) AS n, count(*) FILTER (WHERE hit) AS count FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS r FROM c WHERE count > 0),
z AS (SELECT count(*) AS lines, count(*) FILTER (WHERE k > 90 AND event IN ('error', 'click')) AS results FROM e), x AS (SELECT field, value, count, count / results AS share, (count / results) / (n / lines) AS lift FROM r, z WHERE r = 1)
SELECT field, value, count, round(share, 9) AS share, round(lift, 9) AS lift FROM x WHERE share >= 0.5 OR share >= 0.15 AND lift >= 1.5 ORDER BY share DESC, lift DESC, field LIMIT 8""")
def correlate(spark, sf):
    pred = P.field_cmp("k", "gt", 90) & (P.field_eq("event", "error") | P.field_eq("event", "click"))
    got = D.correlate(L.typed_lines(spark, sf), pred)
    return got.withColumn("share", F.round("share", 9)).withColumn("lift", F.round("lift", 9))


@query("d02_duration_field", "SELECT 'duration_ms' AS key, count(*) AS n FROM events")
def duration_field(spark, sf):
    return D.duration_field(L.typed_lines(spark, sf))


@query("d03_triage", f"""WITH {EVENTS}, r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS c FROM e),
s AS (SELECT count(*) AS n, max(CASE WHEN r = floor(0.5 * (c - 1) + 0.5) THEN value END) AS p50, max(CASE WHEN r = floor(0.95 * (c - 1) + 0.5) THEN value END) AS p95, max(value) AS max FROM r),
a AS (SELECT count(*) AS total, count(ms) AS with_ts, min(ms) AS min_ms, max(ms) AS max_ms, count(*) FILTER (WHERE level IN ('ERROR', 'FATAL')) AS errors FROM e)
SELECT 'summary' AS part, u.name, CAST(u.value AS DOUBLE) AS value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME name VALUE value) u
UNION ALL SELECT 'levels', level, CAST(count(*) AS DOUBLE) FROM e GROUP BY level
UNION ALL SELECT 'clusters', event || ' <*> by <*>', CAST(count(*) AS DOUBLE) FROM e WHERE level IN ('ERROR', 'FATAL') GROUP BY event
UNION ALL SELECT 'duration_ms', 'n', n FROM s UNION ALL SELECT 'duration_ms', 'p50', p50 FROM s UNION ALL SELECT 'duration_ms', 'p95', p95 FROM s UNION ALL SELECT 'duration_ms', 'max', max FROM s""")
def triage(spark, sf):
    got = D.triage(L.typed_lines(spark, sf))
    flat = lambda df, part, names: df.select(part.alias("part"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in names.items()])))
    summary = flat(got["summary"], F.lit("summary"), {"total": F.col("total"), "with_ts": F.col("with_ts"), "min_ms": _ms("min_ts"), "max_ms": _ms("max_ts"), "errors": F.col("errors")})
    levels = got["levels"].select(F.lit("levels").alias("part"), F.col("level").alias("name"), F.col("n").cast("double").alias("value"))
    clusters = got["clusters"].select(F.lit("clusters").alias("part"), F.col("pattern").alias("name"), F.col("count").cast("double").alias("value"))
    slowest = flat(got["slowest"], F.col("field"), {c: F.col(c) for c in ("n", "p50", "p95", "max")})
    return summary.unionByName(levels).unionByName(clusters).unionByName(slowest)


@query("d04_spikes", f"""WITH {EVENTS}, {_hist_sql(FLOOR_100)}, q AS (SELECT quantile_cont(total, 0.5) AS med, quantile_cont(total, 0.9) AS q90, count(*) AS n FROM hist),
s AS (SELECT quantile_cont(abs(total - med), 0.5) * 1.4826 AS sigma FROM hist, q), c AS (SELECT hist.*, med, n FROM hist, q, s WHERE n >= 8 AND total >= 3 AND total > q90 AND total >= greatest(med + 4 * sigma, q90 * 1.8))
SELECT bucket, start_ms, total, round(CASE WHEN med > 0 THEN total / med ELSE CAST('inf' AS DOUBLE) END, 9) AS ratio FROM c WHERE (SELECT count(*) FROM c) <= n * 0.25 ORDER BY total DESC, bucket LIMIT 15""")
def spikes(spark, sf):
    return D.spikes(A.time_histogram(L.typed_lines(spark, sf))).withColumn("ratio", F.round("ratio", 9))


@query("d05_gaps", f"""WITH {EVENTS}, {_hist_sql(FLOOR_100)}, w AS (SELECT count(*) AS n, (max(start_ms) - min(start_ms)) AS span, max(bucket_ms) AS w FROM hist),
g AS (SELECT lag(start_ms) OVER (ORDER BY start_ms) + bucket_ms AS f, start_ms FROM hist), x AS (SELECT f AS start_ms, start_ms AS end_ms, start_ms - f AS duration_ms, CAST(floor((start_ms - f) / w + 0.5) AS BIGINT) AS missing FROM g, w WHERE n >= 8 AND n / (floor(span / w + 0.5) + 1) >= 0.4)
SELECT * FROM x WHERE missing >= 2 ORDER BY duration_ms DESC, start_ms LIMIT 12""")
def gaps(spark, sf):
    return D.gaps(A.time_histogram(L.typed_lines(spark, sf)))


# ---------------------------------------------------------------- several sources


def _sources(spark, sf) -> dict[str, DataFrame]:
    o = L.table(spark, sf, "orders")
    ts = o["o_orderdate"].cast("timestamp") + F.make_dt_interval(F.lit(9000))
    orders = S.from_columns(o, ts, F.when(o.o_orderstatus == "F", "ERROR").otherwise("INFO"), {"priority": o.o_orderpriority}, F.concat(F.lit("order of "), o.o_custkey), F.lit("orders"), o.o_orderkey)
    orders = orders.withColumn("head", F.col("line_no")).withColumn("is_head", F.lit(True))
    return {"events": L.typed_lines(spark, sf), "orders": orders}


_BOTH = EVENTS + """, m AS (SELECT 'events' AS source, stream, line_no, ms, level, text FROM e
 UNION ALL SELECT 'orders', 'orders', o_orderkey, epoch_ms(o_orderdate) + 9000 * 86400000::BIGINT, CASE WHEN o_orderstatus = 'F' THEN 'ERROR' ELSE 'INFO' END, 'order of ' || o_custkey FROM orders)"""


@query("m01_merge_timeline", f"WITH {_BOTH} SELECT source, stream, line_no, ms, level, CAST(1 AS INTEGER) AS span FROM m")
def merge_timeline(spark, sf):
    return M.merge_timeline(_sources(spark, sf)).orderBy(*M.ORDER).select("source", "stream", "line_no", _ms().alias("ms"), "level", "span")


@query("m02_merged_search", f"WITH {_BOTH} SELECT source, stream, line_no, ms FROM m WHERE level = 'ERROR'")
def merged_search(spark, sf):
    return M.merged_search(_sources(spark, sf), P.level_cmp("eq", "ERROR")).select("source", "stream", "line_no", _ms().alias("ms"))


@query("m03_merged_page", f"WITH {_BOTH} SELECT source, stream, line_no, ms, regexp_matches(text, 'error|7') AS match FROM m ORDER BY ms DESC, source DESC, stream DESC, line_no DESC LIMIT 200 OFFSET 50")
def merged_page(spark, sf):
    tl = M.merge_timeline(_sources(spark, sf))
    return M.merged_page(tl, 50, 200, newest_first=True, highlight=P.line_regex("error|7")).select("source", "stream", "line_no", _ms().alias("ms"), "match")


@query("m04_merged_histogram", f"WITH {_BOTH}, {_hist_sql(CEIL_100, source='m')} SELECT * FROM hist")
def merged_histogram(spark, sf):
    return M.merged_histogram(M.merge_timeline(_sources(spark, sf)))


@query("m05_seek", f"WITH {_BOTH} SELECT count(*) AS n FROM m WHERE ms < epoch_ms(TIMESTAMP '2024-01-15')")
def seek(spark, sf):
    return M.seek(M.merge_timeline(_sources(spark, sf)), 1705276800000)


@query("m05_seek_result", f"WITH {_BOTH} SELECT count(*) AS n FROM m WHERE ms < epoch_ms(TIMESTAMP '2024-01-15')")
def seek_result(spark, sf):
    return M.seek_result(M.materialize_timeline(M.merge_timeline(_sources(spark, sf)).drop("fields")), 1705276800000)


# ---------------------------------------------------------------- streaming


def _segments(spark, sf, log=L.app_log) -> str:
    """The app log of the events, or another, as text segments in a fresh folder."""
    path = S.scratch(spark, "segments")
    log(spark, sf).select("text").write.text(path)
    return path


_RULES = lambda: [W.Rule("errors", P.level_cmp("eq", "ERROR"), 1, 60), W.Rule("sevens", P.line_regex(r"k=7\b"), 3, 3600), W.Rule("off", P.match_all(), enabled=False)]


def _tailed(spark, sf) -> DataFrame:
    return W.tail(W.read_lines_stream(spark, _segments(spark, sf)), P.match_all(), "timestamped")


@query("x01_read_lines_stream", _WHOLE)
def lines_stream(spark, sf):
    return _whole(W.run_available(W.read_lines_stream(spark, _segments(spark, sf, L.typed_lines), blocks=True), "append", W.dense_numbers))


@query("x02_tail", f"WITH {EVENTS} SELECT ms, level, 'user.' || usr AS logger, event || ' k=' || k || ' took ' || value || 'ms' AS message FROM e WHERE level = 'ERROR' AND k > 50")
def tail(spark, sf):
    pred = P.level_cmp("eq", "ERROR") & P.capture_cmp(_DUR, "gt", 50)
    return W.run_available(W.tail(W.read_lines_stream(spark, _segments(spark, sf)), pred, "timestamped"), "append").select(_ms().alias("ms"), "level", F.col("fields")["logger"].alias("logger"), "message")


@query("x03_stream_records", f"WITH {RECORDS} SELECT stream, head, CAST(count(*) AS INTEGER) AS span, md5(string_agg(text, chr(10) ORDER BY line_no)) AS text FROM h GROUP BY stream, head")
def stream_records(spark, sf):
    path = S.scratch(spark, "record-lines")
    S.explode_lines(L.table(spark, sf, "documents"), "text", F.col("doc_id").cast("string")).write.parquet(path)
    stream = spark.readStream.schema("stream string, line_no long, text string").parquet(path)
    got = W.collect_records(W.run_available(W.stream_records(stream), "append"))
    return got.select("stream", "head", "span", F.md5("text").alias("text"))


@query("x04_watch_match", f"WITH {EVENTS} SELECT 'errors' AS rule, count(*) AS n FROM e WHERE level = 'ERROR' UNION ALL SELECT 'sevens', count(*) FROM e WHERE k = 7")
def watch_match(spark, sf):
    got = W.run_available(_tailed(spark, sf), "append", lambda df: W.watch_match(df, _RULES()))
    return got.groupBy("rule").agg(F.sum("n").alias("n"))


def _rate_sql(rule: str, pred: str, threshold: int, ms: int) -> str:
    """The times at which the matches of the last ms reach the threshold, having been fewer just before."""
    sums = f"SELECT ms, sum(c) OVER (ORDER BY ms RANGE BETWEEN {ms} PRECEDING AND CURRENT ROW) AS n, c FROM (SELECT ms, count(*) AS c FROM e WHERE {pred} GROUP BY ms)"
    return f"SELECT '{rule}' AS rule, ms AS at_ms, CAST(n AS BIGINT) AS n FROM ({sums}) WHERE n >= {threshold} AND n - c < {threshold}"


@query("x05_watch_rate", f"WITH {EVENTS} {_rate_sql('errors', "level = 'ERROR'", 4, 7_200_000)} UNION ALL {_rate_sql('sevens', 'k = 7', 3, 86_400_000)}")
def watch_rate(spark, sf):
    rules = [W.Rule("errors", P.level_cmp("eq", "ERROR"), 4, 7200), W.Rule("off", P.match_all(), enabled=False), W.Rule("sevens", P.line_regex(r"k=7\b"), 3, 86400)]
    return W.run_available(W.watch_rate(_tailed(spark, sf), rules), "update").select("rule", "at_ms", "n")


@query("x06_live_histogram", f"WITH {EVENTS} SELECT ms // 3600000 * 3600000 AS start_ms, level, count(*) AS n FROM e GROUP BY ALL")
def live_histogram(spark, sf):
    got = W.run_available(W.live_histogram(_tailed(spark, sf), "1 hour", "60 days"), "update")
    return got.groupBy(_ms("start").alias("start_ms"), "level").agg(F.max_by("n", "batch").alias("n"))


@query("x07_live_merge", f"WITH {EVENTS} SELECT source, ms, level, event || ' k=' || k || ' took ' || value || 'ms' AS message FROM e, (VALUES ('a'), ('b')) v(source) WHERE source = 'a' OR level = 'ERROR'")
def live_merge(spark, sf):
    path = _segments(spark, sf)
    a = W.tail(W.read_lines_stream(spark, path), P.match_all(), "timestamped")
    b = W.tail(W.read_lines_stream(spark, path), P.level_cmp("eq", "ERROR"), "timestamped")
    return W.run_available(W.live_merge({"a": a, "b": b}), "append").select("source", _ms().alias("ms"), "level", "message")


@query("x08_live_templates", f"WITH {EVENTS} SELECT '<*> [' || level || '] <*> - ' || event || ' <*> took <*>' AS template, count(*) AS n FROM e GROUP BY ALL")
def live_templates(spark, sf):
    got = W.run_available(W.live_templates(W.read_lines_stream(spark, _segments(spark, sf))), "update")
    return got.groupBy("template").agg(F.max_by("n", "batch").alias("n"))


# ---------------------------------------------------------------- redaction


def _masks_sql(text: str) -> dict[str, str]:
    """For each category the SQL of its mask over an expression. A token is what is left of a run of its characters
    between its first and its last word character; a card's digits are summed as Luhn's check says."""
    plain = lambda pattern, label: f"regexp_replace({text}, '{pattern}', '{label}', 'g')"
    secret = r"\b(pass(?:word|wd)?|pwd|secret|token|api[_-]?key|apikey|auth(?:orization)?|access[_-]?token|refresh[_-]?token|client[_-]?secret|session[_-]?id)\b(\s*[:=]\s*\"?)([^\s,;\"'']+)"
    each = lambda pattern, f: f"array_to_string(list_transform(list_zip(regexp_split_to_array({text}, '{pattern}'), regexp_extract_all({text}, '{pattern}')), lambda x: x[1] || CASE WHEN x[2] IS NULL THEN '' ELSE {f} END), '')"
    return {
        "secret": f"regexp_replace(regexp_replace({text}, '{secret}', '\\1\\2[secret]', 'gi'), '\\bBearer\\s+[A-Za-z0-9._~+/=-]{{8,}}', 'Bearer [secret]', 'gi')",
        "jwt": plain(r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "[jwt]"),
        "email": plain(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[email]"),
        "ipv4": plain(r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", "[ip]"),
        "ipv6": plain(r"\b(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,6}:(?:[0-9a-fA-F]{1,4}:?){0,5}\b", "[ip]"),
        "card": each(r"\b\d(?:[ -]?\d){12,18}\b", "CASE WHEN " + _LUHN.format(m="x[2]") + " THEN '[card]' ELSE x[2] END"),
        "token": each(r"[A-Za-z0-9+/_=-]{20,}", r"CASE WHEN " + _TOKEN.format(m="x[2]") + r" THEN regexp_extract(x[2], '^[+/=-]*') || '[token]' || regexp_extract(x[2], '[+/=-]*$') ELSE x[2] END"),
    }


_LUHN = "list_sum(list_transform(list_reverse(regexp_extract_all({m}, '\\d')), lambda d, i: CASE WHEN i % 2 = 0 THEN 2 * CAST(d AS INTEGER) // 10 + 2 * CAST(d AS INTEGER) % 10 ELSE CAST(d AS INTEGER) END)) % 10 = 0"
_TOKEN = "length(regexp_replace({m}, '^[+/=-]+|[+/=-]+$', '', 'g')) >= 20 AND regexp_matches({m}, '\\d') AND regexp_matches({m}, '[A-Za-z]')"
_CATEGORIES = ["secret", "jwt", "email", "ipv4", "ipv6", "card", "token"]
_CHAIN = ", ".join(f"s{i + 1} AS (SELECT doc_id, {_masks_sql('text')[c]} AS text FROM s{i})" for i, c in enumerate(_CATEGORIES))


@query("k01_redact", f"WITH s0 AS (SELECT doc_id, text FROM documents), {_CHAIN} SELECT doc_id, md5(regexp_replace(text, 'Licensed under the Apache License', '[licence]', 'g')) AS masked FROM s7")
def redacted(spark, sf):
    return L.table(spark, sf, "documents").select("doc_id", F.md5(redact(F.col("text"), custom=[("licence", r"Licensed under the Apache License")])).alias("masked"))


def _mask(number: int, category: str) -> None:
    def run(spark, sf):
        return L.table(spark, sf, "documents").select("doc_id", F.md5(mask(category, F.col("text"))).alias("masked"))

    query(f"k{number:02}_mask_{category}", f"SELECT doc_id, md5({_masks_sql('text')[category]}) AS masked FROM documents")(run)


for _i, _c in enumerate(_CATEGORIES):
    _mask(_i + 2, _c)


@query("k09_mask_custom", "SELECT doc_id, md5(regexp_replace(text, 'Licensed under the \\w+ License', '[licence]', 'g')) AS masked FROM documents")
def mask_custom(spark, sf):
    every = ["secret", "jwt", "email", "ipv4", "ipv6", "card", "token"]
    return L.table(spark, sf, "documents").select("doc_id", F.md5(redact(F.col("text"), every, [("licence", r"Licensed under the \w+ License"), ("bad", "(")])).alias("masked"))


@query("k10_find_sensitive", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_masks_sql('text')[c]} <> text THEN '{c}' END" for c in _CATEGORIES) + "], lambda x: x IS NOT NULL), ',') AS found FROM documents")
def sensitive(spark, sf):
    return L.table(spark, sf, "documents").select("doc_id", F.array_join(find_sensitive(F.col("text")), ",").alias("found"))
