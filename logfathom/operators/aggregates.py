"""Counts, facets, histograms, percentiles and group/split/metric aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfathom.functions.predicates import Capture
from logfathom.functions.values import LEVEL_NAMES, ascii_fold, to_num
from logfathom.sources.ordered import in_order, staged

# Keys that a summary of fields leaves out (any case).
SUMMARY_SKIPS = ["timestamp", "ts", "time", "@timestamp", "date", "datetime", "eventtime", "level", "lvl", "severity", "loglevel", "message", "msg"]
_RANGES = 80  # that values are put in order by


def _one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a frame that an aggregate without keys has made: one row."""
    return df.crossJoin(F.broadcast(row))


def level_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.coalesce("level", F.lit("NONE")).alias("level")).agg(F.count("*").alias("n"))


def stats(lines: DataFrame, heads_only: bool = False) -> DataFrame:
    """One row: total, with_ts, min_ts, max_ts and levels, an array of (level, n) by count."""
    rows = lines.filter("is_head") if heads_only else lines
    whole = rows.agg(F.count("*").alias("total"), F.count("ts").alias("with_ts"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
    by_level = level_counts(rows).agg(F.collect_list(F.struct((-F.col("n")).alias("m"), "level")).alias("l"))  # seven rows at most
    levels = F.transform(F.array_sort("l"), lambda x: F.struct(x["level"].alias("level"), (-x["m"]).alias("n")))
    return _one_row(whole, by_level.select(levels.alias("levels")))


def width_floor(lo: Column, hi: Column, buckets: int) -> Column:
    """The bucket width of one stream's histogram: max(1, floor(span / n) + 1), n from 10 to 1,000, span at least 1."""
    n = min(max(buckets, 10), 1000)
    return F.greatest(F.floor(F.greatest(hi - lo, F.lit(1)) / n) + 1, F.lit(1))


def width_ceil(lo: Column, hi: Column, buckets: int) -> Column:
    """The bucket width of a merged timeline: max(1, ceil(span / n)); the last time may fall into bucket n."""
    return F.greatest(F.ceil(F.greatest(hi - lo, F.lit(1)) / buckets), F.lit(1))


def bucketed(lines: DataFrame, buckets: int, width=width_floor) -> DataFrame:
    """Lines that have a ts, with bucket, start_ms and bucket_ms."""
    ms = F.unix_millis("ts")
    rows = lines.filter("ts is not null")
    span = rows.agg(F.min(ms).alias("lo_ms"), F.max(ms).alias("hi_ms"))
    sized = span.select("lo_ms", width(F.col("lo_ms"), F.col("hi_ms"), buckets).cast("long").alias("bucket_ms"))
    got = _one_row(rows, sized).withColumn("bucket", F.floor((ms - F.col("lo_ms")) / F.col("bucket_ms")).cast("long"))
    return got.withColumn("start_ms", F.col("lo_ms") + F.col("bucket") * F.col("bucket_ms"))


def time_histogram(lines: DataFrame, buckets: int = 100, width=width_floor) -> DataFrame:
    """bucket, start_ms, a count for each level and NONE, total, bucket_ms; buckets without lines are left out."""
    names = [*LEVEL_NAMES, "NONE"]
    # The lines are read once: times and levels are counted first, and both the range and the buckets come from the counts.
    counts = lines.filter("ts is not null").groupBy(F.unix_millis("ts").alias("ms"), F.coalesce("level", F.lit("NONE")).alias("level")).agg(F.count("*").alias("n"))
    whole = F.struct("ms", "level", "n")  # all columns, so that both uses are the same exchange
    span = counts.agg(F.min(whole)["ms"].alias("lo_ms"), F.max(whole)["ms"].alias("hi_ms"))
    sized = span.select("lo_ms", width(F.col("lo_ms"), F.col("hi_ms"), buckets).cast("long").alias("bucket_ms"))
    at = F.floor((F.col("ms") - F.col("lo_ms")) / F.col("bucket_ms")).cast("long")
    cells = _one_row(counts, sized).groupBy(at.alias("bucket"), "lo_ms", "bucket_ms").agg(*[F.coalesce(F.sum(F.when(F.col("level") == n, F.col("n"))), F.lit(0).cast("long")).alias(n) for n in names], F.sum("n").alias("total"))
    return cells.select("bucket", (F.col("lo_ms") + F.col("bucket") * F.col("bucket_ms")).alias("start_ms"), "bucket_ms", *names, "total")


def without_ts(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count_if(F.col("ts").isNull()).alias("without_ts"))


def peak_per_min(lines: DataFrame) -> DataFrame:
    """One row: the fullest bucket's lines a minute, rounded; 0 without timestamps."""
    peak = time_histogram(lines, 100).agg(F.max(F.col("total") / F.col("bucket_ms") * 60000).alias("p"))
    return peak.select(F.coalesce(F.floor(F.col("p") + 0.5), F.lit(0)).cast("long").alias("peak_per_min"))


def fields_long(lines: DataFrame) -> DataFrame:
    """stream, line_no, key, value, num: a row for each field of each line."""
    rows = lines.select("stream", "line_no", F.explode("fields"))
    return rows.withColumn("num", to_num(F.col("value")))


def field_catalog(lines: DataFrame, limit: int = 200) -> DataFrame:
    """key, n: in how many lines, most first, then by name."""
    counts = lines.select(F.explode(F.map_keys("fields")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "key").limit(limit)


def top_fields_summary(lines: DataFrame, scope: Column | None = None, fields: int = 5, values: int = 4) -> DataFrame:
    """Of the most frequent keys of all lines: key, rank, value, n of the top values in the scope, distinct, covered."""
    keys = field_catalog(lines.select(F.map_filter("fields", lambda k, v: ~F.lower(k).isin(SUMMARY_SKIPS)).alias("fields")), fields)
    rows = fields_long(lines.filter(scope) if scope is not None else lines).join(F.broadcast(keys.select("key")), "key")
    counts = rows.groupBy("key", ascii_fold(F.col("value")).alias("folded")).agg(F.count("*").alias("n"), F.min_by("value", F.struct("stream", "line_no")).alias("value"))
    whole = counts.groupBy("key").agg(F.count("*").alias("distinct"), F.sum("n").alias("covered"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "folded"))).filter(F.col("rank") <= values)
    return ranked.join(whole, "key").select("key", "rank", "value", "n", "distinct", "covered")


def _facet(rows: DataFrame, limit: int) -> DataFrame:
    """rows: stream, line_no, value."""
    limit = min(max(limit, 1), 1000)
    counts = rows.filter("value is not null").groupBy(ascii_fold(F.col("value")).alias("folded")).agg(F.count("*").alias("n"), F.min_by("value", F.struct("stream", "line_no")).alias("value"), F.count(to_num(F.col("value"))).alias("numeric"))
    whole = counts.agg(F.count("*").alias("distinct_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("covered"), F.coalesce(F.sum("numeric"), F.lit(0)).alias("numeric_count"))
    top = counts.orderBy(F.desc("n"), "folded").limit(limit).select("value", "n")
    return _one_row(top, whole)


def facet(lines: DataFrame, field: str, limit: int = 25) -> DataFrame:
    """value, n of the most frequent values (ASCII case aside; shown as first seen), with distinct_count, covered and
    numeric_count of all."""
    return _facet(lines.select("stream", "line_no", F.col("fields")[field].alias("value")), limit)


def capture_facet(lines: DataFrame, capture: Capture, limit: int = 25) -> DataFrame:
    """facet() over an ad-hoc field, of all lines."""
    return _facet(lines.select("stream", "line_no", capture.column().alias("value")), limit)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """keys, q, value at the 0-based rank floor(q * (n - 1) + 0.5) of each key's non-null values. Values are counted first,
    in one read of df."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    return rank_of_counts(counts, keys, quantiles)


def rank_of_counts(counts: DataFrame, keys: Sequence[str], quantiles: Sequence[float], parts: int = _RANGES) -> DataFrame:
    """nearest_rank() of values __v that each key has __c times; no value twice in a key.

    They are written in the order of (keys, value) as range partitions that a sample of them has cut, so that outliers
    don't matter and a key with most of the values is in many partitions. Sums by partition tell where a rank is, and only
    the values of that key in that partition are summed up one by one.
    """
    keys = list(keys)
    if not keys:
        counts, keys = counts.withColumn("__all", F.lit(0)), ["__all"]
    rows = in_order(counts, [*keys, "__v"], "ranks", parts).all().drop("row")
    sums = rows.groupBy(*keys, "__part").agg(F.sum("__c").alias("__s"))
    own = Window.partitionBy(*keys)
    spans = sums.withColumns({"__end": F.sum("__s").over(own.orderBy("__part")), "__n": F.sum("__s").over(own)}).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    ranked = spans.withColumn("__rank", F.floor(F.col("q") * (F.col("__n") - 1) + 0.5))
    hit = ranked.filter((F.col("__rank") < F.col("__end")) & (F.col("__rank") >= F.col("__end") - F.col("__s")))
    hit = hit.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__of_part"), "q", (F.col("__rank") - (F.col("__end") - F.col("__s"))).alias("__left"))
    inside = rows.join(hit, [rows["__part"] == hit["__of_part"], *[rows[k].eqNullSafe(hit[f"__{k}"]) for k in keys]])
    first = inside.withColumn("__run", F.sum("__c").over(Window.partitionBy(*keys, "q").orderBy("__v"))).filter(F.col("__run") > F.col("__left"))
    return first.groupBy(*keys, "q").agg(F.min("__v").alias("value")).drop("__all")


def numeric_facet(lines: DataFrame, field: str, buckets: int = 24) -> DataFrame:
    """bin, lo, hi, n with count, min, max, avg, p50, p95 on each row; zero bins kept, the maximum in the last; one bin
    for a single value, no row without numbers. The lines are read once, into counts of the values."""
    bins = min(max(buckets, 1), 200)
    nums = lines.select(to_num(F.col("fields")[field]).alias("__v")).filter("__v is not null")
    counts = staged(nums.groupBy("__v").agg(F.count("*").alias("__c")), "values")
    whole = counts.agg(F.sum("__c").alias("count"), F.min("__v").alias("min"), F.max("__v").alias("max"), (F.sum(F.col("__v") * F.col("__c")) / F.sum("__c")).alias("avg"))
    ranks = rank_of_counts(counts, [], [0.5, 0.95]).agg(F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("q") == 0.95, F.col("value"))).alias("p95"))
    whole = _one_row(whole, ranks).filter("count > 0").withColumn("bins", F.when(F.col("max") > F.col("min"), bins).otherwise(1)).withColumn("width", (F.col("max") - F.col("min")) / F.col("bins"))
    at = F.when(F.col("width") > 0, F.least(F.floor((F.col("__v") - F.col("min")) / F.col("width")), F.col("bins") - 1)).otherwise(0)
    in_bins = _one_row(counts, whole.select("min", "width", "bins")).groupBy(at.cast("int").alias("bin")).agg(F.sum("__c").alias("n"))
    rows = whole.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    lo = F.col("min") + F.col("width") * F.col("bin")
    out = rows.join(in_bins, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("lo", lo)
    return out.withColumn("hi", F.when(F.col("bin") == F.col("bins") - 1, F.col("max")).otherwise(F.col("lo") + F.col("width"))).select("bin", "lo", "hi", "n", "count", "min", "max", "avg", "p50", "p95")


@dataclass(frozen=True)
class Group:
    """What rows of an aggregate stand for: ``none``, ``time`` (in so many buckets) or a ``field`` (its top values)."""

    kind: str = "none"
    field: str | None = None
    limit: int = 20
    buckets: int = 100


@dataclass(frozen=True)
class Split:
    """Series: by ``level`` or by a ``field``'s values (case-sensitive; ``(none)`` where it is missing)."""

    kind: str
    field: str | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Metric:
    """count, unique, sum, avg, min, max, p50 or p95; all but count of a field."""

    kind: str = "count"
    field: str | None = None


def _checked(group: Group, split: Split | None, metric: Metric) -> None:
    if group.kind not in ("none", "time", "field") or group.kind == "field" and not group.field:
        raise ValueError(f"bad group: {group}")
    if split and (split.kind not in ("level", "field") or split.kind == "field" and not split.field):
        raise ValueError(f"bad split: {split}")
    if metric.kind not in ("count", "unique", "sum", "avg", "min", "max", "p50", "p95") or metric.kind != "count" and not metric.field:
        raise ValueError(f"bad metric: {metric}")


def aggregate(lines: DataFrame, group: Group = Group(), split: Split | None = None, metric: Metric = Metric()) -> DataFrame:
    """group, series, value, truncated: one row for each cell that has rows.

    Time groups are bucket starts (ms) over the lines given; field groups are the ones with the largest sums of cell
    values over all series (ties by name), folded in ASCII case and shown as first seen; series are the ones with the
    largest sums (12, or 50 levels). truncated says that groups were cut off. Without split the series is ``all``.
    """
    _checked(group, split, metric)
    rows = bucketed(lines, group.buckets).withColumn("g", F.col("start_ms")) if group.kind == "time" else lines
    if group.kind == "field":
        rows = rows.withColumn("__raw", F.col("fields")[group.field]).filter("__raw is not null").withColumn("g", ascii_fold(F.col("__raw")))
    elif group.kind == "none":
        rows = rows.withColumn("g", F.lit("all"))
    series = F.lit("all") if split is None else F.coalesce("level", F.lit("NONE")) if split.kind == "level" else F.coalesce(F.col("fields")[split.field], F.lit("(none)"))
    rows = rows.withColumn("s", series)
    if metric.field:
        text = F.col("fields")[metric.field]
        rows = rows.withColumn("m", ascii_fold(text) if metric.kind == "unique" else to_num(text)).filter("m is not null")
    shown = F.min_by("__raw", F.struct("stream", "line_no")).alias("shown") if group.kind == "field" else F.max("g").alias("shown")
    if metric.kind in ("p50", "p95"):
        ranks = nearest_rank(rows, ["g", "s"], "m", [float(metric.kind[1:]) / 100]).select("g", "s", F.col("value").alias("value"))
        cells = rows.groupBy("g", "s").agg(shown).join(ranks, ["g", "s"])
    else:
        how = {"count": F.count("*"), "unique": F.count_distinct("m") if metric.field else None, "sum": F.sum("m") if metric.field else None, "avg": F.avg("m") if metric.field else None, "min": F.min("m") if metric.field else None, "max": F.max("m") if metric.field else None}[metric.kind]
        cells = rows.groupBy("g", "s").agg(how.cast("double").alias("value"), shown)
    return _shown(cells, group, split)


def _shown(cells: DataFrame, group: Group, split: Split | None) -> DataFrame:
    """The cells (g, s, value, shown) of the largest groups and series."""
    cells = cells.withColumn("value", F.col("value").cast("double")).withColumn("truncated", F.lit(False))
    if split is not None:
        most = split.limit or (50 if split.kind == "level" else 12)
        kept = cells.groupBy("s").agg(F.sum("value").alias("t")).orderBy(F.desc("t"), "s").limit(most).select("s")
        totals = cells.groupBy("g").agg(F.sum("value").alias("t"))
        cells = cells.join(F.broadcast(kept), "s", "left_semi")
    else:
        totals = cells.groupBy("g").agg(F.sum("value").alias("t"))
    if group.kind == "field":
        top = totals.orderBy(F.desc("t"), "g").limit(group.limit).select("g")
        many = totals.agg((F.count("*") > group.limit).alias("many"))
        cells = _one_row(cells.join(F.broadcast(top), "g", "left_semi"), many).withColumn("truncated", F.col("many"))
    return cells.select(F.col("shown").cast("string").alias("group"), F.col("s").alias("series"), "value", "truncated")


def _value_of(metric: Metric) -> Column:
    """A metric of counted rows: n, total, low, high, and u, what unique counts."""
    of = {"count": F.sum("n"), "unique": F.count_distinct("u"), "sum": F.sum("total"), "avg": F.sum("total") / F.sum("n"), "min": F.min("low"), "max": F.max("high")}
    return of[metric.kind].cast("double")


def run_panels(lines: DataFrame, panels: dict[str, tuple[Column | None, Group, Split | None, Metric]]) -> dict[str, DataFrame]:
    """A dashboard: for each panel its aggregate() over the lines in its scope.

    The lines are read once: each becomes a row for every panel that it is in, and all panels are counted together, by
    panel, group (or time), series and, where a metric needs single values, value. Panels are made of those counts.
    """
    entries = []
    for i, (scope, group, split, metric) in enumerate(panels.values()):
        _checked(group, split, metric)
        raw = F.col("fields")[group.field] if group.kind == "field" else F.lit("all")
        series = F.lit("all") if split is None else F.coalesce("level", F.lit("NONE")) if split.kind == "level" else F.coalesce(F.col("fields")[split.field], F.lit("(none)"))
        text = F.col("fields")[metric.field] if metric.field else F.lit(None).cast("string")
        number = to_num(text) if metric.field and metric.kind != "unique" else F.lit(None).cast("double")
        counts = F.lit(True) if not metric.field else text.isNotNull() if metric.kind == "unique" else number.isNotNull()
        inside = (F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))) & (F.col("ts").isNotNull() if group.kind == "time" else raw.isNotNull() & counts)
        ranked = metric.kind in ("p50", "p95")
        entry = F.struct(
            F.lit(i).alias("panel"), ascii_fold(raw).alias("g"), (F.unix_millis("ts") if group.kind == "time" else F.lit(None).cast("long")).alias("ms"), series.alias("s"), number.alias("m"),
            (number if ranked else F.lit(None).cast("double")).alias("v"), (ascii_fold(text) if metric.kind == "unique" else F.lit(None).cast("string")).alias("u"), raw.alias("raw"), counts.cast("int").alias("one"),
        )
        entries.append(F.when(inside, entry))
    rows = lines.select("stream", "line_no", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("stream", "line_no", "e.*")
    counted = rows.groupBy("panel", "g", "ms", "s", "v", "u").agg(F.sum("one").alias("n"), F.sum("m").alias("total"), F.min("m").alias("low"), F.max("m").alias("high"), F.min(F.struct("stream", "line_no", "raw")).alias("first"))
    counted = staged(counted, "panels")
    out = {}
    for i, (name, (_, group, split, metric)) in enumerate(panels.items()):
        own = counted.filter(F.col("panel") == i)
        if group.kind == "time":
            span = own.agg(F.min("ms").alias("lo_ms"), F.max("ms").alias("hi_ms"))
            sized = span.select("lo_ms", width_floor(F.col("lo_ms"), F.col("hi_ms"), group.buckets).cast("long").alias("bucket_ms"))
            own = _one_row(own, sized).withColumn("g", F.col("lo_ms") + F.floor((F.col("ms") - F.col("lo_ms")) / F.col("bucket_ms")).cast("long") * F.col("bucket_ms"))
        own = own.filter("n > 0")
        shown = F.min("first")["raw"].alias("shown") if group.kind == "field" else F.max("g").alias("shown")
        if metric.kind in ("p50", "p95"):
            ranks = rank_of_counts(own.groupBy("g", "s", F.col("v").alias("__v")).agg(F.sum("n").alias("__c")), ["g", "s"], [float(metric.kind[1:]) / 100]).select("g", "s", "value")
            cells = own.groupBy("g", "s").agg(shown).join(ranks, ["g", "s"])
        else:
            cells = own.groupBy("g", "s").agg(_value_of(metric).alias("value"), shown)
        out[name] = _shown(cells, group, split)
    return out
