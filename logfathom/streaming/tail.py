"""Structured Streaming over logs: segment files as they come, records, alert rules, live counts."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logfathom.functions.values import is_continuation, template_of
from logfathom.operators.parsing import NamedPattern, parse_logs
from logfathom.sources.files import clean_line, scratch

MOST_RULES, MOST_THRESHOLD, MOST_WINDOW, SAMPLE_CHARS = 50, 1_000_000, 86400, 300


def read_lines_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None, blocks: bool = False) -> DataFrame:
    """stream, line_no, text of new segment files of a folder. A segment is complete when it appears (bytes appended to a
    known file are not read again). Segments are read line by line, in splits if they are large; lines are numbered from the
    first byte of their split on, so from 0 without gaps in a segment of one split, and in any case in their order. With
    blocks, that byte too, from which dense_numbers() closes the gaps."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, next_ = None, 0
        for batch in batches:
            paths, blocks = batch.column("stream").dictionary_encode(), batch.column("block").to_numpy()
            of, numbers = paths.indices.to_numpy(), np.empty(batch.num_rows, np.int64)
            starts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (blocks[1:] != blocks[:-1])))) if len(of) else []
            for a, b in zip(starts, [*starts[1:], len(of)], strict=True):
                split = (paths.dictionary[int(of[a])].as_py(), int(blocks[a]))
                if split != last:
                    last, next_ = split, split[1]
                numbers[a:b] = np.arange(next_, next_ + b - a)
                next_ += int(b - a)
            yield pa.RecordBatch.from_arrays([batch.column("stream"), pa.array(numbers), batch.column("text"), batch.column("block")], names=["stream", "line_no", "text", "block"])

    lines = reader.text(folder).select(F.col("_metadata.file_path").alias("stream"), F.col("_metadata.file_block_start").alias("block"), clean_line(F.col("value")).alias("text"))
    numbered = lines.mapInArrow(number, "stream string, line_no long, text string, block long")
    return numbered if blocks else numbered.drop("block")


def dense_numbers(batch: DataFrame) -> DataFrame:
    """A micro-batch of read_lines_stream() with blocks, its lines numbered from 0 without gaps in each segment: by their
    place in their split and the lines of the splits before it, one row a split. For foreachBatch(); a segment's splits all
    come in one micro-batch."""
    counts = batch.groupBy("stream", "block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("stream", "block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("block")).alias("__add"))
    return batch.join(starts, ["stream", "block"]).select("stream", (F.col("line_no") + F.col("__add")).alias("line_no"), "text")


def tail(stream: DataFrame, pred: Column, format: str, patterns: Sequence[NamedPattern] = (), year: int = 1970) -> DataFrame:
    """New lines, parsed by a fixed format, that match; stateless."""
    return parse_logs(stream, format, patterns, year).filter(pred)


def stream_records(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """stream, head, part, span, text, closed: what each micro-batch adds to a record, one row for each record it touches (to
    be appended; collect_records() puts records together). span and text are of the added lines; closed says that the
    record is whole, since its next head has come, or no line of its stream for ``idle_ms`` of the clock. part counts a
    record's rows from 0.

    Lines of a stream are to arrive in order of line_no. The state of a stream is the head of its open record and the number
    of rows given out for it, so that a record of any length costs as much as its lines. After a silence a continuation
    line starts a record of its own, as the first line of a stream does.
    """

    def extend(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head, part = state.get if state.exists else (-1, 0)
        out: list[tuple[int, int, int, str | None, bool]] = []
        if state.hasTimedOut:
            out.append((head, part, 0, None, True))
            state.remove()
        else:
            frames, texts = list(parts), []
            lines = [x for f in frames for x in zip(f["line_no"].tolist(), f["text"].tolist(), f["starts"].tolist(), strict=True)]
            for number, text, starts in sorted(lines, key=itemgetter(0)):
                if starts or head < 0:
                    if head >= 0:
                        out.append((head, part, len(texts), "\n".join(texts) if texts else None, True))
                    head, part, texts = number, 0, []
                texts.append(text or "")
            if texts:
                out.append((head, part, len(texts), "\n".join(texts), False))
                part += 1
            state.update((head, part))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        heads, places, spans, joined, closed = zip(*out, strict=True) if out else [()] * 5
        yield pd.DataFrame({"stream": [key[0]] * len(out), "head": heads, "part": places, "span": spans, "text": joined, "closed": closed})

    rows = stream.select("stream", "line_no", "text", (~is_continuation(F.coalesce("text", F.lit("")))).alias("starts"))
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("stream").applyInPandasWithState(extend, "stream string, head long, part int, span int, text string, closed boolean", "head long, part int", "append", timeout)


def collect_records(pieces: DataFrame) -> DataFrame:
    """stream, head, span, text, closed of each record, from the rows that stream_records() has given so far."""
    texts = F.array_sort(F.collect_list(F.when(F.col("span") > 0, F.struct("part", "text"))))
    got = pieces.groupBy("stream", "head").agg(F.sum("span").cast("int").alias("span"), F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("text"), F.max("closed").alias("closed"))
    return got.select("stream", "head", "span", "text", "closed")


@dataclass(frozen=True)
class Rule:
    """An alert: lines that match; for a rate, ``threshold`` of them in ``window`` seconds. Rules are told apart by their
    place, not by their names; sane_rules() fills it in."""

    name: str
    pred: Column
    threshold: int = 1
    window: int = 60
    enabled: bool = True
    place: int = 0


def sane_rules(rules: Iterable[Rule]) -> list[Rule]:
    """The enabled ones of the first 50 rules, thresholds from 1 to a million and windows of a second to a day; a rule with
    a blank name is called by its place, ``rule-0``."""
    named = [(i, r, r.name if r.name.strip() else f"rule-{i}") for i, r in enumerate(list(rules)[:MOST_RULES])]
    return [Rule(name, r.pred, min(max(int(r.threshold), 1), MOST_THRESHOLD), min(max(int(r.window), 1), MOST_WINDOW), True, i) for i, r, name in named if r.enabled]


def _matched(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """A row for each line and rule that it matches: rule_id, ms, stream, line_no, sample."""
    places = F.array_compact(F.array(*[F.when(F.coalesce(r.pred, F.lit(False)), F.lit(r.place)) for r in rules])) if rules else F.array().cast("array<int>")
    return lines.select(F.explode(places).alias("rule_id"), F.unix_millis("ts").alias("ms"), "stream", "line_no", F.substring("text", 1, SAMPLE_CHARS).alias("sample"))


def _named(rules: Sequence[Rule]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.place, r.name)]), F.col("rule_id")) if rules else F.lit(None).cast("string")


def watch_match(batch: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """rule, rule_id (its place), n, sample (of the last line) for each rule with a match in a micro-batch; for
    foreachBatch()."""
    rules = sane_rules(rules)
    found = _matched(batch, rules).groupBy("rule_id").agg(F.count("*").alias("n"), F.max_by("sample", F.struct("ms", "stream", "line_no")).alias("sample"))
    return found.select(_named(rules).alias("rule"), "rule_id", "n", "sample")


class Rate:
    """The matches of one rule in its window: counts by time, of the latest ``threshold`` matches at most, since older ones
    leave the window first."""

    def __init__(self, threshold: int, window_ms: int, state: str | None = None):
        self.threshold, self.window = threshold, window_ms
        got = json.loads(state) if state else {"times": [], "counts": [], "firing": False, "clock": None}
        self.times, self.counts, self.firing, self.clock = deque(got["times"]), deque(got["counts"]), got["firing"], got["clock"]
        self.total = sum(self.counts)

    def dump(self) -> str:
        return json.dumps({"times": list(self.times), "counts": list(self.counts), "firing": self.firing, "clock": self.clock})

    def add(self, at: int, n: int) -> int | None:
        """Count n matches at a time; the window's sum if the rule fires with them. The window ends at the latest time so
        far, and what is as old as the window still counts; later arrivals count by their own time."""
        self.clock = at if self.clock is None else max(self.clock, at)
        while self.times and self.times[0] < self.clock - self.window:
            self.times.popleft()
            self.total -= self.counts.popleft()
        if self.total < self.threshold:
            self.firing = False  # enough has slid out of the window before these
        if at >= self.clock - self.window:
            place = len(self.times)
            while place and self.times[place - 1] > at:
                place -= 1
            self.times.insert(place, at)
            self.counts.insert(place, n)
            self.total += n
        fires = self.total >= self.threshold and not self.firing
        self.firing = self.total >= self.threshold
        total = self.total
        while self.counts and self.total - self.counts[0] >= self.threshold:
            self.times.popleft()
            self.total -= self.counts.popleft()
        return total if fires else None


def watch_rate(stream: DataFrame, rules: Iterable[Rule], event_time: bool = True) -> DataFrame:
    """rule, rule_id, at_ms, n, sample: a row whenever a rule's matches in its window reach the threshold; it fires again
    only after they have been fewer.

    Matches are dated by their lines' ts and taken in that order, whatever micro-batch they come in; a line without one, or
    each line without event_time, by the latest ts so far or else by the clock. Each partition counts its matches by rule and
    time first; the state of a rule is at most ``threshold`` counts.
    """
    rules = sane_rules(rules)
    limits = {r.place: (r.threshold, r.window * 1000) for r in rules}
    counted = pa.schema([("rule_id", pa.int32()), ("ms", pa.int64()), ("n", pa.int64()), ("sample", pa.string())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int | None], list] = {}  # (rule, ms) -> number, (stream, line_no) of the last line, its sample
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["stream"] or "", row["line_no"] or 0)
                one = sums.setdefault((row["rule_id"], row["ms"] if event_time else None), [0, at, row["sample"]])
                one[0] += 1
                if at >= one[1]:
                    one[1:] = at, row["sample"]
        yield pa.RecordBatch.from_pylist([{"rule_id": rule, "ms": ms, "n": n, "sample": sample} for (rule, ms), (n, _, sample) in sums.items()], schema=counted)

    def slide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rate = Rate(*limits[key[0]], state.get[0] if state.exists else None)
        rows = pd.concat(list(parts))
        dated, undated = rows[rows["ms"].notna()].sort_values("ms", kind="stable"), rows[rows["ms"].isna()]
        arrivals = list(zip(dated["ms"].astype("int64"), dated["n"], dated["sample"], strict=True))
        if len(undated):
            known = [t for t in (rate.clock, arrivals[-1][0] if arrivals else None) if event_time and t is not None]
            now = max(known) if known else state.getCurrentProcessingTimeMs()
            arrivals.append((now, undated["n"].sum(), undated["sample"].iloc[-1]))
        fired = [(int(at), total, sample) for at, n, sample in arrivals if (total := rate.add(int(at), int(n))) is not None]
        state.update((rate.dump(),))
        yield pd.DataFrame({"rule_id": [key[0]] * len(fired), "at_ms": [x[0] for x in fired], "n": [x[1] for x in fired], "sample": [x[2] for x in fired]})

    found = _matched(stream, rules).mapInArrow(count, "rule_id int, ms long, n long, sample string")
    alerts = found.groupBy("rule_id").applyInPandasWithState(slide, "rule_id int, at_ms long, n long, sample string", "rate string", "update", GroupStateTimeout.NoTimeout)
    return alerts.select(_named(rules).alias("rule"), "rule_id", "at_ms", "n", "sample")


def live_histogram(stream: DataFrame, width: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """start, level, n of each window of time, kept current; lines later than the watermark are dropped."""
    rows = stream.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"), F.coalesce("level", F.lit("NONE")).alias("level"))
    return rows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "level", "n")


def live_merge(streams: Mapping[str, DataFrame]) -> DataFrame:
    """Several tailed sources as one stream, to be appended to a table; its order is made on reading, by merge_timeline()'s
    ORDER, so a late line takes its place."""
    return reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(name)) for name, df in streams.items()])


def live_templates(stream: DataFrame) -> DataFrame:
    """template, n, kept current over the lines that start records."""
    heads = stream.filter(~is_continuation(F.col("text")))
    return heads.groupBy(template_of(F.col("text")).alias("template")).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, mode: str, batch=None) -> DataFrame:
    """Run a stream over what there is now and return its rows, with the number of the micro-batch they came in. batch: a
    function of each micro-batch first."""
    spark = stream.sparkSession
    out, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")

    def write(df: DataFrame, number: int) -> None:
        (df if batch is None else batch(df)).withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(out)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
