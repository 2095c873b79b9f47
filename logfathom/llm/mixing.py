"""Soft-membership mixing in Spark SQL: domain posteriors from a labelled table, document rates by least squares.

The classifier is naive Bayes over binned figures of a text: rates of symbols, capitals, digits and line ends, how many
of its words are repeats, and how many words it has of each domain's lexicon. The rates x minimize the squared distance
of the expected domain totals, sum over documents of x * tokens * posterior, from their targets under x >= 0, by projected
gradient steps from x = 1. What those leave over, at targets out of reach or nearly so, an active set of a few documents
takes up, until no rates are proved to come nearer. The gradient for a document, by token, is posterior . residual, so
documents with equal posteriors keep equal rates: their tokens are summed first, and a step is one pass of partial sums
over those sums. The driver holds just vectors and matrices of domains.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfathom.llm._shared import stage

_STRATUM, _UNIT_BITS = 1 << 12, 16

_CUTS = {"symbols": [0.002, 0.01, 0.03, 0.1], "capitals": [0.01, 0.05, 0.15, 0.4], "digits": [0.001, 0.01, 0.05], "breaks": [0.002, 0.008, 0.02], "repeats": [0.2, 0.4, 0.6, 0.8], "marks": [0.001, 0.01, 0.05]}


def _distinct_words(text: str = "text") -> Column:
    """The distinct runs of letters of a text, lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), "")


def _hashed(c: str = "doc_id") -> Column:
    return F.xxhash64(c)


def lexicons(docs: DataFrame, labelled: DataFrame, per_domain: int = 2000, words: int = 100) -> dict[str, list[str]]:
    """For each domain the words most tied to it (likelihood ratio), at most ``words``, from a bounded sample: of each
    domain the ``per_domain`` labelled documents with the smallest hashes of doc_id."""
    kinds = sorted(r[0] for r in labelled.select("domain").distinct().collect())  # the domains that have a target
    if len(kinds) < 2:
        return {d: [] for d in kinds}
    sample = reduce(DataFrame.union, [labelled.filter(F.col("domain") == d).orderBy(_hashed(), "doc_id").limit(per_domain) for d in kinds])
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    seen = stage(texts.select("domain", _distinct_words().alias("w")), "lexicon-sample")
    sizes = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    counts = seen.select("domain", F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"in_{i}") for i, d in enumerate(kinds)]).filter("n >= 3")
    out = {}
    for i, d in enumerate(kinds):
        share = sizes.get(d, 0) / total if total else 0
        if not 0 < share < 1:
            out[d] = []
            continue
        a, n = F.col(f"in_{i}").cast("double"), F.col("n").cast("double")
        gain = 2 * (a * F.log(F.greatest(a, F.lit(1e-9)) / (n * share)) + (n - a) * F.log(F.greatest(n - a, F.lit(1e-9)) / (n * (1 - share))))
        top = counts.filter(a > n * share).withColumn("gain", gain).filter(F.col("gain") > 30).orderBy(F.desc("gain"), "w").limit(words)
        out[d] = sorted(r["w"] for r in top.select("w").collect())
    return out


def features(docs: DataFrame, lexicon: Mapping[str, list[str]]) -> DataFrame:
    """doc_id, tokens (words) and an array of bin numbers for every row; a null text is empty."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.greatest(F.char_length("text"), F.lit(1))
    count = lambda chars: F.regexp_count("text", F.lit(f"[{chars}]"))
    classes = {"symbols": "#*$%&|<>", "capitals": "A-Z", "digits": "0-9", "breaks": r"\n", "marks": "!?"}
    bare = F.btrim("text", F.lit(" \t\n\v\f\r"))
    tokens = F.when(bare != "", F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")
    plain = t.select("doc_id", *[(count(v) / n).alias(k) for k, v in classes.items()], tokens.alias("tokens"), _distinct_words().alias("w"))
    plain = plain.withColumn("repeats", 1 - F.size("w") / F.greatest("tokens", F.lit(1)))
    bins = [reduce(lambda a, b: a + b, [F.when(F.col(c) > x, 1).otherwise(0) for x in cuts]) for c, cuts in _CUTS.items()]
    for d in sorted(lexicon):
        hits = F.size(F.array_intersect("w", F.array(*[F.lit(w) for w in lexicon[d]]))) if lexicon[d] else F.lit(0)
        bins.append(F.least(hits, F.lit(3)))
    return plain.select("doc_id", "tokens", F.array(*bins).alias("bins"))


def posteriors(feats: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """feats with p, the array of posteriors by domain (in the order given), from all labelled rows. Bins are counted
    with 0.5 added; without any labelled row all domains are alike."""
    width = len(_CUTS) + len(domains)
    rows = feats.join(labelled, "doc_id").select("domain", F.posexplode("bins")).groupBy("domain", "pos", "col").agg(F.count("*").alias("n")).collect()
    counts = np.full((len(domains), width, 5), 0.5)
    for r in rows:
        counts[domains.index(r["domain"]), r["pos"], r["col"]] += r["n"]
    sizes = counts[:, 0, :].sum(axis=1)
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    prior = np.log(sizes / sizes.sum())
    scores = []
    for i in range(len(domains)):
        parts = [F.element_at(F.array(*[F.lit(float(x)) for x in logs[i, f]]), F.col("bins")[f] + 1) for f in range(width)]
        scores.append(reduce(lambda a, b: a + b, parts, F.lit(float(prior[i]))))
    top = feats.withColumn("s", F.array(*scores)).withColumn("m", F.array_max("s"))
    powers = top.withColumn("e", F.transform("s", lambda x: F.exp(x - F.col("m"))))
    whole = powers.withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return whole.select("doc_id", "tokens", F.transform("e", lambda x: x / F.col("z")).alias("p"))


def _dot(v) -> Column:
    return reduce(lambda a, b: a + b, [F.col("p")[i] * float(m) for i, m in enumerate(v)])


@dataclass(frozen=True)
class Rates:
    """Rates of documents by their posteriors ``p``: a share of those after projected gradient ``steps`` from 1 (length and
    move of each), and more for the ``corners`` (posteriors and rate)."""

    steps: tuple[tuple[float, tuple[float, ...]], ...] = ()
    share: float = 1.0
    corners: tuple[tuple[tuple[float, ...], float], ...] = ()

    def column(self) -> Column:
        x = F.lit(1.0)
        if self.steps:
            steps = F.array(*[F.struct(F.lit(length).alias("length"), F.array(*[F.lit(float(a)) for a in move]).alias("move")) for length, move in self.steps])
            slope = lambda s: reduce(lambda a, b: a + b, [F.col("p")[i] * s["move"][i] for i in range(len(self.steps[0][1]))])
            x = F.aggregate(steps, x, lambda x, s: x + s["length"] * (F.greatest(F.lit(0.0), x - slope(s)) - x))
        each = [F.when(F.col("p") == F.array(*[F.lit(a) for a in p]), F.lit(rate)) for p, rate in self.corners]
        return x * self.share + (F.coalesce(*each, F.lit(0.0)) if each else 0.0)

    def of(self, p: np.ndarray) -> np.ndarray:
        """column() of rows of posteriors, in numpy."""
        x, more = np.ones(len(p)), dict(self.corners)
        for length, move in self.steps:
            x = x + length * (np.maximum(0.0, x - p @ np.array(move)) - x)
        return x * self.share + np.array([more.get(tuple(row), 0.0) for row in p.tolist()])


def project(members: DataFrame, goal: np.ndarray, tolerance: float, most_steps: int = 40) -> tuple[Rates, np.ndarray]:
    """Projected gradient steps towards ``goal`` over members (tokens, p), each one pass, until the totals are within
    ``tolerance`` or there were ``most_steps``: the rates and their totals.

    A step goes along the projection of the gradient, at the spectral (Barzilai-Borwein) rate of the step before, as far
    as the distance falls, which for a square is known from the totals of the projection.
    """
    k, t = len(goal), F.col("tokens")
    p = [F.col("p")[i] for i in range(k)]
    number = lambda row: np.array([float(y or 0.0) for y in row])
    first = number(members.agg(*[F.sum(t * a) for a in p], *[F.sum(t * a * b) for a in p for b in p]).first())
    at, pace = first[:k], 1 / max(float(np.linalg.norm(first[k:].reshape(k, k), 2)), 1e-300)
    steps: list[tuple[float, tuple[float, ...]]] = []
    while np.linalg.norm(at - goal) > tolerance and len(steps) < most_steps:
        move = tuple(float(a) for a in pace * (at - goal))
        moved = members.withColumn("x", Rates(tuple(steps)).column()).withColumn("d", F.greatest(F.lit(0.0), F.col("x") - _dot(move)) - F.col("x"))
        got = number(moved.agg(F.sum(t * F.col("d") * F.col("d")), *[F.sum(t * F.col("d") * a) for a in p]).first())
        turn = got[1:]
        fall = float(turn @ turn)
        if fall <= 0 or got[0] <= 0:
            break
        length = min(1.0, -float((at - goal) @ turn) / fall)
        steps.append((length, move))
        at, pace = at + length * turn, float(got[0]) / fall
    return Rates(tuple(steps)), at


def settle(members: DataFrame, goal: np.ndarray, rates: Rates, at: np.ndarray, tolerance: float, most_passes: int = 500) -> tuple[Rates, float, bool]:
    """``rates`` (with totals ``at``) scaled and given more of single documents, so that no rates over members (tokens, p)
    come nearer to ``goal``; the distance left, and whether it is proved to be within ``tolerance`` of the least.

    An active set: a pass finds the document whose tokens lower the distance most; it joins the few that the driver weighs
    anew, never more than domains. Proof: no rates bring more tokens to their nearest point than sqrt(k) |goal|, and no
    token lowers half the squared distance by more than its document's -posterior . residual.
    """
    reach = float(np.sqrt(len(goal)) * np.linalg.norm(goal))
    some = members.filter("tokens > 0")
    points: list[tuple[tuple[float, ...] | None, float, np.ndarray]] = []  # posteriors (None: all rates), tokens, totals
    mass = np.zeros(0)
    if np.linalg.norm(at - goal) <= tolerance:
        return rates, float(np.linalg.norm(at - goal)), True
    if at @ goal > 0:
        points, mass = [(None, 1.0, at)], np.array([at @ goal / (at @ at)])
    for _ in range(most_passes):
        sums = np.array([x[2] for x in points]).T @ mass if points else np.zeros(len(goal))
        residual = sums - goal
        off = float(np.linalg.norm(residual))
        slope = _dot(residual)
        lowest, found = some.agg(F.min(slope), F.min_by(F.struct("p", "tokens"), F.struct(slope, "p"))).first() if off > tolerance else (0.0, None)
        gap = float(residual @ sums) + max(0.0, -float(lowest or 0.0)) * reach
        weights = {p: float(m / t) for (p, t, _), m in zip(points, mass, strict=True)}
        got = Rates(rates.steps, weights.pop(None, 0.0), tuple(weights.items()))
        if off <= tolerance or gap <= tolerance * off / 2:
            return got, off, True
        points, mass = [*points, (tuple(found["p"]), float(found["tokens"]), np.array(found["p"]))], np.append(mass, 0.0)
        while True:
            best = np.linalg.lstsq(np.array([x[2] for x in points]).T, goal, rcond=None)[0]
            if (best > 0).all():
                mass = best
                break
            out = best <= 0
            part = np.where(out, mass / np.maximum(mass - best, 1e-300), np.inf)
            mass = mass + part.min() * (best - mass)
            keep = np.arange(len(mass)) != int(np.argmin(part))
            points, mass = [x for x, k in zip(points, keep, strict=True) if k], mass[keep]
            if not points:
                return got, off, False
    return got, off, False


def solve(members: DataFrame, targets: list[float], tolerance: float = 1e-6) -> tuple[Rates, float, bool]:
    """Rates of least distance for members (tokens, p), the distance left (as a share of all targets) and whether it is
    proved to be within ``tolerance`` of the least."""
    scale = max(sum(targets), 1.0)
    goal = np.array(targets, float) / scale
    alike = stage(members.groupBy("p").agg((F.sum("tokens") / scale).alias("tokens")), "posteriors-summed")
    return settle(alike, goal, *project(alike, goal, tolerance), tolerance)


def whole_copies(found: DataFrame) -> DataFrame:
    """found (doc_id, tokens, p, rate) with copies, rates rounded down or up so that no domain's tokens stray far.

    Documents are put in order by likeliest domain and length; a document gets as many copies as the running sum of rates
    passes whole numbers in it. As lengths in order hardly differ, what is rounded up and down nearly cancels: a domain is
    off by about its longest document. Sums run inside strata of some 4,096 documents (a domain, a power of two of tokens
    and a share of hashes) and are carried over by one row a stratum.
    """
    kind = F.array_position("p", F.array_max("p")).cast("int")
    rows = found.withColumns({"__kind": kind, "__class": F.length(F.bin("tokens")), "__hash": F.xxhash64("doc_id", "p", "tokens"), "__fixed": F.round(F.col("rate") * (1 << _UNIT_BITS)).cast("long")})
    counts = rows.groupBy("__kind", "__class").agg(F.ceil(F.count("*") / _STRATUM).alias("__parts"))  # at most 64 rows a domain
    rows = rows.join(F.broadcast(counts), ["__kind", "__class"]).withColumn("__part", F.pmod("__hash", "__parts"))
    stratum = ["__kind", "__class", "__part"]
    order = Window.partitionBy("__kind").orderBy(F.desc("__class"), "__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*stratum).agg(F.sum("__fixed").alias("__sum")).withColumn("__start", F.coalesce(F.sum("__sum").over(order), F.lit(0))).drop("__sum")
    running = F.sum("__fixed").over(Window.partitionBy(*stratum).orderBy(F.desc("tokens"), "__hash", "doc_id", "p").rowsBetween(Window.unboundedPreceding, 0))
    got = rows.withColumn("__to", running).join(sums, stratum).withColumn("__to", F.col("__to") + F.col("__start"))
    copies = F.shiftright("__to", _UNIT_BITS) - F.shiftright(F.col("__to") - F.col("__fixed"), _UNIT_BITS)
    return got.select(*found.columns, copies.alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], total: float | None = None) -> DataFrame:
    """doc_id, tokens, rate, copies and p_<domain>; one row for each row of docs.

    labelled: doc_id, domain; of several labels of one doc_id the first by name counts, rows with a null or with a domain
    that ``weights`` lacks are left out. ``weights`` (normalized) times ``total`` tokens (None: as many as docs has) are
    the targets. copies is rate rounded down or up, see whole_copies(). A null text is empty and of no tokens; null and
    repeated doc_ids stay, and rows repeated share a rate, though not always copies. Without labels all domains are alike.
    Extra columns are ignored; an empty table gives no rows. Rates that are not proved to be the best raise an error. A
    hot domain or source costs no task more: all sums are partial first.
    """
    domains = sorted(weights)
    single = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    lexicon = lexicons(docs, single)
    feats = stage(features(docs, {d: lexicon.get(d, []) for d in domains}), "features")
    members = stage(posteriors(feats, single, domains), "posteriors")
    if total is None:
        total = float(members.agg(F.sum("tokens")).first()[0] or 0)
    whole = sum(weights.values())
    targets = [weights[d] / whole * total for d in domains]
    rates, left, proved = solve(members, targets)
    if not proved:
        raise RuntimeError(f"mixing: the rates found leave {left:.3g} of all tokens off the targets, and it is not proved that none do better")
    found = whole_copies(members.withColumn("rate", rates.column()))
    return found.select("doc_id", "tokens", "rate", "copies", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)])


def mixed(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], total: float | None = None) -> DataFrame:
    """The rows of docs, each as many times as mix() says (rows with one doc_id: the most that it says for any), with all
    their columns and texts as they are, null ones too. An empty table gives no rows."""
    found = mix(docs, labelled, weights, total).groupBy("doc_id").agg(F.max("copies").alias("copies"))
    times = found.filter("copies > 0").select(F.col("doc_id").alias("__of_doc"), F.col("copies").alias("__copies"))
    joined = docs.join(times, docs.doc_id.eqNullSafe(F.col("__of_doc")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labels table: toxic, else by quality good or low; rows with a null that matters have none."""
    quality = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, quality).alias("domain"))
