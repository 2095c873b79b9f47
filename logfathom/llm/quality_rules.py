"""Quality rules with adaptive thresholds: fences from mergeable quantile sketches by language and source.

Everything is Spark SQL expressions: the figures of a text come from its own words by array functions, a KLL sketch by
(language, source) and by language merges them, and the fences go back to the documents by a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.llm._shared import stage

#: The rates that the rules judge, and those that most documents have none of, whose tail tells more than their quartiles.
RULES = ["symbol_rate", "word_length", "dup_line_rate", "repeat_rate"]
_RARE, _TAIL = ("dup_line_rate", "repeat_rate"), 0.98
_WORD = r"[^\\x20\\x09-\\x0D]+"


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text."""
    base = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    words = base.select("doc_id", "lang", "source", "text", F.expr(rf"regexp_extract_all(text, '{_WORD}', 0)").alias("words"))
    # The hash of each five-word window and its place, in order of the hashes, so that equal windows are neighbours.
    windows = words.select(
        "doc_id", "lang", "source",
        F.expr("cast(size(words) as bigint)").alias("n_words"),
        F.expr("cast(char_length(array_join(words, '')) as bigint)").alias("word_chars"),
        F.expr("cast(char_length(text) - char_length(translate(text, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr(rf"filter(split(text, '\\n', -1), x -> x rlike '{_WORD}')").alias("lines"),
        F.expr("""array_sort(transform(slice(words, 1, greatest(size(words) - 4, 0)), (x, i) ->
            named_struct('h', xxhash64(x, words[i + 1], words[i + 2], words[i + 3], words[i + 4]), 'i', i)))""").alias("w"),
    )
    # Windows equal to the one before or after them; w[j - 1] at j = 0 is left out, w[j + 1] at the end is null.
    twice = windows.withColumn("p", F.expr("""array_sort(transform(filter(
        transform(w, (x, j) -> named_struct('i', x.i, 't', coalesce(x.h = if(j > 0, w[j - 1].h, null), false) or coalesce(x.h = try_element_at(w, j + 2).h, false))),
        x -> x.t), x -> x.i))"""))
    return twice.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr("cast(aggregate(zip_with(p, slice(p, 2, greatest(size(p) - 1, 0)), (a, b) -> least(coalesce(b - a, 5), 5)), 0, (s, x) -> s + x) as bigint)").alias("n_repeat_words"),
    )


def _rates(df: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1))
    return df.withColumns({
        "symbol_rate": F.col("n_symbols") / n, "word_length": F.col("word_chars") / n,
        "dup_line_rate": F.col("n_dup_lines") / n * 10.0, "repeat_rate": F.col("n_repeat_words") / n,
    })


def quality_filter(docs: DataFrame, spread: float = 3.0, prior: float = 20.0, k: int = 400, explain: bool = False) -> DataFrame:
    """The figures of every document and whether it is kept; one row for each row of docs.

    base_failed: fewer than 10 words, or over 20 % of the words in five-word windows that the text has twice. Of the
    documents that pass, each rate in RULES must not be over its fence; word_length has a lower fence as well. A group's
    fence is q3 + max(spread * (q3 - q1), tail), with a tail of half as much again as the 98th percentile is over q3 for
    repeated lines and words, which most documents have none of, else spread times the way from the median to the nearer
    of the 5th and 95th percentiles (so that a group with many bad documents doesn't widen its fence): where q1 = q3 = 0,
    no symbols at all. All quantiles are from KLL sketches of size k (exact for up to k documents, rank error about 2.3 / k
    beyond), which merge: by language and source, by language, and of all. A document's fence is the mean of its
    group's, counted by the group's documents, and its language's, counted as ``prior`` documents; a language's is the mean
    of its own and that of all in the same way. So a small source leans on its language without any cutoff.

    A null lang or source is a value of its own. A null text has no words (and fails). Repeated rows count each; ties change
    nothing; extra columns are ignored; no rows give no rows. explain adds a column for each rule: over_<rule>, and under
    for too short words.
    """
    got = stage(figures(docs), "figures")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    got = _rates(got.withColumn("base_failed", failed))
    # Three levels in one pass over the documents: sketches by language and source, which merge by language and of all.
    fine = got.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias(c) for c in RULES])
    fine = stage(fine, "sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(c).alias(c) for c in RULES]]

    def fence(c: str, up: bool) -> Column:
        q = lambda x: F.kll_sketch_get_quantile_double(F.col(c), F.lit(x))
        tail = 1.5 * (q(_TAIL) - q(0.75)) if c in _RARE else spread * F.least(q(0.95) - q(0.5), q(0.5) - q(0.05))
        room = F.greatest(spread * (q(0.75) - q(0.25)), tail)
        return q(0.75) + room if up else q(0.25) - room

    fences = {**{f"most_{c}": fence(c, True) for c in RULES}, "least_word_length": fence("word_length", False)}
    level = lambda df, *keys: df.select(*keys, "n", *[f.alias(name) for name, f in fences.items()])
    lean = lambda own, n, wide: (own * n + wide * prior) / (n + prior)
    whole = level(fine.agg(*merged).filter("n > 0")).first() if not fine.isEmpty() else None  # five numbers
    coarse = level(fine.groupBy("lang").agg(*merged), "lang")
    coarse = coarse.select(F.col("lang").alias("of_lang"), *[lean(F.col(c), F.col("n"), F.lit(whole[c] if whole else None).cast("double")).alias(f"wide_{c}") for c in fences])
    own = level(fine, "lang", "source")
    both = own.join(coarse, own.lang.eqNullSafe(coarse.of_lang)).select("of_lang", F.col("source").alias("of_source"), *[lean(F.col(c), F.col("n"), F.col(f"wide_{c}")).alias(c) for c in fences])
    joined = got.join(both, got.lang.eqNullSafe(both.of_lang) & got.source.eqNullSafe(both.of_source), "left")
    out = {f"over_{c}": F.coalesce(F.col(c) > F.col(f"most_{c}"), F.lit(False)) for c in RULES} | {"under_word_length": F.coalesce(F.col("word_length") < F.col("least_word_length"), F.lit(False))}
    kept = ~F.col("base_failed") & ~reduce(lambda a, b: a | b, out.values())
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *([c.alias(name) for name, c in out.items()] if explain else []))
