"""Language identification by compression: the language whose dictionary packs a text smallest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfathom.llm._words import slices

_OTHER = regex.compile(r"\P{L}+")


def letters(text: str) -> str:
    """What is compared: lower case, each run of anything but letters one space."""
    return _OTHER.sub(" ", text.lower()).strip()


def fit_dictionaries(rows: DataFrame, per_language: int = 512, chars: int = 400, size: int = 110_000) -> dict[str, bytes]:
    """A raw-content dictionary of at most ``size`` bytes for each language of rows (doc_id, text, lang), most frequent
    language first.

    The bound: of each language, the ``per_language`` documents with the smallest hashes (rows that a null lang or text
    has are left out), ``chars`` code points of each from its middle. Languages are counted first; by its count, a hash
    threshold lets about four times the wanted number of a language's documents through, and only those are ranked, so
    that what is shuffled does not grow with the input.
    """
    known = rows.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    middle = F.expr(f"substring(text, greatest(1, cast(char_length(text) / 2 - {chars // 2} as int)), {chars})")
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 4 * per_language / n + 64 / n)))])
    tagged = known.select("lang", middle.alias("part"), F.xxhash64("doc_id", "text").alias("h"))
    few = tagged.filter(F.shiftrightunsigned("h", 11) / float(1 << 53) < F.element_at(share, F.col("lang")))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).filter(F.col("rank") <= per_language)
    texts: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", F.col("rank").desc()).collect():
        texts.setdefault(r["lang"], []).append(r["part"])
    order = sorted(texts, key=lambda lang: (-counts[lang], lang))
    return {lang: letters("\n".join(texts[lang])).encode()[-size:] for lang in order}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 9):
        self.langs = list(dictionaries)
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.packers = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language and the margin: by how much of the runner-up's size the best is smaller. Of equal sizes the first
        language given, that is the most frequent, wins."""
        raw = letters(text or "").encode()
        if not self.langs or not raw:
            return "und", 0.0
        sizes = sorted((len(p.compress(raw)), i) for i, p in enumerate(self.packers))
        margin = 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]
        return self.langs[sizes[0][1]], margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score, accepted; one row for each row of docs, from its whole text.

    lang_pred is the language of the smallest encoding, ``und`` if the text is null, empty or without a letter (or no
    language was learned); score is the margin to the second (0 to 1); accepted is false where the margin is under
    ``least_margin`` or lang_pred is und. Equal sizes go to the most
    frequent language. Null and repeated doc_ids stay.
    Extra columns are ignored; an empty table gives no rows.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(dictionaries)
        for batch in (part for x in batches for part in slices(x, "text")):
            got = [own(t) for t in batch.column("text").to_pylist()]
            langs, scores = [x[0] for x in got], [x[1] for x in got]
            fine = [lang != "und" and s >= least_margin for lang, s in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fine, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, accepted boolean")
