"""A corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, tokenization.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each
is written as Parquet and read again as the next one's docs.

All columns of documents pass through, whatever their names. A null text stays null until passages are taken out, and is
an empty one from then on; a null doc_id is an id of its own kind, and rows repeated are copies of each other. Texts of any
length are taken whole. An empty table gives an empty table of the same columns. What each stage does with each of these is
said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logfathom.llm._shared import stage
from logfathom.llm.bpe_chunks import encode_documents
from logfathom.llm.mixing import domains_of, mixed
from logfathom.llm.probminhash import one_of_each
from logfathom.llm.queries import _tokenizer
from logfathom.llm.substring_dedup import without_repeats
from logfathom.llm.toxicity import fit, grades, reject_toxic

#: Shares of tokens after mixing. Toxic documents have gone before, so that domain has no target.
TARGETS = {"good": 0.92, "low": 0.08}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression flags as toxic go. Null, empty and blank texts stay, as texts without any of
    the model's words; copies go or stay together; without labels all stay."""
    return reject_toxic(docs, fit(docs, grades(_labels(spark, sf_dir))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest doc_id (nulls come last; of several texts
    with that doc_id the one whose MD5 is smallest; of rows repeated one). Null, empty and blank texts are alike to none
    and all stay."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words that start earlier too are taken out of the texts; all documents stay, a text that was nothing
    but repeats as an empty one, a null text as an empty one, and a text of fewer than 20 words as it is."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out at the rates that bring the domains' tokens to their target shares. Texts without
    words have no tokens and go by the rate of their posteriors; without labels all documents stay once."""
    return mixed(docs, domains_of(_labels(spark, sf_dir)), TARGETS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row for each row; an empty text has no tokens."""
    return encode_documents(docs, _tokenizer())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("encoding", encoding)]

#: SQL can't express the learned and hashed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
