"""The registered queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfathom.llm.simple8b import token_files

    return token_files(_table(spark, sf_dir, "documents"), _tokenizer())


def op3_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfathom.llm.bpe_chunks import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), _tokenizer())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfathom.llm.substring_dedup import dedup_passages

    return dedup_passages(_table(spark, sf_dir, "documents"))


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfathom.llm.probminhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfathom.llm.oph_fingerprint import fingerprint_documents

    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfathom.llm.toxicity import fit, grade_documents, grades

    docs = _table(spark, sf_dir, "documents")
    return grade_documents(docs, fit(docs, grades(_table(spark, sf_dir, "labels"))))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfathom.llm.language_id import fit_dictionaries, identify

    docs = _table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    found = identify(docs, fit_dictionaries(docs.filter(fold != 0)))
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfathom.llm.warc_zip import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Target shares of tokens for mixing.
MIX = {"good": 0.85, "low": 0.1, "toxic": 0.05}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfathom.llm.mixing import domains_of, mix

    return mix(_table(spark, sf_dir, "documents"), domains_of(_table(spark, sf_dir, "labels")), MIX)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfathom.llm.quality_rules import quality_filter

    return quality_filter(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfathom.llm.prefix_trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations")).drop("enter", "exit")


def op12_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfathom.llm.decontamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfathom.llm.dual_tree import rank_documents

    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_warc_zip": op1_warc_zip,
    "op2_language_id": op2_language_id,
    "op3_bpe_chunks": op3_bpe_chunks,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mixing": op5_mixing,
    "op6_fingerprints": op6_fingerprints,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_probminhash": op9_probminhash,
    "op10_token_files": op10_token_files,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_suffix_arrays": op12_suffix_arrays,
    "op13_dual_tree": op13_dual_tree,
}

#: Words in DuckDB, as op12 and op13 take them.
_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The others can't be said in SQL: they hash, learn, or run a tokenizer. Tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": """
WITH t AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS r
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS turns, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y // 2, 3988292384 * (y % 2)))), 4294967295) % 6 AS h
  FROM t GROUP BY conv_id),
i AS (SELECT c.*, least(c.h, coalesce(b.turns, 0)) AS taken FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
rebuilt AS (
  SELECT i.conv_id, t.r AS pos, t.k, t.chars FROM i JOIN t ON t.conv_id = i.base AND t.r < i.taken
  UNION ALL SELECT i.conv_id, i.taken + t.r - i.h, t.k, t.chars FROM i JOIN t ON t.conv_id = i.conv_id AND t.r >= i.h),
path AS (
  SELECT conv_id, pos + 1 AS depth, md5(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS node, chars, count(*) OVER (PARTITION BY conv_id) = pos + 1 AS last FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM c),
nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM path GROUP BY depth, node),
up AS (SELECT n.depth, n.node, p.conv_id AS parent FROM nodes n JOIN path q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 JOIN nodes p ON p.depth = q.depth AND p.node = q.node),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM up GROUP BY ALL),
below AS (
  SELECT q.depth, q.node, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM nodes n JOIN path q ON q.conv_id = n.conv_id AND q.depth <= n.depth LEFT JOIN kids k ON k.parent = n.conv_id AND k.depth = n.depth GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.parent AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN up USING (depth, node) LEFT JOIN kids k ON k.parent = n.conv_id AND k.depth = n.depth JOIN below b ON b.depth = n.depth AND b.node = n.node""",
    "op12_suffix_arrays": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_TERMS}, []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_TERMS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM b WHERE len(w) > 0)),
places AS (
  SELECT rid, size, s, array_to_string(w[s : s + size - 1], ' ') AS words
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
hits AS (SELECT p.rid, p.size, p.s, x.item FROM places p JOIN windows x ON x.size = p.size AND x.words = p.words),
covered AS (SELECT rid, count(DISTINCT s + j) AS n FROM (SELECT rid, s, unnest(range(size)) AS j FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)""",
    "op13_dual_tree": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
totals AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS length FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
tf AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, docs),
scores AS (
  SELECT item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), totals GROUP BY item_id, rid, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10""",
}
