"""The registered queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accord.llm import bpe, factors, jaccard, knn, manifest, mixing, pii, quality, repeats, shards, tokens, toxicity, trie
from accord.llm.common import read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


# What each query gives for null and empty texts, ties, repeated rows, other columns and empty tables is told where its
# operator is: section_tokens, digest, top_k, manifest and encode_documents.


def op1_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op2_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def op3_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return knn.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.manifest(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read(spark, sf_dir, "documents"))


def byte_bpe(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs; null texts count as empty, repeated rows have equal results."""
    encoded = bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, decode=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digest(read(spark, sf_dir, "conversations"))


def op13_quality_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_section_tokens, op2_pii_sanitisation, op3_pivot_search, op4_suffix_dedup, op5_quality_rules, op6_jaccard_join, op7_toxicity, op8_training_order, op9_source_mixing, op10_byte_bpe, op11_merkle_manifest, op12_prefix_trie, op13_quality_factors)
}

#: The CRC-32 of the decimal {0}, bit by bit.
CRC = """xor(list_reduce([4294967295] || [CAST((ascii(CAST({0} AS VARCHAR)[1 + i // 8]) >> (i % 8)) & 1 AS BIGINT) FOR i IN range(8 * length(CAST({0} AS VARCHAR)))],
    lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""


def _item(value: str) -> str:
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_item, ('CAST(doc_id AS VARCHAR)', 'source', 'lang', 'CAST(n_chars AS VARCHAR)', text)))})"


#: The levels of a tree over {0} (k, pos, h, n), and each node's siblings.
_TREE = """
{1} AS (
  SELECT 0 AS level, k, pos, h, n FROM {0}
  UNION ALL
  SELECT level + 1, k, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM {1} WHERE n > 1 GROUP BY level, k, pos // 3
), {1}_sides AS (
  SELECT level, k, pos, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {1} WHERE n > 1 WINDOW run AS (PARTITION BY level, k, pos // 3 ORDER BY pos)
)"""

#: {0} (id, k, pos, h, proof) led upwards by the siblings of {1}; a row for each step, the last one being the result.
_WALK = """
{2} AS (
  SELECT id, k, pos, h, proof, 0 AS level FROM {0}
  UNION ALL
  SELECT w.id, w.k, w.pos // 3, sha256(s.l || w.h || s.r), w.proof || s.l || s.r, w.level + 1
  FROM {2} w JOIN {1}_sides s ON s.level = w.level AND s.k = w.k AND s.pos = w.pos
)"""

SQL: dict[str, str] = {
    "op3_pivot_search": """
WITH fine AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
    CAST(list_sum([q.v[i] * x.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM fine q JOIN fine x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE given AS (
  SELECT doc_id, coalesce('=' || source, '-') AS k, {_leaf("text")} AS leaf,
    CASE WHEN ({CRC.format("doc_id")}) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS changed FROM documents
), leaves AS (
  SELECT *, row_number() OVER (ORDER BY k, doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM given
), nodes AS (SELECT k, pos, leaf AS h, n FROM leaves
), {_TREE.format("nodes", "tree")},
subroots AS (SELECT 0 AS k, row_number() OVER (ORDER BY k) - 1 AS pos, h, count(*) OVER () AS n, k AS source FROM tree WHERE n = 1
), {_TREE.format("subroots", "crown")},
starts AS (SELECT id, k, pos, coalesce(changed, leaf) AS h, '' AS proof FROM leaves
), {_WALK.format("starts", "tree", "walk")},
halfway AS (SELECT w.id, 0 AS k, s.pos, w.h, w.proof FROM (SELECT id, arg_max(k, level) AS k, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM walk GROUP BY id) w JOIN subroots s ON s.source = w.k
), {_WALK.format("halfway", "crown", "climb")},
done AS (SELECT id, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climb GROUP BY id)
SELECT l.doc_id, l.leaf, s.h AS subroot, c.h AS root, sha256(d.proof) AS proof_sha256, d.h AS folded_root, d.h = c.h AS verified
FROM leaves l JOIN done d USING (id) JOIN subroots s ON s.source = l.k JOIN (SELECT h FROM crown WHERE n = 1) c ON true
""",
    "op12_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(x ORDER BY turn NULLS FIRST, s) AS turns, CAST({CRC.format("conv_id")} % 6 AS BIGINT) AS h FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), []), coalesce(list_slice(c.turns, c.h + 1, len(c.turns)), [])) AS turns
  FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), begun AS (SELECT conv_id, len(turns) AS length, d, list_slice(turns, 1, d) AS path FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = d), '')) AS ends FROM begun GROUP BY d, path
), children AS (SELECT d - 1 AS d, list_slice(path, 1, d - 1) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), sized AS (SELECT x.*, coalesce(c.n, 0) AS n_children, CASE WHEN x.d = 0 THEN 0 ELSE (x.n - 1) * length(x.path[x.d].t) END AS own FROM nodes x LEFT JOIN children c ON c.d = x.d AND c.path = x.path
), under AS (
  SELECT v.d, v.path, count(*) FILTER (u.n_children = 0) AS n_leaves, sum(u.own) AS saved FROM nodes v JOIN sized u ON u.d >= v.d AND list_slice(u.path, 1, v.d) = v.path GROUP BY v.d, v.path
)
SELECT s.conv_id, CAST(s.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, s.n AS n_convs, s.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, s.ends AS ends_sha256
FROM sized s JOIN under u ON u.d = s.d AND u.path = s.path LEFT JOIN nodes p ON p.d = s.d - 1 AND p.path = list_slice(s.path, 1, s.d - 1)
""",
}
