"""The thin queries of the operators and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    exact_dedup,
    fill_in_middle,
    jaccard_join,
    language_id,
    packing,
    pii,
    piece_codec,
    prefix_trie,
    quality_pu,
    quality_rules,
    simhash_trie,
    substring_dedup,
    toxicity,
)
from .common import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op4_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.quality_scores(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_long_repeats(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.simhash_near_duplicates(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents")))


_ALL = (
    op1_language_id, op2_packing, op3_exact_dedup, op4_quality_pu, op5_quality_rules, op6_piece_codec, op7_substring_dedup,
    op8_pii, op9_jaccard_join, op10_toxicity, op11_simhash_trie, op12_prefix_trie, op13_fill_in_middle,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS kept,
       s AS text_sha256
FROM n""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY x) AS n FROM k) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(35) AS t(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS rest
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, list({'s': sha256(length(r)::VARCHAR || ':' || r || x), 'n': length(x)}
                       ORDER BY turn NULLS FIRST, sha256(length(r)::VARCHAR || ':' || r || x)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id),
-- The CRC-32 of the decimal conv_id: each byte is met with the register, then eight bits are shifted out.
crc AS (
  SELECT conv_id, (xor(list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda acc, b: xor(xor(acc, b) >> 1, 3988292384 * (xor(acc, b) & 1))), 4294967295) % 6)::BIGINT AS h
  FROM own),
rebuilt AS (
  SELECT own.conv_id, list_concat(coalesce(list_slice(base.turns, 1, h), []), list_slice(own.turns, h + 1, len(own.turns))) AS turns
  FROM own JOIN crc USING (conv_id) LEFT JOIN own AS base ON base.conv_id = own.conv_id - own.conv_id % 100),
p AS (
  SELECT conv_id, d, array_to_string(list_transform(list_slice(turns, 1, d), lambda t: t.s), '') AS k, turns[d].n AS n,
         array_to_string(list_transform(list_slice(turns, 1, d - 1), lambda t: t.s), '') AS up, d = len(turns) AS last
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT k, min(conv_id) AS conv_id, min(d) AS depth, min(up) AS up, count(*) AS n_convs, min(n) AS n,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends
  FROM p GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY up),
full_node AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children, coalesce((n_convs - 1) * n, 0) AS saved FROM node LEFT JOIN kids USING (k)),
-- A node's ancestors are the prefixes of its own path, itself included.
below AS (
  SELECT substr(k, 1, 64 * unnest(range(0, depth + 1))::BIGINT) AS k, n_children = 0 AS leaf, saved FROM full_node),
sums AS (SELECT k, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM below GROUP BY k)
SELECT a.conv_id, a.depth::BIGINT AS depth, CASE WHEN a.depth > 0 THEN b.conv_id END AS parent_conv_id, a.n_convs::BIGINT AS n_convs,
       a.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, a.ends AS ends_sha256
FROM full_node AS a JOIN sums ON sums.k = a.k LEFT JOIN node AS b ON b.k = a.up""",
    "op13_fill_in_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (
  SELECT *, ('0x' || substr(s, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(s, 9, 8))::BIGINT % (n + 1) AS b,
         ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM t),
f AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (SELECT *, substr(x, 1, lo) AS p, substr(x, lo + 1, hi - lo) AS m, substr(x, hi + 1) AS q FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM parts""",
}
