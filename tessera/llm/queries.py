"""Queries of the corpus operators and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, chaining, context_mixing, edit_counts, exact_dedup, line_crf, merkle, minhash, packing, suffix_dedup, token_files, toxicity, whitening
from tessera.llm.common import documents, scratch_root


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, and what is left of each text as ``text``."""
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).withColumnRenamed("kept", "text")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/tessera-tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(documents(spark, sf_dir), path)
    return token_files.digests(spark, path)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(documents(spark, sf_dir), shingle_words=4, percent=80)


def op5_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.edit_counts(documents(spark, sf_dir))


def op6_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="max")


def op9_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(documents(spark, sf_dir))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(documents(spark, sf_dir))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=4)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_best_fit_packing,
        op3_token_files,
        op4_minhash_near_dedup,
        op5_edit_aware_counts,
        op6_line_crf_quality,
        op7_byte_bpe,
        op8_exact_dedup,
        op9_collinear_chaining,
        op10_context_mixing,
        op11_merkle_manifest,
        op12_embedding_whitening,
        op13_toxicity,
    )
}

ORACLES: dict[str, str] = {
    "op8_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n""",
    # CRC-32 of the decimal id, bit by bit; trees level by level; positions keep their bits, so a sibling is one bit off
    "op11_merkle_manifest": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS row,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 7 = 0 AS hit
  FROM documents),
e AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n0, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n1
  FROM d),
leaves AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS grp, sha256(head || n0 || tail) AS leaf, CASE WHEN hit THEN sha256(head || n1 || tail) ELSE sha256(head || n0 || tail) END AS changed, row FROM e),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
tree AS (
  SELECT grp, 0 AS lvl, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT grp, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, lvl, pos // 2, n),
subroots AS (SELECT grp, h AS subroot, lvl AS height, row_number() OVER (ORDER BY grp) - 1 AS gpos, count(*) OVER () AS groups FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, gpos AS pos, groups AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n),
roots AS (SELECT h AS root, lvl AS height FROM top WHERE n = 1),
fold AS (
  SELECT p.doc_id, p.row, p.grp, p.leaf, s.subroot, r.root, s.gpos, s.height AS own, s.height + r.height AS steps, 0 AS step, p.pos, p.changed AS h, '' AS sibs
  FROM placed p JOIN subroots s USING (grp) CROSS JOIN roots r
  UNION ALL
  SELECT f.doc_id, f.row, f.grp, f.leaf, f.subroot, f.root, f.gpos, f.own, f.steps, f.step + 1, CASE WHEN f.step + 1 = f.own THEN f.gpos ELSE f.pos // 2 END,
         sha256(CASE WHEN f.pos % 2 = 1 THEN coalesce(t.h, u.h) || f.h ELSE f.h || coalesce(t.h, u.h, '') END), f.sibs || coalesce(t.h, u.h, '')
  FROM (SELECT * REPLACE (CASE WHEN step = 0 AND own = 0 THEN gpos ELSE pos END AS pos) FROM fold WHERE step < steps) f
  LEFT JOIN tree t ON f.step < f.own AND t.grp = f.grp AND t.lvl = f.step AND t.pos = xor(f.pos, 1)
  LEFT JOIN top u ON f.step >= f.own AND u.lvl = f.step - f.own AND u.pos = xor(f.pos, 1))
SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, h AS folded_root, h = root AS verified, steps::BIGINT AS n_steps FROM fold WHERE step = steps""",
}
