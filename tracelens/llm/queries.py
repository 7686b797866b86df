"""The numbered queries: each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelens.llm import decontaminate, exact_dedup, fill_middle, mixing, ngram_join, passages, pii, quality, sentencepiece_codec, suffix_dedup, token_store, url_filter, whitening
from tracelens.llm.common import table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), keep="max")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_store.write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_store.read_tokens(files, token_store.digest, "n_tokens long, ids_crc32 long")


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_of(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_url_filter": op3_url_filter,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_store": op5_token_store,
    "op6_passages": op6_passages,
    "op7_pii": op7_pii,
    "op8_ngram_join": op8_ngram_join,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
    "op11_mixing": op11_mixing,
    "op12_fill_middle": op12_fill_middle,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_mixing": """
        WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
        -- full sources come first by size over weight; the level is that after the last of them
        f AS (SELECT *, 1.5 * sum(source_size) OVER () AS budget, sum(2 * source_size) OVER o AS held, sum(w) OVER () - sum(w) OVER o AS rest, lead(2 * source_size / w) OVER o AS next_full
              FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
        l AS (SELECT coalesce((SELECT min((budget - held)::DOUBLE / rest) FROM f WHERE rest > 0 AND 2 * source_size < (budget - held)::DOUBLE / rest * w AND next_full >= (budget - held)::DOUBLE / rest),
                              (SELECT max(budget)::DOUBLE / sum(w) FROM f)) AS level),
        t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, level * w) AS target FROM s, l),
        p AS (SELECT d.*, source_size, target, epoch, sum(size) OVER (PARTITION BY d.source, epoch ORDER BY substr(md5(epoch || ':' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 15), doc_id, digest ROWS UNBOUNDED PRECEDING)
                     - size + (epoch - 1) * source_size AS before
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, range(1, 3) e(epoch))
        SELECT doc_id, size, source_size, target, sum(greatest(0, least(size, floor(target)::BIGINT - before)))::BIGINT AS taken
        FROM p GROUP BY doc_id, digest, size, source, source_size, target
    """,
    "op12_fill_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS sha FROM documents),
        h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || sha[1:8])::BIGINT AS h1, ('0x' || sha[9:16])::BIGINT AS h2, ('0x' || sha[17:24])::BIGINT AS h3, ('0x' || sha[25:32])::BIGINT AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        x AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
        FROM x
    """,
}
