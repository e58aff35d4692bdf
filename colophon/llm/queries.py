"""Queries over the test tables, one for each operator, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, embedding_dedup, exact_dedup, importance_resampling, language_id, license_scan, mixing, near_dedup, prefix_hashes, sentencepiece_nbest, source_divergence, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents")).drop("row", "row2")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest_conversations(chat.with_forged(_table(spark, sf_dir, "conversations")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.encode_documents(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hashes.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


_ALL = [op1_license_scan, op2_mixing, op3_toxicity, op4_near_dedup, op5_chat_format, op6_language_id, op7_embedding_dedup, op8_warc, op9_sentencepiece, op10_exact_dedup, op11_fingerprints, op12_importance_resampling, op13_source_divergence]
QUERIES = {f.__name__: f for f in _ALL}

ORACLES = {
    "op1_license_scan": license_scan.oracle(),
    "op12_importance_resampling": importance_resampling.ORACLE,
    "op13_source_divergence": source_divergence.ORACLE,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op5_chat_format": r"""
        WITH r AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(role) + length(regexp_replace(role, M, 'xx', 'g')) - length(regexp_replace(role, M, 'x', 'g')) AS role_chars,
                     length(text) + length(regexp_replace(text, M, 'xx', 'g')) - length(regexp_replace(text, M, 'x', 'g')) AS text_chars
              FROM (SELECT *, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|role\|>|<\|text\|>|<\|end\|>|<\|im_start\|>|<\|im_end\|>' AS M FROM r))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(text_chars + 1 + CASE role WHEN 'assistant' THEN 7 WHEN 'user' THEN 13 WHEN 'system' THEN 15 ELSE 23 + role_chars END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
        p AS MATERIALIZED (
          SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
          AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
        c AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id,
               vec_id = least(vec_id, coalesce(c.b, vec_id)) AS kept
        FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op8_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d""",
    "op2_mixing": """
        WITH RECURSIVE d AS (
          SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '/' || coalesce(text, ''))) AS h,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
          FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
                     sum(source_size) OVER () AS total FROM s),
        capped AS (
          SELECT source, source_size, weight, 3 * source_size AS cap, total,
                 source_size / weight AS ratio FROM w),
        o AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
                     sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
              FROM capped),
        l AS (SELECT *, CAST(remaining AS DOUBLE) / CAST(weights AS DOUBLE) AS level FROM o),
        r AS (SELECT arg_min(level, ratio) AS rate FROM l WHERE cap > level * weight),
        t AS (SELECT source, source_size,
                     CASE WHEN cap > level * weight THEN (SELECT rate FROM r) * weight ELSE CAST(cap AS DOUBLE) END AS target FROM l),
        q AS (SELECT d.doc_id, d.source, d.size, d.h, t.source_size, t.target,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT q.*, k, CAST(k * source_size + upto AS DOUBLE) / target AS finish
              FROM q, range(3) AS passes(k) WHERE size > 0 AND target > 0),
        m AS (SELECT doc_id, source, size, sum(size) OVER (ORDER BY finish, h, doc_id, k, size ROWS UNBOUNDED PRECEDING) AS run
              FROM c),
        n AS (SELECT doc_id, source, size, sum(size) AS taken FROM m WHERE run <= (SELECT sum(size) FROM d) GROUP BY ALL)
        SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(n.taken, 0) AS BIGINT) AS taken, q.source
        FROM q LEFT JOIN n ON q.doc_id = n.doc_id AND q.source IS NOT DISTINCT FROM n.source AND q.size = n.size""",
}
