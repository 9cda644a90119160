"""The corpus operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, counts, decontaminate, exact, language, licenses, pieces, sharding, simhash, warc

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's exact group over normalised whole texts."""
    return exact.exact_groups(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each document, and whether they decode to its text."""
    return pieces.round_trip(_documents(spark, sf_dir))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's SimHash fingerprint and near-duplicate component."""
    return simhash.near_groups(_documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record, written to archives and read back."""
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return sharding.assign(_documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that stand in a window of a benchmark item."""
    found = decontaminate.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("whole_window")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each conversation, formatted to token ids, written and read back."""
    return chat.digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens, before and after edits that are counted by what they touch."""
    return counts.revised(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of each document."""
    return language.predictions(_documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and texts in each document."""
    return licenses.scan(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_exact_dedup,
    op2_sentencepiece,
    op3_simhash_near_dedup,
    op4_warc,
    op5_benchmark_decontamination,
    op6_sharding,
    op7_chat_format,
    op8_token_counts,
    op9_language_id,
    op10_license_scan,
)}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        ), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
    "op5_benchmark_decontamination": f"""
        WITH i AS (
            SELECT item_id, ws, least(13, len(ws)) AS n FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0
        ), w AS (
            SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS win
            FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS s FROM i)
        ), d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents
        ), dw AS (
            SELECT r, n, s, array_to_string(ws[s:s + n - 1], ' ') AS win
            FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM w))
        ), h AS (SELECT DISTINCT r, s, dw.n, dw.win FROM dw JOIN w ON w.win = dw.win
        ), c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r
        ), l AS (
            SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
            FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h JOIN w USING (win)) GROUP BY r
        )
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r)
    """,
    "op10_license_scan": licenses.scan_sql(_WORDS),
    "op7_chat_format": chat.digests_sql(),
    "op4_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
        ), f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, payload_bytes, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> last THEN last END AS refers_to, CAST(NULL AS VARCHAR) AS problem,
            array_to_string(flatten(list_transform(range(0, 40, 5), lambda k: list_transform([15, 10, 5, 0], lambda s:
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(CAST('0x' || h[k + 1:k + 5] AS INT) >> s) % 32 + 1]))), '') AS payload_digest
        FROM f
    """,
}
