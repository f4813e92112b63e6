"""The opN_ queries: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import read_digests, write_shards

    return read_digests(write_shards(common.read_columns(spark, sf_dir, "documents", ["doc_id", "text"])))


def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(common.read_columns(spark, sf_dir, "documents", ["doc_id", "text"]))


def op3_maxplus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(common.read_columns(spark, sf_dir, "documents", ["doc_id", "text"]))


def op4_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(common.read_columns(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import features, store_packed

    return features(store_packed(common.read_columns(spark, sf_dir, "documents", ["doc_id", "text"])))


def op6_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(common.read_columns(spark, sf_dir, "pages", ["page_id", "url"]))


def op7_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, read back from the compacted store: its shard, bytes and checksum of the text, and the version."""
    from pyspark.sql import functions as F

    from .compaction import shard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    file = common.unused(docs, "file")
    store, rows = shard(docs, name=file)
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.col(file).alias("shard"), F.lit(store.version()).alias("version"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest

    return digest(common.read_columns(spark, sf_dir, "documents", ["doc_id", "text"]))


def op9_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(common.read_columns(spark, sf_dir, "documents", ["doc_id", "text"]))


def op10_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(common.read_columns(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of op5 that SQL can express."""
    return op5_telephony_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of op6 that SQL can express; the verdict where a rule gives it."""
    from pyspark.sql import functions as F

    return op6_url_words(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the compacted store of op7."""
    from pyspark.sql import functions as F

    from .compaction import shard

    rows = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))[1]
    return rows.select("doc_id", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def personal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of op8 that SQL can express."""
    return op8_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


_T = "coalesce(text, '')"
_BYTES = f"octet_length(encode({_T}))"
_PADDED = f"greatest(64, 64 * ((({_BYTES}) + 63) // 64))"
_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_UNDER = lambda host: f"(host = '{host}' OR host LIKE '%.{host}')"
_RULE = f"""CASE WHEN {_UNDER('example.com')} AND starts_with(path, '/de/') THEN 'example.com/de/' WHEN {_UNDER('example.net')} AND starts_with(path, '/en/') THEN 'example.net/en/'
WHEN {_UNDER('org')} AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN {_UNDER('net')} AND starts_with(path, '/') THEN 'net/' END"""
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST(substr({_DIGITS}, i, 1) AS INT) ELSE (2 * CAST(substr({_DIGITS}, i, 1) AS INT)) % 10 + CAST(substr({_DIGITS}, i, 1) AS INT) // 5 END for i in range(1, length({_DIGITS}) + 1)]) % 10 = 0"

OPERATORS = (op1_wavelet_tokens, op2_circulant_minhash, op3_maxplus_pieces, op4_additive_quantisation, op5_telephony_audio, op6_url_words, op7_size_tiered_shards, op8_personal_data, op9_min_slack_packing, op10_kneser_ney_language)
QUERIES = {f.__name__: f for f in (*OPERATORS, media_payloads, url_rules, shard_rows, personal_counts)}
#: What SQL can express of the operators; tests hold the rest against brute force, round trips and held-out accuracy.
ORACLES: dict[str, str] = {
    "media_payloads": f"SELECT doc_id, CAST({_BYTES} AS BIGINT) AS n_bytes, CAST({_PADDED} AS BIGINT) AS payload_bytes, sha256({_T} || repeat(chr(0), CAST({_PADDED} - {_BYTES} AS BIGINT))) AS payload_sha256, CAST({_PADDED} + 58 AS BIGINT) AS media_bytes FROM documents",
    "url_rules": f"""WITH parts AS (SELECT page_id, coalesce(translate(regexp_extract({_REST}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, {_RULE} AS rule FROM parts) SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS verdict FROM ruled""",
    "shard_rows": "SELECT doc_id, lang, source, CAST(n_chars AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM documents",
    "personal_counts": f"""SELECT doc_id, CAST(len(regexp_extract_all({_T}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
CAST(len([x for x in regexp_extract_all({_T}, '[0-9]+(?:\\.[0-9]+){{3}}') if len([p for p in string_split(x, '.') if length(ltrim(p, '0')) > 3 OR try_cast(right(p, 3) AS INT) > 255]) = 0]) AS BIGINT) AS n_ip,
CAST(len([x for x in regexp_extract_all({_T}, '[0-9](?:[ -]?[0-9])+') if length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}]) AS BIGINT) AS n_card,
CAST(len([x for x in regexp_extract_all({_T}, '\\+[0-9][ ().0-9-]+[0-9]') if length({_DIGITS}) BETWEEN 10 AND 15]) AS BIGINT) AS n_phone FROM documents""",
}
