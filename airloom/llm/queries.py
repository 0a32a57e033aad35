"""The operators applied to the whole given tables, and the SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm import (bpe, embedding, exact_dedup, license_scan, lm_score, merkle, mixing, quality, secrets, simhash,
                         token_files, url_filter, whitening)

Query = Callable[[SparkSession, str], DataFrame]
RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENISER = "byte_bpe_50k.json"
TARGETS = {"en": 0.5, "fr": 0.2, "de": 0.18, "es": 0.12}

# The rules that urls are judged by.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Domain of the documents that the table of labels covers: their language."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("domain"))
    return docs.join(table(spark, folder, "labels").select("doc_id").distinct(), "doc_id", "left_semi")


def id_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score_texts(table(spark, folder, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"))


def op3_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "layers", "oversize")


def op4_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, folder, "documents"), license_scan.notices(spark))


def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding.near_vectors(table(spark, folder, "embeddings"))


def listed_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Urls to refuse: pages whose path ends in the number of a document labelled toxic."""
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?\z", 1).try_cast("long")
    toxic = table(spark, folder, "labels").where("toxic = 1").select("doc_id").distinct()
    return table(spark, folder, "pages").select("url", number.alias("doc_id")).join(toxic, "doc_id", "left_semi").select("url")


def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, folder, "pages"), listed_urls(spark, folder), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_mixing_to_targets(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), labelled_domains(spark, folder), TARGETS)


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    coded = bpe.round_trip(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", id_digest(F.col("ids")).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows, fitted, error = whitening.whiten(table(spark, folder, "embeddings"))
    shares = fitted.explained if fitted else []
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n if fitted else 0).cast("long").alias("n"),
                       F.col("deviation").cast("long").alias("deviation"), "whitened",
                       F.array(*map(F.lit, shares)).cast("array<double>")[F.col("at")].alias("explained"),
                       F.lit(error).alias("identity_error"))


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    made = token_files.write_token_files(table(spark, folder, "documents"), public_tokenizers.path(TOKENISER))
    return token_files.read_files(made).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Proofs of all documents, checked against documents of which some have lost their line ends."""
    lossy = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(lossy, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = [shown if f == "text" else F.col(f) for f in merkle.FIELDS]
    made = merkle.build_manifest(table(spark, folder, "documents"), also={"shown": merkle.leaf(fields)})
    checked = merkle.verify(made.proofs(), "shown")
    return checked.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root",
                          merkle.path_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def reachable(query: Query) -> Query:
    """Python workers of a session started elsewhere find the package, too."""
    root = str(Path(__file__).resolve().parents[2])

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        known = spark.sparkContext.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
        return query(spark, folder)

    return run


QUERIES: dict[str, Query] = {q.__name__: reachable(q) for q in (
    op1_lm_scoring, op2_simhash_near_dedup, op3_secret_scans, op4_license_scans, op5_embedding_near_dedup, op6_url_filters,
    op7_quality_classifier, op8_mixing_to_targets, op9_byte_bpe, op10_exact_dedup,
    op11_embedding_whitening, op12_token_files, op13_merkle_manifest)}

def _told(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


# Whether crc32 of the decimal doc_id is even: every byte (and after it eight shifts, written as -1) in turn.
_EVEN = """(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
            FOR b IN string_split(doc_id::VARCHAR, '')])), LAMBDA crc, b: CASE WHEN b >= 0 THEN xor(crc, b)
            ELSE xor(crc >> 1, (crc & 1) * 3988292384) END) & 1) = 1"""
_FIELDS = ("doc_id", "source", "lang", "n_chars")

ORACLE: dict[str, str] = {
    "op6_url_filters": """
        WITH p AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
                   FROM pages),
        h AS (SELECT page_id, rest, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
                     regexp_extract(coalesce(rest, ''), '^[^?#]*\\?([^#]*)', 1) AS query FROM p),
        c AS (SELECT *, [x FOR x IN string_split(query, '&') IF x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)(=|\\z)')] AS q
              FROM h),
        k AS (SELECT *, CASE WHEN regexp_replace(host, '^www\\.', '') <> '' THEN regexp_replace(host, '^www\\.', '') || rtrim(path, '/') ||
                     CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canon,
                     try_cast(regexp_extract(path, '/([0-9]{1,18})(?:\\.html)?/?\\z', 1) AS BIGINT) AS doc_id FROM c),
        listed AS (SELECT DISTINCT canon FROM k WHERE canon IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
        r AS (SELECT * FROM (VALUES ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'),
                     ('block', 'example.org', '/en/1', 'example.org/en/1'), ('allow', 'com', '/fr/', 'com/fr/'),
                     ('block', 'com', '/de/', 'com/de/')) AS t(verdict, rule_host, rule_path, rule)),
        f AS (SELECT k.*, (SELECT arg_max({'rule': r.rule, 'verdict': r.verdict}, length(r.rule)) FROM r
                           WHERE (k.host = r.rule_host OR ends_with(k.host, '.' || r.rule_host))
                           AND starts_with(k.path, r.rule_path)) AS best FROM k)
        SELECT page_id, host, path, best.rule AS rule,
               coalesce(best.verdict, CASE WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
        FROM f""",
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY text)""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, source, sha256(concat_ws('', {', '.join(map(_told, (*_FIELDS, 'text')))})) AS leaf, sha256(concat_ws('', {', '.join(map(_told, (*_FIELDS, 'shown_text')))})) AS shown
            FROM (SELECT *, CASE WHEN {_EVEN} THEN replace(text, chr(10), '') ELSE text END AS shown_text FROM documents)),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY source) AS held FROM leaves),
        up AS (
            SELECT source, pos, leaf AS digest, 0 AS height, held FROM placed
            UNION ALL
            SELECT source, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), height + 1, (held + 2) // 3
            FROM up WHERE held > 1 GROUP BY source, pos // 3, height, held),
        tops AS (
            SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS held
            FROM up WHERE held = 1),
        over AS (
            SELECT pos, subroot AS digest, 0 AS height, held FROM tops
            UNION ALL
            SELECT pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), height + 1, (held + 2) // 3
            FROM over WHERE held > 1 GROUP BY pos // 3, height, held),
        steps AS (
            SELECT p.source, p.pos, u.height,
                   coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos < p.pos // (3 ** u.height)::BIGINT), '') AS before,
                   coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos > p.pos // (3 ** u.height)::BIGINT), '') AS after
            FROM placed p JOIN up u ON p.source IS NOT DISTINCT FROM u.source AND u.held > 1
                 AND u.pos // 3 = (p.pos // (3 ** u.height)::BIGINT) // 3
            GROUP BY p.source, p.pos, u.height
            UNION ALL
            SELECT p.source, p.pos, 1000 + u.height,
                   coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos < t.pos // (3 ** u.height)::BIGINT), ''),
                   coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos > t.pos // (3 ** u.height)::BIGINT), '')
            FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source
                 JOIN over u ON u.held > 1 AND u.pos // 3 = (t.pos // (3 ** u.height)::BIGINT) // 3
            GROUP BY p.source, p.pos, u.height),
        ordered AS (
            SELECT source, pos, height, before, after, row_number() OVER (PARTITION BY source, pos ORDER BY height) AS step
            FROM steps),
        fold AS (
            SELECT source, pos, 0 AS step, shown AS digest FROM placed
            UNION ALL
            SELECT f.source, f.pos, f.step + 1, sha256(concat(o.before, f.digest, o.after))
            FROM fold f JOIN ordered o ON f.source IS NOT DISTINCT FROM o.source AND f.pos = o.pos AND o.step = f.step + 1),
        ends AS (SELECT source, pos, arg_max(digest, step) AS folded_root FROM fold GROUP BY source, pos),
        proofs AS (SELECT source, pos, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM ordered GROUP BY source, pos)
        SELECT p.doc_id, p.leaf, t.subroot, r.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
               e.folded_root, e.folded_root = r.digest AS verified
        FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source
        JOIN ends e ON p.source IS NOT DISTINCT FROM e.source AND p.pos = e.pos
        LEFT JOIN proofs q ON p.source IS NOT DISTINCT FROM q.source AND p.pos = q.pos
        CROSS JOIN (SELECT digest FROM over WHERE held = 1) r""",
}
