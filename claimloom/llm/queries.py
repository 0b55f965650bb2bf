"""The opN_<name> queries: each applies one operator to its whole table and returns its full result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import bpe, credentials, kdshards, langid, mixing, quotes, syncmers, topk
from claimloom.llm.minhash import near_duplicates
from claimloom.llm.substrings import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The byte-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return os.environ.get("BYTE_BPE_PATH") or public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return near_duplicates(_table(spark, sf_dir, "documents"), k=2)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products among all other rows, for each row whose id is divisible by 50."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message in its thread, without quotes."""
    return quotes.reply_ordered(quotes.link_quotes(_table(spark, sf_dir, "conversations")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four folds of five."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that also start in a document with a smaller id."""
    return remove_repeats(_table(spark, sf_dir, "documents"), length=50).drop("kept_text")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix by source weights takes, and which shards draw them."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", mixing.digest("draws").alias("draws"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with linked credentials."""
    return credentials.find_secrets(_table(spark, sf_dir, "documents"))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 24 of near equal bytes."""
    sharded = kdshards.shard(_table(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return syncmers.fingerprints(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_language_id": op5_language_id,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_secret_scan": op8_secret_scan,
    "op9_kd_sharding": op9_kd_sharding,
    "op10_closed_syncmers": op10_closed_syncmers,
}

_WORD = r"'[^\x20\x09-\x0D]+'"

#: Words, shingles and windows by joins: fit for the tables that the comparison reads, not for large ones.
ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS ws FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 1 THEN ws ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END)) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op2_exact_top_k": """
        WITH v AS (
          SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op6_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
        places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50),
        windows AS (SELECT doc_id, p, sha256(array_to_string(ws[p : p + 49], ' ')) AS h FROM places),
        gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE low < doc_id),
        covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM gone),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
}
