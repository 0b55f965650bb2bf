"""Documents to training tokens: languages, near duplicates, secrets, source weights, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; all but the last return the columns
of documents. Null texts, and texts without a letter, are rejected by the first stage; empty tables stay empty; extra columns
are carried along, whatever their names. Ids may be null or shared: the stage that joins rows gives each row an own key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import bpe, credentials, langid, mixing
from claimloom.llm.minhash import near_duplicates
from claimloom.llm.queries import tokenizer_path
from claimloom.llm.storage import forget, stored


def _recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where it is there, of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


#: An own key of each row, and a hash of its id and text that reruns agree on.
ROW, TURN = "claimloom_row", "claimloom_turn"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ROW and TURN, as a table, so that a row has one key wherever it is read."""
    return stored(docs.withColumns({ROW: F.monotonically_increasing_id(), TURN: F.xxhash64("doc_id", "text")}))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; those that it rejects go."""
    return langid.keep_identified(docs, langid.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Null ids come last, and rows of one id that are no near duplicates all stay.
    """
    keyed = _keyed(docs)
    groups = near_duplicates(keyed, ROW, k=5, percent=80).select(F.col(ROW).alias("of_row"), "component_id")
    members = keyed.select(ROW, TURN, "doc_id").join(groups, F.col(ROW) == F.col("of_row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", TURN, ROW))
    kept = members.groupBy("component_id").agg(first.alias("first")).select(F.col(f"first.{ROW}").alias("kept_row"))
    return keyed.join(kept, F.col(ROW) == F.col("kept_row"), "left_semi").drop(ROW, TURN)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked credentials replaced by their kind."""
    return _recounted(credentials.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source weights takes them, shard after shard; the last draw of a source may take part of a document."""
    return _recounted(mixing.materialised(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit integers), and whether they decode to the text."""
    path = tokenizer_path()
    plain = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    coded = bpe.encode_and_decode(plain, path)
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("language ID", identify_languages),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

#: Compression, MinHash links and byte-pair merges are not SQL: tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as a table and read back."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
