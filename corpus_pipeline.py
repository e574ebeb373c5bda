"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from huelake.llm import mixing, packing, pii, quality, simhash
from huelake.llm.common import durable, remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Key of the surrogates; a real run passes its own secret.
PII_KEY = b"registered pipeline"
#: Entropy of the source weights over that of equal weights. The budget is the least that
#: holds every document at least once, so mixing repeats small sources and drops nothing.
ENTROPY_RATIO = 0.9
MAX_REPEATS = 4.0
#: Words that a worker remembers while it packs: fewer than by itself, as other stages' workers share its machine.
WORDS = 200_000

#: None: shingle hashes, keyed surrogates and token ids have no SQL form.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """COLUMNS and row_key, a 64-bit hash of them all: doc_id may be null, or shared by different texts."""
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]).alias("row_key"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and whose host does; each by itself, with a null or shared doc_id too."""
    keyed = _keyed(docs)
    kept = quality.judge(keyed, doc_id="row_key").where("kept").select(F.col("doc_id").alias("row_key"))
    return keyed.join(kept, "row_key", "left_semi").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each near-duplicate group, once; a null doc_id comes last.

    Groups depend on the texts alone: different texts stay where they share a doc_id or have none.
    """
    keyed = _keyed(docs)
    found = simhash.near_duplicates(keyed, doc_id="row_key").select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    named = keyed.select("row_key", "doc_id").join(found, "row_key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key")).alias("least"))
    return keyed.join(first.select("least.row_key"), "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data; n_chars follows the text."""
    made = pii.replace_pii(docs.select(*COLUMNS), PII_KEY)
    return made.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks."""
    return mixing.mix(docs.select(*COLUMNS), entropy_ratio=ENTROPY_RATIO, max_repeats=MAX_REPEATS).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memory=WORDS)


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("pii surrogates", pii_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is written as Parquet and read again.

    A stage's folder is deleted once the next one's is whole; the last, which the result reads, when the driver ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    durable(spark.range(0))  # sets the shared folder where the session has none
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.mode("overwrite").parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
        if 0 < i < len(STAGES) - 1:
            remove(spark, f"{folder}/{i - 1}")
    remove(spark, folder, at_exit=True)
    return docs
