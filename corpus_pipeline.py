"""A corpus pipeline: toxicity, near-duplicates, decontamination, secrets, tokens.

Each stage takes the documents that its predecessor kept and returns documents,
the last one their tokens. Between stages the documents are written as Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, decontamination, near_dedup, secrets, toxicity
from marlstone.llm.fitting import remainder
from marlstone.llm.runtime import mark, release, stash, table

TOXIC_FROM = 0.7
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The classifier learns from two thirds of the labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return toxicity.keep_clean(docs, model, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id stays: five-word shingles, similarity of 0.8 or more.

    Rows of one doc_id are one document: of those that stay, the row with the smallest text does. Rows without a doc_id all stay.
    """
    gone = near_dedup.near_duplicates(docs, words=5, percent=80).filter("NOT kept").select("doc_id").distinct()
    several = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    repeated = docs.join(several, "doc_id", "left_semi").join(gone, "doc_id", "left_anti").select("doc_id", F.struct(*docs.columns).alias("row"))
    one = repeated.groupBy("doc_id").agg(F.min_by("row", F.struct("row.text", F.to_json("row"))).alias("row")).select("row.*")
    return docs.join(gone.unionByName(several), "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def count_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text they decode to."""
    path, pattern = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN
    decoded = bpe.round_trip(docs, path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", count_tokens),
]
#: The toxicity classifier and the merges of the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, began = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        release(spark, began, docs)  # what went before is not read again
    return STAGES[-1][1](spark, docs, sf_dir)
