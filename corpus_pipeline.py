"""The corpus pipeline: toxicity, SimHash near-dedup, suffix-array dedup, benchmark decontamination and
SentencePiece encoding, each over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A stage's text changes take effect for the next, and n_chars follows the text. Null ids:
such a row is never dropped as a near-duplicate, as nothing names it; rows with equal ids count as one
document. A document that loses all its text stays, with an empty text."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guildspark.llm import decontaminate, sentencepiece_trie, simhash, suffixes, toxicity
from guildspark.llm.common import cut, fresh, read

TOXIC_FROM = 0.3
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity")
    return toxicity.with_score(docs, model, name=score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(docs)
    gone = groups.where("id <> component").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, c = suffixes.deduplicate(docs, as_text=True)
    changed = {"text": F.col(c["kept"])}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size(c["removed"]) > 0, F.length(c["kept"]).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = sentencepiece_trie.encode(docs, VOCABULARY)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_strings),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Neither a trained model nor XXH64 is in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
