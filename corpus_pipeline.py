"""Cleaning pipeline over documents: toxicity, quality rules, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and decides on all rows its predecessor kept; ``run`` writes each stage's result
as parquet in the shared folder and reads it again.  All stages but the last return the columns of documents.

Cases: null and empty texts fail the quality rules (no words) and go; rows with null doc_id are no duplicates of
anything and stay; of rows that repeat a doc_id one stays, chosen by a hash of its columns; without labels toxicity keeps all rows
and the quality rules decide by their base alone; columns beside doc_id, text and n_chars are passed on as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.llm import near_dedup, packing, quality_rules, substring_dedup, toxicity
from framefold.llm.common import table
from framefold.session import materialize, temporary_tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of at least 0.5 go; without labels of both classes none does."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    if not model.weights.any():
        return docs
    return docs.where(toxicity.score_column(model, F.col("text")) < 0.5)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are mostly boilerplate lines go."""
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_rules.rules_column(model, F.col("text"))["kept"])


def _names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their 5-word shingles, directly or through others, the smallest doc_id stays."""
    found = materialize(near_dedup.near_duplicates(docs.select("doc_id", "text")).select("doc_id", "kept"))
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    gone = ids.where("not kept").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti").select(*_names(docs))
    repeated = materialize(ids.where("kept and n > 1").select("doc_id"))
    if repeated.isEmpty():
        return left
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "doc_id"))
    row = F.min_by(rest, F.sha2(F.to_json(rest), 256)).alias("r")
    single = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(row).select("doc_id", "r.*")
    return left.join(repeated, "doc_id", "left_anti").select(*_names(docs)).unionByName(single)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by 20-word windows that also start earlier are cut; what is left is joined by single spaces."""
    found = substring_dedup.substring_dedup(docs.select("doc_id", "text")).where("kept_text is not null and doc_id is not null")
    cut = found.groupBy("doc_id").agg(F.min("kept_text").alias("kept_text")).alias("cut")
    changed, whole = F.col("cut.kept_text").isNotNull(), docs.alias("whole")
    new = {"text": F.col("cut.kept_text"), "n_chars": F.length("cut.kept_text")}
    columns = [F.when(changed, new[f.name].cast(f.dataType)).otherwise(F.col(f"whole.`{f.name}`")).alias(f.name) if f.name in new
               else F.col(f"whole.`{f.name}`") for f in docs.schema.fields]
    return whole.join(cut, F.col("whole.doc_id") == F.col("cut.doc_id"), "left").select(*columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 2,048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("packing", pack_sequences),
]

# Trained models, shingle similarity and tokenizers have no SQL counterpart; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with temporary_tables(spark):
            docs = materialize(stage(spark, docs, sf_dir), lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
