"""A training-corpus pipeline over ``documents``: each stage is one of the numbered operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomlake.llm import bpe, decontaminate, ngram_join, secrets, toxicity
from loomlake.llm.common import small_side, table
from loomlake.llm.queries import BPE_FILE
from loomlake.session import materialize


#: Unique number of each row of a stage's input; doc_id may be null or repeated.
ROW = "__row"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a unique row number, written once so that all later reads see the same numbers."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def drop_rows(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """Numbered ``rows`` without those whose numbers are in ``gone``, and without the numbers."""
    return rows.join(small_side(materialize(gone.select(ROW), name)), ROW, "left_anti").select([c for c in rows.columns if c != ROW])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are told to be toxic go. Labels are by doc_id, so the model is trained on that; each row is told on its own."""
    rows, labels = numbered(docs, "toxicity-rows"), table(spark, sf_dir, "labels")
    told = toxicity.toxicity(rows, labels, id_col=ROW, model=toxicity.train(rows, labels))
    return drop_rows(rows, told.where("predicted = 1"), "toxic")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: of the least id, nulls last, and of the least row number among equal ids."""
    rows = numbered(docs, "near-rows")
    groups = materialize(ngram_join.similar_groups(rows, id_col=ROW).select(ROW, "component_id"), "near-groups")
    # a component's least row is its name, so only groups of several rows have others
    several = small_side(materialize(groups.where(F.col(ROW) != F.col("component_id")).select("component_id").distinct(), "near-several"))
    members = groups.join(several, "component_id", "left_semi").join(rows.select(ROW, "doc_id"), ROW)
    members = materialize(members, "near-members")
    least = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("least"))
    stay = materialize(least.select(F.col(f"least.{ROW}").alias(ROW)), "near-stay")
    return drop_rows(rows, members.join(small_side(stay), ROW, "left_anti"), "near")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    rows = numbered(docs, "leak-rows")
    return drop_rows(rows, decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=ROW).where("contaminated"), "leaks")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the new text."""
    found = secrets.find_secrets(docs, secrets.train_model(docs), keep=True)
    found = found.withColumn("clean", F.when(F.col("row.text").isNotNull(), secrets.redacted(F.col("text"), F.col("spans"))))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType)}
    return found.select([new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the cleaned texts, with their number and the hashes of the encoded and decoded texts."""
    return bpe.encode_documents(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, ids=True)


STAGES = [("toxicity", toxicity_stage), ("near_duplicates", near_duplicates_stage), ("decontamination", decontamination_stage), ("secrets", secrets_stage), ("tokens", tokens_stage)]

#: Trained models and byte-pair merges are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written in the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
