"""Corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, secret scans, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; all but
the last return the columns of documents. Stages judge rows, not doc_ids: a row without a doc_id is treated like any
other, two texts under one doc_id are judged apart, and of rows repeated with doc_id and text the near-duplicate stage
keeps one (as of any near copies: the one of the smallest doc_id, nulls last). Null texts pass as empty ones. Empty
tables give empty ones; other columns, whatever their names, go through as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitat_spark.llm import bpe, decontaminate, near_texts, quality_classifier, secrets
from habitat_spark.llm.common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows with a stored number of their own, and that column's name, which no other column has."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), f"{name}-numbered"), row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1. It learns from the documents of the input table."""
    weights = quality_classifier.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    rows = quality_classifier.scored(docs.select("doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")]), weights)
    return rows.filter(F.col(rows.columns[-1]) >= quality_classifier.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, fingerprints: bool = False) -> DataFrame:
    """One row of each component of texts linked at a 5-word Jaccard similarity of 0.8, or by SimHash if asked for: that of the smallest doc_id, nulls last."""
    rows, row = _numbered(docs, "near")
    found = near_texts.near_texts(rows.select(F.col(row).alias("row"), "text"), "row", fingerprints).join(rows.select(F.col(row).alias("row"), "doc_id"), "row")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias(row)).select(row)
    return rows.join(first, row, "left_semi").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stage: links of SimHash and of similarity together."""
    return near_duplicates(spark, docs, sf_dir, fingerprints=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't contaminated by benchmark passages."""
    rows, row = _numbered(docs, "benchmark")
    found = decontaminate.decontaminate(rows.select(F.col(row).alias("doc_id"), "text"), _table(spark, sf_dir, "benchmark"))
    return rows.join(found.filter("contaminated").select(F.col("doc_id").alias(row)), row, "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars counted anew."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, ids, n_tokens, and whether decoding the ids gives the text's bytes again."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    rows = bpe.decode(encoded, ranks)
    same = F.encode(F.coalesce("text", F.lit("")), "UTF-8") == F.col("decoded")
    return rows.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [("quality classifier", quality), ("near duplicates", near_copies), ("decontamination", decontamination), ("secret scans", secret_scans), ("byte-level BPE", byte_bpe)]

#: A trained classifier, XXH64 majorities and ranked merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each one's rows stored before the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
