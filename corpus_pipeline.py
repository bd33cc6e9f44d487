"""From raw documents to token digests: reject, deduplicate, decontaminate, redact, encode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import quality_bayes, secret_lexer, simhash, spans, winnowing
from riskframe.llm.queries import ASPECTS, aspect_labels
from riskframe.session import materialise

#: Names of the helper columns; no table of documents is expected to have such.
ID, TEXT, ROWS = "__decided_doc_id", "__decided_text_hash", "__decided_rows"


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text) is not decided against; all their columns as they are."""
    out = decided.select(F.col("doc_id").alias(ID), F.col("text_hash").alias(TEXT)).distinct()
    return docs.join(out, docs["doc_id"].eqNullSafe(out[ID]) & F.xxhash64("text").eqNullSafe(out[TEXT]), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = aspect_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality_bayes.classify(docs, labels, ASPECTS)
    return _without(docs, materialise(judged.filter(~F.col("accepted")), "rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: of the least doc_id and, if that is repeated, the least text hash."""
    found = simhash.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    # Rows alike in id and text are counted with map-side merging; only where there are any is one chosen.
    alike = found.groupBy("component", "fingerprint", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    chosen = alike.groupBy("component", "fingerprint").agg(first, F.min_by("rows", F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("rows"))
    chosen = chosen.groupBy("component").agg(F.min(F.struct("first", "rows")).alias("kept"))
    stays = chosen.select(F.col("kept.first.doc_id").alias(ID), F.col("kept.first.text_hash").alias(TEXT), F.col("kept.rows").alias(ROWS))
    stays = materialise(stays, "stays")

    def kept(keys: DataFrame) -> DataFrame:
        hashed = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
        return docs.join(keys, docs["doc_id"].eqNullSafe(keys[ID]) & hashed.eqNullSafe(keys[TEXT]), "left_semi")

    once = kept(stays.filter(F.col(ROWS) == 1))
    repeated = stays.filter(F.col(ROWS) > 1)
    if repeated.isEmpty():
        return once
    return once.unionByName(kept(repeated).dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated with benchmark items go."""
    found = winnowing.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.filter("contaminated").select("doc_id", "text_hash")
    out = materialise(gone, "contaminated").select(F.col("doc_id").alias(ID), F.col("text_hash").alias(TEXT))
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(out, docs["doc_id"].eqNullSafe(out[ID]) & (hashed == out[TEXT]), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; a mark stands in place of each secret."""
    return secret_lexer.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document and the bytes they stand for, and a digest of the decoded text."""
    found = spans.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "ids", "begins", "ends", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: The classifier, the links and the pieces are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
