"""The registered queries of the text operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (
    fertility,
    page_text,
    periodic_runs,
    quality_bayes,
    secret_lexer,
    simhash,
    spans,
    token_counts,
    token_files,
    toxicity,
    url_templates,
    whitening,
    winnowing,
)

BASE_KINDS = ("assign", "access", "hex")


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: What a document has to be to be good.
ASPECTS = ("quality", "harmless")


def aspect_labels(labels: DataFrame) -> DataFrame:
    """``quality`` as labelled, and ``harmless``: not labelled toxic."""
    harmless = F.coalesce("toxic", F.lit(0)) == 0
    return labels.select("doc_id", "quality", harmless.cast("int").alias("harmless"))


def op1_quality_bayes(spark: SparkSession, folder: str) -> DataFrame:
    labels = aspect_labels(_read(spark, folder, "labels"))
    return quality_bayes.classify(_read(spark, folder, "documents"), labels, ASPECTS).drop("text_hash")


def op2_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = winnowing.decontaminate(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = token_files.write_tokens(_read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(manifest)


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    found = spans.encode_decode(_read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        # The spans follow each other from the first byte of the text to its end.
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("bigint").alias("n_bytes"),
    )


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_lexer.find_secrets(_read(spark, folder, "documents"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*BASE_KINDS)
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op7_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.judge_urls(_read(spark, folder, "pages"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.extract(_read(spark, folder, "pages"))


def op10_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.judge(_read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of repeated words of each document, the longest one, and what stays without the repeats.

    One row per document row. NULL and empty texts have no words and no runs: four NULLs and the digests of empty strings. A row
    without doc_id has no planted period.
    """
    found = periodic_runs.find_runs(_read(spark, folder, "documents"), ["doc_id"], prepare=periodic_runs.planted)
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short")))
    best = F.try_element_at(F.array_sort(ranked), F.lit(-1))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.short")
    return rows.select(
        "doc_id",
        "n_runs",
        (-F.col("best.before")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of each document, learned from the labels that are not held out.

    One row per document row. NULL and empty texts score what a text without any telling word does; a row without doc_id is scored and not held out.
    """
    return toxicity.classify(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened components of each vector, as ``whitening.whiten`` defines them for broken, repeated and equal vectors."""
    return whitening.components(whitening.whiten(_read(spark, folder, "embeddings"), ["vec_id"]), ["vec_id"])


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_bayes,
        op2_winnowing,
        op3_simhash,
        op4_token_files,
        op5_sentencepiece,
        op6_secrets,
        op7_url_templates,
        op8_token_counts,
        op9_page_text,
        op10_fertility,
        op11_periodic_runs,
        op12_toxicity,
        op13_whitening,
        pipeline,
    )
}

ORACLES = {
    "op2_winnowing": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
