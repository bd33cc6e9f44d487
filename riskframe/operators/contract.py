"""Model-ready datasets and the checks that they keep their contract."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from riskframe.functions.rowwise import MISSING_CATEGORY
from riskframe.operators.fitted import AmountThresholds, fill_categories
from riskframe.operators.profile import union_all
from riskframe.spec import TableSpec

# Versions, dataset names and policies of the feature contract.
PROCESSING_VERSION = "riskframe-preprocess-1.0.0"
FEATURE_SCHEMA_VERSION = "riskframe-features-1.0.0"
TRAIN_DATASETS = ("train_original", "train_weighted", "train_balanced")
DATASETS = (*TRAIN_DATASETS, "validation", "holdout", "unlabelled")
UNLABELLED_DATASETS = ("unlabelled",)
WEIGHTED_DATASETS = ("train_weighted",)
METADATA = ("split_name", "processing_version", "feature_schema_version", "generated_at")
NUMBER_POLICY = "median fitted on chronological training split"
TEXT_POLICY = f"{MISSING_CATEGORY} category"


def model_columns(df: DataFrame, spec: TableSpec, with_label: bool = True) -> DataFrame:
    """Id, label, numeric features as double, categorical features without NULL."""
    numeric = [c for c in spec.numeric_features if c in df.columns]
    text = [c for c in spec.categorical_features if c in df.columns]
    label = [spec.label] if with_label and spec.label in df.columns else []
    chosen = df.select(spec.id, *label, *[F.col(c).cast("double").alias(c) for c in numeric], *text)
    return fill_categories(chosen, text)


def stamp(
    df: DataFrame,
    dataset: str,
    spec: TableSpec,
    generated_at: str | None = None,
) -> DataFrame:
    """Add the metadata columns; drop label and weight where the dataset may not have them."""
    at = generated_at or datetime.now(timezone.utc).isoformat()
    stamped = df.withColumns(
        {
            "split_name": F.lit(dataset),
            "processing_version": F.lit(PROCESSING_VERSION),
            "feature_schema_version": F.lit(FEATURE_SCHEMA_VERSION),
            "generated_at": F.lit(at),
        }
    )
    if dataset in UNLABELLED_DATASETS:
        stamped = stamped.drop(spec.label)
    if dataset not in WEIGHTED_DATASETS:
        stamped = stamped.drop("class_weight")
    return stamped


def feature_columns(df: DataFrame, spec: TableSpec) -> list[str]:
    other = {spec.id, spec.label, "class_weight", *METADATA}
    return [c for c in df.columns if c not in other]


def schema_hash(df: DataFrame) -> str:
    """SHA-256 of the column names and types."""
    records = [{"name": name, "type": kind} for name, kind in df.dtypes]
    return hashlib.sha256(json.dumps(records, sort_keys=True).encode()).hexdigest()


def feature_catalog(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Name, kind and missing-value policy of every feature the table has, and
    whether it is ready for training: no NULL left in any row."""
    rows = F.count(F.lit(1))
    entries = []
    for names, kind, policy in (
        (spec.numeric_features, "numeric", NUMBER_POLICY),
        (spec.categorical_features, "categorical", TEXT_POLICY),
    ):
        for name in names:
            if name in df.columns:
                entries.append(
                    F.struct(
                        F.lit(name).alias("feature_name"),
                        F.lit(kind).alias("feature_type"),
                        F.lit(policy).alias("missing_value_policy"),
                        ((rows > 0) & (F.count(name) == rows)).alias("training_ready"),
                    )
                )
    return df.agg(F.array(*entries).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def dataset_manifest(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and schema digest of every dataset."""
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("dataset"),
                "rows",
                F.lit(len(df.columns)).alias("columns"),
                F.lit(schema_hash(df)).alias("schema_hash"),
            )
            for name, df in datasets.items()
        ]
    )


def split_overlap(frames: Mapping[str, DataFrame], id_column: str) -> DataFrame:
    """Shared ids of every pair of splits, from one grouping by id."""
    names = list(frames)
    tagged = union_all(
        [
            df.select(F.col(id_column).alias("id"), *[F.lit(int(n == name)).alias(n) for n in names])
            for name, df in frames.items()
        ]
    )
    member = tagged.filter(F.col("id").isNotNull()).groupBy("id").agg(*[F.max(n).alias(n) for n in names])
    pairs = [
        F.struct(
            F.lit(a).alias("left_split"),
            F.lit(b).alias("right_split"),
            F.count(F.when((F.col(a) == 1) & (F.col(b) == 1), 1)).alias("shared_ids"),
        )
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    ]
    return member.agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def leakage_check(
    train: DataFrame, stored: AmountThresholds, recomputed: AmountThresholds, dataset: str = "train"
) -> DataFrame:
    """Compare stored thresholds with a refit on the training rows."""
    rows = [
        Row(name=name, stored=float(getattr(stored, name)), refit=float(getattr(recomputed, name)))
        for name in ("p25", "p75", "p95", "p99", "iqr", "upper_cap")
    ]
    table = train.sparkSession.createDataFrame(rows, "name string, stored double, refit double")
    return table.select(
        F.lit(dataset).alias("fit_scope"), "name", "stored", "refit", (F.col("stored") == F.col("refit")).alias("ok")
    )


def contract_checks(datasets: Mapping[str, DataFrame], spec: TableSpec, manifest: Mapping[str, Row] | None = None) -> DataFrame:
    """All contract checks as one tidy table ``(dataset, check_name, expected, actual, ok)``.

    Schema checks need no data. Counts, distinct ids, versions and time bounds
    come from one aggregation per dataset, id overlap from one grouping by id.
    """
    spark = next(iter(datasets.values())).sparkSession
    expected_features = next(
        feature_columns(df, spec) for name, df in datasets.items() if name not in UNLABELLED_DATASETS
    )
    schema_rows: list[tuple[str, str, str, str, bool]] = []

    def note(dataset: str, check: str, expected: object, actual: object) -> None:
        schema_rows.append((dataset, check, str(expected).lower(), str(actual).lower(), expected == actual))

    for name, df in datasets.items():
        features = feature_columns(df, spec)
        note(name, "has_id", True, spec.id in df.columns)
        note(name, "has_label", name not in UNLABELLED_DATASETS, spec.label in df.columns)
        note(name, "has_weight", name in WEIGHTED_DATASETS, "class_weight" in df.columns)
        note(name, "feature_count", len(spec.features), len(features))
        note(name, "features_unique", len(features), len(set(features)))
        note(name, "feature_order", True, features == expected_features)
    checks = [
        spark.createDataFrame(
            schema_rows, "dataset string, check_name string, expected string, actual string, ok boolean"
        )
    ]
    checks += [_data_checks(name, df, spec, (manifest or {}).get(name)) for name, df in datasets.items()]
    checks.append(_overlap_checks(datasets, spec))
    checks.append(_order_checks(datasets, spec))
    return union_all(checks)


def _check(dataset: str, name: str, expected, actual, ok):
    return F.struct(
        F.lit(dataset).alias("dataset"),
        F.lit(name).alias("check_name"),
        expected.cast("string").alias("expected"),
        actual.cast("string").alias("actual"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
    )


def _explode(df: DataFrame, checks: Sequence) -> DataFrame:
    return df.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def _data_checks(name: str, df: DataFrame, spec: TableSpec, listed: Row | None) -> DataFrame:
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(spec.id).alias("ids"),
        F.min("processing_version").alias("p_low"),
        F.max("processing_version").alias("p_high"),
        F.min("feature_schema_version").alias("s_low"),
        F.max("feature_schema_version").alias("s_high"),
    )
    checks = [
        _check(name, "non_empty", F.lit("true"), F.col("rows") > 0, F.col("rows") > 0),
        _check(name, "unique_ids", F.col("rows"), F.col("ids"), F.col("rows") == F.col("ids")),
    ]
    for label, version, low, high in (
        ("processing_version", PROCESSING_VERSION, "p_low", "p_high"),
        ("feature_schema_version", FEATURE_SCHEMA_VERSION, "s_low", "s_high"),
    ):
        one = (F.col(low) == version) & (F.col(high) == version)
        checks.append(_check(name, label, F.lit(version), F.col(low), one))
    if listed is not None:
        checks.append(_check(name, "manifest_rows", F.lit(listed["rows"]), F.col("rows"), F.col("rows") == listed["rows"]))
        digest = schema_hash(df)
        same = F.lit(digest == listed["schema_hash"])
        checks.append(_check(name, "manifest_schema", F.lit(listed["schema_hash"]), F.lit(digest), same))
    return _explode(facts, checks)


def _split_frames(datasets: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    chosen = {"train": "train_original", "validation": "validation", "holdout": "holdout"}
    return {split: datasets[name] for split, name in chosen.items() if name in datasets}


def _overlap_checks(datasets: Mapping[str, DataFrame], spec: TableSpec) -> DataFrame:
    shared = F.col("shared_ids")
    return split_overlap(_split_frames(datasets), spec.id).select(
        F.concat_ws("/", "left_split", "right_split").alias("dataset"),
        F.lit("no_shared_ids").alias("check_name"),
        F.lit("0").alias("expected"),
        shared.cast("string").alias("actual"),
        (shared == 0).alias("ok"),
    )


def _order_checks(datasets: Mapping[str, DataFrame], spec: TableSpec) -> DataFrame:
    frames = _split_frames(datasets)
    names = list(frames)
    at = F.col(spec.time).cast("bigint")
    tagged = union_all([df.select(F.lit(n).alias("split"), at.alias("at")) for n, df in frames.items()])
    bounds = tagged.agg(
        *[F.min(F.when(F.col("split") == n, F.col("at"))).alias(f"{n}_min") for n in names],
        *[F.max(F.when(F.col("split") == n, F.col("at"))).alias(f"{n}_max") for n in names],
    )
    checks = []
    for a, b in zip(names, names[1:]):
        low, high = F.col(f"{a}_max"), F.col(f"{b}_min")
        checks.append(_check(f"{a}/{b}", "time_order", low, high, low <= high))
    return _explode(bounds, checks)


def require_ok(checks: DataFrame) -> None:
    """Stop at failed checks, naming them."""
    failed = checks.filter(~F.col("ok")).limit(20).collect()
    if failed:
        text = "; ".join(f"{r['dataset']}: {r['check_name']} is {r['actual']}, not {r['expected']}" for r in failed)
        raise ValueError(f"the datasets break their contract: {text}")
