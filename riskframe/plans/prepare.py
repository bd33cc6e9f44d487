"""From raw tables to model-ready datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.rowwise import amount_against_mean, base_features, outlier_flags
from riskframe.operators.contract import DATASETS, contract_checks, dataset_manifest, model_columns, require_ok, stamp
from riskframe.operators.fitted import (
    NEGATIVES_PER_POSITIVE,
    SEED,
    AmountThresholds,
    fit_amount_thresholds,
    fit_class_weights,
    fit_medians,
    impute,
    undersample,
    with_class_weight,
)
from riskframe.operators.history import ROWS_PER_TASK, add_history, history_for_unlabelled
from riskframe.operators.joins import join_audit, left_join_with_marker, require_pass
from riskframe.operators.profile import key_audit, union_all
from riskframe.operators.splits import (
    TRAIN_RATIO,
    VALIDATION_RATIO,
    Boundaries,
    fit_boundaries,
    split_frames,
)
from riskframe.session import materialise
from riskframe.sources.files import write_dataset, write_report
from riskframe.spec import TableSpec


@dataclass(frozen=True)
class Options:
    train_ratio: float = TRAIN_RATIO
    validation_ratio: float = VALIDATION_RATIO
    negatives_per_positive: float = NEGATIVES_PER_POSITIVE
    seed: int = SEED
    rows_per_task: int = ROWS_PER_TASK
    generated_at: str | None = None


@dataclass(frozen=True)
class Prepared:
    """Fitted parameters (plain numbers), the six model-ready datasets, and the contract columns per split before imputation (``raw``)."""

    boundaries: Boundaries
    thresholds: AmountThresholds
    medians: dict[str, float]
    weights: dict[int, float]
    features: DataFrame
    datasets: dict[str, DataFrame]
    raw: dict[str, DataFrame]


def join_and_audit(
    transactions: dict[str, DataFrame], identities: dict[str, DataFrame], spec: TableSpec
) -> dict[str, DataFrame]:
    """Left-join each transaction table with its side table after the audits have passed."""
    require_pass(
        union_all([key_audit(df, spec.id, name) for tables in (transactions, identities) for name, df in tables.items()])
    )
    require_pass(
        union_all([join_audit(df, identities[name], spec.id, name) for name, df in transactions.items()])
    )
    return {name: left_join_with_marker(df, identities[name], spec.id) for name, df in transactions.items()}


def feature_stream(
    labelled: DataFrame, unlabelled: DataFrame, spec: TableSpec, options: Options = Options()
) -> tuple[DataFrame, Boundaries, AmountThresholds]:
    """Row features and histories of both tables in one stream, in one pass.

    Labelled rows see labelled rows only, unlabelled rows see both. Where all
    unlabelled rows are later, one pass over the joint stream gives both;
    otherwise the labelled rows get a pass of their own. The row features are
    written first, and keep only the columns the contract needs.
    """
    wanted = [c for c in unlabelled.columns if c != spec.label]
    stream = (
        labelled.select(*wanted, spec.label)
        .withColumn("labelled", F.lit(True))
        .unionByName(
            unlabelled.select(*wanted)
            .withColumn(spec.label, F.lit(None).cast(labelled.schema[spec.label].dataType))
            .withColumn("labelled", F.lit(False))
        )
    )
    rows = base_features(stream, spec)
    keys = ["card_entity_key", "email_entity_key", "device_entity_key"]
    known = [c for c in spec.features if c in rows.columns]
    kept = [spec.id, spec.time, spec.label, "labelled", "transaction_period", *keys, *known]
    # Written here so that the join with the side table runs once, not once per fit.
    rows = materialise(rows.select(*dict.fromkeys(kept)), "row_features")
    own, other = rows.filter("labelled"), rows.filter("NOT labelled")
    boundaries = fit_boundaries(own, spec.time, options.train_ratio, options.validation_ratio)
    thresholds = fit_amount_thresholds(own.filter(F.col(spec.time) <= boundaries.first), spec.amount)
    if _unlabelled_are_later(rows, spec.time):
        with_history = add_history(rows, spec, rows_per_task=options.rows_per_task)
    else:
        with_history = add_history(own, spec, rows_per_task=options.rows_per_task).unionByName(
            history_for_unlabelled(own, other, spec, rows_per_task=options.rows_per_task)
        )
    return (
        with_history.withColumns(
            {
                **outlier_flags(spec, thresholds.upper_cap, thresholds.p99),
                **amount_against_mean(spec.amount, "prior_card_avg_amount"),
            }
        ),
        boundaries,
        thresholds,
    )


def _unlabelled_are_later(rows: DataFrame, time: str) -> bool:
    bounds = rows.agg(
        F.max(F.when(F.col("labelled"), F.col(time))).alias("last"),
        F.min(F.when(~F.col("labelled"), F.col(time))).alias("first"),
        F.count_if(F.col("labelled") & F.col(time).isNull()).alias("lost"),
        F.count_if(~F.col("labelled") & F.col(time).isNull()).alias("undated"),
    ).first()
    if bounds["lost"]:
        raise ValueError(f"{bounds['lost']} labelled rows have no {time} and would be in no split")
    if bounds["undated"]:
        return False  # such rows come first in a history, so labelled rows must not see them
    return None in (bounds["first"], bounds["last"]) or bounds["first"] > bounds["last"]


def prepare(
    labelled: DataFrame, unlabelled: DataFrame, spec: TableSpec, options: Options = Options()
) -> Prepared:
    """Fit on the training window, apply everywhere, and build the six datasets.

    Inputs are joined tables that carry ``has_identity``. Row features and the
    feature stream are written once each; the fits and the datasets read them.
    """
    stream, boundaries, thresholds = feature_stream(labelled, unlabelled, spec, options)
    features = materialise(stream, "features")
    frames = split_frames(features.filter("labelled"), spec.time, boundaries)
    raw = {name: model_columns(df, spec) for name, df in frames.items()}
    raw["unlabelled"] = model_columns(features.filter(~F.col("labelled")), spec, with_label=False)

    numeric = [c for c in spec.numeric_features if c in raw["train"].columns]
    medians = fit_medians(raw["train"], numeric)
    weights = fit_class_weights(raw["train"], spec.label)
    ready = {name: impute(df, medians) for name, df in raw.items()}
    train = ready["train"]
    chosen = {
        "train_original": train,
        "train_weighted": with_class_weight(train, spec.label, weights),
        "train_balanced": undersample(train, spec.id, spec.label, options.negatives_per_positive, options.seed),
        "validation": ready["validation"],
        "holdout": ready["holdout"],
        "unlabelled": ready["unlabelled"],
    }
    datasets = {name: stamp(chosen[name], name, spec, options.generated_at) for name in DATASETS}
    return Prepared(boundaries, thresholds, medians, weights, features, datasets, raw)


def write_prepared(prepared: Prepared, spec: TableSpec, folder: str) -> dict[str, DataFrame]:
    """Write the datasets, verify what was written, and write the reports.

    Returns the datasets as read back from ``folder``.
    """
    spark = prepared.features.sparkSession
    paths = {
        name: write_dataset(df, f"{folder}/model_ready/{name}") for name, df in prepared.datasets.items()
    }
    written = {name: spark.read.parquet(path) for name, path in paths.items()}
    manifest = dataset_manifest(written)
    write_report(manifest, f"{folder}/reports/dataset_manifest")
    listed = {row["dataset"]: row for row in manifest.collect()}
    checks = contract_checks(written, spec, listed)
    write_report(checks, f"{folder}/reports/contract_checks")
    require_ok(checks)
    return written
