"""Train on the prepared datasets, calibrate, set thresholds, evaluate the holdout, decide."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from riskframe.operators import ranking, training
from riskframe.operators.contract import contract_checks
from riskframe.operators.splits import WINDOWS, check_windows, validation_windows
from riskframe.session import materialise
from riskframe.spec import TableSpec


@dataclass(frozen=True)
class Release:
    name: str
    model: PipelineModel
    calibrator: ranking.Calibrator
    thresholds: Row
    comparison: DataFrame
    threshold_table: DataFrame
    metrics: DataFrame
    gates: DataFrame
    status: DataFrame


def model_columns(datasets: Mapping[str, DataFrame], spec: TableSpec) -> training.Columns:
    present = datasets["train_weighted"].columns
    return training.Columns(
        spec.id,
        spec.label,
        [c for c in spec.numeric_features if c in present],
        [c for c in spec.categorical_features if c in present],
    )


def release(
    datasets: Mapping[str, DataFrame],
    spec: TableSpec,
    families=training.FAMILIES,
    settings: Mapping[str, Mapping] | None = None,
) -> Release:
    """The champion on the selection window, calibrated on the calibration window,
    with thresholds from the policy window, judged once on the holdout.

    ``datasets`` are written tables (see ``write_prepared``), so every step reads
    only the columns it needs.
    """
    columns = model_columns(datasets, spec)
    failed = contract_checks(datasets, spec).filter(~F.col("ok")).limit(1).count()

    tagged, _ = validation_windows(datasets["validation"], spec.time)
    check_windows(tagged, spec.time)
    windows = {w: tagged.filter(F.col("window") == w) for w in WINDOWS}

    models = training.compare_families(
        datasets["train_weighted"], datasets["train_balanced"], columns, families, settings
    )
    comparison = training.evaluate_all(models, {"selection": windows["selection"]}, columns)
    name = training.champion(comparison, "selection")
    model = models[name]

    def scored(df: DataFrame) -> DataFrame:
        # Written, so that each metric reads numbers instead of predicting again.
        return materialise(training.predict(model, df, [spec.id, spec.label]), "predictions")

    calibrator = ranking.fit_calibrator(scored(windows["calibration"]), "probability", spec.label)
    policy_rows = calibrator.apply(scored(windows["policy"]), "probability")
    table = ranking.threshold_table(policy_rows, "calibrated", spec.label)
    thresholds = ranking.threshold_policy(table).first()

    holdout = calibrator.apply(scored(datasets["holdout"]), "probability")
    metrics = ranking.holdout_metrics(
        holdout, "probability", "calibrated", spec.label, thresholds["review_threshold"]
    )
    gates = ranking.release_gates(metrics, failed == 0)
    return Release(
        name, model, calibrator, thresholds, comparison, table, metrics, gates, ranking.release_status(gates)
    )
