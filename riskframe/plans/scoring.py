"""Batch scoring: fill, predict, explain, calibrate, classify, upsert."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.risk import DEFAULT_FEATURE_VALUE
from riskframe.functions.rowwise import MISSING_CATEGORY
from riskframe.operators import queue, training
from riskframe.operators.ranking import Calibrator
from riskframe.operators.scorers import Scorer, largest, scorer_of
from riskframe.session import materialise
from riskframe.spec import TableSpec

SCORED_COLUMNS = (
    "amount",
    "probability",
    "risk_score",
    "risk_band",
    "decision",
    "scoring_mode",
    "scored_at",
    "model_version",
    "features",
    "contributions",
)


def calibrate(predicted: DataFrame, calibrator: Calibrator | None) -> DataFrame:
    """``probability`` on the calibrator's curve, held within 0 and 1."""
    if calibrator is not None:
        predicted = materialise(predicted, "predicted")  # the curve reads the scores twice
        predicted = calibrator.apply(predicted, "probability").drop("probability").withColumnRenamed(
            "calibrated", "probability"
        )
    held = F.least(F.greatest(F.col("probability"), F.lit(0.0)), F.lit(1.0))
    return predicted.withColumn("probability", held)


def score_batch(
    df: DataFrame,
    model: PipelineModel | Scorer,
    calibrator: Calibrator | None,
    spec: TableSpec,
    columns: training.Columns,
    model_version: str,
    scored_at: str,
) -> DataFrame:
    """Score every row of ``df`` in one pass.

    Missing or NULL numeric features take the default value; a row counts as
    fully scored when the table supplies every contract column. ``contributions``
    are the five features that moved the model's output most, before calibration.
    A fitted pipeline and its stored scorer give the same rows.
    """
    scorer = scorer_of(model, columns) if isinstance(model, PipelineModel) else model
    supplied = set(df.columns)
    mode = "full_feature" if supplied.issuperset([*columns.numeric, *columns.text]) else "partial_demo"
    default = F.lit(float(DEFAULT_FEATURE_VALUE))
    filled = df.withColumns(
        {
            **{
                c: F.coalesce(F.col(c).cast("double"), default) if c in supplied else default
                for c in columns.numeric
            },
            **{
                c: F.coalesce(F.col(c), F.lit(MISSING_CATEGORY)) if c in supplied else F.lit(MISSING_CATEGORY)
                for c in columns.text
            },
            "__amount": F.coalesce(F.col(spec.amount).cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)")),
        }
    )
    given = [c for c in (*columns.numeric, *columns.text) if c in supplied]
    kept = F.to_json(F.struct(*[F.col(c) for c in given]))
    predicted = filled.select(
        spec.id,
        "__amount",
        kept.alias("__given"),
        scorer.probability().alias("probability"),
        largest(scorer.contributions()).alias("contributions"),
    )
    return (
        queue.classify(calibrate(predicted, calibrator), "probability")
        .withColumns(
            {
                "amount": F.col("__amount"),
                "features": F.col("__given"),
                "scoring_mode": F.lit(mode),
                "scored_at": F.lit(scored_at).cast("timestamp"),
                "model_version": F.lit(model_version),
            }
        )
        .select(spec.id, *SCORED_COLUMNS)
    )


def write_scored(current: DataFrame | None, batch: DataFrame, spec: TableSpec, path: str) -> DataFrame:
    """Merge a scored batch into the scored table and write the result to a new path."""
    merged = batch if current is None else queue.upsert(current, batch, spec.id, "scored_at")
    merged.write.mode("errorifexists").parquet(path)
    return batch.sparkSession.read.parquet(path)
