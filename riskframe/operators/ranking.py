"""Ranking metrics, threshold tables, policies, calibration and release gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.isotonic import apply_isotonic, fit_isotonic
from riskframe.operators.quantiles import known, running_totals

# The threshold grid, policy limits and release gates.
THRESHOLD_GRID = tuple(round(i / 100, 2) for i in range(5, 96))
MIN_REVIEW_PRECISION = 0.30
MIN_REJECT_PRECISION = 0.60
REVIEW_RULE = "max_recall_then_f1_with_min_precision"
REJECT_RULE = "lowest_threshold_meeting_reject_precision"
REJECT_FALLBACK_RULE = "best_available_precision_fallback"
GATES = {"holdout_pr_auc": 0.4582, "holdout_roc_auc": 0.8746, "review_precision": 0.30}



def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0.0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def confusion_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the four cases with precision, recall and F1 of the positive class."""

    def cases(y: int, p: int) -> Column:
        return F.count(F.when((F.col(label) == y) & (F.col(prediction) == p), 1))

    counts = df.groupBy(*by).agg(
        cases(1, 1).alias("tp"), cases(0, 0).alias("tn"), cases(0, 1).alias("fp"), cases(1, 0).alias("fn")
    )
    return _with_rates(counts)


def _with_rates(counts: DataFrame) -> DataFrame:
    rated = counts.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )
    return rated.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def score_points(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: positives and negatives there, from the top down to it, and in all.

    Rows without a score (NULL or NaN) are one point below all others.
    """
    classes = df.select(
        *by,
        score,
        F.when(F.col(label) == 1, 1).otherwise(0).alias("pos"),
        F.when(F.col(label) == 1, 0).otherwise(1).alias("neg"),
    )
    return running_totals(classes, score, ["pos", "neg"], by=by, descending=True)


def _average_precision() -> Column:
    return F.sum(F.col("pos") / F.col("total_pos") * F.col("upto_pos") / (F.col("upto_pos") + F.col("upto_neg")))


def _roc_auc() -> Column:
    lower_negatives = F.col("total_neg") - F.col("upto_neg") + F.col("neg") / 2
    return F.sum(F.col("pos") / F.col("total_pos") * lower_negatives / F.col("total_neg"))


def _guarded(points: DataFrame) -> DataFrame:
    """Turn empty classes into NULL totals, so the metrics become NULL, not an error."""
    return points.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in ("total_pos", "total_neg")})


def rank_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision and ROC-AUC with ties counted half, exact."""
    points = _guarded(score_points(df, score, label, by))
    return points.groupBy(*by).agg(_average_precision().alias("pr_auc"), _roc_auc().alias("roc_auc"))


def binary_metrics(
    df: DataFrame, score: str, label: str, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """Ranking metrics and the confusion counts at ``score >= threshold``, in one pass."""
    points = _guarded(score_points(df, score, label, by))
    above = F.coalesce(F.col(score) >= threshold, F.lit(False))  # a row without a score is not above
    counts = points.groupBy(*by).agg(
        _average_precision().alias("pr_auc"),
        _roc_auc().alias("roc_auc"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(F.col("neg"))).alias("tn"),
        F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"),
    )
    return _with_rates(counts).withColumn("threshold", F.lit(float(threshold)))


def threshold_table(
    df: DataFrame, score: str, label: str, thresholds: Sequence[float] = THRESHOLD_GRID
) -> DataFrame:
    """Confusion counts and rates at every threshold, for ``score >= threshold``.

    Each row is put into the slot of the highest threshold it reaches; the
    counts per threshold are suffix sums over the slots. A row without a score (NULL or NaN) reaches none.
    """
    grid = sorted(thresholds)
    edges = [float("-inf"), *grid, float("inf")]
    positive = F.when(F.col(label) == 1, 1).otherwise(0)
    slots = (
        Bucketizer(splits=edges, inputCol="__score", outputCol="__slot")
        .transform(df.select(F.coalesce(known(score), F.lit(float("-inf"))).alias("__score"), positive.alias("pos")))
        .groupBy(F.col("__slot").cast("int").alias("slot"))
        .agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    )
    numbers = F.array(*[F.lit(t) for t in grid])
    rows = df.sparkSession.range(0, len(grid) + 1).select(F.col("id").cast("int").alias("slot"))
    filled = rows.join(slots, "slot", "left").na.fill(0, ["pos", "neg"])
    downward = Window.orderBy(F.col("slot").desc())
    whole = Window.partitionBy()
    counts = (
        filled.select(
            "slot",
            F.sum("pos").over(downward).alias("tp"),
            F.sum("neg").over(downward).alias("fp"),
            F.sum("pos").over(whole).alias("all_pos"),
            F.sum("neg").over(whole).alias("all_neg"),
        )
        .filter(F.col("slot") > 0)
        .select(
            F.element_at(numbers, F.col("slot")).alias("threshold"),
            "tp",
            "fp",
            (F.col("all_neg") - F.col("fp")).alias("tn"),
            (F.col("all_pos") - F.col("tp")).alias("fn"),
        )
    )
    return _with_rates(counts)


def threshold_policy(
    table: DataFrame,
    min_precision: float = MIN_REVIEW_PRECISION,
    min_reject_precision: float = MIN_REJECT_PRECISION,
) -> DataFrame:
    """Review and reject thresholds from a threshold table, as one row.

    Review: most recall, then F1, then precision, among thresholds with enough
    precision (among all, if none has). Reject: the lowest threshold from there
    on with enough precision, else the most precise one. The table has one row
    per grid threshold, so its rows fit an array.
    """
    rows = table.agg(F.collect_list(F.struct("threshold", "precision", "recall", "f1")).alias("rows"))

    def review_rank(r: Column) -> Column:
        return F.struct(
            (r["precision"] >= min_precision).alias("ok"),
            r["recall"].alias("recall"),
            r["f1"].alias("f1"),
            r["precision"].alias("precision"),
            (-r["threshold"]).alias("minus_threshold"),
        )

    def reject_rank(r: Column) -> Column:
        ok = r["precision"] >= min_reject_precision
        return F.struct(
            ok.alias("ok"),
            F.when(ok, -r["threshold"]).otherwise(r["precision"]).alias("first"),
            r["recall"].alias("recall"),
            r["threshold"].alias("threshold"),
            r["precision"].alias("precision"),
        )

    reviewed = rows.withColumn("review", F.array_max(F.transform("rows", review_rank))).withColumn(
        "review_threshold", -F.col("review.minus_threshold")
    )
    later = F.filter("rows", lambda r: r["threshold"] >= F.col("review_threshold"))
    return reviewed.withColumn("reject", F.array_max(F.transform(later, reject_rank))).select(
        "review_threshold",
        F.col("reject.threshold").alias("reject_threshold"),
        F.lit(REVIEW_RULE).alias("selection_rule"),
        F.when(F.col("reject.ok"), REJECT_RULE).otherwise(REJECT_FALLBACK_RULE).alias("reject_selection_rule"),
        F.lit(float(min_precision)).alias("min_precision"),
        F.lit(float(min_reject_precision)).alias("min_reject_precision"),
        F.col("review.precision").alias("selected_review_precision"),
        F.col("reject.precision").alias("selected_reject_precision"),
    )


def squared_error(probability: Column, label: Column) -> Column:
    return (probability - label.cast("double")) * (probability - label.cast("double"))


def brier_scores(df: DataFrame, raw: str, calibrated: str, label: str) -> DataFrame:
    """Mean squared error of the raw and the calibrated probability, over the rows that have it."""
    y = F.col(label)
    return df.agg(
        F.avg(squared_error(known(raw), y)).alias("raw_brier_score"),
        F.avg(squared_error(known(calibrated), y)).alias("brier_score"),
    ).withColumn("calibration_improved", F.col("brier_score") <= F.col("raw_brier_score"))


@dataclass(frozen=True)
class Calibrator:
    """A fitted isotonic curve; inputs outside its range take the end values, rows without a score have none."""

    steps: DataFrame

    def apply(self, df: DataFrame, score: str, output: str = "calibrated") -> DataFrame:
        return apply_isotonic(df, self.steps, score, output)


def fit_calibrator(df: DataFrame, score: str, label: str) -> Calibrator:
    """Isotonic fit on the distinct scores weighted by their rows, which are merged first."""
    points = df.groupBy(known(score).alias("x")).agg(
        F.sum(F.col(label).cast("double")).alias("total"), F.count(label).cast("double").alias("weight")
    )
    return Calibrator(fit_isotonic(points.filter("weight > 0")))


def holdout_metrics(holdout: DataFrame, raw: str, calibrated: str, label: str, threshold: float) -> DataFrame:
    """Final evaluation under a frozen calibrator and review threshold."""
    metrics = binary_metrics(holdout, calibrated, label, threshold)
    scores = brier_scores(holdout, raw, calibrated, label)
    both = metrics.unionByName(scores, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def release_gates(metrics: DataFrame, contract_ok: bool) -> DataFrame:
    """One row per gate: its value, its bound and whether it is passed."""

    def gate(name: str, value: Column, bound: Column, passed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("gate"),
            value.cast("double").alias("value"),
            bound.cast("double").alias("bound"),
            F.coalesce(passed, F.lit(False)).alias("passed"),
        )

    rules = []
    for name, column in (
        ("holdout_pr_auc", "pr_auc"),
        ("holdout_roc_auc", "roc_auc"),
        ("review_precision", "precision"),
    ):
        bound = F.lit(GATES[name])
        rules.append(gate(name, F.col(column), bound, F.col(column) >= bound))
    better = F.col("brier_score") <= F.col("raw_brier_score")
    rules.append(gate("calibration_non_regression", F.col("brier_score"), F.col("raw_brier_score"), better))
    kept = F.lit(contract_ok)
    rules.append(gate("data_contract_verification", kept.cast("int"), F.lit(1), kept))
    return metrics.select(F.explode(F.array(*rules)).alias("g")).select("g.*")


def release_status(gates: DataFrame) -> DataFrame:
    """The decision and the list of failed gates; the gate table has a fixed size."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate"))))
    return gates.agg(failed.alias("failed_gates")).select(
        F.when(F.size("failed_gates") == 0, "eligible_for_promotion_review").otherwise("not_promoted").alias("status"),
        "failed_gates",
    )
