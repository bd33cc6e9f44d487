"""Risk score, band, decision and per-row scoring expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (band, lowest score, highest score, decision); they cover 0-100.
RISK_BANDS = (
    ("low", 0, 19, "approve"),
    ("guarded", 20, 39, "approve"),
    ("medium", 40, 59, "review"),
    ("high", 60, 79, "review"),
    ("critical", 80, 100, "reject"),
)
HIGH_RISK_BANDS = ("high", "critical")
DEFAULT_FEATURE_VALUE = -999
FALLBACK = {
    "amount_share": 0.7,
    "hash_share": 0.3,
    "centre": 6.0,
    "width": 1.5,
    "lowest": 0.01,
    "highest": 0.99,
}


def risk_score(probability: Column) -> Column:
    """Probability in percent, half-even, held within 0-100; NULL where it is NULL or NaN."""
    percent = F.least(F.greatest(probability * 100, F.lit(0.0)), F.lit(100.0))
    return F.when(probability.isNotNull() & ~F.isnan(probability.cast("double")), F.bround(percent).cast("int"))


def _by_band(score: Column, field: int) -> Column:
    *lower, top = RISK_BANDS
    parts = [F.when(score <= entry[2], F.lit(entry[field])) for entry in lower]
    return F.when(score.isNotNull(), F.coalesce(*parts, F.lit(top[field])))


def risk_band(score: Column) -> Column:
    return _by_band(score, 0)


def decision(score: Column) -> Column:
    return _by_band(score, 3)


def threshold_decision(probability: Column, review_at: Column, reject_at: Column) -> Column:
    """Decision under fitted thresholds instead of the fixed bands."""
    return (
        F.when(probability >= reject_at, "reject").when(probability >= review_at, "review").otherwise("approve")
    )


def case_type(label: Column, prediction: Column) -> Column:
    right = F.when(label == prediction, "true").otherwise("false")
    sign = F.when(prediction == 1, "positive").otherwise("negative")
    return F.concat_ws("_", right, sign)


def fallback_probability(amount: Column) -> Column:
    """Deterministic score without a model: larger amounts score higher, plus a
    share drawn from a digest of the amount's text. A NULL amount counts as 0."""
    value = F.coalesce(amount.cast("double"), F.lit(0.0))
    text = F.coalesce(amount.cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")).cast("string")
    first_byte = F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("double")
    curve = 1 / (1 + F.exp(-(F.log1p(value) - FALLBACK["centre"]) / FALLBACK["width"]))
    mixed = FALLBACK["amount_share"] * curve + FALLBACK["hash_share"] * first_byte / 255
    return F.least(F.greatest(mixed, F.lit(FALLBACK["lowest"])), F.lit(FALLBACK["highest"]))


def scoring_mode(supplied: Column, contract: Sequence[str]) -> Column:
    """'full_feature' when the array of supplied names covers the contract."""
    lacking = F.array_except(F.array(*[F.lit(c) for c in contract]), supplied)
    return F.when(F.size(lacking) == 0, "full_feature").otherwise("partial_demo")


def linear_contributions(
    weights: Mapping[str, float], means: Mapping[str, float], top: int = 5
) -> Column:
    """The ``top`` largest weight x (value - mean) of a row, signed, by size then name."""
    parts = []
    for name, weight in weights.items():
        value = F.coalesce(F.col(name).cast("double"), F.lit(float(DEFAULT_FEATURE_VALUE)))
        contribution = F.lit(float(weight)) * (value - F.lit(float(means[name])))
        parts.append(
            F.struct(
                (-F.abs(contribution)).alias("order"),
                F.lit(name).alias("feature"),
                contribution.alias("contribution"),
            )
        )
    largest = F.slice(F.sort_array(F.array(*parts)), 1, top)
    return F.transform(largest, lambda c: F.struct(c["feature"].alias("feature"), c["contribution"].alias("contribution")))
