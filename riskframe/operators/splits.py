"""Chronological splits. Boundaries are exact discrete quantiles of the time column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.quantiles import exact_quantiles, quantile_values
from riskframe.spec import TableSpec

# Split names, ratios and the cut of the validation window.
SPLITS = ("train", "validation", "holdout")
TRAIN_RATIO = 0.70
VALIDATION_RATIO = 0.15
WINDOWS = ("selection", "calibration", "policy")
WINDOW_CUTS = (0.50, 0.75)


@dataclass(frozen=True)
class Boundaries:
    """Two inclusive upper bounds that cut a time axis into three windows."""

    first: float
    second: float

    def name(self, time: str, names: tuple[str, str, str] = SPLITS) -> Column:
        return (
            F.when(F.col(time) <= self.first, names[0])
            .when(F.col(time) <= self.second, names[1])
            .when(F.col(time).isNotNull(), names[2])
        )


def check_ratios(train_ratio: float, validation_ratio: float) -> None:
    if not 0.0 < train_ratio < train_ratio + validation_ratio < 1.0:
        raise ValueError(
            "the train and validation ratios must leave three non-empty windows, "
            f"got {train_ratio} and {validation_ratio}"
        )


def boundaries_table(
    df: DataFrame, time: str, train_ratio: float = TRAIN_RATIO, validation_ratio: float = VALIDATION_RATIO
) -> DataFrame:
    check_ratios(train_ratio, validation_ratio)
    upper = round(train_ratio + validation_ratio, 6)
    value = F.col("value").cast("bigint")
    return exact_quantiles(df, [time], [train_ratio, upper]).agg(
        F.min(value).alias("train_max"), F.max(value).alias("validation_max")
    )


def fit_boundaries(
    df: DataFrame, time: str, train_ratio: float = TRAIN_RATIO, validation_ratio: float = VALIDATION_RATIO
) -> Boundaries:
    check_ratios(train_ratio, validation_ratio)
    cuts = (train_ratio, round(train_ratio + validation_ratio, 6))
    return _fit(df, time, cuts)


def _fit(df: DataFrame, time: str, cuts: tuple[float, float]) -> Boundaries:
    found = quantile_values(df, [time], cuts)[time]
    if len(found) < 2:
        raise ValueError(f"no values of {time} to take boundaries from")
    return Boundaries(*(found[c] for c in cuts))


def with_split(df: DataFrame, time: str, boundaries: Boundaries) -> DataFrame:
    return df.withColumn("split", boundaries.name(time))


def split_frames(df: DataFrame, time: str, boundaries: Boundaries) -> dict[str, DataFrame]:
    """The three windows as filters on the time column, which reach the scan."""
    at = F.col(time)
    return {
        "train": df.filter(at <= boundaries.first),
        "validation": df.filter((at > boundaries.first) & (at <= boundaries.second)),
        "holdout": df.filter(at > boundaries.second),
    }


def split_summary(df: DataFrame, spec: TableSpec, split: str = "split") -> DataFrame:
    """Rows, classes, rate and time range of every split, in one aggregation."""
    positive = F.sum(F.when(F.col(spec.label) == 1, 1).otherwise(0))
    rows = F.count(F.lit(1))
    return df.groupBy(split).agg(
        rows.alias("rows"),
        (rows - positive).alias("negatives"),
        positive.alias("positives"),
        (positive / rows).alias("positive_rate"),
        F.min(spec.time).alias("min_time"),
        F.max(spec.time).alias("max_time"),
    )


def validation_windows(validation: DataFrame, time: str) -> tuple[DataFrame, Boundaries]:
    """Tag validation rows as selection (50%), calibration (25%) or policy (25%)."""
    if time not in validation.columns:
        raise ValueError(f"the validation table has no column {time}")
    cuts = _fit(validation, time, WINDOW_CUTS)
    return validation.withColumn("window", cuts.name(time, WINDOWS)), cuts


def check_windows(tagged: DataFrame, time: str) -> None:
    """Fail unless the windows are non-empty, cover every row and follow each other."""
    rows = {
        row["window"]: row
        for row in tagged.groupBy("window")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("low"), F.max(time).alias("high"))
        .collect()
    }
    if None in rows:
        raise ValueError(f"{rows[None]['rows']} validation rows have no time and fall into no window")
    lacking = [w for w in WINDOWS if w not in rows]
    if lacking:
        raise ValueError(f"the time cut leaves no rows for: {', '.join(lacking)}")
    bounds = [b for w in WINDOWS for b in (rows[w]["low"], rows[w]["high"])]
    if bounds != sorted(bounds):
        raise ValueError(f"the validation windows overlap in time: {bounds}")
