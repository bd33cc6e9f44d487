"""Positive-rate reports: how often the label is 1 per group."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.rowwise import MISSING_GROUP, exact_amount
from riskframe.spec import TableSpec

# Support limits and report length.
MIN_SUPPORT_RATE = 100
MIN_SUPPORT_VOLUME = 20
REPORT_ROWS = 30


def rate_pct(label: str) -> Column:
    return F.round(F.avg(label) * 100, 6)


def mean_amount(spec: TableSpec) -> Column:
    """Mean amount from an exact sum; NULL amounts are left out."""
    amount = exact_amount(spec.amount)
    return F.round(F.sum(amount).cast("double") / F.count(amount), 4)


def or_missing(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(MISSING_GROUP))


def overview(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count(F.when(F.col(spec.label) == 1, 1)).alias("positives"),
        rate_pct(spec.label).alias("rate_pct"),
        mean_amount(spec).alias("avg_amount"),
    )


def rate_by(
    df: DataFrame,
    groups: Mapping[str, Column],
    spec: TableSpec,
    min_support: int = 0,
    with_amount: bool = False,
) -> DataFrame:
    """Rows and positive rate per group, groups below ``min_support`` left out."""
    measures = [F.count(F.lit(1)).alias("transactions"), rate_pct(spec.label).alias("rate_pct")]
    if with_amount:
        measures.append(mean_amount(spec).alias("avg_amount"))
    rated = df.groupBy(*[c.alias(name) for name, c in groups.items()]).agg(*measures)
    return rated.filter(F.col("transactions") >= min_support) if min_support else rated


def top_by_volume(rated: DataFrame, key: str, rows: int = REPORT_ROWS) -> DataFrame:
    """The groups with most rows; equal ones in key order."""
    return rated.orderBy(F.col("transactions").desc(), key).limit(rows)


def top_by_rate(rated: DataFrame, key: str, rows: int = REPORT_ROWS) -> DataFrame:
    """The groups with the highest rate, then most rows, then in key order."""
    return rated.orderBy(F.col("rate_pct").desc(), F.col("transactions").desc(), key).limit(rows)
