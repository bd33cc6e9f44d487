"""Key audits, column profiles and data-quality tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.spec import TableSpec

# Profile batch size, cut-offs and texts of the missingness report.
COLUMNS_PER_PASS = 40
SPARSE_SHARE = 0.8
HIGH_CARDINALITY = 0.1
MISSING_GRADES = ((20, "Low"), (70, "Medium"), (95, "High"))
TOP_MISSING_GRADE = "Extreme"
TEXT_STRATEGY = "trim + normalize empty + __MISSING__ + __UNKNOWN__ for unseen"
TEXT_ACTION = "categorical_fill_missing"
NUMBER_STRATEGY = "median_train_only"
NUMBER_ACTION = "numeric_imputation"

# A sketch has 2^bits cells; its standard error follows from them.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def key_audit(df: DataFrame, key: str, dataset: str) -> DataFrame:
    """Missing and repeated keys of a table."""
    rows, known, distinct = F.count(F.lit(1)), F.count(key), F.count_distinct(key)
    return df.agg(
        rows.alias("rows"),
        (rows - known).alias("null_keys"),
        (rows - distinct).alias("duplicate_keys"),
        F.when((rows == known) & (rows == distinct), "pass").otherwise("fail").alias("status"),
    ).select(F.lit(dataset).alias("dataset"), "*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def batches(values: Sequence[str], size: int) -> Iterator[Sequence[str]]:
    for start in range(0, len(values), size):
        yield values[start : start + size]


def column_profile(df: DataFrame, dataset: str, exact: bool = False) -> DataFrame:
    """One row per column: type, NULLs and distinct values.

    Distinct values come from sketches of fixed size, 40 columns per pass to
    keep the generated code compilable; ``exact`` counts them by a shuffle.
    """
    types = dict(df.dtypes)
    distinct = "exact_distinct_count" if exact else "approx_distinct_count"
    parts = []
    for names in batches(df.columns, COLUMNS_PER_PASS):
        measure = F.count_distinct if exact else F.approx_count_distinct
        entries = [
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(types[name]).alias("spark_type"),
                F.count(F.lit(1)).alias("row_count"),
                (F.count(F.lit(1)) - F.count(F.col(f"`{name}`"))).alias("null_count"),
                measure(F.col(f"`{name}`")).alias(distinct),
            )
            for name in names
        ]
        parts.append(df.agg(F.array(*entries).alias("c")).select(F.explode("c").alias("c")).select("c.*"))
    return _rated(union_all(parts), dataset, distinct)


def _rated(measured: DataFrame, dataset: str, distinct: str) -> DataFrame:
    """Shares and flags of a profile's counts."""
    rows = F.col("row_count")
    null_share = F.when(rows > 0, F.col("null_count") / rows).otherwise(F.lit(0.0))
    cardinality = F.when(rows > 0, F.col(distinct) / rows).otherwise(F.lit(0.0))
    return measured.withColumns(
        {
            "dataset": F.lit(dataset),
            "null_pct": null_share * 100,
            "cardinality_ratio": cardinality,
            "is_sparse_over_80pct": null_share > SPARSE_SHARE,
            "is_high_cardinality_over_10pct": cardinality > HIGH_CARDINALITY,
        }
    )


def profile_state(df: DataFrame) -> DataFrame:
    """What a part of a table adds to a profile: per column its rows, NULLs and a sketch of its values.

    One pass with map-side merging; a state is a few kilobytes for each column, whatever the part holds. States of
    parts are kept, so that a new part is profiled without the old ones being read.
    """
    types = dict(df.dtypes)
    parts = []
    for names in batches(df.columns, COLUMNS_PER_PASS):
        entries = []
        for name in names:
            value = F.col(f"`{name}`")
            hashed = F.when(value.isNotNull(), F.xxhash64(value))  # sketches know few types
            entries.append(
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.lit(types[name]).alias("spark_type"),
                    F.count(F.lit(1)).alias("row_count"),
                    (F.count(F.lit(1)) - F.count(value)).alias("null_count"),
                    F.hll_sketch_agg(hashed, F.lit(SKETCH_BITS)).alias("sketch"),
                )
            )
        parts.append(df.agg(F.array(*entries).alias("c")).select(F.explode("c").alias("c")).select("c.*"))
    return union_all(parts)


def merge_profiles(states: DataFrame) -> DataFrame:
    """One state of all parts. A column that some parts lack has the rows of the parts that have it."""
    counts = [F.sum(c).alias(c) for c in ("row_count", "null_count")]
    return states.groupBy("column_name", "spark_type").agg(*counts, F.hll_union_agg("sketch").alias("sketch"))


def profile_of_state(state: DataFrame, dataset: str) -> DataFrame:
    """The rows of ``column_profile``; distinct values within about ``SKETCH_ERROR`` (one standard error)."""
    counted = state.withColumn("approx_distinct_count", F.hll_sketch_estimate("sketch")).drop("sketch")
    return _rated(counted, dataset, "approx_distinct_count")


def missing_grade(null_pct: Column) -> Column:
    parts = [F.when(null_pct < limit, grade) for limit, grade in MISSING_GRADES]
    return F.coalesce(*parts, F.lit(TOP_MISSING_GRADE))


def missingness_strategy(profile: DataFrame) -> DataFrame:
    """What to do about the missing values of every profiled column."""
    text = F.col("spark_type").contains("string")
    return profile.withColumns(
        {
            "missing_group": missing_grade(F.col("null_pct")),
            "recommended_strategy": F.when(text, TEXT_STRATEGY).otherwise(NUMBER_STRATEGY),
            "final_action": F.when(text, TEXT_ACTION).otherwise(NUMBER_ACTION),
        }
    )


def type_summary(df: DataFrame, dataset: str) -> DataFrame:
    """Column names and types of a table; its size is the width of the schema."""
    rows = [(dataset, name, kind) for name, kind in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "dataset string, column_name string, spark_type string")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per class and their share; the window runs over the grouped rows only."""
    grouped = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy()) * 100
    return grouped.withColumn("percentage", F.round(share, 6))


def imbalance_summary(df: DataFrame, label: str) -> DataFrame:
    rows = F.count(F.lit(1))
    positives = F.count(F.when(F.col(label) == 1, 1))
    negatives = F.count(F.when(F.col(label) == 0, 1))
    return df.agg(
        positives.alias("positives"),
        negatives.alias("negatives"),
        (positives / F.greatest(rows, F.lit(1))).alias("positive_rate"),
        (negatives / F.greatest(positives, F.lit(1))).alias("negatives_per_positive"),
    )


def quality_summary(tables: Mapping[str, DataFrame], joined: Mapping[str, DataFrame], spec: TableSpec) -> DataFrame:
    """Row counts per stage, side-table coverage and invalid values, in tidy form.

    ``tables`` are raw tables; those with an amount column also get the
    NULL-amount and blank-product metrics. ``joined`` carry ``has_identity``.
    """
    parts = []
    for stage, df in tables.items():
        metrics = {"rows": F.count(F.lit(1))}
        if spec.amount in df.columns:
            blank = F.trim(F.coalesce(F.col(spec.product), F.lit(""))) == ""
            metrics["null_amount"] = F.count(F.when(F.col(spec.amount).isNull(), 1))
            metrics["empty_product"] = F.count(F.when(blank, 1))
        parts.append(_tidy(df, stage, metrics))
    for stage, df in joined.items():
        coverage = F.sum("has_identity") / F.greatest(F.count(F.lit(1)), F.lit(1))
        parts.append(_tidy(df, stage, {"identity_coverage_ratio": coverage}))
    return union_all(parts)


def _tidy(df: DataFrame, stage: str, metrics: Mapping[str, Column]) -> DataFrame:
    entries = [F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()]
    return (
        df.agg(F.array(*entries).alias("m"))
        .select(F.explode("m").alias("m"))
        .select(F.lit(stage).alias("stage"), "m.*")
    )
