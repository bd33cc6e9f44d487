"""Joins with the side table, their audits, and lookups of fitted aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.rowwise import exact_amount
from riskframe.spec import TableSpec


def left_join_with_marker(left: DataFrame, right: DataFrame, key: str, marker: str = "has_identity") -> DataFrame:
    """Left join that also says whether a partner was found, in one join."""
    marked = right.withColumn(marker, F.lit(1))
    return left.join(marked, key, "left").withColumn(marker, F.coalesce(F.col(marker), F.lit(0)))


def join_audit(left: DataFrame, right: DataFrame, key: str, dataset: str) -> DataFrame:
    """Row counts of ``left LEFT JOIN right`` without running the join.

    Key counts are merged before the shuffle, so a key that is frequent on both
    sides costs one row instead of the product of its rows.
    """
    sides = left.select(F.col(key).alias("key"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(F.col(key).alias("key"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = sides.groupBy("key").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    partners = F.when(F.col("key").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("r"))
    matched = F.coalesce(F.sum(F.col("l") * partners), F.lit(0).cast("bigint"))
    before = F.coalesce(F.sum("l"), F.lit(0).cast("bigint"))
    after = F.coalesce(F.sum(F.col("l") * F.greatest(partners, F.lit(1).cast("bigint"))), F.lit(0).cast("bigint"))
    return per_key.agg(
        before.alias("rows_before"),
        F.coalesce(F.sum("r"), F.lit(0).cast("bigint")).alias("side_rows"),
        after.alias("rows_after"),
        matched.alias("matched_rows"),
        (after - matched).alias("unmatched_rows"),
        (after - before).alias("row_difference"),
        F.when(after == before, "pass").otherwise("fail").alias("status"),
    ).select(F.lit(dataset).alias("dataset"), "*")


def require_pass(audit: DataFrame) -> None:
    """Stop when an audit table has a row whose status is not 'pass'."""
    failed = audit.filter(F.col("status") != "pass").limit(20).collect()
    if failed:
        raise ValueError("audit failed: " + "; ".join(str(row.asDict()) for row in failed))


def entity_aggregate(df: DataFrame, spec: TableSpec, entity: str) -> DataFrame:
    """Per-key statistics. Sums are exact; the mean skips NULL amounts."""
    amount = exact_amount(spec.amount)
    total = F.sum(amount).cast("double")
    columns = {"history_count": F.count(F.lit(1)), "history_amount_sum": total}
    if entity == "card":
        columns["history_amount_stddev"] = F.stddev_samp(F.col(spec.amount).cast("double"))
        columns["last_transaction_dt"] = F.max(spec.time)
    else:
        columns["history_avg_amount"] = total / F.count(amount)
    return df.groupBy(f"{entity}_entity_key").agg(*[c.alias(f"{entity}_{n}") for n, c in columns.items()])


def lookup_history(df: DataFrame, train: DataFrame, spec: TableSpec, entities: Sequence[str]) -> DataFrame:
    """Histories looked up from aggregates of the training rows; unseen keys get zeros."""
    kept = df.columns
    features = []
    zero = F.lit(0.0)
    for entity in entities:
        # AQE broadcasts a small table of keys, and splits a hot key of the left side.
        df = df.join(entity_aggregate(train, spec, entity), f"{entity}_entity_key", "left")
        count = F.coalesce(F.col(f"{entity}_history_count"), F.lit(0).cast("bigint"))
        total = F.coalesce(F.col(f"{entity}_history_amount_sum"), zero)
        if entity == "card":
            mean = F.when(count > 0, total / count).otherwise(zero)
        else:
            mean = F.coalesce(F.col(f"{entity}_history_avg_amount"), zero)
        features += [
            count.alias(f"prior_{entity}_transaction_count"),
            total.alias(f"prior_{entity}_amount_sum"),
            mean.alias(f"prior_{entity}_avg_amount"),
        ]
        if entity == "card":
            spread = F.coalesce(F.col("card_history_amount_stddev"), zero)
            since = (F.col(spec.time) - F.col("card_last_transaction_dt")).cast("double")
            features += [
                spread.alias("prior_card_amount_stddev"),
                since.alias("time_since_previous_card_transaction"),
            ]
    return df.select(*kept, *features)
