"""Scored tables: risk policy, review queue, KPIs, upserts and catalogue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.risk import (
    HIGH_RISK_BANDS,
    RISK_BANDS,
    case_type,
    decision,
    risk_band,
    risk_score,
    threshold_decision,
)
from riskframe.operators.profile import union_all

# Page size, work-list limit and catalogue tolerance.
PAGE_ROWS = 20
WORKLIST_MIN_SCORE = 40
CASES_PER_TYPE = 3
NATURAL_RATE_TOLERANCE = 0.005
SORT_ORDERS = ("risk_score", "-risk_score", "scored_at", "-scored_at")
REVIEW_STATUSES = ("pending", "approved", "rejected")


def classify(df: DataFrame, probability: str) -> DataFrame:
    """Add score, band and decision."""
    scored = df.withColumn("risk_score", risk_score(F.col(probability)))
    score = F.col("risk_score")
    return scored.withColumns({"risk_band": risk_band(score), "decision": decision(score)})


def policy_disagreement(df: DataFrame, probability: str, review_at: float, reject_at: float) -> DataFrame:
    """Rows per pair of fixed-band decision and fitted-threshold decision."""
    other = threshold_decision(F.col(probability), F.lit(review_at), F.lit(reject_at))
    return (
        classify(df, probability)
        .groupBy(F.col("decision").alias("band_decision"), other.alias("threshold_decision"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("agree", F.col("band_decision") == F.col("threshold_decision"))
    )


def latest(df: DataFrame, key: str, version: Sequence[str]) -> DataFrame:
    """The row with the highest version per key.

    An aggregate, not a ranking window: versions of one key are merged before
    the shuffle, however many there are.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    newest = F.max_by(whole, F.struct(*[F.col(c) for c in version]))
    return df.groupBy(F.col(key).alias("__key")).agg(newest.alias("__row")).select("__row.*")


def upsert(current: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """The table after writing ``incoming`` over ``current``: per key, the highest
    version wins, and an incoming row wins over a current one of the same version.

    Write the result to a new path, never over the one being read.
    """
    rank = "__incoming"
    both = current.withColumn(rank, F.lit(0)).unionByName(incoming.withColumn(rank, F.lit(1)))
    return latest(both, key, [version, rank]).drop(rank)


def search_filter(id_column: str, search: str) -> Column:
    """Rows whose id equals the number searched for; other text matches nothing."""
    return F.col(id_column) == F.lit(search).try_cast("bigint") if search.isdigit() else F.lit(False)


def review_queue(
    scored: DataFrame,
    reviews: DataFrame,
    id_column: str,
    *,
    band: str | None = None,
    wanted_decision: str | None = None,
    min_score: int | None = None,
    max_score: int | None = None,
    search: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Scored rows that meet every given condition.

    ``reviews`` holds one row per reviewed id. 'pending' means not in it.
    """
    queue = scored
    if band is not None:
        queue = queue.filter(F.col("risk_band") == band)
    if wanted_decision is not None:
        queue = queue.filter(F.col("decision") == wanted_decision)
    if min_score is not None:
        queue = queue.filter(F.col("risk_score") >= min_score)
    if max_score is not None:
        queue = queue.filter(F.col("risk_score") <= max_score)
    if search is not None:
        queue = queue.filter(search_filter(id_column, search))
    if status is None:
        return queue
    if status not in REVIEW_STATUSES:
        raise ValueError(f"unknown review status {status!r}")
    if status == "pending":
        return queue.join(reviews.select(id_column), id_column, "left_anti")
    return queue.join(reviews.filter(F.col("status") == status).select(id_column), id_column, "left_semi")


def _order(sort: str, id_column: str) -> list[Column]:
    if sort not in SORT_ORDERS:
        raise ValueError(f"unknown sort order {sort!r}")
    name = sort.lstrip("-")
    first = F.col(name).desc() if sort.startswith("-") else F.col(name).asc()
    return [first, F.col(id_column).asc()]


def page(
    queue: DataFrame, id_column: str, number: int = 1, rows: int = PAGE_ROWS, sort: str = "-risk_score"
) -> DataFrame:
    """One page of the sorted queue. Deep pages cost their offset; see ``page_after``."""
    return queue.orderBy(*_order(sort, id_column)).offset((number - 1) * rows).limit(rows)


def page_after(
    queue: DataFrame, id_column: str, last_score: int, last_id: int, rows: int = PAGE_ROWS
) -> DataFrame:
    """The page that follows a known last row, by descending score; cost does not grow with depth."""
    behind = (F.col("risk_score") < last_score) | (
        (F.col("risk_score") == last_score) & (F.col(id_column) > last_id)
    )
    return queue.filter(behind).orderBy(*_order("-risk_score", id_column)).limit(rows)


def worklist(scored: DataFrame, reviews: DataFrame, id_column: str, number: int = 1) -> DataFrame:
    """The reviewer's list: pending rows from the middle band up, highest score first."""
    pending = review_queue(scored, reviews, id_column, min_score=WORKLIST_MIN_SCORE, status="pending")
    return page(pending, id_column, number)


def kpis(scored: DataFrame, reviews: DataFrame, id_column: str, amount: str) -> DataFrame:
    """Total, pending, mean score and amount at high risk."""
    reviewed = reviews.select(id_column, F.lit(1).alias("__reviewed"))
    high = F.col("risk_band").isin(*HIGH_RISK_BANDS)
    return scored.join(reviewed, id_column, "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("__reviewed").isNull(), 1)).alias("pending_review"),
        F.round(F.coalesce(F.avg("risk_score"), F.lit(0.0)), 1).alias("avg_risk_score"),
        F.coalesce(F.sum(F.when(high, F.col(amount))).cast("double"), F.lit(0.0)).alias("high_risk_amount"),
    )


def risk_by_band(scored: DataFrame) -> DataFrame:
    """Rows and share of each of the five bands, 0 for a band without rows."""
    total = F.count(F.lit(1))
    entries = []
    for position, (band, *_) in enumerate(RISK_BANDS, start=1):
        rows = F.count(F.when(F.col("risk_band") == band, 1))
        share = F.when(total > 0, F.round(rows / total * 100, 1)).otherwise(F.lit(0.0))
        entries.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(band).alias("risk_band"),
                rows.alias("rows"),
                share.alias("share_pct"),
            )
        )
    return scored.agg(F.array(*entries).alias("b")).select(F.explode("b").alias("b")).select("b.*")


def first_per_band(scored: DataFrame, order: Sequence[str], per_band: int) -> DataFrame:
    """Up to ``per_band`` rows of every band in the given order.

    Spark keeps only the first rows per band before the shuffle.
    """
    place = Window.partitionBy("risk_band").orderBy(*order)
    return (
        scored.withColumn("band_rank", F.row_number().over(place)).filter(F.col("band_rank") <= per_band)
    )


def demo_cases(
    df: DataFrame, label: str, prediction: str, probability: str, id_column: str, rows: int = CASES_PER_TYPE
) -> DataFrame:
    """The most certain cases of every type, ties by id."""
    place = Window.partitionBy("case_type").orderBy(F.col(probability).desc(), F.col(id_column).asc())
    return (
        df.withColumn("case_type", case_type(F.col(label), F.col(prediction)))
        .withColumn("case_rank", F.row_number().over(place))
        .filter(F.col("case_rank") <= rows)
    )


def dataset_catalogue(
    datasets: Mapping[str, DataFrame], label: str, baseline: float, trained_prefix: str = "train"
) -> DataFrame:
    """Rows, positive rate and fitness for evaluation of every dataset."""
    parts = []
    for name, df in datasets.items():
        labelled = label in df.columns
        rate = F.avg(label) if labelled else F.lit(None).cast("double")
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows"), rate.alias("positive_rate")).select(
                F.lit(name).alias("dataset"),
                "rows",
                "positive_rate",
                F.lit(labelled).alias("has_labels"),
                F.lit(name.startswith(trained_prefix)).alias("trained_on"),
            )
        )
    natural = F.coalesce(F.abs(F.col("positive_rate") - baseline) <= NATURAL_RATE_TOLERANCE, F.lit(False))
    return (
        union_all(parts)
        .withColumn("natural", natural)
        .withColumn("recommended", F.col("has_labels") & ~F.col("trained_on") & F.col("natural"))
        .orderBy(F.col("recommended").desc(), "dataset")
    )
