"""The exploratory reports of a labelled table, written once from one materialised table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.rowwise import base_features
from riskframe.operators import profile, rates
from riskframe.operators.fitted import amount_by_class, correlation_matrix
from riskframe.session import materialise
from riskframe.sources.files import write_report
from riskframe.spec import TableSpec

CORRELATED = ("log_transaction_amount", "selected_missing_ratio", "identity_missing_ratio")


def reports(df: DataFrame, spec: TableSpec) -> dict[str, DataFrame]:
    """All bounded reports over ``base_features`` of a labelled table."""

    def plain(column: str, **options) -> DataFrame:
        return rates.rate_by(df, {column: F.col(column)}, spec, **options).orderBy(column)

    def category(*columns: str) -> DataFrame:
        groups = {c: rates.or_missing(c) for c in columns}
        rated = rates.rate_by(df, groups, spec, rates.MIN_SUPPORT_RATE)
        return rated.orderBy(F.col("rate_pct").desc(), F.col("transactions").desc(), *columns)

    def entity(name: str, support: int) -> DataFrame:
        return rates.rate_by(df, {name: F.col(name)}, spec, support)

    bucket = {"missing_ratio_bucket": F.round("selected_missing_ratio", 1)}
    found = {
        "rate_overview": rates.overview(df, spec),
        "rate_by_product": rates.rate_by(
            df, {spec.product: rates.or_missing(spec.product)}, spec, with_amount=True
        ).orderBy(F.col("rate_pct").desc(), spec.product),
        "rate_by_card_brand": category(spec.card_brand),
        "rate_by_card_type": category(spec.card_type),
        "rate_by_device": category(spec.device_type, "device_family"),
        "rate_by_email": category(spec.payer_email).limit(rates.REPORT_ROWS),
        "rate_by_r_email": category(spec.receiver_email).limit(rates.REPORT_ROWS),
        "rate_by_amount_band": plain("amount_band"),
        "rate_by_hour": plain("transaction_hour", with_amount=True),
        "rate_by_day": plain("transaction_day"),
        "rate_by_week": plain("transaction_week"),
        "rate_by_has_identity": plain("has_identity"),
        "rate_by_missing_ratio": rates.rate_by(df, bucket, spec).orderBy("missing_ratio_bucket"),
        "top_rate_entities": rates.top_by_rate(
            entity("card_entity_key", rates.MIN_SUPPORT_RATE), "card_entity_key"
        ),
        "class_distribution": profile.class_distribution(df, spec.label).orderBy(spec.label),
        "imbalance_summary": profile.imbalance_summary(df, spec.label),
        "amount_by_class": amount_by_class(df, spec),
        "correlation_matrix": correlation_matrix(df, [spec.amount, *CORRELATED, *spec.distances]),
    }
    for name in ("card", "email", "device"):
        key = f"{name}_entity_key"
        found[f"top_{name}_entities"] = rates.top_by_volume(entity(key, rates.MIN_SUPPORT_VOLUME), key)
    return found


def write_reports(joined: DataFrame, spec: TableSpec, folder: str) -> None:
    """Profile the joined table, derive its row features once, and write every report."""
    strategy = profile.missingness_strategy(profile.column_profile(joined, "train"))
    write_report(strategy.orderBy(F.col("null_pct").desc(), "column_name"), f"{folder}/column_profile")
    write_report(profile.type_summary(joined, "train_joined"), f"{folder}/type_conversion_summary")
    rows = materialise(base_features(joined, spec), "row_features")
    for name, report in reports(rows, spec).items():
        write_report(report, f"{folder}/{name}")
