"""Bindings: transaction, side, scored, review and import tables from the test tables.

The same SQL expressions make the tables in Spark and in the checking SQL,
except for two that the engines spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.rowwise import base_features
from riskframe.operators.joins import left_join_with_marker
from riskframe.operators.splits import fit_boundaries, validation_windows
from riskframe.plans.prepare import Options, Prepared, prepare
from riskframe.spec import TableSpec

SPEC = TableSpec(
    id="transaction_id",
    time="transaction_dt",
    amount="amount",
    label="label",
    product="product",
    card_parts=("card1", "card2"),
    card_brand="card_brand",
    card_type="card_type",
    payer_email="p_email",
    receiver_email="r_email",
    device_type="device_type",
    device_info="device_info",
    distances=("dist1", "dist2"),
    addresses=("addr1", "addr2"),
    normalised=(
        "product", "card1", "card2", "card_brand", "card_type", "addr1", "addr2",
        "p_email", "r_email", "device_type", "device_info", "id_12",
    ),
    watched=(
        "amount", "product", "card1", "card2", "card_brand", "card_type", "addr1", "addr2",
        "p_email", "r_email", "device_type", "device_info", "dist1", "dist2",
    ),
)

LABELLED_UNTIL = 25 * 86400
GENERATED_AT = "2024-02-01T00:00:00+00:00"
BASELINE_RATE = 0.0335

SECONDS = {
    "spark": "unix_timestamp(ts) - 1704067200 + 86400",
    "duckdb": "epoch_us(ts)//1000000 - 1704067200 + 86400",
}
K = {
    "spark": "CAST(get_json_object(props,'$.k') AS INT)",
    "duckdb": "CAST(props->>'$.k' AS INT)",
}
TXN = """event_id AS transaction_id
dt AS transaction_dt
CASE WHEN event_id % 50 <> 7 THEN CAST(value AS DECIMAL(18,2)) END AS amount
CASE WHEN event_type = 'error' AND event_id % 6 = 0 THEN 1 ELSE 0 END AS label
CASE k % 6 WHEN 0 THEN ' W ' WHEN 1 THEN 'C' WHEN 2 THEN 'r' WHEN 3 THEN 'H' WHEN 4 THEN '  ' ELSE 'w' END AS product
CASE k % 4 WHEN 0 THEN 'Visa' WHEN 1 THEN 'mastercard' WHEN 2 THEN 'Discover' END AS card_brand
user_id AS card1
k % 3 AS card2
CASE user_id % 3 WHEN 0 THEN 'credit' WHEN 1 THEN 'debit' END AS card_type
CASE WHEN k % 8 <> 0 THEN user_id % 20 END AS addr1
CASE WHEN k % 8 < 6 THEN 87 END AS addr2
CASE WHEN k % 10 < 5 THEN 'gmail.com' WHEN k % 10 < 7 THEN 'Yahoo.com' WHEN k % 10 < 9 THEN 'mail.test' END AS p_email
CASE WHEN event_id % 3 = 0 THEN 'gmail.com' WHEN event_id % 3 = 1 THEN 'mail.test' END AS r_email
CASE WHEN event_id % 3 = 0 THEN value * 5 END AS dist1
CASE WHEN event_id % 14 = 0 THEN value * 3 END AS dist2""".splitlines()
IDENT = """event_id AS transaction_id
CASE WHEN k % 5 <> 0 THEN CAST(k AS DOUBLE) END AS id_01
CASE WHEN user_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device_type
CASE c_nationkey % 6 WHEN 0 THEN 'iPhone 12' WHEN 1 THEN 'SM-G960U' WHEN 2 THEN 'Windows NT' WHEN 3 THEN 'MacOS' WHEN 4 THEN 'rv:52' END AS device_info
c_mktsegment AS id_12""".splitlines()
# A missing amount counts as 0, as it does when a transaction is stored.
SCORED_AMOUNT = "coalesce(amount, CAST(0 AS DECIMAL(18,2)))"
SCORED = [
    "transaction_id",
    "transaction_dt",
    "label",
    f"{SCORED_AMOUNT} AS amount",
    f"CAST({SCORED_AMOUNT} AS DOUBLE)/(CAST({SCORED_AMOUNT} AS DOUBLE)+50) AS p",
]
# Some rows have no score, some one that is no number.
PARTLY_SCORED = ["label", "CASE WHEN transaction_id % 9 = 4 THEN NULL WHEN transaction_id % 31 = 3 THEN CAST('NaN' AS DOUBLE) ELSE p END AS p"]
REVIEW = [
    "event_id AS transaction_id",
    "CASE WHEN event_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status",
    "dt+60 AS updated_at",
]
REVIEW_AGAIN = ["event_id AS transaction_id", "'rejected' AS status", "dt+120 AS updated_at"]
RAW_IMPORT = """CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(event_id AS STRING) END AS transaction_id
CASE WHEN event_id % 101 = 0 THEN 'abc' WHEN event_id % 103 = 0 THEN '' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END AS amount""".splitlines()


def base(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ev(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder, "events").selectExpr(
        "event_id", f"{SECONDS['spark']} AS dt", "user_id", "event_type", "value", f"{K['spark']} AS k"
    )


def txn(spark: SparkSession, folder: str) -> DataFrame:
    return ev(spark, folder).selectExpr(*TXN)


def ident(spark: SparkSession, folder: str) -> DataFrame:
    customers = base(spark, folder, "customer")
    owners = ev(spark, folder).filter("event_id % 4 = 0")
    return owners.join(customers, F.col("c_custkey") == F.col("user_id")).selectExpr(*IDENT)


def wide(spark: SparkSession, folder: str) -> DataFrame:
    return left_join_with_marker(txn(spark, folder), ident(spark, folder), SPEC.id)


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return base_features(wide(spark, folder), SPEC)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return wide(spark, folder).filter(F.col(SPEC.time) < LABELLED_UNTIL)


def unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    return wide(spark, folder).filter(F.col(SPEC.time) >= LABELLED_UNTIL).drop(SPEC.label)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return txn(spark, folder).selectExpr(*SCORED)


def partly_scored(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).selectExpr(*PARTLY_SCORED)


def scored_windows(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Scored rows of the calibration, policy and holdout windows."""
    rows = scored(spark, folder)
    cuts = fit_boundaries(rows, SPEC.time)
    at = F.col(SPEC.time)
    validation = rows.filter((at > cuts.first) & (at <= cuts.second))
    tagged, _ = validation_windows(validation, SPEC.time)
    windows = {w: tagged.filter(F.col("window") == w) for w in ("selection", "calibration", "policy")}
    return {**windows, "holdout": rows.filter(at > cuts.second)}


def review_log(spark: SparkSession, folder: str) -> DataFrame:
    events = ev(spark, folder)
    return (
        events.filter("event_id % 3 = 0")
        .selectExpr(*REVIEW)
        .unionByName(events.filter("event_id % 12 = 0").selectExpr(*REVIEW_AGAIN))
    )


def raw_import(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder, "events").selectExpr(*RAW_IMPORT)


_PREPARED: dict[tuple[str, str], Prepared] = {}


def prepared(spark: SparkSession, folder: str) -> Prepared:
    """The model-ready datasets; prepared once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _PREPARED:
        options = Options(generated_at=GENERATED_AT)
        _PREPARED[key] = prepare(labelled(spark, folder), unlabelled(spark, folder), SPEC, options)
    return _PREPARED[key]


def _select(expressions: list[str], source: str) -> str:
    return f"SELECT {', '.join(expressions)} FROM {source}"


DEVICE_SQL = (
    "CASE WHEN regexp_matches(device_info, 'iphone|ipad|ios') THEN 'apple' "
    "WHEN regexp_matches(device_info, 'android|samsung|sm-') THEN 'android' "
    "WHEN regexp_matches(device_info, 'windows') THEN 'windows' "
    "WHEN regexp_matches(device_info, 'mac') THEN 'mac' ELSE 'other' END"
)
BAND_SQL = (
    "CASE WHEN amount <= 10 THEN '00_0_10' WHEN amount <= 25 THEN '01_10_25' WHEN amount <= 50 THEN '02_25_50' "
    "WHEN amount <= 100 THEN '03_50_100' WHEN amount <= 250 THEN '04_100_250' WHEN amount <= 500 THEN '05_250_500' "
    "WHEN amount <= 1000 THEN '06_500_1000' ELSE '07_1000_plus' END"
)


def _nulls(columns: tuple[str, ...] | list[str]) -> str:
    return "(" + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in columns) + ")"


def _key(*columns: str) -> str:
    return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '__NA__')" for c in columns)


IDENTITY_COLUMNS = ("id_01", "id_12")
TABLES_SQL: dict[str, str] = {
    "ev": f"SELECT event_id, {SECONDS['duckdb']} AS dt, user_id, event_type, value, {K['duckdb']} AS k FROM events",
    "txn": _select(TXN, "ev"),
    "ident": _select(IDENT, "ev JOIN customer ON c_custkey = user_id WHERE event_id % 4 = 0"),
    "wide": "SELECT t.*, i.id_01, i.device_type, i.device_info, i.id_12, "
    "CASE WHEN i.transaction_id IS NULL THEN 0 ELSE 1 END AS has_identity "
    "FROM txn t LEFT JOIN ident i ON i.transaction_id = t.transaction_id",
    "norm": "SELECT * REPLACE ("
    + ", ".join(f"nullif(lower(trim(CAST({c} AS VARCHAR))), '') AS {c}" for c in SPEC.normalised)
    + ") FROM wide",
    "clean": f"""SELECT *,
        CAST(floor(transaction_dt / 86400.0) AS BIGINT) AS transaction_day,
        CAST(floor(transaction_dt / 604800.0) AS BIGINT) AS transaction_week,
        CAST(floor((transaction_dt % 86400) / 3600.0) AS INTEGER) AS transaction_hour,
        CAST(floor(transaction_dt / 86400.0) AS BIGINT) % 7 AS transaction_day_of_week_proxy,
        transaction_dt / CAST(86400 AS DOUBLE) AS transaction_age_days,
        ln(1 + CAST(amount AS DOUBLE)) AS log_transaction_amount,
        CAST(amount AS DOUBLE) - floor(CAST(amount AS DOUBLE)) AS amount_decimal,
        {BAND_SQL} AS amount_band,
        {_nulls(SPEC.watched)} AS selected_missing_count,
        {_nulls(SPEC.watched)} / CAST({len(SPEC.watched)} AS DOUBLE) AS selected_missing_ratio,
        {_nulls(IDENTITY_COLUMNS)} AS identity_missing_count,
        {_nulls(IDENTITY_COLUMNS)} / CAST(2 AS DOUBLE) AS identity_missing_ratio,
        {DEVICE_SQL} AS device_family,
        {_key('card1', 'card2')} AS card_entity_key,
        {_key('p_email')} AS email_entity_key,
        {_key('device_type', 'device_info')} AS device_entity_key,
        {_key('addr1', 'addr2')} AS address_entity_key
        FROM norm""",
    "scored": _select(SCORED, "txn"),
    "partly_scored": "SELECT label, CASE WHEN p IS NULL OR isnan(p) THEN -1 ELSE p END AS p FROM (" + _select(PARTLY_SCORED, "scored") + ")",
    "review_log": _select(REVIEW, "ev WHERE event_id % 3 = 0")
    + " UNION ALL "
    + _select(REVIEW_AGAIN, "ev WHERE event_id % 12 = 0"),
    "review": "SELECT transaction_id, status, updated_at FROM (SELECT *, row_number() OVER "
    "(PARTITION BY transaction_id ORDER BY updated_at DESC) AS rn FROM review_log) WHERE rn = 1",
    "raw_import": _select(RAW_IMPORT, "events"),
    "banded": """SELECT *,
        CASE WHEN risk_score <= 19 THEN 'low' WHEN risk_score <= 39 THEN 'guarded' WHEN risk_score <= 59 THEN 'medium'
             WHEN risk_score <= 79 THEN 'high' ELSE 'critical' END AS risk_band,
        CASE WHEN risk_score <= 39 THEN 'approve' WHEN risk_score <= 79 THEN 'review' ELSE 'reject' END AS decision
        FROM (SELECT *, CAST(least(greatest(round_even(p * 100, 0), 0), 100) AS INTEGER) AS risk_score FROM scored)""",
    "scored_cuts": "SELECT quantile_disc(transaction_dt, 0.7) AS b1, quantile_disc(transaction_dt, 0.85) AS b2 FROM scored",
    "scored_validation": "SELECT s.* FROM scored s, scored_cuts c WHERE transaction_dt > b1 AND transaction_dt <= b2",
    "window_cuts": "SELECT quantile_disc(transaction_dt, 0.5) AS w1, quantile_disc(transaction_dt, 0.75) AS w2 FROM scored_validation",
    "calibration": "SELECT s.* FROM scored_validation s, window_cuts c WHERE transaction_dt > w1 AND transaction_dt <= w2",
    "policy": "SELECT s.* FROM scored_validation s, window_cuts c WHERE transaction_dt > w2",
    "holdout_scored": "SELECT s.* FROM scored s, scored_cuts c WHERE transaction_dt > b2",
}


def with_tables(sql: str, *extra: tuple[str, str]) -> str:
    """A complete statement: the bindings as CTEs, more CTEs, then the query."""
    steps = [*TABLES_SQL.items(), *extra]
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in steps) + f"\n{sql}"
