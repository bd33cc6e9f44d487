"""Queries: row features, joins and point-in-time history."""

from pyspark.sql import functions as F

from riskframe.catalog.registry import query
from riskframe.catalog.tables import LABELLED_UNTIL, SPEC, base, clean, ident, labelled, txn, unlabelled, wide
from riskframe.functions import rowwise
from riskframe.operators.fitted import fit_amount_thresholds
from riskframe.operators.history import add_history, entity_state, history_for_unlabelled, merge_state
from riskframe.session import materialise
from riskframe.operators.joins import join_audit, left_join_with_marker, lookup_history
from riskframe.operators.splits import fit_boundaries
from riskframe.spec import CARD_HISTORY, DEVICE_HISTORY, EMAIL_HISTORY

ID, TIME = SPEC.id, SPEC.time
NORMALISED = ", ".join(SPEC.normalised)


@query("normalize_categoricals", f"SELECT transaction_id, {NORMALISED} FROM norm")
def normalize_categoricals(spark, d):
    return rowwise.normalise(wide(spark, d), SPEC).select(ID, *SPEC.normalised)


@query(
    "time_features",
    """SELECT transaction_id, transaction_day, transaction_week, transaction_hour,
       CAST(transaction_day_of_week_proxy AS INTEGER) AS transaction_day_of_week_proxy, transaction_age_days,
       CASE WHEN transaction_hour <= 5 OR transaction_hour >= 22 THEN 1 ELSE 0 END AS is_night_transaction,
       'week_' || transaction_week AS transaction_period FROM clean""",
)
def time_features(spark, d):
    return txn(spark, d).select(ID, *[c.alias(n) for n, c in rowwise.time_parts(TIME).items()])


@query(
    "amount_features",
    """SELECT transaction_id, round(log_transaction_amount, 6) AS log_transaction_amount,
       round(amount_decimal, 2) AS amount_decimal, amount_band FROM clean""",
)
def amount_features(spark, d):
    parts = rowwise.amount_parts(SPEC.amount)
    return txn(spark, d).select(
        ID,
        F.round(parts["log_transaction_amount"], 6).alias("log_transaction_amount"),
        F.round(parts["amount_decimal"], 2).alias("amount_decimal"),
        parts["amount_band"].alias("amount_band"),
    )


MISSING = ("selected_missing_count", "selected_missing_ratio", "identity_missing_count", "identity_missing_ratio")


@query("row_missingness", f"SELECT transaction_id, {', '.join(MISSING)} FROM clean")
def row_missingness(spark, d):
    return clean(spark, d).select(ID, *MISSING)


@query(
    "presence_flags",
    """SELECT transaction_id, CAST(device_info IS NOT NULL AS INTEGER) AS has_device_info,
       CAST(p_email IS NOT NULL AS INTEGER) AS has_p_email, CAST(r_email IS NOT NULL AS INTEGER) AS has_r_email,
       CAST(dist1 IS NOT NULL OR dist2 IS NOT NULL AS INTEGER) AS has_distance,
       CAST(addr1 IS NOT NULL OR addr2 IS NOT NULL AS INTEGER) AS has_address,
       CAST(coalesce(p_email, '__NA__') = coalesce(r_email, '__NA__') AS INTEGER) AS same_email_domain FROM norm""",
)
def presence_flags(spark, d):
    flags = rowwise.presence(SPEC)
    return rowwise.normalise(wide(spark, d), SPEC).select(ID, *[c.alias(n) for n, c in flags.items()])


@query("device_family", "SELECT transaction_id, device_info, device_family FROM clean")
def device_family(spark, d):
    return clean(spark, d).select(ID, "device_info", "device_family")


KEYS = ("card_entity_key", "email_entity_key", "device_entity_key", "address_entity_key")


@query("entity_keys", f"SELECT transaction_id, {', '.join(KEYS)} FROM clean")
def entity_keys(spark, d):
    return clean(spark, d).select(ID, *KEYS)


CUTS = ("cuts", "SELECT quantile_disc(transaction_dt, 0.7) AS b1, quantile_disc(transaction_dt, 0.85) AS b2 FROM clean")
LIMITS = (
    "limits",
    """SELECT p95, p99, p25, p75, p75 - p25 AS iqr, p75 + 1.5 * (p75 - p25) AS upper_cap FROM (
       SELECT quantile_disc(CAST(amount AS DOUBLE), 0.25) AS p25, quantile_disc(CAST(amount AS DOUBLE), 0.75) AS p75,
              quantile_disc(CAST(amount AS DOUBLE), 0.95) AS p95, quantile_disc(CAST(amount AS DOUBLE), 0.99) AS p99
       FROM clean, cuts WHERE transaction_dt <= b1)""",
)


@query(
    "outlier_flags",
    """SELECT transaction_id, round(least(CAST(amount AS DOUBLE), upper_cap), 6) AS transaction_amount_capped,
       CASE WHEN amount >= p99 THEN 1 ELSE 0 END AS high_amount_flag,
       CASE WHEN amount >= upper_cap THEN 1 ELSE 0 END AS amount_outlier_flag,
       CASE WHEN dist1 >= 1000 OR dist2 >= 1000 THEN 1 ELSE 0 END AS distance_outlier_flag
       FROM clean, limits""",
    (CUTS, LIMITS),
)
def outlier_flags(spark, d):
    rows = txn(spark, d)
    train = rows.filter(F.col(TIME) <= fit_boundaries(rows, TIME).first)
    limits = fit_amount_thresholds(train, SPEC.amount)
    flags = rowwise.outlier_flags(SPEC, limits.upper_cap, limits.p99)
    flags["transaction_amount_capped"] = F.round(flags["transaction_amount_capped"], 6)
    return rows.select(ID, *[c.alias(n) for n, c in flags.items()])


def frame(key: str) -> str:
    return (
        f"(PARTITION BY {key} ORDER BY transaction_dt, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )


CARD_SQL = """count(*) OVER card AS prior_card_transaction_count,
    coalesce(CAST(sum(amount) OVER card AS DOUBLE), 0.0) AS prior_card_amount_sum,
    CASE WHEN count(*) OVER card > 0 THEN coalesce(CAST(sum(amount) OVER card AS DOUBLE), 0.0) / count(*) OVER card
         ELSE 0.0 END AS prior_card_avg_amount,
    round(coalesce(stddev_samp(CAST(amount AS DOUBLE)) OVER card, 0.0), 4) AS prior_card_amount_stddev,
    CAST(transaction_dt - max(transaction_dt) OVER card AS DOUBLE) AS time_since_previous_card_transaction"""


def other_sql(entity: str) -> str:
    return f"""count(*) OVER {entity} AS prior_{entity}_transaction_count,
    coalesce(CAST(sum(amount) OVER {entity} AS DOUBLE), 0.0) AS prior_{entity}_amount_sum,
    coalesce(CAST(sum(amount) OVER {entity} AS DOUBLE) / nullif(count(amount) OVER {entity}, 0), 0.0) AS prior_{entity}_avg_amount"""


WINDOWS_SQL = ", ".join(f"{e} AS {frame(e + '_entity_key')}" for e in ("card", "email", "device"))
HISTORY_SQL = f"{CARD_SQL}, {other_sql('email')}, {other_sql('device')}"
HISTORY = (
    "history",
    f"SELECT *, {HISTORY_SQL} FROM clean WINDOW {WINDOWS_SQL}",
)


def history_columns(entity: str) -> list[str]:
    return list({"card": CARD_HISTORY, "email": EMAIL_HISTORY, "device": DEVICE_HISTORY}[entity])


def narrow(df):
    return df.select(ID, TIME, SPEC.amount, *KEYS[:3])


def rounded(df, columns):
    return df.select(
        ID, *[F.round(c, 4).alias(c) if c == "prior_card_amount_stddev" else F.col(c) for c in columns]
    )


def _history_query(entity: str):
    columns = history_columns(entity)
    key = f"{entity}_entity_key"

    @query(f"pit_history_{entity}", f"SELECT transaction_id, {key}, {', '.join(columns)} FROM history", (HISTORY,))
    def run(spark, d):
        rows = clean(spark, d).select(ID, TIME, SPEC.amount, key)
        return rounded(add_history(rows, SPEC, [entity]), [key, *columns])

    return run


pit_history_card = _history_query("card")
pit_history_email = _history_query("email")
pit_history_device = _history_query("device")
ALL_HISTORY = [c for e in ("card", "email", "device") for c in history_columns(e)]


@query("pit_history_hot_keys", f"SELECT transaction_id, {', '.join(ALL_HISTORY)} FROM history", (HISTORY,))
def pit_history_hot_keys(spark, d):
    """All histories with every key above 200 rows cut into time chunks. The rows are read several times, so their join is written first."""
    rows = materialise(narrow(clean(spark, d)), "rows")
    return rounded(add_history(rows, SPEC, rows_per_task=200), ALL_HISTORY)


@query(
    "pit_history_unlabelled",
    f"SELECT transaction_id, {', '.join(ALL_HISTORY)} FROM history WHERE transaction_dt >= {LABELLED_UNTIL}",
    (HISTORY,),
)
def pit_history_unlabelled(spark, d):
    past = rowwise.base_features(labelled(spark, d), SPEC)
    new = rowwise.base_features(unlabelled(spark, d), SPEC)
    return rounded(history_for_unlabelled(narrow(past), narrow(new), SPEC), ALL_HISTORY)


@query(
    "pit_history_incremental",
    f"SELECT transaction_id, {', '.join(ALL_HISTORY)} FROM history WHERE transaction_dt >= {LABELLED_UNTIL}",
    (HISTORY,),
)
def pit_history_incremental(spark, d):
    """Histories of the last rows from stored states of two earlier stretches, without reading the rows behind them."""
    rows = narrow(clean(spark, d))
    middle = LABELLED_UNTIL // 2
    stored = materialise(entity_state(rows.filter(F.col(TIME) < middle), SPEC), "state")
    newer = entity_state(rows.filter((F.col(TIME) >= middle) & (F.col(TIME) < LABELLED_UNTIL)), SPEC)
    stored = materialise(merge_state(stored, newer), "state")
    batch = rows.filter(F.col(TIME) >= LABELLED_UNTIL)
    return rounded(add_history(batch, SPEC, rows_per_task=500, state=stored), ALL_HISTORY)


@query(
    "amount_vs_history",
    """SELECT transaction_id,
       CASE WHEN prior_card_avg_amount > 0 THEN CAST(amount AS DOUBLE) / prior_card_avg_amount ELSE 1.0 END AS amount_ratio_to_card_mean,
       CAST(amount AS DOUBLE) - prior_card_avg_amount AS amount_deviation_from_card_mean FROM history""",
    (HISTORY,),
)
def amount_vs_history(spark, d):
    rows = clean(spark, d).select(ID, TIME, SPEC.amount, "card_entity_key")
    ratios = rowwise.amount_against_mean(SPEC.amount, "prior_card_avg_amount")
    return add_history(rows, SPEC, ["card"]).select(ID, *[c.alias(n) for n, c in ratios.items()])


@query("identity_left_join", "SELECT transaction_id, id_01, device_type, device_info, id_12, has_identity FROM wide")
def identity_left_join(spark, d):
    joined = left_join_with_marker(txn(spark, d).select(ID), ident(spark, d), ID)
    return joined.select(ID, "id_01", "device_type", "device_info", "id_12", "has_identity")


def audit_sql(dataset: str, left: str, right: str, left_key: str, right_key: str) -> str:
    return f"""SELECT '{dataset}' AS dataset, l AS rows_before, r AS side_rows, j AS rows_after, m AS matched_rows,
       j - m AS unmatched_rows, j - l AS row_difference, CASE WHEN j = l THEN 'pass' ELSE 'fail' END AS status
       FROM (SELECT (SELECT count(*) FROM {left}) AS l, (SELECT count(*) FROM {right}) AS r,
             count(*) AS j, count(b.{right_key}) AS m
             FROM {left} a LEFT JOIN {right} b ON a.{left_key} = b.{right_key})"""


@query("join_audit_pass", audit_sql("train", "txn", "ident", "transaction_id", "transaction_id"))
def join_audit_pass(spark, d):
    return join_audit(txn(spark, d), ident(spark, d), ID, "train")


@query("join_audit_fanout", audit_sql("orders", "orders", "lineitem", "o_orderkey", "l_orderkey"))
def join_audit_fanout(spark, d):
    orders = base(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"))
    lines = base(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    return join_audit(orders, lines, "orderkey", "orders")


TRAIN = ("train", "SELECT clean.* FROM clean, cuts WHERE transaction_dt <= b1")
LOOKUP = tuple(
    (
        f"{e}_agg",
        f"""SELECT {e}_entity_key, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS s,
        CAST(sum(amount) AS DOUBLE) / nullif(count(amount), 0) AS m,
        stddev_samp(CAST(amount AS DOUBLE)) AS sd, max(transaction_dt) AS last FROM train GROUP BY 1""",
    )
    for e in ("card", "email", "device")
)


@query(
    "train_lookup_features",
    """SELECT transaction_id, coalesce(c.n, 0) AS prior_card_transaction_count, coalesce(c.s, 0.0) AS prior_card_amount_sum,
       CASE WHEN c.n > 0 THEN coalesce(c.s, 0.0) / c.n ELSE 0.0 END AS prior_card_avg_amount,
       round(coalesce(c.sd, 0.0), 4) AS prior_card_amount_stddev,
       CAST(transaction_dt - c.last AS DOUBLE) AS time_since_previous_card_transaction,
       coalesce(e.n, 0) AS prior_email_transaction_count, coalesce(e.s, 0.0) AS prior_email_amount_sum,
       coalesce(e.m, 0.0) AS prior_email_avg_amount,
       coalesce(v.n, 0) AS prior_device_transaction_count, coalesce(v.s, 0.0) AS prior_device_amount_sum,
       coalesce(v.m, 0.0) AS prior_device_avg_amount
       FROM clean LEFT JOIN card_agg c USING (card_entity_key) LEFT JOIN email_agg e USING (email_entity_key)
       LEFT JOIN device_agg v USING (device_entity_key)""",
    (CUTS, TRAIN, *LOOKUP),
)
def train_lookup_features(spark, d):
    rows = narrow(clean(spark, d))
    train = rows.filter(F.col(TIME) <= fit_boundaries(txn(spark, d), TIME).first)
    return rounded(lookup_history(rows, train, SPEC, ["card", "email", "device"]), ALL_HISTORY)
