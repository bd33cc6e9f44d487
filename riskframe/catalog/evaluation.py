"""Queries: ranking metrics, thresholds, calibration and release gates."""

from pyspark.sql import functions as F

from riskframe.catalog.registry import query
from riskframe.catalog.tables import SPEC, partly_scored, prepared, scored, scored_windows
from riskframe.operators import ranking
from riskframe.operators.contract import contract_checks

LABEL, P = SPEC.label, "p"
HOLDOUT_THRESHOLD = 0.03
POINTS_SQL = """SELECT {p} AS p, sum(label) AS pos, count(*) - sum(label) AS neg FROM {table} GROUP BY 1"""
RUNNING_SQL = """SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
    FROM {points} WINDOW d AS (ORDER BY p DESC)"""
POINTS = ("points", POINTS_SQL.format(p="p", table="scored"))
RUNNING = ("running", RUNNING_SQL.format(points="points"))
AP_SQL = "sum(pos / CAST(all_pos AS DOUBLE) * tp / (tp + fp))"
AUC_SQL = "sum(pos / CAST(all_pos AS DOUBLE) * (all_neg - fp + neg / CAST(2 AS DOUBLE)) / all_neg)"


def rates_sql(source: str) -> str:
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
    FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
          CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall FROM ({source}))"""


def counts_sql(table: str, p: str, threshold: str) -> str:
    cases = {"tp": (1, ">="), "fp": (0, ">="), "tn": (0, "<"), "fn": (1, "<")}
    return ", ".join(
        f"count(*) FILTER (label = {y} AND {p} {op} {threshold}) AS {name}" for name, (y, op) in cases.items()
    )


METRICS = "tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def rounded(df, *extra):
    names = [c for c in ("precision", "recall", "f1", *extra) if c in df.columns]
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("average_precision", f"SELECT round({AP_SQL}, 6) AS pr_auc FROM running", (POINTS, RUNNING))
def average_precision(spark, d):
    return ranking.rank_metrics(scored(spark, d), P, LABEL).select(F.round("pr_auc", 6).alias("pr_auc"))


@query("roc_auc", f"SELECT round({AUC_SQL}, 6) AS roc_auc FROM running", (POINTS, RUNNING))
def roc_auc(spark, d):
    return ranking.rank_metrics(scored(spark, d), P, LABEL).select(F.round("roc_auc", 6).alias("roc_auc"))


@query(
    "binary_metrics",
    f"""SELECT {METRICS}, pr_auc, roc_auc, 0.5::DOUBLE AS threshold FROM
    ({rates_sql('SELECT ' + counts_sql('scored', 'p', '0.5') + ' FROM scored')}),
    (SELECT round({AP_SQL}, 6) AS pr_auc, round({AUC_SQL}, 6) AS roc_auc FROM running)""",
    (POINTS, RUNNING),
)
def binary_metrics(spark, d):
    return rounded(ranking.binary_metrics(scored(spark, d), P, LABEL, 0.5), "pr_auc", "roc_auc")


PARTLY = (
    ("m_points", POINTS_SQL.format(p="p", table="partly_scored")),
    ("m_running", RUNNING_SQL.format(points="m_points")),
)


@query(
    "binary_metrics_missing",
    f"""SELECT {METRICS}, pr_auc, roc_auc, 0.5::DOUBLE AS threshold FROM
    ({rates_sql('SELECT ' + counts_sql('partly_scored', 'p', '0.5') + ' FROM partly_scored')}),
    (SELECT round({AP_SQL}, 6) AS pr_auc, round({AUC_SQL}, 6) AS roc_auc FROM m_running)""",
    PARTLY,
)
def binary_metrics_missing(spark, d):
    """Rows without a score rank below all others and are never above a threshold."""
    return rounded(ranking.binary_metrics(partly_scored(spark, d), P, LABEL, 0.5), "pr_auc", "roc_auc")


@query(
    "confusion_metrics",
    f"SELECT {METRICS} FROM ({rates_sql('SELECT ' + counts_sql('scored', 'p', '0.5') + ' FROM scored')})",
)
def confusion_metrics(spark, d):
    rows = scored(spark, d).withColumn("prediction", (F.col(P) >= 0.5).cast("int"))
    return rounded(ranking.confusion_metrics(rows, LABEL, "prediction"))


def grid_sql(table: str) -> str:
    return rates_sql(
        "SELECT t AS threshold, "
        + counts_sql(table, "p", "t")
        + f" FROM {table}, (SELECT i / CAST(100 AS DOUBLE) AS t FROM range(5, 96) r(i)) GROUP BY t"
    )


TABLE = ("grid_table", grid_sql("scored"))


@query("threshold_table_missing", f"SELECT threshold, {METRICS} FROM ({grid_sql('partly_scored')})")
def threshold_table_missing(spark, d):
    return rounded(ranking.threshold_table(partly_scored(spark, d), P, LABEL))



@query("threshold_table", f"SELECT threshold, {METRICS} FROM grid_table", (TABLE,))
def threshold_table(spark, d):
    return rounded(ranking.threshold_table(scored(spark, d), P, LABEL))


def policy_steps(review: str, reject: str) -> tuple[tuple[str, str], ...]:
    return (
        (
            "reviewed",
            f"""SELECT threshold AS review_threshold, precision AS review_precision FROM grid_table
            ORDER BY precision >= {review} DESC, recall DESC, f1 DESC, precision DESC, threshold LIMIT 1""",
        ),
        (
            "rejected",
            f"""SELECT threshold AS reject_threshold, precision AS reject_precision, precision >= {reject} AS ok
            FROM grid_table, reviewed WHERE threshold >= review_threshold
            ORDER BY precision >= {reject} DESC, CASE WHEN precision >= {reject} THEN -threshold ELSE precision END DESC,
            recall DESC, threshold DESC LIMIT 1""",
        ),
    )


def policy_select(review: str, reject: str) -> str:
    return f"""SELECT review_threshold, reject_threshold, '{ranking.REVIEW_RULE}' AS selection_rule,
    CASE WHEN ok THEN '{ranking.REJECT_RULE}' ELSE '{ranking.REJECT_FALLBACK_RULE}' END AS reject_selection_rule,
    {review}::DOUBLE AS min_precision, {reject}::DOUBLE AS min_reject_precision,
    round(review_precision, 6) AS selected_review_precision, round(reject_precision, 6) AS selected_reject_precision
    FROM reviewed, rejected"""


def _policy(name: str, review: float, reject: float):
    r, j = f"{review}::DOUBLE", f"{reject}::DOUBLE"

    @query(name, policy_select(str(review), str(reject)), (TABLE, *policy_steps(r, j)))
    def run(spark, d):
        table = ranking.threshold_table(scored(spark, d), P, LABEL)
        policy = ranking.threshold_policy(table, review, reject)
        return policy.withColumns(
            {c: F.round(c, 6) for c in ("selected_review_precision", "selected_reject_precision")}
        )

    return run


threshold_policy = _policy("threshold_policy", ranking.MIN_REVIEW_PRECISION, ranking.MIN_REJECT_PRECISION)
# Limits the synthetic scores can reach, so that the first-choice rules apply too.
threshold_policy_reachable = _policy("threshold_policy_reachable", 0.032, 0.034)

# --- calibration: the isotonic fit as a max-min formula over the distinct scores ------------

ISOTONIC = (
    (
        "bins",
        """SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs FROM (
        SELECT p AS x, count(*) AS w, sum(label) AS s FROM calibration GROUP BY 1)""",
    ),
    (
        "segments",
        """SELECT a.i AS lo, b.i AS hi, (b.cs - coalesce(z.cs, 0)) / CAST(b.cw - coalesce(z.cw, 0) AS DOUBLE) AS m
        FROM bins a JOIN bins b ON b.i >= a.i LEFT JOIN bins z ON z.i = a.i - 1""",
    ),
    (
        "curve",
        """SELECT x, max(m) AS y FROM (SELECT c.i, c.x, s.lo, min(s.m) AS m FROM bins c
        JOIN segments s ON s.lo <= c.i AND s.hi >= c.i GROUP BY 1, 2, 3) GROUP BY x""",
    ),
)


def calibrated_sql(table: str) -> str:
    """Rows of ``table`` with the curve's value, linear between its points and flat outside."""
    return f"""SELECT t.*, CASE WHEN x1 IS NULL THEN y2 WHEN x2 IS NULL OR x1 = x2 THEN y1
        ELSE y1 + (y2 - y1) * (g - x1) / (x2 - x1) END AS calibrated
    FROM (SELECT *, p AS g FROM {table}) t JOIN (
      SELECT q.g AS gg, (SELECT max(x) FROM curve WHERE x <= q.g) AS x1, (SELECT min(x) FROM curve WHERE x >= q.g) AS x2,
        (SELECT arg_max(y, x) FROM curve WHERE x <= q.g) AS y1, (SELECT arg_min(y, x) FROM curve WHERE x >= q.g) AS y2
      FROM (SELECT DISTINCT p AS g FROM {table}) q) k ON k.gg = t.g"""


def calibrated(spark, d, window: str):
    windows = scored_windows(spark, d)
    calibrator = ranking.fit_calibrator(windows["calibration"], P, LABEL)
    return calibrator.apply(windows[window], P)


@query(
    "isotonic_calibration",
    "SELECT transaction_id, p, round(calibrated, 6) AS calibrated FROM done",
    (*ISOTONIC, ("done", calibrated_sql("policy"))),
)
def isotonic_calibration(spark, d):
    return calibrated(spark, d, "policy").select("transaction_id", P, F.round("calibrated", 6).alias("calibrated"))


BRIER_SQL = "avg((p - label) * (p - label)) AS raw_brier_score, avg((calibrated - label) * (calibrated - label)) AS brier_score"


@query(
    "brier_scores",
    f"""SELECT round(raw_brier_score, 6) AS raw_brier_score, round(brier_score, 6) AS brier_score,
        brier_score <= raw_brier_score AS calibration_improved FROM (SELECT {BRIER_SQL} FROM done)""",
    (*ISOTONIC, ("done", calibrated_sql("policy"))),
)
def brier_scores(spark, d):
    scores = ranking.brier_scores(calibrated(spark, d, "policy"), P, "calibrated", LABEL)
    return scores.withColumns({c: F.round(c, 6) for c in ("raw_brier_score", "brier_score")})


HOLDOUT = (
    *ISOTONIC,
    ("done", calibrated_sql("holdout_scored")),
    # Isotonic values are equal within a block; rounding keeps them equal in both engines.
    ("rounded", "SELECT label, p, round(calibrated, 9) AS calibrated FROM done"),
    ("h_points", POINTS_SQL.format(p="calibrated", table="rounded")),
    ("h_running", RUNNING_SQL.format(points="h_points")),
    (
        "h_metrics",
        f"""SELECT * FROM ({rates_sql('SELECT ' + counts_sql('rounded', 'calibrated', str(HOLDOUT_THRESHOLD)) + ' FROM rounded')}),
        (SELECT {AP_SQL} AS pr_auc, {AUC_SQL} AS roc_auc FROM h_running), (SELECT {BRIER_SQL} FROM rounded)""",
    ),
)


def _holdout(spark, d):
    rows = calibrated(spark, d, "holdout").withColumn("calibrated", F.round("calibrated", 9))
    return ranking.holdout_metrics(rows, P, "calibrated", LABEL, HOLDOUT_THRESHOLD)


@query(
    "holdout_metrics",
    f"""SELECT {METRICS}, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, {HOLDOUT_THRESHOLD}::DOUBLE AS threshold,
        round(raw_brier_score, 6) AS raw_brier_score, round(brier_score, 6) AS brier_score,
        brier_score <= raw_brier_score AS calibration_improved FROM h_metrics""",
    HOLDOUT,
)
def holdout_metrics(spark, d):
    return rounded(_holdout(spark, d), "pr_auc", "roc_auc", "raw_brier_score", "brier_score")


@query(
    "release_gates",
    """SELECT gate, round(value, 6) AS value, round(bound, 6) AS bound, passed FROM (
       SELECT 'holdout_pr_auc' AS gate, pr_auc AS value, 0.4582::DOUBLE AS bound, pr_auc >= 0.4582 AS passed FROM h_metrics
       UNION ALL SELECT 'holdout_roc_auc', roc_auc, 0.8746, roc_auc >= 0.8746 FROM h_metrics
       UNION ALL SELECT 'review_precision', precision, 0.30, precision >= 0.30 FROM h_metrics
       UNION ALL SELECT 'calibration_non_regression', brier_score, raw_brier_score, brier_score <= raw_brier_score FROM h_metrics
       UNION ALL SELECT 'data_contract_verification', 1, 1, true FROM h_metrics)""",
    HOLDOUT,
)
def release_gates(spark, d):
    failed = contract_checks(prepared(spark, d).datasets, SPEC).filter(~F.col("ok")).limit(1).count()
    gates = ranking.release_gates(_holdout(spark, d), failed == 0)
    return gates.withColumns({c: F.round(c, 6) for c in ("value", "bound")})


@query(
    "release_status",
    """SELECT CASE WHEN len(failed) = 0 THEN 'eligible_for_promotion_review' ELSE 'not_promoted' END AS status,
       array_to_string(failed, ',') AS failed_gates FROM (SELECT list_filter([
         CASE WHEN NOT brier_score <= raw_brier_score THEN 'calibration_non_regression' END,
         CASE WHEN NOT pr_auc >= 0.4582 THEN 'holdout_pr_auc' END,
         CASE WHEN NOT roc_auc >= 0.8746 THEN 'holdout_roc_auc' END,
         CASE WHEN NOT precision >= 0.30 THEN 'review_precision' END], lambda g: g IS NOT NULL) AS failed FROM h_metrics)""",
    HOLDOUT,
)
def release_status(spark, d):
    status = ranking.release_status(ranking.release_gates(_holdout(spark, d), True))
    return status.withColumn("failed_gates", F.array_join("failed_gates", ","))
