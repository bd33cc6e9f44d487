"""Queries: batches scored and explained by stored models, and kept in a stored table."""

from pyspark.sql import functions as F

from riskframe.catalog.quality import scratch
from riskframe.catalog.registry import query
from riskframe.catalog.tables import SPEC, clean
from riskframe.functions.risk import DEFAULT_FEATURE_VALUE
from riskframe.functions.rowwise import MISSING_CATEGORY
from riskframe.operators.ranking import Calibrator
from riskframe.operators.scorers import LinearScorer, Node, TreeScorer, explain, read_scorer, write_scorer
from riskframe.operators.training import Columns
from riskframe.plans.scoring import score_batch as score
from riskframe.sources.buckets import BucketTable

ID = SPEC.id
COLUMNS = Columns(ID, SPEC.label, ("amount", "dist1"), ("product",))
CODES = {"product": ("w", "c", "r")}

TREE = TreeScorer(
    (
        Node(
            0.10, "amount", at=50.0,
            left=Node(0.04, "product", texts=("w", "c"), left=Node(0.02), right=Node(0.07)),
            right=Node(
                0.25, "dist1", at=100.0,
                left=Node(0.20),
                right=Node(0.40, "amount", at=400.0, left=Node(0.30), right=Node(0.60)),
            ),
        ),
    ),
    (1.0,),
    CODES,
)
LINEAR = LinearScorer(
    -1.0,
    {"amount": 0.8, "dist1": -0.5, "product": 0.4},
    {"amount": 60.0, "dist1": 200.0, "product": 1.0},
    {"amount": 40.0, "dist1": 150.0, "product": 1.25},
    CODES,
)
STEPS = ((0.0, 0.1, 0.02), (0.2, 0.5, 0.3), (0.7, 1.0, 0.9))

FILLED = (
    "filled",
    f"""SELECT transaction_id, transaction_dt, CAST(coalesce(amount, 0) AS DECIMAL(12,2)) AS stored_amount,
       coalesce(CAST(amount AS DOUBLE), {DEFAULT_FEATURE_VALUE}.0::DOUBLE) AS amount,
       coalesce(dist1, {DEFAULT_FEATURE_VALUE}.0::DOUBLE) AS dist1, coalesce(product, '{MISSING_CATEGORY}') AS product FROM clean""",
)
WALKED = (
    "walked",
    """SELECT transaction_id,
       CASE WHEN amount <= 50 THEN CASE WHEN product IN ('w', 'c') THEN 0.02 ELSE 0.07 END
            WHEN dist1 <= 100 THEN 0.2 WHEN amount <= 400 THEN 0.3 ELSE 0.6 END::DOUBLE AS probability,
       CASE WHEN amount <= 50 THEN -0.06 WHEN dist1 <= 100 THEN 0.15 WHEN amount <= 400 THEN 0.05 ELSE 0.35 END::DOUBLE AS by_amount,
       CASE WHEN amount <= 50 THEN 'product' ELSE 'dist1' END AS other,
       CASE WHEN amount <= 50 THEN CASE WHEN product IN ('w', 'c') THEN -0.02 ELSE 0.03 END
            WHEN dist1 <= 100 THEN -0.05 ELSE 0.15 END::DOUBLE AS by_other FROM filled""",
)


@query(
    "tree_contributions",
    """SELECT transaction_id, probability, CAST(row_number() OVER (PARTITION BY transaction_id ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS place,
       feature, contribution, 0.1::DOUBLE AS base FROM (
           SELECT transaction_id, probability, 'amount' AS feature, by_amount AS contribution FROM walked
           UNION ALL SELECT transaction_id, probability, other, by_other FROM walked)""",
    (FILLED, WALKED),
)
def tree_contributions(spark, d):
    """What each feature on a row's path through a stored tree adds to the tree's base."""
    path = scratch(spark, "tree")
    write_scorer(spark, TREE, path)
    tree = read_scorer(spark, path)
    numbers = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(DEFAULT_FEATURE_VALUE))) for c in COLUMNS.numeric}
    rows = clean(spark, d).withColumns({**numbers, "product": F.coalesce("product", F.lit(MISSING_CATEGORY))})
    found = explain(rows.withColumn("probability", tree.probability()), tree, [ID, "probability"])
    return found.withColumns({"contribution": F.round("contribution", 9), "base": F.lit(tree.base())})


LINEAR_SQL = [("amount", "(amount - 60) * (0.8::DOUBLE / 40)"), ("product", "(CASE product WHEN 'w' THEN 0 WHEN 'c' THEN 1 WHEN 'r' THEN 2 ELSE 3 END - 1) * (0.4::DOUBLE / 1.25)")]


def _linear_sql(name: str, dist1: str) -> tuple[str, str]:
    parts = dict(LINEAR_SQL, dist1=f"({dist1} - 200) * (-0.5::DOUBLE / 150)")
    listed = ", ".join(f"{{'s': -abs({sql}), 'feature': '{feature}', 'value': {sql}}}" for feature, sql in parts.items())
    return name, f"SELECT *, 1 / (1 + exp(-(-1.0::DOUBLE + {' + '.join(parts.values())}))) AS raw, list_sort([{listed}]) AS parts FROM filled"


SCORED_SQL = """SELECT transaction_id, stored_amount AS amount, parts, '{version}' AS model_version, '{mode}' AS scoring_mode, {order_} AS n,
       CASE WHEN raw <= 0.1 THEN 0.02 WHEN raw < 0.2 THEN 0.02 + 0.28::DOUBLE * ((raw - 0.1) / 0.1) WHEN raw <= 0.5 THEN 0.3
            WHEN raw < 0.7 THEN 0.3 + 0.6::DOUBLE * ((raw - 0.5) / 0.2) ELSE 0.9 END::DOUBLE AS probability FROM {source}"""


@query(
    "score_batch",
    """SELECT transaction_id, amount, round(probability, 9) AS probability, risk_score,
       CASE WHEN risk_score <= 19 THEN 'low' WHEN risk_score <= 39 THEN 'guarded' WHEN risk_score <= 59 THEN 'medium'
            WHEN risk_score <= 79 THEN 'high' ELSE 'critical' END AS risk_band,
       CASE WHEN risk_score <= 39 THEN 'approve' WHEN risk_score <= 79 THEN 'review' ELSE 'reject' END AS decision,
       scoring_mode, model_version, parts[1].feature AS first_feature, round(parts[1].value, 9) AS first_contribution,
       parts[3].feature AS last_feature, round(parts[3].value, 9) AS last_contribution
       FROM (SELECT *, CAST(round_even(probability * 100, 0) AS INTEGER) AS risk_score,
             row_number() OVER (PARTITION BY transaction_id ORDER BY n DESC) AS turn FROM both_batches) WHERE turn = 1""",
    (
        FILLED,
        _linear_sql("with_all", "dist1"),
        _linear_sql("without_dist1", f"{DEFAULT_FEATURE_VALUE}"),
        (
            "both_batches",
            SCORED_SQL.format(version="v1", mode="full_feature", order_=1, source="with_all WHERE transaction_dt < 1728000")
            + " UNION ALL "
            + SCORED_SQL.format(version="v2", mode="partial_demo", order_=2, source="without_dist1 WHERE transaction_dt >= 864000"),
        ),
    ),
)
def score_batch(spark, d):
    """Two batches scored, explained, calibrated and merged into a stored table; the second lacks a feature and replaces rows of the first."""
    path = scratch(spark, "linear")
    write_scorer(spark, LINEAR, path)
    model = read_scorer(spark, path)
    curve = Calibrator(spark.createDataFrame(STEPS, "low double, high double, value double"))
    rows = clean(spark, d)
    table = BucketTable(scratch(spark, "scored"), (ID,), 16)
    first = rows.filter(f"{SPEC.time} < 1728000")
    table.create(score(first, model, curve, SPEC, COLUMNS, "v1", "2024-03-01 00:00:00"))
    second = rows.filter(f"{SPEC.time} >= 864000").drop("dist1")
    table.upsert(score(second, model, curve, SPEC, COLUMNS, "v2", "2024-03-02 00:00:00"), ["scored_at"])
    first_part, last_part = F.col("contributions")[0], F.col("contributions")[2]
    return table.read(spark).select(
        ID,
        "amount",
        F.round("probability", 9).alias("probability"),
        "risk_score",
        "risk_band",
        "decision",
        "scoring_mode",
        "model_version",
        first_part["feature"].alias("first_feature"),
        F.round(first_part["contribution"], 9).alias("first_contribution"),
        last_part["feature"].alias("last_feature"),
        F.round(last_part["contribution"], 9).alias("last_contribution"),
    )
