"""Queries: scoring policy, review queue, imports and KPIs."""

import uuid

from pyspark.sql import functions as F

from riskframe.catalog.registry import query
from riskframe.catalog.tables import SPEC, raw_import, review_log, scored, txn, wide
from riskframe.functions import risk
from riskframe.operators import queue
from riskframe.session import shared_folder
from riskframe.sources import batch_import
from riskframe.sources.buckets import BucketTable

ID, P = SPEC.id, "p"


def banded(spark, d):
    return queue.classify(scored(spark, d), P)


def reviews(spark, d):
    return queue.latest(review_log(spark, d), ID, ["updated_at"])


SHOWN = (ID, "risk_score", "risk_band", "decision")
SHOWN_SQL = ", ".join(SHOWN)


@query("risk_score", "SELECT transaction_id, p, risk_score FROM banded")
def risk_score(spark, d):
    return scored(spark, d).select(ID, P, risk.risk_score(F.col(P)).alias("risk_score"))


@query("risk_bands", f"SELECT {SHOWN_SQL} FROM banded")
def risk_bands(spark, d):
    return banded(spark, d).select(*SHOWN)


@query(
    "policy_disagreement",
    """SELECT *, band_decision = threshold_decision AS agree FROM (SELECT decision AS band_decision,
       CASE WHEN p >= 0.53 THEN 'reject' WHEN p >= 0.16 THEN 'review' ELSE 'approve' END AS threshold_decision,
       count(*) AS rows FROM banded GROUP BY 1, 2)""",
)
def policy_disagreement(spark, d):
    return queue.policy_disagreement(scored(spark, d), P, review_at=0.16, reject_at=0.53)


@query(
    "fallback_score",
    """SELECT transaction_id, round(least(greatest(0.7 / (1 + exp(-(ln(1 + a) - 6) / 1.5))
         + 0.3 * CAST(('0x' || substr(sha256(CAST(CAST(a AS DECIMAL(18,2)) AS VARCHAR)), 1, 2)) AS INTEGER) / 255, 0.01), 0.99), 6) AS probability
       FROM (SELECT transaction_id, coalesce(CAST(amount AS DOUBLE), 0) AS a FROM txn)""",
)
def fallback_score(spark, d):
    probability = risk.fallback_probability(F.col(SPEC.amount))
    return txn(spark, d).select(ID, F.round(probability, 6).alias("probability"))


@query(
    "scoring_mode",
    "SELECT transaction_id, CASE WHEN has_identity = 1 THEN 'full_feature' ELSE 'partial_demo' END AS scoring_mode FROM wide",
)
def scoring_mode(spark, d):
    """Rows without a side-table partner supply only the transaction columns."""
    rows = wide(spark, d)
    own = [c for c in txn(spark, d).columns if c != ID]
    contract = [*own, "id_01", "device_type", "device_info", "id_12"]
    supplied = F.when(F.col("has_identity") == 1, F.array(*map(F.lit, contract))).otherwise(F.array(*map(F.lit, own)))
    return rows.select(ID, risk.scoring_mode(supplied, contract).alias("scoring_mode"))


WEIGHTS = {"amount": 0.02, "dist1": -0.004, "dist2": 0.003, "card1": 0.01, "card2": -0.5, "addr1": 0.125, "addr2": 0.25}
MEANS = {"amount": 50.0, "dist1": 250.0, "dist2": 150.0, "card1": 75.0, "card2": 1.0, "addr1": 9.5, "addr2": 87.0}


@query(
    "attribution_top5",
    """SELECT transaction_id, CAST(place AS INTEGER) AS place, feature, round(contribution, 6) AS contribution FROM (
       SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(contribution) DESC, feature) AS place FROM ("""
    + " UNION ALL ".join(
        f"SELECT transaction_id, '{c}' AS feature, {w}::DOUBLE * (coalesce(CAST({c} AS DOUBLE), -999) - {MEANS[c]}::DOUBLE) AS contribution FROM txn"
        for c, w in WEIGHTS.items()
    )
    + ")) WHERE place <= 5",
)
def attribution_top5(spark, d):
    top = risk.linear_contributions(WEIGHTS, MEANS)
    return (
        txn(spark, d)
        .select(ID, F.posexplode(top).alias("place", "c"))
        .select(ID, (F.col("place") + 1).alias("place"), "c.feature", F.round("c.contribution", 6).alias("contribution"))
    )


CASES = (
    "cases",
    """SELECT *, CASE WHEN label = 1 AND prediction = 1 THEN 'true_positive' WHEN label = 0 AND prediction = 0 THEN 'true_negative'
       WHEN label = 0 AND prediction = 1 THEN 'false_positive' ELSE 'false_negative' END AS case_type
       FROM (SELECT *, CAST(p >= 0.5 AS INTEGER) AS prediction FROM scored)""",
)


def predicted(spark, d):
    return scored(spark, d).withColumn("prediction", (F.col(P) >= 0.5).cast("int"))


@query("confusion_cases", "SELECT transaction_id, label, prediction, case_type FROM cases", (CASES,))
def confusion_cases(spark, d):
    case = risk.case_type(F.col("label"), F.col("prediction"))
    return predicted(spark, d).select(ID, "label", "prediction", case.alias("case_type"))


@query(
    "demo_cases",
    """SELECT case_type, CAST(case_rank AS INTEGER) AS case_rank, transaction_id, label, prediction, p, CAST(amount AS DOUBLE) AS amount FROM (
       SELECT *, row_number() OVER (PARTITION BY case_type ORDER BY p DESC, transaction_id) AS case_rank FROM cases) WHERE case_rank <= 3""",
    (CASES,),
)
def demo_cases(spark, d):
    found = queue.demo_cases(predicted(spark, d), "label", "prediction", P, ID)
    return found.select(
        "case_type", "case_rank", ID, "label", "prediction", P, F.col("amount").cast("double").alias("amount")
    ).orderBy("case_type", "case_rank")


@query(
    "coverage_sample",
    """SELECT transaction_id, risk_score, risk_band, CAST(band_rank AS INTEGER) AS band_rank FROM (SELECT *,
       row_number() OVER (PARTITION BY risk_band ORDER BY transaction_id) AS band_rank FROM banded) WHERE band_rank <= 20""",
)
def coverage_sample(spark, d):
    return queue.first_per_band(banded(spark, d), [ID], 20).select(ID, "risk_score", "risk_band", "band_rank")


UPSERT_SQL = """SELECT transaction_id, amount, p, version FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id
    ORDER BY version DESC, incoming DESC) AS rn FROM (
      SELECT transaction_id, CAST(amount AS DOUBLE) AS amount, p, 1 AS version, 0 AS incoming FROM scored WHERE transaction_dt < 1728000
      UNION ALL SELECT transaction_id, CAST(amount AS DOUBLE), p / 2, CAST(2 - transaction_id % 3 AS INTEGER), 1 FROM scored WHERE transaction_dt >= 864000))
    WHERE rn = 1"""


@query("upsert_scored", UPSERT_SQL)
def upsert_scored(spark, d):
    """A later batch written over an earlier one; they overlap in the middle ten days."""
    rows = scored(spark, d).withColumn("amount", F.col("amount").cast("double"))
    current = rows.filter("transaction_dt < 1728000").select(ID, "amount", P, F.lit(1).alias("version"))
    incoming = rows.filter("transaction_dt >= 864000").select(
        ID, "amount", (F.col(P) / 2).alias(P), (2 - F.col(ID) % 3).cast("int").alias("version")
    )
    return queue.upsert(current, incoming, ID, "version")


@query("upsert_buckets", UPSERT_SQL)
def upsert_buckets(spark, d):
    """The same upsert into a stored table, in two batches; each rewrites only the buckets it touches."""
    rows = scored(spark, d).withColumn("amount", F.col("amount").cast("double"))
    table = BucketTable(f"{shared_folder(spark)}/riskframe-{uuid.uuid4().hex}/scored", (ID,), 16)
    table.create(rows.filter("transaction_dt < 1728000").select(ID, "amount", P, F.lit(1).alias("version")))
    incoming = rows.select(ID, "amount", (F.col(P) / 2).alias(P), (2 - F.col(ID) % 3).cast("int").alias("version"), "transaction_dt")
    for part in ("transaction_dt >= 864000 AND transaction_dt < 2000000", "transaction_dt >= 2000000"):
        table.upsert(incoming.filter(part).drop("transaction_dt"), ["version"])
    return table.read(spark)


@query("review_latest", "SELECT transaction_id, status, updated_at FROM review")
def review_latest(spark, d):
    return reviews(spark, d)


@query(
    "review_queue",
    f"""SELECT {SHOWN_SQL} FROM banded WHERE risk_band = 'high' AND decision = 'review' AND risk_score >= 65 AND risk_score <= 75
        AND transaction_id IN (SELECT transaction_id FROM review WHERE status = 'approved')""",
)
def review_queue(spark, d):
    found = queue.review_queue(
        banded(spark, d),
        reviews(spark, d),
        ID,
        band="high",
        wanted_decision="review",
        min_score=65,
        max_score=75,
        status="approved",
    )
    return found.select(*SHOWN)


@query(
    "pending_reviews",
    f"SELECT {SHOWN_SQL} FROM banded WHERE transaction_id NOT IN (SELECT transaction_id FROM review)",
)
def pending_reviews(spark, d):
    return queue.review_queue(banded(spark, d), reviews(spark, d), ID, status="pending").select(*SHOWN)


@query(
    "reviewed_by_status",
    f"SELECT {SHOWN_SQL} FROM banded WHERE transaction_id IN (SELECT transaction_id FROM review WHERE status = 'rejected')",
)
def reviewed_by_status(spark, d):
    return queue.review_queue(banded(spark, d), reviews(spark, d), ID, status="rejected").select(*SHOWN)


@query("queue_page", f"SELECT {SHOWN_SQL} FROM banded ORDER BY risk_score DESC, transaction_id LIMIT 20 OFFSET 40")
def queue_page(spark, d):
    return queue.page(banded(spark, d), ID, number=3).select(*SHOWN)


@query(
    "queue_keyset_page",
    f"""SELECT {SHOWN_SQL} FROM banded WHERE risk_score < 75 OR (risk_score = 75 AND transaction_id > 500)
        ORDER BY risk_score DESC, transaction_id LIMIT 20""",
)
def queue_keyset_page(spark, d):
    return queue.page_after(banded(spark, d), ID, last_score=75, last_id=500).select(*SHOWN)


@query(
    "review_worklist",
    f"""SELECT {SHOWN_SQL} FROM banded WHERE risk_score >= 40 AND transaction_id NOT IN (SELECT transaction_id FROM review)
        ORDER BY risk_score DESC, transaction_id LIMIT 20""",
)
def review_worklist(spark, d):
    return queue.worklist(banded(spark, d), reviews(spark, d), ID).select(*SHOWN)


@query("prediction_export", "SELECT transaction_id, p AS label FROM scored ORDER BY transaction_id")
def prediction_export(spark, d):
    return scored(spark, d).select(ID, F.col(P).alias("label")).orderBy(ID)


@query("head_n", "SELECT transaction_id, CAST(amount AS DOUBLE) AS amount FROM txn ORDER BY transaction_id LIMIT 100")
def head_n(spark, d):
    return txn(spark, d).select(ID, F.col("amount").cast("double").alias("amount")).orderBy(ID).limit(100)


@query(
    "risk_kpis",
    """SELECT count(*) AS total, count(*) FILTER (transaction_id NOT IN (SELECT transaction_id FROM review)) AS pending_review,
       round(avg(risk_score), 1) AS avg_risk_score,
       coalesce(CAST(sum(amount) FILTER (risk_band IN ('high', 'critical')) AS DOUBLE), 0.0) AS high_risk_amount FROM banded""",
)
def risk_kpis(spark, d):
    return queue.kpis(banded(spark, d), reviews(spark, d), ID, SPEC.amount)


@query(
    "risk_by_band",
    """SELECT position, b.risk_band, count(s.transaction_id) AS rows,
       round(count(s.transaction_id) / CAST((SELECT count(*) FROM banded) AS DOUBLE) * 100, 1) AS share_pct
       FROM (VALUES (1, 'low'), (2, 'guarded'), (3, 'medium'), (4, 'high'), (5, 'critical')) b(position, risk_band)
       LEFT JOIN banded s ON s.risk_band = b.risk_band GROUP BY position, b.risk_band""",
)
def risk_by_band(spark, d):
    return queue.risk_by_band(banded(spark, d))


@query(
    "import_valid",
    """SELECT CAST(transaction_id AS BIGINT) AS transaction_id, coalesce(CAST(nullif(amount, '') AS DOUBLE), 0.0) AS amount
       FROM raw_import WHERE transaction_id IS NOT NULL AND amount <> 'abc'""",
)
def import_valid(spark, d):
    return batch_import.valid_rows(raw_import(spark, d), ID, "amount")


@query(
    "import_quarantine",
    f"""SELECT transaction_id, amount, CASE WHEN transaction_id IS NULL THEN '{batch_import.ID_MISSING}'
        ELSE '{batch_import.AMOUNT_NOT_NUMBER}' END AS error FROM raw_import WHERE transaction_id IS NULL OR amount = 'abc'""",
)
def import_quarantine(spark, d):
    return batch_import.quarantined_rows(raw_import(spark, d), ID, "amount")


@query(
    "import_summary",
    f"""SELECT CASE WHEN transaction_id IS NULL THEN '{batch_import.ID_MISSING}' WHEN amount = 'abc'
        THEN '{batch_import.AMOUNT_NOT_NUMBER}' ELSE 'imported' END AS outcome, count(*) AS rows FROM raw_import GROUP BY 1""",
)
def import_summary(spark, d):
    return batch_import.import_summary(raw_import(spark, d), ID, "amount")


NUMBERED = """CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 5 THEN concat(CAST(event_id AS STRING), '.25') ELSE CAST(event_id AS STRING) END AS transaction_id
CASE WHEN event_id % 101 = 0 THEN 'abc' WHEN event_id % 103 = 0 THEN NULL ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END AS amount
event_id
event_id % 4 AS part""".splitlines()


@query(
    "import_row_numbers",
    f"""SELECT * FROM (SELECT transaction_id, amount, 'part=' || part AS file, 1 + row_number() OVER (PARTITION BY part ORDER BY event_id) AS row_number,
        CASE WHEN transaction_id IS NULL THEN '{batch_import.ID_MISSING}' WHEN contains(transaction_id, '.') THEN '{batch_import.ID_NOT_WHOLE}'
        WHEN amount = 'abc' THEN '{batch_import.AMOUNT_NOT_NUMBER}' END AS error FROM (SELECT {', '.join(NUMBERED)} FROM events)) WHERE error IS NOT NULL""",
)
def import_row_numbers(spark, d):
    """CSV files with their rows in the order of the events; each rejected row is named by its file and its number there."""
    raw = spark.read.parquet(f"{d}/events.parquet").selectExpr(*NUMBERED)
    path = f"{shared_folder(spark)}/riskframe-{uuid.uuid4().hex}/import"
    ordered = raw.repartition("part").sortWithinPartitions("part", "event_id")
    ordered.select(ID, "amount", "part").write.partitionBy("part").option("header", True).csv(path)
    rejected = batch_import.quarantined_rows(batch_import.numbered_csv(spark, f"{path}/part=*"), ID, "amount")
    folder = F.element_at(F.split("file", "/"), -2)
    return rejected.select(ID, "amount", folder.alias("file"), "row_number", "error")


EXPECTED = ("amount", "product", "card_brand", "card_type")


@query(
    "import_column_match",
    """SELECT count(*) AS rows, 1 AS matched_features, 4 AS expected_features,
       'product,card_brand,card_type' AS missing_features FROM raw_import""",
)
def import_column_match(spark, d):
    return batch_import.column_match(raw_import(spark, d), EXPECTED)
