"""Queries: splits, fitted statistics, model-ready datasets and their contract."""

from pyspark.sql import functions as F

from riskframe.catalog.features import CUTS, HISTORY, KEYS, LIMITS
from riskframe.catalog.registry import query
from riskframe.catalog.tables import BASELINE_RATE, LABELLED_UNTIL, SPEC, clean, prepared, txn
from riskframe.functions.rowwise import normalise
from riskframe.operators import contract, fitted
from riskframe.operators.history import add_history
from riskframe.operators.profile import union_all
from riskframe.operators.queue import dataset_catalogue as catalogue
from riskframe.operators.splits import (
    boundaries_table,
    check_windows,
    fit_boundaries,
    split_frames,
    validation_windows as windows,
    with_split,
)

ID, TIME = SPEC.id, SPEC.time
NUMERIC, TEXT = SPEC.numeric_features, SPEC.categorical_features
SPLIT_SQL = "CASE WHEN transaction_dt <= b1 THEN 'train' WHEN transaction_dt <= b2 THEN 'validation' ELSE 'holdout' END"


# Columns whose last bits depend on the engine's logarithm, root or subtraction.
ROUNDED = {"prior_card_amount_stddev": 4, "log_transaction_amount": 6, "amount_decimal": 6}


def rounded(names):
    return [F.round(n, ROUNDED[n]).alias(n) if n in ROUNDED else F.col(n) for n in names]


def number_sql(name: str) -> str:
    value = f"CAST({name} AS DOUBLE)"
    return f"round({value}, {ROUNDED[name]}) AS {name}" if name in ROUNDED else f"{value} AS {name}"


# --- the model-ready datasets in SQL -------------------------------------------------

LAB = ("lab", f"SELECT * FROM clean WHERE transaction_dt < {LABELLED_UNTIL}")
LAB_CUTS = ("lab_cuts", CUTS[1].replace("FROM clean", "FROM lab"))
LAB_LIMITS = ("lab_limits", LIMITS[1].replace("FROM clean, cuts", "FROM lab, lab_cuts"))
FEATURES = (
    "features",
    f"""SELECT h.*, CASE WHEN transaction_dt >= {LABELLED_UNTIL} THEN 'unlabelled' ELSE {SPLIT_SQL} END AS split,
    least(CAST(amount AS DOUBLE), upper_cap) AS transaction_amount_capped,
    CASE WHEN transaction_hour <= 5 OR transaction_hour >= 22 THEN 1 ELSE 0 END AS is_night_transaction,
    CAST(device_info IS NOT NULL AS INTEGER) AS has_device_info,
    CAST(p_email IS NOT NULL AS INTEGER) AS has_p_email, CAST(r_email IS NOT NULL AS INTEGER) AS has_r_email,
    CAST(dist1 IS NOT NULL OR dist2 IS NOT NULL AS INTEGER) AS has_distance,
    CAST(addr1 IS NOT NULL OR addr2 IS NOT NULL AS INTEGER) AS has_address,
    CAST(p_email IS NOT DISTINCT FROM r_email AS INTEGER) AS same_email_domain,
    CASE WHEN amount >= p99 THEN 1 ELSE 0 END AS high_amount_flag,
    CASE WHEN amount >= upper_cap THEN 1 ELSE 0 END AS amount_outlier_flag,
    CASE WHEN dist1 >= 1000 OR dist2 >= 1000 THEN 1 ELSE 0 END AS distance_outlier_flag,
    CASE WHEN prior_card_avg_amount > 0 THEN CAST(amount AS DOUBLE) / prior_card_avg_amount ELSE 1.0 END AS amount_ratio_to_card_mean,
    CAST(amount AS DOUBLE) - prior_card_avg_amount AS amount_deviation_from_card_mean
    FROM history h, lab_cuts, lab_limits""",
)
MODEL = (
    "model",
    "SELECT transaction_id, CASE WHEN split <> 'unlabelled' THEN label END AS label, split, "
    + ", ".join(map(number_sql, NUMERIC))
    + ", "
    + ", ".join(f"coalesce({c}, '__MISSING__') AS {c}" for c in TEXT)
    + " FROM features",
)
TRAIN = ("train", "SELECT * FROM model WHERE split = 'train'")
MEDIANS = (
    "medians",
    "SELECT " + ", ".join(f"quantile_disc({c}, 0.5) AS {c}" for c in NUMERIC) + " FROM train",
)
COUNTS = (
    "counts",
    "SELECT count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM train",
)
RANKED = (
    "ranked",
    """SELECT transaction_id, label, row_number() OVER (ORDER BY md5('42|' || transaction_id), transaction_id) AS place
       FROM train WHERE label = 0""",
)
BALANCED = (
    "balanced",
    """SELECT transaction_id, label FROM train WHERE label = 1 UNION ALL
       SELECT transaction_id, label FROM ranked, counts WHERE place <= least(neg, pos * 3)""",
)
DATASETS = (
    "datasets",
    """SELECT 'train_original' AS dataset, transaction_id, label, transaction_dt FROM train
       UNION ALL SELECT 'train_weighted', transaction_id, label, transaction_dt FROM train
       UNION ALL SELECT 'train_balanced', b.transaction_id, b.label, t.transaction_dt
                 FROM balanced b JOIN train t ON t.transaction_id = b.transaction_id
       UNION ALL SELECT split, transaction_id, label, transaction_dt FROM model WHERE split <> 'train'""",
)
STEPS = (LAB, LAB_CUTS, LAB_LIMITS, HISTORY, FEATURES, MODEL, TRAIN, MEDIANS, COUNTS, RANKED, BALANCED, DATASETS)

# --- boundaries and splits -----------------------------------------------------------


@query("temporal_boundaries", "SELECT b1 AS train_max, b2 AS validation_max FROM cuts", (CUTS,))
def temporal_boundaries(spark, d):
    return boundaries_table(txn(spark, d), TIME)


@query("temporal_split", f"SELECT transaction_id, transaction_dt, {SPLIT_SQL} AS split FROM clean, cuts", (CUTS,))
def temporal_split(spark, d):
    rows = txn(spark, d)
    return with_split(rows.select(ID, TIME), TIME, fit_boundaries(rows, TIME))


VALIDATION = ("valid", "SELECT clean.* FROM clean, cuts WHERE transaction_dt > b1 AND transaction_dt <= b2")
VALID_CUTS = (
    "valid_cuts",
    "SELECT quantile_disc(transaction_dt, 0.5) AS w1, quantile_disc(transaction_dt, 0.75) AS w2 FROM valid",
)


@query(
    "validation_windows",
    """SELECT transaction_id, transaction_dt,
       CASE WHEN transaction_dt <= w1 THEN 'selection' WHEN transaction_dt <= w2 THEN 'calibration' ELSE 'policy' END AS "window"
       FROM valid, valid_cuts""",
    (CUTS, VALIDATION, VALID_CUTS),
)
def validation_windows(spark, d):
    rows = txn(spark, d)
    frames = split_frames(rows, TIME, fit_boundaries(rows, TIME))
    tagged, _ = windows(frames["validation"].select(ID, TIME), TIME)
    check_windows(tagged, TIME)
    return tagged


@query("amount_thresholds", "SELECT p95, p99, p25, p75, iqr, upper_cap FROM limits", (CUTS, LIMITS))
def amount_thresholds(spark, d):
    rows = txn(spark, d)
    return fitted.amount_thresholds_table(rows.filter(F.col(TIME) <= fit_boundaries(rows, TIME).first), SPEC.amount)


# --- fitted statistics ---------------------------------------------------------------


@query(
    "train_medians",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS median FROM medians" for c in NUMERIC),
    STEPS,
)
def train_medians(spark, d):
    done = prepared(spark, d)
    train = split_frames(done.features.filter("labelled"), TIME, done.boundaries)["train"]
    table = fitted.medians_table(contract.model_columns(train, SPEC), NUMERIC)
    median = F.col("median")
    for name, digits in ROUNDED.items():
        median = F.when(F.col("column_name") == name, F.round("median", digits)).otherwise(median)
    return table.withColumn("median", median)


@query(
    "impute_median",
    "SELECT transaction_id, split, "
    + ", ".join(f"coalesce(model.{c}, medians.{c}) AS {c}" for c in NUMERIC)
    + " FROM model, medians",
    STEPS,
)
def impute_median(spark, d):
    sets = prepared(spark, d).datasets
    named = {"train": sets["train_original"], **{n: sets[n] for n in ("validation", "holdout", "unlabelled")}}
    return union_all([df.select(ID, F.lit(n).alias("split"), *rounded(NUMERIC)) for n, df in named.items()])


@query(
    "class_weights",
    """SELECT 0 AS label, neg AS rows, (pos + neg) / (2.0::DOUBLE * neg) AS class_weight FROM counts
       UNION ALL SELECT 1, pos, (pos + neg) / (2.0::DOUBLE * pos) FROM counts""",
    STEPS,
)
def class_weights(spark, d):
    return fitted.class_weights_table(prepared(spark, d).datasets["train_original"], SPEC.label)


@query("undersample", "SELECT transaction_id, label FROM balanced", STEPS)
def undersample(spark, d):
    train = prepared(spark, d).datasets["train_original"]
    return fitted.undersample(train.select(ID, SPEC.label), ID, SPEC.label)


SAMPLE_ROWS = 500


@query(
    "sample_n",
    f"SELECT transaction_id, amount FROM txn ORDER BY md5('42|' || transaction_id), transaction_id LIMIT {SAMPLE_ROWS}",
)
def sample_n(spark, d):
    return fitted.sample_rows(txn(spark, d).select(ID, SPEC.amount), ID, SAMPLE_ROWS)


INDEXED = ("product", "card_brand", "card_type", "p_email")


@query(
    "category_index",
    """SELECT column_name, category, rows, CAST(row_number() OVER (PARTITION BY column_name ORDER BY rows DESC, category) - 1 AS INTEGER) AS code
       FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS category, count(*) AS rows FROM norm, cuts WHERE transaction_dt <= b1 AND {c} IS NOT NULL GROUP BY {c}"
        for c in INDEXED
    )
    + ")",
    (CUTS,),
)
def category_index(spark, d):
    rows = normalise(txn(spark, d), SPEC)
    train = rows.filter(F.col(TIME) <= fit_boundaries(rows, TIME).first)
    return fitted.category_index(train, INDEXED)


@query(
    "category_encoding",
    "SELECT transaction_id, "
    + ", ".join(
        f"CAST(coalesce((SELECT code FROM codes WHERE column_name = '{c}' AND category = n.{c}), "
        f"(SELECT count(*) FROM codes WHERE column_name = '{c}')) AS DOUBLE) AS {c}"
        for c in INDEXED
    )
    + " FROM norm n",
    (
        CUTS,
        (
            "codes",
            """SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY rows DESC, category) - 1 AS code FROM ("""
            + " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, {c} AS category, count(*) AS rows FROM norm, cuts WHERE transaction_dt <= b1 AND {c} IS NOT NULL GROUP BY {c}"
                for c in INDEXED
            )
            + ")",
        ),
    ),
)
def category_encoding(spark, d):
    rows = normalise(txn(spark, d), SPEC)
    train = rows.filter(F.col(TIME) <= fit_boundaries(rows, TIME).first)
    index = fitted.category_index(train, INDEXED)
    return fitted.encode_categories(rows.select(ID, *INDEXED), index, INDEXED)


# --- model-ready datasets ------------------------------------------------------------


@query("model_ready", f"SELECT transaction_id, split, {', '.join(NUMERIC)}, {', '.join(TEXT)} FROM model", STEPS)
def model_ready(spark, d):
    """The contract columns before imputation."""
    done = prepared(spark, d)
    frames = split_frames(done.features.filter("labelled"), TIME, done.boundaries)
    frames["unlabelled"] = done.features.filter(~F.col("labelled"))
    return union_all(
        [
            contract.model_columns(df, SPEC, with_label=False).select(ID, F.lit(n).alias("split"), *rounded(NUMERIC), *TEXT)
            for n, df in frames.items()
        ]
    )


STAMPS = ("split_name", "processing_version", "feature_schema_version")


@query(
    "model_ready_stamped",
    f"""SELECT transaction_id, CASE WHEN dataset <> 'unlabelled' THEN label END AS label,
        CASE WHEN dataset = 'train_weighted' THEN CASE label WHEN 1 THEN (pos + neg) / (2.0::DOUBLE * pos) ELSE (pos + neg) / (2.0::DOUBLE * neg) END END AS class_weight,
        dataset AS split_name, '{contract.PROCESSING_VERSION}' AS processing_version,
        '{contract.FEATURE_SCHEMA_VERSION}' AS feature_schema_version FROM datasets, counts""",
    STEPS,
)
def model_ready_stamped(spark, d):
    """Label, weight and stamps of all six datasets; absent columns show as NULL."""
    parts = []
    for df in prepared(spark, d).datasets.values():
        label = F.col("label") if "label" in df.columns else F.lit(None).cast("int").alias("label")
        weight = F.col("class_weight") if "class_weight" in df.columns else F.lit(None).cast("double").alias("class_weight")
        parts.append(df.select(ID, label, weight, *STAMPS))
    return union_all(parts)


@query(
    "balance_report",
    """SELECT dataset, count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives,
       count(*) FILTER (label = 0) / CAST(count(*) FILTER (label = 1) AS DOUBLE) AS negatives_per_positive
       FROM datasets WHERE dataset <> 'unlabelled' GROUP BY dataset""",
    STEPS,
)
def balance_report(spark, d):
    sets = prepared(spark, d).datasets
    tagged = union_all(
        [df.select(F.lit(n).alias("dataset"), SPEC.label) for n, df in sets.items() if SPEC.label in df.columns]
    )
    positives, negatives = (F.count(F.when(F.col(SPEC.label) == v, 1)) for v in (1, 0))
    return tagged.groupBy("dataset").agg(
        negatives.alias("negatives"),
        positives.alias("positives"),
        (negatives / F.greatest(positives, F.lit(1))).alias("negatives_per_positive"),
    )


def _width(dataset: str) -> int:
    return 1 + (dataset != "unlabelled") + len(SPEC.features) + (dataset == "train_weighted") + 4


@query(
    "dataset_manifest",
    "SELECT dataset, count(*) AS rows, CASE dataset "
    + " ".join(f"WHEN '{n}' THEN {_width(n)}" for n in contract.DATASETS)
    + " END AS columns FROM datasets GROUP BY dataset",
    STEPS,
)
def dataset_manifest(spark, d):
    return contract.dataset_manifest(prepared(spark, d).datasets).drop("schema_hash")


def _contract_sql() -> str:
    rows = []

    def note(dataset, check, expected, actual):
        rows.append(f"SELECT '{dataset}' AS dataset, '{check}' AS check_name, '{expected}' AS expected, '{actual}' AS actual, true AS ok")

    width = len(SPEC.features)
    for n in contract.DATASETS:
        has_label, has_weight = str(n != "unlabelled").lower(), str(n == "train_weighted").lower()
        note(n, "has_id", "true", "true")
        note(n, "has_label", has_label, has_label)
        note(n, "has_weight", has_weight, has_weight)
        note(n, "feature_count", width, width)
        note(n, "features_unique", width, width)
        note(n, "feature_order", "true", "true")
        note(n, "processing_version", contract.PROCESSING_VERSION, contract.PROCESSING_VERSION)
        note(n, "feature_schema_version", contract.FEATURE_SCHEMA_VERSION, contract.FEATURE_SCHEMA_VERSION)
    rows.append("SELECT dataset, 'non_empty', 'true', CASE WHEN count(*) > 0 THEN 'true' ELSE 'false' END, count(*) > 0 FROM datasets GROUP BY dataset")
    rows.append(
        "SELECT dataset, 'unique_ids', CAST(count(*) AS VARCHAR), CAST(count(DISTINCT transaction_id) AS VARCHAR), "
        "count(*) = count(DISTINCT transaction_id) FROM datasets GROUP BY dataset"
    )
    sets = {"train": "train_original", "validation": "validation", "holdout": "holdout"}
    names = list(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            rows.append(
                f"SELECT '{a}/{b}', 'no_shared_ids', '0', CAST(count(*) AS VARCHAR), count(*) = 0 FROM datasets x JOIN datasets y "
                f"ON x.transaction_id = y.transaction_id WHERE x.dataset = '{sets[a]}' AND y.dataset = '{sets[b]}'"
            )
    for a, b in zip(names, names[1:]):
        low, high = (
            f"CAST(max(transaction_dt) FILTER (dataset = '{sets[a]}') AS BIGINT)",
            f"CAST(min(transaction_dt) FILTER (dataset = '{sets[b]}') AS BIGINT)",
        )
        rows.append(f"SELECT '{a}/{b}', 'time_order', CAST({low} AS VARCHAR), CAST({high} AS VARCHAR), {low} <= {high} FROM datasets")
    return " UNION ALL ".join(rows)


@query("contract_checks", _contract_sql(), STEPS)
def contract_checks(spark, d):
    return contract.contract_checks(prepared(spark, d).datasets, SPEC)


@query(
    "split_overlap",
    " UNION ALL ".join(
        f"SELECT '{a}' AS left_split, '{b}' AS right_split, count(*) AS shared_ids FROM model x JOIN model y "
        f"ON x.transaction_id = y.transaction_id WHERE x.split = '{a}' AND y.split = '{b}'"
        for a, b in (("train", "validation"), ("train", "holdout"), ("validation", "holdout"))
    ),
    STEPS,
)
def split_overlap(spark, d):
    sets = prepared(spark, d).datasets
    frames = {"train": sets["train_original"], "validation": sets["validation"], "holdout": sets["holdout"]}
    return contract.split_overlap(frames, ID)


@query(
    "leakage_check",
    " UNION ALL ".join(
        f"SELECT 'train' AS fit_scope, '{n}' AS name, {n} AS stored, {n} AS refit, true AS ok FROM lab_limits"
        for n in ("p25", "p75", "p95", "p99", "iqr", "upper_cap")
    ),
    STEPS,
)
def leakage_check(spark, d):
    done = prepared(spark, d)
    train = split_frames(done.features.filter("labelled"), TIME, done.boundaries)["train"]
    return contract.leakage_check(train, done.thresholds, fitted.fit_amount_thresholds(train, SPEC.amount))


@query(
    "feature_catalog",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature_name, '{kind}' AS feature_type, '{policy}' AS missing_value_policy, "
        f"count(*) > 0 AS training_ready FROM train"
        for names, kind, policy in ((NUMERIC, "numeric", contract.NUMBER_POLICY), (TEXT, "categorical", contract.TEXT_POLICY))
        for c in names
    ),
    STEPS,
)
def feature_catalog(spark, d):
    return contract.feature_catalog(prepared(spark, d).datasets["train_original"], SPEC)


@query(
    "dataset_catalogue",
    f"""SELECT *, has_labels AND NOT trained_on AND "natural" AS recommended FROM (
        SELECT dataset, count(*) AS rows, avg(label) FILTER (dataset <> 'unlabelled') AS positive_rate,
        dataset <> 'unlabelled' AS has_labels, dataset LIKE 'train%' AS trained_on,
        coalesce(abs(avg(label) FILTER (dataset <> 'unlabelled') - {BASELINE_RATE}::DOUBLE) <= 0.005::DOUBLE, false) AS "natural"
        FROM datasets GROUP BY dataset)""",
    STEPS,
)
def dataset_catalogue(spark, d):
    return catalogue(prepared(spark, d).datasets, SPEC.label, BASELINE_RATE)


@query(
    "flagship",
    f"""SELECT {SPLIT_SQL} AS split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives,
        CAST(sum(prior_card_transaction_count) AS BIGINT) AS card_history_rows,
        CAST(sum(prior_email_transaction_count) AS BIGINT) AS email_history_rows,
        CAST(sum(prior_device_transaction_count) AS BIGINT) AS device_history_rows,
        round(avg(prior_card_avg_amount), 4) AS mean_card_amount,
        round(avg(time_since_previous_card_transaction), 4) AS mean_gap,
        min(transaction_dt) AS min_time, max(transaction_dt) AS max_time
        FROM history, cuts GROUP BY 1""",
    (CUTS, HISTORY),
)
def flagship(spark, d):
    """Histories of all three entities, summed up per chronological split."""
    bounds = fit_boundaries(txn(spark, d), TIME)
    rows = clean(spark, d).select(ID, TIME, SPEC.amount, SPEC.label, *KEYS[:3])
    return (
        with_split(add_history(rows, SPEC), TIME, bounds)
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(SPEC.label).alias("positives"),
            *[F.sum(f"prior_{e}_transaction_count").alias(f"{e}_history_rows") for e in ("card", "email", "device")],
            F.round(F.avg("prior_card_avg_amount"), 4).alias("mean_card_amount"),
            F.round(F.avg("time_since_previous_card_transaction"), 4).alias("mean_gap"),
            F.min(TIME).alias("min_time"),
            F.max(TIME).alias("max_time"),
        )
    )
