"""Queries: sources, key audits, profiles and data quality."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.catalog.registry import query
from riskframe.catalog.tables import SPEC, base, clean, ident, raw_import, txn, wide
from riskframe.operators import profile
from riskframe.session import materialise, shared_folder
from riskframe.sources import files

ID = SPEC.id
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels",
          "embeddings", "pages", "benchmark", "conversations")


def _audit_sql(dataset: str, table: str, key: str) -> str:
    return f"""SELECT '{dataset}' AS dataset, count(*) AS rows, count(*) - count({key}) AS null_keys,
       count(*) - count(DISTINCT {key}) AS duplicate_keys,
       CASE WHEN count(*) = count({key}) AND count(*) = count(DISTINCT {key}) THEN 'pass' ELSE 'fail' END AS status FROM {table}"""


@query(
    "key_audit",
    " UNION ALL ".join(
        (
            _audit_sql("transactions", "txn", "transaction_id"),
            _audit_sql("identity", "ident", "transaction_id"),
            _audit_sql("raw_import", "raw_import", "transaction_id"),
            _audit_sql("lineitem", "lineitem", "l_orderkey"),
        )
    ),
)
def key_audit(spark, d):
    return profile.union_all(
        [
            profile.key_audit(txn(spark, d), ID, "transactions"),
            profile.key_audit(ident(spark, d), ID, "identity"),
            profile.key_audit(raw_import(spark, d), ID, "raw_import"),
            profile.key_audit(base(spark, d, "lineitem"), "l_orderkey", "lineitem"),
        ]
    )


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, d):
    return profile.duplicate_keys(base(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


WIDE_TYPES = {
    "transaction_id": "bigint", "transaction_dt": "bigint", "amount": "decimal(18,2)", "label": "int",
    "product": "string", "card_brand": "string", "card1": "bigint", "card2": "int", "card_type": "string",
    "addr1": "bigint", "addr2": "int", "p_email": "string", "r_email": "string", "dist1": "double",
    "dist2": "double", "id_01": "double", "device_type": "string", "device_info": "string", "id_12": "string",
    "has_identity": "int",
}
PROFILE = (
    "profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS spark_type, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        f"count(DISTINCT {c}) AS exact_distinct_count FROM wide"
        for c, t in WIDE_TYPES.items()
    ),
)
RATED = (
    "rated",
    """SELECT *, 'train' AS dataset, null_count / CAST(row_count AS DOUBLE) * 100 AS null_pct,
       exact_distinct_count / CAST(row_count AS DOUBLE) AS cardinality_ratio,
       null_count / CAST(row_count AS DOUBLE) > 0.8::DOUBLE AS is_sparse_over_80pct,
       exact_distinct_count / CAST(row_count AS DOUBLE) > 0.1::DOUBLE AS is_high_cardinality_over_10pct FROM profile""",
)


@query("column_profile", "SELECT * FROM rated", (PROFILE, RATED))
def column_profile(spark, d):
    return profile.column_profile(wide(spark, d), "train", exact=True)


@query("column_profile_approx")
def column_profile_approx(spark, d):
    """The one-pass form with distinct counts from sketches."""
    return profile.column_profile(wide(spark, d), "train")


@query(
    "column_profile_merged",
    """SELECT dataset, column_name, spark_type, row_count, null_count, null_pct, is_sparse_over_80pct, exact_distinct_count, TRUE AS estimate_close FROM rated""",
    (PROFILE, RATED),
)
def column_profile_merged(spark, d):
    """A profile from the stored states of two parts of the table; its distinct counts are held against the exact ones."""
    rows = wide(spark, d)
    early, late = rows.filter(F.col(SPEC.time) < 1728000), rows.filter(F.col(SPEC.time) >= 1728000)
    states = [materialise(profile.profile_state(part), "state") for part in (early, late)]
    merged = profile.profile_of_state(profile.merge_profiles(profile.union_all(states)), "train")
    exact = profile.column_profile(rows, "train", exact=True).select("column_name", "exact_distinct_count")
    off = F.abs(F.col("approx_distinct_count") - F.col("exact_distinct_count"))
    close = off <= 3 * profile.SKETCH_ERROR * F.col("exact_distinct_count")
    return merged.join(exact, "column_name").select(
        "dataset", "column_name", "spark_type", "row_count", "null_count", "null_pct", "is_sparse_over_80pct", "exact_distinct_count",
        close.alias("estimate_close"),
    )


@query(
    "missingness_strategy",
    f"""SELECT column_name, null_pct,
       CASE WHEN null_pct < 20 THEN 'Low' WHEN null_pct < 70 THEN 'Medium' WHEN null_pct < 95 THEN 'High' ELSE 'Extreme' END AS missing_group,
       CASE WHEN spark_type = 'string' THEN '{profile.TEXT_STRATEGY}' ELSE '{profile.NUMBER_STRATEGY}' END AS recommended_strategy,
       CASE WHEN spark_type = 'string' THEN '{profile.TEXT_ACTION}' ELSE '{profile.NUMBER_ACTION}' END AS final_action FROM rated""",
    (PROFILE, RATED),
)
def missingness_strategy(spark, d):
    graded = profile.missingness_strategy(profile.column_profile(wide(spark, d), "train"))
    return graded.select("column_name", "null_pct", "missing_group", "recommended_strategy", "final_action")


@query(
    "quality_summary",
    """SELECT 'raw_transactions' AS stage, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM txn
       UNION ALL SELECT 'raw_transactions', 'null_amount', count(*) FILTER (amount IS NULL) FROM txn
       UNION ALL SELECT 'raw_transactions', 'empty_product', count(*) FILTER (trim(coalesce(product, '')) = '') FROM txn
       UNION ALL SELECT 'raw_identity', 'rows', count(*) FROM ident
       UNION ALL SELECT 'joined', 'identity_coverage_ratio', sum(has_identity) / CAST(count(*) AS DOUBLE) FROM wide""",
)
def quality_summary(spark, d):
    raw = {"raw_transactions": txn(spark, d), "raw_identity": ident(spark, d)}
    return profile.quality_summary(raw, {"joined": wide(spark, d)}, SPEC)


@query(
    "table_inventory",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", (SELECT count(*) FROM {t}) AS rows,
        CAST((SELECT count(*) FROM duckdb_columns() WHERE table_name = '{t}') AS INTEGER) AS columns"""
        for t in TABLES
    ),
)
def table_inventory(spark, d):
    return files.table_inventory({t: base(spark, d, t) for t in TABLES}, fingerprint=False)


@query("table_fingerprints")
def table_fingerprints(spark, d):
    """Inventory with the order-free content fingerprint of every table."""
    return files.table_inventory({t: base(spark, d, t) for t in TABLES})


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/riskframe-{uuid.uuid4().hex}/{name}"


CSV_SCHEMA = T.StructType(
    [
        T.StructField(ID, T.LongType()),
        T.StructField(SPEC.time, T.LongType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("product", T.StringType()),
        T.StructField("card1", T.StringType()),
        T.StructField("dist1", T.DoubleType()),
    ]
)


@query(
    "csv_typed_roundtrip",
    """SELECT transaction_id, transaction_dt, CAST(amount AS DOUBLE) AS amount, nullif(trim(product), '') AS product,
       CAST(card1 AS VARCHAR) AS card1, dist1 FROM txn""",
)
def csv_typed_roundtrip(spark, d):
    """Written as CSV, read back under a declared schema."""
    path = scratch(spark, "transactions_csv")
    rows = txn(spark, d).select(*CSV_SCHEMA.names).withColumn("product", F.nullif(F.trim("product"), F.lit("")))
    return files.read_csv(spark, files.write_csv(rows, path), CSV_SCHEMA)


@query(
    "wide_store_roundtrip",
    """SELECT 'week_' || transaction_week AS transaction_period, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount,
       CAST(sum(selected_missing_count) AS BIGINT) AS missing FROM clean GROUP BY 1""",
)
def wide_store_roundtrip(spark, d):
    """Written as Parquet partitioned by week, read back and summed per partition."""
    path = files.write_dataset(clean(spark, d), scratch(spark, "wide"), ["transaction_period"])
    return (
        files.read_dataset(spark, path)
        .groupBy("transaction_period")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("amount").cast("double").alias("amount"),
            F.sum("selected_missing_count").alias("missing"),
        )
    )


@query(
    "manifest_changes",
    """SELECT 'part=' || CAST(transaction_id % 5 AS VARCHAR) AS part,
       CASE WHEN transaction_id % 5 = 4 THEN NULL ELSE count(*) END AS rows_before,
       CASE WHEN transaction_id % 5 = 3 THEN NULL ELSE count(*) END AS rows_after,
       CASE transaction_id % 5 WHEN 0 THEN 'kept' WHEN 1 THEN 'rewritten' WHEN 2 THEN 'changed' WHEN 3 THEN 'removed' ELSE 'added' END AS state
       FROM txn GROUP BY transaction_id % 5""",
)
def manifest_changes(spark, d):
    """Folders of a stored table by what happened to them since its manifest: one reordered, one with one amount edited, one gone, one new."""
    path = scratch(spark, "parts")
    rows = txn(spark, d).select(ID, SPEC.time, "amount", "product", (F.col(ID) % 5).alias("part"))

    def put(some) -> None:
        some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    put(rows.filter("part < 4"))
    before = materialise(files.content_manifest(spark, path), "manifest")
    put(rows.filter("part = 1").orderBy(F.desc(ID)))
    least = rows.filter("part = 2").agg(F.min(ID)).first()[0]
    edited = F.when(F.col(ID) == least, F.coalesce("amount", F.lit(0)) + 1).otherwise(F.col("amount")).cast("decimal(18,2)")
    put(rows.filter("part = 2").withColumn("amount", edited))
    put(rows.filter("part = 4"))
    after = files.content_manifest(spark, path, before)
    found = files.compare_manifests(before, after.filter(~F.col("part").endswith("part=3")))
    return found.withColumn("part", F.element_at(F.split("part", "/"), -1))
