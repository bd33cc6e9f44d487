import math
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import contract, joins, profile, queue
from riskframe.plans.prepare import Options, join_and_audit, prepare, write_prepared
from riskframe.plans.release import model_columns, release
from riskframe.plans.reports import write_reports
from riskframe.plans.scoring import score_batch, write_scored
from riskframe.sources import batch_import, files, schemas
from riskframe.sources.batch_import import numbered_csv
from riskframe.sources.buckets import BucketTable
from riskframe.spec import CARD_PAYMENTS


def test_join_audit_equals_the_join(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,), (3,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "d"), (9, "e")], "k int, v string")
    joined = joins.left_join_with_marker(left, right, "k")
    row = joins.join_audit(left, right, "k", "x").first()
    assert row["rows_after"] == joined.count() == 7
    assert row["matched_rows"] == joined.filter("has_identity = 1").count() == 5
    assert (row["rows_before"], row["side_rows"], row["status"]) == (5, 5, "fail")
    with pytest.raises(ValueError):
        joins.require_pass(joins.join_audit(left, right, "k", "x"))


def test_key_audit_and_approximate_profile(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (None, None)], "k int, v string")
    row = profile.key_audit(df, "k", "d").first()
    assert (row["null_keys"], row["duplicate_keys"], row["status"]) == (1, 2, "fail")
    found = {r["column_name"]: r for r in profile.column_profile(df, "d").collect()}
    assert found["v"]["null_count"] == 2 and found["v"]["approx_distinct_count"] == 1


def test_profile_runs_in_batches(spark):
    df = spark.range(3).select(*[F.lit(i).alias(f"c{i}") for i in range(95)])
    assert profile.column_profile(df, "d").count() == 95


def test_schemas_by_name():
    assert schemas.normalise_header(["id-01", "id_02", "TransactionID"]) == ["id_01", "id_02", "TransactionID"]
    kinds = dict(
        (f.name, f.dataType.simpleString())
        for f in schemas.transaction_schema(["TransactionID", "isFraud", "TransactionAmt", "C1", "V339", "card1", "M4", "dist1"])
    )
    assert list(kinds.values()) == ["bigint", "int", "double", "double", "double", "string", "string", "double"]
    found = [f.dataType.simpleString() for f in schemas.identity_schema(["TransactionID", "id_01", "id_12", "DeviceType"])]
    assert found == ["bigint", "double", "string", "string"]
    assert len(CARD_PAYMENTS.features) == 68 and len(set(CARD_PAYMENTS.features)) == 68
    assert len(CARD_PAYMENTS.normalised) == 37 and len(CARD_PAYMENTS.watched) == 22


def test_csv_binds_by_position_and_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "identity.csv").write_text("TransactionID,id-01,id-12\n1, 2.5 , Found \n2,abc,\n3,NaN,x\n")
    schema = schemas.identity_schema(schemas.normalise_header(files.csv_header(spark, str(tmp_path))))
    rows = {r["TransactionID"]: r for r in files.read_csv(spark, str(tmp_path), schema, keep_corrupt=True).collect()}
    assert (rows[1]["id_01"], rows[1]["id_12"], rows[1][files.CORRUPT]) == (2.5, "Found", None)
    assert rows[2]["id_01"] is None and rows[2]["id_12"] is None and rows[2][files.CORRUPT] is not None
    assert math.isnan(rows[3]["id_01"])
    assert files.file_inventory(spark, str(tmp_path)).first()["filename"] == "identity.csv"
    with pytest.raises(ValueError):
        files.require_size(files.file_inventory(spark, str(tmp_path)), 10**6)
    with pytest.raises(files.DatasetNotFound):
        files.read_dataset(spark, str(tmp_path / "nothing"))


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    prints = [
        r["fingerprint"]
        for r in files.table_inventory(
            {"a": df, "b": df.orderBy(F.desc("id")), "c": df.withColumn("v", F.col("v") + 1)}
        ).collect()
    ]
    assert prints[0] == prints[1] != prints[2]


def test_import_takes_good_rows_and_reports_bad_ones(spark):
    raw = spark.createDataFrame(
        [("1", "12.5", "w"), ("2", "abc", "w"), ("3", "", ""), (None, "1", "w"), ("x", "1", "w"), ("4", None, "c")],
        "TransactionID string, TransactionAmt string, ProductCD string",
    )
    good = {r[0]: r[1] for r in batch_import.valid_rows(raw, "TransactionID", "TransactionAmt").collect()}
    assert good == {1: 12.5, 3: 0.0, 4: 0.0}
    assert batch_import.quarantined_rows(raw, "TransactionID", "TransactionAmt").count() == 3
    with pytest.raises(ValueError):
        batch_import.valid_rows(raw, "id", "TransactionAmt")
    match = batch_import.column_match(raw, ["ProductCD", "card4"]).first()
    assert (match["matched_features"], match["missing_features"]) == (1, "card4")


def scored(spark):
    rows = [(2987000 + i, amount, p) for i, (amount, p) in enumerate([(25.0, 0.1), (480.0, 0.5), (9500.0, 0.95)])]
    return queue.classify(spark.createDataFrame(rows, "id long, amount double, p double"), "p")


def test_queue_review_and_kpis(spark):
    log = spark.createDataFrame([(2987001, "approved", 1), (2987001, "rejected", 2)], "id long, status string, updated_at int")
    review = queue.latest(log, "id", ["updated_at"])
    assert [tuple(r) for r in review.collect()] == [(2987001, "rejected", 2)]
    rows = scored(spark)

    def ids(df):
        return [r["id"] for r in df.orderBy("id").collect()]

    assert ids(queue.review_queue(rows, review, "id", status="pending")) == [2987000, 2987002]
    assert ids(queue.review_queue(rows, review, "id", status="rejected")) == [2987001]
    assert ids(queue.review_queue(rows, review, "id", search="2987002")) == [2987002]
    assert ids(queue.review_queue(rows, review, "id", search="29x")) == []
    assert ids(queue.review_queue(rows, review, "id", search="9" * 30)) == []
    assert [r["id"] for r in queue.page(rows, "id", 2, 1).collect()] == [2987001]
    assert [r["id"] for r in queue.page_after(rows, "id", 95, 2987002, 1).collect()] == [2987001]
    assert [r["id"] for r in queue.worklist(rows, review, "id").collect()] == [2987002]
    with pytest.raises(ValueError):
        queue.page(rows, "id", sort="amount")
    kpis = queue.kpis(rows, review, "id", "amount").first()
    assert (kpis["total"], kpis["pending_review"], kpis["high_risk_amount"]) == (3, 2, 9500.0)
    bands = {r["risk_band"]: r["rows"] for r in queue.risk_by_band(rows).collect()}
    assert bands == {"low": 1, "guarded": 0, "medium": 1, "high": 0, "critical": 1}


def test_incoming_row_wins_a_tie(spark):
    old = spark.createDataFrame([(1, "old", 5), (2, "old", 9)], "id long, v string, at int")
    new = spark.createDataFrame([(1, "new", 5), (2, "new", 8), (3, "new", 1)], "id long, v string, at int")
    got = {r["id"]: r["v"] for r in queue.upsert(old, new, "id", "at").collect()}
    assert got == {1: "new", 2: "old", 3: "new"}


def raw_tables(spark):
    """A small table in the wide card-payment layout, with its side table."""
    pick = random.Random(8)
    spec = CARD_PAYMENTS
    names = [
        spec.id, spec.time, spec.amount, spec.product, *[f"card{i}" for i in range(1, 7)], "addr1", "addr2",
        "P_emaildomain", "R_emaildomain", "dist1", "dist2", *[f"C{i}" for i in range(1, 15)],
        *[f"D{i}" for i in (1, 2, 3, 4, 5, 10, 15)], *[f"M{i}" for i in range(1, 10)],
    ]

    def row(i, at):
        amount = round(pick.lognormvariate(4, 1), 3)
        text = [pick.choice(["W", "C", " h ", None])] + [pick.choice(["1", "2", None]) for _ in range(6)]
        rest = [pick.choice(["10", None]), pick.choice(["87", None]), pick.choice(["Gmail.com", None]), None]
        numbers = [pick.random() * 10 if pick.random() < 0.8 else None for _ in range(23)]
        marks = [pick.choice(["T", "F", None]) for _ in range(9)]
        return (i, at, amount, *text, *rest, *numbers, *marks)

    def table(start, n, at):
        rows = [row(start + i, at + 60 * i) for i in range(n)]
        return spark.createDataFrame(rows, schemas.transaction_schema(names))

    train = table(1, 900, 86400)
    label = (F.col(spec.amount) > 60).cast("int")
    train = train.withColumn(spec.label, F.when(F.col(spec.id) % 9 == 0, 1 - label).otherwise(label))
    test = table(5000, 100, 10**6)
    side = [(i, float(i), "Found", pick.choice(["mobile", None]), pick.choice(["iPhone", None])) for i in range(1, 901, 4)]
    layout = "TransactionID long, id_01 double, id_12 string, DeviceType string, DeviceInfo string"
    identity = spark.createDataFrame(side, layout)
    return {"train": train, "test": test}, {"train": identity, "test": identity.filter("TransactionID < 0")}


def test_from_raw_tables_to_a_release_and_scores(spark, tmp_path):
    spec = CARD_PAYMENTS
    joined = join_and_audit(*raw_tables(spark), spec)
    write_reports(joined["train"], spec, str(tmp_path / "reports"))
    assert spark.read.option("header", True).csv(str(tmp_path / "reports/rate_by_hour")).count() > 0
    prepared = prepare(joined["train"], joined["test"], spec, Options(generated_at="2024-01-01"))
    datasets = write_prepared(prepared, spec, str(tmp_path))
    assert contract.feature_columns(datasets["holdout"], spec) == list(spec.features)
    assert sum(datasets[n].count() for n in ("train_original", "validation", "holdout")) == 900

    done = release(datasets, spec, families=("logreg", "decision_tree"), settings={"logreg": {"maxIter": 20}})
    assert done.metrics.first()["roc_auc"] > 0.8
    assert done.gates.count() == 5 and done.comparison.count() == 4

    columns = model_columns(datasets, spec)
    batch = score_batch(datasets["unlabelled"], done.model, done.calibrator, spec, columns, "v1", "2024-01-01 00:00:00")
    table = write_scored(None, batch, spec, str(tmp_path / "scored_1"))
    assert {r[0] for r in table.select("scoring_mode").distinct().collect()} == {"full_feature"}
    partial = datasets["unlabelled"].drop("C1").filter("TransactionID < 5010")
    later = score_batch(partial, done.model, done.calibrator, spec, columns, "v2", "2024-01-02 00:00:00")
    merged = write_scored(table, later, spec, str(tmp_path / "scored_2"))
    assert {r[0]: r[1] for r in merged.groupBy("scoring_mode").count().collect()} == {"full_feature": 90, "partial_demo": 10}

    broken = {**datasets, "holdout": datasets["validation"].drop("C1")}
    failed = {(r["dataset"], r["check_name"]) for r in contract.contract_checks(broken, spec).filter("NOT ok").collect()}
    assert {("holdout", "feature_order"), ("holdout", "feature_count"), ("validation/holdout", "no_shared_ids")} <= failed
    with pytest.raises(ValueError):
        contract.require_ok(contract.contract_checks(broken, spec))


def test_histories_of_interleaved_tables_do_not_leak(spark):
    """Unlabelled rows between the labelled ones leave labelled histories as they were."""
    transactions, identities = raw_tables(spark)
    spec = CARD_PAYMENTS
    joined = join_and_audit(transactions, identities, spec)
    early = joined["test"].withColumn(spec.time, F.col(spec.time) - 10**6 + 86400)
    names = [spec.id, "prior_card_transaction_count", "prior_email_amount_sum"]
    options = Options(generated_at="2024-01-01")
    apart = prepare(joined["train"], joined["test"], spec, options).features.filter("labelled").select(*names)
    mixed = prepare(joined["train"], early, spec, options).features.filter("labelled").select(*names)
    assert apart.exceptAll(mixed).isEmpty() and mixed.exceptAll(apart).isEmpty()


def test_import_of_ids_that_are_no_bigints(spark):
    ids = ["NaN", "1e30", "12.7", "9007199254740993", "12.0", "Infinity", "x", "", None, "-5"]
    raw = spark.createDataFrame([(i, "1.5") for i in ids] + [("77", "NaN"), ("78", "Infinity")], "id string, amount string")
    from riskframe.sources.batch_import import quarantined_rows, valid_rows

    assert {r.id for r in valid_rows(raw, "id", "amount").collect()} == {9007199254740993, 12, -5}
    assert quarantined_rows(raw, "id", "amount").count() == len(ids) + 2 - 3


def test_an_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    folder = str(tmp_path / "t")
    table = BucketTable(folder, ("id",), 8)
    schema = "id bigint, value string, at int"
    first = [(i, f"old{i}", 1) for i in range(40)] + [(None, "old", 1)]
    table.create(spark.createDataFrame(first, schema))
    before = {b: p for b, p in table.paths(spark)[1].items()}
    files = {p: sorted((f.name, f.stat().st_mtime_ns) for f in pathlib.Path(p).iterdir()) for p in before.values()}
    batch = [(3, "older", 0), (4, "tie", 1), (4, "stale", 0), (900, "new", 5), (None, "newer", 2)]
    touched = table.upsert(spark.createDataFrame(batch, schema), ["at"])
    assert 0 < len(touched) <= 4
    version, after = table.paths(spark)
    assert version == 2 and {b for b in after if after[b] != before.get(b)} == set(touched)
    for path, had in files.items():
        assert sorted((f.name, f.stat().st_mtime_ns) for f in pathlib.Path(path).iterdir()) == had
    expected = {i: (v, a) for i, v, a in first} | {4: ("tie", 1), 900: ("new", 5), None: ("newer", 2)}
    assert {r.id: (r.value, r.at) for r in table.read(spark).collect()} == expected
    assert table.read(spark).count() == len(expected)
    assert table.upsert(spark.createDataFrame([], schema), ["at"]) == []


def test_a_stored_table_may_start_empty(spark, tmp_path):
    table = BucketTable(str(tmp_path / "t"), ("id",), 4)
    rows = spark.createDataFrame([(1, 2)], "id bigint, at int")
    table.create(rows.limit(0))
    assert table.read(spark).count() == 0 and table.read(spark).columns == ["id", "at"]
    table.upsert(rows, ["at"])
    assert [tuple(r) for r in table.read(spark).collect()] == [(1, 2)]


def test_rows_of_csv_files_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a", 700), ("b", 3), ("c", 0)):
        lines = ["id,amount", *[f"{name}{i},{'' if i % 5 else i}" for i in range(1, n + 1)]]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        rows = numbered_csv(spark, str(tmp_path))
        found = {(pathlib.Path(r.file).stem, r.row_number): r.id for r in rows.collect()}
        splits = spark.read.csv(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert splits > 5
    assert found == {(f, i + 1): f"{f}{i}" for f, n in (("a", 700), ("b", 3)) for i in range(1, n + 1)}


def test_profile_states_add_up(spark):
    pick = random.Random(3)
    rows = [(pick.randrange(3000), None if i % 7 == 0 else f"v{i}", float("nan") if i % 2 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "a int, `b.c` string, d double")
    states = profile.union_all([profile.profile_state(df.filter(f"pmod(hash(a), 3) = {i}")) for i in range(3)] + [profile.profile_state(df.limit(0))])
    found = {r.column_name: r for r in profile.profile_of_state(profile.merge_profiles(states), "x").collect()}
    assert {c: (r.row_count, r.null_count) for c, r in found.items()} == {
        "a": (6000, 0), "b.c": (6000, sum(r[1] is None for r in rows)), "d": (6000, 3000)
    }
    for column, exact in (("a", len({r[0] for r in rows})), ("b.c", len({r[1] for r in rows} - {None})), ("d", 1)):
        assert abs(found[column].approx_distinct_count - exact) <= 3 * profile.SKETCH_ERROR * exact


def test_a_manifest_reads_only_folders_that_are_not_as_they_were(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id * 2 AS v", "id % 3 AS part").write.partitionBy("part").parquet(path)
    content = files.content_manifest(spark, path)
    content.write.parquet(str(tmp_path / "manifest"))
    before = spark.read.parquet(str(tmp_path / "manifest"))
    assert {r.state for r in files.compare_manifests(before, files.content_manifest(spark, path, before)).collect()} == {"kept"}
    # A fingerprint that was tampered with stays, since the folder's files are the same: it was not read.
    odd = before.withColumn("fingerprint", F.lit("0"))
    again = files.content_manifest(spark, path, odd)
    assert {r.fingerprint for r in again.collect()} == {"0"}
    spark.range(100).selectExpr("id", "id * 2 AS v", "id % 3 AS part").filter("part = 1 AND id <> 4").write.mode("overwrite").partitionBy("part").parquet(path)
    after = {r.part[-6:]: r.fingerprint for r in files.content_manifest(spark, path, odd).collect()}
    assert after["part=0"] == after["part=2"] == "0" != after["part=1"]
    states = {r.part[-6:]: (r.state, r.rows_before, r.rows_after) for r in files.compare_manifests(before, files.content_manifest(spark, path, before)).collect()}
    assert states["part=1"] == ("changed", 33, 32) and states["part=0"] == ("kept", 34, 34)
