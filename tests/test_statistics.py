import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import boosting, fitted, isotonic, quantiles, ranking, splits, training
from riskframe.operators.quantiles import exact_quantiles, quantile_values, running_totals


def disc(values, p):
    ordered = sorted(values)
    return ordered[max(math.ceil(round(p * len(ordered), 9)), 1) - 1]


@pytest.mark.parametrize("most", [10**6, 100, 3])
def test_quantiles_equal_brute_force(spark, most):
    pick = random.Random(3)
    # A third of the rows share one value; the rest is long-tailed.
    values = [7.5 if pick.random() < 0.34 else round(math.exp(pick.gauss(3, 2)), 2) for _ in range(3000)]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)] + [(None, 0), (float("nan"), 1)], "v double, g int")
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.7, 0.85, 0.99, 0.9999999, 1.0, 1 / 3]
    got = {r["probability"]: r["value"] for r in exact_quantiles(df, ["v"], probabilities, rows_per_bracket=most).collect()}
    assert got == {p: disc(values, p) for p in probabilities}
    grouped = exact_quantiles(df, ["v"], [0.5], by=["g"], rows_per_bracket=most).collect()
    assert {r["g"]: r["value"] for r in grouped} == {g: disc(values[g::2], 0.5) for g in (0, 1)}


def test_quantiles_of_several_columns(spark):
    df = spark.range(1, 101).select(F.col("id").alias("a"), (F.col("id") * 2).cast("decimal(9,2)").alias("b"))
    assert quantile_values(df, ["a", "b"], [0.5]) == {"a": {0.5: 50.0}, "b": {0.5: 100.0}}


def test_quantiles_of_wild_and_of_equal_values(spark):
    """Whatever a sketch says: many orders of size, both signs, infinities, one value only, and none."""
    pick = random.Random(9)
    wild = [pick.choice([-1, 1]) * 10.0 ** pick.uniform(-300, 300) for _ in range(500)] + [float("inf"), float("-inf"), 0.0, -0.0]
    df = spark.createDataFrame([(v, 5.0, None) for v in wild], "a double, b double, c double")
    for most in (10**6, 5):
        rows = exact_quantiles(df, ["a", "b", "c"], [0.001, 0.5, 0.999], rows_per_bracket=most).collect()
        got = {(r["column_name"], r["probability"]): r["value"] for r in rows}
        assert got == {**{("a", p): disc(wild, p) for p in (0.001, 0.5, 0.999)}, **{("b", p): 5.0 for p in (0.001, 0.5, 0.999)}}
    assert exact_quantiles(df.limit(0), ["a"], [0.5]).count() == 0


def test_few_values_are_shuffled_for_a_quantile(spark):
    """No bracket of the last pass holds more than its rows, unless it is one value."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v")).union(spark.range(100_000).select(F.lit(77.5)))
    df.createOrReplaceTempView("many")
    seen = []
    first = quantiles._State.__init__

    def watched(self, frame, by):
        first(self, frame, by)
        seen.append(self.only)

    quantiles._State.__init__ = watched
    try:
        rows = exact_quantiles(df, ["v"], [0.1, 0.6], rows_per_bracket=50).collect()
    finally:
        quantiles._State.__init__ = first
    ordered = sorted(r["v"] for r in df.collect())
    assert {r["probability"]: r["value"] for r in rows} == {0.1: ordered[29_999], 0.6: ordered[179_999]}
    last = [s for s in seen if "in0_0" in s][-1]
    assert all(last[f"in0_{j}"] <= 50 or last[f"low0_{j}"] == last[f"high0_{j}"] for j in (0, 1))


def test_cells_of_running_totals_are_small(spark):
    df = spark.range(40_000).select((F.col("id") / 7).alias("v"), F.lit(1).alias("n"))
    edges = quantiles.cell_edges(df, ["v"], rows_per_cell=500)
    sizes = quantiles.with_cells(df, ["v"], edges).groupBy("__cell_v").count().collect()
    assert max(r["count"] for r in sizes) <= 1500


def test_running_totals_equal_brute_force(spark):
    pick = random.Random(4)
    rows = [(round(pick.random() ** 3, 3), pick.randrange(5)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "v double, n int")
    for r in running_totals(df, "v", ["n"], descending=True).collect():
        assert r["upto_n"] == sum(n for v, n in rows if v >= r["v"])
        assert r["total_n"] == sum(n for _, n in rows)


def scores(seed, n=800):
    pick = random.Random(seed)
    return [(round(pick.random(), 2), int(pick.random() < 0.2)) for _ in range(n)]


def test_ranking_metrics_equal_brute_force(spark):
    rows = scores(5)
    df = spark.createDataFrame(rows, "p double, label int")
    positives = [p for p, y in rows if y]
    negatives = [p for p, y in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in positives for b in negatives) / len(positives) / len(negatives)
    ap, before = 0.0, 0.0
    for t in sorted({p for p, _ in rows}, reverse=True):
        tp, n = sum(p >= t for p in positives), sum(p >= t for p, _ in rows)
        recall = tp / len(positives)
        ap, before = ap + (recall - before) * tp / n, recall
    got = ranking.rank_metrics(df, "p", "label").first()
    assert (got["pr_auc"], got["roc_auc"]) == (pytest.approx(ap), pytest.approx(auc))
    at = ranking.binary_metrics(df, "p", "label", 0.29).first()
    assert at["tp"] == sum(p >= 0.29 for p in positives) and at["fp"] == sum(p >= 0.29 for p in negatives)
    for r in ranking.threshold_table(df, "p", "label").collect():
        assert r["tp"] == sum(p >= r["threshold"] for p in positives)
        assert r["tn"] == sum(p < r["threshold"] for p in negatives)


def test_rows_without_a_score_rank_last(spark):
    rows = [(None, 0)] * 20 + [(float("nan"), 1)] + [(0.9, 1), (0.4, 0), (0.1, 0)]
    df = spark.createDataFrame(rows, "p double, label int")
    got = ranking.binary_metrics(df, "p", "label", 0.5).first()
    assert (got.tp, got.fp, got.tn, got.fn) == (1, 0, 22, 1)
    assert got.roc_auc == pytest.approx((22 + 20 / 2) / 44)
    assert got.pr_auc == pytest.approx(0.5 + 0.5 * 2 / 24)
    at = {r.threshold: r for r in ranking.threshold_table(df, "p", "label").collect()}
    assert (at[0.05].tp, at[0.05].fp, at[0.05].tn, at[0.05].fn) == (1, 2, 20, 1)


def test_metrics_without_positives_are_null_or_zero(spark):
    df = spark.createDataFrame([(0.2, 0), (0.8, 0)], "p double, label int")
    row = ranking.binary_metrics(df, "p", "label").first()
    assert (row["pr_auc"], row["roc_auc"]) == (None, None)
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_policy_on_four_thresholds(spark):
    rows = [(0.10, 0.20, 0.90, 0.33), (0.20, 0.35, 0.80, 0.49), (0.40, 0.61, 0.50, 0.55), (0.60, 0.75, 0.30, 0.43)]
    table = spark.createDataFrame(rows, "threshold double, precision double, recall double, f1 double")
    policy = ranking.threshold_policy(table).first()
    assert (policy["review_threshold"], policy["reject_threshold"]) == (0.20, 0.40)
    assert policy["reject_selection_rule"] == ranking.REJECT_RULE
    strict = ranking.threshold_policy(table, 0.30, 0.90).first()
    assert (strict["reject_threshold"], strict["reject_selection_rule"]) == (0.60, ranking.REJECT_FALLBACK_RULE)


def pooled(points):
    """Adjacent violators pooled one pair at a time, from the start whenever one is found."""
    blocks = [([x], w, t) for x, w, t in sorted(points)]
    i = 0
    while i + 1 < len(blocks):
        (xs, w, t), (ys, v, u) = blocks[i], blocks[i + 1]
        if t / w > u / v:
            blocks[i : i + 2] = [(xs + ys, w + v, t + u)]
            i = max(i - 1, 0)
        else:
            i += 1
    return [(xs[0], xs[-1], t / w) for xs, w, t in blocks]


SHAPES = {
    "rising": lambda i, pick: i + pick.random(),
    "falling": lambda i, pick: -i,
    "saw": lambda i, pick: i % 40,
    "waves": lambda i, pick: math.sin(i / 60) * 50 + i / 9 + pick.gauss(0, 4),
    "cliff": lambda i, pick: i if i < 500 else i - 450,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_isotonic_fit_in_ranges_equals_pooling(spark, shape, monkeypatch):
    pick = random.Random(8)
    points = [(i / 7, float(pick.randrange(1, 5))) for i in range(600)]
    points = [(x, w, w * SHAPES[shape](i, pick)) for i, (x, w) in enumerate(points)]
    sizes = []
    cut = isotonic.cut

    def watched(*args):
        placed, cells = cut(*args)
        sizes.append(max((r["count"] for r in placed.groupBy("cell").count().collect()), default=0))
        return placed, cells

    monkeypatch.setattr(isotonic, "cut", watched)
    df = spark.createDataFrame([*points, (None, 1.0, 9.0), (float("nan"), 1.0, 9.0)], "x double, weight double, total double").repartition(3)
    steps = isotonic.fit_isotonic(df, blocks_per_task=30)
    expected = pooled(points)
    got = sorted(map(tuple, steps.collect()))
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in expected])
    assert max(sizes) <= 90  # never all 600 in one task
    asked = [-5.0, 0.0, 3.3, 17.01, 42.0, 80.5, 999.0, None, float("nan")]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "i int, x double")
    found = isotonic.apply_isotonic(rows, steps, "x", "y", blocks_per_task=30).orderBy("i").collect()
    xs = [x for low, high, _ in expected for x in (low, high)]
    ys = [v for *_, v in expected for _ in (0, 1)]
    assert [r.y for r in found[:7]] == pytest.approx(np.interp(asked[:7], xs, ys).tolist())
    assert [r.y for r in found[7:]] == [None, None]


def test_the_curve_is_looked_up_without_frames_of_all_following_rows(spark):
    """Such a frame takes square time; with thousands of scores and steps in one task the values are those of interpolation."""
    steps = [(float(i), i + 0.5, i / 500) for i in range(0, 500, 2)]
    asked = [i / 7 - 3 for i in range(4000)] + [float(i) for i in range(0, 500, 2)]
    rows = spark.createDataFrame([(x,) for x in asked], "x double")
    found = isotonic.apply_isotonic(rows, spark.createDataFrame(steps, "low double, high double, value double"), "x", "y")
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    got = sorted(map(tuple, found.collect()))
    xs, ys = [x for low, high, _ in steps for x in (low, high)], [v for *_, v in steps for _ in (0, 1)]
    assert [y for _, y in got] == pytest.approx(np.interp(sorted(asked), xs, ys).tolist())


def test_no_points_give_no_curve(spark):
    steps = isotonic.fit_isotonic(spark.createDataFrame([], "x double, weight double, total double"))
    rows = spark.createDataFrame([(0.5,)], "x double")
    assert [r.y for r in isotonic.apply_isotonic(rows, steps, "x", "y").collect()] == [None]


def test_calibration_is_monotone_and_clipped(spark):
    pick = random.Random(6)
    rows = [(p, int(pick.random() < p * p)) for p in (0.1 + 0.8 * pick.random() for _ in range(2000))]
    df = spark.createDataFrame(rows, "p double, label int")
    calibrator = ranking.fit_calibrator(df, "p", "label")
    outside = spark.createDataFrame([(0.0,), (0.3,), (0.5,), (0.7,), (1.0,)], "p double")
    got = [r["calibrated"] for r in calibrator.apply(outside, "p").orderBy("p").collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1
    after = ranking.brier_scores(calibrator.apply(df, "p"), "p", "calibrated", "label").first()
    assert after["calibration_improved"]


def test_windows_of_eight_rows(spark):
    df = spark.createDataFrame([(i, 10 * i) for i in range(1, 9)], "id long, at long")
    tagged, _ = splits.validation_windows(df, "at")
    splits.check_windows(tagged, "at")
    counts = {r["window"]: r["count"] for r in tagged.groupBy("window").count().collect()}
    assert counts == {"selection": 4, "calibration": 2, "policy": 2}


def test_splits_partition_the_rows(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") * 7 % 100).alias("at"))
    frames = splits.split_frames(df, "at", splits.fit_boundaries(df, "at", 0.50, 0.25))
    assert [frames[s].count() for s in splits.SPLITS] == [50, 25, 25]
    with pytest.raises(ValueError):
        splits.fit_boundaries(df, "at", 0.7, 0.3)
    with pytest.raises(ValueError):
        splits.check_windows(df.withColumn("window", F.lit("selection")), "at")


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(5000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    first = {r[0] for r in fitted.sample_rows(df, "id", 700).collect()}
    again = {r[0] for r in fitted.sample_rows(df.repartition(7), "id", 700).collect()}
    assert first == again and len(first) == 700
    assert fitted.sample_rows(df, "id", 9999).count() == 5000
    counts = {r["label"]: r["count"] for r in fitted.undersample(df, "id", "label", 3.0).groupBy("label").count().collect()}
    assert counts == {1: 500, 0: 1500}


def test_unseen_category_takes_the_last_code(spark, monkeypatch):
    train = spark.createDataFrame([("w",), ("w",), ("c",)], "product string")
    rows = spark.createDataFrame([("w",), ("never-seen",), (None,)], "product string")
    index = fitted.category_index(train, ["product"])
    assert [r[0] for r in fitted.encode_categories(rows, index, ["product"]).collect()] == [0.0, 2.0, 2.0]
    monkeypatch.setattr(fitted, "MOST_LITERAL_CATEGORIES", 1)
    joined = fitted.encode_categories(rows, index, ["product"]).collect()
    assert sorted(r[0] for r in joined) == [0.0, 2.0, 2.0]


def test_medians_come_from_training_rows_and_empty_columns_fail(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    filled = fitted.impute(df.select("a"), fitted.fit_medians(df, ["a"])).collect()
    assert sorted(r[0] for r in filled) == [1.0, 1.0, 3.0]
    with pytest.raises(ValueError, match="b"):
        fitted.fit_medians(df, ["a", "b"])


def test_learners_of_a_table_share_its_vectors(spark, monkeypatch):
    pick = random.Random(5)
    rows = [(i, pick.random(), "abc"[i % 3], 1.0 + i % 2) for i in range(400)]
    weighted = spark.createDataFrame([(i, a, c, w, int(a > 0.6)) for i, a, c, w in rows], "id int, a double, c string, class_weight double, label int")
    balanced = weighted.filter("id % 4 > 0").drop("class_weight")
    columns = training.Columns("id", "label", ["a"], ["c"])
    made, encode = [], training.encode
    monkeypatch.setattr(training, "encode", lambda table, columns: made.append(table) or encode(table, columns))
    families = ("logreg", "decision_tree", "gbt")
    models = training.compare_families(weighted, balanced, columns, families, {"gbt": {"maxIter": 2}})
    assert len(models) == 6 and made == [weighted, balanced]
    for family in families:
        settings = {"maxIter": 2} if family == "gbt" else {}
        for name, table, weight in (("weighted", weighted, "class_weight"), ("balanced", balanced, None)):
            own = training.pipeline(family, columns, weight, **settings).fit(table)
            got, expected = ([r.probability for r in training.predict(m, weighted, ["id"]).orderBy("id").collect()] for m in (models[f"{family}__{name}"], own))
            assert got == pytest.approx(expected, abs=1e-6)


def test_the_first_rounds_of_a_run_are_the_shorter_run(spark):
    pick = random.Random(2)
    rows = [(i, float(pick.random()), float(pick.random()), "ab"[i % 2]) for i in range(300)]
    rows = [(i, a, b, c, int(a * b > 0.3)) for i, a, b, c in rows]
    df = spark.createDataFrame(rows, "id int, a double, b double, c string, label int")
    columns = training.Columns("id", "label", ["a", "b"], ["c"])
    points = {"short": {"maxIter": 2, "maxDepth": 2}, "long": {"maxIter": 5, "maxDepth": 2}, "deep": {"maxIter": 2, "maxDepth": 3}}
    found = training.fit_grid(df, columns, "gbt", points, None, 2)
    for name, point in points.items():
        own = training.pipeline("gbt", columns, **point).fit(df)
        got, expected = (sorted(training.predict(m, df, ["id"]).collect()) for m in (found[name], own))
        assert got == expected
    assert found["short"].stages[-1].getNumTrees == 2 and found["long"].stages[-1].getNumTrees == 5


def test_runs_that_grow_together_are_the_runs_of_spark_ml(spark, monkeypatch):
    monkeypatch.setattr(boosting, "LEAST_TASK_ROWS", 200)
    monkeypatch.setattr(boosting, "ROUNDS_OF_LINEAGE", 2)
    pick = random.Random(2)
    rows = [(i, round(pick.random(), 2), pick.random(), float(pick.randrange(5)), "abcdefg"[pick.randrange(7)], 1.0 + pick.randrange(3)) for i in range(900)]
    rows = [(*r, int(r[1] * r[2] + 0.2 * (r[4] in "bdf") + 0.1 * pick.random() > 0.4)) for r in rows]
    names = "id int, a double, b double, e double, c string, class_weight double, label int"
    df = spark.createDataFrame(rows, names).withColumns({"same": F.col("a") * 2, "one": F.lit(1.0)})
    columns = training.Columns("id", "label", ["a", "b", "e", "same", "one"], ["c"])
    points = {
        "short": {"maxIter": 2, "maxDepth": 3, "stepSize": 0.1},
        "long": {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1},
        "deep": {"maxIter": 4, "maxDepth": 4, "stepSize": 0.05},
    }
    jobs, total = [], boosting.total
    monkeypatch.setattr(boosting, "total", lambda parts: jobs.append(parts.getNumPartitions()) or total(parts))
    together = training.boost_grid(df, columns, points, "class_weight")
    assert jobs == [5] * 19  # four rounds of four levels for both runs, and the last round of the flat run
    alone = training.fit_grid(df, columns, "gbt", points, "class_weight", 2)
    unseen = df.withColumn("c", F.when(F.col("id") % 9 > 0, F.col("c")).otherwise("new"))
    for name in points:
        got, expected = (sorted(training.predict(m[name], unseen, ["id"]).collect()) for m in (together, alone))
        assert [r.probability for r in got] == pytest.approx([r.probability for r in expected], abs=1e-12)
        assert [r.prediction for r in got] == [r.prediction for r in expected]
