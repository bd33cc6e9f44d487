"""Physical plans keep the shape the operators promise."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from riskframe.catalog.tables import SPEC, scored
from riskframe.operators.queue import demo_cases
from riskframe.operators.splits import Boundaries, split_frames

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["flagship", "pit_history_hot_keys", "train_lookup_features", "holdout_metrics", "join_audit_fanout", "upsert_scored",
     "outlier_profile", "review_worklist", "threshold_table", "attribution_top5"],
)
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(spark_entry.queries()[name](spark, FOLDER))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|EvalPython|InPandas", text)


def test_split_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") * 3).alias("at"), F.lit("x").alias("other")).write.parquet(str(tmp_path / "t"))
    frame = split_frames(spark.read.parquet(str(tmp_path / "t")), "at", Boundaries(100, 200))["validation"]
    text = plan(frame.select("id"))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(at,100.*LessThanOrEqual\(at,200", text)
    assert "other" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_ranked_cases_are_cut_before_the_shuffle(spark):
    rows = scored(spark, FOLDER).withColumn("prediction", (F.col("p") >= 0.5).cast("int"))
    assert "WindowGroupLimit" in plan(demo_cases(rows, "label", "prediction", "p", SPEC.id))


def test_latest_merges_before_the_shuffle(spark):
    text = plan(spark_entry.queries()["review_latest"](spark, FOLDER))
    assert "partial_max_by" in text and "Window" not in text
