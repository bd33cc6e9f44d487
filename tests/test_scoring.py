"""Stored scorers against the learners they come from."""

import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import training
from riskframe.operators.scorers import LinearScorer, explain, largest, read_scorer, scorer_of, write_scorer

COLUMNS = training.Columns("id", "label", ("a", "b"), ("kind",))
SETTINGS = {
    "logreg": {"maxIter": 30},
    "decision_tree": {"minInstancesPerNode": 5},
    "random_forest": {"numTrees": 4, "maxDepth": 4},
    "gbt": {"maxIter": 4, "maxDepth": 3},
}


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(4)
    made = []
    for i in range(800):
        a, b, kind = pick.uniform(-2, 2), pick.randrange(6) * 1.0, pick.choice("pqrs")
        made.append((i, int(a + b / 3 + (kind == "r") > pick.uniform(0, 3)), a, b, kind))
    return spark.createDataFrame(made, "id bigint, label int, a double, b double, kind string").cache()


@pytest.mark.parametrize("family", training.FAMILIES)
def test_a_scorer_gives_what_the_learner_gives(spark, rows, tmp_path, family):
    model = training.pipeline(family, COLUMNS, **SETTINGS[family]).fit(rows)
    write_scorer(spark, scorer_of(model, COLUMNS), str(tmp_path / "scorer"))
    scorer = read_scorer(spark, str(tmp_path / "scorer"))
    assert scorer == scorer_of(model, COLUMNS)
    odd = spark.createDataFrame([(9000, 0, 0.1, 2.0, "never seen"), (9001, 0, -1.0, 5.0, None), (9002, 0, float("nan"), 1.0, "p")], rows.schema)
    both = rows.unionByName(odd)
    if family == "logreg":
        both = both.filter("not isnan(a)")
    expected = {r.id: r.probability for r in training.predict(model, both, ["id"]).collect()}
    total = F.aggregate(scorer.contributions(), F.lit(0.0), lambda s, c: s + c["contribution"])
    found = both.select("id", scorer.probability().alias("p"), scorer.output().alias("out"), total.alias("moved")).collect()
    assert len(found) == len(expected)
    for r in found:
        assert r.p == pytest.approx(expected[r.id], abs=1e-9)
        assert scorer.base() + r.moved == pytest.approx(r.out, abs=1e-9)


def test_contributions_are_ordered_by_size_then_name(spark):
    names = ("c", "a", "b")
    scorer = LinearScorer(0.5, dict.fromkeys(names, 2.0), dict.fromkeys(names, 0.0), {"c": 1.0, "a": 1.0, "b": 0.0}, {})
    df = spark.createDataFrame([(1, -3.0, 3.0, 8.0)], "id int, c double, a double, b double")
    assert [tuple(c) for c in df.select(largest(scorer.contributions(), 2)).first()[0]] == [("a", 6.0), ("c", -6.0)]
    assert [tuple(r) for r in explain(df, scorer, ["id"]).collect()] == [(1, 1, "a", 6.0), (1, 2, "c", -6.0), (1, 3, "b", 0.0)]
    assert explain(df.limit(0), scorer, ["id"]).count() == 0
