import math

import pytest
from pyspark.sql import functions as F

from riskframe.functions import risk, rowwise


def test_both_sides_of_every_band_edge(spark):
    """Scores are half-even percents, so a band ends just after half a percent above its last score."""
    rows = []
    for band, low, high, decision in risk.RISK_BANDS:
        rows += [(low / 100 - 0.004, low, band, decision), (low / 100, low, band, decision)]
        rows += [(high / 100, high, band, decision), (high / 100 + 0.004, high, band, decision)]
    rows += [(-3.25, 0, *[risk.RISK_BANDS[0][i] for i in (0, 3)]), (8.0, 100, *[risk.RISK_BANDS[-1][i] for i in (0, 3)]), (None, None, None, None)]
    # Halves go to the even score.
    rows += [(s / 100, 4, "low", "approve") for s in (3.5, 4.5)]
    df = spark.createDataFrame(rows, "p double, score int, band string, decision string").withColumn("s", risk.risk_score(F.col("p")))
    for r in df.select("*", risk.risk_band(F.col("s")).alias("b"), risk.decision(F.col("s")).alias("d")).collect():
        assert (r.s, r.b, r.d) == (r.score, r.band, r.decision), r


def test_bands_cover_all_scores():
    covered = [s for _, low, high, _ in risk.RISK_BANDS for s in range(low, high + 1)]
    assert covered == list(range(101))


def test_null_traps(spark):
    df = spark.createDataFrame([(None, None, None, None)], "amount double, a string, b string, info string")
    row = df.select(
        rowwise.amount_band(F.col("amount")),
        F.col("a").eqNullSafe(F.col("b")),
        rowwise.device_family("info"),
        rowwise.entity_key("a", "b"),
    ).first()
    assert tuple(row) == ("07_1000_plus", True, "other", "__NA__|__NA__")


def test_amount_bands_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (10.0, 10.01, 1000.0, 1000.01)], "amount double")
    bands = [r[0] for r in df.select(rowwise.amount_band(F.col("amount"))).collect()]
    assert bands == ["00_0_10", "01_10_25", "06_500_1000", "07_1000_plus"]


def test_device_families_in_order(spark):
    values = ["iPhone SAMSUNG", "sm-g960", "Windows iOS", "windows mac", "MacOS", "rv:52"]
    df = spark.createDataFrame([(v,) for v in values], "info string")
    found = [r[0] for r in df.select(rowwise.device_family("info")).collect()]
    assert found == ["apple", "android", "apple", "windows", "mac", "other"]


def test_fallback_is_repeatable_and_bounded(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1e7,), (50.0,)], "amount double")
    got = [r[0] for r in df.select(risk.fallback_probability(F.col("amount"))).collect()]
    import hashlib

    for amount, p in zip((0.0, 0.0, 1e7, 50.0), got):
        byte = hashlib.sha256(f"{amount:.2f}".encode()).digest()[0] / 255
        curve = 1 / (1 + math.exp(-(math.log1p(amount) - 6) / 1.5))
        assert p == pytest.approx(min(0.99, max(0.01, 0.7 * curve + 0.3 * byte)))


def test_scoring_mode_counts_null_as_supplied(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],)], "names array<string>")
    modes = [r[0] for r in df.select(risk.scoring_mode(F.col("names"), ["a", "b"])).collect()]
    assert modes == ["full_feature", "partial_demo"]


def test_contributions_are_the_largest_by_size(spark):
    weights = {c: w for c, w in zip("abcdefg", (1, -2, 3, -4, 5, -6, 7))}
    df = spark.createDataFrame([tuple([1.0] * 7)], ", ".join(f"{c} double" for c in weights))
    top = df.select(risk.linear_contributions(weights, dict.fromkeys(weights, 0.0))).first()[0]
    assert [(t["feature"], t["contribution"]) for t in top] == [("g", 7), ("f", -6), ("e", 5), ("d", -4), ("c", 3)]
