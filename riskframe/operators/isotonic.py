"""Isotonic regression over any number of distinct scores, without a task that holds them all.

Scores are cut into ranges of about so many blocks. Each range pools its adjacent violators; what is left are
blocks that rise within a range, and only neighbours across a border can still violate. The next round cuts at other
places, so that such neighbours meet, and pools again: raw points are not read twice.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.quantiles import known, with_cells
from riskframe.session import materialise

BLOCKS_PER_TASK = 500_000
BLOCK = "cell double, low double, high double, weight double, total double"


def pool_violators(low: np.ndarray, high: np.ndarray, weight: np.ndarray, total: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Blocks in order, neighbours pooled until means rise or stay."""
    blocks: list[tuple[float, float, float, float]] = []
    for a, b, w, s in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist(), strict=True):
        while blocks and blocks[-1][3] * w > s * blocks[-1][2]:
            a, _, w0, s0 = blocks.pop()
            w, s = w + w0, s + s0
        blocks.append((a, b, w, s))
    return blocks


def cut(blocks: DataFrame, turn: int, blocks_per_task: int) -> tuple[DataFrame, int]:
    """``cell`` of each block by its ``low``; odd turns cut in the middle of the cells of even ones."""
    cells = ceil(blocks.count() / blocks_per_task)
    shift = turn % 2 / 2
    shares = [(i + shift) / cells for i in range(1 - turn % 2, cells)] if cells > 1 else []
    found = blocks.approxQuantile("low", shares, 0.1 / cells) if shares else []
    edges = [float("-inf"), *(sorted(set(found)) or [0.0]), float("inf")]
    if not found:
        return blocks.withColumn("cell", F.lit(0.0)), 1
    placed = with_cells(blocks.drop("cell"), ["low"], [edges])
    return placed.withColumnRenamed("__cell_low", "cell"), len(edges) - 1


def fit_isotonic(points: DataFrame, blocks_per_task: int = BLOCKS_PER_TASK) -> DataFrame:
    """``low``, ``high`` and ``value``: the steps of the rising curve nearest to the points, in squared error.

    ``points`` has one row per distinct ``x`` with its ``weight`` and ``total`` (weight times mean); NULL and NaN ``x`` are ignored. No
    points give no steps. Each round is a shuffle of the blocks that are left; a task has about ``blocks_per_task`` of them.
    """

    def pooled(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("low")
        found = pool_violators(*[group[c].to_numpy() for c in ("low", "high", "weight", "total")])
        return pd.DataFrame([(group["cell"].iloc[0], *b) for b in found], columns=["cell", "low", "high", "weight", "total"])

    x = known("x")
    blocks = materialise(points.select(x.alias("low"), x.alias("high"), "weight", "total").filter("low is not null"), "points")
    turn = 0
    while True:
        placed, cells = cut(blocks, turn, blocks_per_task)
        ordered = placed.select("cell", "low", "high", F.col("weight").cast("double"), F.col("total").cast("double"))
        blocks = materialise(ordered.groupBy("cell").applyInPandas(pooled, BLOCK), "blocks")
        if cells == 1:
            break
        mean = F.col("total") / F.col("weight")
        ends = blocks.groupBy("cell").agg(F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last")).orderBy("cell").collect()
        if all(a["last"] <= b["first"] for a, b in zip(ends, ends[1:])):  # one row per task
            break
        turn += 1
    return blocks.select("low", "high", (F.col("total") / F.col("weight")).alias("value"))


def apply_isotonic(df: DataFrame, steps: DataFrame, score: str, output: str, blocks_per_task: int = BLOCKS_PER_TASK) -> DataFrame:
    """``df`` with the curve's value at ``score``: flat on a step, linear between two, the end values outside; NULL without a score or a curve.

    Distinct scores and steps meet in ranges of the score; a range knows the step before and after it.
    """
    points = materialise(steps, "steps")
    asked = df.select(known(score).alias("low")).filter("low is not null").distinct()
    both = points.unionByName(asked, allowMissingColumns=True)
    placed, _ = cut(both, 0, blocks_per_task)
    placed = materialise(placed, "asked")
    step = F.when(F.col("value").isNotNull(), F.struct("low", "high", "value"))
    ends = placed.filter("value is not null").groupBy("cell").agg(F.min(F.struct("low", "high", "value")).alias("least"), F.max(F.struct("low", "high", "value")).alias("most"))
    every = placed.select("cell").distinct().join(ends, "cell", "left")  # one row per task
    upward, downward = Window.orderBy("cell"), Window.orderBy(F.col("cell").desc())
    earlier = (Window.unboundedPreceding, -1)
    around = every.select(
        "cell",
        F.last("most", ignorenulls=True).over(upward.rowsBetween(*earlier)).alias("before"),
        F.last("least", ignorenulls=True).over(downward.rowsBetween(*earlier)).alias("after"),
    )
    # The next step is the last one in falling order: a frame of all following rows is walked again for each row, in square time.
    inside = Window.partitionBy("cell").orderBy("low", F.col("value").isNull())
    falling = Window.partitionBy("cell").orderBy(F.col("low").desc(), F.col("value").isNull().desc())
    met = placed.withColumns(
        {
            "at": F.last(step, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "next": F.last(step, ignorenulls=True).over(falling.rowsBetween(*earlier)),
        }
    )
    met = met.filter("value is null").join(around, "cell")
    a, b = F.coalesce("at", "before"), F.coalesce("next", "after")
    x = F.col("low")
    share = (x - a["high"]) / (b["low"] - a["high"])
    value = (
        F.when(a.isNull(), b["value"])
        .when((x <= a["high"]) | b.isNull(), a["value"])
        .otherwise(a["value"] + (b["value"] - a["value"]) * share)
    )
    curve = met.select(x.alias("__at"), value.alias(output))
    return df.join(curve, known(score) == F.col("__at"), "left").drop("__at")
