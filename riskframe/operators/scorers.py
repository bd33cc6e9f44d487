"""Fitted models as plain parameters: scored and explained by column expressions, and stored as one small text.

A scorer has no learner behind it, so a batch is scored inside generated code, and a stored one scores the same rows
in another session. Its size is that of the model: the nodes of its trees or one weight for each input.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.training import Columns

PARTS = "array<struct<feature:string,contribution:double>>"


@dataclass(frozen=True)
class Node:
    """A node with the ``value`` of the training rows that reached it.

    An inner node sends rows with ``feature`` <= ``at`` to the left or, for a text, those with one of ``texts``;
    ``others_left`` says where a text unseen in training goes. NaN goes to the right.
    """

    value: float
    feature: str | None = None
    at: float | None = None
    texts: tuple[str, ...] = ()
    others_left: bool = False
    left: Node | None = None
    right: Node | None = None


def _leaves(node: Node, path: tuple[tuple[str, float], ...] = ()) -> Iterator[tuple[float, tuple[tuple[str, float], ...]]]:
    """Value and steps (feature, change of the value) of each leaf, from the left."""
    if node.feature is None:
        yield node.value, path
        return
    for child in (node.left, node.right):
        yield from _leaves(child, (*path, (node.feature, child.value - node.value)))


def _goes_left(node: Node, known: Mapping[str, tuple[str, ...]]) -> Column:
    if node.feature not in known:
        return F.col(f"`{node.feature}`").cast("double") <= node.at
    text = F.col(f"`{node.feature}`")
    listed = text.isin(*node.texts) if node.texts else F.lit(False)
    if node.others_left:
        seen = known[node.feature]
        listed = listed | (~text.isin(*seen) if seen else F.lit(True))
    return listed


def _leaf_number(root: Node, known: Mapping[str, tuple[str, ...]]) -> Column:
    count = iter(range(sum(1 for _ in _leaves(root))))

    def walk(node: Node) -> Column:
        if node.feature is None:
            return F.lit(next(count))
        left = walk(node.left)
        return F.when(_goes_left(node, known), left).otherwise(walk(node.right))

    return walk(root)


def _fixed(values: object, kind: str) -> Column:
    """A constant of a nested type; the optimizer reads the text once."""
    return F.from_json(F.lit(json.dumps(values)), F.lit(kind))


@dataclass(frozen=True)
class TreeScorer:
    """Trees with weights. The weighted sum is the probability, or with ``margin`` half the log odds of it.

    ``texts`` has the values of each text input that were seen in training.
    """

    roots: tuple[Node, ...]
    weights: tuple[float, ...]
    texts: Mapping[str, tuple[str, ...]]
    margin: bool = False

    def base(self) -> float:
        """The sum before any split: what a row's contributions are added to."""
        return math.fsum(w * r.value for w, r in zip(self.weights, self.roots, strict=True))

    def output(self) -> Column:
        parts = [
            F.element_at(_fixed([w * value for value, _ in _leaves(root)], "array<double>"), _leaf_number(root, self.texts) + 1)
            for w, root in zip(self.weights, self.roots, strict=True)
        ]
        return reduce(lambda a, b: a + b, parts)

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-2 * self.output())) if self.margin else self.output()

    def contributions(self) -> Column:
        """How much each feature on the row's paths moved the output away from ``base``; an array of (feature, contribution)."""
        found = []
        for w, root in zip(self.weights, self.roots, strict=True):
            merged = []
            for _, path in _leaves(root):
                totals: dict[str, float] = {}
                for feature, change in path:
                    totals[feature] = totals.get(feature, 0.0) + w * change
                merged.append([{"feature": f, "contribution": c} for f, c in sorted(totals.items())])
            found.append(F.element_at(_fixed(merged, f"array<{PARTS}>"), _leaf_number(root, self.texts) + 1))
        if len(found) == 1:
            return found[0]
        every = F.flatten(F.array(*found))

        def total(name: Column) -> Column:
            zero = F.lit(0.0)
            return F.aggregate(every, zero, lambda sum_, part: sum_ + F.when(part["feature"] == name, part["contribution"]).otherwise(zero))

        names = F.array_distinct(F.transform(every, lambda part: part["feature"]))
        return F.transform(names, lambda name: F.struct(name.alias("feature"), total(name).alias("contribution")))


@dataclass(frozen=True)
class LinearScorer:
    """Log odds: ``intercept`` plus weight x (input - mean) / scale. A text counts as its place in ``texts``, others as the place after."""

    intercept: float
    weights: Mapping[str, float]
    means: Mapping[str, float]
    scales: Mapping[str, float]
    texts: Mapping[str, tuple[str, ...]]

    def base(self) -> float:
        return self.intercept

    def _number(self, name: str) -> Column:
        column = F.col(f"`{name}`")
        if name not in self.texts:
            return column.cast("double")
        seen = self.texts[name]
        place = F.coalesce(F.array_position(_fixed(list(seen), "array<string>"), column), F.lit(0))
        return F.when(place > 0, place - 1).otherwise(len(seen)).cast("double")

    def _part(self, name: str) -> Column:
        scale = self.scales[name]  # an input without spread has no say
        centred = self._number(name) - F.lit(float(self.means[name]))
        return centred * F.lit(float(self.weights[name] / scale if scale else 0.0))

    def output(self) -> Column:
        return reduce(lambda a, b: a + b, [self._part(n) for n in self.weights], F.lit(float(self.intercept)))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.output()))

    def contributions(self) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("feature"), self._part(n).alias("contribution")) for n in self.weights])


Scorer = TreeScorer | LinearScorer


def largest(contributions: Column, top: int = 5) -> Column:
    """The ``top`` contributions by size, then name."""
    ordered = F.sort_array(
        F.transform(contributions, lambda c: F.struct((-F.abs(c["contribution"])).alias("order"), c["feature"].alias("feature"), c["contribution"].alias("contribution")))
    )
    return F.transform(F.slice(ordered, 1, top), lambda c: F.struct(c["feature"].alias("feature"), c["contribution"].alias("contribution")))


def _seen(model: PipelineModel, columns: Columns) -> dict[str, tuple[str, ...]]:
    if not columns.text:
        return {}
    indexer = model.stages[0]
    return {name: tuple(labels) for name, labels in zip(indexer.getInputCols(), indexer.labelsArray, strict=True)}


def _node(java, columns: Columns, seen: Mapping[str, tuple[str, ...]], classes: bool) -> Node:
    if classes:
        stats = list(java.impurityStats().stats())
        value = float(stats[1]) / sum(stats) if sum(stats) else 0.0
    else:
        value = float(java.prediction())
    if java.subtreeDepth() == 0:
        return Node(value)
    split = java.split()
    numbers, place = len(columns.numeric), split.featureIndex()
    children = {"left": _node(java.leftChild(), columns, seen, classes), "right": _node(java.rightChild(), columns, seen, classes)}
    if place < numbers:
        return Node(value, columns.numeric[place], at=float(split.threshold()), **children)
    name = columns.text[place - numbers]
    labels = seen[name]
    if split.getClass().getSimpleName() == "ContinuousSplit":  # more values than bins: codes are numbers to the learner
        codes = [i for i in range(len(labels) + 1) if i <= split.threshold()]
    else:
        codes = [int(c) for c in split.leftCategories()]
    return Node(value, name, texts=tuple(labels[c] for c in codes if c < len(labels)), others_left=len(labels) in codes, **children)


def scorer_of(model: PipelineModel, columns: Columns) -> Scorer:
    """The parameters of a pipeline fitted by ``training``: logistic regression, a tree, a forest or boosted trees."""
    seen, fitted = _seen(model, columns), model.stages[-1]
    names = [*columns.numeric, *columns.text]
    if hasattr(fitted, "coefficients"):
        scaler = model.stages[-2]
        return LinearScorer(
            float(fitted.intercept),
            dict(zip(names, map(float, fitted.coefficients), strict=True)),
            dict(zip(names, map(float, scaler.mean), strict=True)),
            dict(zip(names, map(float, scaler.std), strict=True)),
            seen,
        )
    if not hasattr(fitted, "trees"):
        return TreeScorer((_node(fitted._java_obj.rootNode(), columns, seen, True),), (1.0,), seen)
    trees = [t._java_obj.rootNode() for t in fitted.trees]
    boosted = type(fitted).__name__.startswith("GBT")
    weights = tuple(float(w) for w in fitted.treeWeights) if boosted else (1.0 / len(trees),) * len(trees)
    return TreeScorer(tuple(_node(t, columns, seen, not boosted) for t in trees), weights, seen, boosted)


def write_scorer(spark: SparkSession, scorer: Scorer, path: str) -> None:
    """One line of text with all parameters."""
    line = json.dumps({"kind": type(scorer).__name__, "parameters": asdict(scorer)})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(path)


def read_scorer(spark: SparkSession, path: str) -> Scorer:
    stored = json.loads(spark.read.text(path).first()[0])
    given = stored["parameters"]
    texts = {name: tuple(values) for name, values in given["texts"].items()}
    if stored["kind"] == "LinearScorer":
        return LinearScorer(**{**given, "texts": texts})

    def node(found: dict | None) -> Node | None:
        if found is None:
            return None
        return Node(**{**found, "texts": tuple(found["texts"]), "left": node(found["left"]), "right": node(found["right"])})

    return TreeScorer(tuple(map(node, given["roots"])), tuple(given["weights"]), texts, given["margin"])


def explain(df: DataFrame, scorer: Scorer, keep: list[str], top: int = 5) -> DataFrame:
    """One row for each of a row's ``top`` contributions, with its place from 1."""
    found = df.select(*keep, F.posexplode(largest(scorer.contributions(), top)).alias("at", "c"))
    return found.select(*keep, (F.col("at") + 1).alias("place"), "c.feature", "c.contribution")
