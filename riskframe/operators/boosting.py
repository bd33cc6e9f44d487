"""Gradient-boosted trees on Spark: the runs of a grid grow side by side, in one job per tree level.

Spark ML fits a run as a chain of jobs, one per level of each tree, and a grid has a chain per run. Here one job sums the
rows of a level by node and bin for all runs at once, from cached bin numbers, and of two children only the lighter one is
summed. The trees are those of Spark ML's ``GBTClassifier`` (log loss, variance, one instance per leaf) with the same thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from hashlib import sha256
from math import ceil, prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import ship

# Spark ML finds thresholds on about so many rows, or maxBins squared if that is more.
LEAST_SPLIT_ROWS = 10_000
#: Rows of a task: a table is dealt to as many tasks as there are cores, but not to smaller ones, and to more only for larger ones.
LEAST_TASK_ROWS, MOST_TASK_ROWS = 10_000, 500_000
#: Sums of more tasks than this are added up before the driver gets them.
TASKS_TO_DRIVER = 32
#: Features of few bins are summed together while their bins have no more combinations than this.
MOST_COMBINATIONS = 256
#: After so many rounds the rows' margins come from the trees anew, so that their lineage stays short.
ROUNDS_OF_LINEAGE = 32
#: Gains as near as this to the best, relatively, are the same: sums differ by rounding. The first split of them is taken.
SAME_GAIN = 1e-9


@dataclass(frozen=True)
class Run:
    """One boosting run of a grid."""

    rounds: int
    depth: int
    step: float


@dataclass(frozen=True)
class Bins:
    """How a vector becomes bin numbers: a category is its own bin, a number lies after the thresholds below it."""

    thresholds: Mapping[int, np.ndarray]
    arities: Mapping[int, int]

    def __len__(self) -> int:
        return len(self.thresholds) + len(self.arities)

    @property
    def counts(self) -> list[int]:
        return [self.arities[f] if f in self.arities else len(self.thresholds[f]) + 1 for f in range(len(self))]

    def codes(self, values: np.ndarray) -> np.ndarray:
        """One row of bin numbers per feature."""
        found = np.empty(values.shape[::-1], np.int16)
        for f in range(len(self)):
            v = values[:, f]
            found[f] = v if f in self.arities else np.searchsorted(self.thresholds[f], v, side="left")
        return found


def walk(feature: np.ndarray, left: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The node of a tree that each row ends in."""
    n, (inner, width) = codes.shape[1], left.shape
    rows, node, flat = np.arange(n), np.zeros(n, np.int64), codes.reshape(-1)
    own = np.arange(2 * inner + 1)
    leaf = np.append(feature < 0, np.ones(inner + 1, bool))
    start = np.where(leaf, 0, np.append(feature, np.zeros(inner + 1, np.int64))).astype(np.int64) * n
    goes = np.repeat(own, width).reshape(-1, width)  # a leaf keeps its rows
    goes[:inner][feature >= 0] = (2 * own[:inner].reshape(-1, 1) + 2 - left)[feature >= 0]
    goes = goes.reshape(-1)
    for level in range(inner.bit_length()):
        if leaf[2**level - 1 : 2 ** (level + 1) - 1].all():
            break
        node = goes.take(node * width + flat.take(start.take(node) + rows))
    return node


@dataclass(frozen=True)
class Trees:
    """Trees of one depth, in arrays. Node n has the children 2n+1 and 2n+2; a leaf has the feature -1 and a value."""

    feature: np.ndarray  # trees x inner nodes
    left: np.ndarray  # trees x inner nodes x bins: whether the bin goes left
    value: np.ndarray  # trees x nodes

    def first(self, rounds: int) -> Trees:
        return Trees(self.feature[:rounds], self.left[:rounds], self.value[:rounds])

    def margins(self, codes: np.ndarray, step: float) -> np.ndarray:
        """The sum of the trees' values, the first tree in full and the others by ``step``."""
        total = np.zeros(codes.shape[1])
        for i, (feature, left, value) in enumerate(zip(self.feature, self.left, self.value, strict=True)):
            total += value[walk(feature, left, codes)] * (step if i else 1.0)
        return total


@dataclass(frozen=True)
class BoostedModel:
    """The fitted stages and trees of a run; scores as a Spark ML model does."""

    stages: tuple[Transformer, ...]
    bins: Bins
    trees: Trees
    step: float

    def first_rounds(self, rounds: int) -> BoostedModel:
        """The model as it was after so many rounds."""
        return BoostedModel(self.stages, self.bins, self.trees.first(rounds), self.step)

    def transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage.transform(df)
        given = df.sparkSession.sparkContext.broadcast((self.bins, self.trees, self.step))

        @F.pandas_udf("double")
        def margin(features: pd.Series) -> pd.Series:
            bins, trees, step = given.value
            if not len(features):
                return pd.Series([], dtype="float64")
            return pd.Series(trees.margins(bins.codes(np.stack(features.to_numpy())), step))

        one = 1 / (1 + F.exp(-2 * F.col("margin")))
        return (
            df.withColumn("margin", margin(vector_to_array(self.stages[-1].getOutputCol())))
            .withColumn("probability", array_to_vector(F.array(1 - one, one)))
            .withColumn("prediction", (F.col("margin") > 0).cast("double"))
        )


def category_arities(rows: DataFrame, vector: str) -> dict[int, int]:
    """Number of categories by feature, as the vector's metadata has them."""
    attrs = rows.schema[vector].metadata.get("ml_attr", {}).get("attrs", {})
    found = {a["idx"]: len(a["vals"]) if "vals" in a else a["num_vals"] for a in attrs.get("nominal", [])}
    return found | {a["idx"]: 2 for a in attrs.get("binary", [])}


def thresholds_of(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Between all values if ``most`` thresholds are enough for that, else at steps of even weight, as Spark ML sets them."""
    distinct, place = np.unique(values, return_inverse=True)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) <= most:
        return between
    weight = np.bincount(place, weights)
    step = weight.sum() / (most + 1)
    found, target, before = [], step, weight[0]
    for i, now in enumerate(weight[1:]):
        after = before + now
        if abs(before - target) < abs(after - target):
            found.append(between[i])
            target += step
        before = after
    return np.array(found)


def find_bins(rows: DataFrame, vector: str, weight: str | None, most: int, seed: int, n: int) -> Bins:
    """Thresholds per feature, from all rows or, as in Spark ML, from about ``most`` squared of them if there are more."""
    most, wanted = min(most, n), max(most * most, LEAST_SPLIT_ROWS)
    arities = category_arities(rows, vector)
    if big := {f: k for f, k in arities.items() if k > most}:
        raise ValueError(f"more categories than {most} bins: {big}")
    some = rows if n <= wanted else rows.sample(False, wanted / n, seed)

    def per_feature(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = thresholds_of(part["value"].to_numpy(), part["weight"].to_numpy(), most - 1)
        return pd.DataFrame({"feature": [key[0]], "found": [found]})

    given = (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight")
    long = some.select(given, F.posexplode(vector_to_array(vector)).alias("feature", "value"))
    numbers = long.filter(~F.col("feature").isin(list(arities))) if arities else long
    found = numbers.groupBy("feature").applyInPandas(per_feature, "feature int, found array<double>").collect()
    return Bins({r.feature: np.array(r.found) for r in found}, arities)


@dataclass(frozen=True)
class _Block:
    """The rows of one task: bins by feature, label (-1 or 1), weight, and the margin of each run so far."""

    codes: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    margins: tuple[np.ndarray, ...]
    grouped: tuple[np.ndarray, ...] = ()

    def advanced(self, trees: Mapping[int, Trees], step: Mapping[int, float], anew: bool) -> _Block:
        """With the margins after one more tree of some runs, or from all their trees."""
        margins = list(self.margins)
        for i, more in trees.items():
            margins[i] = more.margins(self.codes, step[i]) if anew else margins[i] + more.margins(self.codes, 1.0) * step[i]
        return replace(self, margins=tuple(margins))

    def signal(self, run: int, first: bool) -> np.ndarray:
        """What the next tree learns: the label, and then the negative gradient of the log loss."""
        y = self.label
        return self.weight * (y if first else 4 * y / (1 + np.exp(2 * y * self.margins[run])))

    def sums(self, asked: Sequence[_Ask], groups: Sequence[_Group]) -> np.ndarray:
        """Weight and weighted signal by node and bin, run after run, feature after feature; at a root after the first, the signal alone."""
        out = []
        for ask in asked:
            weight, signal, slots = self.weight, self.signal(ask.run, ask.first), len(ask.nodes)
            whole = ask.nodes == (0,)
            if not whole:
                place = np.full(2 * len(ask.feature) + 1, -1)
                place[list(ask.nodes)] = np.arange(slots)
                slot = place.take(walk(ask.feature, ask.left, self.codes))
                rows = np.flatnonzero(slot >= 0)
                slot, weight, signal = slot.take(rows), weight.take(rows), signal.take(rows)
            starts = {} if whole else {size: slot * size for size in {g.size for g in groups}}
            for group, codes in zip(groups, self.grouped, strict=True):
                at = codes if whole else codes.take(rows) + starts[group.size]
                for values in (signal,) if whole and not ask.first else (weight, signal):
                    out += group.apart(np.bincount(at, values, slots * group.size), slots)
        return np.concatenate(out)


@dataclass(frozen=True)
class _Group:
    """Features that are summed together, by the combinations of their bins, and then taken apart."""

    features: Sequence[int]
    sizes: Sequence[int]

    @property
    def size(self) -> int:
        return prod(self.sizes)

    def codes(self, codes: np.ndarray) -> np.ndarray:
        at = np.zeros(codes.shape[1], np.int64)
        for f, size in zip(self.features, self.sizes, strict=True):
            at = at * size + codes[f]
        return at.astype(np.uint8 if self.size <= MOST_COMBINATIONS else np.int16)

    def apart(self, sums: np.ndarray, slots: int) -> list[np.ndarray]:
        if len(self.sizes) == 1:
            return [sums]
        sums, axes = sums.reshape(slots, *self.sizes), range(1, len(self.sizes) + 1)
        return [sums.sum(axis=tuple(a for a in axes if a != own)).reshape(-1) for own in axes]


@dataclass(frozen=True)
class _Ask:
    """Nodes of a run's growing tree whose sums are wanted."""

    run: int
    first: bool
    feature: np.ndarray
    left: np.ndarray
    nodes: tuple[int, ...]


@dataclass(frozen=True)
class _Features:
    """The features that can split, with their numbers of bins."""

    groups: Sequence[_Group]
    nominal: frozenset[int]
    width: int
    some: float  # a bin of less weight has no row: its sums are rounding

    @property
    def used(self) -> list[int]:
        return sorted(f for group in self.groups for f in group.features)

    @property
    def bins(self) -> int:
        return sum(size for group in self.groups for size in group.sizes)

    def spread(self, flat: np.ndarray, slots: int, kinds: int) -> np.ndarray:
        """The sums as an array of kinds x slots x features x bins."""
        place = {f: i for i, f in enumerate(self.used)}
        out, at = np.zeros((kinds, slots, len(place), self.width)), 0
        for group in self.groups:
            for kind in range(kinds):
                for f, size in zip(group.features, group.sizes, strict=True):
                    out[kind, :, place[f], :size] = flat[at : at + slots * size].reshape(slots, size)
                    at += slots * size
        return out


class _Growing:
    """A run's trees, the last one being grown level by level."""

    def __init__(self, index: int, run: Run, features: _Features):
        self.index, self.run, self.features = index, run, features
        self.feature, self.left, self.value = [], [], []
        self.root: np.ndarray | None = None  # weights of the root by feature and bin

    def plant(self) -> None:
        inner = 2**self.run.depth - 1
        self.feature.append(np.full(inner, -1, np.int16))
        self.left.append(np.zeros((inner, self.features.width), bool))
        self.value.append(np.zeros(2 * inner + 1))
        self.level, self.nodes, self.built, self.known = 0, [0], [0], None

    @property
    def open(self) -> bool:
        return self.level < self.run.depth and bool(self.nodes)

    def ask(self) -> _Ask:
        """The sums that are needed of the rows: of the root, and then of the lighter one of two children."""
        return _Ask(self.index, len(self.value) == 1, self.feature[-1], self.left[-1], tuple(self.built))

    def size(self) -> int:
        return self.kinds * len(self.built) * self.features.bins

    @property
    def kinds(self) -> int:
        """1 at a root after the first, whose weights are known, else 2."""
        return 2 if self.level or self.root is None else 1

    def trees(self, start: int = 0) -> Trees:
        return Trees(*(np.array(x[start:]) for x in (self.feature, self.left, self.value)))

    def grow(self, flat: np.ndarray) -> None:
        """Split the nodes of a level by the sums over all rows."""
        known, some, width = self.features, self.features.some, self.features.width
        used = known.used
        nominal = [i for i, f in enumerate(used) if f in known.nominal]
        feature, left, value = self.feature[-1], self.left[-1], self.value[-1]
        sums = known.spread(flat, len(self.built), self.kinds)
        if not self.level:
            self.root = sums[:1] if self.root is None else self.root
            sums = np.concatenate([self.root, sums[-1:]])
        else:
            heavy = self.known - sums
            heavy[:, heavy[0] < some] = 0.0
            second = (np.array(self.built) % 2 == 0).reshape(-1, 1, 1)  # the lighter one is the right child
            pairs = np.stack([np.where(second, heavy, sums), np.where(second, sums, heavy)], axis=2)
            sums = pairs.reshape(2, len(self.nodes), *sums.shape[2:])
        weight, signal = sums
        if not self.level:
            value[0] = signal[0, 0].sum() / weight[0, 0].sum()
        if nominal:  # categories in the order of their means, those without rows last
            w, s = weight[:, nominal], signal[:, nominal]
            order = np.argsort(np.divide(s, w, out=np.full(s.shape, np.inf), where=w > 0), axis=2, kind="stable")
            weight, signal = weight.copy(), signal.copy()
            weight[:, nominal], signal[:, nominal] = (np.take_along_axis(x, order, 2) for x in (w, s))
        w, s = weight.cumsum(2), signal.cumsum(2)
        all_w, all_s = w[:, :, -1:], s[:, :, -1:]
        other = all_w - w
        valid = (w > some) & (other > some)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(valid, s * s / w + (all_s - s) ** 2 / other - all_s * all_s / all_w, -np.inf)
        gain = gain.reshape(len(self.nodes), -1)
        split, lighter = [], []
        for i, node in enumerate(self.nodes):
            best = gain[i].max()
            if not best > 1e-12 * all_w[i, 0, 0]:
                continue
            f, b = divmod(int(np.argmax(gain[i] >= best * (1 - SAME_GAIN))), width)
            feature[node] = used[f]
            if f in nominal:
                left[node, order[i, nominal.index(f), : b + 1]] = True
            else:
                left[node, : b + 1] = True
            value[2 * node + 1] = s[i, f, b] / w[i, f, b]
            value[2 * node + 2] = (all_s[i, f, 0] - s[i, f, b]) / other[i, f, b]
            split.append(i)
            lighter.append(2 * node + (1 if w[i, f, b] <= other[i, f, b] else 2))
        self.known, self.built, self.level = sums[:, split], lighter, self.level + 1
        self.nodes = [child for i in split for child in (2 * self.nodes[i] + 1, 2 * self.nodes[i] + 2)]


def to_blocks(rows: DataFrame, vector: str, label: str, weight: str | None, bins: Bins, tasks: int, runs: int) -> RDD:
    """One block per task."""
    kind = np.uint8 if max(bins.counts) <= 256 else np.int16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, label, weight = [np.zeros((len(bins), 0), kind)], [np.zeros(0)], [np.zeros(0)]
        for batch in batches:
            codes.append(bins.codes(batch.column(2).flatten().to_numpy().reshape(-1, len(bins))).astype(kind))
            label.append(batch.column(0).to_numpy(zero_copy_only=False))
            weight.append(batch.column(1).to_numpy(zero_copy_only=False))
        parts = (np.concatenate(codes, axis=1), np.concatenate(label), np.concatenate(weight))
        yield pa.RecordBatch.from_pydict({n: pa.array([p.tobytes()], pa.binary()) for n, p in zip(("codes", "label", "weight"), parts, strict=True)})

    def unpack(row) -> _Block:
        label = np.frombuffer(bytes(row.label))
        codes = np.frombuffer(bytes(row.codes), kind).reshape(len(bins), len(label))
        return _Block(codes, label, np.frombuffer(bytes(row.weight)), (np.zeros(len(label)),) * runs)

    given = rows.select(
        (2.0 * F.col(label) - 1.0).alias("label"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"),
        vector_to_array(vector).alias("features"),
    )
    return given.repartition(tasks).mapInArrow(pack, "codes binary, label binary, weight binary").rdd.map(unpack)


def splitting_features(blocks: RDD, bins: Bins) -> _Features:
    """Without features of one bin, and without those whose bins are an earlier feature's throughout: the first is taken anyway."""
    told = blocks.map(lambda b: ([sha256(c.tobytes()).digest() for c in b.codes], float(b.weight.min(initial=np.inf)))).collect()
    alike = list(zip(*(digests for digests, _ in told), strict=True))
    sizes = bins.counts
    used = [f for f, known in enumerate(alike) if sizes[f] > 1 and alike.index(known) == f] or [0]
    groups: list[_Group] = []
    for f in sorted(used, key=lambda f: sizes[f]):
        fits = [i for i, g in enumerate(groups) if g.size * sizes[f] <= MOST_COMBINATIONS]
        if fits:
            groups[fits[0]] = _Group([*groups[fits[0]].features, f], [*groups[fits[0]].sizes, sizes[f]])
        else:
            groups.append(_Group([f], [sizes[f]]))
    return _Features(groups, frozenset(bins.arities), max(sizes), min(least for _, least in told) / 2)


def total(parts: RDD) -> np.ndarray:
    """The sum of one array per task."""
    if parts.getNumPartitions() > TASKS_TO_DRIVER:
        return parts.treeReduce(np.add)
    first, *others = parts.collect()
    for other in others:
        first = first + other
    return first


def grow_runs(base: RDD, runs: Sequence[Run], features: _Features) -> list[Trees]:
    """The trees of every run: at each level of a round, one job for all runs."""
    groups = features.groups
    base = base.map(lambda b: replace(b, grouped=tuple(g.codes(b.codes) for g in groups))).persist(StorageLevel.MEMORY_AND_DISK)
    grown = [_Growing(i, run, features) for i, run in enumerate(runs)]
    blocks, old = base, []
    for done in range(max(run.rounds for run in runs)):
        live = [g for g in grown if g.run.rounds > done]
        if done:
            anew = done % ROUNDS_OF_LINEAGE == 0
            steps = {g.index: g.run.step if anew or done > 1 else 1.0 for g in live}
            trees = {g.index: g.trees(0 if anew else done - 1) for g in live}
            sent = base.context.broadcast((trees, steps, anew))
            blocks = (base if anew else blocks).map(lambda b, sent=sent: b.advanced(*sent.value))
            blocks.persist(StorageLevel.MEMORY_AND_DISK)
            old.append((blocks, sent))
        for g in live:
            g.plant()
        while asking := [g for g in live if g.open]:
            asked = [g.ask() for g in asking]
            sums = total(blocks.map(lambda b, asked=asked: b.sums(asked, groups)))
            for g, flat in zip(asking, np.split(sums, np.cumsum([g.size() for g in asking])[:-1]), strict=True):
                g.grow(flat)
        for blocks_before, _ in old[:-1]:
            blocks_before.unpersist()
        old = old[-1:]
    for kept in (base, *(blocks_before for blocks_before, _ in old)):
        kept.unpersist()
    return [g.trees() for g in grown]


def fit_runs(
    rows: DataFrame, stages: Sequence[Transformer], vector: str, label: str, weight: str | None, runs: Sequence[Run], most_bins: int, seed: int
) -> list[BoostedModel]:
    """A model per run, from rows with a vector."""
    ship(rows.sparkSession)
    n = rows.count()
    if not n:
        raise ValueError("no rows to learn from")
    bins = find_bins(rows, vector, weight, most_bins, seed, n)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(cores, ceil(n / LEAST_TASK_ROWS)), ceil(n / MOST_TASK_ROWS))
    blocks = to_blocks(rows, vector, label, weight, bins, tasks, len(runs)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        trees = grow_runs(blocks, runs, splitting_features(blocks, bins))
    finally:
        blocks.unpersist()
    return [BoostedModel(tuple(stages), bins, t, run.step) for t, run in zip(trees, runs, strict=True)]
