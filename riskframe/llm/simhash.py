"""SimHash near-duplicates, linked with BK-trees over shards that share a part of the fingerprint."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.components import components
from riskframe.llm.texts import map_texts, ship
from riskframe.session import materialise

#: Words of a shingle, seed of its hash, and differing bits up to which fingerprints link.
SHINGLE, SEED, RADIUS = 3, 42, 3

#: Fingerprints of one tree; a larger shard is cut into chunks of about this many.
TREE = 1_000

#: Wanted fingerprints of a shard; more tables of longer keys are used until the mean is below it.
SHARD = 1_000


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint as a signed integer; 0 for a text without words."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    size = min(shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):  # a long text is counted in parts
        part = hashes[first : first + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id``, the ``text_hash`` (NULL for NULL) and the ``fingerprint`` (bigint), a row for each row."""
    rows = documents.select("doc_id", "text", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_hash"))
    return map_texts(
        rows, "text", ["doc_id", "text_hash"], "fingerprint bigint", lambda: lambda text: (simhash(text, shingle, seed),)
    )


class BKTree:
    """Values in a tree whose edges carry the Hamming distance between parent and child."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        at, new = 0, len(self.values) - 1
        while True:
            edge = (self.values[at] ^ value).bit_count()
            following = self.children[at].setdefault(edge, new)
            if following == new:
                return
            at = following

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Positions of the values at most ``radius`` bits away: only edges within the radius of the distance are followed."""
        open_nodes = [0] if self.values else []
        while open_nodes:
            at = open_nodes.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            for edge, child in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    open_nodes.append(child)


class Forest:
    """Union-find over positions; each set's root is its first position."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def shard_links(tree: list[int], queries: list[int] | None, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect what is within ``radius``: among ``tree``, or between ``queries`` and ``tree``.

    At most one link fewer than there are values, however many pairs are near.
    """
    own = BKTree()
    values = tree + (queries or [])
    forest = Forest(len(values))
    for i, value in enumerate(tree):
        if queries is None:
            for j in own.within(value & 0xFFFFFFFFFFFFFFFF, radius):
                forest.join(i, j)
        own.add(value & 0xFFFFFFFFFFFFFFFF)
    for i, value in enumerate(queries or [], len(tree)):
        for j in own.within(value & 0xFFFFFFFFFFFFFFFF, radius):
            forest.join(i, j)
    for i, value in enumerate(values):
        root = forest.root(i)
        if root != i:
            yield value, values[root]


def key_masks(n: int, radius: int = RADIUS, shard: int = SHARD) -> list[int]:
    """Bit masks such that values within ``radius`` agree under at least one.

    64 bits in b parts: at most ``radius`` parts differ, so some b - radius parts
    agree. b grows with n, so that the mean shard holds at most ``shard`` of n evenly spread values.
    """
    parts = radius + 1
    while parts < radius + 4 and log2(max(n, 1)) - 64 * (parts - radius) / parts > log2(shard):
        parts += 1
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(blocks, parts - radius)]
    assert len(masks) == comb(parts, radius)
    return masks


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("bigint")


def links(values: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links ``a``, ``b`` that connect exactly the distinct ``fingerprint`` values within ``radius``.

    A shard is the values that agree under a mask. One of more than ``tree``
    values is cut into chunks; each pair of chunks is a task's work of at most about
    2 * ``tree`` values: the tree of one chunk is sent to the queries of the other.
    """
    ship(values.sparkSession)
    masks = key_masks(values.count(), radius)
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fingerprint").bitwiseAND(_signed(m)).alias("key")) for i, m in enumerate(masks)])
    rows = values.select("fingerprint", F.explode(keys).alias("shard")).select("fingerprint", "shard.*")
    sizes = rows.groupBy("mask", "key").count().filter(F.col("count") > tree)
    sizes = sizes.select("mask", "key", F.ceil(F.col("count") / tree).cast("int").alias("chunks"))
    rows = rows.join(sizes, ["mask", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fingerprint", "mask"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(
        "mask", "key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "fingerprint"
    )
    unit = ["mask", "key", "low", "high"]
    rows = rows.repartition(*unit).sortWithinPartitions(*unit, "chunk", "fingerprint")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(unit: tuple, chunks: np.ndarray, prints: np.ndarray) -> list[tuple[int, int]]:
        low, high = unit[2], unit[3]
        first = prints[chunks == low].tolist()
        second = None if low == high else prints[chunks == high].tolist()
        return list(shard_links(first, second, radius))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []
        out: list[tuple[int, int]] = []
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            n = batch.num_rows
            if not n:
                continue
            changed = np.zeros(n, bool)
            changed[0] = True
            for c in columns[:4]:
                changed[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(changed).tolist()
            for lo, hi in zip(starts, [*starts[1:], n], strict=False):
                this = tuple(int(c[lo]) for c in columns[:4])
                if this != unit:
                    if held and sum(len(p) for _, p in held) > 1:
                        out += found(unit, np.concatenate([c for c, _ in held]), np.concatenate([p for _, p in held]))
                    unit, held = this, []
                held.append((columns[4][lo:hi].copy(), columns[5][lo:hi].copy()))
            if len(out) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=schema)
                out = []
        if held and sum(len(p) for _, p in held) > 1:
            out += found(unit, np.concatenate([c for c, _ in held]), np.concatenate([p for _, p in held]))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=schema)

    return rows.mapInArrow(work, "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fingerprint`` (bigint), ``component_id``: the least doc_id reachable over links of at most ``radius`` bits, and ``component``.

    ``component`` is the component's own key, its least fingerprint: documents are in one component exactly if it is equal, which
    does not hold of ``component_id`` where doc_ids are repeated or NULL. One row for each row. Equal fingerprints are one node, so copies cost
    nothing beyond their own row. NULL and empty texts have fingerprint 0 and are
    linked like any other. A NULL doc_id is never the least; a component of such rows only has a NULL component_id.
    """
    prints = materialise(fingerprints(documents, shingle, seed), "fingerprints")
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_doc")), "nodes")
    labels = components(materialise(links(nodes.select("fingerprint"), radius), "links"))
    tagged = nodes.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    linked = tagged.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("least_doc").alias("component_least"))
    # Most fingerprints have no link: only linked ones look up their component.
    found = tagged.join(linked, "label", "left").select(
        "fingerprint",
        F.when(F.col("label").isNull(), F.col("least_doc")).otherwise(F.col("component_least")).alias("component_id"),
        F.coalesce("label", "fingerprint").alias("component"),
    )
    return prints.join(found, "fingerprint").select("doc_id", "text_hash", "fingerprint", "component_id", "component")
