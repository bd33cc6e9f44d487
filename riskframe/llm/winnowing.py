"""Benchmark decontamination by winnowing, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.texts import LOWER, UPPER

#: Fixed value: what separates words (every ASCII character but digits and a-z, after lower-casing A-Z).
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Words of a window.
SPAN = 13

#: Fingerprints and windows of the benchmark are broadcast up to this many values in all; beyond it they are shuffled.
BROADCAST_VALUES = 2_000_000


def words(text: Column) -> Column:
    """The words of a text; none for NULL."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, WORD_BREAK), "")


def grams(span: int) -> tuple[int, int]:
    """Words of a k-gram and k-grams of a sliding window, so that one window covers exactly ``span`` words."""
    k = (span + 1) // 2
    return k, span - k + 1


def _slide(rows: DataFrame, column: str, size: int, join) -> DataFrame:
    """Joins each value of the array with the ``size`` - 1 values after it, by doubling. Each step is a projection of its own."""
    # The arrays are exploded by the outer forms only: for the others, Spark adds a filter on the array's size
    # below all projections, in which the doubled expressions are written out.
    done = 1
    while done < size:
        step = min(done, size - done)
        shifted = F.slice(column, F.lit(step + 1), F.greatest(F.size(column), F.lit(1)))
        rows = rows.withColumn(column, F.zip_with(column, shifted, join))
        done += step
    return rows


def with_minima(rows: DataFrame, span: int) -> DataFrame:
    """Adds ``minima``: at each word position, the least k-gram hash of the ``span`` words from there.

    The last ``span`` - 1 positions have no whole window; what stands there is not to be used.
    """
    k, w = grams(span)
    rows = rows.withColumn("minima", F.transform("words", lambda x: F.xxhash64(x)))
    rows = _slide(rows, "minima", k, lambda a, b: F.shiftleft(a, 9).bitwiseOR(F.shiftrightunsigned(a, 55)).bitwiseXOR(b))
    return _slide(rows, "minima", w, lambda a, b: F.least(a, b))


def benchmark_windows(benchmark: DataFrame, span: int) -> DataFrame:
    """Each distinct window of ``span`` words: its text ``window``, its ``print`` and the ids of its ``items``.

    Shorter items are single windows of their own length, found with that length as ``span``.
    """
    rows = benchmark.select("item_id", words(F.col("text")).alias("words"))
    size = F.size("words")
    rows = rows.filter(size >= span) if span == SPAN else rows.filter(size == span)
    rows = with_minima(rows, span)
    rows = rows.select("item_id", "words", F.posexplode_outer("minima").alias("at", "print"))
    rows = rows.filter(F.col("at") <= F.size("words") - span)
    window = F.array_join(F.slice("words", F.col("at") + 1, span), " ")
    return rows.groupBy(window.alias("window")).agg(F.first("print").alias("print"), F.collect_set("item_id").alias("items"))


def _sent(table: DataFrame, values: int) -> DataFrame:
    return F.broadcast(table) if values <= BROADCAST_VALUES else table


def _hits(documents: DataFrame, windows: DataFrame, span: int) -> DataFrame:
    """For every document a row without ``hit``, and a row for each place where a benchmark window stands.

    A document keeps one fingerprint for each run of equal window minima (a run
    is cut after w windows, so that a repetitive text has bounded runs). Runs
    whose fingerprint the benchmark has are extended to the windows they stand
    for, and those are compared as text. Rows without a place have a hash of
    the document as join key, so that a shuffled join spreads them.
    """
    _, w = grams(span)
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("ids")).first()
    values = size.n + size.ids
    rows = with_minima(documents, span)
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.col("minima"))
    pairs = F.arrays_zip(F.col("minima").alias("own"), before.alias("before"))
    none = F.array(F.struct(F.lit(None).cast("bigint").alias("own"), F.lit(None).cast("bigint").alias("before")))
    rows = rows.withColumn("pairs", F.concat(none, pairs)).drop("minima")
    rows = rows.select("doc_id", "text_hash", "words", F.posexplode_outer("pairs").alias("place", "pair"))
    at = F.col("place") - 1
    kept = (at <= F.size("words") - span) & ((F.col("pair.own") != F.col("pair.before")) | (at % w == 0))
    rows = rows.filter((F.col("place") == 0) | kept)
    rows = rows.select(
        "doc_id",
        "text_hash",
        F.size("words").cast("bigint").alias("n_words"),
        at.alias("at"),
        F.coalesce("pair.own", "text_hash").alias("print"),
        # The words of the w windows that the run can stand for.
        F.when(F.col("place") > 0, F.slice("words", F.greatest(at, F.lit(0)) + 1, span + w - 1)).alias("around"),
    )
    prints = _sent(windows.select("print").distinct().withColumn("seen", F.lit(True)), values)
    rows = rows.join(prints, (rows["print"] == prints["print"]) & (rows["at"] >= 0), "left").drop("print")
    rows = rows.filter((F.col("at") < 0) | F.col("seen"))

    steps = F.when(F.col("at") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.size("around") - span))
    rows = rows.withColumn("step", F.explode_outer(steps))
    text = F.array_join(F.slice("around", F.greatest("step", F.lit(0)) + 1, span), " ")
    rows = rows.withColumn("text", F.when(F.col("step") >= 0, text).otherwise(F.col("text_hash").cast("string")))
    found = _sent(windows.select("window", "items"), values)
    rows = rows.join(found, (rows["text"] == found["window"]) & (rows["step"] >= 0), "left")
    rows = rows.filter((F.col("step") < 0) | F.col("window").isNotNull())
    start = F.col("at") + F.col("step")
    hit = F.when(F.col("step") >= 0, F.struct(start.alias("start"), (start + span).alias("end")))
    return rows.select("doc_id", "text_hash", "n_words", hit.alias("hit"), "items")


def _covered(hits: Column) -> Column:
    """Words that lie in at least one of the places."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("words"))
    return F.aggregate(
        F.array_sort(hits),
        zero,
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["end"]).alias("end"),
            (acc["words"] + F.greatest(x["end"] - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("words"),
        ),
        lambda acc: acc["words"],
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """Which words of which documents stand in windows of which benchmark items.

    Two equal windows of 13 words have the same least 7-gram hash among their
    seven, so every shared window has a shared fingerprint: none is missed.

    Returns a row for each distinct (doc_id, text): ``doc_id``, ``text_hash``, ``n_words``,
    ``n_hit``, ``n_items``, ``item_ids`` (strings, sorted) and ``contaminated``
    (``n_hit`` > 0 and ``share`` * ``n_hit`` >= ``n_words``).
    NULL and empty texts have no words. An item without words has no window; one
    without an id still hits words but is not listed. Further columns are not read.
    The ids of one benchmark window are gathered in one array: the benchmark is the stated, small side.
    """
    rows = documents.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words(F.col("text")).alias("words")
    )
    sizes = benchmark.select(F.size(words(F.col("text"))).alias("n")).filter("n > 0")
    # At most SPAN values: the lengths of the short items, and SPAN itself.
    spans = [r.n for r in sizes.select(F.least("n", F.lit(SPAN)).alias("n")).distinct().collect()]
    parts = [_hits(rows, benchmark_windows(benchmark, span), span) for span in sorted({SPAN, *spans})]
    found = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"), F.collect_set("items").alias("items")
    )
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten("items")), lambda x: x.cast("string")))
    found = found.select("doc_id", "text_hash", "n_words", _covered(F.col("hits")).alias("n_hit"), ids.alias("item_ids"))
    return found.select(
        "doc_id",
        "text_hash",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        "item_ids",
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
