"""Quality rules from tokeniser fertility, with rejection bands per language."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.spans import Aligned, aligned
from riskframe.llm.texts import map_texts
from riskframe.session import materialise

#: Symbol characters, and the white space that separates words.
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\v\f\r"

#: A measure is rejected beyond this many deviations from the median of its language, on the side that has a meaning. A
#: deviation is the distance from the median to that side's quartile, over that of a normal distribution.
REACH, QUARTILE = 3.0, 0.6745

#: A deviation is this much at least: most languages may have no byte pieces at all, say.
LEAST = 0.0025

#: Documents at the median and deviations of all languages that are added to each language's own.
PRIOR = 30.0

#: Languages whose bands are broadcast at most; more are joined by a shuffle.
MOST_SENT = 10_000

#: Relative error of the quartiles: 1 / ACCURACY.
ACCURACY = 10_000

#: Which sides reject: texts in pieces too small or too large, too many single bytes, too few different tokens.
MEASURES = {"chars_per_token": ("low", "high"), "byte_share": ("high",), "evenness": ("low",)}


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that stand in a window found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    codes = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) ** window < 1 << 63:
        keys = np.zeros(n, np.int64)
        for i in range(window):
            keys = keys * len(known) + codes[i : i + n]
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    else:
        rows = np.stack([codes[i : i + n] for i in range(window)], axis=1)
        _, which, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    repeated = times[which.ravel()] > 1
    hit = np.zeros(len(words), bool)
    for i in range(window):
        hit[i : i + n] |= repeated
    return int(hit.sum())


def measure(text: str, model: Aligned) -> tuple:
    """Base figures and tokeniser figures of one text; the latter are None for a text without tokens."""
    data = text.encode()
    words = data.split()
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif line.strip(BLANKS.decode()):
            seen.add(line)
    base = (
        len(words),
        len(text) - (len(data) - len(data.translate(None, BLANKS))),
        len(data) - len(data.translate(None, SYMBOLS)),
        duplicates,
        repeated_words(words),
    )
    ids = model.ids(model.normalise(text)[0])
    if not len(ids):
        return *base, 0, None, None, None
    times = np.bincount(ids)
    shares = times[times > 0] / len(ids)
    entropy = float(-(shares * np.log2(shares)).sum())
    most = np.log2(min(len(ids), len(model.surfaces)))
    return (
        *base,
        len(ids),
        len(text) / len(ids),
        float(model.bytes[ids].mean()),
        entropy / float(most) if most > 0 else 0.0,
    )


def _bands(figures: DataFrame, by: list[str]) -> DataFrame:
    """Median, and deviations below and above it, of each measure, from all documents that pass the base rules."""
    wanted = [F.percentile_approx(m, F.array(*map(F.lit, (0.25, 0.5, 0.75))), F.lit(ACCURACY)).alias(m) for m in MEASURES]
    rows = figures.groupBy(*by).agg(F.count("*").alias("n_group"), *wanted)
    fitted = []
    for m in MEASURES:
        low, middle, high = (F.col(m)[i] for i in range(3))
        fitted += [middle.alias(m), ((middle - low) / QUARTILE).alias(f"{m}_low"), ((high - middle) / QUARTILE).alias(f"{m}_high")]
    return rows.select(*by, "n_group", *fitted)


def _within() -> Column:
    """All bands hold. What a language is fitted to counts by its documents, what all are fitted to as ``PRIOR`` documents."""
    weight = F.col("own.n_group") / (F.col("own.n_group") + PRIOR)

    def shrunk(name: str) -> Column:
        return weight * F.col(f"own.{name}") + (1 - weight) * F.col(f"of_all.{name}")

    held = F.lit(True)
    for m, sides in MEASURES.items():
        for side in sides:
            beyond = F.col(m) - shrunk(m) if side == "high" else shrunk(m) - F.col(m)
            held = held & (beyond <= REACH * F.greatest(shrunk(f"{m}_{side}"), F.lit(LEAST)))
    return F.coalesce(held, F.lit(False))


def judge(documents: DataFrame, path: str) -> DataFrame:
    """Base figures, tokeniser figures and ``kept`` of each row, with the model at ``path``.

    Columns: ``doc_id``, ``lang``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``n_tokens``, ``chars_per_token``, ``byte_share`` (pieces that are
    single bytes), ``evenness`` (token entropy over its maximum) and ``kept``: the base rules and all bands hold.
    Bands come from every document of the language (a NULL language is one of its own), and the fewer
    these are, the more from the documents of all languages.
    NULL and empty texts have no words, and fail.
    """

    def start():
        model = aligned(path)
        return lambda text: measure(text, model)

    new = (
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "n_tokens bigint, chars_per_token double, byte_share double, evenness double"
    )
    figures = map_texts(documents, "text", ["doc_id", "lang"], new, start)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    figures = materialise(figures.withColumn("base_failed", failed), "figures")
    passed = figures.filter(~F.col("base_failed")).withColumn("group", F.coalesce("lang", F.lit("")))
    # One row per language, and one row.
    own = materialise(_bands(passed, ["group"]).select("group", F.struct("*").alias("own")), "bands")
    if own.count() <= MOST_SENT:
        own = F.broadcast(own)
    of_all = _bands(passed.withColumn("every", F.lit(1)), ["every"]).select(F.struct("*").alias("of_all"), "every")
    rows = figures.withColumn("group", F.coalesce("lang", F.lit(""))).withColumn("every", F.lit(1))
    rows = rows.join(own, "group", "left").join(F.broadcast(of_all), "every", "left")
    return rows.select(*figures.columns, (~F.col("base_failed") & _within()).alias("kept"))
