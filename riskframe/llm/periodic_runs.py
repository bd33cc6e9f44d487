"""Periodic run detection with a dictionary of basic factors.

For each power of two, every stretch of so many words gets a number, equal stretches the same one. Occurrences of
a stretch that follow each other within half its length form an arithmetic progression; two progressions
within twice the length propose periods, and each proposal is extended by longer and longer equal stretches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskframe.llm.texts import ship

#: A run has at least so many words, and at least two periods.
LEAST_LENGTH = 12

#: Texts are worked on together until they have so many words; a longer text is worked on alone.
WORDS_AT_ONCE = 500_000

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def basic_factors(ids: np.ndarray) -> list[np.ndarray]:
    """Level k numbers the stretches of 2**k words from each place; the last level is the first without a repeated stretch."""
    levels = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    n, width = len(ids), 1
    while 2 * width <= n and len(levels[-1]) > levels[-1].max() + 1:
        last = levels[-1]
        pairs = last[: n - 2 * width + 1] * (last.max() + 1) + last[width : n - width + 1]
        levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return levels


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range, its number and each place in it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return owner, starts[owner] + inside


def proposals(names: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of stretches of ``width`` words that come again after ``period`` words, at most twice ``width``.

    Not all pairs are made. Moving both ends of a pair by the step of their progressions keeps its period, so
    a pair can be moved until one end is the first of its progression: those pairs are enough. Within one progression only its step is.
    """
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    gaps = np.diff(order)
    chained = same & (gaps <= width // 2)
    first = np.flatnonzero(np.r_[True, ~chained])  # where in `order` each progression begins
    size = np.diff(np.r_[first, len(order)])
    begin, end, name = order[first], order[first + size - 1], names[order[first]]
    stepped = np.flatnonzero(size > 1)
    places, periods = [begin[stepped]], [order[first[stepped] + 1] - begin[stepped]]
    ahead = 1
    while ahead < len(first):
        a = np.arange(len(first) - ahead)
        b = a + ahead
        a = a[(name[a] == name[b]) & (begin[b] - end[a] <= 2 * width)]
        if not len(a):
            break
        b = a + ahead
        owner, at = _ranges(first[a], size[a])
        places.append(order[at])
        periods.append(begin[b][owner] - order[at])
        owner, at = _ranges(first[b], size[b])
        places.append(begin[a][owner])
        periods.append(order[at] - begin[a][owner])
        ahead += 1
    place, period = np.concatenate(places), np.concatenate(periods)
    near = period <= 2 * width
    return place[near], period[near]


def _reach(levels: list[np.ndarray], place: np.ndarray, period: np.ndarray, back: bool) -> np.ndarray:
    """How far words stay equal to those ``period`` later: the first place where they don't, or with ``back`` the last start from where they do."""
    at = place.copy()
    # Longest stretches first; the longest may fit more than once.
    for k in [*range(len(levels) - 1, -1, -1)]:
        names, width = levels[k], 1 << k
        moving = np.arange(len(at))
        while len(moving):
            left = at[moving] - width if back else at[moving]
            right = left + period[moving]
            fits = (left >= 0) & (right < len(names))
            moving, left, right = moving[fits], left[fits], right[fits]
            moving = moving[names[left] == names[right]]
            at[moving] += -width if back else width
            if k < len(levels) - 1:
                break
    return at


def maximal_runs(ids: np.ndarray, least: int = LEAST_LENGTH) -> np.ndarray:
    """Rows (start, length, period) by start, then period: each run of ``ids`` with its smallest period."""
    found = []
    if len(ids) >= 2:
        levels = basic_factors(ids)
        for k, names in enumerate(levels):
            place, period = proposals(names, 1 << k)
            # Neighbouring places with one period are in one run.
            keys = np.unique(period * len(ids) + place)
            keys = keys[np.r_[True, np.diff(keys) != 1]] if len(keys) else keys
            period, place = keys // len(ids), keys % len(ids)
            start = _reach(levels, place, period, back=True)
            length = _reach(levels, place, period, back=False) + period - start
            long = (length >= least) & (length >= 2 * period)
            found.append(np.stack([start, length, period], axis=1)[long])
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    # A stretch with several periods counts with the smallest.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.r_[True, (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)] if len(runs) else np.empty(0, bool)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def runs_of_texts(texts: Sequence[list[str]], least: int = LEAST_LENGTH) -> list[tuple[np.ndarray, list[str]]]:
    """The runs and the kept words of each list of words. All are one sequence, with a word of its own between two."""
    known: dict[str, int] = {}
    ids: list[int] = []
    for number, words in enumerate(texts):
        ids.extend([known.setdefault(w, len(known)) for w in words])
        ids.append(-1 - number)
    runs = maximal_runs(np.array(ids, np.int64), least)
    ends = np.cumsum([len(words) + 1 for words in texts])
    parts = np.split(runs, np.searchsorted(runs[:, 0], ends[:-1])) if texts else []
    answers = []
    for words, part, end in zip(texts, parts, ends, strict=True):
        own = part - [end - len(words) - 1, 0, 0]
        keep = kept_words(len(words), own)
        answers.append((own, words if keep.all() else [words[i] for i in np.flatnonzero(keep)]))
    return answers


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """Words with a period put in: for a tenth of the ids, from a place on the words up to there are repeated."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * ((n - a) // p + 1))[: n - a]


def find_runs(
    documents: DataFrame,
    columns: Sequence[str] = ("doc_id",),
    text: str = "text",
    prepare: Callable[[object, list[str]], list[str]] | None = None,
    least: int = LEAST_LENGTH,
) -> DataFrame:
    """``columns``, ``runs`` and ``collapsed`` (the kept words, joined by a space) of each row.

    A run is a longest stretch of words with smallest period ``period``, of at least ``least`` words and two periods;
    runs come by start, then period. A word stays unless a run has it after its first period. ``prepare`` gets
    the first column's value and the words, and gives the words to look at. NULL and empty texts have no words, no
    runs and an empty ``collapsed``. One row in, one row out, repeated rows too; an empty table gives none. Other columns are not read.
    """
    ship(documents.sparkSession)
    chosen = documents.select(F.coalesce(F.col(text), F.lit("")).alias("__text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)])
    schema = StructType([*documents.select(*columns).schema.fields, *StructType.fromDDL(f"runs {RUNS}, collapsed string").fields])
    arrow = to_arrow_schema(schema)
    n = len(columns)
    struct = arrow.field(n).type.value_type

    def answer(batch: pa.RecordBatch, first: int, texts: list[list[str]]) -> pa.RecordBatch:
        answers = runs_of_texts(texts, least)
        runs = np.concatenate([r for r, _ in answers])
        offsets = np.cumsum([0, *[len(r) for r, _ in answers]]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(runs[:, j], pa.int64()) for j in range(3)], fields=list(struct))
        lists = pa.ListArray.from_arrays(pa.array(offsets), values).cast(arrow.field(n).type)
        said = pa.array([" ".join(words) for _, words in answers], arrow.field(n + 1).type)
        own = [batch.column(j + 1).slice(first, len(texts)).cast(arrow.field(j).type) for j in range(n)]
        return pa.RecordBatch.from_arrays([*own, lists, said], schema=arrow)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, texts = 0, 0, []
            for i in range(batch.num_rows):
                words = WORD.findall(batch.column(0)[i].as_py())
                if prepare:
                    words = prepare(batch.column(1)[i].as_py(), words)
                if texts and size + len(words) > WORDS_AT_ONCE:
                    yield answer(batch, first, texts)
                    first, size, texts = i, 0, []
                texts.append(words)
                size += len(words)
            if texts:
                yield answer(batch, first, texts)

    return chosen.mapInArrow(work, schema)
