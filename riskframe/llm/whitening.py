"""Embedding whitening: blockwise QR, Householder bidiagonalisation, dqds singular values, twisted factorisations.

The rows are never multiplied with each other. Each task reduces its centred rows to a triangle, triangles are reduced in
groups, and the driver gets one triangle of the vectors' dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from riskframe.llm.texts import ship
from riskframe.session import materialise

#: Components that are given at most.
COMPONENTS = 8

#: An entry c counts as the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000

EPS = np.finfo(float).eps
#: A squared element off the diagonal that is so much smaller than what is beside it is nothing.
NOTHING = (32 * EPS) ** 2
LARGEST = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """``rows`` vectors with ``sums``; unit ``vectors`` (columns) of the largest ``values`` of their covariance, and its trace."""

    rows: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


# --- the small dense part -------------------------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v with (I - 2 v v') x = (beta, 0, ...)."""
    size = np.abs(x).max()
    if size == 0 or not x[1:].any():
        return np.zeros_like(x), x[0]
    v = x / size  # no square of it overflows
    beta = -np.copysign(np.linalg.norm(v), v[0])
    v[0] -= beta
    return v / np.linalg.norm(v), beta * size


def bidiagonalise(square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and V of ``square`` = U B V'."""
    a = square.astype(float)
    d = len(a)
    v_all = np.eye(d)
    upper = np.zeros(max(d - 1, 0))
    for k in range(d):
        v, a[k, k] = _reflector(a[k:, k].copy())
        a[k + 1 :, k] = 0
        a[k:, k + 1 :] -= 2 * np.outer(v, v @ a[k:, k + 1 :])
        if k + 1 < d:
            v, upper[k] = _reflector(a[k, k + 1 :].copy())
            a[k + 1 :, k + 1 :] -= 2 * np.outer(a[k + 1 :, k + 1 :] @ v, v)
            v_all[:, k + 1 :] -= 2 * np.outer(v_all[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), upper, v_all


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One step: the factors of L R - shift, or None if that is not positive."""
    to_q, to_e = [0.0] * len(q), [0.0] * len(e)
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        to_q[i] = d + e[i]
        ratio = q[i + 1] / to_q[i] if to_q[i] > 0 else 0.0
        to_e[i] = e[i] * ratio
        d = d * ratio - shift if to_q[i] > 0 else q[i + 1] - shift
    if d < 0:
        return None
    to_q[-1] = d
    return to_q, to_e


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Of the bidiagonal matrix, largest first, by differential quotient-difference steps with shifts."""
    found: list[float] = []
    blocks = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        if q[0] < q[-1]:  # the small end belongs below, where values are found
            q, e = _flipped(q, e)
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + moved)
                break
            if e[-1] <= NOTHING * (moved + q[-1]) or e[-1] == 0:
                found.append(q[-1] + moved)
                q, e = q[:-1], e[:-1]
                continue
            cut = next((i for i in range(n - 3, -1, -1) if e[i] <= NOTHING * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            # The least eigenvalue of the last two rows is the limit that shifts come near to.
            a, b, c = q[-2] + (e[-2] if n > 2 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
            half = (a - c) / 2
            shift = max(c - b / (half + sqrt(half * half + b)) if half > 0 else 0.0, 0.0)
            shift = min(shift, min(q))
            for share in (1 - 4 * EPS, 0.99, 0.9, 0.5, 0.1, 0.0):
                stepped = _dqds(q, e, shift * share)
                if stepped:
                    (q, e), moved = stepped, moved + shift * share
                    break
    return np.sort(np.array(found))[::-1]


def _flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The bidiagonal matrix with its ends exchanged; the singular values are the same."""
    # Its transpose, read from the end, is lower bidiagonal; one step without shift makes it upper again.
    q, e = q[::-1], e[::-1]
    to_q, to_e = [0.0] * len(q), [0.0] * len(e)
    d = q[0]
    for i in range(len(e)):
        to_q[i] = d + e[i]
        ratio = q[i + 1] / to_q[i] if to_q[i] > 0 else 0.0
        to_e[i] = e[i] * ratio
        d = d * ratio if to_q[i] > 0 else q[i + 1]
    to_q[-1] = d
    return to_q, to_e


def _twisted(big: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers from above and below of L D L' - value, and the twist element at each place."""
    n = len(big)
    tiny = EPS**2 * big.max()
    above, below = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s, p = np.zeros(n), np.zeros(n)
    s[0], p[-1] = -value, big[-1] - value
    for i in range(n - 1):
        pivot = s[i] + big[i]
        above[i] = big[i] * low[i] / (pivot if pivot else tiny)
        s[i + 1] = above[i] * low[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        pivot = big[i] * low[i] ** 2 + p[i + 1]
        if not pivot:
            p[i + 1] += tiny
            pivot = tiny
        t = big[i] / pivot
        below[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    return above, below, s + p + value


def _vector(above: np.ndarray, below: np.ndarray, twist: int) -> np.ndarray:
    z = np.zeros(len(above) + 1)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -above[i] * z[i + 1]
    for i in range(twist, len(above)):
        z[i + 1] = -below[i] * z[i]
    return z


def singular_directions(square: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of ``square`` and their right singular vectors (columns); none for values at rounding level."""
    scale = np.abs(square).max() if square.size else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((len(square), 0))
    diagonal, upper, v = bidiagonalise(square / scale)
    # A zero on the diagonal has no factor L; what takes its place is far below rounding.
    diagonal = np.where(np.abs(diagonal) < EPS**2, EPS**2, diagonal)
    squares = squared_singular_values(diagonal, upper)
    squares = squares[squares > (len(square) * EPS) ** 2 * squares[0]][:most]
    big, low = diagonal**2, upper / diagonal[:-1]
    chosen: list[np.ndarray] = []
    for value in squares:
        best, size = None, 0.0
        at = value
        for _ in range(3):  # a Rayleigh step takes the value to the last digit
            above, below, twist = _twisted(big, low, at)
            z = _vector(above, below, int(np.nanargmin(np.abs(twist))))
            step = twist[int(np.nanargmin(np.abs(twist)))] / (z @ z)
            if not np.isfinite(step) or abs(at + step - value) > 1e-8 * value:
                break
            at += step
        # Close values may have the same best twist; other twists give the rest of their space.
        for k in np.argsort(np.abs(np.nan_to_num(twist, nan=np.inf))):
            z = _vector(above, below, int(k))
            if not np.isfinite(z).all():
                continue
            z = z / np.linalg.norm(z)
            for _ in range(2):
                for other in chosen:
                    z = z - (other @ z) * other
            if (left := np.linalg.norm(z)) > size:
                best, size = z / left, left
            if size > 0.5:
                break
        chosen.append(best)
    return squares * scale**2, v @ np.stack(chosen, axis=1)


# --- the large part -------------------------------------------------------------------------


def whole_numbers(vectors: DataFrame, columns: list[str], vector: str) -> DataFrame:
    """``columns`` and ``x`` (array<bigint>) of the rows that have one: all entries finite, and none beyond 2**53."""
    entries = F.col(vector).cast("array<double>")
    plain = (F.size(entries) > 0) & F.forall(entries, lambda c: F.coalesce(F.abs(c) * SCALE < 2**53, F.lit(False)))  # NaN is above
    numbers = F.transform(entries, lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT)
    return vectors.select(*columns, F.when(plain, numbers).alias("x")).filter("x is not null")


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _states(rows: DataFrame, fold: Callable[[Iterable[pa.RecordBatch]], np.ndarray | None]) -> DataFrame:
    """One array per task that has rows."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = fold(batches)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state.ravel().tolist()], pa.list_(pa.float64()))], ["state"])

    return rows.mapInArrow(work, "state array<double>")


def fold_all(rows: DataFrame, fold: Callable, join: Callable[[np.ndarray | None, np.ndarray], np.ndarray], name: str) -> np.ndarray | None:
    """One array for all ``rows``: one per task, then one per group of so many tasks as there are groups, then one."""

    def joined(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
        state = None
        for batch in batches:
            for other in batch.column(0):
                state = join(state, np.array(other.values.to_numpy()))
        return state

    states = materialise(_states(rows, fold), name)
    groups = ceil(sqrt(max(states.count(), 1)))
    row = _states(_states(states.repartition(groups), joined).coalesce(1), joined).first()
    return None if row is None else np.array(row.state)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly: as Python's whole numbers where 64 bits might not do."""
    largest = n * int(np.abs(x).max(initial=0)) + int(max((abs(int(s)) for s in sums), default=0))
    if largest > LARGEST:
        return n * x.astype(object) - sums.astype(object)
    return n * x - sums.astype(np.int64)


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """From all ``rows`` with ``x`` of one length; None if there are none."""
    row = rows.agg(F.count("*").alias("n"), F.first(F.size("x")).alias("d")).first()
    if not row.n:
        return None
    n, d = row.n, row.d
    # Sums are exact: the entries are whole numbers.
    by_place = rows.select(F.posexplode("x").alias("place", "value")).groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"))
    sums = tuple(int(r.s) for r in sorted(by_place.collect()))  # one row per dimension
    exact = np.array(sums, dtype=object)

    def triangle(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
        state = None
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(first, 4096), d)
                centred = (_deviations(x, n, exact) / n).astype(float)
                state = stacked(state, centred)
        return state

    def stacked(state: np.ndarray | None, more: np.ndarray) -> np.ndarray:
        more = more.reshape(-1, d)
        r = np.linalg.qr(more if state is None else np.vstack([state.reshape(-1, d), more]), mode="r")
        return np.vstack([r, np.zeros((d - len(r), d))])

    r = fold_all(rows.select("x"), triangle, stacked, "triangles").reshape(d, d)
    squares, vectors = singular_directions(r, most)
    return Whitening(n, sums, squares / n, vectors, float((r**2).sum() / n))


def whiten(vectors: DataFrame, columns: list[str], vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """``columns``, ``n``, ``deviation``, ``whitened`` (array), ``explained`` (array) and ``identity_error`` of each remaining row.

    Left out are rows whose vector is NULL, empty, has a NULL, NaN or infinite entry or one beyond 2**53 / ``SCALE``, or has another
    length than most remaining vectors (of equally frequent lengths the greater counts). Repeated rows count as often as they
    are there. Directions in which the vectors don't vary, beyond rounding, have no component: if all vectors are equal, ``whitened`` is empty.
    ``deviation`` is NULL where it is beyond 64 bits. No remaining row gives none. Other columns are not read.
    """
    ship(vectors.sparkSession)
    named = [f"__{i}" for i in range(len(columns))]
    chosen = vectors.select(*[F.col(c).alias(k) for c, k in zip(columns, named, strict=True)], F.col(vector).alias("__vector"))
    rows = whole_numbers(chosen, named, "__vector")
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = usual.d if usual else 1
    rows = rows.filter(F.size("x") == d)
    fitted = fit(rows, most)
    types = ", ".join(f"{k} {t}" for k, t in chosen.select(*named).dtypes)
    schema = f"{types + ', ' if types else ''}n bigint, deviation bigint, whitened array<double>"
    if fitted is None:
        done, error = vectors.sparkSession.createDataFrame([], schema), None
        explained: list[float] = []
    else:
        n, exact = fitted.rows, np.array(fitted.sums, dtype=object)
        k = len(fitted.values)
        directions = fitted.vectors / np.sqrt(fitted.values)
        explained = [float(v / fitted.trace) for v in fitted.values]
        arrow = to_arrow_schema(vectors.sparkSession.createDataFrame([], schema).schema)

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                deviations = _deviations(_matrix(batch.column(len(named)), d), n, exact)
                if deviations.dtype == object or d * float(np.abs(deviations).max()) ** 2 > LARGEST // 2:
                    squares = [sum(int(v) ** 2 for v in row) for row in deviations]
                    squares = [s if s <= LARGEST else None for s in squares]
                else:
                    squares = (deviations**2).sum(axis=1)
                white = (deviations / n).astype(float) @ directions
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k)
                lists = pa.ListArray.from_arrays(offsets, pa.array(white.ravel(), pa.float64()))
                made = [pa.array(np.full(batch.num_rows, n)), pa.array(squares, pa.int64()), lists]
                columns_ = [*batch.columns[: len(named)], *made]
                yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(columns_)], schema=arrow)

        done = materialise(rows.mapInArrow(work, schema), "whitened")
        error = identity_error(done, k)
    return done.select(
        *[F.col(k_).alias(c) for k_, c in zip(named, columns, strict=True)],
        "n",
        "deviation",
        "whitened",
        F.lit(explained).cast("array<double>").alias("explained") if explained else F.array().cast("array<double>").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(done: DataFrame, k: int) -> float | None:
    """The largest absolute entry of the covariance of ``whitened`` (of length ``k``) less the identity; None without components."""
    if not k:
        return None

    def moments(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
        state = None
        for batch in batches:
            if batch.num_rows:
                w = _matrix(batch.column(0), k)
                mean = w.mean(axis=0)
                state = both(state, np.r_[len(w), mean, ((w - mean).T @ (w - mean)).ravel()])
        return state

    def both(one: np.ndarray | None, other: np.ndarray) -> np.ndarray:
        """Rows, means and centred products of two parts together."""
        if one is None:
            return other
        total = one[0] + other[0]
        apart = other[1 : k + 1] - one[1 : k + 1]
        mean = one[1 : k + 1] + apart * (other[0] / total)
        products = one[k + 1 :] + other[k + 1 :] + (np.outer(apart, apart) * (one[0] * other[0] / total)).ravel()
        return np.r_[total, mean, products]

    state = fold_all(done.select("whitened"), moments, both, "moments")
    return float(np.abs(state[k + 1 :].reshape(k, k) / state[0] - np.eye(k)).max())


def components(whitened: DataFrame, columns: list[str]) -> DataFrame:
    """One row per row and component: ``columns``, ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    zipped = F.arrays_zip("whitened", "explained")
    long = whitened.select(*columns, "n", "deviation", "identity_error", F.posexplode(zipped).alias("__place", "__both"))
    return long.select(
        *columns,
        (F.col("__place") + 1).alias("component"),
        "n",
        "deviation",
        F.col("__both.whitened").alias("whitened"),
        F.col("__both.explained").alias("explained"),
        "identity_error",
    )
