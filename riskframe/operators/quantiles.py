"""Exact quantiles and ordered running totals without a one-task sort.

A wanted quantile is bracketed by two values from mergeable sketches, the rows
below and inside the bracket are counted, and a bracket with too many rows is
narrowed the same way. Only the values inside the last brackets are shuffled,
equal ones merged before. Sketches only place the brackets: the counts decide.

Running totals rest on *cells*: an order-preserving cut of a column at
approximate quantiles. A cell holds about ``ROWS_PER_CELL`` rows at most, and
equal values are merged before they reach the task that owns it.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from math import ceil

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskframe.session import materialise, shuffle_width

MIN_CELLS = 16
ROWS_PER_CELL = 1_000_000
#: The sketches' error is a share of 1 / ACCURACY of the rows.
ACCURACY = 10_000
#: Values that one wanted quantile may still have between its brackets when they are shuffled.
ROWS_PER_BRACKET = 1_000_000
#: Parts that a bracket with too many rows is cut into.
CUTS = 40
#: A bracket loses at least nine tenths of its rows each time, or is one value.
MOST_ROUNDS = 12


def cell_edges(df: DataFrame, columns: Sequence[str], rows_per_cell: int = ROWS_PER_CELL) -> list[list[float]]:
    """Cut points per column: one for each ``rows_per_cell`` rows, and at least as many as a shuffle has tasks."""
    cells = max(shuffle_width(df.sparkSession), MIN_CELLS, ceil(df.count() / rows_per_cell))
    fractions = [i / cells for i in range(1, cells)]
    found = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).approxQuantile(
        list(columns), fractions, 0.5 / cells
    )
    inner = [sorted(set(values)) or [0.0] for values in found]
    return [[float("-inf"), *values, float("inf")] for values in inner]


def with_cells(df: DataFrame, columns: Sequence[str], edges: list[list[float]]) -> DataFrame:
    """Add ``__cell_<column>``, upwards; NULL and NaN have the cell -1."""
    inputs = [f"__in_{c}" for c in columns]
    cutter = Bucketizer(
        splitsArray=edges,
        inputCols=inputs,
        outputCols=[f"__cell_{c}" for c in columns],
        handleInvalid="keep",
    )
    cast = df.withColumns({f"__in_{c}": known(c) for c in columns})
    placed = {f"__cell_{c}": F.when(F.col(f"__in_{c}").isNull(), -1.0).otherwise(F.col(f"__cell_{c}")) for c in columns}
    return cutter.transform(cast).withColumns(placed).drop(*inputs)


def known(column: str) -> Column:
    """The column as double; NaN is unknown like NULL."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    rows_per_bracket: int = ROWS_PER_BRACKET,
) -> DataFrame:
    """Discrete quantiles: the smallest value whose cumulative share reaches p.

    Returns ``(*by, column_name, probability, value)`` with ``value`` as double;
    NULLs and NaNs are ignored. One row per group, column and probability; none for a column without values.
    Each round is one aggregate over the plain columns: a row is never multiplied by their number.
    """
    columns, by, wanted = list(columns), list(by), list(dict.fromkeys(probabilities))
    names = {c: f"__v{i}" for i, c in enumerate(columns)}
    rows = df.select(*by, *[known(c).alias(n) for c, n in names.items()])
    # A slot is a column and a probability; expressions are text, as there are many.
    slots = [(f"{i}_{j}", names[c], c, p) for i, c in enumerate(columns) for j, p in enumerate(wanted)]

    near = {p: (max(p - 2 / ACCURACY, 0.0), min(p + 2 / ACCURACY, 1.0)) for p in wanted}
    ends = ", ".join(_double(x) for p in wanted for x in near[p])
    first = []
    for n in names.values():
        first += [f"count({n}) AS n{n}", f"min({n}) AS min{n}", f"max({n}) AS max{n}"]
        first.append(f"percentile_approx({n}, array({ends}), {ACCURACY}) AS at{n}")
    state = _State(rows.groupBy(*by).agg(*map(F.expr, first)), by)
    opened = []
    for i, (s, n, _, p) in enumerate(slots):
        j = 2 * (i % len(wanted))
        # An end at 0 or 1 is the least or greatest value itself.
        opened.append(f"at{n}[{j}] AS low{s}" if near[p][0] > 0 else f"min{n} AS low{s}")
        opened.append(f"at{n}[{j + 1}] AS high{s}" if near[p][1] < 1 else f"max{n} AS high{s}")
        opened.append(f"{_rank(p, f'n{n}')} AS rank{s}")
    ranges = [f"{k}{n}" for n in names.values() for k in ("min", "max")]
    kept = [f"{k}{s}" for s, *_ in slots for k in ("low", "high", "rank")]
    state = state.changed([*opened, *ranges])

    cuts = ", ".join(_double(i / CUTS) for i in range(CUTS + 1))
    narrowing = False
    for left in range(MOST_ROUNDS, 0, -1):
        counts = []
        for s, n, _, _ in slots:
            low, high = state.text(f"low{s}"), state.text(f"high{s}")
            counts += [f"count_if({n} < {low}) AS below{s}", f"count_if({n} BETWEEN {low} AND {high}) AS in{s}"]
            if narrowing:
                counts.append(f"percentile_approx(CASE WHEN {n} BETWEEN {low} AND {high} THEN {n} END, array({cuts}), {ACCURACY}) AS cuts{s}")
        state = state.with_counts(rows, counts)
        missed = {s: f"(rank{s} <= below{s} OR rank{s} > below{s} + in{s})" for s, *_ in slots}
        wide = {s: f"(in{s} > {rows_per_bracket} AND low{s} < high{s})" for s, *_ in slots}
        bad = state.frame.selectExpr(" OR ".join(missed.values()) + " AS missed", " OR ".join(wide.values()) + " AS wide")
        bad = bad.agg(F.max("missed").alias("missed"), F.max("wide").alias("wide")).first()
        if not bad["missed"] and (not bad["wide"] or left == 1):
            break
        changed = []
        for s, n, _, _ in slots:
            low, high = f"low{s}", f"high{s}"
            if bad["missed"]:  # a sketch erred: that bracket starts from the ends
                low, high = f"if({missed[s]}, min{n}, {low})", f"if({missed[s]}, max{n}, {high})"
            elif narrowing:
                at = f"CAST(floor((rank{s} - below{s}) / in{s} * {CUTS}) AS INT)"
                low = f"if({wide[s]}, cuts{s}[greatest({at} - 1, 0)], {low})"
                high = f"if({wide[s]}, cuts{s}[least({at} + 2, {CUTS})], {high})"
            changed += [f"{low} AS low{s}", f"{high} AS high{s}", f"rank{s}"]
        state = state.changed([*changed, *ranges])
        narrowing = True
    entries = [
        f"CASE WHEN {n} BETWEEN {state.text(f'low{s}')} AND {state.text(f'high{s}')} THEN "
        f"struct({i} AS slot, {n} AS value, {state.text(f'rank{s}')} - {state.text(f'below{s}')} AS left) END"
        for i, (s, n, _, _) in enumerate(slots)
    ]
    inside = F.explode(F.expr(f"array_compact(array({', '.join(entries)}))")).alias("e")
    values = state.beside(rows).select(*by, inside).select(*by, "e.*")
    upward = Window.partitionBy(*by, "slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    reached = values.groupBy(*by, "slot", "left", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upward))
    labels = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(float(p)).alias("probability")) for _, _, c, p in slots])
    return (
        reached.filter(F.col("upto") >= F.col("left"))
        .groupBy(*by, "slot")
        .agg(F.min("value").alias("value"))
        .select(*by, F.get(labels, F.col("slot")).alias("of"), "value")
        .select(*by, "of.column_name", "of.probability", "value")
    )


def _double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _rank(p: float, rows: str) -> str:
    """1-based rank of the discrete quantile, with the probability as it is written."""
    exact = Decimal(str(p))
    places = max(-exact.as_tuple().exponent, 0)
    if places > 18:  # as a double, then
        rank = f"ceil({_double(float(p))} * {rows})"
    else:
        rank = f"ceil(CAST({int(exact.scaleb(places))} AS DECIMAL(19,0)) * CAST({rows} AS DECIMAL(19,0)) / CAST({10**places} AS DECIMAL(19,0)))"
    return f"CASE WHEN {rows} > 0 THEN least(greatest(CAST({rank} AS BIGINT), 1L), {rows}) END"


class _State:
    """What is known of each group: one row each. Without groups it is one row of numbers, which are put into expressions as such."""

    def __init__(self, frame: DataFrame, by: Sequence[str]) -> None:
        self.by, self.only = list(by), None
        if by:
            self.frame = materialise(frame, "brackets")
        else:
            [self.only] = frame.collect()
            self.frame = frame.sparkSession.createDataFrame([self.only], frame.schema)

    def text(self, name: str) -> str:
        """The column in an expression over rows that are ``beside`` it."""
        if self.by:
            return name
        value = self.only[name]
        kind = self.frame.schema[name].dataType.simpleString()
        return f"CAST({'NULL' if value is None else repr(str(value))} AS {kind})"

    def changed(self, expressions: list[str]) -> _State:
        return _State(self.frame.select(*self.by, *map(F.expr, expressions)), self.by)

    def beside(self, rows: DataFrame) -> DataFrame:
        if not self.by:
            return rows
        named = self.frame.withColumnsRenamed({b: f"__{b}" for b in self.by})
        return rows.join(named, [rows[b].eqNullSafe(named[f"__{b}"]) for b in self.by]).drop(*[f"__{b}" for b in self.by])

    def with_counts(self, rows: DataFrame, expressions: list[str]) -> _State:
        counts = self.beside(rows).groupBy(*self.by).agg(*map(F.expr, expressions))
        if self.by:
            return _State(_State(counts, self.by).beside(self.frame), self.by)
        counted = counts.collect()[0]
        both = {**self.only.asDict(), **counted.asDict()}
        fields = [*self.frame.schema.fields, *counts.schema.fields]
        frame = rows.sparkSession.createDataFrame([tuple(both[f.name] for f in fields)], StructType(fields))
        return _State(frame, self.by)


def quantile_values(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, dict[float, float]]:
    """The quantiles as plain numbers: at most columns x probabilities of them."""
    found: dict[str, dict[float, float]] = {c: {} for c in columns}
    for row in exact_quantiles(df, columns, probabilities).collect():
        found[row["column_name"]][row["probability"]] = row["value"]
    return found


def running_totals(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Per distinct ``value``, totals of ``sums`` over all values up to and including it.

    NULL and NaN are one value, NULL, below all others. ``df`` is aggregated to one row per (by, value) first. Adds ``upto_<sum>``
    and ``total_<sum>``.
    """
    by, sums = list(by), list(sums)
    cell = f"__cell_{value}"
    cut = with_cells(df, [value], cell_edges(df, [value], rows_per_cell)).withColumn(value, F.when(~F.isnan(F.col(value).cast("double")), F.col(value)))
    points = cut.groupBy(*by, cell, value).agg(*[F.sum(s).alias(s) for s in sums])
    step = F.col(cell).desc() if descending else F.col(cell).asc()
    cells = Window.partitionBy(*by).orderBy(step)
    whole = Window.partitionBy(*by)
    offsets = (
        points.groupBy(*by, cell)
        .agg(*[F.sum(s).alias(f"__in_{s}") for s in sums])
        .select(
            *by,
            cell,
            *[
                (F.sum(f"__in_{s}").over(cells.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"__in_{s}")).alias(
                    f"__before_{s}"
                )
                for s in sums
            ],
            *[F.sum(f"__in_{s}").over(whole).alias(f"total_{s}") for s in sums],
        )
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy(*by, cell).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = points.select("*", *[F.sum(s).over(inside).alias(f"__run_{s}") for s in sums])
    return running.join(offsets, [*by, cell]).select(
        *by,
        value,
        *sums,
        *[(F.col(f"__before_{s}") + F.col(f"__run_{s}")).alias(f"upto_{s}") for s in sums],
        *[f"total_{s}" for s in sums],
    )
