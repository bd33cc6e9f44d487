"""Point-in-time entity history: what was known about an entity strictly before a row.

Each history is a running window over one entity key. A key that holds more
rows than one task should sort is cut into chunks of at most so many rows, by
time and then by id; the chunk totals are summed over a small table, and the
running window is taken inside the chunk. Both paths give the same numbers;
cold keys use one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.rowwise import exact_amount, exact_units, fits_scale, minor_units
from riskframe.session import materialise, shuffle_width
from riskframe.spec import TableSpec

ENTITIES = ("card", "email", "device")
#: The rows are wide (all features), and a task holds them twice: sorted, and in the window.
ROWS_PER_TASK = 500_000
#: A key above the limit is first cut into so many slices for each limit it holds; a slice above the limit is cut again.
SLICES_PER_TASK = 16
MOST_SLICES = 1024
#: A shuffle has a block, and an index entry, for each pair of tasks: more than so many tasks are only made for so many rows each, however low the limit.
FEW_TASKS, LEAST_TASK_ROWS = 64, 50_000

#: Squares of whole amounts up to this size fit 64 bits.
MOST_NARROW = 3_037_000_499
HALF = 1 << 32

WHOLE = "decimal(38,0)"

#: What is known of a key.
STATE = ("n", "known", "total", "squares", "latest")


@dataclass(frozen=True)
class Units:
    """How amounts are added exactly: as 64-bit whole numbers of ``scale`` decimals, or else as decimals. And how many tasks their rows need."""

    scale: int
    narrow: bool
    tasks: int = 1

    def of(self, spec: TableSpec) -> Column:
        return minor_units(spec.amount, self.scale) if self.narrow else exact_units(spec.amount)

    def major(self, minor: Column) -> Column:
        return minor.cast("double") / F.lit(float(10**self.scale))


@dataclass(frozen=True)
class Chunks:
    """Hot keys cut up: the slices of each level that are cut again, and what every chunk adds to.

    ``levels`` have ``entity``, ``key``, ``path`` (the slices chosen so far), ``by_id``, ``low`` and ``width``;
    ``before`` has ``entity``, ``key``, ``path`` and the sums of all earlier chunks of the key.
    """

    levels: tuple[DataFrame, ...]
    before: DataFrame
    entities: frozenset[str]


def _place(column: str, df: DataFrame) -> Column:
    """The column as a whole number to cut by; NULL if it is of another kind, and can't be cut."""
    whole = df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.col(column).cast("bigint") if whole else F.lit(None).cast("bigint")


def _cuts(counted: DataFrame, limit: int) -> DataFrame:
    """From counted slices (``rows``, and the ends of time and id in them) those above the limit that can be cut, with how."""

    def span(low: str, high: str) -> Column:
        return (F.col(high).cast("decimal(20,0)") - F.col(low).cast("decimal(20,0)")).cast("double")

    by_id = ~F.coalesce(F.col("first") < F.col("last"), F.lit(False))
    slices = F.least(F.greatest(F.ceil(F.col("rows") * SLICES_PER_TASK / limit), F.lit(2)), F.lit(MOST_SLICES))
    cut = counted.filter(
        (F.col("rows") > limit) & (F.coalesce(F.col("first") < F.col("last"), F.lit(False)) | F.coalesce(F.col("least") < F.col("most"), F.lit(False)))
    )
    return cut.select(
        "entity",
        "key",
        "path",
        by_id.alias("by_id"),
        F.when(by_id, F.col("least")).otherwise(F.col("first")).alias("low"),
        ((F.when(by_id, span("least", "most")).otherwise(span("first", "last")) + 1) / slices).alias("width"),
    )


def _counted(rows: DataFrame, *more: Column) -> DataFrame:
    ends = [F.min("time").alias("first"), F.max("time").alias("last"), F.min("id").alias("least"), F.max("id").alias("most")]
    return rows.groupBy("entity", "key", "path").agg(F.count(F.lit(1)).alias("rows"), *ends, *more)


def _into(rows: DataFrame, level: DataFrame, how: str) -> DataFrame:
    """The slice of this level is added to ``path`` of the rows whose slice is cut again. Slice -1 has the rows without a value, which come first."""
    place = F.when(F.col("by_id"), F.col("id")).otherwise(F.col("time"))
    # The difference is exact, so that it keeps the order and the two ends never share a slice.
    slice_ = F.floor((place.cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)")).cast("double") / F.col("width")).cast("int")
    path = F.when(F.col("width").isNotNull(), F.concat("path", F.array(F.coalesce(slice_, F.lit(-1))))).otherwise(F.col("path"))
    kept = rows.columns
    return rows.join(level, ["entity", "key", "path"], how).withColumn("path", path).select(*kept)


def _tasks(rows: int, limit: int) -> int:
    """How many tasks the rows need: none has more than the limit, unless that would be many tasks of a few rows."""
    return min(ceil(rows / limit), max(FEW_TASKS, ceil(rows / LEAST_TASK_ROWS)))


def cut_hot_keys(df: DataFrame, spec: TableSpec, entities: Sequence[str], rows_per_task: int) -> tuple[Chunks | None, Units]:
    """Chunks of the entity keys above ``rows_per_task`` rows, or None if there are none; and how their amounts add up.

    One pass for all entities counts keys with map-side merging. If some are hot, their rows are written with a few columns, and
    each further pass over those counts the slices of the ones that are too large: by time, and at equal times by
    id. Only rows equal in time and id can share a chunk above the limit. Few passes are needed: each takes a slice's own
    ends, so empty stretches cost nothing. Every table of slices has about rows / ``rows_per_task`` rows times ``SLICES_PER_TASK``.
    """
    places = [_place(spec.time, df).alias("time"), _place(spec.id, df).alias("id")]
    none = F.array().cast("array<int>").alias("path")
    amounts = {
        "largest": F.abs(minor_units(spec.amount, spec.amount_scale)),
        "fine": ~fits_scale(spec.amount, spec.amount_scale),
    }

    def long(of: Sequence[str], **more: Column) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(e).alias("entity"), F.col(f"{e}_entity_key").alias("key")) for e in of])
        return df.select(F.explode(pairs).alias("pair"), *places, *[c.alias(n) for n, c in more.items()]).select("pair.*", "time", "id", none, *more)

    keys = _counted(long(entities, **amounts), *[F.max(c).alias(c) for c in amounts])
    hot_entities = F.collect_set(F.when(F.col("rows") > rows_per_task, F.col("entity")))
    seen = keys.agg(F.max("largest").alias("largest"), F.max("fine").alias("fine"), hot_entities.alias("hot"), F.sum("rows").alias("rows")).first()
    affected = frozenset(seen.hot)
    narrow = not seen.fine and (seen.largest or 0) <= MOST_NARROW
    tasks = _tasks(ceil((seen.rows or 0) / len(entities)), rows_per_task)  # a row counts once for each entity
    units = Units(spec.amount_scale, True, tasks) if narrow else Units(9, False, tasks)
    if not affected:
        return None, units
    cut = [e for e in entities if e in affected]
    hot = materialise(_counted(long(cut)).filter(F.col("rows") > rows_per_task), "hot_keys")
    rows = long(cut, minor=exact_units(spec.amount)).join(hot.select("entity", "key"), ["entity", "key"], "left_semi")
    rows = materialise(rows, "hot_rows")
    levels = []
    level = materialise(_cuts(hot, rows_per_task), "slices")
    while not level.isEmpty():
        levels.append(level)
        rows = _into(rows, level, "left")
        level = materialise(_cuts(_counted(rows), rows_per_task), "slices")
    # Totals in the unit of the histories: amounts of few decimals are whole numbers of them.
    minor = (F.col("minor") / F.lit(10 ** (9 - spec.amount_scale))).cast("bigint") if narrow else F.col("minor")
    totals = rows.groupBy("entity", "key", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("minor").alias("known"),
        F.sum(minor.cast(WHOLE)).alias("total"),
        (F.sum((minor * minor).cast(WHOLE)) if narrow else F.var_pop(minor.cast("double"))).alias("squares"),
        F.max("time").alias("latest"),
    )
    return Chunks(tuple(levels), materialise(_before(totals, narrow), "chunks"), affected), units


def _before(totals: DataFrame, narrow: bool) -> DataFrame:
    """The sums of all earlier chunks of a key. Squares are those of the amounts, or the squared deviations from their mean."""
    whole = Window.partitionBy("entity", "key")
    earlier = whole.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    sums = {s: F.sum(s).over(earlier) for s in ("n", "known", "total", "squares")}
    if not narrow:
        # Deviations of chunk means are taken from the mean of the key, so that large amounts do not cancel.
        known = F.col("known").cast("double")
        of_key = F.sum("total").over(whole).cast("double") / F.sum("known").over(whole)
        apart = F.when(known > 0, F.col("total").cast("double") / known - of_key)
        totals = totals.withColumns({"within": F.coalesce("squares", F.lit(0.0)) * known + known * apart * apart, "apart": known * apart})
        moved = F.sum("apart").over(earlier)
        sums["squares"] = F.sum("within").over(earlier) - F.coalesce(moved * moved / F.nullif(sums["known"], F.lit(0)), F.lit(0.0))
    latest = F.max("latest").over(earlier).alias("at_latest")
    return totals.select("entity", "key", "path", *[c.alias(f"at_{s}") for s, c in sums.items()], latest)


def _statistics(minor: Column, time: Column, units: Units) -> dict[str, Column]:
    """Sums that add up across chunks. Of narrow squares the halves are added, which fit 64 bits; wide ones spread around their mean."""
    sums = {"n": F.count(F.lit(1)), "known": F.count(minor), "total": F.sum(minor), "latest": F.max(time)}
    if units.narrow:
        square = minor * minor
        return {**sums, "high": F.sum(F.shiftright(square, 32)), "low": F.sum(square.bitwiseAND(F.lit(HALF - 1)))}
    return {**sums, "squares": F.var_pop(minor.cast("double"))}


def _entity_history(
    df: DataFrame, spec: TableSpec, entity: str, chunks: Chunks | None, units: Units, state: DataFrame | None = None
) -> DataFrame:
    key = f"{entity}_entity_key"
    squares = ("high", "low") if units.narrow else ("squares",)
    names = ("n", "known", "total", "latest", *squares) if entity == "card" else ("n", "known", "total")
    stats = _statistics(F.col("__minor"), F.col(spec.time), units)
    kept = df.columns
    rows = df.withColumn("__minor", units.of(spec))
    group = [key]
    if chunks is not None:
        rows = rows.withColumn("__path", F.array().cast("array<int>"))
        place = {"time": _place(spec.time, df), "id": _place(spec.id, df)}
        for level in chunks.levels:
            own = level.filter(F.col("entity") == entity).select(*[F.col(c).alias(f"__{c}") for c in ("key", "path", "by_id", "low", "width")])
            own = own.withColumnRenamed("__path", "__of")
            rows = rows.join(own, (rows[key] == own["__key"]) & (rows["__path"] == own["__of"]), "left")
            at = F.when(F.col("__by_id"), place["id"]).otherwise(place["time"])
            slice_ = F.floor((at.cast("decimal(20,0)") - F.col("__low").cast("decimal(20,0)")).cast("double") / F.col("__width")).cast("int")
            further = F.concat("__path", F.array(F.coalesce(slice_, F.lit(-1))))
            rows = rows.withColumn("__path", F.when(F.col("__width").isNotNull(), further).otherwise(F.col("__path")))
            rows = rows.select(*kept, "__minor", "__path")
        group = [key, "__path"]
    if units.tasks > shuffle_width(df.sparkSession):  # a session's own number of tasks does not grow with the table
        rows = rows.repartition(units.tasks, *group)
    inside = Window.partitionBy(*group).orderBy(spec.time, spec.id).rowsBetween(Window.unboundedPreceding, -1)
    frame = rows.withColumns({f"__in_{s}": stats[s].over(inside) for s in names})
    value = {s: F.col(f"__in_{s}") if s == "latest" else F.coalesce(F.col(f"__in_{s}"), F.lit(0)) for s in names}
    if "high" in value:
        value["squares"] = value["high"].cast("decimal(19,0)") * F.lit(HALF).cast("decimal(10,0)") + value["low"].cast("decimal(19,0)")
    elif "squares" in value:
        value["squares"] = value["squares"] * value["known"]
    if chunks is not None:
        before = chunks.before.filter(F.col("entity") == entity).drop("entity").withColumnsRenamed({"key": "__key", "path": "__of"})
        frame = frame.join(before, (frame[key] == before["__key"]) & (frame["__path"] == before["__of"]), "left")
        at = {s: F.coalesce(F.col(f"at_{s}"), F.lit(0)) for s in ("n", "known", "total", "squares")}
        if "squares" in value:
            value["squares"] = value["squares"].cast(WHOLE) + at["squares"].cast(WHOLE) if units.narrow else _spread_of_both(value, at)
        for s in ("n", "known", "total"):
            value[s] = value[s].cast(WHOLE) + at[s].cast(WHOLE)
        if "latest" in value:
            value["latest"] = F.coalesce(value["latest"], F.col("at_latest"))
    if "squares" in value and units.narrow:
        value["squares"] = _squared_deviations(value["known"].cast("bigint"), value["total"], value["squares"])
    if state is not None:
        frame, value = _after_state(frame, key, value, units, state.filter(F.col("entity") == entity))
    return frame.select(*kept, *_features(entity, value, units, F.col(spec.time)))


def _after_state(frame: DataFrame, key: str, value: dict[str, Column], units: Units, state: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The sums with those of the stored state of the row's key before them."""
    stored = state.select(*[F.col(c).alias(f"__{c}") for c in ("key", *STATE)])
    frame = frame.join(stored, frame[key].eqNullSafe(stored["__key"]), "left")
    old = {s: F.coalesce(F.col(f"__{s}"), F.lit(0)) for s in ("n", "known", "squares")}
    old["total"] = F.coalesce(F.col("__total") * F.lit(10**units.scale), F.lit(0)).cast(WHOLE)
    both = {s: value[s].cast(WHOLE) + old[s].cast(WHOLE) for s in ("n", "known", "total")}
    if "squares" in value:
        old["squares"] = old["squares"] * F.lit(float(10 ** (2 * units.scale)))
        both["squares"] = _spread_of_both(value, old)
        both["latest"] = F.coalesce(value["latest"], F.col("__latest"))
    return frame, both


def _features(entity: str, value: dict[str, Column], units: Units, time: Column) -> list[Column]:
    """Feature columns from the sums. The card mean divides by all earlier rows,
    the other means by the earlier rows that have an amount."""
    total = units.major(value["total"])
    divisor = value["n"] if entity == "card" else value["known"]
    columns = {
        f"prior_{entity}_transaction_count": value["n"].cast("bigint"),
        f"prior_{entity}_amount_sum": total,
        f"prior_{entity}_avg_amount": F.when(divisor > 0, total / divisor.cast("double")).otherwise(F.lit(0.0)),
    }
    if entity == "card":
        known = value["known"].cast("double")
        spread = F.sqrt(value["squares"] / F.nullif(known - 1, F.lit(0.0)))
        columns["prior_card_amount_stddev"] = F.when(known > 1, units.major(spread)).otherwise(F.lit(0.0))
        columns["time_since_previous_card_transaction"] = (time - value["latest"]).cast("double")
    return [c.alias(name) for name, c in columns.items()]


def _spread_of_both(one: dict[str, Column], other: dict[str, Column]) -> Column:
    """Squared deviations from the mean of two parts together."""
    a, b = one["known"].cast("double"), other["known"].cast("double")
    apart = one["total"].cast("double") / F.nullif(a, F.lit(0.0)) - other["total"].cast("double") / F.nullif(b, F.lit(0.0))
    return one["squares"] + other["squares"] + F.coalesce(apart * apart * a * b / (a + b), F.lit(0.0))


def _squared_deviations(known: Column, total: Column, squares: Column) -> Column:
    """Squared deviations of narrow amounts from their mean: taken from the whole number next to it, so that large equal amounts do not cancel."""
    whole, rows = total.cast("decimal(19,0)"), known.cast("decimal(19,0)")
    mean = F.coalesce(F.round(whole / F.nullif(known, F.lit(0)), 0), F.lit(0)).cast("decimal(19,0)")
    around = squares.cast(WHOLE) - (mean * whole).cast(WHOLE) * 2 + (mean * mean).cast(WHOLE) * rows
    rest = (whole - mean * rows).cast("double")
    return F.greatest(around.cast("double") - F.coalesce(rest * rest / F.nullif(known, F.lit(0)), F.lit(0.0)), F.lit(0.0))


def add_history(
    df: DataFrame,
    spec: TableSpec,
    entities: Sequence[str] = ENTITIES,
    rows_per_task: int = ROWS_PER_TASK,
    state: DataFrame | None = None,
) -> DataFrame:
    """Add the history of every entity to each row of ``df``.

    With ``state`` (``entity_state`` of all earlier rows) the history goes on from there, and no earlier row is read.

    ``df`` carries ``<entity>_entity_key`` columns. Each entity costs one
    shuffle of ``df``, so pass only the columns that are needed. ``df`` is read
    once to find hot keys; without any, no join is planned. Amounts are added
    exactly: with ``amount_scale`` decimals if none has more, else with nine. NaN and infinite amounts are unknown.
    """
    if state is not None:
        _require_later(df, spec, state)
        state = state.filter(F.col("entity").isin(*entities))
    chunks, units = cut_hot_keys(df, spec, entities, rows_per_task)
    for entity in entities:
        cut = chunks if chunks is not None and entity in chunks.entities else None
        df = _entity_history(df, spec, entity, cut, units, state)
    return df


def entity_state(df: DataFrame, spec: TableSpec, entities: Sequence[str] = ENTITIES) -> DataFrame:
    """One row per ``entity`` and ``key``: rows ``n``, ``known`` amounts, their ``total``, squared deviations ``squares``, and the ``latest`` time.

    One pass with map-side merging, whatever the skew. This is all that later rows need to know of ``df``.
    """
    pairs = F.array(*[F.struct(F.lit(e).alias("entity"), F.col(f"{e}_entity_key").alias("key")) for e in entities])
    amount = exact_amount(spec.amount)
    rows = df.select(F.explode(pairs).alias("pair"), amount.alias("amount"), F.col(spec.time).alias("time")).select("pair.*", "amount", "time")
    return rows.groupBy("entity", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("amount").alias("known"),
        F.sum("amount").cast("decimal(38,9)").alias("total"),
        F.coalesce(F.var_pop(F.col("amount").cast("double")) * F.count("amount"), F.lit(0.0)).alias("squares"),
        F.max("time").alias("latest"),
    )


def merge_state(older: DataFrame, newer: DataFrame) -> DataFrame:
    """The state after both: a full join of one row per key on each side. Neither the rows behind them nor their order matter."""
    a, b = (df.select("entity", "key", *[F.col(s).alias(f"{side}_{s}") for s in STATE]) for df, side in ((older, "a"), (newer, "b")))
    b = b.withColumnsRenamed({"entity": "__entity", "key": "__key"})
    joined = a.join(b, (F.col("entity") == F.col("__entity")) & F.col("key").eqNullSafe(F.col("__key")), "full")
    here = F.col("entity").isNotNull()
    one, other = ({s: F.coalesce(F.col(f"{side}_{s}"), F.lit(0)) for s in ("n", "known", "total", "squares")} for side in "ab")
    return joined.select(
        F.coalesce("entity", "__entity").alias("entity"),
        F.when(here, F.col("key")).otherwise(F.col("__key")).alias("key"),
        (one["n"] + other["n"]).alias("n"),
        (one["known"] + other["known"]).alias("known"),
        F.when(one["known"] + other["known"] > 0, (one["total"] + other["total"]).cast("decimal(38,9)")).alias("total"),
        _spread_of_both(one, other).alias("squares"),
        F.greatest("a_latest", "b_latest").alias("latest"),
    )


def _require_later(df: DataFrame, spec: TableSpec, state: DataFrame) -> None:
    """Every row has to be later than the stored state, or its history would hold later rows."""
    last = state.agg(F.max("latest").alias("last")).first()["last"]
    bounds = df.agg(F.min(spec.time).alias("first"), F.count_if(F.col(spec.time).isNull()).alias("undated")).first()
    if last is not None and (bounds["undated"] or (bounds["first"] is not None and bounds["first"] <= last)):
        raise ValueError(f"rows from {spec.time} {bounds['first']} on ({bounds['undated']} without) do not come after the state, which ends at {last}")


def history_for_unlabelled(
    labelled: DataFrame, unlabelled: DataFrame, spec: TableSpec, **options
) -> DataFrame:
    """Histories of unlabelled rows over the joint stream of both tables.

    Only columns common to both tables are kept.
    """
    shared = [c for c in unlabelled.columns if c in labelled.columns]
    stream = (
        labelled.select(*shared)
        .withColumn("__unlabelled", F.lit(False))
        .unionByName(unlabelled.select(*shared).withColumn("__unlabelled", F.lit(True)))
    )
    return add_history(stream, spec, **options).filter("__unlabelled").drop("__unlabelled")
