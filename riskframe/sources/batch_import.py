"""Import of untyped rows: good rows in, bad rows reported, never a failed batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.session import materialise
from riskframe.sources.files import CSV_OPTIONS, csv_header

ID_MISSING = "transaction id is missing"
ID_NOT_WHOLE = "transaction id is not a whole number"
AMOUNT_NOT_NUMBER = "amount is not a number"

# Wide enough for every bigint, and for the digits by which a number is told from a whole one.
WIDE = "decimal(38,12)"


def _blank_as_null(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def _whole(key: Column) -> Column:
    """The id as a bigint; NULL unless it is a whole number in range, without a detour over doubles."""
    number = key.try_cast(WIDE)
    return F.when(number == F.floor(number), number.cast("decimal(38,0)").try_cast("bigint"))


def _finite(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def checked(raw: DataFrame, id_column: str, amount: str) -> DataFrame:
    """Add ``error``: why a row cannot be imported, NULL for a good row.

    A blank amount is fine (it is stored as 0); an amount that is text is not.
    """
    if id_column not in raw.columns:
        raise ValueError(f"the import has no column {id_column}")
    key, value = _blank_as_null(id_column), _blank_as_null(amount)
    error = (
        F.when(key.isNull(), ID_MISSING)
        .when(_whole(key).isNull(), ID_NOT_WHOLE)
        .when(value.isNotNull() & _finite(value).isNull(), AMOUNT_NOT_NUMBER)
    )
    return raw.withColumn("error", error)


def valid_rows(raw: DataFrame, id_column: str, amount: str) -> DataFrame:
    """The good rows: whole-number id, amount as double with 0.0 for blank.

    Other columns stay text; blank becomes NULL.
    """
    others = [c for c in raw.columns if c not in (id_column, amount)]
    return (
        checked(raw, id_column, amount)
        .filter(F.col("error").isNull())
        .select(
            _whole(F.col(id_column)).alias(id_column),
            F.coalesce(_finite(_blank_as_null(amount)), F.lit(0.0)).alias(amount),
            *[_blank_as_null(c).alias(c) for c in others],
        )
    )


def quarantined_rows(raw: DataFrame, id_column: str, amount: str) -> DataFrame:
    """The rejected rows as they came, with the reason."""
    return checked(raw, id_column, amount).filter(F.col("error").isNotNull())


def numbered_csv(spark: SparkSession, path: str) -> DataFrame:
    """The cells of CSV files as text, with ``file`` (path) and ``row_number`` (the header is row 1) of each row.

    Nothing is sorted: a split is read in order, so a row's place in it is a difference of increasing ids, and the
    splits before it in its file are counted in a pass of their own over a table of one row for each split. Files have to stay as they are meanwhile.
    """
    names = csv_header(spark, path)
    rows = spark.read.options(**CSV_OPTIONS).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__id"),
    )
    splits = materialise(placed.groupBy("file", "__split").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows")), "splits")
    before = Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "__split", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.col("__id") - F.col("__first") + 2
    return placed.join(starts, ["file", "__split"]).select(*[f"`{n}`" for n in names], "file", number.alias("row_number"))


def import_summary(raw: DataFrame, id_column: str, amount: str) -> DataFrame:
    """How many rows came in and how many were rejected, per reason."""
    return (
        checked(raw, id_column, amount)
        .groupBy(F.coalesce("error", F.lit("imported")).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def column_match(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Which of the expected columns a table has, as one row.

    Only the header is looked at; the single row comes from the table's count.
    """
    wanted, present = F.array(*map(F.lit, expected)), F.array(*map(F.lit, df.columns))
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.size(F.array_intersect(wanted, present)).alias("matched_features"),
        F.size(wanted).alias("expected_features"),
        F.array_join(F.array_except(wanted, present), ",").alias("missing_features"),
    )
