"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.profile import union_all

CORRUPT = "_corrupt_record"

# CSV conventions of the raw files.
CSV_OPTIONS = {
    "header": True,
    "mode": "PERMISSIVE",
    "nullValue": "",
    "nanValue": "NaN",
    "ignoreLeadingWhiteSpace": True,
    "ignoreTrailingWhiteSpace": True,
}


class DatasetNotFound(FileNotFoundError):
    """A named dataset is not where it should be."""


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV source, from its first line."""
    return spark.read.option("header", True).csv(path).columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = False) -> DataFrame:
    """CSV under an explicit schema. Columns bind by position; blank is NULL.

    A cell that does not parse becomes NULL; with ``keep_corrupt`` its whole
    line is kept in ``_corrupt_record``.
    """
    reader = spark.read.format("csv").options(**CSV_OPTIONS)
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).load(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_report(df: DataFrame, path: str) -> str:
    """A bounded report as one CSV file with a header. Not for data tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise DatasetNotFound(f"no dataset at {path}") from error
        raise


def write_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Parquet, optionally partitioned.

    Rows are gathered per partition value before the write so that tasks do not
    each open a file for every value; AQE splits a value that holds many rows.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def table_inventory(tables: Mapping[str, DataFrame], fingerprint: bool = True) -> DataFrame:
    """Rows, columns and an order-free content fingerprint of every table."""
    parts = []
    for name, df in tables.items():
        measures = [F.count(F.lit(1)).alias("rows")]
        if fingerprint:
            digest = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")
            measures.append(digest.alias("fingerprint"))
        parts.append(df.agg(*measures).select(F.lit(name).alias("table"), F.lit(len(df.columns)).alias("columns"), "*"))
    return union_all(parts)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and change time of the files of a source; contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("path"),
        F.col("length").alias("size_bytes"),
        F.round(F.col("length") / (1024 * 1024), 2).alias("size_mb"),
        F.col("modificationTime").alias("modified_time"),
    )


def _folder(path: str) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _contents(rows: DataFrame) -> DataFrame:
    """Rows and fingerprint of each folder: equal for equal rows in whatever order and files."""
    digest = F.sum(F.xxhash64(*[f"`{c}`" for c in sorted(rows.columns)]).cast("decimal(38,0)")).cast("string")
    schema = sha256(",".join(sorted(f"{n} {t}" for n, t in rows.dtypes)).encode()).hexdigest()
    found = rows.groupBy(_folder("_metadata.file_path").alias("part")).agg(F.count(F.lit(1)).alias("rows"), digest.alias("fingerprint"))
    return found.withColumn("schema_hash", F.lit(schema))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.groupBy(_folder("path").alias("part")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest")
    )


def content_manifest(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """One row for each folder of a Parquet table: its files, rows, content and schema.

    With the manifest of an earlier time only folders are read whose files are not those of then by number, size or time;
    the listing of the others is enough.
    """
    listed = _listed(spark, path)
    if known is None:
        return listed.join(_contents(spark.read.parquet(path)), "part")
    seen = ["part", "files", "bytes", "newest"]
    kept = listed.join(known, seen, "left_semi").join(known, seen)
    fresh = [r.part for r in listed.join(known, seen, "left_anti").select("part").collect()]
    if not fresh:
        return kept.select(*known.columns)
    again = _contents(spark.read.option("basePath", path).parquet(*fresh))
    return kept.select(*known.columns).unionByName(listed.join(again, "part").select(*known.columns))


def compare_manifests(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of each folder: ``kept`` (the same files), ``rewritten`` (other files, equal rows), ``changed``, ``schema``, ``added`` or ``removed``."""
    old, new = before.alias("old"), after.alias("new")
    both = old.join(new, F.col("old.part") == F.col("new.part"), "full_outer")

    def equal(*names: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"old.{n}") == F.col(f"new.{n}") for n in names])

    state = (
        F.when(F.col("old.part").isNull(), "added")
        .when(F.col("new.part").isNull(), "removed")
        .when(~equal("schema_hash"), "schema")
        .when(~equal("rows", "fingerprint"), "changed")
        .when(equal("files", "bytes", "newest"), "kept")
        .otherwise("rewritten")
    )
    return both.select(F.coalesce("old.part", "new.part").alias("part"), F.col("old.rows").alias("rows_before"), F.col("new.rows").alias("rows_after"), state.alias("state"))


def require_size(inventory: DataFrame, at_least_bytes: int) -> None:
    total = inventory.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    if total < at_least_bytes:
        raise ValueError(f"the source files hold {total} bytes, fewer than {at_least_bytes}")
