"""A stored table that is changed in place: rows lie in hash buckets, and a batch rewrites only the buckets it touches.

The files of a bucket are never changed. A commit writes new files for some buckets and then appends one small file
of (version, bucket, path) rows to the manifest; the newest row of a bucket says where it is. A reader sees all of a
commit or nothing of it, and a job that dies before the last step has changed nothing. There is one writer at a time;
files that no bucket points to any more stay until they are cleaned up from outside.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import materialise

BUCKETS = 256
COLUMN = "__bucket"


@dataclass(frozen=True)
class BucketTable:
    """Rows keyed by ``keys`` under ``folder``, in ``buckets`` buckets, which may not change later."""

    folder: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def paths(self, spark: SparkSession) -> tuple[int, dict[int, str]]:
        """The newest version and the place of each bucket that has rows; at most ``buckets`` rows."""
        log = spark.read.parquet(f"{self.folder}/manifest").groupBy("bucket")
        found = log.agg(F.max("version").alias("version"), F.max_by("path", "version").alias("path")).collect()
        return max((r.version for r in found), default=0), {r.bucket: r.path for r in found}

    def _commit(self, rows: DataFrame, version: int) -> None:
        spark = rows.sparkSession
        place = f"{self.folder}/data/{uuid.uuid4().hex}"
        # One file for a bucket; of a large one AQE makes several.
        rows.hint("rebalance", COLUMN).write.partitionBy(COLUMN).parquet(place)
        written = spark.read.parquet(place).select(F.col(COLUMN).alias("bucket")).distinct()
        entries = written.select(F.lit(version).cast("bigint").alias("version"), "bucket", F.concat(F.lit(f"{place}/{COLUMN}="), "bucket").alias("path"))
        entries.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def create(self, rows: DataFrame) -> None:
        """The first version. An empty table is stored by its columns alone."""
        rows.limit(0).write.parquet(f"{self.folder}/columns")
        empty = rows.sparkSession.createDataFrame([], "version bigint, bucket int, path string")
        empty.write.parquet(f"{self.folder}/manifest")
        if not rows.isEmpty():
            self._commit(rows.withColumn(COLUMN, self._bucket()), 1)

    def read(self, spark: SparkSession, only: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; only their files are opened."""
        _, paths = self.paths(spark)
        chosen = [p for b, p in sorted(paths.items()) if only is None or b in set(only)]
        columns = spark.read.parquet(f"{self.folder}/columns")
        return spark.read.schema(columns.schema).parquet(*chosen) if chosen else columns

    def upsert(self, batch: DataFrame, newest: Sequence[str]) -> list[int]:
        """Rows of the batch in place of stored ones with the same keys; of several rows of a key the one with the greatest ``newest`` stays.

        A tie goes to the batch. Gives the buckets that were rewritten: the others keep their files, and aren't read. NULL keys are a key.
        """
        spark = batch.sparkSession
        names = spark.read.parquet(f"{self.folder}/columns").columns
        incoming = materialise(batch.select(*names).withColumn(COLUMN, self._bucket()), "batch")
        touched = sorted(r[0] for r in incoming.select(COLUMN).distinct().collect())
        if not touched:
            return []
        version, _ = self.paths(spark)
        stored = self.read(spark, touched).withColumn(COLUMN, self._bucket()).withColumn("__new", F.lit(0))
        both = stored.unionByName(incoming.withColumn("__new", F.lit(1)))
        value = F.struct(*[c for c in names if c not in self.keys])
        latest = both.groupBy(COLUMN, *self.keys).agg(F.max_by(value, F.struct(*newest, "__new")).alias("__value"))
        self._commit(latest.select(*self.keys, "__value.*", COLUMN).select(*names, COLUMN), version + 1)
        return touched
