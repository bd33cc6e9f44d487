"""Session settings and the folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

ROOT = Path(__file__).resolve().parents[1]


def get_session(app_name: str = "riskframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume.

    ``master`` and cluster sizing (executors, memory, shuffle partitions) are
    left to spark-submit unless given.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for intermediate tables, named in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a folder of
    its own: on a cluster, executors would each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"riskframe-{application}-")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the written table.

    Later steps then read only the columns they need, and a lost executor costs
    a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/riskframe-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """How many tasks a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, unless they find it as the driver does (PYTHONPATH or working folder)."""
    known = [Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    sent = getattr(spark.sparkContext, "_python_includes", [])
    if ROOT in known or "riskframe.zip" in sent:
        return
    path = Path(tempfile.mkdtemp()) / "riskframe.zip"
    with zipfile.ZipFile(path, "w") as packed:
        for file in sorted((ROOT / "riskframe").rglob("*.py")):
            packed.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
