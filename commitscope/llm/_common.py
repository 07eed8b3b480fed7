"""Shared plumbing of the corpus operators: table reads, shared-storage staging, Arrow helpers.

Staging writes a Parquet table below ``spark.checkpoint.dir`` and reads it back. It cuts lineage the way
``checkpoint()`` does, survives the loss of any executor, and gives Catalyst column pruning and size statistics.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitscope.cluster import ship

#: White space of the contracts: ``[\x20\x09-\x0D]``.
WS = "\\x20\\x09-\\x0D"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one is set only where none is configured and all tasks run on this machine."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="commitscope-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_made: list[str] = []


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that later plans reuse it; removed when the session's JVM ends."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _folder(spark, path)
    files.deleteOnExit(at)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, staged; all that was staged on the way to it is removed."""
    before = len(_made)
    df = make()
    out = staged(df)
    for path in _made[before:-1]:
        files, at = _folder(df.sparkSession, path)
        files.delete(at, True)
    del _made[before:-1]
    return out


def private(df: DataFrame, base: str) -> str:
    """A column name starting with ``base`` that ``df`` does not have (Spark names ignore case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def utf8(col: str) -> F.Column:
    """UTF-8 bytes of a text column, null as empty: binary crosses to Python without decoding."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")
